"""The 16 two-input transfer functions, as expressions over 0/1 columns, packed words, vectors and whole numbers.

Function k gives bit (2x + y) of k for inputs x and y. ``TABLE`` writes each one once, over
any values that know and, or and exclusive or; ``ones`` is what stands for all ones (1 for
single bits, -1 for words of two's complement, a mask for whole numbers).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

NAMES = ["false", "nor", "not_x_and_y", "not_x", "x_and_not_y", "not_y", "xor", "nand", "and", "xnor", "y", "not_x_or_y", "x", "x_or_not_y", "or", "true"]

#: The functions by number (fixed values).
TABLE: list[Callable] = [
    lambda x, y, ones: ones ^ ones,
    lambda x, y, ones: (x | y) ^ ones,
    lambda x, y, ones: (x ^ ones) & y,
    lambda x, y, ones: x ^ ones,
    lambda x, y, ones: x & (y ^ ones),
    lambda x, y, ones: y ^ ones,
    lambda x, y, ones: x ^ y,
    lambda x, y, ones: (x & y) ^ ones,
    lambda x, y, ones: x & y,
    lambda x, y, ones: x ^ y ^ ones,
    lambda x, y, ones: y,
    lambda x, y, ones: (x ^ ones) | y,
    lambda x, y, ones: x,
    lambda x, y, ones: x | (y ^ ones),
    lambda x, y, ones: x | y,
    lambda x, y, ones: ones,
]


class _Bits:
    """A column whose operators are the bitwise ones (those of Column are logical)."""

    def __init__(self, column: Column) -> None:
        self.column = column

    def __and__(self, other: _Bits) -> _Bits:
        return _Bits(self.column.bitwiseAND(other.column))

    def __or__(self, other: _Bits) -> _Bits:
        return _Bits(self.column.bitwiseOR(other.column))

    def __xor__(self, other: _Bits) -> _Bits:
        return _Bits(self.column.bitwiseXOR(other.column))


def value(k: int, x: int, y: int) -> int:
    """The function on two plain bits."""
    return k >> (2 * x + y) & 1


def gate(k: int, x: Column, y: Column, *, packed: bool = False) -> Column:
    """The function on columns of bits (0/1 integers), or on packed words if ``packed``."""
    if not 0 <= k <= 15:
        raise ValueError(f"transfer function {k} is not in 0..15")
    ones = F.lit(-1).cast("bigint") if packed else F.lit(1)
    return TABLE[k](_Bits(x), _Bits(y), _Bits(ones)).column
