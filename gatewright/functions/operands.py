"""Arithmetic and bit operators on the operands that an example number holds.

An example number holds one operand of ``nb`` bits, or two: the first in the high bits, the
second in the low ones.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

UNARY = ("zero", "not", "unary_and", "unary_or")
BINARY = ("and", "or", "xor", "add", "sub", "mul")
OPERATORS = UNARY + BINARY


def operand_count(operator: str) -> int:
    if operator not in OPERATORS:
        raise ValueError(f"unknown operator {operator!r}; there are {', '.join(OPERATORS)}")
    return 1 if operator in UNARY else 2


def input_width(operator: str, nb: int) -> int:
    if nb < 1:
        raise ValueError("an operand has at least one bit")
    return operand_count(operator) * nb


def default_outputs(operator: str, nb: int) -> int:
    """As many outputs as an operand has bits, unless told otherwise."""
    return nb if operand_count(operator) else 0


def expression(operator: str, nb: int, example: Column) -> Column:
    """The operator's value for an example number, a bigint."""
    operand_count(operator)
    x = example.cast("bigint")
    full = (1 << nb) - 1
    a, b = F.shiftright(x, nb), x.bitwiseAND(F.lit(full))
    made: dict[str, Callable[[], Column]] = {
        "zero": lambda: F.lit(0).cast("bigint"),
        "not": lambda: x.bitwiseXOR(F.lit(full)),
        "unary_and": lambda: (x == full).cast("bigint"),
        "unary_or": lambda: (x != 0).cast("bigint"),
        "and": lambda: a.bitwiseAND(b),
        "or": lambda: a.bitwiseOR(b),
        "xor": lambda: a.bitwiseXOR(b),
        "add": lambda: a + b,
        "sub": lambda: F.pmod(a - b, F.lit(full + 1)),
        "mul": lambda: a * b,
    }
    return made[operator]()


def values(operator: str, nb: int, examples: np.ndarray) -> np.ndarray:
    """The operator on a vector of example numbers."""
    operand_count(operator)
    full = (1 << nb) - 1
    x = examples.astype(np.int64)
    a, b = x >> nb, x & full
    made: dict[str, Callable[[], np.ndarray]] = {
        "zero": lambda: np.zeros_like(x), "not": lambda: x ^ full, "unary_and": lambda: (x == full).astype(np.int64), "unary_or": lambda: (x != 0).astype(np.int64), "and": lambda: a & b, "or": lambda: a | b,
        "xor": lambda: a ^ b, "add": lambda: a + b, "sub": lambda: (a - b) % (full + 1), "mul": lambda: a * b,
    }
    return made[operator]()


def value(operator: str, nb: int, example: int) -> int:
    """The operator on a plain number, for use inside tasks."""
    operand_count(operator)
    full = (1 << nb) - 1
    a, b = example >> nb, example & full
    return {
        "zero": 0, "not": example ^ full, "unary_and": int(example == full), "unary_or": int(example != 0), "and": a & b, "or": a | b,
        "xor": a ^ b, "add": a + b, "sub": (a - b) % (full + 1), "mul": a * b,
    }[operator]
