"""A network bound to a small example table, bit-sliced, for search inside a task.

Every signal is one whole number whose bit i is its value for example i: a gate is one or
two operations on whole numbers, whatever the number of examples, and counting ones is
``int.bit_count``. A move re-evaluates only the gates from the lowest changed one on.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

from gatewright.functions.gates import TABLE
from gatewright.model.network import Move, Network

def pack_rows(bits: np.ndarray) -> list[int]:
    """Rows of 0/1 as whole numbers, the first example in the lowest bit."""
    return [int.from_bytes(np.packbits(row, bitorder="little").tobytes(), "little") for row in np.asarray(bits, dtype=np.uint8)]


def unpack_rows(signals: Sequence[int], ne: int) -> np.ndarray:
    n = -(-ne // 8)
    raw = np.frombuffer(b"".join(s.to_bytes(n, "little") for s in signals), dtype=np.uint8).reshape(len(signals), n)
    return np.unpackbits(raw, axis=1, bitorder="little")[:, :ne]


class State:
    def __init__(self, network: Network, x: np.ndarray, y: np.ndarray) -> None:
        """x: inputs by examples, y: outputs by examples, as 0/1."""
        if x.shape[0] != network.ni or y.shape[0] != network.no or x.shape[1] != y.shape[1]:
            raise ValueError("inputs, outputs and examples don't fit the network")
        self.ne, self.ni, self.no, self.ng = x.shape[1], network.ni, network.no, network.ng
        self.target, self.ones = pack_rows(y), (1 << self.ne) - 1
        self.act = pack_rows(x) + [0] * self.ng
        self._past: list[tuple[int, tuple]] = []
        self.set_network(network)

    def set_network(self, network: Network) -> None:
        self.gates = list(network.gates)
        self._past.clear()
        self._dirty = 0
        self._live: list[int] | None = None

    @property
    def network(self) -> Network:
        return Network(tuple(self.gates), self.ni, self.no)

    def apply(self, move: Move) -> None:
        gate = list(self.gates[move.gate])
        self._past.append((move.gate, self.gates[move.gate]))
        gate[move.terminal] = move.new_source
        self.gates[move.gate] = tuple(gate)  # type: ignore[assignment]
        self._dirty, self._live = min(self._dirty, move.gate), None

    def revert(self) -> None:
        if not self._past:
            raise RuntimeError("there is no move to take back")
        g, gate = self._past.pop()
        self.gates[g] = gate
        self._dirty, self._live = min(self._dirty, g), None

    def clear(self) -> None:
        self._past.clear()

    def random_move(self, rng: np.random.Generator) -> None:
        if self._live is None:
            live, reached = [], [False] * (self.ni + self.ng)
            for s in range(self.ni + self.ng - self.no, self.ni + self.ng):
                reached[s] = True
            for g in range(self.ng - 1, -1, -1):
                if reached[self.ni + g]:
                    live.append(g)
                    a, b, _ = self.gates[g]
                    reached[a] = reached[b] = True
            self._live = live
        g, terminal = self._live[int(rng.integers(len(self._live)))], int(rng.integers(2))
        n, old = self.ni + min(g, self.ng - self.no), self.gates[g][terminal]
        if n < 2:
            new = old
        elif old >= n:
            new = int(rng.integers(n))
        else:
            new = int(rng.integers(n - 1))
            new += new >= old
        self.apply(Move(g, terminal, new))

    def errors(self) -> list[int]:
        """The error signals of the outputs, evaluated from the lowest changed gate on."""
        act, m, ni, table = self.act, self.ones, self.ni, TABLE
        for g in range(self._dirty, self.ng):
            a, b, k = self.gates[g]
            act[ni + g] = table[k](act[a], act[b], m)
        self._dirty = self.ng
        return [o ^ t for o, t in zip(act[-self.no :], self.target, strict=True)]

    def activation(self) -> np.ndarray:
        """All signals as 0/1, one row per source."""
        self.errors()
        return unpack_rows(self.act, self.ne)


def _or(signals: Sequence[int]) -> int:
    out = 0
    for s in signals:
        out |= s
    return out


def metric(name: str, errors: Sequence[int], target: Sequence[int], ne: int, *, weights: Sequence[float] | None = None, dependencies: Sequence[Sequence[int]] | None = None, threshold: float = 0.0) -> float | np.ndarray:
    """A function of error and target signals."""
    no = len(errors)
    cells = no * ne
    c = [e.bit_count() for e in errors]
    if name == "e1":
        return sum(c) / cells
    if name in ("e3", "e4"):
        total, so_far = 0, 0
        for e in errors:
            so_far = so_far | e if name == "e3" else max(so_far, _flood(e, ne))
            total += so_far.bit_count() if name == "e3" else so_far
        return total / cells
    if name == "e3_general":
        return sum(_or([errors[r], *(errors[d] for d in deps)]).bit_count() for r, deps in enumerate(dependencies or [])) / cells
    if name == "correctness":
        return 1 - _or(errors).bit_count() / ne
    first = next((r for r in range(no) if c[r]), None)
    if name in ("e5", "e6"):
        return 0.0 if first is None else (ne * (no - first - 1) + (_flood(errors[first], ne) if name == "e5" else c[first])) / cells
    if name == "e7":
        return 0.0 if first is None else (no - first) / no
    mean = [n / ne for n in c]
    if name == "per_output_error":
        return np.array(mean)
    if name == "e6_thresholded":
        total, over = 0.0, False
        for share in mean:
            total += 1.0 if over else share
            over = over or share > threshold
        return total / no
    if name == "e6_general":
        return sum(1.0 if any(mean[d] > threshold for d in deps) else mean[r] for r, deps in enumerate(dependencies or [])) / no
    given = list(range(no, 0, -1)) if weights is None else list(weights)
    if name == "e2":
        return sum(w * share for w, share in zip(given, mean, strict=True)) / sum(given)
    if name == "e6_mcc" and first is None:
        return 0.0
    wanted = [first] if name == "e6_mcc" else range(no)
    mcc = [_mcc(ne, c[r], target[r].bit_count(), (errors[r] & target[r]).bit_count()) for r in wanted]
    if name == "per_output_mcc":
        return np.array(mcc)
    if name == "macro_mcc":
        return sum(mcc) / no
    if name == "e2_mcc":
        return sum(w * v for w, v in zip(given, mcc, strict=True)) / sum(given)
    if name == "e6_mcc":
        return (mcc[0] - (no - first - 1)) / no
    raise ValueError(f"unknown function {name!r}")


def _flood(e: int, ne: int) -> int:
    """Examples from the first error to the last example."""
    return ne - ((e & -e).bit_length() - 1) if e else 0


def _mcc(ne: int, c: int, p: int, fn: int) -> float:
    tp, fp = p - fn, c - fn
    tn = ne - p - fp
    if p in (0, ne):
        return 2 * (ne - c) / ne - 1
    if tp + fp == 0 or tn + fn == 0:
        return 0.0
    return (tp * tn - fp * fn) / ((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)) ** 0.5
