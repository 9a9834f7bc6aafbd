"""Feed-forward networks of two-input gates, and what can be done to them as graphs.

A network is metadata: hundreds of gates, not rows. Source numbers 0..ni-1 are inputs,
ni+g is gate g; the last ``no`` gates are the outputs. Networks are immutable values, so
undoing moves is keeping the older value; ``Editor`` adds the undo history that a search needs.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass, replace
from functools import cached_property

import numpy as np

Gate = tuple[int, int, int]


@dataclass(frozen=True)
class Network:
    gates: tuple[Gate, ...]
    ni: int
    no: int

    def __post_init__(self) -> None:
        if any(len(tuple(g)) != 3 for g in self.gates):
            raise ValueError("a gate is (source, source, transfer function)")
        object.__setattr__(self, "gates", tuple((int(a), int(b), int(k)) for a, b, k in self.gates))
        if self.ni < 1:
            raise ValueError("a network has at least one input")
        if not 0 < self.no <= len(self.gates):
            raise ValueError("a network has at least one output, and no more outputs than gates")
        for g, (a, b, k) in enumerate(self.gates):
            if not 0 <= k <= 15:
                raise ValueError(f"gate {g}: transfer function {k} is not in 0..15")
            if not (0 <= a < self.ni + g and 0 <= b < self.ni + g):
                raise ValueError(f"gate {g}: sources {a}, {b} don't all come before it")

    @classmethod
    def of(cls, gates: Iterable[Sequence[int]], ni: int, no: int) -> Network:
        return cls(tuple(tuple(g) for g in gates), ni, no)  # type: ignore[arg-type]

    @property
    def ng(self) -> int:
        return len(self.gates)

    @property
    def outputs(self) -> range:
        """Source numbers of the outputs."""
        return range(self.ni + self.ng - self.no, self.ni + self.ng)

    @cached_property
    def connected(self) -> tuple[bool, ...]:
        """Per source, whether an output depends on it (outputs depend on themselves)."""
        live = [False] * (self.ni + self.ng)
        for s in self.outputs:
            live[s] = True
        for g in reversed(range(self.ng)):
            if live[self.ni + g]:
                live[self.gates[g][0]] = live[self.gates[g][1]] = True
        return tuple(live)

    def connected_sources(self) -> list[int]:
        return [s for s, live in enumerate(self.connected) if live]

    def connected_gates(self) -> list[int]:
        return [s - self.ni for s in self.connected_sources() if s >= self.ni]

    @cached_property
    def levels(self) -> tuple[int, ...]:
        """Per source, the length of the longest path from an input to it."""
        depth = [0] * self.ni
        for a, b, _ in self.gates:
            depth.append(1 + max(depth[a], depth[b]))
        return tuple(depth)

    def depths(self) -> list[int]:
        """The level of each output."""
        return [self.levels[s] for s in self.outputs]

    def shrunk(self) -> Network:
        """The network without gates that no output depends on; it computes the same."""
        keep = self.connected_gates()
        number = {s: s for s in range(self.ni)} | {self.ni + g: self.ni + i for i, g in enumerate(keep)}
        return Network(tuple((number[a], number[b], k) for a, b, k in (self.gates[g] for g in keep)), self.ni, self.no)

    def reordered(self, order: Sequence[int]) -> Network:
        """The network whose output i is output ``order[i]`` of this one."""
        check_permutation(order, self.no)
        body, out = self.gates[: -self.no], self.gates[-self.no :]
        return Network(body + tuple(out[i] for i in order), self.ni, self.no)

    # moves

    def sources_allowed(self, gate: int) -> range:
        """Sources that a gate may take: anything before it but outputs."""
        return range(self.ni + min(gate, self.ng - self.no))

    def random_move(self, rng: np.random.Generator) -> Move:
        """One terminal of one connected gate to another source; the same source if there is no other."""
        live = self.connected_gates()
        gate, terminal = live[rng.integers(len(live))], int(rng.integers(2))
        old, choice = self.gates[gate][terminal], self.sources_allowed(gate)
        if len(choice) < 2:
            return Move(gate, terminal, old)
        if old not in choice:
            return Move(gate, terminal, int(rng.integers(len(choice))))
        new = int(rng.integers(len(choice) - 1))
        return Move(gate, terminal, new + (new >= old))

    def moved(self, move: Move) -> Network:
        gates = list(self.gates)
        gate = list(gates[move.gate])
        gate[move.terminal] = move.new_source
        gates[move.gate] = tuple(gate)  # type: ignore[call-overload]
        return replace(self, gates=tuple(gates))

    def randomised(self, rng: np.random.Generator) -> Network:
        """New sources for every gate, the same transfer functions."""
        return Network(tuple((*(int(s) for s in rng.integers(len(self.sources_allowed(g)), size=2)), k) for g, (_, _, k) in enumerate(self.gates)), self.ni, self.no)  # type: ignore[misc]

    @classmethod
    def random(cls, ng: int, ni: int, no: int, functions: Sequence[int], rng: np.random.Generator) -> Network:
        if not functions or any(not 0 <= f <= 15 for f in functions):
            raise ValueError("transfer functions have to be in 0..15")
        kinds = rng.choice(np.asarray(functions), size=ng)
        blank = cls(tuple((0, 0, int(k)) for k in kinds), ni, no)
        return blank.randomised(rng)


@dataclass(frozen=True)
class Move:
    gate: int
    terminal: int
    new_source: int


class Editor:
    """A network under change, with the history needed to take changes back."""

    def __init__(self, network: Network) -> None:
        self.network, self._past = network, []

    def apply(self, move: Move) -> None:
        self._past.append(self.network)
        self.network = self.network.moved(move)

    def revert(self) -> None:
        if not self._past:
            raise RuntimeError("there is no move to take back")
        self.network = self._past.pop()

    def revert_all(self) -> None:
        if self._past:
            self.network = self._past[0]
        self._past.clear()

    def clear(self) -> None:
        self._past.clear()

    @property
    def is_clean(self) -> bool:
        return not self._past


def check_permutation(order: Sequence[int], n: int) -> None:
    if sorted(order) != list(range(n)):
        raise ValueError(f"{list(order)} is no permutation of 0..{n - 1}")


def inverse(order: Sequence[int]) -> list[int]:
    check_permutation(order, len(order))
    return [i for i, _ in sorted(enumerate(order), key=lambda p: p[1])]


def _renumbered(gates: Iterable[Gate], number) -> tuple[Gate, ...]:
    return tuple((number(a), number(b), k) for a, b, k in gates)


def chained(networks: Sequence[Network], learned_order: Sequence[int]) -> Network:
    """Single-output networks, each fed the inputs and all earlier outputs, as one network.

    Network i gives output ``learned_order[i]``. One OR gate per output puts them in order.
    """
    check_permutation(learned_order, len(networks))
    ni, gates, ends = networks[0].ni, (), []
    for i, net in enumerate(networks):
        if net.ni != ni + i or net.no != 1:
            raise ValueError(f"network {i} of a chain has {ni} + {i} inputs and one output")
        base = ni + len(gates)
        feed = [*range(ni), *ends]
        gates += _renumbered(net.gates, lambda s: feed[s] if s < len(feed) else base + s - len(feed))  # noqa: B023
        ends.append(base + net.ng - 1)
    gates += tuple((ends[i], ends[i], 14) for i in inverse(learned_order))
    return Network(gates, ni, len(networks))


def beside(base: Network | None, new: Network, ni: int, inputs: Sequence[int] | None = None) -> Network:
    """``new`` added to ``base`` (None: nothing yet): inner gates of both, then outputs of both.

    ``inputs[j]`` is the source of ``base`` that input j of ``new`` reads: an input or an
    inner gate. By default input j is source j.
    """
    inputs = list(range(new.ni)) if inputs is None else list(inputs)
    inner = () if base is None else base.gates[: -base.no]
    out = () if base is None else base.gates[-base.no :]
    if len(inputs) != new.ni or any(not 0 <= s < ni + len(inner) for s in inputs):
        raise ValueError("the added network can't be fed from these sources")
    first, body = ni + len(inner), new.ng - new.no
    number = lambda s: inputs[s] if s < new.ni else first + s - new.ni + (len(out) if s - new.ni >= body else 0)
    # output gates of the base move back behind the new inner gates; nothing may read them
    shift = lambda s: s if s < first else s + body
    added = _renumbered(new.gates, number)
    return Network(inner + added[:body] + _renumbered(out, shift) + added[body:], ni, len(out) + new.no)


def spacings(n: int, k: int, *, low_first: bool = True) -> list[int]:
    """n as a sum of k near-equal whole numbers, the smaller ones first (or last)."""
    if k < 1:
        raise ValueError("k has to be at least 1")
    parts = [n // k + (i >= k - n % k) for i in range(k)]
    return parts if low_first else parts[::-1]
