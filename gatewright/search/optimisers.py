"""Hill climbing, late acceptance and annealing over a task's state.

Costs are turned so that lower is better, whatever the function's direction; restarts
return the best run. Everything is driven by one seeded generator, so a task that is
retried on another executor gives the same result.
"""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np

from gatewright.model.network import Network
from gatewright.operators.metrics import is_minimiser, optimum
from gatewright.search.state import State, metric


@dataclass(frozen=True)
class Result:
    network: Network
    error: float
    best_iteration: int
    iteration: int
    restarts: int


def geometric(start: float, rate: float, n: int) -> list[float]:
    return [start * rate**i for i in range(n)]


def stepped(start: float, rate: float, n: int, steps: int) -> Iterator[float]:
    """Each level of the schedule for a number of steps."""
    for level in geometric(start, rate, n):
        yield from (level for _ in range(steps))


def scaled(size: int | str, n: int) -> int:
    """A size given as a number, as ``kn`` (k times n) or ``kn2`` (k times n squared)."""
    text = str(size)
    for ending, power in (("n2", 2), ("n", 1)):
        if text.endswith(ending):
            return int(text[: -len(ending)]) * n**power
    return int(size)


@dataclass
class Optimiser:
    """``guiding`` steers; the search stops when ``stop`` (a function name or the guiding one) reaches ``limit``."""

    name: str = "LAHC"
    guiding: str = "e1"
    stop: str | None = None
    limit: float | None = None
    max_iterations: int = 1000
    max_restarts: int = 0
    cost_list_length: int = 50
    num_temps: int = 20
    steps_per_temp: int = 50
    init_temp: float = 0.1
    temp_rate: float = 0.9
    options: dict | None = None
    return_option: str = "best"

    def cost(self, state: State, name: str | None = None) -> float:
        name = name or self.guiding
        value = metric(name, state.errors(), state.target, state.ne, **(self.options or {}))
        if np.ndim(value):
            raise ValueError(f"{name} can't guide a search; it has a value per output")
        return float(value) if is_minimiser(name) else -float(value)

    def _stopped(self, state: State, cost: float) -> bool:
        name = self.stop or self.guiding
        # a perfect network has the value 0 of this function, so its optimum of 1 is never met
        best = 0.0 if name == "e6_mcc" and self.limit is None else optimum(name) if self.limit is None else self.limit
        if name == "e6_mcc" and self.limit is None:
            return not any(state.errors())
        now = cost if name == self.guiding else self.cost(state, name)
        return now <= (best if is_minimiser(name) else -best)

    def run(self, state: State, rng: np.random.Generator) -> Result:
        walks: dict[str, Callable[[State, np.random.Generator], Result]] = {"HC": self._climb, "LAHC": self._late, "SA": self._anneal}
        if self.name not in walks:
            raise ValueError(f"unknown optimiser {self.name!r}; there are {', '.join(walks)}")
        best: tuple[float, Result] | None = None
        for restart in range(self.max_restarts + 1):
            if restart:
                state.set_network(state.network.randomised(rng))
            got = walks[self.name](state, rng)
            state.set_network(got.network)
            cost = self.cost(state)
            if best is None or cost < best[0]:
                best = cost, Result(got.network, cost if is_minimiser(self.guiding) else -cost, got.best_iteration, got.iteration, restart)
            if self._stopped(state, cost):
                break
        state.set_network(best[1].network)
        return best[1]

    def _walk(self, state: State, rng: np.random.Generator, accept: Callable[[int, float, float], bool], n: int) -> Result:
        now = self.cost(state)
        best, best_at, kept, i = now, 0, state.network, 0
        while i < n and not self._stopped(state, now):
            i += 1
            state.random_move(rng)
            new = self.cost(state)
            if accept(i, now, new):
                now = new
                state.clear()
                if now < best:
                    best, best_at, kept = now, i, state.network
            else:
                state.revert()
        return Result(kept if self.return_option == "best" else state.network, best, best_at, i, 0)

    def _climb(self, state: State, rng: np.random.Generator) -> Result:
        return self._walk(state, rng, lambda _, now, new: new <= now, self.max_iterations)

    def _late(self, state: State, rng: np.random.Generator) -> Result:
        return self._walk(state, rng, late_acceptance(self.cost(state), self.cost_list_length), self.max_iterations)

    def _anneal(self, state: State, rng: np.random.Generator) -> Result:
        levels = list(stepped(self.init_temp, self.temp_rate, self.num_temps, self.steps_per_temp))
        chance = lambda i, now, new: new <= now or (levels[i - 1] > 0 and rng.random() < math.exp((now - new) / levels[i - 1]))
        return self._walk(state, rng, chance, len(levels))


def late_acceptance(first: float, length: int) -> Callable[[int, float, float], bool]:
    """Accept what is no worse than now, or better than the cost ``length`` steps ago."""
    past = deque([first] * length, maxlen=length)

    def accept(_: int, now: float, new: float) -> bool:
        ok = new <= now or new < past[0]
        past.append(new if ok else now)
        return ok

    return accept
