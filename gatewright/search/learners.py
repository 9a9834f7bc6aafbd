"""Ways to learn a network of many outputs out of searches for smaller ones.

Data are 0/1 arrays, signals by examples. A learner gets a ``Setting`` and returns a
network over all inputs with its outputs in the given order, the order it learnt them in,
and a record of its stages. Every stage has its own evaluator for its own outputs.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace

import numpy as np

from gatewright.model.network import Network, beside, chained, check_permutation, inverse, spacings
from gatewright.operators.curricula import entropy_order, greedy_cover, order_from_rank
from gatewright.search.optimisers import Optimiser, Result
from gatewright.search.state import State


class StageFailed(ValueError):
    """A stage that had to be learnt without error was not."""


@dataclass
class Setting:
    x: np.ndarray
    y: np.ndarray
    optimiser: Optimiser
    budget: int
    functions: Sequence[int]
    rng: np.random.Generator
    order: Sequence[int] | None = None
    apply_mask: bool | str = False
    prefilter: tuple[str, ...] = ()
    shrink: bool = True
    early_terminate: bool = True
    options: dict = field(default_factory=dict)


@dataclass
class Learnt:
    network: Network
    order: list[int]
    extra: dict


def _search(s: Setting, x: np.ndarray, y: np.ndarray, gates: int, stage: int, *, stop_early: bool = True) -> Result:
    network = Network.random(max(gates, len(y)), len(x), len(y), s.functions, s.rng)
    result = s.optimiser.run(State(network, x, y), s.rng)
    if stop_early and s.early_terminate and result.error > 0:
        raise StageFailed(f"stage {stage} ended with error {result.error}")
    return result


def _record(results: Sequence[Result], **more) -> dict:
    return {"best_err": [r.error for r in results], "best_step": [r.best_iteration for r in results], "steps": [r.iteration for r in results], "restarts": [r.restarts for r in results], "partial_networks": [r.network for r in results], **more}


def feature_sets(x: np.ndarray, y: np.ndarray) -> list[list[int]]:
    """A feature set per output, greedily; patterns that occur often count once."""
    out = []
    for row in y:
        both = np.unique(np.vstack([x, row]).T, axis=0).astype(np.int64)
        out.append(greedy_cover(both[:, :-1], both[:, -1]))
    return out


def _ranks(x: np.ndarray, y: np.ndarray) -> tuple[list[int], list[list[int]]]:
    sets = feature_sets(x, y)
    return [sum(len(o) < len(s) for o in sets) for s in sets], sets


def target_order(s: Setting) -> tuple[list[int], list[list[int]] | None]:
    if s.order is not None:
        check_permutation(list(s.order), len(s.y))
        return [int(t) for t in s.order], None
    ranks, sets = _ranks(s.x, s.y)
    return order_from_rank(ranks, s.rng), sets


def monolithic(s: Setting) -> Learnt:
    """One network for all outputs; the guiding function sees them in the target order."""
    order, sets = target_order(s)
    result = _search(s, s.x, s.y[order], s.budget, 0, stop_early=False)
    return Learnt(result.network.reordered(inverse(order)), order, _record([result], feature_sets=sets))


def split(s: Setting) -> Learnt:
    """A network of its own for every output, fed all inputs or its feature set."""
    order = list(range(len(s.y))) if s.order is None else [int(t) for t in s.order]
    check_permutation(order, len(s.y))
    sets = feature_sets(s.x, s.y) if s.apply_mask else [[] for _ in s.y]
    whole, results = None, []
    for stage, (target, gates) in enumerate(zip(order, spacings(s.budget, len(order)), strict=True)):
        feed = sets[target] or list(range(len(s.x)))
        results.append(_search(s, s.x[feed], s.y[[target]], gates, stage))
        whole = beside(whole, results[-1].network, len(s.x), feed)
    return Learnt(whole.reordered(inverse(order)), order, _record(results, feature_sets=sets))


def classifier_chain(s: Setting) -> Learnt:
    """Each output's network is fed the inputs and the true values of earlier outputs; joined, the predicted ones."""
    order, sets = target_order(s)
    results = []
    for stage, (target, gates) in enumerate(zip(order, spacings(s.budget, len(order)), strict=True)):
        results.append(_search(s, np.vstack([s.x, s.y[order[:stage]]]), s.y[[target]], gates, stage))
    return Learnt(chained([r.network for r in results], order), order, _record(results, feature_sets=sets))


def classifier_chain_plus(s: Setting) -> Learnt:
    """A chain whose next output is one of those easiest to tell from inputs and earlier outputs."""
    order, results, sets = [], [], []
    for stage, gates in enumerate(spacings(s.budget, len(s.y))):
        left = [t for t in range(len(s.y)) if t not in order]
        x = np.vstack([s.x, s.y[order]])
        ranks, found = _ranks(x, s.y[left])
        target = left[int(s.rng.choice(np.flatnonzero(np.asarray(ranks) == 0)))]
        sets.append(found)
        results.append(_search(s, x, s.y[[target]], gates, stage))
        order.append(target)
    return Learnt(chained([r.network for r in results], order), order, _record(results, feature_sets=sets))


def ecc_member(s: Setting) -> Learnt:
    """A chain in random order over a bag of the examples."""
    draw = s.rng.integers(s.x.shape[1], size=s.x.shape[1])
    order = [int(t) for t in s.rng.permutation(len(s.y))]
    return classifier_chain(replace(s, x=s.x[:, draw], y=s.y[:, draw], order=order))


def candidates(ni: int, sizes: Sequence[int], previous: Sequence[int] | None, wanted: Sequence[str]) -> list[int]:
    """Sources that a stratum may read: those that the prefilters ``wanted`` name, without any all so far.

    ``sizes``: gates of earlier strata; the first stratum has only inputs to read.
    """
    so_far = ni + sum(sizes)
    sources: dict[str, Sequence[int]] = {
        "all": range(so_far),
        "input": range(ni),
        "prev-strata": range(so_far - sizes[-1] if sizes else so_far, so_far),
        # the target's feature set of the stage before
        "prev-fs": previous or (),
    }
    if not set(wanted) < set(sources):
        raise ValueError(f"unknown prefilters {sorted(set(wanted) - set(sources))}")
    names = (wanted or ["all"]) if sizes else ["input"]
    return sorted({s for name in names for s in sources[name]})


def _stratified(s: Setting, most: int) -> Learnt:
    """Strata one after the other, each fed inputs and inner gates of earlier strata.

    ``most`` outputs of rank 0 are learnt together in a stratum when the order is not given.
    """
    given = None if s.order is None else [int(t) for t in s.order]
    if given is not None:
        check_permutation(given, len(s.y))
    ni, whole, sizes, learnt, results, sets_used, budgets, strata = len(s.x), None, [], [], [], [], [], []
    last_sets: dict[int, list[int]] = {}
    while len(learnt) < len(s.y):
        left = [t for t in range(len(s.y)) if t not in learnt]
        inner = s.x if whole is None else State(whole, s.x, s.y[learnt]).activation()[: ni + whole.ng - whole.no]
        feeds = {t: [f for f in candidates(ni, sizes, last_sets.get(t), s.prefilter) if f < len(inner)] or list(range(len(inner))) for t in left}
        found: dict[int, list[int]] = {}
        if s.apply_mask or given is None:
            # feature sets of the targets in question, in numbers of the whole network
            asked = left if given is None else [given[len(learnt)]]
            found = {t: [feeds[t][i] for i in feature_sets(inner[feeds[t]], s.y[[t]])[0]] for t in asked}
        if given is not None:
            targets = [given[len(learnt)]]
        else:
            fewest = min(len(found[t]) for t in left)
            easiest = [t for t in left if len(found[t]) == fewest]
            targets = [int(t) for t in s.rng.permutation(easiest)][:most]
        last_sets |= found
        if s.apply_mask == "prefilter":
            feed = sorted(set().union(*(feeds[t] for t in targets)))
        elif s.apply_mask:
            feed = sorted(set().union(*(found[t] for t in targets)))
        else:
            feed = []
        feed = feed or list(range(len(inner)))
        gates = (s.budget - (0 if whole is None else whole.ng)) // len(left) * len(targets)
        result = _search(s, inner[feed], s.y[targets], gates, len(strata))
        whole = beside(whole, result.network, ni, feed)
        if s.shrink:
            whole = whole.shrunk()
        learnt += targets
        strata.append(targets)
        results.append(result)
        sets_used.append([found.get(t) for t in targets])
        budgets.append(gates - len(targets))
        sizes.append(whole.ng - whole.no - sum(sizes))
    return Learnt(whole.reordered(inverse(learnt)), learnt, _record(results, feature_sets=sets_used, strata=strata, strata_budgets=budgets, strata_sizes=sizes))


def stratified(s: Setting) -> Learnt:
    return _stratified(s, 1)


def stratified_parallel(s: Setting) -> Learnt:
    """Strata that learn all equally easy outputs together."""
    return _stratified(s, len(s.y))


def _entropies(y: np.ndarray) -> np.ndarray:
    n, ne = y.shape
    h = np.zeros((n, n))
    for i in range(n):
        for j in range(n):
            joint = np.bincount(2 * y[i].astype(int) + y[j], minlength=4).reshape(2, 2)
            for b in (0, 1):
                nb = joint[:, b].sum()
                h[i, j] -= sum(v / ne * np.log2(v / nb) for v in joint[:, b] if v)
    return np.abs(h)


def _effects(y: np.ndarray, steps: int) -> np.ndarray:
    n = len(y)
    e = np.zeros((n, n))
    for i in range(n):
        if y[i].any() and not y[i].all():
            e[i] = np.abs(y[:, y[i] == 0].mean(axis=1) - y[:, y[i] == 1].mean(axis=1))
    np.fill_diagonal(e, 0)
    total = e.sum(axis=0)
    return np.linalg.matrix_power(e / np.where(total == 0, 1, total), steps).sum(axis=1)


def a_priori(s: Setting) -> Learnt:
    """An order from the data first (options ``method``: minfs, CEbCC or label_effects), then another learner (``sublearner``)."""
    options = dict(s.options)
    method, inner = options.get("method") or "minfs", options.get("sublearner") or "classifierchain"
    if method == "minfs":
        order = order_from_rank(_ranks(s.x, s.y)[0], s.rng)
    elif method == "CEbCC":
        order = entropy_order(_entropies(s.y), int(options.get("variant", 1)), s.rng)
    elif method == "label_effects":
        v = np.round(_effects(s.y, int(options.get("t", 1))), 12)
        order = order_from_rank([int((v > w).sum()) for w in v], s.rng)
    else:
        raise ValueError(f"unknown curriculum {method!r}")
    got = learner(inner)(replace(s, order=order))
    return Learnt(got.network, got.order, got.extra | {"sublearner": inner})


LEARNERS: dict[str, Callable[[Setting], Learnt]] = {
    "monolithic": monolithic, "split": split, "classifierchain": classifier_chain, "classifierchain_plus": classifier_chain_plus, "ecc_member": ecc_member,
    "stratified": stratified, "stratmultipar": stratified_parallel, "wrapper": a_priori,
}


def learner(name: str) -> Callable[[Setting], Learnt]:
    if name not in LEARNERS:
        raise ValueError(f"unknown learner {name!r}; there are {', '.join(LEARNERS)}")
    return LEARNERS[name]
