"""The evaluators: error and quality functions of an (example x output) error table.

All of them come from one ``profile``: a single aggregation with map-side combination that
keeps, per group, a few numbers for each output. What is left is arithmetic over at most
``no`` columns of one row per group. The order-dependent functions need the rank of an
output's first error; it is not found by ordering all examples but by the least id with an
error (first aggregation) and the number of examples with a lower id (second one).

Error tables hold e0.. and t0.. in {0, 1}; output 0 is the most important one. Without
examples every function is null.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Functions by name: (is it minimised, its optimum, is it a vector).
FUNCTIONS: dict[str, tuple[bool, float, bool]] = {
    "e1": (True, 0, False), "e2": (True, 0, False), "e3": (True, 0, False), "e3_general": (True, 0, False), "e4": (True, 0, False), "e5": (True, 0, False), "e6": (True, 0, False),
    "e6_thresholded": (True, 0, False), "e6_general": (True, 0, False), "e7": (True, 0, False), "correctness": (False, 1, False), "per_output_error": (True, 0, True),
    "per_output_mcc": (False, 1, True), "macro_mcc": (False, 1, False), "e2_mcc": (False, 1, False), "e6_mcc": (False, 1, False),
}


def function_names(*, scalar: bool | None = None) -> list[str]:
    """All functions, or only the scalar or per-output ones."""
    return [n for n, (_, _, vector) in FUNCTIONS.items() if scalar is None or vector != scalar]


def is_minimiser(name: str) -> bool:
    return _known(name)[0]


def optimum(name: str) -> float:
    return _known(name)[1]


def _known(name: str) -> tuple[bool, float, bool]:
    if name not in FUNCTIONS:
        raise ValueError(f"unknown function {name!r}; there are {', '.join(FUNCTIONS)}")
    return FUNCTIONS[name]


def profile(errors: DataFrame, no: int, *, by: Sequence[str] = (), dependencies: Sequence[Sequence[int]] | None = None, order: str | None = None) -> DataFrame:
    """One row per group with everything the functions need.

    ne; per output r: c{r} errors, p{r} positive targets, b{r} errors at positive targets;
    h, sum over examples and outputs of "an error here or before"; w, examples with any error;
    g, the same as h for the listed ``dependencies`` (own errors and those of the listed
    outputs); with ``order``, f{r}: examples from the first error of r to the last example.
    """
    e, t = [F.col(f"e{r}") for r in range(no)], [F.col(f"t{r}") for r in range(no)]
    running = [F.greatest(*e[: r + 1]) if r else e[0] for r in range(no)]
    total = lambda c: F.sum(c.cast("bigint"))
    kept = [F.count(F.lit(1)).alias("ne"), total(sum(running[1:], running[0])).alias("h"), total(running[-1]).alias("w")]
    for r in range(no):
        kept += [total(e[r]).alias(f"c{r}"), total(t[r]).alias(f"p{r}"), total(e[r] * t[r]).alias(f"b{r}")]
    if dependencies is not None:
        _check(dependencies, no)
        own = [F.greatest(e[r], *(e[d] for d in deps)) if deps else e[r] for r, deps in enumerate(dependencies)]
        kept.append(total(sum(own[1:], own[0])).alias("g"))
    if order is None:
        return errors.groupBy(*by).agg(*kept) if by else errors.agg(*kept)
    firsts = [F.min(F.when(e[r] == 1, F.col(order))).alias(f"__gw_first{r}") for r in range(no)]
    if by:
        first = errors.groupBy(*by).agg(*firsts)
        names = [f"__gw_by{i}" for i in range(len(by))]
        right = first.select(*(F.col(f"`{c}`").alias(n) for c, n in zip(by, names, strict=True)), *(f"__gw_first{r}" for r in range(no)))
        same = reduce(lambda a, b: a & b, (errors[c].eqNullSafe(right[n]) for c, n in zip(by, names, strict=True)))
        placed, at = errors.join(right, same), [F.col(f"__gw_first{r}") for r in range(no)]
    else:
        # one row, read as a scalar subquery: nothing is joined
        all_firsts = errors.agg(F.struct(*firsts)).scalar()
        placed, at = errors, [all_firsts[f"__gw_first{r}"] for r in range(no)]
    floods = [F.count(F.when(F.col(order) >= at[r], F.lit(1))).alias(f"f{r}") for r in range(no)]
    return placed.groupBy(*by).agg(*kept, *floods) if by else placed.agg(*kept, *floods)


def _check(dependencies: Sequence[Sequence[int]], no: int) -> None:
    if len(dependencies) != no or any(not 0 <= d < no for deps in dependencies for d in deps):
        raise ValueError(f"dependencies are {no} lists of outputs")


def weights(no: int, given: Sequence[float] | None = None) -> list[float]:
    """no, no-1, .. 1 unless given; made to sum to 1."""
    raw = [float(no - r) for r in range(no)] if given is None else [float(w) for w in given]
    if len(raw) != no or sum(raw) == 0:
        raise ValueError(f"weights are {no} numbers that don't sum to 0")
    return [w / sum(raw) for w in raw]


def _d(c: Column) -> Column:
    return c.cast("double")


def _sum(columns: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)


def _first(no: int, amount: Callable[[int], Column], value: Callable[[int], Column], none: float) -> Column:
    """value(r) of the first output with amount(r) > 0."""
    return F.coalesce(*(F.when(amount(r) > 0, value(r)) for r in range(no)), F.lit(none))


def output_mcc(r: int) -> Column:
    """Matthews correlation of output r; 2 accuracy - 1 for a constant target, 0 for a constant prediction."""
    ne, c, p, b = (_d(F.col(n)) for n in ("ne", f"c{r}", f"p{r}", f"b{r}"))
    tp, fn, fp = p - b, b, c - b
    tn = ne - p - fp
    constant_target, constant_output = (p == 0) | (p == ne), (tp + fp == 0) | (tn + fn == 0)
    bottom = F.sqrt((tp + fp) * (tp + fn)) * F.sqrt((tn + fp) * (tn + fn))
    return F.when(ne == 0, F.lit(None)).when(constant_target, 2 * (ne - c) / ne - 1).when(constant_output, F.lit(0.0)).otherwise((tp * tn - fp * fn) / bottom)


def value(name: str, no: int, *, given_weights: Sequence[float] | None = None, dependencies: Sequence[Sequence[int]] | None = None, threshold: float = 0.0) -> Column:
    """A function as a column over the rows of a profile; an array for the per-output ones."""
    _known(name)
    ne = _d(F.col("ne"))
    c, f = lambda r: _d(F.col(f"c{r}")), lambda r: _d(F.col(f"f{r}"))
    mean = lambda r: c(r) / ne
    cells = ne * no
    if name == "e1":
        column = _sum([c(r) for r in range(no)]) / cells
    elif name == "e2":
        column = _sum([F.lit(w) * mean(r) for r, w in enumerate(weights(no, given_weights))])
    elif name == "e3":
        column = _d(F.col("h")) / cells
    elif name == "e3_general":
        column = _d(F.col("g")) / cells
    elif name == "e4":
        column = _sum([F.greatest(*(f(q) for q in range(r + 1))) if r else f(0) for r in range(no)]) / cells
    elif name in ("e5", "e6"):
        amount = f if name == "e5" else c
        column = _first(no, amount, lambda r: ne * (no - r - 1) + amount(r), 0.0) / cells
    elif name == "e6_thresholded":
        passed = [F.lit(False)]
        for r in range(no - 1):
            passed.append(passed[-1] | (mean(r) > threshold))
        column = _sum([F.when(passed[r], F.lit(1.0)).otherwise(mean(r)) for r in range(no)]) / no
    elif name == "e6_general":
        _check(dependencies or [], no)
        over = lambda deps: reduce(lambda a, b: a | b, (mean(d) > threshold for d in deps), F.lit(False))
        column = _sum([F.when(over(deps), F.lit(1.0)).otherwise(mean(r)) for r, deps in enumerate(dependencies or [])]) / no
    elif name == "e7":
        column = _first(no, c, lambda r: F.lit(float(no - r)), 0.0) / no
    elif name == "correctness":
        column = 1 - _d(F.col("w")) / ne
    elif name == "per_output_error":
        column = F.array(*(mean(r) for r in range(no)))
    elif name == "per_output_mcc":
        column = F.array(*(output_mcc(r) for r in range(no)))
    elif name == "macro_mcc":
        column = _sum([output_mcc(r) for r in range(no)]) / no
    elif name == "e2_mcc":
        column = _sum([F.lit(w) * output_mcc(r) for r, w in enumerate(weights(no, given_weights))])
    else:  # e6_mcc; without errors it is 0, though 1 is the optimum of its kind
        column = _first(no, c, lambda r: output_mcc(r) - (no - r - 1), 0.0) / no
    return F.when(F.col("ne") > 0, column)


def evaluate(errors: DataFrame, name: str, no: int, *, by: Sequence[str] = (), order: str = "id", given_weights: Sequence[float] | None = None, dependencies: Sequence[Sequence[int]] | None = None, threshold: float = 0.0) -> DataFrame:
    """(by, value), or (by, r, value) for the per-output functions."""
    kept = profile(errors, no, by=by, dependencies=dependencies if name == "e3_general" else None, order=order if name in ("e4", "e5") else None)
    column = value(name, no, given_weights=given_weights, dependencies=dependencies, threshold=threshold)
    if FUNCTIONS[name][2]:
        return kept.select(*by, F.posexplode(column).alias("r", "value"))
    return kept.select(*by, column.alias("value"))


def confusion(errors: DataFrame, no: int, *, by: Sequence[str] = ()) -> DataFrame:
    """(by, r, tp, fp, fn, tn)."""
    kept = profile(errors, no, by=by)
    row = lambda r: F.struct(F.lit(r).alias("r"), (F.col(f"p{r}") - F.col(f"b{r}")).alias("tp"), (F.col(f"c{r}") - F.col(f"b{r}")).alias("fp"), F.col(f"b{r}").alias("fn"), (F.col("ne") - F.col(f"p{r}") - F.col(f"c{r}") + F.col(f"b{r}")).alias("tn"))
    return kept.select(*by, F.explode(F.array(*(row(r) for r in range(no)))).alias("m")).select(*by, "m.*")


def record(errors: DataFrame, no: int, *, by: Sequence[str] = (), prefix: str = "") -> DataFrame:
    """The metrics of a result record, all from one aggregation."""
    wanted = {"err": "e1", "cor": "correctness", "mcc": "macro_mcc", "errs": "per_output_error", "mccs": "per_output_mcc"}
    return profile(errors, no, by=by).select(*by, "ne", *(value(f, no).alias(f"{prefix}{n}") for n, f in wanted.items()))
