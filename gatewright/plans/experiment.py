"""One experiment description turned into a table of tasks and a table of results.

A description has ``name``, ``seed``, ``base_config`` and either ``list`` (overrides, one
configuration each) or ``product`` (lists of overrides, every combination). Configurations
are small; they are merged and checked on the driver. Tasks, one per configuration and
training sample, are rows; each runs as its own group on an executor with its own seeded
generator, so a lost executor only repeats its tasks. Results are written in JSON lines or
Parquet, and a task whose result is there is not run again.
"""

from __future__ import annotations

import hashlib
import json
import logging
import math
import re
import time
from collections.abc import Callable, Iterator, Mapping, Sequence
from copy import deepcopy
from itertools import product
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gatewright.functions import operands
from gatewright.model.network import Network
from gatewright.operators.metrics import function_names
from gatewright.search.learners import LEARNERS, Setting, StageFailed, learner
from gatewright.search.optimisers import Optimiser, scaled
from gatewright.search.state import State, metric

# descriptions


def load(path: str | Path) -> dict:
    import yaml

    return yaml.safe_load(Path(path).read_text())


def merged(base: Mapping, *overrides: Mapping) -> dict:
    """Nested mappings put together; later values win."""
    out = deepcopy(dict(base))
    for override in overrides:
        for key, value in override.items():
            out[key] = merged(out[key], value) if isinstance(value, Mapping) and isinstance(out.get(key), Mapping) else deepcopy(value)
    return out


def configurations(experiment: Mapping) -> list[dict]:
    """The configurations of an experiment in order, each checked; without variants the base is the only one."""
    check_experiment(experiment)
    if "list" in experiment:
        variants: list[tuple] = [(v,) for v in experiment["list"]]
    else:
        variants = list(product(*experiment.get("product", [])))
    base = merged(experiment["base_config"], {"log_keys": [*DEFAULT_LOG_KEYS, *experiment["base_config"].get("log_keys", [])]})
    return [check(merged(base, *variant, {"configuration_number": i})) for i, variant in enumerate(variants)]


def leaves(config: Mapping) -> list[tuple[tuple[str, ...], object]]:
    """(path, value) of everything in a nested mapping that is no mapping itself, in order."""
    out, todo = [], [((), config)]
    while todo:
        path, value = todo.pop()
        if isinstance(value, Mapping):
            todo += [((*path, str(k)), v) for k, v in reversed(value.items())]
        else:
            out.append((path, value))
    return out


class KeyFilter:
    """Leaves picked by patterns, one regular expression per path element, and given new names.

    The first pattern listed that matches a path counts; ``{}`` in its name becomes the path
    elements that its wildcard expressions matched, joined by ``_``.
    """

    def __init__(self, wanted: Sequence[tuple[str, Sequence[str]]]) -> None:
        self._by_length: dict[int, list[tuple[str, re.Pattern, list[int]]]] = {}
        for name, pattern in wanted:
            # elements are texts without \0, so a joined path is matched by a joined pattern
            whole = re.compile("\0".join(f"(?:{p})" for p in pattern), re.DOTALL)
            wild = [i for i, p in enumerate(pattern) if set(p) & set(r".^$*+?{}[]\|()")]
            self._by_length.setdefault(len(pattern), []).append((name, whole, wild))

    def __call__(self, config: Mapping) -> dict:
        found = {}
        for path, value in leaves(config):
            text = "\0".join(path)
            match = next(((n, w) for n, whole, w in self._by_length.get(len(path), ()) if (m := whole.fullmatch(text)) and m[0].count("\0") == len(path) - 1), None)
            if match:
                name, wild = match
                found[name.replace("{}", "_".join(path[i] for i in wild))] = value
        return found


def filter_keys(config: Mapping, wanted: Sequence[tuple[str, Sequence[str]]]) -> dict:
    return KeyFilter(wanted)(config)


class Seeds:
    """Seeds by name: named ones shared, numbers as given, others new; all follow from the first."""

    def __init__(self, primary: int | None = None) -> None:
        self.primary = int(np.random.SeedSequence().entropy % 2**32) if primary is None else primary
        self._made = 0

    def seed(self, group: str, wanted: int | str | None) -> int:
        if isinstance(wanted, int):
            return wanted
        if wanted is None:
            self._made += 1
            wanted = f"#{self._made}"
        digest = hashlib.sha256(f"{self.primary}/{group}/{wanted}".encode()).digest()
        return 1 + int.from_bytes(digest[:8], "big") % (2**32 - 1)


# what is logged of every task: name, whether it has to be there, path (fixed values)
DEFAULT_LOG_KEYS: list[list] = [
    ["learner", True, ["learner", "name"]],
    ["config_num", True, ["configuration_number"]],
    ["trg_set_num", True, ["training_set_number"]],
    ["tfs", True, ["learner", "network_params", "node_funcs"]],
    ["guiding_function", True, ["optimiser", "guiding_function"]],
    ["given_tgt_order", False, ["learner", "target_order"]],
    ["targets", False, ["data", "targets"]],
    ["sample_seed", False, ["sampling", "seed"]],
    ["opt_{}", False, ["optimiser", ".*"]],
]


def unlogged(config: Mapping) -> list[str]:
    """Names of log keys that have to match something in the configuration and don't."""
    missing = []
    for name, required, pattern in config.get("log_keys", []):
        if required and not filter_keys(config | {"training_set_number": 0}, [(name, pattern)]):
            missing.append(name)
    return missing


# checks: a section takes one of several forms, told apart by one of its fields

Test = Callable[[object], bool]


def _whole(least: int, most: int | None = None) -> Test:
    return lambda v: type(v) is int and v >= least and (most is None or v <= most)


def _number(least: float = -math.inf, most: float = math.inf) -> Test:
    return lambda v: type(v) in (int, float) and least <= v <= most


def _text(pattern: str = r"(?s).*") -> Test:
    return lambda v: isinstance(v, str) and re.fullmatch(pattern, v) is not None


def _among(*values: object) -> Test:
    return lambda v: any(v is o if isinstance(o, bool) else v == o and not isinstance(v, bool) for o in values)


def _either(*tests: Test) -> Test:
    return lambda v: any(t(v) for t in tests)


def _each(test: Test, least: int = 1) -> Test:
    return lambda v: isinstance(v, list) and len(v) >= least and all(map(test, v))


def _distinct(v: object) -> bool:
    return _each(_whole(0))(v) and len(set(v)) == len(v)


def _mapping(v: object) -> bool:
    return isinstance(v, Mapping)


def _network(v: object) -> bool:
    return isinstance(v, Mapping) and set(v) == {"Ng", "node_funcs"} and _either(_whole(1), _text(r"[1-9]\d*n2?"))(v["Ng"]) and _each(_whole(0, 15))(v["node_funcs"])


def _stop(v: object) -> bool:
    return isinstance(v, list) and len(v) in (2, 3) and _among("guiding", *function_names(scalar=True))(v[0]) and _number()(v[1])


_SEED = _either(_whole(0), _text(), lambda v: v is None)
_ORDER = _either(_among("auto", "lsb", "msb", "random"), lambda v: _distinct(v) and sorted(v) == list(range(len(v))))
_TARGETS = _either(_among("random"), _distinct, lambda v: v is None)
_ITERATIONS = _either(_whole(1), _text(r"[1-9]\d*n"))
_FILE = {"dir": _text(), "add_noise": _number(0, 1), "targets": _TARGETS}
_SEARCH = {"guiding_function_parameters": _mapping, "return_option": _among("best", "last"), "stopping_condition": _stop, "max_restarts": _whole(0)}
_GUIDED = {"guiding_function": _among(*function_names(scalar=True))}
_LEARN = {"network_params": _network, "target_order": _ORDER}
_MASK = _among(True, False, "prefilter")
#: Feature sets are found greedily inside tasks; other solvers and metrics of published packages are not offered.
_MINFS = lambda v: isinstance(v, Mapping) and set(v) <= {"solver", "metric"} and v.get("solver", "greedy") == "greedy" and v.get("metric", "cardinality>first") == "cardinality>first"
_STAGED = {"seed": _SEED, "minfs_params": _MINFS, "early_terminate": _among(True, False), "apply_mask": _MASK}
_STRATA = {**_STAGED, "prefilter": _among("", "prev-strata+input", "prev-strata+prev-fs", "prev-strata+prev-fs+input"), "shrink_subnets": _among(True, False)}

#: section: (field that tells its forms apart, {form: (required fields, optional fields)}); None as optional: anything goes.
FORMS: dict[str, tuple[str, dict[str, tuple[dict[str, Test], dict[str, Test] | None]]]] = {
    "data": ("type", {
        "generated": ({"operator": _among(*operands.OPERATORS), "bits": _whole(1)}, {"out_width": _whole(1), "add_noise": _number(0, 1), "targets": _TARGETS}),
        "file": ({"filename": _text()}, _FILE),
        "split": ({"training_filename": _text(), "test_filename": _text()}, _FILE),
    }),
    "sampling": ("type", {
        "generated": ({"Ns": _whole(1), "Ne": _whole(1)}, {"seed": _SEED, "test": _whole(0)}),
        "file": ({"filename": _text()}, {"test": _text(), "dir": _text()}),
        "given": ({"indices": _each(_each(_whole(0)))}, {"test": _each(_each(_whole(0)))}),
        "blank": ({}, {}),
    }),
    "optimiser": ("name", {
        "HC": ({"max_iterations": _ITERATIONS, **_GUIDED}, _SEARCH),
        "LAHC": ({"max_iterations": _ITERATIONS, "cost_list_length": _whole(1), **_GUIDED}, _SEARCH),
        "SA": ({"num_temps": _whole(1), "init_temp": _number(0), "temp_rate": _number(0, 1), "steps_per_temp": _whole(1), **_GUIDED}, _SEARCH),
    }),
    "learner": ("name", {
        "monolithic": (_LEARN, {"seed": _SEED, "minfs_params": _MINFS}),
        "stratified": (_LEARN, _STRATA),
        "stratmultipar": (_LEARN, _STRATA),
        "classifierchain": (_LEARN, _STAGED),
        "classifierchain_plus": (_LEARN, _STAGED),
        "split": (_LEARN, _STAGED),
        "ecc_member": ({"network_params": _network}, {"target_order": _ORDER, "seed": _SEED, "early_terminate": _among(True, False)}),
        "wrapper": ({"sublearner": _among(*(n for n in LEARNERS if n != "wrapper")), "curricula_method": _among("minfs", "CEbCC", "label_effects"), "network_params": _network}, None),
    }),
}


def _need(ok: bool, what: str) -> None:
    if not ok:
        raise ValueError(what)


def check_experiment(experiment: Mapping) -> None:
    _need(isinstance(experiment.get("base_config"), Mapping), "base_config has to be a mapping")
    _need(not ("list" in experiment and "product" in experiment), "an experiment has 'list' or 'product', not both")
    _need(_SEED(experiment.get("seed")), "seed has to be a number, a name or nothing")
    _need(_each(_mapping)(experiment.get("list", [{}])), "'list' has to be a list of mappings")
    _need(_each(_each(_mapping), 2)(experiment.get("product", [[{}], [{}]])), "'product' has to be at least two lists of mappings")


def check(config: dict) -> dict:
    """The configuration, if it is a valid one; ValueError names what is wrong."""
    for section, (field, forms) in FORMS.items():
        given = config.get(section)
        _need(isinstance(given, Mapping), f"section {section} is missing")
        _need(given.get(field) in forms, f"{section}.{field} has to be one of {', '.join(forms)}")
        required, optional = forms[given[field]]
        for key, test in required.items():
            _need(key in given, f"{section}.{key} is missing")
            _need(test(given[key]), f"{section}.{key} can't be {given[key]!r}")
        for key in given:
            if key != field and key not in required and optional is not None:
                _need(key in optional, f"{section}.{key} is not known for {given[field]}")
                _need(optional[key](given[key]), f"{section}.{key} can't be {given[key]!r}")
    _need(config["sampling"]["type"] != "blank" or config["data"]["type"] == "split", "only data in separate files may go without sampling")
    _need("target_order" not in config["learner"] or config["learner"]["name"] != "wrapper", "a wrapper finds the target order itself")
    for key in config.get("log_keys", []):
        _need(isinstance(key, list) and len(key) == 3 and isinstance(key[0], str) and isinstance(key[1], bool) and _each(_text())(key[2]), f"log key {key!r} has to be [name, whether it has to be there, path]")
    for key, value in config.items():
        if key.startswith("notes"):
            _need(isinstance(value, str), f"{key} has to be a text")
    return config


def file_path(section: Mapping, key: str, extension: str) -> str:
    """A file name in its folder (``dir``, unless it is absolute), with the extension if it has none."""
    path = Path(section[key]).expanduser()
    if section.get("dir") and not path.is_absolute():
        path = Path(section["dir"]) / path
    return str(path if path.suffix else path.with_suffix(extension))


def result_folder(base: str, name: str, at: float | None = None) -> str:
    return f"{base}/{name}_{time.strftime('%y-%m-%d_%H-%M-%S', time.gmtime(at))}"


# tasks

_TASK = "task_id string, config_num int, training_set_number int, seed bigint, config string, training_indices array<bigint>, test_indices array<bigint>"


def listed_samples(sampling: Mapping) -> list[tuple[list[int] | None, list[int] | None]]:
    """(training, test) index lists of each sample; None where they are drawn or left to the complement."""
    if sampling["type"] == "given":
        train, test = sampling["indices"], sampling.get("test")
    elif sampling["type"] == "file":
        read = lambda key: np.load(file_path(sampling, key, ".npy"), allow_pickle=False).astype(int).tolist()
        train, test = read("filename"), read("test") if "test" in sampling else None
    else:
        return [(None, None)] * sampling.get("Ns", 1)
    return list(zip(train, test or [None] * len(train), strict=True))


def tasks(spark: SparkSession, experiment: Mapping) -> DataFrame:
    """(task_id, config_num, training_set_number, seed, config, indices): one row per configuration and sample."""
    seed = experiment.get("seed")
    seeds = Seeds(seed if isinstance(seed, int) else None)
    rows = []
    for number, config in enumerate(configurations(experiment)):
        for name in unlogged(config):
            logging.getLogger(__name__).warning("log key %s matches nothing in configuration %d", name, number)
        config["sampling"]["seed"] = seeds.seed("sampling", config["sampling"].get("seed"))
        if config["data"].get("targets") == "random":
            config["data"]["target_seed"] = seeds.seed("targets", None)
        text = json.dumps(config, sort_keys=True)
        for sample, (train, test) in enumerate(listed_samples(config["sampling"])):
            learner_seed = seeds.seed("learner", config["learner"].get("seed"))
            rows.append((hashlib.sha256(f"{text}/{sample}/{learner_seed}".encode()).hexdigest()[:16], number, sample, learner_seed, text, train, test))
    return spark.createDataFrame(rows, _TASK)


# running

#: Bytes of example files that one run may share with all its tasks.
MAX_SHARED = 1 << 30

_RESULT = """task_id string, config_num int, training_set_number int, learner_seed bigint, learner string, guiding_function string, ni int, nout int, ng int, ne int,
    actual_noise double, target_order array<int>, trg_err double, trg_cor double, trg_mcc double, trg_err_gf double, trg_errs array<double>, trg_mccs array<double>,
    test_err double, test_cor double, test_mcc double, test_err_gf double, test_errs array<double>, test_mccs array<double>,
    setup_time double, learning_time double, total_time double, final_net array<array<int>>, extra string, notes string, failed string"""
_FIELDS = [part.split()[0] for part in re.split(r",\s*(?![^<]*>)", _RESULT)]


def _drawn(n: int, size: int, seed: int, sample: int) -> np.ndarray:
    """Rows of one sample: the same for every task with this seed and sample number."""
    if size > n:
        raise ValueError(f"{size} examples asked of {n}")
    return np.random.default_rng([seed, sample]).permutation(n)[:size]


def _bits(ids: np.ndarray, n: int) -> np.ndarray:
    return (ids[None, :] >> np.arange(n)[:, None] & 1).astype(np.uint8)


def task_data(config: Mapping, row: Mapping, datasets: Mapping[str, tuple[np.ndarray, np.ndarray]]) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """((x, y) for training, (x, y) for test) of a task; without test examples the rest of one table is the test."""
    data, sampling, sample = config["data"], config["sampling"], int(row["training_set_number"])
    given = lambda key: np.asarray(row[key], dtype=np.int64) if row.get(key) is not None else None
    picked, tested = given("training_indices"), given("test_indices")
    drawn = sampling["type"] == "generated"
    if data["type"] == "split":
        train, test = (datasets[file_path(data, k, ".npz")] for k in ("training_filename", "test_filename"))
        if len(train[0]) != len(test[0]) or len(train[1]) != len(test[1]):
            raise ValueError("training and test file have different signals")
        if drawn:
            picked = _drawn(train[0].shape[1], sampling["Ne"], sampling["seed"], sample)
            tested = _drawn(test[0].shape[1], sampling["test"], sampling["seed"] + 1, sample) if "test" in sampling else None
        take = lambda part, ids: part if ids is None else (part[0][:, ids], part[1][:, ids])
        train, test = take(train, picked), take(test, tested)
    else:
        if data["type"] == "generated":
            op, nb = data["operator"], data["bits"]
            ni, no = operands.input_width(op, nb), data.get("out_width", operands.default_outputs(op, nb))
            ids = np.arange(1 << ni, dtype=np.int64)
            x, y = _bits(ids, ni), _bits(np.array([operands.value(op, nb, int(i)) for i in ids]), no)
        else:
            x, y = datasets[file_path(data, "filename", ".npz")]
        if drawn:
            both = _drawn(x.shape[1], sampling["Ne"] + sampling.get("test", 0), sampling["seed"], sample)
            picked, tested = both[: sampling["Ne"]], both[sampling["Ne"] :] if "test" in sampling else None
        if tested is None:
            tested = np.setdiff1d(np.arange(x.shape[1]), picked)
        train, test = (x[:, picked], y[:, picked]), (x[:, tested], y[:, tested])
    targets = data.get("targets")
    if targets == "random":
        targets = np.random.default_rng(data["target_seed"]).permutation(len(train[1])).tolist()
    if targets:
        train, test = (train[0], train[1][targets]), (test[0], test[1][targets])
    return train, test


def with_noise(y: np.ndarray, rate: float, rng: np.random.Generator) -> tuple[np.ndarray, float]:
    """Targets with the same number of random flips in every row, and the rate that this is."""
    n = round(y.shape[1] * rate)
    y = y.copy()
    for row in y if n else ():
        row[rng.permutation(len(row))[:n]] ^= 1
    return y, n / y.shape[1] if y.shape[1] else 0.0


def scores(network: Network, x: np.ndarray, y: np.ndarray, guiding: str, options: dict) -> dict:
    if not x.shape[1]:
        return {}
    state = State(network, x, y)
    e = state.errors()
    get = lambda name, **kw: metric(name, e, state.target, state.ne, **kw)
    return {"err": get("e1"), "cor": get("correctness"), "mcc": get("macro_mcc"), "err_gf": get(guiding, **options), "errs": get("per_output_error").tolist(), "mccs": get("per_output_mcc").tolist()}


def run_task(row: Mapping, datasets: Mapping[str, tuple[np.ndarray, np.ndarray]]) -> dict:
    """One task from start to end; a stage that had to succeed and didn't is told in ``failed``."""
    began = time.monotonic()
    config = json.loads(row["config"])
    rng = np.random.default_rng(int(row["seed"]))
    (x, y), (test_x, test_y) = task_data(config, row, datasets)
    learn, opt = dict(config["learner"]), dict(config["optimiser"])
    noisy, rate = with_noise(y, config["data"].get("add_noise") or 0.0, rng)
    order = learn.get("target_order", "auto")
    no = len(y)
    order = {"lsb": list(range(no)), "msb": list(range(no))[::-1], "auto": None}.get(order, None) if isinstance(order, str) and order != "random" else rng.permutation(no).tolist() if order == "random" else order
    guiding, options = opt["guiding_function"], opt.get("guiding_function_parameters", {})
    stop = opt.get("stopping_condition", [None, None])
    optimiser = Optimiser(
        opt["name"], guiding, None if stop[0] in (None, "guiding") else stop[0], stop[1], scaled(opt.get("max_iterations", 1000), no), opt.get("max_restarts", 0), opt.get("cost_list_length", 50),
        opt.get("num_temps", 20), opt.get("steps_per_temp", 50), opt.get("init_temp", 0.1), opt.get("temp_rate", 0.9), options, opt.get("return_option", "best"),
    )
    network = learn["network_params"]
    setting = Setting(
        x, noisy, optimiser, scaled(network["Ng"], no), network["node_funcs"], rng, order, learn.get("apply_mask", learn["name"].startswith("strat")), tuple(filter(None, learn.get("prefilter", "").split("+"))),
        learn.get("shrink_subnets", True), learn.get("early_terminate", True), {"sublearner": learn.get("sublearner"), "method": learn.get("curricula_method"), **learn.get("options", {})},
    )
    ready = time.monotonic()
    out = {
        "task_id": row["task_id"], "config_num": int(row["config_num"]), "training_set_number": int(row["training_set_number"]), "learner_seed": int(row["seed"]), "learner": learn["name"],
        "guiding_function": guiding, "ni": len(x), "nout": no, "ne": x.shape[1], "actual_noise": rate, "setup_time": ready - began,
        "notes": json.dumps({k: v for k, v in config.items() if k.startswith("notes")} | filter_keys(config | {"training_set_number": int(row["training_set_number"])}, [(k, p) for k, _, p in config.get("log_keys", [])])),
    }
    try:
        got = learner(learn["name"])(setting)
    except StageFailed as failure:
        return out | {"failed": str(failure), "total_time": time.monotonic() - began}
    out["learning_time"] = time.monotonic() - ready
    # the record is about the data without noise
    out |= {f"trg_{k}": v for k, v in scores(got.network, x, y, guiding, options).items()} | {f"test_{k}": v for k, v in scores(got.network, test_x, test_y, guiding, options).items()}
    keep = config.get("record_intermediate_nets", False)
    extra = {k: v for k, v in got.extra.items() if k != "partial_networks"} | ({"partial_networks": [n.gates for n in got.extra.get("partial_networks", [])]} if keep else {})
    return out | {"ng": got.network.ng, "target_order": got.order, "final_net": [list(g) for g in got.network.gates] if config.get("record_final_net", True) else None, "extra": json.dumps(extra), "total_time": time.monotonic() - began}


def run(task_table: DataFrame, datasets: Mapping[str, tuple[np.ndarray, np.ndarray]] | None = None) -> DataFrame:
    """The results of the tasks, one group each. ``datasets``: 0/1 arrays by path, at most MAX_SHARED bytes, shared with all tasks.

    Example files that are not among them are read by the tasks that name them.
    """
    if sum(a.nbytes for pair in (datasets or {}).values() for a in pair) > MAX_SHARED:
        raise ValueError(f"the example files of the tasks hold more than {MAX_SHARED} bytes")
    shared = task_table.sparkSession.sparkContext.broadcast(dict(datasets or {}))

    def go(group: pd.DataFrame) -> pd.DataFrame:
        rows = [run_task(r, _Held(shared.value)) for r in group.to_dict("records")]
        frame = pd.DataFrame([[r.get(f) for f in _FIELDS] for r in rows], columns=_FIELDS)
        return frame.astype({c: "Int64" for c in ("ng", "ni", "nout", "ne")})

    return task_table.groupBy("task_id").applyInPandas(go, _RESULT)


class _Held(dict):
    """Example files by path, read when they are first asked for; learning data are small enough for one task."""

    def __missing__(self, path: str) -> tuple[np.ndarray, np.ndarray]:
        from gatewright.sources.files import npz_arrays, parquet_arrays

        self[path] = npz_arrays(path) if path.endswith(".npz") else parquet_arrays(path)
        return self[path]


def run_new(task_table: DataFrame, folder: str, datasets: Mapping[str, tuple[np.ndarray, np.ndarray]] | None = None) -> DataFrame:
    """Run the tasks that have no result in ``folder`` yet and add theirs; returns all results there."""
    spark = task_table.sparkSession
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        task_table = task_table.join(spark.read.schema(_RESULT).json(folder).select("task_id"), "task_id", "left_anti")
    run(task_table, datasets).write.mode("append").json(folder)
    return spark.read.schema(_RESULT).json(folder)


def with_config(results: DataFrame, task_table: DataFrame) -> DataFrame:
    return results.join(task_table.select("task_id", F.col("config")), "task_id")
