"""Deeply nested JSON as flat node tables with interval labels.

``label_records`` walks each record's JSON documents once, depth first, and numbers every node
in pre-order and post-order in one sequence: a node lies inside another exactly if its interval
``(pre, post)`` lies inside the other's. Nodes carry their parent's ``pre``, their type (the path
with list places removed, so every type is a table of its own), and, per named container type,
the interval of the innermost such container around them with scalar members of it. So nodes
of one type are tied to those that contain them without any join or window; ``label`` and
``node_table`` give the tables, ``within`` ties two of them by interval containment.

``learning_tables`` makes the related tables of stages, targets and features of learning records,
``learning_features`` the flat (stage, target, feature).

Defined results: null, blank or broken JSON has no nodes (words such as ``lsb`` are one
text node); JSON text inside a JSON text, however often wrapped, is walked as if it stood there;
a wrapper object ``{"extra": ...}`` around a record is passed through; nesting may have any depth;
whole rows that repeat give each node once in ``learning_tables``; numbers are kept as written.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Nodes gathered before their records are handed on; a record is never cut.
BATCH_NODES = 50_000


class _Raw(str):
    """A number as written."""


_TOKEN = re.compile(r'[ \t\n\r]*(?:([\[\]{},:])|(")|(-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][-+]?\d+)?)|(true|false|null))')
_WORDS = {"true": True, "false": False, "null": None}


def _parse_deep(text: str) -> object:
    """JSON of any depth, with a stack of its own; ValueError if it is none."""
    at, stack, done, want = 0, [], None, "value"
    while True:
        m = _TOKEN.match(text, at)
        if m is None:
            raise ValueError("no JSON token")
        at, mark, ready = m.end(), m[1], False
        if mark in ("[", "{") and want in ("value", "value or end"):
            stack.append(([] if mark == "[" else {}, None))
            want = "value or end" if mark == "[" else "key or end"
            continue
        if mark in ("]", "}") and stack and want in ("next", "value or end" if mark == "]" else "key or end") and isinstance(stack[-1][0], list) == (mark == "]"):
            done, ready = stack.pop()[0], True
        elif mark == "," and want == "next" and stack:
            want = "value" if isinstance(stack[-1][0], list) else "key"
            continue
        elif m[2] and want in ("key", "key or end"):
            key, at = json.decoder.scanstring(text, at)
            m = _TOKEN.match(text, at)
            if m is None or m[1] != ":":
                raise ValueError("no colon")
            stack[-1], at, want = (stack[-1][0], key), m.end(), "value"
            continue
        elif mark is None and want in ("value", "value or end"):
            if m[2]:
                done, at = json.decoder.scanstring(text, at)
            else:
                done = _Raw(m[3]) if m[3] else _WORDS[m[4]]
            ready = True
        if not ready:
            raise ValueError("misplaced token")
        if not stack:
            if text[at:].strip(" \t\n\r"):
                raise ValueError("text after the end")
            return done
        holder, key = stack[-1]
        holder.append(done) if isinstance(holder, list) else holder.__setitem__(key, done)
        want = "next"


def _decoded(text: object) -> object:
    """The JSON value of a text, also of JSON texts inside JSON texts; the text itself if it is no JSON object or list."""
    # every layer taken off leaves a shorter text
    while type(text) is str and (bare := text.strip())[:1] in ("{", "[", '"'):
        try:
            text = json.loads(bare, parse_float=_Raw, parse_int=_Raw)
        except RecursionError:
            try:
                text = _parse_deep(bare)
            except ValueError:
                return text
        except ValueError:
            return text
    return text


def _unwrapped(value: object, name: str) -> object:
    """The record without outer objects that only wrap it under its own name."""
    while isinstance(value, dict) and name in value:
        value = _decoded(value[name])
    return value


class Container:
    """A type of nodes (a regular expression) and the scalar members that are told of it."""

    def __init__(self, types: str, facts: Sequence[str] = ()) -> None:
        self.types, self.facts = re.compile(types), list(facts)


def walk(value: object, root: str = "$", containers: Sequence[Container] = (), keep: Mapping[str, bool] | None = None) -> list[list]:
    """The labelled nodes of a parsed document: [pre, post, depth, parent, type, key, place, kind, value, held, facts].

    ``held`` has per container the number of the innermost node of that type around the node
    (itself included), ``facts`` the scalar members of a container that are told of it. Scalars
    of types that ``keep`` does not want take their numbers but are left out.
    """
    nodes: list[list] = []
    clock = 0
    told = {f for c in containers for f in c.facts}
    # which containers a type is one of; None if it is none
    known: dict[str, tuple[bool, ...] | None] = {}
    # a task is the number of a node to close, or a node to open
    todo: list = [(value, root, None, None, 0, None, None, (None,) * len(containers))]
    while todo:
        task = todo.pop()
        if type(task) is int:
            nodes[task][1] = clock
            clock += 1
            continue
        item, type_, key, place, depth, above, parent, held = task
        kind = type(item)
        if kind is str:
            item = _decoded(item)
            kind = type(item)
        at = len(nodes)
        mine = known.get(type_, ())
        if mine == ():
            mine = tuple(c.types.fullmatch(type_) is not None for c in containers)
            known[type_] = mine = mine if any(mine) else None
        outer = held
        if mine is not None:
            held = tuple(at if m else h for m, h in zip(mine, held, strict=True))
        if kind is dict:
            nodes.append([clock, None, depth, parent, type_, key, place, "object", None, held, None])
            todo.append(at)
            todo += [(v, f"{type_}.{k}", k, None, depth + 1, at, clock, held) for k, v in reversed(item.items())]
        elif kind is list:
            nodes.append([clock, None, depth, parent, type_, key, place, "array", None, held, None])
            todo.append(at)
            inner = f"{type_}[]"
            if keep is not None and not keep[inner] and all(type(v) is _Raw for v in item):
                clock += 1 + 2 * len(item)
                continue
            todo += [(item[i], inner, None, i, depth + 1, at, clock, held) for i in range(len(item) - 1, -1, -1)]
        else:
            text = None if item is None else str(item).lower() if kind is bool else str(item)
            if keep is None or keep[type_]:
                nodes.append([clock, clock + 1, depth, parent, type_, key, place, "null" if item is None else "boolean" if kind is bool else "number" if kind is _Raw else "string", text, held, None])
            clock += 1
            # a scalar member is told of its container, right below which it stands
            if key in told and text is not None:
                for i, c in enumerate(containers):
                    if outer[i] == above and above is not None and key in c.facts:
                        nodes[above][10] = (nodes[above][10] or {}) | {key: text}
        clock += 1
    return nodes


_NODE = [("doc", "string"), ("pre", "int"), ("post", "int"), ("depth", "int"), ("parent", "int"), ("type", "string"), ("key", "string"), ("place", "int"), ("kind", "string"), ("value", "string")]


def _clean(values: list) -> list:
    """Texts without lone surrogates, which can't leave Python."""
    return [v if v is None or v.isascii() else v.encode("utf-8", "replace").decode() for v in values]


class _Labels:
    """Nodes of a batch of records, column by column."""

    def __init__(self, names: list[str], containers: list[Container]) -> None:
        self.names, self.containers = names, containers
        self.columns: list[list] = [[] for _ in _NODE]
        self.held: list[list[list]] = [[[] for _ in range(3 + len(c.facts))] for c in containers]
        self.ends = [0]

    def add(self, doc: str, nodes: list[list], keep: Mapping[str, bool]) -> None:
        nothing = [(None,) * len(parts) for parts in self.held]
        for n in nodes:
            if keep[n[4]]:
                for column, v in zip(self.columns, (doc, *n[:9])):  # noqa: B905
                    column.append(v)
                for parts, c, at, none in zip(self.held, self.containers, n[9], nothing):  # noqa: B905
                    if at is None:
                        row = none
                    else:
                        outer = nodes[at]
                        more = outer[10] or {}
                        row = (outer[0], outer[1], outer[6], *[more.get(f) for f in c.facts])
                    for column, v in zip(parts, row):  # noqa: B905
                        column.append(v)

    def close_record(self) -> None:
        self.ends.append(len(self.columns[0]))

    def array(self) -> pa.Array:
        kind = {"string": pa.string(), "int": pa.int32()}
        made = [pa.array(_clean(v) if t == "string" else v, kind[t]) for v, (_, t) in zip(self.columns, _NODE, strict=True)]
        names = [n for n, _ in _NODE]
        for name, c, parts in zip(self.names, self.containers, self.held, strict=True):
            inner = [pa.array(v, pa.int32()) for v in parts[:3]] + [pa.array(_clean(v), pa.string()) for v in parts[3:]]
            made.append(pa.StructArray.from_arrays(inner, names=["pre", "post", "place", *c.facts]))
            names.append(name)
        return pa.ListArray.from_arrays(pa.array(self.ends, pa.int32()), pa.StructArray.from_arrays(made, names=names))


def label_records(records: DataFrame, columns: Sequence[str], *, keep: Sequence[str] = (), types: str | None = None, containers: Mapping[str, Container] | None = None) -> DataFrame:
    """``keep`` and ``nodes``, an array of all nodes of the JSON ``columns`` of a record; one walk for all of them.

    ``types`` is a regular expression for the node types wanted; labels don't depend on it. Each
    container adds a field of its name to the nodes: struct(pre, post, place, facts).
    """
    wanted = re.compile(types) if types else None
    names, made = list(containers or {}), list((containers or {}).values())
    held = "".join(f", {n}: struct<pre: int, post: int, place: int{''.join(f', {f}: string' for f in c.facts)}>" for n, c in zip(names, made, strict=True))
    node = ", ".join(f"{n}: {t}" for n, t in _NODE) + held
    columns, keep = list(columns), list(keep)

    class Keep(dict):
        def __missing__(self, type_: str) -> bool:
            self[type_] = wanted is None or wanted.fullmatch(type_) is not None
            return self[type_]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = Keep()
        for batch in batches:
            texts = [batch.column(len(keep) + i).to_pylist() for i in range(len(columns))]
            labels, begun = _Labels(names, made), 0
            for at in range(batch.num_rows):
                for column, held_texts in zip(columns, texts, strict=True):
                    text = held_texts[at]
                    if text is not None and text.strip():
                        labels.add(column, walk(_unwrapped(_decoded(text), column), "$", made, kept), kept)
                labels.close_record()
                if labels.ends[-1] >= BATCH_NODES or at == batch.num_rows - 1:
                    part = batch.slice(begun, at + 1 - begun)
                    yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(keep))), labels.array()], names=[*keep, "nodes"])
                    labels, begun = _Labels(names, made), at + 1

    given = dict(records.dtypes)
    schema = "".join(f"`{c}` {given[c]}, " for c in keep) + f"nodes array<struct<{node}>>"
    return records.select(*(F.col(f"`{c}`") for c in [*keep, *columns])).mapInArrow(run, schema)


def label(records: DataFrame, columns: Sequence[str], *, key: str = "rk", **options) -> DataFrame:
    """The record key ``rk`` and the nodes as rows."""
    return label_records(records, columns, keep=[key], **options).select(F.col(f"`{key}`").alias("rk"), F.inline("nodes"))


def node_table(nodes: DataFrame, node_type: str) -> DataFrame:
    return nodes.where(F.col("type") == node_type).drop("type")


def within(inner: Column, outer: Column) -> Column:
    """Whether the interval of one node (struct with pre, post) lies inside the other's."""
    return (outer["pre"] <= inner["pre"]) & (inner["post"] <= outer["post"])


# types of the nodes that hold stages, targets and features
_STRATUM = r"\$\.strata\[\]"
_STAGE = r"\$\.stages\[\]"
_LISTED = r"\$\.feature_sets\[\]"
_TARGETS = r"\$\.strata\[\]\.targets(?:\[\])?"
_SET = r"\$\.strata\[\](?:\.targets(?:\[\])?)?\.fs|\$\.stages\[\]\.(?:feature_set\.features|fs)"
_FEATURE = rf"(?:{_SET}|{_LISTED})\[\](?:\.input)?"
_ENTRY = r"\$\[\]"
_WANTED = rf"{_STRATUM}|{_STAGE}|{_LISTED}|{_TARGETS}|{_FEATURE}|\$|{_ENTRY}"
_CONTAINERS = {"stage": Container(rf"{_STRATUM}|{_STAGE}|{_LISTED}", ["stage"]), "holder": Container(rf"{_TARGETS}|{_STAGE}", ["target", "stage"]), "entry": Container(_ENTRY, ["target", "rank"])}


def _whole(text: Column) -> Column:
    return text.try_cast("bigint")


def _is(node: Column, types: str) -> Column:
    return node["type"].rlike(rf"\A(?:{types})\z")


def _labelled(results: DataFrame) -> DataFrame:
    """result_id, nout, rk (tells different records of one result apart) and ``nodes`` of extra and target_order."""
    records = results.select("result_id", F.col("nout").cast("bigint").alias("nout"), "target_order", "extra").where("extra is not null")
    records = records.withColumn("rk", F.xxhash64("result_id", "nout", "target_order", "extra"))
    return label_records(records, ["extra", "target_order"], keep=["result_id", "nout", "rk"], types=_WANTED, containers=_CONTAINERS)


def _stage_no(n: Column) -> Column:
    """The ``stage`` beside a feature set or around it, else the place in its list."""
    return F.coalesce(_whole(n["holder"]["stage"]), _whole(n["stage"]["stage"]), n["stage"]["place"].cast("bigint"))


def _number(n: Column) -> Column:
    return F.regexp_extract(F.lower(F.btrim(n["value"])), r"\A(?:x_?)?([0-9]+)\z", 1).try_cast("int")


def _extra(types: str, *, scalar: bool = False):
    def test(n: Column) -> Column:
        mine = (n["doc"] == "extra") & _is(n, types) & n["stage"]["pre"].isNotNull() & within(n, n["stage"])
        return mine & n["kind"].isin("number", "string") if scalar else mine

    return test


def learning_tables(results: DataFrame) -> dict[str, DataFrame]:
    """Related flat tables, each row once: stages (rk, pre, post, result_id, stage_no), targets (rk, pre, post, stage_pre, target) and features (rk, pre, post, stage_pre, target_pre, feature).

    ``rk`` and ``stage_pre`` or ``target_pre`` are the links to the parent rows; a target that is not
    given beside its feature set has none, as has a feature whose set stands under no target.
    """
    nodes = _labelled(results)
    rows = lambda types, scalar=False: nodes.select("rk", "result_id", F.explode(F.filter("nodes", _extra(types, scalar=scalar))).alias("n"))
    n = F.col("n")
    stages = rows(rf"{_STRATUM}|{_STAGE}|{_LISTED}").select("rk", "n.pre", "n.post", "result_id", F.coalesce(_whole(n["stage"]["stage"]), n["place"].cast("bigint")).alias("stage_no"))
    targets = rows(rf"{_TARGETS}|{_STAGE}").select("rk", "n.pre", "n.post", F.col("n.stage.pre").alias("stage_pre"), _whole(n["holder"]["target"]).alias("target")).where("target is not null")
    held = F.when(_whole(n["holder"]["target"]).isNotNull(), n["holder"]["pre"])
    features = rows(_FEATURE, True).select("rk", "n.pre", "n.post", F.col("n.stage.pre").alias("stage_pre"), held.alias("target_pre"), _number(n).alias("feature")).where("feature is not null")
    return {name: t.dropDuplicates(["rk", "pre"]) for name, t in (("stages", stages), ("targets", targets), ("features", features))}


def learning_features(results: DataFrame) -> DataFrame:
    """(result_id, stage_no, target, feature), distinct, from ``extra`` and ``target_order``.

    The stage is the ``stage`` beside a feature set, else the place in its list; the target
    is the ``target`` beside it, else the entry of the target order at that stage. Stages,
    targets and order stand in the record's own node array, so rows only meet in the last step.
    """
    nodes = _labelled(results)
    order = F.filter("nodes", lambda n: n["doc"] == "target_order")
    entries = F.filter(order, lambda n: n["type"] == "$[]")
    # an entry is a number, or an object with a target and perhaps a rank
    pair = F.transform(entries, lambda n: F.named_struct(F.lit("stage"), F.coalesce(_whole(n["entry"]["rank"]), n["place"].cast("bigint")), F.lit("target"), F.when(n["kind"].isin("number", "string"), _whole(n["value"])).otherwise(_whole(n["entry"]["target"]))))
    word = F.lower(F.btrim(F.get(F.filter(order, lambda n: (n["type"] == "$") & (n["kind"] == "string")), F.lit(0))["value"]))
    found = F.transform(F.filter("nodes", _extra(_FEATURE, scalar=True)), lambda n: F.named_struct(F.lit("stage_no"), _stage_no(n), F.lit("given"), F.when(within(n, n["holder"]), _whole(n["holder"]["target"])), F.lit("feature"), _number(n)))
    # worked out once per record, below the explode
    told = nodes.select("result_id", "nout", word.alias("word"), pair.alias("order"), found.alias("found"))
    flat = told.select("result_id", "nout", "word", "order", F.explode("found").alias("f")).select("result_id", "nout", "word", "order", "f.*")
    listed = F.array_max(F.transform(F.filter("order", lambda p: p["stage"] == F.col("stage_no")), lambda p: p["target"]))
    in_range = (F.col("stage_no") >= 0) & (F.col("stage_no") < F.col("nout"))
    by_word = F.when((F.col("word") == "lsb") & in_range, F.col("stage_no")).when((F.col("word") == "msb") & in_range, F.col("nout") - 1 - F.col("stage_no"))
    rows = flat.select("result_id", F.col("stage_no").cast("int").alias("stage_no"), F.coalesce("given", listed, by_word).cast("int").alias("target"), "feature")
    return rows.where("target is not null and feature is not null and stage_no is not null").distinct()
