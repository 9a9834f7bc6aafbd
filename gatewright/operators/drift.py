"""JSON records whose fields change from file to file: schema versions, migration steps, one table.

1. ``file_schemas`` reads every line once and gives each file its schema (a map from
   top-level key to the set of types of its values) and a fingerprint of that schema.
2. ``versions`` puts the files of a stream in order and sets each beside the one before it;
   a file whose fingerprint differs starts a new version.
3. ``migrations`` turns each change of version into explicit steps: rename, add (a default
   comes in), remove, retype (a cast comes in). ``report`` lists them.
4. ``routes`` follows each stream's own renames to the target fields, so every file is sent
   through the rules of its own version. A name that a stream never renames is read as the
   target that other streams renamed it to only if the stream is of the same record family:
   it holds at least half of the target fields, and at least MIN_SHARED, by its own steps.
5. ``unify`` applies the rename, cast and default rules of a line's file; ``applied`` lists
   them per file, ``leftovers`` each value that no rule could place.

Types: boolean, integer, decimal, string, object, array<...> with the types inside. A key
that only ever holds null has the empty set of types.

Nothing is lost: of several values for one target the one with the shortest chain of renames
that can be cast is taken; the others, and values that can't be cast, stay in ``others`` under
their own names and in the report of ``leftovers`` (``unused`` or ``uncast``), where a line that
is no JSON object stands whole (``unparsed``). A key that stands twice in an object is, as in
JSON, its last value.

Defined results: lines that are null or not one JSON object carry no keys (``unify`` gives
them a row of nulls); files without a line have no fields; files without a stream or a place
in it are in no comparison and are read by the target names alone; a file listed twice counts once. Whole lines that repeat change nothing in a
schema. Empty tables give empty results.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatewright.operators.scans import previous
from gatewright.session import checkpoint

#: Target fields that a stream has to hold, besides half of all, before renames of other streams count for it.
MIN_SHARED = 3

_SCALARS = {bool: "boolean", int: "integer", float: "decimal", str: "string", dict: "object"}


def json_type(value: object) -> str | None:
    """The type of a parsed JSON value; null has none."""
    if type(value) is list:
        return f"array<{','.join(sorted({t for v in value if (t := json_type(v)) is not None}))}>"
    return _SCALARS.get(type(value))


def _not_json(text: str) -> None:
    raise ValueError(text)


_KEY = pa.schema([("file_id", pa.int64()), ("field", pa.string()), ("type", pa.string())])


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file, key, type) of a partition's lines, each triple once per batch."""
    # len stands for int: only the type matters, and a whole number may have any number of digits
    decoder = json.JSONDecoder(parse_constant=_not_json, parse_int=len)
    for batch in batches:
        found: dict[tuple[int, str, str], None] = {}
        for file_id, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            try:
                record = decoder.decode(line)
            except (ValueError, TypeError, RecursionError):
                continue
            if type(record) is dict:
                for key, value in record.items():
                    found[file_id, key.encode("utf-8", "replace").decode(), json_type(value) or ""] = None
        columns = list(zip(*found, strict=True)) or [(), (), ()]
        yield pa.record_batch([pa.array(v, f.type) for v, f in zip(columns, _KEY, strict=True)], schema=_KEY)


def file_schemas(lines: DataFrame, *, file_col: str = "log_file_id", line_col: str = "line") -> DataFrame:
    """(file_id, fields map<key, types joined by |>, fingerprint) of every file that has lines."""
    narrow = lines.select(F.col(f"`{file_col}`").cast("bigint").alias("file_id"), F.col(f"`{line_col}`").alias("line"))
    keys = narrow.where("file_id is not null").mapInArrow(_keys, "file_id bigint, field string, type string")
    per_file = keys.groupBy("file_id").agg(F.collect_set(F.struct("field", "type")).alias("pairs"))
    names = F.array_sort(F.array_distinct(F.col("pairs.field")))
    types = lambda name: F.array_join(F.array_sort(F.transform(F.filter("pairs", lambda p: (p["field"] == name) & (p["type"] != "")), lambda p: p["type"])), "|")
    fields = F.map_from_arrays(names, F.transform(names, types))
    return per_file.select("file_id", fields.alias("fields")).withColumn("fingerprint", F.sha2(F.to_json("fields"), 256))


def versions(lines: DataFrame, files: DataFrame, *, file_col: str = "log_file_id", stream_col: str = "stream_id", seq_col: str = "seq", line_col: str = "line") -> DataFrame:
    """(stream, seq, file_id, fields, fingerprint, prev_file_id, prev_fields, prev_fingerprint) of every file."""
    placed = files.select(F.col(file_col).cast("bigint").alias("file_id"), F.col(stream_col).alias("stream"), F.col(seq_col).cast("bigint").alias("seq"))
    placed = placed.where("file_id is not null and stream is not null and seq is not null").groupBy("file_id").agg(F.min(F.struct("stream", "seq")).alias("p")).select("file_id", "p.stream", "p.seq")
    # places are ordered without their schemas; those are joined to both sides afterwards
    ordered = previous(placed, "stream", "seq", ["file_id"], tie="file_id")
    schemas = file_schemas(lines, file_col=file_col, line_col=line_col)
    before = schemas.select(F.col("file_id").alias("prev_file_id"), F.col("fields").alias("prev_fields"), F.col("fingerprint").alias("prev_fingerprint"))
    none = F.from_json(F.lit("{}"), "map<string,string>")
    joined = ordered.join(schemas, "file_id", "left").join(before, "prev_file_id", "left")
    return joined.withColumns({"fields": F.coalesce("fields", none), "prev_fields": F.when(F.col("prev_file_id").isNotNull(), F.coalesce("prev_fields", none))})


def migrations(versioned: DataFrame) -> DataFrame:
    """One row per step from a file's predecessor to it.

    Columns: stream, seq, file_id, prev_file_id, change (renamed, retyped, added, removed),
    field, to_field (of renames), from_type, to_type.
    """
    changed = versioned.where(F.col("prev_file_id").isNotNull() & ~F.col("fingerprint").eqNullSafe(F.col("prev_fingerprint")))
    entries = lambda mine, other: F.filter(F.map_entries(mine), lambda e: ~F.map_contains_key(other, e["key"]))
    changed = changed.withColumns({"stopped": entries(F.col("prev_fields"), F.col("fields")), "started": entries(F.col("fields"), F.col("prev_fields"))})
    alone = lambda side, e: F.size(F.filter(side, lambda o: o["value"] == e["value"])) == 1
    moved = lambda e: alone(F.col("stopped"), e) & alone(F.col("started"), e)
    step = lambda change, field, to_field, old, new: F.struct(F.lit(change).alias("change"), field.alias("field"), to_field.alias("to_field"), old.alias("from_type"), new.alias("to_type"))
    no = F.lit(None).cast("string")
    value_of = lambda m, k: F.try_element_at(m, k)
    partner = lambda e: F.get(F.filter("started", lambda o: o["value"] == e["value"]), F.lit(0))["key"]
    renamed = F.transform(F.filter("stopped", moved), lambda e: step("renamed", e["key"], partner(e), e["value"], e["value"]))
    removed = F.transform(F.filter("stopped", lambda e: ~moved(e)), lambda e: step("removed", e["key"], no, e["value"], no))
    added = F.transform(F.filter("started", lambda e: ~moved(e)), lambda e: step("added", e["key"], no, no, e["value"]))
    both = F.filter(F.map_entries("fields"), lambda e: F.map_contains_key(F.col("prev_fields"), e["key"]) & (value_of(F.col("prev_fields"), e["key"]) != e["value"]))
    retyped = F.transform(both, lambda e: step("retyped", e["key"], no, value_of(F.col("prev_fields"), e["key"]), e["value"]))
    steps = changed.withColumn("s", F.explode(F.concat(renamed, removed, added, retyped)))
    return steps.select("stream", "seq", "file_id", "prev_file_id", "s.*")


def report(steps: DataFrame, *, file_col: str = "log_file_id") -> DataFrame:
    """(file, field, change), one row per change; a rename is one row under the old name."""
    return steps.select(F.col("file_id").alias(file_col), "field", "change")


def _seconds(text: Column) -> Column:
    """A number from a number, a text such as ``1.8 s``, or an object with ``value``; a unit other than seconds fails."""
    unit = F.coalesce(F.get_json_object(text, "$.unit"), F.lit("s"))
    bare = F.coalesce(F.get_json_object(text, "$.value"), text)
    bare = F.btrim(F.regexp_replace(bare, r"(?i)\s*s(ec(onds)?)?\s*\z", ""))
    return F.when(F.lower(unit).isin("s", "sec", "seconds"), bare.try_cast("double"))


def _order(text: Column) -> Column:
    """A target order as lsb, msb or a JSON list of numbers, from a list, a list of texts or ``1,0``."""
    listed = F.from_json(F.when(text.rlike(r"\A\s*\["), text).otherwise(F.concat(F.lit("["), text, F.lit("]"))), "array<string>")
    numbers = F.transform(listed, lambda v: v.try_cast("int"))
    word = F.lower(F.btrim(text))
    return F.when(word.isin("lsb", "msb"), word).when(~F.exists(numbers, lambda v: v.isNull()), F.to_json(numbers))


class Field(NamedTuple):
    """A target field: its Spark type, the type that needs no cast, the cast rule (else a plain cast), the default."""

    name: str
    kind: str
    native: str
    rule: Callable[[Column], Column] | None = None
    default: object = None

    def cast(self, text: Column) -> Column:
        return self.rule(text) if self.rule else text if self.kind == "string" else text.try_cast(self.kind)


RECORD_FIELDS = [
    Field("id", "bigint", "integer"), Field("learner", "string", "string"), Field("Ni", "int", "integer"), Field("No", "int", "integer"), Field("Ng", "int", "integer"), Field("config_num", "int", "integer"),
    Field("target_order", "string", "array<integer>", _order), Field("setup_time", "double", "decimal", _seconds), Field("learning_time", "double", "decimal"), Field("trg_err", "double", "decimal"),
    Field("test_err", "double", "decimal"), Field("extra", "string", "object"),
]

#: The scope of renames of all streams together; streams' own scopes start with =.
_ALL = "*"


def _renames(versioned: DataFrame, steps: DataFrame) -> DataFrame:
    """(scope, field, to_field), each way: the renames of single streams and of all together.

    Two names of one field never stand in the same file; a rename between names that do is
    a chance meeting (one field went, another of its type came) and makes no rule.
    """
    pairs = steps.where("change = 'renamed'").select(F.explode(F.array(F.lit(_ALL), F.concat(F.lit("="), F.col("stream").cast("string")))).alias("scope"), "field", "to_field").distinct()
    # files of one schema tell the same, and there are far fewer schemas than files
    schemas = versioned.groupBy("fingerprint").agg(F.any_value(F.map_keys("fields")).alias("all"))
    both = schemas.select(F.explode("all").alias("field"), "all").join(pairs.select("field", "to_field").distinct(), "field")
    together = both.where(F.array_contains("all", F.col("to_field"))).select("field", "to_field").distinct()
    kept = pairs.join(together, ["field", "to_field"], "left_anti")
    return kept.unionByName(kept.select("scope", F.col("to_field").alias("field"), F.col("field").alias("to_field"))).distinct()


def _chains(scopes: DataFrame, renames: DataFrame, targets: Sequence[str]) -> DataFrame:
    """(scope, field, place, far): the names that lead to a target (its place in the list) over ``far`` renames.

    A name belongs to the target with the shortest chain, then to the one listed first. All
    scopes take one step per round, so the rounds are as many as the longest chain has names.
    """
    named = F.array(*(F.struct(F.lit(t).alias("field"), F.lit(i).alias("place"), F.lit(0).alias("far")) for i, t in enumerate(targets)))
    known = front = checkpoint(scopes.select("scope", F.inline(named)))
    renames, far = checkpoint(renames), 0
    while True:
        far += 1
        met = renames.join(front.select("scope", "field", "place"), ["scope", "field"]).select("scope", F.col("to_field").alias("field"), "place")
        new = met.join(known.select("scope", "field"), ["scope", "field"], "left_anti").groupBy("scope", "field").agg(F.min("place").alias("place"))
        front = checkpoint(new.withColumn("far", F.lit(far)))
        if front.isEmpty():
            return known
        known = known.unionByName(front)


def routes(versioned: DataFrame, steps: DataFrame, fields: Sequence[Field] = RECORD_FIELDS) -> DataFrame:
    """(file_id, field, types, target, far): where each field of each file goes, by the steps of the file's own stream.

    Streams of the same record family (see above) take over the renames of others for names
    that their own steps say nothing about. Fields that go nowhere have no row.
    """
    targets = [f.name for f in fields]
    keys = versioned.select("file_id", F.concat(F.lit("="), F.col("stream").cast("string")).alias("scope"), F.explode("fields").alias("field", "types"))
    held = keys.select("scope", "field").distinct()
    one = versioned.sparkSession.range(1).select(F.lit(_ALL).alias("scope"))
    chains = _chains(held.select("scope").distinct().unionByName(one), _renames(versioned, steps), targets)
    own = held.join(chains, ["scope", "field"])
    family = own.groupBy("scope").agg(F.count_distinct("place").alias("n")).where((F.col("n") >= MIN_SHARED) & (2 * F.col("n") >= len(targets))).select("scope")
    others = chains.where(F.col("scope") == _ALL).select("field", "place", "far")
    taken = held.join(family, "scope", "left_semi").join(own.select("scope", "field"), ["scope", "field"], "left_anti").join(others, "field").select("scope", "field", "place", "far")
    rules = own.select("scope", "field", "place", "far").unionByName(taken)
    name = F.element_at(F.array(*map(F.lit, targets)), F.col("place") + 1)
    return keys.join(rules, ["scope", "field"]).select("file_id", "field", "types", name.alias("target"), "far")


def applied(routed: DataFrame, versioned: DataFrame, fields: Sequence[Field] = RECORD_FIELDS, *, file_col: str = "log_file_id") -> DataFrame:
    """(file, field, target, rule) of every rule that changes something in a file: rename, cast, default (no field)."""
    native = F.create_map(*(F.lit(v) for f in fields for v in (f.name, f.native)))
    rules = F.array_compact(F.array(F.when(F.col("field") != F.col("target"), F.lit("rename")), F.when((F.col("types") != "") & (F.col("types") != native[F.col("target")]), F.lit("cast"))))
    changed = routed.select("file_id", "field", "target", F.explode(rules).alias("rule"))
    have = routed.groupBy("file_id").agg(F.collect_set("target").alias("have"))
    every = versioned.select("file_id").join(have, "file_id", "left")
    missing = F.array_except(F.array(*(F.lit(f.name) for f in fields)), F.coalesce("have", F.array().cast("array<string>")))
    filled = every.select("file_id", F.lit(None).cast("string").alias("field"), F.explode(missing).alias("target"), F.lit("default").alias("rule"))
    return changed.unionByName(filled).withColumnRenamed("file_id", file_col)


def unify(lines: DataFrame, routed: DataFrame, fields: Sequence[Field] = RECORD_FIELDS, *, keep: tuple[str, ...] = ("log_file_id", "line_no"), file_col: str = "log_file_id", line_col: str = "line") -> DataFrame:
    """Every line as one row of the target fields, ``others`` (what has no place there) and ``leftovers`` (field, rule, value)."""
    place = {f.name: i for i, f in enumerate(fields)}
    at = F.create_map(*(v for f in fields for v in (F.lit(f.name), F.lit(place[f.name]))))
    entry = F.struct("field", F.struct(at[F.col("target")].alias("place"), "far"))
    per_file = routed.groupBy(F.col("file_id").alias("__gw_file")).agg(F.map_from_entries(F.collect_list(entry)).alias("__gw_route"))
    plain = F.create_map(*(v for f in fields for v in (F.lit(f.name), F.struct(F.lit(place[f.name]).alias("place"), F.lit(0).alias("far")))))
    # as texts: objects and arrays stay JSON, texts lose their quotes
    parsed = lines.withColumn("__gw_e", F.map_entries(F.from_json(F.col(f"`{line_col}`"), "map<string,string>")))
    names = F.col("__gw_e.key")
    last = lambda e, i: F.array_position(F.reverse(names), e["key"]) == F.size(names) - i
    parsed = parsed.withColumn("__gw_e", F.filter("__gw_e", last)).join(per_file, F.col(f"`{file_col}`").cast("bigint") == F.col("__gw_file"), "left")

    def placed(e: Column) -> Column:
        to = F.coalesce(F.col("__gw_route"), plain)[e["key"]]
        fits = F.coalesce(*(F.when(to["place"] == i, f.cast(e["value"]).isNotNull()) for i, f in enumerate(fields)), F.lit(False))
        return F.struct(to["place"].alias("place"), (~fits).alias("misfit"), to["far"].alias("far"), e["key"].alias("field"), e["value"].alias("value"))

    # the first of each place that fits, by length of chain, then name, is taken; exploding one
    # array of arrays gives back the row, with the inner array worked out once
    parsed = parsed.select("*", F.explode(F.array(F.array_sort(F.transform("__gw_e", placed)))).alias("__gw_p"))
    is_taken = lambda p, i: ~p["misfit"] & ~F.coalesce(F.get("__gw_p", i - 1)["place"] == p["place"], F.lit(False))
    parsed = parsed.withColumn("__gw_s", F.filter("__gw_p", lambda p, i: p["place"].isNull() | (p["value"].isNotNull() & ~is_taken(p, i))))
    first = lambda i: F.get(F.filter("__gw_p", lambda p: (p["place"] == i) & ~p["misfit"]), F.lit(0))["value"]
    columns = []
    for f in fields:
        value = f.cast(first(place[f.name]))
        columns.append((value if f.default is None else F.coalesce(value, F.lit(f.default))).alias(f.name))
    others = F.map_from_entries(F.transform("__gw_s", lambda p: F.struct(p["field"], p["value"])))
    left = F.transform(F.filter("__gw_s", lambda p: p["place"].isNotNull()), lambda p: F.struct(p["field"].alias("field"), F.when(p["misfit"], F.lit("uncast")).otherwise("unused").alias("rule"), p["value"].alias("value")))
    unread = F.when(F.col("__gw_e").isNull() & F.col(f"`{line_col}`").isNotNull(), F.array(F.struct(F.lit(None).cast("string").alias("field"), F.lit("unparsed").alias("rule"), F.col(f"`{line_col}`").alias("value"))))
    return parsed.select(*keep, *columns, others.alias("others"), F.coalesce(unread, left).alias("leftovers"))


def leftovers(unified: DataFrame, *, keep: tuple[str, ...] = ("log_file_id", "line_no")) -> DataFrame:
    """(file, line, field, rule, value) of every value that had a target and could not be put there."""
    return unified.select(*keep, F.inline("leftovers"))
