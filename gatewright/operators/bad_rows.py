"""Delimited text rows checked against their schema by anchored regular expressions.

For every row shape (number of inputs and outputs) one anchored expression for the whole
row is generated; rows that match it are good and are split without further checks. Only
the others meet the slower expressions: the one for well-formed quoting, the one for the
number of values, and the incremental field prefixes, whose longest match ends before the
first broken field. All of it runs in the JVM; the generated expressions use possessive
quantifiers, so they neither backtrack nor recurse, however long a row is.

Defined results
* A null line has no values (``columns``), as has the empty line (one empty value).
* A line whose data set is unknown or null has no schema; its reason is ``schema``. Such
  lines are outside the three reasons of ``p5_found``.
* Only the space counts as padding; a tab, a line end or a byte order mark is data.
* Rows that stand twice are judged twice. Extra columns pass through.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_ID = 2**63 - 1
#: Distinct row shapes that one plan may hold; each adds four literal expressions to it.
MAX_SHAPES = 500

_BODY = r'[^"]*+(?:""[^"]*+)*+'
_QUOTED = rf'"{_BODY}"'
_ANY = rf' *+(?:{_QUOTED} *+|[^",]*+)'


def _at_most(limit: int) -> str:
    """An expression for the decimal numbers 0..limit with any leading zeros."""
    text, parts = str(limit), [rf"[0-9]{{1,{len(str(limit)) - 1}}}+(?![0-9])"]
    for i, digit in enumerate(text):
        if digit != "0":
            rest = len(text) - i - 1
            parts.append(f"{text[:i]}[0-{int(digit) - 1}]" + (f"[0-9]{{{rest}}}" if rest else ""))
    return rf"0*+(?:(?:{'|'.join([*parts, text])})|(?<=0))(?![0-9])"


def _date() -> str:
    """An expression for the real dates written YYYY-MM-DD in the years 0001 to 9999."""
    month31, month30 = "(?:0[13578]|1[02])", "(?:0[469]|11)"
    leap = "(?:[0-9]{2}(?:0[48]|[2468][048]|[13579][26])|(?:0[48]|[2468][048]|[13579][26])00)"
    return rf"(?!0000)(?:[0-9]{{4}}-(?:{month31}-(?:0[1-9]|[12][0-9]|3[01])|{month30}-(?:0[1-9]|[12][0-9]|30)|02-(?:0[1-9]|1[0-9]|2[0-8]))|{leap}-02-29)"


def _field(value: str) -> str:
    """A value of the given form, bare or quoted, with spaces around it; ends before a comma or the end."""
    return rf' *+(?:"{value}"|{value}) *+(?=,|\z)'


ID, SIGNAL, DAY = _field(_at_most(MAX_ID)), _field("[01]"), _field(f"(?:{_date()})?+")
LABEL = rf"{_ANY}(?=,|\z)"


def field_names(ni: int, nout: int) -> list[str]:
    return ["id", *(f"x{i}" for i in range(ni)), *(f"y{i}" for i in range(nout)), "label", "day"]


def field_patterns(ni: int, nout: int) -> list[str]:
    return [ID, *[SIGNAL] * (ni + nout), LABEL, DAY]


def row_pattern(ni: int, nout: int) -> str:
    """The anchored expression of a whole good row."""
    return rf"\A{ID}(?:,{SIGNAL}){{{ni + nout}}},{LABEL},{DAY}\z"


def prefix_pattern(ni: int, nout: int) -> str:
    """Field prefixes of growing length in one expression: it matches as many leading good fields as there are."""
    first, *rest = field_patterns(ni, nout)
    inner = reduce(lambda tail, head: rf"(?:,{head}{tail})?+", reversed(rest), "")
    return rf"\A(?:{first}{inner})?+"


WELL_QUOTED = rf"\A{_ANY}(?:,{_ANY})*+\z"


def columns_pattern(n: int) -> str:
    return rf"\A{_ANY}(?:,{_ANY}){{{n - 1}}}\z"


def _by_shape(shapes: list[tuple[int, int]], make) -> Column:
    """The value of ``make(ni, nout)`` for the row's own shape."""
    mine = lambda ni, nout: (F.col("__gw_ni") == ni) & (F.col("__gw_nout") == nout)
    return F.coalesce(*(F.when(mine(*shape), make(*shape)) for shape in shapes), F.lit(None))


def judge(lines: DataFrame, datasets: DataFrame, *, line_col: str = "line", dataset_col: str = "dataset_id") -> DataFrame:
    """``lines`` with ``reason`` (null for good rows) and ``broken_field`` (the first field that breaks the schema).

    ``datasets`` has one row per data set with its ``ni`` and ``nout``; only its distinct
    shapes, at most MAX_SHAPES, come to the driver.
    """
    schema = datasets.select(F.col(dataset_col).alias("__gw_ds"), F.col("ni").alias("__gw_ni"), F.col("nout").alias("__gw_nout"))
    schema = schema.where("__gw_ds is not null and __gw_ni >= 0 and __gw_nout >= 0").dropDuplicates(["__gw_ds"])
    shapes = [(r[0], r[1]) for r in schema.select("__gw_ni", "__gw_nout").distinct().limit(MAX_SHAPES + 1).collect()]
    if len(shapes) > MAX_SHAPES:
        raise ValueError(f"more than {MAX_SHAPES} row shapes; judge the data sets in parts")
    shapes.sort()
    line = F.coalesce(F.col(f"`{line_col}`"), F.lit(""))
    rows = lines.join(schema, lines[dataset_col] == schema["__gw_ds"], "left").withColumn("__gw_line", line)
    line = F.col("__gw_line")
    good = _by_shape(shapes, lambda ni, nout: line.rlike(row_pattern(ni, nout)))
    right_number = _by_shape(shapes, lambda ni, nout: line.rlike(columns_pattern(ni + nout + 3)))
    prefix = _by_shape(shapes, lambda ni, nout: F.regexp_extract(line, prefix_pattern(ni, nout), 0))
    names = _by_shape(shapes, lambda ni, nout: F.array(*map(F.lit, field_names(ni, nout))))
    # the separators outside quotes in the longest good prefix give the number of its fields
    fields = F.when(prefix == "", F.lit(0)).otherwise(F.regexp_count(prefix, F.lit(rf"{_QUOTED}|,")) - F.regexp_count(prefix, F.lit(_QUOTED)) + 1)
    reason = (
        F.when(F.col("__gw_ds").isNull(), "schema")
        .when(good, F.lit(None).cast("string"))
        .when(~line.rlike(WELL_QUOTED), "quoting")
        .when(~right_number, "columns")
        .otherwise("value")
    )
    rows = rows.withColumn("reason", reason)
    broken = F.when(F.col("reason").isin("quoting", "columns", "value"), F.coalesce(F.try_element_at(names, fields + 1), F.lit("(end)")))
    return rows.withColumn("broken_field", broken).drop("__gw_ds", "__gw_line")


def split_rows(lines: DataFrame, datasets: DataFrame, **columns) -> tuple[DataFrame, DataFrame]:
    """(good rows, bad rows with ``reason`` and ``broken_field``)."""
    judged = judge(lines, datasets, **columns)
    shape = ["__gw_ni", "__gw_nout"]
    return load(judged.where("reason is null"), columns.get("line_col", "line")), judged.where("reason is not null").drop(*shape)


def load(good: DataFrame, line_col: str = "line") -> DataFrame:
    """The values of good rows: ``id``, ``x`` and ``y`` arrays, ``label`` and ``day`` (null if empty)."""
    raw = F.regexp_extract_all(F.col(f"`{line_col}`"), F.lit(rf"(?:\A|,)({_ANY})"), F.lit(1))
    bare = F.transform(raw, lambda v: F.btrim(v, F.lit(" ")))
    value = F.transform(bare, lambda v: F.when(v.startswith('"'), F.replace(F.substr(v, F.lit(2), F.length(v) - 2), F.lit('""'), F.lit('"'))).otherwise(v))
    rows = good.withColumn("__gw_v", value)
    v, ni, nout = F.col("__gw_v"), F.col("__gw_ni"), F.col("__gw_nout")
    signals = lambda start, n: F.transform(F.slice(v, start, n), lambda s: s.cast("int"))
    rows = rows.withColumns({
        "parsed_id": F.element_at(v, 1).cast("bigint"), "x": signals(F.lit(2), ni), "y": signals(ni + 2, nout),
        "label": F.element_at(v, ni + nout + 2), "day": F.nullif(F.element_at(v, ni + nout + 3), F.lit("")).cast("date"),
    })
    return rows.drop("__gw_v", "__gw_ni", "__gw_nout", "reason", "broken_field")
