"""Sources mixed to target shares of tokens, by systematic sampling.

Sizes are tokens of a public tokenizer whose vocabulary file is a parameter. Each source
gets a rate, the expected copies of each of its documents: its share of the wanted total
over its tokens, at most its ``max_repeats``. Documents of a source are put in an order,
their expected copies are prefix-summed, one random offset of the source is added, and a
document is emitted once for every whole number its interval crosses: floor(rate) or
ceil(rate) times. Documents are ordered by size, so every size is drawn at the
same rate and the tokens drawn stay close to their expectation.

Without ``total_tokens`` the total is the largest at which no cap binds, so the shares come
out as wanted. With it, sources whose cap binds give all they may, and the others share
the rest in proportion to their shares. The shares of listed sources without tokens can't
be given; the report shows them with 0, the others rise in proportion.

Prefix sums run within blocks of documents and over one row per block, so a source that
holds a third of all documents is never ordered in one task.

Defined results: source names agree if letter case, outer spaces and the choice of - or _
do; documents of null or unlisted sources take no part; null and empty texts have 0 tokens
and are drawn like others; documents that stand twice are drawn twice; a source listed
twice counts with the sum of its shares and its lowest cap; null or negative shares and
caps count as 0.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gatewright.operators.scans import running_before
from gatewright.session import checkpoint

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The pattern published with the byte-level vocabulary (fixed value).
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Listed sources, which come to the driver; more are an error.
MAX_SOURCES = 100_000
BLOCK_ROWS = 50_000


def source_name(column: Column) -> Column:
    return F.replace(F.lower(F.btrim(column)), F.lit("-"), F.lit("_"))


def token_counter(path: str = TOKENIZER, pattern: str = PATTERN):
    """A column function text -> number of tokens, run on Arrow batches."""

    @F.pandas_udf("bigint")
    def count(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in Path(path).read_bytes().splitlines() if line)}
        encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        for batch in texts:
            # lone surrogates can't be encoded
            yield pd.Series([len(encoding.encode_ordinary(t.encode("utf-8", "replace").decode())) if isinstance(t, str) else 0 for t in batch], dtype="int64")

    return count


def rates(tokens: dict[str, int], shares: dict[str, float], caps: dict[str, int], total_tokens: float | None = None) -> dict[str, float]:
    """Expected copies of each document of every source."""
    open_ = {s for s in shares if tokens.get(s, 0) > 0 and shares[s] > 0 and caps.get(s, 0) > 0}
    out = {s: 0.0 for s in shares}
    if not open_:
        return out
    if total_tokens is None:
        whole = sum(shares[s] for s in open_)
        total_tokens = min(caps[s] * tokens[s] * whole / shares[s] for s in open_)
    rest = float(total_tokens)
    while open_:
        whole = sum(shares[s] for s in open_)
        bound = {s for s in open_ if rest * shares[s] / whole >= caps[s] * tokens[s] * (1 - 1e-12)}
        if not bound:
            out |= {s: rest * shares[s] / whole / tokens[s] for s in open_}
            break
        for s in bound:
            out[s] = float(caps[s])
        rest -= sum(caps[s] * tokens[s] for s in bound)
        open_ -= bound
        if rest <= 0:
            break
    return out


def sizes(documents: DataFrame, weights: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", tokenizer: str = TOKENIZER) -> DataFrame:
    """(id, source_name, n_tokens) of the documents with a listed source."""
    listed = weights.select(source_name(F.col("source_name")).alias("source_name")).where("source_name is not null").distinct()
    named = documents.select(F.col(f"`{id_col}`"), source_name(F.col(f"`{source_col}`")).alias("source_name"), F.col(f"`{text_col}`").alias("__gw_text"))
    return named.join(listed, "source_name", "left_semi").select(F.col(f"`{id_col}`"), "source_name", token_counter(tokenizer)("__gw_text").alias("n_tokens"))


def _plan(sized: DataFrame, weights: DataFrame, total_tokens: float | None) -> list[dict]:
    w = weights.select(source_name(F.col("source_name")).alias("s"), F.greatest(F.coalesce("target_share", F.lit(0.0)), F.lit(0.0)).alias("share"), F.greatest(F.coalesce("max_repeats", F.lit(0)), F.lit(0)).alias("cap"))
    w = w.where("s is not null").groupBy("s").agg(F.sum("share").alias("share"), F.min("cap").alias("cap"))
    have = sized.groupBy(F.col("source_name").alias("s")).agg(F.count(F.lit(1)).alias("docs"), F.sum("n_tokens").alias("tokens"))
    rows = [r.asDict() for r in w.join(have, "s", "left").fillna(0, ["docs", "tokens"]).limit(MAX_SOURCES + 1).collect()]
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} listed sources")
    by = lambda k: {r["s"]: r[k] for r in rows}
    got = rates(by("tokens"), by("share"), by("cap"), total_tokens)
    return [r | {"rate": got[r["s"]]} for r in rows]


def mix(documents: DataFrame, weights: DataFrame, *, total_tokens: float | None = None, seed: int = 0, id_col: str = "doc_id", block_rows: int = BLOCK_ROWS, **columns) -> tuple[DataFrame, DataFrame]:
    """(drawn, report): every drawn document with ``n_tokens`` and ``copies``, and one row per listed source."""
    spark = documents.sparkSession
    sized = checkpoint(sizes(documents, weights, id_col=id_col, **columns))
    plan = _plan(sized, weights, total_tokens)
    blocks = max(1, math.ceil(sum(r["docs"] for r in plan) / block_rows))
    rate = spark.createDataFrame([(r["s"], float(r["share"]), int(r["cap"]), int(r["docs"]), int(r["tokens"]), r["rate"]) for r in plan], "source_name string, target_share double, max_repeats int, docs bigint, tokens bigint, rate double")

    # the offset is one number per source, the order within a size class is a hash
    offset = F.pmod(F.xxhash64(F.lit(seed), "source_name"), F.lit(1 << 32)) / float(1 << 32)
    size_class = F.floor(F.log2(F.col("n_tokens") + 1) * 4).cast("bigint")
    mixed = F.xxhash64(F.lit(seed), F.col(f"`{id_col}`"))
    placed = sized.withColumns({"__gw_mix": mixed, "__gw_one": F.lit(1), "__gw_block": size_class * blocks + F.pmod(mixed, F.lit(blocks))})
    placed = running_before(placed, ["source_name"], "__gw_block", ["n_tokens", "__gw_mix", f"`{id_col}`"], "__gw_one", "__gw_k")
    placed = placed.join(rate.select("source_name", "rate"), "source_name").withColumn("__gw_u", offset)
    crossed = F.floor(F.col("rate") * (F.col("__gw_k") + 1) + F.col("__gw_u")) - F.floor(F.col("rate") * F.col("__gw_k") + F.col("__gw_u"))
    drawn = placed.select(F.col(f"`{id_col}`"), "source_name", "n_tokens", crossed.cast("int").alias("copies")).where("copies > 0")

    got = drawn.groupBy("source_name").agg(F.sum("copies").alias("drawn_docs"), F.max("copies").alias("most_copies"), F.sum(F.col("copies") * F.col("n_tokens")).alias("drawn_tokens"))
    report = rate.join(got, "source_name", "left").fillna(0, ["drawn_docs", "most_copies", "drawn_tokens"])
    # one row per listed source
    return drawn, report.withColumn("actual_share", F.col("drawn_tokens") / F.sum("drawn_tokens").over(Window.partitionBy(F.lit(0))))
