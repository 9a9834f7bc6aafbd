"""Queries of the language-model data operators, and their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gatewright.llm import leakage, mixing, percentiles, quality
from gatewright.session import checkpoint, table

Query = Callable[[SparkSession, str], DataFrame]

ASKED = [5_000, 9_000, 9_900]


def p4_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    """Exact percentiles per learner, data set and day."""
    rows = percentiles.unique_rows(table(spark, sf, "task_times"))
    return percentiles.percentiles(rows, ["learner", "dataset_id", "run_day"], "learning_time", ASKED)


def p4_merged(spark: SparkSession, sf: str) -> DataFrame:
    """Exact percentiles per learner over all days, narrowed from the days' summaries put together."""
    rows = checkpoint(percentiles.unique_rows(table(spark, sf, "task_times")).select("learner", "run_day", "learning_time"))
    days = percentiles.summarise(rows, ["learner", "run_day"], "learning_time")
    return percentiles.percentiles(rows, ["learner"], "learning_time", ASKED, summary=percentiles.merge(days, ["learner"]))


def p4_bounds(spark: SparkSession, sf: str) -> DataFrame:
    """Bounds of percentiles per learner and data set from summaries of single days alone."""
    days = percentiles.summarise(percentiles.unique_rows(table(spark, sf, "task_times")), ["learner", "dataset_id", "run_day"], "learning_time")
    merged = percentiles.merge(days, ["learner", "dataset_id"])
    return percentiles.bounds(merged, ["learner", "dataset_id"], ASKED).select("learner", "dataset_id", "p", "n", "lo", "hi")


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return leakage.leaks(table(spark, sf, "documents"), table(spark, sf, "eval_items"))


def p7_near(spark: SparkSession, sf: str) -> DataFrame:
    """Items whose passages stand in a document with an edit at most, as the alignment decides."""
    return leakage.near_leaks(table(spark, sf, "documents"), table(spark, sf, "eval_items"))


def p8_mixture(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mix(table(spark, sf, "documents"), table(spark, sf, "source_weights"))[0]


def p8_shares(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mix(table(spark, sf, "documents"), table(spark, sf, "source_weights"))[1]


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    judged = quality.judge(table(spark, sf, "documents"), table(spark, sf, "common_words"))
    return judged.where(F.size("reasons") > 0).select("doc_id")


def p9_statistics(spark: SparkSession, sf: str) -> DataFrame:
    """The published statistics of every document, and the published thresholds it fails."""
    got = quality.statistics(table(spark, sf, "documents"), table(spark, sf, "common_words"), running=False)
    shares = {c: F.round(c, 6) for c in ("mean_word_length", "symbol_ratio", "bullet_share", "ellipsis_share", "line_end_share", "alpha_share", "common_share")}
    return got.withColumn("reasons", F.array_join(quality.reasons(quality.PUBLISHED), ",")).withColumns(shares)


def p9_reasons(spark: SparkSession, sf: str) -> DataFrame:
    """Every document that is not natural prose, with the rules it fails."""
    judged = quality.judge(table(spark, sf, "documents"), table(spark, sf, "common_words"))
    return judged.where(F.size("reasons") > 0).select("doc_id", F.round("running_share", 6).alias("running_share"), F.array_join("reasons", ",").alias("reasons"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (p4_percentiles, p4_merged, p4_bounds, p7_found, p7_near, p8_mixture, p8_shares, p9_found, p9_reasons, p9_statistics)}

_COUNTED = "select distinct * from task_times"
_VALID = "learning_time is not null and not isnan(learning_time) and learning_time >= 0"


def _exact(groups: str) -> str:
    """Nearest-rank percentiles, written out."""
    ps = ", ".join(map(str, ASKED))
    return f"""
        with r as (
            select {groups}, learning_time as value, row_number() over (partition by {groups} order by learning_time) as k, count(*) over (partition by {groups}) as n
            from ({_COUNTED}) where {_VALID}),
        a as (select unnest([{ps}]) as p)
        select {groups}, p, n, value from r, a where k = greatest(1, (n * p + 9999) // 10000)"""


# Unicode's white space but for the ASCII ones that every engine knows
_SPACES = " || ".join(f"chr({c})" for c in [11, 28, 29, 30, 31, 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288])

SQL: dict[str, str] = {
    "p4_percentiles": _exact("learner, dataset_id, run_day"),
    "p4_merged": _exact("learner"),
    # value cells of 1 % relative width; a percentile's bounds are the least and greatest value of its cell
    "p4_bounds": f"""
        with v as (select learner, dataset_id, learning_time as v, case when learning_time = 0 then -2147483648 else floor(ln(learning_time) / ln(1.01)) end as cell from ({_COUNTED}) where {_VALID}),
        c as (select learner, dataset_id, cell, count(*) as n, min(v) as lo, max(v) as hi from v group by all),
        u as (select *, sum(n) over (partition by learner, dataset_id)::bigint as total, sum(n) over (partition by learner, dataset_id order by cell)::bigint as upto from c),
        a as (select unnest([{', '.join(map(str, ASKED))}])::int as p)
        select learner, dataset_id, p, total as n, lo, hi from u, a where greatest(1, (total * p + 9999) // 10000) between upto - n + 1 and upto""",
    "p9_statistics": r"""
        with c as (select list(distinct lower(trim(word))) as common from common_words),
        d as (select doc_id, translate(coalesce(text, ''), __SPACES__, repeat(' ', length(__SPACES__))) as t from documents),
        w as (select doc_id, t, list_filter(string_split(t, e'\n'), lambda l: regexp_matches(l, '\S')) as lines, regexp_extract_all(t, '\S+') as words from d),
        n as (select doc_id, len(words) as n_words, len(lines) as n_lines, length(regexp_replace(t, '\s', '', 'g')) as chars, len(regexp_extract_all(t, '#|…|\.\.\.')) as symbols,
            len(list_filter(lines, lambda l: regexp_matches(l, '\A[ \t]*(?:[-*•·–—▪◦‣+]|[0-9]{1,3}[.)])\s'))) as bullets, len(list_filter(lines, lambda l: regexp_matches(l, '(?:…|\.\.\.)[ \t\r]*\z'))) as ellipses,
            len(list_filter(lines, lambda l: regexp_matches(l, '[.!?…]["”»)'']*[ \t\r]*\z'))) as line_ends, len(list_filter(words, lambda x: regexp_matches(x, '\p{L}'))) as alpha,
            len(list_filter(words, lambda x: list_contains(common, lower(trim(x, '"''.,;:!?…“”„«»‘’()[]¿¡-–—'))))) as n_common from w, c),
        s as (select doc_id, n_words, n_lines, coalesce(chars / nullif(n_words, 0), 0) as mean_word_length, coalesce(symbols / nullif(n_words, 0), 0) as symbol_ratio, coalesce(bullets / nullif(n_lines, 0), 0) as bullet_share,
            coalesce(ellipses / nullif(n_lines, 0), 0) as ellipsis_share, coalesce(line_ends / nullif(n_lines, 0), 0) as line_end_share, coalesce(alpha / nullif(n_words, 0), 0) as alpha_share, n_common, coalesce(n_common / nullif(n_words, 0), 0) as common_share from n)
        select doc_id, n_words, n_lines, round(mean_word_length, 6) as mean_word_length, round(symbol_ratio, 6) as symbol_ratio, round(bullet_share, 6) as bullet_share, round(ellipsis_share, 6) as ellipsis_share, round(line_end_share, 6) as line_end_share,
            round(alpha_share, 6) as alpha_share, n_common, round(common_share, 6) as common_share,
            concat_ws(',', case when n_words < 50 or n_words > 100000 then 'words' end, case when mean_word_length < 3 or mean_word_length > 10 then 'word_length' end, case when symbol_ratio > 0.1 then 'symbols' end, case when bullet_share > 0.9 then 'bullets' end,
                case when ellipsis_share > 0.3 then 'ellipses' end, case when alpha_share < 0.8 then 'letters' end, case when n_common < 2 then 'common_words' end, case when line_end_share < 0.12 then 'line_ends' end) as reasons from s""".replace("__SPACES__", _SPACES),
    "p7_found": r"""
        with folded as (
            select 'd' as kind, doc_id as id, text from documents union all select 'i', item_id, text from eval_items),
        words as (
            select kind, id, string_split(trim(regexp_replace(regexp_replace(strip_accents(lower(text)), '[\p{Cf}\p{M}]', '', 'g'), '[^\p{L}\p{N}]+', ' ', 'g')), ' ') as w from folded),
        grams as (
            select distinct kind, id, array_to_string(w[k:k + 12], ' ') as g
            from (select *, unnest(range(1, len(w) - 11)) as k from words where len(w) >= 13))
        select distinct d.id as doc_id, i.id as item_id from grams d join grams i using (g) where d.kind = 'd' and i.kind = 'i'""",
}
