"""Queries of the data-preparation operators, and their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gatewright.operators import bad_rows, compaction, deliveries, drift, nested
from gatewright.session import checkpoint, table

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    versioned = drift.versions(table(spark, sf, "record_lines"), table(spark, sf, "record_files"))
    return drift.report(drift.migrations(versioned))


def _drift(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(lines, versions, routes)"""
    lines = table(spark, sf, "record_lines")
    versioned = checkpoint(drift.versions(lines, table(spark, sf, "record_files")))
    return lines, versioned, drift.routes(versioned, drift.migrations(versioned))


def p1_unified(spark: SparkSession, sf: str) -> DataFrame:
    """One table of all records; of ``extra`` and ``others`` their keys, and sums of the numbers in them."""
    lines, _, routed = _drift(spark, sf)
    keys = lambda m: F.array_join(F.array_sort(m), ",")
    total = lambda values: F.round(F.aggregate(values, F.lit(0.0), lambda a, v: a + F.coalesce(v.try_cast("double"), F.lit(0.0))), 6)
    extra = F.from_json("extra", "map<string,string>")
    unified = drift.unify(lines, routed).withColumns({
        "extra_keys": keys(F.map_keys(extra)), "extra_errors": total(F.from_json(extra["best_err"], "array<string>")), "other_keys": keys(F.map_keys("others")), "other_sum": total(F.map_values("others")),
    })
    return unified.drop("extra", "others", "leftovers")


def p1_applied(spark: SparkSession, sf: str) -> DataFrame:
    """The rename, cast and default rules that each file went through."""
    _, versioned, routed = _drift(spark, sf)
    return drift.applied(routed, versioned)


def p1_leftovers(spark: SparkSession, sf: str) -> DataFrame:
    """The values that no rule could place in the one table; they stay in ``others``."""
    lines, _, routed = _drift(spark, sf)
    return drift.leftovers(drift.unify(lines, routed)).select("log_file_id", "line_no", "field", "rule")


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return compaction.adds_nothing(compaction.compact(table(spark, sf, "small_files"), table(spark, sf, "examples")))


def p2_journal(spark: SparkSession, sf: str) -> DataFrame:
    return compaction.compact(table(spark, sf, "small_files"), table(spark, sf, "examples"))


def p2_journal_totals(spark: SparkSession, sf: str) -> DataFrame:
    """What has to hold of the journal, per key: every tiny file is one input, outputs are inputs once at most, rows add up."""
    journal = checkpoint(compaction.compact(table(spark, sf, "small_files"), table(spark, sf, "examples")))
    tiny = ~F.col("input").startswith("L")
    made = journal.where("output is not null").groupBy(F.col("output").alias("o")).agg(F.sum("rows_kept").alias("made"))
    seen = journal.join(made, F.col("input") == F.col("o"), "left")
    times = Window.partitionBy("input")
    seen = seen.withColumn("times", F.count(F.lit(1)).over(times))
    n = lambda c: F.count(F.when(c, 1))
    return seen.groupBy(F.col("key").cast("int").alias("dataset_id")).agg(
        n(tiny).alias("files"), n(tiny & F.col("output").isNull()).alias("discarded"), F.sum(F.when(tiny, F.col("rows_in"))).alias("rows_in"), F.sum(F.when(tiny, F.col("rows_kept"))).alias("rows_kept"),
        n(F.col("times") > 1).alias("inputs_twice"), n(~tiny & ~F.col("made").eqNullSafe(F.col("rows_kept"))).alias("rows_astray"),
    )


def p2_records(spark: SparkSession, sf: str) -> DataFrame:
    return compaction.compacted(table(spark, sf, "small_files"), table(spark, sf, "examples")).drop("out_file", "file_id")


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return nested.learning_features(table(spark, sf, "results"))


def p3_nodes(spark: SparkSession, sf: str) -> DataFrame:
    nodes = nested.label(table(spark, sf, "results"), ["extra", "target_order"], key="result_id")
    return nodes.groupBy("doc", "type", "kind").agg(F.count(F.lit(1)).alias("nodes"), F.max("depth").alias("depth"))


def p3_stages(spark: SparkSession, sf: str) -> DataFrame:
    """Stages of all records with the number of given targets and of features tied to them."""
    tables = nested.learning_tables(table(spark, sf, "results"))
    count = lambda name, what: tables[name].groupBy("rk", F.col("stage_pre").alias("pre")).agg(F.count(F.lit(1)).alias(what))
    stages = tables["stages"].join(count("targets", "targets"), ["rk", "pre"], "left").join(count("features", "features"), ["rk", "pre"], "left")
    return stages.select("result_id", F.col("stage_no").cast("int").alias("stage_no"), F.coalesce("targets", F.lit(0)).alias("targets"), F.coalesce("features", F.lit(0)).alias("features"))


def p3_targets(spark: SparkSession, sf: str) -> DataFrame:
    """Targets given beside their feature sets, tied to their stage."""
    tables = nested.learning_tables(table(spark, sf, "results"))
    stages = tables["stages"].select("rk", F.col("pre").alias("stage_pre"), "result_id", "stage_no")
    return tables["targets"].join(stages, ["rk", "stage_pre"]).select("result_id", F.col("stage_no").cast("int").alias("stage_no"), F.col("target").cast("int").alias("target"))


def p3_features(spark: SparkSession, sf: str) -> DataFrame:
    """Features tied to their stage and, where it is given, their target."""
    tables = nested.learning_tables(table(spark, sf, "results"))
    stages = tables["stages"].select("rk", F.col("pre").alias("stage_pre"), "result_id", "stage_no")
    targets = tables["targets"].select("rk", F.col("pre").alias("target_pre"), F.col("target").cast("int").alias("target"))
    return tables["features"].join(stages, ["rk", "stage_pre"]).join(targets, ["rk", "target_pre"], "left").select("result_id", F.col("stage_no").cast("int").alias("stage_no"), "target", "feature")


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    judged = bad_rows.judge(table(spark, sf, "raw_rows"), table(spark, sf, "datasets"))
    return judged.where(F.col("reason").isin("quoting", "columns", "value")).select("raw_id", "reason")


def p5_loaded(spark: SparkSession, sf: str) -> DataFrame:
    good, _ = bad_rows.split_rows(table(spark, sf, "raw_rows"), table(spark, sf, "datasets"))
    bits = lambda c: F.array_join(F.transform(c, lambda v: v.cast("string")), "").alias(c)
    return good.select("raw_id", F.col("parsed_id").alias("id"), bits("x"), bits("y"), "label", F.col("day").cast("string").alias("day"))


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return deliveries.copies(table(spark, sf, "result_messages"))


def p6_kept(spark: SparkSession, sf: str) -> DataFrame:
    return deliveries.keep_one(table(spark, sf, "result_messages")).select("delivery_id", "id", "batch_id", "worker", "body")


QUERIES: dict[str, Query] = {f.__name__: f for f in (p1_found, p1_unified, p1_applied, p1_leftovers, p2_found, p2_journal, p2_journal_totals, p2_records, p3_found, p3_nodes, p3_stages, p3_targets, p3_features, p5_found, p5_loaded, p6_found, p6_kept)}

_SIGNALS = ", ".join([*(f"x{i}" for i in range(8)), *(f"y{i}" for i in range(4))])
_MESSAGES = r"select *, nullif(lower(trim(id, e' \t\r\n')), '') as nid from result_messages"
_RANKED = f"select *, row_number() over (partition by nid order by received_at, delivery_id) as rn from ({_MESSAGES}) where nid is not null"
_FIELD = r'(?: *"(?:[^"]|"")*" *|[^",]*)'
_PARSED = f"""r as (select raw_id, line, ni, 1 + ni + nout + 2 as n, ni + nout as s from raw_rows join datasets using (dataset_id)),
        q as (select *, regexp_full_match(line, '{_FIELD}(?:,{_FIELD})*', 's') as quoted from r),
        v as (select *, case when quoted then list_transform(regexp_extract_all(',' || line, ',({_FIELD})', 1, 's'), lambda w: trim(w, ' ')) end as w from q),
        b as (select *, list_transform(w, lambda t: case when t[1] = '"' then replace(t[2:-2], '""', '"') else t end) as u from v),
        c as (select *, u[1] as id, u[n] as d from b),
        judged as (select *, case
                when not quoted then 'quoting'
                when len(u) <> n then 'columns'
                when not regexp_full_match(id, '[0-9]+') or coalesce(try_cast(id as hugeint), 9223372036854775808) > 9223372036854775807 then 'value'
                when len(list_filter(u[2:s + 1], lambda t: t <> '0' and t <> '1')) > 0 then 'value'
                when d <> '' and not (regexp_full_match(d, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') and try_cast(d as date) is not null) then 'value'
            end as reason from c)"""

_DRIFT = """with recursive rec as (select log_file_id, unnest(json_keys(line)) as k, line from record_lines),
        vals as (select log_file_id, k, json_extract(line, '$."' || k || '"') as v from rec),
        -- types of values; lists are opened level by level, their types put together from the inside
        leaf as (select log_file_id, k, v, json_type(v) as jt from vals),
        named as (select log_file_id, k, case
            when jt in ('UBIGINT', 'BIGINT', 'HUGEINT') then 'integer' when jt = 'DOUBLE' then 'decimal' when jt = 'VARCHAR' then 'string' when jt = 'BOOLEAN' then 'boolean' when jt = 'OBJECT' then 'object'
            when jt = 'ARRAY' then 'array<' || coalesce((select string_agg(distinct case json_type(u) when 'UBIGINT' then 'integer' when 'BIGINT' then 'integer' when 'HUGEINT' then 'integer' when 'DOUBLE' then 'decimal' when 'VARCHAR' then 'string' when 'BOOLEAN' then 'boolean' when 'OBJECT' then 'object' end, ',' order by 1) from (select unnest(json_extract(v, '$[*]')) as u)), '') || '>' end as t from leaf),
        fields as (select log_file_id, k, coalesce(string_agg(distinct t, '|' order by t), '') as ty from named group by all),
        ordered as (select log_file_id, stream_id, lag(log_file_id) over (partition by stream_id order by seq, log_file_id) as prev from record_files),
        pairs as (select o.log_file_id, f.k, f.ty as new, null::varchar as old from ordered o join fields f using (log_file_id) where prev is not null union all select o.log_file_id, f.k, null, f.ty from ordered o join fields f on f.log_file_id = o.prev),
        sides as (select log_file_id, k, max(new) as new, max(old) as old from pairs group by all),
        gone as (select *, count(*) over (partition by log_file_id, old) as n from sides where new is null),
        came as (select *, count(*) over (partition by log_file_id, new) as n from sides where old is null),
        ren as (select g.log_file_id, g.k as field, c.k as to_field from gone g join came c on g.log_file_id = c.log_file_id and g.old = c.new and g.n = 1 and c.n = 1)"""
# record fields, their place, the type that needs no cast
_TARGETS = """t as (select unnest(['id', 'learner', 'Ni', 'No', 'Ng', 'config_num', 'target_order', 'setup_time', 'learning_time', 'trg_err', 'test_err', 'extra']) as target,
            unnest(['integer', 'string', 'integer', 'integer', 'integer', 'integer', 'array<integer>', 'decimal', 'decimal', 'decimal', 'decimal', 'object']) as native, unnest(range(12)) as place)"""
_ROUTES = f"""{_DRIFT}, {_TARGETS},
        met as (select distinct a.k as x, b.k as y from fields a join fields b using (log_file_id)),
        pr as (select distinct unnest([stream_id::varchar, '*']) as scope, field as a, to_field as b from ren join record_files using (log_file_id) where (field, to_field) not in (select (x, y) from met)),
        nb as (select scope, a, b from pr union select scope, b, a from pr),
        reach as (select scope, target as k, place, 0 as far from (select distinct stream_id::varchar as scope from record_files union select '*'), t
            union select r.scope, b, place, far + 1 from reach r join nb on nb.scope = r.scope and nb.a = r.k where b not in (select target from t) and far < 12),
        chain as (select scope, k, min(far) as far, min_by(place, far * 100 + place) as place from reach group by all),
        held as (select distinct stream_id::varchar as scope, k from fields join record_files using (log_file_id)),
        own as (select * from held join chain using (scope, k)),
        family as (select scope from own group by scope having count(distinct place) >= 6),
        rule as (select * from own union all select h.scope, h.k, c.far, c.place from held h join chain c on c.scope = '*' and c.k = h.k where h.scope in (select scope from family) and (h.scope, h.k) not in (select (scope, k) from own)),
        routed as (select log_file_id, f.k as field, ty, place, target, native, far from fields f join record_files using (log_file_id) join rule on scope = stream_id::varchar and rule.k = f.k join t using (place))"""
_VALUES = f"""{_ROUTES},
        vals2 as (select log_file_id, line_no, k as field, json_extract(line, '$."' || k || '"') as v from (select *, unnest(json_keys(line)) as k from record_lines)),
        texts as (select *, case json_type(v) when 'NULL' then null when 'VARCHAR' then v ->> '$' else v::varchar end as s from vals2),
        cast_ as (select x.*, target, place, far, case
            when target in ('learner', 'extra') then s
            when target in ('id', 'Ni', 'No', 'Ng', 'config_num') then try_cast(s as bigint)::varchar
            when target = 'target_order' then case when lower(trim(s)) in ('lsb', 'msb') then lower(trim(s)) else to_json(try_cast(case when s like '[%' then replace(s, '"', '') else '[' || s || ']' end as int[]))::varchar end
            when target = 'setup_time' then try_cast(trim(regexp_replace(case when json_type(v) = 'OBJECT' then v ->> '$.value' else s end, '(?i)\\s*s(ec(onds)?)?\\s*$', '')) as double)::varchar
            when target is not null then try_cast(s as double)::varchar end as c from texts x left join routed using (log_file_id, field)),
        pick as (select *, row_number() over (partition by log_file_id, line_no, place order by c is null, far, field) as rn from cast_)"""

_DOCS = """with recursive raw as (select distinct result_id, nout, target_order, extra from results where extra is not null),
        un as (select result_id, nout, target_order, extra::json as e from raw
            union all select result_id, nout, target_order, case when json_type(e) = 'VARCHAR' then (e ->> '$')::json else json_extract(e, '$.extra') end from un
            where json_type(e) = 'VARCHAR' or (json_type(e) = 'OBJECT' and json_exists(e, '$.extra'))),
        doc as (select * from un where json_type(e) = 'OBJECT' and not json_exists(e, '$.extra'))"""
_SETS = """sets as (
            select result_id, nout, target_order, i::bigint as stage, null::bigint as target, json_extract(e, '$.feature_sets[' || i || ']') as fs
            from doc, lateral (select unnest(range(json_array_length(e, '$.feature_sets')::bigint)) as i)
            union all
            select result_id, nout, target_order, coalesce((s ->> '$.stage')::bigint, i), (t ->> '$.target')::bigint, json_extract(t, '$.fs')
            from (select *, json_extract(e, '$.strata[' || i || ']') as s from doc, lateral (select unnest(range(json_array_length(e, '$.strata')::bigint)) as i)),
                lateral (select unnest(case when json_type(s, '$.targets') = 'ARRAY' then json_extract(s, '$.targets[*]') else [json_extract(s, '$.targets')] end) as t)
            union all
            select result_id, nout, target_order, coalesce((s ->> '$.stage')::bigint, i), (s ->> '$.target')::bigint, json_extract(s, '$.feature_set.features')
            from (select *, json_extract(e, '$.stages[' || i || ']') as s from doc, lateral (select unnest(range(json_array_length(e, '$.stages')::bigint)) as i)))"""
# places of stages in a record are its own, so rows that agree in all but the place stay apart
_PLACED = f"""{_DOCS}, numbered as (select *, row_number() over () as rk from doc),
        lists as (select rk, result_id, i, null::json as s, json_extract(e, '$.feature_sets[' || i || ']') as direct, 'l' as form from numbered, lateral (select unnest(range(json_array_length(e, '$.feature_sets')::bigint)) as i)
            union all select rk, result_id, i, json_extract(e, '$.strata[' || i || ']'), null, 's' from numbered, lateral (select unnest(range(json_array_length(e, '$.strata')::bigint)) as i)
            union all select rk, result_id, i, json_extract(e, '$.stages[' || i || ']'), null, 't' from numbered, lateral (select unnest(range(json_array_length(e, '$.stages')::bigint)) as i)),
        stage as (select *, coalesce((s ->> '$.stage')::bigint, i)::int as stage_no from lists),
        tgt as (select rk, result_id, form, i, stage_no, (t ->> '$.target')::int as target, json_extract(t, '$.fs') as fs
                from stage, lateral (select unnest(case when json_type(s, '$.targets') = 'ARRAY' then json_extract(s, '$.targets[*]') else [json_extract(s, '$.targets')] end) as t) where form = 's'
            union all select rk, result_id, form, i, stage_no, (s ->> '$.target')::int, json_extract(s, '$.feature_set.features') from stage where form = 't'
            union all select rk, result_id, form, i, stage_no, null, direct from stage where form = 'l'),
        feat as (select rk, result_id, form, i, stage_no, target, ltrim(case json_type(f) when 'OBJECT' then f ->> '$.input' else f ->> '$' end, 'x')::int as feature from (select *, unnest(json_extract(fs, '$[*]')) as f from tgt))"""

_ADDING = f"""whens as (select file_id, written_at from small_files), first as (
            select e.dataset_id, e.id, {_SIGNALS}, min(row(f.written_at, f.file_id)) as place
            from examples e join whens f using (file_id) group by all),
        kept as (select place[2] as file_id, count(*) as n from first group by 1)"""

SQL: dict[str, str] = {
    "p1_found": f"""
        {_DRIFT}
        select log_file_id, k as field, 'retyped' as change from sides where new <> old
        union all select log_file_id, field, 'renamed' from ren
        union all select log_file_id, k, 'removed' from gone where (log_file_id, k) not in (select (log_file_id, field) from ren)
        union all select log_file_id, k, 'added' from came where (log_file_id, k) not in (select (log_file_id, to_field) from ren)""",
    "p1_applied": f"""
        {_ROUTES}
        select log_file_id, field, target, 'rename' as rule from routed where field <> target
        union all select log_file_id, field, target, 'cast' from routed where ty <> '' and ty <> native
        union all select log_file_id, null, target, 'default' from record_files, t where (log_file_id, target) not in (select (log_file_id, target) from routed)""",
    "p1_leftovers": f"""
        {_VALUES}
        select log_file_id, line_no, field, case when c is null then 'uncast' else 'unused' end as rule from pick where place is not null and s is not null and (c is null or rn > 1)""",
    "p1_unified": f"""
        {_VALUES},
        one as (select log_file_id, line_no, {", ".join(f"max(c) filter (target = '{n}' and rn = 1) as {n}" for n in ("id", "learner", "Ni", "No", "Ng", "config_num", "target_order", "setup_time", "learning_time", "trg_err", "test_err", "extra"))},
            string_agg(field, ',' order by field) filter (place is null or (s is not null and (c is null or rn > 1))) as other_keys, sum(try_cast(s as double)) filter (place is null or c is null or rn > 1) as other_sum from pick group by all)
        select log_file_id, line_no, id::bigint as id, learner, Ni::int as Ni, No::int as No, Ng::int as Ng, config_num::int as config_num, target_order, setup_time::double as setup_time, learning_time::double as learning_time, trg_err::double as trg_err,
            test_err::double as test_err, array_to_string(list_sort(json_keys(extra)), ',') as extra_keys, round(list_sum(json_extract(extra, '$.best_err')::double[]), 6) as extra_errors, coalesce(other_keys, '') as other_keys, round(coalesce(other_sum, 0), 6) as other_sum
        from record_lines left join one using (log_file_id, line_no)""",
    "p3_found": f"""
        {_DOCS}, {_SETS},
        feats as (select * exclude (fs, f), case json_type(f) when 'OBJECT' then (f ->> '$.input') else (f ->> '$') end as f from (select *, unnest(json_extract(fs, '$[*]')) as f from sets)),
        ord as (select distinct target_order, coalesce((o ->> '$.rank')::bigint, i) as stage, case json_type(o) when 'OBJECT' then (o ->> '$.target') else (o ->> '$') end::bigint as t
            from (select distinct target_order, i, json_extract(target_order, '$[' || i || ']') as o from (select distinct target_order from raw where target_order like '[%'), lateral (select unnest(range(json_array_length(target_order)::bigint)) as i)))
        select distinct result_id, stage::int as stage_no, coalesce(target, t, case when stage >= 0 and stage < nout then case target_order when 'lsb' then stage when 'msb' then nout - 1 - stage end end)::int as target, ltrim(f, 'x')::int as feature
        from feats left join ord using (target_order, stage)
        where coalesce(target, t, case when stage < nout then case target_order when 'lsb' then stage when 'msb' then nout - 1 - stage end end) is not null and f is not null""",
    "p3_stages": f"""
        {_PLACED}
        select s.result_id, s.stage_no, coalesce(t.n, 0) as targets, coalesce(f.n, 0) as features from stage s
        left join (select rk, form, i, count(target) as n from tgt group by all) t on t.rk = s.rk and t.form = s.form and t.i = s.i
        left join (select rk, form, i, count(feature) as n from feat group by all) f on f.rk = s.rk and f.form = s.form and f.i = s.i""",
    "p3_targets": f"""
        {_PLACED}
        select result_id, stage_no, target from tgt where target is not null""",
    "p3_features": f"""
        {_PLACED}
        select result_id, stage_no, target, feature from feat where feature is not null""",
    "p2_found": f"""
        with {_ADDING}
        select file_id from small_files where file_id not in (select file_id from kept)""",
    "p2_journal_totals": f"""
        with {_ADDING}
        select dataset_id, count(*) as files, count(*) filter (kept.file_id is null) as discarded, sum(coalesce(held.n, 0))::bigint as rows_in, sum(coalesce(kept.n, 0))::bigint as rows_kept, 0::bigint as inputs_twice, 0::bigint as rows_astray
        from small_files left join kept using (file_id) left join (select file_id, count(*) as n from examples group by 1) held using (file_id) group by 1""",
    "p2_records": f"select distinct dataset_id, id, {_SIGNALS} from examples",
    "p5_found": f"""
        with {_PARSED}
        select raw_id, reason from judged where reason is not null""",
    "p5_loaded": f"""
        with {_PARSED}
        select raw_id, id::bigint as id, array_to_string(u[2:ni + 1], '') as x, array_to_string(u[ni + 2:s + 1], '') as y, u[n - 1] as label, nullif(d, '') as day from judged where reason is null""",
    "p6_found": f"select delivery_id from ({_RANKED}) where rn > 1",
    "p6_kept": f"select delivery_id, id, batch_id, worker, body from result_messages where delivery_id not in (select delivery_id from ({_RANKED}) where rn > 1)",
}
