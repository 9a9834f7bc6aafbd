"""Size-tiered compaction of very many tiny files into few well-sized ones, with a journal.

Which record survives is settled first: of equal records (all record columns equal, nulls
equal too) the one in the earliest file stays, earlier meaning lower ``written_at``, then
lower ``file_id`` (a null time is later than any). Files are numbered in that order once;
the least number per record is one aggregation with map-side combination, so records that
stand in very many files do not gather in one task. A file none of whose records survives
adds nothing; the journal discards it.

The other files are merged level by level: files of a key (data set) in the same size tier
are merged ``fan_in`` at a time, their merger is a file of a higher tier, until files reach
the target size. A last sweep merges what is left of each key. Levels are planned over names
and sizes alone, all of a part of a key in one go; a key with very many files is planned in
parts of at most PLAN_FILES, and what the parts leave over (a few files per tier) is planned
again, until a key fits one part. Rows are moved once, from the tiny file to the file it ends in.

The target is in bytes as stored: every surviving record of a listed file is encoded as
Parquet where it is counted, and their mean tells what one takes, since the stated sizes of
tiny files are mostly overhead, and may be null or wrong. It decides on sizes only, never on
what is kept. (The file that a stored record came from is not counted in it.)

The journal has one row per input of each merge: transaction, level, key, input, output, rows
kept, and the file that the input has ended in after the planning stage. Transaction and file
names are hashes of their inputs, so planning or running the same input again gives the same
names, and a run that is found in the journal is not done again.

Defined results: files without rows are discarded; rows whose file is not listed count
as the latest file and are kept if they stand nowhere else; a listed file that stands twice
counts once with its lowest time; empty tables give an empty journal.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gatewright.session import checkpoint

RECORD = ["dataset_id", "id", *(f"x{i}" for i in range(8)), *(f"y{i}" for i in range(4))]
FAN_IN, TIER_BASE, TARGET_BYTES = 16, 4, 256 << 20
#: Files that one task plans, and bytes of records that a task holds at a time to encode them.
PLAN_FILES, BLOCK_BYTES = 50_000, 16 << 20
#: Keys that are written into a plan as a list; more of them are joined.
LISTED_KEYS = 1_000


def _files(files: DataFrame, key: str) -> DataFrame:
    named = files.select(F.col("file_id"), F.col("written_at").cast("timestamp_ntz").alias("written_at"), F.col(key).alias("__gw_key"))
    return named.where("file_id is not null").groupBy("file_id").agg(F.min("written_at").alias("written_at"), F.min("__gw_key").alias("__gw_key"))


def _numbered(files: DataFrame, key: str) -> DataFrame:
    """(file_id, seq, key): listed files numbered in their order, the earliest lowest; numbers rise with gaps.

    One number instead of a time and an id keeps what is shuffled per row small, and its
    minimum is found by hash aggregation. Written out, so that every reader sees the same numbers.
    """
    ordered = _files(files, key).orderBy(F.col("written_at").asc_nulls_last(), "file_id")
    return checkpoint(ordered.select("file_id", F.monotonically_increasing_id().alias("seq"), "__gw_key"))


def _packed(record: list[str]) -> tuple[list[Column], list[str]]:
    """The grouping key of a record in few bytes, still exact: signals in {0, 1} as bits, any others as they are."""
    signals = [c for c in record if c[:1] in "xy" and c[1:].isdigit()][:60]
    if not signals:
        return [F.col(f"`{c}`") for c in record], record
    plain = F.lit(True)
    for c in signals:
        plain = plain & F.coalesce(F.col(c).isin(0, 1), F.lit(False))
    bits = sum((F.shiftleft(F.col(c).cast("bigint"), i) for i, c in enumerate(signals)), F.lit(0).cast("bigint"))
    odd = F.when(~plain, F.array(*(F.col(c).cast("bigint") for c in signals)))
    rest = [c for c in record if c not in signals]
    return [*(F.col(f"`{c}`") for c in rest), F.when(plain, bits).alias("__gw_bits"), odd.alias("__gw_odd")], [*rest, "__gw_bits", "__gw_odd"]


def _survivors(numbered: DataFrame, rows: DataFrame, record: list[str]) -> DataFrame:
    """One row per distinct record: its columns and ``seq``, the number of its earliest listed file (null: none is listed)."""
    key_columns, key_names = _packed(record)
    at = numbered.select(F.col("file_id").alias("__gw_f"), "seq")
    narrow = rows.select(*key_columns, F.col("file_id").alias("__gw_file"))
    placed = narrow.join(at, F.col("__gw_file") == F.col("__gw_f"), "left")
    first = placed.groupBy(*key_names).agg(F.min("seq").alias("seq"))
    if key_names == record:
        return first
    signals = [c for c in record if c not in key_names]
    back = lambda i: F.coalesce(F.shiftright("__gw_bits", i).bitwiseAND(F.lit(1)), F.get("__gw_odd", F.lit(i)))
    types = dict(rows.dtypes)
    return first.select(*(back(signals.index(c)).cast(types[c]).alias(c) if c in signals else F.col(f"`{c}`") for c in record), "seq")


def _encoded_bytes(block: pa.Table) -> int:
    """Bytes of the pages of ``block`` as Parquet; of each column the smaller of plain and dictionary, as a writer picks it."""
    least: dict[str, int] = {}
    for dictionary in (False, True):
        made: list[pq.FileMetaData] = []
        pq.write_table(block, pa.MockOutputStream(), compression="snappy", use_dictionary=dictionary, metadata_collector=made)
        chunks = [made[0].row_group(g).column(c) for g in range(made[0].num_row_groups) for c in range(made[0].num_columns)]
        here: dict[str, int] = {}
        for chunk in chunks:
            here[chunk.path_in_schema] = here.get(chunk.path_in_schema, 0) + chunk.total_compressed_size
        least = {c: min(n, least.get(c, n)) for c, n in here.items()}
    return sum(least.values())


def _encoder(record: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Encodes all records, a block at a time: per ``seq`` of a block its records and their share of the block's bytes."""

    def shares(batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = pa.Table.from_batches(batches)
        each = _encoded_bytes(block.select(record)) / block.num_rows
        counts = block.group_by("seq").aggregate([([], "count_all")])
        n = counts["count_all"].combine_chunks()
        yield pa.RecordBatch.from_arrays([counts["seq"].combine_chunks(), n, pc.multiply(n.cast("double"), each)], ["seq", "rows_kept", "bytes_kept"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
            if sum(b.nbytes for b in held) >= BLOCK_BYTES:
                yield from shares(held)
                held = []
        if held:
            yield from shares(held)

    return run


def contributions(files: DataFrame, rows: DataFrame, *, record: list[str] = RECORD, key: str = "dataset_id", sized: bool = True) -> DataFrame:
    """Per listed file its key, the rows it holds, the rows that survive of it and (null unless ``sized``) the bytes these take."""
    numbered = _numbered(files, key)
    held = rows.groupBy("file_id").agg(F.count(F.lit(1)).alias("rows_in"))
    kept = _survivors(numbered, rows, record)
    if sized:
        # in the order in which they are stored
        blocks = kept.sortWithinPartitions(key, *record).mapInArrow(_encoder(record), "seq bigint, rows_kept bigint, bytes_kept double")
        kept = blocks.groupBy("seq").agg(F.sum("rows_kept").alias("rows_kept"), F.sum("bytes_kept").alias("bytes_kept"))
    else:
        kept = kept.groupBy("seq").agg(F.count(F.lit(1)).alias("rows_kept")).withColumn("bytes_kept", F.lit(None).cast("double"))
    listed = numbered.join(held, "file_id", "left").join(kept, "seq", "left")
    count = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return listed.select("file_id", "__gw_key", count("rows_in"), count("rows_kept"), "bytes_kept")


def row_bytes(contributed: DataFrame) -> float:
    """Bytes that the record columns take a row in a Parquet file: the mean over all surviving records."""
    total, n = contributed.agg(F.sum("bytes_kept"), F.sum("rows_kept")).first()
    return total / n if n else 1.0


def _tier(size: int) -> int:
    """floor(log(size)) to the base TIER_BASE, in whole numbers."""
    return (max(size, 1).bit_length() - 1) // (TIER_BASE.bit_length() - 1)


def merge_plan(units: list[tuple[str, int, int]], fan_in: int, target: int, *, last: bool) -> tuple[list[tuple], list[tuple[str, int, int]]]:
    """The merges of files (name, level, size) and the files there are afterwards.

    A merge is (level, [inputs], output); ``fan_in`` files of the same tier at a time, the
    smallest first. In the ``last`` stage what is left is put together up to the target.
    """
    tiers: dict[int, list[tuple[int, str, int]]] = {}
    full: list[tuple[str, int, int]] = []
    merges: list[tuple] = []

    def put(name: str, level: int, size: int) -> None:
        if size >= target:
            full.append((name, level, size))
        else:
            tiers.setdefault(_tier(size), []).append((size, name, level))

    def merge(members: list[tuple[int, str, int]]) -> None:
        level = max(m[2] for m in members)
        name = f"L{level}-" + hashlib.sha256(",".join(sorted(m[1] for m in members)).encode()).hexdigest()[:24]
        merges.append((level, [(m[1], m[0]) for m in members], name))
        put(name, level + 1, sum(m[0] for m in members))

    for unit in units:
        put(*unit)
    tier = min(tiers, default=0)
    while tiers and tier <= max(tiers):
        # mergers are of this tier or of a higher one, so tiers are done from the lowest up
        while len(here := sorted(tiers.get(tier, []))) >= fan_in:
            whole = len(here) // fan_in * fan_in
            tiers[tier] = here[whole:]
            for at in range(0, whole, fan_in):
                merge(here[at : at + fan_in])
        tier += 1
    left = sorted(m for members in tiers.values() for m in members)
    if last:
        tiers.clear()
        bin_: list[tuple[int, str, int]] = []
        for m in left:
            bin_.append(m)
            if sum(b[0] for b in bin_) >= target:
                merge(bin_) if len(bin_) > 1 else full.append((m[1], m[2], m[0]))
                bin_ = []
        if len(bin_) > 1:
            merge(bin_)
        elif bin_:
            full.append((bin_[0][1], bin_[0][2], bin_[0][0]))
        left = sorted(m for members in tiers.values() for m in members)
    return merges, full + [(name, level, size) for size, name, level in left]


_PLANNED = "kind string, level int, key string, input string, output string, rows_kept bigint, ends_in string"


def _planner(fan_in: int, target: int, last: bool) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def plan(group: pd.DataFrame) -> pd.DataFrame:
        key = group["key"].iloc[0]
        key = None if pd.isna(key) else key
        merges, after = merge_plan(list(zip(group["unit"], group["level"].astype(int), group["size"].astype(int), strict=True)), fan_in, target, last=last)
        ends = {name: name for name, _, _ in after}
        # the latest mergers first, so that an output's end is known before its inputs'
        for _, members, output in reversed(merges):
            for name, _ in members:
                ends[name] = ends[output]
        rows = [("merge", level, key, name, output, size, ends[name]) for level, members, output in merges for name, size in members]
        rows += [("unit", level, key, name, None, size, name) for name, level, size in after]
        return pd.DataFrame(rows, columns=["kind", "level", "key", "input", "output", "rows_kept", "ends_in"])

    return plan


def compact(
    files: DataFrame, rows: DataFrame, *, record: list[str] = RECORD, key: str = "dataset_id", fan_in: int = FAN_IN, target_bytes: int = TARGET_BYTES, bytes_per_row: float | None = None, plan_files: int = PLAN_FILES
) -> DataFrame:
    """The journal of the whole compaction.

    Columns: txn, level (that of the highest input; 0 = tiny files), key, input, output (null:
    discarded), rows_kept, stage, ends_in, rows_in (tiny files only). Every listed file is
    the input of one row: of a merge, of a discard, or, if it found no partner, of its own.
    """
    tiny = checkpoint(contributions(files, rows, record=record, key=key, sized=not bytes_per_row))
    target = max(1, int(target_bytes / (bytes_per_row or row_bytes(tiny))))
    named = tiny.select(F.col("__gw_key").cast("string").alias("key"), F.col("file_id").cast("string").alias("unit"), F.col("rows_kept").alias("size"), "rows_in")
    none = F.lit(None).cast("string")
    gone = named.where("size = 0").select(F.concat(F.lit("D-"), "unit").alias("txn"), F.lit(0).alias("level"), "key", F.col("unit").alias("input"), none.alias("output"), F.col("size").alias("rows_kept"), F.lit(0).alias("stage"), none.alias("ends_in"))
    units = named.where("size > 0").select("key", "unit", F.lit(0).alias("level"), "size")
    journal, stage, stuck = gone, 0, False
    while True:
        stage += 1
        # the largest key decides whether another stage is needed; one row per key
        per_key = units.where(F.col("size") < target).groupBy("key").agg(F.count(F.lit(1)).alias("n"))
        largest = per_key.agg(F.max("n")).first()[0] or 0
        # parts in which no tier fills up are swept as they are
        last = stuck or largest <= plan_files
        if largest <= plan_files:
            parted = units.withColumn("part", F.lit(0))
        else:
            parts = F.ceil(F.coalesce("n", F.lit(1)) / plan_files)
            at = per_key.select(F.col("key").alias("k"), "n")
            parted = units.join(at, F.col("key").eqNullSafe(F.col("k")), "left").withColumn("part", F.pmod(F.xxhash64("unit", F.lit(stage)), parts).cast("int")).drop("k", "n")
        done = checkpoint(parted.where(F.col("size") < target).groupBy("key", "part").applyInPandas(_planner(fan_in, target, last), _PLANNED))
        full = units.where(F.col("size") >= target)
        merged = done.where("kind = 'merge'").select(F.col("output").alias("txn"), "level", "key", "input", "output", "rows_kept", F.lit(stage).alias("stage"), "ends_in")
        journal = journal.unionByName(merged)
        left = done.where("kind = 'unit'").select("key", F.col("input").alias("unit"), "level", F.col("rows_kept").alias("size"))
        if last:
            units = left.unionByName(full)
            break
        stuck = merged.isEmpty()
        units = checkpoint(left.unionByName(full))
    alone = units.where(~F.col("unit").startswith("L")).select(
        F.concat(F.lit("S-"), "unit").alias("txn"), F.lit(0).alias("level"), "key", F.col("unit").alias("input"), F.concat(F.lit("L0-"), "unit").alias("output"), F.col("size").alias("rows_kept"), F.lit(stage).alias("stage"), F.concat(F.lit("L0-"), "unit").alias("ends_in")
    )
    read = named.select(F.col("unit").alias("__gw_in"), "rows_in")
    journal = journal.unionByName(alone)
    return journal.join(read, journal["input"] == read["__gw_in"], "left").drop("__gw_in")


def adds_nothing(journal: DataFrame) -> DataFrame:
    """``file_id`` of the files that the journal discards."""
    return journal.where("level = 0 and output is null").select(F.col("input").cast("bigint").alias("file_id"))


def _tiny(journal: DataFrame) -> DataFrame:
    return journal.where(~F.col("input").startswith("L"))


def destinations(journal: DataFrame) -> DataFrame:
    """``file_id`` and ``out_file``, the file in which its rows end; one join per planning stage after the first."""
    top = journal.agg(F.max("stage")).first()[0] or 0
    place = _tiny(journal).where("output is not null").select(F.col("input").alias("file_id"), F.col("stage").alias("from"), F.col("ends_in").alias("out_file"))
    for stage in range(2, top + 1):
        at = journal.where((F.col("stage") == stage) & F.col("input").startswith("L")).select(F.col("input").alias("out_file"), F.col("ends_in").alias("next"))
        place = place.join(at, "out_file", "left").select("file_id", F.coalesce("next", "out_file").alias("out_file"))
    return place.select(F.col("file_id").cast("bigint").alias("file_id"), "out_file")


def compacted(files: DataFrame, rows: DataFrame, journal: DataFrame | None = None, *, record: list[str] = RECORD, key: str = "dataset_id", **plan) -> DataFrame:
    """Every distinct record once, with ``out_file``, the well-sized file that is to hold it."""
    journal = compact(files, rows, record=record, key=key, **plan) if journal is None else journal
    numbered = _numbered(files, key)
    kept = _survivors(numbered, rows, record)
    ends = numbered.join(destinations(journal), "file_id", "left").select("seq", "file_id", "out_file")
    # what is in no listed file
    return kept.join(ends, "seq", "left").drop("seq").withColumn("out_file", F.coalesce("out_file", F.lit("L0-none")))


def run(spark: SparkSession, files: DataFrame, rows: DataFrame, folder: str, *, record: list[str] = RECORD, key: str = "dataset_id", **plan) -> DataFrame:
    """Compact the files that ``folder`` has not seen yet into it; returns the run's journal.

    A run writes its data, then its journal, each under a name made from its inputs and in
    overwrite mode: a run that broke off is repeated over its own remains, and a run that
    ended is found in the journal and not repeated. Records that ``folder`` holds already
    are not stored again; files of nothing else are discarded.

    Data lie in one folder per run and key with all the well-sized files of the key in it, so
    the stored records that new ones are compared with are those of the new records' keys
    alone. (A record's columns take fewer bytes than a hash of it would, so they are what is
    compared.)
    """
    if _exists(spark, f"{folder}/journal"):
        done = _tiny(spark.read.parquet(f"{folder}/journal")).select(F.col("input").cast("bigint").alias("file_id")).distinct()
        files = files.join(done, "file_id", "left_anti")
        rows = checkpoint(rows.join(done, "file_id", "left_anti"))
        rows = _not_stored(spark, rows, folder, record, key)
    journal = checkpoint(compact(files, rows, record=record, key=key, **plan))
    if journal.isEmpty():
        return journal
    stamp = journal.agg(F.sha2(F.concat_ws(",", F.count(F.lit(1)), F.sum(F.xxhash64("input", "output").cast("decimal(38,0)"))), 256)).first()[0][:24]
    records = compacted(files, rows, journal, record=record, key=key)
    # one task, and so one file, per output; outputs are few (all bytes over the target)
    outs = checkpoint(records.select("out_file").distinct().withColumn("__gw_no", F.row_number().over(Window.orderBy("out_file")) - 1))
    placed = records.join(outs, "out_file").repartitionById(max(outs.count(), 1), F.col("__gw_no").cast("int")).drop("__gw_no")
    kept_key = placed.withColumn("__gw_key", F.col(key).cast("string"))
    kept_key.sortWithinPartitions("__gw_key", *record[:2]).write.mode("overwrite").partitionBy("__gw_key").parquet(f"{folder}/data/run={stamp}")
    journal.write.mode("overwrite").parquet(f"{folder}/journal/run={stamp}")
    return journal


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def _not_stored(spark: SparkSession, rows: DataFrame, folder: str, record: list[str], key: str) -> DataFrame:
    """The rows whose record ``folder`` does not hold; only the folders of their keys are read (partition pruning)."""
    if not _exists(spark, f"{folder}/data"):
        return rows
    keys = rows.select(F.col(key).cast("string").alias("k")).distinct()
    few = [r["k"] for r in keys.limit(LISTED_KEYS + 1).collect()]
    stored = stored_records(spark, folder)
    mine = F.col("__gw_key")
    if len(few) <= LISTED_KEYS:
        # a list in the plan prunes folders before anything is read
        stored = stored.where(mine.isin([k for k in few if k is not None]) | (mine.isNull() if None in few else F.lit(False)))
    else:
        stored = stored.join(keys, mine.eqNullSafe(keys["k"]), "left_semi")
    stored = stored.select(*record)
    return rows.join(stored, [rows[c].eqNullSafe(stored[c]) for c in record], "left_anti")


def stored_records(spark: SparkSession, folder: str) -> DataFrame:
    """The records of all runs that the journal of ``folder`` lists; remains of broken runs are left out."""
    runs = spark.read.parquet(f"{folder}/journal").select(F.col("run").cast("string").alias("r")).distinct()
    data = spark.read.option("basePath", f"{folder}/data").parquet(f"{folder}/data").withColumns({"run": F.col("run").cast("string"), "__gw_key": F.col("__gw_key").cast("string")})
    return data.join(runs, F.col("run") == F.col("r"), "left_semi")
