"""What operators need of a session: tables by name, and lineage cut in a folder that all executors share."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint(df: DataFrame) -> DataFrame:
    """``df`` written once to the reliable checkpoint folder, so that its lineage ends there.

    The folder is the one the cluster names in ``spark.checkpoint.dir``. Only a session in a
    single JVM (tests, a laptop) may go without it and gets a temporary one, removed at its
    end; any other session raises, as a folder of one machine would lose its files with it.
    Checkpoints nobody refers to any more are removed by Spark itself if
    ``spark.cleaner.referenceTracking.cleanCheckpoints`` is set.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named:
            if not re.fullmatch(r"local(\[[\d,* ]+\])?", context.master):
                raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
            named = tempfile.mkdtemp(prefix="gatewright-")
            atexit.register(shutil.rmtree, named, True)
        context.setCheckpointDir(named)
    return df.checkpoint(eager=True)
