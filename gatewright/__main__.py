"""Command line: check an experiment, list its tasks, run it, with results that resume.

    python -m gatewright check experiment.yaml
    python -m gatewright prepare experiment.yaml folder
    python -m gatewright run folder [--range first end | --list file]
"""

from __future__ import annotations

import argparse
import json
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from gatewright.plans import experiment


def main(arguments: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="gatewright")
    commands = parser.add_subparsers(dest="command", required=True)
    check = commands.add_parser("check", help="say whether an experiment is valid")
    check.add_argument("experiment")
    check.add_argument("-v", "--verbose", action="store_true", help="print the configurations")
    prepare = commands.add_parser("prepare", help="write an experiment's tasks")
    prepare.add_argument("experiment")
    prepare.add_argument("folder")
    run = commands.add_parser("run", help="run the tasks of a folder that have no result yet")
    run.add_argument("folder")
    some = run.add_mutually_exclusive_group()
    some.add_argument("--range", nargs=2, type=int, metavar=("FIRST", "END"), help="only tasks of these configurations")
    some.add_argument("--list", metavar="FILE", help="only the tasks whose ids the file lists, one a line")
    options = parser.parse_args(arguments)

    if options.command == "check":
        try:
            configurations = experiment.configurations(experiment.load(options.experiment))
        except (ValueError, KeyError, TypeError) as why:
            print(f"invalid: {why}")
            return 1
        print(f"valid: {len(configurations)} configurations")
        if options.verbose:
            print(json.dumps(configurations, indent=1))
        return 0
    spark = SparkSession.builder.appName("gatewright").getOrCreate()
    if options.command == "prepare":
        experiment.tasks(spark, experiment.load(options.experiment)).write.mode("overwrite").parquet(f"{options.folder}/tasks")
        return 0
    tasks = spark.read.parquet(f"{options.folder}/tasks")
    if options.range:
        tasks = tasks.where(F.col("config_num").between(options.range[0], options.range[1] - 1))
    if options.list:
        wanted = spark.read.text(options.list).select(F.trim("value").alias("task_id")).distinct()
        tasks = tasks.join(wanted, "task_id", "left_semi")
    results = experiment.run_new(tasks, f"{options.folder}/results")
    print(f"{results.count()} results in {Path(options.folder) / 'results'}")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
