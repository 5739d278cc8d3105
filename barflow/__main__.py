"""Command lines: `python -m barflow convert` and `python -m barflow profile`. Each builds one plan and runs it in the session that spark-submit, or the
environment, configures."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .plans import pipeline
from .plans.calendar import RowSessions
from .plans.config import ProfileConfig, load_contracts
from .sources import files, runs
from .sources.store import write_report


def parsed(arguments: list[str] | None = None) -> argparse.Namespace:
    top = argparse.ArgumentParser(prog="barflow", description=__doc__)
    commands = top.add_subparsers(dest="command", required=True)
    convert = commands.add_parser("convert", help="source tick files to one-minute bar files, and a report")
    profile = commands.add_parser("profile", help="representative contracts, profiles, levels and events of source tick files, as reports")
    for one in (convert, profile):
        one.add_argument("input", help="folder of source tick files, named symbol_YYYYMMDD.csv")
        one.add_argument("output", help="folder for what is made")
        one.add_argument("--roots", nargs="*", help="only contracts of these roots")
        one.add_argument("--days", nargs="*", help="only files of these days (YYYYMMDD)")
        one.add_argument("--max-bytes", type=int, help="a larger source file is an error")
        one.add_argument("--overwrite", action="store_true", help="the output folder's files may go")
    profile.add_argument("--contracts", required=True, help="contract metadata as JSON")
    return top.parse_args(arguments)


def convert(spark: SparkSession, o: argparse.Namespace) -> dict:
    """Bar files of all sources and a report of them; sessions by each contract's root. The totals, as the report's own job counts them."""
    rows = files.source_ticks(spark, o.input, roots=o.roots, days=o.days, max_bytes=o.max_bytes)
    kept = runs.Stages(runs.scratch(spark))(rows, "ticks")
    one, report = pipeline.convert(kept)
    written = runs.write_source_files(one, f"{o.output}/bars", overwrite=o.overwrite)
    names = ("rows", "valid_rows", "filtered_rows", "bad_price_rows", "backwards_rows", "resets")
    return written | runs.observed(report, {n: F.coalesce(F.sum(n), F.lit(0)) for n in names}, lambda df: write_report(df, f"{o.output}/report", overwrite=o.overwrite))


def profile(spark: SparkSession, o: argparse.Namespace) -> dict:
    """The six reports of a run; sessions by each contract's group."""
    contracts, groups = load_contracts(spark, o.contracts)
    rows = files.source_ticks(spark, o.input, roots=o.roots, days=o.days, max_bytes=o.max_bytes)
    cfg = ProfileConfig()
    run = pipeline.run(rows, contracts, RowSessions.by("session_group", groups), cfg, runs.Stages(runs.scratch(spark)))
    return runs.write_run(run, pipeline.normalization_stats(run.normalized), o.output, cfg, overwrite=o.overwrite)


def main(arguments: list[str] | None = None) -> int:
    o = parsed(arguments)
    spark = SparkSession.builder.appName(f"barflow {o.command}").getOrCreate()
    print(json.dumps({"convert": convert, "profile": profile}[o.command](spark, o), ensure_ascii=False))
    return 0


if __name__ == "__main__":
    sys.exit(main())
