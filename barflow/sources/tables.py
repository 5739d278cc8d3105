"""Tables on shared storage that are changed by partition: the canonical archive of external bars, with a manifest, and reviews."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.dml import delete, last_wins, upsert, valid_review
from ..schema import BAR, BAR_COLUMNS
from .raw import archive_metadata
from .store import KEYS, PARTS, exclusive, named_parts, only, path_of, read_archive, replace_partitions

#: What a bar's rows are compared by.
_VALUES = [c for c in BAR_COLUMNS if c != "bar_time"]
#: A manifest row: what a partition of the archive was made with, how many bars it has, and a fingerprint of the last batch that it took.
MANIFEST = "symbol STRING, period STRING, trading_day INT, metadata STRING, rows BIGINT, batch_rows BIGINT, batch_hash BIGINT"
REVIEW = "trading_day STRING, instrument STRING, zone_id STRING, node_type STRING, center DOUBLE, lower DOUBLE, upper DOUBLE, auto_outcome STRING, grade STRING, behavior STRING, quality STRING, zone_quality STRING, comment STRING, created_at TIMESTAMP_NTZ, updated_at TIMESTAMP_NTZ"
REVIEW_KEYS = ["trading_day", "instrument", "zone_id"]


class Conflict(ValueError):
    """An archive was made with other metadata."""


def write_canonical(bars: DataFrame, path: str, *, tool: str = "barflow", **metadata: str) -> dict[str, int]:
    """Takes canonical bars (with seq) into the archive at path, the last of a time winning. metadata: as for archive_metadata, without symbol and period. Returns how
    many partitions were written and how many passed over.

    The manifest beside the archive has a row a partition. Before anything is written, each partition that the batch names must have been made with the same nine
    keys, else Conflict is raised and nothing has changed. A partition whose last batch was this one is passed over without being read; so the same
    batch again reads the manifest alone. Bars are written before the manifest: a run that ends in between is simply done again.
    """
    spark = bars.sparkSession
    path = path.rstrip("/")
    cols = [part.split()[0] for part in BAR.split(", ")]
    batch = last_wins(bars, KEYS).select(*cols).persist()
    try:
        with exclusive(spark, path):
            line = lambda symbol, period: archive_metadata(symbol, period, **metadata)
            # sums of hashes do not depend on the order of rows; few rows a partition
            each = batch.groupBy(*PARTS).agg(F.count("*").alias("n"), F.expr(f"bit_xor(xxhash64({', '.join(cols)}))").alias("x"), F.sum(F.expr(f"xxhash64({', '.join(cols)}, 1) div 1000000")).alias("s"))
            named = named_parts(each.select(*PARTS, "n", F.xxhash64("x", "s").alias("h")), [*PARTS, "n", "h"])
            known = {tuple(r)[:3]: r for r in only(read_archive(spark, f"{path}.manifest", MANIFEST), [p[:3] for p in named], PARTS).collect()}
            for p in named:
                if p[:3] in known and known[p[:3]].metadata != line(*p[:2]):
                    raise Conflict(f"{p[:3]} was made with {known[p[:3]].metadata!r}, not {line(*p[:2])!r}")
            moved = [p for p in named if p[:3] not in known or (known[p[:3]].batch_rows, known[p[:3]].batch_hash) != p[3:]]
            if moved:
                parts = [p[:3] for p in moved]
                new = upsert(only(read_archive(spark, path, BAR), parts, PARTS), only(batch, parts, PARTS).withColumn("seq", F.lit(0)), KEYS)
                written = replace_partitions(new, path, BAR, PARTS, ["bar_time"])
                rows = {tuple(r)[:3]: r["count"] for r in only(written, parts, PARTS).groupBy(*PARTS).count().collect()}
                entries = spark.createDataFrame([(*p[:3], line(*p[:2]), rows[p[:3]], *p[3:]) for p in moved], MANIFEST)
                old = only(read_archive(spark, f"{path}.manifest", MANIFEST), sorted({p[:2] for p in moved}), PARTS[:2])
                replace_partitions(upsert(old, entries.withColumn("seq", F.lit(0)), PARTS), f"{path}.manifest", MANIFEST, PARTS[:2], ["trading_day"])
            return {"written": len(moved), "unchanged": len(named) - len(moved)}
    finally:
        batch.unpersist()


def read_canonical(spark: SparkSession, path: str) -> DataFrame:
    """Bars of the archive with the metadata that their partition was made with."""
    return read_archive(spark, path, BAR).join(read_archive(spark, f"{path.rstrip('/')}.manifest", MANIFEST).select(*PARTS, "metadata"), PARTS)


class Reviews:
    """Reviews by trading day: a change reads and writes the days that it names. Writers take turns."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def all(self) -> DataFrame:
        return read_archive(self.spark, self.path, REVIEW)

    def of(self, day: str, instrument: str | None = None) -> DataFrame:
        rows = self.all().filter(F.col("trading_day") == day)
        return (rows if instrument is None else rows.filter(F.col("instrument") == instrument)).orderBy("instrument", "center")

    def counts(self, day: str) -> DataFrame:
        """(instrument, reviews) of a day."""
        return self.all().filter(F.col("trading_day") == day).groupBy("instrument").agg(F.count("*").alias("reviews"))

    def put(self, change: DataFrame) -> int:
        """Takes reviews (all columns; of rows with one key, the last by updated_at) into the table. An existing one keeps its created_at; values out of their
        lists raise, and nothing has changed. Returns the days written."""
        ok = valid_review(F.col("grade"), F.col("behavior"), F.col("quality"), F.col("comment"))
        names = [part.split()[0] for part in REVIEW.split(", ")]
        checked = change.filter(F.when(ok, F.lit(True)).otherwise(F.raise_error(F.lit("invalid review")))).select(*names, F.col("updated_at").alias("seq"))
        return self._change(checked, lambda old, new: upsert(old, new, REVIEW_KEYS, keep_old=["created_at"]))

    def drop(self, keys: DataFrame) -> int:
        """Deletes the reviews of these keys; returns the days that were written."""
        return self._change(keys.select(*REVIEW_KEYS), lambda old, gone: delete(old, gone, REVIEW_KEYS))

    def _change(self, rows: DataFrame, change) -> int:
        with exclusive(self.spark, self.path):
            days = named_parts(rows, ["trading_day"])
            if not days:
                return 0
            left = replace_partitions(change(only(self.all(), days, ["trading_day"]), rows), self.path, REVIEW, ["trading_day"], ["instrument", "center"])
            # a day without rows has no folder to overwrite: its old one goes
            for (day,) in set(days) - set(named_parts(left, ["trading_day"])):
                fs, where = path_of(self.spark, f"{self.path}/trading_day={day}")
                fs.delete(where, True)
            return len(days)
