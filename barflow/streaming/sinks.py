"""Where live bars go: the archive, and functions that are told of each batch, once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.calendar import Sessions
from ..schema import BAR
from ..sources.store import exclusive, path_of, persist, safe_component
from .bars import live_bars

#: Told of a batch of bars that have closed, with the batch's number.
OnBars = Callable[[DataFrame, int], None]


class Ledger:
    """Which batches of a named query are in an archive: one empty file named by the number, in a folder beside the archive. Numbers grow, so the
    last one says it, and older files go."""

    def __init__(self, spark: SparkSession, archive: str, name: str):
        self.spark, self.folder = spark, f"{archive.rstrip('/')}.ledger/{safe_component(name)}"

    def last(self) -> int:
        fs, where = path_of(self.spark, self.folder)
        if not fs.exists(where):
            return -1
        return max((int(f.getPath().getName()) for f in fs.listStatus(where) if f.getPath().getName().isdigit()), default=-1)

    def enter(self, batch: int) -> None:
        fs, where = path_of(self.spark, f"{self.folder}/{batch}")
        fs.create(where, True).close()
        for f in fs.listStatus(where.getParent()):
            name = f.getPath().getName()
            if name.isdigit() and int(name) < batch:
                fs.delete(f.getPath(), False)


def into_archive(path: str, name: str, on_bars: OnBars | None = None) -> OnBars:
    """A function for foreachBatch that takes live bars into the archive at path (as persist does) and enters the batch in the ledger. A batch that comes again
    after it was entered does nothing. One that comes again before (the process ended in between) is persisted again, which changes nothing. on_bars is called
    before the batch is entered, so it sees each batch at least once, and again only if the process ended within that batch."""

    def take(bars: DataFrame, batch: int) -> None:
        spark = bars.sparkSession
        ledger = Ledger(spark, path, name)
        with exclusive(spark, f"{path.rstrip('/')}.ledger-{safe_component(name)}"):
            if batch <= ledger.last():
                return
            rows = bars.select(*bars.columns, F.lit(0.0).alias("settlement"), F.lit(0).alias("seq")).persist()
            try:
                persist(rows, path, BAR)
                if on_bars is not None:
                    on_bars(rows.drop("seq"), batch)
            finally:
                rows.unpersist()
            ledger.enter(batch)

    return take


def run(ticks: DataFrame, sessions: Sessions, path: str, name: str, checkpoint: str, *, periods: tuple[int, ...] = (5, 15), delay: str = "1 hour", on_bars: OnBars | None = None, **trigger) -> StreamingQuery:
    """Starts live bars of a stream of ticks into the archive at path. trigger: as for Spark's trigger (availableNow=True: what is there, then end)."""
    writer = live_bars(ticks, sessions, periods, delay=delay).writeStream.queryName(name).outputMode("append").option("checkpointLocation", checkpoint)
    return writer.foreachBatch(into_archive(path, name, on_bars)).trigger(**(trigger or {"processingTime": "1 second"})).start()


def replay(spark: SparkSession, folder: str, schema: str, sessions: Sessions, path: str, name: str, checkpoint: str, *, form: str = "parquet", files: int = 1, **options) -> None:
    """Feeds stored ticks (files of a folder, oldest first, `files` to a batch) through the live path into an archive, and returns when all are in. Files that
    came since the last replay under the same checkpoint are taken by the next one; those it has seen are not."""
    ticks = spark.readStream.format(form).schema(schema).option("maxFilesPerTrigger", files).load(folder)
    query = run(ticks, sessions, path, name, checkpoint, availableNow=True, **options)
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()
