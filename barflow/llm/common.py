"""Helpers that several operators share."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Rows that a Python worker turns into objects at a time.
SLICE = 512
#: Spark's own setting of the bytes after which a batch of rows goes to a Python worker, whatever its rows, and a value for it: a batch lies in
#: memory several times, in buffers of up to twice its size on Spark's side and two at a time in the worker.
BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: the one that spark.checkpoint.dir names. Only a session within one process
    (local mode, as in tests) may do without; it gets a temporary folder."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not context.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(named or f"{tempfile.gettempdir()}/checkpoints-{uuid.uuid4().hex}")
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut by a checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


class Tables:
    """Tables between the steps of one operator: Parquet in a folder of their own within the shared one, which goes at the end."""

    #: Spark's own setting: a finished write's shuffle files go at once, not when the driver happens to collect its garbage. A frame that is
    #: written here is never run again.
    TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

    def __init__(self, spark: SparkSession):
        self.spark, self.folder = spark, f"{shared_folder(spark)}/tables-{uuid.uuid4().hex}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """df, written and read again, so that what comes next does not repeat its work."""
        with self.tidied():
            df.write.parquet(f"{self.folder}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.folder}/{name}")

    @contextmanager
    def tidied(self) -> Iterator[None]:
        before = self.spark.conf.get(self.TIDY, None)
        self.spark.conf.set(self.TIDY, "true")
        try:
            yield
        finally:
            self.spark.conf.unset(self.TIDY) if before is None else self.spark.conf.set(self.TIDY, before)

    def drop(self, name: str = "") -> None:
        """Deletes a table that is no longer read, or all."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}".rstrip("/"))
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def tables(spark: SparkSession) -> Iterator[Tables]:
    own = Tables(spark)
    try:
        yield own
    finally:
        own.drop()


def short_batches(spark: SparkSession) -> None:
    """Sets BATCH for the session, unless it is set. It counts when a plan runs, which may be any time later, so it stays."""
    if spark.conf.get(BATCH, None) is None:
        spark.conf.set(BATCH, str(BATCH_BYTES))


def slices(batches: Iterable[pa.RecordBatch], rows: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The batches in slices of few rows, so that long texts do not become Python objects all at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def give_back() -> None:
    """Gives the memory that the process holds but no longer uses back to the system: Arrow's pool and the C library would keep it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def giving_back(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, for mapInArrow; at its end the worker gives memory back, since workers live on after their tasks, beside the next ones."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return tidied


@contextmanager
def uncollected() -> Iterator[None]:
    """Without Python's search for cycles, for code that makes very many objects and no cycles: the search would go through all that is
    remembered again and again. Also a decorator."""
    on = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if on:
            gc.enable()


def texts(column: pa.Array) -> list[str]:
    """The column as strings; null counts as the empty text."""
    return [x or "" for x in column.to_pylist()]


def raw(column: pa.Array) -> list[bytes]:
    """The column as UTF-8 bytes; null counts as the empty text."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


class Memo(dict):
    """A bounded table of fn's values, by entries and by the letters of their keys (LETTERS an entry on average). When full, what was asked for
    since the last time stays, older entries go; a key that alone would take much of the table is not kept. Values do not depend on it."""

    #: Letters of keys for each entry of the limit: words have fewer, lines of texts without spaces many more.
    LETTERS = 24

    def __init__(self, fn: Callable, limit: int):
        super().__init__()
        self.fn, self.half, self.old = fn, limit // 2, {}
        self.letters, self.most = 0, limit // 2 * self.LETTERS

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.fn(key)
        size = len(key)
        if size * 16 > self.most:
            return value
        if len(self) >= self.half or self.letters + size > self.most:
            self.old = dict(self)
            self.clear()
            self.letters = 0
        self.letters += size
        self[key] = value
        return value


def fresh(name: str, taken: list[str]) -> str:
    """name, or name with more underscores, as no column of taken is called."""
    while name.lower() in {t.lower() for t in taken}:
        name += "_"
    return name
