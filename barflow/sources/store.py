"""The bar archive: Parquet partitioned by symbol, period and trading day, and bar files for exchange with others."""

from __future__ import annotations

import os
import re
import tempfile
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import has_flag
from ..operators.dml import changes, last_wins, upsert
from ..schema import BAR_COLUMNS, CLOSED

KEYS = ["symbol", "period", "bar_time"]
PARTS = ["symbol", "period", "trading_day"]


def safe_component(text: str) -> str:
    """text, if it can be part of a path."""
    if not re.fullmatch(r"[A-Za-z0-9_.-]+", text) or text in (".", ".."):
        raise ValueError(f"not a path component: {text!r}")
    return text


def read_archive(spark: SparkSession, path: str, schema: str, **parts: object) -> DataFrame:
    """Bars of the archive (none if there is no archive yet); parts (symbol=, period=, trading_day=) prune partitions."""
    fs, where = path_of(spark, path)
    if not fs.exists(where):
        return spark.createDataFrame([], schema)
    df = spark.read.schema(schema).parquet(path)
    for k, v in parts.items():
        df = df.filter(F.col(k) == v)
    return df


def path_of(spark: SparkSession, path: str):
    """(file system, path) of a path as Spark reads it."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def persist(bars: DataFrame, path: str, schema: str) -> int:
    """Writes closed bars of the batch into the archive: the last of a key wins, over what is there too. Only trading days with a new
    or changed bar are written again, and of the archive only days that the batch names are read. Returns how many bars are new or changed; 0
    when the batch comes again. bars need seq. Writers of one archive take turns; what is staged has a folder of its own run, which goes at the end."""
    with exclusive(bars.sparkSession, path.rstrip("/")):
        return _persist(bars, path, schema)


def only(df: DataFrame, parts: list[tuple], names: list[str]) -> DataFrame:
    """df's rows in these partitions. Lists of literals, one a column, prune the folders that a scan reads; a join keeps the exact combinations."""
    spark = df.sparkSession
    if not parts:
        return df.limit(0)
    for k, name in enumerate(names):
        df = df.filter(F.col(name).isin(*sorted({p[k] for p in parts})))
    exact = spark.createDataFrame(parts, df.select(*names).schema)
    return df.join(exact, names, "left_semi")


#: Partitions that a batch may name: their list is kept at the driver, as that of an archive's folders is.
MOST_PARTS = 100_000


def named_parts(df: DataFrame, names: list[str]) -> list[tuple]:
    """The partitions that rows belong to; more than MOST_PARTS raise."""
    found = [tuple(r) for r in df.select(*names).distinct().limit(MOST_PARTS + 1).collect()]
    if len(found) > MOST_PARTS:
        raise ValueError(f"the batch belongs to more than {MOST_PARTS} partitions: write it in parts")
    return found


def replace_partitions(new: DataFrame, path: str, schema: str, parts: list[str], order: list[str]) -> DataFrame:
    """Writes new in place of the partitions that its rows belong to, a file each, in order; what new is made from may be what is replaced. Returns those rows as
    they lie in the table now."""
    spark = new.sparkSession
    staged = f"{path.rstrip('/')}.staged-{uuid.uuid4().hex}"
    new.write.mode("overwrite").parquet(staged)  # what is read must not be what is overwritten
    ready = spark.read.schema(schema).parquet(staged)
    named = named_parts(ready, parts)
    ready.repartition(*(F.col(c) for c in parts)).sortWithinPartitions(*parts, *order).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*parts).parquet(path)
    fs, where = path_of(spark, staged)
    fs.delete(where, True)
    return only(spark.read.schema(schema).parquet(path), named, parts)


def _persist(bars: DataFrame, path: str, schema: str) -> int:
    spark = bars.sparkSession
    cols = [f.name for f in spark.createDataFrame([], schema).schema]
    batch = last_wins(bars.filter(has_flag(F.col("flags"), CLOSED)), KEYS).select(*cols, F.lit(0).alias("seq")).persist()
    try:
        existing = only(read_archive(spark, path, schema), named_parts(batch, PARTS), PARTS)
        values = [c for c in cols if c not in KEYS]
        diff = changes(existing, batch, KEYS, values).filter("change <> 'unchanged'")
        moved = diff.join(batch.select(*KEYS, "trading_day"), KEYS).groupBy(*PARTS).count().collect()
        if not moved:
            return 0
        days = [tuple(r)[:3] for r in moved]
        new = upsert(only(read_archive(spark, path, schema), days, PARTS), only(batch, days, PARTS), KEYS)
        replace_partitions(new, path, schema, PARTS, ["bar_time"])
        return sum(r["count"] for r in moved)
    finally:
        batch.unpersist()


def exclusive(spark: SparkSession, path: str):
    """One writer at a time: a lock of the host for a local path, with file: or without, a lease beside any other."""
    plain = re.sub(r"^file:(?=/)/*", "/", path)
    return locked(plain) if "://" not in plain else Lease(spark, f"{path}.lease")


@contextmanager
def locked(path: str) -> Iterator[None]:
    """One writer at a time on a host: holds a lock file beside the local path."""
    import fcntl

    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with open(f"{path}.lock", "w") as f:
        fcntl.flock(f, fcntl.LOCK_EX)
        yield


class Lease:
    """One writer at a time on storage that hosts share: whoever creates the file has it, until it deletes it or its time is over. The file says owner and
    end (seconds since 1970), so clocks of hosts must agree to some seconds. A lease that has ended is moved away by a rename, which only one of those who
    wait can do. It needs a file system that creates a file for one caller alone (as HDFS does); the holder must be done in `seconds`."""

    def __init__(self, spark: SparkSession, path: str, *, seconds: float = 3600, wait: float = 0.2, patience: float = 7200):
        self.spark, self.path, self.seconds, self.wait, self.patience = spark, path, seconds, wait, patience
        self.owner = uuid.uuid4().hex

    def _create(self) -> bool:
        fs, where = path_of(self.spark, self.path)
        if fs.exists(where):
            return False
        try:
            out = fs.create(where, False)
        except Exception as e:  # noqa: BLE001 - another was first
            if "AlreadyExists" in str(e) or "already exists" in str(e):
                return False
            raise
        out.write(bytearray(f"{self.owner} {time.time() + self.seconds}".encode()))
        out.close()
        return True

    def held_by(self) -> tuple[str, float] | None:
        """Owner and end of the lease that is there; one that is still being written has no end yet."""
        fs, where = path_of(self.spark, self.path)
        try:
            text = bytes(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(s := fs.open(where))).decode()
            s.close()
        except Exception as e:  # noqa: BLE001 - it has gone
            if "FileNotFound" in str(e) or "does not exist" in str(e):
                return None
            raise
        owner, _, end = text.partition(" ")
        return owner, float(end) if end else float("inf")

    def _take_away(self) -> None:
        fs, where = path_of(self.spark, self.path)
        _, gone = path_of(self.spark, f"{self.path}.over-{self.owner}")
        if fs.rename(where, gone):
            fs.delete(gone, False)

    def __enter__(self) -> Lease:
        until = time.time() + self.patience
        while not self._create():
            held = self.held_by()
            if held is not None and held[1] < time.time():
                self._take_away()
            elif time.time() > until:
                raise TimeoutError(f"{self.path} is held by {held}")
            else:
                time.sleep(self.wait)
        return self

    def __exit__(self, *error: object) -> None:
        held = self.held_by()
        if held is not None and held[0] == self.owner:
            fs, where = path_of(self.spark, self.path)
            fs.delete(where, False)


def bar_line(row, price: str = "%.2f") -> str:
    """One line of a bar file, with the precision of its columns."""
    number = [price % row.open, price % row.high, price % row.low, price % row.close, "%.0f" % row.volume, "%.2f" % row.turnover, "%.0f" % row.open_interest, price % row.settlement]
    return ",".join([row.bar_time.strftime("%Y-%m-%d %H:%M:%S"), str(row.trading_day), *number, str(row.tick_count), str(row.flags)])


def write_bar_file(bars: DataFrame, path: str, *, symbol: str, period: str, price: str = "%.2f", zone: str = "Asia/Shanghai", tool: str = "barflow") -> int:
    """One local bar file of a day's bars (a few hundred): written beside its place, then moved there in one step."""
    safe_component(symbol), safe_component(period)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    fd, temp = tempfile.mkstemp(dir=os.path.dirname(path))
    n = 0
    with os.fdopen(fd, "w", encoding="utf-8") as f:
        f.write(f"# symbol={symbol} period={period} tz={zone} generated_by={tool}\n{','.join(BAR_COLUMNS)}\n")
        for row in bars.orderBy("bar_time").toLocalIterator():
            f.write(bar_line(row, price) + "\n")
            n += 1
        f.flush()
        os.fsync(f.fileno())
    os.replace(temp, path)
    return n


def write_ticks(ticks: DataFrame, path: str, *, overwrite: bool = False) -> None:
    """Normalised ticks as compressed CSV; without overwrite an existing target raises. Lists become text joined by |."""
    flat = ticks.select(*(F.array_join(F.col(f.name), "|").alias(f.name) if f.dataType.typeName() == "array" else F.col(f.name) for f in ticks.schema))
    flat.write.mode("overwrite" if overwrite else "errorifexists").option("compression", "gzip").option("header", True).csv(path)


def write_report(df: DataFrame, path: str, *, overwrite: bool = False) -> None:
    """A report as one CSV: for summaries, whose size the query bounds."""
    df.coalesce(1).write.mode("overwrite" if overwrite else "errorifexists").option("header", True).option("quote", '"').option("escape", '"').csv(path)
