"""The raw archive of external minute bars by year, bar files of many symbols at once, and text forms of bars and reviews."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import csv_cell, short_number
from ..functions.scalars import has_flag
from ..operators.dml import last_wins, upsert
from ..schema import BAR, BAR_COLUMNS, CLOSED, EXTERNAL_BAR
from .files import read_bars
from .ingest import consistent
from .store import exclusive, named_parts, only, path_of, read_archive

RAW = "symbol STRING, period STRING, year INT, datetime TIMESTAMP_NTZ, open DOUBLE, high DOUBLE, low DOUBLE, close DOUBLE, volume DOUBLE, hold DOUBLE"
RAW_KEYS, RAW_PARTS = ["symbol", "period", "datetime"], ["symbol", "period", "year"]
#: Columns of an exported review.
REVIEW_COLUMNS = ["tradingDay", "instrument", "zoneId", "nodeType", "center", "lower", "upper", "autoOutcome", "manualGrade", "manualBehavior", "profileQuality", "zoneQuality", "comment", "createdAt", "updatedAt"]


def exists(spark: SparkSession, path: str) -> bool:
    fs, where = path_of(spark, path)
    return fs.exists(where)


def bars_if_there(spark: SparkSession, path: str) -> DataFrame:
    """read_bars, or no bars where there is no such file."""
    if exists(spark, path):
        return read_bars(spark, path)
    bar = spark.createDataFrame([], BAR).select(*BAR_COLUMNS)
    return bar.select(F.lit("").alias("path"), F.lit(0).cast("bigint").alias("seq"), *bar.columns)


def read_raw(spark: SparkSession, path: str, **parts: object) -> DataFrame:
    """Rows of the raw archive; none where there is none yet. A row of another year than its partition's raises."""
    return _own_year(read_archive(spark, path, RAW, **parts))


def _own_year(rows: DataFrame) -> DataFrame:
    year = F.when(F.year("datetime") == F.col("year"), F.col("year")).otherwise(F.raise_error(F.concat(F.lit("outside of its year: "), F.col("datetime").cast("string"))).cast("int"))
    return rows.withColumn("year", year)


def upsert_raw(rows: DataFrame, path: str) -> int:
    """Takes rows (symbol, period, seq and the columns of an external bar) into the raw archive, the last of a time winning. All rows of all
    symbols, and what is there of their years, are checked before the first partition is written: a bar whose prices do not fit
    together, or a time that is there twice, raises, and nothing has changed. Returns the partitions written. Writers of one archive take turns."""
    spark = rows.sparkSession
    good = F.when(consistent(), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("inconsistent bar at "), F.col("datetime").cast("string"))))
    with exclusive(spark, path.rstrip("/")):
        batch = rows.withColumn("year", F.year("datetime")).filter(good)
        cols = [f.name for f in spark.createDataFrame([], RAW).schema]
        batch = last_wins(batch, RAW_KEYS).select(*cols, "seq")
        old = _own_year(only(read_archive(spark, path, RAW), named_parts(batch, RAW_PARTS), RAW_PARTS)).filter(good)
        twice = old.groupBy(*RAW_KEYS).count().filter("count > 1").limit(1).collect()
        if twice:
            raise ValueError(f"the archive has a time twice: {twice[0].symbol} {twice[0].period} {twice[0].datetime}")
        # all of it is computed, and so checked, into a folder of this run; only then are partitions exchanged
        staged = f"{path.rstrip('/')}.staged-{uuid.uuid4().hex}"
        upsert(old, batch, RAW_KEYS).write.parquet(staged)
        ready = spark.read.schema(RAW).parquet(staged)
        n = ready.select(*RAW_PARTS).distinct().count()
        if n:
            ready.repartition(*RAW_PARTS).sortWithinPartitions(*RAW_PARTS, "datetime").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*RAW_PARTS).parquet(path)
        fs, where = path_of(spark, staged)
        fs.delete(where, True)
        return n


def archive_metadata(symbol: str, period: str, *, zone: str, schema: str, source: str, source_time: str, calendar: str, night_start: str = "18:00", day_start: str = "08:00") -> str:
    """The first line of a canonical bar file: nine keys in this order."""
    pairs = {"symbol": symbol, "period": period, "tz": zone, "schema": schema, "source": source, "source_time": source_time, "calendar": calendar, "night_start": night_start, "day_start": day_start}
    if bad := [k for k, v in pairs.items() if not v or any(c.isspace() for c in v)]:
        raise ValueError(f"no metadata for {bad}")
    return "# " + " ".join(f"{k}={v}" for k, v in pairs.items())


def bar_lines(price: str = "%.2f") -> Column:
    """A bar as a line of a bar file."""
    form = {"volume": "%.0f", "turnover": "%.2f", "open_interest": "%.0f"}
    number = lambda c: F.format_string(form.get(c, price), F.col(c).cast("double"))
    cells = {"bar_time": F.date_format("bar_time", "yyyy-MM-dd HH:mm:ss"), **{c: F.col(c).cast("string") for c in ("trading_day", "tick_count", "flags")}}
    return F.concat_ws(",", *(cells[c] if c in cells else number(c) for c in BAR_COLUMNS))


def write_bar_files(bars: DataFrame, path: str, price: str = "%.2f") -> None:
    """Bars of many symbols as bar files, a folder a symbol and trading day, in order of time. The lines have no header."""
    day = F.col("trading_day").alias("day")
    lines = bars.select("symbol", day, "bar_time", bar_lines(price).alias("value")).repartition("symbol", "day").sortWithinPartitions("symbol", "day", "bar_time")
    lines.select("symbol", "day", "value").write.partitionBy("symbol", "day").text(path)


def read_ticks(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Normalised compressed ticks as rows of text, or of the schema given; flags that were joined by | are lists again."""
    rows = spark.read.option("header", True).csv(path) if schema is None else spark.read.option("header", True).schema(schema).csv(path)
    if "quality_flags" in rows.columns:
        rows = rows.withColumn("quality_flags", F.filter(F.split(F.coalesce("quality_flags", F.lit("")), r"\|"), lambda f: f != ""))
    return rows


def source_lines() -> Column:
    """An external bar as a line of a source CSV."""
    time = F.date_format("datetime", "yyyy-MM-dd HH:mm:ss")
    return F.concat_ws(",", time, *(short_number(F.col(c).cast("double")) for c in EXTERNAL_BAR[1:]))


def dry_run(rows: DataFrame, form: str = "csv") -> Iterator[str]:
    """Lines that would be written, csv or json, in the frame's order; no archive is read or touched."""
    if form not in ("csv", "json"):
        raise ValueError(f"no form: {form!r}")
    if form == "csv":
        yield ",".join(rows.columns)
    line = F.concat_ws(",", *(csv_cell(F.col(c)) for c in rows.columns)) if form == "csv" else F.to_json(F.struct(*rows.columns))
    for row in rows.select(line.alias("line")).toLocalIterator():
        yield row.line


def review_lines(reviews: DataFrame, day: str) -> Iterator[str]:
    """A day's reviews as CSV lines, by instrument and centre. reviews: columns named as in the export, but with underscores."""
    snake = lambda c: "".join("_" + x.lower() if x.isupper() else x for x in c)
    yield ",".join(REVIEW_COLUMNS)
    own = reviews.filter(F.col("trading_day") == day).orderBy("instrument", F.col("center").cast("double"))
    for row in own.select(F.concat_ws(",", *(csv_cell(F.col(snake(c))) for c in REVIEW_COLUMNS)).alias("line")).toLocalIterator():
        yield row.line


def bar_of(rows: DataFrame, keep: list[str] = []) -> DataFrame:  # noqa: B006
    """rows as bars, beside the columns to keep: columns that are missing, or null, are 0 (symbol and period: empty)."""
    kinds = [part.split() for part in BAR.split(", ")]
    zero = lambda kind: F.lit("") if kind == "STRING" else F.lit(0).cast(kind) if kind != "TIMESTAMP_NTZ" else F.lit("1970-01-01 00:00:00").cast(kind)
    return rows.select(*((F.coalesce(F.col(c).cast(kind), zero(kind)) if c in rows.columns else zero(kind)).alias(c) for c, kind in kinds), *keep)


def bar_text() -> Column:
    """A bar in one line for people."""
    head = F.format_string("%s TD=%d O:%.2f H:%.2f L:%.2f C:%.2f V:%.0f OI:%.0f", F.date_format("bar_time", "yyyy-MM-dd HH:mm:ss"), F.col("trading_day"), *(F.col(c).cast("double") for c in ("open", "high", "low", "close", "volume", "open_interest")))
    return F.concat(head, F.when(has_flag(F.col("flags"), CLOSED), " [closed]").otherwise(""))
