"""File sources: source tick CSVs, simplified tick CSVs, bar CSVs with a metadata line, external minute bars, calendars, catalogs.

Rows keep their order of arrival as seq: file, place of the split in the file, then place in the split. Paths are read by Spark alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.times import millis_of_day, simple_time, source_time
from ..schema import BAR_COLUMNS, EXTERNAL_BAR, SOURCE_TICK

BOM = "\ufeff"
#: Names with this mark are continuous contracts, which are no source of ticks. A fixed value.
CONTINUOUS = "连续"


def _lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """path, seq (place in the file, from 0) and value of each line. Lines are counted by split, so only a file's small table of splits
    is summed up."""
    rows = spark.read.text(paths).select(F.regexp_replace("value", f"^{BOM}|\r$", "").alias("value"), F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("own"))
    per = rows.groupBy("path", "block").agg(F.count("*").alias("__n"), F.min("own").alias("__first"))
    before = F.sum("__n").over(Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    start = per.select("path", "block", (F.coalesce(before, F.lit(0)) - F.col("__first")).alias("__shift"))
    return rows.join(F.broadcast(start), ["path", "block"]).select("path", (F.col("own") + F.col("__shift")).alias("seq"), "value")


def _settled(rows: DataFrame, column: str = "value") -> DataFrame:
    """rows as they are, but later filters on the column stay above this point: a check that raises must not see lines that were passed
    over, and Spark moves filters only through deterministic columns."""
    return rows.withColumn(column, F.when(F.monotonically_increasing_id() >= 0, F.col(column)))


def _csv(lines: DataFrame, required: list[str]) -> DataFrame:
    """CSV lines with a header in each file's first line: the required columns as text, others ignored, blank lines skipped. A file
    without a required column raises."""
    rows = lines.filter("trim(value) <> ''")
    cells = split_csv(F.col("value"))
    heads = rows.groupBy("path").agg(F.min_by(cells, "seq").alias("__head"), F.min("seq").alias("__at"))
    missing = F.array_except(F.array(*(F.lit(c) for c in required)), F.col("__head"))
    heads = heads.withColumn("__head", F.when(F.size(missing) > 0, F.raise_error(F.concat(F.lit("missing columns "), F.array_join(missing, ","), F.lit(" in "), F.col("path")))).otherwise(F.col("__head")))
    body = rows.join(F.broadcast(heads), "path").filter(F.col("seq") > F.col("__at")).withColumn("__cells", cells)
    place = lambda c: F.array_position("__head", F.lit(c)).cast("int")
    return _settled(body, "__cells").select("path", "seq", *(F.try_element_at("__cells", place(c)).alias(c) for c in required))


def split_csv(line: Column) -> Column:
    """Cells of one CSV line; quoted ones may hold commas, and doubled quotes stand for one."""
    cells = F.regexp_extract_all(F.concat(line, F.lit(",")), F.lit(r'(?:"((?:[^"]|"")*)"|([^,]*)),'), F.lit(0))
    strip = lambda c: F.substr(c, F.lit(1), F.length(c) - 1)
    return F.transform(cells, lambda c: F.when(c.startswith('"'), F.replace(F.regexp_replace(strip(c), '^"|"$', ""), F.lit('""'), F.lit('"'))).otherwise(strip(c)))


def identity(path: Column) -> tuple[Column, Column]:
    """(logical symbol, day) of a file named symbol_YYYYMMDD.csv; other names raise."""
    stem = F.regexp_extract(F.url_decode(path), r"([^/]+?)(\.csv)?(\.gz)?$", 1)
    day = F.regexp_extract(stem, r"^(.+)_([0-9]{8})$", 2)
    return F.when(day == "", F.raise_error(F.concat(F.lit("no symbol and day in name "), stem))).otherwise(F.regexp_extract(stem, r"^(.+)_([0-9]{8})$", 1)), day


def finite(c: str) -> Column:
    x = F.col(c).try_cast("double")
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), F.raise_error(F.concat(F.lit(f"{c} is no finite number in "), F.col("path"), F.lit(" row "), F.col("seq").cast("string")))).otherwise(x)


def chosen(spark: SparkSession, paths: str | list[str], *, skip: str | None = None, roots: list[str] | None = None, days: list[str] | None = None, max_bytes: int | None = None) -> list[str]:
    """The files that a scan should read, decided from their listing alone: without those whose name holds `skip`, of these roots (leading letters, in any case) and
    days (of names that end in _YYYYMMDD). A chosen file over max_bytes raises. The list is at the driver, as Spark's own list of a scan's files is."""
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    rows = spark.read.format("binaryFile").load(paths).select("path", "length", name.alias("name"))
    if skip is not None:
        rows = rows.filter(~F.col("name").contains(skip))
    if roots is not None:
        rows = rows.filter(F.upper(F.regexp_extract("name", "^([A-Za-z]+)", 1)).isin([r.upper() for r in roots]))
    if days is not None:
        rows = rows.filter(F.regexp_extract("name", r"_([0-9]{8})(\.csv)?(\.gz)?$", 1).isin(days))
    found = sorted((r.path, r.length) for r in rows.collect())
    if large := [p for p, n in found if max_bytes is not None and n > max_bytes]:
        raise ValueError(f"too large: {large[0]}")
    return [p for p, _ in found]


def source_ticks(spark: SparkSession, paths: str | list[str], *, roots: list[str] | None = None, days: list[str] | None = None, max_bytes: int | None = None) -> DataFrame:
    """Source tick files as ticks: symbol, source_file, source_day, trading_day, seq, time, millis_of_day, price, cumulative volume and
    turnover, open_interest. Continuous contracts are left out, and roots and days not asked for: such files are not scanned. A file with several
    instruments, or with a trading day other than its own or the day before, raises."""
    own = chosen(spark, paths, skip=CONTINUOUS, roots=roots, days=days, max_bytes=max_bytes)
    lines = _lines(spark, own) if own else spark.createDataFrame([], "path string, seq bigint, value string")
    raw = _csv(lines, SOURCE_TICK)
    name, day = identity(F.col("path"))
    raw = raw.withColumns({"source_file": name, "source_day": day})
    same = raw.groupBy("path").agg(F.min("InstrumentID").alias("__lo"), F.max("InstrumentID").alias("__hi"), F.collect_set("TradingDay").alias("__days"), F.max("source_day").alias("__d"))
    own = F.to_date("__d", "yyyyMMdd")
    allowed = F.array("__d", F.date_format(F.date_sub(own, 1), "yyyyMMdd"))
    wrong = F.when(F.col("__lo") != F.col("__hi"), F.raise_error(F.concat(F.lit("several instruments in "), F.col("path")))).when(F.size(F.array_except("__days", allowed)) > 0, F.raise_error(F.concat(F.lit("unexpected trading day in "), F.col("path")))).otherwise(F.lit(True))
    raw = raw.join(F.broadcast(same.select("path", wrong.alias("__ok"))), "path").filter("__ok").drop("__ok")
    return raw.select(
        F.col("InstrumentID").alias("symbol"), "source_file", "source_day", F.col("TradingDay").cast("int").alias("trading_day"), "seq", source_time(F.col("TradingDay"), F.col("UpdateTime"), F.nullif("UpdateMillisec", F.lit(""))).alias("time"),
        millis_of_day(F.col("UpdateTime"), F.col("UpdateMillisec")).alias("millis_of_day"), finite("LastPrice").alias("price"), finite("Volume").alias("volume"), finite("Turnover").alias("turnover"), finite("OpenInterest").alias("open_interest"),
    )


def simple_ticks(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """update_date, symbol, last_price, volume files as ticks; a time or number of wrong form raises."""
    raw = _csv(_lines(spark, paths), ["update_date", "symbol", "last_price", "volume"])
    time = simple_time(F.col("update_date"))
    time = F.when(time.isNull(), F.raise_error(F.concat(F.lit("no time in "), F.col("path"), F.lit(" row "), F.col("seq").cast("string")))).otherwise(time)
    return raw.select("symbol", "seq", time.alias("time"), finite("last_price").alias("price"), finite("volume").alias("volume"))


def read_bars(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Bars of bar files: lines that are blank, begin with # or are the header are passed over; any other must have twelve fields, all
    but the time numbers, else it raises with path and line. Nothing is sorted or made unique."""
    rows = _settled(_lines(spark, paths).filter(~F.col("value").rlike(r"^\s*$|^#|^bar_time")))
    f = F.split("value", ",")
    time = F.when(f[0].rlike(r"^\d{4}-\d\d-\d\d \d\d:\d\d:\d\d$"), f[0].try_cast("timestamp_ntz"))
    numbers = F.forall(F.slice(f, 2, 11), lambda x: x.rlike(r"^\s*[-+]?(\d+(\.\d*)?|\.\d+)([eE][-+]?\d+)?\s*$"))
    bad = (F.size(f) != 12) | time.isNull() | ~numbers
    ok = F.when(bad, F.raise_error(F.concat(F.lit("bad bar at "), F.col("path"), F.lit(":"), (F.col("seq") + 1).cast("string")))).otherwise(F.lit(True))
    kinds = {"trading_day": "int", "tick_count": "int", "flags": "int"}
    return rows.filter(ok).select("path", "seq", time.alias("bar_time"), *(F.trim(f[i]).cast("double").cast(kinds.get(c, "double")).alias(c) for i, c in enumerate(BAR_COLUMNS) if i))


def metadata(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, meta): the key=value tokens of each file's first line, if it begins with #."""
    rows = _settled(_lines(spark, paths).filter("seq = 0"))
    tokens = F.filter(F.split(F.regexp_replace("value", "^#", ""), r"\s+"), lambda t: t.contains("="))
    pairs = F.transform(tokens, lambda t: F.struct(F.substring_index(t, "=", 1).alias("k"), F.regexp_extract(t, "=(.*)$", 1).alias("v")))
    return rows.select("path", F.when(F.col("value").startswith("#"), F.map_from_entries(pairs)).otherwise(F.create_map().cast("map<string,string>")).alias("meta"))


def with_metadata_check(spark: SparkSession, paths: str | list[str], expected: dict[str, str]) -> DataFrame:
    """read_bars, raising if a file's metadata says something else than expected."""
    wrong = F.array_join(F.array_compact(F.array(*(F.when(~F.coalesce(F.col("meta")[k] == v, F.lit(False)), k) for k, v in expected.items()))), ",")
    ok = F.when(wrong != "", F.raise_error(F.concat(F.lit("metadata conflict in "), F.col("path"), F.lit(": "), wrong))).otherwise(F.lit(True))
    checked = metadata(spark, paths).select("path", ok.alias("__ok"))
    return read_bars(spark, paths).join(F.broadcast(checked), "path").filter("__ok").drop("__ok")


def external_bars(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """External minute bars as text: datetime, open, high, low, close, volume, hold."""
    return _csv(_lines(spark, paths), EXTERNAL_BAR).drop("path")


def jsonp_bars(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Bars from responses of the form `name=([...]);`: objects with short or long names, or arrays of seven. Size is a reader's limit."""
    body = spark.read.text(paths, wholetext=True).select(F.regexp_extract("value", r"(?s)=\s*\((.*)\)\s*;", 1).alias("j"))
    rows = body.select(F.posexplode(F.from_json("j", "array<string>")).alias("seq", "r"))
    short = dict(zip(EXTERNAL_BAR, "dohlcvp", strict=True))
    arr = F.from_json("r", "array<string>")
    pick = lambda i, c: F.when(F.col("r").startswith("["), F.get(arr, i)).otherwise(F.coalesce(F.get_json_object("r", f"$.{short[c]}"), F.get_json_object("r", f"$.{c}")))
    return rows.select("seq", *(pick(i, c).alias(c) for i, c in enumerate(EXTERNAL_BAR)))


#: Bytes of one response at most. A fixed value.
RESPONSE_BYTES = 4 << 20


def response_bars(spark: SparkSession, paths: str | list[str], *, max_bytes: int = RESPONSE_BYTES) -> DataFrame:
    """path, seq (place by time, from 0) and the columns of an external bar of stored responses, in order of time within each. A response that is over max_bytes, is
    not of the form `name=([...]);`, holds no bars, or holds a time twice, raises. A response is one row, so its bars are ordered within it."""
    own = chosen(spark, paths, max_bytes=max_bytes)
    body = spark.read.text(own, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.regexp_extract("value", r"(?s)=\s*\((.*)\)\s*;", 1).alias("j")) if own else spark.createDataFrame([], "path string, j string")
    short = dict(zip(EXTERNAL_BAR, "dohlcvp", strict=True))

    def bar(r: Column) -> Column:
        cells = F.from_json(r, "array<string>")
        pick = lambda i, c: F.when(r.startswith("["), F.get(cells, i)).otherwise(F.coalesce(F.get_json_object(r, f"$.{short[c]}"), F.get_json_object(r, f"$.{c}")))
        return F.struct(*(pick(i, c).alias(c) for i, c in enumerate(EXTERNAL_BAR)))

    rows = body.withColumn("bars", F.array_sort(F.transform(F.from_json("j", "array<string>"), bar)))
    times = F.transform("bars", lambda b: b["datetime"])
    said = lambda text: F.raise_error(F.concat(F.lit(f"{text} in "), F.col("path"))).cast("boolean")
    ok = F.when(F.col("bars").isNull(), said("no response")).when(F.size("bars") == 0, said("no bars")).when(F.size(F.array_distinct(times)) < F.size(times), said("a time twice")).otherwise(F.lit(True))
    return rows.filter(ok).select("path", F.posexplode("bars").alias("seq", "b")).select("path", "seq", "b.*")


def trade_dates(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Distinct trade dates of a JSON list or of lines; # begins a comment; YYYYMMDD or YYYY-MM-DD. Anything else raises, as does an
    empty calendar when it is used."""
    words = spark.read.text(paths).select(F.explode(F.split(F.regexp_replace(F.regexp_replace("value", "#.*$", ""), r'[\[\]",\s]+', " "), " ")).alias("w")).filter("w <> ''")
    day = F.coalesce(F.when(F.col("w").rlike(r"^\d{8}$"), F.try_to_timestamp("w", F.lit("yyyyMMdd"))), F.when(F.col("w").rlike(r"^\d{4}-\d\d-\d\d$"), F.try_to_timestamp("w", F.lit("yyyy-MM-dd")))).cast("date")
    return words.select(F.when(day.isNull(), F.raise_error(F.concat(F.lit("no date: "), F.col("w")))).otherwise(day).alias("trade_date")).distinct()


def catalog(spark: SparkSession, path: str, suffix: str = ".csv", max_bytes: int | None = None) -> DataFrame:
    """(day, name, path, length, modified) of files in folders named by day, from their listing alone; larger ones than max_bytes raise."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*{suffix}").load(path).select("path", "length", F.col("modificationTime").alias("modified"))
    parts = files.withColumn("day", F.regexp_extract("path", r"/(\d{8})(?:/[^/]+)*/[^/]+$", 1)).withColumn("name", F.regexp_extract(F.url_decode("path"), r"([^/]+)$", 1))
    parts = parts.filter(F.try_to_timestamp("day", F.lit("yyyyMMdd")).isNotNull())
    if max_bytes is not None:
        parts = parts.filter(F.when(F.col("length") > max_bytes, F.raise_error(F.concat(F.lit("too large: "), F.col("path")))).otherwise(F.lit(True)))
    return parts.select("day", "name", "path", "length", "modified")


def day_status(files: DataFrame, results: DataFrame, reviews: DataFrame) -> DataFrame:
    """Per day, newest first: raw and one-minute files, whether levels and report are there, the run's counts, and reviews. files: day, kind."""
    n = lambda k: F.count_if(F.col("kind") == k)
    per = files.groupBy("day").agg(n("raw").alias("raw_files"), n("1m").alias("bar_files"), (n("levels") > 0).alias("has_levels"), (n("report") > 0).alias("has_report"))
    seen = reviews.groupBy("day").agg(F.count("*").alias("reviews"))
    return per.join(results, "day", "left").join(seen, "day", "left").withColumn("reviews", F.coalesce("reviews", F.lit(0))).orderBy(F.desc("day"))


def manifest(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """A row for each instrument of manifest documents."""
    return spark.read.json(paths, multiLine=True).select(F.explode("instruments").alias("i")).select("i.*")
