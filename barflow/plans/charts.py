"""Chart documents of an instrument and day: frames of several grains, each gathered by key, as one JSON text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.times import minute_of_day
from ..operators.charts import afternoon_x, breaks, extent, gathered, nested, positions, thinned, tick_x, together
from ..operators.ticks import relevant_ticks, session_vwap
from .calendar import AnySessions

#: Versions of the two kinds of document.
FULL, SIMPLE = "1", "mvp-1"
#: What the parts of documents are, to read them again.
BAR = "array<struct<time:string,open:double,close:double,low:double,high:double,volume:double,openInterest:double,session:string,ticks:bigint>>"
POINT = "array<struct<x:double,price:double,time:string,volume:double,flags:string>>"
BREAK = "array<struct<x:double,minutes:int,label:string>>"
LEVEL = "array<struct<type:string,lower:double,upper:double,available:string,startX:double,role:string,outcome:string>>"
EVENT = "array<struct<x:double,price:double,time:string,type:string,role:string,outcome:string,mfe:double,mae:double>>"
STATS = "struct<ticks:bigint,tickPoints:int,bars:int,levels:int,events:int,bounce:int,break:int,timeout:int>"
SIMPLE_POINT, VWAP = "array<struct<x:double,price:double,time:string,volume:double>>", "array<struct<x:double,price:double>>"
BIN = "array<struct<price:double,volume:double,share:double>>"
ZONE = "array<struct<type:string,lower:double,upper:double,role:string,firstTouchTime:string,firstTouchX:double>>"
FULL_SCHEMA = f"version:string,tradingDay:string,instrument:string,tickSize:double,bars:{BAR},ticksOverview:{POINT},ticksFull:{POINT},breaks:{BREAK},levels:{LEVEL},events:{EVENT},profiles:map<string,map<string,array<array<double>>>>,priceMin:double,priceMax:double,stats:{STATS}"
SIMPLE_SCHEMA = f"algorithmVersion:string,tradingDay:string,instrument:string,tickSize:double,bars:{BAR},ticks:{SIMPLE_POINT},vwap:{VWAP},profile:{BIN},zones:{ZONE},priceMin:double,priceMax:double,quality:map<string,bigint>"


def _clock(time: Column) -> Column:
    return F.date_format(time, "yyyy-MM-dd HH:mm:ss.SSS")


def _bars(placed: DataFrame, sessions: AnySessions, keys: list[str]) -> DataFrame:
    item = F.struct(F.date_format("bar_time", "yyyy-MM-dd HH:mm").alias("time"), "open", "close", "low", "high", "volume", F.col("open_interest").alias("openInterest"), sessions.label(minute_of_day(F.col("bar_time"))).alias("session"), F.col("tick_count").alias("ticks"))
    return gathered(placed, keys, ["idx"], item, "bars")


def _document(columns: list[str]) -> Column:
    """The columns as JSON that may stand within a page."""
    return F.replace(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), F.lit("</"), F.lit("<\\/"))


def _filled(rows: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """rows in which a missing array or map is empty."""
    return rows.withColumns({c: F.coalesce(F.col(c), (F.array() if k.startswith("array") else F.create_map()).cast(k)) for c, k in kinds.items()})


def full_documents(bars: DataFrame, ticks: DataFrame, zones: DataFrame, events: DataFrame, profiles: DataFrame, sessions: AnySessions, tick: float, *, bucket_ms: int = 1000, padding: float = 0.025) -> DataFrame:
    """(symbol, day, payload) for each symbol and day that has bars: bars, breaks, all relevant ticks and an overview of four a bucket of time, levels with what
    came of them, events, profiles by method and scale, the extent of prices, and counts.

    All frames have symbol and day (text). ticks: accepted, with deltas, quality_flags and seq; zones: zone_no, node_types, lower, upper, available;
    events: zone_no, node_types, role, outcome, touch_time, touch_price, mfe_ticks, mae_ticks; profiles: method, sigma, bin, volume. Ticks of minutes that
    have no bar are not drawn. An instrument's day is one document, so its frames are small; each is gathered by one exchange.
    """
    keys = ["symbol", "day"]
    placed = positions(bars, keys)
    drawn = tick_x(relevant_ticks(ticks, keys), placed, keys).filter("x IS NOT NULL").select(*keys, "seq", "time", F.round("x", 10).alias("x"), "price", "delta_volume", F.array_join("quality_flags", "|").alias("flags"))
    point = F.struct("x", "price", _clock(F.col("time")).alias("time"), F.col("delta_volume").cast("double").alias("volume"), "flags")
    afternoon = sessions.label(minute_of_day(F.col("bar_time"))) == "afternoon"
    levels = zones.join(events.select(*keys, "zone_no", "role", "outcome"), [*keys, "zone_no"], "left").join(afternoon_x(placed, afternoon, keys).withColumnRenamed("x", "start_x"), keys)
    level = F.struct(F.col("node_types").alias("type"), "lower", "upper", "available", F.col("start_x").cast("double").alias("startX"), F.coalesce("role", F.lit("neutral")).alias("role"), F.coalesce("outcome", F.lit("no_touch")).alias("outcome"))
    touches = tick_x(events.withColumn("time", F.col("touch_time")), placed, keys).filter("x IS NOT NULL")
    event = F.struct(F.round("x", 10).alias("x"), F.col("touch_price").alias("price"), _clock(F.col("touch_time")).alias("time"), F.col("node_types").alias("type"), "role", "outcome", F.col("mfe_ticks").alias("mfe"), F.col("mae_ticks").alias("mae"))
    parts = [
        _bars(placed, sessions, keys),
        ticks.groupBy(*keys).agg(F.count("*").alias("all_ticks")),
        gathered(drawn, keys, ["seq"], point, "ticksFull"),
        gathered(thinned(drawn, keys, bucket_ms), keys, ["seq"], point, "ticksOverview"),
        gathered(breaks(placed, keys), keys, ["x"], F.struct(F.col("x").cast("double").alias("x"), "minutes", "label"), "breaks"),
        gathered(levels, keys, ["zone_no"], level, "levels"),
        gathered(touches, keys, ["time", "zone_no"], event, "events"),
        nested(profiles, keys, ["method", "sigma"], ["bin"], F.array((F.col("bin") * tick).cast("double"), F.col("volume").cast("double")), "profiles"),
        extent([(bars, "low", "high"), (zones, "lower", "upper")], tick, keys, padding).select(*keys, F.col("low").alias("priceMin"), F.col("high").alias("priceMax")),
    ]
    kinds = {"ticksOverview": POINT, "ticksFull": POINT, "breaks": BREAK, "levels": LEVEL, "events": EVENT, "profiles": "map<string,map<string,array<array<double>>>>"}
    rows = _filled(together(parts, keys).filter("bars IS NOT NULL"), kinds)
    came = lambda what: F.size(F.filter("events", lambda e: e["outcome"] == what)).alias(what)
    stats = F.struct(F.coalesce("all_ticks", F.lit(0)).alias("ticks"), F.size("ticksFull").alias("tickPoints"), F.size("bars").alias("bars"), F.size("levels").alias("levels"), F.size("events").alias("events"), came("bounce"), came("break"), came("timeout"))
    rows = rows.withColumns({"version": F.lit(FULL), "tradingDay": F.col("day"), "instrument": F.col("symbol"), "tickSize": F.lit(float(tick)), "stats": stats})
    return rows.select(*keys, _document(["version", "tradingDay", "instrument", "tickSize", "bars", "ticksOverview", "ticksFull", "breaks", "levels", "events", "profiles", "priceMin", "priceMax", "stats"]).alias("payload"))


def simple_documents(bars: DataFrame, ticks: DataFrame, zones: DataFrame, touched: DataFrame, profile: DataFrame, quality: DataFrame, sessions: AnySessions, tick: float, *, padding: float = 0.04) -> DataFrame:
    """(symbol, day, payload) for each symbol and day that has bars: bars, all accepted ticks, the running price by volume, the profile of last prices, zones
    with their first touch, the extent of prices, and counters of the source (quality: symbol, day and one column a counter).

    zones: zone_no, node_types, lower, upper; touched: zone_no, role, touch_time; profile: price, volume, share; otherwise as for full_documents."""
    keys = ["symbol", "day"]
    placed = positions(bars, keys)
    drawn = tick_x(ticks, placed, keys).withColumn("x", F.round("x", 10)).filter("x IS NOT NULL")
    point = F.struct("x", "price", _clock(F.col("time")).alias("time"), F.col("delta_volume").cast("double").alias("volume"))
    touch = tick_x(touched.withColumn("time", F.col("touch_time")), placed, keys).select(*keys, "zone_no", "role", "touch_time", F.round("x", 10).alias("x"))
    own = zones.join(touch, [*keys, "zone_no"], "left")
    zone = F.struct(F.col("node_types").alias("type"), "lower", "upper", F.coalesce("role", F.lit("neutral")).alias("role"), _clock(F.col("touch_time")).alias("firstTouchTime"), F.col("x").alias("firstTouchX"))
    counters = [c for c in quality.columns if c not in keys]
    parts = [
        _bars(placed, sessions, keys),
        gathered(drawn, keys, ["seq"], point, "ticks"),
        gathered(session_vwap(drawn, keys), keys, ["seq"], F.struct("x", F.col("vwap").alias("price")), "vwap"),
        gathered(profile, keys, ["price"], F.struct("price", F.col("volume").cast("double").alias("volume"), "share"), "profile"),
        gathered(own, keys, ["zone_no"], zone, "zones"),
        extent([(bars, "low", "high"), (zones, "lower", "upper"), (profile, "price", "price")], tick, keys, padding).select(*keys, F.col("low").alias("priceMin"), F.col("high").alias("priceMax")),
        quality.select(*keys, F.create_map(*(x for c in counters for x in (F.lit(c), F.col(c).cast("bigint")))).alias("quality")),
    ]
    kinds = {"ticks": SIMPLE_POINT, "vwap": VWAP, "profile": BIN, "zones": ZONE, "quality": "map<string,bigint>"}
    rows = _filled(together(parts, keys).filter("bars IS NOT NULL"), kinds)
    rows = rows.withColumns({"algorithmVersion": F.lit(SIMPLE), "tradingDay": F.col("day"), "instrument": F.col("symbol"), "tickSize": F.lit(float(tick))})
    return rows.select(*keys, _document(["algorithmVersion", "tradingDay", "instrument", "tickSize", "bars", "ticks", "vwap", "profile", "zones", "priceMin", "priceMax", "quality"]).alias("payload"))


def read_document(documents: DataFrame, schema: str) -> DataFrame:
    """documents with doc: the payload, read by the schema (FULL_SCHEMA or SIMPLE_SCHEMA)."""
    return documents.withColumn("doc", F.from_json("payload", f"struct<{schema}>"))
