"""Queries that write files and archives in the session's shared folder and read them again, and text forms, with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import names
from .operators import bars, events, profile
from .plans import charts
from .plans.pipeline import convert, quality_stats, simple_profile
from .queries import ARCHIVE, BARS, BASE, CONFIG, DELTAS, EVENTS, INS, KEY, MORNING, SESSIONS, _archive, _deltas, _one, _rolled, _with_deltas, _zones, query
from .schema import BAR, EXTERNAL_BAR, TICK
from .sources import files, raw, records, runs, store, tables
from .sources.events import event_ticks
from .streaming import sinks
from .streaming.bars import COLUMNS

EXTERNAL = "bar_time AS datetime, open, high, low, close, volume::DOUBLE AS volume, open_interest AS hold"


_place = runs.scratch


def _external(spark: SparkSession, sf: str) -> DataFrame:
    b = _one(spark, sf)
    return b.select("symbol", F.lit("1m").alias("period"), F.col("bar_time").alias("datetime"), "open", "high", "low", "close", F.col("volume").cast("double").alias("volume"), F.col("open_interest").alias("hold"))


@query("s1_k1_bar_files", f"{BARS} SELECT symbol, bar_time, trading_day, round(open, 2) AS open, round(high, 2) AS high, round(low, 2) AS low, round(close, 2) AS close, volume::DOUBLE AS volume, open_interest, tick_count, flags FROM b")
def bar_files(spark, sf):
    place = _place(spark)
    raw.write_bar_files(_one(spark, sf), place)
    back = raw.bars_if_there(spark, place).withColumn("symbol", F.regexp_extract(F.url_decode("path"), "/symbol=([^/]+)/", 1))
    return back.select("symbol", "bar_time", "trading_day", "open", "high", "low", "close", "volume", "open_interest", "tick_count", "flags")


@query("k2_k4_archive", f"{ARCHIVE} SELECT symbol, bar_time, coalesce(lw.close, ex.close) AS close, coalesce(lw.volume, ex.volume)::DOUBLE AS volume FROM ex FULL JOIN lw USING (symbol, bar_time)")
def archive(spark, sf):
    place = _place(spark)
    old, batch = _archive(spark, sf)
    day = F.date_format("bar_time", "yyyyMMdd").cast("int").alias("trading_day")
    for part in (old.withColumn("seq", F.lit(0)), batch):
        rows = part.select("symbol", F.lit("1m").alias("period"), "bar_time", day, "close", "volume", F.lit(1).alias("flags"), "seq")
        store.persist(raw.bar_of(rows, keep=["seq"]), place, BAR)
    return store.read_archive(spark, place, BAR).select("symbol", "bar_time", "close", "volume")


@query("s24_k7_raw_archive", f"{BARS}, x AS (SELECT symbol, {EXTERNAL} FROM b WHERE low > 0) SELECT symbol, '1m' AS period, year(datetime)::INT AS year, datetime, open, high + CASE WHEN minute(datetime) % 2 = 0 THEN 1 ELSE 0 END AS high, low, close, volume, hold FROM x")
def raw_archive(spark, sf):
    place, rows = _place(spark), _external(spark, sf).filter("low > 0")
    raw.upsert_raw(rows.withColumn("seq", F.lit(0)), place)
    even = rows.filter(F.minute("datetime") % 2 == 0).withColumn("high", F.col("high") + 1)
    raw.upsert_raw(even.withColumn("seq", F.lit(1)), place)
    return raw.read_raw(spark, place)


@query("s12_k10_normalised_ticks", f"{DELTAS} SELECT symbol, seq, price, delta_volume::BIGINT AS delta_volume, concat_ws('|', CASE WHEN volume < pv THEN 'VOLUME_RESET' END, CASE WHEN turnover < pt THEN 'TURNOVER_RESET' END, CASE WHEN gap_millis > 10000 THEN 'LONG_GAP' END) AS quality_flags FROM d")
def normalised_ticks(spark, sf):
    place = _place(spark)
    store.write_ticks(_with_deltas(spark, sf).select("symbol", "seq", "price", "delta_volume", "quality_flags"), place)
    back = raw.read_ticks(spark, place, "symbol string, seq bigint, price double, delta_volume bigint, quality_flags string")
    return back.withColumn("quality_flags", F.array_join("quality_flags", "|"))


@query("m16_bar_text", f"{BARS} SELECT symbol, printf('%s TD=%d O:%.2f H:%.2f L:%.2f C:%.2f V:%.0f OI:%.0f', strftime(bar_time, '%Y-%m-%d %H:%M:%S'), trading_day, open, high, low, close, volume::DOUBLE, open_interest) || ' [closed]' AS line FROM b")
def bar_text(spark, sf):
    return raw.bar_of(_one(spark, sf)).select("symbol", raw.bar_text().alias("line"))


@query("k19_source_lines", f"{BARS}, x AS (SELECT symbol, {EXTERNAL} FROM b) SELECT symbol, concat_ws(',', strftime(datetime, '%Y-%m-%d %H:%M:%S'), {', '.join(f'''printf('%.15g', {c})''' for c in EXTERNAL_BAR[1:])}) AS line FROM x")
def source_lines(spark, sf):
    return _external(spark, sf).select("symbol", raw.source_lines().alias("line"))


@query("t18_event_text", f"{BASE} SELECT seq, strftime(time, '%Y-%m-%d %H:%M:%S.') || lpad((epoch_us(time) // 1000 % 1000)::VARCHAR, 3, '0') AS event_time FROM ticks")
def event_text(spark, sf):
    time = F.col("time")
    ms = F.unix_millis(time.cast("timestamp")) % 1000
    return event_ticks(spark, sf).select("seq", names.event_text(F.date_format(time, "yyyyMMdd"), F.date_format(time, "HH:mm:ss"), ms).alias("event_time"))


@query(
    "a12_f5_quality_stats",
    f"""{BASE}, iv AS (SELECT * REPLACE (CASE WHEN seq % 53 <> 0 AND seq % 61 <> 0 THEN price END AS price) FROM ticks),
    ij AS (SELECT *, max(CASE WHEN price > 0 AND {INS} THEN time END) OVER (PARTITION BY symbol ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS base FROM iv),
    ik AS (SELECT *, CASE WHEN NOT coalesce(price > 0, false) THEN 'price' WHEN NOT {INS} THEN 'session' WHEN time < base THEN 'time' ELSE 'valid' END AS verdict FROM ij),
    il AS (SELECT *, lag(volume) OVER (PARTITION BY symbol ORDER BY seq) AS pv FROM ik WHERE verdict = 'valid'),
    good AS (SELECT symbol, count_if(coalesce(volume < pv, false))::BIGINT AS volume_resets, count_if(pv IS NULL OR volume <= pv)::BIGINT AS zero_delta_rows, count_if({MORNING})::BIGINT AS morning_rows, count_if(m >= 810 AND m < 900)::BIGINT AS afternoon_rows FROM il GROUP BY symbol)
    SELECT ik.symbol, count(*) AS rows, count_if(verdict = 'valid')::BIGINT AS valid_rows, count_if(verdict = 'session')::BIGINT AS filtered_rows, count_if(verdict = 'price')::BIGINT AS bad_price_rows, count_if(verdict = 'time')::BIGINT AS backwards_rows,
           coalesce(any_value(volume_resets), 0) AS volume_resets, coalesce(any_value(zero_delta_rows), 0) AS zero_delta_rows, coalesce(any_value(morning_rows), 0) AS morning_rows, coalesce(any_value(afternoon_rows), 0) AS afternoon_rows FROM ik LEFT JOIN good USING (symbol) GROUP BY ik.symbol""",
)
def quality(spark, sf):
    rows = event_ticks(spark, sf).withColumn("volume", F.when(F.col("seq") % 53 == 0, F.lit(-1)).otherwise(F.col("volume")))
    named = F.when(F.col("seq") % 61 == 0, F.lit("other")).otherwise(F.col("symbol"))
    return quality_stats(rows, SESSIONS, KEY, instrument=named)


@query("s15_csv_records", "SELECT doc_id, coalesce(lang, '') AS lang, coalesce(text, '') AS text, coalesce(source, '') AS source FROM documents WHERE doc_id IS NOT NULL")
def csv_records(spark, sf):
    place = _place(spark)
    docs = spark.read.parquet(f"{sf}/documents.parquet").filter("doc_id IS NOT NULL").select("doc_id", "lang", "text", "source")
    docs.write.option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(place)
    return records.csv_rows(spark, place, docs.columns).select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "text", "source")


_LIVE = "SELECT symbol, '{0}m' AS period, bar_time, trading_day, open, high, low, close, volume::DOUBLE AS volume, turnover::DOUBLE AS turnover, open_interest, tick_count, flags FROM {1}"


@query("st_live_archive", f"{BARS}, {_rolled(5, 'x')}, {_rolled(15, 'y')} {_LIVE.format(1, 'b')} UNION ALL {_LIVE.format(5, 'x')} UNION ALL {_LIVE.format(15, 'y')}")
def live_archive(spark, sf):
    """Ticks in four files, as they came, are replayed as a stream into an archive; a last file says that each symbol has ended."""
    place, t = _place(spark), event_ticks(spark, sf)
    kinds = {c: k for c, k in (part.split() for part in TICK.split(", "))}
    rows = t.select(*((F.col(c) if c in t.columns else F.lit(None)).cast(k).alias(c) for c, k in kinds.items()), F.lit(False).alias("flush"))
    last = t.agg(F.max("seq")).first()[0] + 1
    for k in range(4):
        rows.filter((F.col("seq") >= last * k // 4) & (F.col("seq") < last * (k + 1) // 4)).write.mode("append").parquet(f"{place}/ticks")
    ends = rows.groupBy("symbol").agg(F.max("time").alias("time"))
    ends.select(*((F.lit(last) if c == "seq" else F.col(c) if c in ("symbol", "time") else F.lit(None)).cast(k).alias(c) for c, k in kinds.items()), F.lit(True).alias("flush")).write.mode("append").parquet(f"{place}/ticks")
    sinks.replay(spark, f"{place}/ticks", f"{TICK}, flush BOOLEAN", SESSIONS, f"{place}/archive", "live", f"{place}/progress", files=64, delay="30 days")
    return store.read_archive(spark, f"{place}/archive", BAR).select(*COLUMNS)


# --- chart documents: written as JSON, read again and compared part by part ------------------------------------------------------
CHART = ["symbol", "day"]
_CLOCK = "strftime({0}, '%Y-%m-%d %H:%M:%S.') || lpad((epoch_us({0}) // 1000 % 1000)::VARCHAR, 3, '0')"
_TEN = "symbol, day, '{0}' AS part, {1} AS place, {2} AS a, {3} AS b, {4} AS c, {5} AS d, {6} AS s, {7} AS t"


def _line(part: str, place: str, *numbers: str, s: str = "NULL", t: str = "NULL") -> str:
    """SELECT of one part's rows: four numbers, rounded, and two texts."""
    four = [f"round(({n})::DOUBLE, 8)" for n in numbers] + ["NULL::DOUBLE"] * (4 - len(numbers))
    return "SELECT " + _TEN.format(part, f"({place})::BIGINT", *four, f"({s})::VARCHAR", f"({t})::VARCHAR")


_DAYS = f"""{EVENTS}, {_deltas()}, dy AS (SELECT * EXCLUDE (pv, pt, ptime), strftime(time, '%Y%m%d') AS day FROM d),
    bb AS (SELECT symbol, strftime(bar_time, '%Y%m%d') AS day, bar_time, open, close, low, high, volume, open_interest, tick_count, row_number() OVER (PARTITION BY symbol, strftime(bar_time, '%Y%m%d') ORDER BY bar_time) - 1 AS idx,
        hour(bar_time) * 60 + minute(bar_time) AS bm FROM (SELECT symbol, date_trunc('minute', arg_min(time, seq)) AS bar_time, arg_min(price, seq) AS open, max(price) AS high, min(price) AS low, arg_max(price, seq) AS close,
        sum(delta_volume)::BIGINT AS volume, coalesce(arg_max(open_interest, seq) FILTER (open_interest IS NOT NULL), 0.0) AS open_interest, count(*) AS tick_count FROM d GROUP BY symbol, date_trunc('minute', time))),
    dd AS (SELECT symbol, day, count(*) AS bars, min(low) AS lo, max(high) AS hi, coalesce(greatest(min(idx) FILTER (bm >= 810 AND bm < 900) - 0.5, 0.0), count(*) - 1)::DOUBLE AS start_x FROM bb GROUP BY symbol, day),
    zz AS (SELECT z.*, dd.day, dd.start_x FROM z JOIN dd USING (symbol)),
    lv AS (SELECT zz.*, th.role AS th_role, th.touch_time, ev.outcome, ev.mfe_ticks, ev.mae_ticks, th.touch_price FROM zz LEFT JOIN th ON th.symbol = zz.symbol AND th.zone_no = zz.zone_no AND strftime(th.touch_time, '%Y%m%d') = zz.day LEFT JOIN ev ON ev.symbol = th.symbol AND ev.zone_no = th.zone_no),
    tv AS (SELECT lv.*, bb.idx + (epoch_us(touch_time) % 60000000) / 6e7 AS x, row_number() OVER (PARTITION BY lv.symbol, lv.day ORDER BY touch_time, zone_no) - 1 AS place FROM lv JOIN bb ON bb.symbol = lv.symbol AND bb.bar_time = date_trunc('minute', touch_time)),
    br AS (SELECT *, date_diff('second', lag(bar_time) OVER w, bar_time) / 60.0 AS gap FROM bb WINDOW w AS (PARTITION BY symbol, day ORDER BY bar_time)),
    zx AS (SELECT symbol, min(lower) AS zl, max(upper) AS zh FROM z GROUP BY symbol)"""
_SESSION = "CASE WHEN bm >= 540 AND bm < 615 OR bm >= 630 AND bm < 690 THEN 'morning' WHEN bm >= 810 AND bm < 900 THEN 'afternoon' END"
_BAR_LINES = f"{_line('bars', 'idx', 'open', 'close', 'low', 'high', s='strftime(bar_time, $$%Y-%m-%d %H:%M$$)', t=_SESSION)} FROM bb UNION ALL {_line('more', 'idx', 'volume', 'open_interest', 'tick_count')} FROM bb"
_FULL = f"""{_DAYS}, rl AS (SELECT *, lag(price) OVER (PARTITION BY symbol, day ORDER BY seq) AS bp FROM dy),
    pt AS (SELECT rl.*, bb.idx + (epoch_us(time) % 60000000) / 6e7 AS x FROM rl JOIN bb ON bb.symbol = rl.symbol AND bb.bar_time = date_trunc('minute', time) WHERE bp IS NULL OR bp <> rl.price OR delta_volume > 0),
    pf AS (SELECT *, row_number() OVER (PARTITION BY symbol, day ORDER BY seq) - 1 AS place FROM pt),
    ov AS (SELECT DISTINCT symbol, day, unnest([min(seq), max(seq), arg_min(seq, row(price, seq)), arg_max(seq, row(price, -seq))]) AS seq FROM pt GROUP BY symbol, day, epoch_ms(time) // 3600000),
    po AS (SELECT pt.*, row_number() OVER (PARTITION BY pt.symbol, pt.day ORDER BY seq) - 1 AS place FROM pt JOIN ov USING (symbol, day, seq)),
    ph AS (SELECT symbol, day, round_even(price, 0)::INT AS bin, sum(delta_volume)::BIGINT AS volume FROM dy WHERE delta_volume > 0 GROUP BY ALL),
    sc AS (SELECT ph.*, s.sigma FROM ph, (VALUES ('0.0', 1), ('1.0', 2)) s(sigma, f)), pr AS (SELECT *, row_number() OVER (PARTITION BY symbol, day, sigma ORDER BY bin) - 1 AS place FROM sc)
    {_BAR_LINES}
    UNION ALL {_line("ticksFull", "place", "x", "price", "delta_volume", s=_CLOCK.format("time"))} FROM pf
    UNION ALL {_line("ticksOverview", "place", "x", "price", "delta_volume", s=_CLOCK.format("time"))} FROM po
    UNION ALL {_line("breaks", "row_number() OVER (PARTITION BY symbol, day ORDER BY idx) - 1", "idx - 0.5", "(gap - 1)::INT", s="CASE WHEN gap >= 60 THEN '午休' ELSE '休盘' END")} FROM br WHERE gap > 1.5
    UNION ALL {_line("levels", "zone_no - 1", "lower", "upper", "start_x", s="coalesce(th_role, 'neutral')", t="coalesce(outcome, 'no_touch')")} FROM lv
    UNION ALL {_line("events", "place", "x", "touch_price", "mfe_ticks", "mae_ticks", s="th_role", t="outcome")} FROM tv
    UNION ALL {_line("profiles", "place", "bin", "volume", s="'LTP'", t="sigma")} FROM pr
    UNION ALL {_line("extent", "0", "least(lo, zl) - greatest(2.0, (greatest(hi, zh) - least(lo, zl)) * 0.025)", "greatest(hi, zh) + greatest(2.0, (greatest(hi, zh) - least(lo, zl)) * 0.025)")} FROM dd JOIN zx USING (symbol)
    UNION ALL {_line("stats", "0", "ticks", "bars", "12", "(SELECT count(*) FROM tv WHERE tv.symbol = dd.symbol AND tv.day = dd.day)")} FROM dd JOIN (SELECT symbol, day, count(*) AS ticks FROM dy GROUP BY ALL) USING (symbol, day)"""
_SIMPLE = f"""{_DAYS}, pt AS (SELECT dy.*, bb.idx + (epoch_us(time) % 60000000) / 6e7 AS x, row_number() OVER (PARTITION BY dy.symbol, dy.day ORDER BY seq) - 1 AS place FROM dy JOIN bb ON bb.symbol = dy.symbol AND bb.bar_time = date_trunc('minute', time)),
    vw AS (SELECT *, sum(price * delta_volume) OVER w / sum(delta_volume) OVER w AS vwap, row_number() OVER w - 1 AS vplace FROM pt WHERE delta_volume > 0 WINDOW w AS (PARTITION BY symbol, day ORDER BY seq ROWS UNBOUNDED PRECEDING)),
    ph AS (SELECT symbol, day, floor(price + 0.5)::INT AS bin, sum(delta_volume)::BIGINT AS volume FROM dy WHERE delta_volume > 0 GROUP BY ALL),
    pr AS (SELECT *, volume / sum(volume) OVER (PARTITION BY symbol, day) AS share, row_number() OVER (PARTITION BY symbol, day ORDER BY bin) - 1 AS place FROM ph),
    px AS (SELECT symbol, day, min(bin) AS pl, max(bin) AS ph FROM pr GROUP BY ALL), ex AS (SELECT dd.symbol, dd.day, least(lo, zl, pl) AS l, greatest(hi, zh, ph) AS h FROM dd JOIN zx USING (symbol) LEFT JOIN px USING (symbol, day))
    {_BAR_LINES}
    UNION ALL {_line("ticks", "place", "x", "price", "delta_volume", s=_CLOCK.format("time"))} FROM pt
    UNION ALL {_line("vwap", "vplace", "x", "vwap")} FROM vw
    UNION ALL {_line("profile", "place", "bin", "volume", "share")} FROM pr
    UNION ALL {_line("zones", "lv.zone_no - 1", "lower", "upper", "x", s="coalesce(th_role, 'neutral')", t=_CLOCK.format("touch_time"))} FROM (SELECT lv.*, tv.x FROM lv LEFT JOIN tv USING (symbol, day, zone_no)) lv
    UNION ALL {_line("extent", "0", "l - greatest(2.0, (h - l) * 0.04)", "h + greatest(2.0, (h - l) * 0.04)")} FROM ex
    UNION ALL {_line("quality", "0", "ticks", "with_volume")} FROM dd JOIN (SELECT symbol, day, count(*) AS ticks, count_if(delta_volume > 0) AS with_volume FROM dy GROUP BY ALL) USING (symbol, day)"""


def _chart_frames(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    """Accepted ticks are written once; bars, zones and events are made from them."""
    place = _place(spark)
    _with_deltas(spark, sf).drop("user_id").write.parquet(place)
    rows = spark.read.parquet(place)
    one = bars.bars_1m(rows, SESSIONS)
    day = lambda df, time: df.withColumn("day", F.date_format(time, "yyyyMMdd"))
    own = day(one, "bar_time")
    zones = _zones(spark, sf)
    touched = events.first_touch(zones, rows, KEY)
    limits = events.thresholds(profile.minute_ranges(rows, 1.0, KEY).withColumn("range_ticks", F.col("range_ticks") + 40), CONFIG, KEY)
    each = zones.join(own.select("symbol", "day").distinct(), "symbol").withColumn("available", F.lit(""))
    return {"bars": own, "ticks": day(rows, "time"), "zones": each, "touched": day(touched, "touch_time"), "events": day(events.outcomes(touched, rows, limits, 1.0, KEY), "touch_time")}


def _flat(documents: DataFrame, parts: dict[str, tuple[str, list[str], list[str]]]) -> DataFrame:
    """A row an item of each part: part, place, four numbers and two texts. parts: array, numbers and texts, as expressions of the document and the item x."""
    out = None
    for name, (array, numbers, texts) in parts.items():
        cells = [F.round(F.expr(n).cast("double"), 8).alias(c) for n, c in zip([*numbers, *["NULL"] * (4 - len(numbers))], "abcd", strict=True)]
        cells += [F.expr(t).cast("string").alias(c) for t, c in zip([*texts, *["NULL"] * (2 - len(texts))], "st", strict=True)]
        one = documents.select(*CHART, "doc", F.posexplode(F.expr(array)).alias("place", "x")).select(*CHART, F.lit(name).alias("part"), F.col("place").cast("bigint").alias("place"), *cells)
        out = one if out is None else out.unionByName(one)
    return out


_BAR_PARTS = {"bars": ("doc.bars", ["x.open", "x.close", "x.low", "x.high"], ["x.time", "x.session"]), "more": ("doc.bars", ["x.volume", "x.openInterest", "x.ticks"], [])}
_EXTENT = ("array(doc)", ["x.priceMin", "x.priceMax"], [])


@query("v2_payload", _FULL)
def full_payload(spark, sf):
    f = _chart_frames(spark, sf)
    hist = profile.histograms(f["ticks"].withColumn("interval_vwap", F.col("price")), 1.0, CHART).filter("method = 'LTP'")
    scales = hist.withColumn("sigma", F.explode(F.array(F.lit(0.0), F.lit(1.0))))
    # written once: each part reads them, and would make them anew
    docs = runs.Stages(_place(spark))(charts.full_documents(f["bars"], f["ticks"], f["zones"], f["events"], scales, SESSIONS, 1.0, bucket_ms=3_600_000), "documents")
    profiles = "flatten(flatten(transform(map_entries(doc.profiles), m -> transform(map_entries(m.value), s -> transform(s.value, (v, i) -> struct(m.key AS method, s.key AS sigma, v[0] AS price, v[1] AS volume, i AS i))))))"
    rows = _flat(
        charts.read_document(docs, charts.FULL_SCHEMA),
        {
            **_BAR_PARTS,
            "ticksFull": ("doc.ticksFull", ["x.x", "x.price", "x.volume"], ["x.time"]),
            "ticksOverview": ("doc.ticksOverview", ["x.x", "x.price", "x.volume"], ["x.time"]),
            "breaks": ("doc.breaks", ["x.x", "x.minutes"], ["x.label"]),
            "levels": ("doc.levels", ["x.lower", "x.upper", "x.startX"], ["x.role", "x.outcome"]),
            "events": ("doc.events", ["x.x", "x.price", "x.mfe", "x.mae"], ["x.role", "x.outcome"]),
            "profiles": (profiles, ["x.price", "x.volume", "x.i"], ["x.method", "x.sigma"]),
            "extent": _EXTENT,
            "stats": ("array(doc.stats)", ["x.ticks", "x.bars", "x.levels", "x.events"], []),
        },
    )
    # a profile's place is its own, not that in all of them
    return rows.withColumn("place", F.when(F.col("part") == "profiles", F.col("c").cast("bigint")).otherwise(F.col("place"))).withColumn("c", F.when(F.col("part") != "profiles", F.col("c")))


@query("v3_payload", _SIMPLE)
def simple_payload(spark, sf):
    f = _chart_frames(spark, sf)
    quality = f["ticks"].groupBy(*CHART).agg(F.count("*").alias("ticks"), F.count_if(F.col("delta_volume") > 0).alias("with_volume"))
    docs = charts.simple_documents(f["bars"], f["ticks"], f["zones"], f["touched"], simple_profile(f["ticks"], 1.0, CHART), quality, SESSIONS, 1.0)
    return _flat(
        charts.read_document(docs, charts.SIMPLE_SCHEMA),
        {
            **_BAR_PARTS,
            "ticks": ("doc.ticks", ["x.x", "x.price", "x.volume"], ["x.time"]),
            "vwap": ("doc.vwap", ["x.x", "x.price"], []),
            "profile": ("doc.profile", ["x.price", "x.volume", "x.share"], []),
            "zones": ("doc.zones", ["x.lower", "x.upper", "x.firstTouchX"], ["x.role", "x.firstTouchTime"]),
            "extent": _EXTENT,
            "quality": ("array(doc.quality)", ["x['ticks']", "x['with_volume']"], []),
        },
    )


@query(
    "a10_run_counters",
    f"""{BARS}, v AS (SELECT CASE WHEN NOT coalesce(price > 0, false) THEN 'price' WHEN time < base THEN 'time' WHEN NOT {INS} THEN 'session' ELSE 'valid' END AS verdict FROM judged)
    SELECT (SELECT count(DISTINCT symbol) FROM judged) AS files, count(*) AS rows, count_if(verdict = 'valid')::BIGINT AS valid_rows, count_if(verdict = 'session')::BIGINT AS filtered_rows, count_if(verdict = 'price')::BIGINT AS bad_price_rows,
           count_if(verdict = 'time')::BIGINT AS backwards_rows, (SELECT count(*) FROM b) AS bars, (SELECT (count_if(coalesce(volume < pv, false)) + count_if(coalesce(turnover < pt, false)))::BIGINT FROM d) AS resets FROM v""",
)
def run_counters(spark, sf):
    """A conversion's report is written, and its totals are counted by that job."""
    place = _place(spark)
    rows = event_ticks(spark, sf).withColumns({"source_file": F.col("symbol"), "source_day": F.lit("")})
    names_ = ("rows", "valid_rows", "filtered_rows", "bad_price_rows", "backwards_rows", "bars", "resets")
    got = runs.observed(convert(rows, SESSIONS)[1], {"files": F.count("*"), **{n: F.sum(n) for n in names_}}, lambda df: store.write_report(df, place))
    return spark.createDataFrame([got], ", ".join(f"{n} bigint" for n in ("files", *names_))).select("files", *names_)


@query("k14_source_files", f"{BARS} SELECT symbol, bar_time, trading_day, round(open, 2) AS open, round(high, 2) AS high, round(low, 2) AS low, round(close, 2) AS close, volume::DOUBLE AS volume, open_interest, tick_count, flags FROM b")
def source_files(spark, sf):
    place = _place(spark)
    runs.write_source_files(_one(spark, sf), place, day="trading_day")
    named = files.metadata(spark, place).select("path", F.col("meta")["symbol"].alias("symbol"))
    return files.read_bars(spark, place).join(named, "path").select("symbol", "bar_time", "trading_day", "open", "high", "low", "close", "volume", "open_interest", "tick_count", "flags")


@query(
    "d4_review_table",
    """WITH o AS (SELECT year(o_orderdate)::VARCHAR AS trading_day, 'I' || (o_custkey % 7) AS instrument, (o_custkey % 50)::VARCHAR AS zone_id, o_orderkey AS k, CASE o_orderpriority[1] WHEN '1' THEN 'A' WHEN '2' THEN 'B' ELSE 'C' END AS grade FROM orders),
    a AS (SELECT trading_day, instrument, zone_id, k AS created, grade FROM o WHERE k % 2 = 0 QUALIFY row_number() OVER (PARTITION BY trading_day, instrument, zone_id ORDER BY k DESC) = 1),
    b AS (SELECT trading_day, instrument, zone_id, k AS created, grade FROM o WHERE k % 2 = 1 QUALIFY row_number() OVER (PARTITION BY trading_day, instrument, zone_id ORDER BY k DESC) = 1)
    SELECT trading_day, instrument, zone_id, coalesce(b.grade, a.grade) AS grade, coalesce(a.created, b.created)::BIGINT AS created FROM a FULL JOIN b USING (trading_day, instrument, zone_id) WHERE trading_day <> '1995' AND instrument <> 'I3'""",
)
def review_table(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet")
    at = F.timestamp_seconds(F.col("o_orderkey")).cast("timestamp_ntz")
    own = {"trading_day": F.year("o_orderdate").cast("string"), "instrument": F.concat(F.lit("I"), F.col("o_custkey") % 7), "zone_id": (F.col("o_custkey") % 50).cast("string"), "grade": F.when(F.col("o_orderpriority").startswith("1"), "A").when(F.col("o_orderpriority").startswith("2"), "B").otherwise("C"), "created_at": at, "updated_at": at}
    rows = o.select("o_orderkey", *((own[c] if c in own else F.lit("" if k == "STRING" else 0).cast(k)).alias(c) for c, k in (p.split() for p in tables.REVIEW.split(", "))))
    table = tables.Reviews(spark, _place(spark))
    table.put(rows.filter("o_orderkey % 2 = 0"))
    table.put(rows.filter("o_orderkey % 2 = 1"))
    table.drop(table.all().filter("trading_day = '1995' OR instrument = 'I3'"))
    return table.all().select("trading_day", "instrument", "zone_id", "grade", F.unix_seconds(F.col("created_at").cast("timestamp")).alias("created"))


@query("k8_canonical_archive", f"{ARCHIVE} SELECT symbol, bar_time, coalesce(lw.close, ex.close) AS close, 'end' AS source_time FROM ex FULL JOIN lw USING (symbol, bar_time)")
def canonical_archive(spark, sf):
    place = _place(spark)
    old, batch = _archive(spark, sf)
    about = {"zone": "Asia/Shanghai", "schema": "v1", "source": "made", "source_time": "end", "calendar": "weekdays"}
    day = F.date_format("bar_time", "yyyyMMdd").cast("int").alias("trading_day")
    for part in (old.withColumn("seq", F.lit(0)), batch, batch):
        rows = part.select("symbol", F.lit("1m").alias("period"), "bar_time", day, "close", "volume", F.lit(1).alias("flags"), "seq")
        tables.write_canonical(raw.bar_of(rows, keep=["seq"]), place, **about)
    back = tables.read_canonical(spark, place)
    return back.select("symbol", "bar_time", "close", F.regexp_extract("metadata", "source_time=([^ ]+)", 1).alias("source_time"))
