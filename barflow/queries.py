"""Queries over the test tables, each with its DuckDB twin where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import scalars as M
from .functions import times as T
from .operators import bars, charts, dml, events, levels, profile, selection, series, ticks
from .plans.calendar import NIGHT_0230, NIGHT_2300, STOCK_INDEX, RowSessions, Sessions, day_map, minute_dimension
from .plans.config import Limits, ProfileConfig
from .sources import runs
from .sources.events import event_ticks, line_tape

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
SESSIONS = Sessions.parse(NIGHT_2300)
LIMITS = Limits(volume=1000, nonzero_updates=20, coverage=0.2, bins=8)
CONFIG = ProfileConfig(max_gap_ms=3_600_000, match_ticks=6, peak_share=0.001, min_valley_depth=0.05)
KEY = ["symbol"]


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return add


# --- DuckDB text of the shared steps -------------------------------------------------------------------------------------------
MIN = "(hour(time) * 60 + minute(time))"
INS = "(m >= 1260 AND m < 1380 OR m >= 540 AND m < 615 OR m >= 630 AND m < 690 OR m >= 810 AND m < 900)"
LAST = "m IN (1379, 614, 689, 899)"
MORNING = "(m >= 540 AND m < 615 OR m >= 630 AND m < 690)"
TRADING = "strftime(CASE WHEN m >= 1260 THEN time::DATE + (CASE isodow(time) WHEN 5 THEN 3 WHEN 6 THEN 2 ELSE 1 END)::INT ELSE time::DATE END, '%Y%m%d')::INT"


def _ticks(dirty: bool = True) -> str:
    price = "CASE WHEN seq % 97 = 0 THEN 0.0 ELSE price END" if dirty else "price"
    time = "CASE WHEN seq % 41 = 0 THEN time - INTERVAL 10 MINUTE ELSE time END" if dirty else "time"
    return f"""t0 AS (
        SELECT event_type AS symbol, event_id AS seq, ts AS time, value AS price, CAST(json_extract_string(props, '$.k') AS BIGINT) AS qty,
               CASE WHEN user_id % 3 <> 0 THEN user_id::DOUBLE END AS open_interest, user_id FROM events
    ), t1 AS (
        SELECT *, (sum(qty) OVER w)::BIGINT AS volume, (sum(qty * round(price * 100)::BIGINT) OVER w)::BIGINT AS turnover
        FROM t0 WINDOW w AS (PARTITION BY symbol, time::DATE ORDER BY seq)
    ), t2 AS (SELECT * REPLACE ({price} AS price, {time} AS time) FROM t1),
    ticks AS (SELECT *, {MIN} AS m FROM t2)"""


def _raw() -> str:
    return f"""{_ticks()}, judged AS (
        SELECT *, max(CASE WHEN price > 0 AND {INS} THEN time END) OVER (PARTITION BY symbol ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS base FROM ticks
    ), valid AS (SELECT * FROM judged WHERE price > 0 AND {INS} AND (base IS NULL OR time >= base))"""


def _deltas(keys: str = "symbol") -> str:
    return f"""prev AS (
        SELECT *, lag(volume) OVER w AS pv, lag(turnover) OVER w AS pt, lag(time) OVER w AS ptime FROM valid WINDOW w AS (PARTITION BY {keys} ORDER BY seq)
    ), d AS (
        SELECT *, CASE WHEN pv IS NULL THEN 0 ELSE greatest(volume - pv, 0) END AS delta_volume, CASE WHEN pt IS NULL THEN 0 ELSE greatest(turnover - pt, 0) END AS delta_turnover,
               coalesce((epoch_us(time) - epoch_us(ptime)) // 1000, 0) AS gap_millis FROM prev
    )"""


def _bars(night: str = "m >= 1260") -> str:
    return f"""b AS (
        SELECT symbol, date_trunc('minute', arg_min(time, seq)) AS bar_time, arg_min({TRADING}, seq) AS trading_day, arg_min(price, seq) AS open, max(price) AS high,
               min(price) AS low, arg_max(price, seq) AS close, sum(delta_volume)::BIGINT AS volume, sum(delta_turnover)::BIGINT AS turnover,
               coalesce(arg_max(open_interest, seq) FILTER (open_interest IS NOT NULL), 0.0) AS open_interest, 0.0::DOUBLE AS settlement, count(*)::INT AS tick_count,
               (1 + CASE WHEN arg_min({night}, seq) THEN 4 ELSE 0 END)::INT AS flags
        FROM d GROUP BY symbol, date_trunc('minute', time)
    )"""


def _rolled(n: int, name: str = "r") -> str:
    return f"""{name}1 AS (SELECT *, (hour(bar_time) * 60 + minute(bar_time)) AS m, (hour(bar_time) * 60 + minute(bar_time)) // {n} AS slot FROM b),
    {name}2 AS (SELECT *, CASE WHEN lag(slot) OVER w IS NULL OR lag(slot) OVER w <> slot OR lag({LAST}) OVER w THEN 1 ELSE 0 END AS brk FROM {name}1 WINDOW w AS (PARTITION BY symbol ORDER BY bar_time)),
    {name}3 AS (SELECT *, sum(brk) OVER (PARTITION BY symbol ORDER BY bar_time) AS g FROM {name}2),
    {name} AS (
        SELECT symbol, min(bar_time) AS bar_time, arg_min(trading_day, bar_time) AS trading_day, arg_min(open, bar_time) AS open, max(high) AS high, min(low) AS low,
               arg_max(close, bar_time) AS close, sum(volume)::BIGINT AS volume, sum(turnover)::BIGINT AS turnover, arg_max(open_interest, bar_time) AS open_interest,
               0.0::DOUBLE AS settlement, sum(tick_count)::INT AS tick_count, 1 AS flags FROM {name}3 GROUP BY symbol, g
    )"""


BASE = f"WITH {_raw()}"
DELTAS = f"{BASE}, {_deltas()}"
BARS = f"{DELTAS}, {_bars()}"


def _valid(spark: SparkSession, sf: str) -> DataFrame:
    return ticks.valid_ticks(event_ticks(spark, sf), SESSIONS)


def _with_deltas(spark: SparkSession, sf: str, **o) -> DataFrame:
    return ticks.deltas(_valid(spark, sf), **o)


def _one(spark: SparkSession, sf: str) -> DataFrame:
    return bars.bars_1m(_with_deltas(spark, sf), SESSIONS)


# --- filters, times, windows ---------------------------------------------------------------------------------------------------
@query("f1_f2_f3_valid_ticks", f"{BASE} SELECT symbol, seq, time, price, volume FROM valid")
def valid(spark, sf):
    return _valid(spark, sf).select("symbol", "seq", "time", "price", "volume")


@query(
    "f_counters_by_order",
    f"""{BASE}, v AS (
        SELECT symbol, CASE WHEN NOT price > 0 THEN 'price' WHEN time < base THEN 'time' WHEN NOT {INS} THEN 'session' ELSE 'valid' END AS a,
               CASE WHEN NOT {INS} THEN 'session' WHEN NOT price > 0 THEN 'price' WHEN time < base THEN 'time' ELSE 'valid' END AS b FROM judged
    ), o AS (SELECT symbol, 'price,time,session' AS ord, a AS v FROM v UNION ALL SELECT symbol, 'session,price,time', b FROM v)
    SELECT symbol, ord, count(*) AS rows, count_if(v = 'valid')::BIGINT AS valid_rows, count_if(v = 'session')::BIGINT AS filtered_rows, count_if(v = 'price')::BIGINT AS bad_price_rows,
           count_if(v = 'time')::BIGINT AS backwards_rows FROM o GROUP BY symbol, ord""",
)
def counters(spark, sf):
    t, out = event_ticks(spark, sf), None
    for order in (("price", "time", "session"), ("session", "price", "time")):
        one = ticks.verdict_counts(ticks.with_verdict(t, SESSIONS, order=order)).withColumn("ord", F.lit(",".join(order)))
        out = one if out is None else out.unionByName(one)
    return out


@query(
    "t6_next_trading_day",
    """SELECT DISTINCT o_orderdate::DATE::VARCHAR AS day, strftime(o_orderdate::DATE + (CASE isodow(o_orderdate) WHEN 5 THEN 3 WHEN 6 THEN 2 ELSE 1 END)::INT, '%Y%m%d')::INT AS next_day,
    strftime(o_orderdate::DATE + (CASE isodow(o_orderdate) WHEN 6 THEN 2 WHEN 7 THEN 1 ELSE 0 END)::INT, '%Y%m%d')::INT AS weekday FROM orders""",
)
def next_day(spark, sf):
    d = spark.read.parquet(f"{sf}/orders.parquet").select(F.col("o_orderdate").cast("date").alias("day")).distinct()
    return d.select(F.col("day").cast("string").alias("day"), T.day_number(T.next_trading_day(F.col("day"))).alias("next_day"), T.day_number(T.weekday_from(F.col("day"))).alias("weekday"))


@query("t7_trading_day", f"{BASE} SELECT seq, {TRADING} AS trading_day, m AS minute FROM ticks")
def trading_day(spark, sf):
    t = event_ticks(spark, sf)
    return t.select("seq", T.trading_day(F.col("time"), SESSIONS.night_start).alias("trading_day"), T.minute_of_day(F.col("time")).alias("minute"))


@query(
    "t9_calendar_day",
    """WITH c AS (SELECT DISTINCT o_orderdate::DATE AS d FROM orders WHERE isodow(o_orderdate) < 6 AND day(o_orderdate) % 7 <> 0),
    e AS (SELECT min(o_orderdate)::DATE AS first, max(o_orderdate)::DATE + 7 AS last FROM orders), g AS (SELECT unnest(generate_series(first, last, INTERVAL 1 DAY))::DATE AS date FROM e)
    SELECT g.date::VARCHAR AS date, a.d::VARCHAR AS day_session, b.d::VARCHAR AS night_session FROM g ASOF LEFT JOIN c a ON g.date <= a.d ASOF LEFT JOIN c b ON g.date < b.d""",
)
def calendar_day(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet").select(F.col("o_orderdate").cast("date").alias("trade_date"))
    dates = o.filter((F.weekday("trade_date") < 5) & (F.dayofmonth("trade_date") % 7 != 0)).distinct()
    # each day from the first order to a week after the last, where no trade date follows
    first, last = o.agg(F.min("trade_date"), F.date_add(F.max("trade_date"), 7)).first()
    return day_map(dates, str(first), str(last)).select(*(F.col(c).cast("string").alias(c) for c in ("date", "day_session", "night_session")))


@query(
    "t12_last_minute",
    f"""{BASE}, x AS (SELECT *, seq % 2 = 0 AS even FROM ticks)
    SELECT seq, m AS minute, CASE WHEN even THEN 'night' ELSE 'late' END AS root, CASE WHEN even THEN {INS} ELSE m >= 1260 OR m < 150 OR m >= 540 AND m < 615 END AS in_session,
           CASE WHEN even THEN {LAST} ELSE m IN (149, 614) END AS is_last FROM x""",
)
def last_minute(spark, sf):
    t = event_ticks(spark, sf).select("seq", T.minute_of_day(F.col("time")).alias("minute"), F.when(F.col("seq") % 2 == 0, "night").otherwise("late").alias("root"))
    return t.join(minute_dimension(spark, {"night": SESSIONS, "late": Sessions.parse("21:00-02:30,09:00-10:15")}), ["root", "minute"])


# contracts of three kinds: one with a night session, one without, one whose night goes past midnight
KINDS = RowSessions.by("kind", {"night": SESSIONS, "index": Sessions.parse(STOCK_INDEX), "late": Sessions.parse(NIGHT_0230)})
_BY_KIND = "CASE kind WHEN 'night' THEN {0} WHEN 'index' THEN {1} ELSE {2} END"
_DAY_INS = "m >= 540 AND m < 615 OR m >= 630 AND m < 690 OR m >= 810 AND m < 900"
KIND_INS = _BY_KIND.format(INS, "(m >= 570 AND m < 690 OR m >= 780 AND m < 900)", f"(m >= 1260 OR m < 150 OR {_DAY_INS})")
KIND_LAST = _BY_KIND.format(LAST, "m IN (689, 899)", "m IN (149, 614, 689, 899)")
_KIND_OF = "CASE user_id % 3 WHEN 0 THEN 'night' WHEN 1 THEN 'index' ELSE 'late' END"
MIXED = f"""WITH {_ticks()},
    ct AS (SELECT * REPLACE (symbol || '_' || (user_id % 3) AS symbol), {_KIND_OF} AS kind FROM ticks),
    judged AS (SELECT *, max(CASE WHEN price > 0 AND {KIND_INS} THEN time END) OVER (PARTITION BY symbol ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS base FROM ct),
    valid AS (SELECT * FROM judged WHERE price > 0 AND {KIND_INS} AND (base IS NULL OR time >= base)), {_deltas()},
    b AS (SELECT symbol, any_value(kind) AS kind, date_trunc('minute', arg_min(time, seq)) AS bar_time, arg_min(CASE WHEN kind = 'index' THEN strftime(time::DATE, '%Y%m%d')::INT ELSE {TRADING} END, seq) AS trading_day,
        arg_min(price, seq) AS open, max(price) AS high, min(price) AS low, arg_max(price, seq) AS close, sum(delta_volume)::BIGINT AS volume, sum(delta_turnover)::BIGINT AS turnover,
        coalesce(arg_max(open_interest, seq) FILTER (open_interest IS NOT NULL), 0.0) AS open_interest, 0.0::DOUBLE AS settlement, count(*)::INT AS tick_count,
        (1 + CASE WHEN arg_min(m >= 1260 AND kind <> 'index', seq) THEN 4 ELSE 0 END)::INT AS flags FROM d GROUP BY symbol, date_trunc('minute', time)),
    {_rolled(15).replace(LAST, KIND_LAST).replace("SELECT symbol, min(bar_time)", "SELECT symbol, any_value(kind) AS kind, min(bar_time)")}"""


@query("j8_mixed_sessions", f"{MIXED} SELECT *, '1m' AS period FROM b UNION ALL SELECT *, '15m' FROM r")
def mixed_sessions(spark, sf):
    t = event_ticks(spark, sf).withColumn("symbol", F.concat_ws("_", "symbol", (F.col("user_id") % 3).cast("string")))
    t = t.withColumn("kind", F.element_at(F.array(*map(F.lit, ("night", "index", "late"))), (F.col("user_id") % 3 + 1).cast("int")))
    return bars.all_periods(t, KINDS, (15,))


@query("x2_zone", f"{BASE} SELECT seq, CASE user_id % 2 WHEN 0 THEN time + INTERVAL 8 HOUR ELSE time END AS local_time FROM ticks")
def zone(spark, sf):
    own = RowSessions.by("kind", {"a": SESSIONS}, zones={"utc": "UTC"})
    t = event_ticks(spark, sf).withColumn("kind", F.when(F.col("user_id") % 2 == 0, "a").otherwise("utc"))
    return t.select("seq", own.local(F.col("time")).alias("local_time"))


@query("w1_delta_volume", f"{BASE}, {_deltas()} SELECT symbol, seq, delta_volume::BIGINT AS delta_volume, delta_turnover::BIGINT AS delta_turnover FROM d")
def delta_volume(spark, sf):
    return _with_deltas(spark, sf).select("symbol", "seq", "delta_volume", "delta_turnover")


@query(
    "w3_gap_flags",
    f"""{DELTAS} SELECT symbol, seq, gap_millis, concat_ws('|', CASE WHEN volume < pv THEN 'VOLUME_RESET' END, CASE WHEN turnover < pt THEN 'TURNOVER_RESET' END,
    CASE WHEN gap_millis > 3600000 THEN 'LONG_GAP' END) AS quality_flags FROM d""",
)
def gap_flags(spark, sf):
    return _with_deltas(spark, sf, max_gap_ms=3_600_000).select("symbol", "seq", "gap_millis", F.array_join("quality_flags", "|").alias("quality_flags"))


@query(
    "w5_session_vwap",
    f"""{DELTAS} SELECT symbol, seq, round(sum(price * delta_volume) OVER w / sum(delta_volume) OVER w, 6) AS vwap FROM d WHERE delta_volume > 0
    WINDOW w AS (PARTITION BY symbol, time::DATE ORDER BY seq ROWS UNBOUNDED PRECEDING)""",
)
def session_vwap(spark, sf):
    rows = _with_deltas(spark, sf).withColumn("day", F.col("time").cast("date"))
    return ticks.session_vwap(rows, ["symbol", "day"]).select("symbol", "seq", F.round("vwap", 6).alias("vwap"))


@query(
    "f12_relevant_ticks",
    f"""{DELTAS}, x AS (SELECT *, lag(price) OVER (PARTITION BY symbol ORDER BY seq) AS bp FROM d) SELECT symbol, seq FROM x WHERE bp IS NULL OR bp <> price OR delta_volume > 0""",
)
def relevant(spark, sf):
    return ticks.relevant_ticks(_with_deltas(spark, sf), KEY).select("symbol", "seq")


# --- bars ----------------------------------------------------------------------------------------------------------------------
@query("b1_bars_1m", f"{BARS} SELECT * FROM b")
def bars_1m(spark, sf):
    return _one(spark, sf)


@query("b3_bars_night_flag", f"{DELTAS}, {_bars('(m >= 1080 OR m < 180)')} SELECT symbol, bar_time, flags FROM b")
def bars_clock(spark, sf):
    return bars.bars_1m(_with_deltas(spark, sf), SESSIONS, night_rule="clock").select("symbol", "bar_time", "flags")


@query(
    "b4_consecutive_bars",
    f"""{DELTAS}, x AS (SELECT *, date_trunc('minute', time) AS mt FROM d), y AS (SELECT *, CASE WHEN lag(mt) OVER w IS NULL OR lag(mt) OVER w <> mt THEN 1 ELSE 0 END AS n FROM x WINDOW w AS (PARTITION BY symbol ORDER BY seq)),
    z AS (SELECT *, sum(n) OVER (PARTITION BY symbol ORDER BY seq) AS g FROM y)
    SELECT symbol, g::BIGINT AS bar_no, arg_min(mt, seq) AS bar_time, arg_min(price, seq) AS open, max(price) AS high, min(price) AS low, arg_max(price, seq) AS close, sum(delta_volume)::BIGINT AS volume, count(*) AS tick_count FROM z GROUP BY symbol, g""",
)
def consecutive(spark, sf):
    return bars.consecutive_bars(_with_deltas(spark, sf), KEY)


def _rollup_query(n: int) -> None:
    @query(f"b6_rollup_{n}m", f"{BARS}, {_rolled(n)} SELECT * FROM r")
    def rolled(spark, sf):
        return bars.roll_up(_one(spark, sf), n, SESSIONS)


for _n in (15, 60, 240):
    _rollup_query(_n)


@query("b7_all_periods", f"{BARS}, {_rolled(5, 'x')}, {_rolled(15, 'y')} SELECT *, '1m' AS period FROM b UNION ALL SELECT *, '5m' FROM x UNION ALL SELECT *, '15m' FROM y")
def all_periods(spark, sf):
    return bars.all_periods(event_ticks(spark, sf), SESSIONS)


@query("b8_daily_bars", f"{BARS} SELECT symbol, trading_day, min(bar_time) AS bar_time, arg_min(open, bar_time) AS open, max(high) AS high, min(low) AS low, arg_max(close, bar_time) AS close, sum(volume)::BIGINT AS volume, sum(tick_count)::BIGINT AS tick_count FROM b GROUP BY symbol, trading_day")
def daily(spark, sf):
    return bars.daily_bars(_one(spark, sf))


@query(
    "b8_lineitem_daily_bars",
    """WITH l AS (SELECT l_returnflag AS symbol, l_shipdate::DATE AS date, l_extendedprice AS price, l_quantity AS qty, row(l_shipdate, l_orderkey, l_linenumber, l_extendedprice, l_quantity) AS o FROM lineitem)
    SELECT symbol, date::VARCHAR AS date, arg_min(price, o) AS open, max(price) AS high, min(price) AS low, arg_max(price, o) AS close, sum(qty) AS volume, count(*) AS tick_count FROM l GROUP BY symbol, l.date""",
)
def line_bars(spark, sf):
    return line_tape(spark, sf).groupBy("symbol", F.col("date").cast("string").alias("date")).agg(F.min_by("price", "ord").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "ord").alias("close"), F.sum("qty").alias("volume"), F.count("*").alias("tick_count"))


# --- series --------------------------------------------------------------------------------------------------------------------
@query("w10_at", f"{BARS}, x AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY bar_time) AS i, row_number() OVER (PARTITION BY symbol ORDER BY bar_time DESC) AS j FROM b) SELECT symbol, '3' AS at, bar_time, close FROM x WHERE i = 3 UNION ALL SELECT symbol, '-2', bar_time, close FROM x WHERE j = 2")
def at(spark, sf):
    b = _one(spark, sf)
    one = lambda i: series.at(b, i, KEY).select("symbol", F.lit(str(i)).alias("at"), "bar_time", "close")
    return one(3).unionByName(one(-2)).unionByName(one(0))


@query("w11_last", f"{BARS} SELECT symbol, max(bar_time) AS bar_time, arg_max(close, bar_time) AS close FROM b GROUP BY symbol")
def last_bar(spark, sf):
    return series.last(_one(spark, sf), KEY).select("symbol", "bar_time", "close")


@query("w12_count", f"{BARS} SELECT symbol, count(*) AS n FROM b GROUP BY symbol")
def count(spark, sf):
    return series.counts(_one(spark, sf), KEY)


@query("w13_find", f"{BARS}, q AS (SELECT symbol, arg_min(bar_time, row(tick_count * -1, bar_time)) AS t FROM b GROUP BY symbol) SELECT b.symbol, (count_if(bar_time < t) + 1)::BIGINT AS index FROM b JOIN q USING (symbol) GROUP BY b.symbol")
def find(spark, sf):
    b = _one(spark, sf)
    when = b.groupBy("symbol").agg(F.min_by("bar_time", F.struct(-F.col("tick_count"), "bar_time")).alias("__t"))
    return series.find(b.join(F.broadcast(when), "symbol"), F.col("__t"), KEY)


@query("w14_slice", f"{BARS} SELECT symbol, (count_if(bar_time < TIMESTAMP '2024-01-08 09:30:00') + 1)::BIGINT AS start_index, count_if(bar_time >= TIMESTAMP '2024-01-08 09:30:00' AND bar_time < TIMESTAMP '2024-01-12 14:00:00')::BIGINT AS n FROM b GROUP BY symbol")
def slice_of(spark, sf):
    t = lambda x: F.lit(x).cast("timestamp_ntz")
    return series.slice_of(_one(spark, sf), t("2024-01-08 09:30:00"), t("2024-01-12 14:00:00"), KEY)


# --- keyed tables --------------------------------------------------------------------------------------------------------------
def _archive(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """An archive of two thirds of the bars, and a batch of half of them, some changed and some twice."""
    b = _one(spark, sf).select("symbol", "bar_time", "close", "volume").withColumn("m", T.epoch_minute(F.col("bar_time")))
    existing = b.filter("m % 3 <> 0").drop("m")
    batch = b.filter("m % 2 = 0").withColumn("close", F.when(F.col("m") % 10 == 0, F.col("close") + 1).otherwise(F.col("close"))).withColumn("seq", F.lit(1))
    again = batch.filter("m % 8 = 0").withColumn("close", F.col("close") + 2).withColumn("seq", F.lit(2))
    return existing, batch.unionByName(again).drop("m")


ARCHIVE = f"""{BARS}, bm AS (SELECT symbol, bar_time, close, volume, epoch(bar_time)::BIGINT // 60 AS m FROM b), ex AS (SELECT * FROM bm WHERE m % 3 <> 0),
    ba AS (SELECT * REPLACE (CASE WHEN m % 10 = 0 THEN close + 1 ELSE close END AS close) FROM bm WHERE m % 2 = 0), inc AS (SELECT *, 1 AS seq FROM ba UNION ALL SELECT * REPLACE (close + 2 AS close), 2 AS seq FROM ba WHERE m % 8 = 0),
    lw AS (SELECT * FROM inc QUALIFY row_number() OVER (PARTITION BY symbol, bar_time ORDER BY seq DESC) = 1)"""


@query("u5_last_wins", f"{ARCHIVE} SELECT symbol, bar_time, close, volume, seq FROM lw")
def last_wins(spark, sf):
    return dml.last_wins(_archive(spark, sf)[1], ["symbol", "bar_time"])


@query("k3_upsert_changed", f"{ARCHIVE} SELECT lw.symbol, lw.bar_time, CASE WHEN ex.symbol IS NULL THEN 'new' WHEN ex.close <> lw.close OR ex.volume <> lw.volume THEN 'changed' ELSE 'unchanged' END AS change FROM lw LEFT JOIN ex USING (symbol, bar_time)")
def upsert_changed(spark, sf):
    return dml.changes(*_archive(spark, sf), ["symbol", "bar_time"], ["close", "volume"])


@query("k3_upsert", f"{ARCHIVE} SELECT symbol, bar_time, coalesce(lw.close, ex.close) AS close, coalesce(lw.volume, ex.volume) AS volume FROM ex FULL JOIN lw USING (symbol, bar_time)")
def upsert(spark, sf):
    return dml.upsert(*_archive(spark, sf), ["symbol", "bar_time"])


@query(
    "d1_review_upsert",
    """WITH o AS (SELECT o_orderdate::DATE AS day, o_custkey % 50 AS zone, o_orderkey AS k, o_orderpriority AS grade FROM orders),
    a AS (SELECT day, zone, k AS created, grade FROM o WHERE k % 2 = 0 QUALIFY row_number() OVER (PARTITION BY day, zone ORDER BY k DESC) = 1),
    b AS (SELECT day, zone, k AS created, grade FROM o WHERE k % 2 = 1 QUALIFY row_number() OVER (PARTITION BY day, zone ORDER BY k DESC) = 1)
    SELECT day::VARCHAR AS day, zone, coalesce(a.created, b.created) AS created, coalesce(b.grade, a.grade) AS grade FROM a FULL JOIN b USING (day, zone)""",
)
def review_upsert(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet").select(F.col("o_orderdate").cast("date").alias("day"), (F.col("o_custkey") % 50).alias("zone"), F.col("o_orderkey").alias("created"), F.col("o_orderpriority").alias("grade"))
    old = dml.last_wins(o.filter("created % 2 = 0"), ["day", "zone"], "created")
    return dml.upsert(old, o.filter("created % 2 = 1").withColumn("seq", F.col("created")), ["day", "zone"], keep_old=["created"]).withColumn("day", F.col("day").cast("string"))


@query("d2_review_delete", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 4 = 0)")
def review_delete(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", "o_custkey")
    gone = spark.read.parquet(f"{sf}/customer.parquet").filter("c_custkey % 4 = 0").select(F.col("c_custkey").alias("o_custkey"))
    return dml.delete(o, gone, ["o_custkey"])


@query("s6_order_audit", f"{BASE}, x AS (SELECT *, lag(time) OVER (PARTITION BY symbol ORDER BY seq) AS b FROM ticks) SELECT symbol, count(*) > count(DISTINCT time) AS duplicates, coalesce(bool_or(b > time), false) AS disordered FROM x GROUP BY symbol")
def order_audit(spark, sf):
    return dml.order_audit(event_ticks(spark, sf), KEY, "time")


@query("a15_review_counts", "SELECT o_orderdate::DATE::VARCHAR AS day, count(*) AS reviews, count(DISTINCT o_custkey % 50) AS instruments FROM orders GROUP BY 1")
def review_counts(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet")
    return o.groupBy(F.col("o_orderdate").cast("date").cast("string").alias("day")).agg(F.count("*").alias("reviews"), F.count_distinct(F.col("o_custkey") % 50).alias("instruments"))


# --- selection -----------------------------------------------------------------------------------------------------------------
def _contracts(spark: SparkSession, sf: str) -> DataFrame:
    keys = ["root", "source_file"]
    rows = event_ticks(spark, sf).withColumn("root", F.col("symbol")).withColumn("source_file", F.concat_ws("_", "symbol", (F.col("user_id") % 4).cast("string")))
    judged = ticks.with_verdict(rows, SESSIONS, order=("session", "price", "time"), keys=keys)
    good = ticks.deltas(judged.filter("verdict = 'valid'").drop("verdict"), keys=keys)
    morning = SESSIONS.label(T.minute_of_day(F.col("time"))) == "morning"
    return selection.with_counters(selection.contract_stats(good, 0.05, 135, keys, morning=F.coalesce(morning, F.lit(False))), judged, keys)


CONTRACTS = f"""{BASE}, p AS (SELECT * EXCLUDE (base), symbol AS root, symbol || '_' || (user_id % 4) AS source_file FROM judged),
    jd AS (SELECT *, max(CASE WHEN price > 0 AND {INS} THEN time END) OVER (PARTITION BY root, source_file ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS base FROM p),
    vd AS (SELECT *, CASE WHEN NOT {INS} THEN 'session' WHEN NOT coalesce(price > 0, false) THEN 'price' WHEN time < base THEN 'time' ELSE 'valid' END AS verdict FROM jd),
    q AS (SELECT *, lag(volume) OVER w AS pv, lag(turnover) OVER w AS pt FROM vd WHERE verdict = 'valid' WINDOW w AS (PARTITION BY root, source_file ORDER BY seq)),
    s AS (SELECT *, CASE WHEN pv IS NULL THEN 0 ELSE greatest(volume - pv, 0) END AS dv, {MORNING} AS early FROM q),
    st AS (SELECT root, source_file, coalesce(sum(dv) FILTER (early), 0)::DOUBLE AS total_volume, count_if(early AND dv > 0)::BIGINT AS nonzero_updates,
        count(DISTINCT CASE WHEN early AND dv > 0 THEN date_trunc('minute', time) END) AS active_minutes, count(DISTINCT CASE WHEN early AND dv > 0 THEN round_even(price / 0.05, 0) END) AS price_bins,
        count(*) AS valid_rows, count_if(coalesce(volume < pv OR turnover < pt, false))::BIGINT AS resets, count_if(abs(price / 0.05 - round_even(price / 0.05, 0)) > 1e-6)::BIGINT AS misaligned_rows FROM s GROUP BY root, source_file),
    rejected AS (SELECT root, source_file, count_if(verdict IN ('session', 'price'))::BIGINT AS filtered_rows, count_if(verdict = 'time')::BIGINT AS backwards_rows FROM vd GROUP BY root, source_file),
    stats AS (SELECT root, source_file, filtered_rows, backwards_rows, coalesce(total_volume, 0) AS total_volume, coalesce(nonzero_updates, 0) AS nonzero_updates, coalesce(active_minutes, 0) AS active_minutes,
        coalesce(price_bins, 0) AS price_bins, coalesce(valid_rows, 0) AS valid_rows, coalesce(resets, 0) AS resets, coalesce(misaligned_rows, 0) AS misaligned_rows, coalesce(round(active_minutes / 135.0, 10), 0.0) AS coverage
        FROM rejected LEFT JOIN st USING (root, source_file))"""


@query("a1_contract_stats", f"{CONTRACTS} SELECT * FROM stats")
def contract_stats(spark, sf):
    return _contracts(spark, sf)


REASONS = "concat_ws('|', CASE WHEN total_volume < 1000 THEN 'volume' END, CASE WHEN nonzero_updates < 20 THEN 'nonzero_updates' END, CASE WHEN coverage < 0.2 THEN 'active_minute_coverage' END, CASE WHEN price_bins < 8 THEN 'price_bins' END, CASE WHEN backwards_rows > 0 THEN 'backwards_ticks' END, CASE WHEN misaligned_rows > 0 THEN 'tick_alignment' END)"


@query("f11_reasons", f"{CONTRACTS} SELECT root, source_file, {REASONS} AS reasons FROM stats")
def reasons(spark, sf):
    return _contracts(spark, sf).select("root", "source_file", F.array_join(selection.reasons(LIMITS), "|").alias("reasons"))


@query(
    "a2_representative",
    f"""{CONTRACTS}, top AS (SELECT * FROM stats QUALIFY row_number() OVER (PARTITION BY root ORDER BY total_volume DESC, nonzero_updates DESC, source_file DESC) = 1),
    roots AS (SELECT DISTINCT event_type AS root FROM events UNION ALL SELECT 'none')
    SELECT root, source_file, total_volume, CASE WHEN source_file IS NULL THEN 'no_source_file' ELSE {REASONS} END AS reasons, coalesce({REASONS} = '' AND source_file IS NOT NULL, false) AS selected FROM roots LEFT JOIN top USING (root)""",
)
def representative(spark, sf):
    roots = spark.read.parquet(f"{sf}/events.parquet").select(F.col("event_type").alias("root")).distinct().unionByName(spark.sql("SELECT 'none' AS root"))
    out = selection.representative(_contracts(spark, sf), roots, LIMITS)
    return out.select("root", "source_file", "total_volume", F.array_join("reasons", "|").alias("reasons"), "selected")


# --- profiles ------------------------------------------------------------------------------------------------------------------
def _priced(spark: SparkSession, sf: str) -> DataFrame:
    rows = _with_deltas(spark, sf)
    return rows.withColumn("interval_vwap", M.interval_vwap(F.col("delta_turnover"), F.col("delta_volume"), 100.0, F.col("price"), 1.0, 100.0))


VWAP = "CASE WHEN delta_volume = 0 THEN NULL WHEN delta_turnover <= 0 OR abs(delta_turnover / (delta_volume * 100.0) - price) > 100 THEN price ELSE delta_turnover / (delta_volume * 100.0) END"
PRICED = f"{DELTAS}, v AS (SELECT *, {VWAP} AS interval_vwap FROM d)"
HIST = f"""{PRICED}, hb AS (SELECT symbol, 'LTP' AS method, round_even(price, 0)::INT AS bin, delta_volume FROM v WHERE delta_volume > 0 UNION ALL SELECT symbol, 'VWAP', round_even(interval_vwap, 0)::INT, delta_volume FROM v WHERE delta_volume > 0),
    h AS (SELECT symbol, method, bin, sum(delta_volume)::BIGINT AS volume FROM hb GROUP BY ALL)"""
DENSE = f"""{HIST}, sp AS (SELECT symbol, min(bin) AS lo, max(bin) AS hi FROM h GROUP BY symbol),
    gr AS (SELECT symbol, method, unnest(range(lo, hi + 1))::INT AS bin FROM sp, (VALUES ('LTP'), ('VWAP')) m(method)),
    de AS (SELECT symbol, method, bin, coalesce(volume, 0)::BIGINT AS volume FROM gr LEFT JOIN h USING (symbol, method, bin))"""


def _dense(spark: SparkSession, sf: str) -> DataFrame:
    return profile.dense(profile.histograms(_priced(spark, sf), 1.0, KEY), KEY)


@query("m5_interval_vwap", f"{PRICED} SELECT symbol, seq, round(interval_vwap, 6) AS interval_vwap FROM v")
def interval_vwap(spark, sf):
    return _priced(spark, sf).select("symbol", "seq", F.round("interval_vwap", 6).alias("interval_vwap"))


@query("a4_histograms", f"{HIST} SELECT * FROM h")
def histograms(spark, sf):
    return profile.histograms(_priced(spark, sf), 1.0, KEY)


@query("a5_minute_ranges", f"{DELTAS} SELECT symbol, epoch(date_trunc('minute', time))::BIGINT // 60 AS minute, max(price) - min(price) AS range_ticks FROM d GROUP BY ALL")
def minute_ranges(spark, sf):
    return profile.minute_ranges(_with_deltas(spark, sf), 1.0, KEY)


@query("a6_dense_profile", f"{DENSE} SELECT * FROM de")
def dense(spark, sf):
    return _dense(spark, sf)


_KERNEL = M.gaussian_kernel(2.0)
SMOOTH = f"""{DENSE}, k AS (SELECT unnest(range({len(_KERNEL)})) - {len(_KERNEL) // 2} AS o, unnest({_KERNEL}) AS w),
    c AS (SELECT a.symbol, a.method, a.bin, coalesce(sum(b.volume * k.w), 0) AS v FROM de a CROSS JOIN k LEFT JOIN de b ON b.symbol = a.symbol AND b.method = a.method AND b.bin = a.bin - k.o GROUP BY ALL),
    sm AS (SELECT c.symbol, c.method, c.bin, v * t / sum(v) OVER (PARTITION BY c.symbol, c.method) AS volume FROM c JOIN (SELECT symbol, method, sum(volume) AS t FROM de GROUP BY ALL) USING (symbol, method))"""


@query("p1_smoothed_sigma2", f"{SMOOTH} SELECT symbol, method, bin, round(volume, 5) AS volume FROM sm")
def smoothed(spark, sf):
    return profile.smoothed(_dense(spark, sf), 2.0, KEY).select("symbol", "method", "bin", F.round("volume", 5).alias("volume"))


@query("a7_conserved_scales", f"{DENSE} SELECT symbol, method, s AS sigma, sum(volume)::BIGINT AS volume FROM de, (VALUES (0.0::DOUBLE), (1.0), (2.0), (4.0)) x(s) GROUP BY ALL")
def conserved(spark, sf):
    d = _dense(spark, sf)
    scales = profile.conserved(profile.all_scales(d, CONFIG.sigmas, KEY), d, KEY)
    return scales.groupBy("symbol", "method", "sigma").agg(F.round(F.sum("volume")).cast("bigint").alias("volume"))


@query("p7_profile_rows", f"{DENSE} SELECT symbol, method, 0.0::DOUBLE AS sigma, bin, bin * 0.5 AS price, round(volume, 8)::DOUBLE AS volume, round(volume / sum(volume) OVER (PARTITION BY symbol, method), 10) AS volume_share FROM de")
def profile_rows(spark, sf):
    return profile.profile_rows(profile.smoothed(_dense(spark, sf), 0.0, KEY), 0.5, KEY)


@query("l4_edges", f"{HIST} SELECT symbol, min(bin) - 1 AS low_from, min(bin) + 1 AS low_to, max(bin) - 1 AS high_from, max(bin) + 1 AS high_to FROM h WHERE method = 'LTP' AND volume > 0 GROUP BY symbol")
def edges(spark, sf):
    h = profile.histograms(_priced(spark, sf), 1.0, KEY).filter("method = 'LTP' AND volume > 0")
    return h.groupBy("symbol").agg((F.min("bin") - 1).alias("low_from"), (F.min("bin") + 1).alias("low_to"), (F.max("bin") - 1).alias("high_from"), (F.max("bin") + 1).alias("high_to"))


AREA = f"""{DENSE.replace("WITH ", "WITH RECURSIVE ", 1)}, tot AS (SELECT symbol, method, sum(volume) AS t, max(volume) AS top, min(bin) AS lo, max(bin) AS hi, sum((bin - mn) * volume) / sum(volume) + any_value(mn) AS center
        FROM (SELECT *, min(bin) OVER (PARTITION BY symbol, method) AS mn FROM de) GROUP BY symbol, method),
    pk AS (SELECT symbol, method, arg_min(bin, row(abs(bin - center), bin)) AS poc FROM de JOIN tot USING (symbol, method) WHERE volume = top GROUP BY symbol, method),
    grow(symbol, method, a, b, got) AS (
        SELECT symbol, method, poc, poc, top FROM pk JOIN tot USING (symbol, method)
        UNION ALL
        SELECT g.symbol, g.method, CASE WHEN l.volume >= coalesce(r.volume, -1) THEN g.a - 1 ELSE g.a END, CASE WHEN r.volume >= coalesce(l.volume, -1) THEN g.b + 1 ELSE g.b END,
               g.got + CASE WHEN l.volume >= coalesce(r.volume, -1) THEN l.volume ELSE 0 END + CASE WHEN r.volume >= coalesce(l.volume, -1) THEN r.volume ELSE 0 END
        FROM grow g JOIN tot USING (symbol, method) LEFT JOIN de l ON l.symbol = g.symbol AND l.method = g.method AND l.bin = g.a - 1
        LEFT JOIN de r ON r.symbol = g.symbol AND r.method = g.method AND r.bin = g.b + 1
        WHERE g.got < 0.7 * t AND (l.bin IS NOT NULL OR r.bin IS NOT NULL)
    ), flat AS (SELECT symbol, method, coalesce(max(bin) FILTER (bin < poc AND volume < top) + 1, any_value(lo)) AS poc_low, coalesce(min(bin) FILTER (bin > poc AND volume < top) - 1, any_value(hi)) AS poc_high
        FROM de JOIN pk USING (symbol, method) JOIN tot USING (symbol, method) GROUP BY symbol, method)
    SELECT symbol, method, poc, poc_low::INT AS poc_low, poc_high::INT AS poc_high, min(a)::INT AS val, max(b)::INT AS vah FROM grow JOIN pk USING (symbol, method) JOIN flat USING (symbol, method) GROUP BY ALL"""


@query("p5_value_area", AREA)
def value_area(spark, sf):
    return levels.value_areas(_dense(spark, sf), CONFIG.value_area, KEY)


def _levels(spark: SparkSession, sf: str) -> DataFrame:
    return levels.find_levels(profile.all_scales(_dense(spark, sf), CONFIG.sigmas, KEY), 1.0, CONFIG, KEY)


@query("l6_levels")
def find_levels(spark, sf):
    return _levels(spark, sf)


# --- events --------------------------------------------------------------------------------------------------------------------
def _zones(spark: SparkSession, sf: str) -> DataFrame:
    """Twelve zones a symbol around fixed prices."""
    symbols = spark.read.parquet(f"{sf}/events.parquet").select(F.col("event_type").alias("symbol")).distinct()
    z = symbols.select("symbol", F.explode(F.sequence(F.lit(1), F.lit(12))).alias("zone_no"))
    return z.withColumns({"lower": F.col("zone_no") * 30.0 - 4, "upper": F.col("zone_no") * 30.0 + 4, "node_types": F.concat(F.lit("K"), (F.col("zone_no") % 3).cast("string"))})


def _outcomes(spark: SparkSession, sf: str) -> DataFrame:
    # touches, limits, ends and reaches all read the accepted ticks, which are written once
    t, z = runs.Stages(runs.scratch(spark))(_valid(spark, sf).select("symbol", "seq", "time", "price"), "ticks"), _zones(spark, sf)
    limits = events.thresholds(profile.minute_ranges(t, 1.0, KEY).withColumn("range_ticks", F.col("range_ticks") + 40), CONFIG, KEY)
    return events.outcomes(events.first_touch(z, t, KEY), t, limits, 1.0, KEY)


EVENTS = f"""{BASE}, z AS (SELECT symbol, i::INT AS zone_no, i * 30.0 - 4 AS lower, i * 30.0 + 4 AS upper, 'K' || (i % 3) AS node_types FROM (SELECT DISTINCT event_type AS symbol FROM events), range(1, 13) r(i)),
    mv AS (SELECT *, lag(price) OVER (PARTITION BY symbol ORDER BY seq) AS bp FROM valid),
    th AS (SELECT z.*, seq AS touch_seq, time AS touch_time, price AS touch_price, CASE WHEN bp > upper AND price <= upper THEN 'support' ELSE 'resistance' END AS role
        FROM z JOIN mv USING (symbol) WHERE (bp > upper AND price <= upper) OR (bp < lower AND price >= lower) QUALIFY row_number() OVER (PARTITION BY symbol, zone_no ORDER BY seq) = 1),
    rg AS (SELECT symbol, max(price) - min(price) + 40 AS r FROM valid GROUP BY symbol, date_trunc('minute', time)),
    lim AS (SELECT symbol, greatest(2, round_even(median(r) * 0.5, 0))::INT AS reaction_ticks, greatest(1, round_even(median(r) * 0.25, 0))::INT AS penetration_ticks FROM rg GROUP BY symbol),
    af AS (SELECT th.*, reaction_ticks, penetration_ticks, v.seq, v.time, v.price,
        CASE WHEN CASE WHEN role = 'support' THEN v.price >= upper + reaction_ticks ELSE v.price <= lower - reaction_ticks END THEN 'bounce'
             WHEN CASE WHEN role = 'support' THEN v.price <= lower - penetration_ticks ELSE v.price >= upper + penetration_ticks END THEN 'break' END AS what
        FROM th JOIN lim USING (symbol) JOIN valid v USING (symbol) WHERE v.seq >= touch_seq),
    en AS (SELECT symbol, zone_no, coalesce(min(seq) FILTER (what IS NOT NULL), max(seq)) AS rs FROM af GROUP BY symbol, zone_no),
    ev AS (SELECT af.symbol, af.zone_no, any_value(node_types) AS node_types, any_value(role) AS role, any_value(touch_seq) AS touch_seq, any_value(touch_price) AS touch_price, any_value(rs) AS resolution_seq, coalesce(max(what) FILTER (seq = rs), 'timeout') AS outcome,
        any_value(reaction_ticks) AS reaction_ticks, any_value(penetration_ticks) AS penetration_ticks, round(greatest(0, max(CASE WHEN role = 'support' THEN price - touch_price ELSE touch_price - price END)), 6) AS mfe_ticks,
        round(greatest(0, max(CASE WHEN role = 'support' THEN touch_price - price ELSE price - touch_price END)), 6) AS mae_ticks, round(max(date_diff('microsecond', touch_time, time)) FILTER (seq = rs) / 6e7, 6) AS minutes_to_resolution
        FROM af JOIN en USING (symbol, zone_no) WHERE seq <= rs GROUP BY af.symbol, af.zone_no)"""


@query("e2_first_touch", f"{EVENTS} SELECT symbol, zone_no, role, touch_seq, touch_time, touch_price FROM th")
def first_touch(spark, sf):
    return events.first_touch(_zones(spark, sf), _valid(spark, sf), KEY).select("symbol", "zone_no", "role", "touch_seq", "touch_time", "touch_price")


@query("e3_outcomes", f"{EVENTS} SELECT * FROM ev")
def outcomes(spark, sf):
    cols = ["symbol", "zone_no", "node_types", "role", "touch_seq", "touch_price", "resolution_seq", "outcome", "reaction_ticks", "penetration_ticks"]
    return _outcomes(spark, sf).select(*cols, *(F.round(c, 6).alias(c) for c in ("mfe_ticks", "mae_ticks", "minutes_to_resolution")))


@query("e6_zone_roles", f"{EVENTS} SELECT z.symbol, z.zone_no, coalesce(th.role, 'neutral') AS role, touch_seq FROM z LEFT JOIN th USING (symbol, zone_no)")
def zone_roles(spark, sf):
    return events.roles(_zones(spark, sf), _valid(spark, sf), KEY).select("symbol", "zone_no", "role", "touch_seq")


@query(
    "a9_summary",
    f"""{EVENTS}, c AS (SELECT z.node_types, count(*) AS levels, count(ev.zone_no) AS touched, count_if(outcome = 'bounce')::BIGINT AS bounce, count_if(outcome = 'break')::BIGINT AS break, count_if(outcome = 'timeout')::BIGINT AS timeout FROM z LEFT JOIN ev USING (symbol, zone_no) GROUP BY z.node_types)
    SELECT *, levels - touched AS no_touch, CASE WHEN bounce + break > 0 THEN bounce / (bounce + break) ELSE 0.0 END AS bounce_rate FROM c""",
)
def summary(spark, sf):
    return events.summary(_zones(spark, sf), _outcomes(spark, sf))


# --- charts and text -----------------------------------------------------------------------------------------------------------
@query(
    "v1_lod",
    f"""{BASE}, k AS (SELECT symbol, unnest([min(seq), max(seq), arg_min(seq, row(price, seq)), arg_max(seq, row(price, -seq))]) AS seq FROM valid GROUP BY symbol, epoch_ms(time) // 3600000)
    SELECT DISTINCT symbol, seq, price FROM k JOIN valid USING (symbol, seq)""",
)
def lod(spark, sf):
    return charts.thinned(_valid(spark, sf), KEY, 3_600_000).select("symbol", "seq", "price")


@query("w8_breaks", f"{BARS}, x AS (SELECT symbol, row_number() OVER w - 1 AS idx, date_diff('second', lag(bar_time) OVER w, bar_time) / 60.0 AS gap FROM b WINDOW w AS (PARTITION BY symbol ORDER BY bar_time)) SELECT symbol, (idx - 0.5)::DOUBLE AS x, (gap - 1)::INT AS minutes, CASE WHEN gap >= 60 THEN '午休' ELSE '休盘' END AS label FROM x WHERE gap > 1.5")
def breaks(spark, sf):
    return charts.breaks(charts.positions(_one(spark, sf), KEY), KEY).withColumn("x", F.col("x").cast("double"))


@query("w7_tick_x", f"{BARS}, x AS (SELECT symbol, bar_time, row_number() OVER (PARTITION BY symbol ORDER BY bar_time) - 1 AS idx FROM b) SELECT t.symbol, t.seq, round(idx + (epoch_us(t.time) % 60000000) / 6e7, 6) AS x FROM t2 t LEFT JOIN x ON x.symbol = t.symbol AND x.bar_time = date_trunc('minute', t.time)")
def tick_x(spark, sf):
    placed = charts.positions(_one(spark, sf), KEY)
    return charts.tick_x(event_ticks(spark, sf), placed, KEY).select("symbol", "seq", F.round("x", 6).alias("x"))


@query("w9_afternoon_x", f"{BARS}, x AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY bar_time) - 1 AS idx FROM b) SELECT symbol, coalesce(greatest(min(idx) FILTER (hour(bar_time) BETWEEN 13 AND 14) - 0.5, 0.0), count(*) - 1)::DOUBLE AS x FROM x GROUP BY symbol")
def afternoon_x(spark, sf):
    placed = charts.positions(_one(spark, sf), KEY)
    return charts.afternoon_x(placed, SESSIONS.label(T.minute_of_day(F.col("bar_time"))) == "afternoon", KEY).withColumn("x", F.col("x").cast("double"))


@query("a14_extent", f"{BARS}, e AS (SELECT symbol, min(low) AS lo, max(high) AS hi FROM b GROUP BY symbol) SELECT symbol, round(lo - greatest(2.0, (hi - lo) * 0.04), 6) AS low, round(hi + greatest(2.0, (hi - lo) * 0.04), 6) AS high FROM e")
def extent(spark, sf):
    return charts.extent([(_one(spark, sf), "low", "high")], 1.0, KEY).select("symbol", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


@query("m12_zone_id", "SELECT p_partkey, substr(sha256(concat_ws('|', p_type, p_brand, p_name, p_size::VARCHAR, p_partkey::VARCHAR, p_type)), 1, 20) AS zone_id FROM part")
def zone_ids(spark, sf):
    p = spark.read.parquet(f"{sf}/part.parquet")
    return p.select("p_partkey", M.zone_id(*(F.col(c).cast("string") for c in ("p_type", "p_brand", "p_name", "p_size", "p_partkey", "p_type"))).alias("zone_id"))


@query(
    "j4_levels_events",
    """WITH e AS (SELECT o_orderdate::DATE AS day, (o_custkey % 20)::VARCHAR AS lower, o_orderpriority AS role, o_orderstatus AS outcome, o_orderkey AS n FROM orders WHERE o_custkey % 3 = 0 QUALIFY row_number() OVER (PARTITION BY o_orderdate::DATE, o_custkey % 20 ORDER BY o_orderkey DESC) = 1),
    l AS (SELECT DISTINCT o_orderdate::DATE AS day, (o_custkey % 20)::VARCHAR AS lower FROM orders) SELECT day::VARCHAR AS day, lower, coalesce(role, 'neutral') AS role, coalesce(outcome, 'no_touch') AS outcome FROM l LEFT JOIN e USING (day, lower)""",
)
def levels_events(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet").withColumn("day", F.col("o_orderdate").cast("date")).withColumn("lower", (F.col("o_custkey") % 20).cast("string"))
    ev = o.filter("o_custkey % 3 = 0").select("day", "lower", F.col("o_orderpriority").alias("role"), F.col("o_orderstatus").alias("outcome"), F.col("o_orderkey").alias("event_no"))
    return charts.levels_with_events(o.select("day", "lower").distinct(), ev, ["day", "lower"]).withColumn("day", F.col("day").cast("string"))
