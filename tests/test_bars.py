"""Bars and their steps: hand-made cases, and random traces against the live path."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from barflow.operators import bars, charts, dml, series, ticks
from barflow.plans.calendar import NIGHT_2300, STOCK_INDEX, Sessions, day_map, parse_clock
from barflow.streaming.bars import BAR_FIELDS, Slices

S = Sessions.parse(NIGHT_2300)
TICK = "symbol string, seq long, time timestamp_ntz, price double, volume double, turnover double, open_interest double"
DAY = dt.datetime(2026, 7, 24)


def at(text, day=DAY):
    h, m, s = (*map(int, text.split(":")), 0)[:3]
    return day + dt.timedelta(hours=h, minutes=m, seconds=s)


def one_minute(spark, rows, block=1 << 20):
    df = spark.createDataFrame([("rb", i, *r) for i, r in enumerate(rows)], TICK)
    return bars.bars_1m(ticks.deltas(ticks.valid_ticks(df, S, block=block), block=block), S)


GOLDEN = [("9:00:01", 3200, 10, 1000), ("9:00:30", 3205, 25, 1010), ("9:00:59", 3202, 40, 1005), ("9:01:05", 3210, 50, 1020), ("10:20:00", 3300, 200, 1100), ("10:14:30", 3250, 100, 2000), ("10:14:50", 3255, 120, 2010), ("10:30:10", 3260, 150, 2020), ("10:31:00", 0, 160, None)]


@pytest.mark.parametrize("block", [1 << 20, 2])
def test_golden_minutes(spark, block):
    rows = [(at(t), float(p), float(v), None, None if oi is None else float(oi)) for t, p, v, oi in GOLDEN]
    got = [(r.bar_time.strftime("%H:%M"), r.open, r.high, r.low, r.close, r.volume, r.open_interest, r.tick_count, r.trading_day, r.flags) for r in one_minute(spark, rows, block).orderBy("bar_time").collect()]
    assert got == [
        ("09:00", 3200, 3205, 3200, 3202, 30, 1005, 3, 20260724, 1),
        ("09:01", 3210, 3210, 3210, 3210, 10, 1020, 1, 20260724, 1),
        ("10:14", 3250, 3255, 3250, 3255, 70, 2010, 2, 20260724, 1),
        ("10:30", 3260, 3260, 3260, 3260, 30, 2020, 1, 20260724, 1),
    ]


def test_end_to_end_counts(spark):
    rows = [(at(f"9:{m}:30"), 3200.0 + m, (m + 1) * 10.0, 0.0, 5000.0 + m) for m in range(17)]
    df = spark.createDataFrame([("rb", i, *r) for i, r in enumerate(rows)], TICK)
    out = bars.all_periods(df, S).cache()
    assert {r.period: r["count"] for r in out.groupBy("period").count().collect()} == {"1m": 17, "5m": 4, "15m": 2}
    five = out.filter("period = '5m'").orderBy("bar_time").first()
    assert (five.open, five.high, five.low, five.close, five.volume) == (3200, 3204, 3200, 3204, 40)
    fifteen = out.filter("period = '15m'").orderBy("bar_time").first()
    assert (fifteen.open, fifteen.high, fifteen.close) == (3200, 3214, 3214)


def test_rollup_ends_at_the_break(spark):
    rows = [("rb", at(f"10:{m:02}"), 20260724, 1.0, 2.0, 0.5, 1.0 + m, 8.0, 0.0, 0.0, 1) for m in [*range(15), 30, 31]]
    df = spark.createDataFrame(rows, "symbol string, bar_time timestamp_ntz, trading_day int, open double, high double, low double, close double, volume double, turnover double, open_interest double, tick_count int")
    got = [(r.bar_time.strftime("%H:%M"), r.volume, r.close) for r in bars.roll_up(df, 60, S).orderBy("bar_time").collect()]
    assert got == [("10:00", 120, 15), ("10:30", 16, 32)]


def trace(seed, n=300):
    r, out = random.Random(seed), []
    time, volume = at("8:50") + dt.timedelta(days=r.randrange(5)), 0.0
    for _ in range(n):
        time += dt.timedelta(seconds=r.choice([0, 1, 20, 70, 400, -30, 3000 if r.random() < 0.1 else 5]))
        volume = r.choice([0.0, volume]) if r.random() < 0.02 else volume + r.randrange(5)
        out.append((time, r.choice([0.0, None]) if r.random() < 0.05 else float(r.randrange(90, 110)), volume if r.random() > 0.03 else None, volume * 3, float(r.randrange(9)) if r.random() > 0.4 else None))
    return out


def test_batch_equals_slices(spark):
    """Ticks fed to the live path in slices of any length give the bars of the batch path, given trading days too."""
    rows, want = [], []
    day0 = dt.datetime(1970, 1, 1)
    for k in range(12):
        r, own, out = random.Random(k), Slices(S, (5, 15, 60, 240)), []
        made = [(*t, 20260800 + i // 40 if k % 3 == 0 and i % 7 else None) for i, t in enumerate(trace(k))]
        rows += [(f"s{k}", i, *t) for i, t in enumerate(made)]
        columns = [np.array([round((t[0] - day0).total_seconds() * 1e6) for t in made], np.int64)] + [np.array([np.nan if t[c] is None else t[c] for t in made], float) for c in range(1, 6)]
        at = 0
        while at < len(made):
            end = at + r.choice([1, 2, 7, 60])
            out += own.take(*(c[at:end] for c in columns))
            at = end
        out += own.flush()
        want += [(f"s{k}", f"{n}m", day0 + dt.timedelta(minutes=int(b["place"][i])), *(b[c][i].item() for c in list(BAR_FIELDS)[1:])) for n, b in out for i in range(len(b["place"]))]
    df = spark.createDataFrame(rows, f"{TICK}, trading_day int")
    one = bars.bars_1m(ticks.deltas(ticks.valid_ticks(df, S, block=37), block=37), S)
    out = one.withColumn("period", F.lit("1m"))
    for n in (5, 15, 60, 240):
        out = out.unionByName(bars.roll_up(one, n, S).withColumn("period", F.lit(f"{n}m")))
    got = [tuple(r) for r in out.select("symbol", "period", "bar_time", "trading_day", "open", "high", "low", "close", "volume", "turnover", "open_interest", "tick_count", "flags").collect()]
    assert len(want) > 1000 and sorted(got) == sorted(want)


def test_calendar(spark):
    assert [S.holds(parse_clock(t)) for t in ("09:30", "10:20", "12:00", "22:00", "16:00", "03:00")] == [True, False, False, True, False, False]
    assert [S.is_last(parse_clock(t)) for t in ("10:14", "11:29", "14:59", "22:59", "09:30", "12:00")] == [True] * 4 + [False] * 2
    assert (S.day_close, S.night_start, Sessions.parse(STOCK_INDEX).night_start, Sessions.parse(STOCK_INDEX).minutes) == (900, 1260, 1440, 240)
    for bad in ("9:00-10:00", "09:00", "25:00-26:00"):
        with pytest.raises(ValueError):
            Sessions.parse(bad)
    days = day_map(spark.createDataFrame([(dt.date(2026, 7, 24),), (dt.date(2026, 7, 27),)], "trade_date date"), "2026-07-23", "2026-07-27")
    got = {r.date.day: (r.day_session and r.day_session.day, r.night_session and r.night_session.day) for r in days.collect()}
    assert got == {23: (24, 24), 24: (24, 27), 25: (27, 27), 26: (27, 27), 27: (27, None)}


def test_series_and_keyed_tables(spark):
    b = spark.createDataFrame([("x", "1m", i, dt.datetime(2026, 1, 1, 0, i), float(i)) for i in range(1, 6)], "symbol string, period string, seq long, bar_time timestamp_ntz, close double")
    close = lambda i: [r.close for r in series.at(b, i, ["symbol"]).collect()]
    assert (close(-1), close(2), close(99), close(0)) == ([5], [2], [], [])
    t = lambda m: F.lit(dt.datetime(2026, 1, 1, 0, m))
    assert series.find(b, t(3), ["symbol"]).first()["index"] == 3 and series.find(b, t(30), ["symbol"]).count() == 0
    s = series.slice_of(b, t(2), t(4), ["symbol"]).first()
    assert (s.start_index, s.n) == (2, 2)
    new = b.filter("seq > 3").withColumn("close", F.col("close") + 1).unionByName(b.filter("seq = 2")).unionByName(b.filter("seq = 1").withColumn("symbol", F.lit("y")))
    assert {(r.symbol, r.bar_time.minute): r.change for r in dml.changes(b, new, ["symbol", "bar_time"], ["close"]).collect()} == {("x", 4): "changed", ("x", 5): "changed", ("x", 2): "unchanged", ("y", 1): "new"}
    assert dml.upsert(b, new, ["symbol", "bar_time"]).agg(F.sum("close")).first()[0] == 15 + 2 + 1


def test_charts(spark):
    df = spark.createDataFrame([("x", i, dt.datetime(2026, 1, 1, 9, 0, 0), float(p)) for i, p in enumerate((100, 105, 95, 101, 100))], "symbol string, seq long, time timestamp_ntz, price double")
    assert sorted(r.seq for r in charts.thinned(df, ["symbol"]).collect()) == [0, 1, 2, 4]
    b = spark.createDataFrame([("x", at(t)) for t in ("9:30", "9:31", "13:00", "13:01")], "symbol string, bar_time timestamp_ntz")
    placed = charts.positions(b, ["symbol"])
    assert [(r.x, r.label, r.minutes) for r in charts.breaks(placed, ["symbol"]).collect()] == [(1.5, "午休", 208)]
    assert charts.afternoon_x(placed, F.hour("bar_time") >= 13, ["symbol"]).first().x == 1.5


@pytest.mark.parametrize("block", [1, 7, 1 << 20])
def test_prefix_scans_in_blocks(spark, block):
    """Whatever the blocks, running price by volume, relevant ticks and consecutive bars are those of a loop over each symbol's ticks."""
    made = {f"s{k}": [(i, *t) for i, t in enumerate(trace(k, 120)) if t[1]] for k in range(3)}
    rows = [(s, i, time, price, float(i % 4 > 1) * (i % 5)) for s, own in made.items() for i, time, price, *_ in own]
    df = spark.createDataFrame(rows, "symbol string, seq long, time timestamp_ntz, price double, delta_volume double")
    vwap, relevant, runs = {}, set(), []
    for s in made:
        paid = volume = 0.0
        last = minute = None
        for _, i, time, price, dv in (r for r in rows if r[0] == s):
            if dv > 0:
                paid, volume = paid + price * dv, volume + dv
                vwap[s, i] = paid / volume
            if price != last or dv > 0:
                relevant.add((s, i))
            last, now = price, time.replace(second=0)
            if now != minute:
                runs.append([s, now, price, price, price, price, 0.0, 0])
            minute, own = now, runs[-1]
            runs[-1] = [s, now, own[2], max(own[3], price), min(own[4], price), price, own[6] + dv, own[7] + 1]
    got = {(r.symbol, r.seq): r.vwap for r in ticks.session_vwap(df, ["symbol"], block=block).collect()}
    assert got.keys() == vwap.keys() and all(abs(got[k] - vwap[k]) < 1e-9 for k in got)
    assert {(r.symbol, r.seq) for r in ticks.relevant_ticks(df, ["symbol"], block=block).collect()} == relevant
    bars_ = bars.consecutive_bars(df, ["symbol"], block=block).orderBy("symbol", "bar_no").collect()
    assert [[r.symbol, r.bar_time, r.open, r.high, r.low, r.close, r.volume, r.tick_count] for r in bars_] == runs
