"""The live path as streams: given days, timers, the ledger of the archive, replay, and turns of writers."""

import datetime as dt
import subprocess
import sys
import threading
import time

import pytest
from pyspark.sql import functions as F

from barflow.operators import bars
from barflow.plans.calendar import NIGHT_2300, Sessions
from barflow.schema import BAR, TICK
from barflow.sources import store
from barflow.streaming import sinks
from barflow.streaming.bars import live_bars

from .test_bars import GOLDEN, at, trace

S = Sessions.parse(NIGHT_2300)
COLUMNS = ["symbol", "period", "bar_time", "trading_day", "open", "high", "low", "close", "volume", "turnover", "open_interest", "tick_count", "flags"]
SCHEMA = f"{TICK}, flush BOOLEAN"


def put(spark, folder, rows):
    """One file of rows (symbol, seq, time, price, volume, turnover, open_interest, trading_day, flush); files are read oldest first."""
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    time.sleep(0.05)


def feed(spark, folder, parts, flush=True):
    """Rows in parts, one file each, and at the end a row a symbol that closes what is open."""
    for rows in parts:
        put(spark, folder, [(*r, False) for r in rows])
    if flush:
        names = sorted({r[0] for rows in parts for r in rows})
        last = max(r[2] for rows in parts for r in rows)
        put(spark, folder, [(n, 10**6, last, None, None, None, None, None, True) for n in names])


def ticks_of(symbols, n=120, days=False):
    return [[(f"s{k}", i, *t, 20260800 + i // 30 if days and k % 2 else None) for k in symbols for i, t in enumerate(trace(k, n)) if lo <= i < lo + n // 3] for lo in range(0, n, n // 3)]


def batch_bars(spark, parts, periods=(5, 15)):
    df = spark.createDataFrame([r for rows in parts for r in rows], TICK)
    return sorted(tuple(r) for r in bars.all_periods(df, S, periods).select(*COLUMNS).collect())


def archived(spark, path):
    return sorted(tuple(r) for r in store.read_archive(spark, path, BAR).select(*COLUMNS).collect())


def stream(spark, folder):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)


def test_replay_equals_batch(spark, tmp_path):
    parts, folder, path = ticks_of(range(4), days=True), str(tmp_path / "in"), str(tmp_path / "archive")
    feed(spark, folder, parts)
    seen = []
    sinks.replay(spark, folder, SCHEMA, S, path, "live", str(tmp_path / "ck"), delay="30 days", on_bars=lambda b, n: seen.append((n, b.count())))
    want = batch_bars(spark, parts)
    assert archived(spark, path) == want and len(want) > 100
    assert len({n for n, _ in seen}) == len(seen) and sum(c for _, c in seen) == len(want)
    # again: nothing is new, and nothing is told
    sinks.replay(spark, folder, SCHEMA, S, path, "live", str(tmp_path / "ck"), delay="30 days", on_bars=lambda b, n: seen.append((n, -1)))
    assert archived(spark, path) == want and all(c >= 0 for _, c in seen)


def test_golden_ticks_and_timer(spark, tmp_path):
    folder = str(tmp_path / "in")
    rows = [("rb", i, at(t), float(p), float(v), 0.0, None if oi is None else float(oi), None) for i, (t, p, v, oi) in enumerate(GOLDEN)]
    put(spark, folder, [(*r, False) for r in rows[:8]])
    # no flush: a row without price moves the stream's time past the segment's end
    put(spark, folder, [("other", 0, at("11:30:01"), None, None, None, None, None, False)])
    query = live_bars(stream(spark, folder), S, (5,), delay="0 seconds").writeStream.format("memory").queryName("golden").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    query.awaitTermination(200)
    got = {r.bar_time: r for r in spark.table("golden").filter("period = '1m'").collect()}
    assert [(t.hour, t.minute) for t in sorted(got)] == [(9, 0), (9, 1), (10, 14), (10, 30)]
    first, last = got[at("9:00")], got[at("10:30")]
    assert (first.open, first.high, first.low, first.close, first.volume, first.tick_count, first.trading_day, first.flags) == (3200, 3205, 3200, 3202, 30, 3, 20260724, 1)
    assert got[at("9:01")].volume == 10 and (got[at("10:14")].close, got[at("10:14")].volume, got[at("10:14")].tick_count) == (3255, 70, 2) and last.volume == 30
    # the break's last minute was seen, so the longer bar ended there
    assert {(r.bar_time.hour, r.bar_time.minute) for r in spark.table("golden").filter("period = '5m'").collect()} == {(9, 0), (10, 14)}


def test_stopped_between_archive_and_ledger(spark, tmp_path, monkeypatch):
    parts, folder, path, ck = ticks_of(range(3)), str(tmp_path / "in"), str(tmp_path / "archive"), str(tmp_path / "ck")
    feed(spark, folder, parts)
    enter, calls = sinks.Ledger.enter, []

    def broken(self, batch):
        calls.append(batch)
        if batch == 1:
            raise RuntimeError("stopped here")
        enter(self, batch)

    monkeypatch.setattr(sinks.Ledger, "enter", broken)
    with pytest.raises(Exception, match="stopped here"):
        sinks.replay(spark, folder, SCHEMA, S, path, "live", ck, delay="30 days")
    assert sinks.Ledger(spark, path, "live").last() == 0
    monkeypatch.setattr(sinks.Ledger, "enter", enter)
    written = []
    persist = store.persist
    monkeypatch.setattr(sinks, "persist", lambda *a: written.append(persist(*a)))
    sinks.replay(spark, folder, SCHEMA, S, path, "live", ck, delay="30 days")
    assert written[0] == 0 and archived(spark, path) == batch_bars(spark, parts)  # batch 1 came again and changed nothing
    # a batch that is entered does nothing when it comes again
    take = sinks.into_archive(path, "live")
    count = len(written)
    take(spark.createDataFrame([], BAR).drop("settlement"), 1)
    assert len(written) == count and sinks.Ledger(spark, path, "live").last() >= 3


def test_archive_scan_reads_named_partitions_only(spark, tmp_path):
    path = str(tmp_path / "a")
    rows = [(s, "1m", dt.datetime(2026, 7, d, 9, 0), 20260700 + d, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 0.0, 1, 1, 0) for s in "xyz" for d in range(1, 9)]
    batch = spark.createDataFrame(rows, f"{BAR}, seq INT")
    assert store.persist(batch, path, BAR) == 24
    part = store.named_parts(batch.filter("symbol = 'x' AND trading_day = 20260703"), store.PARTS)
    plan = store.only(store.read_archive(spark, path, BAR), part, store.PARTS)._jdf.queryExecution()
    filters = [line for line in plan.optimizedPlan().toString().splitlines() if "Filter" in line]
    assert any("= x" in f and "= 20260703" in f for f in filters) and "PartitionFilters: [isnotnull(symbol" in plan.executedPlan().toString()
    assert store.persist(batch.withColumn("close", F.lit(2.0)).filter("symbol = 'x'"), f"file:{path}", BAR) == 8
    assert store.read_archive(spark, path, BAR).agg(F.sum("close")).first()[0] == 16 + 16
    with pytest.raises(ValueError, match="partitions"):
        store.MOST_PARTS, before = 3, store.MOST_PARTS
        try:
            store.named_parts(batch, store.PARTS)
        finally:
            store.MOST_PARTS = before


def test_lease(spark, tmp_path):
    path, inside, most = str(tmp_path / "x.lease"), [], []

    def work(k):
        for _ in range(4):
            with store.Lease(spark, path, wait=0.01):
                inside.append(k)
                most.append(len(inside))
                time.sleep(0.01)
                inside.remove(k)

    # the local file system does not create for one caller alone, so turns are taken by two threads that start apart
    threads = [threading.Thread(target=work, args=(k,)) for k in range(2)]
    for t in threads:
        t.start()
        time.sleep(0.3)
    for t in threads:
        t.join()
    assert len(most) == 8
    held = store.Lease(spark, path, seconds=3600).__enter__()
    with pytest.raises(TimeoutError):
        store.Lease(spark, path, patience=0, wait=0.01).__enter__()
    assert held.held_by()[0] == held.owner
    held.__exit__()
    store.Lease(spark, path, seconds=-1).__enter__()  # one whose holder has gone
    with store.Lease(spark, path) as own:
        assert own.held_by()[0] == own.owner
    assert own.held_by() is None


WRITER = """
import sys, datetime as dt
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.driver.memory", "1g").config("spark.sql.shuffle.partitions", "1").getOrCreate()
spark.sparkContext.setLogLevel("OFF")
from barflow.schema import BAR
from barflow.sources import store
own, path = int(sys.argv[1]), sys.argv[2]
for k in range(4):
    row = ("x", "1m", dt.datetime(2026, 7, 1, 9, 10 * k + own), 20260701, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 0.0, 1, 1, 0)
    store.persist(spark.createDataFrame([row], BAR + ", seq INT"), path, BAR)
"""


def test_two_processes_lose_no_row(spark, tmp_path):
    path = f"file:{tmp_path}/a"
    running = [subprocess.Popen([sys.executable, "-c", WRITER, str(k), path], stderr=subprocess.DEVNULL) for k in range(2)]
    assert [p.wait(timeout=240) for p in running] == [0, 0]
    assert store.read_archive(spark, path, BAR).count() == 8
