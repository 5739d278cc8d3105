"""File sources, ingest, archive and live bars."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from barflow import schema
from barflow.operators import bars, ticks
from barflow.plans.calendar import NIGHT_2300, STOCK_INDEX, Sessions, day_map
from barflow.sources import files, ingest, store
from barflow.streaming.bars import live_bars

HEAD = "TradingDay,InstrumentID,UpdateTime,UpdateMillisec,LastPrice,Volume,BidPrice1,Turnover,OpenInterest"


def test_source_ticks(spark, tmp_path):
    rows = ["20260109,IF2603,09:29:00,0,100,0,1,0,5", "20260109,IF2603,09:30:00,0,100,10,1,300000,5", "", '20260109,IF2603,09:30:01,500,100.2,50,1,"1503000",5', "20260109,IF2603,13:00:00,,101,51,1,1545300,5"]
    (tmp_path / "IF2603_20260109.csv").write_text("﻿" + "\r\n".join([HEAD, *rows]) + "\r\n", encoding="utf-8")
    (tmp_path / "IF连续_20260109.csv").write_text(HEAD + "\n")
    t = files.source_ticks(spark, str(tmp_path / "*.csv"))
    d = ticks.deltas(ticks.valid_ticks(t, Sessions.parse(STOCK_INDEX)))
    assert [(r.seq, r.delta_volume, r.millis_of_day) for r in d.orderBy("seq").collect()] == [(2, 0, 34200000), (4, 40, 34201500), (5, 1, 46800000)]
    (tmp_path / "IC2603_20260109.csv").write_text("\n".join([HEAD, rows[0], rows[1].replace("IF2603", "IF2604")]))
    with pytest.raises(Exception, match="several instruments"):
        files.source_ticks(spark, str(tmp_path / "IC*.csv")).count()
    (tmp_path / "IH2603_20260109.csv").write_text("a,b\n1,2\n")
    with pytest.raises(Exception, match="missing columns"):
        files.source_ticks(spark, str(tmp_path / "IH*.csv")).collect()


def test_scans_follow_the_listing(spark, tmp_path):
    row = "20260109,{0},09:30:00,0,100,10,0,30,1\n"
    for name, day, n in (("IF2603", "20260109", 1), ("rb 2605", "20260109", 1), ("IF连续", "20260109", 1), ("IF2603", "20260112", 50)):
        (tmp_path / f"{name}_{day}.csv").write_text(f"{HEAD}\n" + row.format(name) * n)
    read = lambda **o: files.source_ticks(spark, str(tmp_path), **o)
    names = lambda df: sorted(f.rsplit("/", 1)[1] for f in df.inputFiles())
    assert names(read(roots=["if"], days=["20260109"])) == ["IF2603_20260109.csv"]
    assert len(names(read())) == 3 and not any("连续" in n or "%E8%BF%9E" in n for n in names(read()))
    assert read(roots=["RB"]).count() == 1 and read(roots=["au"]).count() == 0
    with pytest.raises(ValueError, match="too large.*20260112"):
        read(max_bytes=1000)
    assert names(read(days=["20260109"], max_bytes=1000)) == ["IF2603_20260109.csv", "rb%202605_20260109.csv"]


def test_simple_ticks_and_calendar(spark, tmp_path):
    (tmp_path / "s.csv").write_text('update_date,symbol,last_price,volume\n"2026-07-01 09:29:00",IC2608,100.2,10\n2026-07-01 09:30:00.5,"IC2608",100.4,20\n')
    assert [(r.seq, r.time.microsecond, r.price) for r in files.simple_ticks(spark, str(tmp_path / "s.csv")).orderBy("seq").collect()] == [(1, 0, 100.2), (2, 500000, 100.4)]
    (tmp_path / "c.txt").write_text('# days\n["20260724", "2026-07-27"]\n20260724\n')
    assert sorted(r[0].day for r in files.trade_dates(spark, str(tmp_path / "c.txt")).collect()) == [24, 27]
    (tmp_path / "d.txt").write_text("20261399\n")
    with pytest.raises(Exception, match="no date"):
        files.trade_dates(spark, str(tmp_path / "d.txt")).count()


def test_external_bars(spark, tmp_path):
    (tmp_path / "e.csv").write_text("datetime,open,high,low,close,volume,hold\n2026-07-24 09:01:00,3200,3202,3199,3201,10,1000\n2026-07-24 21:01:00,3210,3212,3209,3211,20,1010\n2026-07-25 00:01:00,3220,3221,3219,3220,30,1020\n")
    raw = files.external_bars(spark, str(tmp_path / "e.csv"))
    days = day_map(spark.createDataFrame([(dt.date(2026, 7, 24),), (dt.date(2026, 7, 27),)], "trade_date date"), "2026-07-24", "2026-07-27")
    for d in (days, None):
        got = ingest.canonical(raw, "rb", 1, days=d).orderBy("bar_time").collect()
        assert [(r.bar_time.hour, r.bar_time.minute, r.trading_day, r.flags) for r in got] == [(9, 0, 20260724, 1), (21, 0, 20260727, 5), (0, 0, 20260727, 5)]
    assert ingest.canonical(raw, "rb", 1, label="start").orderBy("bar_time").first().bar_time.minute == 1
    with pytest.raises(Exception, match="duplicate bar"):
        ingest.canonical(raw.unionByName(raw), "rb", 1).count()
    (tmp_path / "j.js").write_text('var x=([{"d":"2026-07-24 09:01:00","o":"1","h":"2","l":"1","c":"1","v":"5","p":"6"},["2026-07-24 09:02:00","1","2","1","1","5","7"]]);')
    assert [r.hold for r in files.jsonp_bars(spark, str(tmp_path / "j.js")).orderBy("seq").collect()] == ["6", "7"]


def test_archive_upsert_and_bar_files(spark, tmp_path):
    bar = lambda h, m, day, close=1.0, flags=1, seq=0: ("rb", "1m", dt.datetime(2026, 7, 24, h, m), day, 1.0, 2.0, 0.5, close, 10.0, 0.0, 0.0, 0.0, 1, flags, seq)
    frame = lambda rows: spark.createDataFrame(rows, schema.BAR + ", seq INT")
    path, three = str(tmp_path / "archive"), [bar(9, 0, 20260724), bar(9, 1, 20260724), bar(21, 0, 20260727, flags=5)]
    assert [store.persist(frame(r), path, schema.BAR) for r in (three, three, [*three, bar(9, 2, 20260724)], [bar(9, 1, 20260724, 3299.0), bar(9, 1, 20260724, 3300.0, seq=1)], [bar(9, 5, 20260724, flags=0)])] == [3, 0, 1, 1, 0]
    got = store.read_archive(spark, path, schema.BAR, trading_day=20260724).orderBy("bar_time").collect()
    assert [(r.bar_time.minute, r.close) for r in got] == [(0, 1.0), (1, 3300.0), (2, 1.0)]
    out = tmp_path / "rb" / "20260724.csv"
    assert store.write_bar_file(store.read_archive(spark, path, schema.BAR, trading_day=20260724), str(out), symbol="rb", period="1m") == 3
    assert out.read_text().splitlines()[0] == "# symbol=rb period=1m tz=Asia/Shanghai generated_by=barflow"
    back = files.with_metadata_check(spark, str(out), {"symbol": "rb", "period": "1m"}).orderBy("seq").collect()
    assert [(r.bar_time.minute, r.close, r.trading_day) for r in back] == [(0, 1.0, 20260724), (1, 3300.0, 20260724), (2, 1.0, 20260724)]
    with pytest.raises(Exception, match="metadata conflict"):
        files.with_metadata_check(spark, str(out), {"symbol": "cu"}).count()
    out.write_text(out.read_text() + "bad-time,x,x\n")
    with pytest.raises(Exception, match="bad bar"):
        files.read_bars(spark, str(out)).count()
    with pytest.raises(ValueError):
        store.safe_component("../x")


def test_live_bars_equal_batch_bars(spark, tmp_path):
    s = Sessions.parse(NIGHT_2300)
    rows = [("rb", i, dt.datetime(2026, 7, 24, 9, 0) + dt.timedelta(seconds=20 * i), 3200.0 + i % 7, 10.0 * i, 1.0 * i, float(i)) for i in range(120)]
    df = spark.createDataFrame(rows, "symbol string, seq long, time timestamp_ntz, price double, volume double, turnover double, open_interest double")
    live = df.select("symbol", "seq", (F.unix_micros(F.col("time").cast("timestamp")) / 1e6).alias("seconds"), "price", "volume", "turnover", "open_interest", F.lit(False).alias("flush"))
    end = live.limit(1).withColumn("seq", F.lit(10**6).cast("long")).withColumn("flush", F.lit(True))
    for lo in (0, 60):
        live.filter(f"seq >= {lo} AND seq < {lo + 60}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    end.write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(live.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = live_bars(stream, s).writeStream.format("memory").queryName("live").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(200)
    cols = ["period", "bar_time", "open", "high", "low", "close", "volume", "tick_count"]
    want = sorted(tuple(r) for r in bars.all_periods(df, s).select(*cols).collect())
    assert sorted(tuple(r) for r in spark.table("live").select(*cols).collect()) == want and len(want) == 40 + 8 + 3
