"""Names, root kinds, the raw archive and text forms."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from barflow import schema
from barflow.functions import names
from barflow.plans import roots
from barflow.plans.calendar import STOCK_INDEX, Sessions
from barflow.plans.pipeline import quality_stats
from barflow.sources import files, raw, store


def test_names(spark, tmp_path):
    df = spark.createDataFrame([("IF2603",), ("螺纹-1_a",), ("a b",), ("../x",), ("",), (None,)], "n string")
    assert [r[0] for r in df.select(names.valid_instrument(F.col("n"))).collect()] == [True, True, False, False, False, False]
    df = spark.createDataFrame([("rb0",), (" LH2611 ",), ("R",), ("0RB",), ("A" * 17,), ("a%",)], "s string")
    assert [r[0] for r in df.select(names.valid_symbol(F.col("s"), code=True)).collect()] == [True, True, False, False, False, False]
    assert [r[0] for r in df.select(names.valid_symbol(F.col("s"))).collect()] == [True, False, True, True, True, False]
    assert names.inside(str(tmp_path), "a", "b.SVG", extensions=frozenset({".svg"})) == str(tmp_path / "a" / "b.SVG")
    for parts in (("..", "x"), ("a", "../../x"), ("/etc/passwd",), ("a\0b",)):
        with pytest.raises(ValueError):
            names.inside(str(tmp_path / "root"), *parts)
    with pytest.raises(ValueError):
        names.inside(str(tmp_path), "x.exe", extensions=frozenset({".svg"}))


def test_roots(spark):
    df = spark.createDataFrame([("IF2603",), ("rb2605",), ("Sc2605",)], "symbol string")
    assert [(r.root, r.kind) for r in roots.with_kind(df).collect()] == [("if", "index"), ("rb", "night to 23:00"), ("sc", "night to 02:30")]
    assert roots.unknown_roots(df).count() == 0
    bad = spark.createDataFrame([("XX2603",), ("rb2605",)], "symbol string")
    assert [r.root for r in roots.unknown_roots(bad).collect()] == ["xx"]
    with pytest.raises(Exception, match="no sessions known for xx"):
        roots.with_kind(bad).collect()
    with pytest.raises(Exception, match="no root in name"):
        roots.with_kind(spark.createDataFrame([("2603",)], "symbol string")).collect()
    assert roots.sessions_of("CU").minutes == 4 * 60 + 225 and roots.sessions_of("t").day_close == 15 * 60 + 15
    with pytest.raises(ValueError):
        roots.sessions_of("xx")


def test_text_forms(spark):
    numbers = [3200.0, 0.1, 1 / 3, 0.0, -2.50, 123456789012345.0, 100000000000000.0, 0.0001]
    df = spark.createDataFrame([(x,) for x in numbers], "x double")
    assert [r[0] for r in df.select(names.short_number(F.col("x"))).collect()] == ["%.15g" % x for x in numbers]
    one = spark.createDataFrame([("20260109", "09:30:00", "5"), ("20260109", "09:30:00", ""), ("20260109", "21:00:00", None)], "d string, c string, m string")
    assert [r[0] for r in one.select(names.event_text(F.col("d"), F.col("c"), F.col("m"))).collect()] == ["2026-01-09 09:30:00.005", "2026-01-09 09:30:00.000", "2026-01-09 21:00:00.000"]
    assert [r[0] for r in spark.range(0, 6).select(names.period_name(F.col("id") * 15)).collect()] == [None, "15m", "30m", None, "1h", None]
    bar = raw.bar_of(spark.createDataFrame([("rb", 1.0, None)], "symbol string, close double, volume double"))
    assert tuple(bar.first()) == ("rb", "", dt.datetime(1970, 1, 1), 0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 0, 0)
    assert bar.select(raw.bar_text()).first()[0] == "1970-01-01 00:00:00 TD=0 O:0.00 H:0.00 L:0.00 C:1.00 V:0 OI:0"
    df = spark.createDataFrame([('a,"b"', 1), (None, 2)], "t string, n int")
    assert list(raw.dry_run(df)) == ["t,n", '"a,""b""",1', ",2"]
    assert list(raw.dry_run(df, "json")) == ['{"t":"a,\\"b\\"","n":1}', '{"n":2}']
    with pytest.raises(ValueError):
        list(raw.dry_run(df, "xml"))
    assert raw.archive_metadata("RB0", "1m", zone="Asia/Shanghai", schema="1", source="s", source_time="end", calendar="c") == "# symbol=RB0 period=1m tz=Asia/Shanghai schema=1 source=s source_time=end calendar=c night_start=18:00 day_start=08:00"
    with pytest.raises(ValueError):
        raw.archive_metadata("RB 0", "1m", zone="", schema="1", source="s", source_time="end", calendar="c")


def test_review_lines(spark):
    cols = "trading_day string, instrument string, zone_id string, node_type string, center string, lower string, upper string, auto_outcome string, manual_grade string, manual_behavior string, profile_quality string, zone_quality string, comment string, created_at string, updated_at string"
    row = lambda day, who, center, comment: (day, who, "z", "HVN", center, "1", "2", "bounce", "A", "", "good", "", comment, "t", "t")
    df = spark.createDataFrame([row("20260109", "rb", "10", "plain"), row("20260109", "rb", "9", 'two\nlines, "quoted"'), row("20260110", "rb", "1", "")], cols)
    got = list(raw.review_lines(df, "20260109"))
    assert got[0].startswith("tradingDay,instrument,zoneId,nodeType") and len(got) == 3
    assert got[1] == '20260109,rb,z,HVN,9,1,2,bounce,A,,good,,"two\nlines, ""quoted""",t,t'


def test_raw_archive(spark, tmp_path):
    path = str(tmp_path / "raw")
    bar = lambda y, m, close, seq=0, high=9.0: ("RB0", "1m", dt.datetime(y, 1, 1, 9, m), 2.0, high, 1.0, close, 5.0, 6.0, seq)
    frame = lambda *rows: spark.createDataFrame(list(rows), "symbol string, period string, datetime timestamp_ntz, open double, high double, low double, close double, volume double, hold double, seq int")
    assert raw.read_raw(spark, path).count() == 0
    assert raw.upsert_raw(frame(bar(2025, 1, 2.0), bar(2026, 1, 2.0)), path) == 2
    assert raw.upsert_raw(frame(bar(2026, 1, 3.0), bar(2026, 1, 4.0, 1), bar(2026, 2, 5.0)), path) == 1
    rows = lambda: [(r.year, r.datetime.minute, r.close) for r in raw.read_raw(spark, path).orderBy("datetime").collect()]
    assert rows() == [(2025, 1, 2.0), (2026, 1, 4.0), (2026, 2, 5.0)]
    # one bad row of any symbol or year, and nothing changes
    with pytest.raises(Exception, match="inconsistent bar"):
        raw.upsert_raw(frame(bar(2025, 1, 7.0), bar(2027, 1, 5.0, high=3.0)), path)
    assert rows() == [(2025, 1, 2.0), (2026, 1, 4.0), (2026, 2, 5.0)]
    assert raw.upsert_raw(frame(), path) == 0
    raw.read_raw(spark, path).filter("year = 2025").drop("symbol", "period", "year").write.parquet(f"{path}/symbol=RB0/period=1m/year=2024")
    with pytest.raises(Exception, match="outside of its year"):
        raw.read_raw(spark, path).collect()


def test_files_that_are_not_there_and_ticks_again(spark, tmp_path):
    none = raw.bars_if_there(spark, str(tmp_path / "none.csv"))
    (tmp_path / "a.csv").write_text("2026-07-24 09:00:00,20260724,1,2,1,1,5,0,0,0,1,1\n")
    there = raw.bars_if_there(spark, str(tmp_path / "a.csv"))
    assert none.count() == 0 and none.dtypes == there.dtypes and there.count() == 1
    bars = raw.bar_of(files.read_bars(spark, str(tmp_path / "a.csv")).withColumn("symbol", F.lit("rb")))
    raw.write_bar_files(bars.unionByName(bars.withColumn("symbol", F.lit("cu"))), str(tmp_path / "many"))
    assert raw.bars_if_there(spark, str(tmp_path / "many")).count() == 2
    t = spark.createDataFrame([("rb", 1, ["LONG_GAP", "VOLUME_RESET"]), ("rb", 2, [])], "symbol string, seq int, quality_flags array<string>")
    store.write_ticks(t, str(tmp_path / "t"))
    assert [r.quality_flags for r in raw.read_ticks(spark, str(tmp_path / "t")).orderBy("seq").collect()] == [["LONG_GAP", "VOLUME_RESET"], []]


def test_quality_stats_counts_invalid_rows(spark):
    at = lambda h, m: dt.datetime(2026, 1, 9, h, m)
    rows = [("IF", 0, at(9, 29), 1.0, 1.0), ("IF", 1, at(9, 30), 1.0, 5.0), ("IC", 2, at(9, 31), 1.0, 6.0), ("IF", 3, at(9, 31), 1.0, -1.0), ("IF", 4, at(9, 31), 0.0, 6.0), ("IF", 5, at(9, 30), 1.0, 7.0), ("IF", 6, at(9, 29), 1.0, 8.0), ("IF", 7, at(13, 0), 1.0, 4.0)]
    df = spark.createDataFrame(rows, "symbol string, seq int, time timestamp_ntz, price double, volume double").withColumn("file", F.lit("f"))
    r = quality_stats(df, Sessions.parse(STOCK_INDEX), ["file"], instrument="IF").first()
    assert (r.rows, r.valid_rows, r.filtered_rows, r.bad_price_rows, r.backwards_rows) == (8, 3, 2, 3, 0)
    assert (r.volume_resets, r.zero_delta_rows, r.morning_rows, r.afternoon_rows) == (1, 2, 2, 1)
    assert schema.CLOSED == 1
