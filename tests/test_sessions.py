"""Sessions by row: contracts of several kinds in one call give what a call a kind gives."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from barflow.operators import bars, ticks
from barflow.plans import pipeline, roots
from barflow.plans.calendar import NIGHT_0230, NIGHT_2300, STOCK_INDEX, RowSessions, Sessions
from barflow.plans.config import Limits, ProfileConfig

from .test_plans import day  # noqa: F401

TEXTS = {"night": NIGHT_2300, "index": STOCK_INDEX, "late": NIGHT_0230}
TABLES = {k: Sessions.parse(t) for k, t in TEXTS.items()}
BY_KIND = RowSessions.by("kind", TABLES)
TICK = "symbol string, kind string, seq long, time timestamp_ntz, price double, volume double, turnover double, open_interest double"


def made(n=900):
    out = []
    for k, kind in enumerate(["night", "index", "late", "late", "night"]):
        r, time, volume = random.Random(k), dt.datetime(2026, 7, 23, 20, 50), 0.0
        for i in range(n):
            time += dt.timedelta(seconds=r.choice([1, 30, 60, 240, -20]))
            volume += r.randrange(4)
            out.append((f"c{k}", kind, i, time, float(r.randrange(90, 110)), volume, volume * 2, 1.0))
    return out


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_one_call_equals_a_call_a_kind(spark):
    df = spark.createDataFrame(made(), TICK).cache()
    every = bars.all_periods(df, BY_KIND, (15, 60))
    assert "kind" in every.columns
    parts = [bars.all_periods(df.filter(F.col("kind") == k).drop("kind"), s, (15, 60)) for k, s in TABLES.items()]
    columns = parts[0].columns
    want = sorted((t for p in parts for t in rows_of(p.select(columns))), key=repr)
    assert rows_of(every.select(columns)) == want and len(want) > 500
    assert {r.kind for r in every.filter("hour(bar_time) = 1").select("kind").distinct().collect()} == {"late"}
    assert {r.kind for r in every.filter("flags > 1 AND period = '1m'").select("kind").distinct().collect()} == {"late", "night"}
    judged = lambda d, s: ticks.with_verdict(d, s, block=64).select("symbol", "seq", "verdict")
    assert rows_of(judged(df, BY_KIND)) == sorted((t for k, s in TABLES.items() for t in rows_of(judged(df.filter(F.col("kind") == k), s))), key=repr)


def test_questions(spark):
    minutes = spark.createDataFrame([(k, m) for k in TABLES for m in range(0, 1440, 7)], "kind string, m int")
    m = F.col("m")
    got = minutes.select("kind", "m", BY_KIND.contains(m), BY_KIND.is_last_minute(m), BY_KIND.is_day_close(m), BY_KIND.label(m), BY_KIND.night_start, BY_KIND.minutes, BY_KIND.morning_minutes).collect()
    for k, s in TABLES.items():
        own = [tuple(r)[1:] for r in got if r.kind == k]
        for minute, inside, last, close, label, night, total, early in own:
            want = (s.holds(minute), s.is_last(minute), minute + 1 == s.day_close, night, total, early)
            assert want == (inside, last, close, s.night_start, s.minutes, 120 if k == "index" else 135)
            assert label == ("morning" if minute < 720 else "afternoon") if inside and minute < 1080 else label is None
    with pytest.raises(Exception, match="no sessions known for other"):
        spark.createDataFrame([("other", 1)], "kind string, m int").select(BY_KIND.contains(m)).collect()


def test_lookup_and_zone(spark):
    own = RowSessions.by("root", {"rb": TABLES["night"], "IF": TABLES["index"]}, TABLES["late"], any_case=True, zones={"IF": "UTC"})
    df = spark.createDataFrame([("rb", 1261), ("IF", 780), ("if", 780), ("RB", 100), ("xx", 100), (None, 100)], "root string, m int")
    assert [r[0] for r in df.select(own.contains(F.col("m"))).collect()] == [True, True, True, True, True, True]
    assert [r[0] for r in df.select(own.night_start).collect()] == [1260, 1440, 1440, 1260, 1260, 1260]
    t = F.lit("2026-07-24 18:30:00").cast("timestamp_ntz")
    assert [r[0] for r in df.limit(2).select(own.local(t)).collect()] == [dt.datetime(2026, 7, 25, 2, 30), dt.datetime(2026, 7, 24, 18, 30)]


def test_convert_by_kind(spark):
    names = {"night": "rb2610", "index": "IF2609", "late": "au2612"}
    source = [(names[k], i, *rest, f"{names[k]}_20260724", "20260724") for _, k, i, *rest in made() if k in names and _ in ("c0", "c1", "c2")]
    df = spark.createDataFrame(source, "symbol string, seq long, time timestamp_ntz, price double, volume double, turnover double, open_interest double, source_file string, source_day string").cache()
    one, report = pipeline.convert(df)
    want = [pipeline.convert(df.filter(F.col("symbol") == names[k]), s) for k, s in TABLES.items()]
    assert rows_of(one) == sorted((t for o, _ in want for t in rows_of(o)), key=repr)
    assert rows_of(report) == sorted((t for _, r in want for t in rows_of(r)), key=repr) and report.count() == 3
    with pytest.raises(Exception, match="no sessions known for qq"):
        pipeline.convert(df.withColumn("symbol", F.lit("qq2610")))[0].collect()
    assert sum(len(r) for _, r in roots.KINDS.values()) == len(roots.KIND_OF)


def test_pipeline_by_group(spark, day):  # noqa: F811
    t, contracts = day
    night = t.withColumn("symbol", F.lit("IC2603")).withColumn("source_file", F.lit("IC2603_20260109"))
    cfg = ProfileConfig(limits=Limits(volume=10, nonzero_updates=5, coverage=0.4))
    groups = {"a": Sessions.parse(STOCK_INDEX), "b": Sessions.parse("09:30-10:15,10:30-11:30,13:30-15:00")}
    known = contracts.withColumn("session_group", F.when(F.col("root") == "IF", "a").otherwise("b"))
    both = pipeline.run(t.unionByName(night), known, RowSessions.by("session_group", groups), cfg)
    for rows, root, group in ((t, "IF", "a"), (night, "IC", "b")):
        own = pipeline.run(rows, contracts.filter(F.col("root") == root), groups[group], cfg)
        for name in ("selected", "normalized"):
            one, want = (getattr(r, name).filter(F.col("root") == root) for r in (both, own))
            assert rows_of(one.select(want.columns)) == rows_of(want)
    assert {r.root for r in both.selected.filter("selected").collect()} == {"IF", "IC"}
