"""Contract statistics and reasons against a plain scan by the reference's rule, tick by tick."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from barflow import queries as own
from barflow.operators import selection
from barflow.plans import pipeline
from barflow.plans.config import Limits, ProfileConfig
from barflow.sources.events import event_ticks

from .test_plans import S, day  # noqa: F401

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def scanned(spark):
    """By contract: what a scan of its ticks in order finds."""
    out = {}
    for r in event_ticks(spark, SF).orderBy("seq").collect():
        s = out.setdefault((r.symbol, f"{r.symbol}_{r.user_id % 4}"), {"filtered_rows": 0, "backwards_rows": 0, "valid_rows": 0, "misaligned_rows": 0, "nonzero_updates": 0, "total_volume": 0.0, "minutes": set(), "bins": set(), "last": None})
        minute = r.time.hour * 60 + r.time.minute
        if not own.SESSIONS.holds(minute) or not r.price > 0:
            s["filtered_rows"] += 1
            continue
        if s["last"] and r.time < s["last"][0]:
            s["backwards_rows"] += 1
            continue
        volume = r.volume or 0
        delta = max(volume - s["last"][1], 0) if s["last"] else 0
        if delta > 0 and 540 <= minute < 690:
            s["total_volume"] += delta
            s["nonzero_updates"] += 1
            s["minutes"].add(r.time.replace(second=0, microsecond=0))
            s["bins"].add(round(r.price / 0.05))
        s["misaligned_rows"] += abs(r.price / 0.05 - round(r.price / 0.05)) > 1e-6
        s["valid_rows"] += 1
        s["last"] = (r.time, volume)
    return out


def test_rejected_ticks_are_counted(spark, scanned):
    got = {(r.root, r.source_file): r for r in own.QUERIES["a1_contract_stats"](spark, SF).collect()}
    assert set(got) == set(scanned)
    for k, s in scanned.items():
        assert (got[k].filtered_rows, got[k].backwards_rows) == (s["filtered_rows"], s["backwards_rows"]), k
    assert any(s["backwards_rows"] for s in scanned.values())
    reasons = {(r.root, r.source_file): r.reasons.split("|") for r in own.QUERIES["f11_reasons"](spark, SF).collect()}
    assert all(("backwards_ticks" in reasons[k]) == (s["backwards_rows"] > 0) for k, s in scanned.items())
    chosen = {r.root: r for r in own.QUERIES["a2_representative"](spark, SF).collect()}
    for r in chosen.values():
        if r.source_file:
            assert r.reasons.split("|") == reasons[(r.root, r.source_file)] and r.selected == (r.reasons == "")


def test_stats_equal_a_scan(spark, scanned):
    for r in own.QUERIES["a1_contract_stats"](spark, SF).collect():
        s = scanned[(r.root, r.source_file)]
        assert (r.total_volume, r.nonzero_updates, r.valid_rows, r.misaligned_rows) == (s["total_volume"], s["nonzero_updates"], s["valid_rows"], s["misaligned_rows"])
        assert (r.active_minutes, r.price_bins, r.coverage) == (len(s["minutes"]), len(s["bins"]), round(len(s["minutes"]) / 135, 10))


def test_quoted_minutes_and_afternoon_prices(spark):
    rows = [("A", 9 * 60 + k, 10.0 + k, 1 if k == 0 else 0, True) for k in range(9)] + [("A", 14 * 60, 10.3, 5, False)]
    t = spark.createDataFrame(rows, "root string, minute int, price double, delta_volume int, early boolean")
    t = t.withColumns({"time": F.timestamp_seconds(F.col("minute") * 60).cast("timestamp_ntz"), "quality_flags": F.array().cast("array<string>")})
    r = selection.contract_stats(t, 1.0, 135, ["root"], morning=F.col("early")).first()
    assert (r.total_volume, r.nonzero_updates, r.active_minutes, r.price_bins, r.valid_rows, r.misaligned_rows) == (1.0, 1, 1, 1, 10, 1)


def test_pipeline_excludes_backward_contracts(spark, day):  # noqa: F811
    ticks, contracts = day
    back = ticks.withColumn("time", F.when(F.col("seq") == 100, F.lit(dt.datetime(2026, 1, 9, 9, 31)).cast("timestamp_ntz")).otherwise(F.col("time")))
    bad = ticks.filter("seq < 8").withColumns({"symbol": F.lit("IC2603"), "price": F.lit(0.0)})
    picked = pipeline.run(back.unionByName(bad), contracts, S, ProfileConfig(limits=Limits(volume=10, nonzero_updates=5, coverage=0.5))).selected.collect()
    got = {r.root: (r.source_file, r.reasons, r.selected) for r in picked}
    assert got["IF"] == ("IF2603", ["backwards_ticks"], False)
    # no tick accepted: a file all the same
    assert got["IC"] == ("IC2603", ["volume", "nonzero_updates", "active_minute_coverage", "price_bins"], False)


def test_each_day_has_its_own_contract(spark, day):  # noqa: F811
    ticks, contracts = day
    other = ticks.withColumns({"symbol": F.lit("IF2606"), "price": F.col("price") + 1})
    small = lambda t: t.withColumns({"volume": F.col("volume") / 5, "turnover": F.col("turnover") / 5})
    later = lambda t: t.withColumns({"time": F.col("time") + F.expr("INTERVAL 3 DAYS"), "source_day": F.lit("20260112"), "seq": F.col("seq") + 1000})
    rows = ticks.unionByName(small(other)).unionByName(later(small(ticks))).unionByName(later(other))
    run = pipeline.run(rows, contracts, S, ProfileConfig(limits=Limits(volume=10, nonzero_updates=5, coverage=0.5)))
    got = {(r.trading_day, r.root): r.source_file for r in run.selected.collect()}
    assert got == {("20260109", "IF"): "IF2603", ("20260112", "IF"): "IF2606", ("20260109", "IC"): None, ("20260112", "IC"): None}
    assert {(r.trading_day, r.instrument) for r in run.levels.select("trading_day", "instrument").distinct().collect()} == {("20260109", "IF2603"), ("20260112", "IF2606")}
