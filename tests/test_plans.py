"""The profile pipeline end to end on made ticks, the services, and reports."""

import datetime as dt
import math
import time

import pytest
from pyspark.sql import functions as F

from barflow.plans import pipeline, service
from barflow.plans.calendar import STOCK_INDEX, Sessions
from barflow.plans.config import Limits, ProfileConfig
from barflow.sources import reports

S = Sessions.parse(STOCK_INDEX)


@pytest.fixture(scope="module")
def day(spark):
    rows, volume, turnover = [], 0.0, 0.0
    for k, (h, m) in enumerate([(9, 30 + i) for i in range(30)] + [(10, i) for i in range(60)] + [(13, i) for i in range(60)]):
        for j in range(4):
            price = 100 + 0.2 * round(10 * math.sin(k / 7) + j)
            volume += 5
            turnover += 5 * price * 300
            rows.append(("IF2603", 4 * k + j, dt.datetime(2026, 1, 9, h, m, 10 * j), price, volume, turnover, 1.0, "20260109", "IF2603_20260109"))
    t = spark.createDataFrame(rows, "symbol string, seq long, time timestamp_ntz, price double, volume double, turnover double, open_interest double, source_day string, source_file string")
    contracts = spark.createDataFrame([("IF", 0.2, 300.0), ("IC", 0.2, 200.0)], "root string, tick_size double, turnover_divisor double")
    return t, contracts


def test_pipeline(spark, day):
    run = pipeline.run(*day, S, ProfileConfig(limits=Limits(volume=10, nonzero_updates=5, coverage=0.5)))
    assert {r.root: r.selected for r in run.selected.collect()} == {"IF": True, "IC": False}
    zones = run.levels.collect()
    assert {"VPOC", "EDGE_LOW", "EDGE_HIGH"} <= {k for r in zones for k in r.node_types}
    ev = run.events.collect()
    assert ev and {r.outcome for r in ev} <= {"bounce", "break", "timeout"}
    assert {r.zone_no for r in ev} <= {r.zone_no for r in zones}


def test_converter(day):
    bars, report = pipeline.convert(day[0], S)
    r = report.first()
    assert (r.rows, r.valid_rows, r.bars, r.resets) == (600, 600, 150, 0) and bars.count() == 150
    assert pipeline.totals(report).first().files == 1
    assert pipeline.quality_stats(day[0], S, ["symbol"]).first().zero_delta_rows == 1
    assert pipeline.simple_profile(day[0].withColumn("delta_volume", F.lit(1)), 0.2, ["symbol"]).agg(F.round(F.sum("share"), 9)).first()[0] == 1


def test_services(spark):
    reviews = spark.createDataFrame([("20260109", "IF2603", "z1", 4727.0, "A", "", "", "x", 1)], "trading_day string, instrument string, zone_id string, center double, grade string, behavior string, quality string, comment string, created_at int")
    change = reviews.withColumn("grade", F.lit("B")).withColumn("created_at", F.lit(9))
    got = service.put_review(reviews, change).collect()
    assert [(r.grade, r.created_at) for r in got] == [("B", 1)]
    with pytest.raises(Exception, match="invalid review"):
        service.put_review(reviews, change.withColumn("grade", F.lit("Z"))).collect()
    assert service.drop_review(reviews, change).count() == 0 and service.list_reviews(reviews, "20260109").count() == 1
    level = spark.createDataFrame([("20260109", "IF2603", "2026-01-09 11:30:00", "VPOC", "4727", "4726", "4728")], "trading_day string, instrument string, available_time string, node_types string, center string, lower string, upper string")
    event = level.withColumns({"role": F.lit("support"), "outcome": F.lit("bounce"), "event_no": F.lit(1)})
    r = service.levels(level, event, reviews, "20260109", "IF2603").first()
    assert (r.role, r.outcome, len(r.zone_id), r.grade) == ("support", "bounce", 20, None)
    with pytest.raises(ValueError):
        service.levels(level, event, reviews, "20261399", "IF2603")


def test_tasks_charts_and_reports(spark):
    order = []
    tasks = service.Tasks({s: (lambda d, log, s=s: (order.append(s), log(s), time.sleep(0.05), 1 / (s != "visual"))) for s in service.STEPS})
    t = tasks.start("20260109", "all")
    with pytest.raises(RuntimeError):
        tasks.start("20260109", "all")
    last = list(tasks.events(t.id))[-1]
    assert order == list(service.STEPS) and last["state"] == "failed" and "ZeroDivisionError" in last["log"][-1]
    made = []
    charts = service.Charts(lambda p: made.append(p) or p, keep=1)
    assert [charts.get("a", 1, 1), charts.get("a", 1, 1), charts.get("a", 2, 1), charts.get("a", 1, 1)] == ["a"] * 4 and len(made) == 3
    page = reports.report("<x>", {"t": spark.createDataFrame([("<b>", None)], "a string, b int")})
    assert "&lt;b&gt;" in page and "</script>" not in reports.detail("t", '{"a":"</script>"}').split("<script")[1].removesuffix("</script>")
    assert "polyline" in reports.svg_profile([(1, 2), (2, 3)], [(1.5, "z")])
