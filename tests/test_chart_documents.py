"""Chart documents: parts, text that may stand within a page, days without parts."""

import json

from pyspark.sql import functions as F

from barflow.operators import bars, ticks
from barflow.plans import charts
from barflow.plans.calendar import STOCK_INDEX, Sessions

from .test_bars import TICK, at

S = Sessions.parse(STOCK_INDEX)
DAY = "20260724"


def frames(spark):
    rows = [("IF", i, at(t), float(p), float(v), 0.0, 1.0) for i, (t, p, v) in enumerate([("9:30:00", 100, 0), ("9:30:30", 102, 3), ("9:31:00", 101, 5), ("9:31:30", 101, 5), ("13:00:00", 103, 9), ("13:00:15", 95, 10)])]
    good = ticks.deltas(ticks.valid_ticks(spark.createDataFrame(rows, TICK), S)).withColumn("day", F.lit(DAY)).cache()
    one = bars.bars_1m(good, S).withColumn("day", F.lit(DAY))
    zones = spark.createDataFrame([("IF", DAY, 1, "</script>", 99.0, 101.0, "2026-07-24 11:30:00"), ("IF", DAY, 2, "POC", 110.0, 111.0, "")], "symbol string, day string, zone_no int, node_types string, lower double, upper double, available string")
    touched = spark.createDataFrame([("IF", DAY, 1, "support", at("13:00:15"), 95.0)], "symbol string, day string, zone_no int, role string, touch_time timestamp_ntz, touch_price double")
    events = touched.withColumns({"node_types": F.lit("</script>"), "outcome": F.lit("bounce"), "mfe_ticks": F.lit(1.0), "mae_ticks": F.lit(0.0)})
    return good, one, zones, touched, events


def test_full_document(spark):
    good, one, zones, touched, events = frames(spark)
    profiles = spark.createDataFrame([("IF", DAY, m, s, b, 2.0) for m in ("VWAP", "LTP") for s in (2.0, 0.0) for b in (101, 100)], "symbol string, day string, method string, sigma double, bin int, volume double")
    [row] = charts.full_documents(one, good, zones, events, profiles, S, 0.5).collect()
    assert "</" not in row.payload
    doc = json.loads(row.payload)
    assert [(b["time"], b["open"], b["close"], b["volume"], b["session"], b["ticks"]) for b in doc["bars"]] == [("2026-07-24 09:30", 100, 102, 3, "morning", 2), ("2026-07-24 09:31", 101, 101, 2, "morning", 2), ("2026-07-24 13:00", 103, 95, 5, "afternoon", 2)]
    assert doc["breaks"] == [{"x": 1.5, "minutes": 208, "label": "午休"}]
    assert [p["x"] for p in doc["ticksFull"]] == [0, 0.5, 1, 2, 2.25] and doc["ticksOverview"] == doc["ticksFull"]  # the tick that says nothing new is left out
    assert [(z["role"], z["outcome"], z["startX"]) for z in doc["levels"]] == [("support", "bounce", 1.5), ("neutral", "no_touch", 1.5)]
    assert [(e["x"], e["outcome"], e["type"]) for e in doc["events"]] == [(2.25, "bounce", "</script>")]
    assert list(doc["profiles"]) == ["LTP", "VWAP"] and list(doc["profiles"]["LTP"]) == ["0.0", "2.0"] and doc["profiles"]["VWAP"]["2.0"] == [[50.0, 2.0], [50.5, 2.0]]
    assert (doc["priceMin"], doc["priceMax"]) == (94.0, 112.0)
    assert doc["stats"] == {"ticks": 6, "tickPoints": 5, "bars": 3, "levels": 2, "events": 1, "bounce": 1, "break": 0, "timeout": 0}


def test_simple_document_and_missing_parts(spark):
    good, one, zones, touched, _ = frames(spark)
    quality = good.groupBy("symbol", "day").agg(F.count("*").alias("rows"))
    profile = spark.createDataFrame([("IF", DAY, 101.0, 5, 1.0)], "symbol string, day string, price double, volume long, share double")
    [row] = charts.simple_documents(one, good, zones, touched, profile, quality, S, 0.5).collect()
    doc = json.loads(row.payload)
    assert len(doc["ticks"]) == 6 and [round(v["price"], 6) for v in doc["vwap"]] == [102, 101.6, 102.222222, 101.5] and doc["quality"] == {"rows": 6}
    assert doc["zones"][0]["firstTouchX"] == 2.25 and doc["zones"][1]["firstTouchTime"] is None
    [back] = charts.read_document(spark.createDataFrame([row]), charts.SIMPLE_SCHEMA).select("doc.*").collect()
    assert back.algorithmVersion == "mvp-1" and back.zones[0]["type"] == "</script>"
    none = [df.limit(0) for df in (zones, touched, profile, quality)]
    [row] = charts.simple_documents(one, good, *none, S, 0.5).collect()
    doc = json.loads(row.payload)
    assert doc["zones"] == [] and doc["profile"] == [] and doc["quality"] == {} and len(doc["bars"]) == 3
    assert charts.simple_documents(one.limit(0), good, zones, touched, profile, quality, S, 0.5).count() == 0
