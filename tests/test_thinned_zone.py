"""Thinned ticks do not depend on the session's zone."""

import datetime as dt

from barflow.operators import charts


def test_buckets_lie_in_exchange_time(spark):
    at = lambda h, m: dt.datetime(2024, 1, 2, h, m)
    rows = [("a", 0, at(10, 10), 5.0), ("a", 1, at(10, 20), 6.0), ("a", 2, at(10, 40), 7.0), ("a", 3, at(10, 50), 8.0), ("a", 4, at(11, 10), 9.0)]
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        for zone in ("UTC", "Asia/Kolkata", "Asia/Kathmandu"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            df = spark.createDataFrame(rows, "symbol string, seq long, time timestamp_ntz, price double")
            assert sorted(r.seq for r in charts.thinned(df, ["symbol"], 3_600_000).collect()) == [0, 3, 4], zone
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
