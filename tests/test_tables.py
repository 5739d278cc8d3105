"""The canonical archive with its manifest, and the review table."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from barflow.schema import BAR
from barflow.sources import store, tables

ABOUT = {"zone": "Asia/Shanghai", "schema": "v1", "source": "made", "source_time": "end", "calendar": "weekdays"}


def bars(spark, rows):
    return spark.createDataFrame([(s, "1m", dt.datetime(2026, 7, d, 9, m), 20260700 + d, c, c, c, c, 1.0, 0.0, 1.0, 0.0, 0, 1, n) for n, (s, d, m, c) in enumerate(rows)], f"{BAR}, seq INT")


def left(spark, path):
    return sorted((r.symbol, r.bar_time.day, r.bar_time.minute, r.close) for r in tables.read_canonical(spark, path).collect())


def test_canonical(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "a")
    first = bars(spark, [("x", 1, 0, 1.0), ("x", 1, 1, 1.0), ("x", 2, 0, 1.0), ("y", 1, 0, 1.0), ("x", 1, 1, 2.0)])
    assert tables.write_canonical(first, path, **ABOUT) == {"written": 3, "unchanged": 0}
    assert left(spark, path) == [("x", 1, 0, 1.0), ("x", 1, 1, 2.0), ("x", 2, 0, 1.0), ("y", 1, 0, 1.0)]
    # the same batch in another order reads no bars
    real = store.read_archive
    with monkeypatch.context() as m:
        m.setattr(tables, "read_archive", lambda spark, where, *a, **k: real(spark, where, *a, **k) if where.endswith(".manifest") else pytest.fail("bars were read"))
        assert tables.write_canonical(first.repartition(3), path, **ABOUT) == {"written": 0, "unchanged": 3}
    # one partition has other rows
    second = bars(spark, [("x", 2, 0, 3.0), ("x", 2, 5, 3.0), ("y", 1, 0, 1.0)])
    assert tables.write_canonical(second, path, **ABOUT) == {"written": 1, "unchanged": 1}
    want = [("x", 1, 0, 1.0), ("x", 1, 1, 2.0), ("x", 2, 0, 3.0), ("x", 2, 5, 3.0), ("y", 1, 0, 1.0)]
    assert left(spark, path) == want
    assert {(r.symbol, r.trading_day): r.rows for r in real(spark, f"{path}.manifest", tables.MANIFEST).collect()} == {("x", 20260701): 2, ("x", 20260702): 2, ("y", 20260701): 1}
    # any other key is a conflict, before a partition that would be new is written
    third = bars(spark, [("x", 9, 0, 9.0), ("y", 1, 0, 9.0)])
    for key in (*ABOUT, "night_start", "day_start"):
        with pytest.raises(tables.Conflict, match="y"):
            tables.write_canonical(third, path, **{**ABOUT, key: "other"})
    assert left(spark, path) == want
    with pytest.raises(ValueError, match="metadata"):
        tables.write_canonical(third, path, **{**ABOUT, "source": "a b"})
    assert tables.write_canonical(first.limit(0), path, **ABOUT) == {"written": 0, "unchanged": 0}


def test_reviews(spark, tmp_path):
    table = tables.Reviews(spark, str(tmp_path / "r"))
    names = [p.split()[0] for p in tables.REVIEW.split(", ")]

    def rows(*some):
        at = lambda h: dt.datetime(2026, 7, 1, h)
        made = [dict(zip(names, (day, "IF", zone, "POC", 1.0, 1.0, 2.0, "bounce", grade, "", "good", "", "a, \"b\"", at(h), at(h)), strict=True)) for day, zone, grade, h in some]
        return spark.createDataFrame(made, tables.REVIEW)

    assert table.all().count() == 0
    assert table.put(rows(("20260701", "a", "A", 1), ("20260701", "b", "B", 1), ("20260702", "a", "C", 1), ("20260701", "a", "D", 2))) == 2
    assert table.put(rows(("20260701", "b", "A", 5))) == 1
    got = {(r.trading_day, r.zone_id): (r.grade, r.created_at.hour, r.updated_at.hour) for r in table.all().collect()}
    assert got == {("20260701", "a"): ("D", 2, 2), ("20260701", "b"): ("A", 1, 5), ("20260702", "a"): ("C", 1, 1)}
    with pytest.raises(Exception, match="invalid review"):
        table.put(rows(("20260703", "a", "Z", 1)))
    assert [r.reviews for r in table.counts("20260701").collect()] == [2] and table.of("20260701", "IC").count() == 0
    assert table.drop(rows(("20260702", "a", "", 1), ("20260701", "b", "", 1))) == 2
    assert [(r.trading_day, r.zone_id) for r in table.all().collect()] == [("20260701", "a")]
    assert not (tmp_path / "r" / "trading_day=20260702").exists() and table.drop(rows()) == 0
    assert table.all().filter(F.col("comment") == 'a, "b"').count() == 1
