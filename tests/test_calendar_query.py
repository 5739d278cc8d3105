"""t9_calendar_day over all dates of orders, and past the calendar's end."""

import datetime as dt

import duckdb
import pytest

from barflow import queries as own

WHOLE = """WITH o AS (SELECT o_orderdate::DATE AS d FROM '{sf}/orders.parquet'),
    c AS (SELECT DISTINCT d FROM o WHERE isodow(d) < 6 AND day(d) % 7 <> 0),
    g AS (SELECT unnest(generate_series((SELECT min(d) FROM o), (SELECT max(d) + 7 FROM o), INTERVAL 1 DAY))::DATE AS date)
    SELECT g.date::VARCHAR, a.d::VARCHAR, b.d::VARCHAR FROM g ASOF LEFT JOIN c a ON g.date <= a.d ASOF LEFT JOIN c b ON g.date < b.d"""


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.1"])
def test_each_date_of_orders(spark, sf):
    sf = f"/root/testdata/{sf}"
    got = sorted(tuple(r) for r in own.QUERIES["t9_calendar_day"](spark, sf).collect())
    assert got == sorted(duckdb.sql(WHOLE.format(sf=sf)).fetchall())
    first, last = duckdb.sql(f"SELECT min(o_orderdate)::DATE, max(o_orderdate)::DATE FROM '{sf}/orders.parquet'").fetchall()[0]
    assert (got[0][0], got[-1][0]) == (str(first), str(last + dt.timedelta(7))) and len(got) == (last - first).days + 8
    assert got[-1][1:] == (None, None)
