"""The driver's entry points: every own query against its DuckDB twin on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from barflow import queries as own

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(x):
    return f"{x:.9g}" if isinstance(x, float) else str(x)


@pytest.mark.parametrize("name", ["b6_rollup_15m", "b7_all_periods", "a1_contract_stats", "f11_reasons", "a2_representative", "t9_calendar_day", "p5_value_area", "p1_smoothed_sigma2", "e3_outcomes", "v1_lod", "w3_gap_flags", "k3_upsert", "j8_mixed_sessions", "t12_last_minute", "b4_consecutive_bars", "w5_session_vwap", "f12_relevant_ticks", "e2_first_touch", "v3_payload", "d4_review_table", "k8_canonical_archive", "a10_run_counters"])
def test_query_equals_its_twin(spark, duck, name):
    df = own.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(tuple(map(plain, r)) for r in df.select(cols).collect())
    cur = duck.execute(own.ORACLES[name])
    order = [[d[0] for d in cur.description].index(c) for c in cols]
    assert got and got == sorted(tuple(plain(r[i]) for i in order) for r in cur.fetchall())


def test_entry_points(spark):
    assert set(own.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
