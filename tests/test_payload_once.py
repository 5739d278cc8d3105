"""Chart documents are made once, and their parts equal the SQL on repeated events too."""

import duckdb
from pyspark.sql import functions as F

from barflow import file_queries, queries

SF = "/root/testdata/sf0.001"


def test_parts_read_documents_made_once(spark, tmp_path):
    e = spark.read.parquet(f"{SF}/events.parquet")
    copies = e.join(spark.range(3).withColumnRenamed("id", "k")).withColumns({"event_id": F.col("event_id") + F.col("k") * (1 << 21), "ts": F.col("ts") + F.make_dt_interval(days=(F.col("k") * 30).cast("int"))}).drop("k")
    copies.write.parquet(f"{tmp_path}/events.parquet")
    rows = file_queries.full_payload(spark, str(tmp_path))
    assert "Join" not in rows._jdf.queryExecution().optimizedPlan().toString()
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    rows.write.parquet(f"{tmp_path}/out")
    want, got = f"({queries.ORACLES['v2_payload']})", f"'{tmp_path}/out/*.parquet'"
    assert duck.sql(f"SELECT count(*) FROM {want}").fetchall() == duck.sql(f"SELECT count(*) FROM {got}").fetchall()
    assert duck.sql(f"FROM {want} EXCEPT ALL FROM {got}").fetchall() == []
