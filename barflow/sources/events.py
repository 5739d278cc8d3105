"""The test tables as market data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def event_ticks(spark: SparkSession, sf_dir: str, *, dirty: bool = True) -> DataFrame:
    """events as ticks: cumulative volume and turnover (in cents) grow within a symbol's day and start anew each day. dirty: every 97th
    price is 0, every 41st time lies ten minutes back."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    t = e.select(F.col("event_type").alias("symbol"), F.col("event_id").alias("seq"), F.col("ts").cast("timestamp_ntz").alias("time"), F.col("value").alias("price"), F.get_json_object("props", "$.k").cast("bigint").alias("qty"), F.when(F.col("user_id") % 3 != 0, F.col("user_id").cast("double")).alias("open_interest"), "user_id")
    day = Window.partitionBy("symbol", F.col("time").cast("date")).orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    t = t.withColumn("volume", F.sum("qty").over(day)).withColumn("turnover", F.sum(F.col("qty") * F.round(F.col("price") * 100).cast("bigint")).over(day))
    if dirty:
        t = t.withColumn("price", F.when(F.col("seq") % 97 == 0, 0.0).otherwise(F.col("price"))).withColumn("time", F.when(F.col("seq") % 41 == 0, F.col("time") - F.expr("INTERVAL 10 MINUTES")).otherwise(F.col("time")))
    return t


def line_tape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as a daily tape, symbol = return flag; ord is its order."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return li.select(F.col("l_returnflag").alias("symbol"), F.col("l_shipdate").cast("date").alias("date"), F.col("l_extendedprice").alias("price"), F.col("l_quantity").alias("qty"), F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity").alias("ord"))
