"""Access to a bar series: a DataFrame of bars with symbol, period and bar_time, append order in seq where it matters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def series(bars: DataFrame, symbol: str, period: str) -> DataFrame:
    return bars.filter((F.col("symbol") == symbol) & (F.col("period") == period))


def all_series(bars: DataFrame) -> DataFrame:
    return bars.select("symbol", "period").distinct()


def counts(bars: DataFrame, keys: list[str]) -> DataFrame:
    return bars.groupBy(*keys).agg(F.count("*").alias("n"))


def at(bars: DataFrame, index: int, keys: list[str], order: str = "bar_time") -> DataFrame:
    """Each key's bar at index: from 1, or from the end if negative; 0 and places out of range give none."""
    ranked = Window.partitionBy(*keys).orderBy(F.asc(order) if index > 0 else F.desc(order))
    return bars.withColumn("__i", F.row_number().over(ranked)).filter(F.col("__i") == abs(index)).filter(F.lit(index != 0)).drop("__i")


def last(bars: DataFrame, keys: list[str], order: str = "bar_time") -> DataFrame:
    """Each key's newest bar, without a sort."""
    row = F.struct(order, *(c for c in bars.columns if c != order))
    return bars.groupBy(*keys).agg(F.max_by(row, F.col(order)).alias("r")).select("r.*").select(bars.columns)


def indexed(bars: DataFrame, keys: list[str], order: str = "bar_time") -> DataFrame:
    """bars with index, their place from 1."""
    return bars.withColumn("index", F.row_number().over(Window.partitionBy(*keys).orderBy(order)))


def find(bars: DataFrame, when: Column, keys: list[str]) -> DataFrame:
    """(keys, index) of the first bar exactly at `when`: its rank is one more than the bars before it, so nothing is sorted."""
    return bars.groupBy(*keys).agg((F.count_if(F.col("bar_time") < when) + 1).alias("index"), F.count_if(F.col("bar_time") == when).alias("__hit")).filter("__hit > 0").drop("__hit")


def slice_of(bars: DataFrame, start: Column, end: Column, keys: list[str]) -> DataFrame:
    """(keys, start_index, n) of the bars in [start, end)."""
    t = F.col("bar_time")
    return bars.groupBy(*keys).agg((F.count_if(t < start) + 1).alias("start_index"), F.count_if((t >= start) & (t < end)).alias("n"))


def each(bars: DataFrame, order: str = "bar_time"):
    """Rows in order, fetched a partition at a time."""
    return bars.orderBy(order).toLocalIterator()
