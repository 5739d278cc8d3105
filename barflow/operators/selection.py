"""Contract statistics, liquidity reasons, and the representative contract of each root."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import aligned, price_bin
from ..functions.times import epoch_minute
from ..plans.config import Limits
from .ticks import verdict_counts


def contract_stats(rows: DataFrame, tick: Column | float, session_minutes: int, keys: list[str], *, morning: Column | None = None) -> DataFrame:
    """One row a contract from its accepted ticks with deltas. Volume, updates, minutes and bins are those of morning ticks with
    volume; deltas, valid and misaligned rows and resets come from all sessions. with_counters adds what was rejected."""
    rows = rows.withColumn("__w", F.lit(True) if morning is None else morning)
    traded = F.col("__w") & (F.col("delta_volume") > 0)
    when = lambda c: F.when(traded, c)
    agg = rows.groupBy(*keys).agg(
        F.coalesce(F.sum(when(F.col("delta_volume"))), F.lit(0)).cast("double").alias("total_volume"),
        F.count_if(traded).alias("nonzero_updates"),
        F.count_distinct(when(epoch_minute(F.col("time")))).alias("active_minutes"),
        F.count_distinct(when(price_bin(F.col("price"), tick))).alias("price_bins"),
        F.count("*").alias("valid_rows"),
        F.count_if(F.exists("quality_flags", lambda f: f.endswith("_RESET"))).alias("resets"),
        F.count_if(~aligned(F.col("price"), tick)).alias("misaligned_rows"),
    )
    return agg.withColumn("coverage", F.round(F.col("active_minutes") / session_minutes, 10))


def with_counters(stats: DataFrame, judged: DataFrame, keys: list[str]) -> DataFrame:
    """stats with filtered_rows (out of session or without a positive price) and backwards_rows, from all ticks of the contracts with
    their verdict in the order session, price, time. A contract of which no tick is accepted has zeros elsewhere."""
    counts = verdict_counts(judged, keys).select(*keys, (F.col("filtered_rows") + F.col("bad_price_rows")).alias("filtered_rows"), "backwards_rows")
    return counts.join(stats, keys, "left").fillna(0)


def reasons(limits: Limits) -> Column:
    """What speaks against a contract, in fixed order; empty if nothing does."""
    tests = [("volume", F.col("total_volume") < limits.volume), ("nonzero_updates", F.col("nonzero_updates") < limits.nonzero_updates), ("active_minute_coverage", F.col("coverage") < limits.coverage), ("price_bins", F.col("price_bins") < limits.bins), ("backwards_ticks", F.col("backwards_rows") > limits.backwards), ("tick_alignment", F.col("misaligned_rows") > limits.misaligned)]
    return F.array_compact(F.array(*(F.when(test, name) for name, test in tests)))


def representative(stats: DataFrame, roots: DataFrame, limits: Limits, *, root: str = "root", source: str = "source_file", day: str | None = None) -> DataFrame:
    """Each root's contract (of each day in stats, if day names its column) with the largest volume, then most updates, then last source
    name; roots without one say no_source_file. selected: nothing speaks against it. roots: a dimension of a few dozen rows."""
    keys = [root] if day is None else [day, root]
    best = Window.partitionBy(*keys).orderBy(F.desc("total_volume"), F.desc("nonzero_updates"), F.desc(source))
    top = stats.withColumn("__n", F.row_number().over(best)).filter("__n = 1").drop("__n").withColumn("reasons", reasons(limits))
    if day is not None:
        # a few dozen roots on each day
        roots = stats.select(day).distinct().crossJoin(F.broadcast(roots))
    out = roots.join(top, keys, "left").withColumn("reasons", F.coalesce("reasons", F.array(F.lit("no_source_file"))))
    return out.withColumn("selected", F.size("reasons") == 0).orderBy(*keys)
