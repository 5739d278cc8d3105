"""Upserts, deletes and other changes to keyed tables, as DataFrames in and out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def last_wins(rows: DataFrame, keys: list[str], order: str = "seq") -> DataFrame:
    """Of rows with one key the last in order. A maximum, not a sort, so a key's rows meet in partial sums."""
    row = F.struct(*rows.columns)
    return rows.groupBy(*(F.col(k).alias(f"__k{i}") for i, k in enumerate(keys))).agg(F.max_by(row, F.col(order)).alias("r")).select("r.*")


def changes(existing: DataFrame, incoming: DataFrame, keys: list[str], values: list[str], order: str = "seq") -> DataFrame:
    """(keys, change): new, changed or unchanged, for each key of incoming, whose last row counts."""
    new = last_wins(incoming, keys, order).select(*keys, F.struct(*values).alias("__n"))
    old = existing.select(*keys, F.struct(*values).alias("__o"))
    change = F.when(F.col("__o").isNull(), "new").when(~F.col("__o").eqNullSafe(F.col("__n")), "changed").otherwise("unchanged")
    return new.join(old, keys, "left").select(*keys, change.alias("change"))


def upsert(existing: DataFrame, incoming: DataFrame, keys: list[str], order: str = "seq", keep_old: list[str] = []) -> DataFrame:  # noqa: B006
    """existing with incoming's rows in place of those of the same key; of keep_old the existing value stays (as with a time of creation)."""
    cols = existing.columns
    new = last_wins(incoming, keys, order).select(*keys, F.struct(*cols).alias("__n"))
    both = existing.select(*keys, F.struct(*cols).alias("__o")).join(new, keys, "full")
    pick = [F.coalesce(F.col(f"__o.{c}"), F.col(f"__n.{c}")) if c in keep_old else F.when(F.col("__n").isNotNull(), F.col(f"__n.{c}")).otherwise(F.col(f"__o.{c}")) for c in cols]
    return both.select(*(p.alias(c) for p, c in zip(pick, cols, strict=True)))


def delete(existing: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return existing.join(gone.select(*keys).distinct(), keys, "left_anti")


def order_audit(rows: DataFrame, keys: list[str], time: str = "bar_time", order: str = "seq") -> DataFrame:
    """(keys, duplicates, disordered): whether times come twice, or out of order, in the order of arrival."""
    before = F.lag(time).over(Window.partitionBy(*keys).orderBy(order))
    return rows.withColumn("__b", before).groupBy(*keys).agg((F.count("*") > F.count_distinct(time)).alias("duplicates"), F.coalesce(F.bool_or(F.col("__b") > F.col(time)), F.lit(False)).alias("disordered"))


#: What a review may say.
GRADES = ("", "A", "B", "C", "D")
BEHAVIORS = ("", "clean_bounce", "weak_bounce", "immediate_break", "choppy", "no_touch", "data_problem")
QUALITIES = ("", "good", "fair", "poor")
MAX_COMMENT = 4000


def valid_review(grade: Column, behavior: Column, quality: Column, comment: Column) -> Column:
    return grade.isin(*GRADES) & behavior.isin(*BEHAVIORS) & quality.isin(*QUALITIES) & (F.coalesce(F.length(comment), F.lit(0)) <= MAX_COMMENT)
