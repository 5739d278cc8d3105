"""Bars: one minute from ticks, longer periods from one-minute bars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.times import epoch_minute, floor_minute, minute_of_day, trading_day
from ..plans.calendar import EVENING, AnySessions
from ..schema import CLOSED, NIGHT
from .ticks import BLOCK, deltas, row_before, running_sums, valid_ticks


def bars_1m(rows: DataFrame, sessions: AnySessions, *, keys: list[str] = ["symbol"], night_rule: str = "session") -> DataFrame:  # noqa: B006
    """One-minute bars of accepted ticks with deltas. Open and close are first and last by arrival, open interest is the last one
    given (else 0). The trading day is the first tick's. night_rule: "session" flags bars from the night's start on, "clock" those
    from 18:00 or before 03:00. Minutes without ticks give no bar. Columns that the sessions ask for stay."""
    first_time = F.min_by("time", "seq")
    minute = minute_of_day(first_time)
    night = minute >= sessions.night_start if night_rule == "session" else (minute >= EVENING) | (minute < 180)
    given = F.min_by("trading_day", "seq") if "trading_day" in rows.columns else None
    out = rows.withColumn("__m", epoch_minute(F.col("time"))).groupBy(*keys, *(c for c in sessions.columns if c not in keys), "__m").agg(
        floor_minute(first_time).alias("bar_time"),
        trading_day(first_time, sessions.night_start, given).alias("trading_day"),
        F.min_by("price", "seq").alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", "seq").alias("close"),
        F.sum("delta_volume").alias("volume"),
        F.sum("delta_turnover").alias("turnover"),
        F.coalesce(F.max_by("open_interest", F.when(F.col("open_interest").isNotNull(), F.col("seq"))), F.lit(0.0)).alias("open_interest"),
        F.lit(0.0).alias("settlement"),
        F.count("*").cast("int").alias("tick_count"),
        (F.lit(CLOSED) + F.when(night, NIGHT).otherwise(0)).cast("int").alias("flags"),
    )
    return out.drop("__m")


def roll_up(bars: DataFrame, minutes: int | Column, sessions: AnySessions, *, keys: list[str] = ["symbol"], by_day: bool = False) -> DataFrame:  # noqa: B006
    """Bars of `minutes` from one-minute bars: a bar ends where the slot of the day changes, and after a segment's last minute.

    Slots have no date, so two days whose bars meet in one slot join, unless by_day. Bars are few (at most 1,440 a symbol and
    day), so one symbol's fit in a task. minutes can be a column that is among the keys; bars of one minute stay as they are.
    """
    w = Window.partitionBy(*keys).orderBy("bar_time")
    minute, n = minute_of_day(F.col("bar_time")), minutes if isinstance(minutes, Column) else F.lit(minutes)
    rows = bars.withColumn("__slot", F.floor(minute / n)).withColumn("__last", sessions.is_last_minute(minute))
    new = (n == 1) | F.lag("__slot").over(w).isNull() | (F.lag("__slot").over(w) != F.col("__slot")) | F.lag("__last").over(w)
    if by_day:
        new = new | (F.lag("trading_day").over(w) != F.col("trading_day"))
    rows = rows.withColumn("__new", new.cast("int")).withColumn("__g", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    flags = F.when(n == 1, F.col("flags")).otherwise(CLOSED) if isinstance(minutes, Column) else F.lit(CLOSED)
    return rows.withColumn("__flags", flags).groupBy(*keys, *(c for c in sessions.columns if c not in keys), "__g").agg(
        F.min("bar_time").alias("bar_time"),
        F.min_by("trading_day", "bar_time").alias("trading_day"),
        F.min_by("open", "bar_time").alias("open"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        F.max_by("close", "bar_time").alias("close"),
        F.sum("volume").alias("volume"),
        F.sum("turnover").alias("turnover"),
        F.max_by("open_interest", "bar_time").alias("open_interest"),
        F.lit(0.0).alias("settlement"),
        F.sum("tick_count").cast("int").alias("tick_count"),
        F.first("__flags").cast("int").alias("flags"),
    ).drop("__g")


def all_periods(ticks: DataFrame, sessions: AnySessions, periods: tuple[int, ...] = (5, 15), **options) -> DataFrame:
    """One-minute bars and each longer period's, told apart by period ("60m", not "1h"). One-minute bars are made once, and a row of each
    goes to every period."""
    one = bars_1m(deltas(valid_ticks(ticks, sessions), **options), sessions)
    rows = one.withColumn("__n", F.explode(F.array(*(F.lit(n) for n in (1, *periods)))))
    rolled = roll_up(rows, F.col("__n"), sessions, keys=["symbol", "__n"])
    return rolled.withColumn("period", F.concat(F.col("__n").cast("string"), F.lit("m"))).drop("__n")


def consecutive_bars(rows: DataFrame, keys: list[str], *, block: int = BLOCK) -> DataFrame:
    """One-minute bars of runs of ticks in the same minute: a minute that comes again later is another bar."""
    m = epoch_minute(F.col("time"))
    rows = row_before(rows.withColumn("__m", m), keys, {"m": F.col("__m")}, "__b", block=block)
    new = (F.col("__b").isNull() | (F.col("__b.m") != F.col("__m"))).cast("int")
    rows = running_sums(rows.withColumn("__n", new).drop("__b"), keys, {"__g": F.col("__n")}, block=block)
    return rows.groupBy(*keys, "__g").agg(floor_minute(F.min_by("time", "seq")).alias("bar_time"), F.min_by("price", "seq").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "seq").alias("close"), F.sum("delta_volume").alias("volume"), F.count("*").alias("tick_count")).withColumnRenamed("__g", "bar_no")


def daily_bars(bars: DataFrame, keys: list[str] = ["symbol"]) -> DataFrame:  # noqa: B006
    """One bar a trading day, from shorter ones."""
    return bars.groupBy(*keys, "trading_day").agg(F.min("bar_time").alias("bar_time"), F.min_by("open", "bar_time").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "bar_time").alias("close"), F.sum("volume").alias("volume"), F.sum("tick_count").alias("tick_count"))
