"""External minute bars as canonical bars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.times import day_number, minute_of_day, start_label, weekday_from
from ..plans.calendar import EVENING
from ..schema import CLOSED, NIGHT

#: Before this minute of the day a bar still belongs to the night.
MORNING = 8 * 60


def calendar_day(time: Column, days: DataFrame | None, rows: DataFrame) -> DataFrame:
    """rows with trading_day. With days (date, day_session, night_session) a bar of the evening belongs to the first trade date after
    its day, any other to the first from its day on, and a day past the calendar raises. Without, weekends go to Monday."""
    evening = minute_of_day(time) >= EVENING
    date = time.cast("date")
    if days is None:
        own = weekday_from(F.when(evening, F.date_add(date, 1)).otherwise(date))
        return rows.withColumn("trading_day", day_number(own))
    both = rows.withColumn("date", date).join(F.broadcast(days), "date", "left")
    own = F.when(evening, F.col("night_session")).otherwise(F.col("day_session"))
    own = F.when(own.isNull(), F.raise_error(F.concat(F.lit("past the calendar: "), time.cast("string")))).otherwise(own)
    return both.withColumn("trading_day", day_number(own)).drop("date", "day_session", "night_session")


def consistent() -> Column:
    """Whether a bar's prices fit together: high and low bound the others, prices are positive, volumes are not negative, on the minute."""
    return (F.col("high") >= F.greatest("open", "close", "low")) & (F.col("low") <= F.least("open", "close", "high")) & (F.least("open", "high", "low", "close") > 0) & (F.col("volume") >= 0) & (F.col("hold") >= 0) & (F.second("datetime") == 0)


def canonical(raw: DataFrame, symbol: str, minutes: int, *, days: DataFrame | None = None, label: str = "end") -> DataFrame:
    """Canonical bars of external ones (text columns datetime, open, high, low, close, volume, hold). label "end" moves times to the
    bar's start. Times that come twice, numbers of wrong form and prices that do not fit raise. Not provided means 0."""
    number = lambda c: F.coalesce(F.col(c).try_cast("double"), F.raise_error(F.concat(F.lit(f"bad {c} at "), F.col("datetime").cast("string"))).cast("double")).alias(c)
    rows = raw.select(F.col("datetime").cast("timestamp_ntz").alias("datetime"), *(number(c) for c in ("open", "high", "low", "close", "volume", "hold")))
    rows = rows.filter(F.when(consistent(), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("inconsistent bar at "), F.col("datetime").cast("string")))))
    rows = rows.withColumn("__n", F.count("*").over(Window.partitionBy("datetime")))
    rows = rows.filter(F.when(F.col("__n") > 1, F.raise_error(F.concat(F.lit("duplicate bar at "), F.col("datetime").cast("string")))).otherwise(F.lit(True)))
    start = start_label(F.col("datetime"), minutes) if label == "end" else F.col("datetime")
    rows = rows.withColumn("bar_time", start)
    minute = minute_of_day(F.col("bar_time"))
    night = (minute >= EVENING) | (minute < MORNING)
    out = calendar_day(F.col("bar_time"), days, rows)
    zero = F.lit(0.0)
    return out.select(F.lit(symbol).alias("symbol"), F.lit(f"{minutes}m").alias("period"), "bar_time", "trading_day", "open", "high", "low", "close", "volume", zero.alias("turnover"), F.col("hold").alias("open_interest"), zero.alias("settlement"), F.lit(0).alias("tick_count"), (F.lit(CLOSED) + F.when(night, NIGHT).otherwise(0)).alias("flags"))
