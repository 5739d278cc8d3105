"""Times and dates at the exchange, as column expressions. A time is a TIMESTAMP_NTZ in exchange time; ms are Unix milliseconds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import EXCHANGE_MS


def of_ms(ms: Column, offset_ms: int = EXCHANGE_MS) -> Column:
    """Exchange time of Unix milliseconds."""
    return (F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")) + F.make_dt_interval(secs=((ms + offset_ms) / 1000).cast("decimal(18,6)"))


def to_ms(time: Column, offset_ms: int = EXCHANGE_MS) -> Column:
    return epoch_micros(time) / 1000 - offset_ms


def epoch_micros(time: Column) -> Column:
    """Microseconds since 1970 of a time taken as UTC: independent of the session's zone."""
    days = F.datediff(time.cast("date"), F.lit("1970-01-01").cast("date")).cast("bigint")
    return ((days * 24 + F.hour(time)) * 60 + F.minute(time)) * 60_000_000 + (F.extract(F.lit("SECOND"), time) * 1_000_000).cast("bigint")


def epoch_minute(time: Column) -> Column:
    days = F.datediff(time.cast("date"), F.lit("1970-01-01").cast("date")).cast("bigint")
    return days * 1440 + F.hour(time) * 60 + F.minute(time)


def minute_of_day(time: Column) -> Column:
    return F.hour(time) * 60 + F.minute(time)


def floor_minute(time: Column) -> Column:
    return F.date_trunc("minute", time)


def ms_text(ms: Column) -> Column:
    return F.date_format(of_ms(ms), "yyyy-MM-dd HH:mm:ss")


def text_ms(text: Column) -> Column:
    """Null where the text holds no time."""
    return to_ms(F.try_to_timestamp(F.regexp_extract(text, r"\d{4}-\d\d-\d\d \d\d:\d\d:\d\d", 0), F.lit("yyyy-MM-dd HH:mm:ss")).cast("timestamp_ntz"))


def day_number(date: Column) -> Column:
    """A date as the number YYYYMMDD."""
    return F.year(date) * 10000 + F.month(date) * 100 + F.dayofmonth(date)


def valid_day(text: Column) -> Column:
    """Whether the text is eight digits and a date of the calendar."""
    return text.rlike(r"^\d{8}$") & F.try_to_timestamp(text, F.lit("yyyyMMdd")).isNotNull()


def next_trading_day(date: Column) -> Column:
    """The first day after date that is neither Saturday nor Sunday."""
    return F.date_add(date, F.when(F.weekday(date) == 4, 3).when(F.weekday(date) == 5, 2).otherwise(1))


def weekday_from(date: Column) -> Column:
    """date itself, or the Monday after it if it is a Saturday or Sunday."""
    return F.date_add(date, F.when(F.weekday(date) == 5, 2).when(F.weekday(date) == 6, 1).otherwise(0))


def trading_day(time: Column, night_start: int, given: Column | None = None) -> Column:
    """As YYYYMMDD: the given one; else from night_start on the next trading day, before it the day itself."""
    own = day_number(F.when(minute_of_day(time) >= night_start, next_trading_day(time.cast("date"))).otherwise(time.cast("date")))
    return own if given is None else F.coalesce(given, own)


def source_time(trading_day: Column, clock: Column, millis: Column) -> Column:
    """Time of a source row: evenings (from 18:00) belong to the natural day before the trading day. trading_day: yyyyMMdd text."""
    day = F.to_date(trading_day, "yyyyMMdd")
    day = F.when(F.substring(clock, 1, 2).cast("int") >= 18, F.date_sub(day, 1)).otherwise(day)
    text = F.concat_ws(" ", F.date_format(day, "yyyy-MM-dd"), clock)
    return F.concat(text, F.lit("."), F.lpad(F.coalesce(millis.cast("string"), F.lit("0")), 3, "0")).cast("timestamp_ntz")


def millis_of_day(clock: Column, millis: Column) -> Column:
    p = F.split(clock, ":")
    return ((p[0].cast("int") * 60 + p[1].cast("int")) * 60 + p[2].cast("int")) * 1000 + F.coalesce(F.nullif(millis.cast("string"), F.lit("")).cast("int"), F.lit(0))


def minute_key(text: Column) -> Column:
    return F.substring(text, 1, 16)


def simple_time(text: Column) -> Column:
    """`YYYY-MM-DD HH:MM:SS` with one to three decimals or none; null for anything else."""
    good = text.rlike(r"^\d{4}-\d\d-\d\d \d\d:\d\d:\d\d(\.\d{1,3})?$")
    return F.when(good, text.try_cast("timestamp_ntz"))


def event_time(text: Column) -> Column:
    """`YYYY-MM-DD HH:MM:SS` with up to six decimals or none, as a review or chart row has it; null for anything else."""
    return F.when(text.rlike(r"^\d{4}-\d\d-\d\d \d\d:\d\d:\d\d(\.\d{1,6})?$"), text.try_cast("timestamp_ntz"))


def start_label(end: Column, minutes: int) -> Column:
    return end - F.make_dt_interval(mins=F.lit(minutes))
