"""Trading sessions and trading days: parsed at the driver, used as expressions or small dimensions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

DAY_MINUTES = 1440
#: From this minute of the day on a session that begins is a night session.
EVENING = 18 * 60
#: Session texts by kind of contract.
DAY = "09:00-10:15,10:30-11:30,13:30-15:00"
NIGHT_2300 = "21:00-23:00," + DAY
NIGHT_0230 = "21:00-02:30," + DAY
STOCK_INDEX = "09:30-11:30,13:00-15:00"


def parse_clock(text: str) -> int:
    """Minute of the day of HH:MM; anything else raises."""
    h, colon, m = text.strip().partition(":")
    if not (colon and len(h) == len(m) == 2 and h.isdigit() and m.isdigit() and int(h) < 24 and int(m) < 60):
        raise ValueError(f"no clock time: {text!r}")
    return int(h) * 60 + int(m)


@dataclass(frozen=True)
class Sessions:
    """Segments [start, end) in minutes of the day; one whose start is after its end goes past midnight."""

    segments: tuple[tuple[int, int], ...]
    #: Columns that rows must have for these sessions: none, they are the same for all rows.
    columns = ()

    @staticmethod
    def parse(text: str) -> Sessions:
        out = []
        for part in filter(None, (p.strip() for p in text.split(","))):
            start, dash, end = part.partition("-")
            if not dash:
                raise ValueError(f"no session: {part!r}")
            out.append((parse_clock(start), parse_clock(end)))
        return Sessions(tuple(out))

    def holds(self, minute: int) -> bool:
        return any(s <= minute < e if s <= e else minute >= s or minute < e for s, e in self.segments)

    def is_last(self, minute: int) -> bool:
        return self.holds(minute) and not self.holds((minute + 1) % DAY_MINUTES)

    @property
    def night_start(self) -> int:
        """First minute of the night; past the day's end if there is none."""
        return min((s for s, _ in self.segments if s >= EVENING), default=DAY_MINUTES)

    @property
    def day_close(self) -> int | None:
        return max((e for s, e in self.segments if s < EVENING and s <= e), default=None)

    @property
    def minutes(self) -> int:
        return sum((e - s) % DAY_MINUTES for s, e in self.segments)

    @property
    def morning_minutes(self) -> int:
        return Sessions(tuple(s for s in self.segments if s[0] < 12 * 60)).minutes

    def contains(self, minute: Column) -> Column:
        """Comparisons with literals: no join, and part of generated code."""
        out = F.lit(False)
        for s, e in self.segments:
            out = out | (((minute >= s) & (minute < e)) if s <= e else ((minute >= s) | (minute < e)))
        return out

    def is_last_minute(self, minute: Column) -> Column:
        last = [m for m in range(DAY_MINUTES) if self.is_last(m)]
        return minute.isin(last) if last else F.lit(False)

    def is_day_close(self, minute: Column) -> Column:
        return minute + 1 == F.lit(self.day_close)

    def label(self, minute: Column) -> Column:
        """morning or afternoon by noon; null out of session, and at night."""
        return F.when(self.contains(minute) & (minute < EVENING), F.when(minute < 12 * 60, "morning").otherwise("afternoon"))


@dataclass(frozen=True)
class RowSessions:
    """Sessions that a column of each row names: what takes Sessions takes these too, so contracts of all kinds go through one plan.

    Each question is a choice among the kinds' comparisons, in generated code; nothing is joined. A name that is in no table has the default's
    sessions; without a default it raises. any_case: a name that is not there as written is looked up in capitals first. zones: a kind's time zone (see
    `local`).
    """

    column: str
    tables: tuple[tuple[str, Sessions], ...]
    default: Sessions | None = None
    any_case: bool = False
    zones: tuple[tuple[str, str], ...] = ()

    @staticmethod
    def by(column: str, tables: dict[str, Sessions], default: Sessions | None = None, *, any_case: bool = False, zones: dict[str, str] | None = None) -> RowSessions:
        return RowSessions(column, tuple(sorted(tables.items())), default, any_case, tuple(sorted((zones or {}).items())))

    @property
    def columns(self) -> tuple[str, ...]:
        return (self.column,)

    def _choose(self, answer: Callable[[Sessions], Column], kind: str) -> Column:
        name = F.col(self.column)
        # names with the same sessions are asked about together
        same: dict[Sessions, list[str]] = {}
        for k, s in self.tables:
            same.setdefault(s, []).append(k)
        out = None
        for form in (name, F.upper(name)) if self.any_case else (name,):
            for s, names in same.items():
                out = (F if out is None else out).when(form.isin(names), answer(s))
        unknown = F.raise_error(F.concat(F.lit("no sessions known for "), F.coalesce(name.cast("string"), F.lit("null")))).cast(kind) if self.default is None else answer(self.default)
        return unknown if out is None else out.otherwise(unknown)

    def contains(self, minute: Column) -> Column:
        return self._choose(lambda s: s.contains(minute), "boolean")

    def is_last_minute(self, minute: Column) -> Column:
        return self._choose(lambda s: s.is_last_minute(minute), "boolean")

    def is_day_close(self, minute: Column) -> Column:
        return self._choose(lambda s: s.is_day_close(minute), "boolean")

    def label(self, minute: Column) -> Column:
        return self._choose(lambda s: s.label(minute), "string")

    @property
    def night_start(self) -> Column:
        return self._choose(lambda s: F.lit(s.night_start), "int")

    @property
    def minutes(self) -> Column:
        return self._choose(lambda s: F.lit(s.minutes), "int")

    @property
    def morning_minutes(self) -> Column:
        return self._choose(lambda s: F.lit(s.morning_minutes), "int")

    def local(self, instant: Column, zone: str = "Asia/Shanghai") -> Column:
        """The exchange's clock at a time given in UTC (TIMESTAMP_NTZ): in the zone of the row's kind, else in `zone`."""
        own = F.lit(zone)
        for k, z in self.zones:
            own = F.when(F.col(self.column) == k, z).otherwise(own)
        return F.convert_timezone(F.lit("UTC"), own, instant)


#: What functions over rows take: sessions for all, or by row.
AnySessions = Sessions | RowSessions


def minute_dimension(spark: SparkSession, tables: dict[str, Sessions]) -> DataFrame:
    """(root, minute, in_session, is_last) with 1,440 rows a root: turns the range join with sessions into an equi-join."""
    parts = [spark.range(DAY_MINUTES).select(F.lit(root).alias("root"), F.col("id").cast("int").alias("minute"), s.contains(F.col("id")).alias("in_session"), s.is_last_minute(F.col("id")).alias("is_last")) for root, s in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def session_for(root: str, tables: dict[str, Sessions], default: Sessions) -> Sessions:
    """The root's sessions: as written, else in capitals, else the default."""
    return tables.get(root) or tables.get(root.upper()) or default


def day_map(trade_dates: DataFrame, first: str, last: str) -> DataFrame:
    """(date, day_session, night_session) for each calendar day: the first trade date from that day on, and the first after it.
    Null past the calendar's end. trade_dates: a column trade_date. A calendar has some hundred rows a year."""
    spark = trade_dates.sparkSession
    dense = spark.sql(f"SELECT explode(sequence(date'{first}', date'{last}', interval 1 day)) AS date")
    own = trade_dates.select(F.col("trade_date").cast("date").alias("date")).distinct().withColumn("td", F.col("date"))
    year = F.lit(0)
    ahead = Window.partitionBy(year).orderBy("date")
    return dense.join(F.broadcast(own), "date", "left").select(
        "date",
        F.first("td", ignorenulls=True).over(ahead.rowsBetween(0, Window.unboundedFollowing)).alias("day_session"),
        F.first("td", ignorenulls=True).over(ahead.rowsBetween(1, Window.unboundedFollowing)).alias("night_session"),
    )
