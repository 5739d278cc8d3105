"""Live bars: a batch of a symbol's ticks is taken as a slice of arrays, and state holds only what the next batch needs.

Verdicts are a running maximum, deltas differences, and bars sums over groups of rows: of ticks by minute, of minutes by the slot of a longer
period. What is still open is one bar, which comes first in the next slice as a row like the others. The final rows equal those of the
batch operators for the same ticks; only the moment differs in which they come.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.times import epoch_micros
from ..plans.calendar import DAY_MINUTES, Sessions
from ..schema import CLOSED, NIGHT

#: A bar as it is summed up: place (minute since 1970 of its first row), then what a bar has.
BAR_FIELDS = {"place": np.int64, "trading_day": np.int64, "open": float, "high": float, "low": float, "close": float, "volume": float, "turnover": float, "open_interest": float, "tick_count": np.int64, "flags": np.int64}
_DDL = ", ".join(f"{c} {'double' if k is float else 'long'}" for c, k in BAR_FIELDS.items())
OUTPUT = f"symbol string, period string, {_DDL}"
#: What live_bars gives.
COLUMNS = ["symbol", "period", "bar_time", "trading_day", "open", "high", "low", "close", "volume", "turnover", "open_interest", "tick_count", "flags"]
_STORE, _ROCKS = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

Bars = dict[str, np.ndarray]


def day_numbers(days: np.ndarray) -> np.ndarray:
    """Days since 1970 as YYYYMMDD."""
    date = days.astype("M8[D]")
    month = date.astype("M8[M]")
    return (date.astype("M8[Y]").astype(np.int64) + 1970) * 10000 + (month.astype(np.int64) % 12 + 1) * 100 + (date - month).astype(np.int64) + 1


def fold(rows: Bars, starts: np.ndarray) -> Bars:
    """One bar for each group of neighbouring rows; starts are the places where groups begin."""
    if not len(starts):
        return {c: v[:0] for c, v in rows.items()}
    n = len(rows["place"])
    last = np.append(starts[1:], n) - 1
    given = np.maximum.reduceat(np.where(np.isnan(rows["open_interest"]), -1, np.arange(n)), starts)
    out = {c: rows[c][starts] for c in ("place", "trading_day", "open", "flags")}
    out |= {c: np.add.reduceat(rows[c], starts) for c in ("volume", "turnover", "tick_count")}
    return out | {"high": np.maximum.reduceat(rows["high"], starts), "low": np.minimum.reduceat(rows["low"], starts), "close": rows["close"][last], "open_interest": np.where(given >= starts, rows["open_interest"][given], np.nan)}


def joined(a: Bars | None, b: Bars) -> Bars:
    return b if a is None else {c: np.concatenate([a[c], b[c]]) for c in BAR_FIELDS}


def part(rows: Bars, which: slice | np.ndarray) -> Bars:
    return {c: v[which] for c, v in rows.items()}


class Slices:
    """What is open of one symbol: the last accepted tick (microseconds, volume, turnover), the open minute, and the open bar of each longer period."""

    def __init__(self, sessions: Sessions, periods: tuple[int, ...], last: tuple[int, float, float] | None = None, minute: Bars | None = None, longer: dict[int, Bars] | None = None):
        self.sessions, self.periods = sessions, periods
        self.inside = np.array([sessions.holds(m) for m in range(DAY_MINUTES)])
        self.ends = self.inside & ~np.roll(self.inside, -1)
        self.last, self.minute, self.longer = last, minute, dict(longer or {})

    def take(self, us: np.ndarray, price: np.ndarray, volume: np.ndarray, turnover: np.ndarray, open_interest: np.ndarray, given_day: np.ndarray) -> Iterator[tuple[int, Bars]]:
        """(minutes, bars) that these ticks close, in order of arrival; missing values are NaN."""
        minute = us // 60_000_000
        good = (price > 0) & self.inside[minute % DAY_MINUTES]
        least = np.iinfo(np.int64).min if self.last is None else self.last[0]
        before = np.maximum.accumulate(np.concatenate([[least], np.where(good, us, least)[:-1]])) if len(us) else us
        ok = np.flatnonzero(good & (us >= before))
        if not len(ok):
            return
        us, price, minute, open_interest, given_day = (x[ok] for x in (us, price, minute, open_interest, given_day))
        grown = []
        for k, total in ((1, volume), (2, turnover)):
            total = np.nan_to_num(total[ok])
            grown.append((np.maximum(np.diff(total, prepend=total[0] if self.last is None else self.last[k]), 0), float(total[-1])))
        self.last = (int(us[-1]), grown[0][1], grown[1][1])
        rows = {"place": minute, "trading_day": np.where(np.isnan(given_day), self.days(minute), np.nan_to_num(given_day)).astype(np.int64), "open": price, "high": price, "low": price, "close": price}
        night = minute % DAY_MINUTES >= self.sessions.night_start
        rows |= {"volume": grown[0][0], "turnover": grown[1][0], "open_interest": open_interest, "tick_count": np.ones(len(us), np.int64), "flags": np.where(night, NIGHT, 0)}
        rows = joined(self.minute, rows)
        bars = fold(rows, np.flatnonzero(np.diff(rows["place"], prepend=rows["place"][0] - 1)))
        self.minute = part(bars, slice(-1, None))
        yield from self._closed(part(bars, slice(0, -1)))

    def days(self, minute: np.ndarray) -> np.ndarray:
        """Trading days of minutes since 1970: at night the next one that is no weekend."""
        day = minute // DAY_MINUTES
        weekday = (day + 3) % 7
        ahead = np.select([weekday == 4, weekday == 5], [3, 2], 1)
        return day_numbers(day + np.where(minute % DAY_MINUTES >= self.sessions.night_start, ahead, 0))

    def _closed(self, bars: Bars) -> Iterator[tuple[int, Bars]]:
        """Minutes that have ended, and what they end of longer periods."""
        if not len(bars["place"]):
            return
        bars |= {"flags": bars["flags"] | CLOSED, "open_interest": np.nan_to_num(bars["open_interest"])}
        yield 1, bars
        for n in self.periods:
            held = self.longer.pop(n, None)
            rows = joined(held, bars)
            slot, ends = rows["place"] % DAY_MINUTES // n, self.ends[rows["place"] % DAY_MINUTES]
            if held is not None:
                ends[0] = False  # else it would not be open
            new = np.concatenate([[True], (np.diff(slot) != 0) | ends[:-1]])
            whole = fold(rows, np.flatnonzero(new)) | {"flags": np.full(int(new.sum()), CLOSED)}
            if not ends[-1]:
                self.longer[n] = part(whole, slice(-1, None))
                whole = part(whole, slice(0, -1))
            if len(whole["place"]):
                yield n, whole

    def close_minute(self) -> Iterator[tuple[int, Bars]]:
        bars, self.minute = self.minute, None
        if bars is not None:
            yield from self._closed(bars)

    def flush(self) -> Iterator[tuple[int, Bars]]:
        """Everything that is open."""
        yield from self.close_minute()
        yield from sorted(self.longer.items())
        self.longer = {}

    def segment_end(self) -> int | None:
        """Milliseconds since 1970 at which the open minute's segment ends."""
        if self.minute is None or self.inside.all():
            return None
        place = int(self.minute["place"][0])
        return (place + 1 + int(np.argmin(np.roll(self.inside, -(place + 1) % DAY_MINUTES)))) * 60_000


class Processor(StatefulProcessor):
    """State of a symbol as typed values, and a timer at the end of the open minute's segment."""

    def __init__(self, sessions: Sessions, periods: tuple[int, ...]):
        self.sessions, self.periods = sessions, periods

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "us long, volume double, turnover double")
        self.minute = handle.getValueState("minute", _DDL)
        self.longer = handle.getMapState("longer", "minutes int", _DDL)

    def _read(self) -> Slices:
        bar = lambda row: {c: np.array([v], k) for (c, k), v in zip(BAR_FIELDS.items(), row, strict=True)}
        return Slices(self.sessions, self.periods, self.last.get() if self.last.exists() else None, bar(self.minute.get()) if self.minute.exists() else None, {k[0]: bar(v) for k, v in self.longer.iterator()} if self.longer.exists() else None)

    def _write(self, own: Slices) -> None:
        row = lambda bars: tuple(bars[c][0].item() for c in BAR_FIELDS)
        if own.last is not None:
            self.last.update(own.last)
        self.minute.clear() if own.minute is None else self.minute.update(row(own.minute))
        self.longer.clear()
        for n, bars in own.longer.items():
            self.longer.updateValue((n,), row(bars))
        due, end = set(self.handle.listTimers()), own.segment_end()
        for t in due - {end}:
            self.handle.deleteTimer(t)
        if end is not None and end not in due:
            self.handle.registerTimer(end)

    @staticmethod
    def _frame(key: tuple, out: list[tuple[int, Bars]]) -> Iterator:
        import pandas as pd  # only in tasks

        for n, bars in out:
            yield pd.DataFrame({"symbol": key[0], "period": f"{n}m", **{c: bars[c] for c in BAR_FIELDS}})

    def handleInputRows(self, key, rows, timerValues):
        import pandas as pd

        own, out = self._read(), []
        ticks = pd.concat(list(rows)).sort_values("seq", kind="stable")
        flush = ticks["flush"].to_numpy(bool)
        columns = [ticks["us"].to_numpy(np.int64)] + [ticks[c].to_numpy(float, na_value=np.nan) for c in ("price", "volume", "turnover", "open_interest", "trading_day")]
        at = 0
        for end in [*np.flatnonzero(flush).tolist(), len(ticks)]:
            out += own.take(*(c[at:end] for c in columns))
            if end < len(ticks):
                out += own.flush()
            at = end + 1
        self._write(own)
        yield from self._frame(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        own, out = self._read(), []
        end = own.segment_end()
        if end is not None and end <= expiredTimerInfo.getExpiryTimeInMs():
            out += own.close_minute()
            self._write(own)
        yield from self._frame(key, out)


def live_bars(ticks: DataFrame, sessions: Sessions, periods: tuple[int, ...] = (5, 15), *, delay: str = "1 hour") -> DataFrame:
    """Closed bars (COLUMNS) of a stream of ticks: symbol, seq, time (TIMESTAMP_NTZ at the exchange) or seconds (since 1970 there), price, cumulative volume
    and turnover, open_interest; and, if they are there, trading_day, which is taken as given, and flush.

    Within a batch a symbol's ticks are taken in order of seq; later batches come after it. A tick before the last accepted one is dropped. A minute closes
    with the symbol's next accepted tick of a later minute, or when the stream's time, `delay` behind the latest row, has passed the end of its
    segment; longer bars close as roll_up has them end. A row without price moves time and nothing else, so a source that falls silent can send one.
    A row with flush = true closes what is open of its symbol. Rows behind the stream's time are dropped by Spark as late: delay must be as long as
    symbols may lie apart.

    State is typed values of a symbol's open bars, in RocksDB, which the session is set to use unless it names another store. A task holds one symbol's ticks
    of a batch, whose size the source's limits set. Output mode: append.
    """
    spark = ticks.sparkSession
    if not spark.conf.get(_STORE).endswith("RocksDBStateStoreProvider"):
        spark.conf.set(_STORE, _ROCKS)
    us = F.round(F.col("seconds") * 1_000_000).cast("long") if "seconds" in ticks.columns else epoch_micros(F.col("time"))
    more = {c: F.col(c).cast(k) if c in ticks.columns else F.lit(None).cast(k) for c, k in (("trading_day", "double"), ("flush", "boolean"))}
    rows = ticks.select("symbol", "seq", us.alias("us"), *(F.col(c).cast("double").alias(c) for c in ("price", "volume", "turnover", "open_interest")), more["trading_day"].alias("trading_day"), F.coalesce(more["flush"], F.lit(False)).alias("flush"))
    timed = rows.withColumn("at", F.timestamp_micros("us")).withWatermark("at", delay)
    bars = timed.groupBy("symbol").transformWithStateInPandas(Processor(sessions, tuple(periods)), OUTPUT, "append", "eventtime")
    time = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(mins=F.col("place").cast("int"))
    ints = {c: F.col(c).cast("int") for c in ("trading_day", "tick_count", "flags")}
    return bars.withColumns({"bar_time": time, **ints}).select(*COLUMNS)
