"""Tick filters, cumulative-to-delta conversion and quality flags.

Ticks have symbol, seq (order of arrival), time, price, and cumulative volume and turnover. Order-dependent steps are prefix scans:
ticks of a symbol are cut into blocks of seq, windows run within a block, and one small table a block carries the state over. So a
symbol with a third of all ticks is not one task's work.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import clamped_delta
from ..functions.times import minute_of_day
from ..plans.calendar import AnySessions

#: Seq numbers of a block.
BLOCK = 1 << 20


def _blocked(df: DataFrame, block: int) -> DataFrame:
    return df.withColumn("__blk", F.floor(F.col("seq") / block))


def _carried(df: DataFrame, keys: list[str], state: Column, combine) -> DataFrame:
    """(keys, __blk, __carry): what the blocks before give. One row a block."""
    per = df.groupBy(*keys, "__blk").agg(state.alias("__state"))
    before = Window.partitionBy(*keys).orderBy("__blk")
    return per.select(*keys, "__blk", combine(F.col("__state"), before).alias("__carry"))


def running_sums(rows: DataFrame, keys: list[str], values: dict[str, Column], *, block: int = BLOCK) -> DataFrame:
    """rows with the sums of values over a key's rows up to and with each, in order of seq."""
    rows = _blocked(rows, block)
    carry = _carried(rows, keys, F.struct(*(F.sum(v).alias(n) for n, v in values.items())), lambda s, w: F.struct(*(F.sum(s[n]).over(w.rowsBetween(Window.unboundedPreceding, -1)).alias(n) for n in values)))
    inner = Window.partitionBy(*keys, "__blk").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({n: F.sum(v).over(inner) for n, v in values.items()}).join(carry, [*keys, "__blk"], "left")
    return rows.withColumns({n: F.col(n) + F.coalesce(F.col("__carry")[n], F.lit(0)) for n in values}).drop("__blk", "__carry")


def row_before(rows: DataFrame, keys: list[str], fields: dict[str, Column], name: str, *, block: int = BLOCK) -> DataFrame:
    """rows with a struct of the fields of the key's row before, in order of seq; null for the first."""
    rows = _blocked(rows, block)
    own = F.struct("seq", *(v.alias(n) for n, v in fields.items()))
    carry = _carried(rows, keys, F.max(own), lambda s, w: F.lag(s).over(w))
    inner = Window.partitionBy(*keys, "__blk").orderBy("seq")
    return rows.withColumn(name, F.lag(own).over(inner)).join(carry, [*keys, "__blk"], "left").withColumn(name, F.coalesce(name, "__carry")).drop("__blk", "__carry")


def with_verdict(ticks: DataFrame, sessions: AnySessions, *, order: tuple[str, ...] = ("price", "time", "session"), keys: list[str] = ["symbol"], block: int = BLOCK) -> DataFrame:  # noqa: B006
    """ticks with verdict: valid, or the first check in `order` that fails: price (null or not positive), time (before the last
    accepted tick's), session. Equal times are fine; rejected ticks do not move the baseline."""
    good = F.coalesce(F.col("price") > 0, F.lit(False)) & sessions.contains(minute_of_day(F.col("time")))
    rows = _blocked(ticks, block)
    candidate = F.when(good, F.col("time"))
    inner = F.max(candidate).over(Window.partitionBy(*keys, "__blk").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1))
    carry = _carried(rows, keys, F.max(candidate), lambda s, w: F.max(s).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    rows = rows.withColumn("__inner", inner).join(carry, [*keys, "__blk"], "left")
    fails = {
        "price": ~F.coalesce(F.col("price") > 0, F.lit(False)),
        "time": F.coalesce(F.col("time") < F.greatest("__inner", "__carry"), F.lit(False)),
        "session": ~sessions.contains(minute_of_day(F.col("time"))),
    }
    verdict = F.lit("valid")
    for check in reversed(order):
        verdict = F.when(fails[check], check).otherwise(verdict)
    return rows.withColumn("verdict", verdict).drop("__blk", "__inner", "__carry")


def valid_ticks(ticks: DataFrame, sessions: AnySessions, **options) -> DataFrame:
    """Ticks with positive price, in session, and not before the last accepted one."""
    return with_verdict(ticks, sessions, **options).filter("verdict = 'valid'").drop("verdict")


def verdict_counts(judged: DataFrame, keys: list[str] = ["symbol"]) -> DataFrame:  # noqa: B006
    count = lambda v: F.count_if(F.col("verdict") == v)
    return judged.groupBy(*keys).agg(F.count("*").alias("rows"), count("valid").alias("valid_rows"), count("session").alias("filtered_rows"), count("price").alias("bad_price_rows"), count("time").alias("backwards_rows"))


def deltas(ticks: DataFrame, *, keys: list[str] = ["symbol"], max_gap_ms: int = 10_000, block: int = BLOCK) -> DataFrame:  # noqa: B006
    """Accepted ticks with delta_volume, delta_turnover, gap_millis and quality_flags.

    Missing cumulative values count as 0. The first tick of a key has deltas of 0; a value below its predecessor is a reset, gives 0
    and is the new baseline. keys: ["symbol"] goes on across days, ["symbol", "day"] starts anew each day.
    """
    rows = _blocked(ticks.withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in ("volume", "turnover")}), block)
    own = F.struct("seq", "volume", "turnover", "time")
    w = Window.partitionBy(*keys, "__blk").orderBy("seq")
    carry = _carried(rows, keys, F.max(own), lambda s, win: F.lag(s).over(win))
    rows = rows.withColumn("__inner", F.lag(own).over(w)).join(carry, [*keys, "__blk"], "left").withColumn("__p", F.coalesce("__inner", "__carry"))
    gap = F.coalesce((F.unix_micros(F.col("time").cast("timestamp")) - F.unix_micros(F.col("__p.time").cast("timestamp"))) / 1000, F.lit(0)).cast("bigint")
    rows = rows.withColumns({"delta_volume": clamped_delta(F.col("volume"), F.col("__p.volume")), "delta_turnover": clamped_delta(F.col("turnover"), F.col("__p.turnover")), "gap_millis": gap})
    flags = F.array_compact(F.array(F.when(F.col("volume") < F.col("__p.volume"), "VOLUME_RESET"), F.when(F.col("turnover") < F.col("__p.turnover"), "TURNOVER_RESET"), F.when(F.col("gap_millis") > max_gap_ms, "LONG_GAP")))
    return rows.withColumn("quality_flags", flags).drop("__blk", "__inner", "__carry", "__p")


def session_vwap(rows: DataFrame, keys: list[str], *, block: int = BLOCK) -> DataFrame:
    """Running sum of price times delta over the running sum of deltas, on rows that have volume. keys: those of one session."""
    sums = {"__pv": F.col("price") * F.col("delta_volume"), "__v": F.col("delta_volume")}
    return running_sums(rows.filter("delta_volume > 0"), keys, sums, block=block).withColumn("vwap", F.col("__pv") / F.col("__v")).drop(*sums)


def relevant_ticks(rows: DataFrame, keys: list[str], *, block: int = BLOCK) -> DataFrame:
    """The first tick, and those with another price than the tick before or with volume."""
    rows = row_before(rows, keys, {"price": F.col("price")}, "__b", block=block)
    return rows.filter(F.col("__b").isNull() | (F.col("price") != F.col("__b.price")) | (F.col("delta_volume") > 0)).drop("__b")


def checked(rows: DataFrame, numeric: list[str], where: str = "row") -> DataFrame:
    """rows with the columns as doubles; anything that is no finite number raises, naming the row."""
    out = rows
    for c in numeric:
        x = F.col(c).try_cast("double")
        bad = x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
        out = out.withColumn(c, F.when(bad, F.raise_error(F.concat(F.lit(f"{c} is not finite at {where} "), F.coalesce(F.col("seq").cast("string"), F.lit("?"))))).otherwise(x))
    return out
