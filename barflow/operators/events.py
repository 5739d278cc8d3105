"""First touches of zones that were fixed before, and what came of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.config import ProfileConfig
from .ticks import BLOCK, row_before


def thresholds(ranges: DataFrame, cfg: ProfileConfig, keys: list[str]) -> DataFrame:
    """(keys, reaction_ticks, penetration_ticks) from the exact median of minute ranges, halves to even."""
    m = F.median("range_ticks")
    least = lambda floor, share: F.greatest(F.lit(floor), F.rint(m * share).cast("int"))
    return ranges.groupBy(*keys).agg(least(cfg.reaction_min, cfg.reaction_share).alias("reaction_ticks"), least(cfg.penetration_min, cfg.penetration_share).alias("penetration_ticks"))


def guarded(ticks: DataFrame, available: Column) -> DataFrame:
    """ticks, raising if one is not after the time from which the zones were known."""
    ok = F.when(F.col("time") <= available, F.raise_error(F.lit("look-ahead: a tick is not after the available time"))).otherwise(F.lit(True))
    return ticks.filter(ok)


def first_touch(zones: DataFrame, ticks: DataFrame, keys: list[str], *, block: int = BLOCK) -> DataFrame:
    """zones that a price enters, with role, touch_seq, touch_time and touch_price. Coming from above is support, from below resistance.

    zones: keys, zone_no, lower, upper, a few dozen a key; joined by key to ticks, with one aggregation of which only the first
    touch is kept, so nothing is sorted by zone. The price before a tick is taken in blocks of seq, so nothing is sorted by key either.
    """
    moves = row_before(ticks.select(*keys, "seq", "time", "price"), keys, {"price": F.col("price")}, "__p", block=block)
    moves = moves.select(*keys, "seq", "time", "price", F.col("__p.price").alias("__b")).filter("__b IS NOT NULL AND __b <> price")
    role = F.when((F.col("__b") > F.col("upper")) & (F.col("price") <= F.col("upper")), "support").when((F.col("__b") < F.col("lower")) & (F.col("price") >= F.col("lower")), "resistance")
    hits = moves.join(zones, keys).withColumn("role", role).filter("role IS NOT NULL")
    first = hits.groupBy(*keys, "zone_no").agg(F.min(F.struct(F.col("seq").alias("touch_seq"), "role", F.col("time").alias("touch_time"), F.col("price").alias("touch_price"))).alias("t"))
    return zones.join(first.select(*keys, "zone_no", "t.*"), [*keys, "zone_no"])


def outcomes(touched: DataFrame, ticks: DataFrame, limits: DataFrame, tick: Column | float, keys: list[str]) -> DataFrame:
    """touched with outcome, resolution, mfe_ticks, mae_ticks, minutes_to_resolution.

    From the touch on, the first tick that has gone reaction_ticks away again is a bounce, one penetration_ticks through the zone a
    break; without either it is a timeout at the last tick. Excursions are taken up to that tick.
    """
    own = [*keys, "zone_no"]
    price, up = F.col("price"), F.col("role") == "support"
    away = F.when(up, price >= F.col("upper") + F.col("reaction_ticks") * tick).otherwise(price <= F.col("lower") - F.col("reaction_ticks") * tick)
    through = F.when(up, price <= F.col("lower") - F.col("penetration_ticks") * tick).otherwise(price >= F.col("upper") + F.col("penetration_ticks") * tick)
    base = touched.join(limits, keys)
    after = ticks.select(*keys, "seq", "time", "price").join(base, keys).filter("seq >= touch_seq").withColumn("__what", F.when(away, "bounce").when(through, "break"))
    end = after.groupBy(*own).agg(F.coalesce(F.min(F.when(F.col("__what").isNotNull(), F.struct("seq", "time", "price", "__what"))), F.max(F.struct("seq", "time", "price", "__what"))).alias("e"))
    end = end.select(*own, F.col("e.seq").alias("resolution_seq"), F.col("e.time").alias("resolution_time"), F.col("e.price").alias("resolution_price"), F.coalesce("e.__what", F.lit("timeout")).alias("outcome"))
    gain = F.when(up, price - F.col("touch_price")).otherwise(F.col("touch_price") - price) / tick
    way = after.join(end.select(*own, "resolution_seq"), own).filter("seq <= resolution_seq")
    reach = way.groupBy(*own).agg(F.greatest(F.lit(0.0), F.max(gain)).alias("mfe_ticks"), F.greatest(F.lit(0.0), F.max(-gain)).alias("mae_ticks"))
    minutes = (F.unix_micros(F.col("resolution_time").cast("timestamp")) - F.unix_micros(F.col("touch_time").cast("timestamp"))) / 60_000_000
    return base.join(end, own).join(reach, own).withColumn("minutes_to_resolution", minutes)


def summary(zones: DataFrame, events: DataFrame, kinds: list[str] = ["node_types"]) -> DataFrame:  # noqa: B006
    """Per kind of zone: levels, touched, no_touch, bounce, break, timeout, and the share of bounces among bounces and breaks."""
    have = zones.groupBy(*kinds).agg(F.count("*").alias("levels"))
    count = lambda v: F.count_if(F.col("outcome") == v).alias(v)
    came = events.groupBy(*kinds).agg(F.count("*").alias("touched"), count("bounce"), count("break"), count("timeout"))
    out = have.join(came, kinds, "left").fillna(0, ["touched", "bounce", "break", "timeout"])
    done = F.col("bounce") + F.col("break")
    return out.withColumn("no_touch", F.col("levels") - F.col("touched")).withColumn("bounce_rate", F.when(done > 0, F.col("bounce") / done).otherwise(0.0))


def roles(zones: DataFrame, ticks: DataFrame, keys: list[str]) -> DataFrame:
    """zones with role (neutral if never touched) and touch_seq."""
    touched = first_touch(zones, ticks, keys).select(*keys, "zone_no", "role", "touch_seq")
    return zones.join(touched, [*keys, "zone_no"], "left").withColumn("role", F.coalesce("role", F.lit("neutral")))
