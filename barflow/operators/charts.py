"""What charts need: thinned ticks, bar positions, breaks, and nested payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.times import epoch_micros, epoch_minute


def thinned(ticks: DataFrame, keys: list[str], bucket_ms: int = 1000) -> DataFrame:
    """Of each bucket of time the first, the last, the lowest and the highest tick (the first of equals), each once. One aggregation that holds four rows a
    bucket; seq tells a key's ticks apart. Buckets lie in exchange time, whatever the session's zone."""
    micros = epoch_micros(F.col("time"))
    t = micros - F.pmod(micros, F.lit(bucket_ms * 1000))
    row, rank = F.struct(*ticks.columns), (F.col("seq"), F.struct("price", "seq"), F.struct("price", -F.col("seq")))
    four = F.array(F.min_by(row, rank[0]), F.max_by(row, rank[0]), F.min_by(row, rank[1]), F.max_by(row, rank[2]))
    per = ticks.groupBy(*(F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)), t.alias("__t")).agg(four.alias("__r"))
    once = F.filter("__r", lambda r, i: F.array_position(F.transform("__r", lambda o: o["seq"]), r["seq"]) == i + 1)
    return per.select(F.explode(once).alias("r")).select("r.*")


def positions(bars: DataFrame, keys: list[str]) -> DataFrame:
    """bars with idx, their place from 0."""
    return bars.withColumn("idx", F.row_number().over(Window.partitionBy(*keys).orderBy("bar_time")) - 1)


def breaks(placed: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, x, minutes, label): where over 1.5 minutes lie between two bars. Fixed labels: a noon break from an hour on, else a pause."""
    before = F.lag("bar_time").over(Window.partitionBy(*keys).orderBy("bar_time"))
    gap = (F.unix_seconds(F.col("bar_time").cast("timestamp")) - F.unix_seconds(before.cast("timestamp"))) / 60
    rows = placed.withColumn("__gap", gap).filter("__gap > 1.5")
    return rows.select(*keys, (F.col("idx") - 0.5).alias("x"), (F.col("__gap") - 1).cast("int").alias("minutes"), F.when(F.col("__gap") >= 60, "午休").otherwise("休盘").alias("label"))


def tick_x(ticks: DataFrame, placed: DataFrame, keys: list[str]) -> DataFrame:
    """ticks with x: the position of their minute's bar plus the part of the minute; null without such a bar."""
    at = placed.select(*keys, epoch_minute(F.col("bar_time")).alias("__m"), "idx")
    second = F.extract(F.lit("SECOND"), F.col("time")).cast("double")
    return ticks.withColumn("__m", epoch_minute(F.col("time"))).join(at, [*keys, "__m"], "left").withColumn("x", F.col("idx") + second / 60).drop("__m", "idx")


def afternoon_x(placed: DataFrame, afternoon: Column, keys: list[str]) -> DataFrame:
    """(keys, x): half a bar before the first afternoon bar, at least 0; the last bar's place if there is none."""
    first = F.min(F.when(afternoon, F.col("idx")))
    return placed.groupBy(*keys).agg(F.coalesce(F.greatest(first - 0.5, F.lit(0.0)), (F.count("*") - 1).cast("double")).alias("x"))


def extent(frames: list[tuple[DataFrame, str, str]], tick: Column | float, keys: list[str], share: float = 0.04) -> DataFrame:
    """(keys, low, high): least and greatest price over frames (low column, high column), padded by two ticks or a share of the span."""
    parts = [df.groupBy(*keys).agg(F.min(lo).alias("lo"), F.max(hi).alias("hi")) for df, lo, hi in frames]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    both = out.groupBy(*keys).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    pad = F.greatest(F.lit(2.0) * tick, (F.col("hi") - F.col("lo")) * share)
    return both.select(*keys, (F.col("lo") - pad).alias("low"), (F.col("hi") + pad).alias("high"))


def levels_with_events(levels: DataFrame, events: DataFrame, by: list[str]) -> DataFrame:
    """levels with role and outcome of the event of the same text key (the last one, by event_no); neutral and no_touch without."""
    last = events.groupBy(*by).agg(F.max_by(F.struct("role", "outcome"), "event_no").alias("e"))
    out = levels.join(last, by, "left")
    return out.select(*levels.columns, F.coalesce("e.role", F.lit("neutral")).alias("role"), F.coalesce("e.outcome", F.lit("no_touch")).alias("outcome"))


def payload(parts: dict[str, DataFrame], keys: list[str]) -> DataFrame:
    """(keys, payload): one JSON document a key from frames of its rows, each in the order of its column ord. For display, so a key's
    frames are small: thinned ticks, bars, zones."""
    out = None
    for name, df in parts.items():
        cols = [c for c in df.columns if c not in keys]
        one = df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("ord", *(c for c in cols if c != "ord")))).alias(name))
        out = one if out is None else out.join(one, keys, "full")
    return out.select(*keys, F.to_json(F.struct(*parts)).alias("payload"))


def gathered(df: DataFrame, keys: list[str], order: list[str], item: Column, name: str) -> DataFrame:
    """(keys, name): an array a key of the items, in order."""
    cells = F.array_sort(F.collect_list(F.struct(*(F.col(c).alias(f"o{k}") for k, c in enumerate(order)), item.alias("item"))))
    return df.groupBy(*keys).agg(F.transform(cells, lambda c: c["item"]).alias(name))


def nested(df: DataFrame, keys: list[str], levels: list[str], order: list[str], item: Column, name: str) -> DataFrame:
    """(keys, name): maps within maps, a level each, with arrays of items in order at the end. Names of a level come sorted."""
    out = gathered(df, [*keys, *levels], order, item, name)
    for k in range(len(levels) - 1, -1, -1):
        entries = F.map_from_entries(F.collect_list(F.struct(F.col(levels[k]).cast("string"), F.col(name))))
        out = out.groupBy(*keys, *levels[:k]).agg(entries.alias(name))
        names = F.array_sort(F.map_keys(name))
        out = out.withColumn(name, F.map_from_arrays(names, F.transform(names, lambda n: F.element_at(F.col(name), n))))
    return out


def together(parts: list[DataFrame], keys: list[str]) -> DataFrame:
    """Frames of a row a key as one frame; a key that a frame lacks has null there. Each frame comes dealt by its keys, so that the joins move nothing."""
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p, keys, "full")
    return out
