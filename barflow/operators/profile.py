"""Volume profiles: histograms by last price and interval VWAP, dense bins, smoothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import gaussian_kernel, price_bin
from ..functions.times import epoch_minute


def histograms(rows: DataFrame, tick: Column | float, keys: list[str]) -> DataFrame:
    """(keys, method, bin, volume): volume by bin of the last price (LTP) and of the interval VWAP, from ticks with volume. One pass:
    each tick gives its two bins, and sums start before the shuffle."""
    both = F.array(F.struct(F.lit("LTP").alias("method"), price_bin(F.col("price"), tick).alias("bin")), F.struct(F.lit("VWAP").alias("method"), price_bin(F.col("interval_vwap"), tick).alias("bin")))
    long = rows.filter("delta_volume > 0").select(*keys, "delta_volume", F.explode(both).alias("x")).select(*keys, "x.method", "x.bin", "delta_volume")
    return long.groupBy(*keys, "method", "bin").agg(F.sum("delta_volume").alias("volume"))


def minute_ranges(rows: DataFrame, tick: Column | float, keys: list[str]) -> DataFrame:
    """(keys, minute, range_ticks): high minus low of each minute."""
    return rows.groupBy(*keys, epoch_minute(F.col("time")).alias("minute")).agg(((F.max("price") - F.min("price")) / tick).alias("range_ticks"))


def dense(hist: DataFrame, keys: list[str]) -> DataFrame:
    """Every bin from the lowest to the highest of a key (over both methods), 0 where there is no volume. A key's bins, some hundred, are
    gathered in arrays, so hist is read once."""
    cells = F.collect_list(F.struct("method", "bin", "volume"))
    span = hist.groupBy(*keys).agg(F.min("bin").alias("__lo"), F.max("bin").alias("__hi"), cells.alias("__cells"))
    own = span.withColumn("method", F.explode(F.array_distinct(F.transform("__cells", lambda c: c["method"]))))
    own = own.withColumn("__own", F.map_from_entries(F.transform(F.filter("__cells", lambda c: c["method"] == F.col("method")), lambda c: F.struct(c["bin"], c["volume"]))))
    rows = own.select(*keys, "method", "__own", F.explode(F.sequence("__lo", "__hi")).alias("bin"))
    return rows.select(*keys, "method", "bin", F.coalesce(F.try_element_at("__own", F.col("bin")), F.lit(0)).alias("volume"))


def all_scales(full: DataFrame, sigmas: tuple[float, ...], keys: list[str]) -> DataFrame:
    """(keys, method, bin, sigma, volume): convolution with Gaussian kernels over dense bins, zero outside, then scaled so that each
    total is kept. Sigma 0 copies. A profile's bins, some hundred, are gathered in an array once, and each scale is made from that."""
    group = [*keys, "method"]
    bins = F.array_sort(F.collect_list(F.struct("bin", F.col("volume").cast("double").alias("v"))))
    one = full.groupBy(*group).agg(bins.alias("__b")).withColumn("__v", F.transform("__b", lambda x: x["v"]))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    v = F.col("__v")

    def scale(sigma: float):
        if sigma <= 0:
            return v
        g = gaussian_kernel(sigma)
        half = len(g) // 2
        edge = F.array_repeat(F.lit(0.0), half)
        weights = F.array(*(F.lit(float(w)) for w in g[::-1]))
        spread = F.transform(F.sequence(F.lit(1), F.size(v)), lambda i: total(F.zip_with(F.slice(F.concat(edge, v, edge), i, F.lit(len(g))), weights, lambda x, w: x * w)))
        got = F.transform(F.array(spread), lambda s: F.struct(s.alias("s"), total(s).alias("t")))
        return F.flatten(F.transform(got, lambda x: F.transform(x["s"], lambda y: F.when(x["t"] > 0, y * total(v) / x["t"]).otherwise(0.0))))

    made = F.array(*(F.struct(F.lit(float(s)).alias("sigma"), scale(float(s)).alias("volumes")) for s in sigmas))
    each = one.select(*group, "__b", F.explode(made).alias("x"))
    rows = each.select(*group, "x.sigma", F.explode(F.zip_with("__b", "x.volumes", lambda b, y: F.struct(b["bin"].alias("bin"), y.alias("volume")))).alias("y"))
    return rows.select(*group, "y.bin", "sigma", "y.volume")


def smoothed(full: DataFrame, sigma: float, keys: list[str]) -> DataFrame:
    return all_scales(full, (sigma,), keys)


def profile_rows(scales: DataFrame, tick: Column | float, keys: list[str]) -> DataFrame:
    """Long profile with price and each bin's share of its profile."""
    group = [*keys, "method", "sigma"]
    total = F.sum("volume").over(Window.partitionBy(*group))
    return scales.select(*group, "bin", (F.col("bin") * tick).alias("price"), F.round("volume", 8).alias("volume"), F.round(F.col("volume") / total, 10).alias("volume_share"))


def conserved(scales: DataFrame, raw: DataFrame, keys: list[str]) -> DataFrame:
    """scales, raising where a smoothed total strays from the raw one (by 1e-9 of it and 1e-6)."""
    group = [*keys, "method"]
    total = raw.groupBy(*group).agg(F.sum("volume").cast("double").alias("__raw"))
    rows = scales.withColumn("__sum", F.sum("volume").over(Window.partitionBy(*group, "sigma"))).join(total, group)
    off = F.abs(F.col("__sum") - F.col("__raw")) > F.greatest(F.lit(1e-6), F.lit(1e-9) * F.col("__raw"))
    return rows.filter(F.when(off, F.raise_error(F.lit("volume is not conserved"))).otherwise(F.lit(True))).drop("__sum", "__raw")
