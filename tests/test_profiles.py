"""Profiles, levels and events on hand-made vectors and prices."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from barflow.functions.scalars import gaussian_kernel
from barflow.operators import events, levels, profile, selection
from barflow.plans.config import Limits, ProfileConfig

CFG = ProfileConfig()


def test_smoothing_conserves_and_equals_numpy(spark):
    raw = [0.0, 10.0, 0.0, 20.0, 0.0, 5.0]
    full = spark.createDataFrame([("x", m, i, v) for m in ("LTP", "VWAP") for i, v in enumerate(raw)], "symbol string, method string, bin int, volume double")
    scales = profile.conserved(profile.all_scales(full, CFG.sigmas, ["symbol"]), full, ["symbol"])
    got = scales.filter("method = 'LTP'").toPandas()
    for s in CFG.sigmas:
        v = got[got.sigma == s].sort_values("bin").volume.to_numpy()
        want = np.array(raw) if s == 0 else np.convolve(np.pad(raw, 20), gaussian_kernel(s), "same")[20:-20]
        assert np.allclose(v, want * sum(raw) / want.sum()) and v.min() >= 0
    assert abs(sum(gaussian_kernel(2)) - 1) < 1e-12


def test_value_area():
    a = levels.value_area(np.array([0, 2, 10, 4, 2, 0.0]), 0.7)
    assert (a["poc"], a["poc_low"], a["poc_high"]) == (2, 2, 2)
    assert np.array([0, 2, 10, 4, 2, 0])[a["val"] : a["vah"] + 1].sum() >= 0.7 * 18
    b = levels.value_area(np.array([10, 0, 10.0]), 0.7)
    assert (b["poc"], b["poc_high"]) == (0, 0)
    c = levels.value_area(np.array([1, 4, 10, 4, 1.0]), 0.6)
    assert (c["val"], c["vah"]) == (1, 3)
    d = levels.simple_value_area(np.array([1, 5, 5, 3, 3.0]), 0.7)
    assert d == {"poc_low": 1, "poc_high": 2, "val": 1, "vah": 3}


def test_persistent_peaks():
    v = np.zeros(31)
    v[[8, 22, 7, 9, 21, 23]] = [100, 80, 25, 25, 20, 20]
    scales = {0.0: v} | {s: np.convolve(np.pad(v, 20), gaussian_kernel(s), "same")[20:-20] for s in (1.0, 2.0, 4.0)}
    peaks = levels.persistent_peaks(scales, v.sum(), ProfileConfig(peak_share=0.01))
    assert [abs(p.index - q) <= 2 and len(p.scales) >= 3 for p, q in zip(peaks, (8, 22), strict=True)] == [True, True]
    one = levels.measure(np.array([0, 5, 3, 9, 1, 2.0]), 1)
    assert (one.prominence, one.width) == (2.0, 1.0)
    assert levels.peak_indexes(np.array([3, 1, 4, 4, 2, 5.0])) == [0, 2, 5]


def test_zones_merge_unless_they_clash():
    z = lambda kind, a, b: levels.Zone({kind}, (a + b) / 2, a, b, {"s"})
    out = levels.merge_zones([z("VPOC", 10, 12), z("HVN", 12.5, 14), z("LVN", 14, 15), z("VAH", 15.5, 16)], 1.0)
    assert [sorted(x.types) for x in out] == [["HVN", "VPOC"], ["LVN", "VAH"]]
    assert (out[0].lower, out[0].upper, out[0].center) == (10, 14, 12)


def test_find_levels(spark):
    v = np.abs(np.arange(60) - 26.0) / 4
    v[[10, 11, 12, 40, 41, 42]] = [50, 100, 50, 40, 80, 40]
    v[:10] = v[43:] = 0
    full = spark.createDataFrame([("x", m, i + 100, float(w)) for m in ("LTP", "VWAP") for i, w in enumerate(v)], "symbol string, method string, bin int, volume double")
    got = levels.find_levels(profile.all_scales(full, CFG.sigmas, ["symbol"]), 0.5, CFG, ["symbol"]).collect()
    kinds = {k for r in got for k in r.node_types}
    assert {"VPOC", "HVN", "LVN", "VAL", "VAH", "EDGE_LOW", "EDGE_HIGH"} <= kinds
    assert next(r for r in got if "VPOC" in r.node_types).lower <= 55.5 <= next(r for r in got if "VPOC" in r.node_types).upper


@pytest.mark.parametrize("block", [1, 7, 1 << 20])
def test_events(spark, block):
    at = lambda s: dt.datetime(2026, 1, 9, 13, 0, s)
    t = spark.createDataFrame([("x", i, at(i), p) for i, p in enumerate((110.0, 104.0, 101.0, 103.0))], "symbol string, seq long, time timestamp_ntz, price double")
    zones = spark.createDataFrame([("x", 1, 99.0, 101.0), ("x", 2, 50.0, 60.0)], "symbol string, zone_no int, lower double, upper double")
    limits = events.thresholds(spark.createDataFrame([("x", 4.0)], "symbol string, range_ticks double"), CFG, ["symbol"])
    r = events.outcomes(events.first_touch(zones, t, ["symbol"], block=block), t, limits, 1.0, ["symbol"]).collect()
    assert [(x.zone_no, x.role, x.outcome, x.touch_seq, x.mfe_ticks, x.mae_ticks) for x in r] == [(1, "support", "bounce", 2, 2.0, 0.0)]
    assert {x.zone_no: x.role for x in events.roles(zones, t, ["symbol"]).collect()} == {1: "support", 2: "neutral"}
    with pytest.raises(Exception, match="look-ahead"):
        events.guarded(t, F.lit(dt.datetime(2026, 1, 9, 14))).count()


def test_representative(spark):
    s = spark.createDataFrame([("IF", "IF2603", 50.0), ("IF", "IF2604", 20.0)], "root string, source_file string, total_volume double")
    for c in ("nonzero_updates", "price_bins", "backwards_rows", "misaligned_rows"):
        s = s.withColumn(c, F.lit(0))
    s = s.withColumn("coverage", F.lit(1.0))
    roots = spark.createDataFrame([("IF",), ("IC",)], "root string")
    got = [(r.root, r.source_file, r.reasons) for r in selection.representative(s, roots, Limits(volume=10, nonzero_updates=0, bins=1)).collect()]
    assert got == [("IC", None, ["no_source_file"]), ("IF", "IF2603", ["price_bins"])]


def stepwise(v, first, last, least, both):
    """Growth bin by bin."""
    n = len(v)
    while v[first : last + 1].sum() < least and (first > 0 or last < n - 1):
        left = v[first - 1] if first else -1
        right = v[last + 1] if last < n - 1 else -1
        if left == right and both:
            first, last = first - 1, last + 1
        elif left >= right:
            first -= 1
        else:
            last += 1
    return first, last


def test_growth_in_runs_equals_growth_by_bins():
    r = np.random.default_rng(1)
    for _ in range(2000):
        v = r.integers(0, r.choice([2, 4, 30]), r.integers(1, 25)).astype(float)
        if v.sum():
            at, least = int(np.argmax(v)), float(v.sum() * r.choice([0.1, 0.5, 0.7, 0.95, 1.0]))
            for both in (True, False):
                assert levels.grown(v, at, at, least, both) == stepwise(v, at, at, least, both), (v, at, least, both)


def test_value_area_needs_volume():
    with pytest.raises(ValueError, match="needs volume"):
        levels.value_area(np.zeros(4), 0.7)


def test_peaks_lie_at_even_halves_and_have_the_height_at_two_ticks():
    flat = lambda i: np.eye(12)[i] * 10
    scales = {0.0: flat(2), 1.0: flat(2), 2.0: np.linspace(1, 12, 12) * 0.001, 4.0: flat(3), 8.0: flat(3)}
    peaks = levels.persistent_peaks(scales, 10.0, ProfileConfig(peak_share=0.5))
    assert [(p.index, round(p.value, 6), len(p.scales)) for p in peaks] == [(2, 0.003, 4)]
