"""The profile pipeline as one graph of DataFrames: selection, normalisation, profiles, levels, events, summary."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import interval_vwap, price_bin_up, symbol_root, vwap_fell_back
from ..functions.times import minute_of_day
from ..operators import bars, events, levels, profile, selection, ticks
from ..sources.runs import Stage, as_they_are
from . import roots
from .calendar import AnySessions
from .config import ProfileConfig

KEYS = ["trading_day", "root", "instrument"]
#: Fixed value: from this time of the day on the morning's levels are known.
AVAILABLE = "11:30:00"


@dataclass
class Run:
    """Frames of a run. All are lazy; ticks of selected contracts are the only large one."""

    selected: DataFrame
    normalized: DataFrame
    profiles: DataFrame
    levels: DataFrame
    events: DataFrame
    summary: DataFrame


def judged_ticks(rows: DataFrame, sessions: AnySessions) -> DataFrame:
    """All ticks with instrument, root, day_key and the verdict on each, by contract and day."""
    rows = rows.withColumn("instrument", F.col("symbol")).withColumn("root", F.upper(symbol_root(F.col("symbol")))).withColumn("day_key", F.coalesce("source_day", F.lit("")))
    return ticks.with_verdict(rows, sessions, order=("session", "price", "time"), keys=["instrument", "day_key"])


def _known(rows: DataFrame, contracts: DataFrame, sessions: AnySessions) -> DataFrame:
    """rows with the columns that the sessions ask for, which contracts have by root (as session_group), unless rows have them."""
    lacking = [c for c in sessions.columns if c not in rows.columns]
    if not lacking:
        return rows
    by_root = contracts.select(F.upper("root").alias("__root"), *lacking)
    return rows.withColumn("__root", F.upper(symbol_root(F.col("symbol")))).join(by_root, "__root").drop("__root")


def normalized(rows: DataFrame, contracts: DataFrame, sessions: AnySessions, cfg: ProfileConfig) -> DataFrame:
    """Accepted ticks with deltas, session, interval VWAP and quality flags. rows: symbol, seq, time, price, cumulative volume and
    turnover, source_day; contracts (root, tick_size, turnover_divisor) is a dimension of a few dozen rows."""
    rows = _known(rows, contracts, sessions)
    minute = minute_of_day(F.col("time"))
    good = ticks.deltas(judged_ticks(rows, sessions).filter("verdict = 'valid'").drop("verdict"), keys=["instrument", "day_key"], max_gap_ms=cfg.max_gap_ms)
    good = good.join(F.broadcast(contracts.select("root", "tick_size", "turnover_divisor")), "root")
    args = (F.col("delta_turnover"), F.col("delta_volume"), F.col("turnover_divisor"), F.col("price"), F.col("tick_size"), cfg.vwap_ticks)
    fell = F.when(vwap_fell_back(*args), F.array(F.lit("VWAP_FALLBACK_LTP"))).otherwise(F.array().cast("array<string>"))
    return good.withColumns({"session": sessions.label(minute), "interval_vwap": interval_vwap(*args), "quality_flags": F.concat("quality_flags", fell), "trading_day": F.col("day_key")})


def normalization_stats(rows: DataFrame) -> DataFrame:
    """Per contract and day: rows, rows with volume, volume, resets, long gaps, VWAP fallbacks."""
    has = lambda f: F.count_if(F.array_contains("quality_flags", f))
    return rows.groupBy(*KEYS).agg(F.count("*").alias("rows"), F.count_if(F.col("delta_volume") > 0).alias("positive_rows"), F.sum("delta_volume").alias("assigned_volume"), has("VOLUME_RESET").alias("volume_resets"), has("TURNOVER_RESET").alias("turnover_resets"), has("LONG_GAP").alias("long_gaps"), has("VWAP_FALLBACK_LTP").alias("vwap_fallbacks"))


def quality_stats(rows: DataFrame, sessions: AnySessions, keys: list[str], instrument: Column | str | None = None) -> DataFrame:
    """Counters of a simple tick file: rows by verdict (order session, then time, after invalid ones), resets, ticks without volume, and
    ticks of morning and afternoon. Invalid (bad_price_rows) are rows without a positive price, with a negative volume, or, with an
    instrument given, of another symbol."""
    fits = F.coalesce(F.col("volume") >= 0, F.lit(True))
    if instrument is not None:
        fits = fits & (F.col("symbol") == instrument)
    rows = rows.withColumn("price", F.when(fits, F.col("price")))
    judged = ticks.with_verdict(rows, sessions, order=("price", "session", "time"), keys=keys)
    base = ticks.verdict_counts(judged, keys)
    good = ticks.deltas(judged.filter("verdict = 'valid'").withColumn("turnover", F.lit(0)), keys=keys)
    part = sessions.label(minute_of_day(F.col("time")))
    more = good.groupBy(*keys).agg(
        F.count_if(F.array_contains("quality_flags", "VOLUME_RESET")).alias("volume_resets"), F.count_if(F.col("delta_volume") == 0).alias("zero_delta_rows"),
        F.count_if(part == "morning").alias("morning_rows"), F.count_if(part == "afternoon").alias("afternoon_rows"),
    )
    return base.join(more, keys, "left").fillna(0)


def simple_profile(rows: DataFrame, tick: Column | float, keys: list[str]) -> DataFrame:
    """(keys, bin, price, volume, share) of last prices alone."""
    bins = rows.filter("delta_volume > 0").groupBy(*keys, price_bin_up(F.col("price"), tick).alias("bin")).agg(F.sum("delta_volume").alias("volume"))
    return bins.withColumns({"price": F.col("bin") * tick, "share": F.col("volume") / F.sum("volume").over(Window.partitionBy(*keys))})


def convert(rows: DataFrame, sessions: AnySessions | None = None) -> tuple[DataFrame, DataFrame]:
    """(bars, report): one-minute bars of source files, night by the clock, and a report row a file; both resets count together. Without sessions given,
    each contract has those of its kind, and a root of no known kind raises; so files of all kinds are one conversion."""
    keys = ["symbol", "source_file", "source_day"]
    if sessions is None:
        rows, sessions = roots.with_kind(rows), roots.by_kind()
    judged = ticks.with_verdict(rows, sessions, keys=keys)
    good = ticks.deltas(judged.filter("verdict = 'valid'").drop("verdict"), keys=keys)
    one = bars.bars_1m(good, sessions, keys=keys, night_rule="clock").drop(*sessions.columns)
    resets = good.groupBy(*keys).agg((F.count_if(F.array_contains("quality_flags", "VOLUME_RESET")) + F.count_if(F.array_contains("quality_flags", "TURNOVER_RESET"))).alias("resets"))
    made = one.groupBy(*keys).agg(F.count("*").alias("bars"))
    report = ticks.verdict_counts(judged, keys).join(made, keys, "left").join(resets, keys, "left").fillna(0).orderBy("source_file", "source_day")
    return one, report


def totals(report: DataFrame) -> DataFrame:
    names = ["rows", "valid_rows", "filtered_rows", "bad_price_rows", "backwards_rows", "bars", "resets"]
    return report.agg(F.count("*").alias("files"), *(F.sum(n).alias(n) for n in names))


def run(rows: DataFrame, contracts: DataFrame, sessions: AnySessions, cfg: ProfileConfig, stage: Stage = as_they_are) -> Run:
    """The whole pipeline. The morning is profiled, the afternoon evaluated. Sessions are the same for all contracts, or by row: RowSessions over a
    column that rows have, or that contracts have by root. stage keeps the frames that several results read (normalised ticks, selection, those of
    the selected contracts, scales, levels, events): by default each result computes them anew."""
    rows = _known(rows, contracts, sessions)
    norm = stage(normalized(rows, contracts, sessions, cfg), "normalized")
    morning = F.coalesce(F.col("session") == "morning", F.lit(False))
    files = ["trading_day", "root", "source_file", *sessions.columns]
    stats = selection.contract_stats(norm.withColumn("source_file", F.col("instrument")), F.col("tick_size"), sessions.morning_minutes, files, morning=morning)
    judged = judged_ticks(rows, sessions).join(F.broadcast(contracts.select("root")), "root", "left_semi")
    stats = selection.with_counters(stats, judged.withColumns({"source_file": F.col("instrument"), "trading_day": F.col("day_key")}), files)
    picked = stage(selection.representative(stats.drop(*sessions.columns), contracts.select("root"), cfg.limits, day="trading_day"), "selected")
    chosen = picked.filter("selected").select("trading_day", "root", F.col("source_file").alias("instrument"))
    # at most one contract a root and day
    norm = stage(norm.join(chosen, KEYS, "left_semi"), "chosen")
    early = norm.filter("session = 'morning'")
    full = profile.dense(profile.histograms(early, F.col("tick_size"), [*KEYS, "tick_size"]), [*KEYS, "tick_size"])
    scales = stage(profile.all_scales(full, cfg.sigmas, [*KEYS, "tick_size"]), "scales")
    # zones are found in bins and then priced, so that one function serves every tick size
    found = levels.find_levels(scales, 1.0, cfg, [*KEYS, "tick_size"])
    priced = found.withColumns({c: F.round(F.col(c) * F.col("tick_size"), 10) for c in ("center", "lower", "upper")})
    priced = priced.withColumn("zone_no", F.xxhash64("node_types", "center")).withColumn("available_time", F.concat_ws(" ", F.date_format(F.to_date("trading_day", "yyyyMMdd"), "yyyy-MM-dd"), F.lit(AVAILABLE)).cast("timestamp_ntz"))
    priced = stage(priced, "levels")
    late = norm.filter("session = 'afternoon'")
    known = F.concat_ws(" ", F.date_format(F.to_date("trading_day", "yyyyMMdd"), "yyyy-MM-dd"), F.lit(AVAILABLE)).cast("timestamp_ntz")
    late = events.guarded(late, known).select(*KEYS, "seq", "time", "price")
    limits = events.thresholds(profile.minute_ranges(early, F.col("tick_size"), [*KEYS, "tick_size"]), cfg, KEYS)
    came = stage(events.outcomes(stage(events.first_touch(priced, late, KEYS), "touched"), late, limits, F.col("tick_size"), KEYS), "events")
    kinds = lambda df: df.withColumn("node_types", F.array_join("node_types", "+"))
    return Run(picked, norm, profile.profile_rows(scales, F.col("tick_size"), [*KEYS, "tick_size"]), priced, came, events.summary(kinds(priced), kinds(came)))


def parse_day(text: str) -> dt.date:
    """A day YYYYMMDD; anything else raises."""
    if len(text) != 8 or not text.isdigit():
        raise ValueError(f"no day: {text!r}")
    return dt.datetime.strptime(text, "%Y%m%d").date()
