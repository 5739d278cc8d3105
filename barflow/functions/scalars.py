"""Scalar functions on prices, flags, names and text, as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def has_flag(flags: Column, bit: int) -> Column:
    return flags.bitwiseAND(F.lit(bit)) != 0


def set_flag(flags: Column, bit: int) -> Column:
    return flags.bitwiseOR(F.lit(bit))


def clear_flag(flags: Column, bit: int) -> Column:
    return flags.bitwiseAND(F.lit(0xFF & ~bit))


def price_bin(price: Column, tick: float | Column) -> Column:
    """Nearest bin, halves to even."""
    return F.rint(price / tick).cast("int")


def price_bin_up(price: Column, tick: float | Column) -> Column:
    """Nearest bin, halves up."""
    return F.floor(price / tick + 0.5).cast("int")


def clamped_delta(now: Column, before: Column) -> Column:
    """What a cumulative value grew by: 0 without a predecessor and after a reset."""
    return F.when(before.isNull(), F.lit(0)).otherwise(F.greatest(now - before, F.lit(0)))


def interval_vwap(d_turnover: Column, d_volume: Column, divisor: Column | float, last: Column, tick: Column | float, most_ticks: float) -> Column:
    """Turnover over volume of an interval; the last price where that makes no sense or strays over most_ticks from it; null without volume."""
    raw = d_turnover / F.nullif(d_volume * divisor, F.lit(0.0))
    odd = raw.isNull() | F.isnan(raw) | (F.abs(raw) == float("inf")) | (d_turnover <= 0) | (raw <= 0) | (F.abs(raw - last) > F.lit(most_ticks) * tick)
    return F.when(d_volume == 0, F.lit(None).cast("double")).otherwise(F.when(odd, last).otherwise(raw))


def vwap_fell_back(d_turnover: Column, d_volume: Column, divisor: Column | float, last: Column, tick: Column | float, most_ticks: float) -> Column:
    raw = d_turnover / F.nullif(d_volume * divisor, F.lit(0.0))
    return (d_volume > 0) & ((d_turnover <= 0) | F.coalesce(F.abs(raw - last) > F.lit(most_ticks) * tick, F.lit(True)))


def symbol_root(name: Column) -> Column:
    """Leading letters, as they are."""
    return F.regexp_extract(name, "^([A-Za-z]+)", 1)


def aligned(price: Column, tick: Column | float) -> Column:
    return F.abs(price / tick - F.rint(price / tick)) <= 1e-6


def compact_number(x: Column) -> Column:
    return F.round(x, 10)


def format_number(x: Column) -> Column:
    """Whole numbers without point; else up to ten decimals without trailing zeros."""
    return F.when(F.abs(x - F.rint(x)) < 1e-9, F.rint(x).cast("bigint").cast("string")).otherwise(F.regexp_replace(F.format_string("%.10f", x), r"\.?0+$", ""))


def zone_id(day: Column, instrument: Column, types: Column, lower: Column, upper: Column, available: Column) -> Column:
    """The first 20 hex digits of a SHA-256 over the zone's text fields."""
    return F.substring(F.sha2(F.concat_ws("|", day, instrument, types, lower, upper, available), 256), 1, 20)


def close_to(a: Column, b: Column, rel: float = 1e-9, least: float = 0.0) -> Column:
    return F.abs(a - b) <= F.greatest(F.lit(rel) * F.greatest(F.abs(a), F.abs(b)), F.lit(least))


def safe_json(value: Column) -> Column:
    """JSON that may stand inside a script element."""
    return F.replace(F.to_json(value), F.lit("</"), F.lit("<\\/"))


def gaussian_kernel(sigma: float) -> list[float]:
    """Weights at -r .. r with r = max(1, ceil(4 sigma)); they sum to 1."""
    r = max(1, math.ceil(4 * sigma))
    w = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-r, r + 1)]
    return [x / sum(w) for x in w]
