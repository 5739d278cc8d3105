"""Parameters of the profile pipeline, and contract metadata as a small dimension."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from .calendar import Sessions


@dataclass(frozen=True)
class Limits:
    """Least liquidity of a contract that is profiled. Fixed values."""

    volume: float = 1000
    nonzero_updates: int = 1000
    coverage: float = 0.6
    bins: int = 8
    backwards: int = 0
    misaligned: int = 0


@dataclass(frozen=True)
class ProfileConfig:
    """Parameters of profiles, levels and events. Fixed values."""

    value_area: float = 0.7
    sigmas: tuple[float, ...] = (0.0, 1.0, 2.0, 4.0)
    min_scales: int = 3
    match_ticks: int = 2
    peak_share: float = 0.0025
    min_valley_depth: float = 0.25
    merge_ticks: float = 1
    max_gap_ms: int = 5000
    vwap_ticks: float = 100
    reaction_share: float = 0.5
    penetration_share: float = 0.25
    reaction_min: int = 2
    penetration_min: int = 1
    limits: Limits = field(default_factory=Limits)


def load_contracts(spark: SparkSession, path: str) -> tuple[DataFrame, dict[str, Sessions]]:
    """Contract metadata (root, exchange, session_group, tick_size, multiplier, turnover_divisor) and the sessions of each group, from a
    JSON document of schema version 1. turnover_divisor is the multiplier where none is given."""
    text = "\n".join(r.value for r in spark.read.text(path, wholetext=True).collect())
    doc = json.loads(text)
    if doc.get("schema_version") != 1:
        raise ValueError(f"schema_version is {doc.get('schema_version')!r}, not 1")
    groups = {name: Sessions.parse(",".join(f"{s}-{e}" for part in ("morning", "afternoon") for s, e in g[part])) for name, g in doc["session_groups"].items()}
    rows = [(root, c["exchange"], c["session_group"], float(c["tick_size"]), float(c["multiplier"]), float(c.get("turnover_divisor", c["multiplier"]))) for root, c in sorted(doc["contracts"].items())]
    return spark.createDataFrame(rows, "root string, exchange string, session_group string, tick_size double, multiplier double, turnover_divisor double"), groups
