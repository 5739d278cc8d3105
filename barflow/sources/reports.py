"""Reports for reading: HTML tables, SVG profiles, JSON snapshots. They take small frames, whose rows go to the driver."""

from __future__ import annotations

import html
import json
from pathlib import Path

from pyspark.sql import DataFrame


def html_table(df: DataFrame, limit: int | None = None) -> str:
    rows = (df if limit is None else df.limit(limit)).collect()
    cell = lambda v: html.escape("" if v is None else "+".join(map(str, v)) if isinstance(v, list) else str(v))
    head = "".join(f"<th>{html.escape(c)}</th>" for c in df.columns)
    return f"<table><tr>{head}</tr>" + "".join("<tr>" + "".join(f"<td>{cell(v)}</td>" for v in r) + "</tr>" for r in rows) + "</table>"


def svg_profile(points: list[tuple[float, float]], zones: list[tuple[float, str]], width: int = 320, height: int = 480) -> str:
    """A profile as a line of (price, volume), with a line at each zone."""
    if not points:
        return f'<svg width="{width}" height="{height}"/>'
    lo, hi, most = min(p for p, _ in points), max(p for p, _ in points), max(v for _, v in points) or 1
    y = lambda p: height - (p - lo) / ((hi - lo) or 1) * height
    line = " ".join(f"{v / most * width:.1f},{y(p):.1f}" for p, v in sorted(points))
    marks = "".join(f'<line x1="0" x2="{width}" y1="{y(p):.1f}" y2="{y(p):.1f}" stroke="red"><title>{html.escape(t)}</title></line>' for p, t in zones)
    return f'<svg width="{width}" height="{height}"><polyline fill="none" stroke="black" points="{line}"/>{marks}</svg>'


def report(title: str, parts: dict[str, DataFrame], limit: int | None = 200) -> str:
    body = "".join(f"<h2>{html.escape(name)}</h2>{html_table(df, limit)}" for name, df in parts.items())
    return f"<!doctype html><meta charset='utf-8'><title>{html.escape(title)}</title><h1>{html.escape(title)}</h1>{body}"


def detail(title: str, payload: str) -> str:
    """A page that carries a chart's payload. The payload is JSON in which no element can end."""
    return f"<!doctype html><meta charset='utf-8'><title>{html.escape(title)}</title><script id='payload' type='application/json'>{payload.replace('</', '<\\/')}</script>"


def write_json(value: object, path: str) -> None:
    Path(path).write_text(json.dumps(value, ensure_ascii=False, indent=2, sort_keys=True), encoding="utf-8")
