"""Names of instruments, symbols and files, and how values are written as text."""

from __future__ import annotations

import os

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import PERIODS

#: What an instrument's name and a symbol may hold.
INSTRUMENT = r"^[A-Za-z0-9_一-鿿-]+$"
SYMBOL = r"^[A-Z0-9_.-]+$"
CODE = r"^[A-Z][A-Z0-9]{1,15}$"


def valid_instrument(name: Column) -> Column:
    return F.coalesce(name.rlike(INSTRUMENT), F.lit(False))


def valid_symbol(symbol: Column, *, code: bool = False) -> Column:
    """Whether the symbol in capitals is made of letters, digits and _.-; as a code, of two to 16 letters and digits with a letter first."""
    return F.coalesce(F.upper(F.trim(symbol) if code else symbol).rlike(CODE if code else SYMBOL), F.lit(False))


def root_of(name: Column, case: str = "as written") -> Column:
    """Leading letters of a name, as written, upper or lower. Without any, lower raises (as conversion needs a root), others are empty."""
    letters = F.regexp_extract(name, "^([A-Za-z]+)", 1)
    if case == "lower":
        return F.when(letters == "", F.raise_error(F.concat(F.lit("no root in name "), name))).otherwise(F.lower(letters))
    return F.upper(letters) if case == "upper" else letters


def period_name(minutes: Column) -> Column:
    """Display name of a period; null for others."""
    return F.create_map(*(F.lit(x) for pair in PERIODS.items() for x in pair))[minutes.cast("int")]


def inside(root: str, *parts: str, extensions: frozenset[str] | None = None) -> str:
    """The path of parts below root. One that leads out of it, or has an extension that is not listed, raises."""
    base = os.path.abspath(root)
    path = os.path.abspath(os.path.join(base, *parts))
    if any("\0" in p for p in parts) or os.path.commonpath([base, path]) != base:
        raise ValueError(f"outside of {root}: {parts!r}")
    if extensions is not None and os.path.splitext(path)[1].lower() not in extensions:
        raise ValueError(f"no such kind of file: {parts!r}")
    return path


def event_text(day: Column, clock: Column, millis: Column) -> Column:
    """`YYYY-MM-DD HH:MM:SS.mmm` of a day yyyyMMdd, a clock time and its milliseconds (missing: 0)."""
    date = F.regexp_replace(day.cast("string"), r"^(\d{4})(\d\d)(\d\d)$", "$1-$2-$3")
    ms = F.coalesce(F.nullif(millis.cast("string"), F.lit("")).cast("int"), F.lit(0))
    return F.concat(date, F.lit(" "), clock, F.lit("."), F.lpad(ms.cast("string"), 3, "0"))


def short_number(x: Column) -> Column:
    """Fifteen significant digits, without trailing zeros; an exponent only where there are more digits before the point, or four zeros after it."""
    return F.regexp_replace(F.regexp_replace(F.format_string("%.15g", x), r"(\.\d*?)0+(?=e|$)", "$1"), r"\.(?=e|$)", "")


def csv_cell(x: Column) -> Column:
    """A CSV cell: quoted where it holds a comma, a quote or a line break, with quotes doubled; null is empty."""
    text = F.coalesce(x.cast("string"), F.lit(""))
    return F.when(text.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)
