"""Sessions by kind of contract, for conversion: a root that is in no list is an error."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import root_of
from .calendar import DAY, NIGHT_0230, NIGHT_2300, STOCK_INDEX, RowSessions, Sessions

#: Session text and roots of each kind of contract.
KINDS = {
    "index": (STOCK_INDEX, ["if", "ic", "ih", "im"]),
    "bond": ("09:30-11:30,13:00-15:15", ["t", "tf", "ts", "tl"]),
    "night to 02:30": (NIGHT_0230, ["au", "ag", "sc"]),
    "night to 01:00": ("21:00-01:00," + DAY, ["cu", "al", "zn", "pb", "ni", "sn", "ss", "ao", "ad", "bc"]),
    "night to 23:00": (
        NIGHT_2300,
        [
            "rb", "hc", "bu", "ru", "fu", "sp", "br", "wr", "nr", "lu",
            "a", "b", "bz", "c", "cs", "eb", "eg", "i", "j", "jm", "l", "m", "op", "p", "pg", "pp", "v", "y",
            "cf", "cy", "fg", "ma", "oi", "pf", "pr", "px", "rm", "sa", "sf", "sh", "sm", "sr", "ta", "ur", "zc",
        ],
    ),
    "no night": (DAY, ["bb", "fb", "jd", "lg", "lh", "rr", "ap", "cj", "jr", "lr", "pk", "pm", "ri", "rs", "wh", "ec", "si", "lc", "ps", "pl", "pd", "pt"]),
}
KIND_OF = {root: kind for kind, (_, roots) in KINDS.items() for root in roots}


def sessions_of(root: str) -> Sessions:
    """The root's sessions; an unknown root raises."""
    if root.lower() not in KIND_OF:
        raise ValueError(f"no sessions known for {root!r}")
    return Sessions.parse(KINDS[KIND_OF[root.lower()]][0])


def kinds(spark: SparkSession) -> DataFrame:
    """(root, kind), one row a known root."""
    return spark.createDataFrame(sorted(KIND_OF.items()), "root string, kind string")


def unknown_roots(rows: DataFrame, name: str = "symbol") -> DataFrame:
    """(root): roots of the names that have no sessions."""
    return rows.select(root_of(F.col(name), "lower").alias("root")).filter(~F.col("root").isin(*KIND_OF)).distinct()


def by_kind() -> RowSessions:
    """Sessions of rows by the column kind, as with_kind gives it."""
    return RowSessions.by("kind", {kind: Sessions.parse(text) for kind, (text, _) in KINDS.items()})


def with_kind(rows: DataFrame, name: str = "symbol") -> DataFrame:
    """rows with root (lower case) and kind; a root without sessions raises."""
    known = F.create_map(*(F.lit(x) for pair in sorted(KIND_OF.items()) for x in pair))
    rows = rows.withColumn("root", root_of(F.col(name), "lower"))
    return rows.withColumn("kind", F.coalesce(F.try_element_at(known, F.col("root")), F.raise_error(F.concat(F.lit("no sessions known for "), F.col("root"))).cast("string")))
