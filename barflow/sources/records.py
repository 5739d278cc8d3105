"""CSV records whose quoted cells hold line breaks, read in parallel.

A line break ends a record if the file has an even number of quotes before it. Each split counts its own quotes and, for either state it may begin
in, where its records begin; a prefix over the small table of splits then says which state it was. Only lines of records that span several
lines are brought together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BOM = "﻿"
#: Bytes of one record at most: a quote that is never closed would make one of all that follows it.
MOST_BYTES = 64 << 20
NUMBERED = "path string, block long, value string, at long, quotes long, odd int, even_start long, odd_start long"


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines with their place in the split, the quotes in them, whether an odd number of the split's quotes comes before, and where the record
    began in this split (-1: before it) if the split begins outside of quotes (even_start) or within (odd_start)."""
    split, at, seen, starts = None, 0, 0, [-1, -1]
    for batch in batches:
        path, block, value = batch.columns
        # rows of one split lie side by side; a split is told by file and place
        block_no, paths = block.to_numpy(), path.dictionary_encode().indices.to_numpy()
        edges = np.flatnonzero((np.diff(block_no) != 0) | (np.diff(paths) != 0)) + 1
        for lo, hi in zip([0, *edges.tolist()], [*edges.tolist(), batch.num_rows], strict=True):
            if lo == hi:
                continue
            own = (path[lo].as_py(), int(block_no[lo]))
            if own != split:
                split, at, seen, starts = own, 0, 0, [-1, -1]
            lines = value.slice(lo, hi - lo)
            quotes = pc.count_substring(lines, '"').to_numpy(zero_copy_only=False).astype(np.int64)
            before = seen + np.cumsum(quotes) - quotes
            odd, places = before & 1, at + np.arange(hi - lo)
            began = [np.maximum(np.maximum.accumulate(np.where(odd == k, places, -1)), starts[k]) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([path.slice(lo, hi - lo), block.slice(lo, hi - lo), lines, pa.array(places), pa.array(quotes), pa.array(odd.astype(np.int32)), *map(pa.array, began)], [f.split()[0] for f in NUMBERED.split(", ")])
            at, seen, starts = at + hi - lo, int(seen + quotes.sum()), [int(b[-1]) for b in began]


def records(spark: SparkSession, paths: str | list[str], *, most_bytes: int = MOST_BYTES) -> DataFrame:
    """path, seq and value of each record of CSV files, in the file's order by seq; value is its text, with line breaks within quotes and without the one
    that ends it (\\n or \\r\\n). A byte order mark is left out. Records over most_bytes raise, with path and line. Empty lines are records with an empty
    value; a file without lines has none. Each split is read by its own task; no file is one task's work."""
    rows = spark.read.option("lineSep", "\n").text(paths).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), "value")
    lines = rows.mapInArrow(_number, NUMBERED)
    # one row a split from here on
    per = lines.groupBy("path", "block").agg(F.count("*").alias("n"), (F.sum("quotes") % 2).alias("quotes"), F.max("even_start").alias("even"), F.max("odd_start").alias("odd"))
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    total = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    per = per.withColumn("within", total("quotes") % 2).withColumn("shift", total("n"))
    last = F.when(F.col("within") == 0, F.col("even")).otherwise(F.col("odd"))
    own = F.when(last >= 0, F.col("shift") + last)
    per = per.select("path", "block", "within", "shift", F.last(own, ignorenulls=True).over(before).alias("open"))

    both = lines.join(per, ["path", "block"])
    began = F.when(F.col("within") == 0, F.col("even_start")).otherwise(F.col("odd_start"))
    both = both.withColumn("line", F.col("shift") + F.col("at")).withColumn("seq", F.when(began >= 0, F.col("shift") + began).otherwise(F.col("open")))
    # a line alone is a record if it begins outside of quotes and has all of its own
    alone = (F.col("seq") == F.col("line")) & (F.col("quotes") % 2 == 0)
    several = both.filter(~alone)
    bytes_ = several.groupBy("path", "seq").agg((F.sum(F.octet_length("value")) + F.count("*")).alias("bytes"))
    large = F.raise_error(F.concat(F.lit("record too large: "), F.col("path"), F.lit(":"), (F.col("seq") + 1).cast("string")))
    fine = bytes_.filter(F.when(F.col("bytes") > most_bytes, large).otherwise(F.lit(True)))
    joined = several.join(fine, ["path", "seq"]).groupBy("path", "seq").agg(F.sort_array(F.collect_list(F.struct("line", "value"))).alias("x"))
    text = both.filter(alone).select("path", "seq", "value").unionByName(joined.select("path", "seq", F.array_join(F.transform("x", lambda l: l["value"]), "\n").alias("value")))
    return text.select("path", "seq", F.regexp_replace(F.when(F.col("seq") == 0, F.regexp_replace("value", f"^{BOM}", "")).otherwise(F.col("value")), r"\r\z", "").alias("value"))


def cells(record: Column) -> Column:
    """Cells of one CSV record. Quoted ones may hold commas and line breaks, and doubled quotes stand for one; what follows a closing quote belongs to the cell."""
    found = F.regexp_extract_all(F.concat(record, F.lit(",")), F.lit(r'(?:"(?:[^"]++|"")*+"[^,]*+|[^,]*+),'), F.lit(0))
    strip = lambda c: F.substr(c, F.lit(1), F.length(c) - 1)
    quoted = lambda c: F.concat(F.replace(F.regexp_extract(c, r'(?s)^"((?:[^"]++|"")*+)"', 1), F.lit('""'), F.lit('"')), F.regexp_extract(c, r'(?s)^"(?:[^"]++|"")*+"(.*)\z', 1))
    return F.transform(found, lambda c: F.when(c.startswith('"'), quoted(strip(c))).otherwise(strip(c)))


def csv_rows(spark: SparkSession, paths: str | list[str], columns: list[str], **options) -> DataFrame:
    """path, seq and the named columns (as text) of CSV files with a header in their first record. Records in which all cells are empty are left out, the
    header as any; cells that a record lacks are empty, those beyond the header are not read. A file whose header lacks a named column raises."""
    rows = records(spark, paths, **options).withColumn("cells", cells(F.col("value"))).filter(F.exists("cells", lambda c: c != ""))
    heads = rows.groupBy("path").agg(F.min_by("cells", "seq").alias("head"), F.min("seq").alias("head_at"))
    missing = F.array_except(F.array(*(F.lit(c) for c in columns)), F.col("head"))
    wrong = F.raise_error(F.concat(F.lit("missing columns "), F.array_join(missing, ","), F.lit(" in "), F.col("path")))
    heads = heads.withColumn("head", F.when(F.size(missing) > 0, wrong).otherwise(F.col("head")))
    body = rows.join(heads, "path").filter(F.col("seq") > F.col("head_at"))
    return body.select("path", "seq", *(F.coalesce(F.try_element_at("cells", F.array_position("head", F.lit(c)).cast("int")), F.lit("")).alias(c) for c in columns))
