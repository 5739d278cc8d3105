"""Exact dedup by a content sort: sampled splitters, external sorting, full comparisons of neighbours."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import cut, giving_back, raw, slices

#: Bytes that do not count: `[\x20\x09-\x0D]`. None of them is part of another character in UTF-8.
BLANK = b" \t\n\x0b\x0c\r"
#: Leading bytes of a text that the splitters compare; a hash of the whole text comes next, so that equals stay together.
HEAD = 48
#: Bytes of input for a task at most: it holds the ids of one group, as far as they lie in it.
TASK_BYTES = 256 << 20


def _better(a: tuple, b: tuple) -> tuple:
    """Of two (code points, id, row) the one that stays: most code points, then smallest id (null last), then first row."""
    return min(a, b, key=lambda x: (-x[0], x[1] is None, 0 if x[1] is None else x[1], x[2]))


def find_copies(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """id_col, keep_id, group_size, kept, text_sha256 of each row of df, dropped ones too; and row_col, a long, if it is named.

    Texts are equal if the same without blanks (BLANK). Of equal texts the row with the most code points in the original text
    stays, then the one with the smallest id. Null text counts as empty, and empty texts equal each other. Null ids come after
    all others. Of rows that repeat id and text just one is kept. An empty table gives no rows; other columns are not read.

    The sort key is the normalised text's first bytes, a hash of all of it, the id, and the row's place in the input (row_col, if it is named; else df
    must give the same rows in the same order whenever it is read, as tables do). So the splitters, sampled from all rows, also split a group of any
    size by id, and rows that repeat text and id, or have none, by place; what is sampled is short whatever the texts' length. Each task compares neighbours
    in full and settles the groups that lie within it. Only the first and last key of a task can go on in another; those few
    texts (two a task) are compared in one more, small aggregation.
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *([F.col(row_col).alias("own")] if row_col else []))
    kind = rows.schema[0].dataType.simpleString()
    own, own_kind = (["own"], ", own long") if row_col else ([], "")
    rows = rows.withColumn("place", F.col("own") if row_col else F.monotonically_increasing_id())

    def normalise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = raw(batch.column(1))
            points = [len(t.decode()) for t in texts]
            norm = [t.translate(None, BLANK) for t in texts]
            hashes = [xxhash.xxh3_64_intdigest(t) - (1 << 63) for t in norm]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(points, pa.int64()), pa.array([t[:HEAD] for t in norm], pa.binary()), pa.array(hashes, pa.int64()), pa.array(norm, pa.binary()), *batch.columns[2:]], ["id", "points", "head", "hash", "norm", *own, "place"])

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId() << 40
        names = ["id", "row", "keep", "keep_points", "keep_row", "size", "sha", "run", "norm", *own]
        kinds = [id_type[0], pa.int64(), id_type[0], pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.binary(), *(pa.int64() for _ in own)]
        out: list[tuple] = []
        n = runs = 0

        def close(run: dict, edge: bool) -> None:
            nonlocal runs
            runs += 1
            best, sha = run["best"], hashlib.sha256(run["norm"]).hexdigest()
            for k, (i, row, *more) in enumerate(run["rows"]):
                out.append((i, row, best[1], best[0], best[2], len(run["rows"]), sha, task + runs if edge else None, run["norm"] if edge and k == 0 else None, *more))

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        key, first, held = None, True, []
        for batch in slices(batches):
            for i, points, head, hashed, norm, *more in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                n += 1
                me = (points, i, task + n)
                if key != (head, hashed):
                    for run in held:
                        close(run, first)
                    first, held, key = key is None, [], (head, hashed)
                run = held[-1] if held else None
                if run is None or run["norm"] != norm:
                    held.append(run := {"norm": norm, "rows": [], "best": me})
                run["rows"].append((i, task + n, *more))
                run["best"] = _better(run["best"], me)
            if len(out) >= 4096:
                yield batch_of(out)
                out.clear()
        for run in held:
            close(run, True)
        if out:
            yield batch_of(out)

    id_type = [to_arrow_type(rows.schema[0].dataType)]
    normal = rows.mapInArrow(giving_back(normalise), f"id {kind}, points long, head binary, hash long, norm binary{own_kind}, place long")
    # the session's number of partitions, or more where the plan's size says that a task would get over TASK_BYTES
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    tasks = size // TASK_BYTES if size < 1 << 60 else 0
    wide = [tasks] if tasks > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else []
    placed = normal.repartitionByRange(*wide, "head", "hash", "id", "place").sortWithinPartitions("head", "hash", "norm", "id").drop("place")
    settled = cut(placed.mapInArrow(giving_back(settle), f"id {kind}, row long, keep {kind}, keep_points long, keep_row long, size long, sha string, run long, norm binary{own_kind}"))

    # runs that may go on in another task: at most those of two keys a task
    order = F.struct(-F.col("keep_points"), F.col("keep").isNull(), "keep", "keep_row")
    edges = settled.filter(F.col("norm").isNotNull()).select("run", "size", "norm", order.alias("best"))
    joint = edges.groupBy("norm").agg(F.min("best").alias("best"), F.sum("size").alias("joint_size"), F.collect_list("run").alias("runs"))
    joint = joint.select(F.explode("runs").alias("run"), F.col("best.keep").alias("joint_keep"), F.col("best.keep_row").alias("joint_row"), "joint_size")
    both = settled.drop("norm").join(F.broadcast(joint), "run", "left")
    inner = F.col("joint_size").isNull()
    return both.select(
        F.col("id").alias(id_col),
        F.when(inner, F.col("keep")).otherwise(F.col("joint_keep")).alias("keep_id"),
        F.coalesce("joint_size", "size").alias("group_size"),
        (F.col("row") == F.coalesce("joint_row", "keep_row")).alias("kept"),
        F.col("sha").alias("text_sha256"),
        *(F.col(c).alias(row_col) for c in own),
    )
