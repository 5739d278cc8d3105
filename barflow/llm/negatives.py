"""Hard-negative mining: each anchor's scores to a block of vectors are sorted whole, and each positive's limits are looked up in them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, giving_back, tables

#: Vectors that a task scores at a time, anchors scored together, and anchors that one pass over the table serves (they are broadcast).
BLOCK, TOGETHER, ANCHORS_A_PASS = 4096, 256, 4096
#: What a candidate of an anchor's slot is, within a task and between tasks.
FOUND = "anchor_id long, slot int, other_id long, score long"


def scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers: in doubles where they are exact, else in Python's integers, kept to 64 bits."""
    if np.abs(q).max(initial=0) * np.abs(x).max(initial=0) * max(1, q.shape[1]) < 2**53:
        return (q @ x.T).astype(np.int64)
    top = (1 << 63) - 1
    exact = np.vectorize(int, otypes=[object])
    return np.clip(exact(q).dot(exact(x).T), -top - 1, top).astype(np.int64)


class Anchors:
    """The anchors of a pass that have one number of dimensions, and what each may still take (slots: positives, or limits of scores)."""

    def __init__(self, ids: list[int], labels: list[int], vectors: list[list[float]], limits: list[list[tuple[int, int, int]]]):
        self.ids, self.labels, self.vectors, self.limits = np.array(ids, np.int64), np.array(labels, np.int64), np.array(vectors, np.float64), limits


def sorted_rows(score: np.ndarray, ids: np.ndarray, take: np.ndarray) -> np.ndarray:
    """The places of the rows to take, best score first and smaller id first among equals."""
    places = np.flatnonzero(take)
    return places[np.lexsort((ids[places], -score[places]))]


def positives(score: np.ndarray, ids: np.ndarray, same: np.ndarray, limits: list, k: int) -> Iterator[tuple[int, np.ndarray]]:
    yield 0, sorted_rows(score, ids, same)[:k]


def negatives(score: np.ndarray, ids: np.ndarray, same: np.ndarray, limits: list, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each (slot, least, most) the first k rows of other labels from most down to least."""
    if not limits:
        return
    order = sorted_rows(score, ids, ~same)
    falling = -score[order]
    for slot, least, most in limits:
        at = np.searchsorted(falling, -most, "left")
        end = np.searchsorted(falling, -least, "right")
        if at < end:
            yield slot, order[at : min(end, at + k)]


class Kept:
    """The best k (score, id) of each anchor and slot so far, over the blocks of a task."""

    def __init__(self, k: int):
        self.k, self.best = k, {}

    def add(self, anchor: int, slot: int, ids: np.ndarray, score: np.ndarray) -> None:
        if len(ids):
            both = self.best.get((anchor, slot), []) + [(-s, i) for s, i in zip(score.tolist(), ids.tolist(), strict=True)]
            self.best[anchor, slot] = sorted(both)[: self.k]

    def batch(self) -> pa.RecordBatch:
        rows = [(a, slot, i, -s) for (a, slot), best in self.best.items() for s, i in best]
        kinds = (("anchor_id", pa.int64()), ("slot", pa.int32()), ("other_id", pa.int64()), ("score", pa.int64()))
        return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, (_, t) in enumerate(kinds)], [n for n, _ in kinds])


def _scan(rows: DataFrame, anchors: DataFrame, read: Callable, k: int, scale: int) -> DataFrame:
    """What read takes of every block of rows for each of the anchors, at most k a slot and task."""
    by_size: dict[int, list[tuple]] = {}
    for r in anchors.toArrow().to_pylist():
        limits = [(x["slot"], x["least"], x["most"]) for x in r.get("limits") or []]
        by_size.setdefault(len(r["vec"]), []).append((r["id"], r["label"], r["vec"], limits))
    shared = anchors.sparkSession.sparkContext.broadcast({d: Anchors(*map(list, zip(*a, strict=True))) for d, a in by_size.items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, kept = shared.value, Kept(k)
        held: dict[int, list[tuple]] = {}

        def block(d: int) -> None:
            ids, labels, x = (np.concatenate(c) for c in zip(*held.pop(d), strict=True))
            own, x = known[d], np.floor(x * scale)
            for lo in range(0, len(own.ids), TOGETHER):
                for a, score in enumerate(scores(np.floor(own.vectors[lo : lo + TOGETHER] * scale), x), lo):
                    other = ids != own.ids[a]
                    mine, theirs = ids[other], score[other]
                    for slot, at in read(theirs, mine, labels[other] == own.labels[a], own.limits[a], k):
                        kept.add(int(own.ids[a]), slot, mine[at], theirs[at])

        for batch in batches:
            for lo in range(0, batch.num_rows, BLOCK):
                part = batch.slice(lo, BLOCK)
                vecs = part.column(2)
                sizes, flat, starts = vecs.value_lengths().to_numpy(), vecs.values.to_numpy(zero_copy_only=False), vecs.offsets.to_numpy()
                for d in map(int, np.unique(sizes)):
                    if d in known:
                        at = np.flatnonzero(sizes == d)
                        held.setdefault(d, []).append((part.column(0).to_numpy()[at], part.column(1).to_numpy()[at], flat[starts[at][:, None] + np.arange(d)]))
                        if sum(len(p[0]) for p in held[d]) >= BLOCK:
                            block(d)
        for d in list(held):
            block(d)
        yield kept.batch()

    return rows.mapInArrow(giving_back(run), FOUND)


def _best(found: DataFrame, k: int) -> DataFrame:
    """The k best of each anchor and slot over all tasks, with their rank."""
    order = Window.partitionBy("anchor_id", "slot").orderBy(F.desc("score"), "other_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def mine(df: DataFrame, *, id_col: str = "vec_id", vec_col: str = "embedding", label: Column | str = "label", every: int = 100, positives_each: int = 5, negatives_each: int = 5, band: tuple[int, int] = (80, 100), scale: int = 256) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score, positive_rank.

    Anchors are the rows whose id is divisible by `every`. Components become floor(scale * x); a score is the whole-number inner product with
    the anchor, and higher scores come first, then smaller ids. An anchor's positives are its first positives_each other rows of the same
    label; for each of them the first negatives_each rows of other labels follow whose score lies between band[0] and band[1] hundredths
    of the positive's (so there are none for a positive with a negative score, unless both bounds meet). A positive without negatives has no rows.

    Rows without id, label or vector, and vectors that are empty or hold null or non-finite components, take no part. ids are whole
    numbers (others fail when Spark casts them), labels too. Rows that repeat an id are candidates each, but not for an anchor of that id; of
    anchors that repeat an id the one with the smallest label and vector asks. Vectors of other length than the anchor's are no candidates.
    Scores beyond 64 bits are held at the limits. An empty table gives no rows; other columns of df are not read.

    Anchors are served ANCHORS_A_PASS at a time, drawn by a hash of their ids: so many are broadcast, never more. A pass reads the table
    twice, for the positives and then, within their limits, for the negatives; rows do not move. Of the sorted scores a task keeps k a slot, and
    only these are shuffled. Each pass is written before the next begins; what is returned is a checkpoint.
    """
    spark = df.sparkSession
    x = F.col("vec")
    known = F.expr(label) if isinstance(label, str) else label
    rows = df.select(F.col(id_col).cast("long").alias("id"), known.cast("long").alias("label"), F.col(vec_col).cast("array<double>").alias("vec"))
    rows = rows.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & (F.size(x) > 0) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))))
    anchors = rows.filter(F.col("id") % every == 0).groupBy("id").agg(F.min(F.struct("label", "vec")).alias("row")).select("id", "row.*")
    passes = max(1, -(-anchors.count() // ANCHORS_A_PASS))
    # whole-number bounds: band[0] * positive <= 100 * negative <= band[1] * positive
    wide = F.col("score").cast("decimal(38,0)")
    least = F.ceil(wide * band[0] / 100).cast("long")
    most = F.floor(wide * band[1] / 100).cast("long")

    with tables(spark) as own:
        for part in range(passes):
            asked = anchors.filter(F.pmod(F.xxhash64("id"), F.lit(passes)) == part)
            close = own.keep(_best(_scan(rows, asked, positives, positives_each, scale), positives_each), f"close-{part}")
            limits = close.groupBy("anchor_id").agg(F.collect_list(F.struct(F.col("rank").alias("slot"), least.alias("least"), most.alias("most"))).alias("limits"))
            far = _best(_scan(rows, asked.join(limits, asked.id == limits.anchor_id).select("id", "label", "vec", "limits"), negatives, negatives_each, scale), negatives_each)
            pos = close.select("anchor_id", F.col("rank").alias("slot"), F.col("other_id").alias("positive_id"), F.col("score").alias("positive_score"))
            own.keep(far.join(pos, ["anchor_id", "slot"]).select("anchor_id", "positive_id", "rank", F.col("other_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"), F.col("slot").alias("positive_rank")), f"done-{part}")
        return cut(spark.read.parquet(*(f"{own.folder}/done-{part}" for part in range(passes))))
