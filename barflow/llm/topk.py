"""Exact top-k by inner product with no random access to the lists (NRA), over blocks of vectors and queries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Tables, cut, tables

#: Vectors in a block, queries searched at once in it, and queries that one pass over the table serves (they are broadcast).
BLOCK, TOGETHER, QUERIES_A_PASS = 4096, 512, 8192
#: Depths at which bounds are taken, as parts of the lists.
DEPTHS = (0.0625, 0.125, 0.25, 0.5, 1.0)
#: A query stops reading once at most this many vectors can still qualify; their final scores are then resolved.
FEW = 32


def whole(vectors: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) of each component as a double, which holds such whole numbers exactly up to 2 to the 53."""
    return np.floor(vectors.astype(np.float64) * scale)


def exact_dot(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Row-wise inner products of whole numbers: in doubles where they are exact, else in Python's integers, kept to 64 bits."""
    bound = np.abs(q).max(initial=0) * np.abs(x).max(initial=0) * max(1, q.shape[1])
    if bound < 2**53:
        return np.einsum("ij,ij->i", q, x).astype(np.int64)
    top = (1 << 63) - 1
    return np.array([max(-top - 1, min(top, sum(int(a) * int(b) for a, b in zip(u, v, strict=True)))) for u, v in zip(q, x, strict=True)], np.int64)


class Best:
    """The k best (score, id) so far of each query."""

    def __init__(self, queries: int, k: int):
        self.k, self.query, self.id, self.score = k, np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
        self.floor = np.full(queries, -np.inf)
        self.kept = np.full((queries, k), -np.inf)

    def add(self, query: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        if not len(query):
            return
        q, i, s = (np.concatenate(x) for x in ((self.query, query), (self.id, ids), (self.score, score)))
        order = np.lexsort((i, -s, q))
        q, i, s = q[order], i[order], s[order]
        starts = np.flatnonzero(np.r_[True, q[1:] != q[:-1]])
        place = np.arange(len(q)) - np.repeat(starts, np.diff(np.r_[starts, len(q)]))
        keep = place < self.k
        self.query, self.id, self.score = q[keep], i[keep], s[keep]
        self.kept[self.query, place[keep]] = self.score
        self.floor = self.kept[:, -1]


class Lists:
    """A block's lists, one a dimension, sorted by component, with how far they were read from either end.

    part[q, v] sums what was read of vector v for query q: components of its lists, those that raise the query's score from the top on, those
    that lower it from the bottom on. A stretch just read from all lists is laid out by vector, nothing else in it, and added to the sums of
    all queries as one product. unread (rows: the lists from the top, then from the bottom) says which components were not reached yet;
    nothing else is known of them but that they lie between the place reached and the list's other end.
    """

    def __init__(self, x: np.ndarray, queries: np.ndarray, kind: type):
        by_list = np.ascontiguousarray(x.T)
        self.order = np.argsort(by_list, axis=1, kind="stable")
        self.lists = np.take_along_axis(by_list, self.order, 1).astype(kind)
        self.dims, self.n = by_list.shape
        self.weights = np.hstack([np.maximum(queries, 0), np.minimum(queries, 0)]).astype(kind)
        self.part = np.zeros((len(queries), self.n), kind)
        self.unread = np.ones((2 * self.dims, self.n), kind)
        self.at = self.read = 0

    def read_to(self, depth: int) -> None:
        """Reads each list on to this depth, the top for queries with a positive component, the bottom for the others."""
        stretch = np.zeros((2 * self.dims, self.n), self.lists.dtype)
        for rows, span in ((slice(0, self.dims), slice(self.n - depth, self.n - self.at)), (slice(self.dims, None), slice(self.at, depth))):
            np.put_along_axis(stretch[rows], self.order[:, span], self.lists[:, span], 1)
            np.put_along_axis(self.unread[rows], self.order[:, span], 0, 1)
        self.part += self.weights @ stretch
        self.read += (depth - self.at) * int(np.count_nonzero(self.weights))
        self.at = depth

    def _bound(self, queries, top: np.ndarray, bottom: np.ndarray) -> np.ndarray:
        if self.at == self.n:
            return self.part[queries].copy()
        return self.part[queries] + (self.weights[queries] * np.concatenate([top, bottom])) @ self.unread

    def least(self, queries=slice(None)) -> np.ndarray:
        """The least score that each vector can have for each of these queries: what is unread lies at the lists' other ends."""
        return self._bound(queries, self.lists[:, 0], self.lists[:, -1])

    def most(self, queries=slice(None)) -> np.ndarray:
        """The greatest: what is unread is as good as the place reached."""
        return self._bound(queries, self.lists[:, self.n - self.at], self.lists[:, self.at - 1])

    def only(self, queries: np.ndarray) -> None:
        """Goes on for these queries."""
        self.part, self.weights = self.part[queries], self.weights[queries]


def search(x: np.ndarray, ids: np.ndarray, queries: np.ndarray, own: np.ndarray, at: np.ndarray, best: Best) -> tuple[int, int]:
    """Adds to best what block x can give the queries (numbers `at` in best). The vectors whose scores were resolved, and the components read
    before, are counted.

    All queries read their lists to one depth, then bounds are taken. A vector stays while its greatest score reaches the k-th greatest score
    of blocks before, and, where that leaves more than FEW, of the least scores here. A query of which few vectors stay stops reading.
    """
    n, resolved = len(x), 0
    # single precision where it is near enough; bounds are widened by more than rounding can move them
    reach = np.abs(queries).sum(1) * np.abs(x).max(initial=0)
    kind = np.float32 if reach.max(initial=0) < 2**40 else np.float64
    slack = (1 + reach) * (1e-6 if kind is np.float32 else 1e-9) * 4 * max(1.0, x.shape[1] / 64)
    lists = Lists(x, queries, kind)
    alive = own[:, None] != ids[None, :]
    going = np.arange(len(queries))
    for depth in DEPTHS:
        lists.read_to(max(1, int(n * depth)))
        most = lists.most()
        floor = best.floor[at[going]] - 2 * slack[going]
        alive &= most >= floor[:, None]
        many = np.flatnonzero(alive.sum(1) > FEW)
        if len(many):
            least = lists.least(many)
            least[~alive[many]] = -np.inf
            both = np.hstack([least, best.kept[at[going[many]]]])
            floor = np.partition(both, both.shape[1] - best.k, axis=1)[:, both.shape[1] - best.k] - 2 * slack[going[many]]
            alive[many] &= most[many] >= floor[:, None]
        stops = (alive.sum(1) <= FEW) | (depth == 1)
        q, v = np.nonzero(alive & stops[:, None])
        resolved += len(q)
        for lo in range(0, len(q), 1 << 16):
            a, b = going[q[lo : lo + (1 << 16)]], v[lo : lo + (1 << 16)]
            best.add(at[a], ids[b], exact_dot(queries[a], x[b]))
        if stops.all():
            break
        left = np.flatnonzero(~stops)
        lists.only(left)
        alive, going = alive[left], going[left]
    return resolved, lists.read


def top_k(df: DataFrame, k: int = 5, *, id_col: str = "vec_id", vec_col: str = "embedding", every: int = 50, scale: int = 256) -> DataFrame:
    """The k best rows for each query: query_id, rank (from 1), vec_id, score, ties to the smaller id.

    Components become floor(scale * x); the score is the whole-number inner product. Queries are the rows whose id is divisible
    by `every`; candidates are all rows but those with the query's own id. Vectors that are null, empty or hold null or
    non-finite components take no part, nor do rows without id; ids are whole numbers (others fail when Spark casts them); of query rows that
    repeat an id the smallest vector asks; vectors of other length than the query's are no candidates. A
    query with fewer than k candidates gets all. Rows that repeat an id are candidates each. Scores beyond 64 bits are held at
    the limits. An empty table gives no rows; other columns of df are not read.

    Queries are served QUERIES_A_PASS at a time, drawn by a hash of their ids: so many vectors are broadcast, never more. Each pass reads
    the table once (its rows do not move) and writes k rows a query and task before the next begins; what is returned is a checkpoint.
    """
    spark = df.sparkSession
    x = F.col("vec")
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))
    rows = rows.filter(F.col("id").isNotNull() & (F.size(x) > 0) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))))
    asked = rows.filter(F.col("id") % every == 0).groupBy("id").agg(F.min("vec").alias("vec"))
    passes = max(1, -(-asked.count() // QUERIES_A_PASS))

    def one(part: int, tables: Tables) -> DataFrame:
        own = asked.filter(F.pmod(F.xxhash64("id"), F.lit(passes)) == part).toArrow()
        by_size: dict[int, list[tuple[int, list]]] = {}
        for i, vec in zip(own["id"].to_pylist(), own["vec"].to_pylist(), strict=True):
            by_size.setdefault(len(vec), []).append((i, vec))
        shared = spark.sparkContext.broadcast({d: (np.array([i for i, _ in q]), whole(np.array([v for _, v in q]), scale)) for d, q in by_size.items()})

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            queries = shared.value
            best = {d: Best(len(q[0]), k) for d, q in queries.items()}

            def block(d: int, ids: np.ndarray, vectors: np.ndarray) -> None:
                own, q = queries[d]
                for lo in range(0, len(own), TOGETHER):
                    at = np.arange(lo, min(lo + TOGETHER, len(own)))
                    search(whole(vectors, scale), ids, q[at], own[at], at, best[d])

            held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
            for batch in batches:
                ids, vecs = batch.column(0).to_numpy(), batch.column(1)
                sizes, flat, starts = vecs.value_lengths().to_numpy(), vecs.values.to_numpy(zero_copy_only=False), vecs.offsets.to_numpy()
                for d in np.unique(sizes):
                    if int(d) not in queries:
                        continue
                    mine = np.flatnonzero(sizes == d)
                    mat = flat[starts[mine][:, None] + np.arange(d)]
                    held.setdefault(int(d), []).append((ids[mine], mat))
                    if sum(len(i) for i, _ in held[int(d)]) >= BLOCK:
                        i, m = (np.concatenate(c) for c in zip(*held.pop(int(d)), strict=True))
                        for lo in range(0, len(i), BLOCK):
                            block(int(d), i[lo : lo + BLOCK], m[lo : lo + BLOCK])
            for d, parts in held.items():
                i, m = (np.concatenate(c) for c in zip(*parts, strict=True))
                block(d, i, m)
            for d, b in best.items():
                if len(b.query):
                    yield pa.RecordBatch.from_arrays([pa.array(queries[d][0][b.query]), pa.array(b.id), pa.array(b.score)], ["query_id", "vec_id", "score"])

        found = tables.keep(rows.mapInArrow(run, "query_id long, vec_id long, score long"), f"pass={part}")
        shared.destroy()
        return found

    with tables(spark) as own:
        for part in range(passes):
            found = one(part, own)
        found = spark.read.schema(found.schema).parquet(*(f"{own.folder}/pass={part}" for part in range(passes)))
        return cut(_ranked(found, k))


def _ranked(found: DataFrame, k: int) -> DataFrame:
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
