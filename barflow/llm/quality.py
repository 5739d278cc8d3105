"""Quality scores: random-indexing word vectors pooled per document, a two-layer numpy network, temperature calibration."""

from __future__ import annotations

import operator
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Memo, give_back, giving_back, slices, texts

#: Labelled rows that the fit may use (the first by a hash of their ids).
SAMPLE = 5000
#: Bytes of their texts at most.
SAMPLE_BYTES = 64 << 20
#: Components of a word's index vector, those of them that are not 0, and words to either side that make its context.
DIMS, ONES, WINDOW = 64, 6, 2
#: Occurrences in the sample from which a word has a vector of its own; rarer words share their shape's.
OWN = 20
#: Chunks that each Python worker remembers.
MEMO = 300_000
WORD = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+|_|\n")
REPEAT = "<repeat>"


def shape(word: str) -> str:
    """What a rare word looks like: case and length of letters, length of numbers, first signs of others."""
    if word[0].isalpha():
        case = "A" if word.isupper() and len(word) > 1 else "a" if word.islower() else "Aa" if word[1:].islower() or len(word) == 1 else "aA"
        return f"<{case}{min(len(word), 14)}>"
    return f"<0{min(len(word), 8)}>" if word[0].isdigit() else f"<{word[:2]}>"


def index_vector(word: str) -> np.ndarray:
    """The word's sparse random vector, from a hash: ONES components are 1 or -1, the rest 0."""
    r = np.random.Generator(np.random.PCG64(xxhash.xxh3_64_intdigest(word.encode())))
    out = np.zeros(DIMS, np.float32)
    out[r.choice(DIMS, ONES, replace=False)] = r.choice([-1.0, 1.0], ONES) / np.sqrt(ONES)
    return out


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


class Vectors:
    """Word vectors learned from sample texts: each word's index vector beside the sum of its neighbours' (its context)."""

    def __init__(self, sample: list[str]):
        counts: Counter = Counter()
        for text in sample:
            counts.update(WORD.findall(text))
        names = [w for w, c in counts.items() if c >= OWN]
        names += sorted({shape(w) for w in counts} | {"<other>", REPEAT})
        self.number = {w: i for i, w in enumerate(dict.fromkeys(names))}
        index = np.stack([index_vector(w) for w in self.number])
        context = np.zeros_like(index)
        for text in sample:
            ids = np.array(self.ids(text), np.int64)
            for o in range(1, WINDOW + 1):
                if len(ids) > o:
                    np.add.at(context, ids[:-o], index[ids[o:]])
                    np.add.at(context, ids[o:], index[ids[:-o]])
        size = np.linalg.norm(context, axis=1, keepdims=True)
        self.table = np.hstack([index, context / np.maximum(size, 1e-9)]).astype(np.float32)
        self.squares = self.table**2

    def ids(self, text: str) -> list[int]:
        number = self.number
        return [number[w] if w in number else number.get(shape(w), number["<other>"]) for w in WORD.findall(text)]

    def _chunk(self, chunk: str) -> bytes:
        return np.array(self.ids(chunk), np.int32).tobytes()

    def pool(self, batch: list[str], memo: Memo) -> np.ndarray:
        """A row per text: mean and spread of its word vectors, the share of words that repeat the one before, its length."""
        rows, ids, repeats = [], [], []
        for text in batch:
            chunks = text.replace("\n", " \n").split(" ")
            repeats.append(sum(map(operator.eq, chunks, chunks[1:])))
            ids.append(np.frombuffer(b"".join(map(memo.__getitem__, chunks)), np.int32))
            rows.append(len(ids[-1]))
        n, v = np.array(rows), len(self.table)
        key, count = np.unique(np.repeat(np.arange(len(batch)), n) * v + np.concatenate([*ids, np.empty(0, np.int32)]), return_counts=True)
        word, count = key % v, count[:, None].astype(np.float32)
        total, squares = (np.zeros((len(batch), self.table.shape[1]), np.float32) for _ in range(2))
        if len(key):
            starts = np.searchsorted(key, np.flatnonzero(n) * v)
            total[n > 0] = np.add.reduceat(self.table[word] * count, starts)
            squares[n > 0] = np.add.reduceat(self.squares[word] * count, starts)
        many = np.maximum(n, 1)[:, None]
        mean = total / many
        spread = np.sqrt(np.maximum(squares / many - mean**2, 0))
        again = np.array(repeats)[:, None] / many
        return np.hstack([mean, spread, again, np.sqrt(again), np.log1p(n)[:, None]]).astype(np.float64)

    def memo(self) -> Memo:
        return Memo(self._chunk, MEMO)


class Network:
    """One hidden layer, fitted by Adam on the logistic loss; a temperature, fitted on rows held back, calibrates it."""

    def __init__(self, x: np.ndarray, y: np.ndarray, hidden: int = 32, epochs: int = 30, seed: int = 5):
        r = np.random.Generator(np.random.PCG64(seed))
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-3
        x, back = (x - self.mean) / self.scale, r.random(len(x)) < 0.2
        self.p = [r.normal(size=(x.shape[1], hidden)) / np.sqrt(x.shape[1]), np.zeros(hidden), r.normal(size=hidden) / np.sqrt(hidden), np.zeros(1)]
        self.temperature = 1.0
        self._fit(x[~back], y[~back], epochs, r)
        if back.any():
            z = self._raw(x[back])
            grid = np.exp(np.linspace(-2, 3, 101))
            self.temperature = float(min(grid, key=lambda t: -np.mean(np.log(np.where(y[back] > 0, sigmoid(z / t), sigmoid(-z / t)) + 1e-12))))

    def _fit(self, x: np.ndarray, y: np.ndarray, epochs: int, r: np.random.Generator) -> None:
        first, second, step = [np.zeros_like(p) for p in self.p], [np.zeros_like(p) for p in self.p], 0
        for _ in range(epochs):
            order = r.permutation(len(x))
            for lo in range(0, len(order), 64):
                a, b = x[order[lo : lo + 64]], y[order[lo : lo + 64]]
                h = np.maximum(a @ self.p[0] + self.p[1], 0)
                g = (sigmoid(h @ self.p[2] + self.p[3][0]) - b) / len(b)
                gh = np.outer(g, self.p[2]) * (h > 0)
                step += 1
                for p, grad, m, s in zip(self.p, (a.T @ gh + 1e-3 * self.p[0], gh.sum(0), h.T @ g + 1e-3 * self.p[2], np.array([g.sum()])), first, second, strict=True):
                    m += 0.1 * (grad - m)
                    s += 0.001 * (grad**2 - s)
                    p -= 3e-3 * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)

    def _raw(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(x @ self.p[0] + self.p[1], 0) @ self.p[2] + self.p[3][0]

    def score(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self._raw((x - self.mean) / self.scale) / self.temperature)


class Model:
    """Vectors and network; without labels of both kinds the score is their mean (one half without any)."""

    def __init__(self, sample: list[tuple[str, int]]):
        y = np.array([q for _, q in sample], float)
        self.prior = float(y.mean()) if len(y) else 0.5
        self.net = None
        if len(set(y.tolist())) == 2:
            self.vectors = Vectors([t for t, _ in sample])
            memo = self.vectors.memo()
            x = np.vstack([self.vectors.pool([t for t, _ in sample[lo : lo + 256]], memo) for lo in range(0, len(sample), 256)])
            self.net = Network(x, y)

    def memo(self) -> Memo | None:
        return self.vectors.memo() if self.net else None

    def score(self, batch: list[str], memo: Memo | None) -> np.ndarray:
        return self.net.score(self.vectors.pool(batch, memo)) if self.net else np.full(len(batch), self.prior)


def held_out(id_col: str):
    """crc32 of the id as text, mod 3, is 1; ids that are null count as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 3 == 1


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> Model:
    """The model from at most `sample` labelled rows that are not held out: those whose ids hash lowest, as far as
    SAMPLE_BYTES of text go; rows that repeat id and text count once. Of an id's labels the
    largest counts; labels other than 0 and 1 and null texts do not. The driver gets the sample's texts."""
    chosen = labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(id_col)).groupBy(id_col).agg(F.max(label_col).cast("int").alias("__y"))
    chosen = chosen.orderBy(F.xxhash64(id_col), id_col).limit(sample)
    text = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__t")).filter(F.col("__t").isNotNull())
    own = text.join(F.broadcast(chosen.select(F.col(id_col).alias("__id"), "__y")), "__id").withColumn("__h", F.sha2("__t", 256))
    # first which rows, by id, length and a hash of the text: no task orders whole texts; rows that are equal in all count once
    order = [F.xxhash64("__id"), "__id", "__h"]
    light = own.groupBy("__id", "__h", "__y").agg(F.max(F.octet_length("__t")).alias("__n")).orderBy(*order).limit(sample)
    line = Window.orderBy(*order)
    fits = light.withColumns({"__sum": F.sum("__n").over(line.rowsBetween(Window.unboundedPreceding, 0)), "__k": F.row_number().over(line)})
    fits = fits.filter(F.col("__sum") <= SAMPLE_BYTES).select("__id", "__h", "__k")
    got = own.join(F.broadcast(fits), ["__id", "__h"]).groupBy("__k").agg(F.first("__t").alias("__t"), F.first("__y").alias("__y")).toArrow().sort_by("__k")
    model = Model(list(zip(got["__t"].to_pylist(), got["__y"].to_pylist(), strict=True)))
    del got
    give_back()  # the driver goes on, without the texts
    return model


def score(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """id_col, held_out, score (0 to 1), predicted (1 if score >= 0.5), and the columns in keep of each row, from its whole text alone.

    Null text counts as empty. Null and repeated ids are scored as any; an empty table gives no rows; columns that are not named
    are not read. One pass without a shuffle; the model, of the sample's size at most, is broadcast.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    # the text goes to the workers once, kept or not
    own = [c for c in keep if c != text_col]
    place = [own.index(c) + 3 if c != text_col else 2 for c in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        memo = model.memo()
        for batch in slices(batches, 256):
            scores = model.score(texts(batch.column(2)), memo)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores, pa.float64()), pa.array((scores >= 0.5).astype(np.int32)), *(batch.column(k) for k in place)], [id_col, "held_out", "score", "predicted", *keep])

    rows = docs.select(id_col, held_out(id_col).alias("__h"), F.col(text_col), *(F.col(f"`{c}`") for c in own))
    more = "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return rows.mapInArrow(giving_back(run), f"`{id_col}` {rows.schema[0].dataType.simpleString()}, held_out boolean, score double, predicted int{more}")
