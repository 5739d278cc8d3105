"""BPE encoding and decoding by speculating and verifying.

Greedy longest match proposes the tokens of every new word. All neighbouring pairs of a batch are then tested at once for
compatibility (see bpe.Pairs). A word whose pairs all pass is encoded right; only failing words go through exact merging.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import chain, filterfalse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .bpe import Bpe, Pairs, fits, plain, segments
from .common import slices, texts, uncollected

#: Segments, and as many words, that each Python worker remembers.
MEMO = 600_000


class Recent(dict):
    """A table of bounded size. When half of it is new, or its keys are long, what was not asked for since the last time goes."""

    def __init__(self, limit: int):
        super().__init__()
        self.half, self.old, self.letters = limit // 2, {}, 0

    def missing(self, wanted: set) -> list:
        """What of wanted is in neither generation; what is in the older one moves to the newer."""
        if len(self) >= self.half or self.letters > 32 * self.half:
            self.old, self.letters = dict(self), 0
            self.clear()
        new = list(filterfalse(self.__contains__, wanted))
        self.letters += sum(map(len, new))
        back = list(filter(self.old.__contains__, new))
        if not back:
            return new
        self.update(zip(back, map(self.old.__getitem__, back), strict=True))
        return list(filterfalse(self.old.__contains__, new))


class Codec:
    """Encodes and decodes with one model. Words and text segments are remembered up to a limit.

    What is remembered: decimal ids joined by commas, and the bytes that the ids decode to.
    """

    #: Segments whose pre-tokens are plain to see: a line end or none, letters with a space or none, other signs.
    SIMPLE = re.compile(r"(\n?)( ?[A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)")

    def __init__(self, bpe: Bpe, limit: int = MEMO):
        self.bpe = bpe
        self.pairs = Pairs(bpe)
        #: the most letters of a token by its first two
        self.longest: dict[str, int] = {}
        for token in bpe.alone:
            self.longest[token[:2]] = max(len(token), self.longest.get(token[:2], 1))
        self.known, self.words = Recent(limit), Recent(limit)
        #: of chunks that stand for a segment of their own (None if they do not)
        self.chunks = Recent(limit)
        self.merged = 0

    def greedy(self, word: str) -> list[int]:
        alone, ids, out, at, n = self.bpe.alone, self.bpe.vocab, [], 0, len(word)
        while at < n:
            end = min(n, at + self.longest.get(word[at : at + 2], 1))
            while word[at:end] not in alone:
                end -= 1
            out.append(ids[word[at:end]])
            at = end
        return out

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """The ids of each word (in byte letters)."""
        out = [self.greedy(w) for w in words]
        sizes = np.fromiter(map(len, out), np.int64, len(out))
        flat = np.fromiter(chain.from_iterable(out), np.int64, int(sizes.sum()))
        of = np.repeat(np.arange(len(out)), sizes)
        inner = np.flatnonzero(of[1:] == of[:-1]) if len(flat) else np.empty(0, np.int64)
        keys, back = np.unique(flat[inner] * self.pairs.n + flat[inner + 1], return_inverse=True)
        good = self.pairs.compatible(keys // self.pairs.n, keys % self.pairs.n)[back]
        failing, number, merge = np.unique(of[inner[~good]]).tolist(), self.bpe.vocab.__getitem__, self.bpe.merge
        self.merged += len(failing)
        for k in failing:
            out[k] = list(map(number, merge(words[k])))
        return out

    def learn(self, new: list[str]) -> list[tuple[str, bytes]]:
        """What is remembered of each of the segments."""
        simple, split = self.SIMPLE.fullmatch, []
        for s in new:
            m = simple(s)
            split.append([g for g in m.groups() if g] if m else self.bpe.pretokens(s))
        words = self.words.missing({w for ws in split for w in ws})
        spell = self.bpe.token_bytes.__getitem__
        for w, ids in zip(words, self.encode_words(list(map(self.bpe.letters, words))), strict=True):
            self.words[w] = (",".join(map(str, ids)), b"".join(map(spell, ids)))
        got = self.words.__getitem__
        out = []
        for ws in split:
            if len(ws) == 1:
                out.append(got(ws[0]))
            elif len(ws) == 2:
                (ids, spelled), (more, rest) = got(ws[0]), got(ws[1])
                out.append((f"{ids},{more}", spelled + rest))
            else:
                parts = list(map(got, ws))
                out.append((",".join([p[0] for p in parts]), b"".join([p[1] for p in parts])))
        return out

    def _remember(self, table: Recent, wanted: set[str], segment) -> None:
        new = table.missing(wanted)
        parts = list(map(segment, new))
        if None in parts:
            table.update(dict.fromkeys(k for k, p in zip(new, parts, strict=True) if p is None))
            new = [k for k, p in zip(new, parts, strict=True) if p is not None]
            parts = [p for p in parts if p is not None]
        table.update(zip(new, self.learn(parts), strict=True))

    @uncollected()
    def encode_batch(self, batch: list[str]) -> list[tuple[str, bytes]]:
        """For each text its decimal ids joined by commas, and the bytes that the ids decode to."""
        parts = [self.bpe.parts(t) for t in batch]
        chunked = [[plain(p) for p in ps[::2]] for ps in parts]
        self._remember(self.chunks, set().union(*(c[1:] for cs in chunked for c in cs if c)), fits)
        slow: dict[tuple[int, int], list[str]] = {}
        quick: dict[tuple[int, int], list] = {}
        for d, (ps, cs) in enumerate(zip(parts, chunked, strict=True)):
            for k, (p, c) in enumerate(zip(ps[::2], cs, strict=True)):
                got = list(map(self.chunks.__getitem__, c[1:])) if c and fits(c[0]) is not None else [None]
                slow[d, k] = segments(p) if None in got else [c[0]]
                quick[d, k] = [] if None in got else got
        self._remember(self.known, set().union(*slow.values()), lambda s: s)
        out = []
        for d, ps in enumerate(parts):
            found: list[tuple[str, bytes]] = []
            for k, p in enumerate(ps):
                if k % 2:
                    found.append((str(self.bpe.special[p]), p.encode()))
                else:
                    found += map(self.known.__getitem__, slow[d, k // 2])
                    found += quick[d, k // 2]
            ids, spelled = zip(*found, strict=True) if found else ((), ())
            out.append((",".join(filter(None, ids)), b"".join(spelled)))
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of ids; bytes that are no UTF-8 become U+FFFD, ids that the model lacks are passed over."""
        spell = self.bpe.token_bytes
        return b"".join(spell[i] for i in ids if i in spell).decode("utf-8", "replace")


_CODECS: dict[str, Codec] = {}


def _codec(shared, path: str) -> Codec:
    """The Python worker's codec for the file, kept with what it remembers from one task to the next."""
    if path not in _CODECS:
        _CODECS.clear()
        _CODECS[path] = Codec(shared.value)
    return _CODECS[path]


def encode(df: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, ids (array<int>) of each row of df; special strings inside texts become their ids. Null text: no ids.

    One pass without a shuffle. Null and repeated ids are returned as they come; an empty table gives no rows; other columns
    of df are not read.
    """
    shared = df.sparkSession.sparkContext.broadcast(Bpe(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared, path)
        for batch in slices(batches):
            ids = [np.array(doc.split(",") if doc else [], np.int32) for doc, _ in codec.encode_batch(texts(batch.column(1)))]
            ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*ids, np.empty(0, np.int32)])))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], [id_col, "ids"])

    rows = df.select(id_col, text_col)
    return rows.mapInArrow(run, f"`{id_col}` {rows.schema[0].dataType.simpleString()}, ids array<int>")


def decode(df: DataFrame, path: str, *, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id_col, text: the inverse of encode. Null ids give the empty text."""
    shared = df.sparkSession.sparkContext.broadcast(Bpe(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared, path)
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([codec.decode(x or []) for x in batch.column(1).to_pylist()], pa.string())], [id_col, "text"])

    rows = df.select(id_col, ids_col)
    return rows.mapInArrow(run, f"`{id_col}` {rows.schema[0].dataType.simpleString()}, text string")


def round_trip(df: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_tokens, ids_sha256, decoded_sha256: digests of what encode and decode give, in one pass over df.

    ids_sha256 is over the decimal ids joined by commas, decoded_sha256 over the decoded text in UTF-8. Nulls, repeated rows,
    empty tables and other columns as in encode.
    """
    shared = df.sparkSession.sparkContext.broadcast(Bpe(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared, path)
        for batch in slices(batches):
            coded = codec.encode_batch(texts(batch.column(1)))
            n = [doc.count(",") + 1 if doc else 0 for doc, _ in coded]
            ids = [hashlib.sha256(doc.encode()).hexdigest() for doc, _ in coded]
            back = [hashlib.sha256(spelled.decode("utf-8", "replace").encode()).hexdigest() for _, spelled in coded]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(back, pa.string())],
                [id_col, "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    rows = df.select(id_col, text_col)
    return rows.mapInArrow(run, f"`{id_col}` {rows.schema[0].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")
