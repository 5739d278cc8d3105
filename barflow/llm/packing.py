"""Packing by first-fit decreasing with a tournament tree of bin capacities, in randomised groups of documents."""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import byte_letters
from .common import Memo, giving_back, slices, texts

#: Documents in a group: enough that first-fit decreasing leaves about a thousandth of padding, few enough for any executor.
GROUP_ROWS = 2048
#: Words, parts of words among them, that each Python worker remembers.
MEMO = 400_000
#: The patterns of the tokenizers that are supported; their special strings begin with <|.
REPLACED = r"\s+"
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Characters that str.split() takes for white space and the tokenizer does not.
_ODD = ("\x1c", "\x1d", "\x1e", "\x1f")


class Tournament:
    """Bins of equal capacity; each inner node holds the largest room below it, so the first bin that fits is found in log n steps."""

    def __init__(self, bins: int, capacity: int):
        self.leaves = 1 << max(0, bins - 1).bit_length()
        self.room = [capacity] * (2 * self.leaves)

    def place(self, size: int) -> int:
        """Takes size from the first bin that has room for it; the bin's number."""
        room, at = self.room, 1
        while at < self.leaves:
            at *= 2
            at += room[at] < size
        room[at] -= size
        leaf = at
        while at > 1:
            at //= 2
            room[at] = max(room[2 * at], room[2 * at + 1])
        return leaf - self.leaves


def first_fit_decreasing(sizes: list[int], capacity: int) -> list[int]:
    """The bin of each size. sizes must already fall; none is over capacity."""
    tree = Tournament(max(1, len(sizes)), capacity)
    return [tree.place(s) for s in sizes]


class Words:
    """Token ids of a text by the tokenizer library, remembered by word.

    For tokenizers that drop white space and never look across it, the ids of a text are those of its words in turn. Words of ASCII and
    Western letters are split here and their parts go to the library's model, which is what the library does with them; others go
    through all of it.
    """

    #: Words that are split here: without special strings, and with characters that normalisation only lower-cases.
    SIMPLE = re.compile("[!-~À-ÖØ-öø-ÿ]+")
    PARTS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")

    def __init__(self, spec: str, wide: int):
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_str(spec)
        # the library's own memory of words belongs to the thread and outlives the tokenizer: a worker would keep one of each task
        self.lib.model._resize_cache(0)
        self.kind = {2: "H", 4: "I"}[wide]
        self.letters = dict(enumerate(byte_letters()))
        self.memo = Memo(self._word, MEMO)

    def _pack(self, ids: list[int]) -> bytes:
        return array(self.kind, ids).tobytes()

    def _part(self, part: str) -> bytes:
        return self._pack([t.id for t in self.lib.model.tokenize(part if part.isascii() else part.encode().decode("latin-1").translate(self.letters))])

    def _word(self, word: str) -> bytes:
        if self.SIMPLE.fullmatch(word) and "<|" not in word:
            parts = self.PARTS.findall(word.lower())
            # a part is a word of one part: all are remembered in one table
            return self._part(parts[0]) if len(parts) == 1 else b"".join(map(self.memo.__getitem__, parts))
        return self._pack(self.lib.encode(word, add_special_tokens=False).ids)

    def ids(self, text: str) -> bytes:
        if any(c in text for c in _ODD):
            return self._pack(self.lib.encode(text, add_special_tokens=False).ids)
        return b"".join(map(self.memo.__getitem__, text.split()))

    def close(self) -> None:
        """Parts the table from the object, which refer to each other, so that both go as soon as they are no longer used."""
        del self.memo


def pack(df: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", length: int = 2048, end_id: int = 1, group_rows: int = GROUP_ROWS, seed: int = 17) -> DataFrame:
    """Sequences of at most `length` tokens, as pieces: id_col, start, length, doc_tokens, sequence_id, offset, ids.

    A document's tokens are those of the tokenizer file at path (read by the driver, broadcast) without special tokens, then
    end_id. It is cut into pieces of `length` tokens and a rest. A full piece is a sequence; the rests of a group of about
    group_rows documents, drawn by a seeded hash of their places in the input, are packed by first-fit decreasing. ids: the piece's ids as
    little-endian unsigned 32-bit numbers. Ties in size go by id, then by place. sequence_id tells group and bin.

    Null text counts as empty: one token, end_id. Rows that repeat an id, or have none, are packed as documents of their own, and spread over
    the groups like others. df must give the same rows in the same order whenever it is read, as tables do. A
    text of any length moves as pieces. An empty table gives no rows. Other columns of df are not read.
    The only shuffle moves the pieces, by group and in the narrowest ids that hold the vocabulary.
    """
    spark = df.sparkSession
    with open(path, encoding="utf-8") as f:
        spec = f.read()
    model = json.loads(spec)
    steps, norm = model["pre_tokenizer"].get("pretokenizers", []), (model["normalizer"] or {}).get("normalizers", [])
    if [p["type"] for p in steps] != ["Split", "ByteLevel"] or steps[0]["pattern"] != {"Regex": SPLIT} or steps[0]["behavior"] != "Removed" or [n["type"] for n in norm] != ["NFC", "Replace", "Lowercase"]:
        raise ValueError(f"{path} is not a tokenizer that drops white space")
    if norm[1].get("pattern") != {"Regex": REPLACED} or norm[1].get("content") != " " or not all(t["content"].startswith("<|") for t in model["added_tokens"]):
        raise ValueError(f"{path} has other replacements or special strings than are known here")
    dtype = "<u2" if max([end_id, *model["model"]["vocab"].values(), *(t["id"] for t in model["added_tokens"])]) < 1 << 16 else "<u4"
    wide = np.dtype(dtype).itemsize
    shared = spark.sparkContext.broadcast(spec)
    groups = max(1, -(-df.count() // group_rows))
    rows = df.select(F.col(id_col), F.col(text_col), F.monotonically_increasing_id().alias("place"))
    kind = rows.schema[0].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, end = Words(shared.value, wide), np.array([end_id], dtype).tobytes()
        for batch in slices(batches):
            of, starts, totals, ids = [], [], [], []
            for k, text in enumerate(texts(batch.column(1))):
                all_ids = words.ids(text) + end
                n = len(all_ids) // wide
                for at in range(0, n, length):
                    of.append(k)
                    starts.append(at)
                    totals.append(n)
                    ids.append(all_ids[at * wide : (at + length) * wide])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of, pa.int64())), pa.array(starts, pa.int64()), pa.array(totals, pa.int64()), pa.array(ids, pa.binary()), batch.column(2).take(pa.array(of, pa.int64()))], ["id", "start", "total", "ids", "place"])
        words.close()

    def fill(key: tuple, group: pa.Table) -> pa.Table:
        own, start = group["id"].to_pylist(), group["start"].to_pylist()
        ids = [np.frombuffer(x, dtype) for x in group["ids"].to_pylist()]
        sizes = [len(x) for x in ids]
        total = group["total"].to_pylist()
        order = sorted(range(len(own)), key=lambda k: (-sizes[k], own[k] is None, 0 if own[k] is None else own[k], start[k], zlib.crc32(ids[k].tobytes())))
        bins = first_fit_decreasing([sizes[k] for k in order], length)
        used: dict[int, int] = {}
        offsets = []
        for k, b in zip(order, bins, strict=True):
            offsets.append(used.get(b, 0))
            used[b] = offsets[-1] + sizes[k]
        first = key[0].as_py() << 32
        return pa.table(
            {
                id_col: group["id"].take(pa.array(order, pa.int64())),
                "start": pa.array([start[k] for k in order], pa.int64()),
                "length": pa.array([sizes[k] for k in order], pa.int64()),
                "doc_tokens": pa.array([total[k] for k in order], pa.int64()),
                "sequence_id": pa.array([first + b for b in bins], pa.int64()),
                "offset": pa.array(offsets, pa.int64()),
                "ids": pa.array([ids[k].astype("<u4").tobytes() for k in order], pa.binary()),
            }
        )

    pieces = rows.mapInArrow(giving_back(cut), f"id {kind}, start long, total long, ids binary, place long")
    drawn = pieces.withColumn("grp", F.pmod(F.xxhash64("place", F.when(F.octet_length("ids") == length * wide, F.col("start")), F.lit(seed)), F.lit(groups))).drop("place")
    return drawn.groupBy("grp").applyInArrow(fill, f"`{id_col}` {kind}, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary")
