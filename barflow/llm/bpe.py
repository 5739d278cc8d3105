"""Byte-level BPE from a tokenizer file: splitting, exact merging, and what can be proved about single tokens."""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Callable, Iterator
from functools import cached_property
from itertools import repeat

import numpy as np
import regex

from .common import Memo

#: The byte-level pre-tokenisation pattern, and the characters that are white space in it.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SPACES = "\t\n\x0b\x0c\r \x85\xa0  -     　"

NEVER = 1 << 60
#: From this length on, merging uses a heap; below, a scan of the ranks is faster.
LONG = 96
_SEGMENT = re.compile(f"[{SPACES}]*[^{SPACES}]+|[{SPACES}]+")
_EDGE = re.compile(f"[{SPACES}]")


def byte_letters() -> str:
    """The letter that stands for each byte in byte-level vocabularies: printable Latin-1 stands for itself."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return "".join(chr(b if b in own else next(spare)) for b in range(256))


class Bpe:
    """The model of a byte-level tokenizer file. Small and picklable; heavier tables are built on first use.

    Only what such a file can say without normaliser, prefix space or unknown token is supported; others raise.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec["pre_tokenizer"]
        if spec["normalizer"] or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre["use_regex"] or model["ignore_merges"] or model["end_of_word_suffix"]:
            raise ValueError(f"{path} is not a plain byte-level BPE")
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.vocab: dict[str, int] = model["vocab"]
        self.ranks: dict[tuple[str, str], int] = {p: i for i, p in enumerate(pairs)}
        self.special: dict[str, int] = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.children: dict[str, tuple[str, str]] = {}
        self.alone = frozenset(self._prove())

    def _prove(self) -> Iterator[str]:
        """Vocabulary strings that, encoded alone, give just their own token. Records the last merge of each."""
        for token in self.vocab:
            if len(token) == 1:
                yield token
            elif len(last := self.merge(token, stop=2)) == 2 and (last[0], last[1]) in self.ranks:
                self.children[token] = (last[0], last[1])
                yield token

    def merge(self, word: str, stop: int = 1) -> list[str]:
        """Exact merging of byte letters: always the pair of lowest rank, leftmost first, while over stop parts are left."""
        if len(word) > LONG:
            return self._merge_long(word)
        parts, rank = list(word), self.ranks.get
        rs = list(map(rank, zip(parts, parts[1:], strict=False), repeat(NEVER)))
        while len(parts) > stop and rs:
            r = min(rs)
            if r == NEVER:
                break
            i = rs.index(r)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del rs[i]
            if i < len(rs):
                rs[i] = rank((parts[i], parts[i + 1]), NEVER)
            if i:
                rs[i - 1] = rank((parts[i - 1], parts[i]), NEVER)
        return parts

    def _merge_long(self, word: str) -> list[str]:
        """The same with a heap and links, in n log n steps."""
        parts: list[str | None] = list(word)
        n, rank = len(parts), self.ranks.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, parts[i] + parts[i + 1]) for i in range(n - 1) if (r := rank((parts[i], parts[i + 1]), NEVER)) != NEVER]
        heapq.heapify(heap)
        while heap:
            _, i, made = heapq.heappop(heap)
            j = after[i] if parts[i] is not None else n
            if j >= n or parts[i] + parts[j] != made or (parts[i], parts[j]) not in self.ranks:
                continue
            parts[i], parts[j] = made, None
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < n and (r := rank((parts[a], parts[b]), NEVER)) != NEVER:
                    heapq.heappush(heap, (r, a, parts[a] + parts[b]))
        return [p for p in parts if p is not None]

    @cached_property
    def _letters(self) -> dict[int, str]:
        return dict(enumerate(byte_letters()))

    @cached_property
    def _pattern(self):
        return regex.compile(PATTERN)

    @cached_property
    def token_bytes(self) -> dict[int, bytes]:
        back = {c: b for b, c in enumerate(byte_letters())}
        return {i: bytes(map(back.__getitem__, s)) for s, i in self.vocab.items()} | {i: s.encode() for s, i in self.special.items()}

    def letters(self, word: str) -> str:
        """The word in byte letters."""
        return word.replace(" ", self._letters[32]) if word.isascii() and word.isprintable() else word.encode().decode("latin-1").translate(self._letters)

    def pretokens(self, segment: str) -> list[str]:
        return self._pattern.findall(segment)

    def words(self, segment: str) -> list[str]:
        """The segment's pre-tokens in byte letters."""
        return list(map(self.letters, self._pattern.findall(segment)))

    @cached_property
    def _special(self):
        return re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def parts(self, text: str) -> list[str]:
        """Ordinary text and special strings in turn: those at odd places are special tokens."""
        return self._special.split(text) if self._special and any(s in text for s in self.special) else [text]

    def __getstate__(self):
        return {k: self.__dict__[k] for k in ("vocab", "ranks", "special", "children", "alone")}


def segments(text: str) -> list[str]:
    """text cut so that no pre-token crosses a cut: white space goes with what follows it."""
    return _SEGMENT.findall(text)


def plain(text: str) -> list[str] | None:
    """Chunks between single spaces or before single line ends, if text has no other white space at a chunk's edge; else None.

    The first chunk is a segment. Each other one is a segment as it is if it begins with a line end, else after a space.
    """
    chunks = text.replace("\n", " \n").split(" ")
    return chunks if "" not in chunks else None


def fits(chunk: str) -> str | None:
    """The segment that a chunk after the first stands for; None if white space at its edges belongs with its neighbours'."""
    body = chunk[1:] if chunk[:1] == "\n" else chunk
    if not body or _EDGE.match(body[0]) or _EDGE.match(body[-1]):
        return None
    return chunk if chunk[0] == "\n" else " " + chunk


class SegmentMap:
    """Values of fn for each segment of a text, in order, remembered by segment."""

    def __init__(self, fn: Callable[[str], object], limit: int):
        self.whole = Memo(fn, limit)
        self.chunk = Memo(self._chunk, limit)

    def _chunk(self, chunk: str):
        segment = fits(chunk)
        return None if segment is None else self.whole.fn(segment)

    def values(self, text: str) -> list:
        if (chunks := plain(text)) and not _EDGE.match(chunks[0][-1]):
            got = list(map(self.chunk.__getitem__, chunks[1:]))
            if None not in got:
                return [self.whole[chunks[0]], *got]
        return list(map(self.whole.__getitem__, segments(text)))


class Pairs:
    """Which tokens can stand side by side: (a, b) can if the merges of their joint bytes end in just a and b.

    Going back in time from a and b, always the piece made last at the border is undone. If the two pieces at the border could
    ever have merged before either went into its own parent, they would have, and (a, b) cannot come about. Where ranks tie, the
    left merge comes first.
    """

    def __init__(self, bpe: Bpe):
        ids = bpe.vocab
        self.n = n = max(ids.values()) + 1
        self.left, self.right = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
        self.born = np.full(n, -1, np.int64)
        for token, (a, b) in bpe.children.items():
            self.left[ids[token]], self.right[ids[token]], self.born[ids[token]] = ids[a], ids[b], bpe.ranks[a, b]
        keys = np.array([ids[a] * n + ids[b] for a, b in bpe.ranks], np.int64)
        order = np.argsort(keys)
        self.keys, self.rank = keys[order], order.astype(np.int64)

    def merged_at(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.keys, key := x * self.n + y), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank[at], NEVER)

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        good = np.ones(len(a), bool)
        live = np.arange(len(a))
        x, y = a.copy(), b.copy()
        gone_x, gone_y = np.full(len(a), NEVER), np.full(len(a), NEVER)
        while len(live):
            r = self.merged_at(x, y)
            clash = (r < gone_x) & (r <= gone_y)
            good[live[clash]] = False
            bx, by = self.born[x], self.born[y]
            go = ~clash & ((bx >= 0) | (by >= 0))
            back_x = bx > by
            gone_x, gone_y = np.where(back_x, bx, gone_x)[go], np.where(back_x, gone_y, by)[go]
            x, y, live = np.where(back_x, self.right[x], x)[go], np.where(back_x, y, self.left[y])[go], live[go]
        return good
