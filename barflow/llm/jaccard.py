"""Exact Jaccard join on word shingles, by token-combination prefixes.

Shingles ("tokens" of the join) have one global order, rare ones first. If two sets are similar enough, few of one's tokens
are missing in the other, so a set can be found by a prefix of its tokens in that order. Rare tokens are indexed alone. Frequent
ones fall into classes by hash, and are indexed in pairs within a class, which far fewer sets share; the prefix is extended
until so many tokens are in it that, with as many missing as similarity allows, a rare one or two of one class must remain. What
shares an index key is compared by bounds, then verified on whole sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, Tables, cut, give_back, giving_back, raw, slices, tables
from .components import components

#: Counters of the frequency table: a shingle's frequency is at most its counter. 16 MB whatever the input.
COUNTERS = 1 << 22
#: Parts in which the table is summed.
PARTS = 64
#: A shingle is frequent if its counter is over this and the mean counter, which is what other shingles add to it; but over BLOCK it always is, so
#: lists of single shingles stay short. Where counters are so full that most are over that, most shingles are indexed in pairs.
FREQUENT = 64
#: Words that each Python worker remembers.
MEMO = 300_000
#: Members of an index list that are compared at once; longer lists are cut into blocks, and blocks compared two by two.
BLOCK = 2048
#: Members of one block that are compared with all of the other at a time.
STRIP = 256
#: Of a block pair at most so many candidate pairs a component are verified at once; beyond, what connects them comes first.
FEW = 2
#: Pairs that a task of the comparison remembers, so that those of several lists leave it once.
PAIRS = 100_000
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads each bit of the 64-bit numbers over all."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def word_memo() -> Memo:
    return Memo(lambda w: xxhash.xxh3_64_intdigest(w).to_bytes(8, "little"), MEMO)


def shingles(text: bytes, words: int, memo: Memo) -> np.ndarray:
    """The set of 64-bit hashes of the text's shingles, ascending. Words: runs of bytes other than `[\\x20\\x09-\\x0D]`, A-Z
    lower-cased. A text of fewer words is one shingle, one without words none."""
    w = np.frombuffer(b"".join(map(memo.__getitem__, text.lower().split())), np.uint64)
    if not len(w):
        return w
    k = min(words, len(w))
    h = np.full(len(w) - k + 1, np.uint64(k * int(MULTIPLIER) % 2**64))
    for j in range(k):
        h = (h + w[j : len(w) - k + 1 + j]) * MULTIPLIER
        h ^= h >> np.uint64(29)
    return np.unique(mix(h))


def _pack_counts(table: np.ndarray) -> list[bytes]:
    """The table in PARTS, each dense or, where mostly 0, as places and counts; counts over 65535 stay there."""
    out = []
    for part in np.split(np.minimum(table, 65535).astype("<u2"), PARTS):
        at = np.flatnonzero(part)
        out.append(b"d" + part.tobytes() if len(at) * 3 > len(part) else b"s" + at.astype("<u4").tobytes() + part[at].tobytes())
    return out


def _add_counts(total: np.ndarray, packed: bytes) -> None:
    if packed[:1] == b"d":
        total += np.frombuffer(packed, "<u2", offset=1)
    else:
        n = (len(packed) - 1) // 6
        total[np.frombuffer(packed, "<u4", n, 1)] += np.frombuffer(packed, "<u2", n, 1 + 4 * n)


def count_table(df: DataFrame, hashes) -> np.ndarray:
    """Counters over all rows: hashes(batch) gives arrays of 64-bit numbers, each counted at its low bits. Each task hands on one
    table of fixed size; they are summed part by part, and the driver gets the one sum."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(COUNTERS, np.uint32)
        get = hashes()
        for batch in slices(batches):
            for h in get(batch):
                np.add.at(table, (h & np.uint64(COUNTERS - 1)).astype(np.int64), 1)
        yield pa.RecordBatch.from_arrays([pa.array(range(PARTS), pa.int32()), pa.array(_pack_counts(table), pa.binary())], ["part", "counts"])

    def add(key: tuple, group: pa.Table) -> pa.Table:
        total = np.zeros(COUNTERS // PARTS, np.uint64)
        for chunk in group["counts"].chunks:
            for packed in chunk:
                _add_counts(total, packed.as_py())
        return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "counts": pa.array([np.minimum(total, 2**32 - 1).astype("<u4").tobytes()], pa.binary())})

    out = np.zeros(COUNTERS, np.uint32)
    for r in df.mapInArrow(giving_back(count), "part int, counts binary").groupBy("part").applyInArrow(add, "part int, counts binary").collect():
        out[r.part * (COUNTERS // PARTS) : (r.part + 1) * (COUNTERS // PARTS)] = np.frombuffer(r.counts, "<u4")
    give_back()
    return out


class Index:
    """Index keys and bounds of one set, for a similarity of num / den."""

    def __init__(self, counters: np.ndarray, num: int, den: int):
        self.counters, self.num, self.den = counters, num, den
        self.limit = min(FREQUENT + int(counters.mean()), BLOCK)

    def missing(self, n: int) -> int:
        """How many tokens of a set of n can lack in a similar set."""
        return n - -(-self.num * n // self.den)

    def bands(self, n: int) -> list[int]:
        """Sets of 2**b to 2**(b + 1) - 1 tokens are of band b. A set also counts to the band below if sets there can be similar;
        so any two similar sets have a band in common."""
        b = n.bit_length() - 1
        return [b, b - 1] if b and -(-self.num * n // self.den) < 1 << b else [b]

    def classes(self, b: int) -> int:
        """Classes of frequent tokens in band b; 0 if its smallest sets are too small to promise two tokens of one class in common, then
        all tokens are indexed alone (at similarities over a half that is so for sets of one token)."""
        return min(max(min(16, (1 << b) // 4), (1 << b) // 32, 1), -(-self.num * (1 << b) // self.den) - 1)

    def keys(self, tokens: np.ndarray) -> np.ndarray:
        """The set's index keys as signed 64-bit numbers. Tokens that no other row has need none."""
        counts = self.counters[(tokens & np.uint64(len(self.counters) - 1)).astype(np.int64)]
        order = np.lexsort((tokens, counts))
        t, c = tokens[order], counts[order]
        need = self.missing(len(t)) + 1
        out = []
        for b in self.bands(len(t)):
            salt = mix(np.array([b + 1], np.uint64))
            rare = int(np.searchsorted(c, self.limit, "right")) if (classes := self.classes(b)) else len(t)
            alone, shared = t[: min(rare, need)], c[: min(rare, need)] > 1
            out.append(mix(alone[shared] ^ salt))
            if rare < need:
                rest = t[rare:]
                cls = (rest >> np.uint64(40)).astype(np.int64) % classes
                first = np.zeros(len(rest), bool)
                first[np.unique(cls, return_index=True)[1]] = True
                end = int(np.searchsorted(np.cumsum(~first), need - rare)) + 1
                rest, cls = rest[:end], cls[:end]
                by = np.argsort(cls, kind="stable")
                rest, cls = rest[by], cls[by]
                for step in range(1, int(np.bincount(cls).max(initial=0))):
                    same = cls[step:] == cls[:-step]
                    x, y = rest[:-step][same], rest[step:][same]
                    out.append(mix((np.minimum(x, y) * MULTIPLIER + np.maximum(x, y)) ^ salt))
        return np.unique(np.concatenate(out)).view(np.int64)

    def sketch(self, tokens: np.ndarray) -> bytes:
        """A bit field of the tokens' parities, about four bits a token: fields of similar sets differ in few bits."""
        bits = min(1 << 14, max(256, 1 << (len(tokens).bit_length() + 2)))
        field = np.bincount((tokens >> np.uint64(8) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
        return np.packbits(field.astype(np.uint8)).tobytes()

    def can_link(self, nx: np.ndarray, ny: np.ndarray, differ: np.ndarray) -> np.ndarray:
        """False where so different sizes, or so many tokens that only one has, rule the similarity out."""
        total = nx + ny
        least = -(-self.num * total // (self.num + self.den))
        return (differ <= total - 2 * least) & (least <= np.minimum(nx, ny))


def fold(sketch: np.ndarray, size: int) -> np.ndarray:
    """Sketches (a row each) folded to size bytes: the parities of fewer, wider places."""
    while sketch.shape[1] > size:
        half = sketch.shape[1] // 2
        # place p and p + half share their low bits
        sketch = sketch[:, :half] ^ sketch[:, half:]
    return sketch


def differing(x: list[bytes], y: list[bytes]) -> np.ndarray:
    """For each x and each y, a lower bound of the number of tokens that just one of the two sets has."""
    size = min(map(len, x + y))
    a, b = (np.concatenate([fold(np.frombuffer(s, np.uint8)[None], size) for s in z]).view(np.uint64) for z in (x, y))
    out = np.empty((len(a), len(b)), np.int64)
    for i in range(len(a)):
        out[i] = np.bitwise_count(a[i] ^ b).sum(1)
    return out


class Join:
    """The join of df's texts with themselves. Words a shingle, and similarity as num / den (whole numbers)."""

    def __init__(self, df: DataFrame, id_col: str, text_col: str, words: int, num: int, den: int, own: Tables):
        self.docs = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
        self.words, self.num, self.den, self.id_col = words, num, den, id_col
        self.spark, self.tables = df.sparkSession, own

    def _index(self) -> DataFrame:
        """Per row: id, n, fp (128-bit hash of the set), keys, sketch."""
        words, num, den = self.words, self.num, self.den

        def hashes():
            memo = word_memo()
            return lambda batch: (shingles(t, words, memo) for t in raw(batch.column(0)))

        with self.tables.tidied():
            shared = self.spark.sparkContext.broadcast(count_table(self.docs.select("text"), hashes))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index, memo = Index(shared.value, num, den), word_memo()
            for batch in slices(batches):
                n, fp, keys, sketch = [], [], [], []
                for text in raw(batch.column(1)):
                    s = shingles(text, words, memo)
                    n.append(len(s))
                    fp.append(xxhash.xxh3_128_digest(s.tobytes()))
                    keys.append(index.keys(s) if len(s) else [])
                    sketch.append(index.sketch(s))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(fp, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(sketch, pa.binary())], ["id", "n", "fp", "keys", "sketch"])

        base = self.tables.keep(self.docs.mapInArrow(giving_back(run), "id long, n long, fp binary, keys array<long>, sketch binary"), "base")
        shared.destroy()
        return base

    def verify(self, pairs: DataFrame, name: str) -> DataFrame:
        """Of distinct pairs (a, b) of ids (a written table) the ones whose whole sets are similar. Texts are read again, and only the
        sets of ids in pairs (told by a table of fixed size) leave the scan."""
        words, num, den = self.words, self.num, self.den
        with self.tables.tidied():
            table = count_table(pairs.select(F.explode(F.array("a", "b")).alias("id")), lambda: lambda batch: [mix(batch.column(0).to_numpy().view(np.uint64))])
        wanted = self.spark.sparkContext.broadcast(np.packbits(table > 0))

        def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            memo, bits = word_memo(), np.unpackbits(wanted.value).view(bool)
            for batch in batches:
                own = batch.column(0).fill_null(-1).to_numpy()
                at = np.flatnonzero(bits[(mix(own.view(np.uint64)) & np.uint64(COUNTERS - 1)).astype(np.int64)])
                for part in slices([batch.take(pa.array(at))]):
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array([shingles(t, words, memo).tobytes() for t in raw(part.column(1))], pa.binary())], ["id", "tokens"])

        def similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches):
                good = []
                for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                    x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    good.append(den * both >= num * (len(x) + len(y) - both) > 0)
                yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(good, pa.bool_())), batch.column(1).filter(pa.array(good, pa.bool_()))], ["a", "b"])

        whole = self.docs.filter("id IS NOT NULL").mapInArrow(giving_back(sets), "id long, tokens binary")
        one = pairs.join(whole.select(F.col("id").alias("a"), F.col("tokens").alias("x")), "a")
        two = one.join(whole.select(F.col("id").alias("b"), F.col("tokens").alias("y")), "b")
        # rows that repeat an id can repeat a link; components takes that
        links = self.tables.keep(two.select("a", "b", "x", "y").mapInArrow(giving_back(similar), "a long, b long"), name)
        wanted.destroy()
        return links

    def _bounded(self, pairs: DataFrame, sketches: DataFrame) -> DataFrame:
        """Pairs that sizes and sketches do not rule out."""
        num, den = self.num, self.den

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = Index(np.zeros(COUNTERS, np.uint8), num, den)
            for batch in slices(batches, 4096):
                c = [batch.column(k) for k in range(6)]
                n = [c[k].to_numpy() for k in (2, 3)]
                differ = np.array([differing([x], [y])[0, 0] for x, y in zip(c[4].to_pylist(), c[5].to_pylist(), strict=True)], np.int64)
                good = pa.array(index.can_link(n[0], n[1], differ))
                yield pa.RecordBatch.from_arrays([c[0].filter(good), c[1].filter(good)], ["a", "b"])

        side = lambda i, k: sketches.select(F.col("id").alias(i), F.col("n").alias(f"n{k}"), F.col("sketch").alias(f"s{k}"))
        sized = pairs.join(side("a", 1), "a").join(side("b", 2), "b").filter(F.greatest("n1", "n2") * self.num <= F.least("n1", "n2") * self.den)
        return sized.select("a", "b", "n1", "n2", "s1", "s2").mapInArrow(giving_back(run), "a long, b long")

    def _blocks(self, rows: DataFrame, sketches: DataFrame) -> DataFrame:
        """Members (id, component) of the lists in rows that have more than one component, with n and sketch, in blocks of about BLOCK:
        each block pair (key, i, j) has the members of blocks i and j."""
        split = rows.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo < hi").select("key")
        rows = rows.join(split, "key").join(sketches.select("id", "n", "sketch"), "id")
        rows = rows.withColumn("nb", F.greatest(F.lit(1), F.ceil(F.col("members") / BLOCK)).cast("int"))
        rows = rows.withColumn("own", F.pmod(F.xxhash64("id"), F.col("nb")).cast("int"))
        rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
        return rows.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "id", "component", "n", "sketch")

    def _compare(self, blocks: DataFrame, every: bool) -> DataFrame:
        """Pairs (a, b) of ids of a block pair that lie in different components so far and that bounds do not rule out. Of a block pair with
        over FEW such pairs a component, unless every, just enough come to connect what all of them would, and a row without ids that
        names it (key, i, j)."""
        num, den = self.num, self.den

        def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = Index(np.zeros(COUNTERS, np.uint8), num, den)
            held: list[tuple] = []
            out: list[tuple] = []
            sent: set[tuple[int, int]] = set()

            def close() -> None:
                key, i, j = held[0][:3]
                left, right = [h for h in held if h[3] == i], [h for h in held if h[3] == j]
                if not left or not right:
                    return
                ids, comp, n = ([np.array([h[k] for h in side]) for side in (left, right)] for k in (4, 5, 6))
                near, sketches = comp[0][:, None] != comp[1][None], [h[7] for h in right]
                for lo in range(0, len(left), STRIP):
                    strip = slice(lo, lo + STRIP)
                    near[strip] &= index.can_link(n[0][strip, None], n[1][None], differing([h[7] for h in left[strip]], sketches))
                a, b = np.nonzero(np.triu(near) if i == j else near)
                whole = every or len(a) <= FEW * len({h[5] for h in held})
                if len(sent) > PAIRS:
                    sent.clear()
                if not whole:
                    out.append((None, None, key, i, j))
                root: dict[int, int] = {}

                def find(c: int) -> int:
                    while root.get(c, c) != c:
                        root[c] = c = root.get(root[c], root[c])
                    return c

                for x, y in zip(a, b, strict=True):
                    if not whole:
                        u, v = find(int(comp[0][x])), find(int(comp[1][y]))
                        if u == v:
                            continue
                        root[max(u, v)] = min(u, v)
                    pair = int(min(ids[0][x], ids[1][y])), int(max(ids[0][x], ids[1][y]))
                    if pair not in sent:
                        sent.add(pair)
                        out.append((*pair, None, None, None))

            def flush() -> pa.RecordBatch:
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32())
                columns = [pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)]
                out.clear()
                return pa.RecordBatch.from_arrays(columns, ["a", "b", "key", "i", "j"])

            for batch in slices(batches):
                for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if held and row[:3] != held[0][:3]:
                        close()
                        held.clear()
                    held.append(row)
                if len(out) > 10000:
                    yield flush()
            if held:
                close()
            yield flush()

        grouped = blocks.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
        return grouped.mapInArrow(giving_back(compare), "a long, b long, key long, i int, j int").distinct()

    def run(self) -> DataFrame:
        keep, drop = self.tables.keep, self.tables.drop
        base = self._index()
        # one set stands for all rows with the same
        first = lambda c: F.first(c).alias(c)
        sets = keep(base.filter("n > 0 AND id IS NOT NULL").groupBy("fp").agg(F.min("id").alias("id"), *map(first, ("n", "keys", "sketch"))), "sets")
        # keys and sketches are most of what lies on disk, and are read from sets from here on
        base = keep(base.select("id", "n", "fp"), "rows")
        drop("base")
        entries = sets.select("id", F.xxhash64("fp").alias("one"), F.xxhash64(F.lit(1), "fp").alias("two"), F.explode("keys").alias("key"))
        lists = entries.groupBy("key").agg(F.count("*").alias("members"), F.min("id").alias("first"), F.bit_xor("one").alias("one"), F.bit_xor("two").alias("two"))
        # lists of the same members (told by a 128-bit sum of their sets, number and least id) give the same pairs: one stands for all
        lists = lists.filter("members > 1").groupBy("members", "first", "one", "two").agg(F.min("key").alias("key"))
        # written first, so that the shuffles of all entries by key, for the lists and for their members, do not lie on disk together
        lists = keep(lists.select("key", "members", "first"), "lists")
        entries = keep(entries.select("id", "key").join(lists, "key"), "entries")
        drop("lists")
        sketches = sets.select("id", "n", "sketch")
        # first every member of a list with the list's smallest, then what is still apart
        stars = entries.filter("id <> first").select(F.col("first").alias("a"), F.col("id").alias("b")).distinct()
        links = self.verify(keep(self._bounded(stars, sketches), "stars"), "star-links")
        known = components(links, self.tables, "known", rounds=1)
        rows = entries.filter("members > 2").join(known, "id", "left").select("key", "id", "members", F.coalesce("component", "id").alias("component"))
        rows = keep(rows, "open")
        drop("entries")
        blocks = self._blocks(rows, sketches)
        found = keep(self._compare(blocks, False), "found")
        links = links.unionByName(self.verify(found.filter("a IS NOT NULL").select("a", "b"), "block-links"))
        crowded = found.filter("a IS NULL").select("key", "i", "j")
        if not crowded.isEmpty():
            known = components(links, self.tables, "more", rounds=2)
            rest = rows.drop("component").join(known, "id", "left").withColumn("component", F.coalesce("component", "id"))
            rest = self._blocks(keep(rest.join(crowded.select("key").distinct(), "key", "left_semi"), "crowded"), sketches)
            found = keep(self._compare(rest.join(crowded, ["key", "i", "j"], "left_semi"), True), "rest")
            links = links.unionByName(self.verify(found.select("a", "b"), "rest-links"))
        known = components(links, self.tables, "last")
        label = sets.select("fp", "id").join(known, "id", "left").select("fp", F.coalesce("component", "id").alias("component"))
        out = base.join(label, "fp", "left")
        out = out.select(F.col("id").alias(self.id_col), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("id")).alias("component_id"))
        with self.tables.tidied():
            return cut(out)


def near_duplicates(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: tuple[int, int] = (8, 10)) -> DataFrame:
    """id_col, n_shingles, component_id of each row: the size of its set of word shingles, and the smallest id reachable by links.

    Two rows link if the Jaccard similarity of their sets is at least similarity[0] / similarity[1], compared in whole numbers. No
    link between different sets is lost; equal sets are one. Sets are compared by 64-bit hashes of shingles.

    Ids are whole numbers (others fail when Spark casts them). Null text counts as empty; empty texts link with nothing and are their own
    components. Rows without id take the smallest id
    of rows with the same set, null if there is none. Rows that repeat an id are one document, with the links of all its texts. An
    empty table gives no rows; other columns are not read.

    Candidates: members of an index list are first compared with the list's smallest id only, which settles most groups in time
    proportional to their size; then pairs of a list that are still in different components are compared, in blocks. All bounds
    are exact, so nothing is missed, whatever the size of a list. Steps are written to the shared folder and deleted at the end; what is
    returned is a checkpoint.
    """
    with tables(df.sparkSession) as own:
        return Join(df, id_col, text_col, words, *similarity, own).run()
