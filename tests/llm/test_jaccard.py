"""The Jaccard join against brute force over all pairs, and the promise of its index."""

import random

import numpy as np
import pytest

from barflow.llm import jaccard
from barflow.llm.common import tables
from barflow.llm.components import components


def union(n, links):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def corpus(seed=4):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randrange(2, 6)))
    out = ["", None, " ", "One", "one", "one two", "One\tTWO", "one two three", "x y"]
    passage = [word() for _ in range(40)]
    for size in (3, 12, 60, 150, 400):
        for _ in range(8):
            base = [word() for _ in range(size)] + (passage if r.random() < 0.4 else [])
            out.append(" ".join(base))
            for _ in range(r.randrange(7)):
                copy = base[:]
                for _ in range(r.randrange(max(1, size // 18))):
                    copy[r.randrange(len(copy))] = word()
                out.append(r.choice([" ", "\n", "  "]).join(copy).title())
    hot = [word() for _ in range(100)]
    for _ in range(120):
        copy = hot[:]
        for _ in range(r.randrange(5)):
            copy[r.randrange(100)] = word()
        out.append(" ".join(copy))
    return out + ["long " * 30000, "long " * 30000 + "end"]


def brute(texts, words, num, den):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + words]) for i in range(len(w) - words + 1)} or ({tuple(w)} if w else set()))
    links = [(a, b) for a in range(len(sets)) for b in range(a) if sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b])]
    return list(zip(map(len, sets), union(len(sets), links), strict=True))


@pytest.mark.parametrize(("words", "num", "den"), [(3, 90, 100), (5, 8, 10)])
def test_join(spark, words, num, den):
    texts = corpus()
    want = brute(texts, words, num, den)
    df = spark.createDataFrame([(i, t, "key", 1) for i, t in enumerate(texts)], "doc_id long, text string, key string, n int").repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(df, words=words, similarity=(num, den)).collect()}
    assert got == dict(enumerate(want))


def test_edges(spark):
    df = spark.createDataFrame([(5, "a b c d"), (5, "a b c d"), (None, "a b c d"), (None, "q r s"), (None, None), (7, "A B C D")], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id) for r in jaccard.near_duplicates(df, words=3).collect() if r.component_id)
    assert got == [(0, 2, 5), (5, 2, 5), (5, 2, 5), (7, 2, 5)]
    assert jaccard.near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize(("num", "den"), [(90, 100), (8, 10)])
def test_similar_sets_share_a_key_and_pass_the_bounds(num, den):
    r = np.random.default_rng(2)
    counters = np.full(jaccard.COUNTERS, 2, np.uint32)
    counters[r.random(jaccard.COUNTERS) < 0.93] = 5000
    index = jaccard.Index(counters, num, den)
    index.frequent = 64
    for n in [1, 2, 5, 20, 63, 64, 65, 70, 130, 300, 500, 1100, 3000] * 6:
        a = np.unique(r.integers(0, 1 << 63, n).astype(np.uint64))
        keep = a[r.random(n) < r.choice([0.9, 0.95, 1.0])]
        b = np.unique(np.concatenate([keep, r.integers(0, 1 << 63, r.integers(0, n // 12 + 1)).astype(np.uint64)]))
        both = len(np.intersect1d(a, b))
        if len(b) and den * both >= num * (len(a) + len(b) - both):
            assert len(np.intersect1d(index.keys(a), index.keys(b))), n
            differ = jaccard.differing([index.sketch(a)], [index.sketch(b)])
            assert differ[0, 0] <= len(a) + len(b) - 2 * both
            assert index.can_link(np.array([len(a)]), np.array([len(b)]), differ[0])[0]
        assert len(index.keys(a)) < 3 * n + 40


def test_components(spark):
    r = random.Random(1)
    links = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 140)] + [(r.randrange(200, 300), r.randrange(200, 300)) for _ in range(60)]
    want = union(300, links)
    with tables(spark) as own:
        got = {x.id: x.component for x in components(spark.createDataFrame(links, "a long, b long"), own, "x").collect()}
        assert got == {i: want[i] for p in links if p[0] != p[1] for i in p}
        assert components(spark.createDataFrame([], "a long, b long"), own, "y").count() == 0
        part = {x.id: x.component for x in components(spark.createDataFrame(links, "a long, b long"), own, "z", rounds=1).collect()}
        assert set(part) == set(got) and all(got[i] == got[c] for i, c in part.items())


def test_long_lists(spark, monkeypatch):
    """Groups in which the smallest id is no copy of most, in lists of many blocks, with and without room for all candidates."""
    r = random.Random(9)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(6))
    passage, texts = [word() for _ in range(60)], []
    for _ in range(300):
        copy = passage + [word() for _ in range(2)]
        for _ in range(r.randrange(1, 4)):
            copy[r.randrange(60)] = word()
        texts.append(" ".join(copy))
    want = brute(texts, 3, 70, 100)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert 3 < len({c for _, c in want}) < 290
    for block, few in ((16, 2), (512, 0)):
        monkeypatch.setattr(jaccard, "BLOCK", block)
        monkeypatch.setattr(jaccard, "FEW", few)
        got = {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard.near_duplicates(df, words=3, similarity=(70, 100)).collect()}
        assert got == dict(enumerate(want)), (block, few)


def test_full_counters_make_no_long_lists():
    """With far fewer counters than shingles no list of different sets is long, and similar sets still share a key."""
    from collections import Counter

    from barflow.llm.jaccard import FREQUENT, Index

    r = np.random.default_rng(7)
    common = r.integers(0, 2**63, 300, dtype=np.uint64)
    sets = [np.unique(np.concatenate([r.choice(common, 25, replace=False), r.integers(0, 2**63, 25, dtype=np.uint64)])) for _ in range(3000)]
    near = [np.unique(np.concatenate([s[: len(s) - 4], r.integers(0, 2**63, 4, dtype=np.uint64)])) for s in sets[:200]]
    table = np.bincount((np.concatenate(sets) & np.uint64(1023)).astype(np.int64), minlength=1024).astype(np.uint32)
    assert table.mean() > FREQUENT
    index = Index(table, 8, 10)
    keys = [set(index.keys(s).tolist()) for s in sets]
    lists = Counter(k for own in keys for k in own)
    assert max(lists.values()) <= FREQUENT < Counter(np.concatenate(sets).tolist()).most_common(1)[0][1]
    for s, t, own in zip(sets, near, keys):
        both = len(np.intersect1d(s, t))
        if 10 * both >= 8 * (len(s) + len(t) - both):
            assert own & set(index.keys(t).tolist())
