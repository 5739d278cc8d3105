"""Counters that other shingles fill do not make an index of pairs, and lose no link."""

import random

import numpy as np

from barflow.llm import jaccard


def test_full_counters_do_not_grow_the_index():
    rng = np.random.default_rng(1)
    tokens = np.unique(rng.integers(0, 2**63, 330, dtype=np.uint64))
    size = 1 << 16

    def keys(mean):
        return len(jaccard.Index(rng.poisson(mean, size).astype(np.uint32), 8, 10).keys(tokens))

    need = len(tokens) - -(-8 * len(tokens) // 10) + 1
    for mean in (15, 181, 900):
        assert keys(mean) <= 2 * need, mean  # a key a token of the prefix, in two bands at most
    # what is truly frequent is still told apart, and no limit is over a block
    assert jaccard.Index(np.full(size, 10**6, np.uint32), 8, 10).limit == jaccard.BLOCK


def test_full_counters_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "COUNTERS", 64)
    rng = random.Random(3)
    rows = []
    for k in range(60):
        words = [f"w{rng.randrange(3000)}" for _ in range(60)]
        rows.append((4 * k, " ".join(words)))
        for j in range(1, 4):
            own = list(words)
            own[rng.randrange(60)] = f"x{j}"
            rows.append((4 * k + j, " ".join(own)))
    got = {r.doc_id: r.component_id for r in jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=3, similarity=(8, 10)).collect()}
    sets = {k: set(zip(t.split(), t.split()[1:], t.split()[2:])) for k, t in rows}
    want = {k: k for k in sets}
    for a in sets:
        for b in sets:
            if a < b and 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b]):
                x, y = want[a], want[b]
                want = {k: min(x, y) if c in (x, y) else c for k, c in want.items()}
    assert got == want and len(set(want.values())) < len(rows)
