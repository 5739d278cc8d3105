"""Hard negatives against brute force."""

import math
import random

import numpy as np
import pytest

from barflow.llm import negatives


def brute(rows, every=100, k=5, m=5, low=80, high=100):
    ok = [(i, y, [math.floor(256 * c) for c in v]) for i, v, y in rows if i is not None and y is not None and v and all(c is not None and math.isfinite(c) for c in v)]
    anchors = {}
    for i, y, v in sorted((r for r in ok if r[0] % every == 0), key=lambda r: (r[1], r[2]), reverse=True):
        anchors[i] = (y, v)
    out = []
    for a, (label, v) in anchors.items():
        scored = sorted((-sum(p * q for p, q in zip(v, w)), i, y == label) for i, y, w in ok if i != a and len(w) == len(v))
        for p, (ps, pid, _) in enumerate([s for s in scored if s[2]][:k], 1):
            fit = [s for s in scored if not s[2] and low * -ps <= 100 * -s[0] <= high * -ps][:m]
            out += [(a, pid, n, s[1], -ps, -s[0], p) for n, s in enumerate(fit, 1)]
    return sorted(out)


def table(spark, rows):
    return spark.createDataFrame([(i, v, y, "x", 1) for i, v, y in rows], "vec_id long, embedding array<double>, label int, score string, rank int")


def got(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture(scope="module")
def rows():
    r = random.Random(4)
    made = [(i, [r.gauss(0.4, 0.3) for _ in range(6)], r.randrange(3)) for i in range(420)]
    made += [(i, made[100][1], r.randrange(3)) for i in range(420, 460)]  # ties of vectors
    made += [(i, [1.0, 2.0, 3.0], i % 2) for i in range(500, 540)]  # another length, with an anchor
    made += [(101, made[101][1], 1), (200, [0.1] * 6, 0), (200, [0.1] * 6, 0)]  # repeated ids
    return made + [(600, None, 1), (700, [], 1), (800, [float("nan")] * 6, 1), (900, [1.0, None, 1.0, 1.0, 1.0, 1.0], 0), (1000, [0.1] * 6, None), (None, [0.1] * 6, 1), (1100, [float("inf")] * 6, 2), (1200, [9.0] * 6, 77), (1300, [-0.5] * 6, 0)]


def test_against_brute_force(spark, rows, monkeypatch):
    df = table(spark, rows).repartition(5)
    want = brute(rows)
    assert len(want) > 50 and got(negatives.mine(df)) == want
    monkeypatch.setattr(negatives, "ANCHORS_A_PASS", 2)
    assert got(negatives.mine(df)) == want  # several passes
    assert got(negatives.mine(df, every=50, positives_each=2, negatives_each=9, band=(50, 90))) == brute(rows, 50, 2, 9, 50, 90)


def test_edges(spark, rows):
    df = table(spark, rows)
    assert negatives.mine(df.limit(0)).count() == 0
    assert negatives.mine(df.filter("vec_id = 1200")).count() == 0  # an anchor alone
    assert negatives.mine(df, label="label * 0").count() == 0  # one label only
    alike = [(i, [1.0] * 4, 0 if i < 150 else 1) for i in range(300)]  # a hot vector: all scores tie
    assert got(negatives.mine(table(spark, alike))) == brute(alike)


def test_scores_beyond_doubles():
    q, x = np.floor(np.array([[2.0**40, 1.0]])), np.floor(np.array([[2.0**20, 3.0], [-(2.0**30), 5.0]]))
    assert negatives.scores(q, x).tolist() == [[(1 << 60) + 3, -(1 << 63)]]
