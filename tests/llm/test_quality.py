"""Quality scores: held-out accuracy, calibration, edge cases."""

import zlib

import numpy as np
import pytest

from barflow.llm import quality

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def scored(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = quality.fit(docs, labels, sample=1500)
    return model, quality.score(docs, model).join(labels, "doc_id").toPandas()


def auc(s, y):
    rank = np.argsort(np.argsort(s)) + 1
    return (rank[y == 1].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (len(y) - y.sum()))


def test_held_out_accuracy(scored):
    out = scored[1][scored[1].held_out]
    assert all(zlib.crc32(str(i).encode()) % 3 == 1 for i in out.doc_id)
    y = out.quality.to_numpy()
    assert auc(out.score.to_numpy(), y) > 0.97
    assert (out.predicted == y).mean() > 0.95
    bins = [(m.mean(), y[k].mean()) for k in [out.score < 0.5, out.score >= 0.5] for m in [out.score[k]]]
    assert all(abs(a - b) < 0.15 for a, b in bins)


def test_edges(spark, scored):
    df = spark.createDataFrame([(1, None, "en", 7), (2, "", "de", 8), (None, "the thing", None, 9), (3, "a " * 200000, "x", 1), (3, "a " * 200000, "x", 1)], "doc_id int, text string, held_out string, score int")
    got = quality.score(df, scored[0]).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert got[0].score == got[1].score and got[3].score == got[4].score
    assert quality.score(df.limit(0), scored[0]).count() == 0


def test_no_labels(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    empty = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in quality.score(docs, quality.fit(docs, empty)).collect()} == {0.5}
    one = spark.createDataFrame([(2, 1), (2, 0), (1, None), (None, 1)], "doc_id long, quality int")
    assert {r.score for r in quality.score(docs, quality.fit(docs, one)).collect()} <= {0.5, 1.0}
