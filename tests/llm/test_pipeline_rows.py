"""The pipeline's stages decide about rows: null and repeated ids among them."""

import numpy as np

import corpus_pipeline
from barflow.llm import quality

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [f"w{k}" for k in range(60)]
LONG = " ".join(WORDS)
NEAR = " ".join([*WORDS[:59], "other"])


class Short:
    """Accepts texts of less than ten code points."""

    def memo(self):
        return None

    def score(self, batch, memo):
        return np.array([float(len(t) < 10) for t in batch])


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", f"s{k}", len(t or "")) for k, (i, t) in enumerate(rows)], COLUMNS).repartition(3).cache()


def left(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=str)


def test_quality_decides_about_rows(spark, monkeypatch):
    monkeypatch.setattr(quality, "fit", lambda docs, labels: Short())
    docs = table(spark, [(1, "good"), (1, "rejected text"), (None, "fine"), (None, "rejected too"), (2, "rejected text"), (3, None)])
    after = corpus_pipeline.quality_stage(spark, docs, "/root/testdata/sf0.001")
    assert after.columns == docs.columns
    assert left(after) == sorted([(1, "good"), (None, "fine"), (3, None)], key=str)


def test_exact_stage_decides_about_rows(spark):
    docs = table(spark, [(1, "a b c")] * 3 + [(None, "abc"), (None, "x y"), (None, "xy"), (2, "p"), (2, "q"), (0, "p")])
    after = corpus_pipeline.exact_stage(spark, docs, "")
    assert after.columns == docs.columns
    assert left(after) == sorted([(1, "a b c"), (None, "x y"), (2, "q"), (0, "p")], key=str)


def test_near_stage_decides_about_rows(spark):
    other, third = LONG.replace("w", "v"), LONG.replace("w", "u")
    docs = table(spark, [(5, LONG), (5, NEAR), (None, LONG), (7, other), (7, third), (None, NEAR.replace("w", "v")), (None, "alone here"), (4, third)])
    after = corpus_pipeline.near_stage(spark, docs, "")
    assert after.columns == docs.columns
    got = left(after)
    # of rows with one id either stays
    assert [x for x in got if x[0] == 5] in ([(5, LONG)], [(5, NEAR)])
    assert [x for x in got if x[0] != 5] == sorted([(7, other), (4, third), (None, "alone here")], key=str)


def test_stages_keep_columns_of_any_name(spark, monkeypatch):
    monkeypatch.setattr(quality, "fit", lambda docs, labels: Short())
    docs = table(spark, [(1, "good"), (1, "rejected text"), (2, "good")])
    for name in ("score", "held_out", "predicted", "__row", "column_1", "place", "hash"):
        docs = docs.withColumn(name, docs["source"])
    docs = docs.cache()
    one = corpus_pipeline.quality_stage(spark, docs, "/root/testdata/sf0.001").cache()
    assert one.columns == docs.columns and left(one) == [(1, "good"), (2, "good")]
    for stage in (corpus_pipeline.exact_stage, corpus_pipeline.near_stage):
        after = stage(spark, one, "")
        assert after.columns == docs.columns and left(after)[0] == (1, "good") and all(r["__row"] == r["source"] == r["hash"] for r in after.collect())
