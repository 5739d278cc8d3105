"""The pipeline's stages, each against a plain version of its decision on its own input."""

import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from barflow.llm import common, quality

from .test_jaccard import brute
from .test_pii import base


@pytest.fixture(scope="module")
def steps(spark):
    """What went into and came out of each stage over a small table."""
    sf = "/root/testdata/sf0.001"
    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, docs, sf).cache()
        out.append((name, docs, after))
        docs = after
    return out


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_stages(spark, steps):
    assert [s[0] for s in steps] == ["quality", "exact_dedup", "ngram_jaccard", "pii", "packing"]
    for _, before, after in steps[:-1]:
        assert after.columns == before.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.001/labels.parquet").collect()}
    before, after = rows(steps[0][1]), rows(steps[0][2])
    good = [i in after for i, q in labels.items() if q == 1]
    assert np.mean(good) > 0.95 and len(after) < len(before)

    before, after = rows(steps[1][1]), rows(steps[1][2])
    groups = {}
    for r in before.values():
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", r.text), []).append((-len(r.text), r.doc_id))
    assert set(after) == {min(g)[1] for g in groups.values()}

    before, after = rows(steps[2][1]), rows(steps[2][2])
    ids = sorted(before)
    root = [c for _, c in brute([before[i].text for i in ids], 5, 8, 10)]
    assert set(after) == {ids[k] for k, c in enumerate(root) if c == k}

    before, after = rows(steps[3][1]), rows(steps[3][2])
    assert set(after) == set(before)
    for i, r in after.items():
        assert r.n_chars == len(r.text)
        assert ("[PRIVATE]" in r.text) >= any(base(before[i].text).values())
        assert r.text == before[i].text or "[PRIVATE]" in r.text

    before, pieces = rows(steps[4][1]), steps[4][2].collect()
    assert {p.doc_id for p in pieces} == set(before)
    assert sum(p.length for p in pieces) == sum({p.doc_id: p.doc_tokens for p in pieces}.values())


def test_model_is_the_same_each_time(spark):
    sf = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    models = [quality.fit(docs.repartition(n), labels) for n in (1, 3)]
    a, b = (m.score(["the thing", ""], m.memo()) for m in models)
    assert np.allclose(a, b)


def test_workers_get_short_batches(spark):
    """Rows of 0.5 MB go to the Python workers in batches of a few MB, not 32 MB at once; a session's own setting stays."""
    docs = spark.range(64, numPartitions=1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("ab "), 175_000).alias("text"))
    own = spark.conf.get(common.BATCH, None)
    try:
        spark.conf.unset(common.BATCH)
        dict(corpus_pipeline.STAGES)["packing"](spark, docs, "")
        got = docs.mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"rows": [b.num_rows], "bytes": [b.nbytes]}) for b in batches), "rows long, bytes long").collect()
        assert sum(r.rows for r in got) == 64 and max(r.bytes for r in got) <= common.BATCH_BYTES + 600_000
        spark.conf.set(common.BATCH, "1000000")
        dict(corpus_pipeline.STAGES)["packing"](spark, docs, "")
        assert spark.conf.get(common.BATCH) == "1000000"
    finally:
        spark.conf.unset(common.BATCH) if own is None else spark.conf.set(common.BATCH, own)
