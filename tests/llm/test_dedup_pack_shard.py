"""Exact dedup, packing and sharding against brute force."""

import gc
import hashlib
import random
import re
import weakref
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from barflow.llm import exact_dedup, packing, queries, sharding

WORDS = public_tokenizers.path("word_bpe_49k.json")


def rows(n=400, seed=3):
    r = random.Random(seed)
    base = ["Ünï the thing", "a b c", "", " \n", "it's\x1cIT'S <|endoftext|>x", "same head " * 20 + "x", "same head " * 20 + "y", "１２ ﬁ É Σας"]
    texts = [r.choice(base).replace(" ", r.choice([" ", "  ", "\t\n"])) for _ in range(n)] + [" ".join(r.choice("abcdef") for _ in range(r.randrange(3000))) for _ in range(60)]
    return [(i, t) for i, t in enumerate(texts)] + [(n * 10, None), (n * 10 + 1, "solo text"), (n * 10 + 2, "hot" * 3)] + [(n * 20 + i, "hot hot hot") for i in range(n)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "x", 1, "y") for i, t in rows()], "doc_id long, text string, id string, size int, shard string").repartition(5)


def test_copies(spark, docs):
    groups = defaultdict(list)
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    for i, t in rows():
        groups[norm(t)].append((-len(t or ""), i))
    got = exact_dedup.find_copies(docs).collect()
    assert len(got) == len(rows())
    text = dict(rows())
    for r in got:
        g = groups[norm(text[r.doc_id])]
        assert (r.keep_id, r.group_size, r.kept) == (min(g)[1], len(g), min(g)[1] == r.doc_id)
        assert r.text_sha256 == hashlib.sha256(norm(text[r.doc_id]).encode()).hexdigest()


def test_copies_of_repeated_and_null_ids(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (None, "a"), (None, "b"), (2, " b")], "doc_id int, text string")
    got = sorted(((r.doc_id or 0, r.keep_id, r.group_size, r.kept) for r in exact_dedup.find_copies(df).collect()))
    assert got == [(0, 1, 3, False), (0, 2, 2, False), (1, 1, 3, False), (1, 1, 3, True), (2, 2, 2, True)]
    assert exact_dedup.find_copies(df.filter("doc_id > 5")).count() == 0


def test_packing(spark, docs):
    lib = Tokenizer.from_file(WORDS)
    want = {i: [*lib.encode(t or "", add_special_tokens=False).ids, 1] for i, t in rows()}
    got = packing.pack(docs, WORDS, length=256, group_rows=200).collect()
    docs_ids, sequences = defaultdict(dict), defaultdict(list)
    for r in got:
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert len(ids) == r.length and r.doc_tokens == len(want[r.doc_id])
        docs_ids[r.doc_id][r.start] = ids
        sequences[r.sequence_id].append((r.offset, r.length))
    assert {i: [x for s in sorted(p) for x in p[s]] for i, p in docs_ids.items()} == want
    for s in sequences.values():
        at = 0
        for offset, n in sorted(s):
            assert offset == at
            at += n
        assert at <= 256
    used = sum(r.length for r in got)
    assert len(sequences) * 256 < used * 1.03 + 256 * 5
    assert packing.pack(docs.limit(0), WORDS).count() == 0


def test_words_go_at_once():
    """The words' table is freed at the end of its task, before the worker gives memory back, not at some later search for cycles."""
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        words = packing.Words(f.read(), 2)
    assert words.ids("the things it's 12")
    gone = [weakref.ref(words), weakref.ref(words.memo)]
    gc.disable()
    try:
        words.close()
        del words
        assert [g() for g in gone] == [None, None]
    finally:
        gc.enable()


def test_first_fit_decreasing():
    r = random.Random(0)
    for _ in range(200):
        sizes = sorted((r.randrange(1, 101) for _ in range(r.randrange(0, 60))), reverse=True)
        bins, want = [], []
        for s in sizes:
            k = next((k for k, b in enumerate(bins) if b >= s), len(bins))
            bins[k:k + 1] = [(bins[k] if k < len(bins) else 100) - s]
            want.append(k)
        assert packing.first_fit_decreasing(sizes, 100) == want


def test_sharding(spark, docs, tmp_path):
    out = sharding.shard(docs, 7, bucket_bytes=8000)
    got = out.collect()
    assert out.columns == ["doc_id", "text", "id", "size", "shard", "slot"]
    assert sorted((r.doc_id, r.text) for r in got) == sorted(rows(), key=lambda x: x[0])
    shards = defaultdict(list)
    for r in got:
        shards[r.shard].append(r.slot)
    assert sorted(shards) == list(range(7)) and all(sorted(s) == list(range(len(s))) for s in shards.values())
    assert max(map(len, shards.values())) - min(map(len, shards.values())) <= 1
    again = {r.doc_id: (r.shard, r.slot) for r in sharding.shard(docs.repartition(3), 7, bucket_bytes=8000).collect()}
    assert again == {r.doc_id: (r.shard, r.slot) for r in got}
    hot = [r.shard for r in got if r.text == "hot hot hot"]
    assert max(hot.count(k) for k in range(7)) < 2 * len(hot) / 7
    sharding.write_shards(out, str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s")).count() == len(rows())
    assert sharding.shard(docs.limit(0)).count() == 0
    assert zlib.crc32(b"") == 0


def test_rows_of_one_id_scatter(spark):
    same = spark.range(30000).selectExpr("CAST(NULL AS bigint) AS doc_id", "'one text' AS text")
    texts = spark.range(30000).selectExpr("7L AS doc_id", "concat('text ', id) AS text")
    df = same.union(texts)
    in_buckets = [r["count"] for r in sharding.scatter(df, 60, 1).groupBy("__bucket").count().collect()]
    assert len(in_buckets) == 60 and max(in_buckets) < 1400
    got = sharding.shard(df, 4, bucket_bytes=100_000)
    assert sorted(map(tuple, got.groupBy("shard").agg(F.count("*"), F.max("slot")).collect())) == [(k, 15000, 14999) for k in range(4)]
    assert got.filter("doc_id IS NULL AND text = 'one text'").count() == 30000
    packed = packing.pack(df, WORDS, length=256, group_rows=1000)
    sizes = [r["count"] for r in packed.withColumn("g", packed.sequence_id.bitwiseAND(-1 << 32)).groupBy("g").count().collect()]
    assert sum(sizes) == 60000 and max(sizes) < 1400


def test_contract_columns_of_shards_and_packs(spark, docs, tmp_path):
    docs.select("doc_id", "text").write.parquet(str(tmp_path / "documents.parquet"))
    text = dict(rows())
    got = queries.op8_sharding(spark, str(tmp_path)).collect()
    assert len(got) == len(text) and {r.law for r in got} == {"rows"} and {r.grown_shard for r in got} == {None}
    counts = defaultdict(list)
    for r in got:
        t = (text[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32) == (len(t) + 1, zlib.crc32(t))
        counts[r.shard].append(r.slot)
    assert sorted(counts) == list(range(16)) and all(sorted(s) == list(range(len(s))) for s in counts.values())
    assert max(map(len, counts.values())) - min(map(len, counts.values())) <= 1
    lib = Tokenizer.from_file(WORDS)
    want = {i: [*lib.encode(t or "", add_special_tokens=False).ids, 1] for i, t in rows()}
    for r in queries.op3_packing(spark, str(tmp_path)).collect():
        ids = want[r.doc_id][r.start : r.start + r.length]
        assert (len(ids), r.ids_crc32, r.doc_tokens) == (r.length, zlib.crc32(np.array(ids, "<u4").tobytes()), len(want[r.doc_id]))


@pytest.mark.parametrize("kind", ["smallint", "decimal(10,0)", "date", "string"])
def test_copies_with_other_ids(spark, kind):
    made = {"date": "date_add(date'2020-01-01', CAST(id AS int))"}.get(kind, f"CAST(id AS {kind})")
    df = spark.range(40).selectExpr(f"{made} AS doc_id", "concat('t', id % 4) AS text")
    got = exact_dedup.find_copies(df.unionByName(df.selectExpr(f"CAST(NULL AS {kind}) AS doc_id", "text"))).collect()
    assert len(got) == 80 and sum(r.kept for r in got) == 4 and {r.group_size for r in got} == {20}


def test_copies_of_very_long_texts(spark):
    df = spark.range(6).selectExpr("id AS doc_id", "concat(repeat('long text ', 300000), IF(id < 4, 'a', 'b')) AS text")
    assert {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup.find_copies(df).collect()} == {i: (0, 4) if i < 4 else (4, 2) for i in range(6)}


def test_ids_that_are_empty_strings(spark):
    df = spark.createDataFrame([("", "a b"), ("x", "ab"), (None, "a b"), ("y", "c d"), ("", "d c"), ("z", "")], "doc_id string, text string")
    got = {(r.doc_id, r.group_size): r.keep_id for r in exact_dedup.find_copies(df).collect()}
    assert got[("", 3)] == got[("x", 3)] == got[(None, 3)] == ""
    pieces = packing.pack(df, WORDS).collect()
    assert len(pieces) == 6 and {r.doc_id for r in pieces} == {"", "x", None, "y", "z"}


def test_rows_without_id_are_split_over_tasks(spark):
    rows = spark.range(4000, numPartitions=4).select(F.lit(None).cast("long").alias("doc_id"), F.when(F.col("id") % 8 > 0, "").otherwise("other").alias("text"), F.col("id").alias("own"))
    seen = []
    before = exact_dedup.cut

    def looked(df):
        out = before(df)
        seen.append([r["count"] for r in out.filter("size > 0").groupBy(F.spark_partition_id()).count().collect()])
        return out

    exact_dedup.cut = looked
    whole = "spark.sql.adaptive.coalescePartitions.enabled"  # few rows as these would be put into one task again
    spark.conf.set(whole, "false")
    try:
        for more in ({}, {"row_col": "own"}):
            out = exact_dedup.find_copies(rows, **more)
            assert out.filter("kept").count() == 2 and {r.group_size for r in out.select("group_size").distinct().collect()} == {3500, 500}
    finally:
        exact_dedup.cut = before
        spark.conf.unset(whole)
    assert all(len(parts) > 2 and max(parts) < 2500 for parts in seen)


def test_shards_with_more_columns(spark):
    rows = [(k % 5, "t", k, None if k % 3 else "x", k // 2, "c", 1.5) for k in range(300)] * 8
    df = spark.createDataFrame(rows, "doc_id long, text string, `count` long, `__key` string, `__first` long, `__bucket` string, n double")
    got = [sorted(map(repr, sharding.shard(df.repartition(p), 4, bucket_bytes=4000).collect())) for p in (1, 7)]
    assert got[0] == got[1] and len(got[0]) == 2400
    many = spark.createDataFrame([(1, "t", 5)] * 3000 + [(2, "u", 6)], "doc_id long, text string, `count` long")
    places = sharding.shard(many, 4, bucket_bytes=4000).groupBy("shard").agg(F.count("*").alias("n"), F.max("slot").alias("m")).collect()
    assert sorted(r.n for r in places) == [750, 750, 750, 751] and all(r.m == r.n - 1 for r in places)


def test_memo_is_bounded_by_letters():
    from barflow.llm.common import Memo

    memo = Memo(len, 1000)
    for k in range(3000):
        assert memo[f"{k:04d}" * 100] == 400
        assert sum(map(len, memo)) + sum(map(len, memo.old)) <= 1000 * Memo.LETTERS
    assert memo["x" * 10_000] == 10_000 and "x" * 10_000 not in memo
    short = Memo(len, 1000)
    for k in range(400):
        short[str(k)]
    assert len(short) == 400


def test_packing_refuses_other_special_strings(tmp_path):
    import json

    spec = json.load(open(WORDS, encoding="utf-8"))
    spec["added_tokens"].append(dict(spec["added_tokens"][0], id=49408, content="[sep]"))
    (tmp_path / "t.json").write_text(json.dumps(spec))

    class NoData:
        sparkSession = None

    with pytest.raises(ValueError, match="special strings"):
        packing.pack(NoData(), str(tmp_path / "t.json"))
