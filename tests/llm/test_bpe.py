"""Counting, encoding and decoding against the tokenizer library."""

import gc
import hashlib
import os
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from barflow.llm import bpe_codec, token_counts
from barflow.llm.bpe import Bpe

os.environ["TOKENIZERS_PARALLELISM"] = "false"
PATH = public_tokenizers.path("byte_bpe_50k.json")
ALPHABET = "abcdefgh ABC  \n\t\r\x0b\x1c\x1f\x85\xa0 　'sst.,!?0123456789äöüß€λжя漢字🙂́-_"
EDGES = ["", " ", "\n", "\n\n\nfoo", "a  b", "a \n b", " a", "a ", "it's we'll I'd", "x<|endoftext|>y", "<|endoftext|><|endoftext|>", "<|endoftext|", "a" * 5000, "ab" * 700 + " " * 300, "don't\n\n  stop", "\x1ca\x1c.\x1c", "foo\xa0 bar", "Ünïcödé ñandú", "\n", "a\n", "aaaaaaa aaaaaaaaaaaaaaaaaaaaaaaaaaaaa"]


def samples() -> list[str]:
    r = random.Random(7)
    words = ["the", "thing", "tion", "and", "éaux", "ción", "heit", "un", "=", "==", "----", "1234567", "a@b.c"]
    noise = ["".join(r.choice(ALPHABET) for _ in range(r.randrange(60))) for _ in range(1500)]
    prose = [" ".join("".join(r.choice(words) for _ in range(r.randrange(1, 4))) for _ in range(r.randrange(40))) for _ in range(300)]
    return EDGES + noise + prose


@pytest.fixture(scope="module")
def wanted():
    lib = Tokenizer.from_file(PATH)
    return [(t, e.ids, lib.decode(e.ids, skip_special_tokens=False)) for t in samples() for e in [lib.encode(t, add_special_tokens=False)]]


def test_counts_and_round_trip(spark, wanted):
    df = spark.createDataFrame([(i, t, "x") for i, (t, _, _) in enumerate(wanted)] + [(None, None, None), (3, wanted[3][0], None)], "doc_id long, text string, n_tokens string")
    got = {r.doc_id: r for r in token_counts.count_tokens(df, PATH).collect()}
    coded = {r.doc_id: r for r in bpe_codec.round_trip(df, PATH).collect()}
    for i, (t, ids, text) in enumerate(wanted):
        assert (got[i].n_bytes, got[i].n_tokens, got[i].over_limit) == (len(t.encode()), len(ids), len(ids) > 1024), t
        assert (coded[i].n_tokens, coded[i].ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()), t
        assert coded[i].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest(), t
    assert (got[None].n_bytes, got[None].n_tokens, coded[None].n_tokens) == (0, 0, 0)


def test_encode_and_decode(spark, wanted):
    df = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(wanted[:200])], "doc_id long, text string")
    coded = bpe_codec.encode(df, PATH)
    assert {r.doc_id: r.ids for r in coded.collect()} == {i: ids for i, (_, ids, _) in enumerate(wanted[:200])}
    assert {r.doc_id: r.text for r in bpe_codec.decode(coded, PATH).collect()} == {i: t for i, (_, _, t) in enumerate(wanted[:200])}


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert token_counts.count_tokens(df, PATH).count() == bpe_codec.round_trip(df, PATH).count() == 0


def test_speculation_equals_merging():
    bpe = Bpe(PATH)
    codec, r = bpe_codec.Codec(bpe), random.Random(1)
    tokens = sorted(t for t in bpe.alone if len(t) < 6)
    words = ["".join(r.choice(tokens) for _ in range(r.randrange(1, 5))) for _ in range(20000)] + ["a" * n for n in range(1, 60)]
    wanted = [[bpe.vocab[p] for p in bpe.merge(w)] for w in words]
    assert codec.encode_words(words) == wanted
    assert 0 < codec.merged < len(words)
    assert all(bpe._merge_long(w) == bpe.merge(w) for w in words[:3000])


def test_no_search_for_cycles_while_encoding(wanted):
    """Python's collector does not run over what is remembered while a batch is encoded, only once when it is on again."""
    codec, seen = bpe_codec.Codec(Bpe(PATH)), []
    gc.callbacks.append(seen_by := lambda phase, info: seen.append(phase))
    try:
        gc.collect()
        seen.clear()
        got = codec.encode_batch([t for t, _, _ in wanted])
        runs = seen.count("start")
    finally:
        gc.callbacks.remove(seen_by)
    assert gc.isenabled() and runs <= 1, runs
    assert [doc for doc, _ in got] == [",".join(map(str, ids)) for _, ids, _ in wanted]
    gc.disable()
    try:
        codec.encode_batch(["a"])
        assert not gc.isenabled()
    finally:
        gc.enable()
