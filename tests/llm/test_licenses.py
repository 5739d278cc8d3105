"""License scans against each block compared with each template."""

import math
import random
import re

from pyspark.sql import functions as F

from barflow.llm import licenses

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(text, templates=licenses.TEMPLATES, least=(9, 10)):
    w = words(text)
    places = sorted((i, label) for phrase, label in licenses.PHRASES for p in [phrase.split()] for i in range(len(w)) if w[i : i + len(p)] == p)
    sets = [(label, set(t.lower().split())) for label, t in templates]
    blocks = []
    for b in range(max(0, math.ceil(len(w) / 32) - 2) + 1):
        own = set(w[b * 32 : b * 32 + 64])
        fit = [(label, t) for label, t in sets if len(t & own) * least[1] >= least[0] * len(t)]
        blocks += [(label, b, len(t & own) / len(t), any(t < o for _, o in fit)) for label, t in fit]
    return len(w), places, blocks


def scanned(df, **more):
    return {r[0]: (r.n_words, [tuple(p) for p in r.places], [tuple(b) for b in r.blocks]) for r in licenses.scan(df, **more).collect()}


def texts():
    r = random.Random(8)
    some = ["the", "of", "mit", "license", "under", "licensed", "software", "4", "0", "by", "cc", "is", "öl", "free", "and", "public", "domain", "general", "Gnu", "terms"]
    out = [None, "", " .\n", "MIT License", "Mit\tLICENSE, mit-license; general PUBLIC license apache  license", "mitlicense mit öl license", "general public", "Kit license", "mİt license lİcense"]
    out += [t for _, t in licenses.TEMPLATES]
    out += [" ".join(r.choice(some) for _ in range(n)) for n in (1, 31, 32, 33, 63, 64, 65, 96, 97, 500, 3000)]
    for _, t in licenses.TEMPLATES:  # across borders of blocks, with words left out, put in and changed in order
        w = t.split()
        for cut in (0, 1, 2):
            own = w[:]
            for _ in range(cut):
                own.pop(r.randrange(len(own)))
            r.shuffle(own) if cut == 1 else None
            out.append(" ".join(["x"] * r.randrange(120) + own + ["y"] * r.randrange(90)))
    return out


def test_against_brute_force(spark):
    every = texts()
    df = spark.createDataFrame([(i, t, "n", 1) for i, t in enumerate(every)], "doc_id long, text string, words string, found int").repartition(3)
    got = scanned(df)
    assert all(got[i] == brute(t) for i, t in enumerate(every))
    assert sum(len(g[2]) for g in got.values()) > 60
    assert scanned(df, least=(6, 10)) == {i: brute(t, least=(6, 10)) for i, t in enumerate(every)}
    few = (("own", "alpha beta"), ("more", "alpha beta gamma öl".replace(" öl", "")), ("one", "kappa"))
    df = spark.createDataFrame([(1, "Alpha\nBETA gamma"), (2, "kappa"), (3, "Kappa")], "doc_id long, text string")
    got = scanned(df, templates=few)
    assert got[1][2] == [("own", 0, 1.0, True), ("more", 0, 1.0, False)] and got[2][2] == [("one", 0, 1.0, False)] and got[3][2] == []


def test_rows_as_any(spark):
    df = spark.createDataFrame([(None, "MIT license"), (None, None), (1, "MIT license"), (1, "MIT license")], "doc_id long, text string")
    out = licenses.scan(df)
    assert out.count() == 4 and out.filter(F.size("places") == 1).count() == 3
    assert licenses.scan(df.limit(0)).count() == 0


def test_labels_and_order(spark):
    df = spark.createDataFrame([(1, "Licensed under CC BY-NC 4.0. It is no MIT license.")], "doc_id long, text string")
    row = licenses.scan(df).select(licenses.labels_of(F.col("places")).alias("base"), licenses.labels_of(F.col("places"), F.col("blocks")).alias("all")).first()
    assert row.base == ["mit"] and row.all == ["cc-by-nc", "mit"]
    many = spark.createDataFrame([(i, "the license of the land" if i else "nc") for i in range(9)], "doc_id long, text string")
    order = licenses.by_frequency(many, "text", (("x", "the nc license zz"),))
    assert order == ["zz", "nc", "license", "the"]
    t = licenses.Templates((("x", "the nc license zz"),), order, (3, 4))
    assert t.all == [("x", order, 3, ["zz", "nc"])]


def test_no_python_on_executors(spark):
    df = spark.createDataFrame([(1, "MIT license")], "doc_id long, text string")
    plan = licenses.scan(df)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
