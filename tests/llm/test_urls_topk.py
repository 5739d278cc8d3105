"""URL verdicts and top-k search against brute force."""

import math
import random
import re

import numpy as np

from barflow.llm import topk, url_filters
from barflow.llm.queries import RULES

URLS = [None, "", "no scheme", "http://", "http://A.Org", "http://A.Org/", "https://example.org/es/1", "https://x.EXAMPLE.org/en/12?a#b", "http://notexample.org/es/", "http://a.com/fr/1", "http://a.com/de/1", "http://com/de/", "http://a.com/x", "http://www.b.net/p/?utm_source=x&b=2&a=1#f", "http://b.net/p?a=1&b=2", "http://b.net/q", "x://y://z.org/", "http://b.net?x", "http://É.org/ü", "http://b.net/p?b=2&a=1&ref"]
LISTED = ["https://www.b.net/p?b=2&a=1", "nothing", None, "http://b.net/p?b=2&a=1"]


def canonical(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host):])[0]
    query = (re.match(r"[^?#]*\?([^#]*)", rest) or ["", ""])[1]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    keep = sorted(p for p in query.split("&") if p and not re.match(r"(utm_[^=]*|ref|gclid|fbclid)(=.*)?$", p))
    return host, path, re.sub(r"^www\.", "", host) + re.sub("/+$", "", path) + ("?" + "&".join(keep) if keep else "")


def test_judge(spark):
    df = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(URLS)] + [(None, URLS[5], None, None)] * 2, "page_id long, url string, host string, known string")
    listed = {canonical(u)[2] for u in LISTED} - {""}
    got = {r.page_id: r for r in url_filters.judge(df, RULES, spark.createDataFrame([(u,) for u in LISTED], "url string")).collect()}
    assert len(got) == len(URLS) + 1
    for i, u in enumerate(URLS):
        host, path, known = canonical(u)
        fit = [(len(r), r, v) for v, r in RULES for h, _, p in [r.partition("/")] if (host == h or host.endswith("." + h)) and path.startswith("/" + p)]
        want = (host, path, max(fit)[1] if fit else None, max(fit)[2] if fit else "block" if known in listed else "allow")
        assert (got[i].host, got[i].path, got[i].rule, got[i].verdict) == want, u
    assert got[13].verdict == got[14].verdict == got[19].verdict == "block" and got[15].verdict == "allow"
    assert url_filters.judge(df.limit(0), RULES, df.select("url")).count() == 0
    assert url_filters.judge(df, RULES, df.limit(0)).filter("verdict = 'block'").count() == 4


def test_filter_passes_all_keys_and_few_others(spark):
    keys = spark.range(4000).selectExpr("concat('k', id) AS key")
    bloom, blocks = url_filters.build_filter(keys, "key", 4000)
    words = {r.block: [r[f"w{i}"] for i in range(8)] for r in bloom.collect()}
    from pyspark.sql import functions as F

    probe = spark.range(20000).selectExpr("concat('k', id) AS key").select("key", url_filters._block(F.col("key"), blocks).alias("b"), F.array(*url_filters._bits(F.col("key"))).alias("bits")).collect()
    passed = [all(w & b for w, b in zip(words.get(r.b, [0] * 8), r.bits)) for r in probe]
    assert all(passed[:4000]) and sum(passed[4000:]) < 16000 * 0.03


def brute(rows, k):
    ok = [(i, np.floor(np.array(v, float) * 256)) for i, v in rows if i is not None and v and all(c is not None and math.isfinite(c) for c in v)]
    asked = {}
    for i, v in sorted(ok, key=lambda x: tuple(x[1]), reverse=True):
        if i % 50 == 0:
            asked[i] = v
    return {(q, n + 1, i, s) for q, v in asked.items() for n, (s, i) in enumerate(sorted(((int(v @ c), i) for i, c in ok if i != q and len(c) == len(v)), key=lambda x: (-x[0], x[1]))[:k])}


def test_top_k(spark):
    r = np.random.default_rng(5)
    rows = [(i, r.normal(size=12).tolist()) for i in range(700)] + [(700 + i, [0.5] * 12) for i in range(40)]
    rows += [(800, [1.0] * 3), (801, [2.0] * 3), (850, [1.0] * 4), (802, None), (803, []), (804, [float("nan")] * 12), (805, [None] * 12), (None, [9.0] * 12), (806, [float("inf")] * 12), (900, [1e12] * 12), (901, [-1e12] * 12)]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, score int").repartition(3)
    small = [x for x in rows if not (x[1] and len(x[1]) == 12 and x[1][0] and abs(x[1][0]) == 1e12)]
    got = {tuple(x) for x in topk.top_k(df.filter("vec_id IS NULL OR vec_id < 900")).collect()}
    assert got == brute(small, 5)
    assert len(topk.top_k(df).filter("query_id = 900").collect()) == 5
    assert topk.top_k(df.filter("vec_id > 99999")).count() == 0


def test_search_in_blocks_and_passes(spark, monkeypatch):
    monkeypatch.setattr(topk, "QUERIES_A_PASS", 5)
    r = np.random.default_rng(6)
    rows = [(i, np.round(r.normal(size=6), 1).tolist()) for i in range(900)] + [(i, [0.1] * 6) for i in range(900, 1000)]
    best = topk.Best(20, 5)
    x, ids = topk.whole(np.array([v for _, v in rows]), 256), np.array([i for i, _ in rows])
    asked = ids % 50 == 0
    resolved = sum(topk.search(x[lo:lo + 256], ids[lo:lo + 256], x[asked], ids[asked], np.arange(asked.sum()), best)[0] for lo in range(0, 1000, 256))
    want = brute(rows, 5)
    assert {(int(ids[asked][q]), int(i), int(s)) for q, i, s in zip(best.query, best.id, best.score)} == {(q, i, s) for q, _, i, s in want}
    assert resolved < 20 * 1000 / 2
    assert {tuple(x) for x in topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()} == want


def test_reading_stops():
    """Where few vectors stand out, few components of each list are read; what is not read is not looked up."""
    r = np.random.default_rng(7)
    x = topk.whole(r.exponential(size=(4000, 8)) ** 4, 256)
    asked = x[:100]
    best = topk.Best(100, 5)
    read = topk.search(x, np.arange(4000), asked, np.arange(100), np.arange(100), best)[1]
    assert read < 0.5 * 100 * 4000 * 8
    scores = asked @ x.T
    scores[np.arange(100), np.arange(100)] = -np.inf
    want = {(q, int(i), int(scores[q, i])) for q in range(100) for i in np.lexsort((np.arange(4000), -scores[q]))[:5]}
    assert {(int(q), int(i), int(s)) for q, i, s in zip(best.query, best.id, best.score)} == want


def test_bounds_hold_at_each_depth():
    r = np.random.default_rng(8)
    x, q = topk.whole(r.normal(size=(300, 5)), 256), topk.whole(r.normal(size=(20, 5)), 256)
    lists = topk.Lists(x, q, np.float64)
    for depth in (1, 20, 150, 300):
        lists.read_to(depth)
        least, most = lists.least(), lists.most()
        assert (least <= q @ x.T).all() and (q @ x.T <= most).all()
    assert (least == most).all() and lists.read == 300 * np.count_nonzero(q)
