"""The op queries over the test tables, and the DuckDB SQL of those that SQL can express.

Tokenizer files are parameters: TOKENIZERS says where they are.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe_codec, conversations, exact_dedup, jaccard, licenses, negatives, packing, pii, quality, sharding, token_counts, topk, url_filters
from .common import table

#: Where a tokenizer file is, by name.
TOKENIZERS: Callable[[str], str] = public_tokenizers.path
#: URL rules: verdict, host and path.
RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]


def listed_urls(pages: DataFrame) -> DataFrame:
    """The list of blocked URLs: the pages whose canonical URL has an MD5 that starts with 0 or 1, about an eighth of them on any host.
    It grows with the table."""
    return pages.select("url").filter(F.md5(url_filters.canonical(F.col("url")).cast("binary")).rlike("^[01]"))


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.find_copies(table(spark, sf_dir, "documents"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), TOKENIZERS("byte_bpe_50k.json"), limit=1024)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), TOKENIZERS("word_bpe_49k.json"), length=2048, end_id=1)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return url_filters.judge(pages, RULES, listed_urls(pages))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"), words=3, similarity=(90, 100))


def op7_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), 5, every=50, scale=256)


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    sharded = sharding.shard(table(spark, sf_dir, "documents").select("doc_id", "text"), 16)
    text = F.coalesce("text", F.lit(""))
    return sharded.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents"))
    base, added = F.col("base"), F.col("added")
    joined = lambda extra: F.array_join(F.concat(*(pii.kind_spans(base[k], extra, k) for k in pii.KINDS)), ",")
    secrets = F.filter(added, lambda c: c["kind"] == "secret")
    return found.select(
        "doc_id",
        *(F.size(base[k]).cast("long").alias(f"n_{k}") for k in pii.KINDS),
        F.sha2(joined(None), 256).alias("base_sha256"),
        joined(added).alias("spans"),
        F.array_join(F.transform(secrets, lambda c: F.concat_ws(":", c["start"], c["end"])), ",").alias("secret_spans"),
        (sum(F.size(base[k]) for k in pii.KINDS) + F.size(added)).cast("long").alias("n_found"),
    )


def op10_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_codec.round_trip(table(spark, sf_dir, "documents"), TOKENIZERS("byte_bpe_50k.json"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.expr("CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END")
    return negatives.mine(table(spark, sf_dir, "embeddings"), label=label, every=100, positives_each=5, negatives_each=5, band=(80, 100), scale=256)


def op12_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents"))
    places, starts = F.col("places"), F.transform("places", lambda p: p["start"])
    best = F.coalesce(F.array_max(F.transform("blocks", lambda b: b["containment"])), F.lit(0.0))
    return found.select(
        "doc_id",
        "n_words",
        F.size(places).cast("long").alias("n_base"),
        F.array_min(starts).cast("long").alias("first_word"),
        F.array_max(starts).cast("long").alias("last_word"),
        F.array_join(licenses.labels_of(places), ",").alias("base_labels"),
        F.array_join(licenses.labels_of(places, F.col("blocks")), ",").alias("labels"),
        F.when(F.size(places) > 0, 1.0).otherwise(best).alias("score"),
    )


def damaged(rows: DataFrame) -> DataFrame:
    """The rows of conversations with the faults that a hash of conversation and turn says: dropped, emptied, unmarked, repeated, said by the user."""
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    fault = F.crc32(name.cast("binary")) % 20
    text, role = F.coalesce("text", F.lit(" ")), F.coalesce("role", F.lit(" "))
    text = F.when(fault == 1, "").when(fault == 2, F.translate(text, ".!?", "")).otherwise(text)
    role = F.when(fault == 4, "user").otherwise(role)
    copies = F.explode(F.when(fault == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.filter(fault != 0).select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def op13_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    left = damaged(rows)
    repaired = conversations.repair(left)
    figures = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    found = repaired.conversations.select("conv", *figures).join(conversations.digests(conversations.replay(left, repaired)).withColumnRenamed("conv", "c"), F.col("conv").eqNullSafe(F.col("c")))
    every = rows.select("conv_id").distinct()
    nothing = F.sha2(F.lit("").cast("binary"), 256)
    out = every.join(found, F.col("conv_id").eqNullSafe(F.col("conv")), "left")
    return out.select("conv_id", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in figures), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha256", nothing).alias("repaired_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_token_counts": op2_token_counts,
    "op3_packing": op3_packing,
    "op4_url_filter": op4_url_filter,
    "op5_quality": op5_quality,
    "op6_ngram_jaccard": op6_ngram_jaccard,
    "op7_top_k": op7_top_k,
    "op8_sharding": op8_sharding,
    "op9_pii": op9_pii,
    "op10_bpe_round_trip": op10_bpe_round_trip,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_licenses": op12_licenses,
    "op13_conversations": op13_conversations,
}

ORACLES: dict[str, str] = {
    "op1_exact_dedup": r"""
        WITH d AS (
            SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS n FROM documents
        )
        SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY n) AS group_size,
               row_number() OVER w = 1 AS kept, sha256(n) AS text_sha256
        FROM d WINDOW w AS (PARTITION BY n ORDER BY length(t) DESC, doc_id)""",
    "op4_url_filter": r"""
        WITH a AS (
            SELECT page_id, CASE WHEN contains(coalesce(url, ''), '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
        ), b AS (
            SELECT page_id, rest,
                   translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                   regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path,
                   array_to_string(list_sort(list_filter(string_split(regexp_extract(rest, '^[^?#]*\?([^#]*)', 1), '&'),
                       lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_[^=]*|ref|gclid|fbclid)(=.*)?$'))), '&') AS params
            FROM a
        ), rules(verdict, host, path) AS (
            VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')
        ), fitting AS (
            SELECT b.page_id, r.verdict, r.host || r.path AS rule,
                   row_number() OVER (PARTITION BY b.page_id ORDER BY length(r.host || r.path) DESC, r.host || r.path DESC) AS n
            FROM b JOIN rules r ON (b.host = r.host OR ends_with(b.host, '.' || r.host)) AND starts_with(b.path, r.path)
        ), known AS (
            SELECT page_id, regexp_replace(host, '^www\.', '') || regexp_replace(path, '/+$', '') || CASE WHEN params <> '' THEN '?' || params ELSE '' END AS url FROM b
        ), listed AS (
            SELECT DISTINCT url FROM known WHERE regexp_matches(md5(url), '^[01]')
        )
        SELECT b.page_id, b.host, b.path, f.rule, coalesce(f.verdict, CASE WHEN k.url IN (SELECT url FROM listed) THEN 'block' ELSE 'allow' END) AS verdict
        FROM b JOIN known k ON k.page_id = b.page_id LEFT JOIN fitting f ON f.page_id = b.page_id AND f.n = 1""",
    "op6_ngram_jaccard": r"""
        WITH RECURSIVE w AS (
            SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words
            FROM documents
        ), s AS (
            SELECT doc_id, CASE WHEN len(words) = 0 THEN []::VARCHAR[] WHEN len(words) < 3 THEN [array_to_string(words, ' ')]
                ELSE list_distinct(list_transform(range(1, len(words) - 1), lambda i: words[i] || ' ' || words[i + 1] || ' ' || words[i + 2])) END AS sh FROM w
        ), x AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS g FROM s), p AS (
            SELECT a.doc_id AS a, b.doc_id AS b FROM x a JOIN x b ON a.g = b.g AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n)
            GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))
        ), e AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p), r(v, c) AS (
            SELECT doc_id, doc_id FROM s UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.v
        )
        SELECT s.doc_id, len(s.sh)::BIGINT AS n_shingles, (SELECT min(c) FROM r WHERE r.v = s.doc_id) AS component_id FROM s""",
    "op7_top_k": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda c: floor(256 * c::DOUBLE)::BIGINT) AS x FROM embeddings
            WHERE embedding IS NOT NULL AND len(embedding) > 0 AND list_bool_and(list_transform(embedding, lambda c: c IS NOT NULL AND isfinite(c)))
        ), s AS (
            SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.x, c.x), lambda p: p[1] * p[2]))::BIGINT AS score
            FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.x) = len(c.x) WHERE q.vec_id % 50 = 0
        ), r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s)
        SELECT * FROM r WHERE rank <= 5""",
    "op11_hard_negatives": """
        WITH v AS (
            SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda c: floor(256 * c::DOUBLE)::BIGINT) AS x FROM embeddings
            WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND list_bool_and(list_transform(embedding, lambda c: c IS NOT NULL AND isfinite(c)))
        ), s AS (
            SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, list_sum(list_transform(list_zip(a.x, c.x), lambda p: p[1] * p[2]))::BIGINT AS score
            FROM v a JOIN v c ON a.vec_id <> c.vec_id AND len(a.x) = len(c.x) WHERE a.vec_id % 100 = 0
        ), p AS (
            SELECT anchor_id, vec_id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id)::INT AS positive_rank FROM s WHERE same
        ), n AS (
            SELECT p.anchor_id, p.positive_id, row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id)::INT AS rank, s.vec_id AS negative_id, p.positive_score, s.score AS negative_score, p.positive_rank
            FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 80 * p.positive_score <= 100 * s.score AND 100 * s.score <= 100 * p.positive_score WHERE p.positive_rank <= 5
        )
        SELECT * FROM n WHERE rank <= 5""",
    "op12_licenses": r"""
        WITH d AS (
            SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
        ), p AS (
            SELECT r, doc_id, w, list_filter(range(0, len(w)), lambda i: w[i + 1] = 'mit' AND w[i + 2] = 'license') AS mit,
                   list_filter(range(0, len(w)), lambda i: w[i + 1] = 'apache' AND w[i + 2] = 'license') AS apache,
                   list_filter(range(0, len(w)), lambda i: w[i + 1] = 'general' AND w[i + 2] = 'public' AND w[i + 3] = 'license') AS gpl FROM d
        ), q AS (
            SELECT r, doc_id, w, mit || apache || gpl AS places, list_filter([CASE WHEN len(apache) > 0 THEN 'apache' END, CASE WHEN len(gpl) > 0 THEN 'gpl' END, CASE WHEN len(mit) > 0 THEN 'mit' END], lambda l: l IS NOT NULL) AS base FROM p
        ), t(k, label, words) AS (VALUES @templates@), b AS (
            SELECT r, i, w[i * 32 + 1 : i * 32 + 64] AS own FROM (SELECT r, w, unnest(range(0, greatest(1, (len(w) + 31) // 32 - 1))) AS i FROM d)
        ), x AS (
            SELECT b.r, b.i, t.k, t.label, t.words, len(list_intersect(t.words, b.own)) / len(t.words) AS containment
            FROM b, t WHERE 10 * len(list_intersect(t.words, b.own)) >= 9 * len(t.words)
        ), z AS (
            SELECT x.r, x.containment, CASE WHEN NOT EXISTS (SELECT 1 FROM x o WHERE o.r = x.r AND o.i = x.i AND len(o.words) > len(x.words) AND list_has_all(o.words, x.words)) THEN x.label END AS label FROM x
        ), y AS (
            SELECT r, max(containment) AS best, coalesce(list(label) FILTER (label IS NOT NULL), []) AS labels FROM z GROUP BY r
        )
        SELECT doc_id, len(w)::BIGINT AS n_words, len(places)::BIGINT AS n_base, list_min(places)::BIGINT AS first_word, list_max(places)::BIGINT AS last_word, array_to_string(base, ',') AS base_labels,
               array_to_string(list_sort(list_distinct(base || coalesce(y.labels, []::VARCHAR[]))), ',') AS labels, CASE WHEN len(places) > 0 THEN 1.0::DOUBLE ELSE coalesce(y.best, 0.0)::DOUBLE END AS score
        FROM q LEFT JOIN y USING (r)""".replace("@templates@", ", ".join(f"({k}, '{label}', {sorted(set(text.lower().split()))})" for k, (label, text) in enumerate(licenses.TEMPLATES))),
    "op13_conversations": r"""
        WITH RECURSIVE k AS (
            SELECT coalesce(conv_id::VARCHAR, ' ') AS cid, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, encode(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')) AS name FROM conversations
        ), h AS (
            SELECT *, xor(list_reduce([4294967295::BIGINT] || list_transform(range(1, octet_length(name) + 1), lambda j: ord(substr(decode(name), j, 1))::BIGINT),
                lambda c, b: list_reduce([xor(c, b)] || range(8), lambda x, n: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295) % 20 AS f FROM k
        ), d AS (
            SELECT cid, turn, CASE WHEN f = 4 THEN 'user' ELSE role END AS role, CASE f WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN f = 3 THEN [0, 1] ELSE [0] END) AS copy FROM h WHERE f <> 0
        ), o AS (
            SELECT cid, turn, role, text, substr(role, 1, 1) AS ini, regexp_replace(text, '[\x20\x09-\x0D]+\z', '') AS bare, row_number() OVER (PARTITION BY cid ORDER BY turn NULLS FIRST, role, sha256(text)) AS i FROM d
        ), q AS (
            SELECT *, CASE WHEN bare = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY cid, role, text ORDER BY i) > 1 THEN 'duplicate' WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault, lag(ini) OVER (PARTITION BY cid ORDER BY i) || ini AS pair FROM o
        ), chain(p, q, ins) AS (
            VALUES (0, 0, []::VARCHAR[]), (1, 1, []), (2, 2, []), (3, 3, []), (0, 2, ['user:']), (1, 2, ['user:']), (3, 2, ['user:']), (2, 3, ['assistant:']),
                   (0, 3, ['user:', 'assistant:']), (1, 3, ['user:', 'assistant:']), (3, 3, ['user:', 'assistant:']), (2, 2, ['assistant:', 'user:'])
        ), step(q, ini, st, letter, said) AS (
            VALUES (0, '', 0, 'D', ''), (1, '', 1, 'D', ''), (2, '', 2, 'D', ''), (3, '', 3, 'D', ''), (0, 's', 1, 'K', ''), (0, 'u', 2, 'K', ''), (1, 'u', 2, 'K', ''), (3, 'u', 2, 'K', ''), (2, 'a', 3, 'K', ''),
                   (0, '', 2, 'R', 'user'), (1, '', 2, 'R', 'user'), (3, '', 2, 'R', 'user'), (2, '', 3, 'R', 'assistant')
        ), dp(cid, i, st, best) AS (
            SELECT DISTINCT cid, 0::BIGINT, 0, {'cost': 0::BIGINT, 'audit': '', 'lines': []::VARCHAR[]} FROM d
            UNION ALL
            SELECT dp.cid, q.i, step.st, min({'cost': best.cost + 3 * len(ins) + CASE letter WHEN 'D' THEN 4 WHEN 'R' THEN 3 ELSE 0 END + CASE WHEN letter <> 'D' AND fault = 'truncated' THEN 3 ELSE 0 END,
                'audit': best.audit || repeat('I', len(ins)) || letter, 'lines': best.lines || ins || CASE letter WHEN 'K' THEN [role || ':' || text] WHEN 'R' THEN [said || ':' || text] ELSE []::VARCHAR[] END})
            FROM dp JOIN q ON q.cid = dp.cid AND q.i = dp.i + 1 JOIN chain ON chain.p = dp.st JOIN step ON step.q = chain.q AND (letter = 'D' OR fault NOT IN ('blank', 'duplicate') AND (letter = 'R' OR step.ini = q.ini))
            GROUP BY dp.cid, q.i, step.st
        ), fig AS (
            SELECT cid, max(i) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(fault = 'blank') AS blank, count_if(fault = 'duplicate') AS duplicate, count_if(fault = 'truncated') AS truncated,
                   count_if(pair NOT IN ('su', 'ua', 'au')) AS illegal FROM q GROUP BY cid
        ), done AS (
            SELECT dp.cid, min({'cost': best.cost + 3 * len(ins), 'audit': best.audit || repeat('I', len(ins)), 'lines': best.lines || ins}) AS best
            FROM dp JOIN fig ON fig.cid = dp.cid AND fig.n = dp.i JOIN chain ON chain.p = dp.st AND chain.q IN (0, 3) GROUP BY dp.cid
        )
        SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
               coalesce(best.cost, 0)::BIGINT AS cost, coalesce(best.audit, '') AS audit, sha256(coalesce(array_to_string(best.lines, chr(10)), '')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN fig ON fig.cid = coalesce(c.conv_id::VARCHAR, ' ') LEFT JOIN done ON done.cid = fig.cid""",
}
