"""URL rules, and a list of URLs behind a blocked Bloom filter. Everything is DataFrame expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Words of a block of the filter: a key sets one bit in each. Fixed odd multipliers spread a key's hash to them.
WORDS = 8
SALTS = [0x9E3779B97F4A7C15 - (1 << 64), 0xC2B2AE3D27D4EB4F - (1 << 64), 0x165667B19E3779F9, 0xD6E8FEB86659FD93 - (1 << 64), 0xA0761D6478BD642F - (1 << 64), 0xE7037ED1A0B428DB - (1 << 64), 0x8EBC6AF09C88C6E3 - (1 << 64), 0x589965CC75374CC3]
#: Bits of the filter a listed URL, and the most blocks that are broadcast (64 bytes each); past that the filter passes more,
#: and the exact join still decides.
BITS_A_KEY = 12
MOST_BLOCKS = 1 << 17
#: Query parameters that say where a visitor came from, not what a page is.
TRACKING = r"^(utm_[^=]*|ref|gclid|fbclid)(=.*)?$"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; empty for null or without ://."""
    return F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """From the host's end up to ? # or the end; empty for null or without ://."""
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def canonical(url: Column) -> Column:
    """Host without www., path without its last slashes, and the query without tracking parameters, in order of the parameters.
    Scheme and fragment go. Empty for null or without ://."""
    query = F.regexp_extract(_rest(url), r"^[^?#]*\?([^#]*)", 1)
    kept = F.array_join(F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(TRACKING))), "&")
    return F.concat(F.regexp_replace(host_of(url), r"^www\.", ""), F.regexp_replace(path_of(url), r"/+$", ""), F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]], what: int) -> Column:
    """Of the rules (verdict, host + path) that fit, what (0: the verdict, 1: the rule) of the longest; null if none fits.

    A rule fits its host and all subdomains if the URL's path starts with the rule's. Rules of one length go in order of text.
    """
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r[1]), r[1]), reverse=False):
        name, slash, start = rule[1].partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(slash + start)
        out = F.when(fits, F.lit(rule[what])).otherwise(out)
    return out


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(1)), F.lit(blocks))


def _bits(key: Column) -> list[Column]:
    """One bit in each word of the key's block: the top six bits of the hash's low half times the word's multiplier."""
    low = F.xxhash64(key, F.lit(2)).bitwiseAND(F.lit(0x7FFFFFFF))
    return [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned((low * F.lit(s & 0x7FFFFFFF)).bitwiseAND(F.lit(0x7FFFFFFFFFFFFFF)), 31).bitwiseAND(F.lit(63)).cast("int")) for s in SALTS]


def build_filter(keys: DataFrame, key: str, count: int) -> tuple[DataFrame, int]:
    """The filter of distinct keys as rows (block, w0 .. w7), and the number of blocks."""
    blocks = max(1, min(MOST_BLOCKS, -(-count * BITS_A_KEY // (64 * WORDS))))
    rows = keys.select(_block(F.col(key), blocks).alias("block"), *(b.alias(f"w{i}") for i, b in enumerate(_bits(F.col(key)))))
    return rows.groupBy("block").agg(*(F.bit_or(f"w{i}").alias(f"w{i}") for i in range(WORDS))), blocks


def judge(df: DataFrame, rules: list[tuple[str, str]], listed: DataFrame, *, id_col: str = "page_id", url_col: str = "url", listed_col: str = "url") -> DataFrame:
    """id_col, host, path, rule, verdict of each row of df.

    The longest fitting rule decides (rule_of). Where none fits, a URL whose canonical form is that of a listed one is blocked, any
    other allowed. listed: a DataFrame of URLs; its canonical forms go into a blocked Bloom filter of bounded size, which is
    broadcast. Only rows that pass it are shuffled, to the exact join that removes false positives; a very common URL is split
    by adaptive execution there. Null or malformed URLs have empty host and path, and are allowed. Null and repeated ids and
    URLs are judged as any; an empty table gives no rows; an empty list blocks nothing. Other columns of df are not read.
    """
    own = cut(listed.select(canonical(F.col(listed_col)).alias("known")).filter("known <> ''").distinct())
    bloom, blocks = build_filter(own, "known", own.count())
    base = df.select(F.col(id_col), F.col(url_col).alias("__url"))
    parts = base.select(id_col, "__url", host_of(F.col("__url")).alias("host"), path_of(F.col("__url")).alias("path"))
    ruled = parts.withColumns({"rule": rule_of(F.col("host"), F.col("path"), rules, 1), "verdict": rule_of(F.col("host"), F.col("path"), rules, 0)})
    done = ruled.filter(F.col("rule").isNotNull())
    open_ = ruled.filter(F.col("rule").isNull()).withColumn("known", canonical(F.col("__url")))
    probed = open_.withColumn("block", _block(F.col("known"), blocks)).join(F.broadcast(bloom), "block", "left")
    hit = F.coalesce(F.reduce(F.array(*((b.bitwiseAND(F.col(f"w{i}"))) != 0 for i, b in enumerate(_bits(F.col("known"))))), F.lit(True), lambda a, x: a & x), F.lit(False))
    passing, rest = probed.filter(hit), probed.filter(~hit)
    joined = passing.join(own.withColumn("is_listed", F.lit(True)).hint("shuffle_hash"), "known", "left")
    cols = [id_col, "host", "path", "rule"]
    return (
        done.select(*cols, "verdict")
        .unionByName(rest.select(*cols, F.lit("allow").alias("verdict")))
        .unionByName(joined.select(*cols, F.when(F.col("is_listed"), "block").otherwise("allow").alias("verdict")))
    )
