"""Sharding by a two-pass external shuffle: a seeded scatter into memory-sized buckets, then Fisher-Yates in each."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, fresh

#: Bytes of text in a bucket.
BUCKET_BYTES = 16 << 20
#: Buckets whose counts are summed up in one window.
GROUP = 4096
#: Rows that are equal in all columns and stay together.
COPIES = 1024


def scatter(df: DataFrame, buckets: int, seed: int) -> DataFrame:
    """df with __bucket (with more underscores, if df has such a column)."""
    placed, key, _ = _scattered(df, buckets, seed)
    return placed.drop(key)


def _scattered(df: DataFrame, buckets: int, seed: int) -> tuple[DataFrame, str, str]:
    """df with two more columns, and their names: a seeded hash of all of a row (and of its number among rows that are equal in all, where these are
    many), and its bucket."""
    names = [F.col(f"`{c}`") for c in df.columns]
    key, bucket, n = (fresh(c, df.columns) for c in ("__key", "__bucket", "__n"))
    rows = df.withColumn(key, F.xxhash64(*names, F.lit(seed)))
    many = cut(rows.groupBy(key).agg(F.count("*").alias(n)).filter(F.col(n) > COPIES).select(key))
    if not many.isEmpty():
        equal = rows.join(many, key, "left_semi").groupBy(*names).agg(F.count("*").alias(n))
        equal = equal.select(*names, F.explode(F.sequence(F.lit(1), F.col(n))).alias(key)).withColumn(key, F.xxhash64(*names, key, F.lit(seed)))
        rows = rows.join(many, key, "left_anti").select(*names, key).unionByName(equal)
    return rows.withColumn(bucket, F.pmod(key, F.lit(buckets))), key, bucket


def shard(df: DataFrame, shards: int = 16, *, id_col: str = "doc_id", text_col: str = "text", seed: int = 29, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """df's columns in random order, with shard (0 to shards - 1) and slot (place in the shard, gapless from 0).

    Pass 1 scatters whole records into buckets of about bucket_bytes by a seeded hash of all their columns, so any rows scatter: copies of one
    text, rows of one id or of none. Rows that are equal in all and more than COPIES are counted and numbered, and scatter by number too.
    Pass 2 puts each bucket in order of that hash, in which only rows that are equal in all tie, and shuffles it in memory by Fisher-Yates, seeded with the
    bucket's number. The buckets in a row are one random order of all
    records; place p in it goes to slot p // shards of shard p % shards. So shards differ by one row at most. The result depends on rows
    and seed alone, not on tasks or retries.

    Null texts have no bytes; null ids and rows that repeat an id are records as any. An empty table gives no rows. Columns of
    df named shard or slot are replaced. The first place of each bucket is a sum within 4096 buckets and one over such groups; no table of
    buckets goes to the driver.
    """
    names = [c for c in df.columns if c not in ("shard", "slot")]
    df = df.select(*(F.col(f"`{c}`") for c in names))
    total = df.select(F.sum(F.coalesce(F.octet_length(text_col), F.lit(0)) + 16).alias("b")).first().b or 0
    buckets = max(1, -(-total // bucket_bytes))
    placed, scatter_key, scatter_bucket = _scattered(df, buckets, seed)
    begin = fresh("__first", placed.columns)
    counts = placed.groupBy(F.col(scatter_bucket).alias("bucket")).agg(F.count("*").alias("n")).withColumn("part", F.expr(f"bucket div {GROUP}"))
    inner = F.sum("n").over(Window.partitionBy("part").orderBy("bucket")) - F.col("n")
    # one row a group of buckets: 64 GB of text each
    before = F.sum("n").over(Window.orderBy("part")) - F.col("n")
    groups = counts.groupBy("part").agg(F.sum("n").alias("n")).select("part", before.alias("before"))
    first = counts.withColumn("inner", inner).join(groups, "part").select(F.col("bucket").alias(scatter_bucket), (F.col("inner") + F.col("before")).alias(begin))

    def shuffle(key: tuple, group: pa.Table) -> pa.Table:
        bucket, start = key[0].as_py(), group[begin][0].as_py() if group.num_rows else 0
        group = group.take(pc.sort_indices(group, [(scatter_key, "ascending"), (id_col, "ascending"), (text_col, "ascending")])).select(names)
        order = np.arange(group.num_rows)
        np.random.Generator(np.random.PCG64([seed, bucket])).shuffle(order)  # Fisher-Yates
        at = start + np.arange(group.num_rows)
        return group.take(pa.array(order)).append_column("shard", pa.array((at % shards).astype(np.int32))).append_column("slot", pa.array(at // shards))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return placed.join(first, scatter_bucket).groupBy(scatter_bucket).applyInArrow(shuffle, f"{fields}, shard int, slot long")


def write_shards(sharded: DataFrame, path: str) -> None:
    """Writes what shard() gave, a folder a shard, each task writing what it shuffled; slot has the order."""
    sharded.write.partitionBy("shard").parquet(path)
