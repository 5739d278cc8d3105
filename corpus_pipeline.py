"""The corpus pipeline: quality, exact copies, near copies, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next one's docs.
All but the last return the columns of documents.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barflow.llm import exact_dedup, jaccard, packing, pii, quality
from barflow.llm.common import cut, fresh, short_batches

#: Where the packing stage's tokenizer file is.
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


#: Numbers the rows of a stage's input, so that a decision is about one row whatever its doc_id.
ROW = "__row"


def _numbered(docs: DataFrame) -> DataFrame:
    """doc_id, text and ROW of each row. docs must give the same rows in the same order each time it is read, as the Parquet files of a stage do."""
    return docs.select("doc_id", "text", F.monotonically_increasing_id().alias(ROW))


def _kept(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """The rows of docs whose number is in rows (a column ROW)."""
    name = fresh(ROW, docs.columns)
    return docs.withColumn(name, F.monotonically_increasing_id()).join(rows.select(F.col(ROW).alias(name)), name, "left_semi").drop(name)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects (score under 0.5) go. It is fitted on labelled documents that are not held out."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    # columns of any name travel through the scores under names of their own
    place = {c: f"column_{k}" for k, c in enumerate(docs.columns)}
    scored = quality.score(docs.toDF(*place.values()), quality.fit(docs, labels), id_col=place["doc_id"], text_col=place["text"], keep=tuple(p for c, p in place.items() if c != "doc_id"))
    return scored.filter("predicted = 1").select(*(F.col(p).alias(c) for c, p in place.items()))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for blanks one row stays, with null and repeated ids as well."""
    return _kept(docs, exact_dedup.find_copies(_numbered(docs), row_col=ROW).filter("kept"))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five words a shingle, similarity 0.8 or more) the row with the smallest id stays; null ids come
    last, and of equal ids the first row. Rows that share an id are documents of their own."""
    numbered = _numbered(docs)
    groups = jaccard.near_duplicates(numbered, id_col=ROW, words=5, similarity=(8, 10)).join(numbered.select(ROW, "doc_id"), ROW)
    best = groups.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", ROW)).alias("best"))
    return _kept(docs, best.select(F.col(f"best.{ROW}").alias(ROW)))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by [PRIVATE]; n_chars follows the text."""
    clean = pii.redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 2048 tokens, as pieces with their ids."""
    return packing.pack(docs, TOKENIZER, length=2048, end_id=1)


def _lean(stage: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """stage in a session whose batches for Python workers are short: all stages share the executors, and what one's buffers took stays with them."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        short_batches(spark)
        return stage(spark, docs, sf_dir)

    return run


STAGES = [(name, _lean(stage)) for name, stage in (("quality", quality_stage), ("exact_dedup", exact_stage), ("ngram_jaccard", near_stage), ("pii", pii_stage), ("packing", packing_stage))]

#: The classifier, the trees and the tokenizer are not SQL; the stages are tested against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. What lies between them is written to the shared folder that the session names."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    cut(spark.range(0))  # makes sure that there is a folder
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path
    before = None
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            here = f"{folder}/{k}-{name}"
            docs.write.parquet(here)
            docs = spark.read.parquet(here)
            if before is not None:  # nothing reads it any more; the last one is what the result is read from
                path(before).getFileSystem(spark._jsc.hadoopConfiguration()).delete(path(before), True)
            before = here
    return docs
