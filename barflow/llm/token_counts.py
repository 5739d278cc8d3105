"""Token counts by the whole-token shortcut.

Before the job, the driver proves for each vocabulary string whether it encodes alone as one token. A pre-token among them
counts 1 without merging; only the rest are merged. Counts equal the tokenizer library's.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .bpe import Bpe, SegmentMap
from .common import Memo, raw, slices

#: Segments, and words, that each Python worker remembers.
MEMO = 500_000


def count_tokens(df: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024) -> DataFrame:
    """id_col, n_bytes, n_tokens, over_limit (n_tokens > limit) of each row of df, in one pass without a shuffle.

    path: a byte-level BPE file that the driver reads; its model (of the vocabulary's size) is broadcast. Null text counts as
    empty: 0 bytes, 0 tokens. Null or repeated ids are returned as they come. An empty table gives no rows. Other columns of
    df are not read, whatever their names.
    """
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(Bpe(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe: Bpe = shared.value
        alone, merge, words = bpe.alone, bpe.merge, bpe.words
        tokens = Memo(lambda w: 1 if w in alone else len(merge(w)), MEMO)
        counts = SegmentMap(lambda s: sum(map(tokens.__getitem__, words(s))), MEMO)
        for batch in slices(batches):
            n_bytes, n_tokens = [], []
            for text in raw(batch.column(1)):
                n_bytes.append(len(text))
                parts = bpe.parts(text.decode())
                n_tokens.append(len(parts) // 2 + sum(sum(counts.values(p)) for p in parts[::2] if p))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64()), pa.array([n > limit for n in n_tokens], pa.bool_())],
                [id_col, "n_bytes", "n_tokens", "over_limit"],
            )

    rows = df.select(id_col, text_col)
    kind = rows.schema[0].dataType.simpleString()
    return rows.mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean")
