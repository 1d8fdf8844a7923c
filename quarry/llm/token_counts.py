"""Token counts of whole documents by rank-synchronous BPE merging.

Each task reads Arrow batches, cuts every text into pre-tokens, merges the new distinct ones together as ragged numpy
arrays (see ``bpe``) and adds up the surviving symbols. Nothing is shuffled, so a hot source or a group of copies costs
no more than its bytes.

Null texts count as empty (0 bytes, 0 tokens). Repeated rows each give a row. An empty table gives an empty result. Only
the id and text columns are read; other columns, whatever their names, don't matter.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import default_vocabulary, encoder


def count_tokens(docs: DataFrame, vocabulary: str | None = None, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit)."""
    path = vocabulary or default_vocabulary()
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = T.StructType([docs.schema["doc_id"], T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())])

    def count(batches):
        own = encoder(path)
        for batch in batches:
            tokens = np.zeros(batch.num_rows, np.int64)
            for first, last, counts, _ in own.encode(batch.column(1), with_ids=False):
                tokens[first:last] = counts
            size = pc.fill_null(pc.binary_length(batch.column(1)), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), size, pa.array(tokens), pa.array(tokens > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.mapInArrow(count, schema)
