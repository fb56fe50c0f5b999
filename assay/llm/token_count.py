"""Token counts with the whole-token shortcut.

Once, before the job, each vocabulary string is encoded alone; those that come out as
one token form the proven set, which is broadcast (its size is the vocabulary's). Tasks
cut texts where the tokenizer always cuts, count proven pieces as one token, and let
the tokenizer merge each distinct remaining piece.

Defined results: a null or empty text has 0 bytes and tokens; special strings inside
a text count as the library counts them; texts of any length are counted whole.
"""

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assay.llm import bpe
from assay.llm.pack import tokenizer_path

TOKENIZER = "byte_bpe_50k.json"
LIMIT = 1024


def count_tokens(docs: DataFrame, path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit."""
    path = path or tokenizer_path(TOKENIZER)
    proven = docs.sparkSession.sparkContext.broadcast(bpe.proven_tokens(path))

    @F.pandas_udf("long")
    def n_tokens(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counter = bpe.piece_counts(path, lambda: proven.value)
        for texts in batches:
            yield pd.Series(counter.count(texts.tolist()), dtype="int64")

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), n_tokens(text).alias("n_tokens"))
    return rows.withColumn("over_limit", F.col("n_tokens") > limit)


def op9(docs: DataFrame) -> DataFrame:
    return count_tokens(docs)
