"""Packing: concatenate all documents' ids and cut into fixed windows.

First pass: every partition tokenizes its documents, numbers them by the ids before
them in the partition, and writes the ids. Second pass: a prefix sum over the
partitions' totals makes those numbers global, and each document is cut where a
window of the whole sequence ends; a document that crosses a boundary gives one
record for each window it touches. Only the last sequence is padded.

Defined results: a null or empty text is the end id alone; repeated rows are packed
each; a text of any length is cut into as many pieces as it needs; an empty table
gives no rows. The order is that of the table's partitions.
"""

from __future__ import annotations

from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from assay.llm import bpe, common

WINDOW = 4096
END_ID = 2
TOKENIZER = "word_bpe_49k.json"
ROWS = "doc_id long, _part int, _at long, doc_tokens long, ids binary"


def tokenizer_path(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def slices(batch, chars: int = 4 << 20):
    """``batch`` in runs of rows with about ``chars`` bytes of text (column 1), a row at least."""
    import numpy as np
    import pyarrow.compute as pc
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype("int64"))
    at = 0
    while at < len(ends):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + chars, "right")))
        yield batch.slice(at, to - at)
        at = to


def tokenize(docs: DataFrame, path: str, end_id: int = END_ID) -> DataFrame:
    """doc_id, ids (little-endian uint32, with ``end_id``), their number, partition and ids before them in it."""
    def run(batches):
        import pyarrow as pa
        words, at, part = bpe.word_ids(path), 0, TaskContext.get().partitionId()
        end = end_id.to_bytes(4, "little")
        for b in (x for batch in batches for x in slices(batch)):
            out = []
            for key, ids in zip(b.column(0).to_pylist(), words.encode(b.column(1).fill_null(""))):
                ids += end
                out.append((key, part, at, len(ids) // 4, ids))
                at += len(ids) // 4
            if out:
                cols = list(zip(*out))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()))],
                    ["doc_id", "_part", "_at", "doc_tokens", "ids"])
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, ROWS)


def pack(docs: DataFrame, path: str | None = None, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, start, length, ids, doc_tokens, sequence_id, offset."""
    tokens = common.materialize(tokenize(docs, path or tokenizer_path(TOKENIZER), end_id), "tokens")
    totals = tokens.groupBy("_part").agg(F.sum("doc_tokens").alias("n"))  # one row per task of the first pass
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))
    w = F.lit(window)
    placed = (tokens.join(F.broadcast(offsets), "_part").withColumn("_g", F.col("_before") + F.col("_at"))
              .withColumn("sequence_id", F.explode(F.sequence(
                  F.floor(F.col("_g") / w), F.floor((F.col("_g") + F.col("doc_tokens") - 1) / w))))
              .withColumn("start", F.greatest(F.lit(0).cast("long"), F.col("sequence_id") * w - F.col("_g")))
              .withColumn("length", F.least("doc_tokens", (F.col("sequence_id") + 1) * w - F.col("_g")) - F.col("start")))
    return placed.select(
        "doc_id", "start", "length",
        F.expr("substring(ids, int(start * 4 + 1), int(length * 4))").alias("ids"),
        "doc_tokens", "sequence_id", (F.col("_g") + F.col("start") - F.col("sequence_id") * w).alias("offset"))


def op3(docs: DataFrame) -> DataFrame:
    return pack(docs).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens",
                             "sequence_id", "offset")
