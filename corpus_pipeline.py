"""A corpus pipeline over ``documents``: clean, de-duplicate, redact, mix, pack.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next one's docs. All but the last return the columns
of ``documents``.

quality_rules      lines that fail are cut from the text, documents that fail go
simhash_near_dedup one document of each near-duplicate group stays
secret_scans       secrets are replaced by a mark
mix_sources        each document is repeated as often as the mix takes it
packing            sequences of 4096 tokens, one row per piece
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from assay.llm import common, mix, pack, quality, secret_scan, simhash


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    common.prepare(spark)
    return quality.clean(docs)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    common.prepare(spark)
    return simhash.dedup(docs, size=3, radius=2)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    common.prepare(spark)
    return secret_scan.redact(docs)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    common.prepare(spark)
    return mix.mix(docs)


def pack_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    common.prepare(spark)
    return pack.pack(docs)


STAGES = [
    ("quality_rules", quality_stage),
    ("simhash_near_dedup", dedup_stage),
    ("secret_scans", secrets_stage),
    ("mix_sources", mix_stage),
    ("packing", pack_stage),
]

# XXH64 fingerprints, BPE ids and connected components are beyond SQL; tests hold every stage against brute force over its own input.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.prepare(spark)
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
