"""Queries of the corpus operators over the driver tables, and their DuckDB oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from assay.llm import (common, embed_dedup, lang_id, license_scan, mix, pack, periodic, quality, search, secret_scan,
                       simhash, suffix_dedup, token_count, url_filter)


def _over(names: str, fn) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        common.prepare(spark)
        return fn(*[common.table(spark, sf_dir, name) for name in names.split()])
    return run


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mix_sources": _over("documents", mix.op1),
    "op2_embedding_dedup": _over("embeddings", embed_dedup.op2),
    "op3_pack": _over("documents", pack.op3),
    "op4_simhash_dedup": _over("documents", simhash.op4),
    "op5_secret_scan": _over("documents", secret_scan.op5),
    "op6_license_scan": _over("documents", license_scan.op6),
    "op7_language_id": _over("documents", lang_id.op7),
    "op8_suffix_dedup": _over("documents", suffix_dedup.op8),
    "op9_token_counts": _over("documents", token_count.op9),
    "op10_quality_rules": _over("documents", quality.op10),
    "op11_periodic_runs": _over("documents", periodic.op11),
    "op12_ranked_search": _over("documents benchmark", search.op12),
    "op13_url_filter": _over("pages", url_filter.op13),
}

ORACLE: dict[str, str] = {
    "op1_mix_sources": mix.OP1_SQL,
    "op2_embedding_dedup": embed_dedup.OP2_SQL,
    "op12_ranked_search": search.OP12_SQL,
    "op13_url_filter": url_filter.OP13_SQL,
}
