"""Dataset profiles: column metrics, output statistics, schema rows and
column-lineage edges (D9, D10, H21, C13) -- the facet payloads the event
model carries, computed with Spark aggregates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .checks import quote_ident


def column_metrics(df: DataFrame, columns: list[str], exact_distinct: bool = True,
                   rsd: float = 0.01) -> DataFrame:
    """Null count, distinct count, sum, count, min and max of every listed
    column in one scan and one aggregate, returned as one row per column.

    ``exact_distinct=False`` uses HyperLogLog (``approx_count_distinct``),
    which keeps the aggregate map-side-combinable for very wide profiles."""
    aggs = []
    for i, c in enumerate(columns):
        x = F.col(quote_ident(c))
        numeric = isinstance(df.schema[c].dataType, T.NumericType)
        num = x.cast("double") if numeric else F.lit(None).cast("double")
        aggs += [F.count_if(x.isNull()).alias(f"n{i}"),
                 (F.count_distinct(x) if exact_distinct else F.approx_count_distinct(x, rsd)).alias(f"d{i}"),
                 F.sum(num).alias(f"s{i}"), F.count(x).alias(f"c{i}"),
                 F.min(num).alias(f"lo{i}"), F.max(num).alias(f"hi{i}")]
    m = df.agg(*aggs)
    rows = [F.struct(F.lit(c).alias("column"), F.col(f"n{i}").alias("null_count"),
                     F.col(f"d{i}").cast("long").alias("distinct_count"), F.col(f"s{i}").alias("sum"),
                     F.col(f"c{i}").alias("count"), F.col(f"lo{i}").alias("min"), F.col(f"hi{i}").alias("max"))
            for i, c in enumerate(columns)]
    return m.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def column_quantiles(df: DataFrame, columns: list[str], probs=(0.25, 0.5, 0.75), accuracy: int = 10000) -> DataFrame:
    """D9 quantiles (approximate, mergeable sketches; one aggregate)."""
    aggs = [F.percentile_approx(F.col(quote_ident(c)).cast("double"), list(probs), accuracy).alias(f"q{i}")
            for i, c in enumerate(columns)]
    m = df.agg(*aggs)
    rows = [F.struct(F.lit(c).alias("column"),
                     F.map_from_arrays(F.array(*[F.lit(str(p)) for p in probs]), F.col(f"q{i}")).alias("quantiles"))
            for i, c in enumerate(columns)]
    return m.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


# ---- stored profiles: mergeable sketches -------------------------------------------

def column_sketches(df: DataFrame, columns: list[str], by: list[str], lg_k: int = 12, k: int = 400) -> DataFrame:
    """D9 as stored state: one row per part (the values of ``by``) and column with null count, count, sum, min,
    max, a HyperLogLog sketch of the distinct values and, for numbers, a KLL sketch of the distribution.

    One aggregate with map-side combine and no ``Expand``: the state of a part is ``columns`` sketches of a
    size fixed by ``lg_k`` and ``k``, whatever its rows. Rows of several days or tables are merged by
    ``merge_sketches``, so a profile is brought up to date by sketching the new parts only. Nulls enter no
    sketch; a part without a value of a column has null sketches."""
    aggs, rows = [], []
    for i, c in enumerate(columns):
        x, kind = F.col(quote_ident(c)), df.schema[c].dataType
        numeric = isinstance(kind, T.NumericType)
        num = x.cast("double") if numeric else F.lit(None).cast("double")
        name = x.cast("long") if isinstance(kind, T.IntegralType) else x.cast("string")
        aggs += [F.count_if(x.isNull()).alias(f"n{i}"), F.count(x).alias(f"c{i}"), F.sum(num).alias(f"s{i}"),
                 F.min(num).alias(f"lo{i}"), F.max(num).alias(f"hi{i}"), F.hll_sketch_agg(name, lg_k).alias(f"h{i}")]
        if numeric:
            aggs.append(F.kll_sketch_agg_double(num, k).alias(f"k{i}"))
        some = F.col(f"c{i}") > 0
        rows.append(F.struct(
            F.lit(c).alias("column"), F.col(f"n{i}").alias("null_count"), F.col(f"c{i}").alias("count"),
            F.col(f"s{i}").alias("sum"), F.col(f"lo{i}").alias("min"), F.col(f"hi{i}").alias("max"),
            F.when(some, F.col(f"h{i}")).alias("distinct_sketch"),
            (F.when(some, F.col(f"k{i}")) if numeric else F.lit(None).cast("binary")).alias("value_sketch")))
    m = df.groupBy(*by).agg(*aggs)
    return m.select(*by, F.explode(F.array(*rows)).alias("_r")).select(*by, "_r.*")


def merge_sketches(sketches: DataFrame, by: tuple[str, ...] = ("column",)) -> DataFrame:
    """Stored profiles of several parts as one, again mergeable; ``by`` holds ``column`` and any part column to keep."""
    return sketches.groupBy(*by).agg(
        F.sum("null_count").alias("null_count"), F.sum("count").alias("count"), F.sum("sum").alias("sum"),
        F.min("min").alias("min"), F.max("max").alias("max"),
        F.hll_union_agg("distinct_sketch", False).alias("distinct_sketch"),
        F.kll_merge_agg_double("value_sketch").alias("value_sketch"))


def sketch_metrics(sketches: DataFrame, probs=(0.25, 0.5, 0.75)) -> DataFrame:
    """What stored profiles tell: the exact metrics, the estimated distinct count (relative standard error about
    ``1.04 / sqrt(2 ** lg_k)``) and the quantiles (rank error about ``2.3 / k``); null for columns without numbers."""
    numbers = F.col("value_sketch").isNotNull() & F.col("max").isNotNull()
    quantiles = F.array(*[F.kll_sketch_get_quantile_double("value_sketch", F.lit(float(p))) for p in probs])
    return sketches.select(
        *[c for c in sketches.columns if c not in ("distinct_sketch", "value_sketch")],
        F.when(F.col("count") > 0, F.hll_sketch_estimate("distinct_sketch")).otherwise(0).alias("distinct_count"),
        F.when(numbers, F.kll_sketch_get_n_double("value_sketch")).alias("n_sketched"),
        F.when(numbers, quantiles).alias("quantiles"))


def rank_errors(df: DataFrame, metrics: DataFrame, columns: list[str], probs=(0.25, 0.5, 0.75)) -> DataFrame:
    """How far the quantiles of ``metrics`` are from true ones: per numeric column the largest distance of a
    probability from the ranks its value has in ``df`` (0 where the value is a true quantile).

    The few quantiles enter one aggregate over ``df`` as a scalar subquery, so nothing is joined or sorted."""
    found = metrics.agg(F.map_from_entries(F.collect_list(F.struct("column", "quantiles"))).alias("q")).scalar()
    aggs = []
    for i, c in enumerate(columns):
        x = F.col(quote_ident(c)).cast("double")
        for j, p in enumerate(probs):
            v = F.get(found[c], F.lit(j))
            below, upto = F.count_if(x < v) / F.count(x), F.count_if(x <= v) / F.count(x)
            aggs.append(F.greatest(below - F.lit(float(p)), F.lit(float(p)) - upto, F.lit(0.0)).alias(f"e{i}_{j}"))
    rows = [F.struct(F.lit(c).alias("column"), F.greatest(*[F.col(f"e{i}_{j}") for j in range(len(probs))], F.lit(0.0))
                     .alias("rank_error")) for i, c in enumerate(columns)]
    return df.agg(*aggs).select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def observed_write(df: DataFrame, writer, name: str = "output_stats") -> dict:
    """Row count of a dataset as it is written, observed in the same job
    (no second pass). ``writer`` receives the observed DataFrame."""
    obs = Observation(name)
    writer(df.observe(obs, F.count(F.lit(1)).alias("rowCount")))
    return obs.get


def schema_rows(df: DataFrame, table: str) -> list[tuple]:
    """``(table, position, name, type)`` per field (metadata only)."""
    return [(table, i + 1, f.name, f.dataType.simpleString()) for i, f in enumerate(df.schema.fields)]


SCHEMA_ROWS_T = "table_name string, position int, name string, type string"

COLUMN_LINEAGE_T = T.MapType(T.StringType(), T.StructType([
    T.StructField("inputFields", T.ArrayType(T.StructType([
        T.StructField("namespace", T.StringType()), T.StructField("name", T.StringType()),
        T.StructField("field", T.StringType())]))),
    T.StructField("transformationDescription", T.StringType()),
    T.StructField("transformationType", T.StringType())]))


def column_lineage_edges(datasets: DataFrame, facet_col: str = "columnLineage") -> DataFrame:
    """One edge per (output field, input field) listed in a dataset's
    column-lineage facet: ``explode`` of the field map, then of its inputs."""
    f = datasets.select("namespace", "name", F.explode(F.col(facet_col)).alias("field", "spec"))
    e = f.select("namespace", "name", "field", "spec.transformationDescription", "spec.transformationType",
                 F.explode("spec.inputFields").alias("src"))
    return e.select(F.col("namespace").alias("out_namespace"), F.col("name").alias("out_name"),
                    F.col("field").alias("out_field"), F.col("src.namespace").alias("in_namespace"),
                    F.col("src.name").alias("in_name"), F.col("src.field").alias("in_field"),
                    "transformationDescription", "transformationType")
