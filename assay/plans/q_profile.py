"""Queries for dataset profiles."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import profile as P
from ..session import scratch_dir
from ..sources.tables import read_table
from .registry import register

PROFILE_COLUMNS = ["l_quantity", "l_extendedprice", "l_discount", "l_suppkey", "l_returnflag"]


def _metric_sql(col: str, numeric: bool = True) -> str:
    num = f"cast({col} as double)" if numeric else "cast(null as double)"
    return (f"select '{col}' as \"column\", count(*) filter (where {col} is null) as null_count, "
            f"count(distinct {col}) as distinct_count, round(sum({num}), 2) as sum, count({col}) as count, "
            f"min({num}) as min, max({num}) as max from lineitem")


@register("prof_columns", " union all ".join(_metric_sql(c, c != "l_returnflag") for c in PROFILE_COLUMNS))
def prof_columns(spark, sf):
    """Column metrics of lineitem in one aggregate (text columns have no numeric metrics)."""
    li = read_table(spark, sf, "lineitem")
    m = P.column_metrics(li, PROFILE_COLUMNS)
    return m.withColumn("sum", F.round("sum", 2))


@register("prof_quantiles")
def prof_quantiles(spark, sf):
    """D9 quantiles (approximate sketches): rows-only check."""
    return P.column_quantiles(read_table(spark, sf, "lineitem"), PROFILE_COLUMNS[:4])


def _sketch_sql(col: str, numeric: bool) -> str:
    num = f"cast({col} as double)" if numeric else "cast(null as double)"
    return (f"select '{col}' as \"column\", count(*) filter (where {col} is null) as null_count, count({col}) as count, "
            f"round(sum({num}), 2) as sum, min({num}) as min, max({num}) as max, "
            f"{f'count({col})' if numeric else 'null'} as n_sketched, true as distinct_close, "
            f"{'true' if numeric else 'cast(null as boolean)'} as ranks_close from lineitem")


@register("prof_sketches", " union all ".join(_sketch_sql(c, c != "l_returnflag") for c in PROFILE_COLUMNS))
def prof_sketches(spark, sf):
    """D9 from stored state: sketches of each ship month, written, read back and merged; the distinct counts are held
    to 6% (about four standard errors) of the exact ones and the quantiles to 2% of their ranks in the whole table."""
    li = read_table(spark, sf, "lineitem")
    path = scratch_dir(spark, f"column-sketches-{uuid.uuid4().hex}")
    P.column_sketches(li.withColumn("month", F.date_trunc("month", "l_shipdate")), PROFILE_COLUMNS, ["month"]).write.parquet(path)
    merged = P.sketch_metrics(P.merge_sketches(spark.read.parquet(path)))
    exact = P.column_metrics(li, PROFILE_COLUMNS).select("column", F.col("distinct_count").alias("_exact"))
    errors = P.rank_errors(li, merged, [c for c in PROFILE_COLUMNS if c != "l_returnflag"])
    return merged.join(exact, "column").join(errors, "column", "left").select(
        "column", "null_count", "count", F.round("sum", 2).alias("sum"), "min", "max", "n_sketched",
        (F.abs(F.col("distinct_count") - F.col("_exact")) <= F.greatest(F.lit(1.0), 0.06 * F.col("_exact"))).alias("distinct_close"),
        (F.col("rank_error") <= 0.02).alias("ranks_close"))


@register("prof_output_stats", """
select 'orders' as table_name, count(*) as row_count from orders
union all select 'lineitem', count(*) from lineitem
union all select 'customer', count(*) from customer""")
def prof_output_stats(spark, sf):
    """Row counts observed while each table is written (noop sink, one pass)."""
    rows = []
    for t in ("orders", "lineitem", "customer"):
        stats = P.observed_write(read_table(spark, sf, t),
                                 lambda d: d.write.format("noop").mode("overwrite").save())
        rows.append((t, int(stats["rowCount"])))
    return spark.createDataFrame(rows, "table_name string, row_count long")


_TYPE_SQL = """case data_type when 'BIGINT' then 'bigint' when 'INTEGER' then 'int' when 'DOUBLE' then 'double'
  when 'VARCHAR' then 'string' when 'TIMESTAMP' then 'timestamp_ntz' when 'BOOLEAN' then 'boolean'
  when 'FLOAT[]' then 'array<float>' else lower(data_type) end"""


@register("prof_schema", f"""
select table_name, cast(ordinal_position as int) as position, column_name as name, {_TYPE_SQL} as type
from information_schema.columns
where table_name in ('region', 'nation', 'customer', 'supplier', 'part', 'orders', 'lineitem', 'events',
                     'documents', 'labels')""")
def prof_schema(spark, sf):
    """Schema rows of the driver tables."""
    rows = []
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
              "documents", "labels"):
        rows += P.schema_rows(read_table(spark, sf, t), t)
    return spark.createDataFrame(rows, P.SCHEMA_ROWS_T)


@register("prof_output_size")
def prof_output_size(spark, sf):
    """D10 size: bytes of each driver table from a metadata-only file listing; rows-only check."""
    from ..sources.tables import list_files_by_mtime
    files = list_files_by_mtime(spark, sf, "*.parquet")
    return files.select(F.regexp_extract("path", r"([^/]+)\.parquet$", 1).alias("table_name"),
                        F.col("length").alias("size_bytes"))
