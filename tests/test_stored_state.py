"""State that outlives a job: upserts that touch few partitions, sketches merged from parts."""

import os

from pyspark.sql import functions as F

from assay.operators import profile as P
from assay.operators import schedule as SC


def files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns
            for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet")}


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_upsert_leaves_untouched_partitions(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(40).select("id", (F.col("id") * 2).alias("v"), F.when(F.col("id") < 36, F.floor(F.col("id") / 10)).alias("part")) \
        .repartition("part").write.partitionBy("part").parquet(path)
    before = files(path)
    new = [(3, -1, 0), (100, -2, 0), (39, -3, None), (200, -4, 7)]
    SC.upsert_partitions(path, spark.createDataFrame(new, "id long, v long, part long"), ["id"], "part")
    after = files(path)
    kept = {f: t for f, t in before.items() if "part=1" in f or "part=2" in f or "part=3" in f}
    assert len(kept) == 3 and {f: after.get(f) for f in kept} == kept
    assert not set(before) - set(kept) & set(after)
    want = {i: (i, 2 * i, i // 10 if i < 36 else None) for i in range(40)} | {r[0]: r for r in new}
    assert rows(spark.read.parquet(path).select("id", "v", "part")) == sorted(want.values(), key=str)


def test_upsert_of_nothing_writes_nothing(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(4).select("id", (F.col("id") % 2).alias("part")).write.partitionBy("part").parquet(path)
    before = files(path)
    SC.upsert_partitions(path, spark.createDataFrame([], "id long, part long"), ["id"], "part")
    assert files(path) == before


def test_sketches_of_parts_tell_what_one_pass_tells(spark):
    df = spark.range(30000).select((F.col("id") % 7).alias("day"), F.when(F.col("id") % 10 > 0, F.col("id") % 5000).alias("a"),
                                   F.concat(F.lit("x"), F.col("id") % 900).alias("b"), F.lit(None).cast("double").alias("c"))
    parts = P.column_sketches(df, ["a", "b", "c"], ["day"])
    assert parts.count() == 21
    days = P.merge_sketches(parts.filter("day < 3")).unionByName(P.merge_sketches(parts.filter("day >= 3")))
    merged = P.sketch_metrics(P.merge_sketches(days))
    got = {r["column"]: r for r in merged.collect()}
    exact = {r["column"]: r for r in P.column_metrics(df, ["a", "b", "c"]).collect()}
    for c, r in exact.items():
        assert [got[c][k] for k in ("null_count", "count", "sum", "min", "max")] == [r[k] for k in ("null_count", "count", "sum", "min", "max")]
        assert abs(got[c].distinct_count - r.distinct_count) <= 0.06 * r.distinct_count
    assert got["a"].n_sketched == 27000 and got["b"].quantiles is None and got["c"].quantiles is None
    errors = P.rank_errors(df, merged, ["a"]).collect()
    assert errors[0].rank_error <= 0.02
    assert "Expand" not in parts._jdf.queryExecution().executedPlan().toString()


def test_rank_error_of_a_wrong_quantile(spark):
    df = spark.range(1000).select(F.col("id").alias("a"))
    said = spark.createDataFrame([("a", [249.0, 499.0, 900.0])], "column string, quantiles array<double>")
    assert abs(P.rank_errors(df, said, ["a"]).first().rank_error - 0.15) < 1e-9


def test_sketches_of_an_empty_table(spark):
    none = spark.createDataFrame([], "day int, a long, b string")
    assert P.sketch_metrics(P.merge_sketches(P.column_sketches(none, ["a", "b"], ["day"]))).collect() == []
