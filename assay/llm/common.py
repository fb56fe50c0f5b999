"""Helpers shared by the corpus operators: written intermediates, row ids, global ranks, connected components."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from assay.session import ensure_checkpoint_dir, ship_package

WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def prepare(spark: SparkSession) -> None:
    """Shared checkpoint folder and the package on the workers' path."""
    ensure_checkpoint_dir(spark)
    ship_package(spark)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` under the shared checkpoint folder and read it back: cuts the
    lineage, computes once, survives lost executors."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/corpus-{name}-{uuid.uuid4().hex[:12]}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def with_row_id(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once with a unique ``_rid``, so that repeated rows and null ids stay apart in joins."""
    return materialize(df.withColumn("_rid", F.monotonically_increasing_id()), name)


def lower_ascii(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def global_rank(df: DataFrame, groups: list[str], order: list[str], name: str) -> DataFrame:
    """Add ``_rank``: 0-based rank within ``groups`` by ``order``, without a whole group in one task.

    Range partitions hold disjoint, ordered key ranges; the rank is the rows of the
    group in earlier partitions (a prefix sum over at most one count per group and
    partition) plus the row number inside the partition. Group columns hold no nulls.
    """
    n = parallelism(df.sparkSession)
    ranged = materialize(df.repartitionByRange(n, *groups, *order).withColumn("_part", F.spark_partition_id()), name)
    counts = ranged.groupBy("_part", *groups).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*(groups or [F.lit(0)])).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_part", *groups, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_part", *groups).orderBy(*order)
    return (ranged.withColumn("_rank", F.row_number().over(inside) - 1)
            .join(offsets, ["_part", *groups])
            .withColumn("_rank", F.col("_rank") + F.col("_before"))
            .drop("_part", "_before"))


def connected_components(edges: DataFrame, name: str) -> DataFrame:
    """(``u``, ``v``) edges of longs to (``node``, ``root``), ``root`` the smallest node reachable.

    Alternating large-star and small-star rounds. Each round is two aggregates with
    map-side minimum and two equi-joins, written to the shared folder; the driver
    sees two numbers a round. Nodes without an edge are not returned.
    """
    def star(pairs: DataFrame) -> DataFrame:
        """Each left end with its smallest neighbour, itself included."""
        return pairs.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))

    def mark(pairs: DataFrame):
        return pairs.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()

    cur = materialize(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
                      .filter("u <> v").distinct(), f"{name}-edges")
    seen = mark(cur)
    while seen["n"]:
        both = cur.union(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = (both.join(star(both), "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .filter("u <> v").distinct())
        large = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        small = large.join(star(large), "u")
        nxt = (small.select(F.col("v").alias("u"), F.col("m").alias("v"))
               .union(small.select("u", F.col("m").alias("v"))).filter("u <> v").distinct())
        cur = materialize(nxt, f"{name}-round")
        now = mark(cur)
        if now == seen:
            break
        seen = now
    roots = cur.select(F.col("v").alias("node")).distinct()
    return (cur.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))
            .unionByName(roots.withColumn("root", F.col("node"))))


def once(c: Column) -> Column:
    """A boolean column that is not moved below the projection that makes it: filters on that projection's columns would
    otherwise be rewritten in terms of the text, inside lambdas too, and work it out anew for each word."""
    return c & (F.monotonically_increasing_id() >= 0)


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def running(values: Column, zero: Column, combine, chunk: int = 256) -> Column:
    """For each element of an array what ``combine`` makes of those before it (``zero`` for the first), in linear time: arrays
    grow to ``chunk`` elements at most, the chunks' own results are combined the same way."""
    def over(items: Column) -> Column:
        begin = F.struct(zero.alias("at"), F.filter(F.array(zero), lambda _: F.lit(False)).alias("out"))
        return F.aggregate(items, begin, lambda a, x: F.struct(combine(a["at"], x).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")))

    none = F.filter(F.array(zero), lambda _: F.lit(False))

    def chunks(v: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / chunk).cast("int")), lambda j: over(F.slice(v, j * chunk + 1, chunk)))

    def whole(parts: Column) -> Column:
        return F.flatten(F.zip_with(parts, _starts(parts, zero, combine), lambda p, start: F.transform(p["out"], lambda x: combine(start, x))))

    one = lambda value, use: F.get(F.transform(F.array(value), use), F.lit(0))  # noqa: E731  computed once
    return one(values, lambda v: F.when(F.size(v) > 0, one(chunks(v), whole)).otherwise(none))


def _starts(parts: Column, zero: Column, combine) -> Column:
    begin = F.struct(zero.alias("at"), F.filter(F.array(zero), lambda _: F.lit(False)).alias("out"))
    return F.aggregate(parts, begin, lambda a, p: F.struct(combine(a["at"], p["at"]).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")),
                       lambda a: a["out"])
