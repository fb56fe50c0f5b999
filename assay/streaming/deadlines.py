"""I8: deadlines of runs, kept as an index that each batch of events updates.

A run's deadline is the nominal end of its root, found through the COMPLETE rows on the way
up; as events arrive in any order, a run may have to wait for an ancestor. Three append-only
tables under one folder, each dealt into buckets by its key, hold what is known:

* ``resolved`` (run_id, deadline): runs whose root is known, and runs that lead into a cycle
  (their deadline is null for good);
* ``pending`` (run_id, awaits): runs whose walk ended at ``awaits``, a run without a COMPLETE
  row so far; the newest row of a run counts;
* ``waiting`` (awaits, run_id): the same the other way round, to wake runs. The rows of one
  ``awaits`` are read once, by the batch in which it arrives, so none has to be deleted.

A batch looks up the parents of its new runs and the runs that wait for them, reading only the
buckets its keys fall into, resolves the chains among those rows by pointer jumping, and
appends the outcome under its batch id. Nothing reads the stored run log. Tables of later
batch ids are not looked at, so a batch that is replayed finds what it found before and
replaces what it wrote. What a batch needs meanwhile lies in files under ``work``, each removed once it is not needed any more.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import runs as RN
from ..session import STORED, WorkTables, complete_folders, remove_folder

BUCKETS = 16  # of each table; more for larger logs, so that a batch reads a smaller part
TABLES = {"resolved": ("run_id", "run_id {id}, deadline timestamp_ntz"), "pending": ("run_id", "run_id {id}, awaits {id}"),
          "waiting": ("awaits", "awaits {id}, run_id {id}")}


class DeadlineIndex:
    """The index under ``path`` (a shared folder); ``id_type`` is the type of run ids."""

    def __init__(self, path: str, id_type: str = "string", buckets: int = BUCKETS):
        self.path, self.id_type, self.buckets = path.rstrip("/"), id_type, buckets

    def _bucket(self, key):
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def _read(self, spark: SparkSession, name: str, batch_id: int, keys: DataFrame, column: str) -> DataFrame:
        """Rows of a table whose key is among ``keys``.``column``, of earlier batches (``batch_id`` of each row)."""
        key, schema = TABLES[name]
        schema = schema.format(id=self.id_type)
        before = [f for f in complete_folders(spark, f"{self.path}/{name}") if int(f.removeprefix("batch_id=")) < batch_id]
        if not before:
            return spark.createDataFrame([], schema + ", batch_id long")
        touched = [r["b"] for r in keys.select(self._bucket(F.col(column)).alias("b")).distinct().collect()]  # numbers of buckets
        root = f"{self.path}/{name}"
        t = (spark.read.schema(schema + ", batch_id long, bucket int").option("basePath", root)
             .parquet(*[f"{root}/{f}" for f in before]).filter(F.col("bucket").isin(touched)))
        return t.join(keys.select(F.col(column).alias(key)).distinct(), key, "left_semi").drop("bucket")

    def _write(self, rows: DataFrame, name: str, batch_id: int) -> None:
        key = TABLES[name][0]
        (rows.withColumn("bucket", self._bucket(F.col(key))).repartition("bucket").write.options(**STORED).partitionBy("bucket").mode("overwrite")
         .parquet(f"{self.path}/{name}/batch_id={batch_id}"))

    def update(self, done: DataFrame, batch_id: int) -> DataFrame:
        """Take in the COMPLETE rows of a batch (id, run_id, parent_run_id, nominal_end_time); returns (run_id, based_end_time) of
        the parents they name, as known with this batch, to be read before ``release`` and before the next batch."""
        spark = done.sparkSession
        work = WorkTables(spark, f"{self.path}/work")
        first = work.keep(RN.first_per_key(done.select("id", "run_id", "parent_run_id", "nominal_end_time"), "run_id", "id"), "first")
        parents = done.select(F.col("parent_run_id").alias("run_id")).filter(F.col("run_id").isNotNull()).distinct()
        asked = work.keep(first.select("run_id").union(parents).distinct(), "asked")
        resolved = work.keep(self._read(spark, "resolved", batch_id, asked, "run_id").select("run_id", "deadline"), "resolved")
        pending = work.keep(self._read(spark, "pending", batch_id, asked, "run_id").groupBy("run_id")
                            .agg(F.max_by("awaits", "batch_id").alias("awaits")), "pending")
        # a run is new once: later COMPLETE rows of it change nothing
        new = work.keep(first.join(resolved, "run_id", "left_anti").join(pending, "run_id", "left_anti")
                        .select("run_id", "parent_run_id", "nominal_end_time"), "new")
        work.drop("first", "asked")
        woken = self._read(spark, "waiting", batch_id, new, "run_id").select("run_id", F.col("awaits").alias("ptr"))

        # chains among the new and the woken: a pointer ends at a new run, or at what is known of the outside
        known = resolved.select(F.col("run_id").alias("_p"), F.lit(True).alias("_known"), "deadline") \
            .unionByName(pending.select(F.col("run_id").alias("_p"), F.lit(False).alias("_known"), "awaits"), allowMissingColumns=True)
        arrived = new.select(F.col("run_id").alias("_to"))
        x = new.join(known, new["parent_run_id"] == known["_p"], "left").withColumn(
            "ptr", F.when(F.col("_known").isNull(), F.col("parent_run_id")).when(~F.col("_known"), F.col("awaits")))
        x = x.join(arrived, x["ptr"] == arrived["_to"], "left")
        end = lambda deadline, awaits: F.struct(deadline.alias("deadline"), awaits.alias("awaits"))
        none = F.lit(None).cast(self.id_type)
        no_time = F.lit(None).cast("timestamp_ntz")
        nodes = x.select(
            F.col("run_id").alias("node"), "ptr",
            F.when(F.col("parent_run_id").isNull(), end(F.col("nominal_end_time"), none))
             .when(F.col("_known"), end(F.col("deadline"), none)).when(F.col("_to").isNull(), end(no_time, F.col("ptr"))).alias("value"),
            (F.col("parent_run_id").isNull() | F.coalesce("_known", F.lit(False)) | F.col("_to").isNull()).alias("done"))
        nodes = nodes.unionByName(woken.select(F.col("run_id").alias("node"), "ptr", F.lit(None).cast(nodes.schema["value"].dataType).alias("value"),
                                               F.lit(False).alias("done")))
        rounds = count()

        def cut(df: DataFrame) -> tuple[DataFrame, int]:
            k = next(rounds)
            kept = work.keep(df, f"round_{k}")
            work.drop(f"round_{k - 1}")
            return kept, kept.filter(~F.col("done")).count()

        ends = work.keep(RN.resolve_chains(nodes, cut).select(F.col("node").alias("run_id"), "value.deadline", "value.awaits"), "ends")
        work.drop(f"round_{next(rounds) - 1}", "new", "pending")
        still = ends.filter(F.col("awaits").isNotNull())
        self._write(ends.filter(F.col("awaits").isNull()).select("run_id", "deadline"), "resolved", batch_id)
        self._write(still.select("run_id", "awaits"), "pending", batch_id)
        self._write(still.select("awaits", "run_id"), "waiting", batch_id)
        now = ends.filter(F.col("awaits").isNull()).select("run_id", "deadline").unionByName(resolved.join(ends, "run_id", "left_anti"))
        return parents.join(now, "run_id", "left").select("run_id", F.col("deadline").alias("based_end_time"))

    def release(self, spark: SparkSession) -> None:
        """Remove what the newest batch kept for the rows that ``update`` returned."""
        remove_folder(spark, f"{self.path}/work")
