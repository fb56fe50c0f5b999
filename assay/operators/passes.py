"""K6 with L3 and A13: one scheduled pass over the pending tasks, safe to repeat.

A pass has an id that sorts after those before it (its planned time). What a task went
through is an append-only log of transitions, one folder a pass and state; a task's state
is the latest one, else that of the queue. A pass looks only at transitions of earlier
passes and writes whole folders of its own, so a pass that is run again after a failure
selects the same tasks and replaces what it left.

Pending tasks (state 0, or 1 from a pass that did not finish them) move to 1; their rules
run once each, fused (``suite.run_rules``); every task whose rule could be run gets a START
event that carries the rule's assertions and a COMPLETE event, as JSON, and moves to 2. A
rule that fails to run leaves its tasks in state 1 for the next pass, without events.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import expressions as X
from ..session import complete_folders
from . import catalog as K
from . import events as EV
from . import suite as S

DATASET = "transaction"
JOB = "check_dq"


class TransitionLog:
    """(task_id, pass_id, state) rows under ``path`` (a shared folder)."""

    def __init__(self, path: str, id_type: str = "long"):
        self.path, self.schema = path.rstrip("/"), f"task_id {id_type}, pass_id string, state int"

    def record(self, task_ids: DataFrame, pass_id: str, state: int) -> None:
        task_ids.select("task_id").distinct().write.mode("overwrite").parquet(f"{self.path}/pass_id={pass_id}/state={state}")

    def read(self, spark: SparkSession, before: str | None = None) -> DataFrame:
        """All transitions, or those of passes ``before`` an id."""
        passes = [f for f in _folders(spark, self.path) if before is None or f.removeprefix("pass_id=") < before]
        done = [f"{self.path}/{p}/{s}" for p in passes for s in complete_folders(spark, f"{self.path}/{p}")]
        if not done:
            return spark.createDataFrame([], self.schema)
        return spark.read.schema(self.schema).option("basePath", self.path).parquet(*done)

    def states(self, tasks: DataFrame, before: str | None = None) -> DataFrame:
        """``tasks`` (id, state, ...) with the state of their latest transition."""
        latest = (self.read(tasks.sparkSession, before).groupBy(F.col("task_id").alias("id"))
                  .agg(F.max(F.struct("pass_id", "state"))["state"].alias("_state")))
        now = F.coalesce("_state", "state").cast(tasks.schema["state"].dataType).alias("state")
        return tasks.join(latest, "id", "left").select(*[now if c == "state" else c for c in tasks.columns])


def _folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders under ``path``; those of passes hold folders, not files."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(s.getPath().getName() for s in fs.listStatus(root) if s.isDirectory()) if fs.exists(root) else []


def check_events(runs: DataFrame, assertions: DataFrame, now: str, producer: str = "DQ tool", job_namespace: str = "dq") -> DataFrame:
    """(offset, value): a START event with its assertions and a COMPLETE event for each of ``runs`` (task_id, run_id, input_ns).
    ``assertions`` (task_id, ...) of a task are those of one rule, a row for each column it checks."""
    said = assertions.groupBy("task_id").agg(F.array_sort(F.collect_list(F.struct(
        "assertion", "column", "msg", F.col("rule_id").cast("string").alias("rule_id"), "state", "success"))).alias("said"))
    at = F.to_timestamp_ntz(F.lit(now))
    dq = F.struct(*EV._facet_base(EV.DQ_FACET_SCHEMA_URL), F.col("said").alias("assertions"))
    dataset = F.struct(F.struct(dq.alias("dataQuality")).alias("facets"), F.struct().alias("inputFacets"), F.lit(DATASET).alias("name"),
                       F.col("input_ns").alias("namespace"))
    nominal = F.struct(*EV._facet_base(EV.FACET_SCHEMA_BASE + "#/definitions/NominalTimeRunFacet"),
                       X.iso_timestamp(F.timestamp_add("MINUTE", F.lit(1), at)).alias("nominalEndTime"),
                       X.iso_timestamp(at).alias("nominalStartTime"))
    e = runs.join(said, "task_id").withColumn("kind", F.explode(F.array(F.lit("START"), F.lit("COMPLETE"))))
    none = F.array().cast("array<string>")
    event = lambda inputs: F.struct(
        X.iso_timestamp(at).alias("eventTime"), F.col("kind").alias("eventType"), inputs.alias("inputs"),
        F.struct(F.struct().alias("facets"), F.lit(JOB).alias("name"), F.lit(job_namespace).alias("namespace")).alias("job"),
        none.alias("outputs"), F.lit(producer).alias("producer"),
        F.struct(F.struct(nominal.alias("nominalTime")).alias("facets"), F.col("run_id").alias("runId")).alias("run"),
        F.lit(EV.RUN_EVENT_SCHEMA_URL).alias("schemaURL"))
    return e.select(X.deterministic_id(F.col("run_id"), F.col("kind")).alias("offset"),
                    F.when(F.col("kind") == "START", F.to_json(event(F.array(dataset)))).otherwise(F.to_json(event(none))).alias("value"))


@dataclass
class Pass:
    """What a pass did: its tasks, assertions, events and the tasks it finished."""
    selected: DataFrame
    assertions: DataFrame
    events: DataFrame
    finished: DataFrame


def run_pass(spark: SparkSession, cat: K.Catalog, tasks: DataFrame, resolve: S.Resolver, base: str, pass_id: str, now: str) -> Pass:
    """One pass over the pending tasks of scheduled rules; everything it makes is written under ``base`` by its id."""
    log = TransitionLog(f"{base}/transitions", tasks.schema["id"].dataType.simpleString())

    def kept(df: DataFrame, name: str) -> DataFrame:
        path = f"{base}/{name}/pass_id={pass_id}"
        df.write.mode("overwrite").parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    rows = K.rule_catalog(cat, "for_schedule", tasks=log.states(tasks, before=pass_id))
    selected = kept(rows.groupBy(F.col("dq_tasks_id").alias("task_id"), "entity_sample_to_dq_rule_id", "rule_ref", "rule_settings").agg(
        F.min(F.coalesce("data_asset_id", "data_asset_id1").cast("string")).alias("input_ns")), "selected")
    log.record(selected, pass_id, 1)
    found = kept(S.run_rules(spark, selected, resolve), "results")
    broken = found.filter(F.col("error").isNotNull()).select("rule_id").distinct()
    of_task = selected.select("task_id", F.col("entity_sample_to_dq_rule_id").alias("rule_id"))
    assertions = kept(of_task.join(found.join(broken, "rule_id", "left_anti"), "rule_id").select(
        "task_id", "rule_id", "assertion", "column", "success", "state", "msg"), "assertions")
    finished = kept(assertions.select("task_id").distinct(), "finished")
    runs = selected.join(finished, "task_id", "left_semi").select(
        "task_id", X.deterministic_uuid(F.lit("run"), F.lit(pass_id), F.col("task_id")).alias("run_id"), "input_ns")
    events = kept(check_events(runs, assertions, now), "events")
    log.record(finished, pass_id, 2)
    return Pass(selected, assertions, events, finished)
