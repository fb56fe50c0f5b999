"""The scheduled pass over several passes and retries, and views that follow their base tables."""

import uuid

from pyspark.sql import functions as F

from assay.operators import events as EV
from assay.operators import passes as PS
from assay.operators import views as V
from assay.plans.q_catalog import _cat
from assay.plans.q_monitor import MON_FIXTURES
from assay.plans.q_catalog import CAT_FIXTURES
from assay.session import scratch_dir
from assay.sources.fixtures import register_fixtures
from assay.sources.tables import read_table
from paths import SF_SMALL


def test_passes_continue_and_retries_change_nothing(spark):
    cat = _cat(spark, SF_SMALL)
    tasks = spark.table("entity_sample_to_dq_rule").select(  # one pending task for each binding
        "id", F.lit("2024-01-31 23:59:00").cast("timestamp_ntz").alias("time"), F.col("id").alias("rule_id"), F.lit(0).alias("state"))
    base = scratch_dir(spark, f"t-pass-{uuid.uuid4().hex}")
    tables = {"ok": lambda name: read_table(spark, SF_SMALL, name)}

    def missing(name):
        if name == "lineitem":
            raise ValueError("source is down")
        return tables["ok"](name)

    def rows(df):
        return sorted(map(str, df.collect()))

    first = PS.run_pass(spark, cat, tasks, missing, base, "2024-02-01T00-00", "2024-02-01 00:00:00")
    log = PS.TransitionLog(f"{base}/transitions")
    events, states = rows(first.events), rows(log.states(tasks))
    again = PS.run_pass(spark, cat, tasks, missing, base, "2024-02-01T00-00", "2024-02-01 00:00:00")
    assert rows(again.events) == events and rows(log.states(tasks)) == states

    state = {r["id"]: r["state"] for r in log.states(tasks).collect()}
    picked = {r["task_id"] for r in again.selected.collect()}
    done = {r["task_id"] for r in again.finished.collect()}
    assert done and done < picked
    assert all(state[t] == (2 if t in done else 1) for t in picked)
    second = PS.run_pass(spark, cat, tasks, tables["ok"], base, "2024-02-01T00-01", "2024-02-01 00:01:00")
    assert {r["task_id"] for r in second.selected.collect()} == picked - done  # what did not finish is picked again
    assert not {r["task_id"] for r in second.finished.collect()} & done
    shredded = EV.shred(EV.parse_events(second.events))
    assert shredded["run_log"].filter("event_type = 'COMPLETE'").count() == second.finished.count()
    assert shredded["assertions"].count() == second.assertions.count()
    # a retry of the first pass after the second still sees what the first one saw
    third = PS.run_pass(spark, cat, tasks, missing, base, "2024-02-01T00-00", "2024-02-01 00:00:00")
    assert rows(third.events) == events


def test_views_show_rows_added_after_registration(spark):
    register_fixtures(spark, SF_SMALL, tuple(dict.fromkeys(MON_FIXTURES + CAT_FIXTURES)))
    V.register_views(spark)
    base = spark.table("run_log")
    before = {name: spark.sql(f"select * from {name}").count() for name in V.VIEWS}
    try:
        row = base.filter("event_type = 'START'").limit(1).withColumn("id", F.lit(-5).cast("long")).withColumn("run_id", F.lit(-1).cast("long")) \
            .withColumn("parent_run_id", F.lit(None).cast("long"))
        base.unionByName(row).createOrReplaceTempView("run_log")
        after = {name: spark.sql(f"select * from {name}").count() for name in V.VIEWS}
        grown = {"run_log_extended", "run_monitor", "run_monitor_draft"}
        assert {n for n in V.VIEWS if after[n] != before[n]} == grown
        assert spark.sql("select state_name from run_monitor_draft where id = -5").first()[0] == "Незавершен"
    finally:
        base.createOrReplaceTempView("run_log")
