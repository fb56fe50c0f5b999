"""Queries for schedules and the task queue."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import catalog as K
from ..operators import schedule as SC
from ..session import scratch_dir
from ..sources.fixtures import CRON_LITERALS, FIXED_NOW, duckdb_with
from .q_catalog import _cat, _catalog_steps
from .q_suite import _suite_oracle
from .registry import register


_cat_body = _catalog_steps


# oracle: bounded candidate times per cron literal, matched field by field
_CRON_MATCH = f"""case cron
  when '{CRON_LITERALS[0]}' then minute(m) % 5 = 0
  when '{CRON_LITERALS[1]}' then minute(m) = 0 and hour(m) = 3
  when '{CRON_LITERALS[2]}' then minute(m) = 30 and hour(m) = 6 and day(m) = 1
  when '{CRON_LITERALS[3]}' then minute(m) = 0 and hour(m) = 0 and dayofweek(m) = 1
  else false end"""

def _cand_sql(src: str) -> str:
    """Bounded candidate fire times after ``t`` for each (cron, t) row of ``src``:
    the next five minutes for the every-5-minutes literal, else the fixed time
    of day on each of the next 33 days (each literal fires within that span)."""
    return f"""select s.*, unnest(generate_series(s.t + interval 1 minute, s.t + interval 5 minute, interval 1 minute)) as m
         from {src} s where s.cron = '{CRON_LITERALS[0]}'
         union all
         select s.*, unnest(generate_series(date_trunc('day', s.t), date_trunc('day', s.t) + interval 32 day, interval 1 day))
                + case s.cron when '{CRON_LITERALS[1]}' then interval 3 hour
                              when '{CRON_LITERALS[2]}' then interval 390 minute else interval 0 minute end as m
         from {src} s where s.cron <> '{CRON_LITERALS[0]}'"""


_DUE_ORACLE = _cat_body("regular_for_schedule", tasks=True) + f"""
, rules as (select distinct entity_sample_to_dq_rule_id as rule_id,
                   json_extract_string(rule_settings, '$.crontab') as cron
            from cat where json_extract_string(rule_settings, '$.crontab') is not null),
last as (select rule_id, max(time) as t from dq_tasks group by rule_id),
rl as (select r.rule_id, r.cron, l.t from rules r join last l on l.rule_id = r.rule_id),
cand as ({_cand_sql('rl')}),
fire as (select rule_id, min(m) as time from cand where m > t and {_CRON_MATCH} group by rule_id)
select rule_id, time from fire where time <= timestamp '{FIXED_NOW}'
union all
select rule_id, timestamp '{FIXED_NOW}' from rules where rule_id not in (select rule_id from last)
"""


def _due(spark, sf):
    cat = _cat(spark, sf, ("dq_tasks",))
    rules = K.rule_catalog(cat, "regular_for_schedule")
    return SC.due_tasks(rules, spark.table("dq_tasks"), FIXED_NOW)


@register("task_due", _DUE_ORACLE)
def task_due(spark, sf):
    """L1: next cron fire per scheduled rule, due by the fixed now."""
    return _due(spark, sf).select("rule_id", "time")


_DUE_STEPS, _DUE_ROWS = _DUE_ORACLE.split("\nselect rule_id, time from fire", 1)


@register("task_due_rows", _DUE_STEPS + ", due as (select rule_id, time from fire" + _DUE_ROWS + """)
select sha256(concat_ws(':', cast(rule_id as varchar), cast(time as varchar))) as id, time, rule_id, 0 as state from due""")
def task_due_rows(spark, sf):
    """The task rows to append, with deterministic ids."""
    return _due(spark, sf)


_NEXT_ORACLE = duckdb_with("dq_tasks") + f"""
, crons as (select unnest(['{CRON_LITERALS[0]}', '{CRON_LITERALS[1]}', '{CRON_LITERALS[2]}', '{CRON_LITERALS[3]}']) as cron),
pts as (select distinct time as t from dq_tasks),
ct as (select c.cron, p.t from crons c, pts p),
cand as ({_cand_sql('ct')})
select cron, t, min(m) as next_time from cand where m > t and {_CRON_MATCH} group by cron, t
"""


@register("task_next_fire", _NEXT_ORACLE)
def task_next_fire(spark, sf):
    """Cron compile + next fire after every distinct task time, for each cron literal."""
    from ..sources.fixtures import register_fixtures
    register_fixtures(spark, sf, ("dq_tasks",))
    pts = spark.table("dq_tasks").select(F.col("time").alias("t")).distinct()
    crons = pts.select(F.explode(F.array(*[F.lit(c) for c in CRON_LITERALS])).alias("cron"), "t")
    return SC.with_next_fire(crons, F.col("cron"), F.col("t"), "next_time")


@register("task_latest", duckdb_with("dq_tasks") + """
select rule_id, arg_max(id, (time, id)) as id, max(time) as time, arg_max(state, (time, id)) as state
from dq_tasks group by rule_id""")
def task_latest(spark, sf):
    """Newest task per rule."""
    from ..sources.fixtures import register_fixtures
    register_fixtures(spark, sf, ("dq_tasks",))
    return SC.latest_task(spark.table("dq_tasks"))


@register("task_upsert", _cat_body("for_schedule") + """
select t.id, t.time, t.rule_id,
       case when t.id in (select dq_tasks_id from cat) then 2 else t.state end as state
from dq_tasks t""")
def task_upsert(spark, sf):
    """Tasks selected for running (L3) are marked done in the queue."""
    cat = _cat(spark, sf, ("dq_tasks",))
    tasks = spark.table("dq_tasks")
    selected = K.rule_catalog(cat, "for_schedule", tasks=tasks)
    return SC.set_task_state(tasks, selected.select(F.col("dq_tasks_id").alias("id")), 2)


@register("task_upsert_partitions", _cat_body("for_schedule") + """
, done as (select distinct dq_tasks_id as id from cat),
parts as (select distinct rule_id % 256 as part from dq_tasks where id in (select id from done))
select id, time, rule_id, case when id in (select id from done) then 2 else state end as state,
       rule_id % 256 in (select part from parts) as rewritten
from dq_tasks""")
def task_upsert_partitions(spark, sf):
    """A12 in place: the queue in 256 buckets of rules; only buckets with a task that ran get new files."""
    cat = _cat(spark, sf, ("dq_tasks",))
    path = scratch_dir(spark, f"task-queue-{uuid.uuid4().hex}")
    tasks = spark.table("dq_tasks").withColumn("part", F.col("rule_id") % 256)
    tasks.repartition("part").write.partitionBy("part").parquet(path)
    files = scratch_dir(spark, f"task-queue-files-{uuid.uuid4().hex}")
    spark.read.parquet(path).select(F.col("_metadata.file_name").alias("_file")).distinct().write.parquet(files)
    ran = K.rule_catalog(cat, "for_schedule", tasks=spark.table("dq_tasks")).select(F.col("dq_tasks_id").alias("id")).distinct()
    SC.upsert_partitions(path, tasks.join(ran, "id", "left_semi").withColumn("state", F.lit(2)), ["id"], "part")
    after = spark.read.parquet(path).withColumn("_file", F.col("_metadata.file_name"))
    return after.join(spark.read.parquet(files).withColumn("_old", F.lit(True)), "_file", "left").select(
        "id", "time", "rule_id", "state", F.col("_old").isNull().alias("rewritten"))


@register("task_run_events", _cat_body("for_schedule") + f"""
, base as (select distinct dq_tasks_id as task_id, coalesce(data_asset_id, data_asset_id1) as ns from cat)
select task_id,
       regexp_replace(substr(sha256(concat_ws(':', 'run', cast(task_id as varchar))), 1, 32),
                      '^(.{{8}})(.{{4}})(.{{4}})(.{{4}})(.{{12}})$', '\\1-\\2-\\3-\\4-\\5') as run_id, e.event_type,
       timestamp '{FIXED_NOW}' as nominal_start_time, timestamp '{FIXED_NOW}' + interval 1 minute as nominal_end_time,
       case when e.event_type = 'START' then cast(ns as varchar) end as input_ns
from base, (select unnest(['START', 'COMPLETE']) as event_type) e""")
def task_run_events(spark, sf):
    """L3 + K6: pending tasks with their rules, each as a START and a COMPLETE event."""
    cat = _cat(spark, sf, ("dq_tasks",))
    selected = K.rule_catalog(cat, "for_schedule", tasks=spark.table("dq_tasks"))
    return SC.scheduled_run_events(selected, FIXED_NOW)


@register("task_mark_running", _cat_body("for_schedule") + """
select t.id, t.time, t.rule_id,
       case when t.id in (select dq_tasks_id from cat) then 1 else t.state end as state,
       case when t.id in (select dq_tasks_id from cat) then 1 else 0 end as attempts
from dq_tasks t""")
def task_mark_running(spark, sf):
    """Tasks picked for a pass move to running and count an attempt."""
    cat = _cat(spark, sf, ("dq_tasks",))
    tasks = spark.table("dq_tasks")
    selected = K.rule_catalog(cat, "for_schedule", tasks=tasks)
    return SC.set_task_state(tasks, selected.select(F.col("dq_tasks_id").alias("id")), 1)


PASS_ID = "2024-02-01T00-00"


def _pass(spark, sf):
    """The scheduled pass, run, then run again as after a failure; the pass and the folder of its log."""
    import uuid
    from ..operators import passes as PS
    from ..session import scratch_dir
    from ..sources.tables import read_table
    cat = _cat(spark, sf, ("dq_tasks",))
    base = scratch_dir(spark, f"pass-{uuid.uuid4().hex}")
    for _ in range(2):
        done = PS.run_pass(spark, cat, spark.table("dq_tasks"), lambda name: read_table(spark, sf, name), base, PASS_ID, FIXED_NOW)
    return done, PS.TransitionLog(f"{base}/transitions")


_PASS_SQL = _suite_oracle(f"""
, picked as (select dq_tasks_id as task_id, entity_sample_to_dq_rule_id as rule_id, min(cast(coalesce(data_asset_id, data_asset_id1) as varchar)) as ns
             from cat group by all),
runs as (select distinct task_id, ns, regexp_replace(substr(sha256(concat_ws(':', 'run', '{PASS_ID}', cast(task_id as varchar))), 1, 32),
                                                     '^(.{{8}})(.{{4}})(.{{4}})(.{{4}})(.{{12}})$', '\\1-\\2-\\3-\\4-\\5') as run_id
         from picked join res using (rule_id))
""", mode="for_schedule")


@register("task_pass", _PASS_SQL + f"""
select r.run_id, 'START' as event_type, timestamp '{FIXED_NOW}' as event_time, timestamp '{FIXED_NOW}' + interval 1 minute as nominal_end_time,
       r.ns, s.assertion, s."column", s.success, s.state, s.msg, cast(p.rule_id as varchar) as rule_id
from runs r join picked p using (task_id) join res s on s.rule_id = p.rule_id
union all
select run_id, 'COMPLETE', timestamp '{FIXED_NOW}', timestamp '{FIXED_NOW}' + interval 1 minute, null, null, null, null, null, null, null from runs""")
def task_pass(spark, sf):
    """K6: the JSON events of a scheduled pass, shredded back: each START with the assertions of its task, each COMPLETE without."""
    from ..operators import events as EV
    done, _ = _pass(spark, sf)
    s = EV.shred(EV.parse_events(done.events))
    ns = s["inputs"].select("ol_id", "ns")
    said = s["assertions"].select("ol_id", "assertion", "column", "success", "state", "msg", "rule_id")
    return (s["run_log"].select(F.col("id").alias("ol_id"), "run_id", "event_type", "event_time", "nominal_end_time")
            .join(ns, "ol_id", "left").join(said, "ol_id", "left").drop("ol_id"))


@register("task_pass_states", _PASS_SQL + """
select t.id, t.time, t.rule_id, case when t.id in (select task_id from runs) then 2 when t.id in (select task_id from picked) then 1 else t.state end as state
from dq_tasks t""")
def task_pass_states(spark, sf):
    """The queue after the pass: finished tasks are done, those whose rule could not be run stay running."""
    _, log = _pass(spark, sf)
    return log.states(spark.table("dq_tasks"))
