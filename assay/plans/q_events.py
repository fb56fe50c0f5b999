"""Queries for run events: serialize, parse, validate, filter, shred."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import events as EV
from ..session import scratch_dir
from ..sources.fixtures import duckdb_with, register_fixtures
from .registry import register

EV_FIXTURES = ("run_log", "assertions", "run_inputs", "run_outputs")

# filters of the event client
FILTERS = [{"type": "exact", "match": "check_dq"}, {"type": "regex", "regex": "etl_[0-2]"}]

_JOB_SQL = "case when producer = 'DQ tool' then 'check_dq' else concat('etl_', cast(run_id % 7 as varchar)) end"


def _job_name():
    return (F.when(F.col("producer") == "DQ tool", F.lit("check_dq"))
            .otherwise(F.concat(F.lit("etl_"), (F.col("run_id") % 7).cast("string"))))


def _events(spark, sf):
    register_fixtures(spark, sf, EV_FIXTURES)
    t = {n: spark.table(n) for n in EV_FIXTURES}
    return EV.build_events(t["run_log"], t["run_inputs"], t["run_outputs"], t["assertions"], _job_name())


def _parsed(spark, sf):
    """The parsed events and their validity, written once for queries that take several shredded tables of them."""
    path = scratch_dir(spark, f"events-parsed-{uuid.uuid4().hex}")
    parsed = EV.parse_events(_events(spark, sf)).drop("value").withColumn("reason", EV.validity_reason(F.col("ev")))
    parsed.write.parquet(path)
    return spark.read.schema(parsed.schema).parquet(path)


def _uuid_sql(x: str) -> str:
    return f"case when {x} is null then null else printf('00000000-0000-0000-0000-%012x', {x}) end"


@register("ev_roundtrip_runs", duckdb_with("run_log") + f"""
select id, event_time, event_type, producer, {_uuid_sql('run_id')} as run_id,
       {_uuid_sql('parent_run_id')} as parent_run_id, nominal_end_time, nominal_start_time
from run_log""")
def ev_roundtrip_runs(spark, sf):
    """shred(build(run log)) = run log (run ids in UUID form)."""
    return EV.shred(EV.parse_events(_events(spark, sf)))["run_log"]


@register("ev_roundtrip_datasets", duckdb_with("run_log", "run_inputs", "run_outputs") + """
select 'input' as side, i.ol_id, i.name, i.ns from run_inputs i where i.ol_id in (select id from run_log)
union all
select 'output', o.ol_id, o.name, o.ns from run_outputs o where o.ol_id in (select id from run_log)""")
def ev_roundtrip_datasets(spark, sf):
    s = EV.shred(_parsed(spark, sf))
    ins = s["inputs"].filter(~((F.col("ns") == EV.CARRIER_NAMESPACE) & (F.col("name") == EV.CARRIER_NAME)))
    return (ins.select(F.lit("input").alias("side"), "ol_id", "name", "ns")
            .unionByName(s["outputs"].select(F.lit("output").alias("side"), "ol_id", "name", "ns")))


@register("ev_roundtrip_assertions", duckdb_with("run_log", "assertions") + """
select a.ol_id, a.assertion, a."column", a.success, a.state, a.msg, cast(a.rule_id as varchar) as rule_id
from assertions a where a.ol_id in (select id from run_log)""")
def ev_roundtrip_assertions(spark, sf):
    return EV.shred(EV.parse_events(_events(spark, sf)))["assertions"].drop("id")


_REASON_SQL = """case id % 101 when 1 then 'no run' when 2 then 'bad eventType' when 3 then 'bad runId'
                 when 4 then 'bad eventTime' when 6 then 'malformed' else null end"""


@register("ev_validate", duckdb_with("run_log") + f"select id as \"offset\", {_REASON_SQL} as reason from run_log")
def ev_validate(spark, sf):
    """B14/B15 over a stream with deterministic bad variants."""
    p = EV.parse_events(EV.corrupt(_events(spark, sf)))
    return p.select("offset", EV.validity_reason(F.col("ev")).alias("reason"))


@register("ev_rejected", duckdb_with("run_log") + f"""
select * from (select id as "offset", {_REASON_SQL} as type from run_log) where type is not null""")
def ev_rejected(spark, sf):
    """Rejected events as exception rows."""
    return EV.rejected(EV.parse_events(EV.corrupt(_events(spark, sf)))).drop("message")


@register("ev_shred_valid_runs", duckdb_with("run_log") + f"""
select id, event_type, {_uuid_sql('run_id')} as run_id from run_log where id % 101 not in (1, 2, 3, 4, 6)""")
def ev_shred_valid_runs(spark, sf):
    """K8 keeps every valid event of a stream with bad rows (fraction-less times included)."""
    s = EV.shred(EV.parse_events(EV.corrupt(_events(spark, sf))))
    return s["run_log"].select("id", "event_type", "run_id")


@register("ev_filter", duckdb_with("run_log") + f"""
select id as "offset", {_JOB_SQL} as job_name from run_log
where not ({_JOB_SQL} = 'check_dq') and not regexp_matches({_JOB_SQL}, '^(?:etl_[0-2])')""")
def ev_filter(spark, sf):
    """Exact and regex job filters, both applied."""
    p = EV.apply_filters(EV.parse_events(_events(spark, sf)), FILTERS)
    return p.select("offset", F.col("ev.job.name").alias("job_name"))


@register("ev_filter_exact", duckdb_with("run_log") + f"""
select id as "offset" from run_log where not ({_JOB_SQL} = 'check_dq')""")
def ev_filter_exact(spark, sf):
    return EV.apply_filters(EV.parse_events(_events(spark, sf)), FILTERS[:1]).select("offset")


@register("ev_filter_regex", duckdb_with("run_log") + f"""
select id as "offset" from run_log where not regexp_matches({_JOB_SQL}, '^(?:etl_[0-2])')""")
def ev_filter_regex(spark, sf):
    return EV.apply_filters(EV.parse_events(_events(spark, sf)), FILTERS[1:]).select("offset")


@register("ev_serialize")
def ev_serialize(spark, sf):
    """The JSON text of each event (sorted keys, nulls dropped); rows-only check."""
    return _events(spark, sf)


ORACLE_RUNS_COUNT = duckdb_with("run_log") + "select event_type, count(*) as n from run_log group by event_type"


@register("ev_shred", duckdb_with("run_log", "run_inputs", "run_outputs", "assertions") + """
select 'run_log' as table_name, count(*) as n from run_log
union all select 'inputs', (select count(*) from run_inputs where ol_id in (select id from run_log))
                           + (select count(distinct ol_id) from assertions where ol_id in (select id from run_log))
union all select 'outputs', count(*) from run_outputs where ol_id in (select id from run_log)
union all select 'assertions', count(*) from assertions where ol_id in (select id from run_log)""")
def ev_shred(spark, sf):
    """K8: rows of the four shredded tables (inputs include each event's assertion carrier)."""
    s = EV.shred(_parsed(spark, sf))
    out = None
    for name in ("run_log", "inputs", "outputs", "assertions"):
        part = s[name].agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table_name"), "n")
        out = part if out is None else out.unionByName(part)
    return out
