"""Queries for run-tree recursion, timeliness and run boundaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import runs as RN
from ..sources.fixtures import duckdb_with, register_fixtures
from .registry import register

RUN_FIXTURES = ("run_log", "assertions", "run_inputs", "run_outputs", "data_asset", "system", "entity",
                "domain", "entity_sample_to_dq_rule", "dq_rule")


def _views(spark, sf, names=RUN_FIXTURES):
    register_fixtures(spark, sf, names)
    return {n: spark.table(n) for n in names}


# recursive oracle pieces (DuckDB), written in the reference's walk order
DEADLINE_CTES = """
, comp as (select run_id, arg_min(parent_run_id, id) as parent_run_id, arg_min(nominal_end_time, id) as net,
                  count(*) as n_complete
           from run_log where event_type = 'COMPLETE' group by run_id),
walk as (select run_id as origin, run_id as cur, parent_run_id as parent, net, 0 as depth from comp
         union all
         select w.origin, c.run_id, c.parent_run_id, c.net, w.depth + 1
         from walk w join comp c on c.run_id = w.parent),
last_step as (select w.origin, w.parent, w.net from walk w
              join (select origin, max(depth) as d from walk group by origin) m
              on m.origin = w.origin and m.d = w.depth),
deadline as (select origin as run_id, case when parent is null then net end as based_end_time from last_step)
"""

LEAF_CTES = """
, nxt as (select parent_run_id as run_id, min(run_id) as child from run_log
          where event_type = 'START' and parent_run_id is not null and producer <> 'DQ tool'
          group by parent_run_id),
lwalk as (select run_id as origin, run_id as cur, 0 as depth
          from (select distinct run_id from run_log where event_type = 'START')
          union all
          select w.origin, n.child, w.depth + 1 from lwalk w join nxt n on n.run_id = w.cur),
leaf as (select w.origin as run_id, w.cur as leaf_run_id from lwalk w
         join (select origin, max(depth) as d from lwalk group by origin) m on m.origin = w.origin and m.d = w.depth)
"""

NAME_CTES = LEAF_CTES + """,
starts as (select id, run_id, producer from run_log where event_type = 'START'),
in_lab as (select st.run_id, min(concat(e.name, ' (', s.name, ')')) as in_label
           from starts st join run_inputs i on i.ol_id = st.id
           join data_asset da on cast(da.id as varchar) = lower(i.ns)
           left join system s on s.id = da.system_id
           join entity e on e.id = da.entity_id
           group by st.run_id),
out_lab as (select st.run_id, min(concat(e.name, ' (', s.name, ')')) as out_label
            from starts st join run_outputs o on o.ol_id = st.id
            join data_asset da on cast(da.id as varchar) = lower(o.ns)
            left join system s on s.id = da.system_id
            join entity e on e.id = da.entity_id
            where st.producer <> 'DQ tool'
            group by st.run_id),
names as (select l.run_id,
                 case when ol.out_label is null then coalesce(il.in_label, '')
                      else concat(coalesce(il.in_label, ''), ' - ', ol.out_label) end as full_name
          from leaf l left join in_lab il on il.run_id = l.run_id left join out_lab ol on ol.run_id = l.leaf_run_id)
"""


@register("run_deadline", duckdb_with("run_log", recursive=True) + DEADLINE_CTES +
          "select run_id, based_end_time from deadline")
def run_deadline(spark, sf):
    v = _views(spark, sf, ("run_log",))
    return RN.inherited_deadline(v["run_log"])


#: chains of 200 runs: each order's parent is the one before it, but for every 200th
_DEEP = """with deep as (
  select o_orderkey * 4 as id, o_orderkey as run_id,
         case when o_orderkey % 200 = 0 then null else o_orderkey - 1 end as parent_run_id,
         'COMPLETE' as event_type, o_orderdate as event_time,
         case when o_orderkey % 200 = 0 then o_orderdate end as nominal_end_time
  from orders)
"""
_DEEP_ORACLE = _DEEP + """
select d.run_id, r.event_time as based_end_time from deep d
left join deep r on r.run_id = d.run_id - d.run_id % 200"""


def _deep(spark, sf):
    register_fixtures(spark, sf, ("run_log",))
    return spark.sql(_DEEP + "select * from deep")


@register("run_deadline_deep", _DEEP_ORACLE)
def run_deadline_deep(spark, sf):
    """J2 over chains of 200 runs, by pointer jumping."""
    return RN.inherited_deadline(_deep(spark, sf))


@register("run_deadline_deep_for", _DEEP_ORACLE)
def run_deadline_deep_for(spark, sf):
    """J2 over chains of 200 runs as the streaming consumer walks them."""
    log = _deep(spark, sf)
    return RN.deadlines_for(log, log.select("run_id"))


@register("run_extended", duckdb_with("run_log", recursive=True) + DEADLINE_CTES + """
select d.based_end_time, r.* from run_log r left join deadline d on d.run_id = r.parent_run_id""")
def run_extended(spark, sf):
    v = _views(spark, sf, ("run_log",))
    return RN.run_log_extended(v["run_log"])


@register("run_timeliness", duckdb_with("run_log", recursive=True) + DEADLINE_CTES + """
select r.id as ol_id, 'time_expired' as assertion, cast(null as varchar) as "column",
       not (d.based_end_time < r.event_time) as success,
       case when d.based_end_time < r.event_time then '0' else '2' end as state,
       case when d.based_end_time < r.event_time
            then concat('Превышено время выполнения на ',
                        cast(cast(epoch_us(r.event_time) - epoch_us(d.based_end_time) as double) / 1e6 as varchar),
                        ' секунд')
            else '' end as msg,
       '389df21d-5294-4cd5-ad61-63b62ee07b54' as rule_id
from run_log r join deadline d on d.run_id = r.parent_run_id
where r.event_type = 'COMPLETE' and d.based_end_time is not null""")
def run_timeliness(spark, sf):
    v = _views(spark, sf, ("run_log",))
    return RN.timeliness_assertions(v["run_log"])


@register("run_leaf", duckdb_with("run_log", recursive=True) + LEAF_CTES + "select run_id, leaf_run_id from leaf")
def run_leaf(spark, sf):
    v = _views(spark, sf, ("run_log",))
    return RN.chain_leaf(v["run_log"])


@register("run_pipeline_name", duckdb_with("run_log", "run_inputs", "run_outputs", "data_asset", "system",
                                           "entity", recursive=True) + NAME_CTES +
          "select run_id, full_name from names")
def run_pipeline_name(spark, sf):
    v = _views(spark, sf, ("run_log", "run_inputs", "run_outputs", "data_asset", "system", "entity"))
    return RN.pipeline_names(v["run_log"], v["run_inputs"], v["run_outputs"], v["data_asset"], v["system"],
                             v["entity"])


@register("run_root_system", duckdb_with("run_log", "run_inputs", "data_asset", "system") + """
, st as (select id, run_id, parent_run_id from run_log where event_type = 'START'),
named as (select i.ol_id, min(s.name) as sname from run_inputs i
          join data_asset da on cast(da.id as varchar) = lower(i.ns) join system s on s.id = da.system_id
          group by i.ol_id)
select st.run_id, min(case when st.parent_run_id is null then n.sname end) as system_producer
from st left join named n on n.ol_id = st.id group by st.run_id""")
def run_root_system(spark, sf):
    v = _views(spark, sf, ("run_log", "run_inputs", "data_asset", "system"))
    return RN.root_system_names(v["run_log"], v["run_inputs"], v["data_asset"], v["system"])


ISLAND_ORACLE = duckdb_with("messages") + """
, f as (select msg_key, run_id,
               case when lag(run_id) over (order by msg_key) is distinct from run_id then 1 else 0 end as s
        from messages),
i as (select *, cast(sum(s) over (order by msg_key rows between unbounded preceding and current row) as bigint) as island from f)
"""


def _islands(spark, sf, bucket_rows=1 << 20):
    v = _views(spark, sf, ("messages",))
    return RN.run_islands(v["messages"].select("msg_key", "run_id"), "msg_key", "run_id", bucket_rows)


@register("run_islands", ISLAND_ORACLE + """
select island, min(run_id) as run_id, min(msg_key) as first_key, max(msg_key) as last_key, count(*) as n_messages
from i group by island""")
def run_islands(spark, sf):
    isl = _islands(spark, sf)
    return isl.groupBy("island").agg(F.min("run_id").alias("run_id"), F.min("msg_key").alias("first_key"),
                                      F.max("msg_key").alias("last_key"), F.count(F.lit(1)).alias("n_messages"))


@register("run_islands_small_ranges", ISLAND_ORACLE + """
select island, min(run_id) as run_id, min(msg_key) as first_key, max(msg_key) as last_key, count(*) as n_messages
from i group by island""")
def run_islands_small_ranges(spark, sf):
    """Same as run_islands with 64-row key ranges: exercises range seams."""
    isl = _islands(spark, sf, bucket_rows=64)
    return isl.groupBy("island").agg(F.min("run_id").alias("run_id"), F.min("msg_key").alias("first_key"),
                                      F.max("msg_key").alias("last_key"), F.count(F.lit(1)).alias("n_messages"))


@register("run_events_from_islands", ISLAND_ORACLE + """
select island, run_id as parent_run_id, msg_key, case when s = 1 then 'START' else 'RUNNING' end as event_type,
       0 as seq from i
union all
select island, min(run_id), max(msg_key), 'COMPLETE', 1 from i group by island""")
def run_events_from_islands(spark, sf):
    return RN.events_from_islands(_islands(spark, sf), "msg_key", "run_id")


@register("run_events_assertions", ISLAND_ORACLE + """
, ev as (select island, run_id as parent_run_id, msg_key, case when s = 1 then 'START' else 'RUNNING' end as event_type
         from i),
ok as (select msg_key, value from messages where json_valid(value)),
a as (select msg_key, count(*) filter (where not json_exists(value, '$.' || f)) as n_failed,
             min(case when json_exists(value, '$.' || f) then '2' else '0' end) as state
      from ok, (select unnest(['value', 'props', 'z']) as f) fl group by msg_key)
select ev.island, ev.parent_run_id, ev.msg_key, ev.event_type, a.n_failed, a.state
from ev left join a on a.msg_key = ev.msg_key""")
def run_events_assertions(spark, sf):
    """I1 + I4 + K5: each START / RUNNING event of the check run carries the
    worst state and failure count of its message's presence assertions
    (malformed messages carry none)."""
    from ..operators import records as R
    from . import q_checks
    isl = _islands(spark, sf)
    ev = RN.events_from_islands(isl, "msg_key", "run_id").filter(F.col("event_type") != "COMPLETE")
    valid, _ = R.split_valid(q_checks._messages(spark, sf))
    a = (R.presence_assertions(valid, q_checks.PRESENCE_FIELDS, key_col=F.col("_m")["key"].cast("long"),
                               keep=("msg_key",))
         .groupBy("msg_key").agg(F.count_if(~F.col("success")).alias("n_failed"), F.min("state").alias("state")))
    return ev.join(a, "msg_key", "left").select("island", "parent_run_id", "msg_key", "event_type", "n_failed",
                                               "state")


#: Messages dealt over this many source partitions; a message that cannot be read names no run.
SOURCE_PARTITIONS = 4

BOUNDARY_ORACLE = duckdb_with("messages") + f"""
, said as (select msg_key % {SOURCE_PARTITIONS} as source_partition, msg_key, if(json_valid(value), run_id, null) as run from messages),
f as (select *, lag(run) over w as prev_run, lag(msg_key) over w as prev_key from said window w as (partition by source_partition order by msg_key)),
b as (select *, run is not null and (prev_run is null or prev_run <> run) as fresh from f),
i as (select *, cast(sum(fresh::int) over (partition by source_partition order by msg_key) as bigint) as island from b)
select source_partition, island, run as parent_run_id, msg_key, if(fresh, 'START', 'RUNNING') as event_type, 0 as seq from i where run is not null
union all select source_partition, island, prev_run, msg_key, 'FAIL', 0 from i where run is null and prev_run is not null
union all select source_partition, island - 1, prev_run, prev_key, 'COMPLETE', 1 from i where fresh and prev_run is not null"""


def partitioned_messages(spark, sf):
    """(source_partition, msg_key, run_id): the run that each message names, null if it cannot be read."""
    from ..operators import records as R
    m = _views(spark, sf, ("messages",))["messages"]
    return m.select((F.col("msg_key") % SOURCE_PARTITIONS).cast("int").alias("source_partition"), "msg_key",
                    R.parse_message(F.col("value"))["run_id"].try_cast("long").alias("run_id"))


@register("run_boundaries", BOUNDARY_ORACLE)
def run_boundaries(spark, sf):
    """I4 in batch, with runs ended by unreadable messages; 64-key ranges exercise the seams."""
    return RN.boundary_events(partitioned_messages(spark, sf), "msg_key", "run_id", 64, ("source_partition",))
