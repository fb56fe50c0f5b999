"""Queries for the monitoring views."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import monitor as M
from ..operators import runs as RN
from ..sources.fixtures import duckdb_with, register_fixtures
from .q_runs import NAME_CTES
from . import q_catalog, q_runs  # noqa: F401  (their oracles)
from .registry import ORACLE, register

MON_FIXTURES = ("run_log", "assertions", "run_inputs", "run_outputs", "data_asset", "system", "entity", "domain")


def _views(spark, sf, names=MON_FIXTURES):
    register_fixtures(spark, sf, names)
    return {n: spark.table(n) for n in names}


# Oracles from the definitions D8, J6 and H13: what is said of an event reaches the event itself, the event's run, and the
# parent of that run; the worst of what reaches a START event, or its run, is its state.
_REACH = """
, said as (
  select l.id as event, l.run_id as run, l.parent_run_id as parent, a.state, a.msg
  from run_log l join assertions a on a.ol_id = l.id),
reach as (
  select 'event' as level, event as key, state, msg from said
  union all select 'run', run, state, null from said
  union all select 'parent', parent, state, msg from said where parent is not null),
worst as (select level, key, min(state) as state from reach group by level, key),
message as (
  select level, key, case when level = 'event' then state end as of_state, min(msg) as msg
  from reach where msg is not null group by all),
fate as (
  select run_id as run, max((event_type = 'FAIL')::int) = 1 as failed, max((event_type = 'COMPLETE')::int) = 1 as ended
  from run_log group by run_id),
starting as (
  select l.id, l.run_id, l.parent_run_id, l.event_type, l.event_time, l.producer, fate.failed, fate.ended,
         list_min([e.state, p.state]) as state, r.state as state_local
  from run_log l join fate on fate.run = l.run_id
  left join worst e on e.level = 'event' and e.key = l.id
  left join worst p on p.level = 'parent' and p.key = l.run_id
  left join worst r on r.level = 'run' and r.key = l.run_id
  where l.event_type = 'START'),
t as (
  select starting.*, list_min([e.msg, p.msg]) as assertion_msg
  from starting
  left join message e on e.level = 'event' and e.key = starting.id and e.of_state = starting.state
  left join message p on p.level = 'parent' and p.key = starting.run_id)
"""


def _label(state: str) -> str:
    words = "map {'0': 'Ошибка', '1': 'Предупреждение'}"  # fixed values; every other state is a success
    return (f"if(t.failed, 'Ошибка выполнения', if(not t.ended, 'Незавершен', "
            f"coalesce(element_at({words}, coalesce({state}, ''))[1], 'Успешно')))")


_MON_SELECT = f"""
select {_label('t.state')} as state_name, {_label('t.state_local')} as state_name_local, t.assertion_msg, t.state, t.state_local,
       t.id, t.run_id, t.parent_run_id, t.event_type, t.event_time, t.producer, names.full_name
from t left join names on names.run_id = t.run_id
"""

MON_ORACLE = (duckdb_with("run_log", "assertions", "run_inputs", "run_outputs", "data_asset", "system", "entity",
                          recursive=True) + NAME_CTES + _REACH + _MON_SELECT)


def _monitor(spark, sf):
    v = _views(spark, sf)
    names = RN.pipeline_names(v["run_log"], v["run_inputs"], v["run_outputs"], v["data_asset"], v["system"],
                              v["entity"])
    return M.monitor_runs(v["run_log"], v["assertions"], names)


@register("mon_runs", MON_ORACLE)
def mon_runs(spark, sf):
    """J1 (one row per START event) with J4 full names, D8 states, J6 message, H13 labels."""
    return _monitor(spark, sf)


@register("mon_roots", MON_ORACLE + " where t.parent_run_id is null")
def mon_roots(spark, sf):
    """The draft view (root runs only)."""
    return M.monitor_roots(_monitor(spark, sf))


_STATE_ORACLE = duckdb_with("run_log", "assertions") + _REACH + """
select t.id, t.run_id, t.state, t.state_local, t.failed as has_fail, t.ended as has_complete
from t"""


@register("mon_state", _STATE_ORACLE)
def mon_state(spark, sf):
    """D8 + C11 + C12: worst states and run flags, decorrelated."""
    v = _views(spark, sf, ("run_log", "assertions"))
    _, es = M.event_grain(v["run_log"], v["assertions"])
    return M.run_states(es).select("id", "run_id", "state", "state_local", "has_fail", "has_complete")


@register("mon_label", duckdb_with("run_log", "assertions") + _REACH + f"""
select t.id, {_label('t.state')} as state_name, {_label('t.state_local')} as state_name_local from t""")
def mon_label(spark, sf):
    """H13 labels only (no names), decorrelated."""
    v = _views(spark, sf, ("run_log", "assertions"))
    return M.monitor_runs(v["run_log"], v["assertions"]).select("id", "state_name", "state_name_local")


@register("mon_message", duckdb_with("run_log", "assertions") + _REACH + "select t.id, t.assertion_msg from t")
def mon_message(spark, sf):
    """Message of the worst state on the event, or any child message."""
    v = _views(spark, sf, ("run_log", "assertions"))
    return M.monitor_runs(v["run_log"], v["assertions"]).select("id", "assertion_msg")


@register("mon_datasets", duckdb_with("run_log", "run_inputs", "run_outputs", "data_asset", "system", "domain") + """
, ds as (select ol_id, name, ns, 'input' as side from run_inputs
         union all select ol_id, name, ns, 'output' from run_outputs)
select dq.id, dq.run_id, ds.side, ds.name, ds.ns, da.id as asset_id, da.name as asset_name,
       s.id as system_id, s.name as system_name, d.id as domain_id, d.name as domain_name
from run_log dq join ds on ds.ol_id = dq.id
left join data_asset da on cast(da.id as varchar) = lower(ds.ns)
left join system s on s.id = da.system_id
left join domain d on d.id = da.domain_id
where dq.event_type = 'START'""")
def mon_datasets(spark, sf):
    """C9/C10 in long form (one row per dataset, not inputs x outputs)."""
    v = _views(spark, sf, ("run_log", "run_inputs", "run_outputs", "data_asset", "system", "domain"))
    return M.monitor_datasets(v["run_log"], v["run_inputs"], v["run_outputs"], v["data_asset"], v["system"],
                              v["domain"])


@register("mon_assertions", duckdb_with("assertions", "entity_sample_to_dq_rule", "dq_rule", "run_log") + """
, rule_of as (select b.id as binding, f.name from entity_sample_to_dq_rule b left join dq_rule f on b.dq_rule_id = f.id)
select a.id, coalesce(element_at(map {'0': 'Ошибка', '1': 'Предупреждение'}, a.state)[1], 'Успешно') as state_name,
       rule_of.name as rule_name, a."column", a.msg, a.rule_id, a.ol_id, a.assertion, a.state,
       (select any_value(run_id) from run_log where id = a.ol_id) as run_id
from assertions a left join rule_of on rule_of.binding = a.rule_id""")
def mon_assertions(spark, sf):
    """Assertion monitor."""
    v = _views(spark, sf, ("assertions", "entity_sample_to_dq_rule", "dq_rule", "run_log"))
    return M.assertion_monitor(v["assertions"], v["entity_sample_to_dq_rule"], v["dq_rule"], v["run_log"])


def _view(spark, sf, name):
    """One of the SQL views, queried by name."""
    from ..operators import views as V
    from .q_catalog import CAT_FIXTURES
    register_fixtures(spark, sf, tuple(dict.fromkeys(MON_FIXTURES + CAT_FIXTURES)))
    V.register_views(spark)
    return spark.sql(f"select * from {name}")


@register("mon_views_sql", MON_ORACLE + " where t.parent_run_id is null")
def mon_views_sql(spark, sf):
    """J7 + B19: the draft view."""
    return _view(spark, sf, "run_monitor_draft")


@register("view_run_monitor", MON_ORACLE)
def view_run_monitor(spark, sf):
    """J7 + J1."""
    return _view(spark, sf, "run_monitor")


@register("view_assertions_monitor", ORACLE["mon_assertions"])
def view_assertions_monitor(spark, sf):
    """J7 + C8."""
    return _view(spark, sf, "assertions_monitor")


@register("view_run_log_extended", ORACLE["run_extended"])
def view_run_log_extended(spark, sf):
    """J7 + J3, by a recursive query."""
    return _view(spark, sf, "run_log_extended")


@register("view_connector_params", ORACLE["cat_params"])
def view_connector_params(spark, sf):
    """J7 + C3."""
    return _view(spark, sf, "connector_params")


@register("view_rule_tasks", ORACLE["cat_tasks_view"])
def view_rule_tasks(spark, sf):
    """J7 + C7."""
    return _view(spark, sf, "dq_rule_tasks")


@register("mon_state_from_events", _STATE_ORACLE.replace(
    "select t.id, t.run_id,",
    "select t.id, printf('00000000-0000-0000-0000-%012x', t.run_id) as run_id,", 1))
def mon_state_from_events(spark, sf):
    """Event lifecycle: events serialized, shredded, then monitored."""
    from ..operators import events as EV
    from . import q_events
    s = EV.shred(q_events._parsed(spark, sf))
    asr = s["assertions"].filter(F.col("assertion").isNotNull())
    _, es = M.event_grain(s["run_log"], asr)
    return M.run_states(es).select("id", "run_id", "state", "state_local", "has_fail", "has_complete")
