"""The reference's six views as Spark SQL views, evaluated when they are queried.

They are defined by SQL text over the names of the base tables (``run_log``, ``assertions``,
...), so a query sees the rows those names hold at that time. The two walks are recursive
queries from the ends of the chains: deadlines from the roots down, pipeline names from the
last run of a chain up. Both reach each run once and never enter a cycle, so the recursion
ends by itself and its limits are lifted.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..functions import expressions as X

VIEWS: dict[str, str] = {}

VIEWS["connector_params"] = """
select sc.name as connection_name, cp.name as param_name, p.param_value, p.system_connection_id
from system_connection_param p
left join connector_param cp on cp.id = p.connector_param_id
left join system_connection sc on sc.id = p.system_connection_id"""

VIEWS["dq_rule_tasks"] = """
select b.id, s.id as system_id, s.name as system_name, r.name as rule_name, r.id as rule_id, r.rule_ref, b.settings as rule_settings,
       q.name as query_name, b.id as entity_sample_to_dq_rule_id, e.name as entity_name, p.name as product_name, i.name as indicator_name,
       a.name as data_asset_name, p.id as product_id, i.id as indicator_id, a.id as data_asset_id, m.id as entity_sample_id,
       m.name as entity_sample_name, int(coalesce(contains(b.settings, 'crontab'), false)) as is_crontab
from entity_sample_to_dq_rule b
join dq_rule r on r.id = b.dq_rule_id
left join entity_sample m on m.id = b.entity_sample_id
left join entity_query q on q.id = m.entity_query_id
left join entity e on e.id = q.entity_id
left join system s on s.id = q.system_id
left join task t on t.query_id = q.id
left join product p on p.id = b.product_id
left join indicator i on i.id = b.indicator_id
left join data_asset a on a.id = b.asset_id
where r.rule_ref is not null and not coalesce(b.disabled, false) and coalesce(p.state, 'PUBLISHED') = 'PUBLISHED'
  and coalesce(i.state, 'PUBLISHED') = 'PUBLISHED' and coalesce(a.state, 'PUBLISHED') = 'PUBLISHED'"""


def _label(state: str) -> str:
    return f"case {state} when '{X.STATE_ERROR}' then '{X.LABEL_ERROR}' when '{X.STATE_WARNING}' then '{X.LABEL_WARNING}' else '{X.LABEL_OK}' end"


def _run_label(state: str) -> str:
    return (f"case when f.failed then '{X.LABEL_RUN_FAILED}' when not f.ended then '{X.LABEL_RUN_UNFINISHED}' else {_label(state)} end")


VIEWS["assertions_monitor"] = f"""
select a.id, {_label('a.state')} as state_name, r.name as rule_name, a.`column`, a.msg, a.rule_id, a.ol_id, l.run_id, a.assertion, a.state
from assertions a
left join entity_sample_to_dq_rule b on b.id = a.rule_id
left join dq_rule r on r.id = b.dq_rule_id
left join run_log l on l.id = a.ol_id"""

VIEWS["run_log_extended"] = """
with recursive done as (
  select run_id, min_by(struct(parent_run_id as parent, nominal_end_time as end), id) as first from run_log where event_type = 'COMPLETE' group by run_id),
deadline (run_id, based_end_time) as (
  select run_id, first.end from done where first.parent is null
  union all
  select c.run_id, d.based_end_time from deadline d join done c on c.first.parent = d.run_id)
select d.based_end_time, l.* from run_log l left join deadline d on d.run_id = l.parent_run_id"""

VIEWS["run_monitor"] = f"""
with recursive said as (
  select l.id, l.run_id, l.parent_run_id, a.state, min(a.msg) as msg from assertions a join run_log l on l.id = a.ol_id group by all),
own as (select id, min(state) as state, min_by(msg, state) as msg from said group by id),
below as (select parent_run_id as run_id, min(state) as state, min(msg) as msg from said where parent_run_id is not null group by parent_run_id),
whole as (select run_id, min(state) as state from said group by run_id),
worst as (select id, state, msg from said where msg is not null),
fate as (select run_id, bool_or(event_type = 'FAIL') as failed, bool_or(event_type = 'COMPLETE') as ended from run_log group by run_id),
label as (
  select cast(a.id as string) as ns, concat(e.name, coalesce(concat(' (', s.name, ')'), ' ()')) as text
  from data_asset a join entity e on e.id = a.entity_id left join system s on s.id = a.system_id),
head as (
  select l.run_id, min(x.text) as text from run_log l join run_inputs d on d.ol_id = l.id join label x on x.ns = lower(d.ns)
  where l.event_type = 'START' group by l.run_id),
tail as (
  select l.run_id, min(x.text) as text from run_log l join run_outputs d on d.ol_id = l.id join label x on x.ns = lower(d.ns)
  where l.event_type = 'START' and l.producer <> 'DQ tool' group by l.run_id),
step as (
  select parent_run_id as run_id, min(run_id) as child from run_log
  where event_type = 'START' and producer <> 'DQ tool' and parent_run_id is not null group by parent_run_id),
chain (run_id, leaf) as (
  select s.run_id, s.run_id from (select distinct run_id from run_log where event_type = 'START') s left anti join step on step.run_id = s.run_id
  union all
  select step.run_id, chain.leaf from chain join step on step.child = chain.run_id)
select {_run_label('least(own.state, below.state)')} as state_name, {_run_label('whole.state')} as state_name_local,
       least(w.msg, below.msg) as assertion_msg, least(own.state, below.state) as state, whole.state as state_local,
       l.id, l.run_id, l.parent_run_id, l.event_type, l.event_time, l.producer,
       concat(coalesce(head.text, ''), coalesce(concat(' - ', tail.text), '')) as full_name
from run_log l
join fate f on f.run_id = l.run_id
left join own on own.id = l.id
left join below on below.run_id = l.run_id
left join whole on whole.run_id = l.run_id
left join worst w on w.id = l.id and w.state = least(own.state, below.state)
left join chain on chain.run_id = l.run_id
left join head on head.run_id = l.run_id
left join tail on tail.run_id = chain.leaf
where l.event_type = 'START'"""

VIEWS["run_monitor_draft"] = "select * from run_monitor where parent_run_id is null"

#: The recursions end by themselves (see above).
LIMITS = ("spark.sql.cteRecursionLevelLimit", "spark.sql.cteRecursionRowLimit")


def register_views(spark: SparkSession) -> None:
    """Define the views over whatever the base names mean when a view is queried."""
    for limit in LIMITS:
        spark.conf.set(limit, "-1")
    for name, text in VIEWS.items():
        spark.sql(f"create or replace temporary view {name} as {text}")
