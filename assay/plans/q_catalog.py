"""Queries for the rule catalog."""

from __future__ import annotations

from ..operators import catalog as K
from ..sources.fixtures import duckdb_with, register_fixtures
from .registry import register

CAT_FIXTURES = ("entity_sample_to_dq_rule", "dq_rule", "entity_sample", "entity_query", "entity", "task",
                "system", "domain", "data_asset", "product", "indicator", "system_connection",
                "connector_param", "system_connection_param")

PRODUCT_ID = 3
ASSET_ID = 3


def _cat(spark, sf, extra=()):
    register_fixtures(spark, sf, CAT_FIXTURES + tuple(extra))
    return K.Catalog.from_views(spark)


# Oracles, step by step from the definitions in SURVEY 2.B and 2.C: which bindings are live, where each one's
# query stands, what its connection is given, and last the rows each variant asks for.
_PARAMS_CTE = """, connector_params as (
  select (select any_value(name) from system_connection where id = v.system_connection_id) as connection_name,
         (select any_value(name) from connector_param where id = v.connector_param_id) as param_name,
         v.param_value, v.system_connection_id
  from system_connection_param v)
"""

_LIVE_CTE = """, published as (
  select 'product' as what, id from product where coalesce(state, 'PUBLISHED') = 'PUBLISHED'
  union all select 'indicator', id from indicator where coalesce(state, 'PUBLISHED') = 'PUBLISHED'),
retired as (
  select 'product' as what, id from product where (what, id) not in (select what, id from published)
  union all select 'indicator' as what, id from indicator where (what, id) not in (select what, id from published)),
live as (
  select b.id as binding, b.settings, b.send_mail, b.asset_id, b.product_id, b.indicator_id, b.entity_sample_id,
         f.id as rule_id, f.name as rule_name, f.rule_ref
  from dq_rule f join entity_sample_to_dq_rule b on b.dq_rule_id = f.id
  where f.rule_ref is not null and b.disabled is distinct from true
    and not exists (select 1 from retired x where x.what = 'product' and x.id = b.product_id)
    and not exists (select 1 from retired x where x.what = 'indicator' and x.id = b.indicator_id)),
samples as (
  select smp.id as sample_id, smp.name as sample_name, qry.id as query_id, qry.name as query_name,
         (select any_value(id) from entity where id = qry.entity_id) as entity_id,
         (select any_value(name) from entity where id = qry.entity_id) as entity_name,
         (select any_value(id) from system where id = qry.system_id) as system_id,
         (select any_value(name) from system where id = qry.system_id) as system_name
  from entity_sample smp left join entity_query qry on qry.id = smp.entity_query_id),
placed as (select * from live left join samples on samples.sample_id = live.entity_sample_id)
"""

_GIVEN_CTE = """, given as (
  select system_connection_id as conn,
         max(param_value) filter (param_name = 'jdbc_username') as username,
         max(param_value) filter (param_name = 'jdbc_password') as password,
         max(replace(param_value, 'jdbc:postgresql://', '')) filter (param_name = 'jdbc_url') as url,
         max(param_value) filter (param_name = 'config') as config,
         max(param_value) filter (param_name = 'topic') as topic
  from connector_params group by conn),
spread as (
  select placed.*, w.system_connection_id,
         (select any_value(connector_id) from system_connection where id = w.system_connection_id) as connector_id,
         given.* exclude (conn)
  from placed left join task w on w.query_id = placed.query_id left join given on given.conn = w.system_connection_id)
"""

_COLUMNS = ("system_id, system_name, rule_name, rule_id, rule_ref, settings as rule_settings, connector_id, system_connection_id, "
            "query_name, binding as entity_sample_to_dq_rule_id, entity_name, send_mail")
_JDBC, _KAFKA = ", username, password, url", ", config, topic"

#: what each variant adds to the columns, and which rows of ``spread`` it takes
_VARIANTS = {
    "regular": (_JDBC + ", home.id as data_asset_id", "contains(settings, 'Kafka') = false"),
    "regular_for_schedule": (_JDBC + ", home.id as data_asset_id", "contains(settings, 'crontab')"),
    "for_product": (_JDBC, f"product_id = {PRODUCT_ID}"),
    "for_asset": (_JDBC, f"asset_id in (select id from data_asset where id = {ASSET_ID} and coalesce(state, 'PUBLISHED') = 'PUBLISHED')"),
    "kafka": (_KAFKA, "contains(settings, 'Kafka')"),
    "check": (_KAFKA, "contains(rule_ref, 'check_nominal_time')"),
}
#: the published assets of the query's entity in its system
_HOME = " left join (select id, system_id as at, entity_id as what from data_asset where state = 'PUBLISHED') home on home.at = system_id and home.what = entity_id"

_SCHEDULED = f"""
  select {_COLUMNS}{_JDBC}, own.id as data_asset_id, home.id as data_asset_id1, q.id as dq_tasks_id
  from spread
  join (select id, rule_id as for_binding from dq_tasks where state <> 2) q on q.for_binding = binding
  left join (select id, state from data_asset) own on own.id = asset_id
  left join (select id, state, system_id as at, entity_id as what from data_asset) home on home.at = system_id and home.what = entity_id
  where contains(settings, 'crontab') and 'PUBLISHED' = all (select coalesce(x, 'PUBLISHED') from unnest([own.state, home.state]) u(x))"""


def _catalog_steps(mode: str, tasks: bool = False) -> str:
    """The oracle of a variant up to a CTE named ``cat``; ``tasks``: with the task queue as a CTE."""
    names = [*CAT_FIXTURES, *(["dq_tasks"] if tasks or mode == "for_schedule" else [])]
    if mode == "for_schedule":
        body = _SCHEDULED
    else:
        extra, rows = _VARIANTS[mode]
        body = f"select {_COLUMNS}{extra} from spread{_HOME if 'home' in extra else ''} where {rows}"
    return duckdb_with(*names) + _PARAMS_CTE + _LIVE_CTE + _GIVEN_CTE + f", cat as ({body})\n"


def _oracle(mode: str) -> str:
    return _catalog_steps(mode) + "select * from cat"


@register("cat_regular", _oracle("regular"))
def cat_regular(spark, sf):
    return K.rule_catalog(_cat(spark, sf), "regular")


@register("cat_regular_schedule", _oracle("regular_for_schedule"))
def cat_regular_schedule(spark, sf):
    return K.rule_catalog(_cat(spark, sf), "regular_for_schedule")


@register("cat_schedule", _oracle("for_schedule"))
def cat_schedule(spark, sf):
    cat = _cat(spark, sf, ("dq_tasks",))
    return K.rule_catalog(cat, "for_schedule", tasks=spark.table("dq_tasks"))


@register("cat_product", _oracle("for_product"))
def cat_product(spark, sf):
    return K.rule_catalog(_cat(spark, sf), "for_product", product_id=PRODUCT_ID)


@register("cat_asset", _oracle("for_asset"))
def cat_asset(spark, sf):
    return K.rule_catalog(_cat(spark, sf), "for_asset", asset_id=ASSET_ID)


@register("cat_kafka", _oracle("kafka"))
def cat_kafka(spark, sf):
    return K.rule_catalog(_cat(spark, sf), "kafka")


@register("cat_check", _oracle("check"))
def cat_check(spark, sf):
    return K.rule_catalog(_cat(spark, sf), "check")


@register("cat_params", duckdb_with(*CAT_FIXTURES) + _PARAMS_CTE + "select * from connector_params")
def cat_params(spark, sf):
    return K.connector_params(_cat(spark, sf))


@register("cat_conn_param", duckdb_with(*CAT_FIXTURES) + _PARAMS_CTE + """
, kafka_rules as (select r.id, json_extract_string(r.settings, '$.connection') as connection
                  from entity_sample_to_dq_rule r where r.settings like '%Kafka%')
select k.id, c.param_name, c.param_value from kafka_rules k
join connector_params c on c.connection_name = k.connection and c.param_name in ('topic', 'config')
""")
def cat_conn_param(spark, sf):
    """A8 for every streaming rule: its connection's topic and config."""
    from pyspark.sql import functions as F
    cat = _cat(spark, sf)
    rules = cat["entity_sample_to_dq_rule"].filter(F.col("settings").contains("Kafka")).select(
        "id", F.get_json_object("settings", "$.connection").alias("connection"))
    params = K.connector_params(cat).filter(F.col("param_name").isin("topic", "config"))
    return rules.join(params, rules["connection"] == params["connection_name"], "inner") \
        .select("id", "param_name", "param_value")


@register("cat_tasks_view", duckdb_with(*CAT_FIXTURES) + _LIVE_CTE + """
select binding as id, placed.system_id, system_name, rule_name, rule_id, rule_ref, settings as rule_settings, query_name,
       binding as entity_sample_to_dq_rule_id, entity_name, product.name as product_name, indicator.name as indicator_name,
       own.name as data_asset_name, product.id as product_id, indicator.id as indicator_id, own.id as data_asset_id,
       sample_id as entity_sample_id, sample_name as entity_sample_name,
       coalesce(contains(settings, 'crontab'), false)::int as is_crontab
from placed
left join product on product.id = placed.product_id
left join indicator on indicator.id = placed.indicator_id
left join data_asset own on own.id = placed.asset_id
left join task on task.query_id = placed.query_id
where coalesce(own.state, 'PUBLISHED') = 'PUBLISHED'""")
def cat_tasks_view(spark, sf):
    return K.rule_tasks_view(_cat(spark, sf))
