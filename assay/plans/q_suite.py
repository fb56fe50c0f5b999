"""Queries for running catalog rules in batch."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import catalog as K
from ..operators import suite as S
from ..sources.tables import read_table
from .q_catalog import _cat, _catalog_steps
from .registry import register

RUN_TIME = "2024-02-01 00:00:00"


def _suite(spark, sf):
    cat = K.rule_catalog(_cat(spark, sf), "regular")
    return S.run_rules(spark, cat, lambda name: read_table(spark, sf, name)), cat


def _uniq(table, col, pos):
    return f"""
    select 'check_uniqueness' as rule_ref, 'table' as kind, '{table}' as src, {pos} as pos,
           'check_uniqueness' as assertion, '{col}' as "column", n is null as success,
           case when n is null then '2' else '0' end as state,
           case when n is null then '' else concat('Значение "', v, '" повторяется ', cast(c as varchar),
                ' раз(а) в колонке {col};') end as msg, coalesce(n, 0) as n_bad
    from (select 1 as one) k left join (
      select count(*) as n, min(value) as v, arg_min(cnt, value) as c
      from (select cast({col} as varchar) as value, count(*) as cnt from {table}
            where {col} is not null group by {col} having count(*) > 1)
      having count(*) > 0) g on true"""


def _nulls(table, col, pos):
    return f"""
    select 'check_null_values', 'table', '{table}', {pos}, 'check_null_values', '{col}', n = 0,
           case when n = 0 then '2' else '0' end,
           case when n = 0 then '' else concat('В колонке {col} ', cast(n as varchar), ' пустых значений;') end, n
    from (select count(*) filter (where {col} is null) as n from {table})"""


def _range(table, col, rng, pred, pos):
    q = rng.replace("'", "''")
    return f"""
    select 'check_range', 'range', '{table}', {pos}, 'check_range', '{col}', n = 0,
           case when n = 0 then '2' else '0' end,
           case when n = 0 then '' else concat('В колонке {col} ', cast(n as varchar), ' значений вне диапазона {q};') end, n
    from (select count(*) filter (where not ({pred})) as n from {table})"""


_CHECKS = " union all ".join([
    _uniq("orders", "o_orderkey", 0), _uniq("orders", "o_custkey", 1),
    _uniq("lineitem", "l_returnflag", 0), _uniq("lineitem", "l_quantity", 1),
    _nulls("orders", "o_orderkey", 0), _nulls("orders", "o_custkey", 1),
    _nulls("lineitem", "l_returnflag", 0), _nulls("lineitem", "l_quantity", 1),
    _range("lineitem", "l_returnflag", "('A','N')", "l_returnflag in ('A','N')", 0),
    _range("lineitem", "l_quantity", "between 1 and 40", "l_quantity between 1 and 40", 1),
    """select 'count_equal', 'file', 'lineitem', 0, 'count_equal', '*', n = 60000,
              case when n = 60000 then '2' else '0' end,
              case when n = 60000 then 'В файле lineitem к-во записей  равно 60000'
                   else 'В файле lineitem к-во записей не равно 60000' end, n
       from (select count(*) as n from lineitem)""",
])

def _suite_oracle(tail: str, mode: str = "regular") -> str:
    # the catalog of ``mode`` as a CTE, then bindings joined to the expected check rows
    return _catalog_steps(mode) + f""",
b as (select distinct entity_sample_to_dq_rule_id as rule_id, rule_ref, rule_settings from cat
      where length(coalesce(rule_settings, '')) > 0),
k as ({_CHECKS}),
res as (
  select b.rule_id, b.rule_ref, b.rule_settings, k.pos, k.assertion, k."column", k.success, k.state, k.msg, k.n_bad
  from b join k on k.rule_ref = b.rule_ref and (
    (k.kind = 'table' and json_extract_string(b.rule_settings, '$.table') = k.src
       and json_extract_string(b.rule_settings, '$.columns') is not null)
    or (k.kind = 'range' and json_extract_string(b.rule_settings, '$.table') = k.src
       and json_extract_string(b.rule_settings, '$.columns') is not null
       and json_extract_string(b.rule_settings, '$.ranges') is not null)
    or (k.kind = 'file' and json_extract_string(b.rule_settings, '$.path') = k.src
       and json_extract_string(b.rule_settings, '$.count') is not null)))
""" + tail


@register("suite_fused", _suite_oracle(
    'select rule_id, assertion, "column", success, state, msg, n_bad from res'))
def suite_fused(spark, sf):
    """K1: every eligible rule of the regular catalog, fused per table."""
    res, _ = _suite(spark, sf)
    return res.select("rule_id", "assertion", "column", "success", "state", "msg", "n_bad")


#: Broken copies of the catalog's rules: a value that cannot be compared, an unknown column, a count that is no number.
_BROKEN = (("check_range", "lineitem", 10**12, '{"table":"lineitem","columns":"l_returnflag;l_quantity","ranges":"> 5;between 1 and 40"}'),
           ("check_null_values", "orders", 2 * 10**12, '{"table":"orders","columns":"o_nope;o_custkey"}'),
           ("count_equal", "lineitem", 3 * 10**12, '{"path":"lineitem","count":"many"}'))


@register("suite_isolated", _suite_oracle("""
, sound as (select distinct b.rule_id, b.rule_ref from b join res using (rule_id, rule_ref, rule_settings)
            where (b.rule_ref, coalesce(json_extract_string(b.rule_settings, '$.table'), json_extract_string(b.rule_settings, '$.path')))
                  in (('check_range', 'lineitem'), ('check_null_values', 'orders'), ('count_equal', 'lineitem')))
select rule_id, assertion, "column", success, state, n_bad, false as broken from res
union all select s.rule_id + 1000000000000, 'check_range', 'l_returnflag', false, '0', 0, true from sound s where s.rule_ref = 'check_range'
union all select s.rule_id + 1000000000000, 'check_range', 'l_quantity', k.success, k.state, k.n_bad, false
          from sound s join k on k.assertion = 'check_range' and k."column" = 'l_quantity' where s.rule_ref = 'check_range'
union all select s.rule_id + 2000000000000, 'check_null_values', null, false, '0', null, true from sound s where s.rule_ref = 'check_null_values'
union all select s.rule_id + 3000000000000, 'count_equal', null, false, '0', null, true from sound s where s.rule_ref = 'count_equal'"""))
def suite_isolated(spark, sf):
    """K1 beside broken rules: those fail with their error, every other assertion stays as it is."""
    rules = K.rule_catalog(_cat(spark, sf), "regular").select("entity_sample_to_dq_rule_id", "rule_ref", "rule_settings").distinct()
    sound = S.eligible(rules).checkpoint(eager=True)
    table = F.coalesce(F.get_json_object("rule_settings", "$.table"), F.get_json_object("rule_settings", "$.path"))
    broken = [sound.filter((F.col("rule_ref") == kind) & (table == name)).select(
        (F.col("entity_sample_to_dq_rule_id") + F.lit(shift)).alias("entity_sample_to_dq_rule_id"), "rule_ref",
        F.lit(settings).alias("rule_settings")) for kind, name, shift, settings in _BROKEN]
    res = S.run_rules(spark, reduce(DataFrame.unionByName, [sound, *broken]), lambda name: read_table(spark, sf, name))
    return res.select("rule_id", "assertion", "column", "success", "state", "n_bad", F.col("error").isNotNull().alias("broken"))


@register("suite_dq_log", _suite_oracle(f"""
, agg as (select rule_id, rule_ref, rule_settings, bool_and(success) as ok,
                 string_agg(msg, '' order by pos) as findings
          from res group by rule_id, rule_ref, rule_settings)
select timestamp '{RUN_TIME}' as date, case when ok then 1 else 0 end as status,
       case when ok then (case rule_ref
              when 'check_uniqueness' then concat('Ошибок нет. Колонки ', json_extract_string(rule_settings, '$.columns'), ' не содержат дубликаты.')
              when 'check_null_values' then concat('Ошибок нет. Колонки ', json_extract_string(rule_settings, '$.columns'), ' не пустые.')
              when 'check_range' then concat('Ошибок нет. Колонки ', json_extract_string(rule_settings, '$.columns'), ' не содержат ошибок.')
              else findings end)
            else (case rule_ref
              when 'check_uniqueness' then concat('В таблице ', json_extract_string(rule_settings, '$.table'), ' найдены дубликаты: ', findings)
              when 'check_null_values' then concat('В таблице ', json_extract_string(rule_settings, '$.table'), ' найдены пустые значения: ', findings)
              when 'check_range' then concat('В таблице ', json_extract_string(rule_settings, '$.table'), ' найдены записи вне диапазона: ', findings)
              else findings end) end as description,
       cast(rule_id as varchar) as rule_id, cast(null as varchar) as tenant
from agg"""))
def suite_dq_log(spark, sf):
    """A9 + D12: one log row per rule run with the rolled-up description."""
    res, _ = _suite(spark, sf)
    return S.dq_log(res, RUN_TIME)


@register("suite_alerts", _suite_oracle("""
, agg as (select rule_id, bool_and(success) as ok from res group by rule_id, rule_ref, rule_settings),
mail as (select distinct entity_sample_to_dq_rule_id as rule_id, send_mail from cat)
select cast(a.rule_id as varchar) as rule_id, count(*) as n_failed_runs
from agg a join mail m on m.rule_id = a.rule_id where not a.ok and m.send_mail group by a.rule_id"""))
def suite_alerts(spark, sf):
    """Mail alerts as rows: failed runs of rules with ``send_mail``."""
    res, cat = _suite(spark, sf)
    return S.alerts(S.dq_log(res, RUN_TIME), cat).groupBy("rule_id").agg(F.count(F.lit(1)).alias("n_failed_runs"))


@register("task_check_assertions", _suite_oracle("""
, tasks as (select distinct dq_tasks_id, entity_sample_to_dq_rule_id as rule_id from cat)
select t.dq_tasks_id, r.rule_id, r.assertion, r."column", r.success, r.state, r.msg
from tasks t join res r on r.rule_id = t.rule_id""", mode="for_schedule"))
def task_check_assertions(spark, sf):
    """Scheduled pass (L3 + K1): every pending task of a scheduled rule with the
    assertions its rule produces (each definition evaluated once)."""
    cat = _cat(spark, sf, ("dq_tasks",))
    selected = K.rule_catalog(cat, "for_schedule", tasks=spark.table("dq_tasks"))
    res = S.run_rules(spark, selected, lambda name: read_table(spark, sf, name))
    tasks = selected.select("dq_tasks_id", F.col("entity_sample_to_dq_rule_id").alias("rule_id")).distinct()
    return tasks.join(res, "rule_id", "inner").select("dq_tasks_id", "rule_id", "assertion", "column", "success",
                                                      "state", "msg")


_REC_DEFS_SQL = """
, defs as (select distinct rule_ref, rule_settings from cat
           where length(coalesce(rule_settings, '')) > 0
             and json_extract_string(rule_settings, '$.table') is null
             and json_extract_string(rule_settings, '$.columns') is not null
             and rule_ref in ('not_null', 'check_condition')),
cols as (select d.rule_ref, d.rule_settings, json_extract_string(d.rule_settings, '$.regex') as rx,
                unnest(string_split(json_extract_string(d.rule_settings, '$.columns'), ';')) as col from defs d),
cells as (select c.rule_ref, c.rule_settings, c.rx, c.col, k.c_custkey,
                 case c.col when 'c_name' then k.c_name when 'c_mktsegment' then k.c_mktsegment end as v
          from cols c, customer k)
select rule_ref, c_custkey as record_id, rule_ref as assertion, col as "column",
       case when rule_ref = 'not_null' then v is not null else coalesce(regexp_matches(v, rx), false) end as success,
       case when (case when rule_ref = 'not_null' then v is not null
                       else coalesce(regexp_matches(v, rx), false) end) then '2' else '0' end as state,
       concat('Идентификатор записи ', cast(c_custkey as varchar)) as msg
from cells"""


@register("rec_rules_catalog", _suite_oracle("", mode="regular").split("\nb as (")[0].rstrip(",") + _REC_DEFS_SQL)
def rec_rules_catalog(spark, sf):
    """K2 + B13: every distinct record-mode definition of the regular catalog
    applied to every customer record (definition grain; bindings are not
    multiplied into the records)."""
    cat = K.rule_catalog(_cat(spark, sf), "regular")
    recs = read_table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), "c_name", "c_mktsegment")
    return S.evaluate_record_rules(recs, cat).drop("rule_settings")
