"""Reference data model derived from the driver tables.

The reference keeps its run log, assertions, rule catalog and task queue in a
database that ships without data. These derivations rebuild them from the
driver tables with plain SQL that both Spark and DuckDB run unchanged (up to
the two dialect placeholders below), so a Spark query and its DuckDB oracle
read the same rows and every derived table grows with the scale factor.

Placeholders: ``{TS}`` is the zone-less timestamp type name and ``{column}``
the quoted identifier ``column``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .tables import _current, _remember, register_tables

# The cron literals used in rule settings.
CRON_LITERALS = ("*/5 * * * *", "0 3 * * *", "30 6 1 * *", "0 0 * * 1")

# Fixed value: the "now" of the scheduler fixtures (never the clock).
FIXED_NOW = "2024-02-01 00:00:00"

_PARENT = "case when o_orderkey < 10 then null else cast(floor(o_orderkey / 10) as bigint) end"

FIXTURE_SQL: dict[str, str] = {}

# Run log: one START per order, RUNNING for even customers, COMPLETE for
# F/O orders (with a nominal window), FAIL for some P orders. run_id is the
# order key and parent_run_id = floor(key / 10), a forest of fan-out <= 10.
FIXTURE_SQL["run_log"] = f"""
select o_orderkey * 4 as id, o_orderkey as run_id, {_PARENT} as parent_run_id,
       'START' as event_type, o_orderdate as event_time,
       case when o_orderpriority = '5-LOW' then 'DQ tool' else 'etl' end as producer,
       cast(null as {{TS}}) as nominal_end_time, cast(null as {{TS}}) as nominal_start_time
from orders
union all
select o_orderkey * 4 + 1, o_orderkey, {_PARENT}, 'RUNNING', o_orderdate, 'etl',
       cast(null as {{TS}}), cast(null as {{TS}})
from orders where o_custkey % 2 = 0
union all
select o_orderkey * 4 + 2, o_orderkey, {_PARENT}, 'COMPLETE',
       o_orderdate + interval '1' day * (o_custkey % 60), 'etl',
       o_orderdate + interval '1' day * (o_orderkey % 90), o_orderdate
from orders where o_orderstatus in ('F', 'O')
union all
select o_orderkey * 4 + 3, o_orderkey, {_PARENT}, 'FAIL', o_orderdate, 'etl',
       cast(null as {{TS}}), cast(null as {{TS}})
from orders where o_orderstatus = 'P' and o_custkey % 3 = 0
"""

# Assertions attached to run events (ol_id may name an event that does not exist).
FIXTURE_SQL["assertions"] = """
select l_orderkey * 10 + l_linenumber as id,
       case when l_linenumber % 2 = 0 then 'not_null' else 'check_range' end as assertion,
       l_returnflag as {column},
       l_discount < 0.085 as success,
       l_orderkey * 4 + l_linenumber % 3 as ol_id,
       case when l_discount >= 0.095 then '0' when l_discount >= 0.085 then '1' else '2' end as state,
       case when l_tax > 0.02 then l_returnflag end as msg,
       l_suppkey as rule_id
from lineitem
"""

FIXTURE_SQL["run_inputs"] = """
select 'part' as name, cast(l_partkey as string) as ns, l_orderkey * 4 + l_linenumber % 3 as ol_id
from lineitem where l_linenumber % 2 = 0
"""

FIXTURE_SQL["run_outputs"] = """
select 'supplier' as name, cast(l_suppkey as string) as ns, l_orderkey * 4 + l_linenumber % 3 as ol_id
from lineitem where l_linenumber % 2 = 1
"""

# ---- rule catalog -------------------------------------------------------
FIXTURE_SQL["entity_sample_to_dq_rule"] = f"""
select o_orderkey as id, o_custkey % 10 as dq_rule_id, o_custkey as entity_sample_id,
       case when o_orderkey % 7 = 0 then null else o_orderkey % 100 end as indicator_id,
       case when o_orderkey % 5 = 0 then null else o_custkey % 100 end as product_id,
       case when o_orderkey % 3 = 0 then null else o_orderkey % 2000 end as asset_id,
       case o_orderkey % 6
         when 0 then concat('{{"crontab":"',
              case cast(floor(o_orderkey / 6) as bigint) % 4 when 0 then '{CRON_LITERALS[0]}'
                   when 1 then '{CRON_LITERALS[1]}' when 2 then '{CRON_LITERALS[2]}'
                   else '{CRON_LITERALS[3]}' end,
              '","table":"orders","columns":"o_orderkey;o_custkey"}}')
         when 1 then concat('{{"connection":"conn NATION_', cast(o_custkey % 25 as string),
              '","source":"Kafka","fields":"', case when o_custkey % 10 = 6 then 'value|50|90' else 'value;z' end, '"}}')
         when 2 then '{{"table":"lineitem","columns":"l_returnflag;l_quantity","ranges":"(''A'',''N'');between 1 and 40"}}'
         when 3 then concat('{{"crontab":"',
              case cast(floor(o_orderkey / 6) as bigint) % 4 when 0 then '{CRON_LITERALS[1]}'
                   when 1 then '{CRON_LITERALS[2]}' when 2 then '{CRON_LITERALS[3]}'
                   else '{CRON_LITERALS[0]}' end,
              '","path":"lineitem","count":"60000"}}')
         when 4 then case when cast(floor(o_orderkey / 6) as bigint) % 2 = 0 then ''
                     else '{{"columns":"c_name;c_mktsegment","regex":"^Customer#0+[1-9]"}}' end
         else null end as settings,
       o_orderkey % 2 = 0 as send_mail,
       case cast(floor(o_orderkey / 7) as bigint) % 3 when 0 then true when 1 then false else null end as disabled
from orders
"""

# The rule kinds (id, name, function name); one has no function.
FIXTURE_SQL["dq_rule"] = """
select * from (values
  (0, 'uniqueness', 'check_uniqueness'),
  (1, 'null values', 'check_null_values'),
  (2, 'value range', 'check_range'),
  (3, 'row count', 'count_equal'),
  (4, 'record not null', 'not_null'),
  (5, 'record regex', 'check_condition'),
  (6, 'deviation from average', 'check_avg'),
  (7, 'draft rule', null),
  (8, 'nominal time', 'check_nominal_time'),
  (9, 'stream field presence', 'check_not_null')
) as t(id, name, rule_ref)
"""

FIXTURE_SQL["entity_sample"] = """
select c_custkey as id, c_name as name, c_custkey as entity_query_id from customer
"""

FIXTURE_SQL["entity_query"] = """
select c_custkey as id, concat('query ', cast(c_custkey as string)) as name,
       c_custkey as entity_id,
       case when c_custkey % 2 = 0 then c_custkey % 25 else c_nationkey end as system_id
from customer
"""

FIXTURE_SQL["entity"] = "select p_partkey as id, p_name as name from part"

# Some queries have two tasks, which fans the catalog out.
FIXTURE_SQL["task"] = """
select s_suppkey * 3 as query_id, s_nationkey as system_connection_id from supplier
union all
select s_suppkey * 3, (s_nationkey + 1) % 25 from supplier where s_suppkey % 4 = 0
"""

FIXTURE_SQL["system"] = "select n_nationkey as id, n_name as name from nation"
FIXTURE_SQL["domain"] = "select r_regionkey as id, r_name as name from region"

FIXTURE_SQL["data_asset"] = """
select p_partkey as id, concat('asset ', p_name) as name,
       case p_partkey % 3 when 0 then 'PUBLISHED' when 1 then 'DRAFT' else null end as state,
       p_partkey % 25 as system_id, p_partkey as entity_id, p_partkey % 5 as domain_id
from part
"""

FIXTURE_SQL["product"] = """
select s_suppkey as id, concat('product ', s_name) as name,
       case s_suppkey % 3 when 0 then 'PUBLISHED' when 1 then 'DRAFT' else null end as state
from supplier
"""

FIXTURE_SQL["indicator"] = """
select s_suppkey as id, concat('indicator ', s_name) as name,
       case s_suppkey % 4 when 0 then 'DRAFT' when 1 then null else 'PUBLISHED' end as state
from supplier
"""

FIXTURE_SQL["system_connection"] = """
select n_nationkey as id, concat('conn ', n_name) as name, n_regionkey as connector_id from nation
"""

# Connector parameter names.
FIXTURE_SQL["connector_param"] = """
select * from (values (1, 'jdbc_username'), (2, 'jdbc_password'), (3, 'jdbc_url'),
                      (4, 'config'), (5, 'topic')) as t(id, name)
"""

FIXTURE_SQL["system_connection_param"] = """
select concat('user_', lower(n_name)) as param_value, n_nationkey as system_connection_id, 1 as connector_param_id from nation
union all
select concat('pw_', lower(n_name)), n_nationkey, 2 from nation
union all
select concat('jdbc:postgresql://db', cast(n_nationkey as string), ':5432/dq'), n_nationkey, 3 from nation
union all
select concat('{"bootstrap.servers":"broker', cast(n_regionkey as string), ':9092"}'), n_nationkey, 4 from nation
where n_regionkey % 2 = 0
union all
select concat('topic_', lower(n_name)), n_nationkey, 5 from nation
"""

# ---- task queue ----------------------------------------------------------
FIXTURE_SQL["dq_tasks"] = """
select event_id as id, cast(date_trunc('minute', ts) as {TS}) as time, user_id * 6 as rule_id,
       cast(event_id % 3 as int) as state
from events
"""

# ---- checked messages (JSON text, key order fixed) ------------------------
# value rendered from cents so both engines print the same text; variants:
# absent field (error), explicit null (view), non-numeric (every 7th signup),
# malformed JSON (every 97th event).
FIXTURE_SQL["messages"] = """
select event_id as msg_key, user_id % 3 as run_id,
       case when event_id % 97 = 5 then concat('{"key": ', cast(event_id as string), ', "run_id": ')
       else concat('{"key": ', cast(event_id as string),
                   ', "run_id": ', cast(user_id % 3 as string),
                   case when event_type = 'error' then ''
                        when event_type = 'view' then ', "value": null'
                        when event_type = 'signup' and event_id % 7 = 0 then ', "value": "n/a"'
                        else concat(', "value": ',
                                    cast(cast(floor(round(value * 100) / 100) as bigint) as string), '.',
                                    lpad(cast(cast(round(value * 100) as bigint) % 100 as string), 2, '0'))
                   end,
                   ', "props": ', props, '}')
       end as value
from events
"""

# dependency order for registration
FIXTURE_ORDER = (
    "run_log", "assertions", "run_inputs", "run_outputs",
    "entity_sample_to_dq_rule", "dq_rule", "entity_sample", "entity_query", "entity", "task",
    "system", "domain", "data_asset", "product", "indicator", "system_connection",
    "connector_param", "system_connection_param", "dq_tasks", "messages",
)


def fixture_sql(name: str, dialect: str = "spark") -> str:
    sql = FIXTURE_SQL[name]
    if dialect == "spark":
        return sql.replace("{TS}", "timestamp_ntz").replace("{column}", "`column`")
    return sql.replace("{TS}", "timestamp").replace("{column}", '"column"')


def fixture(spark: SparkSession, name: str) -> DataFrame:
    """One derived table as a DataFrame over the registered driver views."""
    return spark.sql(fixture_sql(name, "spark"))


def register_fixtures(spark: SparkSession, sf_dir: str, names=FIXTURE_ORDER) -> None:
    """Register driver tables and derived tables as temp views (lazy)."""
    register_tables(spark, sf_dir)
    for n in names:
        src = f"fixture:{sf_dir.rstrip('/')}"
        if _current(spark, n, src):
            continue
        fixture(spark, n).createOrReplaceTempView(n)
        _remember(spark, n, src)


def duckdb_with(*names: str, recursive: bool = False) -> str:
    """A ``WITH`` prefix defining the named derived tables for a DuckDB oracle."""
    return ("with recursive " if recursive else "with ") + ",\n".join(f"{n} as ({fixture_sql(n, 'duckdb')})" for n in names) + "\n"
