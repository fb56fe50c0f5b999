"""Queries for the table, record and message checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import checks as C
from ..operators import records as R
from ..sources.fixtures import duckdb_with, fixture
from ..sources.tables import read_table, register_tables
from .registry import register

# ---- range (B4, D5, H3) -------------------------------------------------------

RANGE_COLUMNS = ["l_returnflag", "l_quantity"]
RANGE_TEXTS = ["('A','N')", "between 1 and 40"]


def _range_sql(table: str, column: str, rng: str, pred: str) -> str:
    msg = (f"case when n = 0 then '' else concat('В колонке {column} ', cast(n as varchar), "
           f"' значений вне диапазона {rng.replace(chr(39), chr(39) * 2)};') end")
    return (f"select 'check_range' as assertion, '{column}' as \"column\", "
            f"'{rng.replace(chr(39), chr(39) * 2)}' as range, n = 0 as success, "
            f"case when n = 0 then '2' else '0' end as state, {msg} as msg, n as n_bad "
            f"from (select count(*) filter (where not ({pred})) as n from {table})")


@register("chk_range_in", _range_sql("lineitem", "l_returnflag", "('A','N')", "l_returnflag in ('A','N')"))
def chk_range_in(spark, sf):
    li = read_table(spark, sf, "lineitem")
    return C.range_check(li, RANGE_COLUMNS[:1], RANGE_TEXTS[:1], "lineitem").drop("pos")


@register("chk_range_between", _range_sql("lineitem", "l_quantity", "between 1 and 40",
                                          "l_quantity between 1 and 40"))
def chk_range_between(spark, sf):
    li = read_table(spark, sf, "lineitem")
    return C.range_check(li, RANGE_COLUMNS[1:], RANGE_TEXTS[1:], "lineitem").drop("pos")


@register("chk_range", _range_sql("lineitem", "l_returnflag", "('A','N')", "l_returnflag in ('A','N')")
          + " union all " + _range_sql("lineitem", "l_quantity", "between 1 and 40", "l_quantity between 1 and 40"))
def chk_range(spark, sf):
    """The minimum slice: two pairs, one fused aggregate over lineitem."""
    li = read_table(spark, sf, "lineitem")
    return C.range_check(li, RANGE_COLUMNS, RANGE_TEXTS, "lineitem").drop("pos")


_DOC_LABELS_SQL = ("(select d.doc_id, d.text, d.lang, l.quality, l.toxic "
                   "from documents d left join labels l on d.doc_id = l.doc_id)")


def _docs_labels(spark, sf):
    d = read_table(spark, sf, "documents").select("doc_id", "text", "lang")
    lab = read_table(spark, sf, "labels").select("doc_id", "quality", "toxic")
    return d.join(lab, "doc_id", "left")


@register("chk_range_null_semantics",
          _range_sql(_DOC_LABELS_SQL, "quality", "(1)", "quality in (1)")
          + " union all " + _range_sql(_DOC_LABELS_SQL, "toxic", "between 0 and 0", "toxic between 0 and 0")
          + " union all " + _range_sql(_DOC_LABELS_SQL, "lang", "<> 'xx'", "lang <> 'xx'"))
def chk_range_null_semantics(spark, sf):
    """Nulls from the outer join are not range violations."""
    return C.range_check(_docs_labels(spark, sf), ["quality", "toxic", "lang", "doc_id"],
                         ["(1)", "between 0 and 0", "<> 'xx'"], "documents").drop("pos")


# ---- nulls (B5, D3, D4) --------------------------------------------------------

def _null_sql(src: str, column: str, expr: str) -> str:
    return (f"select 'check_null_values' as assertion, '{column}' as \"column\", n = 0 as success, "
            f"case when n = 0 then '2' else '0' end as state, "
            f"case when n = 0 then '' else concat('В колонке {column} ', cast(n as varchar), ' пустых значений;') end as msg, "
            f"n as n_bad from (select count(*) filter (where {expr} is null) as n from {src})")


_ORD_NULL_SRC = "(select o_orderkey, nullif(o_orderpriority, '5-LOW') as o_orderpriority from orders)"


@register("chk_nulls", " union all ".join([
    _null_sql(_DOC_LABELS_SQL, "quality", "quality"),
    _null_sql(_DOC_LABELS_SQL, "toxic", "toxic"),
    _null_sql(_DOC_LABELS_SQL, "text", "text"),
]))
def chk_nulls(spark, sf):
    return C.null_check(_docs_labels(spark, sf), ["quality", "toxic", "text"], "documents").drop("pos")


@register("chk_nulls_derived", " union all ".join([
    _null_sql(_ORD_NULL_SRC, "o_orderpriority", "o_orderpriority"),
    _null_sql(_ORD_NULL_SRC, "o_orderkey", "o_orderkey"),
]))
def chk_nulls_derived(spark, sf):
    o = read_table(spark, sf, "orders").select(
        "o_orderkey", F.nullif(F.col("o_orderpriority"), F.lit("5-LOW")).alias("o_orderpriority"))
    return C.null_check(o, ["o_orderpriority", "o_orderkey"], "orders").drop("pos")


# ---- row count (D6) ------------------------------------------------------------

EXPECTED_LINEITEM = 60000


@register("chk_row_count",
          "select 'count_equal' as assertion, '*' as \"column\", n = 60000 as success, "
          "case when n = 60000 then '2' else '0' end as state, "
          "case when n = 60000 then 'В файле lineitem к-во записей  равно 60000' "
          "else 'В файле lineitem к-во записей не равно 60000' end as msg, n as n_bad "
          "from (select count(*) as n from lineitem)")
def chk_row_count(spark, sf):
    return C.row_count_check(read_table(spark, sf, "lineitem"), EXPECTED_LINEITEM, "lineitem").drop("pos")


# ---- uniqueness (D1, D2) -------------------------------------------------------

def _dup_groups_sql(table, col):
    return (f"select '{col}' as \"column\", cast({col} as varchar) as value, count(*) as count "
            f"from {table} where {col} is not null group by {col} having count(*) > 1")


@register("chk_unique_groups", " union all ".join([
    _dup_groups_sql("orders", "o_custkey"), _dup_groups_sql("orders", "o_orderkey"),
    _dup_groups_sql("lineitem", "l_orderkey")]))
def chk_unique_groups(spark, sf):
    o = C.duplicate_groups(read_table(spark, sf, "orders"), ["o_custkey", "o_orderkey"])
    li = C.duplicate_groups(read_table(spark, sf, "lineitem"), ["l_orderkey"])
    return o.unionByName(li).drop("pos")


def _unique_summary_sql(table, col):
    return f"""
    select 'check_uniqueness' as assertion, '{col}' as "column", n is null as success,
           case when n is null then '2' else '0' end as state,
           case when n is null then '' else concat('Значение "', v, '" повторяется ', cast(c as varchar),
                ' раз(а) в колонке {col};') end as msg,
           coalesce(n, 0) as n_bad
    from (select 1 as one) k left join (
      select count(*) as n, min(value) as v, arg_min(cnt, value) as c
      from (select cast({col} as varchar) as value, count(*) as cnt from {table}
            where {col} is not null group by {col} having count(*) > 1)
      having count(*) > 0) g on true"""


@register("chk_unique_summary", " union all ".join([
    _unique_summary_sql("orders", "o_orderkey"), _unique_summary_sql("orders", "o_custkey")]))
def chk_unique_summary(spark, sf):
    return C.uniqueness_check(read_table(spark, sf, "orders"), ["o_orderkey", "o_custkey"], "orders").drop("pos")


# ---- record checks (B1, B2, K2) ------------------------------------------------

@register("rec_not_null", """
select c_custkey as id, 'not_null' as assertion, 'c_name' as "column", c_name is not null as success,
       case when c_name is not null then '2' else '0' end as state,
       concat('Идентификатор записи ', cast(c_custkey as varchar)) as msg from customer
union all
select c_custkey, 'not_null', 'c_mktsegment', nullif(c_mktsegment, 'HOUSEHOLD') is not null,
       case when nullif(c_mktsegment, 'HOUSEHOLD') is not null then '2' else '0' end,
       concat('Идентификатор записи ', cast(c_custkey as varchar)) from customer
""")
def rec_not_null(spark, sf):
    c = read_table(spark, sf, "customer").select(
        F.col("c_custkey").alias("id"), "c_name",
        F.nullif(F.col("c_mktsegment"), F.lit("HOUSEHOLD")).alias("c_mktsegment"))
    return R.record_assertions(c, "not_null", ["c_name", "c_mktsegment"], {}, id_col="id", keep=("id",))


REGEX_CUSTOMER = r"^Customer#\d+$"
REGEX_ZEROS = "0{9}"
REGEX_BRAND = r"#1\d"


@register("rec_regex", f"""
select c_custkey as id, 'check_condition' as assertion, 'c_name' as "column",
       coalesce(regexp_matches(c_name, '{REGEX_CUSTOMER}'), false) as success,
       case when coalesce(regexp_matches(c_name, '{REGEX_CUSTOMER}'), false) then '2' else '0' end as state,
       concat('Идентификатор записи ', cast(c_custkey as varchar)) as msg from customer
union all
select c_custkey, 'check_condition', 'c_name_zeros', coalesce(regexp_matches(c_name, '{REGEX_ZEROS}'), false),
       case when coalesce(regexp_matches(c_name, '{REGEX_ZEROS}'), false) then '2' else '0' end,
       concat('Идентификатор записи ', cast(c_custkey as varchar)) from customer
union all
select p_partkey, 'check_condition', 'p_brand', coalesce(regexp_matches(p_brand, '{REGEX_BRAND}'), false),
       case when coalesce(regexp_matches(p_brand, '{REGEX_BRAND}'), false) then '2' else '0' end,
       concat('Идентификатор записи ', cast(p_partkey as varchar)) from part
""")
def rec_regex(spark, sf):
    c = read_table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), "c_name",
                                                   F.col("c_name").alias("c_name_zeros"))
    a = R.record_assertions(c, "check_condition", ["c_name"], {"regex": REGEX_CUSTOMER}, keep=("id",))
    b = R.record_assertions(c, "check_condition", ["c_name_zeros"], {"regex": REGEX_ZEROS}, keep=("id",))
    p = read_table(spark, sf, "part").select(F.col("p_partkey").alias("id"), "p_brand")
    d = R.record_assertions(p, "check_condition", ["p_brand"], {"regex": REGEX_BRAND}, keep=("id",))
    return a.unionByName(b).unionByName(d)


# ---- message checks (B6, C16, H4-H6, H14, I7) -----------------------------------

PRESENCE_FIELDS = ["value", "props", "z"]


def _messages(spark, sf):
    register_tables(spark, sf, ("events",))
    return fixture(spark, "messages")


@register("msg_presence", duckdb_with("messages") + """
, ok as (select msg_key, value from messages where json_valid(value))
select msg_key, 'not_null' as assertion, f as "column", json_exists(value, '$.' || f) as success,
       case when json_exists(value, '$.' || f) then '2' else '0' end as state,
       case when json_exists(value, '$.' || f) then null
            else concat('Поле ', f, ' не заполнено(key - ', cast(msg_key as varchar), ')') end as msg
from ok, (select unnest(['value', 'props', 'z']) as f) fl
""")
def msg_presence(spark, sf):
    valid, _ = R.split_valid(_messages(spark, sf))
    return R.presence_assertions(valid, PRESENCE_FIELDS, key_col=F.col("_m")["key"].cast("long"),
                                 keep=("msg_key",))


@register("msg_rejected", duckdb_with("messages") + """
select msg_key, run_id, value from messages where not json_valid(value)
""")
def msg_rejected(spark, sf):
    _, bad = R.split_valid(_messages(spark, sf))
    return bad


AVG_SPEC = "value|50|90"

_AVG_ORACLE = duckdb_with("messages") + """
, a as (select avg(value) as av from events),
m as (select msg_key, try_cast(json_extract_string(value, '$.value') as double) as v
      from messages where json_valid(value)),
s as (select msg_key, v, case when abs(av) = 0 then null else 100 * abs(av - v) / abs(av) end as pct from m, a)
"""


@register("msg_avg_deviation", _AVG_ORACLE + """
select msg_key, 'check_avg' as assertion, 'value' as "column", v as value, round(pct, 6) as pct,
       case when pct is null then null when pct > 90 then '0' when pct > 50 then '1' else '2' end = '2' as success,
       case when pct is null then null when pct > 90 then '0' when pct > 50 then '1' else '2' end as state,
       concat('Поле value значительно отличается от среднего (',
              coalesce(cast(cast(round_even(pct, 0) as bigint) as varchar), ''), '%, key - ',
              cast(msg_key as varchar), ')') as msg
from s
""")
def msg_avg_deviation(spark, sf):
    valid, _ = R.split_valid(_messages(spark, sf))
    spec = R.parse_thresholds(AVG_SPEC)
    avgs = R.averages_for(read_table(spark, sf, "events"), [f for f, _, _ in spec])
    out = R.deviation_assertions(valid, avgs, spec, key_col=F.col("_m")["key"].cast("long"), keep=("msg_key",))
    return out.withColumn("pct", F.round("pct", 6))


@register("msg_avg_state_counts", _AVG_ORACLE + """
select case when pct is null then null when pct > 90 then '0' when pct > 50 then '1' else '2' end as state,
       count(*) as n
from s group by 1
""")
def msg_avg_state_counts(spark, sf):
    return msg_avg_deviation(spark, sf).groupBy("state").agg(F.count(F.lit(1)).alias("n"))


@register("rec_regex_values", """
select c_custkey as id, c_name as value, concat('#0*', cast(c_nationkey as varchar), '$') as regex,
       coalesce(regexp_matches(c_name, concat('#0*', cast(c_nationkey as varchar), '$')), false) as res
from customer""")
def rec_regex_values(spark, sf):
    """Value and pattern per row (the ad-hoc check of the reference API, as a batch)."""
    c = read_table(spark, sf, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("value"),
        F.concat(F.lit("#0*"), F.col("c_nationkey").cast("string"), F.lit("$")).alias("regex"))
    return c.withColumn("res", R.regex_values(c, "value", "regex"))
