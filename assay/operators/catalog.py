"""Rule catalog: bindings joined to rule kinds, samples, queries, tasks,
products, indicators, connections, systems and assets (C1-C7, A8, B7-B13).

All seven catalog variants of the reference are one function with a ``mode``;
they differ only in filters, the asset join and the connection parameters.
Joins are plain left joins; AQE turns a join into a broadcast when the
dimension's measured size is under the broadcast threshold and keeps a
sort-merge join otherwise, so no dimension is broadcast on trust.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CATALOG_TABLES = ("entity_sample_to_dq_rule", "dq_rule", "entity_sample", "entity_query", "entity", "task",
                  "indicator", "product", "system_connection", "system", "data_asset", "domain",
                  "connector_param", "system_connection_param")

JDBC_PARAMS = ("jdbc_username", "jdbc_password", "jdbc_url")
KAFKA_PARAMS = ("config", "topic")

MODES = ("for_schedule", "regular_for_schedule", "regular", "for_product", "for_asset", "kafka", "check")


@dataclass
class Catalog:
    tables: dict[str, DataFrame]

    @classmethod
    def from_views(cls, spark: SparkSession, names=CATALOG_TABLES) -> "Catalog":
        return cls({n: spark.table(n) for n in names})

    def __getitem__(self, name: str) -> DataFrame:
        return self.tables[name]


def active(r: str = "r") -> Column:
    """Enabled binding (``disabled`` false or null)."""
    return ~F.coalesce(F.col(f"{r}.disabled"), F.lit(False))


def published_or_absent(alias: str) -> Column:
    """B8."""
    st = F.col(f"{alias}.state")
    return (st == "PUBLISHED") | st.isNull()


def connector_params(cat: Catalog) -> DataFrame:
    """Parameter value with its parameter name and connection name."""
    scp = cat["system_connection_param"].alias("scp")
    cp = cat["connector_param"].alias("cp")
    sc = cat["system_connection"].alias("sc")
    return (scp.join(cp, F.col("cp.id") == F.col("scp.connector_param_id"), "left")
            .join(sc, F.col("sc.id") == F.col("scp.system_connection_id"), "left")
            .select(F.col("sc.name").alias("connection_name"), F.col("cp.name").alias("param_name"),
                    F.col("scp.param_value"), F.col("scp.system_connection_id")))


def params_wide(params: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """C4: one row per connection with one column per parameter.

    The reference reads each parameter with a scalar subquery, which fails on
    more than one row; so does reading a column here whose parameter is there
    twice (the check is part of the value, so it cannot be pruned away).
    """
    p = params.filter(F.col("param_name").isin(*names))
    agg = [F.when(F.count_if(F.col("param_name") == n) > 1, F.raise_error(F.lit(f"more than one {n} for a connection")).cast("string"))
           .otherwise(F.first(F.when(F.col("param_name") == n, F.col("param_value")), ignorenulls=True)).alias(n)
           for n in names]
    return p.groupBy("system_connection_id").agg(*agg)


def connection_param(params: DataFrame, connection: str | Column, name: str) -> DataFrame:
    """Value of one parameter of a named connection."""
    conn = connection if isinstance(connection, Column) else F.lit(connection)
    return params.filter((F.col("connection_name") == conn) & (F.col("param_name") == name)) \
                 .select("param_value")


def _base(cat: Catalog) -> DataFrame:
    """The ten-table left-join chain (fans out per task)."""
    r = cat["entity_sample_to_dq_rule"].alias("r")
    return (r.join(cat["dq_rule"].alias("dr"), F.col("r.dq_rule_id") == F.col("dr.id"), "left")
            .join(cat["entity_sample"].alias("es"), F.col("r.entity_sample_id") == F.col("es.id"), "left")
            .join(cat["entity_query"].alias("eq"), F.col("es.entity_query_id") == F.col("eq.id"), "left")
            .join(cat["entity"].alias("e"), F.col("e.id") == F.col("eq.entity_id"), "left")
            .join(cat["task"].alias("t"), F.col("t.query_id") == F.col("eq.id"), "left")
            .join(cat["indicator"].alias("i"), F.col("i.id") == F.col("r.indicator_id"), "left")
            .join(cat["product"].alias("p"), F.col("p.id") == F.col("r.product_id"), "left"))


def _common_columns() -> list[Column]:
    return [F.col("s.id").alias("system_id"), F.col("s.name").alias("system_name"),
            F.col("dr.name").alias("rule_name"), F.col("dr.id").alias("rule_id"), F.col("dr.rule_ref"),
            F.col("r.settings").alias("rule_settings"), F.col("sc.connector_id"),
            F.col("t.system_connection_id"), F.col("eq.name").alias("query_name"),
            F.col("r.id").alias("entity_sample_to_dq_rule_id"), F.col("e.name").alias("entity_name")]


def rule_catalog(cat: Catalog, mode: str, product_id=None, asset_id=None,
                 tasks: DataFrame | None = None) -> DataFrame:
    """Rules ready to run, in one of the reference's seven variants."""
    if mode not in MODES:
        raise ValueError(f"unknown catalog mode {mode}")
    df = _base(cat)
    if mode == "for_asset":
        df = df.join(cat["data_asset"].alias("da"), F.col("da.id") == F.col("r.asset_id"), "left")
    df = (df.join(cat["system_connection"].alias("sc"), F.col("sc.id") == F.col("t.system_connection_id"), "left")
          .join(cat["system"].alias("s"), F.col("s.id") == F.col("eq.system_id"), "left"))
    cond = active() & published_or_absent("p") & published_or_absent("i") & F.col("dr.rule_ref").isNotNull()
    extra: list[Column] = []
    if mode == "for_schedule":
        da = cat["data_asset"]
        df = (df.join(da.alias("da"), F.col("da.id") == F.col("r.asset_id"), "left")
              .join(da.alias("da1"), (F.col("da1.system_id") == F.col("s.id"))
                    & (F.col("da1.entity_id") == F.col("e.id")), "left"))
        if tasks is None:
            raise ValueError("for_schedule needs the task table")
        pending = tasks.filter(F.col("state") != 2).select(F.col("id").alias("dq_tasks_id"),
                                                           F.col("rule_id").alias("_task_rule"))
        df = df.join(pending, F.col("_task_rule") == F.col("r.id"), "inner")  # C5
        cond = cond & published_or_absent("da") & published_or_absent("da1") \
            & F.col("r.settings").contains("crontab")
        extra = [F.col("da.id").alias("data_asset_id"), F.col("da1.id").alias("data_asset_id1"), "dq_tasks_id"]
    elif mode in ("regular_for_schedule", "regular"):
        published = cat["data_asset"].filter(F.col("state") == "PUBLISHED")  # filter in ON: no row loss
        df = df.join(published.alias("da"), (F.col("da.system_id") == F.col("s.id"))
                     & (F.col("da.entity_id") == F.col("e.id")), "left")
        cond = cond & (F.col("r.settings").contains("crontab") if mode == "regular_for_schedule"
                       else ~F.col("r.settings").contains("Kafka"))
        extra = [F.col("da.id").alias("data_asset_id")]
    elif mode == "for_product":
        cond = cond & (F.col("p.id") == F.lit(product_id))
    elif mode == "for_asset":
        cond = cond & published_or_absent("da") & (F.col("da.id") == F.lit(asset_id))
    elif mode == "kafka":
        cond = cond & F.col("r.settings").contains("Kafka")
    elif mode == "check":
        cond = cond & F.col("dr.rule_ref").contains("check_nominal_time")
    df = df.filter(cond)
    params = connector_params(cat)
    if mode in ("kafka", "check"):
        wide = params_wide(params, KAFKA_PARAMS).alias("cp")
        pcols = [F.col("cp.config"), F.col("cp.topic")]
    else:
        wide = params_wide(params, JDBC_PARAMS).alias("cp")
        pcols = [F.col("cp.jdbc_username").alias("username"), F.col("cp.jdbc_password").alias("password"),
                 F.replace(F.col("cp.jdbc_url"), F.lit("jdbc:postgresql://"), F.lit("")).alias("url")]
    df = df.join(wide, F.col("cp.system_connection_id") == F.col("t.system_connection_id"), "left")
    return df.select(*_common_columns(), *extra, *pcols, F.col("r.send_mail"))


def rule_tasks_view(cat: Catalog) -> DataFrame:
    """C7 (with B23): rules with names and ids; ``task`` is joined but unused,
    so its fan-out is kept as in the reference view."""
    df = (_base(cat)
          .join(cat["system"].alias("s"), F.col("s.id") == F.col("eq.system_id"), "left")
          .join(cat["data_asset"].alias("da"), F.col("r.asset_id") == F.col("da.id"), "left"))
    cond = (active() & published_or_absent("p") & published_or_absent("i") & published_or_absent("da")
            & F.col("dr.rule_ref").isNotNull())
    return df.filter(cond).select(
        F.col("r.id").alias("id"), F.col("s.id").alias("system_id"), F.col("s.name").alias("system_name"),
        F.col("dr.name").alias("rule_name"), F.col("dr.id").alias("rule_id"), F.col("dr.rule_ref"),
        F.col("r.settings").alias("rule_settings"), F.col("eq.name").alias("query_name"),
        F.col("r.id").alias("entity_sample_to_dq_rule_id"), F.col("e.name").alias("entity_name"),
        F.col("p.name").alias("product_name"), F.col("i.name").alias("indicator_name"),
        F.col("da.name").alias("data_asset_name"), F.col("p.id").alias("product_id"),
        F.col("i.id").alias("indicator_id"), F.col("da.id").alias("data_asset_id"),
        F.col("es.id").alias("entity_sample_id"), F.col("es.name").alias("entity_sample_name"),
        F.when(F.col("r.settings").contains("crontab"), 1).otherwise(0).alias("is_crontab"))
