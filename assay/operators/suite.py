"""Running catalog rules in batch.

Rules are data; what must be compiled is only the set of distinct checks: the
rule kind with the settings that say what to check (not its schedule or its
connection). The driver reads those, one row per different check, and their
metrics, one row per checked column. Checks of one table are fused: one
aggregate for every count-style check, one shuffle for all uniqueness columns.
Results join back to the bindings by check, so a check shared by many rules
is evaluated once.

A check that fails becomes a failed assertion with its ``error``; the others go
on. Three layers see to it: what cannot be analysed is left out of its table's
aggregate; values that a range cannot be applied to are counted, not raised on;
and a table whose job fails is checked again item by item.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import expressions as X
from . import checks as C

TABLE_RULES = ("check_uniqueness", "check_null_values", "check_range")
FILE_RULES = ("count_equal",)

Resolver = Callable[[str], DataFrame]


@dataclass(frozen=True)
class Definition:
    rule_ref: str
    settings: str

    @property
    def s(self) -> dict:
        return json.loads(self.settings)


# M1: plug-in rules, name -> (df, settings) -> assertion rows
RULE_BUILDERS: dict[str, Callable[[DataFrame, dict], DataFrame]] = {}

#: Settings that say what a built-in rule checks.
CHECK_KEYS = ("table", "columns", "ranges", "path", "count")
TABLES_AT_ONCE = 4  # tables whose jobs the driver submits side by side


def register_rule(name: str, builder: Callable[[DataFrame, dict], DataFrame]) -> None:
    """M1: plug in a rule (builder returns assertion rows with ``pos``). Under a
    built-in's name it takes the built-in's place."""
    RULE_BUILDERS[name] = builder
    BUILTIN_KINDS.pop(name, None)


def eligible(rules: DataFrame) -> DataFrame:
    """Non-empty settings; table rules need ``table`` and ``columns`` (and
    ``ranges`` for ranges); file rules need ``path`` and ``count``."""
    m = F.from_json(F.col("rule_settings"), "MAP<STRING,STRING>")
    has = lambda k: F.coalesce(F.map_contains_key(m, k), F.lit(False))
    table_ok = has("table") & has("columns") & F.col("rule_ref").isin(*TABLE_RULES) \
        & ((F.col("rule_ref") != "check_range") | has("ranges"))
    file_ok = has("path") & has("count") & F.col("rule_ref").isin(*FILE_RULES)
    extra = F.col("rule_ref").isin(*[k for k in RULE_BUILDERS if k not in TABLE_RULES + FILE_RULES])
    return rules.filter((F.length(F.coalesce(F.col("rule_settings"), F.lit(""))) > 0)
                        & (table_ok | file_ok | extra))


BUILTIN_KINDS = {"check_uniqueness": "unique", "check_null_values": "nulls", "check_range": "range",
                 "count_equal": "row_count"}

_ITEMS_T = ("rule_ref string, rule_settings string, tbl string, kind string, column string, arg string, "
            "pos int")


_METRICS_T = ("tbl string, kind string, column string, arg string, n_bad long, n_err long, rows long, "
              "first_value string, first_count long, error string")

_RESULT_T = ("rule_ref string, rule_settings string, assertion string, column string, success boolean, "
             "state string, msg string, n_bad long, error string, pos int")


def _items(d: Definition) -> list[tuple]:
    """One check item per (definition, column): what to measure and where."""
    s = d.s
    kind = BUILTIN_KINDS[d.rule_ref]
    if kind == "row_count":
        return [(d.rule_ref, d.settings, s["path"], kind, "*", str(int(s["count"])), 0)]
    cols = s["columns"].split(";")
    if kind == "range":
        return [(d.rule_ref, d.settings, s["table"], kind, C.bare_name(c), r.strip(), i)
                for i, (c, r) in enumerate(zip(cols, s["ranges"].split(";")))]
    return [(d.rule_ref, d.settings, s["table"], kind, C.bare_name(c), "", i) for i, c in enumerate(cols)]


def _table_metrics(df: DataFrame, table: str, items: list[tuple]) -> DataFrame:
    """All checks of all definitions on one table: one aggregate for the
    count-style checks, one shuffle for every uniqueness column.
    Rows: ``(tbl, kind, column, arg, n_bad, n_err, rows, first_value, first_count)``."""
    nulls = sorted({i[4] for i in items if i[3] == "nulls"})
    ranges = sorted({(i[4], i[5]) for i in items if i[3] == "range"})
    counts = sorted({i[5] for i in items if i[3] == "row_count"})
    uniq = sorted({i[4] for i in items if i[3] == "unique"})
    parts = []
    if nulls or ranges or counts:
        m = C.fused_counts(df, C.TableChecks(table, nulls=nulls, ranges=ranges, row_counts=[int(c) for c in counts]))
        parts.append(m.select("kind", "column", F.coalesce("range", F.lit("")).alias("arg"), "n_bad", "n_err", "rows",
                              F.lit(None).cast("string").alias("first_value"), F.lit(None).cast("long").alias("first_count")))
    if uniq:
        u = C.uniqueness_metrics(df, uniq)
        parts.append(u.select(F.lit("unique").alias("kind"), "column", F.lit("").alias("arg"), "n_bad", F.lit(0).cast("long").alias("n_err"),
                              F.lit(None).cast("long").alias("rows"), "first_value", "first_count"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("tbl", F.lit(table))


def _assertion_from_metric() -> list:
    """Assertion columns from a joined (item, metric) row, per kind."""
    kind, n = F.col("kind"), F.col("n_bad")
    unread = F.col("error").isNull() & (F.col("n_err") > 0)
    error = F.coalesce("error", F.when(unread, X.template(X.MSG_UNREADABLE, column=F.col("column"), count=F.col("n_err"),
                                                          range=F.col("arg"))))
    ok = error.isNull() & F.when(kind == "row_count", F.col("rows") == F.col("arg").cast("long")).otherwise(n == 0)
    msg = (F.when(error.isNotNull(), error).when(kind == "row_count", F.when(ok, X.template(X.MSG_COUNT_EQ, path=F.col("tbl"), count=F.col("arg")))
                  .otherwise(X.template(X.MSG_COUNT_NE, path=F.col("tbl"), count=F.col("arg"))))
           .when(ok, F.lit(""))
           .when(kind == "unique", X.template(X.MSG_DUPLICATE, value=F.col("first_value"),
                                               count=F.col("first_count"), column=F.col("column")))
           .when(kind == "nulls", X.template(X.MSG_NULLS, column=F.col("column"), count=n))
           .otherwise(X.template(X.MSG_RANGE, column=F.col("column"), count=n, range=F.col("arg"))))
    return [F.col("rule_ref").alias("assertion"), "column", ok.alias("success"),
            F.when(ok, X.STATE_OK).otherwise(X.STATE_ERROR).alias("state"), msg.alias("msg"),
            n.cast("long").alias("n_bad"), error.alias("error"), "pos"]


def _readable(item: tuple, df: DataFrame) -> None:
    """Raises if the item names an unknown column or a range that cannot be applied to it (analysis and literals only, no job)."""
    _, _, _, kind, column, arg, _ = item
    if kind != "row_count":
        df.select(C.quote_ident(column))
    if kind == "range":
        df.filter(C.range_predicate(column, arg))
        if "like" in arg.lower():  # a pattern is a literal: compile it now
            df.sparkSession.sql(f"select '' {arg}").collect()


def _separate(defs: list[Definition], resolve: Resolver) -> tuple[list[tuple], dict[str, DataFrame], list[tuple]]:
    """Items of the definitions that can be evaluated, their tables, and the failures of the others."""
    items, tables, failed = [], {}, []
    for d in defs:
        try:
            own = _items(d)
            for i in own:
                if i[2] not in tables:
                    tables[i[2]] = resolve(i[2])
                _readable(i, tables[i[2]])
            items += own
        except Exception as e:  # one broken rule must not stop the others: its error becomes its result
            failed.append(_failure(d, e))
    return items, tables, failed


def _error_text(e: Exception) -> str:
    return f"{type(e).__name__}: {str(e).splitlines()[0] if str(e) else ''}"


def _failure(d: Definition, e: Exception) -> tuple:
    return (d.rule_ref, d.settings, d.rule_ref, None, False, X.STATE_ERROR, _error_text(e), None, _error_text(e), 0)


def _measured(df: DataFrame, table: str, items: list[tuple]) -> list[tuple]:
    """Metric rows of a table's items, one each. If their common job fails, each item runs alone and the error is its own."""
    names = [c.split()[0] for c in _METRICS_T.split(", ")][:-1]
    try:
        return [(*[r[n] for n in names], None) for r in _table_metrics(df, table, items).collect()]
    except Exception as e:
        alone = {i[3:6]: i for i in items}
        if len(alone) == 1:
            kind, column, arg = items[0][3:6]
            return [(table, kind, column, arg, None, 0, None, None, None, _error_text(e))]
        return [row for i in alone.values() for row in _measured(df, table, [i])]


def evaluate(spark: SparkSession, defs: list[Definition], resolve: Resolver) -> DataFrame:
    """Evaluate definitions fused per table: every built-in check on a table
    shares one scan, one job per table and a few tables side by side; results
    reach each definition through a join with the table of check items. Plug-in
    rules (M1) run one by one. A definition that cannot be read (unknown table
    or column, bad range or count) or whose job fails gives a failed assertion
    with the error as its message."""
    items, frames, failed = _separate([d for d in defs if d.rule_ref in BUILTIN_KINDS], resolve)
    parts = []
    if items:
        tables = sorted({i[2] for i in items})
        with ThreadPoolExecutor(TABLES_AT_ONCE) as pool:
            metrics = [row for rows in pool.map(lambda t: _measured(frames[t], t, [i for i in items if i[2] == t]), tables) for row in rows]
        it = spark.createDataFrame(items, _ITEMS_T)
        joined = it.join(spark.createDataFrame(metrics, _METRICS_T), ["tbl", "kind", "column", "arg"], "inner")
        parts.append(joined.select("rule_ref", "rule_settings", *_assertion_from_metric()))
    for d in sorted((d for d in defs if d.rule_ref not in BUILTIN_KINDS), key=lambda x: (x.rule_ref, x.settings)):
        try:
            s = d.s
            out = RULE_BUILDERS[d.rule_ref](resolve(s.get("table") or s.get("path")), s)
            parts.append(out.select(F.lit(d.rule_ref).alias("rule_ref"), F.lit(d.settings).alias("rule_settings"),
                                    "assertion", "column", "success", "state", "msg", "n_bad",
                                    F.lit(None).cast("string").alias("error"), "pos").checkpoint(eager=True))
        except Exception as e:
            failed.append(_failure(d, e))
    if failed:
        parts.append(spark.createDataFrame(failed, _RESULT_T))
    if not parts:
        return spark.createDataFrame([], _RESULT_T)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def run_rules(spark: SparkSession, rules: DataFrame, resolve: Resolver,
              id_col: str = "entity_sample_to_dq_rule_id") -> DataFrame:
    """K1: assertions of every eligible rule (each binding once per pass).

    The bindings are materialized once (checkpoint in the shared folder): the
    checks read on the driver and the final join both come from it, so
    the catalog joins run a single time. Bindings that check the same thing on
    different schedules share one check."""
    m = F.from_json(F.col("rule_settings"), "MAP<STRING,STRING>")
    what = F.to_json(F.struct(*[m[k].alias(k) for k in CHECK_KEYS]))
    bindings = eligible(rules).select(
        F.col(id_col).alias("rule_id"), "rule_ref", "rule_settings",
        F.when(F.col("rule_ref").isin(*BUILTIN_KINDS), what).otherwise(F.col("rule_settings")).alias("check_settings")).distinct()
    bindings = bindings.checkpoint(eager=True)
    defs = [Definition(r["rule_ref"], r["check_settings"])
            for r in bindings.select("rule_ref", "check_settings").distinct().collect()]
    results = evaluate(spark, defs, resolve).withColumnRenamed("rule_settings", "check_settings")
    return bindings.join(results, ["rule_ref", "check_settings"], "inner").drop("check_settings")


def dq_log(assertions: DataFrame, run_time: str, tenant: str | None = None) -> DataFrame:
    """A9 + D12: one log row per rule run: status 0 when any assertion failed
    else 1, and the description rolled up in column order."""
    m = F.from_json(F.col("rule_settings"), "MAP<STRING,STRING>")
    agg = assertions.groupBy("rule_id", "rule_ref", "rule_settings").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "msg"))), lambda s: s["msg"]), "")
         .alias("findings"),
        F.bool_and("success").alias("all_ok"))
    table = m["table"]
    cols = m["columns"]
    ok_desc = (F.when(F.col("rule_ref") == "check_uniqueness", X.template(X.MSG_NO_DUPLICATES, columns=cols))
               .when(F.col("rule_ref") == "check_null_values", X.template(X.MSG_NO_NULLS, columns=cols))
               .when(F.col("rule_ref") == "check_range", X.template(X.MSG_RANGE_OK, columns=cols))
               .otherwise(F.col("findings")))
    bad_desc = (F.when(F.col("rule_ref") == "check_uniqueness",
                       X.template(X.MSG_DUPLICATES_FOUND, table=table, message=F.col("findings")))
                .when(F.col("rule_ref") == "check_null_values",
                      X.template(X.MSG_NULLS_FOUND, table=table, message=F.col("findings")))
                .when(F.col("rule_ref") == "check_range",
                      X.template(X.MSG_RANGE_FOUND, table=table, message=F.col("findings")))
                .otherwise(F.col("findings")))
    return agg.select(
        F.to_timestamp_ntz(F.lit(run_time)).alias("date"),
        F.when(F.col("all_ok"), 1).otherwise(0).alias("status"),
        F.when(F.col("all_ok"), ok_desc).otherwise(bad_desc).alias("description"),
        F.col("rule_id").cast("string").alias("rule_id"),
        F.lit(tenant).cast("string").alias("tenant"))


def alerts(log: DataFrame, rules: DataFrame) -> DataFrame:
    """Mail alerts as data: failed runs of rules that ask for mail."""
    r = rules.select(F.col("entity_sample_to_dq_rule_id").cast("string").alias("rule_id"), "send_mail").distinct()
    return log.filter(F.col("status") == 0).join(r, "rule_id", "inner").filter(F.col("send_mail"))


def record_rules(rules: DataFrame) -> DataFrame:
    """B13 record mode: non-empty settings without ``table`` but with ``columns``,
    for a record rule kind."""
    from .records import RECORD_RULES
    m = F.from_json(F.col("rule_settings"), "MAP<STRING,STRING>")
    return rules.filter((F.length(F.coalesce(F.col("rule_settings"), F.lit(""))) > 0)
                        & ~F.coalesce(F.map_contains_key(m, "table"), F.lit(False))
                        & F.coalesce(F.map_contains_key(m, "columns"), F.lit(False))
                        & F.col("rule_ref").isin(*RECORD_RULES))


def evaluate_record_rules(records: DataFrame, rules: DataFrame, id_col: str = "id") -> DataFrame:
    """K2 at definition grain: every distinct record-mode definition applied to
    every record, all of them in one projection and one scan of the records. Rows:
    ``(rule_ref, rule_settings, record_id, assertion, column, success, state, msg)``.
    A definition that cannot be read (unknown column, bad pattern) gives one failed
    row without a record."""
    from .records import RECORD_RULES
    spark = records.sparkSession
    defs = [Definition(r["rule_ref"], r["rule_settings"])
            for r in record_rules(rules).select("rule_ref", "rule_settings").distinct().collect()]
    cells, failed = [], []
    for d in sorted(defs, key=lambda x: (x.rule_ref, x.settings)):
        try:
            own = []
            for c in d.s["columns"].split(";"):
                ok = RECORD_RULES[d.rule_ref](c, d.s)
                records.select(ok)
                own.append(F.struct(F.lit(d.rule_ref).alias("rule_ref"), F.lit(d.settings).alias("rule_settings"),
                                    F.lit(C.bare_name(c)).alias("column"), ok.alias("success")))
            if d.s.get("regex") is not None:  # a pattern is a literal: compile it now
                spark.sql("select '' rlike :p", {"p": d.s["regex"]}).collect()
            cells += own
        except Exception as e:
            failed.append((d.rule_ref, d.settings, None, d.rule_ref, None, False, X.STATE_ERROR, _error_text(e)))
    out = spark.createDataFrame(failed, f"rule_ref string, rule_settings string, record_id {records.schema[id_col].dataType.simpleString()}, "
                                "assertion string, column string, success boolean, state string, msg string")
    if not cells:
        return out
    applied = records.select(F.col(C.quote_ident(id_col)).alias("record_id"), F.explode(F.array(*cells)).alias("a")).select(
        "a.rule_ref", "a.rule_settings", "record_id", F.col("a.rule_ref").alias("assertion"), "a.column", "a.success",
        F.when(F.col("a.success"), X.STATE_OK).otherwise(X.STATE_ERROR).alias("state"),
        X.template(X.MSG_RECORD_ID, id=F.col("record_id")).alias("msg"))
    return applied.unionByName(out) if failed else applied


def run_record_rules(records: DataFrame, rules: DataFrame, id_col: str = "id",
                     rule_id_col: str = "entity_sample_to_dq_rule_id") -> DataFrame:
    """K2 per binding: one assertion per (rule, record, column), state 2 on
    success else 0, the message carrying the record id (the reference's
    per-record run for an asset). Definitions are evaluated once; bindings
    join back by definition, so use it on an asset's rules, not a whole catalog."""
    bindings = record_rules(rules).select(F.col(rule_id_col).cast("string").alias("rule_id"),
                                          "rule_ref", "rule_settings").distinct()
    out = evaluate_record_rules(records, rules, id_col)
    return bindings.join(out, ["rule_ref", "rule_settings"], "inner").drop("rule_settings")
