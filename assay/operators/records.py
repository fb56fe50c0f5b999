"""Record-level and message-level checks.

A record check is a boolean column per (record, column); assertions are the
rows of an ``explode`` over an array of structs, so the work stays inside one
projection of the input DataFrame.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import expressions as X
from .checks import bare_name, quote_ident

MESSAGE_MAP = "MAP<STRING,STRING>"


def not_null(column: str) -> Column:
    """B1: ``value != None``; NaN and empty text pass."""
    return F.col(quote_ident(column)).isNotNull()


def matches(column: str, regex: str | None) -> Column:
    """B2: unanchored regex search (Java dialect); no regex -> failure; null value -> failure."""
    if regex is None:
        return F.lit(False)
    return F.coalesce(F.col(quote_ident(column)).cast("string").rlike(regex), F.lit(False))


RECORD_RULES = {"not_null": lambda c, s: not_null(c),
                "check_condition": lambda c, s: matches(c, s.get("regex"))}


def record_assertions(df: DataFrame, rule_ref: str, columns: list[str], settings: dict,
                      id_col: str | None = "id", keep: tuple[str, ...] = ()) -> DataFrame:
    """K2: one assertion per record and column: state 2 on success, else 0;
    the message carries the record id when the record has one."""
    build = RECORD_RULES[rule_ref]
    has_id = id_col is not None and id_col in df.columns
    msg = X.template(X.MSG_RECORD_ID, id=F.col(quote_ident(id_col))) if has_id else F.lit(None).cast("string")
    cells = [F.struct(F.lit(bare_name(c)).alias("column"), build(c, settings).alias("success"))
             for c in columns]
    out = df.select(*[F.col(quote_ident(k)) for k in keep], msg.alias("msg"),
                    F.explode(F.array(*cells)).alias("a"))
    return out.select(*keep, F.lit(rule_ref).alias("assertion"), "a.column", "a.success",
                      F.when(F.col("a.success"), X.STATE_OK).otherwise(X.STATE_ERROR).alias("state"), "msg")


# ---- messages --------------------------------------------------------------

def parse_message(value: Column) -> Column:
    """JSON object as a text map: key presence survives a null value,
    nested objects arrive as text, malformed text gives null."""
    return F.from_json(value, MESSAGE_MAP)


def split_valid(df: DataFrame, value_col: str = "value") -> tuple[DataFrame, DataFrame]:
    """Parsed messages and rejected (unparseable) ones."""
    p = df.withColumn("_m", parse_message(F.col(value_col)))
    return p.filter(F.col("_m").isNotNull()), p.filter(F.col("_m").isNull()).drop("_m")


def presence_assertions(parsed: DataFrame, fields: list[str], key_col: Column | None = None,
                        keep: tuple[str, ...] = ()) -> DataFrame:
    """Field presence per message (``key in object``), one row per field."""
    key = key_col if key_col is not None else F.col("_m")["key"]
    cells = [F.struct(F.lit(f).alias("column"), F.map_contains_key("_m", f).alias("success")) for f in fields]
    out = parsed.select(*keep, key.alias("_key"), F.explode(F.array(*cells)).alias("a"))
    ok = F.col("a.success")
    return out.select(
        *keep, F.lit("not_null").alias("assertion"), "a.column", ok.alias("success"),
        F.when(ok, X.STATE_OK).otherwise(X.STATE_ERROR).alias("state"),
        F.when(ok, F.lit(None).cast("string"))
         .otherwise(X.template(X.MSG_FIELD_MISSING, field=F.col("a.column"), key=F.col("_key"))).alias("msg"))


def parse_thresholds(spec: str) -> list[tuple[str, float, float]]:
    """H2: ``field|warning|error;...`` into (field, warning %, error %)."""
    out = []
    for part in spec.split(";"):
        f, w, e = part.split("|")[:3]
        out.append((f.strip(), float(w), float(e)))
    return out


def deviation_assertions(parsed: DataFrame, averages: DataFrame, spec: list[tuple[str, float, float]],
                         key_col: Column | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Each message value against the current table average.

    ``averages`` is a one-row aggregate with one ``avg_<field>`` column per
    field; each enters as a scalar subquery (computed once, no join).
    Non-numeric or missing values and a zero average give a null state.
    """
    key = key_col if key_col is not None else F.col("_m")["key"]
    cells = []
    for f, w, e in spec:
        avg = averages.select(f"avg_{f}").scalar()
        v = F.col("_m")[f].try_cast("double")
        pct = X.deviation_pct(v, avg)
        cells.append(F.struct(F.lit(f).alias("column"), v.alias("v"), pct.alias("pct"),
                              X.threshold_state(pct, F.lit(w), F.lit(e)).alias("state")))
    out = parsed.select(*keep, key.alias("_key"), F.explode(F.array(*cells)).alias("a"))
    st = F.col("a.state")
    return out.select(
        *keep, F.lit("check_avg").alias("assertion"), "a.column", F.col("a.v").alias("value"),
        F.col("a.pct").alias("pct"), (st == X.STATE_OK).alias("success"), st.alias("state"),
        X.template(X.MSG_AVG_DEVIATION, field=F.col("a.column"),
                   pct=F.bround(F.col("a.pct"), 0).cast("long"), key=F.col("_key")).alias("msg"))


def averages_for(df: DataFrame, fields: list[str]) -> DataFrame:
    """D7 for several fields in one aggregate."""
    return df.agg(*[F.avg(F.col(quote_ident(f)).cast("double")).alias(f"avg_{f}") for f in fields])


def regex_values(df: DataFrame, value_col: str, regex_col: str) -> Column:
    """Ad-hoc ``{value, regex} -> res`` as a column: unanchored search of a
    per-row pattern (Java dialect); a null value or pattern gives false."""
    return F.coalesce(F.regexp_like(F.col(quote_ident(value_col)).cast("string"), F.col(quote_ident(regex_col))),
                      F.lit(False))
