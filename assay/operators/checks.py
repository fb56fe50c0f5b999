"""Table-level checks compiled to fused aggregates.

Every check returns assertion rows
``(assertion, column, success, state, msg, n_bad)``; a caller adds ``rule_id``.
All count-style checks over one table share one scan and one ``agg``; the
duplicate finder needs one shuffle for all its columns together.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import expressions as X

ASSERTION_FIELDS = ("assertion", "column", "success", "state", "msg", "n_bad")

_LITERAL = (r"(?:[+-]?(?:\d+(?:\.\d*)?|\.\d+)(?:e[+-]?\d+)?|(?:(?:date|timestamp)\s*)?'(?:[^']|'')*'|true|false|null)")
_LIST = rf"\(\s*{_LITERAL}(?:\s*,\s*{_LITERAL})*\s*\)"
#: What may follow the column: a list, or one comparison with literals.
_IN_LIST = re.compile(rf"(not\s+)?(?:in\s*)?({_LIST})", re.IGNORECASE)
_COMPARISON = re.compile(
    rf"(?:(?:=|==|<>|!=|<=|>=|<|>|<=>)\s*{_LITERAL}|(?:not\s+)?in\s*{_LIST}|(?:not\s+)?between\s+{_LITERAL}\s+and\s+{_LITERAL}"
    rf"|(?:not\s+)?r?like\s+'(?:[^']|'')*'|is\s+(?:not\s+)?null)", re.IGNORECASE)


def quote_ident(name: str) -> str:
    """Column name from settings text to a Spark identifier (``"X"`` -> `` `X` ``)."""
    n = name.strip()
    if len(n) >= 2 and n[0] == n[-1] == '"':
        n = n[1:-1]
    return "`" + n.replace("`", "``") + "`"


def bare_name(name: str) -> str:
    n = name.strip()
    return n[1:-1] if len(n) >= 2 and n[0] == n[-1] == '"' else n


def range_predicate(column: str, rng: str) -> Column:
    """Text with ``(`` is an IN list, otherwise the text follows the column
    (``> 5``, ``between 1 and 9``). The text is parsed: only literals compared
    with that column are accepted, no other column, operator or query."""
    r = rng.strip()
    if m := _IN_LIST.fullmatch(r):
        return F.expr(f"{quote_ident(column)} {m[1] or ''}IN {m[2]}")
    if not _COMPARISON.fullmatch(r):
        raise ValueError(f"range must compare its column with literals: {rng!r}")
    return F.expr(f"{quote_ident(column)} {r}")


_LITERAL_RX = re.compile(_LITERAL, re.IGNORECASE)


def _literal_kind(text: str) -> str:
    t = text.lower()
    if t.startswith("timestamp"):
        return "timestamp"
    if t.startswith("date"):
        return "date"
    return "text" if t.startswith("'") else t if t == "null" else "boolean" if t in ("true", "false") else "number"


def _common_type(column_type: T.DataType, kinds: set[str]) -> tuple[str | None, set[str]]:
    """The type in which a column and literals of ``kinds`` are compared (None: as they are), and which sides must be read into it."""
    if isinstance(column_type, T.StringType):
        for kind, to in (("number", "double"), ("timestamp", "timestamp_ntz"), ("date", "date"), ("boolean", "boolean")):
            if kind in kinds:
                return to, {"column", "text"}
    elif "text" in kinds:
        if isinstance(column_type, T.NumericType):
            return "double", {"text"}
        if isinstance(column_type, (T.DateType, T.TimestampType, T.TimestampNTZType, T.BooleanType)):
            return column_type.simpleString(), {"text"}
    return None, set()


def guarded_range(column: str, rng: str, column_type: T.DataType) -> tuple[Column, Column | None]:
    """B4 that cannot fail on a value: the predicate, null where a value or literal cannot be read as what it is compared
    with, and whether that is so in a row (None if it never can be)."""
    plain = range_predicate(column, rng)
    r = rng.strip()
    if re.search(r"\br?like\s", r, re.IGNORECASE):
        return plain, None
    literals = _LITERAL_RX.findall(r)
    to, read = _common_type(column_type, {_literal_kind(x) for x in literals})
    if to is None or not literals:
        return plain, None
    name = quote_ident(column)
    subject = f"try_cast({name} as {to})" if "column" in read else name
    typed = [f"try_cast({x} as {to})" if _literal_kind(x) == "text" else x for x in literals]
    if m := _IN_LIST.fullmatch(r):
        text = f"{subject} {m[1] or ''}IN ({', '.join(typed)})"
    else:
        left = iter(typed)
        text = f"{subject} {_LITERAL_RX.sub(lambda _: next(left), r)}"
    unread = [f"({name} is not null and {subject} is null)"] if "column" in read else []
    unread += [f"{x} is null" for x, given in zip(typed, literals) if x != given]
    return F.expr(text), F.expr(" or ".join(unread)) if unread else None


def violation(pred: Column) -> Column:
    """A row violates when the predicate is false; null is not a violation."""
    return F.coalesce(~pred, F.lit(False))


@dataclass
class TableChecks:
    """Checks bound to one table; compiled into one aggregate."""
    table: str
    nulls: list[str] = field(default_factory=list)
    ranges: list[tuple[str, str]] = field(default_factory=list)
    row_counts: list[int] = field(default_factory=list)

    def aggregates(self, schema: T.StructType) -> list[Column]:
        """Counts per check; a range check that may meet unreadable values counts those apart (``_err``)."""
        types = {f.name.lower(): f.dataType for f in schema.fields}
        aggs = [F.count(F.lit(1)).alias("_rows")]
        for i, c in enumerate(self.nulls):
            aggs.append(F.count_if(F.col(quote_ident(c)).isNull()).alias(f"_null{i}"))
        for i, (c, r) in enumerate(self.ranges):
            pred, unread = guarded_range(c, r, types.get(bare_name(c).lower(), T.NullType()))
            aggs.append(F.count_if(violation(pred)).alias(f"_range{i}"))
            aggs.append((F.count_if(unread) if unread is not None else F.any_value(F.lit(0).cast("long"))).alias(f"_err{i}"))
        return aggs


def _rows(metrics: DataFrame, structs: list[Column]) -> DataFrame:
    return metrics.select(F.explode(F.array(*structs)).alias("a")).select("a.*")


def fused_counts(df: DataFrame, checks: TableChecks) -> DataFrame:
    """One scan, one ``agg``: null counts, range violations and the row count.

    Returns per-column rows ``(kind, column, range, n_bad, n_err, rows)`` in the order
    the checks were declared (``pos``); ``n_err`` counts the values that a range cannot be
    applied to.
    """
    m = df.agg(*checks.aggregates(df.schema))
    none = F.lit(0).cast("long").alias("n_err")
    structs = []
    pos = 0
    for i, c in enumerate(checks.nulls):
        structs.append(F.struct(F.lit(pos).alias("pos"), F.lit("nulls").alias("kind"),
                                F.lit(bare_name(c)).alias("column"), F.lit(None).cast("string").alias("range"),
                                F.col(f"_null{i}").alias("n_bad"), none, F.col("_rows").alias("rows")))
        pos += 1
    for i, (c, r) in enumerate(checks.ranges):
        structs.append(F.struct(F.lit(pos).alias("pos"), F.lit("range").alias("kind"),
                                F.lit(bare_name(c)).alias("column"), F.lit(r.strip()).alias("range"),
                                F.col(f"_range{i}").alias("n_bad"), F.coalesce(f"_err{i}", F.lit(0)).alias("n_err"),
                                F.col("_rows").alias("rows")))
        pos += 1
    for n in checks.row_counts:
        structs.append(F.struct(F.lit(pos).alias("pos"), F.lit("row_count").alias("kind"),
                                F.lit("*").alias("column"), F.lit(str(n)).alias("range"),
                                F.col("_rows").alias("n_bad"), none, F.col("_rows").alias("rows")))
        pos += 1
    return _rows(m, structs)


# ---- range ------------------------------------------------------------------

def range_check(df: DataFrame, columns: list[str], ranges: list[str], table: str = "") -> DataFrame:
    """One assertion per (column, range) pair; pairs beyond the shorter list are ignored."""
    pairs = list(zip(columns, ranges))
    rows = fused_counts(df, TableChecks(table, ranges=pairs))
    ok = (F.col("n_bad") == 0) & (F.col("n_err") == 0)
    return rows.select(
        F.lit("check_range").alias("assertion"), "column", "range",
        ok.alias("success"),
        F.when(ok, X.STATE_OK).otherwise(X.STATE_ERROR).alias("state"),
        F.when(ok, F.lit(""))
         .when(F.col("n_err") > 0, X.template(X.MSG_UNREADABLE, column=F.col("column"), count=F.col("n_err"), range=F.col("range")))
         .otherwise(X.template(X.MSG_RANGE, column=F.col("column"), count=F.col("n_bad"), range=F.col("range")))
         .alias("msg"),
        "n_bad", "pos")


# ---- nulls ------------------------------------------------------------------

def null_check(df: DataFrame, columns: list[str], table: str = "") -> DataFrame:
    """One assertion per column with its null count."""
    rows = fused_counts(df, TableChecks(table, nulls=list(columns)))
    ok = F.col("n_bad") == 0
    return rows.select(
        F.lit("check_null_values").alias("assertion"), "column",
        ok.alias("success"),
        F.when(ok, X.STATE_OK).otherwise(X.STATE_ERROR).alias("state"),
        F.when(ok, F.lit("")).otherwise(X.template(X.MSG_NULLS, column=F.col("column"), count=F.col("n_bad")))
         .alias("msg"),
        "n_bad", "pos")


# ---- row count ----------------------------------------------------------------

def row_count_check(df: DataFrame, expected: int, path: str) -> DataFrame:
    """Count compared as a number (the reference compared text)."""
    rows = fused_counts(df, TableChecks(path, row_counts=[int(expected)]))
    ok = F.col("rows") == F.lit(int(expected))
    return rows.select(
        F.lit("count_equal").alias("assertion"), "column",
        ok.alias("success"),
        F.when(ok, X.STATE_OK).otherwise(X.STATE_ERROR).alias("state"),
        F.when(ok, X.template(X.MSG_COUNT_EQ, path=path, count=str(expected)))
         .otherwise(X.template(X.MSG_COUNT_NE, path=path, count=str(expected))).alias("msg"),
        F.col("rows").alias("n_bad"), "pos")


# ---- uniqueness ----------------------------------------------------------------

def _stacked(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value) pairs of all listed columns, values as text; one row per input cell."""
    cells = [F.struct(F.lit(i).alias("pos"), F.lit(bare_name(c)).alias("column"),
                      F.col(quote_ident(c)).cast("string").alias("value")) for i, c in enumerate(columns)]
    return df.select(F.explode(F.array(*cells)).alias("c")).select("c.*")


def duplicate_groups(df: DataFrame, columns: list[str]) -> DataFrame:
    """Every non-null value occurring more than once, per column.

    All columns go through one shuffle keyed by (column, value); the partial
    aggregate before the shuffle collapses a hot value to one row per task.
    """
    return (_stacked(df, columns).filter(F.col("value").isNotNull())
            .groupBy("pos", "column", "value").agg(F.count(F.lit(1)).alias("count"))
            .filter(F.col("count") > 1))


def uniqueness_metrics(df: DataFrame, columns: list[str]) -> DataFrame:
    """Per listed column: number of duplicated values and the smallest one with
    its count; columns without duplicates get ``n_bad = 0``."""
    spark = df.sparkSession
    groups = duplicate_groups(df, columns)
    per_col = groups.groupBy("pos", "column").agg(
        F.count(F.lit(1)).alias("n_bad"), F.min(F.struct("value", "count")).alias("first"))
    names = spark.range(1).select(F.explode(F.array(*[
        F.struct(F.lit(i).alias("pos"), F.lit(bare_name(c)).alias("column")) for i, c in enumerate(columns)
    ])).alias("c")).select("c.*")
    # per_col has at most one row per listed column: a proven bound for the broadcast
    j = names.join(F.broadcast(per_col), ["pos", "column"], "left")
    return j.select("pos", "column", F.coalesce(F.col("n_bad"), F.lit(0)).cast("long").alias("n_bad"),
                    F.col("first.value").alias("first_value"), F.col("first.count").alias("first_count"))


def uniqueness_check(df: DataFrame, columns: list[str], table: str = "") -> DataFrame:
    """One assertion per column; the message names the smallest duplicated value
    (text order) and its count; ``n_bad`` is the number of duplicated values."""
    m = uniqueness_metrics(df, columns)
    ok = F.col("n_bad") == 0
    return m.select(
        F.lit("check_uniqueness").alias("assertion"), "column",
        ok.alias("success"),
        F.when(ok, X.STATE_OK).otherwise(X.STATE_ERROR).alias("state"),
        F.when(ok, F.lit("")).otherwise(X.template(X.MSG_DUPLICATE, value=F.col("first_value"),
                                                   count=F.col("first_count"), column=F.col("column")))
         .alias("msg"),
        "n_bad", "pos")


# ---- column average (D7) -------------------------------------------------------

def column_average(df: DataFrame, column: str) -> DataFrame:
    """One-row average of a column (the table is a parameter, not hard-coded)."""
    return df.agg(F.avg(F.col(quote_ident(column)).cast("double")).alias("avg"))
