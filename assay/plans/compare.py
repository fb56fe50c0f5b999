"""Compare a Spark result with a DuckDB oracle: row count, column names and an
order-insensitive hash of normalized values."""

from __future__ import annotations

import datetime as dt
import decimal
import hashlib
import math

from pyspark.sql import DataFrame

DRIVER_VIEWS = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
                "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def _norm(v):
    if v is None:
        return "∅"
    if isinstance(v, bool):
        return "T" if v else "F"
    if isinstance(v, (int,)):
        return str(v)
    if isinstance(v, (float, decimal.Decimal)):
        f = float(v)
        if math.isnan(f):
            return "NaN"
        if f == int(f) and abs(f) < 1e15:
            return str(int(f))
        return f"{f:.6g}" if abs(f) >= 1e6 else f"{round(f, 6):.6f}".rstrip("0").rstrip(".")
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat(sep=" ")
    if isinstance(v, dt.date):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(_norm(x) for x in v) + "]"
    if isinstance(v, dict):
        return "{" + ",".join(f"{k}:{_norm(x)}" for k, x in sorted(v.items())) + "}"
    return str(v)


def digest(columns: list[str], rows: list[tuple]) -> tuple[int, str]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    lines = sorted("\x1f".join(_norm(r[i]) for i in order) for r in rows)
    h = hashlib.sha256("\n".join(lines).encode()).hexdigest()
    return len(lines), h


def duckdb_connection(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    for t in DRIVER_VIEWS:
        con.sql(f"create view {t} as select * from read_parquet('{sf_dir.rstrip('/')}/{t}.parquet')")
    return con


def compare(df: DataFrame, con, sql: str) -> dict:
    s_cols = df.columns
    s_rows = [tuple(r) for r in df.collect()]
    rel = con.sql(sql)
    o_cols = list(rel.columns)
    o_rows = rel.fetchall()
    n1, h1 = digest(s_cols, s_rows)
    n2, h2 = digest(o_cols, o_rows)
    return {"rows_spark": n1, "rows_oracle": n2, "schema_match": sorted(s_cols) == sorted(o_cols),
            "value_match": h1 == h2, "spark_cols": s_cols, "oracle_cols": o_cols,
            "_spark_rows": s_rows, "_oracle_rows": o_rows}


def diff_rows(res: dict, limit: int = 5) -> tuple[list, list]:
    """Rows present on one side only (normalized), for debugging."""
    sc, oc = res["spark_cols"], res["oracle_cols"]
    so = sorted(range(len(sc)), key=lambda i: sc[i])
    oo = sorted(range(len(oc)), key=lambda i: oc[i])
    a = {"|".join(_norm(r[i]) for i in so) for r in res["_spark_rows"]}
    b = {"|".join(_norm(r[i]) for i in oo) for r in res["_oracle_rows"]}
    return sorted(a - b)[:limit], sorted(b - a)[:limit]
