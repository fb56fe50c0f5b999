"""Run registered queries against their DuckDB oracles (sf0.01 by default).

usage: python tools/check_oracles.py [name-prefix ...]
"""
import importlib
import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from assay.plans import compare as CMP  # noqa: E402
from assay.plans import registry  # noqa: E402
from assay.session import get_session  # noqa: E402

MODULES = ["q_checks", "q_catalog", "q_suite", "q_monitor", "q_runs", "q_events", "q_schedule", "q_profile", "q_streaming", "q_io"]


def main(prefixes):
    for m in MODULES:
        try:
            importlib.import_module(f"assay.plans.{m}")
        except ModuleNotFoundError as e:
            if e.name != f"assay.plans.{m}":
                raise
    sf = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark = get_session("local[8]", shuffle_partitions=8)
    con = CMP.duckdb_connection(sf)
    bad = 0
    for name, fn in registry.QUERIES.items():
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        t = time.time()
        try:
            df = fn(spark, sf)
            if name in registry.ORACLE:
                r = CMP.compare(df, con, registry.ORACLE[name])
                ok = r["schema_match"] and r["value_match"] and r["rows_spark"] == r["rows_oracle"]
                print(json.dumps({"q": name, "ok": ok, "rows": [r["rows_spark"], r["rows_oracle"]],
                                  "schema": r["schema_match"], "sec": round(time.time() - t, 2)}), flush=True)
                if not ok:
                    bad += 1
                    if not r["schema_match"]:
                        print("   spark:", r["spark_cols"], "\n   oracle:", r["oracle_cols"])
                    else:
                        a, b = CMP.diff_rows(r)
                        print("   only spark:", a, "\n   only oracle:", b)
            else:
                n = df.count()
                print(json.dumps({"q": name, "ok": None, "rows": n, "sec": round(time.time() - t, 2)}), flush=True)
        except Exception as e:  # report and continue
            bad += 1
            print(json.dumps({"q": name, "error": str(e)[:800]}), flush=True)
    print("FAILED", bad)


if __name__ == "__main__":
    main(sys.argv[1:])
