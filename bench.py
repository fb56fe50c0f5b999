"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query is materialized in full through the noop sink (no collect to the
driver). Prints one JSON line: total seconds plus seconds per query.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "chk_range",            # minimum slice: fused range aggregate
    "chk_unique_summary",   # one shuffle for all uniqueness columns
    "chk_nulls",
    "rec_regex",
    "msg_avg_deviation",
    "cat_regular",          # ten-table catalog join
    "cat_schedule",
    "suite_fused",          # rule runner over the catalog
    "suite_dq_log",
    "mon_runs",             # flagship: decorrelated monitor + pipeline names
    "mon_datasets",
    "mon_assertions",
    "run_deadline",         # pointer-jumping recursion
    "run_timeliness",
    "run_pipeline_name",
    "run_islands",          # distributed gaps and islands
    "ev_roundtrip_runs",    # build -> JSON -> parse -> shred
    "ev_validate",
    "task_due",             # cron next fire
    "task_next_fire",
    "prof_columns",
    "stream_presence",      # structured streaming, availableNow
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from assay.plans import registry
    from assay.session import get_session

    spark = get_session(f"local[{cpus}]", app="assay-bench", shuffle_partitions=int(cpus) * 2,
                        extra={"spark.driver.memory": os.environ.get("BENCH_DRIVER_MEMORY", "16g")})
    registry.load_all()
    spark.range(1).count()  # session start-up is not part of any query
    names = [n for n in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",") if n]
    times: dict[str, float] = {}
    for name in names:
        t0 = time.perf_counter()
        df = registry.QUERIES[name](spark, sf_dir)
        df.write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": sf}))


if __name__ == "__main__":
    main()
