"""Property tests against plain-Python brute force: recursion on random run
forests, fused table checks on random data with nulls."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from assay.operators import checks as C
from assay.operators import runs as RN

T0 = dt.datetime(2024, 1, 1)


def _forest(seed, n=120):
    rnd = random.Random(seed)
    rows, parent = [], {}
    for r in range(1, n + 1):
        p = None if r <= 3 or rnd.random() < 0.1 else rnd.randint(max(1, r - 30), r - 1)
        parent[r] = p
        prod = "DQ tool" if rnd.random() < 0.2 else "etl"
        rows.append((r * 10, r, p, "START", T0, prod, None, None))
        if rnd.random() < 0.8:  # some runs miss their COMPLETE
            end = T0 + dt.timedelta(days=rnd.randint(0, 30)) if p is None else None
            rows.append((r * 10 + 2, r, p, "COMPLETE", T0, "etl", end, T0 if end else None))
    return rows, parent


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_deadline_and_leaf_match_brute_force(spark, seed):
    rows, parent = _forest(seed)
    log = spark.createDataFrame(rows, "id long, run_id long, parent_run_id long, event_type string, "
                                      "event_time timestamp_ntz, producer string, nominal_end_time timestamp_ntz, "
                                      "nominal_start_time timestamp_ntz")
    complete = {r[1]: r for r in rows if r[3] == "COMPLETE"}

    def deadline(run):
        while True:
            c = complete.get(run)
            if c is None:
                return None
            if c[2] is None:
                return c[6]
            run = c[2]
    got = {r["run_id"]: r["based_end_time"] for r in RN.inherited_deadline(log).collect()}
    assert got == {r: deadline(r) for r in complete}
    asked = spark.createDataFrame([(r,) for r in list(parent)[::3]] + [(None,), (10_000,)], "run_id long")
    part = {r["run_id"]: r["based_end_time"] for r in RN.deadlines_for(log, asked).collect()}
    assert part == {**{r: deadline(r) for r in list(parent)[::3]}, 10_000: None}

    starts = {r[1]: r for r in rows if r[3] == "START"}
    children = {}
    for r, s in starts.items():
        if s[2] is not None and s[5] != "DQ tool":
            children.setdefault(s[2], []).append(r)

    def leaf(run):
        while run in children:
            run = min(children[run])
        return run
    got_leaf = {r["run_id"]: r["leaf_run_id"] for r in RN.chain_leaf(log).collect()}
    assert got_leaf == {r: leaf(r) for r in starts}


@pytest.mark.parametrize("seed", [7, 8])
def test_fused_checks_match_brute_force(spark, seed):
    rnd = random.Random(seed)
    data = [(rnd.choice([None, 1, 2, 3, 4, 5]), rnd.choice([None, "A", "N", "R"])) for _ in range(300)]
    df = spark.createDataFrame(data, "q int, f string")
    rng = {r["column"]: r["n_bad"] for r in C.range_check(df, ["q", "f"], ["between 2 and 4", "('A','N')"]).collect()}
    assert rng["q"] == sum(1 for q, _ in data if q is not None and not 2 <= q <= 4)
    assert rng["f"] == sum(1 for _, f in data if f is not None and f not in ("A", "N"))
    nul = {r["column"]: r["n_bad"] for r in C.null_check(df, ["q", "f"]).collect()}
    assert nul == {"q": sum(q is None for q, _ in data), "f": sum(f is None for _, f in data)}
    dup = {(r["column"], r["value"]): r["count"] for r in C.duplicate_groups(df, ["q", "f"]).collect()}
    want = {}
    for q, f in data:
        for col, v in (("q", q), ("f", f)):
            if v is not None:
                want[(col, str(v))] = want.get((col, str(v)), 0) + 1
    assert dup == {k: v for k, v in want.items() if v > 1}
    summ = {r["column"]: (r["n_bad"], r["msg"]) for r in C.uniqueness_check(df, ["q", "f"]).collect()}
    for col in ("q", "f"):
        vals = sorted(v for (c, v), n in want.items() if c == col and n > 1)
        assert summ[col][0] == len(vals)
        assert f'"{vals[0]}" ' in summ[col][1]


@pytest.mark.parametrize("seed", [11, 12])
def test_pipeline_names_match_brute_force(spark, seed):
    rnd = random.Random(seed)
    n = 60
    runs = []
    for r in range(1, n + 1):
        p = None if r <= 3 or rnd.random() < 0.1 else rnd.randint(max(1, r - 15), r - 1)
        runs.append((r * 10, r, p, "START", T0, "DQ tool" if rnd.random() < 0.2 else "etl", None, None))
    log = spark.createDataFrame(runs, "id long, run_id long, parent_run_id long, event_type string, "
                                      "event_time timestamp_ntz, producer string, nominal_end_time timestamp_ntz, "
                                      "nominal_start_time timestamp_ntz")
    assets = {a: (rnd.choice([None, 1, 2, 3]), rnd.choice([None, 100 + a])) for a in range(1, 40)}
    systems = {1: "S1", 2: "S2"}          # system 3 is missing
    entities = {100 + a: f"E{a}" for a in range(1, 40) if a % 4}  # some entities missing
    ins = [(r * 10, str(rnd.randint(1, 45)), "in") for r in range(1, n + 1) for _ in range(rnd.randint(0, 2))]
    outs = [(r * 10, str(rnd.randint(1, 45)), "out") for r in range(1, n + 1) for _ in range(rnd.randint(0, 2))]
    mk = lambda rows: spark.createDataFrame(rows, "ol_id long, ns string, name string")
    da = spark.createDataFrame([(a, s, e) for a, (s, e) in assets.items()], "id long, system_id long, entity_id long")
    sy = spark.createDataFrame(list(systems.items()), "id long, name string")
    en = spark.createDataFrame(list(entities.items()), "id long, name string")
    got = {r["run_id"]: r["full_name"] for r in RN.pipeline_names(log, mk(ins), mk(outs), da, sy, en).collect()}

    def label(ns):
        a = assets.get(int(ns))
        if a is None or a[1] not in entities:
            return None
        return f"{entities[a[1]]} ({systems.get(a[0], '')})"
    prod = {r[1]: r[5] for r in runs}
    children = {}
    for _, r, p, *_rest in runs:
        if p is not None and prod[r] != "DQ tool":
            children.setdefault(p, []).append(r)

    def leaf(r):
        while r in children:
            r = min(children[r])
        return r

    def name(r):
        first = min((lab for e, ns, _ in ins if e == r * 10 for lab in [label(ns)] if lab), default=None)
        lf = leaf(r)
        last = None
        if prod[lf] != "DQ tool":
            last = min((lab for e, ns, _ in outs if e == lf * 10 for lab in [label(ns)] if lab), default=None)
        res = first or ""
        return res if last is None else f"{res} - {last}"
    assert got == {r: name(r) for r in range(1, n + 1)}


@pytest.mark.parametrize("seed", [21, 22])
def test_monitor_states_match_brute_force(spark, seed):
    from assay.operators import monitor as M
    rnd = random.Random(seed)
    events = []
    for r in range(1, 50):
        p = None if r <= 3 else rnd.randint(1, r - 1)
        for k, et in enumerate(["START", "RUNNING", "COMPLETE", "FAIL"]):
            if k == 0 or rnd.random() < 0.5:
                events.append((r * 10 + k, r, p, et, T0, "etl", None, None))
    ids = [e[0] for e in events]
    asr = [(rnd.choice(ids + [99999]), rnd.choice(["0", "1", "2"]), rnd.choice([None, "a", "b", "c"]))
           for _ in range(150)]
    log = spark.createDataFrame(events, "id long, run_id long, parent_run_id long, event_type string, "
                                        "event_time timestamp_ntz, producer string, nominal_end_time timestamp_ntz, "
                                        "nominal_start_time timestamp_ntz")
    a = spark.createDataFrame(asr, "ol_id long, state string, msg string")
    got = {r["id"]: (r["state"], r["state_local"], r["assertion_msg"])
           for r in M.monitor_runs(log, a, materialize=False).collect()}
    by_id = {e[0]: e for e in events}
    want = {}
    for e in events:
        if e[3] != "START":
            continue
        child_ids = {x[0] for x in events if x[2] == e[1]}
        run_ids = {x[0] for x in events if x[1] == e[1]}
        st = min((s for o, s, _ in asr if o == e[0] or o in child_ids), default=None)
        loc = min((s for o, s, _ in asr if o in run_ids), default=None)
        msgs = [m for o, s, m in asr if m is not None and ((o == e[0] and s == st) or o in child_ids)]
        want[e[0]] = (st, loc, min(msgs, default=None))
    assert by_id and got == want
