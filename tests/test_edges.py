"""Null, missing-key and defect cases on tiny literal DataFrames."""

import datetime as dt
import math
import re

import pytest
from pyspark.sql import functions as F

from assay.functions import expressions as X
from assay.operators import checks as C
from assay.operators import events as EV
from assay.operators import profile as P
from assay.operators import records as R
from assay.operators import runs as RN
from assay.operators import schedule as SC


def test_not_in_skips_null(spark):
    df = spark.createDataFrame([("A",), ("B",), (None,)], "c string")
    r = C.range_check(df, ["c"], ["('A')"]).collect()[0]
    assert r["n_bad"] == 1 and not r["success"] and r["state"] == "0"


def test_range_rejects_subquery(spark):
    df = spark.createDataFrame([(1,)], "c int")
    with pytest.raises(ValueError):
        C.range_check(df, ["c"], ["in (select 1)"])


def test_unequal_columns_and_ranges_use_shorter(spark):
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    assert C.range_check(df, ["a", "b"], ["> 0"]).count() == 1
    assert C.range_check(df, ["a"], ["> 0", "> 5"]).count() == 1


def test_quoted_column_name(spark):
    df = spark.createDataFrame([(0,), (3,)], "ACTION int")
    r = C.range_check(df, ['"ACTION"'], ["(0,1,2)"]).collect()[0]
    assert r["column"] == "ACTION" and r["n_bad"] == 1


def test_not_null_passes_nan_and_empty(spark):
    df = spark.createDataFrame([(1, float("nan"), ""), (2, None, None)], "id long, x double, s string")
    rows = {(r["id"], r["column"]): r["success"]
            for r in R.record_assertions(df, "not_null", ["x", "s"], {}, keep=("id",)).collect()}
    assert rows[(1, "x")] and rows[(1, "s")]
    assert not rows[(2, "x")] and not rows[(2, "s")]


def test_regex_unanchored_null_and_missing(spark):
    df = spark.createDataFrame([(1, "xxCustomer#1"), (2, None)], "id long, s string")
    got = {r["id"]: r["success"] for r in
           R.record_assertions(df, "check_condition", ["s"], {"regex": "Customer#\\d"}, keep=("id",)).collect()}
    assert got == {1: True, 2: False}
    none = R.record_assertions(df, "check_condition", ["s"], {}, keep=("id",)).collect()
    assert not any(r["success"] for r in none)


def test_record_message_carries_id(spark):
    df = spark.createDataFrame([(7, "a")], "id long, s string")
    r = R.record_assertions(df, "not_null", ["s"], {}).collect()[0]
    assert r["msg"] == X.MSG_RECORD_ID.format(id=7)


def test_presence_is_key_not_value(spark):
    df = spark.createDataFrame([('{"key": 1, "a": null}',), ('{"key": 2}',), ("{bad",)], "value string")
    valid, bad = R.split_valid(df)
    assert bad.count() == 1
    rows = R.presence_assertions(valid, ["a"]).collect()
    by_key = {r["msg"] is None: r["success"] for r in rows}
    assert by_key == {True: True, False: False}


@pytest.mark.parametrize("avg, v, state", [(100.0, 100.0, "2"), (100.0, 160.0, "1"), (100.0, 200.0, "0"),
                                           (-100.0, -200.0, "0"), (0.0, 5.0, None)])
def test_deviation_states(spark, avg, v, state):
    msgs = spark.createDataFrame([(f'{{"key": 1, "x": {v}}}',)], "value string")
    valid, _ = R.split_valid(msgs)
    avgs = spark.createDataFrame([(avg,)], "avg_x double")
    r = R.deviation_assertions(valid, avgs, [("x", 50.0, 90.0)]).collect()[0]
    assert r["state"] == state


def test_half_even_rounding_in_message(spark):
    msgs = spark.createDataFrame([('{"key": 9, "x": 102.5}',)], "value string")
    valid, _ = R.split_valid(msgs)
    avgs = spark.createDataFrame([(100.0,)], "avg_x double")
    r = R.deviation_assertions(valid, avgs, [("x", 50.0, 90.0)]).collect()[0]
    assert "(2%, key - 9)" in r["msg"]  # 2.5 -> 2 (half even)


def test_duplicates_ignore_null_keys(spark):
    df = spark.createDataFrame([(None,), (None,), (1,), (1,), (2,)], "k int")
    g = C.duplicate_groups(df, ["k"]).collect()
    assert [(r["value"], r["count"]) for r in g] == [("1", 2)]
    s = C.uniqueness_check(df, ["k"]).collect()[0]
    assert s["n_bad"] == 1 and '"1"' in s["msg"]


def test_uniqueness_reports_columns_without_rows(spark):
    df = spark.createDataFrame([(None,)], "k int")
    s = C.uniqueness_check(df, ["k"]).collect()[0]
    assert s["success"] and s["state"] == "2"


def test_row_count_compared_as_number(spark):
    df = spark.range(3)
    assert C.row_count_check(df, 3, "p").collect()[0]["success"]
    assert not C.row_count_check(df, 4, "p").collect()[0]["success"]


def _run_log(spark, rows):
    return spark.createDataFrame(rows, "id long, run_id long, parent_run_id long, event_type string, "
                                       "event_time timestamp_ntz, producer string, nominal_end_time timestamp_ntz, "
                                       "nominal_start_time timestamp_ntz")


def test_deadline_missing_parent_complete_is_null(spark):
    t = dt.datetime(2024, 1, 1)
    log = _run_log(spark, [
        (1, 1, None, "COMPLETE", t, "etl", t + dt.timedelta(days=1), t),
        (2, 2, 1, "COMPLETE", t, "etl", None, None),
        (3, 3, 9, "COMPLETE", t, "etl", None, None),   # parent 9 has no COMPLETE
        (4, 4, 3, "COMPLETE", t, "etl", None, None),
    ])
    got = {r["run_id"]: r["based_end_time"] for r in RN.inherited_deadline(log).collect()}
    assert got == {1: t + dt.timedelta(days=1), 2: t + dt.timedelta(days=1), 3: None, 4: None}


def test_cycle_stops(spark):
    t = dt.datetime(2024, 1, 1)
    log = _run_log(spark, [(1, 1, 2, "COMPLETE", t, "etl", None, None),
                           (2, 2, 1, "COMPLETE", t, "etl", None, None)])
    nodes = log.select(F.col("run_id").alias("node"), F.col("parent_run_id").alias("ptr"),
                       F.lit(None).cast("timestamp_ntz").alias("value"), F.lit(False).alias("done"))
    got = RN.resolve_chains(nodes).collect()
    assert all(r["value"] is None and not r["done"] for r in got)


def test_timeliness_positive_seconds(spark):
    t = dt.datetime(2024, 1, 1)
    log = _run_log(spark, [(1, 1, None, "COMPLETE", t, "etl", t, t),
                           (2, 2, 1, "COMPLETE", t + dt.timedelta(seconds=90), "etl", None, None)])
    r = RN.timeliness_assertions(log).collect()
    assert len(r) == 1 and r[0]["state"] == "0" and "90.0" in r[0]["msg"]


def test_leaf_skips_checker_runs(spark):
    t = dt.datetime(2024, 1, 1)
    log = _run_log(spark, [(1, 1, None, "START", t, "etl", None, None),
                           (2, 2, 1, "START", t, "DQ tool", None, None),
                           (3, 3, 1, "START", t, "etl", None, None),
                           (4, 4, 3, "START", t, "etl", None, None)])
    got = {r["run_id"]: r["leaf_run_id"] for r in RN.chain_leaf(log).collect()}
    assert got[1] == 4 and got[2] == 2 and got[3] == 4


def _brute_islands(rows):
    out, prev, isl = [], None, 0
    for k, g in sorted(rows):
        if prev is None or g != prev:
            isl += 1
        out.append((k, isl))
        prev = g
    return out


@pytest.mark.parametrize("bucket", [1, 2, 3, 7, 1000])
def test_islands_match_brute_force(spark, bucket):
    import random
    rnd = random.Random(bucket)
    rows = [(k, rnd.choice([0, 0, 1, 2])) for k in rnd.sample(range(200), 120)]
    df = spark.createDataFrame(rows, "k long, g long")
    got = sorted((r["k"], r["island"]) for r in RN.run_islands(df, "k", "g", bucket).collect())
    assert got == _brute_islands(rows)


def _brute_next(cron_sets, t):
    mins, hours, doms, months, dows, dom_star, dow_star = cron_sets
    start = t.replace(second=0, microsecond=0) + dt.timedelta(minutes=1)
    day = start.replace(hour=0, minute=0)
    for _ in range(1500):
        dom_ok, dow_ok = day.day in doms, (day.isoweekday() % 7) in dows
        ok = (dom_ok and dow_ok) if (dom_star or dow_star) else (dom_ok or dow_ok)
        if ok and day.month in months:
            for m in range(24 * 60):  # every minute of a matching day
                c = day + dt.timedelta(minutes=m)
                if c >= start and c.hour in hours and c.minute in mins:
                    return c
        day += dt.timedelta(days=1)
    return None


CRONS = {
    "*/15 2-4 * * *": (set(range(0, 60, 15)), {2, 3, 4}, set(range(1, 32)), set(range(1, 13)), set(range(7)), True, True),
    "5 0 13 * 5": ({5}, {0}, {13}, set(range(1, 13)), {5}, False, False),
    "0 12 29 2 *": ({0}, {12}, {29}, {2}, set(range(7)), False, True),
    "30 6 1,15 */3 0": ({30}, {6}, {1, 15}, {1, 4, 7, 10}, {0}, False, False),
    "59 23 * * 7": ({59}, {23}, set(range(1, 32)), set(range(1, 13)), {0}, True, False),
}


@pytest.mark.parametrize("cron", sorted(CRONS))
def test_next_fire_matches_brute_force(spark, cron):
    times = [dt.datetime(2023, 12, 31, 23, 59), dt.datetime(2024, 2, 28, 12, 0, 30), dt.datetime(2024, 3, 1, 4, 45)]
    df = spark.createDataFrame([(cron, t) for t in times], "cron string, t timestamp_ntz")
    got = {r["t"]: r["n"] for r in SC.with_next_fire(df, F.col("cron"), F.col("t"), "n").collect()}
    for t in times:
        assert got[t] == _brute_next(CRONS[cron], t), (cron, t)


def test_bad_cron_gives_null(spark):
    df = spark.createDataFrame([("not a cron", dt.datetime(2024, 1, 1))], "cron string, t timestamp_ntz")
    assert SC.with_next_fire(df, F.col("cron"), F.col("t"), "n").collect()[0]["n"] is None


def test_upsert_replaces_by_key(spark):
    a = spark.createDataFrame([(1, 0), (2, 0)], "id long, state int")
    b = spark.createDataFrame([(2, 2), (3, 0)], "id long, state int")
    assert sorted(tuple(r) for r in SC.upsert(a, b, ["id"]).collect()) == [(1, 0), (2, 2), (3, 0)]


def test_float_text(spark):
    df = spark.createDataFrame([(100224000.0,), (0.5,), (1.25,)], "x double")
    assert [r[0] for r in df.select(X.float_text(F.col("x"))).collect()] == ["100224000.0", "0.5", "1.25"]


def test_event_time_fraction_optional(spark):
    df = spark.createDataFrame([("2024-01-01T00:00:00",), ("2024-01-01T00:00:00.123",),
                                ("2024-01-01T00:00:00.123456",), ("2024-01-01 00:00:00",)], "s string")
    got = [r[0] for r in df.select(X.parse_event_time(F.col("s"))).collect()]
    assert got[0] is not None and got[1] is not None and got[2] is not None and got[3] is None


def test_event_validation_and_missing_column(spark):
    good = ('{"eventTime":"2024-01-01T00:00:00.000000","eventType":"START","inputs":[{"facets":{"dataQuality":'
            '{"assertions":[{"assertion":"a","rule_id":"r","state":"2","success":true}]}},"name":"n",'
            '"namespace":"ns"}],"job":{"name":"j","namespace":"x"},"outputs":[],"producer":"p",'
            '"run":{"facets":{},"runId":"00000000-0000-0000-0000-000000000001"}}')
    rows = [(1, good), (2, good.replace("START", "NOPE")), (3, '{"eventType":"START"}'), (4, "[")]
    p = EV.parse_events(spark.createDataFrame(rows, "offset long, value string"))
    reasons = {r["offset"]: r["reason"] for r in p.select("offset", EV.validity_reason(F.col("ev")).alias("reason")).collect()}
    assert reasons == {1: None, 2: "bad eventType", 3: "no run", 4: "malformed"}
    a = EV.shred(p)["assertions"].collect()
    assert len(a) == 1 and a[0]["column"] is None


def test_filters_drop_on_match_run_events_only(spark):
    mk = lambda name: ('{"eventType":"START","job":{"name":"%s"},"run":{"runId":"x"}}' % name)
    rows = [(1, mk("exact")), (2, mk("pre_fix")), (3, mk("keep")), (4, '{"job":{"name":"exact"}}')]
    p = EV.parse_events(spark.createDataFrame(rows, "offset long, value string"))
    kept = EV.apply_filters(p, [{"type": "exact", "match": "exact"}, {"type": "regex", "regex": "pre"},
                                {"type": "unknown"}])
    assert sorted(r["offset"] for r in kept.collect()) == [3, 4]


def test_column_lineage_edges(spark):
    js = ('{"namespace":"o","name":"t","columnLineage":{"a":{"inputFields":[{"namespace":"i","name":"s","field":"x"},'
          '{"namespace":"i","name":"s","field":"y"}],"transformationType":"IDENTITY"}}}')
    schema = "namespace string, name string, columnLineage " + P.COLUMN_LINEAGE_T.simpleString()
    df = spark.read.schema(schema).json(spark.sparkContext.parallelize([js]))
    e = P.column_lineage_edges(df).collect()
    assert sorted(r["in_field"] for r in e) == ["x", "y"] and all(r["out_field"] == "a" for r in e)


def test_column_metrics_small(spark):
    df = spark.createDataFrame([(1.0, "a"), (None, "a"), (3.0, None)], "x double, s string")
    m = {r["column"]: r for r in P.column_metrics(df, ["x", "s"]).collect()}
    assert m["x"]["null_count"] == 1 and m["x"]["sum"] == 4.0 and m["x"]["distinct_count"] == 2
    assert m["s"]["sum"] is None and m["s"]["count"] == 2
    assert not math.isnan(m["x"]["max"])


def test_islands_per_source_partition(spark):
    import random
    rnd = random.Random(5)
    rows = [(p, k, rnd.choice([0, 1, 1, 2])) for p in (0, 1) for k in rnd.sample(range(300), 150)]
    df = spark.createDataFrame(rows, "p int, k long, g long")
    got = sorted((r["p"], r["k"], r["island"]) for r in
                 RN.run_islands(df, "k", "g", 16, partition_cols=("p",)).collect())
    want = sorted((p, k, i) for p in (0, 1)
                  for k, i in _brute_islands([(k, g) for q, k, g in rows if q == p]))
    assert got == want


def test_record_rules_from_catalog(spark):
    from assay.operators import suite as S
    rules = spark.createDataFrame([
        (1, "not_null", '{"columns":"a;b"}'),
        (2, "check_condition", '{"columns":"b","regex":"^x"}'),
        (3, "not_null", '{"table":"t","columns":"a"}'),      # table rule: skipped in record mode
        (4, "check_uniqueness", '{"columns":"a"}'),          # not a record rule
        (5, "not_null", ""),
    ], "entity_sample_to_dq_rule_id long, rule_ref string, rule_settings string")
    recs = spark.createDataFrame([(10, 1, "xy"), (11, None, "zz")], "id long, a int, b string")
    got = sorted((r["rule_id"], r["record_id"], r["column"], r["success"])
                 for r in S.run_record_rules(recs, rules).collect())
    assert got == [("1", 10, "a", True), ("1", 10, "b", True), ("1", 11, "a", False), ("1", 11, "b", True),
                   ("2", 10, "b", True), ("2", 11, "b", False)]


def test_events_are_parsed_once(spark):
    """However often ``ev`` is used, and its times and ids fit code that the JVM compiles."""
    rows = [(1, '{"eventTime":"2024-01-01T00:00:00.123456789+05:30","eventType":"START","run":{"runId":"' + "0" * 32 + '"},"inputs":[{"name":"a"}]}'),
            (2, None), (3, "{")]
    p = EV.parse_events(spark.createDataFrame(rows, "offset long, value string"))
    s = EV.shred(p)
    assert [(r["id"], str(r["event_time"]), r["run_id"]) for r in s["run_log"].collect()] == [
        (1, "2023-12-31 18:30:00.123456", "00000000-0000-0000-0000-000000000000")]
    assert sorted((r["offset"], r["type"]) for r in EV.rejected(p).collect()) == [(2, "malformed"), (3, "malformed")]
    for part in (*s.values(), EV.rejected(p)):
        qe = part._jdf.queryExecution()
        assert qe.optimizedPlan().toString().count("from_json(") == 1
        sizes = [int(x) for x in re.findall(r"maxMethodCodeSize:(\d+)", spark._jvm.org.apache.spark.sql.execution.debug.package.codegenString(qe.executedPlan()))]
        assert sizes and max(sizes) < 8000


def test_an_event_without_an_id_gets_no_parts(spark):
    log = spark.createDataFrame([(None, 1), (4, 2)], "id long, run_id long").selectExpr(
        "*", "cast(null as long) parent_run_id", "timestamp_ntz'2024-01-01' event_time", "'START' event_type", "'etl' producer",
        "cast(null as timestamp_ntz) nominal_start_time", "cast(null as timestamp_ntz) nominal_end_time")
    sets = spark.createDataFrame([("b", "2", 4), ("a", "1", 4), ("c", "3", None)], "name string, ns string, ol_id long")
    said = spark.createDataFrame([("x", "c", None, 1, "2", True, 4)], "assertion string, column string, msg string, rule_id long, state string, success boolean, ol_id long")
    got = {r["id"]: (r["ins"], r["outs"]) for r in EV.parse_events(EV.build_events(log, sets, sets, said, F.lit("j"))).select(
        F.col("offset").alias("id"), F.col("ev.inputs.name").alias("ins"), F.col("ev.outputs.name").alias("outs")).collect()}
    assert got == {None: ([], []), 4: (["a", "b", EV.CARRIER_NAME], ["a", "b"])}


def test_stored_validity_is_not_worked_out_again(spark, tmp_path):
    """shred and rejected take the reasons that lie beside parsed events, and agree with those worked out from the events."""
    value = ('{{"eventTime":"{t}","eventType":"START","inputs":[{{"name":"a","namespace":"b"}}],'
             '"run":{{"runId":"00000000-0000-0000-0000-000000000001"}}}}')
    rows = [(1, value.format(t="2024-01-01T00:00:00.5")), (2, value.format(t="2024-01-01 00:00:00")), (3, "{{"),
            (4, value.format(t="2024-01-01T00:00:00.000001\\n"))]
    parsed = EV.parse_events(spark.createDataFrame(rows, "offset long, value string"))
    parsed.withColumn("reason", EV.validity_reason(F.col("ev"))).write.parquet(f"{tmp_path}/parsed")
    stored = spark.read.parquet(f"{tmp_path}/parsed")
    for a, b in ((EV.shred(parsed)["inputs"], EV.shred(stored)["inputs"]), (EV.rejected(parsed), EV.rejected(stored))):
        assert sorted(a.collect()) == sorted(b.collect())
        assert "rlike" not in b._jdf.queryExecution().optimizedPlan().toString().lower()


def test_written_events_may_be_compressed(spark, tmp_path):
    from assay.sources import sinks as SK
    events = spark.createDataFrame([(1, '{"a":1}'), (2, '{"a":2}')], "offset long, value string")
    SK.write_events(events, "file", path=f"{tmp_path}/z", compression="gzip")
    assert list((tmp_path / "z").glob("part-*.txt.gz")) and not list((tmp_path / "z").glob("part-*.txt"))
    assert sorted(r[0] for r in spark.read.text(f"{tmp_path}/z").collect()) == ['{"a":1}', '{"a":2}']
