"""Behaviour at the edges of the reference's contract: isolation of broken rules, parsed ranges, sinks, times, ids, cron."""

import datetime as dt
import uuid

import pytest
from pyspark.sql import functions as F

from assay.functions import expressions as X
from assay.operators import catalog as K
from assay.operators import checks as C
from assay.operators import runs as RN
from assay.operators import schedule as SC
from assay.operators import suite as S
from assay.sources import sinks as SK


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "s string").select(column(F.col("s"))).first()[0]


@pytest.mark.parametrize("text,want", [
    ("2024-01-01T00:00:00Z", dt.datetime(2024, 1, 1)), ("2024-01-01T00:00:00.123Z", dt.datetime(2024, 1, 1, 0, 0, 0, 123000)),
    ("2024-01-01T00:00:00+03:00", dt.datetime(2023, 12, 31, 21)), ("2024-01-01T00:00:00-0530", dt.datetime(2024, 1, 1, 5, 30)),
    ("2024-01-01T00:00:00.123456789", dt.datetime(2024, 1, 1, 0, 0, 0, 123456)), ("2024-01-01T10:20", dt.datetime(2024, 1, 1, 10, 20)),
    ("2024-01-01T00:00:00", dt.datetime(2024, 1, 1)), ("2024-01-01 00:00:00", None), ("2024-13-01T00:00:00", None), ("x", None), (None, None)])
def test_event_times(spark, text, want):
    assert one(spark, text, X.parse_event_time) == want


@pytest.mark.parametrize("text", ["12345678-1234-5678-1234-567812345678", "12345678123456781234567812345678",
                                  "{12345678-1234-5678-1234-567812345678}", "urn:uuid:12345678-1234-5678-1234-567812345678",
                                  "ABCDEF78-1234-5678-1234-567812345678", "not-a-uuid", "1234"])
def test_uuid_forms(spark, text):
    try:
        want = str(uuid.UUID(text))
    except ValueError:
        want = None
    assert one(spark, text, X.uuid_text) == want


def test_scheduled_run_ids_are_uuids(spark):
    got = one(spark, "7", lambda c: X.deterministic_uuid(F.lit("run"), c))
    assert str(uuid.UUID(got)) == got


@pytest.mark.parametrize("cron,after,want", [
    ("0 0 * * MON", "2024-01-02 00:00:00", "2024-01-08 00:00:00"), ("0 0 1 JAN *", "2024-01-02 00:00:00", "2025-01-01 00:00:00"),
    ("@hourly", "2024-01-02 00:10:00", "2024-01-02 01:00:00"), ("@weekly", "2024-01-02 00:00:00", "2024-01-07 00:00:00"),
    ("0 0 L * *", "2024-02-01 00:00:00", "2024-02-29 00:00:00"), ("0 0 29 2 *", "2096-03-01 00:00:00", "2104-02-29 00:00:00"),
    ("0 0 1,L feb-mar *", "2024-02-01 00:00:00", "2024-02-29 00:00:00"), ("0 0 30 2 *", "2024-01-01 00:00:00", None),
    ("0 0 * * 1,BAD", "2024-01-01 00:00:00", None), ("61 0 * * *", "2024-01-01 00:00:00", None)])
def test_cron_names_macros_and_far_days(spark, cron, after, want):
    df = spark.createDataFrame([(cron, after)], "c string, a string").withColumn("a", F.col("a").cast("timestamp_ntz"))
    got = SC.with_next_fire(df, F.col("c"), F.col("a"), "n").first()["n"]
    assert (got and str(got)) == want


def test_bad_crons_are_reported(spark):
    rules = spark.createDataFrame([(1, '{"crontab":"0 0 * * 1,BAD"}'), (2, '{"crontab":"0 0 30 2 *"}'), (3, '{"crontab":"@daily"}'), (4, "{}")],
                                  "entity_sample_to_dq_rule_id long, rule_settings string")
    got = {r.rule_id: r.reason for r in SC.bad_crons(rules).collect()}
    assert got == {1: "not a cron expression", 2: "names a day that never comes"}


def test_unknown_sink_is_refused_and_console_shows_all(spark, capfd):
    ev = spark.range(50).select(F.col("id").alias("offset"), F.concat(F.lit("event-"), "id").alias("value"))
    with pytest.raises(ValueError):
        SK.write_events(ev, "kafak")
    SK.write_events(ev, "console")


@pytest.mark.parametrize("bad", ["> 0 or true", "> 0 or z = 7", "in (select 1)", "> z", "(1) or (1=1)", "between 1 and z", "; drop"])
def test_ranges_compare_with_literals_only(spark, bad):
    with pytest.raises(ValueError):
        C.range_predicate("x", bad)


@pytest.mark.parametrize("good,n", [("> 1", 2), ("('a selected one', '2')", 1), ("not in (1, 2)", 1), ("between 1 and 2", 2), ("is not null", 3), ("in (3)", 1)])
def test_ranges_accepted(spark, good, n):
    df = spark.createDataFrame([("1",), ("2",), ("3",)], "x string")
    assert df.filter(C.range_predicate("x", good)).count() == n


def test_broken_rules_do_not_stop_the_others(spark):
    df = spark.createDataFrame([(1, None), (2, "b")], "a int, b string")
    rules = spark.createDataFrame([
        (1, "check_null_values", '{"table":"t","columns":"b"}'), (2, "check_null_values", '{"table":"t","columns":"nope"}'),
        (3, "check_range", '{"table":"t","columns":"a","ranges":"> 0 or true"}'), (4, "count_equal", '{"path":"t","count":"x"}'),
        (5, "check_uniqueness", '{"table":"missing","columns":"a"}'), (6, "count_equal", '{"path":"t","count":"2"}')],
        "entity_sample_to_dq_rule_id long, rule_ref string, rule_settings string")
    got = {r.rule_id: r for r in S.run_rules(spark, rules, lambda name: {"t": df}[name]).collect()}
    assert set(got) == {1, 2, 3, 4, 5, 6}
    assert got[1].n_bad == 1 and got[6].success
    assert all(not got[i].success and "Error" in got[i].msg or "Exception" in got[i].msg for i in (2, 3, 4, 5))
    log = {r.rule_id: r for r in S.dq_log(S.run_rules(spark, rules, lambda name: {"t": df}[name]), "2024-01-01 00:00:00").collect()}
    assert [log[str(i)].status for i in range(1, 7)] == [0, 0, 0, 0, 0, 1]


RANGE_TYPES = "n int, d double, s string, day date, b boolean"


@pytest.mark.parametrize("column,text,bad,unread", [
    ("s", "> 5", 1, 2), ("s", "between 1 and 9.5", 0, 2), ("s", "in (7, 'x')", 0, 4), ("s", "> 'a'", 2, 0), ("s", "> date '2024-01-01'", 0, 4),
    ("n", "> 'abc'", 0, 4), ("n", "> '2'", 1, 0), ("n", "<> 3.5", 0, 0), ("day", "> '2024-01-01'", 1, 0), ("day", "> 'never'", 0, 4),
    ("b", "= 'true'", 1, 0), ("s", "like '%x'", 2, 0), ("d", "is null", 2, 0)])
def test_ranges_count_what_they_cannot_compare(spark, column, text, bad, unread):
    rows = [(1, 1.5, "3", dt.date(2023, 1, 1), True), (3, None, "7.5", dt.date(2024, 2, 1), None), (5, 2.0, "yx", None, False), (None, None, "cx", None, None)]
    df = spark.createDataFrame(rows, RANGE_TYPES)
    row = C.fused_counts(df, C.TableChecks("t", ranges=[(column, text)])).first()
    assert (row["n_bad"], row["n_err"]) == (bad, unread)


def test_rules_that_fail_at_run_time_do_not_stop_the_others(spark):
    df = spark.createDataFrame([(1, "a"), (2, "7"), (2, None)], "a int, b string")
    broken = df.select("a", F.raise_error(F.lit("no such block")).cast("int").alias("c"))
    S.register_rule("check_odd", lambda t, s: t.filter("b / 2 > 0").select(
        F.lit("check_odd").alias("assertion"), "b", *[F.lit(None).alias(c) for c in ("column", "success", "state", "msg", "n_bad", "pos")]))
    try:
        rules = spark.createDataFrame([
            (1, "check_range", '{"table":"t","columns":"b;a","ranges":"> 5;< 2"}'), (2, "check_null_values", '{"table":"t","columns":"b"}'),
            (3, "check_null_values", '{"table":"u","columns":"c"}'), (4, "check_null_values", '{"table":"u","columns":"a"}'),
            (5, "check_odd", '{"table":"t"}'), (6, "check_range", """{"table":"t","columns":"b","ranges":"rlike '('"}"""),
            (7, "check_uniqueness", '{"table":"t","columns":"a","crontab":"0 0 * * *"}'), (8, "check_uniqueness", '{"table":"t","columns":"a"}'),
            (9, "count_equal", '{"path":"t","count":"3"}')],
            "entity_sample_to_dq_rule_id long, rule_ref string, rule_settings string")
        got = {}
        for r in S.run_rules(spark, rules, lambda name: {"t": df, "u": broken}[name]).collect():
            got.setdefault(r.rule_id, []).append(r)
    finally:
        S.RULE_BUILDERS.pop("check_odd")
    assert set(got) == set(range(1, 10))
    first = {r.column: r for r in got[1]}
    assert first["b"].error == "1 values of b cannot be compared with > 5" and not first["b"].success
    assert first["a"].error is None and first["a"].n_bad == 2
    assert got[2][0].n_bad == 1 and got[4][0].success and got[9][0].success
    assert "no such block" in got[3][0].error and not got[3][0].success
    assert got[5][0].error and got[6][0].error
    assert [r.n_bad for i in (7, 8) for r in got[i]] == [1, 1]


def test_record_rules_share_one_projection_and_report_broken_ones(spark):
    recs = spark.createDataFrame([(1, "x"), (2, None)], "id long, v string")
    rules = spark.createDataFrame([
        (1, "not_null", '{"columns":"v"}'), (2, "check_condition", '{"columns":"v","regex":"^x"}'), (3, "not_null", '{"columns":"nope"}'),
        (4, "check_condition", '{"columns":"v","regex":"("}')], "entity_sample_to_dq_rule_id long, rule_ref string, rule_settings string")
    out = S.evaluate_record_rules(recs, rules)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Generate explode") == 1
    got = sorted((r.rule_ref, r.record_id or 0, r.column or "", r.success) for r in out.collect())
    assert got == [("check_condition", 0, "", False), ("check_condition", 1, "v", True), ("check_condition", 2, "v", False),
                   ("not_null", 0, "", False), ("not_null", 1, "v", True), ("not_null", 2, "v", False)]


def test_duplicate_parameter_raises(spark):
    p = spark.createDataFrame([(1, "url", "a"), (1, "url", "b"), (2, "url", "c")], "system_connection_id int, param_name string, param_value string")
    assert K.params_wide(p.filter("system_connection_id = 2"), ("url",)).first().url == "c"
    with pytest.raises(Exception, match="more than one url"):
        K.params_wide(p, ("url",)).collect()


def test_walk_deeper_than_64_and_cycles(spark):
    rows = [(i, i, None if i == 0 else i - 1, "COMPLETE", "2024-01-01 00:00:00" if i == 0 else None) for i in range(70)]
    rows += [(1000 + k, 1000 + k, 1000 + (k + 1) % 3, "COMPLETE", None) for k in range(3)] + [(2000, 2000, 1000, "COMPLETE", None)]
    log = spark.createDataFrame(rows, "id long, run_id long, parent_run_id long, event_type string, nominal_end_time string") \
        .withColumn("nominal_end_time", F.col("nominal_end_time").cast("timestamp_ntz"))
    batch = {r.run_id: r.based_end_time for r in RN.inherited_deadline(log).collect()}
    asked = {r.run_id: r.based_end_time for r in RN.deadlines_for(log, log.select("run_id")).collect()}
    assert batch == asked and batch[69] is not None and batch[1000] is None and batch[2000] is None


def test_selected_walks_take_few_rounds(spark, monkeypatch):
    """A chain of 200 runs is walked in about log2(200) rounds, each a job over the log, not in 200."""
    rows = [(i, i, None if i == 0 else i - 1, "COMPLETE", "2024-01-01 00:00:00" if i == 0 else None) for i in range(200)]
    log = spark.createDataFrame(rows, "id long, run_id long, parent_run_id long, event_type string, nominal_end_time string") \
        .withColumn("nominal_end_time", F.col("nominal_end_time").cast("timestamp_ntz"))
    rounds, cut = [], RN._cut
    monkeypatch.setattr(RN, "_cut", lambda df: rounds.append(1) or cut(df))
    asked = spark.createDataFrame([(0,), (199,), (199,), (777,), (None,)], "run_id long")
    got = {r.run_id: r.based_end_time for r in RN.deadlines_for(log, asked).collect()}
    assert got.keys() == {0, 199, 777} and got[199] == got[0] is not None and got[777] is None and len(rounds) < 12
