"""Streams against their batch twins over several micro-batches, and replay safety."""

import datetime as dt
import random
import time
import uuid

import pandas as pd
import pytest
from pyspark.sql import functions as F

from assay.operators import runs as RN
from assay.plans import q_events
from assay.session import scratch_dir
from assay.streaming import boundaries as SB
from assay.streaming import checks as ST
from assay.streaming import rules as SR
from assay.streaming.averages import AverageStore
from assay.streaming.deadlines import DeadlineIndex
from paths import SF_SMALL

MESSAGES = "source_partition int, msg_key long, run_id long"


def folder(spark, name):
    return scratch_dir(spark, f"t-{name}-{uuid.uuid4().hex}")


def drain(spark, base, schema):
    src = spark.readStream.schema(schema).parquet(f"{base}/src")
    q = (SB.boundaries_stream(src).writeStream.format("parquet").option("path", f"{base}/out")
         .option("checkpointLocation", f"{base}/ck").trigger(availableNow=True).start())
    q.awaitTermination()


def brute_boundaries(rows):
    """Events of one partition's (key, run) messages, one by one."""
    out, run, last, island = [], None, None, 0
    for key, r in sorted(rows):
        if r is None:
            if run is not None:
                out.append((island, run, key, "FAIL", 0))
        elif r == run:
            out.append((island, run, key, "RUNNING", 0))
        else:
            if run is not None:
                out.append((island, run, last, "COMPLETE", 1))
            island += 1
            out.append((island, r, key, "START", 0))
        run, last = r, key
    return out


def test_boundaries_in_batch_and_over_micro_batches(spark):
    rnd = random.Random(4)
    rows = [(p, k, rnd.choice([1, 1, 1, 2, 2, 3, None])) for p in range(3) for k in sorted(rnd.sample(range(5000), 150))]
    rows += [(7, k, None) for k in range(5)]  # a partition without a readable message
    want = sorted((p, *e) for p in (0, 1, 2, 7) for e in brute_boundaries([(k, r) for q, k, r in rows if q == p]))
    df = spark.createDataFrame(rows, MESSAGES)
    for bucket in (1, 16, 1 << 20):  # from a range for each key, in three levels of blocks, to one range for all
        got = RN.boundary_events(df, "msg_key", "run_id", bucket, ("source_partition",))
        assert sorted(tuple(r) for r in got.collect()) == want
    base = folder(spark, "boundaries")
    for lo, hi in ((0, 900), (900, 901), (901, 3000), (3000, 5000)):
        df.filter((F.col("msg_key") >= lo) & (F.col("msg_key") < hi)).coalesce(1).sortWithinPartitions("msg_key") \
          .write.mode("append").parquet(f"{base}/src")
        drain(spark, base, df.schema)
    assert sorted(tuple(r) for r in spark.read.parquet(f"{base}/out").collect()) == want


def test_boundary_events_leave_by_blocks(spark):
    """The events of a block leave before the next block is asked for, so a task holds one of them; large ids stay exact."""
    class Value:
        held = None

        def exists(self):
            return self.held is not None

        def get(self):
            return self.held

        def update(self, value):
            self.held = value

    asked = []

    def blocks():
        for i in range(5):
            asked.append(i)
            yield pd.DataFrame({"msg_key": range(100 * i, 100 * i + 100), "has_key": True, "run_id": [(1 << 60) + i] * 100, "has_run": True})

    machine = SB.RunBoundaries(None)
    machine.open = Value()
    events = iter(machine.handleInputRows(("0", False), blocks(), None))
    assert len(next(events)) == 100 and asked == [0]
    rest = list(events)
    assert [len(x) for x in rest] == [101] * 4  # COMPLETE of the run before, too
    assert rest[-1]["parent_run_id"].tolist()[:2] == [(1 << 60) + 3, (1 << 60) + 4]
    assert machine.open.get() == ((1 << 60) + 4, 499, 5)


def test_boundaries_of_a_null_partition(spark):
    rows = [(p, k, r) for p in (None, 1) for k, r in ((0, 5), (1, 5), (2, None), (3, (1 << 60) + 1))]
    base = folder(spark, "null-partition")
    df = spark.createDataFrame(rows, MESSAGES).coalesce(1)
    df.write.parquet(f"{base}/src")
    drain(spark, base, df.schema)
    got = [tuple(r) for r in spark.read.parquet(f"{base}/out").collect()]
    want = brute_boundaries([(k, r) for p, k, r in rows if p == 1])
    assert sorted(x[1:] for x in got if x[0] is None) == sorted(x[1:] for x in got if x[0] == 1) == want


def test_boundaries_without_partitions_and_of_nothing(spark):
    empty = spark.createDataFrame([], MESSAGES)
    assert RN.boundary_events(empty, "msg_key", "run_id").collect() == []
    plan = RN.run_islands(spark.createDataFrame([(0, k, k % 2) for k in range(50)], MESSAGES), "msg_key", "run_id", 4) \
        ._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan


def test_stream_refuses_messages_out_of_order(spark):
    base = folder(spark, "disorder")
    df = spark.createDataFrame([(0, 5, 1), (0, 6, 1)], MESSAGES)
    df.coalesce(1).write.parquet(f"{base}/src")
    drain(spark, base, df.schema)
    spark.createDataFrame([(0, 4, 1)], MESSAGES).coalesce(1).write.mode("append").parquet(f"{base}/src")
    with pytest.raises(Exception, match="arrived after"):
        drain(spark, base, df.schema)


def test_idle_timer_completes_last_run(spark):
    base = folder(spark, "idle")
    src_df = spark.createDataFrame([(0, 1, 5), (0, 2, 5), (0, 3, 7), (0, 4, 7)], MESSAGES).coalesce(1)
    src_df.write.parquet(f"{base}/src")
    src = spark.readStream.schema(src_df.schema).parquet(f"{base}/src")
    name = f"islands_{uuid.uuid4().hex[:8]}"
    q = (SB.boundaries_stream(src, idle_timeout_ms=1000).writeStream.format("memory").queryName(name)
         .option("checkpointLocation", f"{base}/ck").outputMode("append").trigger(processingTime="500 milliseconds")
         .start())
    try:
        deadline = time.time() + 90  # a timer keeps scheduling batches: poll the sink instead of draining
        while time.time() < deadline:
            done = spark.sql(f"select * from {name} where event_type = 'COMPLETE'").collect()
            if len(done) == 2:
                break
            time.sleep(0.5)
    finally:
        q.stop()
    got = sorted((r["island"], r["msg_key"]) for r in done)
    assert got == [(1, 2), (2, 4)]  # the change completes run 1, the timer completes run 2


def test_event_consumer_replay_does_not_duplicate(spark):
    base = folder(spark, "shred")
    events = q_events._events(spark, SF_SMALL)
    writer = ST.shred_batch_writer(f"{base}/tables")
    writer(events, 0)
    late = spark.read.parquet(f"{base}/tables/timeliness").count()
    writer(events, 0)  # the same micro-batch again after a failure
    n = spark.read.parquet(f"{base}/tables/run_log").count()
    assert n == events.count()
    assert spark.read.parquet(f"{base}/tables/timeliness").count() == late > 0


DONE = "id long, run_id long, parent_run_id long, nominal_end_time timestamp_ntz"


def test_deadline_index_over_batches_in_any_order(spark):
    rnd = random.Random(9)
    day = dt.datetime(2024, 1, 1)
    parent = {r: (None if r < 3 else rnd.randrange(r) if rnd.random() < 0.9 else 500 + r) for r in range(60)}
    parent |= {100: 101, 101: 102, 102: 100, 103: 100}  # a cycle and a run that leads into it
    end = {r: day + dt.timedelta(days=r) if r != 1 else None for r in parent}
    runs = list(parent)
    rnd.shuffle(runs)
    index = DeadlineIndex(folder(spark, "index"), "long", buckets=3)
    batches = [runs[:5], [], runs[5:30], runs[30:31], runs[31:]]

    def walk(run, known):
        seen = set()
        while run in known and run not in seen:
            if parent[run] is None:
                return end[run]
            seen.add(run)
            run = parent[run]
        return None

    known = set()
    for b, new in enumerate(batches):
        known |= set(new)
        rows = spark.createDataFrame([(r, r, parent[r], end[r]) for r in new], DONE)
        asked = {parent[r] for r in new} - {None}
        index.update(rows, b)
        got = {r["run_id"]: r["based_end_time"] for r in index.update(rows, b).collect()}  # the same batch twice
        assert got == {p: walk(p, known) for p in asked}


def test_deadline_index_reads_no_run_log(spark):
    base = folder(spark, "index-plan")
    index = DeadlineIndex(f"{base}/deadlines", "long")
    spark.createDataFrame([(1, 1, None, dt.datetime(2024, 1, 1))], DONE).write.parquet(f"{base}/run_log")
    index.update(spark.createDataFrame([(1, 1, None, dt.datetime(2024, 1, 1))], DONE), 0).collect()
    out = index.update(spark.createDataFrame([(2, 2, 1, None), (3, 3, 2, None)], DONE), 1)
    assert {r["run_id"]: r["based_end_time"] for r in out.collect()} == {1: dt.datetime(2024, 1, 1), 2: dt.datetime(2024, 1, 1)}
    scan = index._read(spark, "resolved", 1, spark.createDataFrame([(1,)], "run_id long"), "run_id")._jdf.queryExecution().executedPlan().toString()
    assert "run_log" not in scan and "PartitionFilters: [" in scan and "bucket" in scan


def test_averages_grow_by_deltas_and_need_no_table(spark):
    store = AverageStore(folder(spark, "averages"), ["a", "b"])
    assert store.current(spark).collect() == []
    part = lambda *rows: spark.createDataFrame(rows, "a double, b string")
    store.add(part((1.0, "2"), (None, "x")), 0)
    store.add(part((4.0, "4")), 1)
    store.add(part((4.0, "4")), 1)  # a retry replaces the version
    assert {r["field"]: r["avg"] for r in store.current(spark).collect()} == {"a": 2.5, "b": 3.0}
    row = store.wide(spark)
    assert row.collect()[0].asDict() == {"avg_a": 2.5, "avg_b": 3.0}
    assert store.wide(spark)._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 1


RULES = "topic string, rule_id long, kind string, fields string"


def test_stream_rules_by_kind_with_ids_and_log(spark):
    rules = spark.createDataFrame([
        ("t", 1, "check_not_null", "v;z"), ("t", 2, "check_not_null", "z;v"), ("t", 3, "check_avg", "v|50|90"), ("t", 4, "check_avg", "v|x|90"),
        ("t", 5, "check_avg", "none|1|2"), ("u", 6, "check_not_null", "v")], RULES)
    msgs = spark.createDataFrame([(1, "t", '{"key": 1, "v": 10}'), (2, "t", '{"key": 2, "z": 1}'), (3, "t", "{"), (4, "w", '{"key": 4}')],
                                 "msg_key long, topic string, value string")
    averages = spark.createDataFrame([("v", 100.0)], "field string, avg double")
    compiled = SR.compiled(rules)
    assert {r["topic"]: len(r["checks"]) for r in compiled.collect()} == {"t": 5, "u": 1}  # shared checks once
    out = SR.apply_rules(msgs, compiled, averages)
    got = {(r["msg_key"], r["rule_id"], r["column"]): (r["assertion"], r["state"]) for r in out.collect()}
    assert got == {
        (1, 1, "v"): ("not_null", "2"), (1, 1, "z"): ("not_null", "0"), (1, 2, "v"): ("not_null", "2"), (1, 2, "z"): ("not_null", "0"),
        (2, 1, "v"): ("not_null", "0"), (2, 1, "z"): ("not_null", "2"), (2, 2, "v"): ("not_null", "0"), (2, 2, "z"): ("not_null", "2"),
        (1, 3, "v"): ("check_avg", "1"), (2, 3, "v"): ("check_avg", None), (1, 4, "v"): ("check_avg", None), (2, 4, "v"): ("check_avg", None),
        (1, 5, "none"): ("check_avg", None), (2, 5, "none"): ("check_avg", None)}
    log = {(r["rule_id"], r["msg_key"]): (r["status"], r["description"]) for r in SR.stream_log(out, F.lit("2024-01-01").cast("timestamp_ntz")).collect()}
    assert log["1", 1] == (0, "Не заполнены обязательные поля:  Поле z не заполнено(key - 1)")
    assert log["3", 1] == (1, "Ошибок нет. Поля v|50|90 не отличаются от среднего.")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("from_json") >= 1 and "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_rules_are_read_anew_for_each_batch(spark):
    base = folder(spark, "rules")
    msgs = spark.createDataFrame([(1, "t", '{"key": 1}'), (2, "t", "broken")], "msg_key long, topic string, value string")
    rules = {"now": [("t", 1, "check_not_null", "a")]}
    averages = lambda s: s.createDataFrame([], "field string, avg double")
    writer = SR.rules_batch_writer(lambda s: s.createDataFrame(rules["now"], RULES), averages, base)
    writer(msgs, 0)
    rules["now"].append(("t", 2, "check_not_null", "key"))
    writer(msgs, 1)
    writer(msgs, 1)
    got = sorted((r["batch_id"], r["rule_id"], r["success"]) for r in spark.read.parquet(f"{base}/assertions").collect())
    assert got == [(0, 1, False), (1, 1, False), (1, 2, True)]
    assert sorted((r["batch_id"], r["status"]) for r in spark.read.parquet(f"{base}/log").collect()) == [(0, 0), (1, 0), (1, 1)]
    assert [r["msg_key"] for r in spark.read.parquet(f"{base}/exceptions").collect()] == [2, 2]


def test_log_of_judged_checks_is_that_of_the_spread_assertions(spark):
    """Rules that ask for the same fields are grouped once, whatever their number; keys may repeat."""
    rules = spark.createDataFrame(
        [("t", i, "check_not_null", "v;z") for i in range(50)] + [("t", 50, "check_not_null", "z;v"), ("t", 51, "check_avg", "v|5|9"),
         ("t", 52, "check_avg", "v|5|9;v|50|90"), ("u", 1, "check_not_null", "v;v")], RULES)
    msgs = spark.createDataFrame([(1, "t", '{"key": 1, "v": 10}'), (1, "t", '{"key": 1, "z": 1}'), (2, "t", '{"key": 2, "v": 99}'),
                                  (3, "u", '{"key": 3}')], "msg_key long, topic string, value string")
    averages = spark.createDataFrame([("v", 100.0)], "field string, avg double")
    comp, when = SR.compiled(rules).checkpoint(), F.lit("2024-01-01").cast("timestamp_ntz")
    plain = SR.stream_log(SR.apply_rules(msgs, comp, averages), when)
    shared = SR.stream_log(SR.judged(msgs, comp, averages), when, rules=SR.asked(rules))
    assert sorted(map(str, shared.collect())) == sorted(map(str, plain.collect()))
    grouped = SR.judged(msgs, comp, averages).withColumn("fields", F.explode("asks"))
    assert grouped.count() == 22 < plain.count()  # whatever the number of rules that ask for the same


def test_waves_are_not_kept_in_memory(spark, tmp_path):
    """Rows dealt into waves lie in files; nothing is held by the session while a wave is taken."""
    from assay.plans import q_streaming
    empty, seen = [], []

    def run(src):
        empty.append(spark._jsparkSession.sharedState().cacheManager().isEmpty())
        seen.append(spark.read.schema(src.schema).parquet(f"{tmp_path}/src").count())

    spark.catalog.clearCache()
    q_streaming._waves(spark.range(10), F.col("id") % 3, 3, str(tmp_path), run)
    assert empty == [True] * 3 and seen == [4, 7, 10]


def test_consumer_reads_its_parsed_batch_by_splits(spark, monkeypatch):
    """The parsed batch lies in files, of which a task reads a bounded split, and is not kept by partitions."""
    base, seen = folder(spark, "consumer-splits"), []
    shred = ST.EV.shred
    monkeypatch.setattr(ST.EV, "shred", lambda parsed: seen.append(parsed) or shred(parsed))
    event = '{"eventTime":"2024-01-0%dT00:00:00.5","eventType":"COMPLETE","run":{"facets":%s,"runId":"00000000-0000-0000-0000-%012x"}}'
    parent = '{"parent":{"run":{"runId":"00000000-0000-0000-0000-000000000001"}}}'
    root = '{"nominalTime":{"nominalEndTime":"2024-01-05T00:00:00","nominalStartTime":"2024-01-01T00:00:00"}}'
    rows = [(k, event % (1 + k % 9, parent if k > 1 else root, k)) for k in range(1, 400)] + [(400, "{")]
    batch = spark.createDataFrame(rows, "offset long, value string").repartition(2)
    spark.catalog.clearCache()
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
        ST.shred_batch_writer(base)(batch, 0)
        level = seen[0].storageLevel
        assert not level.useMemory and not level.useDisk and seen[0].inputFiles()
        assert seen[0].rdd.getNumPartitions() > 2  # more than the batch has
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    late = {r["ol_id"]: r["success"] for r in spark.read.parquet(f"{base}/timeliness").collect()}
    assert late == {k: 1 + k % 9 < 5 for k in range(2, 400)}
    assert [r["offset"] for r in spark.read.parquet(f"{base}/exceptions").collect()] == [400]


def test_rules_are_stored_before_they_are_spread(spark):
    """What the stream stores grows with the messages and with the rules; reading it gives the rows of every rule of the batch."""
    msgs = spark.createDataFrame([(1, "t", '{"key": 1, "v": 10}'), (1, "t", '{"key": 1, "z": 1}'), (2, "t", "{"), (3, "u", '{"key": 3}'),
                                  (None, "t", '{"v": 99}'), (4, None, '{"key": 4}')], "msg_key long, topic string, value string")
    averages = lambda s: s.createDataFrame([("v", 100.0)], "field string, avg double")
    kinds = [("t", 1, "check_not_null", "v;z"), ("t", 2, "check_avg", "v|5|9"), ("u", 3, "check_not_null", "v;v"), ("u", None, "check_avg", "v|x|9")]
    when, stored = F.lit("2024-01-01").cast("timestamp_ntz"), {}
    for n in (1, 40):
        rules = kinds + [(t, 1000 * i + r, k, f) for i in range(1, n) for t, r, k, f in kinds if r]
        now = {0: rules, 1: [("t", 9, "check_not_null", "v")]}  # each batch is spread over the rules that it met
        plain, packed = folder(spark, f"rules-plain-{n}"), folder(spark, f"rules-packed-{n}")
        for base, spread_out in ((plain, True), (packed, False)):
            for b in now:
                SR.rules_batch_writer(lambda s: s.createDataFrame(now[b], RULES), averages, base, when, spread_out=spread_out)(msgs, b)
        for name, got in (("assertions", SR.read_assertions(spark, packed)), ("log", SR.read_log(spark, packed))):
            want = spark.read.parquet(f"{plain}/{name}").select(*got.columns)
            assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) != []
        assert spark.read.parquet(f"{packed}/exceptions").count() == 2
        stored[n] = [spark.read.parquet(f"{packed}/{x}").count() for x in ("judged", "judged_rules", "said", "said_rules")]
    assert stored[1] == stored[40]


def test_consumer_leaves_no_intermediate_files(spark, monkeypatch):
    """Parsed events, work tables of the index and shuffles leave the disk with the batch that needs them; texts and ids are stored with zstd."""
    import glob
    base, root = folder(spark, "consumer-disk"), spark.sparkContext.getCheckpointDir().removeprefix("file:")
    event = '{"eventTime":"2024-01-05T00:00:00.5","eventType":"COMPLETE","run":{"facets":%s,"runId":"00000000-0000-0000-0000-%012x"}}'
    parent = '{"parent":{"run":{"runId":"00000000-0000-0000-0000-%012x"}}}'
    root_run = '{"nominalTime":{"nominalEndTime":"2024-01-03T00:00:00","nominalStartTime":"2024-01-01T00:00:00"}}'
    rows = [(k, event % (parent % (k - 1) if k > 1 else root_run, k)) for k in range(1, 60)] + [(60, "{")]
    writer, seen = ST.shred_batch_writer(base), []
    update = DeadlineIndex.update
    monkeypatch.setattr(DeadlineIndex, "update", lambda *a: seen.append(glob.glob(f"{base.removeprefix('file:')}/parsed")) or update(*a))
    before = set(glob.glob(f"{root}/rdd-*"))
    for b, part in enumerate((rows[30:], rows[:30])):  # the first runs wait for the second batch
        writer(spark.createDataFrame(part, "offset long, value string").coalesce(1), b)
    assert set(glob.glob(f"{root}/rdd-*")) <= before and seen == [[], []]
    at = base.removeprefix("file:")
    assert sorted(x.rsplit("/", 1)[1] for x in glob.glob(f"{at}/*")) == ["assertions", "deadlines", "exceptions", "inputs", "outputs", "run_log", "timeliness"]
    assert not glob.glob(f"{at}/deadlines/work/*")
    files = glob.glob(f"{at}/**/*.parquet", recursive=True)
    assert files and all(x.endswith(".zstd.parquet") for x in files)
    assert {(r["batch_id"], r["ol_id"]) for r in spark.read.parquet(f"{base}/timeliness").collect()} == {(1, k) for k in range(2, 31)}
    assert [r["message"] for r in spark.read.parquet(f"{base}/exceptions").collect()] == ["{"]
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_rows_of_waves_lie_on_disk_once(spark, tmp_path):
    """A wave's files move to the source when it comes; a wave without rows still gives the query a batch; rows of no wave stay behind."""
    from assay.plans import q_streaming
    rows, seen = spark.createDataFrame([(k, None if k == 7 else k % 4) for k in range(40)], "id long, w long").repartition(3), []
    batches = []

    def run(src):
        q_streaming._drain_batches(src, str(tmp_path), lambda df, b: batches.append((b, df.count())))
        waiting = spark.read.parquet(f"{tmp_path}/arriving").count() if list(tmp_path.glob("arriving/*/*.parquet")) else 0
        seen.append((spark.read.schema(src.schema).parquet(f"{tmp_path}/src").count(), waiting))

    q_streaming._waves(rows, F.when(F.col("w") != 2, F.col("w")), 4, str(tmp_path), run)
    assert batches == [(0, 10), (1, 10), (2, 0), (3, 9)]
    assert seen == [(10, 30), (20, 20), (20, 20), (29, 11)]
