"""Run-tree recursion and run boundaries.

The reference walks the run tree one row at a time in PL/pgSQL. Here every
walk is pointer jumping over a (node -> pointer) DataFrame: each round joins
the table with itself, so a chain of depth d resolves in about log2(d)
rounds, each a distributed join. Lineage is cut with ``checkpoint()`` into
the shared checkpoint folder every round, so a lost executor recomputes one
round, not the whole walk. There is no depth cap: every round resolves at
least one node that does not lead into a cycle, so a round that resolves none
means only cycles are left, and those nodes are null.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import expressions as X


def _cut(df: DataFrame) -> tuple[DataFrame, int]:
    """Materialize a round in the shared checkpoint folder (eager, reliable);
    the same job counts the nodes still unresolved (an observed metric)."""
    obs = Observation()
    cut = df.observe(obs, F.count_if(~F.col("done")).alias("undone")).checkpoint(eager=True)
    return cut, int(obs.get["undone"])


def resolve_chains(nodes: DataFrame, cut=_cut) -> DataFrame:
    """Follow pointers to the end of each chain.

    ``nodes``: ``(node, ptr, value, done)``. A done node carries its final
    ``value``. An undone node points at ``ptr``; if ``ptr`` is not a node the
    result is null. Returns ``(node, value, done)``; nodes that lead into a cycle get a
    null value and ``done = false``. ``cut`` materializes a round and counts its unresolved nodes.
    """
    cur, undone = cut(nodes.select("node", "ptr", "value", "done"))
    before = None
    while undone and undone != before:
        before = undone
        # only unresolved nodes take part in the join; a pointer shared by many
        # nodes (a hot parent) meets one lookup row, and AQE splits that skew
        t = cur.select(F.col("node").alias("t_node"), F.col("ptr").alias("t_ptr"),
                       F.col("value").alias("t_value"), F.col("done").alias("t_done"))
        j = cur.filter(~F.col("done")).join(t, F.col("ptr") == t["t_node"], "left")
        missing = F.col("t_node").isNull()
        moved = j.select(
            "node",
            F.when(missing | F.col("t_done"), F.col("ptr")).otherwise(F.col("t_ptr")).alias("ptr"),
            F.when(missing, F.lit(None)).when(F.col("t_done"), F.col("t_value"))
             .otherwise(F.col("value")).alias("value"),
            (missing | F.col("t_done")).alias("done"))
        cur, undone = cut(cur.filter(F.col("done")).unionByName(moved))
    return cur.select("node", F.when(F.col("done"), F.col("value")).alias("value"), "done")


def first_per_key(df: DataFrame, key: str, order: str) -> DataFrame:
    """The row with the smallest ``order`` value per key (``LIMIT 1`` made
    deterministic). An aggregate, not a window: partial aggregation before
    the shuffle keeps a hot key from landing whole in one task."""
    cols = [c for c in df.columns if c != key]
    picked = df.groupBy(key).agg(F.min_by(F.struct(*cols), F.col(order)).alias("_first"))
    return picked.select(key, *[F.col("_first")[c].alias(c) for c in cols])


# ---- J2 / J3 / L2 -------------------------------------------------------------

def inherited_deadline(run_log: DataFrame) -> DataFrame:
    """Per run with a COMPLETE event, the root's ``nominal_end_time`` reached
    by following COMPLETE rows up through ``parent_run_id``; null when a
    COMPLETE row is missing on the path. Several COMPLETE rows of one run: the
    one with the smallest event id. Returns ``(run_id, based_end_time)``.
    """
    comp = first_per_key(run_log.filter(F.col("event_type") == "COMPLETE")
                         .select("id", "run_id", "parent_run_id", "nominal_end_time"),
                         "run_id", "id")
    nodes = comp.select(
        F.col("run_id").alias("node"), F.col("parent_run_id").alias("ptr"),
        F.when(F.col("parent_run_id").isNull(), F.col("nominal_end_time")).alias("value"),
        F.col("parent_run_id").isNull().alias("done"))
    res = resolve_chains(nodes)
    return res.select(F.col("node").alias("run_id"), F.col("value").alias("based_end_time"))


def deadlines_for(run_log: DataFrame, run_ids: DataFrame) -> DataFrame:
    """J2 for selected runs only (``run_ids`` has a ``run_id`` column): the walk up from each requested run through the stored
    COMPLETE rows, by pointer jumping over those rows, so that a chain of depth d takes about log2(d) rounds. A walk that
    enters a cycle, and a run without a COMPLETE row, ends with null.
    Returns ``(run_id, based_end_time)`` for the requested runs."""
    requested = run_ids.select("run_id").filter(F.col("run_id").isNotNull()).distinct()
    return requested.join(inherited_deadline(run_log), "run_id", "left")


def run_log_extended(run_log: DataFrame, deadlines: DataFrame | None = None) -> DataFrame:
    """Each event with the inherited deadline of its parent run."""
    d = deadlines if deadlines is not None else inherited_deadline(run_log)
    d = d.select(F.col("run_id").alias("_p"), "based_end_time")
    return run_log.join(d, run_log["parent_run_id"] == d["_p"], "left").drop("_p")


def timeliness_assertions(run_log: DataFrame, deadlines: DataFrame | None = None) -> DataFrame:
    """L2: on COMPLETE events with an inherited deadline: late -> ``time_expired``
    failure (state 0, positive seconds late in the text), else success (state 2)."""
    ext = run_log_extended(run_log.filter(F.col("event_type") == "COMPLETE"), deadlines)
    ext = ext.filter(F.col("based_end_time").isNotNull())
    late = F.col("based_end_time") < F.col("event_time")
    secs = X.seconds_between(F.col("based_end_time"), F.col("event_time"))
    return ext.select(
        F.col("id").alias("ol_id"), F.lit("time_expired").alias("assertion"),
        F.lit(None).cast("string").alias("column"), (~late).alias("success"),
        F.when(late, X.STATE_ERROR).otherwise(X.STATE_OK).alias("state"),
        F.when(late, X.template(X.MSG_TIME_EXPIRED, seconds=X.float_text(secs))).otherwise(F.lit("")).alias("msg"),
        F.lit(X.TIMELINESS_RULE_ID).alias("rule_id"))


# ---- J4 / J5 ------------------------------------------------------------------

def chain_leaf(run_log: DataFrame, skip_producer: str = "DQ tool") -> DataFrame:
    """Leaf of the child walk: from each run, repeatedly step to its smallest
    child run with a START event whose producer is not ``skip_producer``.
    Returns ``(run_id, leaf_run_id)`` for every run with a START event."""
    starts = run_log.filter(F.col("event_type") == "START")
    nxt = (starts.filter(F.col("parent_run_id").isNotNull() & (F.col("producer") != skip_producer))
           .groupBy("parent_run_id").agg(F.min("run_id").alias("child")))
    runs = starts.select("run_id").distinct()
    nodes = (runs.join(nxt, runs["run_id"] == nxt["parent_run_id"], "left")
             .select(F.col("run_id").alias("node"),
                     F.col("child").alias("ptr"),
                     F.when(F.col("child").isNull(), F.col("run_id")).alias("value"),
                     F.col("child").isNull().alias("done")))
    # a pointer always names a run with a START event, so "missing" cannot occur
    res = resolve_chains(nodes)
    return res.select(F.col("node").alias("run_id"), F.col("value").alias("leaf_run_id"))


def dataset_labels(events: DataFrame, datasets: DataFrame, data_asset: DataFrame, system: DataFrame,
                   entity: DataFrame) -> DataFrame:
    """Label ``entity (system)`` of each dataset of an event, through the asset
    named by the dataset namespace. Returns ``(ol_id, label, entity_name)``."""
    da = data_asset.select(F.col("id").cast("string").alias("_da"), F.col("system_id").alias("_sys"),
                           F.col("entity_id").alias("_ent"))
    s = system.select(F.col("id").alias("_sid"), F.col("name").alias("system_name"))
    e = entity.select(F.col("id").alias("_eid"), F.col("name").alias("entity_name"))
    d = (datasets.join(events.select(F.col("id").alias("ol_id")), "ol_id", "left_semi")
         .join(da, F.lower(F.col("ns")) == F.col("_da"), "left")
         .join(s, F.col("_sys") == F.col("_sid"), "left")
         .join(e, F.col("_ent") == F.col("_eid"), "left"))
    return d.select("ol_id", X.concat_null_empty(F.col("entity_name"), F.lit(" ("), F.col("system_name"),
                                                 F.lit(")")).alias("label"), "entity_name")


def pipeline_names(run_log: DataFrame, inputs: DataFrame, outputs: DataFrame, data_asset: DataFrame,
                   system: DataFrame, entity: DataFrame, skip_producer: str = "DQ tool") -> DataFrame:
    """``input label - output label of the last run down the child chain``.

    First part: the smallest named input label of the run's START event ('' if
    none). Second part: the smallest named output label of the leaf run's
    START event (producer not ``skip_producer``); omitted when absent.
    Returns ``(run_id, full_name)`` for every run with a START event.
    """
    starts = run_log.filter(F.col("event_type") == "START").select("id", "run_id", "producer")
    in_lab = dataset_labels(starts, inputs, data_asset, system, entity).filter(F.col("entity_name").isNotNull())
    first = (starts.join(in_lab, starts["id"] == in_lab["ol_id"], "inner")
             .groupBy("run_id").agg(F.min("label").alias("in_label")))
    out_starts = starts.filter(F.col("producer") != skip_producer)
    out_lab = dataset_labels(out_starts, outputs, data_asset, system, entity) \
        .filter(F.col("entity_name").isNotNull())
    last = (out_starts.join(out_lab, out_starts["id"] == out_lab["ol_id"], "inner")
            .groupBy(F.col("run_id").alias("leaf_run_id")).agg(F.min("label").alias("out_label")))
    leaf = chain_leaf(run_log, skip_producer)
    runs = starts.select("run_id").distinct()
    j = (runs.join(first, "run_id", "left").join(leaf, "run_id", "left")
         .join(last, "leaf_run_id", "left"))
    res = F.coalesce(F.col("in_label"), F.lit(""))
    return j.select("run_id", F.when(F.col("out_label").isNull(), res)
                    .otherwise(F.concat(res, F.lit(" - "), F.col("out_label"))).alias("full_name"))


def root_system_names(run_log: DataFrame, inputs: DataFrame, data_asset: DataFrame,
                      system: DataFrame) -> DataFrame:
    """For a root run, the (smallest) system name of its START inputs; null
    for runs with a parent. Returns ``(run_id, system_producer)``."""
    starts = run_log.filter(F.col("event_type") == "START").select("id", "run_id", "parent_run_id")
    da = data_asset.select(F.col("id").cast("string").alias("_da"), F.col("system_id").alias("_sys"))
    s = system.select(F.col("id").alias("_sid"), F.col("name").alias("_sname"))
    named = (inputs.join(da, F.lower(F.col("ns")) == F.col("_da"), "inner")
             .join(s, F.col("_sys") == F.col("_sid"), "inner")
             .groupBy("ol_id").agg(F.min("_sname").alias("_sname")))
    j = starts.join(named, starts["id"] == named["ol_id"], "left")
    return j.groupBy("run_id").agg(
        F.min(F.when(F.col("parent_run_id").isNull(), F.col("_sname"))).alias("system_producer"))


# ---- E2: run boundaries ---------------------------------------------------------

SEAM_BITS = 12  # 4,096 ranges are combined at a time


def _before(rows: DataFrame, pc: list[str], lo: int, hi: int, last: bool) -> DataFrame:
    """Exclusive scan of ``_v`` over ranges ``_b`` (``lo`` to ``hi``) of each partition, as ``_before``: the value of the range
    before (``last``) or the sum of all before. Ranges are scanned in blocks and blocks of blocks, so no task
    sees all of them and no window lacks a partition key."""
    w = Window.partitionBy(*pc, "_up").orderBy("_b")
    here = F.lag("_v").over(w) if last else F.coalesce(F.sum("_v").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("_up", F.shiftright("_b", SEAM_BITS))
    scanned = rows.withColumn("_before", here)
    if lo >> SEAM_BITS == hi >> SEAM_BITS:
        return scanned.drop("_up")
    blocks = rows.groupBy(*pc, F.col("_up").alias("_b")).agg((F.max_by("_v", "_b") if last else F.sum("_v")).alias("_v"))
    above = _before(blocks, pc, lo >> SEAM_BITS, hi >> SEAM_BITS, last)
    above = above.select(*pc, F.col("_b").alias("_up"), F.col("_before").alias("_above"))
    both = F.coalesce("_before", "_above") if last else F.col("_before") + F.col("_above")
    return scanned.join(above, [*pc, "_up"]).withColumn("_before", both).drop("_up", "_above")


def run_boundaries(messages: DataFrame, order_col: str, run_col: str, bucket_rows: int = 1 << 20,
                   partition_cols: tuple[str, ...] = ()) -> DataFrame:
    """A new check run starts whenever ``run_col`` differs from the previous
    message's (by ``order_col``) within its source partition (``partition_cols``;
    order exists only there). A message without a run (malformed) belongs to none:
    the one after it starts anew.

    Gaps and islands without a sort into one task: messages are cut into ranges of
    the order key (``bucket_rows`` wide) and written once with the message before
    each in its range; each range is summed up as its first and last run and its
    number of starts, a two-level scan over those rows gives what came before each
    range, and one join brings it back.

    Returns the messages with ``prev`` (run and key of the message before, null at the
    start of a partition), ``is_start`` and ``island`` (1-based per partition)."""
    pc = list(partition_cols)
    keys = [*pc, "_b"]
    me = F.struct(F.col(run_col).alias("run"), F.col(order_col).alias("key"))
    w = Window.partitionBy(*keys).orderBy(order_col)

    def starts(run, prev):
        return run.isNotNull() & ~F.coalesce(prev["run"] == run, F.lit(False))

    m = messages.withColumn("_b", F.floor(F.col(order_col) / F.lit(bucket_rows)).cast("long"))
    m = m.withColumn("_prev", F.lag(me).over(w)).checkpoint(eager=True)
    ranges = m.groupBy(*keys).agg(
        F.min_by(me, F.col(order_col)).alias("_first"), F.max_by(me, F.col(order_col)).alias("_v"),
        F.count_if(F.col("_prev").isNotNull() & starts(F.col(run_col), F.col("_prev"))).alias("_inner")).checkpoint(eager=True)
    ends = ranges.agg(F.min("_b").alias("lo"), F.max("_b").alias("hi")).first()
    if ends["lo"] is None:
        return m.select(*messages.columns, F.col("_prev").alias("prev"), F.lit(False).alias("is_start"), F.lit(0).cast("long").alias("island"))
    seams = _before(ranges, pc, ends["lo"], ends["hi"], last=True).withColumnRenamed("_before", "_tail")
    counts = seams.select(*keys, "_tail", (F.col("_inner") + starts(F.col("_first.run"), F.col("_tail")).cast("long")).alias("_v"))
    known = _before(counts, pc, ends["lo"], ends["hi"], last=False).select(*keys, "_tail", F.col("_before").alias("_offset"))
    out = m.join(known, keys).withColumn("prev", F.coalesce("_prev", "_tail"))
    out = out.withColumn("is_start", starts(F.col(run_col), F.col("prev")))
    n = F.sum(F.col("is_start").cast("long")).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return out.withColumn("island", F.col("_offset") + n).select(*messages.columns, "prev", "is_start", "island")


def run_islands(messages: DataFrame, order_col: str, group_col: str, bucket_rows: int = 1 << 20,
                partition_cols: tuple[str, ...] = ()) -> DataFrame:
    """One row per message with ``island`` (1-based per partition) and ``is_start``."""
    return run_boundaries(messages, order_col, group_col, bucket_rows, partition_cols).drop("prev")


def boundary_events(messages: DataFrame, order_col: str, run_col: str, bucket_rows: int = 1 << 20,
                    partition_cols: tuple[str, ...] = ()) -> DataFrame:
    """I4, batch: START on the first message of a run, RUNNING while the run stays, COMPLETE of the run before when
    another one follows, FAIL of the open run at a message that cannot be read, which ends it. What is open at the
    end of a partition stays open. One projection over the boundaries."""
    b = run_boundaries(messages, order_col, run_col, bucket_rows, partition_cols)
    run, prev, island = F.col(run_col), F.col("prev"), F.col("island")

    def event(island_, of, key, kind, seq):
        return F.struct(island_.alias("island"), of.alias("parent_run_id"), key.alias("msg_key"), kind.alias("event_type"),
                        F.lit(seq).alias("seq"))

    here = F.when(run.isNotNull(), event(island, run, F.col(order_col), F.when(F.col("is_start"), "START").otherwise("RUNNING"), 0)) \
            .when(prev["run"].isNotNull(), event(island, prev["run"], F.col(order_col), F.lit("FAIL"), 0))
    over = F.when(F.col("is_start") & prev["run"].isNotNull(), event(island - 1, prev["run"], prev["key"], F.lit("COMPLETE"), 1))
    return b.select(*partition_cols, F.explode(F.array_compact(F.array(here, over))).alias("e")).select(*partition_cols, "e.*")


def island_summary(islands: DataFrame, order_col: str, group_col: str,
                   partition_cols: tuple[str, ...] = ()) -> DataFrame:
    return islands.groupBy(*partition_cols, "island").agg(
        F.min(group_col).alias(group_col), F.min(order_col).alias("first_key"),
        F.max(order_col).alias("last_key"), F.count(F.lit(1)).alias("n_messages"))


def events_from_islands(islands: DataFrame, order_col: str, group_col: str,
                        partition_cols: tuple[str, ...] = ()) -> DataFrame:
    """I4 batch twin: START for the first message of a run, RUNNING for the
    rest, and one COMPLETE per run after its last message (end of input
    completes the last run). The COMPLETE carries no assertions."""
    per = islands.select(*partition_cols, "island", F.col(group_col).alias("parent_run_id"),
                         F.col(order_col).alias("msg_key"),
                         F.when(F.col("is_start"), "START").otherwise("RUNNING").alias("event_type"),
                         F.lit(0).alias("seq"))
    ends = island_summary(islands, order_col, group_col, partition_cols).select(
        *partition_cols, "island", F.col(group_col).alias("parent_run_id"), F.col("last_key").alias("msg_key"),
        F.lit("COMPLETE").alias("event_type"), F.lit(1).alias("seq"))
    return per.unionByName(ends)
