"""Run monitoring views.

The reference view runs correlated subqueries per row, two levels deep
(Catalyst rejects that shape). Here it is decorrelated into aggregates at
three grains, each one shuffle with a partial aggregate in front:

* per event:  worst own state, smallest own message, smallest message per state
* per run:    worst state over the run's events, FAIL / COMPLETE flags
* per parent: worst state and smallest message over the children's events

and START rows join those small results by key. Fan-out is never expanded:
datasets of an event come as a separate long table (one row per dataset and
side) instead of the reference's inputs x outputs product.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import expressions as X


def event_grain(run_log: DataFrame, assertions: DataFrame, materialize: bool = True):
    """Assertions reduced once to ``(ol_id, state) -> smallest message`` and the
    per-event worst state and smallest message joined to existing events.

    Both results feed several branches (per run, per parent, START rows,
    message candidates); they are checkpointed into the shared folder so the
    assertion table is scanned and shuffled once."""
    g = (assertions.groupBy("ol_id", "state").agg(F.min("msg").alias("state_msg")))
    if materialize:
        g = g.checkpoint(eager=True)
    own = g.groupBy("ol_id").agg(F.min("state").alias("own_state"), F.min("state_msg").alias("own_msg"))
    es = run_log.join(own, run_log["id"] == own["ol_id"], "left").drop("ol_id")
    if materialize:
        es = es.checkpoint(eager=True)
    return g, es


def event_states(run_log: DataFrame, assertions: DataFrame) -> DataFrame:
    """Per existing event: its own worst state and smallest message (assertions
    naming a missing event stay unmatched)."""
    return event_grain(run_log, assertions, materialize=False)[1]


def run_states(es: DataFrame) -> DataFrame:
    """D8 + C11 + C12 from event states: per START event the worst state over
    own and child assertions, the run-local worst state and the run flags."""
    per_run = es.groupBy("run_id").agg(
        F.min("own_state").alias("state_local"),
        F.bool_or(F.col("event_type") == "FAIL").alias("has_fail"),
        F.bool_or(F.col("event_type") == "COMPLETE").alias("has_complete"))
    per_parent = (es.filter(F.col("parent_run_id").isNotNull())
                  .groupBy("parent_run_id").agg(F.min("own_state").alias("child_state"),
                                                F.min("own_msg").alias("child_msg")))
    starts = es.filter(F.col("event_type") == "START")
    return (starts.join(per_run, "run_id", "left")
            .join(per_parent.withColumnRenamed("parent_run_id", "run_id"), "run_id", "left")
            .withColumn("state", F.least("own_state", "child_state")))


def monitor_runs(run_log: DataFrame, assertions: DataFrame, full_names: DataFrame | None = None,
                 materialize: bool = True) -> DataFrame:
    """J1 without the dataset columns: one row per START event.

    ``state``: worst of own assertions and the assertions of every event
    whose parent is this run; ``state_local``: worst over the run's events;
    labels put a FAIL first, then a missing COMPLETE, then the state;
    ``assertion_msg``: smallest non-null message among own assertions in
    that worst state and all assertions of child events.
    """
    g, es = event_grain(run_log, assertions, materialize)
    t = run_states(es)
    # own message candidates: assertions of this event in its worst state
    bs = g.filter(F.col("state_msg").isNotNull()).select(
        F.col("ol_id").alias("_bs_id"), F.col("state").alias("_bs_state"), "state_msg")
    t = t.join(bs, (t["id"] == bs["_bs_id"]) & (t["state"] == bs["_bs_state"]), "left")
    t = t.withColumn("assertion_msg", F.least("state_msg", "child_msg"))
    cols = [X.run_label(F.col("has_fail"), F.col("has_complete"), F.col("state")).alias("state_name"),
            X.run_label(F.col("has_fail"), F.col("has_complete"), F.col("state_local")).alias("state_name_local"),
            "assertion_msg", "state", "state_local", "id", "run_id", "parent_run_id", "event_type",
            "event_time", "producer"]
    out = t.select(*cols)
    if full_names is not None:
        out = out.join(full_names, "run_id", "left")
    return out


def monitor_roots(monitor: DataFrame) -> DataFrame:
    """The draft view, root runs only."""
    return monitor.filter(F.col("parent_run_id").isNull())


def monitor_datasets(run_log: DataFrame, inputs: DataFrame, outputs: DataFrame, data_asset: DataFrame,
                     system: DataFrame, domain: DataFrame) -> DataFrame:
    """C9/C10 in long form: one row per START event and dataset, with the side,
    the asset named by the namespace, its system and its domain. A namespace
    that names no asset gives no match (the reference raised on non-UUIDs)."""
    starts = run_log.filter(F.col("event_type") == "START").select(F.col("id").alias("ol_id"), "run_id")
    ds = (inputs.select("ol_id", "name", "ns", F.lit("input").alias("side"))
          .unionByName(outputs.select("ol_id", "name", "ns", F.lit("output").alias("side"))))
    da = data_asset.select(F.col("id").alias("asset_id"), F.col("id").cast("string").alias("_da"),
                           F.col("name").alias("asset_name"), "system_id", F.col("domain_id").alias("domain_id"))
    s = system.select(F.col("id").alias("_sid"), F.col("name").alias("system_name"))
    d = domain.select(F.col("id").alias("_did"), F.col("name").alias("domain_name"))
    j = (starts.join(ds, "ol_id", "inner")
         .join(da, F.lower(F.col("ns")) == F.col("_da"), "left")
         .join(s, F.col("system_id") == F.col("_sid"), "left")
         .join(d, F.col("domain_id") == F.col("_did"), "left"))
    return j.select(F.col("ol_id").alias("id"), "run_id", "side", "name", "ns", "asset_id", "asset_name",
                    F.col("_sid").alias("system_id"), "system_name", F.col("_did").alias("domain_id"),
                    "domain_name")


def assertion_monitor(assertions: DataFrame, bindings: DataFrame, dq_rule: DataFrame,
                      run_log: DataFrame) -> DataFrame:
    """Assertions with state label, rule name and run id."""
    b = bindings.select(F.col("id").alias("_bid"), F.col("dq_rule_id").alias("_rid"))
    r = dq_rule.select(F.col("id").alias("_drid"), F.col("name").alias("rule_name"))
    ol = run_log.select(F.col("id").alias("_olid"), "run_id")
    j = (assertions.join(b, assertions["rule_id"] == b["_bid"], "left")
         .join(r, F.col("_rid") == F.col("_drid"), "left")
         .join(ol, assertions["ol_id"] == ol["_olid"], "left"))
    return j.select("id", X.state_label(F.col("state")).alias("state_name"), "rule_name", "column", "msg",
                    "rule_id", "ol_id", "run_id", "assertion", "state")


def ordered_for_display(monitor: DataFrame) -> DataFrame:
    """the view's order (run, then event time), applied only at the output edge."""
    return monitor.orderBy("run_id", "event_time")
