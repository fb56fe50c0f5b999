"""I4 on a stream: run boundaries as a state machine per source partition.

The state of a partition is the open run (none after a message that cannot be read),
the key of its last message and the number of runs so far. Rows are taken a block at a
time as they arrive, and the events of a block leave before the next is read: however
many messages of a partition a micro-batch holds, its task keeps one block (at most
``spark.sql.execution.arrow.maxRecordsPerBatch`` rows). A source partition must arrive
in order, as a message log delivers it (one reader per partition, kept by the
exchange); a row that does not is refused with an error rather than taken wrongly.
``runs.boundary_events`` is the batch twin, which needs no such order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

STATE = "run long, last_key long, island long"
KEYS = "partition_text string, partition_null boolean"
EVENTS = KEYS + ", island long, parent_run_id long, msg_key long, event_type string, seq int"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def block_events(run: int | None, last: int | None, island: int, rows: pd.DataFrame) -> tuple[pd.DataFrame, tuple]:
    """Events of a block of messages (``msg_key``, ``run_id`` with ``has_key``, ``has_run``: false where null), and the state (run,
    last key, island) after it."""
    n = len(rows)
    keys, runs = rows["msg_key"].to_numpy(np.int64), rows["run_id"].to_numpy(np.int64)
    keyed, named = rows["has_key"].to_numpy(bool), rows["has_run"].to_numpy(bool)
    # of the message before each
    key0, keyed0 = np.append(last or 0, keys[:-1]), np.append(last is not None, keyed[:-1])
    run0, named0 = np.append(run or 0, runs[:-1]), np.append(run is not None, named[:-1])
    wrong = np.flatnonzero(keyed0 & (~keyed | (keys < key0)))
    if len(wrong):
        at = wrong[0]
        raise ValueError(f"message {keys[at] if keyed[at] else None} arrived after {key0[at]}")
    fresh = named & ~(named0 & (run0 == runs))
    islands = island + np.cumsum(fresh)
    at = np.arange(n)
    over, here, fail = at[fresh & named0], at[named], at[~named & named0]
    events = pd.DataFrame({
        "island": np.concatenate([islands[over] - 1, islands[here], islands[fail]]),
        "parent_run_id": np.concatenate([run0[over], runs[here], run0[fail]]),
        "msg_key": pd.array(np.concatenate([key0[over], keys[here], keys[fail]]), "Int64"),
        "event_type": np.concatenate([np.full(len(over), "COMPLETE", object), np.where(fresh[here], "START", "RUNNING").astype(object),
                                      np.full(len(fail), "FAIL", object)]),
        "seq": np.concatenate([np.ones(len(over), np.int32), np.zeros(len(here) + len(fail), np.int32)])})
    events.loc[~np.concatenate([keyed0[over], keyed[here], keyed[fail]]), "msg_key"] = pd.NA
    events = events.iloc[np.argsort(np.concatenate([over, here, fail]), kind="stable")]
    return events, (int(runs[-1]) if named[-1] else None, int(keys[-1]) if keyed[-1] else None, int(islands[-1]))


class RunBoundaries(StatefulProcessor):
    """START, RUNNING, COMPLETE and FAIL of the runs of one source partition."""

    def __init__(self, idle_ms: int | None):
        self.idle_ms = idle_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", STATE)

    def _of(self, key, events: pd.DataFrame) -> pd.DataFrame:
        return events.assign(partition_text=key[0], partition_null=key[1])[[c.split()[0] for c in EVENTS.split(", ")]]

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state = self.open.get() if self.open.exists() else (None, None, 0)
        for block in rows:
            try:
                events, state = block_events(*state, block)
            except ValueError as e:
                raise ValueError(f"partition {None if key[1] else key[0]}: {e}") from e
            yield self._of(key, events)
        self.open.update(state)
        if self.idle_ms is not None:
            for timer in self.handle.listTimers():
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        run, last, island = self.open.get() if self.open.exists() else (None, None, 0)
        if run is not None:
            self.open.update((None, last, island))
            yield self._of(key, pd.DataFrame({"island": [island], "parent_run_id": [run], "msg_key": pd.array([last], "Int64"),
                                              "event_type": ["COMPLETE"], "seq": [1]}))

    def close(self) -> None:
        pass


def boundaries_stream(messages: DataFrame, partition_col: str = "source_partition", idle_timeout_ms: int | None = None) -> DataFrame:
    """I4: events of the runs of each source partition. ``messages``: partition, ``msg_key`` (the order), ``run_id`` (null:
    cannot be read). Without ``idle_timeout_ms`` the last run stays open until the next change; with it a
    processing-time timer completes a run whose partition has been idle that long."""
    messages.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    kind, none = messages.schema[partition_col].dataType, F.lit(0).cast("long")
    # without nulls, which would turn whole numbers into floats in pandas
    rows = messages.select(
        F.coalesce(F.col(partition_col).cast("string"), F.lit("")).alias("partition_text"), F.col(partition_col).isNull().alias("partition_null"),
        F.coalesce("msg_key", none).alias("msg_key"), F.col("msg_key").isNotNull().alias("has_key"),
        F.coalesce("run_id", none).alias("run_id"), F.col("run_id").isNotNull().alias("has_run"))
    events = rows.groupBy("partition_text", "partition_null").transformWithStateInPandas(
        RunBoundaries(idle_timeout_ms), EVENTS, "Append", "None" if idle_timeout_ms is None else "ProcessingTime")
    return events.select(F.when(~F.col("partition_null"), F.col("partition_text").cast(kind)).alias(partition_col),
                         "island", "parent_run_id", "msg_key", "event_type", "seq")
