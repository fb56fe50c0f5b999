"""Event and table sinks.

One entry point chooses the sink by kind, like the reference's transport
factory, but every kind is a DataFrame writer: Kafka, text files, console and
noop (also forced by ``ASSAY_EVENTS_DISABLED=true``). No kind means the
console; an unknown one is an error. No sink drops events.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SINK_KINDS = ("kafka", "file", "console", "noop")


def resolve_kind(kind: str | None) -> str:
    if os.environ.get("ASSAY_EVENTS_DISABLED", "").lower() == "true":
        return "noop"
    if kind is not None and kind not in SINK_KINDS:
        raise ValueError(f"unknown event sink {kind!r}; known: {', '.join(SINK_KINDS)}")
    return kind or "console"


def _print_rows(rows) -> None:
    for r in rows:
        print(r["value"], flush=True)


def write_events(events: DataFrame, kind: str | None, **opts) -> None:
    """Write ``(offset, value)`` event rows to the chosen sink (batch)."""
    k = resolve_kind(kind)
    if k == "kafka":  # A15 (needs the Kafka connector)
        (events.select(F.col("offset").cast("string").alias("key"), "value").write.format("kafka")
         .option("kafka.bootstrap.servers", opts["servers"]).option("topic", opts["topic"]).save())
    elif k == "file":  # A16: JSON lines, appended; ``compression`` names a codec that readers of text and JSON know
        events.select("value").write.mode(opts.get("mode", "append")).text(opts["path"], compression=opts.get("compression"))
    elif k == "console":  # A17: every event, on the output of the task that has it
        events.select("value").foreachPartition(_print_rows)
    else:  # A18
        events.write.format("noop").mode("overwrite").save()


def write_events_stream(events: DataFrame, kind: str | None, checkpoint: str, **opts):
    """A19 for streams: same kinds as ``write_events``; returns the query."""
    k = resolve_kind(kind)
    w = events.writeStream.option("checkpointLocation", checkpoint)
    if k == "kafka":
        return (events.select(F.col("offset").cast("string").alias("key"), "value").writeStream
                .option("checkpointLocation", checkpoint).format("kafka")
                .option("kafka.bootstrap.servers", opts["servers"]).option("topic", opts["topic"]).start())
    if k == "file":
        return events.select("value").writeStream.option("checkpointLocation", checkpoint) \
            .format("text").option("path", opts["path"]).start()
    if k == "console":
        return events.select("value").writeStream.option("checkpointLocation", checkpoint) \
            .foreachBatch(lambda batch, _: batch.foreachPartition(_print_rows)).start()
    return w.format("noop").start()


def append_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: list[str] | None = None) -> None:
    """Append rows to a log table."""
    w = df.write.mode("append").format(fmt)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.save(path)


def write_jdbc(df: DataFrame, url: str, table: str, user: str | None = None, password: str | None = None,
               mode: str = "append", batch_size: int = 10000) -> None:
    """A9/A11 to a database table over JDBC (batched inserts, one connection per partition)."""
    w = df.write.format("jdbc").option("url", url).option("dbtable", table).option("batchsize", str(batch_size))
    if user is not None:
        w = w.option("user", user)
    if password is not None:
        w = w.option("password", password)
    w.mode(mode).save()
