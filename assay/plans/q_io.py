"""Queries for scans and sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..session import scratch_dir
from ..sources import sinks as SK
from ..sources import tables as TB
from . import q_events
from .registry import register


@register("io_files_by_mtime")
def io_files_by_mtime(spark, sf):
    """Files of the table folder, oldest first, metadata only; rows-only check."""
    return TB.list_files_by_mtime(spark, sf, "*.parquet")


@register("io_sink_text", q_events.ORACLE_RUNS_COUNT)
def io_sink_text(spark, sf):
    """A16 + A19: events appended as JSON lines, read back and counted per type."""
    path = scratch_dir(spark, f"events-text-{uuid.uuid4().hex}")
    SK.write_events(q_events._events(spark, sf), "file", path=path, compression="gzip")
    back = spark.read.text(path)
    return back.select(F.get_json_object("value", "$.eventType").alias("event_type")) \
               .groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@register("io_json_documents", q_events.ORACLE_RUNS_COUNT)
def io_json_documents(spark, sf):
    """The written events read back by the JSON reader with the event schema."""
    from ..operators.events import EVENT_T
    path = scratch_dir(spark, f"events-json-{uuid.uuid4().hex}")
    SK.write_events(q_events._events(spark, sf), "file", path=path, compression="gzip")
    docs = TB.read_json_documents(spark, path, schema=EVENT_T, multi_line=False)
    return docs.groupBy(F.col("eventType").alias("event_type")).agg(F.count(F.lit(1)).alias("n"))


@register("io_sink_noop", q_events.ORACLE_RUNS_COUNT.replace("event_type, count(*) as n", "count(*) as row_count").replace(" group by event_type", ""))
def io_sink_noop(spark, sf):
    """The noop sink over the serialized run events; the row count observed during the write."""
    from ..operators.profile import observed_write
    stats = observed_write(q_events._events(spark, sf), lambda d: SK.write_events(d, "noop"))
    return spark.createDataFrame([(int(stats["rowCount"]),)], "row_count long")
