"""Structured Streaming versions of the continuous checks and the event
consumer (I1-I8, A3, A4, A11).

* field presence (I1) is stateless: parse, explode assertions, append;
* deviation from an average (I2) reads the maintained averages once per
  micro-batch inside ``foreachBatch`` (the reference queried the table per message);
* the event consumer (I3, I8) shreds each micro-batch into four tables and
  derives timeliness from the index of deadlines that it keeps;
* run boundaries (I4) are in ``boundaries``, the streaming rules (I5) in ``rules``.

Offsets and progress live in the checkpoint location (I6), which replaces the
consumer group of the reference; restarts resume from it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import events as EV
from ..operators import records as R
from ..operators import runs as RN
from ..session import STORED, remove_folder, shuffles_removed
from .averages import AverageStore
from .deadlines import DeadlineIndex


def read_kafka_stream(spark: SparkSession, servers: str, topic: str, starting: str = "earliest",
                      extra: dict[str, str] | None = None) -> DataFrame:
    """A3/A4: a Kafka topic as ``(offset, partition, value)`` text rows, replayed from
    ``starting`` (needs the Kafka connector on the classpath)."""
    r = (spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers)
         .option("subscribe", topic).option("startingOffsets", starting))
    for k, v in (extra or {}).items():
        r = r.option(k, v)
    return r.load().select("offset", "partition", F.col("value").cast("string").alias("value"))


# ---- I1 --------------------------------------------------------------------------

def presence_stream(messages: DataFrame, fields: list[str], key_col: str = "msg_key") -> DataFrame:
    """Streaming presence assertions of valid messages (stateless)."""
    parsed = messages.withColumn("_m", R.parse_message(F.col("value"))).filter(F.col("_m").isNotNull())
    return R.presence_assertions(parsed, fields, key_col=F.col("_m")["key"].cast("long"), keep=(key_col,))


def malformed_stream(messages: DataFrame, key_col: str = "msg_key") -> DataFrame:
    """The messages that no check of a stream can read, as exception rows."""
    bad = messages.withColumn("_m", R.parse_message(F.col("value"))).filter(F.col("_m").isNull())
    return bad.select(key_col, F.col("value").alias("message"), F.lit("malformed").alias("type"))


# ---- I2 --------------------------------------------------------------------------

def deviation_batch_writer(averages: AverageStore, spec: list[tuple[str, float, float]], out_path: str,
                           key_col: str = "msg_key"):
    """``foreachBatch`` body: each message is compared with the newest
    averages of the store, one row a field (the reference queried the table per
    message). Writes are keyed by batch id, so a replayed batch overwrites its own output."""
    def write(batch: DataFrame, batch_id: int) -> None:
        valid = batch.withColumn("_m", R.parse_message(F.col("value"))).filter(F.col("_m").isNotNull())
        out = R.deviation_assertions(valid, averages.wide(batch.sparkSession), spec, key_col=F.col("_m")["key"].cast("long"), keep=(key_col,))
        out.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite") \
            .parquet(f"{out_path}/batch_id={batch_id}")
    return write


# ---- I3 / I8 ----------------------------------------------------------------------

def shred_batch_writer(base_path: str):
    """``foreachBatch`` body: parse, validate and shred events into the
    run log, inputs, outputs and assertions; rejected events go to the
    exception table (I7); COMPLETE events get a timeliness assertion as of
    arrival, from the index of deadlines that this batch updates. Output folders are per batch id, so
    replaying a batch replaces its rows instead of duplicating them. The batch is parsed once for all its outputs: its parsed
    events and their validity lie under ``parsed`` while the tables are written, of which each output reads the columns it needs;
    the text stays only beside events that are rejected."""
    index = DeadlineIndex(f"{base_path}/deadlines")

    def write(batch: DataFrame, batch_id: int) -> None:
        spark, path = batch.sparkSession, f"{base_path}/parsed"
        events = EV.parse_events(batch).withColumn("reason", EV.validity_reason(F.col("ev")))
        events = events.withColumn("value", F.when(F.col("reason").isNotNull(), F.col("value")))
        with shuffles_removed(spark):
            events.write.options(**STORED).mode("overwrite").parquet(path)
            write_tables(spark.read.schema(events.schema).parquet(path), batch_id)
            remove_folder(spark, path)
            write_timeliness(spark, batch_id)

    def store(rows: DataFrame, name: str, batch_id: int) -> None:
        rows.write.options(**STORED).mode("overwrite").parquet(f"{base_path}/{name}/batch_id={batch_id}")

    def write_tables(parsed: DataFrame, batch_id: int) -> None:
        for name, rows in (EV.shred(parsed) | {"exceptions": EV.rejected(parsed)}).items():
            store(rows, name, batch_id)

    def write_timeliness(spark: SparkSession, batch_id: int) -> None:
        done = spark.read.parquet(f"{base_path}/run_log/batch_id={batch_id}").filter(F.col("event_type") == "COMPLETE")  # this batch's rows
        store(RN.timeliness_assertions(done, index.update(done, batch_id)), "timeliness", batch_id)
        index.release(spark)
    return write
