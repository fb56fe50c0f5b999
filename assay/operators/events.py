"""Run events: build, serialize, parse, validate, filter and shred
(K5-K8, B14-B18, H14-H17, H20, H22, H23, F5).

An event stream is a DataFrame ``(offset, value)`` of JSON text, the shape a
Kafka or file source delivers. Building nests per-event lists with one
``collect_list`` per event key (bounded by one event's datasets); shredding is
``from_json`` plus ``posexplode``. Ids of shredded rows are derived from the
source position, so replaying a batch yields the same ids.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import expressions as X

# Schema references written into events and facets (definition fragments;
# a deployment may prefix its spec location through ``SCHEMA_BASE``).
SCHEMA_BASE = ""
RUN_EVENT_SCHEMA_URL = SCHEMA_BASE + "#/definitions/RunEvent"
FACET_SCHEMA_BASE = SCHEMA_BASE
DQ_FACET_SCHEMA_URL = "#/definitions/DataQualityAssertionsDatasetFacet"
PRODUCER = "assay"

# carrier dataset for assertions of an event (the scheduler's input dataset)
CARRIER_NAMESPACE = "dq"
CARRIER_NAME = "assertions"

ASSERTION_T = T.StructType([
    T.StructField("assertion", T.StringType()), T.StructField("column", T.StringType()),
    T.StructField("msg", T.StringType()), T.StructField("rule_id", T.StringType()),
    T.StructField("state", T.StringType()), T.StructField("success", T.BooleanType())])

DATASET_T = T.StructType([
    T.StructField("facets", T.StructType([
        T.StructField("dataQuality", T.StructType([
            T.StructField("_producer", T.StringType()), T.StructField("_schemaURL", T.StringType()),
            T.StructField("assertions", T.ArrayType(ASSERTION_T))]))])),
    T.StructField("name", T.StringType()), T.StructField("namespace", T.StringType())])

EVENT_T = T.StructType([
    T.StructField("eventTime", T.StringType()), T.StructField("eventType", T.StringType()),
    T.StructField("inputs", T.ArrayType(DATASET_T)),
    T.StructField("job", T.StructType([T.StructField("name", T.StringType()),
                                       T.StructField("namespace", T.StringType())])),
    T.StructField("outputs", T.ArrayType(DATASET_T)),
    T.StructField("producer", T.StringType()),
    T.StructField("run", T.StructType([
        T.StructField("facets", T.StructType([
            T.StructField("nominalTime", T.StructType([
                T.StructField("nominalEndTime", T.StringType()), T.StructField("nominalStartTime", T.StringType())])),
            T.StructField("parent", T.StructType([
                T.StructField("job", T.StructType([T.StructField("name", T.StringType()),
                                                   T.StructField("namespace", T.StringType())])),
                T.StructField("run", T.StructType([T.StructField("runId", T.StringType())]))]))])),
        T.StructField("runId", T.StringType())])),
    T.StructField("schemaURL", T.StringType())])


def uuid_of(n: Column) -> Column:
    """A UUID-form text for a numeric run id (all-zero prefix, hex suffix)."""
    return F.when(n.isNotNull(), F.concat(F.lit("00000000-0000-0000-0000-"), F.lpad(F.lower(F.hex(n)), 12, "0")))


def _facet_base(schema_fragment: str) -> list[Column]:
    return [F.lit(PRODUCER).alias("_producer"), F.lit(schema_fragment).alias("_schemaURL")]


def build_events(run_log: DataFrame, inputs: DataFrame, outputs: DataFrame, assertions: DataFrame,
                 job_name: Column, job_namespace: str = "dq") -> DataFrame:
    """K5-K7 + H15/F5: one JSON run event per run-log row, keys sorted, nulls
    dropped. Assertions of an event travel in the ``dataQuality`` facet of a
    carrier input dataset. Returns ``(offset, value)`` with offset = event id.
    """
    # one row per part of an event, plain columns, one shuffle for all of them; dealt out before the grouping, so that the
    # readers of the tables neither sort nor spill what they read
    parts = (inputs.select("ol_id", F.struct("name", "ns").alias("_in"))
             .unionByName(outputs.select("ol_id", F.struct("name", "ns").alias("_out")), allowMissingColumns=True)
             .unionByName(assertions.select("ol_id", F.struct(
                 "assertion", "column", "msg", F.col("rule_id").cast("string").alias("rule_id"), "state", "success")
                 .alias("_said")), allowMissingColumns=True))
    parts = (parts.filter(F.col("ol_id").isNotNull()).repartition("ol_id").groupBy("ol_id")
             .agg(*[F.array_sort(F.collect_list(c)).alias(c) for c in ("_in", "_out", "_said")]))
    empty_facets = F.struct(F.lit(None).cast(DATASET_T["facets"].dataType["dataQuality"].dataType)
                            .alias("dataQuality"))  # renders as {} (null members are dropped)
    ins = F.transform("_in", lambda d: F.struct(empty_facets.alias("facets"), F.struct().alias("inputFacets"), d["name"].alias("name"),
                                                d["ns"].alias("namespace")))
    outs = F.transform("_out", lambda d: F.struct(empty_facets.alias("facets"), d["name"].alias("name"), d["ns"].alias("namespace"),
                                                  F.struct().alias("outputFacets")))
    carrier = F.struct(
        F.struct(F.struct(*_facet_base(DQ_FACET_SCHEMA_URL), F.col("_said").alias("assertions")).alias("dataQuality")).alias("facets"),
        F.struct().alias("inputFacets"), F.lit(CARRIER_NAME).alias("name"), F.lit(CARRIER_NAMESPACE).alias("namespace"))
    parts = parts.select(  # the carrier is the last input
        "ol_id", F.concat(ins, F.when(F.size("_said") > 0, F.array(carrier)).otherwise(F.array())).alias("inputs"), outs.alias("outputs"))
    e = run_log.join(parts, run_log["id"] == parts["ol_id"], "left").drop("ol_id")
    nominal = F.when(F.col("nominal_start_time").isNotNull(), F.struct(
        *_facet_base(FACET_SCHEMA_BASE + "#/definitions/NominalTimeRunFacet"),
        X.iso_timestamp(F.col("nominal_end_time")).alias("nominalEndTime"),
        X.iso_timestamp(F.col("nominal_start_time")).alias("nominalStartTime")))
    parent = F.when(F.col("parent_run_id").isNotNull(), F.struct(
        *_facet_base(FACET_SCHEMA_BASE + "#/definitions/ParentRunFacet"),
        F.struct(F.lit("parentjob").alias("name"), F.lit(job_namespace).alias("namespace")).alias("job"),
        F.struct(uuid_of(F.col("parent_run_id")).alias("runId")).alias("run")))
    event = F.struct(
        X.iso_timestamp(F.col("event_time")).alias("eventTime"), F.col("event_type").alias("eventType"),
        F.coalesce(F.col("inputs"), F.array()).alias("inputs"),
        F.struct(F.struct().alias("facets"), job_name.alias("name"), F.lit(job_namespace).alias("namespace")).alias("job"),
        F.coalesce(F.col("outputs"), F.array()).alias("outputs"),
        F.col("producer").alias("producer"),
        F.struct(F.struct(nominal.alias("nominalTime"), parent.alias("parent")).alias("facets"),
                 uuid_of(F.col("run_id")).alias("runId")).alias("run"),
        F.lit(RUN_EVENT_SCHEMA_URL).alias("schemaURL"))
    return e.select(F.col("id").alias("offset"), F.to_json(event).alias("value"))


# ---- parse, validate, filter ------------------------------------------------------

PARSE_T = T.StructType(EVENT_T.fields + [T.StructField("_corrupt_record", T.StringType())])


def parse_events(events: DataFrame, value_col: str = "value") -> DataFrame:
    """Typed parse; malformed text is kept in ``ev._corrupt_record``. The parse is a row of its own (an explode of one
    element), so that filters on ``ev`` stay above it and every event is parsed once, however often ``ev`` is used."""
    ev = F.from_json(F.col(value_col), PARSE_T, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    return events.withColumn("ev", F.explode(F.array(ev)))


def validity_reason(ev: Column) -> Column:
    """Null when valid, else the first failed rule."""
    return (F.when(ev.isNull() | ev["_corrupt_record"].isNotNull(), "malformed")
            .when(ev["run"].isNull(), "no run")
            .when(~ev["eventType"].isin(*X.EVENT_TYPES) | ev["eventType"].isNull(), "bad eventType")
            .when(~F.coalesce(X.is_uuid(ev["run"]["runId"]), F.lit(False)), "bad runId")
            .when(X.parse_event_time(ev["eventTime"]).isNull(), "bad eventTime"))


def _reason(parsed: DataFrame) -> Column:
    """The validity of parsed events: their column ``reason`` where it was stored with them."""
    return F.col("reason") if "reason" in parsed.columns else validity_reason(F.col("ev"))


def exact_filter(match: str) -> Column:
    """Keep events whose job name is not ``match``."""
    return ~F.coalesce(F.col("ev.job.name") == match, F.lit(False))


def regex_filter(regex: str) -> Column:
    """Keep events whose job name does not match ``regex`` at its start."""
    return ~F.coalesce(F.col("ev.job.name").rlike("^(?:" + regex + ")"), F.lit(False))


def make_filter(conf: dict) -> Column | None:
    kind = conf.get("type")
    if kind == "exact":
        return exact_filter(conf["match"])
    if kind == "regex":
        return regex_filter(conf["regex"])
    return None


def apply_filters(parsed: DataFrame, confs: list[dict]) -> DataFrame:
    """All filters apply, to run events only (rows with a ``run``)."""
    keeps = [c for c in (make_filter(x) for x in confs) if c is not None]
    if not keeps:
        return parsed
    keep = reduce(lambda a, b: a & b, keeps)
    return parsed.filter(F.col("ev.run").isNull() | keep)


# ---- shred ---------------------------------------------------------------------------

def shred(parsed: DataFrame, offset_col: str = "offset") -> dict[str, DataFrame]:
    """K8: the run log, inputs, outputs and assertions of valid events."""
    ok = parsed.filter(_reason(parsed).isNull())
    ev = F.col("ev")
    run_log = ok.select(
        F.col(offset_col).alias("id"), X.parse_event_time(ev["eventTime"]).alias("event_time"),
        ev["eventType"].alias("event_type"), ev["producer"].alias("producer"),
        X.uuid_text(ev["run"]["runId"]).alias("run_id"),
        F.coalesce(X.uuid_text(ev["run"]["facets"]["parent"]["run"]["runId"]),
                   ev["run"]["facets"]["parent"]["run"]["runId"]).alias("parent_run_id"),
        X.parse_event_time(ev["run"]["facets"]["nominalTime"]["nominalEndTime"]).alias("nominal_end_time"),
        X.parse_event_time(ev["run"]["facets"]["nominalTime"]["nominalStartTime"]).alias("nominal_start_time"))

    def side(name: str, kind: str) -> DataFrame:
        x = ok.select(F.col(offset_col).alias("ol_id"), F.posexplode(ev[name]).alias("pos", "d"))
        return x.select(X.deterministic_id(F.col("ol_id"), F.lit(kind), F.col("pos")).alias("id"),
                        "ol_id", F.col("d.name").alias("name"), F.col("d.namespace").alias("ns"), "pos", "d")

    ins = side("inputs", "in")
    outs = side("outputs", "out")
    asr = ins.select("ol_id", F.col("pos").alias("ipos"),
                     F.posexplode(F.col("d.facets.dataQuality.assertions")).alias("apos", "a"))
    asr = asr.select(
        X.deterministic_id(F.col("ol_id"), F.lit("assertion"), F.col("ipos"), F.col("apos")).alias("id"),
        "ol_id", F.col("a.assertion").alias("assertion"), F.col("a.column").alias("column"),
        F.col("a.success").alias("success"), F.col("a.state").alias("state"), F.col("a.msg").alias("msg"),
        F.col("a.rule_id").alias("rule_id"))
    return {"run_log": run_log, "inputs": ins.drop("pos", "d"), "outputs": outs.drop("pos", "d"),
            "assertions": asr}


def rejected(parsed: DataFrame, value_col: str = "value", offset_col: str = "offset") -> DataFrame:
    """Invalid events as exception-log rows (message, type)."""
    r = _reason(parsed)
    return parsed.filter(r.isNotNull()).select(F.col(offset_col).alias("offset"),
                                               F.col(value_col).alias("message"), r.alias("type"))


# ---- corruption of a stream for validation tests ----------------------------------

def corrupt(events: DataFrame, every: int = 101) -> DataFrame:
    """Deterministic bad variants of some events (test input for validation):
    offset % every = 1 no ``run``; 2 unknown type; 3 non-UUID run id;
    4 time without ``T``; 5 time without fraction (valid); 6 malformed."""
    k = F.col("offset") % every
    v = F.col("value")
    bad = (F.when(k == 1, F.regexp_replace(v, r'"run":\{', '"norun":{'))
           .when(k == 2, F.regexp_replace(v, r'"eventType":"[A-Z]+"', '"eventType":"BOGUS"'))
           .when(k == 3, F.regexp_replace(v, r'"runId":"[0-9a-f-]+"\}', '"runId":"not-a-uuid"}'))
           .when(k == 4, F.regexp_replace(v, r'"eventTime":"(\d{4}-\d\d-\d\d)T', '"eventTime":"$1 '))
           .when(k == 5, F.regexp_replace(v, r'"eventTime":"([^".]+)\.\d+"', '"eventTime":"$1"'))
           .when(k == 6, F.regexp_replace(v, r'^\{', '{{'))
           .otherwise(v))
    return events.withColumn("value", bad)

