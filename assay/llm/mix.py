"""Mixing sources to target weights by systematic sampling.

Every document of a source has the same expected number of copies, target / size
of the source. Documents of a source are put in order of size, the expected copies
are prefix-summed in that order, one offset drawn from the seed and the source's
name is added, and a document is emitted once per whole number that the sum crosses.
In size order the words taken differ from the target by less than the longest
document of the source.

Defined results: null text has size 0; null source is a source of its own, last in
order; a source without words has target 0; ties in size go by id and then by the
row's hash; repeated rows are documents of their own; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assay.llm import common

SEED = 42
WEIGHTS = (1, 2, 3)
MOST = 3  # copies of a document at most


def offset(source: F.Column, seed: int) -> F.Column:
    """In [0, 1): the first 32 bits of the MD5 of seed and name."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), source)), 1, 8), 16, 10).cast("long") / F.lit(float(2**32))


def source_targets(sizes: DataFrame, weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """(``_null``, ``_name``, ``source_size``, ``target``) of (``_null``, ``_name``, ``size``) rows."""
    per = sizes.groupBy("_null", "_name").agg(F.sum("size").alias("source_size"))
    ranked = common.global_rank(per.withColumn("_all", F.lit(0)), ["_all"], ["_null", "_name"], "sources")
    w = F.array(*[F.lit(int(x)) for x in weights])
    src = common.materialize(ranked.withColumn("_w", F.get(w, (F.col("_rank") % len(weights)).cast("int"))), "weights")
    cap = F.col("source_size") * most
    capped = F.lit(False)
    known = -1
    while True:  # the capped set only grows; the driver sees four sums a round
        s = src.agg(F.sum("source_size").alias("t"), F.sum(F.when(capped, cap).otherwise(0)).alias("c"),
                    F.sum(F.when(capped, 0).otherwise(F.col("_w"))).alias("w"),
                    F.sum(capped.cast("long")).alias("n")).first()
        share = (s["t"] - s["c"]) / s["w"] if s["w"] else 0.0
        if s["n"] in (None, known):
            break
        known = s["n"]
        capped = capped | (F.lit(share) * F.col("_w") > cap)
    target = F.when(capped, cap.cast("double")).otherwise(F.lit(float(share)) * F.col("_w"))
    return src.select("_null", "_name", "source_size", target.alias("target"))


def sample_copies(docs: DataFrame, seed: int = SEED, weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """One row per document: ``_rid`` (if given), doc_id, size, source_size, target, copies."""
    rid = F.col("_rid") if "_rid" in docs.columns else F.monotonically_increasing_id()
    rows = common.materialize(docs.select(
        rid.alias("_rid"), "doc_id", F.col("source").isNull().alias("_null"),
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("_name"),
        F.coalesce(F.regexp_count(F.col("text"), F.lit(common.WORD)), F.lit(0)).cast("long").alias("size"),
        F.xxhash64(*docs.columns).alias("_tie")), "sizes")
    targets = source_targets(rows, weights, most)
    ranked = common.global_rank(rows, ["_null", "_name"], ["size", "doc_id", "_tie", "_rid"], "ranked")
    each = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    u = offset(F.when(F.col("_null"), F.lit("-")).otherwise(F.concat(F.lit("+"), F.col("_name"))), seed)
    crossed = F.floor((F.col("_rank") + 1) * each + u) - F.floor(F.col("_rank") * each + u)
    return (ranked.join(targets, ["_null", "_name"])
            .select("_rid", "doc_id", "size", "source_size", "target", crossed.cast("long").alias("copies")))


def mix(docs: DataFrame, seed: int = SEED, weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """The mixed corpus: rows of ``docs``, each as often as it was taken."""
    rows = common.with_row_id(docs, "mixed")
    taken = sample_copies(rows, seed, weights, most).filter("copies > 0").select("_rid", F.col("copies").alias("_copies"))
    return (rows.join(taken, "_rid").withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), "_copies")))
            .select(*docs.columns))


def op1(docs: DataFrame) -> DataFrame:
    return sample_copies(docs.select("doc_id", "text", "source")).select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


OP1_SQL = r"""
with d as (
  select doc_id, source is null as nul, coalesce(source, '') as name,
         case when text is null then 0 else len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) end as size
  from documents),
s as (
  select nul, name, sum(size)::bigint as source_size,
         1 + (row_number() over (order by nul, name) - 1) % 3 as w
  from d group by nul, name),
-- sources in the order in which they reach three times their size as all shares grow
o as (
  select *, sum(3 * source_size) over k - 3 * source_size as caps_before, sum(w) over k - w as w_before,
         sum(w) over () as w_all, sum(source_size) over () as t
  from s window k as (order by 3.0 * source_size / w, nul, name rows unbounded preceding)),
f as (
  select *, (t - caps_before)::double / (w_all - w_before) as share from o),
l as (
  select arg_min(share, w_before) filter (where share * w <= 3 * source_size) as share from f),
g as (
  select nul, name, source_size,
         case when l.share * w > 3 * source_size then (3 * source_size)::double else l.share * w end as target
  from f, l),
r as (
  select d.*, row_number() over (partition by nul, name order by size, doc_id) - 1 as k from d),
m as (
  select r.doc_id, r.size, g.source_size, g.target, r.k,
         case when g.source_size > 0 then g.target / g.source_size else 0.0 end as e,
         ('0x' || substr(md5('42:' || case when r.nul then '-' else '+' || r.name end), 1, 8))::bigint / 4294967296.0::double as u
  from r join g using (nul, name))
select doc_id, size::bigint as size, source_size, target,
       ((floor((k + 1) * e + u) - floor(k * e + u)) * size)::bigint as taken,
       (floor((k + 1) * e + u) - floor(k * e + u))::bigint as copies
from m
"""
