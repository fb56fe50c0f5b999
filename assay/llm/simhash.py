"""SimHash near-dedup with covering locality-sensitive hashing.

A fingerprint holds, bit by bit, the majority of its document's shingle hashes. Bit
positions are dealt into 7 groups, named by the non-zero vectors of three bits. Table
v keeps the groups whose vector has an odd product with v, four of the seven. Any two
positions are orthogonal to some non-zero v, so two fingerprints that differ in at most
2 bits agree on everything kept by some table: no pair within the radius is missed.

Fingerprints alone in their bucket of a table are dropped. The others are checked
without pairing a bucket's rows: two values that agree on the kept bits are within 2
bits just if a value exists that is within one (dropped) bit of each. So each sends
itself and its one-bit neighbours over the dropped bits, and equal values meet. Every
meeting point has 65 members at most, all linked with each other, so linking each to
the smallest keeps every link. Components follow from those links.

Defined results: null, empty and blank texts have fingerprint zero, linked like any
other; repeated rows have equal fingerprints; documents without id take part, and a
component without any id has a null component_id; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assay.llm import common

SHINGLE = 3
RADIUS = 2
TABLES = range(1, 8)


def kept_bits(v: int) -> list[int]:
    """Bit positions kept by table ``v``; position i is in group 1 + i mod 7."""
    return [i for i in range(64) if ((1 + i % 7) & v).bit_count() % 2]


def as_long(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def mask(v: int) -> int:
    return as_long(sum(1 << i for i in kept_bits(v)))


def shingle_hashes(text: Column, size: int) -> Column:
    """XXH64 (seed 42) of the space-joined word shingles; one of the whole sequence if it is shorter."""
    words = F.col("_words")
    return F.transform(
        F.sequence(F.lit(0), F.greatest(F.size(words) - size, F.lit(0))),
        lambda i: F.xxhash64(F.concat_ws(" ", *[F.get(words, i + k) for k in range(size)])))


def fingerprints(docs: DataFrame, key: list[str], size: int = SHINGLE) -> DataFrame:
    """``key`` columns (together unique) and fingerprint (long).

    Each 64-bit hash adds to 64 counters, two to a long (32 bits each), so a
    document's shingles shrink to 32 sums in the task that read it.
    """
    words = docs.select(*key, F.regexp_extract_all(
        common.lower_ascii(F.coalesce(F.col("text").cast("string"), F.lit(""))), F.lit(common.WORD), F.lit(0)).alias("_words"))
    h = words.select(*key, F.explode_outer(
        F.when(F.size("_words") > 0, shingle_hashes(F.col("_words"), size))).alias("_h"))
    lanes = F.lit((1 << 32) | 1)
    sums = h.groupBy(*key).agg(
        F.count("_h").alias("_n"),
        *[F.sum(F.shiftrightunsigned("_h", i).bitwiseAND(lanes)).alias(f"_s{i}") for i in range(32)])
    low = lambda i: F.col(f"_s{i}").bitwiseAND(F.lit(0xFFFFFFFF))
    bits = [F.when(low(i) * 2 > F.col("_n"), F.lit(1 << i)).otherwise(F.lit(0).cast("long")) for i in range(32)]
    bits += [F.when(F.shiftrightunsigned(f"_s{i}", 32) * 2 > F.col("_n"), F.lit(as_long(1 << (i + 32)))).otherwise(F.lit(0).cast("long"))
             for i in range(32)]
    fp = bits[0]
    for b in bits[1:]:
        fp = fp.bitwiseOR(b)
    return sums.select(*key, F.coalesce(fp, F.lit(0).cast("long")).alias("fingerprint"))


def links(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(``u``, ``v``) links whose components are those of all pairs within ``radius`` bits. ``prints``: distinct ``fingerprint``."""
    if radius != RADIUS:
        raise ValueError("the masks here cover a radius of 2 bits")
    buckets = prints.select("fingerprint", F.explode(F.array(*[
        F.struct(F.lit(v).alias("t"), F.col("fingerprint").bitwiseAND(F.lit(mask(v))).alias("k")) for v in TABLES])).alias("b")) \
        .select("fingerprint", "b.t", "b.k")
    crowded = buckets.groupBy("t", "k").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("t", "k")
    flips = F.element_at(F.array(*[
        F.array(F.lit(0).cast("long"), *[F.lit(as_long(1 << i)) for i in range(64) if i not in set(kept_bits(v))])
        for v in TABLES]), F.col("t"))
    near = (buckets.join(crowded, ["t", "k"])
            .select("fingerprint", F.explode(F.transform(flips, lambda m: F.col("fingerprint").bitwiseXOR(m))).alias("center"))
            .distinct())
    met = near.groupBy("center").agg(F.collect_list("fingerprint").alias("m")).filter(F.size("m") > 1)  # 65 members at most
    return (met.select(F.array_min("m").alias("v"), F.explode("m").alias("u")).filter("u <> v")
            .select("u", "v").distinct())


def near_duplicates(docs: DataFrame, key: list[str], size: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """``key`` columns, fingerprint (long), component_id and ``_first``: whether the row stands for its component."""
    rows = common.materialize(fingerprints(docs, key, size), "prints")
    classes = common.materialize(rows.groupBy("fingerprint").agg(F.min("doc_id").alias("id")), "classes")
    roots = common.connected_components(links(classes.select("fingerprint"), radius), "simhash") \
        .withColumnRenamed("node", "fingerprint")
    rooted = classes.join(roots, "fingerprint", "left").withColumn("root", F.coalesce("root", "fingerprint"))
    smallest = rooted.groupBy("root").agg(F.min("id").alias("component_id"))
    return rows.join(rooted.join(smallest, "root").select("fingerprint", "component_id", "root"), "fingerprint")


def dedup(docs: DataFrame, size: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """``docs`` with one document of each component: that of the smallest id, the first row of it."""
    rows = common.with_row_id(docs, "dedup")
    marked = near_duplicates(rows, ["_rid", "doc_id"], size, radius)
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_rid"))
    kept = marked.groupBy("root").agg(first.alias("s")).select("s._rid")
    return rows.join(kept, "_rid", "left_semi").select(*docs.columns)


def op4(docs: DataFrame) -> DataFrame:
    rows = docs.select(F.monotonically_increasing_id().alias("_rid"), "doc_id", "text")
    return near_duplicates(rows, ["_rid", "doc_id"]).select(
        "doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")
