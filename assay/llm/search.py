"""Ranked lexical search of many items at once, with their common sub-expressions computed once.

An item's score of a document is a sum over the item's terms. Terms that the same items
hold are one class, whose sum is needed once. Among the classes, pairs that two or more
items share are mined greedily, most shared first, and become nodes of their own (a sum of
two sums), until no pair is shared: a DAG in which an item is the sum of the nodes left to
it. For a block of documents every class and node is a row of partial accumulators, computed
once and used by all items above it.

Items are the stated query set. They are dealt into blocks of about ``TERMS`` (item, term)
pairs by hash, the driver reads one block at a time, and its vocabulary and DAGs are
broadcast, which bounds both. For each block one pass over the whole texts writes every
document's length and counts of the vocabulary's terms, from which the document
frequencies are summed; a second pass over those rows evaluates the DAG and keeps, in each
task, the best ``top`` documents of each item. The tasks' lists meet in two steps (by item
and a part of the tasks, then by item), so no task takes in the lists of all.

All scores are 64-bit integers. Class sums go through doubles and are exact: a class has at
most ``CLASS`` terms, each of which adds less than 2^35.

Defined results: a document with a null or empty text or without terms counts nowhere and
is never found, an item without terms finds nothing; rows of items with equal ids and terms
are one item, an id that repeats with other terms is another; repeated documents are ranked each;
documents of equal scores go by doc_id, null last; texts of any length are read whole; an
empty table of items or documents gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from assay.llm import common
from assay.llm.pack import slices

TOP = 50
TERMS = 65_536  # (item, term) pairs in a block
PLAN = 8_192  # (item, term) pairs of the items planned together
ITEMS = 512  # items planned together
CLASS = 100_000  # terms of a class at most
MANY = 4_096  # classes shared by two or more items that are mined together
COLUMNS = 1_024  # documents accumulated at a time
DEALS = 32  # parts of the tasks' lists that meet first
SCALE = 1_000_000_000

#: Upper case to lower case, all else below 128 but letters and digits to a space.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def terms_of(text: str | None) -> list[bytes]:
    """Maximal stretches of letters, digits and characters beyond ASCII, only A to Z lower-cased."""
    return text.encode().translate(_FOLD).split() if text else []


class Plan:
    """Classes of terms and the DAG of shared sums for a few items; each item a list of term numbers."""

    def __init__(self, items: list[list[int]]):
        self.size = len(items)
        holders: dict[int, int] = {}  # term -> items that hold it, as bits
        for i, terms in enumerate(items):
            for t in terms:
                holders[t] = holders.get(t, 0) | 1 << i
        seen: Counter = Counter()
        classes: dict[tuple[int, int], int] = {}
        self.class_of: dict[int, int] = {}  # term -> class
        for t in sorted(holders):
            mask = holders[t]
            self.class_of[t] = classes.setdefault((mask, seen[mask] // CLASS), len(classes))
            seen[mask] += 1
        masks = [m for m, _ in classes]
        self.classes = len(masks)
        self.rounds: list[tuple[np.ndarray, np.ndarray]] = []  # nodes made together: the two sums of each
        shared = [c for c, m in enumerate(masks) if m & (m - 1)]
        held: list[list[int]] = [[] for _ in items]
        for c, m in enumerate(masks):
            if not m & (m - 1):
                held[m.bit_length() - 1].append(c)
        for at in range(0, len(shared), MANY):
            for node, who in self.mine(shared[at:at + MANY], masks):
                for i in np.flatnonzero(who).tolist():
                    held[i].append(node)
        self.parts = np.array([n for nodes in held for n in nodes], np.int64)
        self.starts = np.cumsum([0, *map(len, held)])[:-1]
        self.empty = np.array([not h for h in held])

    @property
    def nodes(self) -> int:
        return self.classes + sum(len(a) for a, _ in self.rounds)

    def mine(self, shared: list[int], masks: list[int]):
        """Replace pairs of sums that two or more items use together by nodes; yield what is left, with its items."""
        ids = np.array(shared)
        used = np.array([[masks[c] >> i & 1 for i in range(self.size)] for c in shared], np.float32)
        while len(ids) > 1:
            gain = used @ used.T
            np.fill_diagonal(gain, 0)
            best = gain.max(1)
            if best.max() < 2:
                break
            # disjoint pairs, most shared first; each side takes its best partner that is still free
            taken = np.zeros(len(ids), bool)
            pairs = []
            for a in np.argsort(-best, kind="stable"):
                if best[a] < 2:
                    break
                if not taken[a]:
                    free = np.where(taken, 0, gain[a])
                    b = int(np.argmax(free))
                    if free[b] >= max(2, best[a] / 2):
                        taken[a] = taken[b] = True
                        pairs.append((int(a), b))
            left, right = np.array(pairs).T
            both = used[left] * used[right]
            used[left] -= both
            used[right] -= both
            made = self.nodes + np.arange(len(pairs))
            self.rounds.append((ids[left], ids[right]))
            ids, used = np.concatenate([ids, made]), np.concatenate([used, both])
            live = used.any(1)
            for n, who in zip(ids[~live], used[~live]):
                yield int(n), who
            ids, used = ids[live], used[live]
        for n, who in zip(ids, used):
            yield int(n), who

    def scores(self, sums: np.ndarray) -> np.ndarray:
        """Items by documents, from the sums of classes by documents."""
        acc = np.empty((self.nodes, sums.shape[1]), np.int64)
        acc[:self.classes] = sums
        at = self.classes
        for a, b in self.rounds:
            acc[at:at + len(a)] = acc[a] + acc[b]
            at += len(a)
        out = np.zeros((self.size, sums.shape[1]), np.int64)
        some = np.flatnonzero(~self.empty)
        for lo in range(0, len(some), 256):  # the parts of a few items at a time
            pick = some[lo:lo + 256]
            first = self.starts[pick[0]]
            last = self.starts[pick[-1] + 1] if pick[-1] + 1 < self.size else len(self.parts)
            out[pick] = np.add.reduceat(acc[self.parts[first:last]], self.starts[pick] - first, axis=0)
        return out


class Best:
    """The best documents of each item so far; ``floor`` is the score of the last one of a full list."""

    def __init__(self, items: int, top: int):
        self.top, self.floor = top, np.zeros(items, np.int64)
        self.kept = (np.zeros(0, np.int64),) * 4  # item, score, no id, doc_id
        self.new: list[tuple] = []
        self.count = 0

    def add(self, at: int, scores: np.ndarray, unknown: np.ndarray, ids: np.ndarray) -> None:
        floor = self.floor[at:at + len(scores), None]
        item, doc = np.nonzero((scores >= floor) & (scores > 0))
        self.new.append((item + at, scores[item, doc], unknown[doc], ids[doc]))
        self.count += len(item)
        if self.count > 4 * self.top * len(self.floor):
            self.settle()

    def settle(self) -> tuple:
        item, score, unknown, ids = (np.concatenate(c) for c in zip(self.kept, *self.new))
        by = np.lexsort((ids, unknown, -score, item))
        item = item[by]
        rank = np.arange(len(by)) - np.searchsorted(item, item)
        by, item, rank = by[rank < self.top], item[rank < self.top], rank[rank < self.top]
        self.kept = (item, score[by], unknown[by], ids[by])
        full = rank == self.top - 1
        self.floor[item[full]] = self.kept[1][full]
        self.new, self.count = [], 0
        return self.kept


def term_counts(docs: DataFrame, words: list[bytes]) -> DataFrame:
    """doc_id, n (terms, with repeats), terms and counts (of ``words``, by number) of each document that has a term."""
    known = docs.sparkSession.sparkContext.broadcast({w: i for i, w in enumerate(words)})  # at most TERMS and one item

    def run(batches):
        import pyarrow as pa
        of = known.value.get
        for b in (x for batch in batches for x in slices(batch)):
            rows = []
            for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if words_ := terms_of(text):
                    found = Counter(map(of, words_))
                    found.pop(None, None)
                    rows.append((key, len(words_), list(found), list(found.values())))
            if rows:
                cols = zip(*rows)
                types = (pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["doc_id", "n", "terms", "counts"])
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id long, n long, terms array<int>, counts array<long>")


def _planned(rows: list, words: dict[bytes, int]) -> list[tuple[list, Plan]]:
    """Items with their plan, some ``PLAN`` pairs or ``ITEMS`` at a time."""
    out, group, held = [], [], 0
    for r in rows:
        group.append(r)
        held += len(r["terms"])
        if held >= PLAN or len(group) >= ITEMS:
            out.append(group)
            group, held = [], 0
    return [(g, Plan([[words[t.encode()] for t in r["terms"]] for r in g])) for g in [*out, group] if g]


def search_block(docs: DataFrame, rows: list, top: int) -> DataFrame:
    """(item, item_id, doc_id, score): for one block of items, up to ``top`` documents of each for each task."""
    spark = docs.sparkSession
    words = {w: i for i, w in enumerate(sorted({t.encode() for r in rows for t in r["terms"]}))}
    counts = common.materialize(term_counts(docs, list(words)), "terms")
    total = counts.agg(F.count(F.lit(1)).alias("N"), F.sum("n").alias("L")).first()
    N, L = total["N"], total["L"]
    df = {r["t"]: r["df"] for r in counts.select(F.explode("terms").alias("t")).groupBy("t")
          .agg(F.count(F.lit(1)).alias("df")).collect()}  # one row for each of the block's terms
    weight = np.zeros(len(words), np.int64)
    for t, n in df.items():
        weight[t] = math.floor(1000 * math.log((2 * N + 2) / (2 * n + 1)))
    planned = _planned(rows, words)
    classes = []
    for _, plan in planned:
        of = np.full(len(words), -1, np.int64)
        of[list(plan.class_of)] = list(plan.class_of.values())
        classes.append(of)
    model = spark.sparkContext.broadcast((weight, [p for _, p in planned], classes))
    ids = [r["item_id"] for g, _ in planned for r in g]

    def run(batches):
        import pyarrow as pa
        weight, plans, classes = model.value
        best = Best(sum(p.size for p in plans), top)
        for b in (batch.slice(at, COLUMNS) for batch in batches for at in range(0, batch.num_rows, COLUMNS)):
            key = b.column(0)
            unknown = key.is_null().to_numpy(zero_copy_only=False).astype(np.int64)
            key = key.fill_null(0).to_numpy(zero_copy_only=False)
            n = b.column(1).to_numpy(zero_copy_only=False)
            m = 50 + 50 * n * N // L
            per = b.column(2).value_lengths().to_numpy(zero_copy_only=False)
            doc = np.repeat(np.arange(len(n)), per)
            term = b.column(2).flatten().to_numpy(zero_copy_only=False)
            tf = b.column(3).flatten().to_numpy(zero_copy_only=False)
            part = weight[term] * (SCALE * tf // (1000 * tf + 20 * m[doc]))
            at = 0
            for plan, of in zip(plans, classes):
                c = of[term]
                on = c >= 0
                sums = np.bincount(c[on] * len(n) + doc[on], part[on], plan.classes * len(n))
                best.add(at, plan.scores(sums.reshape(plan.classes, len(n)).astype(np.int64)), unknown, key)
                at += plan.size
        item, score, unknown, key = best.settle()
        yield pa.RecordBatch.from_arrays(
            [pa.array(item, pa.int32()), pa.array([ids[i] for i in item.tolist()], pa.int64()),
             pa.array(key, pa.int64(), mask=unknown.astype(bool)), pa.array(score, pa.int64())],
            ["item", "item_id", "doc_id", "score"])

    return counts.mapInArrow(run, "item int, item_id long, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """item_id, rank, doc_id, score: the ``top`` documents of each item."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    words = F.array_distinct(F.regexp_extract_all(common.lower_ascii(text), F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), F.lit(0)))
    asked = common.materialize(items.select(F.col("item_id").cast("long"), words.alias("terms")).distinct(), "items")
    pairs = asked.agg(F.sum(F.size("terms"))).first()[0] or 0
    blocks = -(-pairs // TERMS)
    found = []
    for b in range(blocks):
        rows = (asked.filter(F.pmod(F.xxhash64("item_id", "terms"), F.lit(blocks)) == b).filter(F.size("terms") > 0)
                .orderBy(F.col("item_id").asc_nulls_last(), "terms").collect())  # a block of the query set
        if rows:
            lists = common.materialize(search_block(docs, rows, top).withColumn("deal", F.spark_partition_id() % DEALS), "found")
            found.append(lists.withColumn("block", F.lit(b)))
    if not found:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    lists = reduce(DataFrame.unionByName, found)
    order = [F.desc("score"), F.col("doc_id").asc_nulls_last()]
    some = lists.withColumn("rank", F.row_number().over(Window.partitionBy("block", "item", "deal").orderBy(*order))).filter(F.col("rank") <= top)
    return (some.withColumn("rank", F.row_number().over(Window.partitionBy("block", "item").orderBy(*order)))
            .filter(F.col("rank") <= top).select("item_id", "rank", "doc_id", "score"))


def op12(docs: DataFrame, items: DataFrame) -> DataFrame:
    return search(docs, items)


OP12_SQL = r"""
with t as (
  select doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                           '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term
  from documents where text is not null),
c as (select doc_id, term, count(*) as tf from t group by all),
d as (select doc_id, sum(tf)::bigint as n from c group by doc_id),
a as (select count(*) as nn, sum(n)::bigint as ll from d),
w as (select term, floor(1000 * ln((2 * any_value(nn) + 2) / (2 * count(*) + 1)::double))::bigint as w from c, a group by term),
i as (
  select distinct item_id, text,
         unnest(list_distinct(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                 '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))) as term
  from (select distinct item_id, text from benchmark)),
s as (
  select item_id, i.text, c.doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * nn) // ll))))::bigint as score
  from i join c using (term) join w using (term) join d using (doc_id), a
  group by all),
r as (
  select *, row_number() over (partition by item_id, text order by score desc, doc_id) as rank from s where score > 0)
select item_id, rank::int as rank, doc_id, score from r where rank <= 50
"""
