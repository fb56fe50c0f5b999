"""Ranked search against a plain version of the contract's formula."""

import math
import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from assay.llm import search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = {c: c + 32 for c in range(65, 91)}
ITEMS = "item_id long, text string"


def terms(text):
    return TERM.findall((text or "").translate(UPPER))


def brute(docs, items, top=50):
    bags = [(i, Counter(t)) for i, x in docs if (t := terms(x))]
    N, L = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in {(i, tuple(dict.fromkeys(terms(t)))) for i, t in items}:
        scored = []
        for doc, bag in bags:
            m = 50 + (50 * sum(bag.values()) * N) // L
            s = sum(math.floor(1000 * math.log((2 * N + 2) / (2 * df[t] + 1))) * ((10**9 * bag[t]) // (1000 * bag[t] + 20 * m))
                    for t in text if t in bag)
            if s > 0:
                scored.append((-s, doc is None, doc or 0))
        for rank, (s, unknown, doc) in enumerate(sorted(scored)[:top], 1):
            out.append((item, rank, None if unknown else doc, -s))
    return sorted(out, key=str)


def sample(rnd, n, size, words):
    return " ".join(rnd.choice(words) for _ in range(rnd.randrange(size))) + rnd.choice(["", ".", "\n", "é"])


def case(seed, n_docs=200, n_items=30):
    rnd = random.Random(seed)
    words = [w for k in range(60) for w in [f"w{k}", f"W{k}!", "É" + str(k), "the"]]
    docs = [(i, sample(rnd, n_docs, 50, words)) for i in range(n_docs)]
    docs += [(900, None), (901, ""), (902, "... --"), (None, "the w1 w2"), docs[3], docs[3], (-4, "the " * 5000 + "w1")]
    items = [(i, sample(rnd, n_items, 25, words)) for i in range(n_items)]
    items += [items[2], (3, "the w1 w2 w5"), (70, None), (71, "?!"), (72, "unseen"), (None, "w7 the"), (73, docs[5][1])]
    return docs, items


def rows(df):
    return sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in df.collect()), key=str)


def test_search(spark, docs):
    d, items = case(1)
    got = rows(search.op12(docs(d), spark.createDataFrame(items, ITEMS)))
    assert got == brute(d, items)
    assert len({r[0] for r in got}) > 30


def test_many_blocks_plans_and_small_lists(spark, docs, monkeypatch):
    for name, value in (("TERMS", 60), ("PLAN", 30), ("ITEMS", 4), ("COLUMNS", 16), ("CLASS", 2), ("MANY", 5), ("DEALS", 2)):
        monkeypatch.setattr(search, name, value)
    d, items = case(2)
    assert rows(search.search(docs(d).repartition(7), spark.createDataFrame(items, ITEMS), 3)) == brute(d, items, 3)


def test_ties_and_repeated_documents(spark, docs):
    d = [(i % 40, "same words here") for i in range(120)] + [(500, "other")]
    got = rows(search.op12(docs(d).repartition(6), spark.createDataFrame([(1, "words"), (1, "words")], ITEMS)))
    assert got == brute(d, [(1, "words")])
    assert len(got) == 50 and {r[3] for r in got} == {got[0][3]}


def test_plan_sums_equal_plain_sums():
    rnd = random.Random(5)
    items = [sorted({min(rnd.randrange(80), rnd.randrange(80)) for _ in range(rnd.randrange(40))}) for _ in range(60)]
    plan = search.Plan(items)
    values = np.random.default_rng(5).integers(0, 1 << 34, (80, 9))
    sums = np.zeros((plan.classes, 9), np.int64)
    for t, c in plan.class_of.items():
        sums[c] += values[t]
    want = np.array([values[i].sum(0) if i else np.zeros(9, np.int64) for i in items])
    assert (plan.scores(sums) == want).all()
    # shared sums are computed once: fewer additions than adding each item's classes
    alone = sum(len({plan.class_of[t] for t in i}) for i in items)
    assert plan.rounds and len(plan.parts) + plan.nodes - plan.classes < alone


def test_empty_tables_and_extra_columns(spark, docs):
    items = spark.createDataFrame([(1, "w1")], ITEMS)
    assert rows(search.op12(docs([]), items)) == []
    assert rows(search.op12(docs([(1, "w1")]), spark.createDataFrame([], ITEMS))) == []
    d = docs([(1, "w1 w2")])
    for c in ("score", "rank", "item_id", "terms", "n"):
        d, items = d.withColumn(c, F.lit("x")), items if c == "item_id" else items.withColumn(c, F.lit("x"))
    assert [r[:3] for r in rows(search.op12(d, items))] == [(1, 1, 1)]
