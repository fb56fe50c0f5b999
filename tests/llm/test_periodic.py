"""Periodic runs against a brute force over every lag."""

import hashlib
import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from assay.llm import periodic
from assay.llm.common import table


def brute_runs(words):
    """Every maximal stretch with a period, by walking each lag; of equal stretches the smallest period."""
    n, found = len(words), {}
    for q in range(1, n // 2 + 1):
        x = 0
        while x + q < n:
            s = x
            while x + q < n and words[x] == words[x + q]:
                x += 1
            size = x + q - s
            if x > s and size >= max(12, 2 * q):
                found.setdefault((s, size), q)
            x += x == s
    return sorted((s, size, q) for (s, size), q in found.items())


def brute_row(doc_id, text):
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", text or "") if w]
    n = len(words)
    if doc_id is not None and n and (h := zlib.crc32(str(doc_id).encode())) % 10 == 0:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
    runs = sorted(brute_runs(words), key=lambda r: (r[0], r[2]))
    kept = [w for i, w in enumerate(words) if not any(s + q <= i < s + size for s, size, q in runs)]
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    return (doc_id, len(runs), *((*best, 1000 * best[1] // best[2]) if best else (None,) * 4),
            hashlib.sha256("".join(f"{s},{size},{q}\n" for s, size, q in runs).encode()).hexdigest(),
            hashlib.sha256(" ".join(kept).encode()).hexdigest())


def periodic_text(rnd):
    letters = "abcdefghijklmnopqrstuvwxyz"[:rnd.choice([1, 2, 2, 3, 5, 26])]
    words = [rnd.choice(letters) for _ in range(rnd.choice([0, 4, 12, 13, 30, 80, 200]))]
    for _ in range(rnd.randrange(4)):
        if words:
            at, size = rnd.randrange(len(words)), rnd.randrange(1, 60)
            words[at:at] = words[at:at + size] * rnd.randrange(1, 6)
    return words[:500]


def test_runs_of_many_documents_at_once():
    rnd = random.Random(11)
    for _ in range(60):
        docs = [periodic_text(rnd) for _ in range(rnd.randrange(1, 6))]
        codes = np.array([1000 * d + ord(w) for d, words in enumerate(docs) for w in words], np.int64)
        got = list(zip(*(x.tolist() for x in periodic.runs_of(codes))))
        want, at = [], 0
        for words in docs:
            want += sorted([(s + at, size, q) for s, size, q in brute_runs(words)], key=lambda r: (r[0], r[2]))
            at += len(words)
        assert got == want


def test_rows(spark, docs):
    rnd = random.Random(12)
    rows = [(i, rnd.choice([" ", "\n", "\t \x0b"]).join(periodic_text(rnd))) for i in range(120)]
    rows += [(200, None), (201, ""), (202, " \n"), (None, "x " * 40), (-5, "é\u00a0ü é\u00a0ü " * 9), rows[7], rows[7], (203, "no run here")]
    got = sorted((tuple(r) for r in periodic.op11(docs(rows)).collect()), key=str)
    assert got == sorted((brute_row(*r) for r in rows), key=str)
    assert any(r[1] > 1 for r in got)


def test_whole_small_table(spark):
    documents = table(spark, "/root/testdata/sf0.001", "documents")
    small = [(r["doc_id"], r["text"]) for r in documents.select("doc_id", "text").collect()]
    got = {r["doc_id"]: tuple(r) for r in periodic.op11(documents).collect()}
    short = [r for r in small if len((r[1] or "").split()) < 700]
    assert len(got) == len(small) and len(short) > 150
    for r in short:
        assert got[r[0]] == brute_row(*r)


def test_pairs_stay_linear_in_repetitive_texts():
    for words in (np.zeros(40_000, np.int64), np.arange(40_000) % 7, np.random.default_rng(1).integers(0, 2, 40_000)):
        grams = periodic.Grams(words)
        for k, step, low, high in periodic.levels(len(words)):
            name = grams.names[k] if k in grams.names else grams.join(k // 2, k // 2)
            places, _ = periodic.occurrence_pairs(name[:-1], step, low, high)
            assert len(places) <= 2 * len(words) + 2 * high
    start, length, period = periodic.runs_of(np.arange(300_000) % 7)
    assert (start.tolist(), length.tolist(), period.tolist()) == ([0], [300_000], [7])


def test_very_long_text_empty_table_and_extra_columns(spark, docs):
    long = " ".join(str(i % 90_001) for i in range(200_000))
    row = periodic.op11(docs([(1, long)])).first()
    assert (row["n_runs"], row["start"], row["length"], row["period"]) == (1, 0, 200_000, 90_001)
    assert periodic.op11(docs([])).collect() == []
    extra = docs([(1, "a b " * 10)])
    for c in ("start", "length", "period", "n_runs", "words"):
        extra = extra.withColumn(c, F.lit("x"))
    assert periodic.op11(extra).count() == 1
