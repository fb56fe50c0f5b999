"""Periodic runs of words, by seed-and-extend along diagonals.

A run is a stretch of consecutive words with smallest period q and a length of at least
``max(LEAST, 2 * q)`` that no neighbouring word extends. Two words q apart lie on
diagonal (lag) q; a run is a stretch of equal pairs on it, of at least
``max(LEAST - q, q)`` words. So every run holds a repeated k-gram of a guaranteed length:

* lags 1 to 11: six words, a seed at every place;
* lags K to 2K - 1, K = 12, 24, 48, ...: any K equal pairs hold a gram of k = K / 2 words
  that starts at a multiple of k, so only those are seeds.

The index names the grams of each length exactly (a gram's name is the rank of the pair of
names of its parts, no hashing) and lists their places in order. A seed meets the later
places of its gram within its level's lags: at most 2K places for one seed in k words, so
pairs grow with the text alone, however often a gram occurs. Seeds inside a run of a
smaller period that covers them are dropped (their lag is a multiple of it). The table of
seeds by lag holds how far each lag is covered: a seed that starts where the one before it
on its lag ends is not extended again. What is left is extended both ways by comparing
names of grams, longest first. Of stretches with equal ends the smallest lag is the period.

Documents are taken many at a time; their words carry their number, so nothing matches
across them. A task holds some 200 bytes for each word of ``CHARS`` bytes of text, or of one
document if that is longer.

Defined results: a null or empty text has no words and no run; a null doc_id leaves its
text as it is; repeated rows are told each by itself; texts of any length are searched
whole; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assay.llm.pack import slices

LEAST = 12  # words of the shortest run
SEED = LEAST // 2  # words of the shortest repeated gram that a run guarantees
CHARS = 1 << 20  # bytes of text searched at a time


def words_of(text: str | None) -> list[bytes]:
    """Maximal stretches without space, tab, line feed, vertical tab, form feed or carriage return."""
    return text.encode().split() if text else []


def repeated(words: list, doc_id: int | None) -> list:
    """The contract's planted periods: the tail of one document in ten repeats its first words."""
    if doc_id is None or not words:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    unit = words[a:a + p]
    return words[:a] + (unit * (-(-(n - a) // p)))[:n - a]


def named(*parts: np.ndarray) -> np.ndarray:
    """Equal numbers for equal tuples of ``parts``."""
    code = parts[0].astype(np.int64)
    for p in parts[1:]:
        code = code * (int(p.max()) + 1) + p
    return np.unique(code, return_inverse=True)[1].astype(np.int32)


class Grams:
    """Names of the grams of growing lengths at each place; place n stands for the end and equals no other."""

    def __init__(self, codes: np.ndarray):
        self.n = len(codes)
        self.place = np.arange(self.n + 1)
        self.names = {1: named(np.append(codes, codes.max() + 1))}
        self.join(1, 1)
        self.join(1, 2)
        self.join(3, 3)

    def join(self, a: int, b: int) -> np.ndarray:
        """Names of grams of ``a`` + ``b`` words; those that pass the end are each one of a kind."""
        self.names[a + b] = named(self.names[a], self.names[b][np.minimum(self.place + a, self.n)])
        return self.names[a + b]

    def right(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Equal words from places ``x`` and ``y`` on."""
        x, y, out = x.copy(), y.copy(), np.zeros(len(x), np.int64)
        for size in sorted(self.names, reverse=True):
            name = self.names[size]
            go = np.arange(len(x))
            while len(go := go[name[x[go]] == name[y[go]]]):
                x[go] += size
                y[go] += size
                out[go] += size
        return out

    def left(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Equal words before places ``x`` < ``y``."""
        x, y, out = x.copy(), y.copy(), np.zeros(len(x), np.int64)
        for size in sorted(self.names, reverse=True):
            name = self.names[size]
            go = np.arange(len(x))
            while len(go := (go := go[x[go] >= size])[name[x[go] - size] == name[y[go] - size]]):
                x[go] -= size
                y[go] -= size
                out[go] += size
        return out


def occurrence_pairs(name: np.ndarray, step: int, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, lag) of each place that is a multiple of ``step`` and the later places of its gram, ``low`` to ``high`` words on."""
    n = len(name)
    if low == high:
        places = np.flatnonzero(name[:n - low] == name[low:])
        places = places[places % step == 0]
        return places, np.full(len(places), low)
    index = np.sort(name.astype(np.int64) * n + np.arange(n))  # by gram, then place
    seeds = np.arange(0, n, step)
    key = name[seeds].astype(np.int64) * n
    first = np.searchsorted(index, key + np.minimum(seeds + low, n))
    after = np.searchsorted(index, key + np.minimum(seeds + high + 1, n))
    count = np.maximum(after - first, 0)
    at = np.repeat(first - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
    places = np.repeat(seeds, count)
    return places, index[at] - name[places].astype(np.int64) * n - places


def levels(n: int):
    """(k, step, low, high): lags ``low`` to ``high`` are seeded by grams of ``k`` words at multiples of ``step``."""
    yield from ((SEED, 1, lag, lag) for lag in range(1, LEAST))
    k = SEED
    while 4 * k <= n:  # a run of period 2k has 4k words
        yield k, k, 2 * k, 4 * k - 1
        k *= 2


def runs_of(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of every run over ``codes``, words numbered by document and text, by start and period."""
    start, length, period = (np.zeros(0, np.int64) for _ in range(3))
    if len(codes) < LEAST:
        return start, length, period
    grams = Grams(codes)
    for k, step, low, high in levels(len(codes)):
        name = grams.names[k] if k in grams.names else grams.join(k // 2, k // 2)
        if int(name.max()) == len(name) - 1:  # no gram occurs twice: nor does a longer one
            break
        places, lags = occurrence_pairs(name[:-1], step, low, high)
        small = np.flatnonzero(period <= k) if step > 1 else []
        if len(small):
            # at most one run of a period up to k covers a gram and the next 2k words
            by = small[np.argsort(start[small], kind="stable")]
            reach = np.maximum.accumulate((start + length)[by])
            at = np.searchsorted(start[by], places, "right") - 1
            open_ = (at < 0) | (reach[np.maximum(at, 0)] < places + lags + k)
            places, lags = places[open_], lags[open_]
        if not len(places):
            continue
        by = np.lexsort((places, lags))
        places, lags = places[by], lags[by]
        # covered up to here on this lag: seeds that follow without a gap lie in one stretch
        fresh = np.ones(len(places), bool)
        fresh[1:] = (lags[1:] != lags[:-1]) | (places[1:] > places[:-1] + k)
        first = np.flatnonzero(fresh)
        last = np.append(first[1:], len(places)) - 1
        lag, lo, hi = lags[first], places[first], places[last] + k
        lo = lo - grams.left(lo, lo + lag)
        hi = hi + grams.right(hi, hi + lag)
        size = hi + lag - lo
        long = size >= np.maximum(LEAST, 2 * lag)
        start, length, period = (np.concatenate(p) for p in ((start, lo[long]), (length, size[long]), (period, lag[long])))
        # equal stretches: the smallest lag is the period, the others are multiples of it
        by = np.lexsort((period, length, start))
        start, length, period = start[by], length[by], period[by]
        new = np.ones(len(start), bool)
        new[1:] = (start[1:] != start[:-1]) | (length[1:] != length[:-1])
        start, length, period = start[new], length[new], period[new]
    by = np.lexsort((period, start))
    return start[by], length[by], period[by]


def tell(ids: list, texts: list) -> list[tuple]:
    """(doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256) of each document."""
    docs = [repeated(words_of(t), i) for i, t in zip(ids, texts)]
    sizes = np.array([len(d) for d in docs], np.int64)
    ends = np.cumsum(sizes)
    known: dict[bytes, int] = {}
    spoken = [known.setdefault(w, len(known)) for d in docs for w in d]
    owner = np.repeat(np.arange(len(docs)), sizes)
    codes = owner * (len(known) + 1) + np.array(spoken, np.int64) if spoken else np.zeros(0, np.int64)
    start, length, period = runs_of(codes)
    change = np.zeros(len(codes) + 1, np.int64)
    np.add.at(change, start + period, 1)
    np.add.at(change, start + length, -1)
    dropped = np.cumsum(change[:-1]) > 0
    of = owner[start] if len(start) else start
    cut = np.searchsorted(of, np.arange(len(docs) + 1))
    out = []
    for d, (key, words) in enumerate(zip(ids, docs)):
        lo, hi, at = int(cut[d]), int(cut[d + 1]), int(ends[d] - sizes[d])
        best = (None, None, None, None)
        lines = ""
        if hi > lo:
            rows = list(zip((start[lo:hi] - at).tolist(), length[lo:hi].tolist(), period[lo:hi].tolist()))
            s, n, q = min(rows, key=lambda r: (-r[1], r[0], r[2]))
            best = (s, n, q, 1000 * n // q)
            lines = "".join(f"{s},{n},{q}\n" for s, n, q in rows)
            words = [w for w, gone in zip(words, dropped[at:at + len(words)].tolist()) if not gone]
        out.append((key, hi - lo, *best, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(b" ".join(words)).hexdigest()))
    return out


ROWS = ("doc_id long, n_runs long, start long, length long, period long, exponent_milli long, "
        "runs_sha256 string, collapsed_sha256 string")


def find_runs(docs: DataFrame) -> DataFrame:
    """One row per document: its runs' number and digest, the longest run, and the digest of the text without the repeats."""
    names = [c.split()[0] for c in ROWS.split(", ")]

    def run(batches):
        import pyarrow as pa
        types = [pa.int64()] * 6 + [pa.string()] * 2

        def told(ids, texts):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*tell(ids, texts)), types)], names)

        for b in (x for batch in batches for x in slices(batch, CHARS)):
            if b.num_rows:
                yield told(b.column(0).to_pylist(), b.column(1).to_pylist())
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, ROWS)


def op11(docs: DataFrame) -> DataFrame:
    return find_runs(docs)
