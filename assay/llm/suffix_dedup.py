"""Exact removal of repeated 400-byte strings by a distributed merge sort of suffixes.

Copies first. Texts are told apart by SHA-256: of a text that stands twice every 400-byte
string repeats, so only one row of it goes on, to be met by other texts, and its result
needs no search.

Sparse suffixes. In every 400-byte window the smallest hash of 32 bytes marks an anchor,
so equal windows have equal anchors at equal offsets. Consecutive windows with the same
anchor form one entry: the text from its first window's start to its last one's end.
Windows that occur twice in a document are told there, by 400-byte rolling hashes, and
stand once in its entries. Only anchors whose 32 bytes occur at least twice in the corpus
go on (the counts are one aggregate with map-side sums).

Merge sort. Tasks sort their entries by the suffix from the anchor, then by the reversed
text before it, front-code them (length shared with the one before, then the rest) and
send each range of the sort order to its merge task, ranges being cut at sampled anchors.
There a loser tree merges the runs: each candidate carries the length it shares with the
last winner, candidates are told apart by those lengths alone where they differ, and
where they do not, comparing begins behind the known prefix. The lengths that the merge
hands out decide: equal entries are one with a count; two entries of one anchor that share
``r`` bytes from it on and ``l`` before it share the windows at offsets ``400 - r`` to ``l``.
All pairs that matter are found by joining neighbours in the order of falling ``r`` and
looking, in the order of the texts before the anchor, at the nearest on either side.

A merge task takes whole anchors. Those with over ``HOT`` entries of different texts would not
fit one, and are told by narrowing instead: an entry is cut into cells of offsets; in a cell
all its windows share a core, so an entry whose core is alone is done, entries with the same
whole cell repeat in all of it, and what is left is cut four times finer, down to a window.
Each step is a sum by key with map-side combine and a join with one row a key.

Defined results: a null or empty text has 0 bytes; texts under 400 bytes keep all;
repeated rows are copies of each other; texts of any length are read whole, a piece at a
time; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import bisect
import hashlib
from functools import reduce
import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assay.llm import common

WIDTH = 400
GRAM = 32
SPAN = WIDTH - GRAM + 1  # grams in a window
HOT = 4_096  # entries of one anchor that a merge task takes
END = b"\xff"  # between the two parts of a sort key: no byte of UTF-8, so shared lengths never run over
CELLS = (64, 16, 4, 1)  # offsets in a cell while narrowing
PIECE = 1 << 20  # bytes of a long text scanned at a time
RUN_BYTES = 16 << 20  # of a sorted run
PART_BYTES = 4 << 20  # of entries aimed at in a merge task
RANGES = 4_096  # of the sort order at most; beyond, each range is dealt by hash of the anchor's bytes
SAMPLED = 32  # anchors sampled for each range

_rng = np.random.default_rng(400)
TABLES = _rng.integers(1, 1 << 63, (2, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASES = [0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93]  # odd: they have inverses modulo 2^64
HEAD = struct.Struct("<HHHqq")


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_powers: dict[int, tuple] = {}


def rolling(b: np.ndarray, width: int, which: int = 0) -> np.ndarray:
    """Polynomial hash modulo 2^64 of every ``width`` bytes, from one cumulative sum."""
    n = len(b)
    if len(_powers.get(which, ((), ()))[0]) < n + 1:
        base = BASES[which]
        size = max(n + 1, 1 << 16)
        _powers[which] = powers(base, size), powers(pow(base, -1, 1 << 64), size)
    up, down = _powers[which]
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(TABLES[which][b] * down[:n], dtype=np.uint64, out=total[1:])
    return mixed((total[width:] - total[:-width]) * up[:n - width + 1])


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` values: the least of a block's tail and the next block's head."""
    n = len(x)
    padded = np.concatenate([x, np.full(-n % width, np.iinfo(x.dtype).max, x.dtype)]).reshape(-1, width)
    head = np.minimum.accumulate(padded, axis=1).ravel()
    tail = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(tail[:n - width + 1], head[width - 1:n])


def entries(text: bytes) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Rows (gram hash, anchor, first window, last window) of the distinct windows of ``text``, and its ranges of windows that recur in it."""
    n = len(text)
    if n < WIDTH:
        return np.empty((0, 4), np.int64), []
    b = np.frombuffer(text, np.uint8)
    parts = []
    for at in range(0, n - WIDTH + 1, PIECE):
        x = b[at:at + PIECE + WIDTH - 1]
        grams = rolling(x, GRAM)
        low = sliding_min((grams & ~np.uint64(0xFFFFFF)) | np.arange(len(grams), dtype=np.uint64), SPAN)
        cut = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]]))
        anchor = (low[cut] & np.uint64(0xFFFFFF)).astype(np.int64)
        last = np.append(cut[1:], len(low)) - 1
        parts.append(np.stack([grams[anchor].view(np.int64), anchor + at, cut + at, last + at], 1))
    rows = np.concatenate(parts)
    if len(np.unique(rows[:, 0])) == len(rows):
        return rows, []
    # only windows whose anchors recur can recur
    again = np.isin(rows[:, 0], [g for g, c in zip(*np.unique(rows[:, 0], return_counts=True)) if c > 1])
    at = np.concatenate([np.arange(lo, hi + 1) for _, _, lo, hi in rows[again].tolist()])
    h = np.stack([window_hashes(b, w)[at] for w in (0, 1)])
    order = np.lexsort((at, h[1], h[0]))
    same = (h[:, order[1:]] == h[:, order[:-1]]).all(0)
    repeated = np.zeros(n - WIDTH + 1, bool)
    repeated[at[order[1:][same]]] = repeated[at[order[:-1][same]]] = True
    if not repeated.any():
        return rows, []
    later = np.zeros(n - WIDTH + 1, bool)  # all but the first of each
    later[at[order[1:][same]]] = True
    kept = []
    for g, a, lo, hi in rows.tolist():
        if later[lo:hi + 1].any():
            kept += [(g, a, lo + s, lo + e) for s, e in ranges(~later[lo:hi + 1])]
        else:
            kept.append((g, a, lo, hi))
    return np.array(kept, np.int64).reshape(-1, 4), ranges(repeated)


def window_hashes(b: np.ndarray, which: int) -> np.ndarray:
    return np.concatenate([rolling(b[at:at + PIECE + WIDTH - 1], WIDTH, which) for at in range(0, len(b) - WIDTH + 1, PIECE)])


def ranges(flags: np.ndarray) -> list[tuple[int, int]]:
    """First and last index of each run of true flags."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], flags, [False]])))
    return list(zip(edge[::2].tolist(), (edge[1::2] - 1).tolist()))


def shared_prefix(a: bytes, b: bytes, at: int) -> int:
    """Length of the common prefix of ``a`` and ``b``, known to be at least ``at``."""
    n = min(len(a), len(b))
    x, y = a[at:n], b[at:n]
    if x == y:
        return n
    gap = int.from_bytes(x, "big") ^ int.from_bytes(y, "big")
    return n - (gap.bit_length() + 7) // 8


class Run:
    """Reads a front-coded run; ``key`` is the current entry's sort key."""

    def __init__(self, blobs: list[bytes]):
        self.blobs, self.blob, self.at, self.key = iter(blobs), b"", 0, b""
        self.next()

    def next(self) -> int:
        """Go on; the length shared with the entry before, or -1 at the end."""
        while self.at >= len(self.blob):
            self.blob, self.at = next(self.blobs, None), 0
            if self.blob is None:
                self.key = None
                return -1
        lcp, rest, self.right, self.row, self.start = HEAD.unpack_from(self.blob, self.at)
        at = self.at + HEAD.size
        self.at = at + rest
        self.key = self.key[:lcp] + self.blob[at:self.at]
        return lcp


def merge(runs: list[Run]):
    """The runs' entries in order, each with the length it shares with the one before: a loser tree over those lengths.

    An inner node holds the loser of its match and the length that it shares with the winner.
    A player with the longer shared length is the smaller; equal lengths are compared behind them.
    """
    runs = [r for r in runs if r.key is not None]
    k = len(runs)
    if not k:
        return
    losers: list[tuple[int, int]] = [(-1, 0)] * k

    def play(i: int, li: int, j: int, lj: int):
        """Winner with its length, loser with its length."""
        a, b = runs[i].key, runs[j].key
        if a is None:
            return j, lj, i, -1
        if b is None:
            return i, li, j, -1
        if li != lj:
            return (i, li, j, lj) if li > lj else (j, lj, i, li)
        both = shared_prefix(a, b, li)
        if a[both:both + 1] <= b[both:both + 1]:
            return i, li, j, both
        return j, lj, i, both

    def build(node: int) -> tuple[int, int]:
        if node >= k:
            return node - k, 0
        (i, li), (j, lj) = build(2 * node), build(2 * node + 1)
        w, lw, x, lx = play(i, li, j, lj)
        losers[node] = (x, lx)
        return w, lw

    winner, shared = build(1) if k > 1 else (0, 0)
    while runs[winner].key is not None:
        yield runs[winner], shared
        shared = runs[winner].next()
        node = (winner + k) // 2
        while node:
            x, lx = losers[node]
            winner, shared, x, lx = play(winner, shared, x, lx)
            losers[node] = (x, lx)
            node //= 2


def front_coded(items: list[tuple], splitters: list[bytes], deals: int) -> list[tuple[int, bytes]]:
    """(key, right, row, start) items, sorted, as (merge task, front-coded run) pieces."""
    dealt = sorted((zlib.crc32(x[0][:GRAM]) % deals, *x) for x in items) if deals > 1 else [(0, *x) for x in sorted(items)]
    out, blob, prev, part = [], [], b"", -1
    for deal, key, right, row, start in dealt:
        to = bisect.bisect_right(splitters, key[:GRAM]) * deals + deal
        if to != part:
            if blob:
                out.append((part, b"".join(blob)))
            blob, prev, part = [], b"", to
        lcp = shared_prefix(prev, key, 0)
        blob += [HEAD.pack(lcp, len(key) - lcp, right, row, start), key[lcp:]]
        prev = key
    if blob:
        out.append((part, b"".join(blob)))
    return out


def joined(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Closed ranges of integers as few disjoint ones."""
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(out[-1][1], hi))
        else:
            out.append((lo, hi))
    return out


def shared_offsets(rights: list[int], befores: list[bytes], shared: list[int]) -> list[list[tuple[int, int]]]:
    """For each of some different entries of one anchor, in the order of what follows it: the offsets whose windows another one has too.

    ``rights``: bytes from the anchor on; ``befores``: the reversed text before it; ``shared[i]``: bytes from the anchor on that entries
    i - 1 and i share. Blocks of neighbours are joined in the order of falling shared length; when two blocks meet, each entry of the
    smaller one looks at its neighbours among the texts before the anchor. Any other pair shares less than pairs already seen.
    """
    m = len(rights)
    found: list[list[tuple[int, int]]] = [[] for _ in rights]

    def meet(i: int, j: int, r: int) -> None:
        before = shared_prefix(befores[i], befores[j], 0)
        if before + r >= WIDTH:
            found[i].append((WIDTH - r, before))
            found[j].append((WIDTH - r, before))

    if m == 2:
        meet(0, 1, shared[1])
        return found
    order = sorted(range(m), key=befores.__getitem__)
    place = [0] * m
    for at, i in enumerate(order):
        place[i] = at
    block = list(range(m))  # of each entry, as its first and last ones know it
    members: dict[int, list[int]] = {i: [place[i]] for i in range(m)}  # places in the order of befores, sorted

    def top(i: int) -> int:
        while block[i] != i:
            block[i] = block[block[i]]
            i = block[i]
        return i

    for i in sorted(range(1, m), key=lambda i: -shared[i]):
        a, b = top(i - 1), top(i)
        if len(members[a]) < len(members[b]):
            a, b = b, a
        large = members[a]
        for x in members.pop(b):
            at = bisect.bisect(large, x)
            if at:
                meet(order[x], order[large[at - 1]], shared[i])
            if at < len(large):
                meet(order[x], order[large[at]], shared[i])
            large.insert(at, x)
        block[b] = a
    return [joined(f) for f in found]


def repeated_starts(group: list[tuple]) -> list[tuple[int, int, int]]:
    """(row, first, last) ranges of window starts that occur twice or more among the entries of an anchor, in merge order:
    (key, right, row, start, bytes shared with the one before)."""
    kinds: list[tuple] = []  # different entries, each with those that are equal to it
    for key, right, row, start, shared in group:
        if kinds and shared == len(key) == len(kinds[-1][0]) and right == kinds[-1][1]:
            kinds[-1][3].append((row, start))
        else:
            kinds.append((key, right, shared, [(row, start)]))
    found: list[list[tuple[int, int]]] = [[]]
    if len(kinds) > 1:
        rights = [k[1] for k in kinds]
        shared = [0] + [min(kinds[i][2], rights[i - 1], rights[i]) for i in range(1, len(kinds))]
        found = shared_offsets(rights, [k[0][k[1] + 1:] for k in kinds], shared)
    out = []
    for (key, right, _, who), offsets in zip(kinds, found):
        most = len(key) - right - 1  # the offset of the first window
        if len(who) > 1:
            offsets = [(WIDTH - right, most)]
        out += [(row, start + most - hi, start + most - lo) for row, start in who for lo, hi in offsets]
    return out


FOUND = "_rid long, lo long, hi long"
SCANNED = "kind int, part int, blob binary, _rid long, a long, lo long, hi long"


def scan_entries(batches):
    """(gram, gram's bytes where sampled, row, anchor) of every entry."""
    for b in batches:
        out = []
        for row, text in zip(b["_rid"].tolist(), b["text"]):
            raw = text.encode()
            rows, again = entries(raw)
            # one entry of a document with windows of its own twice counts twice, so that the document goes on
            for g, a, _, _ in [*rows.tolist(), *rows[:len(again) > 0].tolist()]:
                out.append((g, raw[a:a + GRAM] if g & 0xFF == 0 else None, row, a))
        yield pd.DataFrame(out, columns=["gram", "bytes", "_rid", "anchor"])


def sort_entries(splitters: list[bytes], deals: int):
    """From documents with their anchors to go on: front-coded runs (kind 0), entries of hot anchors with their bytes (1),
    ranges that recur in the document (2)."""
    cols = [c.split()[0] for c in SCANNED.split(", ")]

    def runs(items):
        return [(0, p, blob, *[None] * 4) for p, blob in front_coded(items, splitters, deals)]

    def run(batches):
        items, held = [], 0
        for b in batches:
            out = []
            for row, text, anchors, hot in zip(b["_rid"].tolist(), b["text"], b["anchors"], b["hot"]):
                raw = text.encode()
                rows, again = entries(raw)
                out += [(2, None, None, row, None, lo, hi) for lo, hi in again]
                go, hot = set(anchors.tolist()), set(hot.tolist())
                for _, a, lo, hi in rows.tolist():
                    if a in hot:
                        out.append((1, None, raw[lo:hi + WIDTH], row, a, lo, hi))
                    elif a in go:
                        items.append((raw[a:hi + WIDTH] + END + raw[lo:a][::-1], hi + WIDTH - a, row, lo))
                        held += hi + WIDTH - lo + 64
                if held > RUN_BYTES:
                    out += runs(items)
                    items, held = [], 0
            if out:
                yield pd.DataFrame(out, columns=cols).astype({c: "Int64" for c in cols if c != "blob"})
        if items:
            yield pd.DataFrame(runs(items), columns=cols).astype({c: "Int64" for c in cols if c != "blob"})
    return run


def merge_runs(runs: pd.DataFrame) -> pd.DataFrame:
    found, group = [], []

    def close():
        nonlocal group
        if len(group) > 1:
            found.extend(repeated_starts(group))
        group = []

    for r, shared in merge([Run([x]) for x in runs["blob"]]):
        if shared < GRAM:
            close()
        group.append((r.key, r.right, r.row, r.start, shared))
    close()
    return pd.DataFrame(found, columns=["_rid", "lo", "hi"])


def narrowed(entries: DataFrame) -> list[DataFrame]:
    """(_rid, lo, hi) ranges of window starts that occur twice or more among ``entries`` (_rid, a, lo, hi, blob: their bytes)."""
    if not entries.head(1):
        return []
    open_ = entries.select("_rid", "a", "lo", "hi", "blob", F.xxhash64("_rid", "a").alias("id"),
                           (F.col("a") - F.col("hi")).alias("o0"), (F.col("a") - F.col("lo")).alias("o1"))
    done = []
    for w in CELLS:
        cells = open_.withColumn("c", F.explode(F.sequence(F.floor(F.col("o0") / w), F.floor(F.col("o1") / w))))
        low, high = F.greatest("o0", F.col("c") * w), F.least("o1", F.col("c") * w + (w - 1))
        part = lambda at, size: F.md5(F.substring("blob", (at + 1).cast("int"), size.cast("int")))
        cells = common.materialize(cells.withColumn("o0", low).withColumn("o1", high).withColumn(
            "core", part(F.col("a") - F.col("c") * w - F.col("lo"), F.lit(WIDTH - w + 1))).withColumn(
            "whole", part(F.col("a") - F.col("o1") - F.col("lo"), F.col("o1") - F.col("o0") + WIDTH)), "cells")
        keys = ["c", "core", "o0", "o1", "whole"]
        kinds = cells.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))
        cores = kinds.groupBy("c", "core").agg(F.sum("n").alias("all"), F.count(F.lit(1)).alias("kinds")).filter(F.col("all") > 1)
        met = common.materialize(cells.join(kinds.join(cores, ["c", "core"]), keys), "met")
        done.append(met.filter(F.col("n") > 1).select("_rid", (F.col("a") - F.col("o1")).alias("lo"), (F.col("a") - F.col("o0")).alias("hi")))
        open_ = met.filter((F.col("kinds") > 1) & ((F.col("n") == 1) | (F.col("id") == F.col("first")))).select(*open_.columns)
        if w > CELLS[-1] and not open_.head(1):
            break
    return done


def remove(raw: bytes, spans: list) -> tuple[int, int, str]:
    """Bytes removed, maximal removed runs and the SHA-256 of the rest, for ranges of window starts."""
    kept, at, n, runs = hashlib.sha256(), 0, 0, 0
    end = -1
    for lo, hi in sorted(spans):
        if lo > end:
            if end >= 0:
                at = end
            kept.update(raw[at:lo])
            runs += 1
            n += hi + WIDTH - lo
            end = hi + WIDTH
        elif hi + WIDTH > end:
            n += hi + WIDTH - end
            end = hi + WIDTH
    kept.update(raw[max(end, 0):])
    return n, runs, kept.hexdigest()


def repeated_ranges(texts: DataFrame, spare: DataFrame, hot: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(_rid, lo, hi): ranges of starts of 400-byte strings that also start elsewhere, and the rows (_rid, text) they are in.
    ``texts``: _rid, text; ``spare``: _rid of further rows of a text, which are left out."""
    spark = texts.sparkSession
    hot = HOT if hot is None else hot
    grams = common.materialize(texts.mapInPandas(scan_entries, "gram long, bytes binary, _rid long, anchor long"), "grams")
    grams = grams.join(spare, "_rid", "left_anti")
    often = common.materialize(grams.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "often")
    going = common.materialize(grams.join(often, "gram").groupBy("_rid").agg(
        F.collect_set(F.when(F.col("n") <= hot, F.col("anchor"))).alias("anchors"),
        F.collect_set(F.when(F.col("n") > hot, F.col("anchor"))).alias("hot")), "anchors")
    size = going.agg(F.sum(F.size("anchors"))).first()[0] or 0
    tasks = max(1, size * (WIDTH + SPAN // 2) // PART_BYTES)
    parts = min(tasks, RANGES)
    deals = -(-tasks // parts)
    drawn = grams.filter("bytes is not null").join(often, "gram").select("bytes", F.xxhash64("_rid", "anchor").alias("x")) \
        .orderBy("x", "bytes").limit(parts * SAMPLED)
    sample = sorted(bytes(r["bytes"]) for r in drawn.collect())
    splitters = sorted(set(sample[SAMPLED::SAMPLED]))
    whole = common.materialize(texts.join(going, "_rid").select("_rid", "text", "anchors", "hot"), "going")
    scanned = common.materialize(whole.mapInPandas(sort_entries(splitters, deals), SCANNED), "runs")
    merged = scanned.filter("kind = 0").select("part", "blob").groupBy("part").applyInPandas(merge_runs, FOUND)
    inside = scanned.filter("kind = 2").select("_rid", "lo", "hi")
    crowded = narrowed(scanned.filter("kind = 1").select("_rid", "a", "lo", "hi", "blob"))
    return reduce(DataFrame.unionByName, [merged, inside, *crowded]), whole.select("_rid", "text")


def dedup(docs: DataFrame, hot: int | None = None) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, and kept (nothing of it was removed) of every row."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = common.with_row_id(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.sha2(text, 256).alias("h"),
                                          F.octet_length(text).cast("long").alias("n_bytes")), "texts")
    long = rows.filter(F.col("n_bytes") >= WIDTH)
    twice = common.materialize(long.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min("_rid").alias("one")).filter("n > 1"), "copies")
    spare = common.materialize(long.select("_rid", "h").join(twice, "h").filter(F.col("_rid") != F.col("one")).select("_rid"), "spare")
    found, whole = repeated_ranges(long.select("_rid", "text"), spare, hot)
    # ranges of a text's own windows: as many as it has anchors, and of its cells
    spans = found.groupBy("_rid").agg(F.collect_set(F.struct("lo", "hi")).alias("spans"))

    @F.pandas_udf("n_removed long, n_spans long, kept_sha256 string")
    def cut(texts: pd.Series, spans: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([remove(t.encode(), [(s["lo"], s["hi"]) for s in sp]) for t, sp in zip(texts, spans)],
                            columns=["n_removed", "n_spans", "kept_sha256"])

    some = whole.join(spans, "_rid").select("_rid", cut("text", "spans").alias("c"))
    told = (rows.select("_rid", "doc_id", "h", "n_bytes").join(some, "_rid", "left")
            .join(twice.select("h", F.lit(True).alias("_copy")), "h", "left"))
    copy = F.coalesce("_copy", F.lit(False))
    none = F.lit(0).cast("long")
    return told.select(
        "doc_id", "n_bytes", F.when(copy, F.col("n_bytes")).otherwise(F.coalesce("c.n_removed", none)).alias("n_removed"),
        F.when(copy, F.lit(1).cast("long")).otherwise(F.coalesce("c.n_spans", none)).alias("n_spans"),
        F.when(copy, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("c.kept_sha256", "h")).alias("kept_sha256"),
        (~copy & (F.coalesce("c.n_removed", none) == 0)).alias("kept"))


def op8(docs: DataFrame) -> DataFrame:
    return dedup(docs.select("doc_id", "text"))
