"""Removal of repeated 400-byte strings against a dictionary of all windows."""

import hashlib
import random

import pytest

from assay.llm import suffix_dedup as S


def brute(rows):
    seen: dict[bytes, list] = {}
    for i, (_, t) in enumerate(rows):
        raw = (t or "").encode()
        for s in range(len(raw) - S.WIDTH + 1):
            seen.setdefault(raw[s:s + S.WIDTH], []).append((i, s))
    cover = [bytearray(len((t or "").encode())) for _, t in rows]
    for places in seen.values():
        if len(places) > 1:
            for i, s in places:
                cover[i][s:s + S.WIDTH] = b"\x01" * S.WIDTH
    out = []
    for (doc, t), c in zip(rows, cover):
        raw = (t or "").encode()
        kept = bytes(x for x, f in zip(raw, c) if not f)
        spans = sum(1 for k, f in enumerate(c) if f and (k == 0 or not c[k - 1]))
        out.append((doc, len(raw), sum(c), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def corpus(seed):
    rnd = random.Random(seed)
    words = ["".join(rnd.choice("abcdeé") for _ in range(rnd.randint(1, 7))) for _ in range(80)]
    say = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    shared = [say(rnd.randint(60, 200)) for _ in range(4)] + [say(400)[:k] for k in (399, 400, 401, 420)]
    rows = []
    for i in range(40):
        text = say(rnd.randint(0, 300))
        for _ in range(rnd.randint(0, 3)):
            p = rnd.choice(shared)
            cut = rnd.randint(0, len(p) // 3)
            at = rnd.randint(0, len(text))
            text = text[:at] + p[cut:] + text[at:]
        rows.append((i, text))
    for i in range(40, 60):  # near copies: one character changed
        t = rnd.choice(rows)[1]
        if t:
            k = rnd.randrange(len(t))
            t = t[:k] + "Z" + t[k + 1:]
        rows.append((i, t))
    rows += [(60, rows[3][1]), (60, rows[3][1]), (61, None), (62, ""), (63, "ab" * 900), (64, "a" * 1200), (65, " " * 399),
             (66, "x" * 500 + say(50) + "x" * 500), (None, shared[0] * 2)]
    return rows


@pytest.mark.parametrize("seed,hot", [(1, S.HOT), (2, S.HOT), (3, 3)])
def test_against_all_windows(docs, monkeypatch, seed, hot):
    rows = corpus(seed)
    got = [tuple(r) for r in S.dedup(docs(rows).select("doc_id", "text").repartition(5), hot).collect()]
    assert sorted((r[:5] for r in got), key=str) == brute(rows)
    assert all(r[5] == (r[2] == 0) for r in got)


def test_one_row_many_times_and_a_passage_in_many_contexts(docs, monkeypatch):
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(6))
    passage = " ".join(word() for _ in range(90))
    rows = [(1, passage + " x")] * 20_000 + [(2, passage)] + [(i, " ".join(word() for _ in range(20)) + passage + " ".join(word() for _ in range(20)))
                                                              for i in range(3, 203)]
    expected = {r[0]: r for r in brute(rows[19_998:])}
    made = []
    monkeypatch.setattr(S.common, "materialize", lambda df, name, keep=S.common.materialize: made.append((name, out := keep(df, name))) or out)
    for hot in (None, 50):
        got = S.dedup(docs(rows).select("doc_id", "text"), hot)
        assert {r["doc_id"]: tuple(r)[:5] for r in got.collect()} == expected
        assert got.count() == len(rows)
        # what is searched grows with the texts, not with their copies
        assert all(df.count() < 12_000 for name, df in made if name in ("often", "anchors", "going", "runs", "cells", "met"))
        made.clear()


def test_shared_offsets_against_all_pairs():
    rnd = random.Random(4)
    for _ in range(200):
        m = rnd.choice([2, 3, 5, 9, 30])
        stock = ["".join(rnd.choice("ab") for _ in range(400)) for _ in range(3)]
        made = set()
        while len(made) < m:
            right = rnd.choice(stock)[:rnd.randint(32, 399)]
            before = rnd.choice(stock)[:rnd.randint(1, 368)]
            if rnd.random() < 0.5:
                k = rnd.randrange(32, len(right) + 1)
                right = right[:k] + "".join(rnd.choice("ab") for _ in range(rnd.randint(0, 60)))
            if rnd.random() < 0.5:
                before = before[:rnd.randrange(len(before))] + "".join(rnd.choice("ab") for _ in range(rnd.randint(0, 60)))
            if len(right) <= 400 and len(before) <= 368 and len(right) + len(before) >= 400:
                made.add((right.encode(), before.encode()))
        keys = sorted((r + S.END + b, len(r)) for r, b in made)
        group = [(k, r, i, 1000 * i, 0 if i == 0 else S.shared_prefix(keys[i - 1][0], k, 0)) for i, (k, r) in enumerate(keys)]
        got = {}
        for row, lo, hi in S.repeated_starts(group):
            got.setdefault(row, set()).update(range(lo, hi + 1))
        want = {}
        for i, (k, r) in enumerate(keys):
            for j, (q, t) in enumerate(keys):
                if i != j:
                    shared = min(S.shared_prefix(k[:r], q[:t], 0), r, t)
                    before = S.shared_prefix(k[r + 1:], q[t + 1:], 0)
                    most = len(k) - r - 1
                    if shared + before >= 400:
                        want.setdefault(i, set()).update(1000 * i + most - o for o in range(400 - shared, before + 1))
        assert got == want


def test_long_text_in_pieces():
    rnd = random.Random(5)
    text = "".join(rnd.choice("abcdefgh ") for _ in range(5000))
    whole, _ = S.entries(text.encode())
    keep = S.PIECE
    try:
        S.PIECE = 700
        parts, again = S.entries(text.encode())
    finally:
        S.PIECE = keep
    cover = lambda rows: sorted((a, s) for _, a, lo, hi in rows.tolist() for s in range(lo, hi + 1))
    assert cover(whole) == cover(parts) and not again


def test_loser_tree_is_a_sort():
    rnd = random.Random(7)
    items = [(bytes(rnd.choice(b"ab") for _ in range(rnd.randint(32, 60))), 32, i, 0) for i in range(500)]
    runs = [S.front_coded(items[k::7], [], 1)[0][1] for k in range(7)]
    merged = [(r.key, shared) for r, shared in S.merge([S.Run([x]) for x in runs])]
    assert [k for k, _ in merged] == sorted(x[0] for x in items)
    for (a, _), (b, shared) in zip(merged, merged[1:]):
        n = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        assert shared == n


def test_ranges_and_deals_keep_an_anchor_together():
    items = [(bytes([i % 5 + 65]) * 40, 32, i, 0) for i in range(50)]
    seen = {}
    for part, blob in S.front_coded(items, [b"B" * 32, b"D" * 32], 3):
        r = S.Run([blob])
        while r.key is not None:
            assert seen.setdefault(r.key, part) == part
            r.next()


def test_empty_table(spark):
    assert S.dedup(spark.createDataFrame([], "doc_id long, text string")).collect() == []
