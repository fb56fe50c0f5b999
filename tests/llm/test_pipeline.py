"""The pipeline, stage by stage, against brute force over what the stage before it returned."""

import random
from collections import Counter

import numpy as np

import corpus_pipeline as P
from assay.llm import mix, pack, quality
from test_document_operators import brute_quality, brute_secrets, brute_simhash, corpus, tok


def test_stages(spark, docs, tmp_path):
    rnd = random.Random(2)
    rows = corpus(21, 50) + [(300 + i, " ".join(f"w{rnd.randrange(10**6)}" for _ in range(40)) + " password=hunter2222 end.", "en", "b") for i in range(6)]
    rows += [(400 + i, rows[-1][1], "en", "a") for i in range(3)]
    docs(rows).write.parquet(str(tmp_path / "documents.parquet"))
    seen, cur = [spark.read.parquet(str(tmp_path / "documents.parquet"))], None
    for name, stage in P.STAGES:
        cur = stage(spark, seen[-1], str(tmp_path))
        cur.write.parquet(str(tmp_path / name))
        seen.append(spark.read.parquet(str(tmp_path / name)))
    given, cleaned, single, clean_of_secrets, mixed, packed = seen
    assert all(d.columns == given.columns for d in seen[1:-1])

    kept = [r for r in quality.op10(given).collect() if r.kept]
    assert Counter(r.doc_id for r in cleaned.collect()) == Counter(r.doc_id for r in kept)
    assert not any(brute_quality(r.text)[-1] for r in given.join(cleaned.select("doc_id").distinct(), "doc_id").collect())

    want = {c for *_, c in brute_simhash([(r.doc_id, r.text) for r in cleaned.collect()])}
    assert sorted(map(str, (r.doc_id for r in single.collect()))) == sorted(map(str, want))

    before = {r.doc_id: r.text for r in single.collect()}
    for r in clean_of_secrets.collect():
        *_, spans = brute_secrets(before[r.doc_id])
        assert (r.text == before[r.doc_id]) == (not spans) and "hunter2222" not in r.text

    copies = Counter()
    for r in mix.op1(clean_of_secrets).collect():
        copies[r.doc_id] += r.copies
    assert Counter(r.doc_id for r in mixed.collect()) == +copies

    t = tok(pack.TOKENIZER)
    ids = Counter(tuple(t.encode(r.text or "", add_special_tokens=False).ids + [2]) for r in mixed.collect())
    whole = np.concatenate([np.frombuffer(p.ids, "<u4") for p in sorted(packed.collect(), key=lambda p: (p.sequence_id, p.offset))]).tolist()
    cut = Counter()
    sizes = [p.doc_tokens for p in sorted(packed.collect(), key=lambda p: (p.sequence_id, p.offset)) if p.start == 0]
    at = 0
    for n in sizes:
        cut[tuple(whole[at:at + n])] += 1
        at += n
    assert at == len(whole) and cut == ids
    assert P.run(spark, str(tmp_path)).count() == packed.count()
