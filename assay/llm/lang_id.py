"""Language identification by nearest centroid.

A text is a vector of character n-grams (one to three bytes of its lower-cased UTF-8,
hashed into a fixed number of features), weighted by log counts and by inverse document
frequency over all training documents, and normalised. Each language has several
centroids: spherical k-means over a sample of its training documents of at most
``SAMPLE`` (a bounded fit; the frequencies and every prediction cover all rows). A text
gets the language of the centroid with the largest cosine. A text farther from that
centroid than ``SLACK`` times the cosine of its farthest training member is marked rejected.

Defined results: null texts and those without a letter are ``und`` with score 0; without
any training document all are ``und``; ties go to the first language by name; null
languages teach nothing; repeated rows are predicted each, equal texts of a
language enter the sample once; an
empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

FEATURES = 1 << 13
SAMPLE = 300  # training documents of a language for its centroids, by hash of their text
CLUSTERS = 4
ROUNDS = 8
SLACK = 0.6
BYTES = 1 << 20  # of a long text counted at a time


def counts(text: str) -> np.ndarray:
    """Counts of the hashed n-grams of the whole text."""
    b = np.frombuffer(text.lower().encode("utf-8", "replace"), np.uint8)
    out = np.zeros(FEATURES, np.float32)
    for at in range(0, len(b), BYTES):
        x = b[at:at + BYTES + 2].astype(np.uint32)  # two more: n-grams that begin in this part
        n = min(BYTES, len(b) - at)
        one = x * np.uint32(0x9E3779B1)
        two = (one[:-1] ^ (x[1:] + np.uint32(1)) * np.uint32(0x85EBCA77)) * np.uint32(0xC2B2AE3D)
        three = (two[:-1] ^ (x[2:] + np.uint32(1)) * np.uint32(0x27D4EB2F)) * np.uint32(0x165667B1)
        for grams in (one[:n], two[:n], three[:n]):
            out += np.bincount(grams >> np.uint32(32 - 13), minlength=FEATURES)
    return out


def vectors(texts, idf: np.ndarray) -> np.ndarray:
    m = np.log1p(np.stack([counts(t) for t in texts])) * idf
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)


def idf_of(train: DataFrame) -> np.ndarray:
    """Over all training documents; what reaches the driver is one number a feature."""
    def frequencies(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        df, n = np.zeros(FEATURES, np.int64), 0
        for b in batches:
            for t in b["text"]:
                df += counts(t) > 0
                n += 1
        if n:
            yield pd.DataFrame({"f": np.arange(-1, FEATURES), "n": np.concatenate([[n], df])})
    rows = dict(train.select("text").mapInPandas(frequencies, "f int, n long").groupBy("f").agg(F.sum("n").alias("n")).collect())
    total = rows.pop(-1, 0)
    df = np.zeros(FEATURES)
    df[list(rows)] = list(rows.values())
    return np.log((1 + total) / (1 + df)).astype(np.float32) + np.float32(1)


def centroids(train: DataFrame, idf: np.ndarray, sample: int = SAMPLE, clusters: int = CLUSTERS) -> list:
    """(lang, cosine of the farthest member, centroid) rows, by language."""
    # a language's distinct texts have uniform hashes: those below a bound that about 4 * sample of them meet hold the smallest
    # ones, so texts move for a few documents and no task sees a whole language; copies, whatever their ids, count once
    hashed = train.withColumn("_h", F.xxhash64("text"))
    bound = F.lit(-(2.0 ** 63)) + F.lit(2.0 ** 64) * F.least(F.lit(1.0), F.lit(4.0 * sample) / F.col("_texts"))
    sizes = hashed.groupBy("lang").agg(F.approx_count_distinct("_h", 0.05).alias("_texts"))  # a row a language, of which the model holds more
    near = (hashed.join(F.broadcast(sizes), "lang")
            .filter(F.col("_h").cast("double") <= bound).dropDuplicates(["lang", "_h"]))
    order = Window.partitionBy("lang").orderBy("_h")
    chosen = near.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= sample)

    def fit(key, rows: pd.DataFrame) -> pd.DataFrame:
        x = vectors(rows.sort_values("_n")["text"], idf)
        c = x[:1]
        while len(c) < min(clusters, len(x)):  # the farthest from those chosen
            c = np.vstack([c, x[(x @ c.T).max(1).argmin()]])
        for _ in range(ROUNDS):
            near = (x @ c.T).argmax(1)
            sums = np.stack([x[near == i].sum(0) if (near == i).any() else c[i] for i in range(len(c))])
            c = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
        cos = x @ c.T
        near = cos.argmax(1)
        return pd.DataFrame([(key[0], float(cos[near == i, i].min()), c[i].astype(np.float32)) for i in range(len(c)) if (near == i).any()],
                            columns=["lang", "far", "c"])

    found = chosen.select("lang", "text", "_n").groupBy("lang").applyInPandas(fit, "lang string, far double, c array<float>")
    return sorted(found.collect(), key=lambda r: (r["lang"], r["far"]))


def predict(docs: DataFrame, train: DataFrame, keep: list[str], sample: int = SAMPLE, clusters: int = CLUSTERS) -> DataFrame:
    """``keep``, lang_pred, score, rejected. ``train``: doc_id, lang and text, without nulls in lang and text."""
    idf = idf_of(train)
    rows = centroids(train, idf, sample, clusters)
    model = docs.sparkSession.sparkContext.broadcast(
        (idf, [r["lang"] for r in rows], np.array([r["far"] for r in rows]),
         np.array([r["c"] for r in rows], np.float32).reshape(-1, FEATURES)))

    @F.pandas_udf("lang_pred string, score double, rejected boolean")
    def nearest(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        idf, langs, far, c = model.value
        names = np.array(langs, object)
        for texts in batches:
            out = []
            for at in range(0, len(texts), 64):
                part = texts.iloc[at:at + 64]
                known = part.notna().to_numpy() & bool(len(c))
                pred, score, out_far = np.full(len(part), "und", object), np.zeros(len(part)), np.zeros(len(part), bool)
                if known.any():
                    cos = vectors(part[known], idf) @ c.T
                    best = cos.argmax(1)
                    top = cos[np.arange(len(best)), best]
                    pred[known], score[known] = names[best], np.clip(top, 0, 1)
                    out_far[known] = top < SLACK * far[best]
                out.append(pd.DataFrame({"lang_pred": pred, "score": score, "rejected": out_far}))
            yield pd.concat(out) if out else pd.DataFrame({"lang_pred": [], "score": [], "rejected": []})

    text = F.col("text").cast("string")
    lettered = F.when(text.rlike(r"\p{L}"), text)
    return docs.select(*keep, nearest(lettered).alias("_p")).select(*keep, "_p.lang_pred", "_p.score", "_p.rejected")


def op7(docs: DataFrame) -> DataFrame:
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4
    rows = docs.select("doc_id", "text", "lang", F.coalesce(fold == 2, F.lit(False)).alias("held_out"))
    train = rows.filter(~F.col("held_out") & F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull()) \
        .select("doc_id", "lang", "text")
    return predict(rows.select("doc_id", "text", "held_out"), train, ["doc_id", "held_out"])
