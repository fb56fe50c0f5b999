"""Embedding near-dedup with a forest of random-projection trees.

Vectors of a label that point in one direction (equal ones, and positive multiples to
twelve decimals) are one class, whose members are counted and not compared. The trees are
fitted on a sample of at most ``SAMPLE`` classes: at each level the vectors of a node are
projected on a random direction and cut at the median; vectors in a band around the cut
go to both sides (spill), so that pairs near a cut stay together. Trees grow until a leaf
is expected to hold ``LEAF`` classes of the whole table, the sample has too few vectors
there to find a median, or the node is dense: most pairs in it link, and any cut would
part them. All classes are dropped down all trees. A leaf that holds more than ``CROWDED``
classes of a label is cut further over the whole table, unless it is dense: each round
projects its classes on a new random direction, takes the quantiles as an aggregate and
joins them back. So the broadcast forest does not grow with the table, and no cluster
narrower than the link distance is cut.

In a leaf all pairs are compared by blocks of a matrix product, in double precision. A
leaf that stays crowded is dealt into blocks of ``CROWDED`` classes and compared block
against block, a task for each two blocks, so no task takes a whole leaf; a crowded leaf
whose classes all share an earlier one is left to that one. A pair that shares several leaves
counts in the first one only, which both sides can tell from the leaves each carries. A
task sends one count for each vector and a link to the smallest vector it is connected
with there, never pairs; connected components of those links unite them.

Defined results: null labels and vectors that are null, empty, zero or hold null or
non-finite components link with nothing; vectors of different lengths do not link;
repeated rows are copies of each other; an empty table gives no rows; other columns are
not read.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from assay.llm import common

SAMPLE = 20_000  # classes the trees are fitted on
TREES = 8
LEAF = 1_000  # classes expected in a leaf
CROWDED = 4_000  # classes of a label in a leaf that is cut further, or in a block of one that is not
DENSE = 0.5  # share of linked pairs from which a node is not cut
LOOKED_AT = 256  # classes of a node whose pairs tell
DECIMALS = 12  # of the components of a direction
SPILL = 0.1  # share of a node on either side of the cut that goes to both
LEAST = 32  # sample vectors needed to find a median
COSINE = 0.98
SEED = 42
HELD = 1 << 19  # numbers of vectors dropped down the trees at a time
BLOCK = 1_024  # rows of a leaf compared at a time


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


@F.pandas_udf(T.BinaryType())
def direction(vectors: pd.Series) -> pd.Series:
    """SHA-256 of a vector's components over its norm, to ``DECIMALS``; by the largest first, so that no square overflows or vanishes."""
    def of(v) -> bytes | None:
        if v is None:
            return None
        x = np.asarray(v, float)
        x = x / np.abs(x).max()
        return hashlib.sha256((np.rint(x / np.linalg.norm(x) * 10.0**DECIMALS) + 0.0).tobytes()).digest()
    return vectors.map(of, na_action="ignore")


def dense(x: np.ndarray, least: float) -> bool:
    """Whether most pairs among the first of some unit vectors link."""
    x = x[:LOOKED_AT]
    n = len(x)
    return n > 1 and (x @ x.T >= least).sum() - n >= DENSE * n * (n - 1)


def grow(x: np.ndarray, total: float, rng, least: float = COSINE) -> list:
    """A tree: nodes (direction, low, high, left, right), leaves None; node 0 is the root."""
    nodes: list = []

    def node(pts: np.ndarray, size: float) -> int:
        at = len(nodes)
        nodes.append(None)
        if size > LEAF and len(pts) >= 2 * LEAST and not dense(pts, least):
            d = rng.standard_normal(x.shape[1])
            p = pts @ d
            low, high = np.quantile(p, [0.5 - SPILL, 0.5 + SPILL])
            if low < high:
                left, right = [node(h, size * (0.5 + SPILL)) for h in (pts[p <= high], pts[p >= low])]
                nodes[at] = (d, low, high, left, right)
        return at

    node(x, total)
    return nodes


def leaves(tree: list, x: np.ndarray) -> list[np.ndarray]:
    """For each leaf of ``tree``, in order: its number and the rows of ``x`` in it."""
    out, todo = [], [(0, np.arange(len(x)))]
    while todo:
        at, rows = todo.pop()
        if tree[at] is None or not len(rows):
            if len(rows):
                out.append((at, rows))
            continue
        d, low, high, left, right = tree[at]
        p = x[rows] @ d
        todo += [(left, rows[p <= high]), (right, rows[p >= low])]
    return out


def thinned(placed: DataFrame, classes: DataFrame, most: int | None = None, least: float = COSINE) -> tuple[DataFrame, DataFrame]:
    """``placed`` (label, dim, leaf, id) with each leaf of over ``most`` classes of a label cut, and the leaves that stay crowded (label,
    dim, leaf, n) because they are dense or their vectors lie in one point.

    A round moves only the rows of crowded leaves. Its cuts are quantiles over all of a leaf's rows, one per leaf and
    joined by leaf; the driver sees one number a round.
    """
    most = CROWDED if most is None else most
    leaf = ["label", "dim", "leaf"]

    def narrow(key, part):
        return pd.DataFrame([[*key, dense(unit(np.array(part["v"].tolist(), float)), least)]], columns=[*leaf, "dense"])

    def project(batches):
        for b in batches:
            p = np.empty(len(b), np.float32)
            for (code, dim), at in b.groupby(["leaf", "dim"]).indices.items():
                d = np.random.default_rng([SEED, int(code) & (2**64 - 1)]).standard_normal(int(dim))
                p[at] = unit(np.array(b["v"].iloc[at].tolist(), float)) @ d
            yield b[[*leaf, "id"]].assign(p=p)

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in placed.select(*leaf, "id").schema)
    by_leaf = kinds.rsplit(",", 1)[0]
    vectors = classes.select("id", "label", "dim", "v")
    done, kept, open_ = [], [], placed
    while True:
        crowds = common.materialize(open_.groupBy(*leaf).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > most), "crowds")
        if not crowds.head(1):
            crowded = reduce(DataFrame.unionByName, kept) if kept else placed.select(*leaf, F.lit(0).cast("long").alias("n")).filter("false")
            return reduce(DataFrame.unionByName, [*done, open_]), crowded
        few = Window.partitionBy(*leaf).orderBy(F.xxhash64("id"), "id")
        seen = (open_.join(crowds.drop("n"), leaf, "left_semi").withColumn("_k", F.row_number().over(few)).filter(F.col("_k") <= LOOKED_AT)
                .join(vectors, ["label", "dim", "id"]).groupBy(*leaf).applyInPandas(narrow, by_leaf + ", dense boolean"))
        crowds = common.materialize(crowds.join(seen, leaf), "told")
        stay = crowds.filter("dense").drop("dense")
        cutting = crowds.filter("not dense").select(*leaf)
        kept.append(stay)
        done += [open_.join(crowds.select(*leaf), leaf, "left_anti"), open_.join(stay.select(*leaf), leaf, "left_semi")]
        p = common.materialize(open_.join(cutting, leaf, "left_semi").join(vectors, ["label", "dim", "id"])
                               .mapInPandas(project, kinds + ", p float"), "projected")
        cuts = p.groupBy(*leaf).agg(F.percentile_approx("p", [0.5 - SPILL, 0.5 + SPILL]).alias("q"),
                                    (F.min("p") == F.max("p")).alias("whole"), F.count(F.lit(1)).alias("n"))
        low, high = F.get("q", F.lit(0)), F.get("q", F.lit(1))
        sides = (F.when(low < high, F.array(F.when(F.col("p") <= high, 0), F.when(F.col("p") >= low, 1)))
                 .otherwise(F.array(F.when(F.col("p") < low, 0).when(F.col("p") > low, 1).otherwise(2))))
        cuts = common.materialize(cuts, "cuts")
        kept.append(cuts.filter("whole").select(*leaf, "n"))
        cut = common.materialize(p.join(cuts.drop("n"), leaf).withColumn("side", F.explode(F.when(F.col("whole"), F.array(F.lit(-1)))
                                                                                          .otherwise(F.array_compact(sides))))
                                 .select("label", "dim", F.when(F.col("side") < 0, F.col("leaf")).otherwise(
                                     F.xxhash64("leaf", "side")).alias("leaf"), "id", "whole"), "cut")
        done.append(cut.filter("whole").drop("whole"))
        open_ = cut.filter("not whole").drop("whole")


def connected(near: np.ndarray, whole: bool = True) -> np.ndarray:
    """The smallest row each row is connected with, for links between rows (``whole``: rows by rows), or between some rows and later
    ones (the first by the later rows, numbered on). Every row is followed once."""
    a, b = near.shape
    n = a if whole else a + b
    root, open_ = np.arange(n), np.ones(n, bool)
    some = near.any(1) | near.any(0) if whole else np.concatenate([near.any(1), near.any(0)])
    for start in np.flatnonzero(some):
        if not open_[start]:
            continue
        front = np.array([start])
        open_[start] = False
        while len(front):
            root[front] = start
            if whole:
                hit = near[front].any(0)
            else:
                hit = np.concatenate([near[:, front[front >= a] - a].any(1), near[front[front < a]].any(0)])
            front = np.flatnonzero(hit & open_)
            open_[front] = False
    return root


def links(x: np.ndarray, tokens: list[np.ndarray], y: np.ndarray, others: list[np.ndarray], here: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows of ``x`` by rows of ``y``: linked; and linked without a leaf before ``here`` in common."""
    before = [t[t < here] for t in tokens + others]
    shared, codes = np.unique(np.concatenate(before), return_inverse=True) if before else (np.array([]), np.array([], int))
    one_hot = np.zeros((len(before), len(shared)), np.float32)
    one_hot[np.repeat(np.arange(len(before)), [len(t) for t in before]), codes] = 1
    mine, theirs = one_hot[:len(x)], one_hot[len(x):]
    near, new = np.empty((len(x), len(y)), bool), np.empty((len(x), len(y)), bool)
    for a in range(0, len(x), BLOCK):
        near[a:a + BLOCK] = x[a:a + BLOCK] @ y.T >= least
        new[a:a + BLOCK] = near[a:a + BLOCK] & ~(mine[a:a + BLOCK] @ theirs.T > 0)
    return near, new


def compared(x: np.ndarray, weight: np.ndarray, tokens: list[np.ndarray], here: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Members linked to each vector by pairs that share no leaf before ``here``, and the row of the smallest connected one.

    Rows are in order of their ids.
    """
    near, new = links(x, tokens, x, tokens, here, least)
    np.fill_diagonal(near, False)
    np.fill_diagonal(new, False)
    return new @ weight, connected(near)


def near_duplicates(vectors: DataFrame, least: float = COSINE, trees: int = TREES, sample: int = SAMPLE) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row; columns vec_id, embedding, label."""
    v = F.col("embedding").cast("array<double>")
    finite = ~F.exists(v, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    valid = F.coalesce(F.col("label").isNotNull() & (F.size(v) > 0) & finite & F.exists(v, lambda e: e != 0)
                       & F.col("vec_id").isNotNull(), F.lit(False))
    rows = vectors.select(F.col("vec_id").cast("long"), "label", v.alias("v"), valid.alias("_ok"))
    aimed = common.materialize(rows.withColumn("d", F.when(F.col("_ok"), direction(F.when(F.col("_ok"), F.col("v"))))), "directions")
    classes = common.materialize(
        aimed.filter("_ok").groupBy("label", "d").agg(F.min_by("v", "vec_id").alias("v"), F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("w"))
        .withColumn("dim", F.size("v")), "vectors")
    drawn = classes.select("dim", "v", F.xxhash64("id", F.lit(SEED)).alias("h"), "id").orderBy("h", "id").limit(sample).toPandas()
    dims = sorted({int(d) for d in drawn["dim"]})  # those of the sample; vectors of others begin in one leaf
    sizes = {r["dim"]: r["n"] for r in classes.join(classes.sparkSession.createDataFrame([(d,) for d in dims], "dim int"), "dim", "left_semi")
             .groupBy("dim").agg(F.count(F.lit(1)).alias("n")).collect()} if dims else {}
    forest = {}
    for dim, part in drawn.groupby("dim"):
        x = unit(np.array(part["v"].tolist(), float))
        forest[int(dim)] = [grow(x, sizes[dim], np.random.default_rng([SEED, t]), least) for t in range(trees)]
    model = classes.sparkSession.sparkContext.broadcast(forest)  # as large as the sample at most
    label, given = (vectors.schema[c].dataType.simpleString() for c in ("label", "embedding"))
    number = given if given in ("array<float>", "array<double>") else "array<double>"

    def drop(batches):
        for dim, part in (group for b in batches for group in b.groupby("dim")):
            step = max(1, HELD // int(dim))
            for b in (part.iloc[i:i + step] for i in range(0, len(part), step)):
                x = unit(np.array(b["v"].tolist(), float))
                met = [(t << 32 | leaf, at) for t, tree in enumerate(model.value.get(int(dim), [[None]])) for leaf, at in leaves(tree, x)]
                at = np.concatenate([rows for _, rows in met])
                yield pd.DataFrame({"label": b["label"].to_numpy()[at], "dim": dim, "id": b["id"].to_numpy()[at],
                                    "leaf": np.repeat([leaf for leaf, _ in met], [len(rows) for _, rows in met])})

    narrow = classes.select("label", "dim", "id", "w", F.col("v").cast(number).alias("v"))
    leaf = ["label", "dim", "leaf"]
    placed, crowded = thinned(common.materialize(narrow.mapInPandas(drop, f"label {label}, dim int, leaf long, id long"), "placed"), narrow, least=least)
    placed, crowded = common.materialize(placed, "leaves"), common.materialize(crowded, "crowded")
    tokens = placed.groupBy("id").agg(F.collect_set("leaf").alias("tokens"))  # the leaves of one vector
    known = common.materialize(narrow.join(tokens, "id"), "known")
    # crowded leaves whose classes all stand in one earlier crowded leaf: every pair counts there
    members = common.materialize(placed.join(crowded, leaf), "members")
    earlier = members.select("id", F.col("leaf").alias("_before"))
    covered = (members.join(earlier, "id").filter(F.col("_before") < F.col("leaf")).groupBy(*leaf, "n", "_before")
               .agg(F.count(F.lit(1)).alias("k")).filter("k = n").select(*leaf).distinct())
    members = members.join(covered, leaf, "left_anti")

    def numbers(part):
        return unit(np.array(part["v"].tolist(), float)), part["w"].to_numpy(), [np.asarray(t, np.int64) for t in part["tokens"]]

    def compare(key, part):
        part = part.sort_values("id")
        count, root = compared(*numbers(part), int(key[2]), least)
        ids = part["id"].to_numpy()
        some = (count > 0) | (root != np.arange(len(ids)))
        return pd.DataFrame({"id": ids[some], "n": count[some], "root": ids[root[some]]})

    def compare_blocks(key, part):
        part = part.sort_values(["block", "id"])
        one, two = part[part["block"] == key[3]], part[part["block"] != key[3]]
        if key[3] == key[4]:
            return compare(key, part)
        (x, w, t), (y, v, u) = numbers(one), numbers(two)
        near, new = links(x, t, y, u, int(key[2]), least)
        count, root = np.concatenate([new @ v, w @ new]), connected(near, whole=False)
        ids = part["id"].to_numpy()
        small = pd.Series(ids).groupby(root).transform("min").to_numpy()
        some = (count > 0) | (small != ids)
        return pd.DataFrame({"id": ids[some], "n": count[some], "root": small[some]})

    met = "id long, n long, root long"
    alone = known.withColumn("leaf", F.explode("tokens")).join(crowded.select(*leaf), leaf, "left_anti").groupBy(*leaf).applyInPandas(compare, met)
    blocks = F.ceil(F.col("n") / CROWDED).cast("int")
    dealt = members.withColumn("block", F.pmod(F.xxhash64("id"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    dealt = dealt.withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other")).drop("n", "other")
    pairs = dealt.join(known.drop("label", "dim"), "id").groupBy(*leaf, "low", "high").applyInPandas(compare_blocks, met)
    found = common.materialize(alone.unionByName(pairs), "met")
    linked = found.groupBy("id").agg(F.sum("n").alias("n"))
    parts = common.connected_components(found.select(F.col("id").alias("u"), F.col("root").alias("v")), "vectors")
    of_class = (classes.join(linked, "id", "left").join(parts.withColumnRenamed("node", "id"), "id", "left")
                .select("label", "d", (F.coalesce("n", F.lit(0)) + F.col("w") - 1).alias("n_links"),
                        F.coalesce("root", "id").alias("component_id")))
    good = aimed.filter("_ok").join(of_class, ["label", "d"]).select("vec_id", "n_links", "component_id")
    single = aimed.filter("not _ok").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return good.unionByName(single).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op2(vectors: DataFrame) -> DataFrame:
    return near_duplicates(vectors.select("vec_id", "embedding", "label"))


# All pairs of a label: DuckDB SQL for tables of a small scale; an index that misses a link differs from it.
OP2_SQL = f"""
with recursive given as (
  select vec_id, label, case when len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
                             then cast(embedding as double[]) end as v
  from embeddings
),
good as (
  select vec_id, label, v from given
  where vec_id is not null and label is not null and len(v) > 0
    and len(list_filter(v, lambda x: x <> 0)) > 0
),
links as (
  select a.vec_id as u, b.vec_id as w from good a join good b on a.label = b.label and a.vec_id <> b.vec_id
  where case when len(a.v) = len(b.v) then list_cosine_similarity(a.v, b.v) >= {COSINE} else false end
),
reach as (
  select u, w from links
  union
  select r.u, l.w from reach r join links l on l.u = r.w
)
select g.vec_id, coalesce(n.n, 0) as n_links, least(g.vec_id, coalesce(m.m, g.vec_id)) as component_id,
       g.vec_id = least(g.vec_id, coalesce(m.m, g.vec_id)) as kept
from given g left join (select u, count(*) as n from links group by u) n on n.u = g.vec_id
left join (select u, min(w) as m from reach group by u) m on m.u = g.vec_id"""
