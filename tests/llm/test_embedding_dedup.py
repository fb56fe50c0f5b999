"""Embedding links against all pairs."""

import numpy as np

from assay.llm import embed_dedup as E

SCHEMA = "vec_id long, embedding array<float>, label int"


def rows(seed=1, n=700, dim=16):
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        if i % 3 and out:
            v = np.array(out[rng.integers(len(out))][1]) + rng.normal(0, .04, dim)
        else:
            v = rng.normal(0, 1, dim)
        out.append((i, [float(np.float32(x)) for x in v], int(rng.integers(3))))
    out += [(1000 + k, out[0][1], out[0][2]) for k in range(5)]
    out += [(2000, None, 1), (2001, [0.0] * dim, 1), (2002, [float("nan")] + [1.0] * (dim - 1), 1), (2003, [None] + [1.0] * (dim - 1), 1),
            (2004, out[0][1], None), (2005, [], 1), (2006, [1.0, 2.0], 1), (2007, [1.0, 2.0], 1), (2008, [float("inf")] * dim, 1)]
    return out


def brute(data):
    ok = [(i, np.array(v, float), g) for i, v, g in data if g is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links, root = {i: 0 for i, *_ in data}, {i: i for i, *_ in data}
    pairs = [(a, b) for k, (a, x, g) in enumerate(ok) for b, y, h in ok[:k]
             if g == h and len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= E.COSINE]
    for a, b in pairs:
        links[a] += 1
        links[b] += 1
    for _ in data:
        before = dict(root)
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
        if root == before:
            break
    return links, root


def test_one_leaf_is_exact(spark):
    data = rows()
    links, root = brute(data)
    got = E.op2(spark.createDataFrame(data, SCHEMA)).collect()
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got} == {i: (links[i], root[i], root[i] == i) for i in links}


def test_recall_with_many_leaves(spark, monkeypatch):
    monkeypatch.setattr(E, "LEAF", 60)
    data = rows(2, 1500)
    links, root = brute(data)
    got = {r.vec_id: r for r in E.op2(spark.createDataFrame(data, SCHEMA)).collect()}
    assert all(got[i].n_links <= links[i] for i in links)  # none below the threshold, none twice
    assert sum(r.n_links for r in got.values()) >= 0.9 * sum(links.values())
    assert all(root[r.component_id] == root[i] for i, r in got.items())


def test_crowded_leaves_are_cut(spark, monkeypatch):
    """Beyond the sample's reach: every leaf ends at or under the limit, links stay found."""
    monkeypatch.setattr(E, "CROWDED", 100)
    data = rows(3, 1500)
    data += [(3000 + k, [(k + 1.0) * x for x in data[0][1]], data[0][2]) for k in range(20)]
    links, root = brute(data)
    got = {r.vec_id: r for r in E.near_duplicates(spark.createDataFrame(data, SCHEMA), sample=8).collect()}
    assert all(got[i].n_links <= links[i] for i in links)
    assert sum(r.n_links for r in got.values()) >= 0.9 * sum(links.values())
    assert all(root[r.component_id] == root[i] for i, r in got.items())


def test_thinned_leaves(spark):
    rng = np.random.default_rng(5)
    vecs = [(i, 1, 8, [float(x) for x in rng.normal(size=8)]) for i in range(600)]
    vecs += [(600 + i, 2, 8, [2.0 ** i] * 8) for i in range(80)]  # multiples of one vector: cannot be cut
    classes = spark.createDataFrame(vecs, "id long, label int, dim int, v array<double>")
    placed = classes.selectExpr("label", "dim", "0L as leaf", "id")
    out, crowded = E.thinned(placed, classes, most=50)
    out = out.toPandas()
    sizes = out.groupby(["label", "leaf"]).size()
    assert sizes[1].max() <= 50 and sizes[2].tolist() == [80]
    assert [(r["label"], r["n"]) for r in crowded.collect()] == [(2, 80)]
    assert set(out["id"]) == set(range(680)) and not out.duplicated().any()


def cluster(seed, n, dim=24, noise=.02, label=0, at=0):
    """Vectors around one direction, nearly all pairs of which link."""
    rng = np.random.default_rng(seed)
    center = E.unit(rng.normal(size=(1, dim)))[0]
    return [(at + i, [float(np.float32(x)) for x in center + rng.normal(0, noise, dim)], label) for i in range(n)]


def fast(data):
    """Link counts of all pairs by one matrix product for each label."""
    out = {}
    for g in {g for *_, g in data}:
        own = [(i, v) for i, v, h in data if h == g]
        x = E.unit(np.array([v for _, v in own], float))
        for (i, _), n in zip(own, (x @ x.T >= E.COSINE).sum(1) - 1):
            out[i] = int(n)
    return out


def test_clusters_many_times_the_limit(spark, monkeypatch):
    """One dense cluster of ten times what a task takes, beside spread vectors and a looser cluster: no link of the dense one is lost."""
    monkeypatch.setattr(E, "LEAF", 100)
    monkeypatch.setattr(E, "CROWDED", 200)
    data = cluster(1, 2000) + rows(6, 600, 24)[:600]
    data = [(i, v, g) for i, (_, v, g) in enumerate(data)] + cluster(2, 800, noise=.03, at=5000, label=7)
    want = fast(data)
    for sample in (20_000, 300):  # told dense by the trees' sample, and by the rounds beyond it
        got = {r.vec_id: r for r in E.near_duplicates(spark.createDataFrame(data, SCHEMA), sample=sample).collect()}
        assert all(got[i].n_links <= want[i] for i in want)
        assert sum(got[i].n_links for i in range(2000)) >= 0.99 * sum(want[i] for i in range(2000))
        assert sum(r.n_links for r in got.values()) >= 0.9 * sum(want.values())
        assert len({got[i].component_id for i in range(2000)}) == 1


def test_multiples_are_one_class_and_keep_their_neighbours(spark, monkeypatch):
    monkeypatch.setattr(E, "LEAF", 100)
    monkeypatch.setattr(E, "CROWDED", 200)
    near = cluster(3, 60, noise=.01)
    crowd = [(100 + k, [(1 + k / 7) * x for x in near[0][1]], 0) for k in range(900)] + [(2000 + k, [2.0 ** -k * x for x in near[0][1]], 0) for k in range(60)]
    data = near + crowd
    want = fast(data)
    got = {r.vec_id: r.n_links for r in E.near_duplicates(spark.createDataFrame(data, SCHEMA.replace("float", "double"))).collect()}
    assert got == want


def test_connected_rows():
    rng = np.random.default_rng(3)
    for n in (1, 5, 40):
        half = np.triu(rng.random((n, n)) < 1.2 / n, 1)
        for near, whole in ((half | half.T, True), (half, False)):
            a, b = near.shape
            pairs = [(i, j if whole else a + j) for i, j in zip(*np.nonzero(near))]
            root = list(range(a if whole else a + b))
            for _ in root:
                for i, j in pairs:
                    root[i] = root[j] = min(root[i], root[j])
            assert E.connected(near, whole).tolist() == root


def test_grow_is_bounded_by_the_sample():
    x = E.unit(np.random.default_rng(0).normal(size=(4000, 8)))
    small, large = (E.grow(x, total, np.random.default_rng(1)) for total in (1e7, 1e12))
    assert len(small) == len(large) < 4000
    deepest = max(len(at) for _, at in E.leaves(large, x))
    assert deepest < 4 * E.LEAST  # no part of the tree is left uncut


def test_empty(spark):
    assert E.op2(spark.createDataFrame([], SCHEMA)).collect() == []


def test_sql_tells_the_same_links(spark):
    import duckdb
    data = rows()
    con = duckdb.connect()
    con.execute("create table embeddings (vec_id bigint, embedding float[], label integer)")
    con.executemany("insert into embeddings values (?, ?, ?)", data)
    want = sorted(con.sql(E.OP2_SQL).fetchall())
    got = E.op2(spark.createDataFrame(data, SCHEMA))
    assert sum(r[1] for r in want) > 20
    assert sorted(tuple(r) for r in got.select("vec_id", "n_links", "component_id", "kept").collect()) == want
