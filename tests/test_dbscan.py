"""DBSCAN: distributed result == the definition, for any
block count; zero vectors; connected components."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from reviewloom.operators.components import connected_components
from reviewloom.operators import dbscan as operator
from reviewloom.operators.dbscan import dbscan, metric_blocks
from reviewloom.operators.ranks import ranked
from reviewloom.sources.tables import embeddings_view

from .conftest import SF_SMALL


def defined_dbscan(vectors, eps, min_pts):
    """Labels by the definition: clusters are the components of the core points,
    numbered by their first core; a border point takes the smallest cluster
    number among its core neighbours; the rest is noise."""
    v = np.array(vectors, float)
    near = np.sqrt(((v[:, None, :] - v[None, :, :]) ** 2).sum(2)) <= eps
    np.fill_diagonal(near, False)
    core = near.sum(1) >= min_pts
    reach = (near & core[:, None] & core[None, :]) | np.diag(core)
    while True:
        wider = (reach.astype(float) @ reach.astype(float)) > 0
        if (wider == reach).all():
            break
        reach = wider
    first = [int(np.flatnonzero(reach[i])[0]) if core[i] else -1 for i in range(len(v))]
    number = {f: k for k, f in enumerate(sorted(set(first) - {-1}))}
    return [number[first[i]] if core[i] else min((number[first[j]] for j in np.flatnonzero(near[i] & core)), default=-1)
            for i in range(len(v))]


@pytest.mark.parametrize("block_size", [64, 1024])
def test_matches_sequential(spark, block_size):
    e = embeddings_view(spark, SF_SMALL)
    rows = sorted(e.select("vec_id", "embedding").collect())
    want = defined_dbscan([[float(x) for x in r.embedding] for r in rows], 1.14, 3)
    got = dict(dbscan(e, 1.14, 3, "vec_id", "embedding", "ord", block_size=block_size)
               .select("vec_id", "cluster_id").collect())
    assert [got[r.vec_id] for r in rows] == want


def test_zero_vectors_form_a_cluster(spark):
    rows = [(i, [0.0, 0.0]) for i in range(4)] + [(4, [5.0, 5.0])]
    df = spark.createDataFrame(rows, "id long, v array<double>").withColumn("ord", F.col("id"))
    got = dict(dbscan(df, 0.5, 3, "id", "v", "ord").select("id", "cluster_id").collect())
    assert got == {0: 0, 1: 0, 2: 0, 3: 0, 4: -1}


def test_grouped_numbering_restarts(spark):
    rows = [(g, g * 10 + i, [float(i) * 0.1, 0.0]) for g in range(2) for i in range(4)]
    df = spark.createDataFrame(rows, "g int, id long, v array<double>").withColumn("ord", -F.col("id"))
    out = dbscan(df, 0.15, 1, "id", "v", "ord", group_cols=["g"]).collect()
    assert {(r.g, r.cluster_id) for r in out} == {(0, 0), (1, 0)}


def test_connected_components_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(50)] + [(100, 101)], "src long, dst long")
    cc = dict(connected_components(edges).select("node", "component").collect())
    assert all(cc[i] == 0 for i in range(51)) and cc[100] == 100 and cc[101] == 100


def test_connected_components_random_graphs(spark):
    import random
    rnd = random.Random(3)
    for n, m in [(60, 40), (200, 150), (120, 400)]:
        edges = [(rnd.randrange(n), rnd.randrange(n)) for _ in range(m)]
        parent = list(range(n))

        def find(x):
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x
        for a, b in edges:
            ra, rb = find(a), find(b)
            if ra != rb:
                parent[max(ra, rb)] = min(ra, rb)
        nodes = {a for e in edges for a in e}
        want = {}
        for v in nodes:
            want.setdefault(find(v), []).append(v)
        want = {v: min(c) for c in want.values() for v in c}
        df = spark.createDataFrame(edges, "src long, dst long")
        got = dict(connected_components(df).select("node", "component").collect())
        assert got == want


def test_grouped_blocked_matches_sequential(spark):
    e = embeddings_view(spark, SF_SMALL)
    rows = sorted(e.select("label", "vec_id", "embedding").collect(), key=lambda r: r.vec_id)
    got = {(r.label, r.vec_id): r.cluster_id for r in
           dbscan(e, 1.14, 3, "vec_id", "embedding", "ord", group_cols=["label"], block_size=16).collect()}
    for lab in {r.label for r in rows}:
        grp = [r for r in rows if r.label == lab]
        want = defined_dbscan([[float(x) for x in r.embedding] for r in grp], 1.14, 3)
        assert [got[(lab, r.vec_id)] for r in grp] == want


def test_string_ids_and_large_norms(spark):
    rows = [(f"r-{i}", i, [1.6e4, float(i // 5)]) for i in range(20)]
    df = spark.createDataFrame(rows, "id string, ord long, v array<double>")
    for block in (4, 64):
        out = {r.id: r for r in dbscan(df, 1e-4, 3, "id", "v", "ord", block_size=block).collect()}
        assert [out[f"r-{i}"].cluster_id for i in range(20)] == [i // 5 for i in range(20)]
        assert {r.n_neighbors for r in out.values()} == {4}


def planted(seed, copies):
    """Points in and around 12 small clouds of the plane, a third of them copies of one point."""
    rng = np.random.default_rng(seed)
    centres = rng.uniform(0, 40, (12, 2))
    v = np.concatenate([c + rng.normal(0, 0.4, (40, 2)) for c in centres] + [rng.uniform(0, 40, (60, 2)), np.repeat(centres[:1], copies, 0)])
    order = rng.permutation(len(v))
    return [(int(i), [float(x) for x in v[i]], int(o)) for o, i in enumerate(order)]


@pytest.mark.parametrize("block_size", [16, 100, 5000])
def test_pivots_and_copies(spark, block_size):
    rows = planted(3, 250)
    df = spark.createDataFrame(rows, "id long, v array<double>, ord long").withColumn("ord", F.struct("ord"))
    got = {r.id: r for r in dbscan(df, 0.5, 4, "id", "v", "ord", block_size=block_size).collect()}
    want = defined_dbscan([r[1] for r in rows], 0.5, 4)
    assert [got[r[0]].cluster_id for r in rows] == want
    v = np.array([r[1] for r in rows])
    near = (np.sqrt(((v[:, None] - v[None]) ** 2).sum(2)) <= 0.5).sum(1) - 1
    assert [got[r[0]].n_neighbors for r in rows] == near.tolist()


def test_blocks_that_cannot_meet_are_dropped(spark):
    rows = [(0, i, v, o, 1) for i, v, o in planted(4, 0)]
    pts = spark.createDataFrame(rows, "g int, __id long, __vec array<double>, __ord long, __w long").withColumn("__n", F.lit(len(rows)))
    got = metric_blocks(pts, ["g"], 0.5, 20).collect()
    assert len(got) == len(rows)
    blocks = {r["__blk"] for r in got}
    met = {tuple(sorted((r["__blk"], b))) for r in got for b in r["__with"]}
    assert len(met) < 0.35 * len(blocks) * (len(blocks) - 1) / 2  # pairs dropped
    assert sum(len(r["__with"]) for r in got) < 0.25 * len(rows) * len(blocks)  # no vector goes everywhere
    assert max(sum(r["__blk"] == b for r in got) for b in blocks) <= 40
    # no neighbour is lost
    for r in got:
        for s in got:
            if np.hypot(r["__vec"][0] - s["__vec"][0], r["__vec"][1] - s["__vec"][1]) <= 0.5:
                assert r["__blk"] == s["__blk"] or s["__blk"] in r["__with"]


def test_points_meet_a_bounded_number_of_blocks(spark):
    """Where no bound cuts anything, points of a group four times larger still meet as many blocks."""
    met = []
    for n in (400, 1600):
        rng = np.random.default_rng(n)
        rows = [(0, i, [float(x) for x in v], i, 1, n) for i, v in enumerate(rng.normal(size=(n, 8)))]
        pts = spark.createDataFrame(rows, "g int, __id long, __vec array<double>, __ord long, __w long, __n long")
        met.append(max(len(r["__with"]) for r in metric_blocks(pts, ["g"], 100.0, operator.block_points(16)).collect()))
    assert 3 <= met[0] <= 4 * operator.BLOCKS and met[1] <= 4 * operator.BLOCKS


def test_tiles_lose_no_neighbour(monkeypatch):
    monkeypatch.setattr(operator, "TILE", 7)
    monkeypatch.setattr(operator, "WIDE", 30)
    v = np.array([r[1] for r in planted(5, 40)])
    want = np.sqrt(((v[:, None] - v[None]) ** 2).sum(2)) <= 0.5
    got, looked = np.zeros(want.shape, int), 0
    for i, j, hit in operator._near(v, None, 0.5):
        got[np.ix_(i, j)] += hit
        got[np.ix_(j, i)] += hit.T
        looked += hit.size
    assert (got == (want & ~np.eye(len(v), dtype=bool))).all() and looked < 0.5 * want.size
    got = np.zeros((200, len(v) - 200), int)
    for i, j, hit in operator._near(v[:200], v[200:], 0.5):
        got[np.ix_(i, j)] += hit
    assert (got == want[:200, 200:]).all()


def test_ranked(spark):
    rng = np.random.default_rng(1)
    rows = [(None if x == 3 else int(x), int(o)) for x, o in zip(rng.choice([0, 0, 0, 0, 1, 2, 3], 3000), rng.permutation(3000))]
    got = ranked(spark.createDataFrame(rows, "g int, o int").repartition(7), ["g"], ["o"]).collect()
    by = {}
    for g, o in sorted(rows, key=lambda r: r[1]):
        by.setdefault(g, []).append(o)
    assert sorted(((r.g, r.o, r.rank) for r in got), key=str) == sorted(((g, o, k) for g, v in by.items() for k, o in enumerate(v)), key=str)


def test_many_groups_are_not_cut(spark, monkeypatch):
    """Groups of a small share of all points are clustered whole, larger than a block or than a tile."""
    rng = np.random.default_rng(5)
    groups = {g: np.repeat(rng.normal(size=(30, 3)).round(1), 2 + g % 2, axis=0) + (rng.random((30 * (2 + g % 2), 1)) > 0.5) for g in range(24)}
    rows = [(g, g * 1000 + i, [float(x) for x in v]) for g, vs in groups.items() for i, v in enumerate(vs)]
    df = spark.createDataFrame(rows, "g int, id long, v array<double>").withColumn("ord", F.col("id"))
    monkeypatch.setattr(operator, "metric_blocks", lambda *a: pytest.fail("vectors sent to several blocks"))
    got = {(r.g, r.id): r.cluster_id for r in dbscan(df, 0.9, 4, "id", "v", "ord", ["g"], block_size=8).collect()}
    assert len(got) == len(rows)
    for g, vs in groups.items():
        assert [got[g, g * 1000 + i] for i in range(len(vs))] == defined_dbscan(vs, 0.9, 4)


def test_whole_group_in_tiles(monkeypatch):
    monkeypatch.setattr(operator, "TILE", 7)
    monkeypatch.setattr(operator, "WIDE", 16)
    v = np.random.default_rng(6).normal(size=(150, 2))
    w = np.ones(150, dtype=np.int64)
    for eps, min_pts in ((0.2, 3), (0.35, 6), (0.05, 1), (0.01, 4)):
        assert operator._local_dbscan(np.arange(150), v, w, eps, min_pts)[0].tolist() == defined_dbscan(v, eps, min_pts)
