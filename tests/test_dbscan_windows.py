"""DBSCAN of windows that share points: the rows of DBSCAN of each window by itself."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from reviewloom.operators import dbscan as operator
from reviewloom.operators.dbscan import dbscan


def _rows(seed, n, dim, windows, copies):
    """(g, w, id, v) of n points of two groups, each in some windows on end; every ``copies``-th has the vector of the one before."""
    r = np.random.default_rng(seed)
    out = []
    for g in "ab":
        v = np.concatenate([r.normal(size=(n // 2, dim)) * 0.6, r.normal(size=(n - n // 2, dim)) * 0.2 + 2.0]).astype(np.float32)
        v[copies::copies] = v[copies - 1:-1:copies]
        first, length = r.integers(0, windows, n), r.integers(1, 5, n)
        out += [(g, f"w{w:02}", i * 7 % 1000, [float(x) for x in v[i]]) for i in range(n) for w in range(first[i], min(windows, first[i] + length[i]))]
    return out


@pytest.mark.parametrize("block_size", [16, 1024])
def test_windows_as_groups(spark, monkeypatch, block_size):
    monkeypatch.setattr(operator, "LARGEST_BLOCK", block_size)
    rows = _rows(3, 160, 3, 6, 9)
    df = spark.createDataFrame(rows, "g string, w string, id long, v array<float>").withColumn("ord", F.struct(-F.col("id"), "id"))

    def of(**more):
        return sorted(map(tuple, dbscan(df, 0.45, 3, "id", "v", "ord", ["g", "w"], block_size, **more).collect()))

    got = of(window_col="w")
    assert got == of() and len(got) == len(rows)
    assert {c for *_, c, _, _ in got} >= {-1, 0, 1, 2} and any(c >= 0 and not core for *_, c, core, _ in got)


def test_distances_are_taken_once(spark, monkeypatch):
    """Ten windows of the same points take the distances of one."""
    v = np.random.default_rng(5).normal(size=(40, 4))
    taken = []
    near = operator._within
    monkeypatch.setattr(operator, "_within", lambda a, b, eps: taken.append(len(a) * len(b)) or near(a, b, eps))
    weights = np.ones((40, 10), np.int64)
    counts, _ = operator._count_windows(v, weights, None, None, 1.0)
    assert sum(taken) == 40 * 40
    d = np.sqrt(((v[:, None] - v[None]) ** 2).sum(2)) <= 1.0
    assert (counts == (d.sum(1) - 1)[:, None]).all()


def test_distances_near_the_bound():
    """Single precision decides no pair near eps; large norms and numbers that are none are told by the sum in sequence."""
    r = np.random.default_rng(1)
    unit = r.normal(size=(30, 16))
    unit = (unit / np.sqrt((unit ** 2).sum(1))[:, None]).astype(np.float32).astype(float)
    odd = unit.copy()
    odd[3, 2], odd[5, 0] = np.nan, np.inf
    for v, eps in ((unit, 1.2), (np.round(unit * 4), 2.0), (unit * 1e6, 1e5), (unit * 1e20, 1.2e20), (odd, 1.2), (np.zeros((3, 0)), 0.5)):
        want = [[operator.math.sqrt(sum((x - y) ** 2 for x, y in zip(a.tolist(), b.tolist()))) <= eps for b in v] for a in v]
        with np.errstate(all="ignore"):
            assert operator._within(v, v, eps).tolist() == want


def test_joins_by_window_in_tiles(monkeypatch):
    """Components and border points by window, within a set and between two, are those of all pairs."""
    monkeypatch.setattr(operator, "TILE", 5)
    monkeypatch.setattr(operator, "WIDE", 12)
    r = np.random.default_rng(2)
    v = np.concatenate([r.normal(size=(70, 2)), r.normal(size=(50, 2)) * 0.3 + 4.0])
    r.shuffle(v)
    core = r.random((120, 3)) < 0.6
    asks = ~core & (r.random((120, 3)) < 0.5)
    comp = np.full(core.shape, -1)
    comp[core] = np.arange(core.sum())
    near = np.sqrt(((v[:, None] - v[None]) ** 2).sum(2)) <= 0.4
    for cut in (None, 70):
        a, b = (slice(None), slice(None)) if cut is None else (slice(cut), slice(cut, None))
        other = (None, None, None) if cut is None else (v[b], comp[b], asks[b])
        lab, mine, theirs = operator._join_windows(v[a], comp[a], asks[a], *other, core.sum(), 0.4)
        pairs = [(w, i, j) for i in range(120)[a] for j in range(120)[b] if i != j and near[i, j] for w in range(3)]
        edges = np.array([(comp[i, w], comp[j, w]) for w, i, j in pairs if core[i, w] and core[j, w]])
        want = operator._local_components(core.sum(), edges[:, 0], edges[:, 1])
        assert (lab == want).all()
        assert set(map(tuple, mine)) == {(i, w, comp[j, w]) for w, i, j in pairs if asks[i, w] and core[j, w]}
        if cut is not None:
            assert set(map(tuple, theirs)) == {(j - cut, w, comp[i, w]) for w, i, j in pairs if asks[j, w] and core[i, w]}
