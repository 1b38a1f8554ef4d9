"""Exact DBSCAN on DataFrames.

Semantics (sequential reference behaviour):
* neighbours of i: every j != i with L2(i, j) <= eps (inclusive; duplicates count);
* core iff #neighbours >= min_pts (self excluded);
* clusters are the connected components of core points under eps-edges;
* a non-core point adjacent to one or more cores is a border point and joins
  the *smallest* adjacent cluster id; all others are noise (-1);
* cluster ids run 0.. in scan order of each cluster's first core point
  (smallest ``order_col`` among its core points), per group.

Distribution.  Equal vectors of a group become one point with a weight, so
copies cost nothing.  A group of at most ``block_size`` points, or at most a sixteenth of all
points (and LARGEST_BLOCK), is clustered by one task, in tiles of distances, so its vectors
are shuffled once; with fewer or larger groups, a group gets pivots, drawn by hash.  Every point belongs to the cell of its nearest pivot; cells
keep their radius and are cut into blocks of bounded size.  A point x of cell a
can have a neighbour in cell b only if it lies within eps of b's ball,
``d(x, p_b) <= r_b + eps``, and not more than 2 eps farther from p_b than from p_a (the
neighbour is nearer to p_b).  Points are shipped to the block pairs of such cells
alone; all other pairs of blocks are dropped.  Each remaining pair (a <= b) is one
``applyInPandas`` task of at most two blocks.  Blocks grow with their group
(``block_points``), so a point meets a bounded number of blocks and what is
shuffled grows with the points, up to LARGEST_BLOCK points a block; only the
distances, computed in tiles, grow with their square where the bounds on cells cut
nothing.  A task never emits all pairs: pass 1 emits one partial neighbour count
per point; pass 2 joins the cores of each block to components; pass 3, over pairs
of different blocks, emits a spanning forest between such components and the
components next to border points (< min_pts per point and pair).  Components of these are
then found with the DataFrame large-star/small-star loop, and numbered by a range
partitioning with counts per partition.  Distances come from a float64 Gram matrix; pairs within a
tiny band around eps are recomputed with the sequential sum of squares so the
eps test is bit-exact; the bounds on cells are widened by more than rounding.

Overlapping groups (``window_col``), such as look-back windows, share points.  There a point
is a vector with a weight for each window, blocks are cut in the order of windows and met by the
blocks whose windows overlap theirs, and a distance is taken once for all windows: pass 1 counts neighbours
by window; passes 2 and 3 leave out pairs of cores that are joined already.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize
from .components import connected_components
from .joins import bounded_broadcast
from .ranks import ranked

BAND = 1e-7
#: Most points of a group that one task clusters alone, and fewest of a block.
BLOCK = 512
#: Blocks of a group, but for cells that are cut, until blocks hold LARGEST_BLOCK points.
BLOCKS = 8
#: A group of at most this part of all points is one block.
SHARES = 16
#: Most points of a block: two make a task.
LARGEST_BLOCK = 1 << 16
#: Points of a task that assigns points to pivots, at most.
CHUNK = 1 << 15
#: Rows and columns of a matrix of distances.
TILE = 512
WIDE = 4096
#: Most pivots of a group; beyond, cells have several blocks.
MOST_PIVOTS = 1024


def _apart(va: np.ndarray, vb: np.ndarray) -> np.ndarray:
    """L2(va[k], vb[k]), summed up in sequence."""
    if va.shape[1] == 0:
        return np.zeros(len(va))
    d = va - vb
    return np.sqrt(np.cumsum(d * d, axis=1)[:, -1])


def _where(hit: np.ndarray) -> np.ndarray:
    """Places of what is true, of eight at a time where little is."""
    flat = hit.ravel()
    if flat.size % 8:
        return np.flatnonzero(flat)
    words = np.flatnonzero(flat.view(np.uint64))
    if 16 * len(words) > flat.size // 8:
        return np.flatnonzero(flat)
    at = (8 * words[:, None] + np.arange(8)).ravel()
    return at[flat[at]]


def _within(va: np.ndarray, vb: np.ndarray, eps: float) -> np.ndarray:
    """Boolean matrix of L2(va[i], vb[j]) <= eps, exact near the boundary."""
    na = np.einsum("ij,ij->i", va, va)
    nb = np.einsum("ij,ij->i", vb, vb)
    # single precision tells most pairs; its error grows with the norms
    limit = eps * eps
    most = (va.shape[1] + 8) * 2.0 ** -22 * (na.max(initial=0.0) + nb.max(initial=0.0) + limit)
    single = most < 0.01 * limit < 1e30
    kind = np.float32 if single else np.float64
    if not single:
        most = BAND * max(1.0, limit) + 1e-14 * (na.max(initial=0.0) + nb.max(initial=0.0))
    left = np.concatenate([va, na[:, None], np.ones((len(va), 1))], axis=1, dtype=kind)
    right = np.concatenate([-2.0 * vb, np.ones((len(vb), 1)), nb[:, None] - limit], axis=1, dtype=kind)
    over = left @ right.T
    if single:
        hit = over <= most
        at = _where(hit)
        at = at[over.ravel()[at] >= -most]
    else:  # norms that are no numbers are near nothing, which the sum in sequence tells
        hit = over <= 0
        at = np.flatnonzero(~(np.abs(over) > most))
    for k in range(0, len(at), CHUNK):
        some = at[k:k + CHUNK]
        i, j = np.divmod(some, len(vb))
        hit.ravel()[some] = _apart(va[i], vb[j]) <= eps
    return hit


def _tiles(v: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Rows of ``v`` in tiles of at most TILE near ones, with the tiles' centres and radii."""
    some = v[::TILE]
    cell = np.concatenate([_distances(v[i:i + WIDE], some).argmin(axis=1) for i in range(0, len(v), WIDE)])
    order = np.argsort(cell, kind="stable")
    runs = np.split(order, np.flatnonzero(np.diff(cell[order])) + 1)
    tiles = [run[i:i + TILE] for run in runs for i in range(0, len(run), TILE)]
    centres = np.stack([v[t].mean(axis=0) for t in tiles])
    radii = np.array([np.sqrt(((v[t] - c) ** 2).sum(axis=1).max()) for t, c in zip(tiles, centres)])
    return tiles, centres, radii


def _near(va: np.ndarray, vb: np.ndarray | None, eps: float):
    """Matrices of L2(va[i], vb[j]) <= eps over tiles that may hold such pairs, as (i, j, matrix).
    Without ``vb`` the pairs are those of ``va``, each once and none of a row with itself."""
    same = vb is None
    if not len(va) or (not same and not len(vb)):  # points may meet a block none of whose points meets theirs
        return
    ta, ca, ra = _tiles(va)
    tb, cb, rb = (ta, ca, ra) if same else _tiles(vb)
    vb = va if same else vb
    slack = 1e-6 * (1.0 + math.sqrt(max(float(np.einsum("ij,ij->i", v, v).max()) for v in (va, vb))))
    for k, rows in enumerate(ta):
        apart = np.sqrt(((cb - ca[k]) ** 2).sum(axis=1))
        ok = ~(apart > rb + ra[k] + eps + slack)
        if same:
            ok[:k + 1] = False
            yield rows, rows, np.triu(_within(va[rows], va[rows], eps), 1)
        met = np.flatnonzero(ok)
        if not len(met):
            continue
        columns = np.concatenate([tb[m] for m in met])
        for i in range(0, len(columns), WIDE):
            some = columns[i:i + WIDE]
            yield rows, some, _within(va[rows], vb[some], eps)


def _pair_sets(pdf: pd.DataFrame):
    a = int(pdf["__a"].iloc[0])
    b = int(pdf["__b"].iloc[0])
    left = pdf[pdf["__blk"] == a]
    right = left if a == b else pdf[pdf["__blk"] == b]
    return a, b, left, right


def _vectors(df: pd.DataFrame, vec: str) -> np.ndarray:
    if len(df) == 0:
        return np.zeros((0, 0))
    return np.stack([np.asarray(x, dtype=np.float64) for x in df[vec].to_numpy()])


def _weigh(hit: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Weight of the columns hit in each row."""
    if (weights == 1).all():
        return np.count_nonzero(hit, axis=1)
    return (hit @ weights.astype(np.float64)).astype(np.int64)


def _joined(lab: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Labels after rows i and j are joined, pair by pair; the smaller label stays."""
    a, b = lab[i], lab[j]
    other = a != b
    if not other.any():
        return lab
    return _local_components(len(lab), a[other], b[other])[lab]


def _local_components(n: int, ei: np.ndarray, ej: np.ndarray) -> np.ndarray:
    """Min-label propagation with pointer jumping over local edges."""
    lab = np.arange(n)
    if len(ei) == 0:
        return lab
    while True:
        new = lab.copy()
        np.minimum.at(new, ei, lab[ej])
        np.minimum.at(new, ej, lab[ei])
        new = new[new]
        if np.array_equal(new, lab):
            return lab
        lab = new


def _local_dbscan(ids: np.ndarray, vecs: np.ndarray, weights: np.ndarray, eps: float, min_pts: int):
    """All rules inside one bounded task (points already in scan order), in tiles of distances."""
    n = len(ids)
    deg = weights.astype(np.int64) - 1
    for i, j, hit in _near(vecs, None, eps):
        deg[i] += _weigh(hit, weights[j])
        deg[j] += _weigh(hit.T, weights[i])
    core = deg >= min_pts
    at, rest = np.flatnonzero(core), np.flatnonzero(~core)
    cluster = np.full(n, -1, dtype=np.int64)
    # components of cores, named and so numbered by their first core in scan order
    lab = np.arange(len(at))
    for i, j, hit in _near(vecs[at], None, eps):
        ci, cj = np.nonzero(hit)
        lab = _joined(lab, i[ci], j[cj])
    cluster[at] = np.unique(lab, return_inverse=True)[1]
    # border points: smallest adjacent cluster id
    first = np.full(len(rest), n)
    for i, j, hit in _near(vecs[rest], vecs[at], eps):
        x, y = np.nonzero(hit)
        np.minimum.at(first, i[x], cluster[at[j[y]]])
    cluster[rest] = np.where(first < n, first, -1)
    return cluster, core, deg


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """L2 distances, good to about 1e-7 of the norms."""
    return np.sqrt(np.maximum(np.einsum("ij,ij->i", a, a)[:, None] + np.einsum("ij,ij->i", b, b)[None, :] - 2.0 * (a @ b.T), 0.0))


def block_points(block_size: int, total: int = 0) -> Column:
    """Points of a block in a group of ``__n`` points; ``total``: points of all groups.  Where there are many groups these give
    tasks enough, so a group is cut only if it holds more than its share of all points."""
    share = F.greatest(F.ceil(F.col("__n") / F.lit(BLOCKS)), F.lit(-(-total // SHARES)))
    return F.greatest(F.lit(block_size), F.least(F.lit(LARGEST_BLOCK), share)).cast("int")


def metric_blocks(pts: DataFrame, g: list[str], eps: float, block_size: int | Column) -> DataFrame:
    """Points (group..., __id, __ord, __vec, __w, __n) -> plus ``__blk``, the point's block,
    and ``__with``, the other blocks of its group that may hold neighbours of it.

    ``__n`` is the group's number of points; ``block_size`` may depend on it.  Pivots meet the points in tasks of a
    bounded number of points, so no vector goes to every block."""
    size = block_size if isinstance(block_size, Column) else F.lit(block_size)
    chunks = F.ceil(F.col("__n") / F.least(F.lit(CHUNK), 8 * size)).cast("int")
    pts = pts.withColumn("__chunk", F.pmod(F.xxhash64("__id"), chunks).cast("int"))
    wanted = F.least(F.lit(MOST_PIVOTS), F.ceil(F.col("__n") / size))
    by_hash = Window.partitionBy(*g).orderBy(F.xxhash64("__id", F.lit(17)), "__id")
    pivots = pts.withColumn("__cell", F.row_number().over(by_hash)).filter(F.col("__cell") <= MOST_PIVOTS) \
        .filter(F.col("__cell") <= wanted).select(*g, "__cell", F.col("__vec").alias("__pivot"), F.explode(F.sequence(F.lit(0), chunks - 1)).alias("__chunk"))
    pivots = materialize(pivots)
    fields = [f for f in pts.schema.fields if f.name != "__chunk"]
    near = T.StructType(fields + [T.StructField("__chunk", T.IntegerType()), T.StructField("__cell", T.IntegerType()), T.StructField("__far", T.DoubleType())])

    def assign(points: pd.DataFrame, some: pd.DataFrame) -> pd.DataFrame:
        d = _distances(_vectors(points, "__vec"), _vectors(some, "__pivot"))
        at = d.argmin(axis=1)
        points["__cell"] = some["__cell"].to_numpy()[at].astype(np.int32)
        points["__far"] = d[np.arange(len(d)), at]
        return points[[f.name for f in near.fields]]

    key = [*g, "__chunk"]
    placed = materialize(pts.groupBy(*key).cogroup(pivots.groupBy(*key)).applyInPandas(assign, near))
    # a row per cell: its radius and its blocks' numbers
    of = Window.partitionBy(*g).orderBy("__cell")
    cells = placed.groupBy(*g, "__cell").agg(F.max("__far").alias("__radius"), F.count(F.lit(1)).alias("__c"), F.max("__n").alias("__n"))
    cells = cells.withColumn("__parts", F.ceil(F.col("__c") / size).cast("int")).drop("__c", "__n")
    cells = materialize(cells.withColumn("__first", (F.sum("__parts").over(of) - F.col("__parts")).cast("int")))
    balls = pivots.join(cells, [*g, "__cell"])
    out = T.StructType(fields + [T.StructField("__blk", T.IntegerType()), T.StructField("__with", T.ArrayType(T.IntegerType()))])

    def meet(points: pd.DataFrame, some: pd.DataFrame) -> pd.DataFrame:
        some = some.sort_values("__cell")
        first, parts, radius = (some[c].to_numpy() for c in ("__first", "__parts", "__radius"))
        v, p = _vectors(points, "__vec"), _vectors(some, "__pivot")
        d = _distances(v, p)
        slack = 1e-6 * (1.0 + np.sqrt(np.einsum("ij,ij->i", v, v)))[:, None]
        own = np.searchsorted(some["__cell"].to_numpy(), points["__cell"].to_numpy())
        far = points["__far"].to_numpy()[:, None]
        ok = (d <= radius[None, :] + eps + slack) & (d <= far + 2 * eps + slack)
        ok[np.arange(len(own)), own] = True
        blk = first[own] + points["__part"].to_numpy() % parts[own]
        blocks = [np.arange(a, a + n) for a, n in zip(first, parts)]
        points["__blk"] = blk.astype(np.int32)
        points["__with"] = [np.concatenate([blocks[c] for c in np.flatnonzero(row)]).astype(np.int32) for row in ok]
        points["__with"] = [w[w != b] for w, b in zip(points["__with"], blk)]
        return points[[f.name for f in out.fields]]

    placed = placed.withColumn("__part", F.pmod(F.xxhash64("__id", F.lit(5)), F.lit(1 << 30)))
    return materialize(placed.groupBy(*key).cogroup(balls.groupBy(*key)).applyInPandas(meet, out))


def _tasks(df: DataFrame) -> int:
    """A number of its own: few bytes, but much work for each, are not put together into few tasks."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _replicate(df: DataFrame, to: Column, g: list[str]) -> DataFrame:
    """Points at each pair (__a, __b) of blocks that their block makes with those in ``to``."""
    r = df.withColumn("__j", F.explode(to))
    r = r.withColumn("__a", F.least("__blk", "__j")).withColumn("__b", F.greatest("__blk", "__j")).drop("__j", "__with")
    return r.repartition(_tasks(df), *g, "__a", "__b")


def _as_floats(points: DataFrame, vec_col: str) -> Column:
    """The vectors: tasks compute in doubles; floats, which are doubles, take half the room."""
    kind = points.schema[vec_col].dataType
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType | T.DoubleType):
        return F.col(vec_col)
    return F.transform(F.col(vec_col), lambda x: x.cast("double"))


def _numbered(pts2: DataFrame, edges: DataFrame, next_to: DataFrame, g: list[str]) -> DataFrame:
    """(group..., __id, cluster_id, is_core, n_neighbors) of ``pts2`` (group..., __id, __ord, __core, __deg, __comp).

    ``edges`` (group..., src, dst, border) join components, or a border point to a component next to it, as do the rows
    (group..., __id, __comp) of ``next_to``."""
    # ---- clusters: components of core points
    cores = pts2.filter("__core").select(*g, "__id", "__ord", "__comp")
    cc_edges = edges.filter(~F.col("border")).select(*g, "src", "dst")
    comps = connected_components(cc_edges, g, "src", "dst").withColumnRenamed("node", "__comp")
    core_comp = cores.join(comps, [*g, "__comp"], "left") \
                     .withColumn("component", F.coalesce(F.col("component"), F.col("__comp")))
    firsts = core_comp.groupBy(*g, "component").agg(F.min("__ord").alias("__first"))
    numbered = ranked(firsts, g, ["__first"]).select(*g, "component", F.col("rank").cast("int").alias("cluster_id"))
    core_cluster = materialize(core_comp.join(numbered, [*g, "component"]).select(*g, "__id", "__comp", "cluster_id"))
    named = core_cluster.select(*g, "__comp", "cluster_id").distinct()
    core_cluster = core_cluster.drop("__comp")

    # ---- border points: smallest adjacent cluster id
    bc = edges.filter("border").select(*g, F.col("src").alias("__id"), F.col("dst").alias("__comp"))
    bc = bc.unionByName(next_to)
    border = bc.join(named, [*g, "__comp"]) \
               .groupBy(*g, "__id").agg(F.min("cluster_id").alias("__border_cluster"))

    out = pts2.select(*g, "__id", "__core", "__deg") \
              .join(core_cluster, [*g, "__id"], "left") \
              .join(border, [*g, "__id"], "left")
    return out.select(*g, "__id", F.coalesce(F.col("cluster_id"), F.col("__border_cluster"), F.lit(-1)).cast("int").alias("cluster_id"),
                      F.col("__core").alias("is_core"), F.col("__deg").cast("long").alias("n_neighbors"))


def _by_window(df: pd.DataFrame, col: str | None, first: int, width: int, fill, kind) -> np.ndarray:
    """Matrix of the values that rows have in ``width`` windows from ``first`` on (true without ``col``), ``fill`` elsewhere."""
    out = np.full((len(df), width), fill, dtype=kind)
    if not len(df):
        return out
    at = np.concatenate(df["__win"].to_numpy()) - first
    rows = np.repeat(np.arange(len(df)), df["__win"].map(len).to_numpy())
    ok = (at >= 0) & (at < width)
    out[rows[ok], at[ok]] = True if col is None else np.concatenate(df[col].to_numpy())[ok]
    return out


def _span(df: pd.DataFrame) -> tuple[int, int]:
    """First window of the rows, and how many there are up to the last."""
    first = min(x[0] for x in df["__win"])
    return first, max(x[-1] for x in df["__win"]) - first + 1


def _count_windows(v: np.ndarray, w: np.ndarray, other: np.ndarray | None, ow: np.ndarray | None, eps: float) -> tuple[np.ndarray, np.ndarray | None]:
    """Weight of the neighbours of each row in each window, among the rows themselves or, if given, between both sets."""
    same = other is None
    ow = w if same else ow
    # sums of weights below 2^24 are exact in single precision
    kind = np.float32 if max(m.sum(axis=0).max(initial=0) for m in (w, ow)) < 1 << 24 else np.float64
    wf, of = w.astype(kind), ow.astype(kind)
    a = w - 1 if same else np.zeros(w.shape, np.int64)
    b = a if same else np.zeros(ow.shape, np.int64)
    for i, j, hit in _near(v, other, eps):
        at = _where(hit)
        if 64 * len(at) > hit.size:
            dense = hit.astype(kind)
            a[i] += (dense @ of[j]).astype(np.int64)
            b[j] += (dense.T @ wf[i]).astype(np.int64)
        elif len(at):
            x, y = np.divmod(at, hit.shape[1])
            starts = np.flatnonzero(np.diff(x, prepend=-1))
            a[i[x[starts]]] += np.add.reduceat(ow[j[y]], starts, axis=0)
            order = np.argsort(y, kind="stable")
            x, y = x[order], y[order]
            starts = np.flatnonzero(np.diff(y, prepend=-1))
            b[j[y[starts]]] += np.add.reduceat(w[i[x]], starts, axis=0)
    return a, None if same else b


def _join_windows(v: np.ndarray, comp: np.ndarray, wants: np.ndarray, other: np.ndarray | None, ocomp: np.ndarray | None,
                  owants: np.ndarray | None, n: int, eps: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Components joined by pairs of cores within eps, and those next to border points.

    ``comp`` has each row's component (of ``n``, which are of one window each) by window, -1 where it is no core; ``wants``
    tells where its neighbours' components are asked for.  Returns the components' labels, and (row, window, component) of the rows, and of the
    other ones.  Cores that most cores of their window are joined to need not meet each other."""
    same = other is None
    lab = np.arange(n)
    found: tuple[list, list] = ([], [])
    if not len(v) or (not same and not len(other)):
        none = np.zeros((0, 3), np.int64)
        return lab, none, none
    ta, ca, ra = _tiles(v)
    tb, cb, rb = (ta, ca, ra) if same else _tiles(other)
    if same:
        other, ocomp, owants = v, comp, wants
    slack = 1e-6 * (1.0 + math.sqrt(max(float(np.einsum("ij,ij->i", x, x).max()) for x in (v, other))))

    def live(of: np.ndarray, asks: np.ndarray, most: np.ndarray) -> np.ndarray:
        return (((of >= 0) & (lab[of] != most[None, :])) | asks).any(axis=1) if n else asks.any(axis=1)

    for k, rows in enumerate(ta):
        apart = np.sqrt(((cb - ca[k]) ** 2).sum(axis=1))
        met = ~(apart > rb + ra[k] + eps + slack)
        if same:
            met[:k + 1] = False
        met = np.flatnonzero(met)
        columns = np.concatenate([tb[m] for m in met]) if len(met) else np.zeros(0, np.int64)
        # in each window, the label of most cores
        most = np.full(comp.shape[1], -1)
        for w in range(comp.shape[1]):
            cores = np.concatenate([x[x >= 0] for x in ([comp[:, w]] if same else [comp[:, w], ocomp[:, w]])])
            if len(cores):
                most[w] = np.bincount(lab[cores]).argmax()
        ar, ac = live(comp[rows], wants[rows], most), live(ocomp[columns], owants[columns], most)
        work = [(rows, rows)] if same and ar.any() else []
        work += [(rows[ar], columns[c:c + WIDE]) for c in range(0, len(columns), WIDE)]
        rest = columns[ac]
        work += [(rows[~ar], rest[c:c + WIDE]) for c in range(0, len(rest), WIDE)]
        edges: list[tuple[np.ndarray, np.ndarray]] = []
        for r, c in work:
            if not len(r) or not len(c):
                continue
            i, j = np.divmod(_where(_within(v[r], other[c], eps)), len(c))
            if same and r is c:
                i, j = i[i < j], j[i < j]
            i, j = r[i], c[j]
            x, y = comp[i], ocomp[j]
            e = (x >= 0) & (y >= 0)
            p, q = x[e], y[e]
            apart_still = lab[p] != lab[q]
            edges.append((p[apart_still], q[apart_still]))
            if sum(len(p) for p, _ in edges) > 1 << 20:
                lab = _joined(lab, *(np.concatenate(z) for z in zip(*edges)))
                edges = []
            for where, mine, asks, theirs in ((0, i, wants, y), (1, j, owants, x)):
                h, w = np.nonzero(asks[mine] & (theirs >= 0))
                found[0 if same else where].append(np.column_stack([mine[h], w, theirs[h, w]]))
        if edges:
            lab = _joined(lab, *(np.concatenate(z) for z in zip(*edges)))
    none = np.zeros((0, 3), np.int64)
    return lab, *(np.unique(np.concatenate([none, *f]), axis=0) for f in found)


def _dbscan_windows(points: DataFrame, eps: float, min_pts: int, id_col: str, vec_col: str, order_col: str,
                    g: list[str], window_col: str, block_size: int) -> DataFrame:
    """``dbscan`` of groups (g..., window_col) that share points.

    A point is a vector of a group ``g``, with a weight, first id and order for each window it is in."""
    gw = [*g, window_col]
    raw = materialize(points.select(*gw, F.col(id_col).alias("__id"), F.col(order_col).alias("__ord"), _as_floats(points, vec_col).alias("__vec")))
    numbers = raw.select(*gw).distinct().withColumn("__w", F.row_number().over(Window.partitionBy(*g).orderBy(window_col)).cast("int"))
    numbers = materialize(numbers)
    pts = raw.groupBy(*gw, "__vec").agg(F.min("__id").alias("__id"), F.min("__ord").alias("__ord"), F.count(F.lit(1)).alias("__wt"))
    pts = pts.join(bounded_broadcast(numbers), gw).groupBy(*g, "__vec") \
        .agg(F.array_sort(F.collect_list(F.struct("__w", "__wt", "__id", "__ord"))).alias("__cells"))
    pts = materialize(pts.withColumn("__p", F.monotonically_increasing_id()))

    # ---- blocks, in the order of the points' first windows
    slim = pts.select(*g, "__p", "__vec", F.col("__cells.__w").alias("__win"), F.col("__cells.__wt").alias("__wts"))
    slim = slim.withColumn("__from", F.element_at("__win", 1)).withColumn("__to", F.element_at("__win", -1))
    begin = slim.groupBy(*g, "__from").agg(F.count(F.lit(1)).alias("__c"))
    of = Window.partitionBy(*g)
    begin = begin.withColumn("__before", F.sum("__c").over(of.orderBy("__from")) - F.col("__c")).withColumn("__n", F.sum("__c").over(of))
    slim = slim.join(bounded_broadcast(materialize(begin)), [*g, "__from"])
    blk = F.floor((F.col("__before") + F.pmod(F.xxhash64("__p"), F.col("__c"))) / block_points(block_size)).cast("int")
    placed = slim.withColumn("__blk", blk)
    blocks = materialize(placed.groupBy(*g, "__blk").agg(F.min("__from").alias("__from"), F.max("__to").alias("__to")))
    facing = blocks.select(*g, F.col("__blk").alias("__j"), F.col("__from").alias("__from2"), F.col("__to").alias("__to2"))
    met = blocks.join(bounded_broadcast(facing), g).filter("__blk != __j and __from <= __to2 and __from2 <= __to") \
        .groupBy(*g, "__blk").agg(F.collect_list("__j").alias("__with"))
    met = blocks.select(*g, "__blk").join(met, [*g, "__blk"], "left").withColumn("__with", F.coalesce("__with", F.array().cast("array<int>")))
    placed = materialize(placed.select(*g, "__p", "__vec", "__win", "__wts", "__blk").join(bounded_broadcast(materialize(met)), [*g, "__blk"]))

    key_fields = [points.schema[c] for c in g]
    by_block, by_pair = [*g, "__blk"], [*g, "__a", "__b"]

    def finish(out: pd.DataFrame, pdf: pd.DataFrame, schema: T.StructType) -> pd.DataFrame:
        for c in g:
            out[c] = pdf[c].iloc[0]
        return out[[f.name for f in schema.fields]]

    def sides(pdf: pd.DataFrame):
        a, b, left, right = _pair_sets(pdf.sort_values("__p", ignore_index=True))
        return a, b, left.reset_index(drop=True), right.reset_index(drop=True)

    # ---- pass 1: neighbour counts by window
    count_schema = T.StructType(key_fields + [T.StructField("__blk", T.IntegerType()), T.StructField("__counts", T.BinaryType())])

    def count_fn(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b, left, right = sides(pdf)
        first, width = _span(pdf)
        lw, rw = (_by_window(d, "__wts", first, width, 0, np.int64) for d in (left, right))
        counts = _count_windows(_vectors(left, "__vec"), lw, *((None, None) if a == b else (_vectors(right, "__vec"), rw)), eps)
        out = []
        for k, d, c in ((a, left, counts[0]), (b, right, counts[1])):
            if c is not None and len(d):
                at, n = _span(d)
                out.append((k, np.ascontiguousarray(c[:, at - first:at - first + n]).tobytes()))
        return finish(pd.DataFrame(out, columns=["__blk", "__counts"]), pdf, count_schema)

    rep = _replicate(placed, F.concat(F.array("__blk"), "__with"), g)
    counts = rep.groupBy(*by_pair).applyInPandas(count_fn, count_schema)

    # ---- pass 2: within a block, by window, components of its cores (named by their smallest point) and those next to border points
    longs = T.ArrayType(T.LongType())
    block_fields = [placed.schema[c] for c in ("__p", "__vec", "__win", "__blk", "__with")]
    block_schema = T.StructType(key_fields + block_fields + [T.StructField("__deg", longs), T.StructField("__core", T.ArrayType(T.BooleanType())), T.StructField("__comp", longs),
                                                             T.StructField("__next_w", T.ArrayType(T.IntegerType())), T.StructField("__next", longs)])

    def block_fn(pdf: pd.DataFrame, some: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("__p", ignore_index=True)
        first, width = _span(pdf)
        deg = np.zeros((len(pdf), width), np.int64)
        for c in some["__counts"]:
            deg += np.frombuffer(c, np.int64).reshape(deg.shape)
        present, ids = _by_window(pdf, None, first, width, False, bool), pdf["__p"].to_numpy(dtype=np.int64)
        core = present & (deg >= min_pts)
        comp = np.full(core.shape, -1)
        rows, windows = np.nonzero(core)
        comp[rows, windows] = np.arange(len(rows))  # by rising id
        lab, border, _ = _join_windows(_vectors(pdf, "__vec"), comp, present & ~core & (deg > 0), None, None, None, len(rows), eps)
        name = np.repeat(ids[:, None], width, axis=1)
        name[rows, windows] = ids[rows[lab]]
        border[:, 2] = ids[rows[lab[border[:, 2]]]]
        border = np.unique(border, axis=0)
        r, w = np.nonzero(present)  # windows are in order
        ends = np.cumsum(present.sum(axis=1))[:-1]
        for col, values in (("__deg", deg), ("__core", core), ("__comp", name)):
            pdf[col] = pd.Series(np.split(values[r, w], ends), dtype=object)
        ends = np.searchsorted(border[:, 0], np.arange(1, len(pdf)))
        pdf["__next_w"] = pd.Series(np.split((border[:, 1] + first).astype(np.int32), ends), dtype=object)
        pdf["__next"] = pd.Series(np.split(border[:, 2], ends), dtype=object)
        return pdf[[f.name for f in block_schema.fields]]

    tasks = _tasks(points)
    pts2 = placed.repartition(tasks, *by_block).groupBy(*by_block).cogroup(counts.repartition(tasks, *by_block).groupBy(*by_block))
    pts2 = materialize(pts2.applyInPandas(block_fn, block_schema))

    # ---- pass 3: between blocks, by window, a spanning forest of components, and components next to border points
    edge_schema = T.StructType(key_fields + [T.StructField("__w", T.IntegerType()), T.StructField("src", T.LongType()),
                                             T.StructField("dst", T.LongType()), T.StructField("border", T.BooleanType())])

    def edge_fn(pdf: pd.DataFrame) -> pd.DataFrame:
        _, _, left, right = sides(pdf)
        first, width = _span(pdf)
        sets = []
        for d in (left, right):
            core = _by_window(d, "__core", first, width, False, bool)
            deg = _by_window(d, "__deg", first, width, 0, np.int64)
            sets.append((core, ~core & (deg > 0), _by_window(d, "__comp", first, width, -1, np.int64)))
        cells = np.concatenate([np.column_stack([np.nonzero(core)[1], name[core]]) for core, _, name in sets])
        names, number = np.unique(cells, axis=0, return_inverse=True) if len(cells) else (cells, np.zeros(0, np.int64))
        comps, at = [], 0
        for core, _, _ in sets:
            comp = np.full(core.shape, -1)
            comp[core] = number.reshape(-1)[at:at + core.sum()]
            at += core.sum()
            comps.append(comp)
        lab, *borders = _join_windows(_vectors(left, "__vec"), comps[0], sets[0][1], _vectors(right, "__vec"), comps[1], sets[1][1], len(names), eps)
        other = np.flatnonzero(lab != np.arange(len(lab)))
        w, src, dst = [names[other, 0]], [names[other, 1]], [names[lab[other], 1]]
        for d, border in zip((left, right), borders):
            w.append(border[:, 1])
            src.append(d["__p"].to_numpy(dtype=np.int64)[border[:, 0]])
            dst.append(names[border[:, 2], 1])
        out = pd.DataFrame({"__w": (np.concatenate(w) + first).astype(np.int32), "src": np.concatenate(src), "dst": np.concatenate(dst),
                            "border": np.arange(sum(map(len, w))) >= len(other)})
        return finish(out, pdf, edge_schema)

    rep2 = _replicate(pts2.select(*g, "__p", "__vec", "__win", "__blk", "__with", "__deg", "__core", "__comp"), F.col("__with"), g)
    edges = materialize(rep2.groupBy(*by_pair).applyInPandas(edge_fn, edge_schema))

    # ---- a row for each point and window
    each = pts2.select(*g, "__p", "__core", "__deg", "__comp").join(pts.select(*g, "__p", "__cells"), [*g, "__p"]) \
        .select(*g, F.col("__p").alias("__point"), F.inline(F.arrays_zip("__cells", "__core", "__deg", "__comp"))) \
        .select(*g, "__point", "__cells.*", "__core", "__deg", "__comp")
    each = materialize(each)
    next_to = pts2.select(*g, F.col("__p").alias("__id"), F.inline(F.arrays_zip(F.col("__next_w").alias("__w"), F.col("__next").alias("__comp"))))
    found = _numbered(each.select(*g, "__w", F.col("__point").alias("__id"), "__ord", "__core", "__deg", "__comp"), edges, next_to, [*g, "__w"])
    found = found.withColumnRenamed("__id", "__point").join(bounded_broadcast(numbers), [*g, "__w"])
    found = materialize(found.join(each.select(*g, "__w", "__point", "__id", "__wt"), [*g, "__w", "__point"]))
    # only rows that have copies are looked up by their vector
    said = ["cluster_id", "is_core", "n_neighbors"]
    copied = found.filter("__wt > 1").select(*gw, "__point", *said).join(pts.select(*g, F.col("__p").alias("__point"), "__vec"), [*g, "__point"]).drop("__point")
    out = found.filter("__wt = 1").select(*gw, "__id", *said).unionByName(raw.join(bounded_broadcast(copied), [*gw, "__vec"]).select(*gw, "__id", *said))
    return materialize(out.withColumnRenamed("__id", id_col))


def dbscan(points: DataFrame, eps: float, min_pts: int, id_col: str, vec_col: str, order_col: str,
           group_cols: list[str] | None = None, block_size: int = BLOCK, window_col: str | None = None) -> DataFrame:
    """Return (group..., id, cluster_id INT, is_core BOOLEAN, n_neighbors LONG).

    ``window_col`` is the group column, if any, whose groups share points."""
    if window_col is not None:
        return _dbscan_windows(points, eps, min_pts, id_col, vec_col, order_col, [c for c in group_cols if c != window_col], window_col, block_size) \
            .select(*group_cols, id_col, "cluster_id", "is_core", "n_neighbors")
    if not group_cols:
        out = dbscan(points.withColumn("__all", F.lit(0)), eps, min_pts, id_col, vec_col, order_col, ["__all"], block_size)
        return out.drop("__all")
    g = list(group_cols)
    if not isinstance(points.schema[id_col].dataType, T.LongType):  # such as string ids: an integer stands for each point
        keyed = materialize(points.withColumn("__key", F.monotonically_increasing_id()))
        out = dbscan(keyed, eps, min_pts, "__key", vec_col, order_col, group_cols, block_size)
        return out.join(keyed.select("__key", id_col), "__key").select(*g, id_col, "cluster_id", "is_core", "n_neighbors")
    # equal vectors are one point: its first id and order, and how many they are
    vec = _as_floats(points, vec_col)
    raw = materialize(points.select(*g, F.col(id_col).alias("__id"), F.col(order_col).alias("__ord"), vec.alias("__vec")))
    pts = materialize(raw.groupBy(*g, "__vec").agg(F.min("__id").alias("__id"), F.min("__ord").alias("__ord"), F.count(F.lit(1)).alias("__w")))
    # only rows that have copies are looked up by their vector
    copied = pts.filter("__w > 1").select(*g, "__vec", F.col("__id").alias("__point"))
    one_of = pts.filter("__w = 1").select(*g, "__id", F.col("__id").alias("__point")) \
        .unionByName(raw.join(bounded_broadcast(copied), [*g, "__vec"]).select(*g, "__id", "__point"))
    sizes = materialize(pts.groupBy(*g).agg(F.count(F.lit(1)).alias("__n")))
    pts = pts.join(bounded_broadcast(sizes), g)
    size = block_points(block_size, sizes.agg(F.sum("__n")).first()[0] or 0)
    tasks = _tasks(points)
    key_fields = [points.schema[c] for c in g]
    out_schema = T.StructType(key_fields + [T.StructField("__point", T.LongType()), T.StructField("cluster_id", T.IntegerType()),
                                            T.StructField("is_core", T.BooleanType()),
                                            T.StructField("n_neighbors", T.LongType())])

    def for_all(found: DataFrame) -> DataFrame:
        """One row per point; read by every later stage."""
        return materialize(one_of.join(found, [*g, "__point"]).select(*g, F.col("__id").alias(id_col), "cluster_id", "is_core", "n_neighbors"))

    # ---- groups of one block: a block has all neighbours of its points, so one task does all passes
    def local_fn(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("__r", kind="stable")
        cl, core, deg = _local_dbscan(pdf["__id"].to_numpy(), _vectors(pdf, "__vec"), pdf["__w"].to_numpy(), eps, min_pts)
        out = pd.DataFrame({"__point": pdf["__id"].to_numpy(dtype=np.int64), "cluster_id": cl.astype(np.int32),
                            "is_core": core, "n_neighbors": deg})
        for c in g:
            out[c] = pdf[c].iloc[0]
        return out[[f.name for f in out_schema.fields]]

    in_order = Window.partitionBy(*g).orderBy("__ord", "__id")  # the order may be of any type, such as a struct
    small = pts.filter(F.col("__n") <= size).repartition(tasks, *g).withColumn("__r", F.row_number().over(in_order))
    local_out = small.select(*g, "__id", "__vec", "__w", "__r").groupBy(*g).applyInPandas(local_fn, out_schema)
    pts = pts.filter(F.col("__n") > size)
    if sizes.filter(F.col("__n") > size).isEmpty():
        return for_all(local_out)
    pts = metric_blocks(pts, g, eps, size)
    pair = [*g, "__a", "__b"]

    # ---- pass 1: neighbour counts
    count_schema = T.StructType(key_fields + [T.StructField("__id", T.LongType()), T.StructField("__cnt", T.LongType())])

    def count_fn(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b, left, right = _pair_sets(pdf)
        lv, lw = _vectors(left, "__vec"), left["__w"].to_numpy()
        rv, rw = (None, lw) if a == b else (_vectors(right, "__vec"), right["__w"].to_numpy())
        lc = lw - 1 if a == b else np.zeros(len(left), dtype=np.int64)
        rc = lc if a == b else np.zeros(len(right), dtype=np.int64)
        for i, j, hit in _near(lv, rv, eps):
            lc[i] += _weigh(hit, rw[j])
            rc[j] += _weigh(hit.T, lw[i])
        out = pd.DataFrame({"__id": left["__id"].to_numpy(), "__cnt": lc})
        if a != b:
            out = pd.concat([out, pd.DataFrame({"__id": right["__id"].to_numpy(), "__cnt": rc})], ignore_index=True)
        for c in g:
            out[c] = pdf[c].iloc[0]
        return out[[f.name for f in count_schema.fields]]

    rep = _replicate(pts.select(*g, "__id", "__vec", "__w", "__blk", "__with"), F.concat(F.array("__blk"), "__with"), g)
    counts = rep.groupBy(*pair).applyInPandas(count_fn, count_schema) \
                .groupBy(*g, "__id").agg(F.sum("__cnt").alias("__deg"))
    pts2 = pts.join(counts, [*g, "__id"]).withColumn("__core", F.col("__deg") >= F.lit(min_pts))

    # ---- pass 2: within a block, components of its cores (named by their smallest id; other points by their own) and those next to border points
    fields = [f for f in pts2.schema.fields if f.name not in ("__w", "__n")]
    block_schema = T.StructType(fields + [T.StructField("__comp", T.LongType()), T.StructField("__next", T.ArrayType(T.LongType()))])

    def block_fn(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("__id", ignore_index=True)
        v, core, ids = _vectors(pdf, "__vec"), pdf["__core"].to_numpy(dtype=bool), pdf["__id"].to_numpy(dtype=np.int64)
        lab = np.arange(len(pdf))
        met: list[list[int]] = [[] for _ in ids]
        for i, j, hit in _near(v, None, eps):
            ci, cj = np.nonzero(hit & core[i][:, None] & core[j][None, :])
            lab = _joined(lab, i[ci], j[cj])
            for m, n, bordering in ((i, j, hit), (j, i, hit.T)):
                for x, y in zip(*np.nonzero(bordering & ~core[m][:, None] & core[n][None, :])):
                    met[m[x]].append(n[y])
        pdf["__comp"] = ids[lab]
        pdf["__next"] = [np.unique(ids[lab[m]]) if m else np.zeros(0, np.int64) for m in met]
        return pdf[[f.name for f in block_schema.fields]]

    pts2 = materialize(pts2.select([f.name for f in fields]).repartition(tasks, *g, "__blk").groupBy(*g, "__blk").applyInPandas(block_fn, block_schema))

    # ---- pass 3: between blocks, a spanning forest of components, and components next to border points
    edge_schema = T.StructType(key_fields + [T.StructField("src", T.LongType()), T.StructField("dst", T.LongType()),
                                             T.StructField("border", T.BooleanType())])

    def edge_fn(pdf: pd.DataFrame) -> pd.DataFrame:
        _, _, left, right = _pair_sets(pdf)
        lid, rid = left["__id"].to_numpy(dtype=np.int64), right["__id"].to_numpy(dtype=np.int64)
        lc, rc = left["__core"].to_numpy(dtype=bool), right["__core"].to_numpy(dtype=bool)
        names = np.unique(pdf["__comp"].to_numpy(dtype=np.int64))
        lp, rp = (np.searchsorted(names, d["__comp"].to_numpy(dtype=np.int64)) for d in (left, right))
        lab = np.arange(len(names))
        border = [np.zeros((0, 2), np.int64)]
        for i, j, hit in _near(_vectors(left, "__vec"), _vectors(right, "__vec"), eps):
            ci, cj = np.nonzero(hit & lc[i][:, None] & rc[j][None, :])
            lab = _joined(lab, lp[i[ci]], rp[j[cj]])
            x, y = np.nonzero(hit & ~lc[i][:, None] & rc[j][None, :])
            border.append(np.column_stack([lid[i[x]], names[rp[j[y]]]]))
            x, y = np.nonzero(hit & lc[i][:, None] & ~rc[j][None, :])
            border.append(np.column_stack([rid[j[y]], names[lp[i[x]]]]))
        other = np.flatnonzero(lab != np.arange(len(lab)))
        border = np.unique(np.concatenate(border), axis=0)
        out = pd.DataFrame({"src": np.concatenate([names[other], border[:, 0]]).astype(np.int64),
                            "dst": np.concatenate([names[lab[other]], border[:, 1]]).astype(np.int64),
                            "border": np.repeat([False, True], [len(other), len(border)])})
        for c in g:
            out[c] = pdf[c].iloc[0]
        return out[[f.name for f in edge_schema.fields]]

    rep2 = _replicate(pts2.select(*g, "__id", "__vec", "__blk", "__with", "__core", "__comp"), F.col("__with"), g)
    edges = materialize(rep2.groupBy(*pair).applyInPandas(edge_fn, edge_schema))

    next_to = pts2.select(*g, "__id", F.explode("__next").alias("__comp"))
    out = _numbered(pts2, edges, next_to, g).withColumnRenamed("__id", "__point")
    return for_all(out.unionByName(local_out))


def cluster_stats(assigned: DataFrame, group_cols: list[str] | None = None) -> DataFrame:
    """Size per cluster id (noise = -1 included)."""
    g = list(group_cols or [])
    return assigned.groupBy(*g, "cluster_id").agg(F.count(F.lit(1)).alias("size"))


__all__ = ["dbscan", "metric_blocks", "cluster_stats"]
