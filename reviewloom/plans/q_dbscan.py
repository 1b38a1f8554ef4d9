"""DBSCAN queries (J1, C1-C5) over the embeddings table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.vectors import sql_l2
from ..operators.dbscan import cluster_stats, dbscan
from ..sources.tables import embeddings_view
from .catalog import register

# Fixture parameters: the vectors are 64-d and nearly uniform, so the
# original eps values (0.6 / 0.7) leave every point as noise; 1.14 forms
# clusters at every scale factor.  0.7 stays as the all-noise case.
EPS = 1.14
MIN_PTS = 3


def _sql_dbscan(eps: float, min_pts: int, group: str | None = None, pts_sql: str | None = None,
                prelude: str = "") -> str:
    """Sequential DBSCAN rules in SQL.  ``pts_sql`` must yield (id, grp, v, o)
    where ``o`` is the scan-order key; the default is the embeddings table."""
    gsel = f"{group} AS grp" if group else "0 AS grp"
    pts = pts_sql or f"SELECT vec_id AS id, {gsel}, embedding AS v, vec_id AS o FROM embeddings"
    return f"""
WITH RECURSIVE {prelude}
pts AS ({pts}),
nb AS (SELECT a.grp, a.id AS i, b.id AS j FROM pts a JOIN pts b
        ON a.grp = b.grp AND a.id <> b.id AND {sql_l2('a.v', 'b.v')} <= {eps}),
deg AS (SELECT p.grp, p.id, count(nb.j) AS n FROM pts p LEFT JOIN nb ON nb.grp = p.grp AND nb.i = p.id
        GROUP BY p.grp, p.id),
core AS (SELECT grp, id FROM deg WHERE n >= {min_pts}),
ce AS (SELECT nb.grp, nb.i, nb.j FROM nb JOIN core c1 ON c1.grp = nb.grp AND c1.id = nb.i
        JOIN core c2 ON c2.grp = nb.grp AND c2.id = nb.j),
cc(grp, id, lbl) AS (SELECT grp, id, id FROM core
        UNION SELECT ce.grp, ce.j, cc.lbl FROM cc JOIN ce ON cc.grp = ce.grp AND cc.id = ce.i),
comp AS (SELECT grp, id, min(lbl) AS comp FROM cc GROUP BY grp, id),
num AS (SELECT comp.grp, comp.comp, row_number() OVER (PARTITION BY comp.grp ORDER BY min(p.o)) - 1 AS cid
        FROM comp JOIN pts p ON p.grp = comp.grp AND p.id = comp.id GROUP BY comp.grp, comp.comp),
core_c AS (SELECT comp.grp, comp.id, num.cid FROM comp JOIN num ON num.grp = comp.grp AND num.comp = comp.comp),
border AS (SELECT nb.grp, nb.i AS id, min(core_c.cid) AS cid FROM nb
        JOIN core_c ON core_c.grp = nb.grp AND core_c.id = nb.j
        WHERE NOT EXISTS (SELECT 1 FROM core WHERE core.grp = nb.grp AND core.id = nb.i)
        GROUP BY nb.grp, nb.i),
assigned AS (
  SELECT d.grp, d.id AS vec_id, CAST(coalesce(core_c.cid, border.cid, -1) AS INTEGER) AS cluster_id,
         d.n >= {min_pts} AS is_core, CAST(d.n AS BIGINT) AS n_neighbors
  FROM deg d LEFT JOIN core_c ON core_c.grp = d.grp AND core_c.id = d.id
  LEFT JOIN border ON border.grp = d.grp AND border.id = d.id)"""


def _points(spark, sf_dir):
    return embeddings_view(spark, sf_dir)


def q_dbscan(spark, sf_dir):
    """Cluster id per vector (scan order = vec_id)."""
    out = dbscan(_points(spark, sf_dir), EPS, MIN_PTS, "vec_id", "embedding", "ord")
    return out.select("vec_id", "cluster_id", "is_core")


register("dbscan", _sql_dbscan(EPS, MIN_PTS) + "\nSELECT vec_id, cluster_id, is_core FROM assigned")(q_dbscan)


def q_core_points(spark, sf_dir):
    """J1 + C1: eps-neighbour count per vector (self excluded) and core flag."""
    out = dbscan(_points(spark, sf_dir), EPS, MIN_PTS, "vec_id", "embedding", "ord")
    return out.select("vec_id", "n_neighbors", "is_core")


register("core_points", _sql_dbscan(EPS, MIN_PTS) + "\nSELECT vec_id, n_neighbors, is_core FROM assigned")(q_core_points)


def q_cluster_stats(spark, sf_dir):
    """Cluster sizes, noise included as -1."""
    out = dbscan(_points(spark, sf_dir), EPS, MIN_PTS, "vec_id", "embedding", "ord")
    return cluster_stats(out)


register("cluster_stats", _sql_dbscan(EPS, MIN_PTS)
         + "\nSELECT cluster_id, count(*)::BIGINT AS size FROM assigned GROUP BY cluster_id")(q_cluster_stats)


def q_dbscan_all_noise(spark, sf_dir):
    """The original eps (0.7) on the fixture vectors: every point is noise."""
    out = dbscan(_points(spark, sf_dir), 0.7, MIN_PTS, "vec_id", "embedding", "ord")
    return cluster_stats(out)


register("dbscan_all_noise", _sql_dbscan(0.7, MIN_PTS)
         + "\nSELECT cluster_id, count(*)::BIGINT AS size FROM assigned GROUP BY cluster_id")(q_dbscan_all_noise)


def q_dbscan_by_label(spark, sf_dir):
    """Grouped DBSCAN: one independent clustering per label (per product-week
    in the pipeline), numbering restarts at 0 in each group."""
    out = dbscan(_points(spark, sf_dir), EPS, MIN_PTS, "vec_id", "embedding", "ord", group_cols=["label"])
    return out.select("label", "vec_id", "cluster_id", "is_core")


register("dbscan_by_label", _sql_dbscan(EPS, MIN_PTS, "label")
         + "\nSELECT grp AS label, vec_id, cluster_id, is_core FROM assigned")(q_dbscan_by_label)


def q_dbscan_blocked(spark, sf_dir):
    """C2-C4 through the distributed block-pair path (block size 128, so the
    vectors span many blocks and block pairs) - must equal ``dbscan``."""
    out = dbscan(_points(spark, sf_dir), EPS, MIN_PTS, "vec_id", "embedding", "ord", block_size=128)
    return out.select("vec_id", "cluster_id", "is_core")


register("dbscan_blocked", _sql_dbscan(EPS, MIN_PTS) + "\nSELECT vec_id, cluster_id, is_core FROM assigned")(q_dbscan_blocked)
