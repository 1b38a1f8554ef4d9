"""Cluster centroids (A2), member-to-centroid join (J5) and the
centroid-nearest sample (W1, W5).

Centroids are an elementwise mean: ``posexplode`` + ``groupBy(cluster, pos)``
aggregates with map-side partial sums, so a hot cluster is reduced before the
shuffle and the result is one dim-sized array per cluster.  The centroid
table holds one row per cluster and is broadcast only when its measured row
count is under the bound.  The sample is ``row_number() <= k`` over
(group, cluster), which Spark plans with a partial WindowGroupLimit ahead of
the exchange, so a cluster holding a third of the rows is cut to k rows per
map task before anything is shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import l2_distance
from .joins import bounded_broadcast


def centroids(members: DataFrame, key_cols: list[str], vec_col: str = "embedding") -> DataFrame:
    """(key..., centroid ARRAY<DOUBLE>, n_members LONG)."""
    pe = members.select(*key_cols, F.posexplode(F.col(vec_col)).alias("__pos", "__x"))
    per_dim = pe.groupBy(*key_cols, "__pos").agg(F.sum(F.col("__x").cast("double")).alias("__s"),
                                                 F.count(F.lit(1)).alias("__n"))
    agg = per_dim.groupBy(*key_cols).agg(
        F.array_sort(F.collect_list(F.struct("__pos", (F.col("__s") / F.col("__n")).alias("__m")))).alias("__c"),
        F.max("__n").alias("n_members"))
    return agg.select(*key_cols, F.transform("__c", lambda s: s["__m"]).alias("centroid"), "n_members")


def nearest_to_centroid(members: DataFrame, key_cols: list[str], order_col: str, k: int = 15,
                        vec_col: str = "embedding") -> DataFrame:
    """Keep at most ``k`` members per cluster.

    Clusters with n <= k keep every member in input order (no distance work);
    larger clusters keep the k nearest to the centroid, ties in input order.
    Adds ``rank`` (1-based) and ``distance`` (NULL for small clusters)."""
    sizes = members.groupBy(*key_cols).agg(F.count(F.lit(1)).alias("__size"))
    m = members.join(bounded_broadcast(sizes), key_cols)
    big_keys = sizes.filter(F.col("__size") > k).select(*key_cols)
    cents = centroids(m.join(bounded_broadcast(big_keys), key_cols, "left_semi"), key_cols, vec_col)
    m = m.join(bounded_broadcast(cents.select(*key_cols, "centroid")), key_cols, "left")
    dist = F.when(F.col("__size") > k, l2_distance(F.col(vec_col), F.col("centroid")))
    m = m.withColumn("distance", dist).drop("centroid")
    sort_key = F.coalesce(F.col("distance"), F.lit(0.0))
    w = Window.partitionBy(*key_cols).orderBy(sort_key, F.col(order_col))
    return m.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).drop("__size")


def fallback_quotes(sample: DataFrame, key_cols: list[str], text_col: str = "content", n: int = 2) -> DataFrame:
    """The first ``n`` sampled texts of each cluster, in sample order."""
    top = sample.filter(F.col("rank") <= n)
    return top.groupBy(*key_cols).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", F.col(text_col).alias("t")))),
                    lambda s: s["t"]).alias("fallback_quotes"))
