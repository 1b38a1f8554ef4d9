"""Vector queries: L2 distance, normalising, centroids, centroid-nearest sample
(H11, H12, A2, J5, W1, W5) on the embeddings table, with ``label`` as the
ready-made cluster id and ``vec_id`` as scan order."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vectors
from ..operators.centroid import centroids, nearest_to_centroid
from ..sources.tables import embeddings_view, table
from .catalog import register


def l2_successor(spark, sf_dir):
    """Distance from each vector to the next id's vector (equi-join on id+1)."""
    e = table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("next_embedding"))
    j = e.join(nxt, "vec_id")
    return j.select("vec_id", F.round(vectors.l2_distance("embedding", "next_embedding"), 6).alias("distance"))


register("l2_successor", f"""
SELECT a.vec_id, round({vectors.sql_l2('a.embedding', 'b.embedding')}, 6) AS distance
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1
""")(l2_successor)


def normalize_vectors(spark, sf_dir):
    """Unit-normalise every vector (zero vectors stay zero)."""
    e = table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    n = e.select("vec_id", vectors.normalize("embedding").alias("v"))
    return n.select("vec_id", F.round(vectors.l2_norm("v"), 6).alias("norm"),
                    F.round(F.element_at("v", 1), 6).alias("first_component"),
                    vectors.is_zero_vector("v").alias("is_zero"))


register("normalize_vectors", """
WITH n AS (SELECT vec_id, sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))) AS nrm,
                  embedding FROM embeddings),
v AS (SELECT vec_id, CASE WHEN nrm > 0 THEN list_transform(embedding, lambda x: CAST(x AS DOUBLE) / nrm)
                          ELSE list_transform(embedding, lambda x: 0.0::DOUBLE) END AS v FROM n)
SELECT vec_id, round(sqrt(list_sum(list_transform(v, lambda x: x * x))), 6) AS norm,
       round(v[1], 6) AS first_component, list_bool_and(list_transform(v, lambda x: x = 0)) AS is_zero FROM v
""")(normalize_vectors)


def q_centroids(spark, sf_dir):
    """A2: elementwise mean per label (not renormalised), rounded to 6 dp."""
    c = centroids(embeddings_view(spark, sf_dir), ["label"])
    return c.select("label", F.transform("centroid", lambda x: F.round(x, 6)).alias("centroid"), "n_members")


register("centroids", """
WITH u AS (SELECT label, unnest(embedding) AS x, unnest(generate_series(1, len(embedding))) AS pos FROM embeddings),
d AS (SELECT label, pos, avg(CAST(x AS DOUBLE)) AS m, count(*) AS n FROM u GROUP BY label, pos)
SELECT label, list(round(m, 6) ORDER BY pos) AS centroid, CAST(max(n) AS BIGINT) AS n_members FROM d GROUP BY label
""")(q_centroids)


_SQL_NEAREST = """
WITH u AS (SELECT label, unnest(embedding) AS x, unnest(generate_series(1, len(embedding))) AS pos FROM embeddings),
d AS (SELECT label, pos, avg(CAST(x AS DOUBLE)) AS m FROM u GROUP BY label, pos),
c AS (SELECT label, list(m ORDER BY pos) AS centroid FROM d GROUP BY label),
s AS (SELECT label, count(*) AS n FROM embeddings GROUP BY label),
m AS (SELECT e.label, e.vec_id, s.n,
             CASE WHEN s.n > {k} THEN {dist} END AS distance
      FROM embeddings e JOIN s ON s.label = e.label JOIN c ON c.label = e.label),
r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY coalesce(distance, 0.0), vec_id) AS rank FROM m)
"""


def q_nearest(spark, sf_dir):
    """At most 15 members per label nearest the centroid, ties by vec_id."""
    s = nearest_to_centroid(embeddings_view(spark, sf_dir), ["label"], "ord", k=15)
    return s.select("label", "vec_id", F.col("rank").cast("long").alias("rank"),
                    F.round("distance", 6).alias("distance"))


register("nearest_to_centroid", _SQL_NEAREST.format(k=15, dist=vectors.sql_l2("e.embedding", "c.centroid")) + """
SELECT label, vec_id, CAST(rank AS BIGINT) AS rank, round(distance, 6) AS distance FROM r WHERE rank <= 15
""")(q_nearest)


def q_nearest_small(spark, sf_dir):
    """W1 with k above every cluster size: all members, input order, no distances."""
    s = nearest_to_centroid(embeddings_view(spark, sf_dir), ["label"], "ord", k=1000)
    return s.select("label", "vec_id", F.col("rank").cast("long").alias("rank"))


register("nearest_all_members", _SQL_NEAREST.format(k=1000, dist=vectors.sql_l2("e.embedding", "c.centroid")) + """
SELECT label, vec_id, CAST(rank AS BIGINT) AS rank FROM r WHERE rank <= 1000
""")(q_nearest_small)


def q_embed_texts(spark, sf_dir):
    """T1 offline embedder (hashing TF-IDF, 384-d, L2-normalised; blank text
    -> zero vector) over every document; rows-only check of dim and norm."""
    from ..operators.embed import hashing_embedder
    d = table(spark, sf_dir, "documents", "doc_id", "text")
    e = hashing_embedder(d, "text", 384)
    return e.select("doc_id", F.size("embedding").cast("long").alias("dim"),
                    F.round(vectors.l2_norm("embedding"), 6).alias("norm"))


register("embed_texts")(q_embed_texts)
