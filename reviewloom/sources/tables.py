"""Parquet table access and the review-shaped views built from the test tables.

``reviews_view`` is the engine's review relation.  Columns are selected at the
scan so Catalyst prunes the parquet ``ReadSchema``; filters placed on the
result (window bounds, ids) are pushed into the scan where they reference
stored columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()

# Fixed epoch of the review-shaped view: 2024-01-01 00:00:00 UTC.
REVIEW_EPOCH_SECONDS = 1704067200


# Tables whose rows carry long texts: per-row regex work dominates their cost.
TEXT_TABLES = {"documents", "pages", "conversations", "benchmark"}


# Most scan splits (of spark.sql.files.maxPartitionBytes) that are dealt out over the cores.
SMALL_SPLITS = 4


def spread(df: DataFrame) -> DataFrame:
    """Round-robin the rows over the cores when a scan has at most SMALL_SPLITS
    splits (a small file with one row group); larger inputs are never moved."""
    try:
        cores = df.sparkSession.sparkContext.defaultParallelism
        splits = df.rdd.getNumPartitions()
    except Exception:  # Spark Connect: leave partitioning to the server
        return df
    return df.repartition(cores) if splits < cores and splits <= SMALL_SPLITS else df


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    df = df.select(*columns) if columns else df
    return spread(df) if name in TEXT_TABLES else df


def review_order_key(ts_col: str = "review_ts", id_col: str = "review_id"):
    """Newest first, then id: a struct ordered ascending == scan order."""
    return F.struct((-F.unix_micros(F.col(ts_col))).alias("neg_ts"), F.col(id_col).alias("id"))


def reviews_view(spark: SparkSession, sf_dir: str, with_embedding: bool = False) -> DataFrame:
    """documents -> reviews(product, review_id, content, score, thumbs_up,
    version, review_ts[, embedding], ord)."""
    d = table(spark, sf_dir, "documents", "doc_id", "text", "lang", "source")
    secs = (F.lit(REVIEW_EPOCH_SECONDS) + ((F.col("doc_id") * 37) % 84) * 86400
            + (F.col("doc_id") % 86400))
    r = d.select(
        F.col("lang").alias("product"),
        F.col("doc_id").alias("review_id"),
        F.col("text").alias("content"),
        (F.lit(1) + F.col("doc_id") % 5).cast("int").alias("score"),
        (F.col("doc_id") % 11).cast("int").alias("thumbs_up"),
        F.col("source").alias("version"),
        F.timestamp_seconds(secs).alias("review_ts"),
    )
    if with_embedding:
        e = table(spark, sf_dir, "embeddings", "vec_id", "embedding")
        r = r.join(e, r.review_id == e.vec_id, "left").drop("vec_id")
    return r.withColumn("ord", review_order_key())


def review_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reviews' vectors by themselves: review_id, embedding."""
    return table(spark, sf_dir, "embeddings", "vec_id", "embedding").withColumnRenamed("vec_id", "review_id")


SQL_REVIEWS_V = """
reviews_v AS (
  SELECT lang AS product, doc_id AS review_id, text AS content,
         CAST(1 + doc_id % 5 AS INTEGER) AS score, CAST(doc_id % 11 AS INTEGER) AS thumbs_up,
         source AS version,
         TIMESTAMP '2024-01-01 00:00:00' + to_days(CAST((doc_id * 37) % 84 AS INTEGER))
             + to_seconds(CAST(doc_id % 86400 AS BIGINT)) AS review_ts
  FROM documents
)"""


def embeddings_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors with ``ord = vec_id`` and ``label`` as a ready-made cluster."""
    return table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label") \
        .withColumn("ord", F.col("vec_id"))
