"""Normalise landed raw review rows with the store client's defaults.

JavaScript ``a || b`` treats NULL, '' and 0 alike as missing, so every default
is ``coalesce(nullif(x, <falsy>), default)``.  The "now" used for a missing
date is an explicit ``ingest_ts`` argument so reruns are deterministic.
Reading landed files: ``spark.read.schema(RAW_SCHEMA).json(path)`` (or
parquet) followed by ``normalize_raw_reviews``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RAW_SCHEMA = ("id STRING, userName STRING, userImage STRING, text STRING, content STRING, "
              "score INT, thumbsUp INT, version STRING, date TIMESTAMP")


def normalize_raw_reviews(raw: DataFrame, product: str, ingest_ts: str) -> DataFrame:
    def blank(c):
        return F.nullif(F.col(c), F.lit(""))
    return raw.select(
        F.lit(product).alias("product"),
        F.coalesce(blank("id"), F.lit("")).alias("review_id"),
        F.coalesce(blank("userName"), F.lit("Anonymous")).alias("user_name"),
        F.coalesce(blank("userImage"), F.lit("")).alias("user_image"),
        F.coalesce(blank("text"), blank("content"), F.lit("")).alias("content"),
        F.coalesce(F.nullif(F.col("score"), F.lit(0)), F.lit(0)).cast("int").alias("score"),
        F.coalesce(F.nullif(F.col("thumbsUp"), F.lit(0)), F.lit(0)).cast("int").alias("thumbs_up"),
        F.coalesce(blank("version"), F.lit("Unknown")).alias("version"),
        F.coalesce(F.col("date"), F.to_timestamp(F.lit(ingest_ts))).alias("review_ts"),
    )


def raw_rows_from_documents(docs: DataFrame) -> DataFrame:
    """Project documents to the raw landed shape, with some fields missing."""
    d = F.col("doc_id")
    secs = F.lit(1704067200) + ((d * 37) % 84) * 86400 + (d % 86400)
    return docs.select(
        F.when(d % 13 == 0, F.lit(None)).otherwise(d.cast("string")).alias("id"),
        F.when(d % 7 == 0, F.lit("")).otherwise(F.concat(F.lit("user"), d.cast("string"))).alias("userName"),
        F.lit(None).cast("string").alias("userImage"),
        F.when(d % 3 == 0, F.lit(None)).otherwise(F.col("text")).alias("text"),
        F.when((d % 3 == 0) & (d % 2 == 0), F.col("text")).alias("content"),
        F.when(d % 4 == 0, F.lit(None)).otherwise((d % 6).cast("int")).alias("score"),
        F.when(d % 5 == 0, F.lit(None)).otherwise((d % 11).cast("int")).alias("thumbsUp"),
        F.when(d % 2 == 0, F.col("source")).otherwise(F.lit("")).alias("version"),
        F.when(d % 9 == 0, F.lit(None)).otherwise(F.timestamp_seconds(secs)).alias("date"),
    )


SQL_RAW_REVIEWS = """
WITH raw AS (
  SELECT CASE WHEN doc_id % 13 = 0 THEN NULL ELSE CAST(doc_id AS VARCHAR) END AS id,
         CASE WHEN doc_id % 7 = 0 THEN '' ELSE 'user' || CAST(doc_id AS VARCHAR) END AS userName,
         CASE WHEN doc_id % 3 = 0 THEN NULL ELSE text END AS text,
         CASE WHEN doc_id % 3 = 0 AND doc_id % 2 = 0 THEN text END AS content,
         CASE WHEN doc_id % 4 = 0 THEN NULL ELSE CAST(doc_id % 6 AS INTEGER) END AS score,
         CASE WHEN doc_id % 5 = 0 THEN NULL ELSE CAST(doc_id % 11 AS INTEGER) END AS thumbsUp,
         CASE WHEN doc_id % 2 = 0 THEN source ELSE '' END AS version,
         CASE WHEN doc_id % 9 = 0 THEN NULL ELSE TIMESTAMP '2024-01-01 00:00:00'
              + to_days(CAST((doc_id * 37) % 84 AS INTEGER)) + to_seconds(CAST(doc_id % 86400 AS BIGINT)) END AS date
  FROM documents)
SELECT coalesce(nullif(id, ''), '') AS review_id, coalesce(nullif(userName, ''), 'Anonymous') AS user_name,
       coalesce(nullif(text, ''), nullif(content, ''), '') AS content,
       coalesce(nullif(score, 0), 0) AS score, coalesce(nullif(thumbsUp, 0), 0) AS thumbs_up,
       coalesce(nullif(version, ''), 'Unknown') AS version,
       strftime(coalesce(date, TIMESTAMP '2024-06-01 00:00:00'), '%Y-%m-%d %H:%M:%S') AS review_ts
FROM raw
"""
