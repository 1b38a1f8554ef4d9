"""Structured Streaming over a landing zone of raw review files.

raw files -> S1 normalise -> F2 word rule -> H8 scrub -> per-product ISO-week
counts within a 7-day watermark.  Every row counts: rows without an id, or with
a repeated one, are kept.  Weekly
tumbling windows use a 4-day offset so they start on Monday (the epoch is a
Thursday).  State is bounded by the watermark; late rows beyond it are dropped
by Spark's watermark rule.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scrub, text
from ..sources.raw import RAW_SCHEMA, normalize_raw_reviews


def landing_stream(spark: SparkSession, path: str, product: str, ingest_ts: str, fmt: str = "parquet",
                   min_words: int = 8, watermark: str = "7 days") -> DataFrame:
    raw = spark.readStream.schema(RAW_SCHEMA).format(fmt).load(path)
    r = normalize_raw_reviews(raw, product, ingest_ts)
    r = r.filter(text.has_min_words("content", min_words))
    r = scrub.scrub_columns(r)
    return r.withWatermark("review_ts", watermark)


def weekly_counts(stream: DataFrame) -> DataFrame:
    w = F.window("review_ts", "7 days", "7 days", "4 days")
    return stream.groupBy(w.alias("w"), "product").agg(
        F.count(F.lit(1)).alias("n_reviews"), F.count_if("pii_removed").alias("n_pii_redacted")) \
        .select("product", F.col("w.start").alias("week_start"), "n_reviews", "n_pii_redacted")
