"""Survey properties: the many-week backfill equals single-week runs; every
kept 'exact' quote is a substring of a review of its cluster."""

from pyspark.sql import functions as F

from reviewloom.functions.weeks import iso_week_key
from reviewloom.operators.window import expand_to_requests, lookback_filter
from reviewloom.plans.weekly import weekly_feedback
from reviewloom.sources.tables import reviews_view

from .conftest import SF_SMALL


def test_backfill_equals_single_weeks(spark):
    r = reviews_view(spark, SF_SMALL).select("product", "review_id", "review_ts")
    req = r.select("product", iso_week_key("review_ts").alias("week")).distinct().withColumn("lookback_weeks", F.lit(4))
    many = {(x.product, x.week, x.review_id) for x in expand_to_requests(r, req).collect()}
    single = set()
    for q in req.collect():
        rows = lookback_filter(r.filter(F.col("product") == q.product), q.week, 4).collect()
        single |= {(q.product, q.week, x.review_id) for x in rows}
    assert many == single and len(many) > 0


def test_exact_quotes_are_substrings_of_cluster_reviews(spark):
    r = reviews_view(spark, SF_SMALL, with_embedding=True)
    req = r.select("product", iso_week_key("review_ts").alias("week")).distinct().withColumn("lookback_weeks", F.lit(10))
    out = weekly_feedback(r, req, eps=1.14)
    checks = out["quote_checks"].filter(F.col("outcome") == "exact")
    members = out["sample"].select("product", "week", "cluster_id", "review_id", "content")
    bad = checks.join(members, ["product", "week", "cluster_id"]) \
        .groupBy("product", "week", "cluster_id", "quote_ord") \
        .agg(F.max(F.col("content").contains(F.col("quote")).cast("int")).alias("ok")).filter("ok = 0")
    assert checks.count() > 0 and bad.count() == 0


def test_requests_are_expanded_not_reviews(spark):
    """Windows at their bounds, weeks that are none and repeated requests; no week key is made for each review and week."""
    ends = ["2024-02-25 23:59:59.998", "2024-02-25 23:59:59.999", "2024-03-10 23:59:59.999", "2024-03-11 00:00:00", "2024-03-10 23:59:59.9995", "2024-02-26 00:00:00"]
    r = spark.createDataFrame([("p", i, t) for i, t in enumerate(ends)] + [("q", 9, ends[2]), (None, 8, ends[2])], "product string, review_id long, ts string")
    r = r.select("product", "review_id", F.col("ts").cast("timestamp").alias("review_ts"))
    req = [("p", "2024-W10", 2), ("p", "2024-W10", 0), ("p", "2024-W10", None), ("p", "2023-W62", 2), ("p", None, 2), ("q", "2024-W11", 1), ("q", "2024-W11", 1)]
    x = expand_to_requests(r, spark.createDataFrame(req, "product string, week string, lookback_weeks int"))
    assert x.columns == ["product", "review_id", "review_ts", "week", "lookback_weeks"]
    got = sorted((i.review_id, i.week, i.lookback_weeks) for i in x.collect())
    assert got == [(1, "2024-W10", 2), (2, "2024-W10", 0), (2, "2024-W10", 2), (5, "2024-W10", 2), (9, "2024-W11", 1), (9, "2024-W11", 1)]
    assert "YEAROFWEEK" not in x._jdf.queryExecution().optimizedPlan().toString().upper()
