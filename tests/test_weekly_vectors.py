"""Reviews without a vector: counted in the audit, or embedded by the caller's function."""

import datetime

from pyspark.sql import functions as F

from reviewloom.plans.weekly import weekly_feedback


def test_reviews_without_vector(spark):
    ts = datetime.datetime(2024, 3, 5, 12)
    text = "this review has more than eight words in its body number"
    vectors = [[1.0, 0.0]] * 4 + [None] * 3 + [[0.0, 0.0]] * 2
    rows = [("p", str(i), i, ts, 5, f"{text} {i}", v) for i, v in enumerate(vectors)] + [("p", "90", 90, ts, 5, "short", None)]
    reviews = spark.createDataFrame(rows, "product string, review_id string, ord long, review_ts timestamp, score int, content string, embedding array<float>")
    requests = spark.createDataFrame([("p", "2024-W10", 10)], "product string, week string, lookback_weeks int")

    def audit(**more):
        r = weekly_feedback(reviews, requests, eps=0.5, **more)["run_audit"].first()
        return r.n_remaining, r.n_without_vector, r.n_zero_vector, r.n_clustered_points

    assert audit() == (9, 3, 2, 4)
    assert audit(embedder=lambda df: df.withColumn("embedding", F.array(F.lit(1.0), F.lit(0.0)))) == (9, 0, 0, 9)


def test_vectors_of_their_own(spark):
    """Vectors beside the reviews give the reports of vectors within them, also where ids repeat."""
    ts = datetime.datetime(2024, 3, 5, 12)
    rows = [("pq"[i % 2], i // 2, ts, 5, f"this review has more than eight words in its body number {i}") for i in range(16)]
    rows += [rows[0], rows[3], ("p", 99, ts, 1, "too short")]
    reviews = spark.createDataFrame(rows, "product string, review_id long, review_ts timestamp, score int, content string").withColumn("ord", F.col("review_id"))
    vectors = spark.createDataFrame([(i, [float(i > 3), 0.5]) for i in range(7)] + [(2, [0.0, 0.5])], "review_id long, embedding array<float>")
    requests = spark.createDataFrame([(p, f"2024-W{w}", 4) for p in "pq" for w in (10, 11)], "product string, week string, lookback_weeks int")

    def results(reviews, **more):
        out = weekly_feedback(reviews, requests, eps=0.5, min_pts=2, **more)
        return [sorted(out[n].select(*c).collect()) for n, c in (("run_audit", "*"), ("reports", ["product", "week", "report_text"]),
                                                                ("prompts", ["product", "week", "cluster_id", "prompt"]))]

    own = results(reviews, vectors_of=vectors)
    assert len(own[2]) == 8 and own == results(reviews.join(vectors, "review_id", "left"))
