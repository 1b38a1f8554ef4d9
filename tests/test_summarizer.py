"""Centroid-nearest sample and fallback theme: the original unit-test cases."""

from pyspark.sql import functions as F

from reviewloom.operators.centroid import fallback_quotes, nearest_to_centroid
from reviewloom.operators.themes import FALLBACK_NAME, ingest_responses, prompt_table


def _reviews(spark):
    rows = [(1, "Fast app", 5, [1.0, 0.0, 0.0]), (2, "Slow app", 2, [0.0, 1.0, 0.0]),
            (3, "Crash app", 1, [0.0, 0.0, 1.0])]
    df = spark.createDataFrame(rows, "id long, content string, score int, embedding array<double>")
    return df.withColumn("c", F.lit(0)).withColumn("ord", F.col("id")) \
             .withColumn("review_ts", F.to_timestamp(F.lit("2026-06-01 10:00:00"))).withColumn("product", F.lit("App"))


def test_under_cap_returns_all_in_order(spark):
    s = nearest_to_centroid(_reviews(spark), ["c"], "ord", k=5).orderBy("rank").collect()
    assert [r.id for r in s] == [1, 2, 3] and all(r.distance is None for r in s)


def test_nearest_with_ties_in_input_order(spark):
    # all three points are equidistant from the centroid: ties keep input order
    s = nearest_to_centroid(_reviews(spark), ["c"], "ord", k=2).orderBy("rank").collect()
    assert [r.id for r in s] == [1, 2]


def test_fallback_theme_on_missing_response(spark):
    s = nearest_to_centroid(_reviews(spark), ["c"], "ord", k=5)
    p = prompt_table(s, ["c"])
    t = ingest_responses(p, None, fallback_quotes(s, ["c"]), ["c"]).first()
    assert t.theme_name == FALLBACK_NAME and t.used_fallback
    assert t.representative_quotes == ["Fast app", "Slow app"] and len(t.action_ideas) == 1


def test_prompt_lines(spark):
    s = nearest_to_centroid(_reviews(spark), ["c"], "ord", k=5)
    p = prompt_table(s, ["c"]).first()
    assert p.reviews_text.startswith('[Review 1] Date: 2026-06-01, Rating: 5★\nText: "Fast app"\n\n[Review 2]')
    assert "for the App financial app" in p.prompt
    assert p.estimated_tokens == -(-(len(p.prompt) + len(p.reviews_text)) // 4) + 500


def test_bad_and_good_responses(spark):
    s = nearest_to_centroid(_reviews(spark), ["c"], "ord", k=5)
    p = prompt_table(s, ["c"]).union(prompt_table(s, ["c"]).withColumn("c", F.lit(1)))
    resp = spark.createDataFrame([(0, '{"themeName": "Login", "themeDescription": "d", "representativeQuotes": ["x"]}'),
                                  (1, '{"themeName": "Login", "themeDescription": "d", "representativeQuotes": "x"}')],
                                 "c int, response string")
    fb = fallback_quotes(s, ["c"]).union(fallback_quotes(s, ["c"]).withColumn("c", F.lit(1)))
    got = {r.c: r for r in ingest_responses(p, resp, fb, ["c"]).collect()}
    assert got[0].theme_name == "Login" and got[0].action_ideas == [] and not got[0].used_fallback
    assert got[1].theme_name == FALLBACK_NAME
