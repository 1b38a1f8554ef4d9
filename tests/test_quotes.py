"""Quote validation: exact, changed and invented quotes, plus scale-path checks."""

import random

from pyspark.sql import functions as F

from reviewloom.operators import quotes as operator
from reviewloom.operators.quotes import substring_matches, validate_quotes

REVIEWS = [(1, "Opening my account page takes ages and then it freezes."),
           (2, "Great tool, setting up a plan was simple!")]


def _run(spark, quotes):
    r = spark.createDataFrame(REVIEWS, "review_id long, content string").withColumn("ord", F.col("review_id")) \
             .withColumn("c", F.lit(0))
    q = spark.createDataFrame([(0, i, x) for i, x in enumerate(quotes)], "c int, quote_ord int, quote string")
    checks, roll = validate_quotes(q, r, theme_cols=["c"], match_cols=["c"])
    return checks.orderBy("quote_ord").collect(), roll.first()


def test_exact(spark):
    _, roll = _run(spark, ["takes ages and then", "setting up a plan was simple!"])
    assert roll.valid_quotes == ["takes ages and then", "setting up a plan was simple!"]
    assert roll.warnings == []


def test_recovered_whole_review(spark):
    _, roll = _run(spark, ["Takes Ages AND then it freezes"])
    assert roll.valid_quotes == [REVIEWS[0][1]]
    assert len(roll.warnings) == 1 and "Quote modified to match verbatim content" in roll.warnings[0]


def test_fabricated_falls_back_to_first_review(spark):
    checks, roll = _run(spark, ["Nobody ever wrote these words in a review."])
    assert checks[0].outcome == "discarded"
    assert roll.valid_quotes == [REVIEWS[0][1]] and roll.substituted
    assert len(roll.warnings) == 2 and "Quote discarded (not found in source texts)" in roll.warnings[0]


def test_blank_and_short_quotes(spark):
    checks, roll = _run(spark, ["   ", "page", "freezes", "q"])
    assert [c.outcome for c in checks] == ["exact", "exact", "discarded"]
    assert roll.valid_quotes == ["page", "freezes"]


def test_substring_matches_equals_brute_force(spark):
    rnd = random.Random(7)
    alphabet = "ab c"
    texts = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 60))) for _ in range(40)]
    quotes = [t[i:i + n] for t in rnd.sample(texts, 10) for i, n in [(rnd.randint(0, 5), rnd.randint(1, 14))]]
    quotes += ["abcabc", "zz", "a"]
    tdf = spark.createDataFrame(list(enumerate(texts)), "tid long, t string")
    qdf = spark.createDataFrame(list(enumerate(quotes)), "qid long, q string")
    got = {(r.qid, r.tid) for r in substring_matches(tdf, qdf, [], "tid", "t", "qid", "q").collect()}
    want = {(qi, ti) for qi, q in enumerate(quotes) for ti, t in enumerate(texts) if q and q in t}
    assert got == want


def test_common_short_grams_make_no_candidates(spark, monkeypatch):
    """Texts of the quotes' words in another order share short grams with each quote, but none as long as LONG_GRAM."""
    words = [f"word{i % 7}common" for i in range(40)]
    texts = [(i, " ".join(words[i % 5:] + [f"tail{i}"])) for i in range(60)]
    quotes = [(1, texts[7][1][11:140]), (2, ("commonword" * 20)[:150]), (3, texts[9][1][-25:])]
    seen = []
    kept = operator.materialize
    monkeypatch.setattr(operator, "materialize", lambda df: seen.append(kept(df)) or seen[-1])
    found = operator.substring_matches(spark.createDataFrame(texts, "id long, t string"), spark.createDataFrame(quotes, "q long, s string"),
                                       [], "id", "t", "q", "s", gram=6, of_text=F.lower)
    assert sorted(map(tuple, found.select("q", "id").collect())) == [(q, i) for q, s in quotes for i, t in texts if s in t]
    assert {r.q for r in seen[-1].collect()} <= {1, 3}


def test_texts_that_stand_once(spark):
    """A review of many themes is read once, and every theme gets what it gets with texts of its own."""
    reviews = [(c, r, r, REVIEWS[r % len(REVIEWS)][1] + f" {r}") for c in range(3) for r in range(9) if (r + c) % 3]
    quotes = [(c, o, q) for c in range(3) for o, q in enumerate([REVIEWS[0][1] + " 1", REVIEWS[1 % len(REVIEWS)][1].upper(), "page", "never written anywhere", " "])]
    quotes = [q for q in quotes if q[0] < 2] + [(2, 0, "neither was this sentence")]
    q = spark.createDataFrame(quotes, "theme int, quote_ord int, quote string")
    r = spark.createDataFrame(reviews, "theme int, review_id int, ord int, content string")
    texts = r.select(F.col("review_id").alias("__row"), "content").distinct()
    want = validate_quotes(q, r, ["theme"], ["theme"])
    got = validate_quotes(q, r.drop("content").withColumn("__row", F.col("review_id")), ["theme"], ["theme"], texts=texts)
    for a, b in zip(got, want):
        assert a.columns == b.columns and sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
    assert {c.outcome for c in got[0].collect()} == {"exact", "recovered", "discarded"}
