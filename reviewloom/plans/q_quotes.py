"""Quote verification queries (J2/J2s, J3, W2-W4, A8, T5).

Quotes are the ``benchmark`` passages in four forms per item: as is (exact),
upper-cased with commas removed (recovered through normalisation), prefixed
with ``zzz`` (discarded) and blank (skipped); the source texts are every
review of ``reviews_v``.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import js_trim, normalize_for_match, sql_js_trim, sql_normalize
from ..operators.quotes import substring_matches, validate_quotes
from ..sources.tables import SQL_REVIEWS_V, reviews_view, table
from .catalog import register


# ASCII-only upper-casing (identical in Spark and DuckDB, unlike locale-aware upper()).
_LOWER = "abcdefghijklmnopqrstuvwxyz"
_UPPER = _LOWER.upper()


def quotes_view(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark", "item_id", "text")
    v = F.explode(F.array(
        F.struct(F.lit(0).alias("quote_ord"), F.col("text").alias("quote")),
        F.struct(F.lit(1).alias("quote_ord"), F.translate(F.replace(F.col("text"), F.lit(","), F.lit("")), _LOWER, _UPPER).alias("quote")),
        F.struct(F.lit(2).alias("quote_ord"), F.concat(F.lit("zzz"), F.col("text")).alias("quote")),
        F.struct(F.lit(3).alias("quote_ord"), F.lit("").alias("quote"))))
    return b.select("item_id", v.alias("q")).select("item_id", "q.quote_ord", "q.quote")


_SQL_QUOTES_V = f"""
quotes_v AS (
  SELECT item_id, 0 AS quote_ord, text AS quote FROM benchmark
  UNION ALL SELECT item_id, 1, translate(replace(text, ',', ''), '{_LOWER}', '{_UPPER}') FROM benchmark
  UNION ALL SELECT item_id, 2, 'zzz' || text FROM benchmark
  UNION ALL SELECT item_id, 3, '' FROM benchmark)"""


def quote_exact(spark, sf_dir):
    """J2/J2s + W2: reviews containing each passage verbatim; first in scan order."""
    r = reviews_view(spark, sf_dir).select("review_id", "content", "ord")
    q = table(spark, sf_dir, "benchmark", "item_id", "text").select("item_id", js_trim("text").alias("q"))
    m = substring_matches(r, q, [], "review_id", "content", "item_id", "q")
    m = m.join(r.select("review_id", "ord"), "review_id")
    return m.groupBy("item_id").agg(F.count(F.lit(1)).alias("n_matches"),
                                    F.min_by("review_id", "ord").alias("first_review_id"))


register("quote_exact", f"""
WITH {SQL_REVIEWS_V.strip()},
q AS (SELECT item_id, {sql_js_trim('text')} AS q FROM benchmark)
SELECT q.item_id, count(*)::BIGINT AS n_matches,
       first(r.review_id ORDER BY r.review_ts DESC, r.review_id) AS first_review_id
FROM q JOIN reviews_v r ON length(q.q) > 0 AND contains(r.content, q.q)
GROUP BY q.item_id
""")(quote_exact)


def quote_normalised(spark, sf_dir):
    """J3 + W3: altered passages matched after normalisation (length > 5);
    the *last* matching review in scan order wins."""
    r = reviews_view(spark, sf_dir).select("review_id", "content", "ord")
    q = quotes_view(spark, sf_dir).filter(F.col("quote_ord") == 1) \
        .select("item_id", normalize_for_match(js_trim("quote")).alias("nq")).filter(F.length("nq") > 5)
    m = substring_matches(r, q, [], "review_id", "content", "item_id", "nq", gram=6, of_text=normalize_for_match)
    m = m.join(r.select("review_id", "ord"), "review_id")
    return m.groupBy("item_id").agg(F.count(F.lit(1)).alias("n_matches"),
                                    F.max_by("review_id", "ord").alias("last_review_id"))


register("quote_normalised", f"""
WITH {SQL_REVIEWS_V.strip()}, {_SQL_QUOTES_V.strip()},
rn AS MATERIALIZED (SELECT review_id, review_ts, {sql_normalize('content')} AS nc FROM reviews_v),
q AS (SELECT item_id, {sql_normalize(sql_js_trim('quote'))} AS nq FROM quotes_v WHERE quote_ord = 1)
SELECT q.item_id, count(*)::BIGINT AS n_matches,
       first(rn.review_id ORDER BY rn.review_ts ASC, rn.review_id DESC) AS last_review_id
FROM q JOIN rn ON length(q.nq) > 5 AND contains(rn.nc, q.nq)
GROUP BY q.item_id
""")(quote_normalised)

_SQL_VALIDATE = f"""
WITH {SQL_REVIEWS_V.strip()}, {_SQL_QUOTES_V.strip()},
rn AS MATERIALIZED (SELECT review_id, review_ts, content, {sql_normalize('content')} AS nc FROM reviews_v),
nb AS (SELECT item_id, quote_ord, {sql_js_trim('quote')} AS trimmed FROM quotes_v
       WHERE length({sql_js_trim('quote')}) > 0),
ex AS (SELECT nb.item_id, nb.quote_ord, first(rn.review_id ORDER BY rn.review_ts DESC, rn.review_id) AS exact_review
       FROM nb JOIN rn ON contains(rn.content, nb.trimmed) GROUP BY 1, 2),
pn AS (SELECT nb.*, {sql_normalize('nb.trimmed')} AS nq FROM nb
       WHERE NOT EXISTS (SELECT 1 FROM ex WHERE ex.item_id = nb.item_id AND ex.quote_ord = nb.quote_ord)
         AND length({sql_normalize('nb.trimmed')}) > 5),
nm AS (SELECT pn.item_id, pn.quote_ord,
              first(rn.content ORDER BY rn.review_ts ASC, rn.review_id DESC) AS recovered,
              first(rn.review_id ORDER BY rn.review_ts ASC, rn.review_id DESC) AS recovered_review
       FROM pn JOIN rn ON contains(rn.nc, pn.nq) GROUP BY 1, 2),
checks AS (
  SELECT nb.item_id, nb.quote_ord, nb.trimmed AS quote,
         CASE WHEN ex.exact_review IS NOT NULL THEN 'exact' WHEN nm.recovered IS NOT NULL THEN 'recovered'
              ELSE 'discarded' END AS outcome,
         CASE WHEN ex.exact_review IS NOT NULL THEN nb.trimmed WHEN nm.recovered IS NOT NULL THEN nm.recovered END
              AS kept_quote,
         CASE WHEN ex.exact_review IS NOT NULL THEN NULL
              WHEN nm.recovered IS NOT NULL THEN 'Quote modified to match verbatim content: "' || nb.trimmed
                   || '" -> "' || nm.recovered || '"'
              ELSE 'Quote discarded (not found in source texts): "' || nb.trimmed || '"' END AS warning,
         coalesce(ex.exact_review, nm.recovered_review) AS matched_review_id
  FROM nb LEFT JOIN ex ON ex.item_id = nb.item_id AND ex.quote_ord = nb.quote_ord
  LEFT JOIN nm ON nm.item_id = nb.item_id AND nm.quote_ord = nb.quote_ord)"""


def _validate(spark, sf_dir):
    r = reviews_view(spark, sf_dir).select("review_id", "content", "ord")
    return validate_quotes(quotes_view(spark, sf_dir), r, theme_cols=["item_id"], match_cols=[])


def quote_checks(spark, sf_dir):
    """T5 per quote: outcome, kept text, matched review."""
    checks, _ = _validate(spark, sf_dir)
    return checks.select("item_id", F.col("quote_ord").cast("int").alias("quote_ord"), "outcome",
                         "matched_review_id", F.md5("kept_quote").alias("kept_md5"))


register("quote_checks", _SQL_VALIDATE + """
SELECT item_id, CAST(quote_ord AS INTEGER) AS quote_ord, outcome, matched_review_id, md5(kept_quote) AS kept_md5
FROM checks""")(quote_checks)


def quote_validation(spark, sf_dir):
    """T5 + A8 + W4 per theme: valid quotes and warnings in quote order, with
    the first-review substitution when nothing survives."""
    _, roll = _validate(spark, sf_dir)
    return roll.select("item_id", "valid_quotes", "warnings", "substituted")


register("quote_validation", _SQL_VALIDATE + """,
roll AS (SELECT item_id, list(kept_quote ORDER BY quote_ord) FILTER (WHERE kept_quote IS NOT NULL) AS valid,
                list(warning ORDER BY quote_ord) FILTER (WHERE warning IS NOT NULL) AS warns
         FROM checks GROUP BY item_id),
fr AS (SELECT first(content ORDER BY review_ts DESC, review_id) AS f FROM reviews_v),
themes AS (SELECT DISTINCT item_id FROM quotes_v)
SELECT t.item_id,
       CASE WHEN len(coalesce(roll.valid, [])) = 0 THEN [fr.f] ELSE roll.valid END AS valid_quotes,
       CASE WHEN len(coalesce(roll.valid, [])) = 0 THEN list_concat(coalesce(roll.warns, []),
            ['No quotes validated. Substituted with top representative review: "' || fr.f || '"'])
            ELSE coalesce(roll.warns, []) END AS warnings,
       len(coalesce(roll.valid, [])) = 0 AS substituted
FROM themes t LEFT JOIN roll ON roll.item_id = t.item_id CROSS JOIN fr
""")(quote_validation)
