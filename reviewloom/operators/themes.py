"""Prompt table (A5, T2), response ingestion with fallback (F9, T3), offline
theme synthesis (T4) and theme collection (A6).

The model call itself is outside the engine: ``prompts`` is written out, a
user's client (for example a ``mapInPandas`` over the prompt table) produces
``responses(key..., response)``, and ``ingest_responses`` turns them into
themes.  Arrays built here are bounded: a prompt holds at most the k sampled
reviews, a theme at most its few quotes; cluster members are never collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.display import token_estimate
from ..functions.text import split_words

# ---------------------------------------------------------------------------
# The prompt template, review line format, response schema and
# fallback theme.  ``{product}`` is the product's display name.
PROMPT_TEMPLATE = (
    "You are a product feedback analyzer. You are given a cluster of reviews for the {product} financial app.\n"
    "Analyze the reviews below and identify the core theme.\n"
    "\n"
    "{reviews}\n"
    "\n"
    "Provide a JSON response containing the synthesized theme details. Follow these constraints:\n"
    "1. \"themeName\": a short, descriptive name (3-6 words, e.g. \"Peak Market Hour Login Crashes\").\n"
    "2. \"themeDescription\": a 1-2 sentence description explaining the core problem users are complaining about.\n"
    "3. \"representativeQuotes\": extract EXACTLY 2-3 quotes from the reviews provided. They MUST be verbatim "
    "substrings of the original review texts. Do not alter spelling, punctuation, or capitalization.\n"
    "4. \"actionIdeas\": 2-3 actionable recommendations for the product, engineering, or support teams.\n"
    "\n"
    "Your response must be valid JSON matching this schema:\n"
    "{{\n"
    "  \"themeName\": string,\n"
    "  \"themeDescription\": string,\n"
    "  \"representativeQuotes\": [string, string],\n"
    "  \"actionIdeas\": [string, string]\n"
    "}}")
REVIEW_LINE = '[Review %d] Date: %s, Rating: %d★\nText: "%s"'
RESPONSE_SCHEMA = ("themeName STRING, themeDescription STRING, representativeQuotes ARRAY<STRING>, "
                   "actionIdeas ARRAY<STRING>")
FALLBACK_NAME = "Uncategorized Issues"
FALLBACK_DESCRIPTION = "General reviews that could not be summarized due to an API error."
FALLBACK_ACTION = "Investigate system logs for errors in reasoning modules."
# ---------------------------------------------------------------------------

THEME_FIELDS = ["theme_name", "theme_description", "representative_quotes", "action_ideas"]


def prompt_table(sample: DataFrame, key_cols: list[str], product_col: str = "product",
                 ts_col: str = "review_ts", score_col: str = "score", text_col: str = "content") -> DataFrame:
    """One row per cluster: reviews_text, prompt and token estimate.

    ``sample`` carries ``rank`` (1..k) from the centroid-nearest sample."""
    line = F.format_string(REVIEW_LINE, F.col("rank"), F.date_format(ts_col, "yyyy-MM-dd"),
                           F.col(score_col), F.col(text_col))
    extra = [] if product_col in key_cols else [F.any_value(product_col).alias(product_col)]
    agg = sample.groupBy(*key_cols).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("l")))),
                                 lambda s: s["l"]), "\n\n").alias("reviews_text"),
        F.count(F.lit(1)).alias("n_sampled"), *extra)
    head, tail = PROMPT_TEMPLATE.split("{reviews}")
    prompt = F.concat(F.replace(F.lit(head), F.lit("{product}"), F.col(product_col)),
                      F.col("reviews_text"), F.lit(tail.replace("{{", "{").replace("}}", "}")))
    out = agg.withColumn("prompt", prompt) \
             .withColumn("estimated_tokens", token_estimate(F.col("prompt"), F.col("reviews_text")))
    return out.drop(*([] if product_col in key_cols else [product_col]))


def ingest_responses(prompts: DataFrame, responses: DataFrame | None, fallback: DataFrame,
                     key_cols: list[str]) -> DataFrame:
    """Theme per cluster from its model response; on a missing or malformed
    response (F9 shape check) the fixed fallback theme with the cluster's
    first two sampled texts (``fallback``: key..., fallback_quotes)."""
    base = prompts.select(*key_cols)
    if responses is not None:
        r = responses.select(*key_cols, F.from_json(F.col("response"), RESPONSE_SCHEMA).alias("__r"))
        base = base.join(r, key_cols, "left")
    else:
        base = base.withColumn("__r", F.from_json(F.lit(None).cast("string"), RESPONSE_SCHEMA))
    base = base.join(fallback, key_cols, "left")
    ok = (F.coalesce(F.col("__r.themeName"), F.lit("")) != "") \
        & (F.coalesce(F.col("__r.themeDescription"), F.lit("")) != "") \
        & F.col("__r.representativeQuotes").isNotNull()
    return base.select(
        *key_cols,
        F.when(ok, F.col("__r.themeName")).otherwise(F.lit(FALLBACK_NAME)).alias("theme_name"),
        F.when(ok, F.col("__r.themeDescription")).otherwise(F.lit(FALLBACK_DESCRIPTION)).alias("theme_description"),
        F.when(ok, F.col("__r.representativeQuotes"))
         .otherwise(F.coalesce(F.col("fallback_quotes"), F.array().cast("array<string>"))).alias("representative_quotes"),
        F.when(ok, F.coalesce(F.col("__r.actionIdeas"), F.array().cast("array<string>")))
         .otherwise(F.array(F.lit(FALLBACK_ACTION))).alias("action_ideas"),
        (~ok).alias("used_fallback"))


def offline_themes(members: DataFrame, key_cols: list[str], group_cols: list[str], sample: DataFrame,
                   text_col: str = "content", top_terms: int = 3, n_quotes: int = 2) -> DataFrame:
    """T4: a theme without a model.  Name = the cluster's top class-TF-IDF
    terms (tf = term share in the cluster, idf = log(1 + mean words per
    cluster / term count across the group's clusters)); quotes = first
    sentence of the first ``n_quotes`` sampled reviews; no action ideas."""
    words = members.select(*key_cols, F.explode(split_words(F.lower(F.col(text_col)))).alias("w")) \
                   .withColumn("w", F.regexp_replace("w", "[^\\p{L}\\p{N}]", "")).filter(F.length("w") > 0)
    tf = words.groupBy(*key_cols, "w").agg(F.count(F.lit(1)).alias("n"))
    tot = tf.groupBy(*key_cols).agg(F.sum("n").alias("total"))
    df_w = tf.groupBy(*group_cols, "w").agg(F.sum("n").alias("freq"))
    avg_words = tot.groupBy(*group_cols).agg(F.avg("total").alias("avg_total"))
    sc = tf.join(tot, key_cols).join(df_w, [*group_cols, "w"]).join(avg_words, group_cols) \
           .withColumn("score", (F.col("n") / F.col("total")) * F.log(F.lit(1.0) + F.col("avg_total") / F.col("freq")))
    w = Window.partitionBy(*key_cols).orderBy(F.desc("score"), F.col("w"))
    top = sc.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= top_terms)
    names = top.groupBy(*key_cols).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "w"))), lambda s: s["w"]), " ")
         .alias("terms"))
    first_sentence = F.regexp_extract(F.col(text_col), "^[^.!?\\n]*[.!?]?", 0)
    q = sample.filter(F.col("rank") <= n_quotes).groupBy(*key_cols).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", first_sentence.alias("s")))),
                    lambda s: s["s"]).alias("representative_quotes"))
    names = members.select(*key_cols).distinct().join(names, key_cols, "left").withColumn("terms", F.coalesce("terms", F.lit("")))
    return names.join(q, key_cols, "left").select(
        *key_cols,
        F.initcap(F.col("terms")).alias("theme_name"),
        F.format_string("Reviews mentioning %s.", F.replace(F.col("terms"), F.lit(" "), F.lit(", "))).alias("theme_description"),
        F.coalesce(F.col("representative_quotes"), F.array().cast("array<string>")).alias("representative_quotes"),
        F.array().cast("array<string>").alias("action_ideas"))


def collect_themes(themes: DataFrame, group_cols: list[str], order_col: str = "cluster_id") -> DataFrame:
    """Per group, themes as an array ordered by cluster id (bounded by the
    number of clusters in one product-week)."""
    st = F.struct(F.col(order_col).alias("__o"), *[F.col(c) for c in THEME_FIELDS])
    return themes.groupBy(*group_cols).agg(
        F.transform(F.array_sort(F.collect_list(st)),
                    lambda s: F.struct(*[s[c].alias(c) for c in THEME_FIELDS])).alias("themes"))
