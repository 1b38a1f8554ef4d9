"""Quote verification (J2, J2s, J3, W2-W4, A8, T5).

Substring search at scale without comparing every quote with every text:
each quote is reduced to exact *anchor grams* and each text to an index of
grams, the two are equi-joined, and only the surviving candidate pairs are
verified with ``contains``.

* A quote of length L >= G + S - 1 contributes S anchors ``q[i:i+G]``
  (i = 0..S-1); texts index only the grams starting at positions that are
  multiples of S.  Any occurrence at position P has an aligned anchor
  i = (-P) mod S with P + i + G <= P + L, so no match is lost while the text
  index is S times smaller than a full gram index.  Long quotes use long grams
  and a large stride, shorter ones short grams and that stride, a small stride, the full (stride 1) index or, below G
  characters, an index of grams of their own length; each index is built
  only when quotes of its tier exist (a bounded metadata check).

The text side is exploded with only its id (never the text itself), joined to
the quote anchors (broadcast when the measured anchor count is small), and the
candidate pairs are then joined back to the texts for the ``contains`` check.
Everything runs inside Spark tasks as Column expressions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import js_trim, normalize_for_match
from ..session import materialize
from .joins import bounded_broadcast

GRAM = 8
STRIDES = (32, 4)
#: Gram length of quotes long enough: shorter grams of common words would make
#: nearly every text a candidate of every quote.
LONG_GRAM = 32
#: Number of a text that stands under several keys.
ROW = "__row"


def _grams(text: Column, g: int, stride: int) -> Column:
    """Distinct grams of length ``g`` starting at every ``stride``-th character.

    A lookahead captures the gram and the match then consumes ``stride``
    characters, so one linear regex pass yields the overlapping grams
    (per-position ``substring`` on UTF-8 would rescan from the start)."""
    pattern = f"(?s)(?=(.{{{g}}})).{{{stride}}}"
    return F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), 1))


def substring_matches(texts: DataFrame, quotes: DataFrame, key_cols: list[str], text_id: str, text_col: str,
                      quote_id: str, quote_col: str, gram: int = GRAM, strides: tuple[int, ...] = STRIDES,
                      of_text: Callable[[Column], Column] | None = None, places: DataFrame | None = None) -> DataFrame:
    """All (key..., quote_id, text_id) with ``text contains quote`` (quote non-empty).

    With ``places`` (key..., text_id, ROW), each text stands once in ``texts`` (ROW, text_col), however many keys
    it is searched under: grams of texts are taken once, and only those of quotes meet the places.

    With ``of_text``, ``of_text(text)`` is searched; it is computed for the index, and then
    for the texts of candidate pairs alone.

    Quotes are split into tiers by length: a quote of length L >= LONG_GRAM + S - 1
    has anchors of LONG_GRAM characters, one of length L >= gram + S - 1
    goes to the largest stride S it supports (its S aligned anchors), then the
    dense gram index, then an index of grams of the quote's own length.  Only
    tiers that hold quotes get an index (decided from one small aggregate of
    the quote lengths)."""
    k = list(key_cols)
    of_text = of_text or (lambda text: text)
    q = quotes.select(*k, quote_id, F.col(quote_col).alias("__q")).filter(F.length("__q") > 0)
    q = materialize(q.withColumn("__L", F.length("__q")))  # small; read by several size checks
    steps = sorted(set(strides) | {1}, reverse=True)
    tiers = [(max(gram, LONG_GRAM), steps[0])] + [(gram, s) for s in steps]
    tier_of = F.lit(None).cast("int")
    for i, (g, s) in reversed(list(enumerate(tiers))):  # a tier needs quotes of g + s - 1 characters
        tier_of = F.when(F.col("__L") >= g + s - 1, F.lit(i)).otherwise(tier_of)
    q = q.withColumn("__tier", F.coalesce(tier_of, -F.col("__L")))  # negative: short quote of that length
    present = sorted(r[0] for r in q.select("__tier").distinct().collect())  # <= len(tiers) + gram - 1 values

    anchors = []
    for t in present:
        sel = q.filter(F.col("__tier") == t)
        if t >= 0:
            g, s = tiers[t]
            a = sel.select(*k, quote_id, F.explode(F.transform(F.sequence(F.lit(0), F.lit(s - 1)),
                                                               lambda i: F.substring(F.col("__q"), i + 1, g)))
                           .alias("__gram"))
            anchors.append((a, g, s))
        else:
            anchors.append((sel.select(*k, quote_id, F.col("__q").alias("__gram")), -t, 1))

    own = [*k, text_id] if places is None else [ROW]
    tx = texts.select(*own, F.col(text_col).alias("__t"))
    found = [*k, quote_id, text_id, *([] if places is None else own)]
    cands = None
    for aq, g, s in anchors:
        # outer, or Spark first filters by the grams, which computes them again; the join drops the nulls
        idx = tx.select(*own, F.explode_outer(_grams(of_text(F.col("__t")), g, s)).alias("__gram"))
        aq = aq.distinct()
        if places is not None:
            aq = materialize(aq)
            idx = idx.join(bounded_broadcast(aq.select("__gram").distinct()), "__gram", "left_semi").join(places.select(*k, text_id, ROW), ROW)
        c = idx.join(bounded_broadcast(aq), [*k, "__gram"]).select(*found)
        cands = c if cands is None else cands.unionByName(c)
    if cands is None:
        return (tx if places is None else places).select(*k, F.lit(None).cast(q.schema[quote_id].dataType).alias(quote_id), text_id).limit(0)
    cands = materialize(cands.distinct())
    # verify: candidates are few; quotes are brought to the texts by key, so that texts are shuffled only beyond the bound
    v = cands.join(bounded_broadcast(q.select(*k, quote_id, "__q")), [*k, quote_id])
    v = tx.join(bounded_broadcast(v), own)
    return v.filter(of_text(F.col("__t")).contains(F.col("__q"))).select(*k, quote_id, text_id)


def validate_quotes(quotes: DataFrame, reviews: DataFrame, theme_cols: list[str], match_cols: list[str],
                    review_id: str = "review_id", order_col: str = "ord", text_col: str = "content",
                    quote_ord: str = "quote_ord", quote_col: str = "quote",
                    texts: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Validate LLM quotes against the theme's source reviews.

    With ``texts`` (ROW, content), ``reviews`` have a ROW in place of the content, and a review of many themes
    is read once.

    ``quotes``: theme_cols + quote_ord + quote.  ``reviews``: match_cols +
    review_id + order_col + content, where ``match_cols`` is the subset of the
    theme key the reviews carry (e.g. product, week, cluster_id).
    Returns (checks, rollup):
      checks  - one row per non-blank quote: outcome exact | recovered |
                discarded, the kept text and the warning;
      rollup  - one row per theme: valid_quotes and warnings arrays in quote
                order, with the first-review substitution (W4) when nothing
                survives.  Themes whose quotes are all blank still get a row.
    """
    th = list(theme_cols)
    mk = list(match_cols)
    if not mk:  # one shared review set: match on a constant key
        quotes = quotes.withColumn("__all", F.lit(0))
        reviews = reviews.withColumn("__all", F.lit(0))
        th, mk = th + ["__all"], ["__all"]
    q = quotes.withColumn("__trim", js_trim(F.coalesce(F.col(quote_col), F.lit("")))) \
              .withColumn("__qid", F.struct(*[F.col(c) for c in th], F.col(quote_ord)))
    q = materialize(q)  # small; reused by both match passes and the roll-up
    nonblank = q.filter(F.length("__trim") > 0)
    text = text_col if texts is None else ROW
    rv = reviews.select(*mk, review_id, order_col, text)
    searched, places = (rv, None) if texts is None else (texts, rv)

    exact = substring_matches(searched, nonblank.select(*mk, "__qid", "__trim"), mk, review_id, text_col, "__qid", "__trim", places=places)
    exact_first = materialize(exact.join(rv, [*mk, review_id]).groupBy(*mk, "__qid").agg(
        F.min_by(F.col(review_id), F.col(order_col)).alias("__exact_review")))  # one row per matched quote

    def read(rows: DataFrame, col: str) -> DataFrame:
        """``rows`` with the text that ``col`` numbers, if it is a number."""
        if texts is None:
            return rows
        found = texts.select(F.col(ROW).alias(col), F.col(text_col).alias("__read")).join(bounded_broadcast(rows), col)
        return found.withColumn(col, F.col("__read")).select(rows.columns)

    pending = nonblank.join(exact_first.select(*mk, "__qid"), [*mk, "__qid"], "left_anti") \
                      .withColumn("__nq", normalize_for_match("__trim")).filter(F.length("__nq") > 5)
    pending = materialize(pending.select(*mk, "__qid", "__nq"))
    if pending.limit(1).count() > 0:
        # normalise each candidate text once; the index and the check both read it
        rvn = materialize(searched.select(*([*mk, review_id] if texts is None else [ROW]), normalize_for_match(text_col).alias("__norm")))
        norm = substring_matches(rvn, pending, mk, review_id, "__norm", "__qid", "__nq", gram=6, places=places)
        norm_last = norm.join(rv, [*mk, review_id]).groupBy(*mk, "__qid").agg(
            F.max_by(F.struct(F.col(text).alias("t"), F.col(review_id).alias("i")), F.col(order_col)).alias("__m"))
        norm_last = read(materialize(norm_last.select(*mk, "__qid", F.col("__m.t").alias("__recovered"),
                                                      F.col("__m.i").alias("__recovered_review"))), "__recovered")
    else:
        norm_last = pending.select(*mk, "__qid", F.lit(None).cast("string").alias("__recovered"),
                                   F.lit(None).cast(rv.schema[review_id].dataType).alias("__recovered_review"))

    checks = nonblank.join(exact_first, [*mk, "__qid"], "left").join(norm_last, [*mk, "__qid"], "left")
    outcome = F.when(F.col("__exact_review").isNotNull(), F.lit("exact")) \
               .when(F.col("__recovered").isNotNull(), F.lit("recovered")).otherwise(F.lit("discarded"))
    kept = F.when(outcome == "exact", F.col("__trim")).when(outcome == "recovered", F.col("__recovered"))
    warning = F.when(outcome == "recovered",
                     F.format_string('Quote modified to match verbatim content: "%s" -> "%s"',
                                     F.col("__trim"), F.col("__recovered"))) \
               .when(outcome == "discarded",
                     F.format_string('Quote discarded (not found in source texts): "%s"', F.col("__trim")))
    checks = checks.select(*th, quote_ord, F.col("__trim").alias("quote"), outcome.alias("outcome"),
                           kept.alias("kept_quote"), warning.alias("warning"),
                           F.coalesce(F.col("__exact_review"), F.col("__recovered_review")).alias("matched_review_id"))

    themes = q.select(*th).distinct()
    per_theme = checks.groupBy(*th).agg(
        F.transform(F.array_sort(F.collect_list(F.when(F.col("kept_quote").isNotNull(),
                                                       F.struct(quote_ord, "kept_quote")))),
                    lambda s: s["kept_quote"]).alias("__valid"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("warning").isNotNull(),
                                                       F.struct(quote_ord, "warning")))),
                    lambda s: s["warning"]).alias("__warn"))
    first_review = rv.groupBy(*mk).agg(F.min_by(F.col(text), F.col(order_col)).alias("__first"))
    if texts is not None:
        first_review = read(materialize(first_review), "__first")
    roll = themes.join(per_theme, th, "left").join(first_review, mk, "left")
    valid = F.coalesce(F.col("__valid"), F.array().cast("array<string>"))
    warn = F.coalesce(F.col("__warn"), F.array().cast("array<string>"))
    substitute = (F.size(valid) == 0) & F.col("__first").isNotNull()
    roll = roll.select(
        *th,
        F.when(substitute, F.array(F.col("__first"))).otherwise(valid).alias("valid_quotes"),
        F.when(substitute, F.concat(warn, F.array(F.format_string(
            'No quotes validated. Substituted with top representative review: "%s"', F.col("__first")))))
         .otherwise(warn).alias("warnings"),
        substitute.alias("substituted"))
    drop = [c for c in ("__all",) if c in th]
    return materialize(checks.drop(*drop)), materialize(roll.drop(*drop))
