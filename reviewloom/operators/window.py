"""Look-back windows (F1), early-stopping scan cap (S2) and the all-weeks
backfill (W9).

A request is one (product, week, lookback_weeks) row; many weeks and products
run in one job.  A review at time ``t`` can only fall in the windows of its
own ISO week and of the ``L`` weeks after it, so instead of a range join each
request is expanded into the ``L+1`` weeks that its window touches, with its bounds, and
equi-joined to the reviews' own weeks; the bounds then drop what is outside.  The
expansion is bounded by the requests, never by the data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.weeks import in_lookback, is_valid_week_key, iso_week_key, lookback_lower, week_end_ts, week_start_date
from .joins import bounded_broadcast


def lookback_filter(reviews: DataFrame, week: str, lookback_weeks: int, ts_col: str = "review_ts",
                    upper_bound: bool = True) -> DataFrame:
    """Single-request window: constant bounds, so the predicate is folded and
    pushed into the parquet scan when ``ts_col`` is a stored column."""
    return reviews.filter(in_lookback(F.col(ts_col), F.lit(week), F.lit(lookback_weeks), upper_bound))


def expand_to_requests(reviews: DataFrame, requests: DataFrame, ts_col: str = "review_ts",
                       product_col: str = "product", upper_bound: bool = True,
                       max_request_rows: int = 200_000) -> DataFrame:
    """Attach every review to every request whose look-back window covers it.

    ``requests`` columns: product, week, lookback_weeks (+ anything else).
    Output: review columns + request columns.  With ``upper_bound=False`` the
    window is open-ended above (the original code's backfill behaviour); the
    candidate expansion then has to cover every later requested week, so that
    mode joins on product only and filters by the lower bound."""
    req = requests.withColumnRenamed(product_col, "__req_product")
    if not upper_bound:
        small = bounded_broadcast(req, max_request_rows)
        joined = reviews.join(small, reviews[product_col] == F.col("__req_product"))
        return joined.filter(in_lookback(F.col(ts_col), F.col("week"), F.col("lookback_weeks"), False)) \
                     .drop("__req_product")
    weeks_back = F.sequence(F.lit(0), F.greatest(F.lit(0), F.col("lookback_weeks").cast("int")))
    req = req.filter(is_valid_week_key(F.col("week"))).filter(F.col("lookback_weeks").isNotNull()) \
             .withColumns({"__lo": lookback_lower(F.col("week"), F.col("lookback_weeks")), "__hi": week_end_ts(F.col("week"))}) \
             .withColumn("__back", F.explode(weeks_back)) \
             .withColumn("__week_start", F.date_sub(week_start_date(F.col("week")), F.col("__back") * 7)).drop("__back")
    own_week_start = F.date_trunc("week", F.col(ts_col)).cast("date")
    small = bounded_broadcast(req, max_request_rows)
    joined = reviews.withColumn("__own_start", own_week_start) \
        .join(small, (reviews[product_col] == F.col("__req_product")) & (F.col("__own_start") == F.col("__week_start")))
    return joined.filter((F.col(ts_col) >= F.col("__lo")) & (F.col(ts_col) <= F.col("__hi"))) \
                 .drop("__req_product", "__own_start", "__week_start", "__lo", "__hi")


def scan_cap(reviews: DataFrame, group_cols: list[str], max_rows: int, order_col: str = "ord") -> DataFrame:
    """Per-request row cap, newest first (the feature is the cap itself).
    ``row_number() <= k`` lets Spark insert a partial WindowGroupLimit before
    the shuffle, so a hot request never sorts all of its rows in one task."""
    w = Window.partitionBy(*group_cols).orderBy(F.col(order_col))
    return reviews.withColumn("__rn", F.row_number().over(w)).filter(F.col("__rn") <= max_rows).drop("__rn")


def week_keys_of(df: DataFrame, ts_col: str, product_col: str = "product") -> DataFrame:
    """Distinct (product, week) pairs present in the data."""
    return df.select(F.col(product_col).alias("product"), iso_week_key(ts_col).alias("week")).distinct()


__all__ = ["lookback_filter", "expand_to_requests", "scan_cap", "week_keys_of", "week_start_date"]
