"""Queries for scans, filters, scrubbing and week arithmetic (S1, S2, S5, F1-F8,
H1-H10, H17-H19, A3, A4, W9)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import display, scrub, text, weeks
from ..operators.window import expand_to_requests, week_keys_of
from ..sources import raw as raw_src
from ..sources import stakeholders
from ..session import materialize
from ..sources.tables import SQL_REVIEWS_V, reviews_view, table
from .catalog import register

_S = scrub.sql_scrub_steps("content")
_WC = text.sql_word_count("content")
_WEEK = weeks.sql_iso_week_key("review_ts")

# ---------------------------------------------------------------- M0 flagship


def weekly_scrub_summary(spark, sf_dir):
    """Per product and ISO week: reviews, short ones dropped, remaining, and
    redaction counts among the remaining (A3, A4 over F2 and H8)."""
    r = reviews_view(spark, sf_dir).select("product", "content", "review_ts")
    r = r.withColumn("week", weeks.iso_week_key("review_ts")) \
         .withColumn("keep", text.has_min_words("content", 8))
    r = scrub.scrub_columns(r)
    keep = F.col("keep")
    return r.groupBy("product", "week").agg(
        F.count(F.lit(1)).alias("n_reviews"),
        F.count_if(~keep).alias("n_short"),
        F.count_if(keep).alias("n_remaining"),
        F.count_if(keep & F.col("pii_removed")).alias("n_pii_redacted"),
        F.count_if(keep & F.col("injection_neutralized")).alias("n_injection"),
    )


register("weekly_scrub_summary", f"""
WITH {SQL_REVIEWS_V.strip()},
s AS (SELECT product, {_WEEK} AS week, {_WC} AS n_words,
             {_S['pii_removed']} AS pii, {_S['injection_neutralized']} AS inj FROM reviews_v)
SELECT product, week, count(*)::BIGINT AS n_reviews,
       count_if(n_words < 8)::BIGINT AS n_short, count_if(n_words >= 8)::BIGINT AS n_remaining,
       count_if(n_words >= 8 AND pii)::BIGINT AS n_pii_redacted,
       count_if(n_words >= 8 AND inj)::BIGINT AS n_injection
FROM s GROUP BY product, week
""")(weekly_scrub_summary)


# ---------------------------------------------------------------- scrub rules


# The documents hold no account references or instructions, so these two rules
# get each whole text with a closing phrase of its row, some of which only
# come near the rule.  Spark and DuckDB read the expressions alike.
_CLOSING = {
    "id": """text || CASE doc_id % 6
        WHEN 0 THEN ' ref-' || CAST(1000000 + doc_id AS STRING)
        WHEN 1 THEN ' Customer ID: A' || CAST(1000000 + doc_id AS STRING) || '.'
        WHEN 2 THEN ' user_' || CAST(doc_id % 1000 AS STRING)
        WHEN 3 THEN ' reference of ' || CAST(doc_id AS STRING)
        WHEN 4 THEN ' acc ' || CAST(1000000000000000 + doc_id AS STRING)
        ELSE ' xref-' || CAST(1000000 + doc_id AS STRING) END""",
    "injection": """text || CASE doc_id % 9
        WHEN 0 THEN ' Ignore any  previous instructions ' WHEN 1 THEN ' ignore instructions '
        WHEN 2 THEN ' YOU must now forget ' WHEN 3 THEN ' act as a ' WHEN 4 THEN ' System prompt '
        WHEN 5 THEN ' override   rules ' WHEN 6 THEN ' instead of summarizing '
        WHEN 7 THEN ' ignore the instructions ' ELSE ' actasa ' END || CAST(doc_id AS STRING)""",
}


def _scrub_query(step: str):
    def q(spark, sf_dir):
        d = table(spark, sf_dir, "documents", "doc_id", "text")
        if step in _CLOSING:
            d = d.select("doc_id", F.expr(_CLOSING[step]).alias("text"))
        col = {"email": scrub.scrub_email, "phone": scrub.scrub_phone,
               "id": scrub.scrub_id, "injection": scrub.scrub_injection}[step]
        pat = {"email": scrub.EMAIL_RE, "phone": scrub.PHONE_RE, "id": scrub.ID_RE}.get(step)
        hit = F.col("text").rlike(pat) if pat else F.lit(False)
        if step == "injection":
            for p in scrub.INJECTION_RES:
                hit = hit | F.col("text").rlike(p)
        return d.select(F.col("doc_id").alias("review_id"), col("text").alias("scrubbed"), hit.alias("hit"))
    return q


def _scrub_input(step: str) -> str:
    return f"(SELECT doc_id, {_CLOSING[step]} AS text FROM documents)" if step in _CLOSING else "documents"


def _scrub_sql(step: str) -> str:
    from ..functions.scrub import (EMAIL_TOKEN, ID_TOKEN, INJECTION_TOKEN, PHONE_TOKEN, SQL_EMAIL_RE,
                                   SQL_ID_RE, SQL_INJECTION_RES, SQL_PHONE_RE)
    if step == "injection":
        cur = "text"
        for p in SQL_INJECTION_RES:
            cur = f"regexp_replace({cur}, '{p}', '{INJECTION_TOKEN}', 'g')"
        hit = " OR ".join(f"regexp_matches(text, '{p}')" for p in SQL_INJECTION_RES)
        return f"SELECT doc_id AS review_id, {cur} AS scrubbed, ({hit}) AS hit FROM {_scrub_input(step)}"
    pat, tok = {"email": (SQL_EMAIL_RE, EMAIL_TOKEN), "phone": (SQL_PHONE_RE, PHONE_TOKEN),
                "id": (SQL_ID_RE, ID_TOKEN)}[step]
    return (f"SELECT doc_id AS review_id, regexp_replace(text, '{pat}', '{tok}', 'g') AS scrubbed, "
            f"regexp_matches(text, '{pat}') AS hit FROM {_scrub_input(step)}")


for _step in ("email", "phone", "id", "injection"):
    register(f"scrub_{_step}", _scrub_sql(_step))(_scrub_query(_step))


def scrub_all(spark, sf_dir):
    """H8 over every review: sequential scrub plus both flags."""
    r = reviews_view(spark, sf_dir).select("review_id", "content")
    return scrub.scrub_columns(r).select("review_id", "content_scrubbed", "pii_removed", "injection_neutralized")


register("scrub_all", f"""
WITH {SQL_REVIEWS_V.strip()}
SELECT review_id, {_S['scrubbed']} AS content_scrubbed, {_S['pii_removed']} AS pii_removed,
       {_S['injection_neutralized']} AS injection_neutralized FROM reviews_v
""")(scrub_all)

_SP = scrub.sql_scrub_steps("html")


def scrub_pages(spark, sf_dir):
    """The same scrub on a second text source (raw web pages)."""
    p = table(spark, sf_dir, "pages", "page_id", "html")
    return scrub.scrub_columns(p, text_col="html").select("page_id", "content_scrubbed", "pii_removed",
                                                          "injection_neutralized")


register("scrub_pages", f"""
SELECT page_id, {_SP['scrubbed']} AS content_scrubbed, {_SP['pii_removed']} AS pii_removed,
       {_SP['injection_neutralized']} AS injection_neutralized FROM pages
""")(scrub_pages)

# ---------------------------------------------------------------- text rules


def word_filter(spark, sf_dir):
    """F2 + H9: word count with JS whitespace, trimmed length, keep flag."""
    r = reviews_view(spark, sf_dir).select("review_id", "content")
    return r.select("review_id", text.word_count("content").cast("long").alias("n_words"),
                    F.length(text.js_trim("content")).cast("long").alias("trimmed_len"),
                    text.has_min_words("content", 8).alias("keep"))


register("word_filter", f"""
WITH {SQL_REVIEWS_V.strip()}
SELECT review_id, {_WC}::BIGINT AS n_words, length({text.sql_js_trim('content')})::BIGINT AS trimmed_len,
       ({_WC} >= 8) AS keep FROM reviews_v
""")(word_filter)


def normalize_text(spark, sf_dir):
    """H10 on every review and every quote candidate."""
    r = reviews_view(spark, sf_dir).select("review_id", "content")
    return r.select("review_id", text.normalize_for_match("content").alias("normalized"))


register("normalize_text", f"""
WITH {SQL_REVIEWS_V.strip()}
SELECT review_id, {text.sql_normalize('content')} AS normalized FROM reviews_v
""")(normalize_text)

# ---------------------------------------------------------------- weeks


def iso_week_events(spark, sf_dir):
    """H1 on events.ts: ISO week keys with counts and extent."""
    e = table(spark, sf_dir, "events", "ts")
    return e.groupBy(weeks.iso_week_key("ts").alias("week")).agg(
        F.count(F.lit(1)).alias("n_events"),
        F.date_format(F.min("ts"), "yyyy-MM-dd HH:mm:ss").alias("first_ts"),
        F.date_format(F.max("ts"), "yyyy-MM-dd HH:mm:ss").alias("last_ts"))


register("iso_week_events", f"""
SELECT {weeks.sql_iso_week_key('ts')} AS week, count(*)::BIGINT AS n_events,
       strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_ts, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_ts
FROM events GROUP BY 1
""")(iso_week_events)


def week_bounds(spark, sf_dir):
    """H2 + F8 on every ISO week of orders.o_orderdate (1995-2001, includes the
    53-week years), plus malformed variants of the same keys."""
    o = table(spark, sf_dir, "orders", "o_orderdate")
    k = o.select(weeks.iso_week_key("o_orderdate").alias("week")).distinct()
    variants = k.select(F.col("week")).unionByName(
        k.select(F.replace(F.col("week"), F.lit("-W"), F.lit("W")).alias("week"))).unionByName(
        k.select(F.concat(F.substring("week", 1, 6), F.lit("54")).alias("week"))).distinct()
    valid = weeks.is_valid_week_key("week")
    return variants.select(
        "week", valid.alias("valid"),
        F.when(valid, F.date_format(weeks.week_start_ts("week"), "yyyy-MM-dd HH:mm:ss.SSS")).alias("week_start"),
        F.when(valid, F.date_format(weeks.week_end_ts("week"), "yyyy-MM-dd HH:mm:ss.SSS")).alias("week_end"),
        F.when(valid, weeks.iso_week_key(weeks.week_start_date("week"))).alias("round_trip"))


_WS = weeks.sql_week_start("week")
register("week_bounds", f"""
WITH k AS (SELECT DISTINCT {weeks.sql_iso_week_key('o_orderdate')} AS week FROM orders),
v AS (SELECT week FROM k UNION SELECT replace(week, '-W', 'W') FROM k
      UNION SELECT substr(week, 1, 6) || '54' FROM k),
c AS (SELECT week, regexp_matches(week, '^\\d{{4}}-W\\d{{2}}$')
        AND TRY_CAST(split_part(week, '-W', 2) AS INTEGER) BETWEEN 1
            AND week(make_date(TRY_CAST(split_part(week, '-W', 1) AS INTEGER), 12, 28)) AS valid FROM v)
SELECT week, coalesce(valid, false) AS valid,
       CASE WHEN valid THEN strftime(CAST({_WS} AS TIMESTAMP), '%Y-%m-%d %H:%M:%S.%g') END AS week_start,
       CASE WHEN valid THEN strftime({weeks.sql_week_end('week')}, '%Y-%m-%d %H:%M:%S.%g') END AS week_end,
       CASE WHEN valid THEN {weeks.sql_iso_week_key(_WS)} END AS round_trip
FROM c
""")(week_bounds)


def run_keys(spark, sf_dir):
    """H3: build and parse ``product:week`` keys for every review week."""
    k = week_keys_of(reviews_view(spark, sf_dir), "review_ts")
    rk = weeks.run_key("product", "week")
    return k.select(rk.alias("run_key"), weeks.run_key_product(rk).alias("key_product"),
                    weeks.run_key_week(rk).alias("key_week"))


register("run_keys", f"""
WITH {SQL_REVIEWS_V.strip()},
k AS (SELECT DISTINCT product, {_WEEK} AS week FROM reviews_v)
SELECT product || ':' || week AS run_key, product AS key_product, week AS key_week FROM k
""")(run_keys)

# ---------------------------------------------------------------- windows

_LOOKBACKS = (1, 4, 10)


def _requests(spark, sf_dir):
    r = reviews_view(spark, sf_dir)
    k = week_keys_of(r, "review_ts")
    req = k.withColumn("lookback_weeks", F.explode(F.array(*[F.lit(x) for x in _LOOKBACKS])))
    return r, materialize(req)  # request-sized; read by several size checks and the join


_SQL_REQUESTS = f"""
k AS (SELECT DISTINCT product, {_WEEK} AS week FROM reviews_v),
requests_v AS (SELECT product, week, lookback_weeks FROM k, (VALUES (1), (4), (10)) t(lookback_weeks))"""


def backfill_weeks(spark, sf_dir):
    """Every requested (product, week, look-back) with the reviews its
    closed rolling window holds, in one job."""
    r, req = _requests(spark, sf_dir)
    r = r.select("product", "review_id", "review_ts", text.has_min_words("content", 8).alias("long"))
    x = expand_to_requests(r, req)
    return x.groupBy("product", "week", "lookback_weeks").agg(
        F.count(F.lit(1)).alias("n_in_window"),
        F.count_if("long").alias("n_long"),
        F.min("review_id").alias("min_review_id"), F.max("review_id").alias("max_review_id"))


register("backfill_weeks", f"""
WITH {SQL_REVIEWS_V.strip()}, {_SQL_REQUESTS.strip()}
SELECT q.product, q.week, q.lookback_weeks, count(*)::BIGINT AS n_in_window,
       count_if({text.sql_word_count('r.content')} >= 8)::BIGINT AS n_long,
       min(r.review_id) AS min_review_id, max(r.review_id) AS max_review_id
FROM requests_v q JOIN reviews_v r ON r.product = q.product
 AND r.review_ts >= {weeks.sql_week_end('q.week')} - to_days(7 * q.lookback_weeks)
 AND r.review_ts <= {weeks.sql_week_end('q.week')}
GROUP BY 1, 2, 3
""")(backfill_weeks)


def lookback_open_window(spark, sf_dir):
    """F1 as the original code applies it: lower bound only (a backfill also
    takes everything newer than the week)."""
    r, req = _requests(spark, sf_dir)
    x = expand_to_requests(r.select("product", "review_id", "review_ts"), req, upper_bound=False)
    return x.groupBy("product", "week", "lookback_weeks").agg(F.count(F.lit(1)).alias("n_in_window"))


register("lookback_open_window", f"""
WITH {SQL_REVIEWS_V.strip()}, {_SQL_REQUESTS.strip()}
SELECT q.product, q.week, q.lookback_weeks, count(*)::BIGINT AS n_in_window
FROM requests_v q JOIN reviews_v r ON r.product = q.product
 AND r.review_ts >= {weeks.sql_week_end('q.week')} - to_days(7 * q.lookback_weeks)
GROUP BY 1, 2, 3
""")(lookback_open_window)


def scan_newest(spark, sf_dir):
    """Newest-first read of every (product, week) request, with each row's place."""
    r, req = _requests(spark, sf_dir)
    req = req.filter(F.col("lookback_weeks") == 4)
    x = expand_to_requests(r.select("product", "review_id", "review_ts", "ord"), req)
    place = F.row_number().over(Window.partitionBy("product", "week").orderBy("ord"))
    return x.select("product", "week", "review_id", place.cast("long").alias("place"))


register("scan_newest", f"""
WITH {SQL_REVIEWS_V.strip()}, {_SQL_REQUESTS.strip()},
x AS (SELECT q.product, q.week, r.review_id,
             row_number() OVER (PARTITION BY q.product, q.week ORDER BY r.review_ts DESC, r.review_id) AS rn
      FROM requests_v q JOIN reviews_v r ON r.product = q.product
       AND r.review_ts >= {weeks.sql_week_end('q.week')} - to_days(7 * q.lookback_weeks)
       AND r.review_ts <= {weeks.sql_week_end('q.week')}
      WHERE q.lookback_weeks = 4)
SELECT product, week, review_id, rn AS place FROM x
""")(scan_newest)

# ---------------------------------------------------------------- sources


def raw_reviews(spark, sf_dir):
    """Landed raw rows (documents projected to the store's raw shape, with
    missing fields) normalised with the store client's defaults."""
    raw = raw_src.raw_rows_from_documents(table(spark, sf_dir, "documents", "doc_id", "text", "source"))
    out = raw_src.normalize_raw_reviews(raw, product="app", ingest_ts="2024-06-01 00:00:00")
    return out.select("review_id", "user_name", "content", "score", "thumbs_up", "version",
                      F.date_format("review_ts", "yyyy-MM-dd HH:mm:ss").alias("review_ts"))


register("raw_reviews", raw_src.SQL_RAW_REVIEWS)(raw_reviews)


def stakeholder_list(spark, sf_dir):
    """S5 + F7: comma-separated recipient strings (assembled per language from
    the addresses found in documents) split, trimmed and sanitised."""
    src = stakeholders.recipient_strings_from_documents(table(spark, sf_dir, "documents", "doc_id", "text", "lang"))
    return stakeholders.split_recipients(src, "product", "recipients")


register("stakeholder_list", stakeholders.SQL_STAKEHOLDERS)(stakeholder_list)


# A stored delivery result for each event, in all the forms that the rules tell
# apart; Spark and DuckDB read the expression alike.
_DELIVERY = """CASE WHEN event_type = 'error' THEN ''
    WHEN event_id % 6 = 0 THEN '{"draft_id": "draft-' || event_type || '-' || CAST(event_id AS STRING) || '"}'
    WHEN event_id % 6 = 1 THEN '{"draftId": "' || CAST(event_id AS STRING) || '"}'
    WHEN event_id % 6 = 2 THEN '{"draft_id": "", "draftId": "d' || CAST(event_id AS STRING) || '", "status": "error"}'
    WHEN event_id % 6 = 3 THEN '{"status": "ok", "error": "code ' || CAST(event_id AS STRING) || '"}'
    WHEN event_id % 6 = 4 THEN 'mail-' || event_type || '-' || CAST(event_id AS STRING)
    ELSE props END"""


def delivery_ids(spark, sf_dir):
    """H17-H19 over stored delivery results: JSON with either id field, an empty
    id, an error status or object, plain ids, other JSON and empty strings."""
    e = table(spark, sf_dir, "events", "event_id", "props", "event_type").withColumn("g", F.expr(_DELIVERY))
    g = F.col("g")
    return e.select("event_id", display.draft_id(g).alias("draft_id"),
                    display.short_id(display.draft_id(g)).alias("short_id"),
                    display.delivery_error(g).alias("delivery_error"),
                    display.mail_status(g).alias("mail_status"),
                    display.doc_status(F.col("event_type")).alias("doc_status"))


register("delivery_ids", f"""
WITH e AS (SELECT event_id, {_DELIVERY} AS g, event_type FROM events),
d AS (SELECT event_id, g, event_type,
        coalesce(nullif(json_extract_string(CASE WHEN json_valid(g) THEN g END, '$.draft_id'), ''),
                 nullif(json_extract_string(CASE WHEN json_valid(g) THEN g END, '$.draftId'), ''), g) AS draft_id,
        coalesce(json_extract_string(CASE WHEN json_valid(g) THEN g END, '$.status') = 'error'
                 OR json_extract(CASE WHEN json_valid(g) THEN g END, '$.error') IS NOT NULL, false) AS delivery_error
      FROM e)
SELECT event_id, draft_id,
       CASE WHEN length(draft_id) > 15 THEN substr(draft_id, 1, 12) || '...' ELSE draft_id END AS short_id,
       delivery_error,
       CASE WHEN coalesce(g, '') <> '' THEN 'Draft Created (ID: ' ||
            CASE WHEN length(draft_id) > 15 THEN substr(draft_id, 1, 12) || '...' ELSE draft_id END || ')'
            ELSE 'Not Sent / Skipped' END AS mail_status,
       CASE WHEN coalesce(event_type, '') <> '' THEN 'Success / Updated' ELSE 'Not Created' END AS doc_status
FROM d
""")(delivery_ids)
