"""Report store, run log and delivery queries
and the end-to-end weekly job (G1, A7, G2).

The stored state is derived from ``reviews_v``: one run-log row per
(product, week) present (every fifth week FAILED), a stored report for every
week whose number is not a multiple of 3, with ``week % 4`` themes."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..functions import weeks
from ..operators.reports import (default_week, log_only_weeks, patch_mail_id, plan_outbox, plan_sections,
                                 redraft_eligible, report_listing, report_lookup, runs_to_do, upsert_run_log)
from ..sources import stakeholders
from ..sources.tables import SQL_REVIEWS_V, review_vectors, reviews_view, table
from .catalog import register
from .weekly import weekly_feedback, window_stage


def _keys(spark, sf_dir):
    r = reviews_view(spark, sf_dir)
    k = r.select("product", weeks.iso_week_key("review_ts").alias("week")).distinct()
    return k.withColumn("n", F.substring("week", 7, 2).cast("int"))


def _log(spark, sf_dir):
    k = _keys(spark, sf_dir)
    return k.select(
        "product", "week",
        F.date_format(weeks.week_end_ts("week"), "yyyy-MM-dd HH:mm:ss").alias("run_ts"),
        F.when(F.col("n") % 5 == 0, F.lit("FAILED")).otherwise(F.lit("SUCCESS")).alias("status"),
        F.concat(F.lit("https://docs.example.com/document/d/doc-"), F.col("product"), F.lit("/edit")).alias("doc_url"),
        F.when(F.col("n") % 2 == 0, F.concat(F.lit('{"status":"success","draft_id":"r'), F.col("n").cast("string"),
                                             F.col("product"), F.lit('"}')))
         .otherwise(F.concat(F.lit("plain-"), F.col("n").cast("string"))).alias("mail_id"))


def _reports(spark, sf_dir):
    lg = _log(spark, sf_dir).withColumn("n", F.substring("week", 7, 2).cast("int")).filter(F.col("n") % 3 != 0)
    th = F.when(F.col("n") % 4 == 0, F.array()).otherwise(
        F.transform(F.sequence(F.lit(1), F.col("n") % 4), lambda i: F.struct(
            F.concat(F.lit("Theme "), i.cast("string")).alias("theme_name"),
            F.concat(F.lit("About "), F.col("week")).alias("theme_description"),
            F.array(F.concat(F.lit("quote "), i.cast("string"))).alias("representative_quotes"),
            F.array().cast("array<string>").alias("action_ideas"))))
    return lg.select("product", "week", F.col("run_ts").alias("report_ts"), "doc_url", "mail_id",
                     F.lit("SUCCESS").alias("status"), th.alias("themes"))


_SQL_STATE = f"""
WITH {SQL_REVIEWS_V.strip()},
k AS (SELECT DISTINCT product, {weeks.sql_iso_week_key('review_ts')} AS week FROM reviews_v),
kn AS (SELECT product, week, CAST(substr(week, 7, 2) AS INTEGER) AS n FROM k),
log_v AS (SELECT product, week, n,
    strftime({weeks.sql_week_end('week')}, '%Y-%m-%d %H:%M:%S') AS run_ts,
    CASE WHEN n % 5 = 0 THEN 'FAILED' ELSE 'SUCCESS' END AS status,
    'https://docs.example.com/document/d/doc-' || product || '/edit' AS doc_url,
    CASE WHEN n % 2 = 0 THEN '{{"status":"success","draft_id":"r' || n || product || '"}}' ELSE 'plain-' || n END
      AS mail_id FROM kn),
reports_v AS (SELECT product, week, n, run_ts AS report_ts, doc_url, mail_id, 'SUCCESS' AS status,
    CASE WHEN n % 4 = 0 THEN [] ELSE list_transform(range(1, n % 4 + 1), lambda i: {{'theme_name': 'Theme ' || i,
      'theme_description': 'About ' || week, 'representative_quotes': ['quote ' || i],
      'action_ideas': CAST([] AS VARCHAR[])}}) END AS themes FROM log_v WHERE n % 3 <> 0)"""


def q_run_log_upsert(spark, sf_dir):
    """K1: last write per key wins."""
    lg = _log(spark, sf_dir)
    new = lg.filter(F.substring("week", 7, 2).cast("int") % 2 == 0).select(
        "product", "week",
        F.date_format(F.to_timestamp("run_ts") + F.expr("INTERVAL 1 DAY"), "yyyy-MM-dd HH:mm:ss").alias("run_ts"),
        F.lit("SUCCESS").alias("status"), "doc_url", F.concat(F.lit("new-"), F.col("week")).alias("mail_id"))
    return upsert_run_log(lg, new)


register("run_log_upsert", _SQL_STATE + """,
new AS (SELECT product, week, strftime(CAST(run_ts AS TIMESTAMP) + INTERVAL 1 DAY, '%Y-%m-%d %H:%M:%S') AS run_ts,
               'SUCCESS' AS status, doc_url, 'new-' || week AS mail_id FROM log_v WHERE n % 2 = 0),
u AS (SELECT product, week, run_ts, status, doc_url, mail_id, 0 AS src FROM log_v
      UNION ALL SELECT *, 1 FROM new),
r AS (SELECT *, row_number() OVER (PARTITION BY product, week ORDER BY run_ts DESC, src DESC) AS rn FROM u)
SELECT product, week, run_ts, status, doc_url, mail_id FROM r WHERE rn = 1
""")(q_run_log_upsert)


def q_log_only(spark, sf_dir):
    """J6 + F6: successful runs without a stored report."""
    return log_only_weeks(_log(spark, sf_dir), _reports(spark, sf_dir)).select("product", "week", "run_ts")


register("log_only_weeks", _SQL_STATE + """
SELECT l.product, l.week, l.run_ts FROM log_v l
WHERE l.status = 'SUCCESS' AND NOT EXISTS (SELECT 1 FROM reports_v r WHERE r.product = l.product AND r.week = l.week)
""")(q_log_only)


def q_listing(spark, sf_dir):
    """U1 + W7: reports plus log-only weeks, newest first."""
    return report_listing(_reports(spark, sf_dir), _log(spark, sf_dir))


register("report_listing", _SQL_STATE + """
SELECT product, week, report_ts AS ts, doc_url, mail_id, status, 'report' AS source FROM reports_v
UNION ALL
SELECT l.product, l.week, l.run_ts, l.doc_url, l.mail_id, l.status, 'log' FROM log_v l
WHERE l.status = 'SUCCESS' AND NOT EXISTS (SELECT 1 FROM reports_v r WHERE r.product = l.product AND r.week = l.week)
""")(q_listing)


def _lookup_requests(spark, sf_dir):
    k = _keys(spark, sf_dir).select("product", "week")
    return k.unionByName(k.select("product").distinct().withColumn("week", F.lit("2023-W52")))


def q_lookup(spark, sf_dir):
    """Report, else log entry with empty themes, else missing."""
    j = report_lookup(_lookup_requests(spark, sf_dir), _reports(spark, sf_dir), _log(spark, sf_dir))
    return j.select("product", "week", "source", "status", "mail_id", F.size("themes").cast("long").alias("n_themes"))


register("report_lookup", _SQL_STATE + """,
req AS (SELECT product, week FROM k UNION ALL SELECT DISTINCT product, '2023-W52' FROM k)
SELECT q.product, q.week,
       CASE WHEN r.status IS NOT NULL THEN 'report' WHEN l.status IS NOT NULL THEN 'log' ELSE 'missing' END AS source,
       coalesce(r.status, l.status) AS status, coalesce(r.mail_id, l.mail_id) AS mail_id,
       CASE WHEN r.status IS NOT NULL THEN CAST(len(r.themes) AS BIGINT) WHEN l.status IS NOT NULL THEN 0::BIGINT
            END AS n_themes
FROM req q LEFT JOIN reports_v r ON r.product = q.product AND r.week = q.week
LEFT JOIN log_v l ON l.product = q.product AND l.week = q.week
""")(q_lookup)


def q_runs_to_do(spark, sf_dir):
    """Requests not yet successful, plus forced ones."""
    req = _keys(spark, sf_dir).withColumn("force", F.col("n") % 2 == 0).drop("n")
    return runs_to_do(req, _log(spark, sf_dir)).select("product", "week", "force")


register("runs_to_do", _SQL_STATE + """,
req AS (SELECT product, week, n % 2 = 0 AS force FROM kn)
SELECT DISTINCT * FROM (
  SELECT q.product, q.week, q.force FROM req q
  WHERE NOT EXISTS (SELECT 1 FROM log_v l WHERE l.status = 'SUCCESS' AND l.product = q.product AND l.week = q.week)
  UNION ALL SELECT product, week, force FROM req WHERE force)
""")(q_runs_to_do)


def q_redraft(spark, sf_dir):
    """Weeks whose stored report has at least one theme."""
    return redraft_eligible(_log(spark, sf_dir).select("product", "week"), _reports(spark, sf_dir))


register("redraft_eligible", _SQL_STATE + """
SELECT l.product, l.week FROM log_v l
WHERE EXISTS (SELECT 1 FROM reports_v r WHERE r.product = l.product AND r.week = l.week AND len(r.themes) > 0)
""")(q_redraft)


def q_default_week(spark, sf_dir):
    """Forced week, else active week, else newest (fallback when absent)."""
    listing = report_listing(_reports(spark, sf_dir), _log(spark, sf_dir))
    ch = listing.select("product").distinct().select(
        "product",
        F.when(F.col("product") == "en", F.lit("2024-W03")).alias("forced_week"),
        F.when(F.col("product") == "de", F.lit("2024-W99")).when(F.col("product") == "fr", F.lit("2024-W05"))
         .alias("active_week"))
    return default_week(listing, ch)


register("default_week", _SQL_STATE + """,
listing AS (SELECT product, week FROM reports_v UNION ALL
            SELECT l.product, l.week FROM log_v l WHERE l.status = 'SUCCESS'
              AND NOT EXISTS (SELECT 1 FROM reports_v r WHERE r.product = l.product AND r.week = l.week)),
ch AS (SELECT DISTINCT product, coalesce(CASE WHEN product = 'en' THEN '2024-W03' END,
                                CASE WHEN product = 'de' THEN '2024-W99' WHEN product = 'fr' THEN '2024-W05' END) AS w
       FROM listing)
SELECT ch.product, coalesce(CASE WHEN EXISTS (SELECT 1 FROM listing x WHERE x.product = ch.product AND x.week = ch.w)
                                 THEN ch.w END,
                            (SELECT max(week) FROM listing x WHERE x.product = ch.product)) AS selected_week
FROM ch
""")(q_default_week)


def _sections(spark, sf_dir):
    rep = _reports(spark, sf_dir).withColumn("doc_id", F.concat(F.lit("doc-"), F.col("product")))
    have = _log(spark, sf_dir).filter(F.substring("week", 7, 2).cast("int") % 4 == 1).select(
        "product", F.format_string("%s — Weekly Review Pulse (%s)", F.col("product"), F.col("week")).alias("header"))
    return plan_sections(rep, have)


_SQL_SECTIONS = """,
have AS (SELECT product, product || ' — Weekly Review Pulse (' || week || ')' AS header FROM log_v WHERE n % 4 = 1),
sec AS (SELECT r.product, r.week, r.product || ' — Weekly Review Pulse (' || r.week || ')' AS header,
        EXISTS (SELECT 1 FROM have h WHERE h.product = r.product
                AND h.header = r.product || ' — Weekly Review Pulse (' || r.week || ')') AS skipped,
        'doc-' || r.product AS doc_id FROM reports_v r),
sec2 AS (SELECT *, CASE WHEN skipped THEN 'https://docs.example.com/document/d/' || doc_id || '/edit'
         ELSE 'https://docs.example.com/document/d/' || doc_id || '/edit#heading=h.section-' || lower(week) END
         AS section_url FROM sec)"""


def q_sections(spark, sf_dir):
    """K3 + H16: idempotent section append plan with links."""
    return _sections(spark, sf_dir).select("product", "week", "header", "skipped", "section_url")


register("sections_plan", _SQL_STATE + _SQL_SECTIONS + """
SELECT product, week, header, skipped, section_url FROM sec2
""")(q_sections)


def _recipients(spark, sf_dir):
    """(product, pos, recipient): the addresses in the documents of each language."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    rec = stakeholders.split_recipients(stakeholders.recipient_strings_from_documents(docs), "product", "recipients")
    lang_of = docs.select(F.col("doc_id").alias("product"), "lang")
    return rec.join(lang_of, "product").select(F.col("lang").alias("product"),
                                               (F.col("product") * 1000 + F.col("pos")).alias("pos"), "recipient")


def q_outbox(spark, sf_dir):
    """K4: mails for appended sections; recipients from the stakeholder lists."""
    ob = plan_outbox(_sections(spark, sf_dir), _recipients(spark, sf_dir), "development")
    return ob.select("product", "week", "to_field", F.col("n_recipients").cast("long").alias("n_recipients"),
                     "action", "is_draft")


register("outbox_plan", _SQL_STATE + _SQL_SECTIONS + f""",
{stakeholders.SQL_STAKEHOLDER_CTES.strip()},
rec AS (SELECT d.lang AS product, s.product * 1000 + s.pos AS pos, s.recipient
        FROM (SELECT product, pos, {stakeholders.sql_js_trim('raw')} AS recipient FROM u
              WHERE length({stakeholders.sql_js_trim('raw')}) > 0 AND contains({stakeholders.sql_js_trim('raw')}, '@')) s
        JOIN documents d ON d.doc_id = s.product),
tof AS (SELECT product, string_agg(recipient, ', ' ORDER BY pos) AS to_field, count(*) AS n FROM rec GROUP BY product)
SELECT s.product, s.week, coalesce(t.to_field, '') AS to_field, CAST(t.n AS BIGINT) AS n_recipients,
       CASE WHEN coalesce(t.n, 0) = 0 THEN 'skipped-no-recipients' ELSE 'draft' END AS action,
       coalesce(t.n, 0) > 0 AS is_draft
FROM sec2 s LEFT JOIN tof t ON t.product = s.product WHERE NOT s.skipped
""")(q_outbox)


def q_field_patch(spark, sf_dir):
    """K5: new draft ids written into the stored reports."""
    rep = _reports(spark, sf_dir)
    upd = rep.filter(F.size("themes") > 1).select("product", "week",
                                                   F.concat(F.lit("draft-"), F.col("week")).alias("mail_id"))
    return patch_mail_id(rep, upd).select("product", "week", "mail_id")


register("field_patch", _SQL_STATE + """
SELECT r.product, r.week, CASE WHEN len(r.themes) > 1 THEN 'draft-' || r.week ELSE r.mail_id END AS mail_id
FROM reports_v r
""")(q_field_patch)


# ---------------------------------------------------------------- G1 / A7

EPS = 1.14


def _weekly(spark, sf_dir):
    r = reviews_view(spark, sf_dir)
    req = r.select("product", weeks.iso_week_key("review_ts").alias("week")).distinct() \
           .withColumn("lookback_weeks", F.lit(10))
    return weekly_feedback(r, req, eps=EPS, min_pts=3, vectors_of=review_vectors(spark, sf_dir))


def q_weekly_audit(spark, sf_dir):
    """Per product-week counts of ingested, short, remaining and redacted
    reviews in each 10-week window."""
    r = reviews_view(spark, sf_dir)
    req = r.select("product", weeks.iso_week_key("review_ts").alias("week")).distinct() \
           .withColumn("lookback_weeks", F.lit(10))
    return window_stage(r, req)[2].select("product", "week", "n_ingested", "n_short", "n_remaining",
                                                   "n_pii_redacted")


register("weekly_audit", f"""
WITH {SQL_REVIEWS_V.strip()},
req AS (SELECT DISTINCT product, {weeks.sql_iso_week_key('review_ts')} AS week FROM reviews_v),
x AS (SELECT q.product, q.week, {__import__('reviewloom.functions.text', fromlist=['x']).sql_word_count('r.content')} AS nw,
             {__import__('reviewloom.functions.scrub', fromlist=['x']).sql_scrub_steps('r.content')['pii_removed']} AS pii
      FROM req q JOIN reviews_v r ON r.product = q.product
       AND r.review_ts >= {weeks.sql_week_end('q.week')} - to_days(70) AND r.review_ts <= {weeks.sql_week_end('q.week')})
SELECT product, week, count(*)::BIGINT AS n_ingested, count_if(nw < 8)::BIGINT AS n_short,
       count_if(nw >= 8)::BIGINT AS n_remaining, count_if(nw >= 8 AND pii)::BIGINT AS n_pii_redacted
FROM x GROUP BY 1, 2
""")(q_weekly_audit)


def q_weekly_reports(spark, sf_dir):
    """G1 end to end (dry run): themes per product-week after DBSCAN, sample,
    fallback themes and quote validation; rows-only check."""
    out = _weekly(spark, sf_dir)["reports"]
    return out.select("product", "week", F.size("themes").cast("long").alias("n_themes"),
                      F.md5("report_text").alias("report_md5"))


def _weekly_base_sql() -> str:
    """DBSCAN per product-week + centroid-nearest ranks (CTE ``rk``)."""
    from ..functions.vectors import sql_l2
    from .q_dbscan import _sql_dbscan
    return _sql_dbscan(EPS, 3, pts_sql=_sql_weekly_points(), prelude=SQL_REVIEWS_V.strip() + ",") + f""",
mem AS (SELECT a.grp, a.vec_id AS id, a.cluster_id, p.v, p.o FROM assigned a JOIN pts p ON p.grp = a.grp AND p.id = a.vec_id
        WHERE a.cluster_id >= 0),
u AS (SELECT grp, cluster_id, unnest(v) AS x, unnest(generate_series(1, len(v))) AS pos FROM mem),
cd AS (SELECT grp, cluster_id, pos, avg(CAST(x AS DOUBLE)) AS mu FROM u GROUP BY 1, 2, 3),
cen AS (SELECT grp, cluster_id, list(mu ORDER BY pos) AS c FROM cd GROUP BY 1, 2),
sz AS (SELECT grp, cluster_id, count(*) AS n FROM mem GROUP BY 1, 2),
md AS (SELECT mem.*, CASE WHEN sz.n > 15 THEN {sql_l2('mem.v', 'cen.c')} END AS dist
       FROM mem JOIN sz USING (grp, cluster_id) JOIN cen USING (grp, cluster_id)),
rk AS (SELECT *, row_number() OVER (PARTITION BY grp, cluster_id ORDER BY coalesce(dist, 0.0), o) AS rank FROM md)"""


def _weekly_reports_sql() -> str:
    from ..functions.scrub import sql_scrub_steps
    from ..functions.text import sql_js_trim, sql_word_count
    rule, div = "'" + "=" * 80 + "'", "'" + "-" * 80 + "'"
    return _weekly_base_sql() + f""",
fq AS (SELECT rk.grp, rk.cluster_id, list({sql_js_trim(sql_scrub_steps('r.content')['scrubbed'])} ORDER BY rk.rank) AS quotes
       FROM rk JOIN reviews_v r ON r.review_id = rk.id WHERE rk.rank <= 2 GROUP BY 1, 2),
th AS (SELECT grp, list({{'theme_name': 'Uncategorized Issues',
            'theme_description': 'General reviews that could not be summarized due to an API error.',
            'representative_quotes': quotes,
            'action_ideas': ['Investigate system logs for errors in reasoning modules.']}} ORDER BY cluster_id) AS themes
       FROM fq GROUP BY grp),
req AS (SELECT DISTINCT product, {weeks.sql_iso_week_key('review_ts')} AS week FROM reviews_v),
nonempty AS (SELECT DISTINCT q.product, q.week FROM req q JOIN reviews_v r ON r.product = q.product
       AND r.review_ts >= {weeks.sql_week_end('q.week')} - to_days(70) AND r.review_ts <= {weeks.sql_week_end('q.week')}
       WHERE {sql_word_count('r.content')} >= 8),
rep AS (SELECT n.product, n.week, coalesce(th.themes, []) AS themes FROM nonempty n
        LEFT JOIN th ON th.grp = n.product || '|' || n.week),
txt AS (SELECT product, week, themes,
  chr(10) || chr(10) || {rule} || chr(10) || product || ' — Weekly Review Pulse (' || week || ')' || chr(10)
  || 'Generated on: 2024-06-01 | Period: Last 10 weeks (rolling window)' || chr(10)
  || {rule} || chr(10) || chr(10) || '📋 TOP FEEDBACK THEMES:' || chr(10) || chr(10)
  || CASE WHEN len(themes) = 0 THEN 'No prominent feedback clusters were identified for this period.' || chr(10) || chr(10)
     ELSE array_to_string(list_transform(themes, lambda t, i:
          i || '. ' || t.theme_name || chr(10) || 'Description: ' || t.theme_description || chr(10) || chr(10)
          || '* Real User Quotes:' || chr(10)
          || array_to_string(list_transform(t.representative_quotes,
               lambda q: '  - "' || replace(q, chr(10), ' ') || '"' || chr(10)), '')
          || chr(10) || '* Action Ideas:' || chr(10)
          || array_to_string(list_transform(t.action_ideas, lambda a: '  - ' || a || chr(10)), '') || chr(10)), '')
     END || {div} AS report_text FROM rep)
SELECT product, week, CAST(len(themes) AS BIGINT) AS n_themes, md5(report_text) AS report_md5 FROM txt"""



def q_weekly_clusters(spark, sf_dir):
    """G1's clustering stage: DBSCAN per (product, week) over the 10-week
    window's long reviews that have vectors; cluster sizes by id (numbering
    follows scan order = newest first)."""
    a = _weekly(spark, sf_dir)["assignments"]
    return a.groupBy("product", "week", "cluster_id").agg(F.count(F.lit(1)).alias("size"))


def _sql_weekly_points() -> str:
    from ..functions.text import sql_word_count
    return f"""
SELECT r.review_id AS id, q.product || '|' || q.week AS grp, e.embedding AS v,
       (-epoch_us(r.review_ts), r.review_id) AS o
FROM (SELECT DISTINCT product, {weeks.sql_iso_week_key('review_ts')} AS week FROM reviews_v) q
JOIN reviews_v r ON r.product = q.product
 AND r.review_ts >= {weeks.sql_week_end('q.week')} - to_days(70) AND r.review_ts <= {weeks.sql_week_end('q.week')}
JOIN embeddings e ON e.vec_id = r.review_id
WHERE {sql_word_count('r.content')} >= 8 AND NOT list_bool_and(list_transform(e.embedding, lambda x: x = 0))"""


def _weekly_clusters_sql() -> str:
    from .q_dbscan import _sql_dbscan
    return _sql_dbscan(EPS, 3, pts_sql=_sql_weekly_points(), prelude=SQL_REVIEWS_V.strip() + ",") + """
SELECT split_part(grp, '|', 1) AS product, split_part(grp, '|', 2) AS week, cluster_id, count(*)::BIGINT AS size
FROM assigned GROUP BY 1, 2, 3"""


register("weekly_clusters", _weekly_clusters_sql())(q_weekly_clusters)


def q_run_audit(spark, sf_dir):
    """Per product-week audit row (ingested, short, redacted, clusters,
    noise, token estimate, quote outcomes); rows-only check."""
    return _weekly(spark, sf_dir)["run_audit"].drop("n_without_vector", "n_zero_vector")


register("run_audit")(q_run_audit)  # SQL oracle attached below, after its helpers


def q_redraft_outbox(spark, sf_dir):
    """New recipients (per-language lists from the addresses in documents)
    -> eligible weeks -> teaser mails -> outbox."""
    from .redraft import redraft
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    lists = stakeholders.recipient_strings_from_documents(docs).join(
        docs.select(F.col("doc_id").alias("product"), "lang"), "product")
    lists = lists.groupBy(F.col("lang").alias("product")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(
        F.struct(F.col("product").alias("doc"), "recipients"))), lambda x: x["recipients"]), ",").alias("recipients"))
    out = redraft(lists, _log(spark, sf_dir), _reports(spark, sf_dir), _log(spark, sf_dir))
    return out["outbox"].select("product", "week", "subject", "to_field", "action")


register("redraft_outbox", _SQL_STATE + f""",
{stakeholders.SQL_STAKEHOLDER_CTES.strip().replace("SELECT doc_id AS product,", "SELECT doc_id AS product, lang,")},
lists AS (SELECT d.lang AS product, string_agg(s.recipients, ',' ORDER BY s.product) AS recipients FROM src s JOIN documents d ON d.doc_id = s.product
          GROUP BY d.lang),
parts2 AS (SELECT product, string_split(recipients, ',') AS p FROM lists),
u2 AS (SELECT product, unnest(p) AS raw, unnest(generate_series(0, len(p) - 1)) AS pos FROM parts2),
rec AS (SELECT product, pos, {stakeholders.sql_js_trim('raw')} AS recipient FROM u2
        WHERE length({stakeholders.sql_js_trim('raw')}) > 0 AND contains({stakeholders.sql_js_trim('raw')}, '@')),
tof AS (SELECT product, string_agg(recipient, ', ' ORDER BY pos) AS to_field, count(*) AS n FROM rec GROUP BY product),
elig AS (SELECT r.product, r.week FROM reports_v r JOIN log_v l ON l.product = r.product AND l.week = r.week
         WHERE len(r.themes) > 0)
SELECT e.product, e.week, e.product || ' Weekly Review Pulse — ' || e.week AS subject,
       coalesce(t.to_field, '') AS to_field,
       CASE WHEN coalesce(t.n, 0) = 0 THEN 'skipped-no-recipients' ELSE 'draft' END AS action
FROM elig e LEFT JOIN tof t ON t.product = e.product
""")(q_redraft_outbox)


register("weekly_reports", _weekly_reports_sql())(q_weekly_reports)


def _weekly_with_state(spark, sf_dir):
    """G1 over an earlier log (weeks of even number are done), stored reports, forced weeks
    (multiples of 4) and recipients; a one-week look-back leaves some windows empty."""
    r = reviews_view(spark, sf_dir)
    req = r.select("product", weeks.iso_week_key("review_ts").alias("week")).distinct() \
           .withColumn("lookback_weeks", F.lit(10)).withColumn("force", F.substring("week", 7, 2).cast("int") % 4 == 0)
    log = _log(spark, sf_dir).filter(F.substring("week", 7, 2).cast("int") % 2 == 0)
    return weekly_feedback(r, req, eps=EPS, min_pts=3, run_log=log, stored_reports=_reports(spark, sf_dir), recipients=_recipients(spark, sf_dir),
                           vectors_of=review_vectors(spark, sf_dir))


def q_weekly_outbox(spark, sf_dir):
    """G1 + R2 + K4: the mails of a weekly run with recipients, done and forced weeks."""
    ob = _weekly_with_state(spark, sf_dir)["outbox"]
    return ob.select("product", "week", "subject", F.md5("email_text").alias("text_md5"), F.md5("email_html").alias("html_md5"), "to_field", "action")


def q_weekly_run_log(spark, sf_dir):
    """G1 + J8 + F3: what became of every request: new log rows, and what is stored of the weeks done before."""
    out = _weekly_with_state(spark, sf_dir)
    new = out["run_log_rows"].select("product", "week", "status", "doc_url", "mail_id", F.lit(-1).cast("long").alias("n_themes"))
    done = out["already_done"].select("product", "week", F.concat(F.lit("DONE "), "status").alias("status"), "doc_url", "mail_id",
                                      F.size("themes").cast("long").alias("n_themes"))
    return new.unionByName(done)


def _sql_recipients() -> str:
    """CTE ``tof`` (product, to_field, n): recipients of each language, under names that clash with no others."""
    ctes = re.sub(r"\b(src|parts|u)\b", r"addr_\1", stakeholders.SQL_STAKEHOLDER_CTES.strip())
    trim = stakeholders.sql_js_trim("raw")
    return f"""{ctes},
tof AS (SELECT d.lang AS product, string_agg(s.recipient, ', ' ORDER BY s.product * 1000 + s.pos) AS to_field, count(*) AS n
        FROM (SELECT product, pos, {trim} AS recipient FROM addr_u WHERE length({trim}) > 0 AND contains({trim}, '@')) s
        JOIN documents d ON d.doc_id = s.product GROUP BY 1)"""


_SQL_WEEK_NO = "CAST(substr({0}.week, 7, 2) AS INTEGER)"
# done before: even weeks but for the tenth, whose run failed; forced: multiples of 4
_SQL_TODO = "({0} % 2 = 1 OR {0} % 4 = 0 OR {0} % 10 = 0)".format(_SQL_WEEK_NO)
_SQL_ACTION = "CASE WHEN coalesce(tof.n, 0) = 0 THEN 'skipped-no-recipients' ELSE 'draft' END"


def _weekly_outbox_sql() -> str:
    def esc(c):
        return f"replace(replace(replace(replace({c}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), chr(34), '&quot;')"
    base = _weekly_reports_sql().rsplit("SELECT product, week, CAST(len(themes)", 1)[0]
    return base.rstrip() + f""",
{_sql_recipients()},
m AS (SELECT txt.product, txt.week, themes, 'https://docs.example.com/document/d/doc-id/edit#heading=h.section-' || lower(week) AS url,
             coalesce(tof.to_field, '') AS to_field, {_SQL_ACTION} AS action
      FROM txt LEFT JOIN tof ON tof.product = txt.product WHERE {_SQL_TODO.format("txt")})
SELECT product, week, product || ' Weekly Review Pulse — ' || week AS subject,
  md5(product || ' — Weekly Review Pulse (' || week || ')' || chr(10) || chr(10)
  || 'Here is a summary of customer feedback themes from the app store:' || chr(10) || chr(10)
  || array_to_string(list_transform(themes, lambda t, i: i || '. ' || t.theme_name || chr(10) || '   ' || t.theme_description || chr(10) || chr(10)), '')
  || 'Read the full detailed report, including verbatim user quotes and actionable ideas, in the shared document:' || chr(10) || url
  || chr(10) || chr(10) || '---' || chr(10) || 'This pulse report was automatically generated and delivered.') AS text_md5,
  md5('<div><h2>' || {esc("product")} || ' — Weekly Review Pulse</h2><p>Period Focus: <strong>' || week || '</strong></p><ul>'
  || array_to_string(list_transform(themes, lambda t: '<li><strong>' || {esc("t.theme_name")} || '</strong><br/><span>' || {esc("t.theme_description")} || '</span></li>'), '')
  || '</ul><a href="' || {esc("url")} || '">Read Full Document Report</a></div>') AS html_md5, to_field, action FROM m"""


register("weekly_outbox", _weekly_outbox_sql())(q_weekly_outbox)


def _weekly_run_log_sql() -> str:
    from ..functions.text import sql_word_count
    end = weeks.sql_week_end("k.week")
    return _SQL_STATE.rstrip() + f""",
{_sql_recipients()},
ne AS (SELECT DISTINCT k.product, k.week FROM k JOIN reviews_v r ON r.product = k.product
       AND r.review_ts >= {end} - to_days(70) AND r.review_ts <= {end} WHERE {sql_word_count('r.content')} >= 8)
SELECT k.product, k.week, CASE WHEN ne.week IS NULL THEN 'SKIPPED_EMPTY' ELSE 'SUCCESS' END AS status,
       CASE WHEN ne.week IS NULL THEN '' ELSE 'https://docs.example.com/document/d/doc-id/edit#heading=h.section-' || lower(k.week) END AS doc_url,
       CASE WHEN ne.week IS NULL THEN '' WHEN coalesce(tof.n, 0) = 0 THEN 'skipped-no-recipients' ELSE 'mock-draft-id' END AS mail_id, CAST(-1 AS BIGINT) AS n_themes
FROM k LEFT JOIN ne ON ne.product = k.product AND ne.week = k.week LEFT JOIN tof ON tof.product = k.product WHERE {_SQL_TODO.format("k")}
UNION ALL
SELECT l.product, l.week, 'DONE ' || coalesce(r.status, l.status), l.doc_url, l.mail_id, CAST(coalesce(len(r.themes), 0) AS BIGINT)
FROM log_v l LEFT JOIN reports_v r ON r.product = l.product AND r.week = l.week WHERE NOT {_SQL_TODO.format("l")}"""


register("weekly_run_log", _weekly_run_log_sql())(q_weekly_run_log)


def _run_audit_sql() -> str:
    from ..functions.scrub import sql_scrub_steps
    from ..functions.text import sql_word_count
    from .q_themes import _TAIL_SQL, _sql_lit, _u16
    from ..operators.themes import PROMPT_TEMPLATE
    head = PROMPT_TEMPLATE.split("{reviews}")[0]
    h1, h2 = head.split("{product}")
    sc = sql_scrub_steps("r.content")
    return _weekly_base_sql() + f""",
lines AS (SELECT rk.grp, rk.cluster_id,
            string_agg('[Review ' || rk.rank || '] Date: ' || strftime(r.review_ts, '%Y-%m-%d') || ', Rating: '
              || r.score || '★' || chr(10) || 'Text: "' || {sc['scrubbed']} || '"', chr(10) || chr(10) ORDER BY rk.rank)
              AS reviews_text
          FROM rk JOIN reviews_v r ON r.review_id = rk.id WHERE rk.rank <= 15 GROUP BY 1, 2),
prm AS (SELECT grp, cluster_id, reviews_text,
               {_sql_lit(h1)} || split_part(grp, '|', 1) || {_sql_lit(h2)} || reviews_text || {_TAIL_SQL} AS prompt
        FROM lines),
tok AS (SELECT grp, sum(CAST(ceil(({_u16('prompt')} + {_u16('reviews_text')}) / 4) + 500 AS BIGINT)) AS est,
               count(*) AS ncl FROM prm GROUP BY grp),
cl AS (SELECT grp, count(*) AS npts, count_if(cluster_id < 0) AS noise, max(cluster_id) + 1 AS nclus
       FROM assigned GROUP BY grp),
req AS (SELECT DISTINCT product, {weeks.sql_iso_week_key('review_ts')} AS week FROM reviews_v),
x AS (SELECT q.product, q.week, {sql_word_count('r.content')} >= 8 AS long_enough, {sc['pii_removed']} AS pii,
             {sc['injection_neutralized']} AS inj
      FROM req q JOIN reviews_v r ON r.product = q.product
       AND r.review_ts >= {weeks.sql_week_end('q.week')} - to_days(70) AND r.review_ts <= {weeks.sql_week_end('q.week')}),
au AS (SELECT product, week, count(*) AS n_ingested, count_if(NOT long_enough) AS n_short,
              count_if(long_enough) AS n_remaining, count_if(long_enough AND pii) AS n_pii_redacted,
              count_if(long_enough AND inj) AS n_injection FROM x GROUP BY 1, 2)
SELECT q.product, q.week, 10 AS lookback_weeks,
       coalesce(au.n_ingested, 0)::BIGINT AS n_ingested, coalesce(au.n_short, 0)::BIGINT AS n_short,
       coalesce(au.n_remaining, 0)::BIGINT AS n_remaining, coalesce(au.n_pii_redacted, 0)::BIGINT AS n_pii_redacted,
       coalesce(au.n_injection, 0)::BIGINT AS n_injection,
       coalesce(cl.npts, 0)::BIGINT AS n_clustered_points, coalesce(cl.noise, 0)::BIGINT AS n_noise,
       coalesce(cl.nclus, 0)::BIGINT AS n_clusters, coalesce(tok.est, 0)::BIGINT AS estimated_tokens,
       (2 * coalesce(tok.ncl, 0))::BIGINT AS quotes_kept, 0::BIGINT AS quotes_modified,
       0::BIGINT AS quotes_discarded, 0::BIGINT AS quotes_substituted
FROM req q LEFT JOIN au ON au.product = q.product AND au.week = q.week
LEFT JOIN cl ON cl.grp = q.product || '|' || q.week
LEFT JOIN tok ON tok.grp = q.product || '|' || q.week"""

from .catalog import ORACLES as _ORACLES  # noqa: E402
_ORACLES["run_audit"] = _run_audit_sql()
