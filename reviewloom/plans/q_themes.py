"""Theme queries.

Clusters are the embeddings' ``label`` groups; each vector's review is the
document with ``doc_id = vec_id`` in ``reviews_v``; the sample is the 15
members nearest the centroid (W1)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vectors
from ..functions.text import sql_js_trim  # noqa: F401
from ..operators.centroid import fallback_quotes, nearest_to_centroid
from ..operators.render import render_email, render_report
from ..operators.themes import PROMPT_TEMPLATE, collect_themes, ingest_responses, offline_themes, prompt_table
from ..sources.tables import SQL_REVIEWS_V, embeddings_view, reviews_view
from .catalog import register

PRODUCT = "App"


def _members(spark, sf_dir):
    e = embeddings_view(spark, sf_dir).drop("ord")
    r = reviews_view(spark, sf_dir).select("review_id", "content", "score", "review_ts", "ord")
    return e.join(r, e.vec_id == r.review_id).drop("review_id").withColumn("product", F.lit(PRODUCT))


def _sample(spark, sf_dir):
    return nearest_to_centroid(_members(spark, sf_dir), ["label"], "ord", k=15)


def _sql_lit(s: str) -> str:
    parts = s.replace("'", "''").split("\n")
    return " || chr(10) || ".join(f"'{p}'" for p in parts)


_HEAD, _TAIL = PROMPT_TEMPLATE.split("{reviews}")
_HEAD_SQL = _sql_lit(_HEAD.replace("{product}", PRODUCT))
_TAIL_SQL = _sql_lit(_TAIL.replace("{{", "{").replace("}}", "}"))

_SQL_SAMPLE = f"""
WITH {SQL_REVIEWS_V.strip()},
m AS (SELECT e.label, e.vec_id, e.embedding, r.content, r.score, r.review_ts
      FROM embeddings e JOIN reviews_v r ON r.review_id = e.vec_id),
u AS (SELECT label, unnest(embedding) AS x, unnest(generate_series(1, len(embedding))) AS pos FROM m),
d AS (SELECT label, pos, avg(CAST(x AS DOUBLE)) AS mu FROM u GROUP BY label, pos),
c AS (SELECT label, list(mu ORDER BY pos) AS centroid FROM d GROUP BY label),
s AS (SELECT label, count(*) AS n FROM m GROUP BY label),
md AS (SELECT m.*, s.n, CASE WHEN s.n > 15 THEN {vectors.sql_l2('m.embedding', 'c.centroid')} END AS distance
       FROM m JOIN s ON s.label = m.label JOIN c ON c.label = m.label),
rk AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY coalesce(distance, 0.0), review_ts DESC, vec_id)
              AS rank FROM md),
sample AS (SELECT * FROM rk WHERE rank <= 15),
lines AS (SELECT label, string_agg('[Review ' || rank || '] Date: ' || strftime(review_ts, '%Y-%m-%d')
                 || ', Rating: ' || score || '★' || chr(10) || 'Text: "' || content || '"', chr(10) || chr(10)
                 ORDER BY rank) AS reviews_text, count(*) AS n_sampled FROM sample GROUP BY label),
prompts AS (SELECT label, reviews_text, n_sampled, {_HEAD_SQL} || reviews_text || {_TAIL_SQL} AS prompt FROM lines)"""


def _u16(x: str) -> str:
    return f"(length({x}) + len(regexp_extract_all({x}, '[\\x{{10000}}-\\x{{10FFFF}}]')))"


def q_prompts(spark, sf_dir):
    """A5 + T2 + H13 + H14: prompt per cluster and its token estimate."""
    p = prompt_table(_sample(spark, sf_dir), ["label"])
    return p.select("label", F.col("n_sampled").cast("long").alias("n_sampled"), "estimated_tokens",
                    F.md5("prompt").alias("prompt_md5"), F.md5("reviews_text").alias("reviews_md5"))


register("prompts", _SQL_SAMPLE + f"""
SELECT label, CAST(n_sampled AS BIGINT) AS n_sampled,
       CAST(ceil(({_u16('prompt')} + {_u16('reviews_text')}) / 4) + 500 AS BIGINT) AS estimated_tokens,
       md5(prompt) AS prompt_md5, md5(reviews_text) AS reviews_md5 FROM prompts
""")(q_prompts)


def _responses(spark, sf_dir):
    e = embeddings_view(spark, sf_dir).select("label").distinct()
    lab = F.col("label").cast("string")
    resp = F.when(F.col("label") % 3 == 0, F.concat(
        F.lit('{"themeName": "Theme '), lab, F.lit('", "themeDescription": "Reviews of label '), lab,
        F.lit('", "representativeQuotes": ["quote a ', ), lab, F.lit('", "quote b"], "actionIdeas": ["act ",'),
        F.lit(' "act 2"]}'))) \
        .when(F.col("label") % 3 == 1, F.concat(F.lit('{"themeName": "", "themeDescription": "x", '
                                                      '"representativeQuotes": ["q"]}'))) \
        .otherwise(F.lit("not json"))
    return e.filter(F.col("label") != 9).select("label", resp.alias("response"))


_SQL_RESPONSES = """,
responses AS (SELECT DISTINCT label,
    CASE WHEN label % 3 = 0 THEN '{"themeName": "Theme ' || label || '", "themeDescription": "Reviews of label '
              || label || '", "representativeQuotes": ["quote a ' || label || '", "quote b"], "actionIdeas": ["act ",'
              || ' "act 2"]}'
         WHEN label % 3 = 1 THEN '{"themeName": "", "themeDescription": "x", "representativeQuotes": ["q"]}'
         ELSE 'not json' END AS response
  FROM embeddings WHERE label <> 9),
parsed AS (SELECT p.label, CASE WHEN json_valid(r.response) THEN r.response END AS j
           FROM prompts p LEFT JOIN responses r ON r.label = p.label),
fb AS (SELECT label, list(content ORDER BY rank) AS fq FROM sample WHERE rank <= 2 GROUP BY label),
themes AS (
  SELECT parsed.label,
         coalesce(json_extract_string(j, '$.themeName'), '') <> ''
           AND coalesce(json_extract_string(j, '$.themeDescription'), '') <> ''
           AND coalesce(json_type(j, '$.representativeQuotes') = 'ARRAY', false) AS ok,
         j, fb.fq FROM parsed LEFT JOIN fb ON fb.label = parsed.label)"""


def q_theme_fallback(spark, sf_dir):
    """T3 + F9 + W5: response ingestion; malformed, badly shaped or missing
    responses give the fixed fallback theme with the first two sampled texts."""
    s = _sample(spark, sf_dir)
    p = prompt_table(s, ["label"])
    t = ingest_responses(p, _responses(spark, sf_dir), fallback_quotes(s, ["label"]), ["label"])
    return t.select("label", "theme_name", "theme_description", "representative_quotes", "action_ideas",
                    "used_fallback")


register("theme_fallback", _SQL_SAMPLE + _SQL_RESPONSES + """
SELECT label,
       CASE WHEN ok THEN json_extract_string(j, '$.themeName') ELSE 'Uncategorized Issues' END AS theme_name,
       CASE WHEN ok THEN json_extract_string(j, '$.themeDescription')
            ELSE 'General reviews that could not be summarized due to an API error.' END AS theme_description,
       CASE WHEN ok THEN CAST(json_extract(j, '$.representativeQuotes') AS VARCHAR[]) ELSE coalesce(fq, []) END
            AS representative_quotes,
       CASE WHEN ok THEN coalesce(CAST(json_extract(j, '$.actionIdeas') AS VARCHAR[]), [])
            ELSE ['Investigate system logs for errors in reasoning modules.'] END AS action_ideas,
       NOT ok AS used_fallback
FROM themes
""")(q_theme_fallback)


def _offline(spark, sf_dir):
    m = _members(spark, sf_dir).withColumn("grp", F.col("label") % 2)
    s = nearest_to_centroid(m, ["grp", "label"], "ord", k=15)
    return offline_themes(m, ["grp", "label"], ["grp"], s)


_SQL_TERMS = """,
mg AS (SELECT label % 2 AS grp, label, content FROM m),
w0 AS (SELECT grp, label, unnest(regexp_extract_all(lower(content), '([^\\t\\n\\x0B\\f\\r \\x{00A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}\\x{FEFF}]+)', 1)) AS w FROM mg),
w1 AS (SELECT grp, label, regexp_replace(w, '[^\\p{L}\\p{N}]', '', 'g') AS w FROM w0),
tf AS (SELECT grp, label, w, count(*) AS n FROM w1 WHERE length(w) > 0 GROUP BY 1, 2, 3),
tot AS (SELECT grp, label, sum(n) AS total FROM tf GROUP BY 1, 2),
dfw AS (SELECT grp, w, sum(n) AS freq FROM tf GROUP BY 1, 2),
aw AS (SELECT grp, avg(total) AS avg_total FROM tot GROUP BY 1),
sc AS (SELECT tf.grp, tf.label, tf.w, (tf.n / tot.total) * ln(1.0 + aw.avg_total / dfw.freq) AS score
       FROM tf JOIN tot USING (grp, label) JOIN dfw USING (grp, w) JOIN aw USING (grp)),
top AS (SELECT *, row_number() OVER (PARTITION BY grp, label ORDER BY score DESC, w) AS r FROM sc),
names AS (SELECT grp, label, string_agg(w, ' ' ORDER BY r) AS terms FROM top WHERE r <= 3 GROUP BY 1, 2),
s2 AS (SELECT m.label % 2 AS grp, m.label, m.content, m.review_ts, m.vec_id, s.n,
              CASE WHEN s.n > 15 THEN {dist} END AS distance
       FROM m JOIN s ON s.label = m.label JOIN c ON c.label = m.label),
rk2 AS (SELECT *, row_number() OVER (PARTITION BY grp, label ORDER BY coalesce(distance, 0.0), review_ts DESC, vec_id)
        AS rank FROM s2),
q AS (SELECT grp, label, list(regexp_extract(content, '^[^.!?\\n]*[.!?]?', 0) ORDER BY rank) AS quotes
      FROM rk2 WHERE rank <= 2 GROUP BY 1, 2),
offline AS (SELECT names.grp, names.label,
       array_to_string(list_transform(string_split(terms, ' '),
                       lambda t: upper(substr(t, 1, 1)) || lower(substr(t, 2))), ' ') AS theme_name,
       'Reviews mentioning ' || replace(terms, ' ', ', ') || '.' AS theme_description,
       coalesce(q.quotes, []) AS representative_quotes, CAST([] AS VARCHAR[]) AS action_ideas
  FROM names LEFT JOIN q USING (grp, label))""".replace("{dist}", vectors.sql_l2("m.embedding", "c.centroid"))


def q_theme_terms(spark, sf_dir):
    """T4: offline theme name from top class-TF-IDF terms, first-sentence quotes."""
    t = _offline(spark, sf_dir)
    return t.select("label", "theme_name", "theme_description", "representative_quotes")


register("theme_terms", _SQL_SAMPLE + _SQL_TERMS + """
SELECT label, theme_name, theme_description, representative_quotes FROM offline
""")(q_theme_terms)


def _reports(spark, sf_dir):
    t = _offline(spark, sf_dir).withColumnRenamed("label", "cluster_id")
    per = collect_themes(t, ["grp"])
    return per.select(F.lit(PRODUCT).alias("product"),
                      F.format_string("2024-W%02d", F.col("grp") + 1).alias("week"),
                      F.lit(4).alias("lookback_weeks"), "themes")


_SQL_REPORT = """,
per AS (SELECT grp, list({'theme_name': theme_name, 'theme_description': theme_description,
                          'representative_quotes': representative_quotes, 'action_ideas': action_ideas}
                         ORDER BY label) AS themes FROM offline GROUP BY grp),
rep AS (SELECT 'App' AS product, printf('2024-W%02d', grp + 1) AS week, 4 AS lookback_weeks, themes FROM per)"""


def q_theme_collection(spark, sf_dir):
    """Themes per report in cluster-id order."""
    r = _reports(spark, sf_dir)
    return r.select("week", F.transform("themes", lambda t: t["theme_name"]).alias("theme_names"),
                    F.size("themes").cast("long").alias("n_themes"))


register("theme_collection", _SQL_SAMPLE + _SQL_TERMS + _SQL_REPORT + """
SELECT week, list_transform(themes, lambda t: t.theme_name) AS theme_names, CAST(len(themes) AS BIGINT) AS n_themes
FROM rep
""")(q_theme_collection)


def q_render_report(spark, sf_dir):
    """R1 (+H15): plain-text report section per week."""
    r = render_report(_reports(spark, sf_dir), "product", "week", "lookback_weeks", "themes", "2024-06-01")
    return r.select("week", "report_text")


_RULE = "'" + "=" * 80 + "'"
_DIV = "'" + "-" * 80 + "'"
register("render_report", _SQL_SAMPLE + _SQL_TERMS + _SQL_REPORT + f"""
SELECT week,
  chr(10) || chr(10) || {_RULE} || chr(10) || product || ' — Weekly Review Pulse (' || week || ')' || chr(10)
  || 'Generated on: 2024-06-01 | Period: Last ' || lookback_weeks || ' weeks (rolling window)' || chr(10)
  || {_RULE} || chr(10) || chr(10) || '📋 TOP FEEDBACK THEMES:' || chr(10) || chr(10)
  || CASE WHEN len(themes) = 0 THEN 'No prominent feedback clusters were identified for this period.' || chr(10) || chr(10)
     ELSE array_to_string(list_transform(themes, lambda t, i:
          i || '. ' || t.theme_name || chr(10) || 'Description: ' || t.theme_description || chr(10) || chr(10)
          || '* Real User Quotes:' || chr(10)
          || array_to_string(list_transform(t.representative_quotes,
               lambda q: '  - "' || replace(q, chr(10), ' ') || '"' || chr(10)), '')
          || chr(10) || '* Action Ideas:' || chr(10)
          || array_to_string(list_transform(t.action_ideas, lambda a: '  - ' || a || chr(10)), '') || chr(10)), '')
     END || {_DIV} AS report_text
FROM rep
""")(q_render_report)


def q_email_teaser(spark, sf_dir):
    """R2 (+H16): subject and plain-text teaser per week."""
    r = _reports(spark, sf_dir).withColumn("url", F.format_string(
        "https://docs.example.com/document/d/doc-id/edit#heading=h.section-%s", F.lower("week")))
    e = render_email(r, "product", "week", "themes", "url")
    return e.select("week", "subject", "email_text")


register("email_teaser", _SQL_SAMPLE + _SQL_TERMS + _SQL_REPORT + """
SELECT week, product || ' Weekly Review Pulse — ' || week AS subject,
  product || ' — Weekly Review Pulse (' || week || ')' || chr(10) || chr(10)
  || 'Here is a summary of customer feedback themes from the app store:' || chr(10) || chr(10)
  || array_to_string(list_transform(themes, lambda t, i: i || '. ' || t.theme_name || chr(10) || '   '
       || t.theme_description || chr(10) || chr(10)), '')
  || 'Read the full detailed report, including verbatim user quotes and actionable ideas, in the shared document:'
  || chr(10) || 'https://docs.example.com/document/d/doc-id/edit#heading=h.section-' || lower(week)
  || chr(10) || chr(10) || '---' || chr(10) || 'This pulse report was automatically generated and delivered.'
  AS email_text
FROM rep
""")(q_email_teaser)
