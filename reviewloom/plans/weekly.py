"""G1: the weekly feedback job for many (product, week) requests at once.

Stages (each a DataFrame keyed by product, week[, cluster_id]):
J8 skip done runs -> scrub (H8) and word count (F2) once per review -> attach
reviews to every requested look-back window (F1/W9) -> audit counts (A3/A4,
F3) -> DBSCAN per product-week on the precomputed vectors (C2) -> noise out
(F4) -> centroid-nearest sample (W1) -> prompt table (T2) -> responses or the
fallback theme (T3) -> quote validation against the full cluster (T5) ->
themes per week (A6) -> report text (R1) -> sections (K3) -> mails (R2) in the
outbox (K4) -> run log rows (K1), SKIPPED_EMPTY ones (F3) among them.  Requests that an
earlier run has done come back with what is stored of them (J8).  ``weekly_feedback`` only builds the frames (a dry run);
``commit_run`` writes them in the order report -> outbox -> run log, so a
run-log row always implies a stored report.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize

from ..functions import scrub, text, vectors, weeks
from ..operators.centroid import fallback_quotes, nearest_to_centroid
from ..operators.dbscan import BLOCK, dbscan
from ..operators.joins import bounded_broadcast
from ..operators.quotes import validate_quotes
from ..operators.render import render_email, render_report
from ..operators.reports import REPORT_COLUMNS, RUN_LOG_COLUMNS, THEME_STRUCT_SNAKE, plan_outbox, plan_sections, planned_mail_id, report_lookup, runs_to_do, upsert_run_log, write_reports
from ..operators.themes import THEME_FIELDS, collect_themes, ingest_responses, offline_themes, prompt_table
from ..operators.window import expand_to_requests

KEY = ["product", "week"]
CKEY = ["product", "week", "cluster_id"]
#: Row numbers that are broadcast to pick texts: 8 bytes each.
MOST_ROW_NUMBERS = 1 << 21


def window_stage(reviews: DataFrame, requests: DataFrame, run_log: DataFrame | None = None, min_words: int = 8,
                 upper_bound: bool = True, vectors_of: DataFrame | None = None):
    """J8 + H8/F2 once per review + F1/W9 windows + A3/A4/F3 audit counts.

    Returns the requests to do, the reviews' rows per window, the audit, the empty windows, the texts by ``__row``, and
    the reviews without texts.  ``vectors_of`` (review_id, embedding) are joined to these, so no text is shuffled for them."""
    if "force" not in requests.columns:
        requests = requests.withColumn("force", F.lit(False))
    requests = materialize(requests)
    twice = requests.groupBy(*KEY).agg(F.countDistinct("lookback_weeks").alias("n")).filter("n > 1").limit(5).collect()
    if twice:  # results are keyed by product and week
        raise ValueError(f"more than one look-back for {[(r.product, r.week) for r in twice]}: request them in separate runs")
    requests = requests.filter(weeks.is_valid_week_key(F.col("week")))
    todo = runs_to_do(requests, run_log) if run_log is not None else requests
    todo = materialize(todo)  # request-sized; read by the span, size checks, joins and audit
    # Bound the scan by the requests' overall span (two scalars from the small
    # request table): literal predicates reach the parquet scan / partition
    # pruning, so a one-week request never scrubs the whole history.
    span = todo.agg(F.min(weeks.lookback_lower(F.col("week"), F.col("lookback_weeks"))).alias("lo"),
                    F.max(weeks.week_end_ts(F.col("week"))).alias("hi")).first()
    if span["lo"] is None:
        reviews = reviews.limit(0)
    else:
        reviews = reviews.filter(F.col("review_ts") >= F.lit(span["lo"]))
        if upper_bound:
            reviews = reviews.filter(F.col("review_ts") <= F.lit(span["hi"]))
    r = reviews.withColumn("long_enough", text.has_min_words("content", min_words))
    r = scrub.scrub_columns(r).withColumn("content", F.col("content_scrubbed")).drop("content_scrubbed")
    # scrub once per review and keep the result; windows carry keys, flags and
    # vectors only - texts are joined back for clustered members alone
    r = materialize(r.withColumn("__row", F.monotonically_increasing_id()))
    slim = r.drop(*[c for c in ("content", "version", "thumbs_up") if c in r.columns])
    if vectors_of is not None:
        # a number of its own: few bytes, but a row for each window of a review comes of each
        tasks = int(reviews.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        slim = materialize(slim.repartition(tasks, "review_id").join(vectors_of.select("review_id", "embedding"), "review_id", "left"))
    x = materialize(expand_to_requests(slim.drop("__row"), todo, upper_bound=upper_bound))
    audit = x.groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("n_ingested"),
        F.count_if(~F.col("long_enough")).alias("n_short"),
        F.count_if("long_enough").alias("n_remaining"),
        F.count_if(F.col("long_enough") & F.col("pii_removed")).alias("n_pii_redacted"),
        F.count_if(F.col("long_enough") & F.col("injection_neutralized")).alias("n_injection"))
    audit = todo.select(*KEY, "lookback_weeks").join(audit, KEY, "left").fillna(0)
    skipped_empty = audit.filter(F.col("n_remaining") == 0).select(*KEY, F.lit("SKIPPED_EMPTY").alias("status"))
    return todo, x, audit, skipped_empty, r.select("__row", "content"), slim


def with_texts(rows: DataFrame, texts: DataFrame) -> DataFrame:
    """``rows`` with the ``content`` of their ``__row``; texts of other rows are not shuffled."""
    needed = materialize(rows.select("__row").distinct())
    texts = texts.join(bounded_broadcast(needed, MOST_ROW_NUMBERS), "__row", "left_semi")
    return texts.join(bounded_broadcast(rows), "__row").select(*[c for c in rows.columns if c != "__row"], "content")


def weekly_feedback(reviews: DataFrame, requests: DataFrame, *, eps: float, min_pts: int = 3, k: int = 15,
                    min_words: int = 8, run_log: DataFrame | None = None, responses: DataFrame | None = None,
                    existing_sections: DataFrame | None = None, recipients: DataFrame | None = None,
                    doc_id: str = "doc-id", environment: str = "development", generated_on: str = "2024-06-01",
                    run_ts: str = "2024-06-01 00:00:00", keep_zero_vectors: bool = False,
                    upper_bound: bool = True, block_size: int = BLOCK,
                    embedder: Callable[[DataFrame], DataFrame] | None = None, offline: bool = False,
                    stored_reports: DataFrame | None = None, vectors_of: DataFrame | None = None) -> dict[str, DataFrame]:
    """The vectors are the column ``embedding`` of ``reviews``, or those of ``vectors_of`` (review_id, embedding).

    ``embedder`` gives rows (product, review_id, content) an ``embedding`` in the
    space of the given vectors; it gets the scrubbed reviews that have none or
    a zero one.  Without it they take no part in clusters and are counted
    in ``run_audit`` (n_without_vector, n_zero_vector).

    ``offline`` names the themes of clusters without a usable response by their
    terms (T4) instead of the fixed fallback.  ``already_done`` has a row for every
    request that ``run_log`` shows as done: the stored report's themes (of
    ``stored_reports``, if given), url and mail id."""
    spark = reviews.sparkSession
    todo, x, audit, skipped_empty, texts, slim = window_stage(reviews, requests, run_log, min_words, upper_bound, vectors_of)

    kept = x.filter(F.col("long_enough"))
    has_vec = F.col("embedding").isNotNull() & ~vectors.is_zero_vector("embedding")
    if embedder is not None:
        lacking = with_texts(slim.filter(F.col("long_enough") & ~has_vec).select("product", "review_id", "__row"), texts)
        made = embedder(lacking).select("product", "review_id", F.col("embedding").cast("array<float>").alias("__made"))
        kept = materialize(kept.join(materialize(made), ["product", "review_id"], "left")
                           .withColumn("embedding", F.when(has_vec, F.col("embedding")).otherwise(F.coalesce("__made", "embedding"))).drop("__made"))
    lost = kept.groupBy(*KEY).agg(F.count_if(F.col("embedding").isNull()).alias("n_without_vector"),
                                  F.count_if(F.col("embedding").isNotNull() & vectors.is_zero_vector("embedding")).alias("n_zero_vector"))
    pts = kept if keep_zero_vectors else kept.filter(has_vec)
    pts = pts.withColumn("embedding", F.coalesce(F.col("embedding"), F.array().cast("array<float>")))
    assigned = dbscan(pts.select(*KEY, "review_id", "ord", "embedding"), eps, min_pts, "review_id", "embedding",
                      "ord", group_cols=KEY, block_size=block_size, window_col="week")
    in_cluster = assigned.filter(F.col("cluster_id") >= 0).select(*KEY, "review_id", "cluster_id") \
        .join(slim.select("product", "review_id", "__row"), ["product", "review_id"])
    members = materialize(pts.join(in_cluster, [*KEY, "review_id"]))
    # each text stands once, however many windows it is in
    clustered = materialize(members.select("__row").distinct())
    texts = materialize(texts.join(bounded_broadcast(clustered, MOST_ROW_NUMBERS), "__row", "left_semi"))
    sample = materialize(with_texts(materialize(nearest_to_centroid(members, CKEY, "ord", k=k)), texts))
    prompts = prompt_table(sample, CKEY)
    themes_raw = ingest_responses(prompts, responses, fallback_quotes(sample, CKEY), CKEY)
    if offline:
        own = offline_themes(with_texts(members, texts), CKEY, KEY, sample).select(*CKEY, F.struct(*THEME_FIELDS).alias("__own"))
        themes_raw = themes_raw.join(own, CKEY, "left").withColumns(
            {c: F.when(F.col("used_fallback") & F.col("__own").isNotNull(), F.col(f"__own.{c}")).otherwise(F.col(c)) for c in THEME_FIELDS}).drop("__own")

    quotes = themes_raw.select(*CKEY, F.posexplode("representative_quotes").alias("quote_ord", "quote"))
    checks, roll = validate_quotes(quotes, members.select(*CKEY, "review_id", "ord", "__row"),
                                   theme_cols=CKEY, match_cols=CKEY, texts=texts)
    themes = themes_raw.join(roll.select(*CKEY, "valid_quotes", "warnings"), CKEY, "left") \
        .withColumn("representative_quotes",
                    F.coalesce(F.col("valid_quotes"), F.array().cast("array<string>"))).drop("valid_quotes")
    themes = materialize(themes)  # one row per cluster
    per_week = collect_themes(themes, KEY)
    reports = todo.select(*KEY, "lookback_weeks").join(per_week, KEY, "left") \
        .withColumn("themes", F.coalesce(F.col("themes"), F.array()))
    reports = reports.join(skipped_empty.select(*KEY), KEY, "left_anti")
    reports = render_report(reports, "product", "week", "lookback_weeks", "themes", generated_on)

    existing = existing_sections if existing_sections is not None else \
        spark.createDataFrame([], "product string, header string")
    sections = plan_sections(reports.withColumn("doc_id", F.lit(doc_id)), existing)
    rec = recipients if recipients is not None else spark.createDataFrame([], "product string, pos long, recipient string")
    outbox = plan_outbox(render_email(sections, "product", "week", "themes", "section_url"), rec, environment)
    log_rows = sections.join(outbox.select(*KEY, "action"), KEY, "left").select(
        *KEY, F.lit(run_ts).alias("run_ts"), F.lit("SUCCESS").alias("status"),
        F.col("section_url").alias("doc_url"),
        F.when(F.col("skipped"), F.lit("skipped"))
         .otherwise(planned_mail_id(F.coalesce(F.col("action"), F.lit("draft")))).alias("mail_id"), "skipped")
    # a section that stands already was mailed by an earlier run: keep that id
    old = run_log if run_log is not None else spark.createDataFrame([], ", ".join(f"{c} string" for c in RUN_LOG_COLUMNS))
    log_rows = log_rows.join(old.select(*KEY, F.col("mail_id").alias("__old")), KEY, "left") \
        .withColumn("mail_id", F.when(F.col("skipped"), F.coalesce(F.nullif(F.col("__old"), F.lit("")), F.col("mail_id")))
                    .otherwise(F.col("mail_id"))).select(*RUN_LOG_COLUMNS)
    nothing = F.lit("")
    log_rows = log_rows.unionByName(skipped_empty.select(*KEY, F.lit(run_ts).alias("run_ts"), "status", nothing.alias("doc_url"), nothing.alias("mail_id")))
    valid = requests.filter(weeks.is_valid_week_key(F.col("week"))).select(*KEY).distinct()
    if stored_reports is None:
        kinds = ", ".join(f"{c} array<{THEME_STRUCT_SNAKE}>" if c == "themes" else f"{c} string" for c in REPORT_COLUMNS)
        stored_reports = spark.createDataFrame([], kinds)
    already_done = report_lookup(valid.join(todo.select(*KEY), KEY, "left_anti"), stored_reports, old)
    # One audit row per request joining every stage's counts
    cl = assigned.groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("n_clustered_points"),
        F.count_if(F.col("cluster_id") < 0).alias("n_noise"),
        (F.max("cluster_id") + 1).alias("n_clusters"))
    tok = prompts.groupBy(*KEY).agg(F.sum("estimated_tokens").alias("estimated_tokens"))
    qc = checks.groupBy(*KEY).agg(
        F.count_if(F.col("outcome") == "exact").alias("quotes_kept"),
        F.count_if(F.col("outcome") == "recovered").alias("quotes_modified"),
        F.count_if(F.col("outcome") == "discarded").alias("quotes_discarded"))
    subst = roll.groupBy(*KEY).agg(F.count_if("substituted").alias("quotes_substituted"))
    run_audit = audit.join(lost, KEY, "left").join(cl, KEY, "left").join(tok, KEY, "left").join(qc, KEY, "left") \
                     .join(subst, KEY, "left").fillna(0)
    return {"todo": todo, "audit": audit, "run_audit": run_audit, "skipped_empty": skipped_empty, "assignments": assigned,
            "sample": sample, "prompts": prompts, "themes": themes, "quote_checks": checks,
            "reports": reports, "already_done": already_done, "sections": sections, "outbox": outbox, "run_log_rows": log_rows,
            "failed_rows": todo.select(*KEY, F.lit(run_ts).alias("run_ts"), F.lit("FAILED").alias("status"), nothing.alias("doc_url"), nothing.alias("mail_id")),
            "quarantine": requests.filter(~F.coalesce(weeks.is_valid_week_key(F.col("week")), F.lit(False)))}


def _stored(spark: SparkSession, path: str) -> DataFrame | None:
    """The table at ``path``; None if there is none yet."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def current_run_log(spark: SparkSession, store_dir: str) -> DataFrame | None:
    """The run log that the newest pointer names; None before the first run."""
    base = store_dir.rstrip("/")
    pointers = _stored(spark, f"{base}/run_log_pointers")
    if pointers is None:
        return None
    return spark.read.parquet(f"{base}/run_log/{pointers.orderBy(F.desc('no')).first().snapshot}")


def commit_run(out: dict[str, DataFrame], store_dir: str, existing_log: DataFrame | None = None,
               snapshot: str | None = None) -> DataFrame:
    """Write one run: requests with an impossible week (quarantine), reports (K2, dynamic partition overwrite),
    sections with their text (K3), outbox rows with their mails (K4), and last a new run-log snapshot (K1, last
    write per key wins) with a pointer to it.  A section or mail that an earlier,
    perhaps broken-off, run has written is not written again.  A snapshot is
    never overwritten.  If a write fails, the run's weeks are logged as FAILED, so that the
    next run does them again, and the error is raised.  Returns the new run log."""
    base = store_dir.rstrip("/")
    if existing_log is None:
        existing_log = current_run_log(out["reports"].sparkSession, base)
    try:
        _write_results(out, base)
    except Exception:
        failed = out["failed_rows"]
        _write_log(failed, existing_log, base, snapshot)
        raise
    return _write_log(out["run_log_rows"], existing_log, base, snapshot)


def _write_results(out: dict[str, DataFrame], base: str) -> None:
    spark = out["reports"].sparkSession
    out["quarantine"].select(*KEY).write.mode("append").parquet(f"{base}/quarantine")
    rep = out["reports"].join(out["run_log_rows"].select(*KEY, "run_ts", "doc_url", "mail_id", "status"), KEY) \
        .select(*KEY, F.col("run_ts").alias("report_ts"), "doc_url", "mail_id", "status", "themes")
    write_reports(rep.select(*REPORT_COLUMNS), f"{base}/reports")
    for name, columns in (("sections", [*KEY, "header", "doc_id", "section_url", "report_text"]),
                          ("outbox", [*KEY, "header", "section_url", "subject", "email_text", "email_html", "to_field", "action", "is_draft"])):
        rows = out[name].filter(~F.col("skipped")) if name == "sections" else out[name]
        rows = rows.select(*[c for c in columns if c in rows.columns])
        have = _stored(spark, f"{base}/{name}")
        if have is not None:
            rows = materialize(rows.join(have.select("product", "header"), ["product", "header"], "left_anti"))
        rows.write.mode("append").parquet(f"{base}/{name}")


def _write_log(rows: DataFrame, existing_log: DataFrame | None, base: str, snapshot: str | None) -> DataFrame:
    """A new snapshot of the log with ``rows``, and a pointer to it."""
    spark = rows.sparkSession
    log = upsert_run_log(existing_log, rows) if existing_log is not None else rows
    snapshot = snapshot or uuid.uuid4().hex
    log.write.mode("error").parquet(f"{base}/run_log/{snapshot}")
    pointers = _stored(spark, f"{base}/run_log_pointers")
    no = pointers.count() if pointers is not None else 0
    spark.createDataFrame([(no, snapshot)], "no long, snapshot string").coalesce(1).write.mode("append").parquet(f"{base}/run_log_pointers")
    return spark.read.parquet(f"{base}/run_log/{snapshot}")
