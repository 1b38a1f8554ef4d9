"""Report store / run log round trips (S3, S4, K1, K2, K6), the weekly job's
idempotency, and the landing stream (X1)."""

import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from reviewloom.functions.weeks import iso_week_key
from reviewloom.operators.embed import model_embedder
from reviewloom.operators.reports import (default_week, parse_run_log, read_reports, read_run_log, replace_stakeholders,
                                          upsert_run_log, write_reports)
from reviewloom.plans.weekly import weekly_feedback
from reviewloom.sources.raw import raw_rows_from_documents
from reviewloom.sources.stakeholders import split_recipients
from reviewloom.sources.tables import reviews_view, table
from reviewloom.streaming.landing import landing_stream, weekly_counts

from .conftest import SF_SMALL


def _scratch():
    return tempfile.mkdtemp(prefix="reviewloom-test-", dir="/tmp")


def test_read_reports_defaults_and_corrupt(spark):
    d = _scratch()
    good = {"week": "2026-W21", "timestamp": "2026-05-25T10:00:00.000Z", "docUrl": "https://docs.example.com/d/1",
            "gmailId": "r123", "status": "SUCCESS",
            "themes": [{"themeName": "A", "themeDescription": "B", "representativeQuotes": ["q"], "actionIdeas": []}]}
    bare = {"week": "2026-W22", "themes": []}
    with open(os.path.join(d, "app_2026-W21.json"), "w") as f:
        json.dump(good, f, indent=2)
    with open(os.path.join(d, "app_2026-W22.json"), "w") as f:
        json.dump(bare, f, indent=2)
    with open(os.path.join(d, "app_2026-W23.json"), "w") as f:
        f.write("{not json")
    rows = {r.week: r for r in read_reports(spark, d, "2026-06-01T00:00:00.000Z").collect()}
    assert set(rows) == {"2026-W21", "2026-W22"}
    assert rows["2026-W21"].themes[0].theme_name == "A" and rows["2026-W21"].product == "app"
    b = rows["2026-W22"]
    assert (b.report_ts, b.doc_url, b.mail_id, b.status) == ("2026-06-01T00:00:00.000Z", "", "", "SUCCESS")


def test_run_log_parse_and_upsert(spark):
    d = _scratch()
    log = {"app:2031-W07": {"timestamp": "2031-02-17T00:00:01.000Z", "status": "SUCCESS",
                            "docUrl": "https://docs.example.com/d/1/edit",
                            "gmailId": "{\"status\":\"success\",\"draft_id\":\"r1\"}"},
           "app:2031-W09": {"timestamp": "2031-03-03T00:00:02.000Z", "status": "SUCCESS", "docUrl": "", "gmailId": "x"}}
    with open(os.path.join(d, "run_log.json"), "w") as f:
        json.dump(log, f, indent=2)
    lg = read_run_log(spark, os.path.join(d, "run_log.json"))
    assert sorted(r.week for r in lg.collect()) == ["2031-W07", "2031-W09"]
    assert parse_run_log(spark.createDataFrame([("{bad",)], "value string")).count() == 0
    new = spark.createDataFrame([("app", "2031-W09", "2031-03-04T00:00:00.000Z", "FAILED", "", "")],
                                "product string, week string, run_ts string, status string, doc_url string, mail_id string")
    up = {r.week: r.status for r in upsert_run_log(lg, new).collect()}
    assert up == {"2031-W07": "SUCCESS", "2031-W09": "FAILED"}


def test_write_reports_and_stakeholders(spark):
    d = _scratch()
    rep = spark.createDataFrame([("app", "2026-W21", "t", "u", "g", "SUCCESS")],
                                "product string, week string, report_ts string, doc_url string, mail_id string, status string") \
        .withColumn("themes", F.array().cast("array<struct<theme_name:string>>"))
    write_reports(rep, os.path.join(d, "reports"))
    back = spark.read.parquet(os.path.join(d, "reports"))
    assert back.filter("week = '2026-W21' AND product = 'app'").count() == 1
    lists = spark.createDataFrame([("app", " a@x.org , ,bad, b@y.org ")], "product string, recipients string")
    clean = split_recipients(lists, "product", "recipients")
    replace_stakeholders(clean, os.path.join(d, "stakeholders"))
    assert [r.recipient for r in spark.read.parquet(os.path.join(d, "stakeholders")).orderBy("pos").collect()] == \
        ["a@x.org", "b@y.org"]


def test_weekly_job_idempotent(spark):
    r = reviews_view(spark, SF_SMALL, with_embedding=True)
    req = r.select("product", iso_week_key("review_ts").alias("week")).distinct().withColumn("lookback_weeks", F.lit(10))
    first = weekly_feedback(r, req, eps=1.14)
    log = first["run_log_rows"]
    sections = first["sections"].filter(~F.col("skipped")).select("product", "header")
    assert log.count() == first["reports"].count() > 0
    second = weekly_feedback(r, req, eps=1.14, run_log=log, existing_sections=sections)
    assert second["todo"].count() == 0 and second["outbox"].count() == 0
    forced = weekly_feedback(r, req.withColumn("force", F.lit(True)), eps=1.14, run_log=log, existing_sections=sections)
    assert forced["sections"].filter(~F.col("skipped")).count() == 0  # headers already present


def test_landing_stream(spark):
    d = _scratch()
    land = os.path.join(d, "landing")
    raw = raw_rows_from_documents(table(spark, SF_SMALL, "documents", "doc_id", "text", "source"))
    raw.write.parquet(land)
    s = weekly_counts(landing_stream(spark, land, "app", "2024-06-01 00:00:00"))
    q = s.writeStream.outputMode("complete").format("memory").queryName("landing_counts") \
         .option("checkpointLocation", os.path.join(d, "ckpt")).trigger(availableNow=True).start()
    q.awaitTermination(300)
    got = spark.table("landing_counts").agg(F.sum("n_reviews")).first()[0]
    from reviewloom.functions.text import word_count
    from reviewloom.sources.raw import normalize_raw_reviews
    want = normalize_raw_reviews(raw, "app", "2024-06-01 00:00:00").filter(word_count("content") >= 8) \
        .count()
    assert got == want


def test_model_embedder_zero_for_blank(spark):
    import numpy as np

    def make_model():
        def encode(texts):
            return np.array([[len(t), 1.0, 0.0] for t in texts])
        return encode

    df = spark.createDataFrame([("abc",), ("",), ("   ",)], "content string")
    out = [r.embedding for r in model_embedder(df, make_model, 3).collect()]
    assert abs(sum(x * x for x in out[0]) - 1.0) < 1e-12 and out[1] == [0.0] * 3 and out[2] == [0.0] * 3


def test_commit_run_writes_report_outbox_log(spark):
    from reviewloom.plans.weekly import commit_run, current_run_log
    d = _scratch()
    r = reviews_view(spark, SF_SMALL, with_embedding=True)
    req = r.select("product", iso_week_key("review_ts").alias("week")).distinct() \
           .withColumn("lookback_weeks", F.lit(10)).limit(3)
    rec = spark.createDataFrame([("en", 0, "a@example.org"), ("fr", 0, "b@example.org")],
                                "product string, pos long, recipient string")
    out = weekly_feedback(r, req, eps=1.14, recipients=rec)
    log = commit_run(out, d)
    reports = spark.read.parquet(os.path.join(d, "reports"))
    assert reports.count() == out["reports"].count() == log.count() > 0
    mails = spark.read.parquet(os.path.join(d, "outbox"))
    n = mails.count()
    assert n == out["outbox"].count()
    sections = spark.read.parquet(os.path.join(d, "sections"))
    assert sections.filter("report_text is not null").count() == log.count()
    ids = {(x.product, x.week): x.mail_id for x in log.collect()}
    assert {v for (p, _), v in ids.items() if p in ("de", "es")} <= {"skipped-no-recipients"}
    again = commit_run(weekly_feedback(r, req, eps=1.14, run_log=log), d)  # nothing new to do
    assert {(x.product, x.week): x.mail_id for x in again.collect()} == ids
    forced = weekly_feedback(r, req.withColumn("force", F.lit(True)), eps=1.14, run_log=again, recipients=rec,
                             existing_sections=spark.read.parquet(os.path.join(d, "sections")).select("product", "header"))
    last = commit_run(forced, d)
    assert {(x.product, x.week): x.mail_id for x in last.collect()} == ids
    assert spark.read.parquet(os.path.join(d, "outbox")).count() == n
    assert spark.read.parquet(os.path.join(d, "sections")).count() == len(ids)
    assert current_run_log(spark, d).count() == len(ids)


def test_failed_commit_offline_themes_and_done_requests(spark):
    from reviewloom.plans.weekly import commit_run, current_run_log
    d = _scratch()
    r = reviews_view(spark, SF_SMALL, with_embedding=True)
    req = r.select("product", iso_week_key("review_ts").alias("week")).distinct().filter("product = 'en'").withColumn("lookback_weeks", F.lit(10))
    rec = spark.createDataFrame([("en", 0, "a@example.org")], "product string, pos long, recipient string")
    out = weekly_feedback(r, req.unionByName(spark.createDataFrame([("en", "2024-W99", 1)], "product string, week string, lookback_weeks int")),
                          eps=1.14, recipients=rec, offline=True)
    names = [t.theme_name for x in out["reports"].collect() for t in x.themes]
    assert names and "Uncategorized Issues" not in names
    mails = out["outbox"].collect()
    assert mails and all(x.subject.endswith(x.week) and x.section_url in x.email_text and x.email_html.startswith("<div>") for x in mails)
    # a write that fails is logged, and its weeks are done again
    broken = dict(out, reports=out["reports"].withColumn("themes", F.when(F.length("week") > 0, F.raise_error(F.lit("disk full"))).otherwise(F.col("themes"))))
    with pytest.raises(Exception, match="disk full"):
        commit_run(broken, d)
    log = current_run_log(spark, d)
    assert {x.status for x in log.collect()} == {"FAILED"} and log.count() == out["todo"].count()
    assert weekly_feedback(r, req, eps=1.14, run_log=log)["todo"].count() == log.count()
    log = commit_run(out, d)
    assert {x.status for x in log.collect()} <= {"SUCCESS", "SKIPPED_EMPTY"}
    assert {x.week for x in spark.read.parquet(os.path.join(d, "quarantine")).collect()} == {"2024-W99"}
    # what is done comes back with what is stored of it
    stored = spark.read.parquet(os.path.join(d, "reports"))
    done = weekly_feedback(r, req, eps=1.14, run_log=log, stored_reports=stored)["already_done"].collect()
    themes = {x.week: len(x.themes) for x in out["reports"].collect()}
    assert {x.week: len(x.themes) for x in done} == themes and all(x.doc_url and x.mail_id for x in done)


def test_requests_are_checked(spark):
    r = reviews_view(spark, SF_SMALL, with_embedding=True)
    two = spark.createDataFrame([("en", "2024-W05", 1), ("en", "2024-W05", 2)], "product string, week string, lookback_weeks int")
    with pytest.raises(ValueError, match="look-back"):
        weekly_feedback(r, two, eps=1.14)
    bad = spark.createDataFrame([("en", "2024-W54", 1), ("en", "2024W05", 1)], "product string, week string, lookback_weeks int")
    out = weekly_feedback(r, bad, eps=1.14)
    assert out["quarantine"].count() == 2 and out["todo"].count() == 0


def test_report_names_and_default_week(spark):
    d = _scratch()
    with open(os.path.join(d, "my_app_2026-W21.json"), "w") as f:
        json.dump({"week": "2026-W21", "themes": []}, f)
    row, = read_reports(spark, d, "now").collect()
    assert (row.product, row.week) == ("my_app", "2026-W21")
    listing = spark.createDataFrame([("a", "2024-W01"), ("a", "2024-W02")], "product string, week string")
    choice = spark.createDataFrame([("a", "", "2024-W01")], "product string, forced_week string, active_week string")
    assert default_week(listing, choice).first().selected_week == "2024-W01"
    assert read_run_log(spark, os.path.join(d, "none.json")).count() == 0
