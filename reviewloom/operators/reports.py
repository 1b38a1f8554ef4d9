"""Report store, run log and delivery tables.

Stored state is three tables keyed by (product, week): ``reports`` (themes as
ARRAY<STRUCT>), ``run_log`` and ``sections``/``outbox`` for delivery.  Every
operation is a join or window over those keys; nothing is read row by row.
Writes go report -> outbox -> run log, so a log row implies a report, and
each writer targets a fresh snapshot directory (Spark cannot overwrite a path
it is reading).
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.display import doc_edit_url, section_header, section_url
from ..functions.weeks import run_key_product, run_key_week

# Field names of the stored run-log and report JSON documents.
LOG_ENTRY = "struct<timestamp:string,status:string,docUrl:string,gmailId:string>"
THEME_STRUCT = ("struct<themeName:string,themeDescription:string,representativeQuotes:array<string>,"
                "actionIdeas:array<string>>")
REPORT_JSON_SCHEMA = f"week string, timestamp string, docUrl string, gmailId string, status string, themes array<{THEME_STRUCT}>"
REPORT_FILE = r"^(.+)_(\d{4}-W\d{2})\.json$"  # the product may hold underscores itself
RUN_LOG_COLUMNS = ["product", "week", "run_ts", "status", "doc_url", "mail_id"]
REPORT_COLUMNS = ["product", "week", "report_ts", "doc_url", "mail_id", "status", "themes"]


# ---------------------------------------------------------------- S3 / S4

def read_reports(spark: SparkSession, path: str, now: str) -> DataFrame:
    """S3: every ``{product}_{week}.json`` under ``path``; unparsable files are
    skipped (PERMISSIVE + corrupt-record filter), defaults applied."""
    schema = REPORT_JSON_SCHEMA + ", _corrupt_record string"
    raw = spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE") \
        .option("columnNameOfCorruptRecord", "_corrupt_record").json(path) \
        .withColumn("__file", F.col("_metadata.file_name"))
    ok = raw.filter(F.col("_corrupt_record").isNull()) \
            .filter(F.col("__file").rlike(REPORT_FILE))
    return ok.select(
        F.regexp_extract("__file", REPORT_FILE, 1).alias("product"),
        F.regexp_extract("__file", REPORT_FILE, 2).alias("week"),
        F.coalesce(F.nullif(F.col("timestamp"), F.lit("")), F.lit(now)).alias("report_ts"),
        F.coalesce(F.col("docUrl"), F.lit("")).alias("doc_url"),
        F.coalesce(F.col("gmailId"), F.lit("")).alias("mail_id"),
        F.coalesce(F.nullif(F.col("status"), F.lit("")), F.lit("SUCCESS")).alias("status"),
        F.transform(F.coalesce(F.col("themes"), F.array()), lambda t: F.struct(
            t["themeName"].alias("theme_name"), t["themeDescription"].alias("theme_description"),
            t["representativeQuotes"].alias("representative_quotes"),
            t["actionIdeas"].alias("action_ideas"))).alias("themes"))


def parse_run_log(text_df: DataFrame, text_col: str = "value") -> DataFrame:
    """JSON object ``{"product:week": {...}}`` -> one row per key.
    Unparsable text yields no rows (from_json on a map gives NULL)."""
    m = text_df.select(F.from_json(F.col(text_col), f"map<string,{LOG_ENTRY}>").alias("m"))
    e = m.select(F.explode("m").alias("k", "v"))
    return e.select(run_key_product("k").alias("product"), run_key_week("k").alias("week"),
                    F.col("v.timestamp").alias("run_ts"), F.col("v.status").alias("status"),
                    F.coalesce(F.col("v.docUrl"), F.lit("")).alias("doc_url"),
                    F.coalesce(F.col("v.gmailId"), F.lit("")).alias("mail_id"))


def read_run_log(spark: SparkSession, path: str) -> DataFrame:
    try:
        txt = spark.read.text(path, wholetext=True)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":  # any other failure must not read as "no runs"
            raise
        txt = spark.createDataFrame([], "value string")
    return parse_run_log(txt)


# ---------------------------------------------------------------- K1 / K2 / K5 / K6

def upsert_run_log(existing: DataFrame, new: DataFrame) -> DataFrame:
    """K1: last write per (product, week) wins (latest run_ts; new rows win ties)."""
    u = existing.select(*RUN_LOG_COLUMNS).withColumn("__src", F.lit(0)) \
        .unionByName(new.select(*RUN_LOG_COLUMNS).withColumn("__src", F.lit(1)))
    w = Window.partitionBy("product", "week").orderBy(F.desc("run_ts"), F.desc("__src"))
    return u.withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").drop("__rn", "__src")


def write_reports(reports: DataFrame, path: str) -> None:
    """K2: one document per (product, week); dynamic partition overwrite
    replaces only the weeks being written."""
    reports.select(*REPORT_COLUMNS).write.mode("overwrite") \
        .option("partitionOverwriteMode", "dynamic").partitionBy("product", "week").parquet(path)


def patch_mail_id(table: DataFrame, updates: DataFrame) -> DataFrame:
    """K5: set mail_id for the updated (product, week) keys, others untouched."""
    u = updates.select("product", "week", F.col("mail_id").alias("__new"))
    return table.join(u, ["product", "week"], "left") \
                .withColumn("mail_id", F.coalesce(F.col("__new"), F.col("mail_id"))).drop("__new")


def replace_stakeholders(cleaned: DataFrame, path: str) -> None:
    """K6: the sanitised list replaces the stored one."""
    cleaned.write.mode("overwrite").parquet(path)


# ---------------------------------------------------------------- K3 / K4

def plan_sections(new_reports: DataFrame, existing_sections: DataFrame, doc_id_col: str = "doc_id") -> DataFrame:
    """K3: idempotent append.  A section is skipped when the document already
    holds its header; otherwise it is appended with its section link."""
    hdr = section_header(F.col("product"), F.col("week"))
    n = new_reports.withColumn("header", hdr)
    have = existing_sections.select("product", "header").distinct().withColumn("__have", F.lit(True))
    j = n.join(have, ["product", "header"], "left")
    skipped = F.coalesce(F.col("__have"), F.lit(False))
    return j.withColumn("skipped", skipped) \
            .withColumn("section_url", F.when(skipped, doc_edit_url(F.col(doc_id_col)))
                        .otherwise(section_url(F.col(doc_id_col), F.col("week")))).drop("__have")


def plan_outbox(sections: DataFrame, recipients: DataFrame, environment: str, can_send: bool = True) -> DataFrame:
    """K4: one mail per non-skipped section; recipients joined by ", " in list
    order; no recipients -> skipped-no-recipients; production sends (or
    drafts when sending is unsupported); other environments draft."""
    to = recipients.groupBy("product").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "recipient"))),
                                 lambda s: s["recipient"]), ", ").alias("to_field"),
        F.count(F.lit(1)).alias("n_recipients"))
    s = sections.filter(~F.col("skipped")).join(to, "product", "left")
    n = F.coalesce(F.col("n_recipients"), F.lit(0))
    action = F.when(n == 0, F.lit("skipped-no-recipients")) \
              .when(F.lit(environment == "production") & F.lit(can_send), F.lit("send")).otherwise(F.lit("draft"))
    return s.withColumn("to_field", F.coalesce(F.col("to_field"), F.lit(""))).withColumn("action", action) \
            .withColumn("is_draft", F.col("action") == "draft")


def planned_mail_id(action: Column) -> Column:
    """Delivery id of a planned mail; without recipients no mail exists."""
    return F.when(action == "skipped-no-recipients", action).otherwise(F.concat(F.lit("mock-"), action, F.lit("-id")))


# ---------------------------------------------------------------- J6-J9, U1, W7, W8

def log_only_weeks(run_log: DataFrame, reports: DataFrame) -> DataFrame:
    """J6 + F6: successful log entries with no stored report."""
    return run_log.filter(F.col("status") == "SUCCESS").join(reports.select("product", "week"),
                                                             ["product", "week"], "left_anti")


def report_listing(reports: DataFrame, run_log: DataFrame) -> DataFrame:
    """U1 + W7: stored reports plus successful log-only weeks, newest first."""
    a = reports.select("product", "week", F.col("report_ts").alias("ts"), "doc_url", "mail_id", "status",
                       F.lit("report").alias("source"))
    b = log_only_weeks(run_log, reports).select("product", "week", F.col("run_ts").alias("ts"), "doc_url",
                                                "mail_id", "status", F.lit("log").alias("source"))
    return a.unionByName(b).orderBy(F.col("product"), F.desc("week"))


def report_lookup(requests: DataFrame, reports: DataFrame, run_log: DataFrame) -> DataFrame:
    """Stored report, else the log entry with empty themes, else missing."""
    r = reports.select("product", "week", F.col("report_ts").alias("r_ts"), F.col("doc_url").alias("r_url"),
                       F.col("mail_id").alias("r_gid"), F.col("status").alias("r_status"), "themes")
    g = run_log.select("product", "week", F.col("run_ts").alias("l_ts"), F.col("doc_url").alias("l_url"),
                       F.col("mail_id").alias("l_gid"), F.col("status").alias("l_status"))
    j = requests.select("product", "week").join(r, ["product", "week"], "left").join(g, ["product", "week"], "left")
    src = F.when(F.col("r_status").isNotNull(), F.lit("report")) \
           .when(F.col("l_status").isNotNull(), F.lit("log")).otherwise(F.lit("missing"))
    return j.select("product", "week", src.alias("source"),
                    F.coalesce("r_ts", "l_ts").alias("ts"), F.coalesce("r_url", "l_url").alias("doc_url"),
                    F.coalesce("r_gid", "l_gid").alias("mail_id"), F.coalesce("r_status", "l_status").alias("status"),
                    F.when(src == "missing", F.lit(None)).otherwise(
                        F.coalesce(F.col("themes"), F.array().cast(f"array<{THEME_STRUCT_SNAKE}>"))).alias("themes"))


THEME_STRUCT_SNAKE = ("struct<theme_name:string,theme_description:string,representative_quotes:array<string>,"
                      "action_ideas:array<string>>")


def runs_to_do(requests: DataFrame, run_log: DataFrame) -> DataFrame:
    """Requests without a SUCCESS log entry, plus forced ones."""
    done = run_log.filter(F.col("status") == "SUCCESS").select("product", "week")
    fresh = requests.join(done, ["product", "week"], "left_anti")
    forced = requests.filter(F.col("force"))
    return fresh.unionByName(forced).distinct()


def redraft_eligible(active: DataFrame, reports: DataFrame) -> DataFrame:
    """Active weeks whose stored report has at least one theme."""
    ok = reports.filter(F.size(F.col("themes")) > 0).select("product", "week")
    return active.join(ok, ["product", "week"], "left_semi")


def default_week(listing: DataFrame, choices: DataFrame) -> DataFrame:
    """Per product, the forced week, else the active one, else the newest;
    a choice not present in the listing falls back to the newest."""
    newest = listing.groupBy("product").agg(F.max("week").alias("newest"))
    present = listing.select("product", F.col("week").alias("__w")).distinct()
    c = choices.select("product", F.coalesce(F.nullif(F.col("forced_week"), F.lit("")), F.col("active_week")).alias("__w"))
    c = c.join(present, ["product", "__w"], "left_semi")
    return newest.join(c, "product", "left").select(
        "product", F.coalesce(F.col("__w"), F.col("newest")).alias("selected_week"))
