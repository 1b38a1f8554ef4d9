"""Re-draft the teaser mail for a new stakeholder list.

F7 sanitise -> K6 replace list -> J9 eligible weeks (stored report with
themes) -> R2 render -> K4 outbox -> K5 patch the delivery id into the stored
report and, where the key exists, the run log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.render import render_email
from ..operators.reports import patch_mail_id, plan_outbox, planned_mail_id, redraft_eligible
from ..sources.stakeholders import split_recipients

DEFAULT_DOC_URL = "https://docs.example.com/document/d/doc-id/edit"


def redraft(recipient_lists: DataFrame, active: DataFrame, reports: DataFrame, run_log: DataFrame,
            environment: str = "development") -> dict[str, DataFrame]:
    cleaned = split_recipients(recipient_lists, "product", "recipients")
    weeks = redraft_eligible(active.select("product", "week"), reports)
    rep = reports.join(weeks, ["product", "week"], "left_semi") \
                 .withColumn("url", F.coalesce(F.nullif(F.col("doc_url"), F.lit("")), F.lit(DEFAULT_DOC_URL)))
    mails = render_email(rep, "product", "week", "themes", "url").withColumn("skipped", F.lit(False))
    outbox = plan_outbox(mails, cleaned, environment)
    ids = outbox.select("product", "week", planned_mail_id(F.col("action")).alias("mail_id"))
    log_ids = ids.join(run_log.select("product", "week"), ["product", "week"], "left_semi")
    return {"stakeholders": cleaned, "outbox": outbox, "reports": patch_mail_id(reports, ids),
            "run_log": patch_mail_id(run_log, log_ids)}
