"""Small presentation rules: token estimate, delivery ids, status labels,
section headers and links."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import utf16_length

# Fixed values used in rendered text and status labels.
DOC_STATUS_OK = "Success / Updated"
DOC_STATUS_MISSING = "Not Created"
MAIL_STATUS_DRAFT = "Draft Created"
MAIL_STATUS_NONE = "Not Sent / Skipped"
DEFAULT_TITLE = "Weekly Review Pulse"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def token_estimate(prompt, reviews_text) -> Column:
    """ceil((len(prompt) + len(reviews)) / 4) + 500, lengths in UTF-16 units."""
    return (F.ceil((utf16_length(prompt) + utf16_length(reviews_text)) / F.lit(4)) + F.lit(500)).cast("long")


def draft_id(mail_id) -> Column:
    """JSON ``draft_id``, else ``draftId``, else the raw string (non-JSON text
    yields NULL from get_json_object, never an error)."""
    g = _c(mail_id)
    return F.coalesce(F.nullif(F.get_json_object(g, "$.draft_id"), F.lit("")),
                      F.nullif(F.get_json_object(g, "$.draftId"), F.lit("")), g)


def delivery_error(mail_id) -> Column:
    """True when the stored delivery result is an error object."""
    g = _c(mail_id)
    return F.coalesce((F.get_json_object(g, "$.status") == F.lit("error"))
                      | F.get_json_object(g, "$.error").isNotNull(), F.lit(False))


def short_id(raw) -> Column:
    r = _c(raw)
    return F.when(F.length(r) > 15, F.concat(F.substring(r, 1, 12), F.lit("..."))).otherwise(r)


def doc_status(doc_url) -> Column:
    return F.when(F.coalesce(_c(doc_url), F.lit("")) != "", F.lit(DOC_STATUS_OK)).otherwise(F.lit(DOC_STATUS_MISSING))


def mail_status(mail_id) -> Column:
    g = F.coalesce(_c(mail_id), F.lit(""))
    return F.when(g != "", F.concat(F.lit(MAIL_STATUS_DRAFT + " (ID: "), short_id(draft_id(g)), F.lit(")"))) \
            .otherwise(F.lit(MAIL_STATUS_NONE))


def section_header(product_title, week) -> Column:
    """``{Product} — Weekly Review Pulse ({week})``."""
    return F.format_string("%s — " + DEFAULT_TITLE + " (%s)", _c(product_title), _c(week))


def section_url(doc_id, week) -> Column:
    """Link used when the document service returns no heading link."""
    return F.format_string("https://docs.example.com/document/d/%s/edit#heading=h.section-%s",
                           F.coalesce(F.nullif(_c(doc_id), F.lit("")), F.lit("doc-id")), F.lower(_c(week)))


def doc_edit_url(doc_id) -> Column:
    return F.format_string("https://docs.example.com/document/d/%s/edit", _c(doc_id))
