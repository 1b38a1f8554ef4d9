"""Recipient lists.

A recipient list is one comma-separated string; it is split, each entry
trimmed with JavaScript whitespace rules, empties dropped, and (F7) entries
without ``@`` dropped.  Position is the entry's index in the raw list, so
``array_join`` in position order rebuilds the ``", "``-joined To: field.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scrub import EMAIL_RE
from ..functions.text import WS_CLASS, js_trim, sql_js_trim


def split_recipients(df: DataFrame, key_col: str, list_col: str, require_at: bool = True) -> DataFrame:
    parts = df.select(key_col, F.posexplode(F.split(F.coalesce(F.col(list_col), F.lit("")), ",")).alias("pos", "raw"))
    out = parts.select(key_col, F.col("pos").cast("long").alias("pos"), js_trim("raw").alias("recipient"))
    out = out.filter(F.length("recipient") > 0)
    if require_at:
        out = out.filter(F.col("recipient").contains("@"))
    return out


def recipient_strings_from_documents(docs: DataFrame) -> DataFrame:
    """Per document: the addresses it mentions plus its source tag and a blank
    entry, joined with ' , ' (exercises trimming, empties and the @ rule)."""
    emails = F.regexp_extract_all(F.col("text"), F.lit(f"({EMAIL_RE})"), 1)
    return docs.select(F.col("doc_id").alias("product"),
                       F.concat_ws(" , ", F.concat(emails, F.array(F.col("lang"), F.lit(" ")))).alias("recipients"))


SQL_STAKEHOLDER_CTES = f"""
src AS (
  SELECT doc_id AS product,
         array_to_string(list_concat(regexp_extract_all(text, '({EMAIL_RE})', 1), [lang, chr(160)]), ' , ') AS recipients
  FROM documents),
parts AS (SELECT product, string_split(recipients, ',') AS p FROM src),
u AS (SELECT product, unnest(p) AS raw, unnest(generate_series(0, len(p) - 1)) AS pos FROM parts)"""
SQL_STAKEHOLDERS = "WITH " + SQL_STAKEHOLDER_CTES.strip() + f"""
SELECT product, CAST(pos AS BIGINT) AS pos, {sql_js_trim('raw')} AS recipient FROM u
WHERE length({sql_js_trim('raw')}) > 0 AND contains({sql_js_trim('raw')}, '@')
"""

__all__ = ["split_recipients", "recipient_strings_from_documents", "WS_CLASS"]
