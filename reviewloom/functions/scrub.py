"""PII redaction and prompt-injection neutralising as column expressions.

``scrub_columns`` applies e-mail -> phone -> id redaction and then the six
injection rules, each step on the previous step's output, exactly in that
order.  ``pii_removed`` is set by the three PII steps only;
``injection_neutralized`` by the injection rules.  All steps are
``regexp_replace``/``rlike`` in one projection (no UDF), so the scrub runs
inside the scan stage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import BOUND_AFTER, BOUND_BEFORE, JS_WS

# ---------------------------------------------------------------------------
# The redaction rules and replacement tokens the output must
# reproduce, written in their original (JavaScript) regex spelling.
#   e-mail : [a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}        (g, i)
#   phone  : (\+91[\-\s]?)?[6-9]\d{9}\b|\b\d{10}\b                  (g)
#   id     : \b(cust|acc|user|id|ref)[\s\-_:]*([a-zA-Z0-9]{6,15})\b (g, i)
#   injection (g, i), applied in this order:
#     ignore\s+(any\s+)?(previous\s+)?instructions
#     you\s+must\s+now\s+forget
#     act\s+as\s+a
#     system\s+prompt
#     override\s+rules
#     instead\s+of\s+summarizing
EMAIL_TOKEN = "[REDACTED_EMAIL]"
PHONE_TOKEN = "[REDACTED_PHONE]"
ID_TOKEN = "[REDACTED_ID]"
INJECTION_TOKEN = "[REDACTED_INSTRUCTION_OVERRIDE]"
# ---------------------------------------------------------------------------

_S = f"[{JS_WS}]"           # JavaScript \s
_SDASH = f"[{JS_WS}\\-]"     # [\-\s]
_IDSEP = f"[{JS_WS}\\-_:]"   # [\s\-_:]

_INJECTION_WORDS = [
    ("ignore", "(any{s})?(previous{s})?instructions"),
    ("you", "must{s}now{s}forget"),
    ("act", "as{s}a"),
    ("system", "prompt"),
    ("override", "rules"),
    ("instead", "of{s}summarizing"),
]


def _injection(ws: str) -> list[str]:
    out = []
    for head, tail in _INJECTION_WORDS:
        s_plus = ws + "+"
        out.append("(?i)" + head + s_plus + tail.format(s=s_plus))
    return out


# Java (Spark) spellings: ASCII boundaries as lookarounds, ASCII digits.  A
# leading lookahead on the possible first characters lets the matcher reject
# most positions with one class test (same matches, no change in meaning).
EMAIL_RE = "(?i)[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\\.[a-zA-Z]{2,}"
PHONE_RE = (f"(?=[+0-9])(?:(\\+91{_SDASH}?)?[6-9][0-9]{{9}}{BOUND_AFTER}"
            f"|{BOUND_BEFORE}[0-9]{{10}}{BOUND_AFTER})")
ID_RE = f"(?i)(?=[cauir]){BOUND_BEFORE}(cust|acc|user|id|ref){_IDSEP}*([a-zA-Z0-9]{{6,15}}){BOUND_AFTER}"
INJECTION_RES = _injection(_S)

# RE2 (DuckDB oracle) spellings: RE2's \b and \d are already ASCII-only.
SQL_EMAIL_RE = EMAIL_RE
SQL_PHONE_RE = f"(\\+91{_SDASH}?)?[6-9]\\d{{9}}\\b|\\b\\d{{10}}\\b"
SQL_ID_RE = f"(?i)\\b(cust|acc|user|id|ref){_IDSEP}*([a-zA-Z0-9]{{6,15}})\\b"
SQL_INJECTION_RES = _injection(_S)


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


# Cheap exact pre-conditions: a rule can only match when its literal part is
# present (an '@', ten ASCII digits in a row, the rule's first word in any
# ASCII case).  Texts failing them skip the backtracking regex entirely.
def _may_email(c: Column) -> Column:
    return F.instr(c, "@") > 0


def _may_phone(c: Column) -> Column:
    return c.rlike("[0-9]{10}")


def _may_injection(c: Column, i: int) -> Column:
    return F.instr(F.lower(c), _INJECTION_WORDS[i][0]) > 0


def _guarded(c: Column, cond: Column, pat: str, token: str) -> Column:
    return F.when(cond, F.regexp_replace(c, pat, token)).otherwise(c)


def scrub_email(col) -> Column:
    c = _c(col)
    return _guarded(c, _may_email(c), EMAIL_RE, EMAIL_TOKEN)


def scrub_phone(col) -> Column:
    c = _c(col)
    return _guarded(c, _may_phone(c), PHONE_RE, PHONE_TOKEN)


def scrub_id(col) -> Column:
    return F.regexp_replace(_c(col), ID_RE, ID_TOKEN)


def scrub_injection(col) -> Column:
    out = _c(col)
    for i, pat in enumerate(INJECTION_RES):
        out = _guarded(out, _may_injection(out, i), pat, INJECTION_TOKEN)
    return out


def scrub_columns(df: DataFrame, text_col: str = "content", out_col: str = "content_scrubbed",
                  pii_col: str = "pii_removed", inj_col: str = "injection_neutralized") -> DataFrame:
    """Add the scrubbed text and the two flags.

    Each step is materialised as its own column so that the flag of step k
    tests the output of step k-1, as the sequential rule requires; Catalyst
    collapses the projections into a single codegen'd Project."""
    t0 = F.coalesce(F.col(text_col), F.lit(""))
    df = df.withColumn("__s0", t0)
    # A replacement always changes the text (no token can equal a match), so
    # "rule k matched" == "step k changed its input": one regex pass per rule.
    df = df.withColumn("__s1", scrub_email("__s0")).withColumn("__f_email", F.col("__s1") != F.col("__s0"))
    df = df.withColumn("__s2", scrub_phone("__s1")).withColumn("__f_phone", F.col("__s2") != F.col("__s1"))
    df = df.withColumn("__s3", scrub_id("__s2")).withColumn("__f_id", F.col("__s3") != F.col("__s2"))
    # Inserted tokens hold no head word followed by whitespace, so the head
    # words can be looked up once, in the text before the injection steps.
    df = df.withColumn("__low", F.lower("__s3"))
    prev = "__s3"
    inj_flags = []
    for i, pat in enumerate(INJECTION_RES):
        may = F.instr(F.col("__low"), _INJECTION_WORDS[i][0]) > 0
        df = df.withColumn(f"__si{i}", _guarded(F.col(prev), may, pat, INJECTION_TOKEN))
        inj_flags.append(F.col(f"__si{i}") != F.col(prev))
        prev = f"__si{i}"
    inj = inj_flags[0]
    for f in inj_flags[1:]:
        inj = inj | f
    df = df.withColumn(out_col, F.col(prev)) \
           .withColumn(pii_col, F.col("__f_email") | F.col("__f_phone") | F.col("__f_id")) \
           .withColumn(inj_col, inj)
    return df.drop(*[c for c in df.columns if c.startswith("__")])


# ---- SQL (DuckDB) spellings for the oracle ----

def _sql_re(fn: str, expr: str, pat: str, token: str | None = None) -> str:
    pat_sql = pat.replace("'", "''")
    if fn == "replace":
        return f"regexp_replace({expr}, '{pat_sql}', '{token}', 'g')"
    return f"regexp_matches({expr}, '{pat_sql}')"


def sql_scrub_steps(expr: str) -> dict[str, str]:
    """Return SQL expressions for every intermediate of the sequential scrub."""
    s0 = f"coalesce({expr}, '')"
    s1 = _sql_re("replace", s0, SQL_EMAIL_RE, EMAIL_TOKEN)
    s2 = _sql_re("replace", s1, SQL_PHONE_RE, PHONE_TOKEN)
    s3 = _sql_re("replace", s2, SQL_ID_RE, ID_TOKEN)
    flags_pii = [_sql_re("match", s0, SQL_EMAIL_RE), _sql_re("match", s1, SQL_PHONE_RE),
                 _sql_re("match", s2, SQL_ID_RE)]
    cur = s3
    inj_flags = []
    for pat in SQL_INJECTION_RES:
        inj_flags.append(_sql_re("match", cur, pat))
        cur = _sql_re("replace", cur, pat, INJECTION_TOKEN)
    return {
        "email": s1, "phone": s2, "id": s3, "scrubbed": cur,
        "pii_removed": "(" + " OR ".join(flags_pii) + ")",
        "injection_neutralized": "(" + " OR ".join(inj_flags) + ")",
        "email_hit": flags_pii[0], "phone_hit": flags_pii[1], "id_hit": flags_pii[2],
    }
