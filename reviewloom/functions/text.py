"""Text column expressions with JavaScript string semantics.

The rules the engine reproduces were written against JavaScript, whose
``\\s`` and ``trim`` cover Unicode spaces that Java's regex ``\\s`` and
Spark's ``trim`` do not, and whose ``\\b`` is ASCII-only while Java treats
letters such as ``é`` as word characters.  Everything here is a plain Column
expression (JVM side, whole-stage codegen), never a Python UDF.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The ECMAScript WhiteSpace + LineTerminator set matched by
# ``\s`` and removed by String.prototype.trim, written as a regex class body
# that both java.util.regex and RE2 accept.
JS_WS = r"\t\n\x0B\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
# The same set as literal characters (for btrim / translate, which need no regex).
JS_WS_CHARS = ("\t\n\x0b\x0c\r \u00a0\u1680" + "".join(chr(c) for c in range(0x2000, 0x200B))
               + "\u2028\u2029\u202f\u205f\u3000\ufeff")
WS_CLASS = f"[{JS_WS}]"
NON_WS_CLASS = f"[^{JS_WS}]"
# ASCII word-boundary lookarounds (JavaScript ``\b`` without the u flag).
WORD_CHAR = "[A-Za-z0-9_]"
BOUND_BEFORE = "(?<![A-Za-z0-9_])"
BOUND_AFTER = "(?![A-Za-z0-9_])"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def js_trim(col) -> Column:
    """String.prototype.trim: strip JS whitespace on both ends (``btrim`` with
    the explicit character set: no regex, no per-position work)."""
    return F.btrim(_c(col), F.lit(JS_WS_CHARS))


def word_count(col) -> Column:
    """``s.trim().split(/\\s+/).filter(w => w.length > 0).length`` == number of
    maximal runs of non-whitespace characters.  Every JS whitespace character
    is first mapped to a plain space (``translate``), so the split is on one
    literal character."""
    spaced = F.translate(F.coalesce(_c(col), F.lit("")), JS_WS_CHARS, " " * len(JS_WS_CHARS))
    return F.size(F.array_remove(F.split(spaced, " "), ""))


def has_min_words(col, n: int) -> Column:
    """``word_count(col) >= n`` decided from the first ``n`` words only: an
    anchored match with possessive runs (the classes are disjoint, so no
    backtracking changes the answer)."""
    if n <= 0:
        return F.lit(True)
    pat = f"^{WS_CLASS}*+(?:{NON_WS_CLASS}++{WS_CLASS}++){{{n - 1}}}{NON_WS_CLASS}"
    return F.coalesce(_c(col), F.lit("")).rlike(pat)


def split_words(col) -> Column:
    """Non-empty whitespace-separated tokens (JS whitespace)."""
    return F.regexp_extract_all(F.coalesce(_c(col), F.lit("")), F.lit(f"({NON_WS_CLASS}+)"), 1)


def normalize_for_match(col) -> Column:
    """Drop every character outside [a-zA-Z0-9], then lower-case."""
    return F.lower(F.regexp_replace(_c(col), "[^a-zA-Z0-9]+", ""))


def newline_to_space(col) -> Column:
    """``q.replace(/\\n/g, ' ')``: only LF is replaced."""
    return F.replace(_c(col), F.lit("\n"), F.lit(" "))


def utf16_length(col) -> Column:
    """JavaScript ``.length`` (UTF-16 code units); Spark's length counts code
    points, so astral characters count twice here."""
    return (F.length(_c(col)) + F.regexp_count(_c(col), F.lit("[\\x{10000}-\\x{10FFFF}]"))).cast("long")


def is_blank(col) -> Column:
    return js_trim(F.coalesce(_c(col), F.lit(""))) == F.lit("")


# ---- DuckDB (RE2) spellings of the same rules, used by the SQL oracles ----

def sql_js_trim(expr: str) -> str:
    return f"regexp_replace({expr}, '^{WS_CLASS}+|{WS_CLASS}+\\z', '', 'g')"


def sql_word_count(expr: str) -> str:
    return f"len(regexp_extract_all(coalesce({expr}, ''), '{NON_WS_CLASS}+'))"


def sql_normalize(expr: str) -> str:
    return f"lower(regexp_replace({expr}, '[^a-zA-Z0-9]', '', 'g'))"
