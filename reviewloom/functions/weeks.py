"""ISO-8601 week keys, week bounds and look-back windows as Column expressions.

Week keys have the fixed form ``YYYY-Www`` (ISO week-numbering year, Thursday
rule).  Bounds are Monday 00:00 of the week containing 4 January plus
``(w-1)`` weeks; the inclusive end is the next Monday minus one millisecond.
All arithmetic happens in the session time zone, which the engine pins to UTC.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WEEK_KEY_PATTERN = r"^\d{4}-W\d{2}$"


def _one_ms() -> Column:
    return F.expr("INTERVAL '0.001' SECOND")


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def iso_year(ts) -> Column:
    return F.extract(F.lit("YEAROFWEEK"), _c(ts))


def iso_week_number(ts) -> Column:
    return F.weekofyear(_c(ts))


def iso_week_key(ts) -> Column:
    """``YYYY-Www`` of a date/timestamp (2027-01-02 -> 2026-W53)."""
    return F.format_string("%04d-W%02d", iso_year(ts), iso_week_number(ts))


def week_key_year(key) -> Column:
    return F.split_part(_c(key), F.lit("-W"), F.lit(1)).try_cast("int")


def week_key_number(key) -> Column:
    return F.split_part(_c(key), F.lit("-W"), F.lit(2)).try_cast("int")


def week_start_date(key) -> Column:
    """Monday (DATE) of an ISO week key."""
    y = week_key_year(key)
    w = week_key_number(key)
    jan4 = F.make_date(y, F.lit(1), F.lit(4))
    first_monday = F.date_sub(jan4, (F.dayofweek(jan4) + 5) % 7)
    return F.date_add(first_monday, (w - 1) * 7)


def week_start_ts(key) -> Column:
    return F.to_timestamp(week_start_date(key))


def week_end_ts(key) -> Column:
    """Inclusive end used for display: next Monday 00:00 minus 1 ms."""
    return F.to_timestamp(F.date_add(week_start_date(key), 7)) - _one_ms()


def weeks_in_year(year) -> Column:
    return F.weekofyear(F.make_date(_c(year), F.lit(12), F.lit(28)))


def is_valid_week_key(key) -> Column:
    """Pattern check plus a range check on the week number (stricter than a
    bare split: ``2026-W54`` and ``2026W10`` are rejected)."""
    k = _c(key)
    y = week_key_year(k)
    w = week_key_number(k)
    return (F.coalesce(k.rlike(WEEK_KEY_PATTERN), F.lit(False))
            & (w >= 1) & (w <= weeks_in_year(y)))


def shift_week_key(key, weeks) -> Column:
    """The week key ``weeks`` weeks after ``key``."""
    return iso_week_key(F.date_add(week_start_date(key), _c(weeks) * 7 if not isinstance(weeks, int) else F.lit(weeks * 7)))


def lookback_lower(key, lookback_weeks) -> Column:
    """Inclusive lower bound of the look-back window: end - L * 7 days."""
    lw = _c(lookback_weeks) if not isinstance(lookback_weeks, int) else F.lit(lookback_weeks)
    return F.timestamp_add("DAY", -lw * 7, week_end_ts(key))


def in_lookback(ts, key, lookback_weeks, upper_bound: bool = True) -> Column:
    cond = _c(ts) >= lookback_lower(key, lookback_weeks)
    if upper_bound:
        cond = cond & (_c(ts) <= week_end_ts(key))
    return cond


def run_key(product, week) -> Column:
    return F.concat_ws(":", _c(product), _c(week))


def run_key_product(key) -> Column:
    return F.split_part(_c(key), F.lit(":"), F.lit(1))


def run_key_week(key) -> Column:
    return F.split_part(_c(key), F.lit(":"), F.lit(2))


# ---- DuckDB spellings ----

def sql_iso_week_key(expr: str) -> str:
    return f"printf('%04d-W%02d', isoyear({expr}), week({expr}))"


def sql_week_start(key: str) -> str:
    y = f"CAST(split_part({key}, '-W', 1) AS INTEGER)"
    w = f"CAST(split_part({key}, '-W', 2) AS INTEGER)"
    return f"(CAST(date_trunc('week', make_date({y}, 1, 4)) AS DATE) + ({w} - 1) * 7)"


def sql_week_end(key: str) -> str:
    return f"(CAST({sql_week_start(key)} + 7 AS TIMESTAMP) - INTERVAL 1 MILLISECOND)"
