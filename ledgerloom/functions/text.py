"""Scalar column helpers (section 2.9 functions) — all built-in, JVM-side."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerloom.config import (CHALLAN_STATUSES, DAYS_MAX, DAYS_MIN, PAGE_MAX,
                               REQUEST_STATUSES)

# The application's database compares text case- and accent-insensitively.
SEARCH_COLLATION = "UNICODE_CI_AI"


def wall_time(value) -> Column:
    """A ``timestamp_ntz`` literal for a naive datetime (or its ISO text).

    Built from text, so the value never passes through a time zone (a Python
    datetime literal would be read in the session zone).
    """
    if value is None:
        return F.lit(None).cast("timestamp_ntz")
    text = value if isinstance(value, str) else value.strftime("%Y-%m-%d %H:%M:%S.%f")
    return F.lit(text).cast("timestamp_ntz")


def search_predicate(columns: Sequence[str], term: str | None) -> Column | None:
    """Substring match over several columns; empty term -> no filter.

    The term is trimmed; ``%`` and ``_`` are literal characters here.
    """
    term = (term or "").strip()
    if not term:
        return None
    pred = None
    for name in columns:
        hit = F.contains(F.collate(F.col(name), SEARCH_COLLATION), F.lit(term))
        pred = hit if pred is None else (pred | hit)
    return pred


def csv_safe(col: Column) -> Column:
    """Text for a spreadsheet cell: null -> '', formula prefixes neutralised."""
    text = F.coalesce(col.cast("string"), F.lit(""))
    return F.when(text.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), text)).otherwise(text)


def challan_number(year: Column, seq: Column) -> Column:
    """``CH-<year>-<sequence zero-padded to at least 5 digits>``."""
    return F.format_string("CH-%d-%05d", year, seq)


def month_day(col: Column) -> Column:
    """short month and day without padding, e.g. ``Aug 9``."""
    return F.date_format(col, "MMM d")


def type_label(col: Column) -> Column:
    """first ``_`` becomes a space, then lower case."""
    return F.lower(F.regexp_replace(col, "^([^_]*)_", "$1 "))


def stars(rating: Column) -> Column:
    """one star per rating point."""
    return F.repeat(F.lit("★"), rating.cast("int"))


def date_or_not_set(col: Column) -> Column:
    """F21."""
    return F.coalesce(F.date_format(col, "yyyy-MM-dd"), F.lit("Not set"))


def first_name(col: Column) -> Column:
    """the first word of a name, for a greeting."""
    return F.split(col, " ").getItem(0)


def initial(col: Column) -> Column:
    """the first character of a name, as a badge shows it (none: empty)."""
    return F.substring(col, 1, 1)


def check_days(days: int) -> int:
    """V7: the sales window is a whole number of days in 7..365."""
    if not isinstance(days, int) or isinstance(days, bool) or not DAYS_MIN <= days <= DAYS_MAX:
        raise ValueError(f"days must be an integer in {DAYS_MIN}..{DAYS_MAX}, got {days!r}")
    return days


def check_page(page: int, limit: int) -> tuple[int, int]:
    """Page >= 1, limit in 1..100; returns (offset, limit)."""
    if not isinstance(page, int) or page < 1:
        raise ValueError(f"page must be a positive integer, got {page!r}")
    if not isinstance(limit, int) or not 1 <= limit <= PAGE_MAX:
        raise ValueError(f"limit must be in 1..{PAGE_MAX}, got {limit!r}")
    return (page - 1) * limit, limit


def check_challan_status(status: str | None) -> str | None:
    """Q4: an unknown status is an error, not a silently dropped filter."""
    if status is None or status == "":
        return None
    if status not in CHALLAN_STATUSES:
        raise ValueError(f"unknown challan status {status!r}")
    return status


def check_request_status(status: str | None) -> str | None:
    if status is None or status.strip() == "":
        return None
    s = status.strip().upper()
    if s not in REQUEST_STATUSES:
        raise ValueError(f"unknown stock request status {status!r}")
    return s
