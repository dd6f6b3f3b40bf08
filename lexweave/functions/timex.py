"""Dates as TIMEX strings (``2004``, ``2004-07``, ``2004-W12``, ``2004-07-09``) and calendar periods."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

YEAR, MONTH, WEEK, DAY = r"^\d{4}$", r"^\d{4}-\d{2}$", r"^\d{4}-W\d{2}$", r"^\d{4}-\d{2}-\d{2}$"


def granularity(timex: Column) -> Column:
    """``year``, ``month``, ``week``, ``day``, or null."""
    return F.when(timex.rlike(DAY), "day").when(timex.rlike(WEEK), "week").when(timex.rlike(MONTH), "month").when(timex.rlike(YEAR), "year")


def iso_week(day: Column) -> Column:
    """ISO week of a date, as ``YYYY-Www``."""
    return F.concat(F.extract(F.lit("YEAROFWEEK"), day).cast("string"), F.lit("-W"), F.lpad(F.weekofyear(day).cast("string"), 2, "0"))


def period(timex: Column) -> tuple[Column, Column]:
    """First day and the day after the last of a TIMEX; null if it is none. Periods are half-open, so a day's is not empty."""
    first_week = F.date_trunc("week", F.to_date(F.concat(F.substring(timex, 1, 4), F.lit("-01-04")))).cast("date")
    start = (
        F.when(timex.rlike(DAY), F.try_to_date(timex, "yyyy-MM-dd"))
        .when(timex.rlike(MONTH), F.try_to_date(F.concat(timex, F.lit("-01")), "yyyy-MM-dd"))
        .when(timex.rlike(YEAR), F.try_to_date(F.concat(timex, F.lit("-01-01")), "yyyy-MM-dd"))
        .when(timex.rlike(WEEK), F.date_add(first_week, (F.substring(timex, 7, 2).try_cast("int") - 1) * 7))
    )
    end = F.when(timex.rlike(DAY), F.date_add(start, 1)).when(timex.rlike(MONTH), F.add_months(start, 1)).when(timex.rlike(YEAR), F.add_months(start, 12)).when(timex.rlike(WEEK), F.date_add(start, 7))
    return start, end


def date_status(timex: Column, first: Column, last: Column) -> Column:
    """A TIMEX against the days ``first`` to ``last``, both inclusive.

    ``NOT_SPECIFIC`` for null or no TIMEX; ``IN_RANGE`` for a day, week or month that overlaps the range and
    a year that lies in it whole; ``TOO_BROAD`` for a year that only overlaps it; else ``OUT_OF_RANGE``.
    """
    start, end = period(timex)
    overlaps = (start <= last) & (end > first)
    whole = (start >= first) & (F.date_sub(end, 1) <= last)
    return F.when(start.isNull(), "NOT_SPECIFIC").when(~overlaps, "OUT_OF_RANGE").when(granularity(timex) != "year", "IN_RANGE").when(whole, "IN_RANGE").otherwise("TOO_BROAD")


def valid_at(start: Column, end: Column, day: Column) -> Column:
    """Strictly between the bounds; a null bound is open."""
    return (start.isNull() | (start < day)) & (end.isNull() | (end > day))


def to_year(timex: Column) -> Column:
    """The year of a TIMEX that begins with one; else null."""
    return F.nullif(F.regexp_extract(timex, r"^([12]\d{3})(-.*)?$", 1), F.lit(""))


def to_day(timex: Column) -> Column:
    """``YYYY-MM-DD`` of a TIMEX that begins with it; else null."""
    return F.nullif(F.regexp_extract(timex, r"^([12]\d{3}-\d{2}-\d{2})", 1), F.lit(""))


def plus_months(day: Column, n: int) -> Column:
    """The day ``n`` months on, or the last of that month if it is shorter."""
    return F.add_months(day, n)


MONTH_NAME = r"(?i)(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\.?"
#: Forms of a date in a query: pattern, and the groups of year, month, day (0: not given).
DATE_FORMS = (
    (r"^\s*([12]\d{3})([01]\d)([0-3]\d)\s*$", 1, 2, 3),
    (rf"^\s*{MONTH_NAME} (\d{{4}}|\d{{2}})\s*$", 2, 1, 0),
    (rf"^\s*([0-3]?\d) {MONTH_NAME} (\d{{4}}|\d{{2}})\s*$", 3, 2, 1),
    (rf"^\s*{MONTH_NAME} ([0-3]?\d),? (\d{{4}}|\d{{2}})\s*$", 3, 1, 2),
    (r"^\s*([01]?\d)/([0-3]?\d)/([12]\d{3}|\d{2})\s*$", 3, 1, 2),
    (r"^\s*([01]?\d)-([0-3]?\d)-([12]\d{3}|\d{2})\s*$", 3, 1, 2),
    (r"^\s*([01]?\d)/([12]\d{3}|\d{2})\s*$", 2, 1, 0),
    (r"^\s*([01]?\d)-([12]\d{3}|\d{2})\s*$", 2, 1, 0),
    (r"^\s*([12]\d{3})\s*$", 1, 0, 0),
    (r"^\s*([12]\d{3})-([0-3]?\d)-([0-3]?\d)\S*\s*$", 1, 2, 3),
)
NAMES = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
#: Two-digit years below this are of this century.
CENTURY = 20


def query_date(written: Column, side: str) -> Column:
    """The date that a query writes in one of the forms; null for none.

    What is missing is filled: the first month and day for ``side`` ``start``, the last for ``end``. A day past the
    end of its month is its last.
    """
    out = None
    for pattern, y, m, d in DATE_FORMS:
        part = [F.regexp_extract(written, pattern, k) if k else None for k in (y, m, d)]
        number = part[0].try_cast("int")
        year = F.when(F.length(part[0]) > 2, number).when(number < CENTURY, number + 2000).otherwise(number + 1900)
        if part[1] is None:
            month = F.lit(1 if side == "start" else 12)
        elif MONTH_NAME in pattern:
            month = F.array_position(F.array(*map(F.lit, NAMES)), F.lower(F.substring(part[1], 1, 3))).cast("int")
        else:
            month = part[1].try_cast("int")
        first = F.try_to_date(F.concat_ws("-", year.cast("string"), month.cast("string"), F.lit("1")), "y-M-d")
        if part[2] is None:
            day = first if side == "start" else F.last_day(first)
        else:
            day = F.least(F.date_add(first, F.greatest(part[2].try_cast("int"), F.lit(1)) - 1), F.last_day(first))
        out = F.when(written.rlike(pattern), day) if out is None else out.when(written.rlike(pattern), day)
    return out


ZONE = r"(Z|[+-]\d{2}:?\d{2})$"
TIME_FORMS = ((r"^\d{8}$", "yyyyMMdd", False), (r"^\d{4}-\d{2}-\d{2}$", "yyyy-MM-dd", False), (r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}", "yyyy-MM-dd'T'HH:mm:ss", True), (r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}", "yyyy-MM-dd HH:mm:ss", True), (r"^\d{8}-\d{2}:\d{2}:\d{2}", "yyyyMMdd-HH:mm:ss", True), (r"^\d{8}T\d{6}", "yyyyMMdd'T'HHmmss", True))


def parse_time(written: Column) -> tuple[Column, Column, Column]:
    """Day, time of day (``HH:mm:ss``) and zone of a date as feeds write it; null where they are not given."""
    trimmed = F.trim(written)
    dated = trimmed.rlike(r"^\d{4}-\d{2}-\d{2}$")
    zone = F.when(~dated, F.nullif(F.regexp_extract(trimmed, ZONE, 1), F.lit("")))
    bare = F.when(dated, trimmed).otherwise(F.regexp_replace(trimmed, ZONE, ""))
    stamp, timed = None, F.lit(False)
    for pattern, form, has_time in TIME_FORMS:
        value = F.try_to_timestamp(bare, F.lit(form))
        stamp = F.when(bare.rlike(pattern), value) if stamp is None else stamp.when(bare.rlike(pattern), value)
        timed = timed | bare.rlike(pattern) if has_time else timed
    return stamp.cast("date"), F.when(timed, F.date_format(stamp, "HH:mm:ss")), zone
