"""Date expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def long_date(c: Column) -> Column:
    """27 April 2026."""
    return F.date_format(c, "d MMMM yyyy")


def url_date(c: Column) -> Column:
    """27-april-2026."""
    return F.lower(F.date_format(c, "d-MMMM-yyyy"))


def from_url_date(c: Column) -> Column:
    """F07 backwards; null for anything else."""
    return F.to_date(F.try_to_timestamp(F.initcap(F.replace(c, F.lit("-"), F.lit(" "))), F.lit("d MMMM yyyy")))


def iso_date(c: Column) -> Column:
    """a date from the first ten characters; null if they are none."""
    return F.when(F.left(c, F.lit(10)).rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_timestamp(F.left(c, F.lit(10)), F.lit("yyyy-MM-dd")).cast("date"))


def noted_date(c: Column) -> Column:
    """struct of a date and a note, from one of five forms; both null if none fits."""
    s = F.trim(c)
    parse = lambda t, form: F.try_to_timestamp(t, F.lit(form)).cast("date")
    span = F.regexp_replace(s, r"^(\d{1,2})\s*[-–]\s*\d{1,2}\s+([A-Za-z]+ \d{4})$", "$1 $2")
    iso, slashed, full = parse(F.when(s.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), s), "yyyy-M-d"), parse(F.when(s.rlike(r"^\d{1,2}/\d{1,2}/\d{4}$"), s), "d/M/yyyy"), parse(F.when(s.rlike(r"^\d{1,2} [A-Za-z]+ \d{4}$"), F.initcap(s)), "d MMMM yyyy")
    from_span = parse(F.when(span != s, F.initcap(span)), "d MMMM yyyy")
    month = parse(F.when(s.rlike(r"^[A-Za-z]+ \d{4}$"), F.concat(F.lit("1 "), F.initcap(s))), "d MMMM yyyy")
    note = F.when(F.coalesce(iso, slashed).isNotNull(), F.lit(None)).when(from_span.isNotNull(), F.concat(F.lit('date range recorded as "'), s, F.lit('"; used start date'))).when(full.isNotNull(), F.lit(None)).when(month.isNotNull(), F.concat(F.lit('no specific day in date "'), s, F.lit('"; used 1st of month')))
    return F.struct(F.coalesce(iso, slashed, from_span, full, month).alias("date"), note.alias("note"))


def range_text(start: Column, end: Column) -> Column:
    """20240101..20240131; an open end is left out, two give null."""
    day = lambda c: F.coalesce(F.date_format(c, "yyyyMMdd"), F.lit(""))
    return F.when(start.isNotNull() | end.isNotNull(), F.concat(day(start), F.lit(".."), day(end)))


def year_range(first: Column, last: Column) -> Column:
    """2024 or 2024–2025."""
    return F.when(F.year(first) == F.year(last), F.year(first).cast("string")).otherwise(F.concat(F.year(first), F.lit("–"), F.year(last)))


def iso_week(c: Column) -> Column:
    """2024-W05."""
    return F.format_string("%04d-W%02d", F.extract(F.lit("YEAROFWEEK"), c), F.extract(F.lit("WEEK"), c))


def monday(c: Column) -> Column:
    """F55 backwards: the Monday of a date's week."""
    return F.date_trunc("week", c).cast("date")


def period_text(start: Column, end: Column) -> Column:
    """2020-01–2024-05 or 2020-01–present."""
    return F.concat(F.left(start, F.lit(7)), F.lit("–"), F.coalesce(F.nullif(F.left(end, F.lit(7)), F.lit("")), F.lit("present")))


def fresh(stored: Column, now: Column, hours: int) -> Column:
    """At most so many hours old."""
    return stored >= now - F.expr(f"INTERVAL {hours} HOURS")


def in_range(c: Column, start: str | None, end: str | None) -> Column:
    """Between two ISO dates, either of which may be missing or malformed."""
    low, high = (F.try_to_timestamp(F.lit(x), F.lit("yyyy-MM-dd")).cast("date") for x in (start, end))
    return F.coalesce(c >= low, F.lit(True)) & F.coalesce(c <= high, F.lit(True)) & (c.isNotNull() | (low.isNull() & high.isNull()))
