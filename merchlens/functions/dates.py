"""Date expressions and period parameters."""

from __future__ import annotations

from datetime import date, datetime, time, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: accepted date spellings
DAY_FIRST_FORMATS = ["yyyy-MM-dd", "dd/MM/yyyy", "yyyy/MM/dd"]
EXPORT_FORMATS = ["yyyy-MM-dd", "yyyy/MM/dd", "dd/MM/yyyy", "MM/dd/yyyy"]
SERIAL_EPOCH = "1899-12-30"


def leading_date(c: Column) -> Column:
    """The first ten characters as an ISO date, NULL when they are not one."""
    return F.try_to_timestamp(F.substring(c.cast("string"), 1, 10), F.lit("yyyy-MM-dd")).cast("date")


def parse_date(c: Column, formats: list[str] = DAY_FIRST_FORMATS) -> Column:
    """First spelling that parses; ISO timestamps are cut to their day."""
    text = F.trim(c)
    iso = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}([T ].*)?$"), leading_date(text))
    word = F.element_at(F.split(text, r"\s+"), 1)
    return F.coalesce(iso, *[F.try_to_timestamp(word, F.lit(f)).cast("date") for f in formats])


def serial_date(c: Column) -> Column:
    """Spreadsheet day number to a date."""
    return F.date_add(F.lit(SERIAL_EPOCH).cast("date"), F.floor(c).cast("int"))


def start_of_range(c: Column) -> Column:
    """Left side of a ``from~to`` text."""
    return F.when(c.contains("~"), leading_date(F.trim(F.substring_index(c, "~", 1))))


def period_bounds(
    start: date | None, end: date | None, today: date | None = None
) -> tuple[datetime, datetime]:
    """Half-open timestamps for inclusive days; a missing bound makes a 30-day window."""
    window = timedelta(days=29)
    if start is None and end is None:
        end = today or date.today()
    if start is None:
        start = end - window
    if end is None:
        end = start + window
    first, last = min(start, end), max(start, end)
    return datetime.combine(first, time.min), datetime.combine(last + timedelta(days=1), time.min)
