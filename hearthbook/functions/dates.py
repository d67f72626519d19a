"""Dates as the ledger uses them; today is always a parameter."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def iso_date(text: Column) -> Column:
    """A strict yyyy-MM-dd, else null."""
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), text.try_cast("date"))


def parse_date(text: Column, order: str) -> Column:
    """ISO, or day and month in the given order (MDY or DMY) with / . or -; invalid dates are null."""
    iso = _assembled(text, r"^(\d{4})[-/](\d{1,2})[-/](\d{1,2})$", (1, 2, 3))
    places = (3, 1, 2) if order == "MDY" else (3, 2, 1)
    return F.coalesce(iso, _assembled(text, r"^(\d{1,2})[/.-](\d{1,2})[/.-](\d{4})$", places))


def _assembled(text: Column, pattern: str, places: tuple[int, int, int]) -> Column:
    year, month, day = (F.regexp_extract(text, pattern, k) for k in places)
    return F.when(text.rlike(pattern), F.concat_ws("-", year, F.lpad(month, 2, "0"), F.lpad(day, 2, "0")).try_cast("date"))


def month_index(date: Column) -> Column:
    return F.year(date) * 12 + F.month(date) - 1


def add_months(date: Column, months: Column | int) -> Column:
    """The same day so many months on, or the month's last."""
    return F.add_months(date, months)


def month_end(date: Column) -> Column:
    return F.last_day(date)


def month_label(index: Column) -> Column:
    return F.format_string("%04d-%02d", F.floor(index / 12).cast("int"), (index % 12 + 1).cast("int"))


def checkin_day(today: Column, weekday: int) -> Column:
    """The latest day on or before today that is the weekday (Monday 0)."""
    return F.date_sub(today, F.pmod(F.weekday(today) - weekday, F.lit(7)).cast("int"))


def effective_day(kind: Column, today: Column, weekday: Column, on_date: Column) -> Column:
    """What a check-in answer's time word means: today, yesterday, this_week (its midpoint), a weekday, or a date."""
    return (
        F.when(kind == "today", today).when(kind == "yesterday", F.date_sub(today, 1)).when(kind == "this_week", F.date_sub(today, 3))
        .when(kind == "weekday", F.date_sub(today, F.pmod(F.weekday(today) - weekday, F.lit(7)).cast("int"))).when(kind == "on_date", on_date)
    )
