"""Dates and numbers as questions use them, always against a given day."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Date formats of other engines, and this one's.
FORMATS = {"%Y": "yyyy", "%m": "MM", "%d": "dd", "%H": "HH", "%i": "mm", "%M": "mm", "%s": "ss", "%S": "ss", "%y": "yy"}


def format_of(pattern: str) -> str:
    """A strftime-like pattern as a Spark pattern."""
    for theirs, ours in FORMATS.items():
        pattern = pattern.replace(theirs, ours)
    return pattern


def month_key(d: Column) -> Column:
    return F.date_format(d, "yyyy-MM")


def quarter_key(d: Column) -> Column:
    return F.concat(F.year(d).cast("string"), F.lit("-Q"), F.quarter(d).cast("string"))


def financial_year(d: Column, first_month: int = 4) -> Column:
    """'2023-24' for days from the first month of 2023 on."""
    start = F.when(F.month(d) >= first_month, F.year(d)).otherwise(F.year(d) - 1)
    return F.concat(start.cast("string"), F.lit("-"), F.lpad(((start + 1) % 100).cast("string"), 2, "0"))


def day_of_year(year: Column, n: Column) -> Column:
    """The n-th day of a year."""
    return F.date_add(F.make_date(year, F.lit(1), F.lit(1)), (n - 1).cast("int"))


def window(period: str, today: Column) -> tuple[Column, Column]:
    """[from, to) of a named period."""
    month, year, quarter = F.trunc(today, "month"), F.trunc(today, "year"), F.trunc(today, "quarter")
    return {
        "last month": (F.add_months(month, -1), month),
        "last quarter": (F.add_months(quarter, -3), quarter),
        "this year": (year, F.add_months(year, 12)),
        "last year": (F.add_months(year, -12), year),
        "last 6 months": (F.add_months(today, -6), F.date_add(today, 1)),
        "last 30 days": (F.date_sub(today, 30), F.date_add(today, 1)),
    }[period]


def number(x: Column) -> Column:
    """A quantity kept as text; null if it isn't a number."""
    return x.try_cast("decimal(10,2)")
