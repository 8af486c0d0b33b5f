"""Reporting periods of a fiscal year from April to March."""

from __future__ import annotations

import calendar
import datetime as dt
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

FREQUENCIES = ("monthly", "quarterly", "yearly")


#: What an unknown frequency, ``custom`` for one, stands for where a date is not given.
DEFAULT_PERIOD = ("monthly", "2026-05")


def period_range(frequency: str, period: str, start: dt.date | None = None, end: dt.date | None = None, default: tuple[str, str] | None = None) -> tuple[dt.date, dt.date]:
    """First and last day; given dates take the period's place.

    An unknown frequency is the ``default`` period (DEFAULT_PERIOD, say), and
    an unknown quarter is January to March of its own year.  ValueError on a
    period that can't be read, and on an unknown frequency without a default.
    """
    if start and end:
        return start, end
    if frequency not in FREQUENCIES and default is not None:
        frequency, period = default
    if frequency == "monthly" and (m := re.fullmatch(r"(\d{4})-(\d{2})", period)):
        year, month = int(m[1]), int(m[2])
        found = dt.date(year, month, 1), dt.date(year, month, calendar.monthrange(year, month)[1])
    elif frequency == "quarterly" and (m := re.fullmatch(r"(?:FY)?(\d{4})-(\w+)", period)):
        year, first = int(m[1]) + (m[2].upper() == "Q4"), {"Q1": 4, "Q2": 7, "Q3": 10}.get(m[2].upper(), 1)
        found = dt.date(year, first, 1), dt.date(year, first + 2, calendar.monthrange(year, first + 2)[1])
    elif frequency == "yearly" and (m := re.fullmatch(r"(?:FY)?(\d{4})(?:-(\d{4}))?", period)):
        found = dt.date(int(m[1]), 4, 1), dt.date(int(m[2] or int(m[1]) + 1), 3, 31)
    else:
        raise ValueError(f"no {frequency} period: {period}")
    return start or found[0], end or found[1]


def period_start(frequency: Column, period: Column) -> Column:
    year = F.regexp_extract(period, r"(\d{4})", 1).cast("int")
    quarter = F.regexp_extract(period, r"Q([1-4])", 1)
    month = F.when(frequency == "monthly", F.regexp_extract(period, r"^\d{4}-(\d{2})$", 1).try_cast("int")).when(frequency == "quarterly", F.when(quarter == "1", 4).when(quarter == "2", 7).when(quarter == "3", 10).when(quarter == "4", 1)).when(frequency == "yearly", 4)
    shifted = F.when((frequency == "quarterly") & (quarter == "4"), year + 1).otherwise(year)
    return F.make_date(shifted, month, F.lit(1))


def period_end(frequency: Column, period: Column) -> Column:
    start = period_start(frequency, period)
    months = F.when(frequency == "monthly", 1).when(frequency == "quarterly", 3)
    second = F.regexp_extract(period, r"^\d{4}-(\d{4})$", 1).try_cast("int")
    year_end = F.when(second.isNotNull(), F.make_date(second, F.lit(3), F.lit(31))).otherwise(F.date_sub(F.add_months(start, 12), 1))
    return F.when(frequency == "yearly", year_end).otherwise(F.date_sub(F.add_months(start, months), 1))


def shown_date(date: Column) -> Column:
    """30/06/2000."""
    return F.date_format(date, "dd/MM/yyyy")


def upper_date(date: Column) -> Column:
    """30-JUN-2000."""
    return F.upper(F.date_format(date, "dd-MMM-yyyy"))


def duration_days(start: Column, end: Column) -> Column:
    """Days inclusive, at least 1; 31 where a date is missing."""
    return F.coalesce(F.greatest(F.datediff(end, start) + 1, F.lit(1)), F.lit(31))


def scale_factors(start: dt.date, end: dt.date) -> tuple[float, float, float]:
    """Day factor (days over 31), and the multipliers of flows and of capital that follow from it."""
    factor = round(max((end - start).days + 1, 1) / 31, 2)
    return factor, min(max(factor, 0.8), 4.5), min(max(1 + (factor - 1) * 0.15, 1.0), 2.5)


def scaled(start: Column, end: Column) -> tuple[Column, Column, Column]:
    """scale_factors of date columns, as decimals."""
    factor = F.round(duration_days(start, end).cast("decimal(12,4)") / 31, 2).cast("decimal(12,2)")
    limited = lambda x, low, high: F.least(F.greatest(x, F.lit(low).cast("decimal(12,4)")), F.lit(high).cast("decimal(12,4)"))
    return factor, limited(factor.cast("decimal(12,4)"), "0.8", "4.5"), limited((1 + (factor - 1) * F.lit("0.15").cast("decimal(3,2)")).cast("decimal(12,4)"), "1.0", "2.5")


def age_label(then: Column, now: Column) -> Column:
    """How long ago, from timestamps: Just now, minutes, hours or days."""
    seconds = F.unix_timestamp(now) - F.unix_timestamp(then)
    return F.when(seconds < 60, "Just now").when(seconds < 3600, F.concat(F.floor(seconds / 60).cast("string"), F.lit("m ago"))).when(seconds < 86400, F.concat(F.floor(seconds / 3600).cast("string"), F.lit("h ago"))).otherwise(F.concat(F.floor(seconds / 86400).cast("string"), F.lit("d ago")))
