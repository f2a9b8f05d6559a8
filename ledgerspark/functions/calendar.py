"""Date parsing and calendar features (F1-F10) as built-in column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c: str | Column) -> Column:
    return F.col(f"`{c}`") if isinstance(c, str) else c


def parse_date(text: str | Column, fmt: str = "dd/MM/yyyy", strict: bool = False) -> Column:
    """text -> date. ``strict`` raises on an impossible date (ANSI); otherwise NULL."""
    return F.to_date(_c(text), fmt) if strict else F.try_to_date(_c(text), fmt)


def add_days(d: str | Column, n: int = 1) -> Column:
    """F1."""
    return F.date_add(_c(d), n)


def days_between(later: str | Column, earlier: str | Column) -> Column:
    """whole days from ``earlier`` to ``later``."""
    return F.date_diff(_c(later), _c(earlier))


def month(d: str | Column) -> Column:
    return F.month(_c(d))


def is_month_start(d: str | Column) -> Column:
    """first day of the month."""
    return F.dayofmonth(_c(d)) == 1


def is_month_end(d: str | Column) -> Column:
    """last day of the month."""
    return F.last_day(_c(d)) == _c(d)


def weekday(d: str | Column) -> Column:
    """Monday = 0 ... Sunday = 6."""
    return F.weekday(_c(d))


def quarter(d: str | Column) -> Column:
    return F.quarter(_c(d))


def is_weekend(d: str | Column) -> Column:
    """F9."""
    return F.weekday(_c(d)) >= 5


def near_month_end(d: str | Column, after_day: int = 27) -> Column:
    """day of month above ``after_day``."""
    return F.dayofmonth(_c(d)) > after_day


def near_month_begin(d: str | Column, before_day: int = 3) -> Column:
    """day of month below ``before_day``."""
    return F.dayofmonth(_c(d)) < before_day


def calendar_features(d: str | Column) -> dict[str, Column]:
    """The cleaning notebook's date features."""
    return {"month": month(d), "is_month_start": is_month_start(d), "is_month_end": is_month_end(d),
            "weekday": weekday(d), "quarter": quarter(d)}


def extra_calendar_features(d: str | Column) -> dict[str, Column]:
    """The README's variants."""
    return {"is_weekend": is_weekend(d), "near_month_end": near_month_end(d),
            "near_month_begin": near_month_begin(d)}
