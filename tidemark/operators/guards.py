"""Checks of arguments and of rows before anything is read."""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def epiweek_argument(value) -> int:
    """An epidemiological week as YYYYWW; a calendar date, which reads as a huge week, is an error."""
    text = str(value).strip()
    if not re.fullmatch(r"[0-9]{6}", text) or not 1 <= int(text[4:]) <= 53:
        raise ValueError(f"{value!r} is no epidemiological week such as 202607")
    return int(text)


def is_epiweek(text: str | Column) -> Column:
    """Whether a text is a week that :func:`epiweek_argument` takes; null for null."""
    t = F.trim(F.col(text) if isinstance(text, str) else text)
    return t.rlike(r"^[0-9]{6}$") & F.coalesce(F.substring(t, 5, 2).try_cast("int").between(1, 53), F.lit(False))


def as_of_argument(text: str | None, first: dt.date, today: dt.date) -> dt.date:
    """The date that is asked for: today if none is; a date to come, or one before the archive begins, is an error."""
    if not text or not text.strip():
        return today
    try:
        day = dt.datetime.fromisoformat(text.strip()).date()
    except ValueError as e:
        raise ValueError(f"{text!r} is no date such as 2026-01-31") from e
    if day > today:
        raise ValueError(f"{day} is in the future")
    if day < first:
        raise ValueError(f"nothing is archived before {first}")
    return day


def as_of_problem(text: str | Column, first: dt.date, today: dt.date) -> Column:
    """What :func:`as_of_argument` would say of a text: 'no date', 'future', 'before the archive', or null."""
    t = F.trim(F.col(text) if isinstance(text, str) else text)
    day = F.try_to_date(F.substring(t, 1, 10), "yyyy-MM-dd")
    return F.when(F.coalesce(t, F.lit("")) == "", None).when(day.isNull(), "no date").when(day > F.lit(today), "future").when(day < F.lit(first), "before the archive")
