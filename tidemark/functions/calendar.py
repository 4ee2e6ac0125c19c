"""Week and epidemiological calendar expressions on dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def week_end(day: str | Column) -> Column:
    """The Saturday on or after a day; weeks run from Sunday to Saturday."""
    return F.next_day(F.date_sub(_c(day).cast("date"), 1), "SAT")


def week_start(day: str | Column) -> Column:
    """The Sunday on or before a day."""
    d = _c(day).cast("date")
    return F.date_sub(d, F.dayofweek(d) - 1)


def epiweek_start(epiweek: str | Column) -> Column:
    """The Sunday of a YYYYWW week; week 1 is the week of January 4."""
    e = _c(epiweek).cast("int")
    anchor = F.make_date(F.floor(e / 100).cast("int"), F.lit(1), F.lit(4))
    return F.date_add(week_start(anchor), ((e % 100) - 1) * 7)


def epiweek(day: str | Column) -> Column:
    """YYYYWW of a day; a week belongs to the year of its Wednesday."""
    sunday = week_start(day)
    year = F.year(F.date_add(sunday, 3))
    first = week_start(F.make_date(year, F.lit(1), F.lit(4)))
    return (year * 100 + F.floor(F.datediff(sunday, first) / 7) + 1).cast("int")


def visible_saturday(day: str | Column) -> Column:
    """The last Saturday on or before a day."""
    return F.date_sub(F.next_day(_c(day).cast("date"), "SAT"), 7)


def month_end_saturday(day: str | Column) -> Column:
    """The last Saturday on or before the end of the day's month."""
    return visible_saturday(F.last_day(_c(day).cast("date")))


def season_label(day: str | Column) -> Column:
    """The October-to-September season of a day, such as 2025-26."""
    y = F.year(F.add_months(_c(day).cast("date"), -9))
    return F.format_string("%d-%02d", y, (y + 1) % 100)


def harmonics(day: str | Column, order: int = 2, period: float = 365.25) -> dict[str, Column]:
    """Sine and cosine of the day of the year, named sin1, cos1, ..."""
    angle = F.dayofyear(_c(day).cast("date")) * F.lit(2 * 3.141592653589793 / period)
    return {f"{name}{k}": fn(angle * k) for k in range(1, order + 1) for name, fn in (("sin", F.sin), ("cos", F.cos))}


def thanksgiving(year: str | Column) -> Column:
    """The fourth Thursday of November."""
    return F.date_add(F.next_day(F.make_date(_c(year), F.lit(10), F.lit(31)), "THU"), 21)
