"""Weekly features of places, as they were visible on every origin date at once."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.calendar import week_end


def station_weeks(daily: DataFrame, served: DataFrame, station: str, place: str, day: str, dates: list[dt.date], measures: dict[str, Column], lag_days: int, history_days: int) -> DataFrame:
    """place, as_of, week_end and the measures of a station's days, for each place that it serves.

    A day is visible ``lag_days`` later, so the last week is often partial; weeks of the last
    ``history_days`` before each date are kept. Each day goes to the dates that see it: a fixed
    number of them, whatever the calendar. Weeks are summed per station before they are given to places.
    """
    calendar = F.array(*[F.lit(d).cast("date") for d in sorted(dates)])
    week = week_end(day)
    sees = F.filter(calendar, lambda d: (F.date_add(F.col(day), lag_days) <= d) & (week > F.date_sub(d, history_days)))
    seen = daily.withColumn("week_end", week).withColumn("as_of", F.explode(sees))
    weekly = seen.groupBy(station, "as_of", "week_end").agg(*[m.alias(n) for n, m in measures.items()])
    return served.select(place, F.col(station).alias("_station")).join(weekly, F.col("_station") == F.col(station)).select(place, "as_of", "week_end", *measures)


def site_levels(rows: DataFrame, site: str, place: str, by: list[str], value: str, weight: str, cap: float) -> DataFrame:
    """place, ``by``, level, sites: values of the sites that serve a place, cut at ``cap`` and weighted, with the plain mean where no site has a weight.

    A site that serves several places counts in each with its full weight; null values count nowhere.
    """
    known = rows.filter(F.col(value).isNotNull()).withColumns({"_v": F.least(F.col(value), F.lit(cap)), "_w": F.greatest(F.coalesce(F.col(weight).cast("double"), F.lit(0.0)), F.lit(0.0))})
    total = F.sum("_w")
    level = F.when(total > 0, F.sum(F.col("_w") * F.col("_v")) / F.when(total > 0, total)).otherwise(F.avg("_v"))
    return known.groupBy(place, *by).agg(level.alias("level"), F.count_distinct(site).alias("sites"))
