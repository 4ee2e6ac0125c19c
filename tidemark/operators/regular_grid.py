"""Irregular readings onto a regular weekly grid.

A harmonic regression with trend is fitted per source by normal equations: each reading adds
its outer products to sums that are combined map-side, so a source is never gathered, and one
small system per source is solved in Arrow batches. Missing weeks get the predicted value plus
the residuals of the observed weeks on either side, bridged linearly.

Defined results: null and NaN readings are no readings; repeated rows count once; a source
without readings gives no rows; a week's value is the mean of its readings; a source with too
few weeks for the model falls back to the ridge solution, which is near its mean.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.calendar import week_end
from tidemark.sources.tables import number

#: Day that the trend counts from; only keeps the numbers small.
EPOCH = "2025-01-01"
PERIOD_DAYS = 365.25


def basis(day: str | Column, order: int) -> list[Column]:
    """1, trend in years, and ``order`` pairs of yearly harmonics of a date."""
    t = F.datediff(F.col(day) if isinstance(day, str) else day, F.lit(EPOCH).cast("date")) / F.lit(PERIOD_DAYS)
    waves = [fn(t * F.lit(2 * math.pi * k)) for k in range(1, order + 1) for fn in (F.sin, F.cos)]
    return [F.lit(1.0), t, *waves]


def weekly_readings(df: DataFrame, source: str, time: str, value: str, reading_id: str) -> DataFrame:
    """source, week_end, value (mean), readings: one row per source and week with a reading."""
    rows = df.select(F.col(source).alias("source"), F.col(time).alias("at"), number(value).alias("value"), F.col(reading_id).alias("id"))
    rows = rows.filter("source is not null and at is not null and value is not null").distinct()
    return rows.groupBy("source", week_end("at").alias("week_end")).agg(F.avg("value").alias("value"), F.count("*").alias("readings"))


def fit_harmonics(weekly: DataFrame, order: int = 2, ridge: float = 1e-3) -> DataFrame:
    """source, beta: least squares of value on :func:`basis`, from sums of products per source."""
    names = [f"x{i}" for i in range(2 + 2 * order)]
    rows = weekly.select("source", F.col("value").alias("y"), *[c.alias(n) for n, c in zip(names, basis("week_end", order), strict=True)])
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    sums = rows.groupBy("source").agg(
        F.array(*[F.sum(F.col(a) * F.col(b)) for a, b in pairs]).alias("xx"),
        F.array(*[F.sum(F.col(a) * F.col("y")) for a in names]).alias("xy"),
    )
    size = len(names)
    upper = np.triu_indices(size)

    @F.pandas_udf("array<double>")
    def solve(xx: pd.Series, xy: pd.Series) -> pd.Series:
        if not len(xx):
            return pd.Series([], dtype=object)
        a = np.zeros((len(xx), size, size))
        a[:, upper[0], upper[1]] = np.stack(xx.to_numpy())
        a = a + np.triu(a, 1).transpose(0, 2, 1)
        penalty = np.eye(size) * ridge
        penalty[0, 0] = 1e-9  # the level is not shrunk
        weeks = a[:, 0, 0][:, None, None]
        beta = np.linalg.solve(a + penalty * np.maximum(weeks, 1) + np.eye(size) * 1e-9, np.stack(xy.to_numpy())[:, :, None])
        return pd.Series(list(beta[:, :, 0]))

    return sums.select("source", solve("xx", "xy").alias("beta"))


def regular_grid(df: DataFrame, source: str, time: str, value: str, reading_id: str, order: int = 2) -> DataFrame:
    """source, week_end, status ('observed' or 'missing'), readings, value, fitted.

    One row per source and Saturday from its first to its last week with a reading; ``value``
    is the weekly mean, or for missing weeks the prediction with bridged residuals.
    """
    weekly = weekly_readings(df, source, time, value, reading_id)
    fitted = sum((F.element_at("beta", i + 1) * c for i, c in enumerate(basis("week_end", order))), F.lit(0.0))
    known = weekly.join(fit_harmonics(weekly, order), "source").select("source", "week_end", "value", "readings", "beta", fitted.alias("fitted"))
    known = known.withColumn("residual", F.col("value") - F.col("fitted"))
    # Weeks per source are bounded by the calendar, so this window is small for every source.
    by_week = Window.partitionBy("source").orderBy("week_end")
    spans = known.withColumns({"next_week": F.lead("week_end").over(by_week), "next_residual": F.lead("residual").over(by_week)})
    steps = F.coalesce((F.datediff("next_week", "week_end") / 7).cast("int"), F.lit(1))
    grid = spans.select("*", F.explode(F.sequence(F.lit(0), steps - 1)).alias("step")).withColumn("steps", steps)
    week = F.date_add("week_end", F.col("step") * 7)
    at_week = sum((F.element_at("beta", i + 1) * c for i, c in enumerate(basis(week, order))), F.lit(0.0))
    bridge = F.col("residual") + (F.col("next_residual") - F.col("residual")) * F.col("step") / F.col("steps")
    observed = F.col("step") == 0
    return grid.select(
        "source",
        week.alias("week_end"),
        F.when(observed, "observed").otherwise("missing").alias("status"),
        F.when(observed, F.col("readings")).otherwise(F.lit(0)).alias("readings"),
        F.when(observed, F.col("value")).otherwise(at_week + bridge).alias("value"),
        at_week.alias("fitted"),
    )
