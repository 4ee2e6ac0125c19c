"""Estimators: ridge by normal equations, autoregression on differences, and tree models.

Sums of products are built map-side and solved per group in Arrow batches, so training rows are
never gathered; a group may hold any share of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ridge_sums(df: DataFrame, by: list[str], features: list[str], target: str) -> DataFrame:
    """by, n and the sums of rows and of their products that a ridge needs, in named columns, so that they add up over groups.

    Rows with a null feature or target are left out.
    """
    rows = df.select(*by, *[F.col(f).cast("double").alias(f"_x{i}") for i, f in enumerate(features)], F.col(target).cast("double").alias("_y"))
    names = [*[f"_x{i}" for i in range(len(features))], "_y"]
    for n in names:
        rows = rows.filter(F.col(n).isNotNull())
    sums = [F.sum(a).alias(f"s{a}") for a in names] + [F.sum(F.col(a) * F.col(b)).alias(f"p{a}{b}") for i, a in enumerate(names) for b in names[i:]]
    return rows.groupBy(*by).agg(F.count("*").alias("n"), *sums)


def running_sums(sums: DataFrame, time: str, days: int, dates: list) -> DataFrame:
    """origin and the added sums of all rows of ``sums`` whose ``time`` is at least ``days`` before it; ``dates`` is a calendar, as the rows are."""
    values = [c for c in sums.columns if c not in (time,)]
    origins = F.array(*[F.lit(d).cast("date") for d in dates])
    seen = sums.withColumn("origin", F.explode(F.filter(origins, lambda o: F.col(time) <= F.date_sub(o, days))))
    return seen.groupBy("origin").agg(*[F.sum(c).alias(c) for c in values])


def other_sums(sums: DataFrame, group: str) -> DataFrame:
    """For each group the sums of all other groups: the total less its own."""
    values = [c for c in sums.columns if c != group]
    total = sums.agg(*[F.sum(c).alias(f"_t_{c}") for c in values])
    return sums.withColumn("_one", F.lit(1)).join(F.broadcast(total.withColumn("_1", F.lit(1))), F.col("_one") == F.col("_1")).select(group, *[(F.col(f"_t_{c}") - F.col(c)).alias(c) for c in values])  # one row


def ridge_solve(sums: DataFrame, by: list[str], features: list[str], ridge: float = 1.0, free: tuple[str, ...] = ()) -> DataFrame:
    """by, n, beta (intercept first) of the sums: standardised ridge, penalty on the sum-of-squares scale.

    The intercept and ``free`` features are not penalised; deviations are population ones, and a
    constant feature counts as deviation one. ``beta`` is on the features' own scale.
    """
    names = [*[f"_x{i}" for i in range(len(features))], "_y"]
    k = len(features)
    upper = np.triu_indices(k + 1)
    penalty = np.array([0.0 if f in free else ridge for f in features])

    @F.pandas_udf("array<double>")
    def solve(n: pd.Series, s: pd.Series, p: pd.Series) -> pd.Series:
        out = []
        for m, t, q in zip(n, s, p, strict=True):
            mean = np.asarray(t) / m
            full = np.zeros((k + 1, k + 1))
            full[upper] = q
            full = full + np.triu(full, 1).T
            cov = full - m * np.outer(mean, mean)
            sd = np.sqrt(np.maximum(np.diag(cov)[:k] / m, 0))
            sd[sd < 1e-12] = 1.0
            a = cov[:k, :k] / np.outer(sd, sd) + np.diag(penalty + 1e-8)
            b = np.linalg.solve(a, cov[:k, k] / sd) / sd
            out.append(np.r_[mean[k] - b @ mean[:k], b])
        return pd.Series(out, dtype=object)

    products = F.array(*[F.col(f"p{a}{b}") for i, a in enumerate(names) for b in names[i:]])
    return sums.filter("n > 0").select(*by, "n", solve("n", F.array(*[f"s{a}" for a in names]), products).alias("beta"))


def ridge_fit(df: DataFrame, by: list[str], features: list[str], target: str, ridge: float = 1.0, free: tuple[str, ...] = ()) -> DataFrame:
    """by, n, beta (intercept first): a ridge per group, from sums that are combined map-side; see :func:`ridge_solve`."""
    return ridge_solve(ridge_sums(df, by, features, target), by, features, ridge, free)


def linear(beta: str | Column, features: list[str]) -> Column:
    """The fitted value of coefficients (intercept first) at the features."""
    b = F.col(beta) if isinstance(beta, str) else beta
    value = F.element_at(b, 1)
    for i, f in enumerate(features):
        value = value + F.element_at(b, i + 2) * F.col(f)
    return value


def mean_imputed(df: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """Nulls replaced by the column's mean within ``by``, or 0 where there is none."""
    means = df.groupBy(*by).agg(*[F.avg(c).alias(f"_m_{c}") for c in columns])
    return df.join(means, by).withColumns({c: F.coalesce(c, f"_m_{c}", F.lit(0.0)) for c in columns}).drop(*[f"_m_{c}" for c in columns])


def ar_differences(df: DataFrame, key: str, time: str, value: str, step_days: int = 7, least: int = 30) -> DataFrame:
    """key, n, a1, a2, last, forecast: AR(2) on first differences of the log series on a regular grid, one step ahead.

    Gaps are interpolated linearly first. Conditional least squares from five sums per key, all
    by built-in windows and aggregates; keys with fewer than ``least`` points get no forecast.
    """
    w = Window.partitionBy(key).orderBy(time)
    logs = df.select(key, time, F.ln(F.greatest(F.col(value), F.lit(0.05))).alias("y")).filter("y is not null")
    spans = logs.withColumns({"_nt": F.lead(time).over(w), "_ny": F.lead("y").over(w)})
    spans = spans.withColumn("_n", F.coalesce(F.greatest((F.datediff("_nt", time) / step_days).cast("int"), F.lit(1)), F.lit(1)))
    grid = spans.withColumn("_k", F.explode(F.sequence(F.lit(0), F.col("_n") - 1))).select(key, F.date_add(time, F.col("_k") * step_days).alias("t"), F.when(F.col("_k") == 0, F.col("y")).otherwise(F.col("y") + (F.col("_ny") - F.col("y")) * F.col("_k") / F.col("_n")).alias("y"))
    g = Window.partitionBy(key).orderBy("t")
    d = grid.withColumn("d", F.col("y") - F.lag("y").over(g)).withColumns({"d1": F.lag("d", 1).over(g), "d2": F.lag("d", 2).over(g)})
    p = lambda a, b: F.sum(F.when(F.col("d2").isNotNull(), F.col(a) * F.col(b)))
    s = d.groupBy(key).agg(F.count("*").alias("n"), p("d1", "d1").alias("s11"), p("d1", "d2").alias("s12"), p("d2", "d2").alias("s22"), p("d", "d1").alias("r1"), p("d", "d2").alias("r2"), F.max_by("y", "t").alias("last"), F.max_by("d", "t").alias("e1"), F.max_by("d1", "t").alias("e2"))
    det = F.col("s11") * F.col("s22") - F.col("s12") ** 2
    ok = (F.col("n") >= least) & (det > 1e-12)
    a1 = F.when(ok, (F.col("r1") * F.col("s22") - F.col("r2") * F.col("s12")) / F.when(ok, det))
    a2 = F.when(ok, (F.col("r2") * F.col("s11") - F.col("r1") * F.col("s12")) / F.when(ok, det))
    return s.select(key, "n", a1.alias("a1"), a2.alias("a2"), F.exp("last").alias("last"), F.exp(F.col("last") + a1 * F.col("e1") + a2 * F.col("e2")).alias("forecast"))


def tree_model(kind: str, label: str, seed: int = 0):
    """A tree ensemble of the ML library: 'boosted', 'forest', or 'linear' for a ridge."""
    from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor

    made = {
        "boosted": lambda: GBTRegressor(featuresCol="_features", labelCol=label, maxIter=30, stepSize=0.1, maxDepth=4, minInstancesPerNode=50, seed=seed),
        "forest": lambda: RandomForestRegressor(featuresCol="_features", labelCol=label, numTrees=40, maxDepth=8, minInstancesPerNode=50, featureSubsetStrategy="0.6", seed=seed),
        "linear": lambda: LinearRegression(featuresCol="_features", labelCol=label, regParam=0.001),
    }
    if kind not in made:
        raise ValueError(f"unknown model {kind}")
    return made[kind]()


def assembled(df: DataFrame, features: list[str]) -> DataFrame:
    """``df`` with its features as one vector; rows with a null feature are left out."""
    from pyspark.ml.feature import VectorAssembler

    return VectorAssembler(inputCols=features, outputCol="_features", handleInvalid="skip").transform(df)


def refit_schedule(days: list, every_days: int = 28) -> dict:
    """The fit that each origin uses: a new one once ``every_days`` have passed since the last."""
    out, last = {}, None
    for d in sorted(days):
        if last is None or (d - last).days >= every_days:
            last = d
        out[d] = last
    return out


def fourier_features(df: DataFrame, features: list[str], size: int = 32, gamma: float = 0.5, seed: int = 0) -> tuple[DataFrame, list[str]]:
    """``df`` with random Fourier features of a Gaussian kernel, so that a ridge on them acts as a kernel machine."""
    rng = np.random.default_rng(seed)
    w, b = rng.normal(scale=np.sqrt(2 * gamma), size=(size, len(features))), rng.uniform(0, 2 * np.pi, size)
    names = [f"rff{i}" for i in range(size)]
    made = {}
    for i, n in enumerate(names):
        angle = F.lit(float(b[i]))
        for j, f in enumerate(features):
            angle = angle + F.col(f) * float(w[i, j])
        made[n] = F.cos(angle) * float(np.sqrt(2 / size))
    return df.withColumns(made), names


def grouped_predict(test: DataFrame, fits: DataFrame, by: list[str], features: list[str]) -> DataFrame:
    """``test`` with pred from the group's coefficients."""
    return test.join(fits.select(*by, "beta"), by).withColumn("pred", linear("beta", features)).drop("beta")


def apply_batches(df: DataFrame, label, schema: str) -> DataFrame:
    """A pluggable labeler over Arrow batches: ``label`` maps a pandas frame to another."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield label(pdf)

    return df.mapInPandas(run, schema)
