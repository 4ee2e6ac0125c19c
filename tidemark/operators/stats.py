"""Evaluation statistics as aggregates and windows."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.skew import prefix_sums


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def gap_closed(pred: str | Column, first: str | Column, final: str | Column) -> Column:
    """The share of the gap between first print and final value that a prediction closes; null without a gap."""
    gap = F.abs(_c(first) - _c(final))
    return F.when(gap > 1e-9, 1 - F.abs(_c(pred) - _c(final)) / gap)


def metrics(pred: str = "pred", final: str = "final", first: str = "first") -> list[Column]:
    """n, mae, rmse, r2, gap_total as aggregate expressions."""
    e, y = _c(pred) - _c(final), _c(final)
    n, var = F.count(e), F.sum(F.when(e.isNotNull(), y * y)) - F.count(e) * F.avg(F.when(e.isNotNull(), y)) ** 2
    gap = F.abs(_c(first) - y)
    closes = gap > 1e-9
    return [
        n.alias("n"),
        F.avg(F.abs(e)).alias("mae"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        (1 - F.sum(e * e) / F.when(var > 1e-12, var)).alias("r2"),
        (1 - F.sum(F.when(closes, F.abs(e))) / F.sum(F.when(closes & e.isNotNull(), gap))).alias("gap_total"),
    ]


def overlapping_groups(df: DataFrame, metro: str, home: str) -> DataFrame:
    """Each row once per group it belongs to: all, home or comparison, and its metro."""
    names = F.array(F.lit("all"), F.when(F.col(home), "home").otherwise("comparison"), F.concat(F.lit("metro:"), F.col(metro)))
    return df.withColumn("grp", F.explode(F.array_compact(names)))


def skill(table: DataFrame, by: list[str], model: str, baseline: str, measure: str = "mae") -> DataFrame:
    """``table`` with skill against the baseline model of the same group; null if the baseline has none."""
    base = table.filter(F.col(model) == baseline).select(*by, F.col(measure).alias("_base"))
    return table.join(base, by, "left").withColumn("skill", F.when(F.col("_base") > 0, 1 - F.col(measure) / F.col("_base"))).drop("_base")


def complete_pairs(df: DataFrame, key: list[str], model: str, models: int) -> DataFrame:
    """Rows of keys that every one of ``models`` models has predicted."""
    whole = df.groupBy(*key).agg(F.count_distinct(model).alias("_m")).filter(F.col("_m") == models)
    return df.join(whole.select(*key), key, "left_semi")


def counted_values(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """by, value, _ties, _upto: how many rows of a group hold each value, and how many hold it or a lesser one.

    Values are counted first, so ties never meet in one task; the running counts of a group are
    cut into ranges of its approximate quantiles and summed in two levels, so no group is sorted
    as a whole. The cuts decide only how work is divided; there are twice as many as tasks.
    """
    counts = df.groupBy(*by, value).agg(F.count("*").alias("_ties"))
    pieces = max(8, 2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    steps = F.lit([i / pieces for i in range(1, pieces)])
    cuts = counts.groupBy(*by).agg(F.percentile_approx(value, steps, max(500, 4 * pieces)).alias("_cuts"))
    on = counts
    for k in by:
        on = on.withColumnRenamed(k, f"_v_{k}")
    match = F.lit(True)
    for k in by:
        match = match & F.col(k).eqNullSafe(F.col(f"_v_{k}"))
    placed = on.join(cuts, match).withColumn("_piece", F.size(F.filter("_cuts", lambda c: c < F.col(value)))).select(*by, value, "_ties", "_piece")
    return prefix_sums(placed, by, [value], "_ties", "_upto", "_piece").select(*by, value, "_ties", "_upto")


def average_ranks(df: DataFrame, by: list[str], value: str, out: str) -> DataFrame:
    """``df`` with average ranks of ``value`` within ``by``, and _ties, the rows that share the value."""
    ranks = counted_values(df, by, value).select(*by, value, "_ties", (F.col("_upto") - (F.col("_ties") - 1) / 2).alias(out))
    return df.join(ranks, [*by, value]).select(*df.columns, out, "_ties")


def quantiles(df: DataFrame, by: list[str], value: str, ranks: dict[str, float]) -> DataFrame:
    """by and one column per entry of ``ranks``: exact quantiles with linear interpolation, nulls left out; groups without a value have no row."""
    known = df.select(*by, F.col(value).cast("double").alias("_x")).filter("_x is not null")
    counted = counted_values(known, by, "_x")
    sizes = known.groupBy(*[F.col(k).alias(f"_g_{k}") for k in by]).agg(F.count("*").alias("_n"))
    match = F.lit(True)
    for k in by:
        match = match & F.col(k).eqNullSafe(F.col(f"_g_{k}"))
    both = counted.join(sizes, match)
    at = {n: (F.col("_n") - 1) * F.lit(float(p)) for n, p in ranks.items()}
    found = []
    for n, place in at.items():
        low = F.floor(place)
        found += [F.min(F.when(F.col("_upto") > low, F.col("_x"))).alias(f"_lo_{n}"), F.min(F.when(F.col("_upto") > F.least(low + 1, F.col("_n") - 1), F.col("_x"))).alias(f"_hi_{n}")]
    per = both.groupBy(*by, "_n").agg(*found)
    return per.select(*by, *[(F.col(f"_lo_{n}") + (F.col(f"_hi_{n}") - F.col(f"_lo_{n}")) * (place - F.floor(place))).alias(n) for n, place in at.items()])


def normal_tail(z: Column) -> Column:
    """The two-sided p of a normal deviate, by the complementary error function's rational approximation (error below 1.5e-7)."""
    x = F.abs(z) / math.sqrt(2)
    t = 1 / (1 + x * 0.3275911)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return F.least(F.lit(1.0), poly * F.exp(-x * x))


#: Differences up to which the signed-rank test is exact; without ties.
EXACT_PAIRS = 50


def _exact_tails(m: pd.Series, w: pd.Series) -> pd.Series:
    """Two-sided p of signed-rank sums ``w`` over ``m`` untied differences: counts of the subsets of 1..m by their sum."""
    known: dict[int, np.ndarray] = {}
    out = []
    for size, total in zip(m, w, strict=True):
        if size is None or total is None or np.isnan(total) or not 0 < size <= EXACT_PAIRS:
            out.append(None)
            continue
        size, total = int(size), int(round(total))
        if size not in known:
            ways = np.ones(1)
            for k in range(1, size + 1):
                ways = np.pad(ways, (0, k)) + np.pad(ways, (k, 0))
            known[size] = ways / ways.sum()
        share = known[size]
        out.append(float(min(1.0, 2 * min(share[: total + 1].sum(), share[total:].sum()))))
    return pd.Series(out, dtype=float)


def wilcoxon(df: DataFrame, by: list[str], a: str, b: str) -> DataFrame:
    """by, n, m, w, z, p of the paired signed-rank test per group (one column at least).

    Zeros are dropped. p is exact up to EXACT_PAIRS differences without ties, and from the normal
    approximation with ties corrected else; z is of the approximation always. All ties give p = 1.
    """
    d = df.select(*by, F.round(F.col(a) - F.col(b), 6).alias("_d")).filter("_d is not null")
    signed = d.filter("_d <> 0").withColumn("_a", F.abs("_d"))
    ranked = average_ranks(signed, by, "_a", "_rank")
    sums = ranked.groupBy(*by).agg(F.count("*").alias("m"), F.sum(F.when(F.col("_d") > 0, F.col("_rank")).otherwise(0.0)).alias("w"), F.sum(F.col("_ties") * F.col("_ties") - 1).alias("t"))
    m = F.col("m").cast("double")
    var = m * (m + 1) * (2 * m + 1) / 24 - F.col("t") / 48
    z = (F.col("w") - m * (m + 1) / 4) / F.sqrt(F.when(var > 0, var))
    whole = d.groupBy(*by).agg(F.count("*").alias("n"))
    exact = F.pandas_udf(_exact_tails, "double")
    joined = whole.join(sums, by, "left").withColumn("_exact", exact(F.when((F.col("t") == 0) & (F.col("m") <= EXACT_PAIRS), F.col("m").cast("double")), F.col("w")))
    p = F.coalesce(F.when(~F.isnan("_exact"), F.col("_exact")), normal_tail(z), F.lit(1.0))
    return joined.select(*by, "n", F.coalesce("m", F.lit(0)).alias("m"), "w", z.alias("z"), p.alias("p"))


def _distinct_p(df: DataFrame, family: list[str], p: str) -> tuple[DataFrame, list[str]]:
    """Families as _f0.., _p, how many tests have it (_ties), how many have it or a lesser one (_upto), and the family's tests (_m).

    Equal p have equal adjustments, so windows run over distinct values only.
    """
    names = [f"_f{i}" for i in range(len(family))]
    known = df.filter(F.col(p).isNotNull()).groupBy(*[F.col(f).alias(n) for f, n in zip(family, names, strict=True)], F.col(p).alias("_p")).agg(F.count("*").alias("_ties"))
    line = Window.partitionBy(*names).orderBy("_p").rowsBetween(Window.unboundedPreceding, 0)
    return known.withColumns({"_upto": F.sum("_ties").over(line), "_m": F.sum("_ties").over(Window.partitionBy(*names))}), names


def _adjusted(df: DataFrame, family: list[str], p: str, steps: DataFrame, names: list[str], out: str) -> DataFrame:
    on = F.col(p) == F.col("_p")
    for f, n in zip(family, names, strict=True):
        on = F.col(f).eqNullSafe(F.col(n)) & on
    return df.join(steps.select(*names, "_p", "_adjusted"), on, "left").select(*df.columns, F.least(F.lit(1.0), "_adjusted").alias(out)).withColumn(out, F.when(F.col(p).isNotNull(), F.col(out)))


def holm(df: DataFrame, family: list[str], p: str) -> DataFrame:
    """``df`` with p_holm: step-down adjustment within a family; nulls stay null and do not count."""
    steps, names = _distinct_p(df, family, p)
    line = Window.partitionBy(*names).orderBy("_p").rowsBetween(Window.unboundedPreceding, 0)
    steps = steps.withColumn("_adjusted", F.max(F.col("_p") * (F.col("_m") - F.col("_upto") + F.col("_ties"))).over(line))
    return _adjusted(df, family, p, steps, names, "p_holm")


def benjamini_hochberg(df: DataFrame, family: list[str], p: str) -> DataFrame:
    """``df`` with p_fdr: step-up adjustment within a family; nulls stay null and do not count."""
    steps, names = _distinct_p(df, family, p)
    line = Window.partitionBy(*names).orderBy("_p").rowsBetween(0, Window.unboundedFollowing)
    steps = steps.withColumn("_adjusted", F.min(F.col("_p") * F.col("_m") / F.col("_upto")).over(line))
    return _adjusted(df, family, p, steps, names, "p_fdr")


def spearman(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """by, n, rho: correlation of average ranks; null below three pairs or for a constant."""
    both = df.select(*by, x, y).filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    ranked = average_ranks(average_ranks(both, by, x, "_rx").drop("_ties"), by, y, "_ry")
    n = F.count("*").cast("double")
    cov = F.sum(F.col("_rx") * F.col("_ry")) - F.sum("_rx") * F.sum("_ry") / n
    vx, vy = (F.sum(F.col(c) * F.col(c)) - F.sum(c) * F.sum(c) / n for c in ("_rx", "_ry"))
    return ranked.groupBy(*by).agg(F.count("*").alias("n"), F.when((F.count("*") >= 3) & (vx > 0) & (vy > 0), cov / F.sqrt(vx * vy)).alias("rho"))


def confusion(df: DataFrame, a: str, b: str) -> DataFrame:
    """a, b, n over all pairs that occur; nulls are a category of their own."""
    return df.groupBy(F.coalesce(F.col(a).cast("string"), F.lit("(none)")).alias("a"), F.coalesce(F.col(b).cast("string"), F.lit("(none)")).alias("b")).agg(F.count("*").alias("n"))


def _expected_equal(cells: DataFrame) -> float:
    """Sum over categories of the products of their marginal counts: one number."""
    left, right = cells.groupBy("a").agg(F.sum("n").alias("na")), cells.groupBy(F.col("b").alias("a")).agg(F.sum("n").alias("nb"))
    return float(left.join(right, "a").agg(F.sum(F.col("na") * F.col("nb").cast("double"))).first()[0] or 0.0)


def cohen_kappa(df: DataFrame, a: str, b: str, weights: str = "none") -> DataFrame:
    """n, observed, expected disagreement and kappa of two numeric or, unweighted, any ratings.

    Disagreement is 0 or 1 ('none'), |a - b| ('linear') or (a - b)^2 ('quadratic'). What chance
    leaves follows from marginal counts, moments or distribution functions, so categories are
    never paired. Only pairs without nulls count when weighted. Kappa is null if chance leaves
    no disagreement.
    """
    if weights == "none":
        cells = confusion(df, a, b)
        equal = _expected_equal(cells)
        seen = cells.agg(F.sum("n").alias("n"), F.sum(F.when(F.col("a") != F.col("b"), F.col("n")).otherwise(0)).alias("o"))
        observed, expected = F.col("o") / F.col("n"), 1 - F.lit(equal) / (F.col("n") * F.col("n"))
    else:
        both = df.select(F.col(a).cast("double").alias("a"), F.col(b).cast("double").alias("b")).filter("a is not null and b is not null")
        distance = F.abs(F.col("a") - F.col("b")) if weights == "linear" else (F.col("a") - F.col("b")) ** 2
        seen = both.agg(F.count("*").alias("n"), F.avg(distance).alias("o"), (F.avg(F.col("a") ** 2) + F.avg(F.col("b") ** 2) - 2 * F.avg("a") * F.avg("b")).alias("e"))
        observed, expected = F.col("o"), F.col("e")
        if weights == "linear":
            sides = both.select(F.explode(F.array(F.struct(F.col("a").alias("x"), F.lit(1).alias("p"), F.lit(0).alias("q")), F.struct(F.col("b").alias("x"), F.lit(0).alias("p"), F.lit(1).alias("q")))).alias("s"))
            steps = sides.groupBy(F.col("s.x").alias("x")).agg(F.sum("s.p").alias("p"), F.sum("s.q").alias("q"))  # a row per category
            w = Window.partitionBy(F.lit(1)).orderBy("x")
            upto = steps.select((F.lead("x").over(w) - F.col("x")).alias("gap"), F.sum("p").over(w).alias("p"), F.sum("q").over(w).alias("q"), F.sum("p").over(Window.partitionBy(F.lit(1))).alias("n"))
            fa, fb = F.col("p") / F.col("n"), F.col("q") / F.col("n")
            expected = F.lit(float(upto.agg(F.sum(F.col("gap") * (fa * (1 - fb) + fb * (1 - fa)))).first()[0] or 0.0))
    done = seen.select("n", observed.alias("observed"), expected.alias("expected"))
    return done.withColumn("kappa", F.when(F.col("expected") > 0, 1 - F.col("observed") / F.when(F.col("expected") > 0, F.col("expected"))))


def precision_recall(df: DataFrame, pred: str, truth: str) -> DataFrame:
    """cls, support, precision, recall, f1 for every class of the truth or of the predictions."""
    cells = df.groupBy(F.col(pred).cast("string").alias("p"), F.col(truth).cast("string").alias("t")).agg(F.count("*").alias("n"))
    hit = F.when(F.col("p") == F.col("t"), F.col("n")).otherwise(0)
    sides = F.array(F.struct(F.col("t").alias("cls"), F.col("n").alias("s"), F.lit(0).cast("long").alias("c"), hit.alias("h")), F.struct(F.col("p").alias("cls"), F.lit(0).cast("long").alias("s"), F.col("n").alias("c"), F.lit(0).cast("long").alias("h")))
    per = cells.select(F.explode(sides).alias("x")).select("x.*").filter("cls is not null").groupBy("cls").agg(F.sum("s").alias("support"), F.sum("c").alias("claimed"), F.sum("h").alias("hits"))
    precision, recall = F.col("hits") / F.when(F.col("claimed") > 0, F.col("claimed")), F.col("hits") / F.when(F.col("support") > 0, F.col("support"))
    return per.select("cls", "support", precision.alias("precision"), recall.alias("recall"), F.when(F.col("hits") > 0, 2 * F.col("hits") / (F.col("claimed") + F.col("support"))).otherwise(0.0).alias("f1"))


def grouped_kappa(cells: DataFrame, by: list[str], a: str, b: str, n: str, weights: str = "none") -> DataFrame:
    """by, n, observed, expected disagreement and kappa per group of ratings counted in ``n``; as cohen_kappa, 'none' or 'quadratic'."""
    if weights == "none":
        named = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("(none)"))
        both = cells.groupBy(*by, named(a).alias("_a"), named(b).alias("_b")).agg(F.sum(n).alias("_n"))
        left, right = both.groupBy(*by, "_a").agg(F.sum("_n").alias("_na")), both.groupBy(*by, F.col("_b").alias("_a")).agg(F.sum("_n").alias("_nb"))
        equal = left.join(right, [*by, "_a"]).groupBy(*by).agg(F.sum(F.col("_na") * F.col("_nb").cast("double")).alias("_equal"))
        seen = both.groupBy(*by).agg(F.sum("_n").alias("n"), F.sum(F.when(F.col("_a") != F.col("_b"), F.col("_n")).otherwise(0)).alias("_o")).join(equal, by, "left")
        observed, expected = F.col("_o") / F.col("n"), 1 - F.coalesce("_equal", F.lit(0.0)) / (F.col("n") * F.col("n").cast("double"))
    else:
        both = cells.select(*by, F.col(a).cast("double").alias("_a"), F.col(b).cast("double").alias("_b"), F.col(n).alias("_n")).filter("_a is not null and _b is not null")
        mean = lambda x: F.sum(F.col("_n") * x) / F.sum("_n")
        x, y = F.col("_a"), F.col("_b")
        seen = both.groupBy(*by).agg(F.sum("_n").alias("n"), mean((x - y) ** 2).alias("_o"), (mean(x * x) + mean(y * y) - 2 * mean(x) * mean(y)).alias("_e"))
        observed, expected = F.col("_o"), F.col("_e")
    done = seen.select(*by, "n", observed.alias("observed"), expected.alias("expected"))
    return done.withColumn("kappa", F.when(F.col("expected") > 0, 1 - F.col("observed") / F.when(F.col("expected") > 0, F.col("expected"))))


def grouped_precision_recall(cells: DataFrame, by: list[str], pred: str, truth: str, n: str) -> DataFrame:
    """by, cls, support, precision, recall, f1 per group of ratings counted in ``n``."""
    zero = F.lit(0).cast("long")
    hit = F.when(F.col(pred) == F.col(truth), F.col(n)).otherwise(zero)
    sides = F.array(F.struct(F.col(truth).cast("string").alias("cls"), F.col(n).alias("s"), zero.alias("c"), hit.alias("h")), F.struct(F.col(pred).cast("string").alias("cls"), zero.alias("s"), F.col(n).alias("c"), zero.alias("h")))
    per = cells.select(*by, F.explode(sides).alias("x")).select(*by, "x.*").filter("cls is not null").groupBy(*by, "cls").agg(F.sum("s").alias("support"), F.sum("c").alias("claimed"), F.sum("h").alias("hits"))
    precision, recall = F.col("hits") / F.when(F.col("claimed") > 0, F.col("claimed")), F.col("hits") / F.when(F.col("support") > 0, F.col("support"))
    return per.select(*by, "cls", "support", precision.alias("precision"), recall.alias("recall"), F.when(F.col("hits") > 0, 2 * F.col("hits") / (F.col("claimed") + F.col("support"))).otherwise(0.0).alias("f1"))


def bootstrap_mean(df: DataFrame, key: str, value: str, reps: int = 200, alpha: float = 0.05) -> DataFrame:
    """n, mean and a percentile interval of it from a Poisson bootstrap whose weights follow from a hash of key and repetition.

    Every row is drawn Poisson(1) times per repetition; sums per repetition combine map-side, so
    rows are not exchanged however many there are.
    """
    u = (F.pmod(F.xxhash64(key, "_rep"), F.lit(1 << 30)) + 0.5) / float(1 << 30)
    steps, total = [], 0.0
    for k in range(8):
        total += math.exp(-1) / math.factorial(k)
        steps.append(F.when(u >= total, 1).otherwise(0))
    weight = sum(steps[1:], steps[0])
    drawn = df.filter(F.col(value).isNotNull()).select(key, value, F.explode(F.sequence(F.lit(1), F.lit(reps))).alias("_rep")).withColumn("_w", weight)
    means = drawn.groupBy("_rep").agg((F.sum(F.col("_w") * F.col(value)) / F.when(F.sum("_w") > 0, F.sum("_w"))).alias("m"))
    low, high = means.agg(F.percentile("m", alpha / 2), F.percentile("m", 1 - alpha / 2)).first()  # one row
    return df.agg(F.count(value).alias("n"), F.avg(value).alias("mean")).select("n", "mean", F.lit(low).cast("double").alias("low"), F.lit(high).cast("double").alias("high"))
