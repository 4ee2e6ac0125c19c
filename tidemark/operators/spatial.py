"""Neighbour graphs and local cluster statistics on points and cells."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.stats import benjamini_hochberg, quantiles
from tidemark.session import durable


def bbox_overlap(west: Column, south: Column, east: Column, north: Column, box: tuple[float, float, float, float]) -> Column:
    """Whether a rectangle touches the box (west, south, east, north)."""
    return (west <= box[2]) & (east >= box[0]) & (south <= box[3]) & (north >= box[1])


def grid_edges(cells: DataFrame, key: str, row: str, col: str) -> DataFrame:
    """src, dst of cells that share a side or a corner: each cell looks up its eight places, so the join is by place."""
    places = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b])
    asks = cells.select(F.col(key).alias("src"), F.col(row).alias("_r"), F.col(col).alias("_c"), F.explode(places).alias("p")).select("src", (F.col("_r") + F.col("p.a")).alias("_r"), (F.col("_c") + F.col("p.b")).alias("_c"))
    return asks.join(cells.select(F.col(key).alias("dst"), F.col(row).alias("_r"), F.col(col).alias("_c")), ["_r", "_c"]).select("src", "dst")


def near_edges(points: DataFrame, key: str, x: str, y: str, radius: float, asking: DataFrame | None = None) -> DataFrame:
    """src, dst, distance of points within ``radius``: cells of that size, each point, or each of ``asking`` (k, x, y), looks into nine of them."""
    cell = lambda c: F.floor(F.col(c) / radius)
    placed = points.select(F.col(key).alias("k"), F.col(x).alias("x"), F.col(y).alias("y"), cell(x).alias("cx"), cell(y).alias("cy")).filter("x is not null and y is not null")
    around = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)])
    who = placed if asking is None else asking.select("k", "x", "y", cell("x").alias("cx"), cell("y").alias("cy"))
    asks = who.select(F.col("k").alias("src"), F.col("x").alias("sx"), F.col("y").alias("sy"), "cx", "cy", F.explode(around).alias("p"))
    asks = asks.select("src", "sx", "sy", (F.col("cx") + F.col("p.a")).alias("cx"), (F.col("cy") + F.col("p.b")).alias("cy"))
    both = asks.join(placed.select(F.col("k").alias("dst"), "x", "y", "cx", "cy"), ["cx", "cy"])
    d = F.sqrt((F.col("x") - F.col("sx")) ** 2 + (F.col("y") - F.col("sy")) ** 2)
    return both.withColumn("distance", d).filter((F.col("src") != F.col("dst")) & (F.col("distance") <= radius)).select("src", "dst", "distance")


def gi_star(values: DataFrame, edges: DataFrame, key: str, value: str) -> DataFrame:
    """key, z: the Getis-Ord Gi* deviate with the cell itself among its neighbours, weights one, in closed form."""
    v = values.select(F.col(key).alias("k"), F.col(value).cast("double").alias("v")).filter("v is not null")
    whole = v.agg(F.count("*").cast("double").alias("n"), F.avg("v").alias("m"), F.stddev_pop("v").alias("s")).first()  # one row
    if not whole["n"] or whole["n"] < 3 or not whole["s"]:
        return v.limit(0).select(F.col("k").alias(key), F.lit(None).cast("double").alias("z"))
    n, m, s = whole["n"], whole["m"], whole["s"]
    links = edges.select(F.col("src").alias("k"), F.col("dst").alias("j")).distinct().filter("k <> j").unionByName(v.select("k", F.col("k").alias("j")))
    sums = links.join(v.select(F.col("k").alias("j"), "v"), "j").groupBy("k").agg(F.sum("v").alias("t"), F.count("*").cast("double").alias("w"))
    sums = sums.join(v.select("k"), "k", "left_semi")
    under = (n * F.col("w") - F.col("w") * F.col("w")) / (n - 1)
    return sums.select(F.col("k").alias(key), ((F.col("t") - m * F.col("w")) / (s * F.sqrt(F.when(under > 1e-12, under)))).alias("z"))


def local_moran(values: DataFrame, edges: DataFrame, key: str, value: str) -> DataFrame:
    """key, i, quadrant: local Moran's I with row-standardised weights; HH, LL, HL or LH by the signs of cell and neighbours."""
    v = values.select(F.col(key).alias("k"), F.col(value).cast("double").alias("v")).filter("v is not null")
    whole = v.agg(F.avg("v").alias("m"), F.var_pop("v").alias("s2")).first()  # one row
    if whole["s2"] is None or whole["s2"] == 0:
        return v.limit(0).select(F.col("k").alias(key), F.lit(None).cast("double").alias("i"), F.lit(None).cast("string").alias("quadrant"))
    z = v.withColumn("z", F.col("v") - F.lit(whole["m"]))
    links = edges.select(F.col("src").alias("k"), F.col("dst").alias("j")).distinct().filter("k <> j")
    lag = links.join(z.select(F.col("k").alias("j"), F.col("z").alias("zj")), "j").groupBy("k").agg(F.avg("zj").alias("lag"))
    both = z.join(lag, "k")
    quadrant = F.concat(F.when(F.col("z") > 0, "H").otherwise("L"), F.when(F.col("lag") > 0, "H").otherwise("L"))
    return both.select(F.col("k").alias(key), (F.col("z") * F.col("lag") / F.lit(whole["s2"])).alias("i"), quadrant.alias("quadrant"))


def ring_edges(shapes: DataFrame, key: str, ring: str, digits: int = 6) -> DataFrame:
    """src, dst of shapes that share a corner or side: shapes meet at the rounded points of their rings (array of array(x, y))."""
    points = shapes.select(F.col(key).alias("src"), F.explode(F.col(ring)).alias("p")).select("src", F.round(F.get("p", F.lit(0)), digits).alias("x"), F.round(F.get("p", F.lit(1)), digits).alias("y")).distinct()
    both = points.join(points.withColumnRenamed("src", "dst"), ["x", "y"])
    return both.filter("src <> dst").select("src", "dst").distinct()


def attach_islands(edges: DataFrame, points: DataFrame, key: str, x: str, y: str, radius: float) -> tuple[DataFrame, DataFrame]:
    """``edges`` with each point that has none tied, both ways, to its nearest other point; and these points (key).

    Points look into growing circles, from ``radius`` on, until each island has met one or the
    circle holds all; equal distances: the lesser key.
    """
    placed = points.select(F.col(key).alias("k"), F.col(x).alias("x"), F.col(y).alias("y")).filter("x is not null and y is not null")
    alone = durable(placed.join(edges.select(F.col("src").alias("k")).distinct(), "k", "left_anti"))
    extent = placed.agg(F.greatest(F.max("x") - F.min("x"), F.max("y") - F.min("y")).alias("d"), F.count("*").alias("n")).first()
    left, found = alone, edges.select("src", "dst")
    while extent["n"] > 1 and not left.isEmpty():
        near = near_edges(placed, "k", "x", "y", radius, left)
        tied = durable(near.groupBy("src").agg(F.min(F.struct("distance", "dst")).alias("m")).select("src", F.col("m.dst").alias("dst")))
        found = found.unionByName(tied).unionByName(tied.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        left = durable(left.join(tied.select(F.col("src").alias("k")), "k", "left_anti"))
        radius *= 2
    return found.distinct(), alone.select(F.col("k").alias(key))


def _draws(values: DataFrame, sizes: list[int], rounds: int, seed: int) -> tuple[DataFrame, dict[int, tuple[np.ndarray, np.ndarray]]]:
    """``values`` (k, v) with a rank at random, and for each size n ``rounds`` draws of n + 1 different ranks with their values.

    Only the values at drawn ranks reach the driver: rounds x (n + 1) for each number of neighbours that occurs.
    """
    spark, cells = values.sparkSession, values.count()
    numbered = values.orderBy(F.xxhash64("k", F.lit(seed)), "k").rdd.zipWithIndex().map(lambda x: (*x[0], x[1]))
    ranked = durable(spark.createDataFrame(numbered, T.StructType([*values.schema.fields, T.StructField("rank", T.LongType())])))
    ranks = {}
    for n in sizes:
        rng = np.random.default_rng(seed + n)
        if n + 1 > cells:
            continue
        if cells <= 4 * (n + 1):
            ranks[n] = np.argsort(rng.random((rounds, cells)), axis=1)[:, : n + 1]
            continue
        drawn = rng.integers(0, cells, size=(rounds, n + 1))
        while True:  # rows with a rank twice are drawn again
            s = np.sort(drawn, axis=1)
            bad = np.flatnonzero((s[:, 1:] == s[:, :-1]).any(axis=1))
            if not len(bad):
                break
            drawn[bad] = rng.integers(0, cells, size=(len(bad), n + 1))
        ranks[n] = drawn
    needed = np.unique(np.concatenate([x.ravel() for x in ranks.values()])) if ranks else np.array([], dtype=np.int64)
    wanted = spark.createDataFrame([(int(x),) for x in needed], "rank long")
    at = {r["rank"]: r["v"] for r in ranked.join(F.broadcast(wanted), "rank").select("rank", "v").collect()}  # as many as draws
    held = np.array([at[x] for x in needed.tolist()], dtype=float)
    return ranked, {n: (x, held[np.searchsorted(needed, x)]) for n, x in ranks.items()}


def permutation_test(values: DataFrame, edges: DataFrame, key: str, value: str, rounds: int = 9999, seed: int = 4109) -> DataFrame:
    """key, value, n, observed, expected, deviation, z, p: conditional permutation test of the mean of a cell's neighbours.

    The cell keeps its value and its neighbours' are drawn from all other cells of the map, without
    repeats; the draws are the same for all cells with as many neighbours, but where a cell draws
    itself it takes one more. z is against the draws' mean and deviation, p is two-sided. Cells
    without neighbours or value have no row, nor those with as many neighbours as the map has cells.
    """
    v = values.select(F.col(key).alias("k"), F.col(value).cast("double").alias("v")).filter("v is not null")
    links = edges.select(F.col("src").alias("k"), F.col("dst").alias("j")).distinct().filter("k <> j")
    seen = links.join(v.select(F.col("k").alias("j"), F.col("v").alias("vj")), "j").groupBy("k").agg(F.avg("vj").alias("observed"), F.count("*").cast("int").alias("n"))
    ranked, draws = _draws(v, sorted(r[0] for r in seen.select("n").distinct().collect()), rounds, seed)  # numbers of neighbours
    plain = {n: (np.sort(x[:, :n].mean(axis=1)), x[:, :n].mean(axis=1)) for n, (_, x) in draws.items()}
    holds = {n: {} for n in draws}
    for n, (r, _) in draws.items():
        for i, rank in zip(*np.nonzero(r[:, :n] >= 0), strict=True):
            holds[n].setdefault(int(r[i, rank]), []).append((int(i), int(rank)))

    def test(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for k, own, rank, observed, n in pdf[["k", "v", "rank", "observed", "n"]].itertuples(index=False):
                if n not in plain:
                    continue
                means = plain[n][0]
                if again := holds[n].get(rank):
                    means = plain[n][1].copy()
                    for i, j in again:
                        means[i] += (draws[n][1][i, n] - draws[n][1][i, j]) / n
                    means.sort()
                above, below = rounds - np.searchsorted(means, observed - 1e-12), np.searchsorted(means, observed + 1e-12, side="right")
                sd = means.std()
                rows.append((k, own, n, observed, means.mean(), sd, (observed - means.mean()) / sd if sd > 0 else 0.0, min(1.0, 2 * (min(above, below) + 1) / (rounds + 1))))
            yield pd.DataFrame(rows, columns=["k", "value", "n", "observed", "expected", "deviation", "z", "p"])

    kind = v.schema["k"].dataType.simpleString()
    return seen.join(ranked, "k").mapInPandas(test, f"k {kind}, value double, n int, observed double, expected double, deviation double, z double, p double").withColumnRenamed("k", key)


def hot_spots(values: DataFrame, edges: DataFrame, key: str, value: str, rounds: int = 9999, seed: int = 4109) -> DataFrame:
    """key, value, z, p, p_fdr, class: Getis-Ord Gi* with row-standardised weights, the cell one of its own neighbours.

    The mean of a cell and its neighbours moves with the neighbours' mean alone when these are
    drawn anew, so z and p are those of :func:`permutation_test`. class: hot or cold spot at 99,
    95 or 90 % by the false discovery rate over the map.
    """
    tested = benjamini_hochberg(permutation_test(values, edges, key, value, rounds, seed).withColumn("_map", F.lit(1)), ["_map"], "p")
    kind = F.when(F.col("z") > 0, "Hot spot ").otherwise("Cold spot ")
    level = F.when(F.col("p_fdr") < 0.01, "99%").when(F.col("p_fdr") < 0.05, "95%").when(F.col("p_fdr") < 0.10, "90%")
    return tested.select(key, "value", "z", "p", "p_fdr", F.coalesce(F.concat(kind, level), F.lit("Not significant")).alias("class"))


def local_clusters(values: DataFrame, edges: DataFrame, key: str, value: str, rounds: int = 9999, seed: int = 4109, alpha: float = 0.05) -> DataFrame:
    """key, value, i, z, p, p_fdr, class: local Moran's I with row-standardised weights; class names cell and neighbours, High or Low, where p_fdr is below ``alpha``."""
    whole = values.filter(F.col(value).isNotNull()).agg(F.avg(value).alias("m"), F.var_pop(value).alias("s2")).first()  # one row
    tested = benjamini_hochberg(permutation_test(values, edges, key, value, rounds, seed).withColumn("_map", F.lit(1)), ["_map"], "p")
    mean, var = whole["m"] or 0.0, whole["s2"] or 1.0
    own, near = F.col("value") - mean, F.col("observed") - mean
    side = lambda c: F.when(c > 0, "High").otherwise("Low")
    named = F.when(F.col("p_fdr") < alpha, F.concat(side(own), F.lit("-"), side(near))).otherwise("Not significant")
    return tested.select(key, "value", (own * near / var).alias("i"), (F.col("z") * F.signum(own)).alias("z"), "p", "p_fdr", named.alias("class"))


def clusters(values: DataFrame, edges: DataFrame, key: str, value: str, measure: str, rounds: int = 9999) -> DataFrame:
    """key, z, p, p_fdr, class by what is measured: hot spots of a 'level', local clusters of a 'change'; no rows for fewer than three values."""
    known = values.filter(F.col(value).isNotNull())
    few = known.limit(3).count() < 3
    found = hot_spots(known, edges, key, value, rounds) if measure == "level" else local_clusters(known, edges, key, value, rounds)
    return found.select(key, "z", "p", "p_fdr", "class").filter(F.lit(not few))


def nearest(points: DataFrame, key: str, x: str, y: str, at: tuple[float, float], k: int) -> DataFrame:
    """The ``k`` points nearest to a place, by squared degrees: a top-k, not a sort."""
    d2 = (F.col(x) - at[0]) ** 2 + (F.col(y) - at[1]) ** 2
    return points.select(key, d2.alias("d2")).orderBy("d2", key).limit(k)


def in_polygon(x: Column, y: Column, ring: list[tuple[float, float]]) -> Column:
    """Whether a point is inside a ring, by crossings of a ray; a built-in expression over the ring's sides."""
    crossings: Column = F.lit(0)
    for (x1, y1), (x2, y2) in zip(ring, [*ring[1:], ring[0]], strict=True):
        if y1 == y2:
            continue
        crosses = ((F.lit(y1) > y) != (F.lit(y2) > y)) & (x < (x2 - x1) * (y - y1) / (y2 - y1) + x1)
        crossings = crossings + crosses.cast("int")
    return crossings % 2 == 1


def albers(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Equal-area conic coordinates in kilometres for the contiguous states, on a sphere."""
    rad = math.pi / 180
    p1, p2, p0, l0, r = 29.5 * rad, 45.5 * rad, 23 * rad, -96 * rad, 6371.0
    n = (math.sin(p1) + math.sin(p2)) / 2
    c = math.cos(p1) ** 2 + 2 * n * math.sin(p1)
    rho0 = r * math.sqrt(c - 2 * n * math.sin(p0)) / n
    rho = r * F.sqrt(F.lit(c) - 2 * n * F.sin(lat * rad)) / n
    theta = n * (lon * rad - l0)
    return rho * F.sin(theta), F.lit(rho0) - rho * F.cos(theta)


def class_breaks(values: DataFrame, value: str, k: int = 7) -> DataFrame:
    """One row, breaks: quantiles rounded half-even to 0.5, distinct, from 0 to the maximum rounded up."""
    one = values.withColumn("_map", F.lit(1))
    q = quantiles(one, ["_map"], value, {f"_q{i}": i / k for i in range(1, k)})
    top = one.groupBy("_map").agg(F.ceil(F.max(value)).cast("double").alias("top"))
    rounded = F.transform(F.array(*[f"_q{i}" for i in range(1, k)]), lambda x: F.bround(x * 2) / 2)
    return q.join(top, "_map").select(F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0.0)), rounded, F.array("top")))).alias("breaks"))


def outline_edges(edges: DataFrame, groups: DataFrame, key: str, group: str) -> DataFrame:
    """Links between cells of different groups: the outline that dissolving groups leaves."""
    a = groups.select(F.col(key).alias("src"), F.col(group).alias("ga"))
    b = groups.select(F.col(key).alias("dst"), F.col(group).alias("gb"))
    return edges.join(a, "src").join(b, "dst").filter("ga <> gb and src < dst").select("src", "dst", "ga", "gb")


def one_per_group(df: DataFrame, group: str, order: list[Column]) -> DataFrame:
    """The first row of each group in an order, with the group's size."""
    w = Window.partitionBy(group)
    return df.withColumns({"members": F.count("*").over(w), "_rn": F.row_number().over(w.orderBy(*order))}).filter("_rn = 1").drop("_rn")


def nice(x: Column) -> Column:
    """The nearest of 1, 2, 2.5, 5 and 10 times a power of ten, by ratio; at least 0.1, and 0.5 where x is not positive."""
    power = F.pow(F.lit(10.0), F.floor(F.log10(x)))
    near = F.array(*[F.struct(F.abs(F.ln(power * m) - F.ln(x)).alias("d"), (power * m).alias("v")) for m in (1.0, 2.0, 2.5, 5.0, 10.0)])
    return F.when(x > 0, F.greatest(F.array_min(near)["v"], F.lit(0.1))).otherwise(0.5)


def change_breaks(values: DataFrame, change: str) -> tuple[float, float]:
    """The inner and outer break of a symmetric scale of changes, from the 90th percentile of their size: one row."""
    spread = quantiles(values.select(F.lit(1).alias("_map"), F.abs(change).alias("_size")), ["_map"], "_size", {"_q": 0.9})
    row = spread.select(nice(F.col("_q") / 2).alias("a")).select("a", F.least(nice(F.col("a") / 4), F.col("a") / 2).alias("b")).first()
    return (float(row["b"]), float(row["a"])) if row else (0.25, 1.0)


def change_bin(change: str | Column, inner: float, outer: float) -> Column:
    """-3 to 3 by the breaks -2 outer, -outer, -inner, inner, outer, 2 outer: each class holds its upper break; 0 is about the same."""
    c = F.col(change) if isinstance(change, str) else change
    bin_ = F.when(c.isNotNull(), F.lit(3))
    for value, top in ((2, 2 * outer), (1, outer), (0, inner), (-1, -inner), (-2, -outer), (-3, -2 * outer)):
        bin_ = F.when(c <= top, F.lit(value)).otherwise(bin_)
    return bin_
