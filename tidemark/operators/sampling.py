"""Samples and shuffles whose order comes from a hash, so that they are the same on every run and engine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.skew import prefix_sums


def hash_order(key: str | Column, seed: int) -> Column:
    """A text that orders rows at random but always in the same way."""
    return F.md5(F.concat_ws("|", (F.col(key) if isinstance(key, str) else key).cast("string"), F.lit(str(seed))))


def allocate(sizes: DataFrame, stratum: str, size: str, n: int) -> DataFrame:
    """stratum, size, take: ``n`` over the strata in proportion to size; takes add up to n, or to all there are if these are fewer.

    Shares are cut to whole numbers, and raised to one where n covers all strata. What is then
    missing is given one at a time, over and over, to strata that have more, by largest remainder
    (equal: the greater name first); what is too much is taken back in the reverse order from
    strata that keep one. Strata without rows have no row. One row per stratum: windows over
    strata see as many rows as there are strata.
    """
    one = Window.partitionBy(F.lit(1))
    rows = sizes.filter(F.col(size) > 0).select(stratum, F.col(size).cast("long").alias("size"))
    rows = rows.withColumns({"total": F.sum("size").over(one), "strata": F.count("*").over(one)}).withColumn("wanted", F.least(F.lit(n), "total"))
    rows = rows.withColumn("quota", F.col("size") * F.col("wanted") / F.col("total").cast("double"))
    rows = rows.withColumn("base", F.when(F.col("wanted") >= F.col("strata"), F.greatest(F.floor("quota"), F.lit(1))).otherwise(F.floor("quota")))
    forward = F.row_number().over(one.orderBy(F.desc(F.col("quota") - F.floor("quota")), F.desc(stratum)))
    rows = rows.withColumns({"missing": F.col("wanted") - F.sum("base").over(one), "rank": forward})
    # Each unit that may be given or taken has a round; the first ones, by round and rank, are.
    room = F.when(F.col("missing") > 0, F.least(F.col("size") - F.col("base"), F.col("missing"))).otherwise(F.least(F.col("base") - 1, -F.col("missing")))
    units = rows.filter(room > 0).select(stratum, "missing", "rank", F.explode(F.sequence(F.lit(1), room.cast("int"))).alias("round"))
    turn = F.row_number().over(one.orderBy("round", F.when(F.col("missing") > 0, F.col("rank")).otherwise(-F.col("rank"))))
    moved = units.withColumn("turn", turn).filter(F.col("turn") <= F.abs("missing")).groupBy(stratum).agg(F.count("*").alias("moved"))
    done = rows.join(moved, stratum, "left")
    return done.select(stratum, "size", (F.col("base") + F.signum("missing") * F.coalesce("moved", F.lit(0))).cast("long").alias("take"))


def random_share(text: Column) -> Column:
    """A number in [0, 1) from the MD5 of a text."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / float(1 << 32)


def systematic(df: DataFrame, stratum: str, takes: DataFrame, listed: str, key: str, seed: int) -> DataFrame:
    """Evenly spaced rows of each stratum, as many as ``takes`` (stratum, size, take) says, from a random start.

    Rows are listed by ``listed`` and at random within it. Places in a stratum are sums over
    pieces of that order, so no stratum is sorted as a whole. Repeated keys take places of their own.
    """
    rows = df.withColumns({"_h": hash_order(key, seed), "_one": F.lit(1)}).withColumn("_piece", F.struct(F.col(listed), F.substring("_h", 1, 2).alias("h")))
    placed = prefix_sums(rows, [stratum], [listed, "_h", key], "_one", "_upto", "_piece")
    both = placed.join(takes.filter("take > 0"), stratum)
    step = F.col("size") / F.col("take").cast("double")
    start = random_share(F.concat_ws("|", F.col(stratum), F.lit(str(seed)))) * step
    taken = lambda x: F.greatest(F.ceil((x - start) / step), F.lit(0))
    picked = taken(F.col("_upto").cast("double")) > taken((F.col("_upto") - 1).cast("double"))
    return both.filter(picked).drop("_h", "_one", "_piece", "_upto", "size", "take")


def shuffle_within(df: DataFrame, group: str, slot: str, payload: list[str], seed: int) -> DataFrame:
    """``df`` with payload columns permuted over the slots of each group: slots in order take rows in hash order."""
    slots = df.withColumn("_i", F.row_number().over(Window.partitionBy(group).orderBy(slot)))
    drawn = df.withColumn("_i", F.row_number().over(Window.partitionBy(group).orderBy(hash_order(F.concat_ws("|", group, F.col(slot).cast("string")), seed)))).select(group, "_i", *payload)
    return slots.drop(*payload).join(drawn, [group, "_i"]).drop("_i")


def shuffles_within(df: DataFrame, group: str, slot: str, value: str, seeds: list[int]) -> DataFrame:
    """``df`` with ``values``: the row's own value, and those that shuffles by each of ``seeds`` within its group put in its place.

    A group's slots are one array in the order of slots: for groups that are bounded, as weeks of a site are.
    """
    own = F.array_sort(F.collect_list(F.struct(F.col(slot).alias("s"), F.struct("*").alias("r"))))
    g = df.groupBy(group).agg(own.alias("_rows"))
    drawn = [F.transform(F.array_sort(F.transform("_rows", lambda x, k=k: F.struct(hash_order(F.concat_ws("|", F.col(group).cast("string"), x["s"].cast("string")), k).alias("h"), x["r"][value].alias("v")))), lambda y: y["v"]) for k in seeds]
    made = g.select("_rows", *[d.alias(f"_d{k}") for k, d in zip(seeds, drawn, strict=True)]).select(F.posexplode("_rows").alias("_i", "_x"), *[f"_d{k}" for k in seeds])
    return made.select("_x.r.*", F.array(F.col(f"_x.r.{value}"), *[F.get(f"_d{k}", F.col("_i")) for k in seeds]).alias("values"))


def place_synthetic(weeks: DataFrame, group: str, time: str, value: str, real: str, precision: float | Column, scale: float | Column, seed: int | Column, run: str | None = None, top_share: float = 0.1) -> DataFrame:
    """``weeks`` with ``placed``: 'rise', 'other' or null, where synthetic signals of a known worth go.

    Per group there are ``scale`` times as many as weeks with ``real`` > 0, one at least and at
    most all; a share of ``precision`` of them lies in weeks drawn from the greatest rises of the
    logarithm of ``value`` (their top share, or more if that is too few), the others in other
    weeks. Draws follow hashes of group, week and seed. ``run`` names a column of runs, each with
    settings of its own. Groups are weeks of a place: bounded.
    """
    by = [group] if run is None else [group, run]
    precision, scale, seed = (x if isinstance(x, Column) else F.lit(x) for x in (precision, scale, seed))
    line, whole = Window.partitionBy(*by).orderBy(time), Window.partitionBy(*by)
    drawn_by = lambda k: F.md5(F.concat_ws("|", F.col(group).cast("string"), F.col(time).cast("string"), (seed + k).cast("string")))
    rows = weeks.withColumn("_log", F.when(F.col(value) > 0, F.ln(value))).withColumn("_rise", F.col("_log") - F.lag("_log").over(line))
    rows = rows.withColumns({"_real": F.sum(F.when(F.col(real) > 0, 1).otherwise(0)).over(whole), "_weeks": F.count("*").over(whole), "_rises": F.count("_rise").over(whole)})
    k = F.least(F.greatest(F.round(F.col("_real") * scale).cast("long"), F.lit(1)), "_weeks")
    rows = rows.withColumn("_k", k).withColumn("_hits", F.least(F.round(F.col("_k") * precision).cast("long"), "_rises"))
    rank = F.when(F.col("_rise").isNotNull(), F.row_number().over(whole.orderBy(F.col("_rise").desc_nulls_last(), time)))
    rows = rows.withColumn("_pool", F.coalesce(rank <= F.greatest(F.col("_hits"), F.ceil(F.col("_rises") * top_share)), F.lit(False)))
    drawn = F.row_number().over(Window.partitionBy(*by, "_pool").orderBy(drawn_by(0)))
    rows = rows.withColumn("_hit", F.col("_pool") & (drawn <= F.col("_hits")))
    other = F.row_number().over(Window.partitionBy(*by, "_hit").orderBy(drawn_by(1)))
    placed = F.when(F.col("_hit"), "rise").when(other <= F.col("_k") - F.col("_hits"), "other")
    return rows.withColumn("placed", placed).select(*weeks.columns, "placed")
