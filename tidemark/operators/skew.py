"""Splitting hot keys over time without changing results.

``plan_shards`` cuts the time line of every key that holds more than ``shard_rows`` rows into
ranges of about that size, at approximate quantiles from mergeable sketches, so no key is ever
sorted to plan it. Cuts decide how work is divided, never what comes out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.session import durable

#: A plan of at most this many rows (about 4 MB) is broadcast; a larger one is joined by key and salt.
BROADCAST_PLAN_ROWS = 50_000
#: Into how many parts the rows of a key are spread for that join.
JOIN_SALTS = 64
#: Ranges per key at most; a key with more rows than that many shards hold gets larger shards.
MOST_RANGES = 20_000


def order_number(time: str | Column, kind: T.DataType) -> Column:
    """A date, timestamp or whole number as a long in the same order."""
    c = F.col(time) if isinstance(time, str) else time
    if isinstance(kind, T.DateType):
        return F.unix_date(c).cast("long")
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(c.cast("timestamp"))
    return c.cast("long")


class ShardPlan:
    """Ranges ``[_lo, _hi)`` of the order number per hot key, with _shard (from 1) and _salts."""

    def __init__(self, rows: DataFrame | None, keys: list[str]) -> None:
        self.rows, self.keys = rows, keys
        self.count = rows.count() if rows is not None else 0

    @property
    def empty(self) -> bool:
        return self.count == 0

    def assign(self, df: DataFrame, time: str, broadcast_rows: int = BROADCAST_PLAN_ROWS) -> DataFrame:
        """``df`` with ``_shard`` (0 for keys that are not hot) and ``_salts``, by key and ``time``."""
        if self.empty:
            return df.withColumns({"_shard": F.lit(0), "_salts": F.lit(1)})
        plan = self.rows.select(*[F.col(k).alias(f"_p_{k}") for k in self.keys], "_lo", "_hi", F.col("_shard").alias("_s"), F.col("_salts").alias("_n"))
        at = order_number(time, df.schema[time].dataType)
        match = (at >= F.col("_lo")) & (F.col("_hi").isNull() | (at < F.col("_hi")))
        for k in self.keys:
            match = (F.col(k) == F.col(f"_p_{k}")) & match
        rows = df
        if self.count <= broadcast_rows:
            plan = F.broadcast(plan)
        else:  # a hot key's rows meet its ranges in many tasks
            rows = df.withColumn("_spread", F.pmod(F.xxhash64(F.struct("*")), F.lit(JOIN_SALTS)))
            plan = plan.withColumn("_spread_of", F.explode(F.sequence(F.lit(0), F.lit(JOIN_SALTS - 1))))
            match = match & (F.col("_spread") == F.col("_spread_of"))
        joined = rows.join(plan, match, "left")
        return joined.select(*df.columns, F.coalesce("_s", F.lit(0)).alias("_shard"), F.coalesce("_n", F.lit(1)).alias("_salts"))


def plan_shards(df: DataFrame, keys: list[str], time: str, shard_rows: int) -> ShardPlan:
    """The shards of all keys with more than ``shard_rows`` rows in ``df``.

    Rows of one moment are never divided over ranges; a range that still holds clearly more than
    ``shard_rows`` rows gets ``_salts`` > 1, for operators that may spread it further.
    """
    spark = df.sparkSession
    per_key = durable(df.groupBy(*keys).agg(F.count("*").alias("_total")).filter(F.col("_total") > shard_rows))
    most = per_key.agg(F.max("_total")).first()[0]
    if most is None:
        return ShardPlan(None, keys)
    size = max(shard_rows, -(-most // MOST_RANGES))
    grid = max(2, -(-most // size))
    hot = df.join(per_key, keys).select(*keys, "_total", order_number(time, df.schema[time].dataType).alias("_at")).filter("_at is not null")
    marks = F.percentile_approx("_at", F.lit([i / grid for i in range(1, grid)]), max(10_000, 4 * grid))
    pieces = F.ceil(F.col("_total") / size).cast("int")
    place = lambda i: F.greatest(F.least(F.round(i * grid / pieces).cast("int"), F.lit(grid - 1)), F.lit(1))
    cuts = hot.groupBy(*keys, "_total").agg(marks.alias("_marks"), F.min("_at").alias("_first"))
    cuts = cuts.select(*keys, F.array_sort(F.array_distinct(F.concat(F.array("_first"), F.transform(F.sequence(F.lit(1), F.greatest(pieces - 1, F.lit(1))), lambda i: F.element_at("_marks", place(i)))))).alias("_cuts"))
    ranges = cuts.select(*keys, F.posexplode("_cuts").alias("_i", "_lo"), "_cuts")
    ranges = durable(ranges.select(*keys, "_lo", F.get("_cuts", F.col("_i") + 1).alias("_hi"), (F.col("_i") + 1).alias("_shard"), F.lit(1).alias("_salts")))
    plan = ShardPlan(ranges, keys)
    held = plan.assign(df.select(*keys, time), time).filter("_shard > 0").groupBy(*keys, "_shard").agg(F.count("*").alias("_rows"))
    salts = F.greatest(F.round(F.col("_rows") / size), F.lit(1)).cast("int")
    return ShardPlan(durable(ranges.drop("_salts").join(held, [*keys, "_shard"], "left").select(*keys, "_lo", "_hi", "_shard", F.coalesce(salts, F.lit(1)).alias("_salts"))), keys)


def halo_rows(placed: DataFrame, plan: ShardPlan, order: list[str], halo: int, wanted: Column | None = None) -> DataFrame:
    """For each shard of ``placed`` (with _shard) the ``halo`` nearest rows before and after it, as rows of that shard.

    ``wanted``: only rows that meet it count and are carried. Per shard the first and the last
    ``halo`` rows are enough; they are handed on over shards that have fewer.
    """
    keys = plan.keys
    if plan.empty:
        return placed.limit(0)
    hot = placed.filter("_shard > 0") if wanted is None else placed.filter("_shard > 0").filter(wanted)
    piece, line = Window.partitionBy(*keys, "_shard"), Window.partitionBy(*keys).orderBy("_shard")
    row, sides = F.struct(*order, *[c for c in placed.columns if c not in order]), []
    for down in (True, False):
        near = hot.withColumn("_near", F.row_number().over(piece.orderBy(*[F.desc(c) if down else F.asc(c) for c in order]))).filter(F.col("_near") <= halo)
        edge = near.groupBy(*keys, "_shard").agg(F.collect_list(row).alias("_edge"))  # at most halo rows
        edge = edge.withColumn("_all", F.array_sort(F.flatten(F.collect_list("_edge").over(line.rowsBetween(-(halo - 1), 0) if down else line.rowsBetween(0, halo - 1)))))
        nearest = F.slice("_all", -halo, halo) if down else F.slice("_all", 1, halo)
        state = edge.select(*keys, "_shard", F.when(F.size("_all") > halo, nearest).otherwise(F.col("_all")).alias("_state"))
        shards = plan.rows.select(*keys, "_shard").join(state, [*keys, "_shard"], "left")
        handed = F.last("_state", ignorenulls=True).over(line.rowsBetween(Window.unboundedPreceding, -1)) if down else F.first("_state", ignorenulls=True).over(line.rowsBetween(1, Window.unboundedFollowing))
        given = shards.select("_shard", handed.alias("_rows")).select(F.col("_shard").alias("_to"), F.explode("_rows").alias("_r"))
        sides.append(given.select(*[F.col("_to" if c == "_shard" else f"_r.{c}").alias(c) for c in placed.columns]))
    return sides[0].unionByName(sides[1])


def prefix_sums(df: DataFrame, keys: list[str], order: list[str], value: str, out: str, shard: str) -> DataFrame:
    """Running sums of ``value`` per key in ``order``, including the row, in two levels.

    ``shard`` is a column that is non-decreasing in ``order``; sums of whole shards come from
    a small aggregate, so that no task needs more than one shard of one key.
    """
    totals = df.groupBy(*keys, shard).agg(F.sum(value).alias("_sum"))
    by_shard = Window.partitionBy(*keys).orderBy(shard)
    base = totals.select(
        *[F.col(k).alias(f"_b_{k}") for k in keys],
        F.col(shard).alias("_b_shard"),
        F.coalesce(F.sum("_sum").over(by_shard.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"),
    )
    local = F.sum(value).over(Window.partitionBy(*keys, shard).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    on = F.col(shard) == F.col("_b_shard")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_b_{k}"))
    return df.withColumn("_local", local).join(base, on).select(*df.columns, (F.col("_local") + F.col("_base")).alias(out))
