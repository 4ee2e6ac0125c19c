"""As-of joins: each event with the version that was valid at its own time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.skew import plan_shards

#: Rows of one key (events and versions) above which it is divided over time.
SHARD_ROWS = 200_000


def known_day(text: str | Column) -> Column:
    """The calendar day of a text that is a date, with or without a time; else null.

    Blanks around it are ignored; a day that does not exist is no date.
    """
    c = F.trim(F.col(text) if isinstance(text, str) else text)
    day = F.regexp_extract(c, r"^([0-9]{4}-[0-9]{2}-[0-9]{2})(?:[T ][0-9]{2}:[0-9]{2}(?::[0-9]{2}(?:\.[0-9]+)?)?(?:Z|[+-][0-9]{2}:?[0-9]{2})?)?$", 1)
    return F.try_to_date(F.nullif(day, F.lit("")), "yyyy-MM-dd")


def asof_join(
    events: DataFrame,
    versions: DataFrame,
    keys: list[str],
    event_time: str,
    event_id: str,
    version_time: str,
    version_order: str,
    carry: list[str],
    shard_rows: int = SHARD_ROWS,
    out: str = "version",
) -> DataFrame:
    """All rows of ``events`` with the latest version of their keys at or before ``event_time``.

    Adds valid_from, order and the ``carry`` columns as one struct ``out``, null where there is
    none. Versions of one moment: the largest ``version_order`` counts.

    Hot keys are cut into time ranges; each range gets the last version before it as carry-in,
    and ranges whose events share few moments are spread by a hash of ``event_id``, with the
    versions repeated. Every piece is then a local merge that needs no other piece.

    Defined results: null keys or null event times match nothing; versions with a null time
    never count; repeated versions count once, repeated events stay; empty tables are fine;
    event columns may have any names but ``out``, as they travel inside one struct.
    """
    if out in events.columns:
        raise ValueError(f"events have a column {out} of their own; choose another name")
    cols = [f"_k{i}" for i in range(len(keys))]
    e = events.select(F.struct("*").alias("_event"), *[F.col(k).alias(c) for k, c in zip(keys, cols, strict=True)], F.col(event_time).alias("_t"), F.xxhash64(event_id).alias("_h"))
    v = versions.select(*[F.col(k).alias(c) for k, c in zip(keys, cols, strict=True)], F.col(version_time).alias("_t"), F.struct(F.col(version_order).alias("order"), *carry).alias("_v"))
    usable = F.col("_t").isNotNull()
    for c in cols:
        usable = usable & F.col(c).isNotNull()
    # One version per moment before anything is shuffled further: versions per key are then bounded by its moments.
    v = v.filter(usable).groupBy(*cols, "_t").agg(F.max("_v").alias("_v")).withColumn("_v", F.struct(F.col("_t").alias("valid_from"), "_v"))
    plan = plan_shards(e.filter(usable).select(*cols, "_t").unionByName(v.select(*cols, "_t")), cols, "_t", shard_rows)
    e = plan.assign(e, "_t")
    # Events that can match nothing are spread over as many pieces as they are, and never meet.
    salt = F.when(~usable, F.pmod("_h", F.lit(1 << 30))).when(F.col("_salts") > 1, F.pmod("_h", F.col("_salts"))).otherwise(0)
    e = e.withColumn("_salt", salt.cast("int"))
    v = plan.assign(v, "_t")
    if not plan.empty:
        last = v.filter("_shard > 0").groupBy(*cols, "_shard").agg(F.max("_v").alias("_last"))
        ranges = plan.rows.select(*cols, "_shard", "_salts").join(last, [*cols, "_shard"], "left")
        earlier = Window.partitionBy(*cols).orderBy("_shard").rowsBetween(Window.unboundedPreceding, -1)
        carried = ranges.withColumn("_v", F.last("_last", ignorenulls=True).over(earlier)).filter("_v is not null")
        v = v.unionByName(carried.select(*cols, F.col("_v.valid_from").alias("_t"), "_v", "_shard", "_salts"))
    v = v.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1)))
    shape = [*cols, "_shard", "_salt", "_t"]
    merged = v.select(*shape, "_v", F.lit(None).cast(e.schema["_event"].dataType).alias("_event"), F.lit(0).alias("_kind")).unionByName(
        e.select(*shape, F.lit(None).cast(v.schema["_v"].dataType).alias("_v"), "_event", F.lit(1).alias("_kind"))
    )
    merge = Window.partitionBy(*cols, "_shard", "_salt").orderBy("_t", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    matched = merged.withColumn("_m", F.last("_v", ignorenulls=True).over(merge)).filter("_kind = 1")
    found = F.when(usable, F.struct(F.col("_m.valid_from").alias("valid_from"), F.col("_m._v.order").alias("order"), *[F.col(f"_m._v.{c}").alias(c) for c in carry]))
    return matched.select("_event.*", F.when(F.col("_m").isNotNull(), found).alias(out))


def range_join(left: DataFrame, right: DataFrame, keys: list[str], low: Column, high: Column, at: str, bucket_days: int = 7) -> DataFrame:
    """Rows of ``left`` with the rows of ``right`` of the same keys whose date ``at`` is between ``low`` and ``high``, dates of ``left``.

    Both sides meet in buckets of days, a row of ``left`` in each that its range touches, so the
    join is by equal keys and buckets and no key's rows meet as a whole. Null keys and dates match
    nothing. The columns of ``left`` come first, then those of ``right`` that are no keys.
    """
    bucket = lambda d: F.floor(F.unix_date(d) / bucket_days).cast("int")
    asked = left.withColumns({"_low": low, "_high": high}).filter("_low <= _high")
    asked = asked.withColumn("_bucket", F.explode(F.sequence(bucket(F.col("_low")), bucket(F.col("_high")))))
    held = right.select(*[F.col(k).alias(f"_r_{k}") for k in keys], *[c for c in right.columns if c not in keys], bucket(F.col(at)).alias("_b"))
    on = (F.col("_bucket") == F.col("_b")) & F.col(at).between(F.col("_low"), F.col("_high"))
    for k in keys:
        on = (F.col(k) == F.col(f"_r_{k}")) & on
    return asked.join(held, on).select(*[F.col(c) for c in left.columns], *[c for c in right.columns if c not in keys])
