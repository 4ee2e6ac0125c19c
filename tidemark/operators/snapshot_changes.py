"""What changed between full snapshots.

The state is an index of the last snapshot, bucketed by key, that holds a hash per key and no
payload. Deliveries lie in a store with the same buckets, a partition per snapshot, so a delivery
probes the index bucket by bucket and nothing is shuffled. Equal hashes are settled there; old
values are fetched, bucket by bucket too, for keys whose hash differs, from the partitions of the
snapshots concerned, and for no others. The result of the probe is written as the next generation
of the index, which then replaces the last one; what only the last one needed is deleted.

Defined results: rows with a null key part or a null ``as_of`` belong to no snapshot; repeated
rows count once; NaN is null; an entity's first snapshot gives no changes; a delivery without
rows of an entity leaves that entity's part of the index as it is; an empty delivery changes
nothing. Columns other than those named are ignored, whatever their names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.skew import BROADCAST_PLAN_ROWS
from tidemark.session import remove, scratch_path
from tidemark.sources.tables import number

#: Rows of all snapshots per bucket; and buckets at most, beyond which they grow.
ROWS_PER_BUCKET, MOST_BUCKETS = 250_000, 10_000


def latest_delivery(df: DataFrame, keys: list[str], as_of: str, value: str, version: str) -> DataFrame:
    """One row per key and snapshot, of the delivery with the latest ``version``: keys, as_of, value.

    Equal versions with different values: the larger value counts, a null least.
    """
    picked = df.select(*[F.col(k) for k in keys], F.col(as_of).alias("as_of"), F.col(version).alias("_version"), number(value).alias("_value"))
    for k in [*keys, "as_of"]:
        picked = picked.filter(F.col(k).isNotNull())
    top = F.max(F.struct("_version", "_value"))
    return picked.groupBy(*keys, "as_of").agg(top.alias("_top")).select(*keys, "as_of", F.col("_top._value").alias("value"))


def value_hash(value: str | Column, tolerance: float) -> Column:
    """Equal for values whose distance is noise; always different at a distance of ``tolerance``.

    The value is rounded to a hundredth of the tolerance before hashing, so noise far below it
    mostly leaves the hash alone, and a true change never does.
    """
    v = F.col(value) if isinstance(value, str) else value
    return F.xxhash64(F.round(v / F.lit(tolerance / 100)).cast("long"), v.isNull())


class BucketedTable:
    """An external table under ``path``, in ``buckets`` of ``keys`` and partitioned, that is written in parts."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], buckets: int, partitions: list[str]) -> None:
        self.spark, self.path, self.keys, self.buckets, self.partitions = spark, path, keys, buckets, partitions
        self.name = f"tidemark_{uuid.uuid4().hex[:16]}"

    def add(self, df: DataFrame) -> None:
        """Append ``df``, whose partitions are the buckets."""
        df.write.partitionBy(*self.partitions).bucketBy(self.buckets, *self.keys).sortBy(*self.keys).option("path", self.path).mode("append").saveAsTable(self.name)

    def read(self) -> DataFrame:
        return self.spark.table(self.name)

    def drop(self) -> None:
        """Forget the table; its files are the caller's."""
        self.spark.sql(f"drop table if exists {self.name}")


class SnapshotIndex:
    """Generations of the key-to-hash index, and the store of deliveries that it is probed with.

    ``store`` is bucketed like the index and partitioned by ``as_of``, with the keys and the value.
    """

    def __init__(self, store: BucketedTable, path: str, entity: str, tolerance: float) -> None:
        self.store, self.entity, self.tolerance, self.keys = store, entity, tolerance, store.keys
        self.index = BucketedTable(store.spark, path, store.keys, store.buckets, ["generation", "event"])
        self.generation = -1

    @property
    def current(self) -> DataFrame | None:
        """keys, hash, seen (the snapshot the hash is of) of the last generation."""
        if self.generation < 0:
            return None
        return self.index.read().filter((F.col("generation") == self.generation) & (F.col("kind") != "removed")).select(*self.keys, "hash", "seen")

    def deliver(self, entities: DataFrame, as_of) -> None:
        """Probe with the store's snapshot of ``as_of`` and write the next generation.

        ``entities`` names those delivered (entity, known: whether they had an earlier snapshot). A
        generation's rows: keys, hash, seen, before (the snapshot it was compared with), kind
        (same, first, added, differs, removed, kept), and the new value where it differs; event is
        1 for what is or may be a change.
        """
        day = F.lit(as_of).cast("date")
        new = self.store.read().filter(F.col("as_of") == day).select(*[F.col(k).alias(f"n_{k}") for k in self.keys], value_hash("value", self.tolerance).alias("n_hash"), F.col("value").alias("n_value"))
        old = self.current
        if old is None:
            old = new.limit(0).select(*[F.col(f"n_{k}").alias(k) for k in self.keys], F.col("n_hash").alias("hash"), day.alias("seen"))
        on = [F.col(k) == F.col(f"n_{k}") for k in self.keys]
        probed = old.join(new, on, "full_outer").select(
            *[F.coalesce(k, f"n_{k}").alias(k) for k in self.keys], "hash", "seen", "n_hash", "n_value", F.col(f"n_{self.keys[0]}").isNotNull().alias("_new"), F.col("seen").isNotNull().alias("_old")
        )
        sent = entities.select(F.col(self.entity).alias("_entity"), F.col("known").alias("_known"))
        probed = probed.join(sent, F.col(self.entity) == F.col("_entity"), "left")
        kind = (
            F.when(~F.col("_new") & F.col("_entity").isNotNull(), "removed")
            .when(~F.col("_new"), "kept")
            .when(~F.col("_old"), F.when(F.col("_known"), "added").otherwise("first"))
            .when(F.col("hash") == F.col("n_hash"), "same")
            .otherwise("differs")
        )
        number = self.generation + 1
        self.index.add(probed.withColumn("kind", kind).select(
            *self.keys,
            F.when(F.col("_new"), F.col("n_hash")).otherwise(F.col("hash")).alias("hash"),
            F.when(F.col("_new"), day).otherwise(F.col("seen")).alias("seen"),
            F.when(F.col("kind") == "differs", F.col("seen")).alias("before"),
            F.when(F.col("kind") == "differs", F.col("n_value")).alias("value"),
            "kind",
            F.lit(number).alias("generation"),
            F.col("kind").isin("added", "removed", "differs").cast("int").alias("event"),
        ))
        remove(self.store.spark, f"{self.index.path}/generation={self.generation}/event=0")  # its keys and hashes are in the new generation
        self.generation = number  # the swap: ``current`` is the new generation from here on

    def events(self, days: DataFrame) -> DataFrame:
        """added, removed and changed records of all generations: keys, as_of, kind.

        ``days``: generation and as_of. Old values are fetched for rows marked 'differs' only,
        bucket by bucket; the snapshot is no join key, so that the buckets of both sides fit.
        """
        rows = self.index.read().filter("event = 1").select(*self.keys, "kind", "before", "value", "generation")
        old = self.store.read().select(*[F.col(k).alias(f"o_{k}") for k in self.keys], F.col("as_of").alias("o_as_of"), F.col("value").alias("old"))
        on = [F.col(k) == F.col(f"o_{k}") for k in self.keys]
        fetched = rows.join(old, [*on, (F.col("before") >= F.col("o_as_of")) & (F.col("before") <= F.col("o_as_of"))], "left")
        changed = (F.col("old").isNull() != F.col("value").isNull()) | (F.abs(F.col("old") - F.col("value")) >= self.tolerance - 1e-9)
        kind = F.when(F.col("kind") != "differs", F.col("kind")).when(changed, "changed")
        return fetched.join(F.broadcast(days), "generation").select(*self.keys, "as_of", kind.alias("kind")).filter("kind is not null")


def snapshot_changes(
    table: DataFrame,
    entity: str,
    key: str,
    as_of: str,
    value: str,
    version: str,
    tolerance: float = 0.005,
    removed_within_days: int | None = 56,
    buckets: int | None = None,
) -> DataFrame:
    """Replay all snapshots of ``table`` through a :class:`SnapshotIndex`: entity, key, as_of, kind.

    ``removed_within_days``: a removal counts only if the date ``key`` is at most so many days
    before ``as_of``. The driver holds one date per delivery and nothing else. The index and the store are deleted once the changes are written.
    """
    spark = table.sparkSession
    root = scratch_path(spark, "snapshots")
    buckets = buckets or max(1, min(MOST_BUCKETS, -(-table.count() // ROWS_PER_BUCKET)))
    keys = [entity, key]
    store = BucketedTable(spark, f"{root}/work/store", keys, buckets, ["as_of"])
    # One shuffle: rows lie in their buckets before deliveries that supersede each other are settled.
    store.add(latest_delivery(table.repartition(buckets, *keys), keys, as_of, value, version))
    kinds = {f.name: f for f in store.read().schema}
    by_day = Window.partitionBy(entity).orderBy("as_of")
    calendar = store.read().select(entity, "as_of").distinct().withColumn("known", F.row_number().over(by_day) > 1)
    calendar.repartition("as_of").write.partitionBy("as_of").parquet(f"{root}/work/entities")
    calendar = spark.read.schema(T.StructType([kinds[entity], T.StructField("known", T.BooleanType()), T.StructField("as_of", T.DateType())])).parquet(f"{root}/work/entities")
    sizes = {r["as_of"]: r["n"] for r in calendar.groupBy("as_of").agg(F.count("*").alias("n")).collect()}  # a row per delivery
    index = SnapshotIndex(store, f"{root}/work/index", entity, tolerance)
    for day in sorted(sizes):
        sent = calendar.filter(F.col("as_of") == F.lit(day)).select(entity, "known")
        index.deliver(F.broadcast(sent) if sizes[day] <= BROADCAST_PLAN_ROWS else sent, day)
    if sizes:
        index.events(spark.createDataFrame(list(enumerate(sorted(sizes))), "generation int, as_of date")).write.parquet(f"{root}/events")
    index.index.drop()
    store.drop()
    remove(spark, f"{root}/work")
    if not sizes:
        return spark.createDataFrame([], T.StructType([kinds[entity], kinds[key], T.StructField("as_of", T.DateType()), T.StructField("kind", T.StringType())]))
    events = spark.read.parquet(f"{root}/events")
    if removed_within_days is not None:
        events = events.filter((F.col("kind") != "removed") | (F.col(key) >= F.date_sub("as_of", removed_within_days)))
    return events
