"""Period aggregates by event time that late records correct, up to a cut-off.

The state per period is a multiset, value -> count, and each unit's last accepted record. Records
come in batches of arrival time. A record is judged against the state: the latest period the state
holds for its key, or that records before it in its batch have brought. Accepting a record takes
the unit's old value out of the multiset and puts the new one in; count, mean, median, distinct
values and extremes are derived from cumulative counts, exactly, after any number of corrections.
A period that no record can reach any more, because the key's latest period is more than the
cut-off later, leaves the state with its final counts, so the state is a few weeks per key.

Within a batch nothing is sorted by record: a record is late if some later period had its first
record before it. First arrivals per key and period are a map-side aggregate; the two thresholds
per period come from a window over periods.

Defined results: records with a null key, period, arrival time or value are ignored, as are
records of a period more than ``early_days`` after the day of arrival; repeated rows count once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.session import file_system, scratch_path
from tidemark.sources.tables import number

#: Days of arrival time that make a batch of a replay.
BATCH_DAYS = 182


def arrivals(df: DataFrame, key: str, period: str, arrived: str, record_id: str, value: str, unit: str | None = None, early_days: int = 6) -> DataFrame:
    """The usable records under fixed names: key, period, at, id, value, unit; repeated rows once."""
    picked = df.select(
        F.col(key).alias("key"), F.col(period).cast("date").alias("period"), F.col(arrived).alias("at"), F.col(record_id).alias("id"), number(value).alias("value"), (F.col(unit) if unit else F.lit("")).alias("unit")
    )
    picked = picked.filter("key is not null and period is not null and at is not null and id is not null and value is not null")
    return picked.filter(F.col("period") <= F.date_add(F.to_date("at"), early_days)).distinct()


def verdicts(records: DataFrame, cutoff_days: int = 28, horizon: DataFrame | None = None) -> DataFrame:
    """``records`` with verdict: null (on time), 'late' or 'dropped' (later than the cut-off).

    ``horizon``: key and top, the latest period that the state holds; it counts as seen before all records.
    """
    place = F.struct("at", "id")
    first = records.groupBy("key", "period").agg(F.min(place).alias("first"))
    if horizon is not None:
        kinds = [records.schema[c].dataType for c in ("at", "id")]
        earliest = F.struct(F.lit("0001-01-01").cast(kinds[0]).alias("at"), F.lit(-(1 << 63)).cast(kinds[1]).alias("id"))
        first = first.unionByName(horizon.select("key", F.col("top").alias("period"), earliest.alias("first"))).groupBy("key", "period").agg(F.min("first").alias("first"))
    later = Window.partitionBy("key").orderBy(F.col("day").asc())
    days = first.withColumn("day", F.datediff("period", F.lit("1970-01-01").cast("date")))
    limits = days.select(
        F.col("key").alias("_key"),
        F.col("period").alias("_period"),
        F.min("first").over(later.rangeBetween(1, Window.unboundedFollowing)).alias("late_after"),
        F.min("first").over(later.rangeBetween(cutoff_days + 1, Window.unboundedFollowing)).alias("drop_after"),
    )
    judged = records.join(limits, (F.col("key") == F.col("_key")) & (F.col("period") == F.col("_period")), "left")
    verdict = F.when(F.col("drop_after") < place, "dropped").when(F.col("late_after") < place, "late")
    return judged.select(*records.columns, verdict.alias("verdict"))


def unit_moves(accepted: DataFrame, held: DataFrame | None = None) -> DataFrame:
    """key, period, unit, last, comes, goes: the units' last records after a batch, and what it puts in and takes out.

    ``held`` has the units' last records before (key, period, unit, last).
    """
    batch = accepted.groupBy("key", "period", "unit").agg(F.max(F.struct("at", "id", "value")).alias("new"))
    if held is None:
        both = batch.withColumn("old", F.lit(None).cast(batch.schema["new"].dataType))
    else:
        old = held.select(F.col("key").alias("_k"), F.col("period").alias("_p"), F.col("unit").alias("_u"), F.col("last").alias("old"))
        on = (F.col("key") == F.col("_k")) & (F.col("period") == F.col("_p")) & F.col("unit").eqNullSafe(F.col("_u"))
        both = batch.join(old, on, "full_outer").select(F.coalesce("key", "_k").alias("key"), F.coalesce("period", "_p").alias("period"), F.coalesce("unit", "_u").alias("unit"), "new", "old")
    newer = F.col("new").isNotNull() & (F.col("old").isNull() | (F.col("new") > F.col("old")))
    return both.select("key", "period", "unit", F.when(newer, F.col("new")).otherwise(F.col("old")).alias("last"), F.when(newer, F.col("new.value")).alias("comes"), F.when(newer, F.col("old.value")).alias("goes"))


def value_changes(moves: DataFrame) -> DataFrame:
    """key, period, value, n: +1 for a value that comes in, -1 for one that it replaces."""
    sides = F.array(F.struct(F.col("comes").alias("value"), F.lit(1).alias("n")), F.struct(F.col("goes").alias("value"), F.lit(-1).alias("n")))
    parts = moves.filter("comes is not null").select("key", "period", F.explode(F.filter(sides, lambda x: x["value"].isNotNull())).alias("d"))
    return parts.groupBy("key", "period", F.col("d.value").alias("value")).agg(F.sum("d.n").alias("n"))


def merge_counts(state: DataFrame | None, deltas: DataFrame) -> DataFrame:
    """The multiset after the changes: key, period, value, n, without empty entries."""
    both = deltas if state is None else state.unionByName(deltas)
    return both.groupBy("key", "period", "value").agg(F.sum("n").alias("n")).filter("n <> 0")


def multiset_aggregates(state: DataFrame) -> DataFrame:
    """key, period, n, mean, median, distinct_values, lowest, highest from value counts."""
    by_value = Window.partitionBy("key", "period").orderBy("value")
    whole = Window.partitionBy("key", "period")
    counted = state.withColumns({"upto": F.sum("n").over(by_value.rowsBetween(Window.unboundedPreceding, 0)), "total": F.sum("n").over(whole)})
    holds = lambda rank: (F.col("upto") - F.col("n") < rank) & (F.col("upto") >= rank)
    low, high = F.floor((F.col("total") + 1) / 2), F.floor((F.col("total") + 2) / 2)
    return counted.groupBy("key", "period").agg(
        F.sum("n").alias("n"),
        (F.sum(F.col("value") * F.col("n")) / F.sum("n")).alias("mean"),
        ((F.max(F.when(holds(low), F.col("value"))) + F.max(F.when(holds(high), F.col("value")))) / 2).alias("median"),
        F.count("*").alias("distinct_values"),
        F.min("value").alias("lowest"),
        F.max("value").alias("highest"),
    )


class LateState:
    """The state in generations under ``root``: one per batch, complete once its mark is there.

    A generation has the batch's records with their verdicts, the units' last records, and the
    value counts of open and of closed periods. A new object goes on from the last complete
    generation; what a broken batch has left is written over; a batch that is there is skipped by
    its number. Batches must come in order of arrival.
    """

    def __init__(self, spark: SparkSession, root: str, cutoff_days: int = 28) -> None:
        self.spark, self.root, self.cutoff = spark, root.rstrip("/"), cutoff_days
        self.fs, self.path = file_system(spark, self.root)
        marks = self.fs.globStatus(self.path(f"{self.root}/done-*")) or []
        self.numbers = sorted(int(m.getPath().getName().split("-")[1]) for m in marks)

    @property
    def done(self) -> int:
        """The number of the last complete batch, -1 before the first."""
        return self.numbers[-1] if self.numbers else -1

    def _read(self, n: int, part: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/gen-{n}/{part}")

    def horizon(self) -> DataFrame | None:
        """key and top: the latest period that the state has values of."""
        return self._read(self.done, "counts").filter("open").groupBy("key").agg(F.max("period").alias("top")) if self.numbers else None

    def apply(self, batch: DataFrame, number: int) -> None:
        """Judge and merge one batch of :func:`arrivals` rows."""
        if number <= self.done:
            return
        base, top = f"{self.root}/gen-{number}", self.horizon()
        held = counts = None
        if self.numbers:
            open_ = F.datediff("top", "period") <= self.cutoff
            held = self._read(self.done, "moves").join(top, "key").filter(open_).select("key", "period", "unit", "last")
            counts = self._read(self.done, "counts").filter("open").drop("open")
        verdicts(batch, self.cutoff, top).write.mode("overwrite").parquet(f"{base}/judged")
        accepted = self._read(number, "judged").filter("verdict is null or verdict = 'late'")
        unit_moves(accepted, held).write.mode("overwrite").parquet(f"{base}/moves")
        merged = merge_counts(counts, value_changes(self._read(number, "moves")))
        now = accepted.select("key", "period") if top is None else accepted.select("key", "period").unionByName(top.select("key", F.col("top").alias("period")))
        now = now.groupBy(F.col("key").alias("_k")).agg(F.max("period").alias("top"))
        flagged = merged.join(now, F.col("key") == F.col("_k")).select("key", "period", "value", "n", (F.datediff("top", "period") <= self.cutoff).alias("open"))
        flagged.write.mode("overwrite").parquet(f"{base}/counts")
        self.fs.create(self.path(f"{self.root}/done-{number}"), True).close()
        if self.numbers:  # what only the last batch needed
            self.fs.delete(self.path(f"{self.root}/gen-{self.done}/moves"), True)
        self.numbers.append(number)

    def judged(self) -> DataFrame:
        """All records with their verdicts."""
        return reduce(DataFrame.unionByName, [self._read(n, "judged") for n in self.numbers])

    def periods(self) -> DataFrame:
        """The aggregates of all periods after the batches so far: of those closed by each batch, and of those open after the last."""
        counts = [self._read(n, "counts").filter(F.lit(n == self.done) | ~F.col("open")).drop("open") for n in self.numbers]
        return multiset_aggregates(reduce(DataFrame.unionByName, counts))


def replay(records: DataFrame, cutoff_days: int = 28, batch_days: int = BATCH_DAYS) -> LateState:
    """The state after all ``records``, taken in batches of ``batch_days`` of arrival time.

    The driver holds the numbers of the batches: a calendar.
    """
    spark = records.sparkSession
    root = scratch_path(spark, "late")
    numbered = records.withColumn("_batch", F.floor(F.datediff(F.to_date("at"), F.lit("1970-01-01").cast("date")) / batch_days).cast("int"))
    numbered.write.partitionBy("_batch").parquet(f"{root}/arrivals")
    arrived = spark.read.schema(numbered.schema).parquet(f"{root}/arrivals")
    fs, path = file_system(spark, root)
    found = fs.globStatus(path(f"{root}/arrivals/_batch=*")) or []
    state = LateState(spark, f"{root}/state", cutoff_days)
    for i, n in enumerate(sorted(int(f.getPath().getName().split("=")[1]) for f in found)):
        state.apply(arrived.filter(F.col("_batch") == n).drop("_batch"), i)
    fs.delete(path(f"{root}/arrivals"), True)
    if not state.numbers:
        state.apply(records.limit(0), 0)
    return state


def corrected_periods(records: DataFrame, cutoff_days: int = 28, batch_days: int = BATCH_DAYS) -> DataFrame:
    """Aggregates of every period over its units' last accepted records, with late and dropped counts."""
    state = replay(records, cutoff_days, batch_days)
    notes: list[Column] = [F.count(F.when(F.col("verdict") == v, 1)).alias(v) for v in ("late", "dropped")]
    counts = state.judged().groupBy(F.col("key").alias("_k"), F.col("period").alias("_p")).agg(*notes)
    return state.periods().join(counts, (F.col("key") == F.col("_k")) & (F.col("period") == F.col("_p")), "left").drop("_k", "_p")
