"""Streams: the point-in-time operators over unbounded input, with bounded state.

Each builder takes a streaming or a batch frame and declares the same plan for both.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import late_events
from tidemark.session import file_system


def weekly_windows(df: DataFrame, time: str, keys: list[str], value: str, delay: str = "14 days") -> DataFrame:
    """Sunday-to-Saturday sums per key; a week is final once the watermark has passed it.

    The epoch was a Thursday, so windows of seven days start three days later to begin on Sundays.
    """
    window = F.window(time, "7 days", "7 days", "3 days")
    grouped = df.withWatermark(time, delay).groupBy(window, *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return grouped.select(F.to_date(F.date_sub(F.to_date("window.end"), 1)).alias("week_end"), *keys, "n", "total")


def newest_per_key(df: DataFrame, keys: list[str], issue: str, value: str) -> DataFrame:
    """The newest issue of every key, corrected as later ones come; for update mode."""
    return df.groupBy(*keys).agg(F.max_by(F.struct(issue, value), issue).alias("t")).select(*keys, f"t.{issue}", f"t.{value}")


def distinct_within(df: DataFrame, time: str, keys: list[str], delay: str = "7 days") -> DataFrame:
    """Repeats of a key within the watermark are dropped."""
    return df.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def gap_marks(df: DataFrame, key: str, time: str, most_days: int) -> DataFrame:
    """key, after, until: gaps of more than ``most_days`` between a key's consecutive records, with one date of state per key."""

    def step(k: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        days = sorted(d for pdf in batches for d in pdf[time].dropna().tolist())
        last = dt.date.fromisoformat(state.get[0]) if state.exists else None
        out = []
        for d in days:
            d = d.date() if isinstance(d, dt.datetime) else d
            if last is not None and (d - last).days > most_days:
                out.append((k[0], last, d))
            last = d if last is None else max(last, d)
        if last is not None:
            state.update((last.isoformat(),))
        yield pd.DataFrame(out, columns=[key, "after", "until"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, time).groupBy(key).applyInPandasWithState(step, f"{key} {kind}, after date, until date", "last string", "append", "NoTimeout")


def settled_table(stream: DataFrame, root: str) -> DataFrame:
    """Run an aggregating stream over all that its source holds now, and the whole result as it then stands.

    Each micro-batch writes the result so far to a folder of its own under ``root``, so a batch
    that is run again writes the same folder; the state lies beside it. An empty source gives no rows.
    """
    spark = stream.sparkSession
    query = stream.writeStream.outputMode("complete").option("checkpointLocation", f"{root}/state").trigger(availableNow=True)
    query.foreachBatch(lambda batch, n: batch.write.mode("overwrite").parquet(f"{root}/result-{n}")).start().awaitTermination()
    fs, path = file_system(spark, root)
    done = [int(f.getPath().getName().split("-")[1]) for f in fs.globStatus(path(f"{root}/result-*")) or []]
    return spark.read.schema(stream.schema).parquet(f"{root}/result-{max(done)}") if done else spark.createDataFrame([], stream.schema)


def late_corrections(stream: DataFrame, root: str, checkpoint: str, cutoff_days: int = 28):
    """A writer of :func:`late_events.arrivals` rows into the value-count state under ``root``, batch by batch; start it with ``.start()``.

    The state keeps the number of the batch with what the batch has changed, so that a restart
    goes on where it was and a batch that comes again changes nothing.
    """
    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda batch, n: late_events.LateState(batch.sparkSession, root, cutoff_days).apply(batch, n))
