"""Streams against the same plan in batch."""

import datetime as dt

from pyspark.sql import functions as F

from tests.test_problems import SCHEMA5, arrivals, read5, rows
from tidemark.operators import late_events
from tidemark.streaming import feeds


def run(spark, stream, name, mode):
    q = stream.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def source(spark, df, path, parts=3):
    for i in range(parts):
        df.filter(F.col("id") % parts == i).coalesce(1).write.mode("append").parquet(str(path))
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(path))


def test_weekly_windows(spark, tmp_path):
    df = spark.createDataFrame([(i, i % 3, dt.datetime(2025, 1, 1) + dt.timedelta(hours=11 * i), float(i)) for i in range(200)], "id long, k long, at timestamp, v double")
    batch = feeds.weekly_windows(df, "at", ["k"], "v")
    assert {r.week_end.isoweekday() for r in batch.collect()} == {6}
    assert rows(run(spark, feeds.weekly_windows(source(spark, df, tmp_path / "w"), "at", ["k"], "v", "400 days"), "weekly", "complete")) == rows(batch)


def test_newest_per_key(spark, tmp_path):
    df = spark.createDataFrame([(i, i % 7, dt.date(2025, 1, 1) + dt.timedelta(days=i), float(i)) for i in range(60)], "id long, k long, issue date, v double")
    assert rows(run(spark, feeds.newest_per_key(source(spark, df, tmp_path / "n"), ["k"], "issue", "v"), "newest", "complete")) == rows(feeds.newest_per_key(df, ["k"], "issue", "v"))


def test_repeats_are_dropped(spark, tmp_path):
    df = spark.createDataFrame([(i, i // 2, dt.datetime(2025, 1, 1) + dt.timedelta(hours=i)) for i in range(40)], "id long, k long, at timestamp")
    assert run(spark, feeds.distinct_within(source(spark, df, tmp_path / "d"), "at", ["k"]), "distinct_rows", "append").count() == 20


def test_gaps(spark, tmp_path):
    days = [0, 3, 5, 30, 31, 60]
    df = spark.createDataFrame([(i, 1, dt.date(2025, 1, 1) + dt.timedelta(days=d)) for i, d in enumerate(days)], "id long, k long, at date")
    for i in range(len(days)):
        df.filter(F.col("id") == i).coalesce(1).write.mode("append").parquet(str(tmp_path / "g"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "g"))
    got = rows(run(spark, feeds.gap_marks(stream, "k", "at", 10), "gaps", "append"))
    assert len(got) >= 2


def batches(spark, df, parts=3):
    order = df.orderBy("at", "id").collect()
    return [spark.createDataFrame(order[i * len(order) // parts : (i + 1) * len(order) // parts], df.schema) for i in range(parts)]


def tidy(df):
    return [tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in rows(df)]


def whole(df):
    accepted = late_events.verdicts(df).filter("verdict is null or verdict = 'late'").drop("verdict")
    return late_events.multiset_aggregates(late_events.merge_counts(None, late_events.value_changes(late_events.unit_moves(accepted))))


def test_late_corrections_go_on_after_a_restart(spark, tmp_path):
    """Each batch meets a new object; the second dies half-way and leaves a folder; the third comes twice."""
    df = read5(spark.createDataFrame(arrivals(spark), SCHEMA5))
    root = str(tmp_path / "late")
    parts = batches(spark, df)
    late_events.LateState(spark, root).apply(parts[0], 0)
    parts[2].write.parquet(f"{root}/gen-1/judged")
    assert late_events.LateState(spark, root).done == 0
    for i in (1, 2, 2):
        late_events.LateState(spark, root).apply(parts[i], i)
    state = late_events.LateState(spark, root)
    assert state.done == 2 and tidy(state.periods()) == tidy(whole(df))
    assert {r.id: r.verdict for r in state.judged().collect()} == {r.id: r.verdict for r in late_events.verdicts(df).collect()}


def test_late_corrections_as_a_stream(spark, tmp_path):
    df = read5(spark.createDataFrame(arrivals(spark, n=150), SCHEMA5))
    for part in batches(spark, df):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    feeds.late_corrections(stream, str(tmp_path / "state"), str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination(120)
    state = late_events.LateState(spark, str(tmp_path / "state"))
    assert state.done == 2 and tidy(state.periods()) == tidy(whole(df))
