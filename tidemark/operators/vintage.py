"""The revision log: what was published when, and what was known on a date.

A log has geo, time, issue and value: what was published on ``issue`` about ``time``. The newest
issue of a key wins even if its value is null; a key missing from a newer issue stays visible.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.calendar import week_end
from tidemark.operators.guards import epiweek_argument
from tidemark.session import file_system

KEY = ("geo", "time")


class LeakError(ValueError):
    """A value about the future is visible."""


class SnapshotError(ValueError):
    """A snapshot breaks its contract."""


def check_snapshot(df: DataFrame) -> DataFrame:
    """``df`` if it is a valid snapshot of one issue, else SnapshotError naming every broken rule; one pass and one aggregate."""
    bad = lambda c: F.count_if(c)
    rules = {
        "no rows": F.when(F.count("*") == 0, 1).otherwise(0),
        "blank geo": bad(F.coalesce(F.trim("geo"), F.lit("")) == ""),
        "null time": bad(F.col("time").isNull()),
        "issue before time": bad(F.col("issue") < F.col("time")),
        "several issues": F.greatest(F.count_distinct("issue") - 1, F.lit(0)),
    }
    found = df.agg(*[c.alias(n) for n, c in rules.items()]).first().asDict()
    repeated = df.groupBy(*KEY).count().filter("count > 1").limit(1).count()
    broken = [n for n, v in found.items() if v] + ["repeated key"] * repeated
    if broken:
        raise SnapshotError(", ".join(broken))
    return df


def write_snapshot(df: DataFrame, root: str, source: str) -> str:
    """Write one issue once: the same content again changes nothing, other content is an error."""
    issue = check_snapshot(df).select("issue").first()[0]
    path = f"{root}/source={source}/issue={issue}"
    spark = df.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    body = df.drop("issue")
    if not fs.exists(hadoop):
        body.write.mode("errorifexists").parquet(path)
        return "written"
    old = spark.read.schema(body.schema).parquet(path)
    if same_rows(old, body):
        return "exists"
    raise SnapshotError(f"{source} {issue} exists with other content")


def list_snapshots(spark: SparkSession, root: str) -> list[tuple[str, dt.date]]:
    """source and issue of every stored snapshot, from the names of folders: nothing is read."""
    fs, path = file_system(spark, root)
    found = fs.globStatus(path(f"{root}/source=*/issue=*")) or []
    parts = [f.getPath() for f in found]
    return sorted((p.getParent().getName().split("=", 1)[1], dt.date.fromisoformat(p.getName().split("=", 1)[1])) for p in parts)


def read_snapshots(spark: SparkSession, root: str, source: str, schema: str, as_of: dt.date | None = None) -> DataFrame:
    """The log of a source from its stored snapshots, issues up to ``as_of`` only: others are not opened. ``schema``: of the rows without issue."""
    issues = [d for s, d in list_snapshots(spark, root) if s == source and (as_of is None or d <= as_of)]
    columns = [c.strip().split(" ")[0] for c in schema.split(",")]
    if not issues:
        return spark.createDataFrame([], f"{schema}, issue date")
    files = [f"{root}/source={source}/issue={d}" for d in issues]
    return spark.read.schema(f"{schema}, issue date").option("basePath", f"{root}/source={source}").parquet(*files).select(*columns, "issue")


def write_history(log: DataFrame, root: str, source: str) -> dict[dt.date, str]:
    """Write every issue of a log that is not stored yet; issue -> 'written' or 'exists'. Issues are a calendar; each is checked and written by itself."""
    issues = sorted(r[0] for r in log.select("issue").distinct().toLocalIterator())
    return {d: write_snapshot(log.filter(F.col("issue") == F.lit(d)), root, source) for d in issues}


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Whether two frames hold the same rows equally often."""
    b = b.select(*a.columns)
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def load_vintage(log: DataFrame, as_of: str | dt.date | None = None) -> DataFrame:
    """Per key the row of the newest issue on or before ``as_of``; all issues if it is null."""
    seen = log if as_of is None else log.filter(F.col("issue") <= F.lit(as_of).cast("date"))
    rest = [c for c in log.columns if c not in (*KEY, "issue")]
    top = seen.groupBy(*KEY).agg(F.max_by(F.struct("issue", *rest), "issue").alias("_top"))
    return top.select(*KEY, "_top.issue", *[f"_top.{c}" for c in rest])


def load_vintage_week(log: DataFrame, as_of) -> DataFrame:
    """:func:`load_vintage` of a log whose issues are epidemiological weeks as YYYYWW; a date is an error, as it would read as a week far ahead."""
    week = epiweek_argument(as_of)
    rest = [c for c in log.columns if c not in (*KEY, "issue")]
    top = log.filter(F.col("issue") <= week).groupBy(*KEY).agg(F.max_by(F.struct("issue", *rest), "issue").alias("_top"))
    return top.select(*KEY, "_top.issue", *[f"_top.{c}" for c in rest])


def first_prints(log: DataFrame) -> DataFrame:
    """Per key the row of its earliest issue."""
    rest = [c for c in log.columns if c not in (*KEY, "issue")]
    top = log.groupBy(*KEY).agg(F.min_by(F.struct("issue", *rest), "issue").alias("_top"))
    return top.select(*KEY, "_top.issue", *[f"_top.{c}" for c in rest])


def first_print_within(log: DataFrame, days: int) -> DataFrame:
    """Per key the earliest issue after ``time`` and at most ``days`` later."""
    return first_prints(log.filter((F.col("issue") > F.col("time")) & (F.datediff("issue", "time") <= days)))


def validity(log: DataFrame) -> DataFrame:
    """The log with valid_to, the next issue of the key; null for the newest."""
    return log.withColumn("valid_to", F.lead("issue").over(Window.partitionBy(*KEY).orderBy("issue")))


def as_of_each(log: DataFrame, dates: list[dt.date]) -> DataFrame:
    """What was known on each of ``dates``, in one pass: as_of, geo, time, issue, value...

    Each row of the log is repeated for the dates on which it was the newest; there is no loop
    over dates and no join. ``dates`` is a calendar: it grows with time, not with data.
    """
    days = F.array(*[F.lit(d).cast("date") for d in sorted(dates)])
    held = validity(log)
    inside = F.filter(days, lambda d: (d >= F.col("issue")) & (F.col("valid_to").isNull() | (d < F.col("valid_to"))))
    return held.select(F.explode(inside).alias("as_of"), *log.columns)


def archive_holes(log: DataFrame, within_days: int = 7) -> DataFrame:
    """Per time: the first issue that has it, and whether that is more than ``within_days`` after it."""
    first = log.groupBy("time").agg(F.min("issue").alias("first_issue"))
    return first.withColumn("late", F.datediff("first_issue", "time") > within_days)


def revisions(log: DataFrame) -> DataFrame:
    """Per key: issues, first and final value, and the relative revision."""
    first = first_prints(log).select(*KEY, F.col("value").alias("first_value"))
    last = load_vintage(log).select(*KEY, F.col("value").alias("final_value"))
    counts = log.groupBy(*KEY).agg(F.count("*").alias("issues"))
    both = counts.join(first, list(KEY)).join(last, list(KEY))
    return both.withColumn("relative", F.when(F.abs("first_value") > 1e-9, F.col("final_value") / F.col("first_value") - 1))


def grid_slices(log: DataFrame, geos: DataFrame, dates: list[dt.date], history: int, values: list[str]) -> DataFrame:
    """The fact table's rows: as_of x geo x the ``history`` + 1 weeks up to the week of as_of, with lag.

    Weeks nothing is known about stay, with nulls. A week that ends after as_of shows no value.
    """
    known = as_of_each(log, dates)
    calendar = F.array(*[F.lit(d).cast("date") for d in sorted(dates)])
    slots = geos.select("geo", F.explode(calendar).alias("as_of")).select("geo", "as_of", F.explode(F.sequence(F.lit(0), F.lit(history))).alias("lag"))
    slots = slots.withColumn("time", F.date_sub(week_end("as_of"), F.col("lag") * 7))
    joined = slots.join(known.select("as_of", "geo", "time", *values), ["as_of", "geo", "time"], "left")
    open_week = F.col("time") > F.col("as_of")
    return joined.select("geo", "time", "as_of", "lag", *[F.when(~open_week, F.col(v)).alias(v) for v in values])


def leak_violations(table: DataFrame, time: str, as_of: str, values: list[str]) -> DataFrame:
    """Rows that show a value of a week that ends after their as_of."""
    return table.filter((F.col(time) > F.col(as_of)) & F.coalesce(*[F.col(v) for v in values]).isNotNull())


def check_no_leak(table: DataFrame, keys: list[str], time: str, as_of: str, values: list[str]) -> DataFrame:
    """``table``, unless it shows a future value or repeats a key."""
    if not leak_violations(table, time, as_of, values).isEmpty():
        raise LeakError(f"a value of a {time} after {as_of} is visible")
    if not table.groupBy(*keys).count().filter("count > 1").isEmpty():
        raise LeakError(f"repeated {keys}")
    return table


def label_columns(log: DataFrame) -> DataFrame:
    """geo, time, final and first value: the answer key, kept apart from features."""
    final = load_vintage(log).select(*KEY, F.col("value").alias("final"))
    first = first_prints(log).select(*KEY, F.col("value").alias("first"))
    return final.join(first, list(KEY), "full_outer")


def visible_until(day: str | Column, lag_days: int, as_of: str | Column) -> Column:
    """Whether a day's record, published ``lag_days`` later, is visible on ``as_of``."""
    return F.date_add(day, lag_days) <= (F.col(as_of) if isinstance(as_of, str) else as_of)


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``old`` with rows of ``new`` in the place of those with the same keys."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def honest_examples(features: DataFrame, labels: DataFrame, label_lag_days: int, window_days: int, origin: str = "origin") -> DataFrame:
    """For every origin at once: examples whose label was visible by then and lies in the window.

    ``features``: geo, as_of, ...; ``labels``: origin, geo, time, label as seen on origin. The
    features of an example are those of its own week's slice, not of the origin's.
    """
    usable = labels.filter((F.datediff(origin, "time") >= label_lag_days) & (F.datediff(origin, "time") <= window_days) & F.col("label").isNotNull())
    return usable.join(features.withColumnRenamed("as_of", "time"), ["geo", "time"])
