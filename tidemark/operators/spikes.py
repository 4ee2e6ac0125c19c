"""Implausible readings per source: impossible values, spikes and stuck values.

An undecimated Haar decomposition of a source's readings decides all but the bounds. Fine details
are the differences of neighbouring readings; coarse details are the differences between a
reading and the course on either side, for which the median of three readings is the smooth part,
so that one odd reading does not bend it. Both are taken of logarithms, as scatter grows with
level, at two levels: for one reading, and for two readings that depart together.

Noise model: scatter s per reading, the same at all times. A fine detail then has the deviation
s * sqrt(2); a coarse one s * sqrt(1 + 0.449), as the median of three normal values has 0.449 of
their variance. s is the source's median absolute fine detail, scaled to a deviation; details of
zero say nothing of scatter and are left out. A spike is where all details, into and out of the
departure, fine and coarse, have one sign and exceed ``threshold`` of their own deviations. The
universal threshold sqrt(2 ln n) is 3.5 for n = 457 readings, and the details must exceed it
together. A lasting shift leaves a step as large as the departure; the course has resumed if the
step left behind, the detail across the departure, is below ``resume`` of the departure.
Stuck values are runs of zero details of the readings themselves.

Each step looks at a fixed number of neighbours, so hot sources are cut into time ranges that
carry that many readings of their neighbours as a halo; results do not depend on the cut.

Defined results: null and NaN readings and rows with a null source or time are not looked at;
repeated rows count once; readings of one moment are ordered by id; impossible readings are no
part of the course, but may be stuck; the first and the last reading of a source are never
spikes, as no course surrounds them.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.skew import halo_rows, plan_shards
from tidemark.session import durable
from tidemark.sources.tables import number

SHARD_ROWS = 200_000
#: Deviations of details where readings have the deviation one; see the noise model above.
FINE_NORM, COARSE_NORM = math.sqrt(2), math.sqrt(1 + 0.449)
#: Turns a median of absolute normal values into a deviation.
MEDIAN_TO_DEVIATION = 1.4826
#: Readings that the details of one reading reach on either side.
REACH = 6
_WINDOW = "over (partition by source, _shard order by at, id)"


def _median(first: Column, second: Column, third: Column) -> Column:
    """The median of up to three neighbours, nearest first; those beyond the end of the series are null."""
    middle = F.greatest(F.least(first, second), F.least(F.greatest(first, second), third))
    return F.when(third.isNotNull(), middle).when(second.isNotNull(), (first + second) / 2).otherwise(first)


def departure(values: list[Column], near: tuple[Column, Column], course: tuple[Column, Column], resume: float) -> Column:
    """The least standardised detail of ``values`` against both sides, on the side of the fine details.

    ``near``: the readings next to the values, ``course``: the smooth part on either side. Zero
    where details differ in sign or the course does not resume; null where a side is missing.
    """
    least = lambda sides, sign: F.least(*[sign * (v - s) for v in values for s in sides])
    up, down = least(near, 1), least(near, -1)
    fine = F.greatest(up, down)
    coarse = F.when(up >= down, least(course, 1)).otherwise(least(course, -1))
    left_behind = F.least(F.abs(near[0] - near[1]), F.abs(course[0] - course[1]))
    resumes = left_behind < F.greatest(fine, coarse) * resume
    known = near[0].isNotNull() & near[1].isNotNull()
    return F.when(known, F.when(resumes, F.greatest(F.least(fine / FINE_NORM, coarse / COARSE_NORM), F.lit(0.0))).otherwise(0.0))


def details(readings: DataFrame, low: float, high: float, floor: float = 0.05, run: int = 6, resume: float = 0.6, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """source, id, possible, fine, single, pair, stuck of readings (source, at, id, value).

    ``fine``: the detail into the reading, of logarithms; ``single`` and ``pair``: how far it
    departs at the levels of one and two readings, in units of scatter once divided by it;
    ``stuck``: in a run of ``run`` zero details. ``floor``: readings below it count as it before
    logarithms are taken.
    """
    possible = F.col("value").between(low, high)
    plan = plan_shards(readings, ["source"], "at", shard_rows)
    placed = plan.assign(readings, "at").drop("_salts")
    # Runs need the neighbours that are nearest; the course needs the nearest possible ones, however far they are.
    halo = halo_rows(placed, plan, ["at", "id"], 2 * run).unionByName(halo_rows(placed, plan, ["at", "id"], REACH, possible)).dropDuplicates(["source", "_shard", "at", "id"])
    rows = placed.withColumn("_halo", F.lit(False))
    rows = rows if plan.empty else rows.unionByName(halo.withColumn("_halo", F.lit(True)))
    rows = rows.withColumn("z", F.when(possible, F.ln(F.greatest("value", F.lit(floor)))))
    near = {f"b{k}": F.expr(f"lag(z, {k}) ignore nulls {_WINDOW}") for k in (1, 2, 3)} | {f"a{k}": F.expr(f"lead(z, {k}) ignore nulls {_WINDOW}") for k in (1, 2, 3, 4)}
    still = F.expr(f"coalesce(cast(value - lag(value) {_WINDOW} = 0 as int), 0)")
    rows = rows.withColumns(near | {"still": still})
    c = {n: F.col(n) for n in ("z", "b1", "b2", "b3", "a1", "a2", "a3", "a4")}
    left = _median(c["b1"], c["b2"], c["b3"])
    rows = rows.withColumns({
        "fine": c["z"] - c["b1"],
        "single": departure([c["z"]], (c["b1"], c["a1"]), (left, _median(c["a1"], c["a2"], c["a3"])), resume),
        "first_of_two": F.when(c["z"].isNotNull(), F.coalesce(departure([c["z"], c["a1"]], (c["b1"], c["a2"]), (left, _median(c["a2"], c["a3"], c["a4"])), resume), F.lit(0.0))),
        # A run ends where the last run - 1 details are zero.
        "ends": F.expr(f"cast(sum(still) over (partition by source, _shard order by at, id rows between {run - 2} preceding and current row) = {run - 1} as int)"),
    })
    rows = rows.withColumns({
        "second_of_two": F.expr(f"lag(first_of_two) ignore nulls {_WINDOW}"),
        "stuck": F.expr(f"max(ends) over (partition by source, _shard order by at, id rows between current row and {run - 1} following) = 1"),
    })
    pair = F.greatest("first_of_two", F.coalesce("second_of_two", F.lit(0.0)))
    return rows.filter("not _halo").select("source", "id", c["z"].isNotNull().alias("possible"), "fine", F.coalesce("single", F.lit(0.0)).alias("single"), F.coalesce(pair, F.lit(0.0)).alias("pair"), "stuck")


def scatters(coded: DataFrame, least: float = 0.01) -> DataFrame:
    """source, scatter: the deviation of a reading, from the median absolute fine detail that is not zero; a mergeable sketch per source."""
    moves = F.when(F.abs("fine") > 1e-9, F.abs("fine"))
    return coded.groupBy(F.col("source").alias("_s")).agg(F.greatest(F.percentile_approx(moves, 0.5, 1000) * (MEDIAN_TO_DEVIATION / FINE_NORM), F.lit(least)).alias("scatter"))


def implausible_readings(
    df: DataFrame, source: str, time: str, reading_id: str, value: str, low: float = 0.0, high: float = 100.0, threshold: float = 3.5, run: int = 6, shard_rows: int = SHARD_ROWS
) -> DataFrame:
    """reading_id, source, impossible, spike, stuck, score: the flagged readings, one row each; score in deviations of details."""
    rows = df.select(F.col(source).alias("source"), F.col(time).alias("at"), F.col(reading_id).alias("id"), number(value).alias("value"))
    rows = rows.filter("source is not null and at is not null and id is not null and value is not null").distinct()
    coded = durable(details(rows, low, high, run=run, shard_rows=shard_rows))
    scored = coded.join(scatters(coded), F.col("source") == F.col("_s"), "left").withColumn("score", F.when(F.col("possible"), F.greatest("single", "pair") / F.col("scatter")))
    spike = F.coalesce(F.col("score") >= threshold, F.lit(False))
    flagged = scored.select("source", "id", (~F.col("possible")).alias("impossible"), spike.alias("spike"), "stuck", F.when(spike, F.col("score")).alias("score")).filter("impossible or spike or stuck")
    return flagged.groupBy(F.col("id").alias("reading_id"), "source").agg(F.bool_or("impossible").alias("impossible"), F.bool_or("spike").alias("spike"), F.bool_or("stuck").alias("stuck"), F.max("score").alias("score"))
