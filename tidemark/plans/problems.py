"""Queries of the general data-preparation problems, over whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import asof, late_events, regular_grid, snapshot_changes, spikes, timestamps
from tidemark.plans.registry import Registry
from tidemark.sources.tables import fips_text, table

REGISTRY = Registry()
FIELDS = {"published": None, "gdelt_seendate": "UTC"}


def day_text(column: str) -> Column:
    return F.date_format(column, "yyyy-MM-dd").alias(column)


@REGISTRY.query(
    "p1_found",
    """
    with picked as (
        select site_id, week_end, as_of, loaded_at, case when not isnan(ed_resp) then ed_resp end as v from county_week
        where site_id is not null and week_end is not null and as_of is not null
    ), snap as (
        select site_id, week_end, as_of, v from (
            select *, row_number() over (partition by site_id, week_end, as_of order by loaded_at desc nulls last, v desc nulls last) as rn from picked
        ) where rn = 1
    ), delivered as (
        select site_id, as_of, lag(as_of) over (partition by site_id order by as_of) as before_of from (select distinct site_id, as_of from snap)
    ), later as (
        select s.site_id, s.week_end, s.as_of, s.v, d.before_of from snap s join delivered d on s.site_id = d.site_id and s.as_of = d.as_of where d.before_of is not null
    ), earlier as (
        select s.site_id, s.week_end, d.as_of, s.v from snap s join delivered d on s.site_id = d.site_id and s.as_of = d.before_of
    ), pairs as (
        select coalesce(l.site_id, e.site_id) as site_id, coalesce(l.week_end, e.week_end) as week_end, coalesce(l.as_of, e.as_of) as as_of,
               l.site_id is not null as is_new, e.site_id is not null as is_old, l.v as new_v, e.v as old_v
        from later l full outer join earlier e on l.site_id = e.site_id and l.week_end = e.week_end and l.as_of = e.as_of
    )
    select site_id, strftime(week_end, '%Y-%m-%d') as week_end, strftime(as_of, '%Y-%m-%d') as as_of, kind from (
        select *, case when is_new and not is_old then 'added'
                       when is_old and not is_new then case when week_end >= as_of - 56 then 'removed' end
                       when (new_v is null) <> (old_v is null) or abs(new_v - old_v) >= 0.005 - 1e-9 then 'changed' end as kind
        from pairs
    ) where kind is not null
    """,
)
def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of a site that were added, removed or changed between its consecutive snapshots."""
    events = snapshot_changes.snapshot_changes(table(spark, sf_dir, "county_week"), "site_id", "week_end", "as_of", "ed_resp", "loaded_at")
    return events.select("site_id", day_text("week_end"), day_text("as_of"), "kind")


@REGISTRY.query(
    "p2_found",
    """
    with weeks as (
        select distinct site_id, (week_end::date + ((6 - dayofweek(week_end::date)) % 7)::integer)::date as sat
        from ed_readings where ed_resp is not null and not isnan(ed_resp) and site_id is not null and week_end is not null
    ), spans as (
        select site_id, sat, lead(sat) over (partition by site_id order by sat) as next_sat from weeks
    )
    select site_id, strftime(sat + (7 * k)::integer, '%Y-%m-%d') as week_end
    from (select site_id, sat, unnest(range(1, (next_sat - sat) // 7)) as k from spans where next_sat - sat > 7)
    """,
)
def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weeks of a site's span without a reading."""
    return p2_grid(spark, sf_dir).filter("status = 'missing' and value is not null").select("site_id", day_text("week_end"))


@REGISTRY.query("p2_grid")
def p2_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per site and Saturday of its span; weeks without a reading carry the seasonal fit and bridged residuals."""
    grid = regular_grid.regular_grid(table(spark, sf_dir, "ed_readings"), "site_id", "week_end", "ed_resp", "reading_id")
    return grid.withColumnRenamed("source", "site_id").withColumns({c: F.round(c, 6) for c in ("value", "fitted")})


def labels_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All distinct origins with the struct ``version`` of the finding known on their day."""
    findings = table(spark, sf_dir, "findings").select("site_id", "week_end", asof.known_day("known_by").alias("known"), "finding_id", "label")
    return asof.asof_join(table(spark, sf_dir, "origins").distinct(), findings, ["site_id", "week_end"], "as_of", "origin_id", "known", "finding_id", ["label"])


_P3 = """
    with known as (
        select distinct finding_id, site_id, week_end, label, try_cast(left(trim(known_by), 10) as date) as day from findings
        where regexp_full_match(trim(known_by), '[0-9]{4}-[0-9]{2}-[0-9]{2}([T ][0-9]{2}:[0-9]{2}(:[0-9]{2}(\\.[0-9]+)?)?(Z|[+-][0-9]{2}:?[0-9]{2})?)?')
    ), asked as (select distinct * from origins),
    ranked as (
        select o.origin_id, k.finding_id, k.label, k.day, row_number() over (partition by o.origin_id order by k.day desc, k.finding_id desc) as rn
        from asked o join known k on o.site_id = k.site_id and o.week_end = k.week_end and k.day <= o.as_of
    )"""


@REGISTRY.query("p3_found", _P3 + " select origin_id, finding_id from ranked where rn = 1")
def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The finding that each origin could know, for origins that have one."""
    return labels_as_of(spark, sf_dir).filter("version is not null").select("origin_id", F.col("version.order").alias("finding_id"))


@REGISTRY.query(
    "p3_labels",
    _P3
    + """
    select o.origin_id, o.site_id, o.week_end, o.as_of, r.finding_id, strftime(r.day, '%Y-%m-%d') as known_on, round(r.label, 6) as label
    from asked o left join ranked r on o.origin_id = r.origin_id and r.rn = 1
    """,
)
def p3_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every origin with the label as it stood on its day, null where none was known."""
    v = F.col("version")
    return labels_as_of(spark, sf_dir).select(
        "origin_id", "site_id", "week_end", "as_of", v["order"].alias("finding_id"), F.date_format(v["valid_from"], "yyyy-MM-dd").alias("known_on"), F.round(v["label"], 6).alias("label")
    )


@REGISTRY.query("p4_instants")
def p4_instants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every distinct value of both fields with the pattern that read it and its instant, null where it is none."""
    zones = timestamps.usable_zones(spark, table(spark, sf_dir, "metros"), "metro", "tz")
    read = timestamps.normalise_fields(table(spark, sf_dir, "articles"), "article_id", FIELDS, "metro", zones)
    return read.withColumnRenamed("row_id", "article_id")


@REGISTRY.query("p4_found")
def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The values that denote an instant, as whole seconds since 1970."""
    return p4_instants(spark, sf_dir).filter("utc_seconds is not null").select("article_id", "field", "utc_seconds")


def arrival_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return late_events.arrivals(table(spark, sf_dir, "ed_arrivals"), "site_id", "week_end", "as_of", "arrival_id", "ed_resp_final", "unit")


_P5 = """
    with records as (
        select distinct arrival_id, site_id, unit, week_end, as_of, ed_resp_final as v from ed_arrivals
        where ed_resp_final is not null and not isnan(ed_resp_final) and site_id is not null and week_end is not null and as_of is not null and week_end <= as_of::date + 6
    ), seen as (
        select *, max(week_end) over (partition by site_id order by as_of, arrival_id rows between unbounded preceding and 1 preceding) as top from records
    ), judged as (
        select *, case when week_end < top - 28 then 'dropped' when week_end < top then 'late' end as verdict from seen
    )"""


@REGISTRY.query("p5_found", _P5 + " select arrival_id, verdict from judged where verdict is not null")
def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrivals that were late for their site, and those beyond the cut-off."""
    return late_events.replay(arrival_records(spark, sf_dir)).judged().filter("verdict is not null").select(F.col("id").alias("arrival_id"), "verdict")


@REGISTRY.query(
    "p5_corrected",
    _P5
    + """
    , last_of as (
        select site_id, week_end, unit, v from (
            select *, row_number() over (partition by site_id, week_end, unit order by as_of desc, arrival_id desc) as rn from judged where verdict is null or verdict = 'late'
        ) where rn = 1
    ), counts as (
        select site_id, week_end, count(*) filter (verdict = 'late') as late, count(*) filter (verdict = 'dropped') as dropped from judged group by site_id, week_end
    )
    select l.site_id, l.week_end, count(*)::bigint as n, round(avg(v), 6) as mean, round(median(v), 6) as median, count(distinct v) as distinct_values,
           min(v) as lowest, max(v) as highest, any_value(c.late) as late, any_value(c.dropped) as dropped
    from last_of l join counts c on l.site_id = c.site_id and l.week_end = c.week_end group by l.site_id, l.week_end
    """,
)
def p5_corrected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per site and week, aggregates over the units' last accepted records, from value counts."""
    done = late_events.corrected_periods(arrival_records(spark, sf_dir))
    return done.withColumnsRenamed({"key": "site_id", "period": "week_end"}).withColumns({c: F.round(c, 6) for c in ("mean", "median")})


def flagged_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spikes.implausible_readings(table(spark, sf_dir, "ed_readings"), "site_id", "week_end", "reading_id", "ed_resp")


@REGISTRY.query("p7_found")
def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Impossible, spiking and stuck readings."""
    return flagged_readings(spark, sf_dir).select("reading_id")


@REGISTRY.query(
    "p7_bounds_and_runs",
    """
    with r as (select distinct site_id, week_end, reading_id, ed_resp as v from ed_readings where ed_resp is not null and not isnan(ed_resp) and site_id is not null and week_end is not null),
    g as (select *, row_number() over (partition by site_id order by week_end, reading_id) - row_number() over (partition by site_id, v order by week_end, reading_id) as run from r),
    n as (select *, count(*) over (partition by site_id, v, run) as length from g)
    select reading_id, v < 0 or v > 100 as impossible, length >= 6 as stuck from n where v < 0 or v > 100 or length >= 6
    """,
)
def p7_bounds_and_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The readings that bounds and runs of zero details flag, which SQL can say."""
    return flagged_readings(spark, sf_dir).filter("impossible or stuck").select("reading_id", "impossible", "stuck")


@REGISTRY.query("p7_by_county")
def p7_by_county(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per county, its sites' readings and how many of them each rule flags; a reading's county is its site's most named."""
    readings = table(spark, sf_dir, "ed_readings").select("reading_id", "site_id", fips_text("fips").alias("fips")).distinct()
    named = readings.filter("fips is not null").groupBy("site_id", "fips").agg(F.count("*").alias("n"))
    home = named.groupBy("site_id").agg(F.max(F.struct("n", "fips")).alias("top")).select("site_id", F.col("top.fips").alias("fips"))
    all_rows = readings.groupBy("site_id").agg(F.countDistinct("reading_id").alias("readings"))
    flags = flagged_readings(spark, sf_dir).groupBy(F.col("source").alias("site_id")).agg(*[F.sum(F.col(c).cast("long")).alias(c) for c in ("impossible", "spike", "stuck")])
    per_site = all_rows.join(home, "site_id", "left").join(flags, "site_id", "left")
    return per_site.groupBy("fips").agg(F.count("*").alias("sites"), F.sum("readings").alias("readings"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("impossible", "spike", "stuck")])
