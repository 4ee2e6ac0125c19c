"""Questions, regional reports, news features, feeds and streams as queries."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.calendar import week_end
from tidemark.operators import questions as ask
from tidemark.operators import timestamps
from tidemark.operators.asof import known_day
from tidemark.plans.registry import Registry
from tidemark.plans.relational import SAT, r6
from tidemark.session import scratch_path
from tidemark.sources import parsers
from tidemark.sources.tables import table
from tidemark.streaming import feeds

REGISTRY = Registry()
query = REGISTRY.query

_VALUES = """
    with v as (select fips, max(metro) as metro, week_end, avg(covid) as ed_covid, avg(flu) as ed_flu, avg(resp) as ed_resp from (
        select site_id, fips, metro, week_end, arg_max(struct_pack(v := ed_covid), as_of).v as covid, arg_max(struct_pack(v := ed_flu), as_of).v as flu, arg_max(struct_pack(v := ed_resp), as_of).v as resp
        from (select * from (select *, row_number() over (partition by site_id, week_end, as_of order by loaded_at desc, ed_covid desc nulls last, ed_flu desc nulls last, ed_resp desc nulls last) as rn from county_week) where rn = 1) group by all) group by fips, week_end)"""


def values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fips, metro, week_end and the newest signals, averaged over a county's sites."""
    w = table(spark, sf_dir, "county_week")
    newest = w.groupBy("site_id", "fips", "metro", "week_end").agg(F.max(F.struct("as_of", "loaded_at", "ed_covid", "ed_flu", "ed_resp")).alias("t"))
    return newest.groupBy("fips", "week_end").agg(F.max("metro").alias("metro"), *[F.avg(f"t.{s}").alias(s) for s in ("ed_covid", "ed_flu", "ed_resp")])


def places(spark: SparkSession, sf_dir: str) -> dict[str, str]:
    return ask.gazetteer(table(spark, sf_dir, "counties"), table(spark, sf_dir, "metros"))


@query("question_peak", _VALUES + """
    , p as (select * from v where metro = 'ash' and ed_resp is not null), w as (select arg_max(week_end, struct_pack(m := m, w := week_end)) as wk from (select week_end, avg(ed_resp) as m from p group by week_end)),
    a as (select fips as place, max(ed_resp) filter (week_end = wk) as value, max(ed_resp) filter (week_end = wk - 7) as before, any_value(wk) as week_end from p, w where week_end in (wk, wk - 7) group by fips)
    select place, week_end, round(value, 6) as value, round(before, 6) as before, round(value - before, 6) as change from a where value is not null order by value desc, place limit 7
    """)  # fmt: skip
def question_peak(spark: SparkSession, sf_dir: str) -> DataFrame:
    """'Top 7 counties in Ashmere at the peak': parsed, resolved against the data and answered."""
    v = values(spark, sf_dir)
    q = ask.resolve(ask.parse("Top 7 counties in Ashmere at the peak", places(spark, sf_dir), dt.date(2026, 3, 14)), v)
    return r6(ask.top_places(q, ask.answer(q, v)), "value", "before", "change")


@query("question_change", _VALUES + """
    , k as (select max(week_end) as wk from v where ed_flu is not null and week_end <= date '2025-12-27'),
    a as (select fips as place, max(ed_flu) filter (week_end = wk) as value, max(ed_flu) filter (week_end = wk - 7) as before, any_value(wk) as week_end from v, k where week_end in (wk, wk - 7) group by fips)
    select place, week_end, round(value, 6) as value, round(before, 6) as before, round(value - before, 6) as change from a where value is not null and before is not null order by value - before desc, place limit 10
    """)  # fmt: skip
def question_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    """'Where is flu rising at Christmas, top 10': change against the week before."""
    v = values(spark, sf_dir)
    q = ask.resolve(ask.parse("Where is flu rising at Christmas, top 10?", places(spark, sf_dir), dt.date(2026, 3, 14)), v)
    return r6(ask.top_places(q, ask.answer(q, v)), "value", "before", "change")


@query("question_counts", _VALUES + """
    , k as (select max(week_end) as wk from v where ed_resp is not null and week_end <= date '2026-01-17'),
    a as (select max(ed_resp) filter (week_end = wk) as value, max(ed_resp) filter (week_end = wk - 7) as before from v, k where week_end in (wk, wk - 7) group by fips)
    select count(*) as places, count(*) filter (value > before) as rose, count(*) filter (value < before) as fell, round(median(value), 6) as median_value, round(median(value - before), 6) as median_change from a where value is not null
    """)  # fmt: skip
def question_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many counties rose and fell in a week."""
    v = values(spark, sf_dir)
    q = ask.resolve(ask.parse("How did things change by 2026-01-17?", places(spark, sf_dir), dt.date(2026, 3, 14)), v)
    return r6(ask.counts(ask.answer(q, v)), "median_value", "median_change")


_SERIES = _VALUES + """
    , s as (select v.metro, week_end, sum(ed_resp * coalesce(population::double, 1)) / sum(case when ed_resp is not null then coalesce(population::double, 1) end) as ed_resp from v left join counties c on v.fips = c.fips group by v.metro, week_end)"""


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ask.regional_series(values(spark, sf_dir), table(spark, sf_dir, "counties").select("fips", "population"), "metro", ["ed_resp"])


@query("region_trend", _SERIES + """
    , b as (select *, coalesce(lag(ed_resp, 3) over w, first_value(ed_resp) over w) as base, row_number() over (partition by metro order by week_end desc) as rn from s where ed_resp is not null window w as (partition by metro order by week_end)),
    p as (select metro, week_end, ed_resp as value, case when base > 0 then (ed_resp / base - 1) * 100 end as pct from b where rn = 1)
    select metro, week_end, round(value, 6) as value, round(pct, 6) as change_pct, case when pct > 15 then 'rising' when pct < -15 then 'falling' else 'roughly flat' end as trend,
           round(least(0.95::double, 0.15 + value / 15 + greatest(coalesce(pct, 0), 0) / 200), 6) as severity from p
    """)  # fmt: skip
def region_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each metro's population-weighted share and its three-week trend."""
    return r6(ask.trend(series(spark, sf_dir), "metro", "ed_resp"), "value", "change_pct", "severity")


@query("region_arrows", _SERIES + """
    , l as (select metro, max(week_end) as week_end from s where ed_resp is not null group by metro)
    select s.metro, s.week_end, round(s.ed_resp, 6) as value, case when s.ed_resp - e.ed_resp > 0.1 then 'up' when s.ed_resp - e.ed_resp < -0.1 then 'down' when e.ed_resp is not null then 'flat' end as arrow
    from s join l on s.metro = l.metro and s.week_end = l.week_end left join s e on e.metro = s.metro and e.week_end = s.week_end - 14
    """)  # fmt: skip
def region_arrows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each metro's last week against two weeks before."""
    return r6(ask.arrows(series(spark, sf_dir), "metro", "ed_resp"), "value")


@query("region_gate", """
    with f as (select distinct finding_id, claim, try_cast(left(trim(known_by), 10) as date) as day from findings)
    select finding_id, reason is null as ok, reason from (select finding_id, case when day is null or day > date '2025-12-31' then 'not known by then' when trim(coalesce(claim, '')) = '' then 'no claim' when length(claim) > 700 then 'claim too long' end as reason from f)
    """)  # fmt: skip
def region_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings that may be shown on a date, and why others may not."""
    f = table(spark, sf_dir, "findings").select("finding_id", "claim", known_day("known_by").alias("day")).distinct()
    return ask.gate(f, "claim", "day", F.lit("2025-12-31").cast("date")).select("finding_id", "ok", "reason")


# Every article whose date can be read in any of the formats of p4, by the day where it was published. No SQL: DuckDB
# cannot read the formats.


def dated_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All distinct articles with day, the local day of ``published`` in the metro's zone, and the pattern that read it; null where it denotes none.

    Without a zone of the metro, the day is the one written, or that of the instant in UTC.
    """
    a = table(spark, sf_dir, "articles").distinct()
    zones = timestamps.usable_zones(spark, table(spark, sf_dir, "metros"), "metro", "tz")
    zoned = a.join(zones.withColumnRenamed("zone_key", "metro"), "metro", "left").withColumn("_zone", F.coalesce("zone", F.lit("UTC")))
    read = timestamps.utc_seconds(zoned, "published", "_zone")
    day = F.to_date(F.from_utc_timestamp(F.timestamp_seconds("utc_seconds"), F.col("_zone")))
    return read.select(*a.columns, day.alias("day"), F.when(day.isNotNull(), F.col("pattern")).alias("pattern"))


def relevant_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """article_id, concern and relevant: means over the labels of an article."""
    from tidemark.functions import labels

    h = table(spark, sf_dir, "human_labels").distinct()
    return h.groupBy("article_id").agg(F.avg(labels.concern_answer("concern").cast("double")).alias("concern"), F.avg(F.when(labels.relevant_answer("relevant") == "y", 1.0).when(labels.relevant_answer("relevant") == "n", 0.0)).alias("relevant"))


@query("region_news")
def region_news(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relevant articles by metro and week, dates of all formats: count and mean concern; week is null for articles without a readable date."""
    a = dated_articles(spark, sf_dir).select("article_id", "metro", "day").filter("day is null or day <= date '2025-12-31'")
    joined = a.join(relevant_scores(spark, sf_dir).filter("relevant > 0.5"), "article_id")
    return r6(joined.groupBy("metro", week_end("day").alias("week")).agg(F.count("*").alias("articles"), F.avg("concern").alias("concern")), "concern")


@query("region_cited")
def region_cited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The six newest eligible articles per metro in two weeks, dates of all formats."""
    a = parsers.eligible(dated_articles(spark, sf_dir).fillna("", ["fetched_ok"]).filter("fetched_ok = 'True'")).select("article_id", "metro", "day").distinct()
    place = F.row_number().over(Window.partitionBy("metro").orderBy(F.desc("day"), "article_id"))
    return a.filter("day between date '2025-12-14' and date '2025-12-27'").withColumn("place", place).filter("place <= 6").select("metro", "article_id", "day", "place")


@query("article_published")
def article_published(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every article with its publication day and the format it was read from; null where it has no readable date."""
    return dated_articles(spark, sf_dir).select("article_id", "day", "pattern")


# Sources, on lines and arrays made from tables


@query("source_parallel_arrays", """
    with h as (select user_id, ts::date as day, value from events)
    select user_id, day, round(case when count(value) >= 2 then avg(value) end, 6) as value, count(value) as hours from h group by all
    """)  # fmt: skip
def source_parallel_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parallel arrays of times and values as daily means, thin days null."""
    e = table(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_list(F.struct("ts", "value")).alias("p"))
    arrays = e.select("user_id", F.transform("p", lambda x: x["ts"].cast("string")).alias("times"), F.col("p.value").alias("vals"))
    return r6(parsers.parallel_hours(arrays, "user_id", "times", {"value": "vals"}, 2), "value")


@query("source_feed_lines", """
    select url, outlet as host, replace(title, '''', '&') as title from (select distinct url, outlet, title from articles) where outlet in ('ashmere-health.example', 'ashmere-ledger.example') and title is not null
    """.replace("replace(title, '''', '&')", "title"))
def source_feed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feed records of two hosts, with escaped titles."""
    a = table(spark, sf_dir, "articles").select("url", "outlet", "title").filter("title is not null").distinct()
    escaped = F.replace(F.replace("title", F.lit("&"), F.lit("&amp;")), F.lit("'"), F.lit("&#39;"))
    blank = [F.lit("")] * 18
    line = F.concat_ws("\t", F.lit("id"), F.lit("20250101000000"), F.lit("1"), "outlet", "url", F.lit(""), F.lit(""), F.lit("HEALTH_PANDEMIC"), *blank, F.concat(F.lit("<PAGE_TITLE>"), escaped, F.lit("</PAGE_TITLE>")))
    found = parsers.feed_lines(a.select(line.alias("value")), ["ashmere-health.example", "ashmere-ledger.example"], "HEALTH")
    return found.select("url", "host", "title")


@query("source_case_lines", "select fips || ' ' || (population // 1000)::varchar || ' 2025/12/27' as value from counties where population // 1000 > 0")
def source_case_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a case file."""
    c = table(spark, sf_dir, "counties").select("fips", F.floor(F.col("population") / 1000).alias("n"), F.lit("2025-12-27").cast("date").alias("day"))
    return parsers.case_lines(c, "fips", "n", "day")


@query("source_scan_lines", "select fips || ' 2025 ' || population::varchar as value from counties where population is not null union all select fips || ' ' || printf('%.6f', lat) || ' ' || printf('%.6f', lon) from counties")
def source_scan_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a population file and of a coordinates file."""
    c = table(spark, sf_dir, "counties")
    return parsers.population_lines(c, "fips", "population", 2025).unionByName(parsers.coordinate_lines(c, "fips", "lat", "lon"))


@query("source_feed_files", "select strftime(t, '%Y%m%d%H%M%S') as stamp from (select unnest(generate_series(timestamp '2025-12-01', timestamp '2025-12-03', interval 60 minute)) as t)")
def source_feed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fourth quarter-hour file of two days."""
    return parsers.feed_files(spark, "2025-12-01 00:00:00", "2025-12-03 00:00:00", 4)


# Streams over the events there are, run to their end


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table, a file or a folder of part files, as a stream; the pattern lets a single file be one."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 64).parquet(f"{sf_dir}/events.parque[t]")


@query("stream_weekly_window", f"select {SAT.format('ts')} as week_end, event_type, count(*) as n, round(sum(value), 6) as total from events group by all")
def stream_weekly_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sunday-to-Saturday sums by event time, from a stream of events."""
    e = event_stream(spark, sf_dir).withColumn("at", F.col("ts").cast("timestamp"))
    return r6(feeds.settled_table(feeds.weekly_windows(e, "at", ["event_type"], "value"), scratch_path(spark, "stream")), "total")


@query("stream_newest", "select user_id, event_type, max(ts::date) as issue from events group by all")
def stream_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest record per key, from a stream of events."""
    e = event_stream(spark, sf_dir).select("user_id", "event_type", F.col("ts").cast("date").alias("issue"), "value")
    return feeds.settled_table(feeds.newest_per_key(e, ["user_id", "event_type"], "issue", "value"), scratch_path(spark, "stream")).select("user_id", "event_type", "issue")
