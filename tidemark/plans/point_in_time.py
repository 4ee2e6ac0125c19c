"""Point-in-time operators over the snapshots of county_week, and their evaluation."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.calendar import harmonics
from tidemark.operators import asof, snapshot_changes, stats, vintage
from tidemark.plans.registry import Registry
from tidemark.plans.relational import r6
from tidemark.sources.tables import number, table

REGISTRY = Registry()
query = REGISTRY.query

#: The log in DuckDB: newest load per key, NaN as null.
REV = """
    with rev as (
        select site_id as geo, week_end as time, as_of as issue, v as value, covid, flu, rsv from (
            select site_id, week_end, as_of, case when not isnan(ed_resp) then ed_resp end as v, ed_covid as covid, ed_flu as flu, ed_rsv as rsv,
                   row_number() over (partition by site_id, week_end, as_of order by loaded_at desc nulls last, ed_resp desc nulls last) as rn from county_week)
        where rn = 1)"""


def revision_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """geo, time, issue, value, covid, flu, rsv of county_week, newest load per key."""
    t = table(spark, sf_dir, "county_week")
    value = F.when(~F.isnan("ed_resp"), F.col("ed_resp"))
    top = t.groupBy(F.col("site_id").alias("geo"), F.col("week_end").alias("time"), F.col("as_of").alias("issue")).agg(
        F.max(F.struct("loaded_at", value.alias("value"), F.col("ed_covid").alias("covid"), F.col("ed_flu").alias("flu"), F.col("ed_rsv").alias("rsv"))).alias("_t")
    )
    return top.select("geo", "time", "issue", "_t.value", "_t.covid", "_t.flu", "_t.rsv")


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return revision_log(spark, sf_dir).select("geo", "time", "issue", "value")


@query("vintage_as_of", REV + " select geo, time, issue, round(value, 6) as value from (select *, row_number() over (partition by geo, time order by issue desc) as rn from rev where issue <= date '2025-12-20') where rn = 1")
def vintage_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Everything as it was known on one date; the newest issue wins even if its value is null."""
    return r6(vintage.load_vintage(log(spark, sf_dir), dt.date(2025, 12, 20)), "value")


@query("vintage_latest", REV + " select geo, time, max(issue) as issue, round(arg_max(struct_pack(v := value), issue).v, 6) as value from rev group by all")
def vintage_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The finalised values."""
    return r6(vintage.load_vintage(log(spark, sf_dir)), "value")


@query("vintage_first_print", REV + " select geo, time, issue, round(value, 6) as value from (select *, row_number() over (partition by geo, time order by issue) as rn from rev) where rn = 1")
def vintage_first_print(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first issue that has each key."""
    return r6(vintage.first_prints(log(spark, sf_dir)), "value")


@query("vintage_first_within", REV + " select geo, time, min(issue) as issue, round(arg_min(struct_pack(v := value), issue).v, 6) as value from rev where issue > time and issue - time <= 28 group by all")
def vintage_first_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first issue after a week and within four weeks of it."""
    return r6(vintage.first_print_within(log(spark, sf_dir), 28), "value")


@query("vintage_validity", REV + " select geo, time, issue, lead(issue) over (partition by geo, time order by issue) as valid_to from rev")
def vintage_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log with the span in which each row was the newest."""
    return vintage.validity(log(spark, sf_dir)).select("geo", "time", "issue", "valid_to")


@query("revision_history", REV + " select geo, time, count(*) as issues, string_agg(coalesce(round(value, 2)::varchar, '-'), ' ' order by issue) as history from rev group by all having count(*) > 1".replace("round(value, 2)::varchar", "(round(value * 100)::bigint)::varchar"))
def revision_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All published values of each key, oldest first, in hundredths."""
    shown = F.coalesce(F.round(F.col("value") * 100).cast("long").cast("string"), F.lit("-"))
    listed = F.array_sort(F.collect_list(F.struct("issue", shown.alias("s"))))  # bounded by the issues of a key
    return log(spark, sf_dir).groupBy("geo", "time").agg(F.count("*").alias("issues"), F.array_join(F.transform(listed, lambda x: x["s"]), " ").alias("history")).filter("issues > 1")


@query("revision_first_final", REV + """
    , f as (select geo, time, count(*) as issues, arg_min(struct_pack(v := value), issue).v as a, arg_max(struct_pack(v := value), issue).v as b from rev group by all)
    select geo, time, issues, round(a, 6) as first_value, round(b, 6) as final_value, round(case when abs(a) > 1e-9 then b / a - 1 end, 6) as relative from f
    """)  # fmt: skip
def revision_first_final(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First and final value of each key and its relative revision."""
    return r6(vintage.revisions(log(spark, sf_dir)), "first_value", "final_value", "relative")


@query("revision_labels", REV + """
    select geo, time, round(arg_max(struct_pack(v := value), issue).v, 6) as final, round(arg_min(struct_pack(v := value), issue).v, 6) as first from rev group by all
    """)  # fmt: skip
def revision_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The answer key: final and first value per key."""
    return r6(vintage.label_columns(log(spark, sf_dir)), "final", "first")


@query("archive_holes", REV + " select time, min(issue) as first_issue, min(issue) - time > 7 as late from rev group by time")
def archive_holes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weeks whose first issue came late."""
    return vintage.archive_holes(log(spark, sf_dir))


@query("asof_grid_intersection", REV + " select issue from rev where covid is not null intersect select issue from rev where flu is not null intersect select issue from rev where rsv is not null and dayofweek(issue) = 6")
def asof_grid_intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Saturdays on which all three signals were published."""
    r = revision_log(spark, sf_dir)
    a, b, c = (r.filter(F.col(s).isNotNull()).select("issue") for s in ("covid", "flu", "rsv"))
    return a.intersect(b).intersect(c.filter(F.dayofweek("issue") == 7))


@query("strict_sum", REV + " select geo, time, issue, round(covid + flu + rsv, 6) as total from rev")
def strict_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sum of three signals, null unless all are there."""
    return revision_log(spark, sf_dir).select("geo", "time", "issue", F.round(F.col("covid") + F.col("flu") + F.col("rsv"), 6).alias("total"))


# Every date on which the table was published, and every signal.

SIGNALS = ("ed_covid", "ed_flu", "ed_rsv", "ed_resp", "temp_mean_f", "ww_flu", "news_n", "news_concern")
_DATES = "(select distinct as_of from county_week where as_of is not null)"
_SIGNALS = f"""
    with clean as (select site_id as geo, week_end as time, as_of as issue, loaded_at, {", ".join(f"case when not isnan({s}) then {s} end as {s}" for s in SIGNALS)} from county_week),
    rev as (select * exclude (loaded_at, rn) from (
        select *, row_number() over (partition by geo, time, issue order by loaded_at desc nulls last, {", ".join(f"{s} desc nulls last" for s in ("ed_resp", *[s for s in SIGNALS if s != "ed_resp"]))}) as rn from clean) where rn = 1)"""
_SLICES = _SIGNALS + f"""
    , held as (select d.as_of, r.* from {_DATES} d join (select *, lead(issue) over (partition by geo, time order by issue) as upto from rev) r on r.issue <= d.as_of and (r.upto is null or d.as_of < r.upto)),
    slots as (select g.geo, d.as_of, l.lag::int as lag, (d.as_of + ((6 - dayofweek(d.as_of)) % 7)::integer - (7 * l.lag)::integer)::date as time from (select distinct geo from rev) g cross join {_DATES} d cross join (select unnest(range(0, 9)) as lag) l),
    grid as (select s.geo, s.time, s.as_of, s.lag, {", ".join(f"case when s.time <= s.as_of then a.{s} end as {s}" for s in SIGNALS)} from slots s left join held a on a.as_of = s.as_of and a.geo = s.geo and a.time = s.time)"""
_ROUNDED = ", ".join(f"round(g.{s}, 6) as {s}" for s in SIGNALS)


def origin_dates(spark: SparkSession, sf_dir: str) -> list[dt.date]:
    """Every as_of of county_week, in order: a calendar."""
    return sorted(r[0] for r in table(spark, sf_dir, "county_week").select("as_of").filter("as_of is not null").distinct().toLocalIterator())


def signal_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """geo, time, issue and all SIGNALS of county_week, newest load per key."""
    first = ("ed_resp", *[s for s in SIGNALS if s != "ed_resp"])
    t = table(spark, sf_dir, "county_week")
    top = t.groupBy(F.col("site_id").alias("geo"), F.col("week_end").alias("time"), F.col("as_of").alias("issue")).agg(F.max(F.struct("loaded_at", *[number(s).alias(s) for s in first])).alias("_t"))
    return top.select("geo", "time", "issue", *[f"_t.{s}" for s in SIGNALS])


def slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = signal_log(spark, sf_dir)
    return vintage.grid_slices(r, r.select("geo").distinct(), origin_dates(spark, sf_dir), 8, list(SIGNALS))


@query("vintage_each_date", _SIGNALS + f" select d.as_of, r.geo, r.time, r.issue, round(r.ed_resp, 6) as value from {_DATES} d join (select *, lead(issue) over (partition by geo, time order by issue) as upto from rev) r on r.issue <= d.as_of and (r.upto is null or d.as_of < r.upto)")
def vintage_each_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was known on each date of the table, from one pass over the log."""
    return r6(vintage.as_of_each(log(spark, sf_dir), origin_dates(spark, sf_dir)), "value")


@query("county_week_slice", _SLICES + f" select geo, time, as_of, lag, {_ROUNDED} from grid g")
def county_week_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The grid of sites, all dates of the table and lags with every signal as known on each date."""
    return r6(slices(spark, sf_dir), *SIGNALS)


@query("county_week_full", _SLICES + f"""
    , key as (select geo, time, arg_max(struct_pack(v := ed_resp), issue).v as final, arg_min(struct_pack(v := ed_resp), issue).v as first from rev group by all),
    site as (select site_id, max(metro) as metro, max(fips) as fips from county_week group by site_id)
    select g.geo, s.fips, s.metro, g.time, g.as_of, g.lag, {_ROUNDED}, round(k.final, 6) as final, round(k.first, 6) as first
    from grid g left join key k on g.geo = k.geo and g.time = k.time left join site s on s.site_id = g.geo
    """)  # fmt: skip
def county_week_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fact table of all origins and signals, with labels and places joined last."""
    sites = table(spark, sf_dir, "county_week").groupBy(F.col("site_id").alias("geo")).agg(F.max("fips").alias("fips"), F.max("metro").alias("metro"))
    full = slices(spark, sf_dir).join(vintage.label_columns(log(spark, sf_dir)), ["geo", "time"], "left").join(sites, "geo", "left")
    return r6(full.select("geo", "fips", "metro", "time", "as_of", "lag", *SIGNALS, "final", "first"), *SIGNALS, "final", "first")


@query("leak_guard", "select site_id, week_end, as_of from (select distinct * from county_week) where week_end > as_of - 7 and (ed_covid is not null or ed_flu is not null or ed_rsv is not null)")
def leak_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values that were published within the week they are about: what a guard with a week's lag would stop."""
    t = table(spark, sf_dir, "county_week").distinct().withColumn("open", F.date_sub("as_of", 7))
    return vintage.leak_violations(t, "week_end", "open", ["ed_covid", "ed_flu", "ed_rsv"]).select("site_id", "week_end", "as_of")


@query("availability_weekly", """
    with d as (select distinct reading_id, site_id, week_end::date as day, ed_resp from ed_readings where ed_resp between 0 and 100), o as (select distinct origin_id, site_id, as_of from origins where as_of is not null)
    select o.origin_id, count(*) as visible, round(avg(d.ed_resp), 6) as mean from o join d on o.site_id = d.site_id and d.day + 7 <= o.as_of and d.day >= o.as_of - 35 group by o.origin_id
    """)  # fmt: skip
def availability_weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily records become visible seven days later: the last five weeks as each origin saw them."""
    d = table(spark, sf_dir, "ed_readings").select("reading_id", "site_id", F.col("week_end").cast("date").alias("day"), "ed_resp").distinct().filter("ed_resp between 0 and 100")
    o = table(spark, sf_dir, "origins").select("origin_id", "site_id", "as_of").filter("as_of is not null").distinct()
    seen = asof.range_join(o, d, ["site_id"], F.date_sub("as_of", 35), F.date_sub("as_of", 7), "day")
    return r6(seen.groupBy("origin_id").agg(F.count("*").alias("visible"), F.avg("ed_resp").alias("mean")), "mean")


@query("proxy_vintage", REV + """
    , honest as (select geo, time, issue, value, false as proxy from (select *, row_number() over (partition by geo, time order by issue desc) as rn from rev where issue <= date '2025-11-15') where rn = 1),
    late as (select geo, time, min(issue) as issue, arg_min(struct_pack(v := value), issue).v as value, true as proxy from rev where issue > date '2025-11-15' and time + 6 <= date '2025-12-06' group by geo, time)
    select geo, time, issue, round(value, 6) as value, proxy from honest union all select l.geo, l.time, l.issue, round(l.value, 6), l.proxy from late l anti join honest h on l.geo = h.geo and l.time = h.time
    """)  # fmt: skip
def proxy_vintage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vintage of one date, and for weeks it could not hold the first print once six days have passed."""
    r = log(spark, sf_dir)
    honest = vintage.load_vintage(r, dt.date(2025, 11, 15)).withColumn("proxy", F.lit(False))
    later = r.filter((F.col("issue") > F.lit("2025-11-15").cast("date")) & (F.date_add("time", 6) <= F.lit("2025-12-06").cast("date")))
    proxy = vintage.first_prints(later).join(honest.select("geo", "time"), ["geo", "time"], "left_anti").withColumn("proxy", F.lit(True))
    return r6(honest.unionByName(proxy).select("geo", "time", "issue", "value", "proxy"), "value")


@query("revision_profile", REV + """
    , fin as (select geo, time, arg_max(struct_pack(v := value), issue).v as f from rev group by all), j as (select date_diff('week', r.time, r.issue) as lag, case when f.f <> 0 then r.value / f.f - 1 end as rel from rev r join fin f on r.geo = f.geo and r.time = f.time where r.value is not null and f.f is not null)
    select lag::int as lag, count(*) as n, round(median(rel), 6) as median_rel, round(median(abs(rel)), 6) as median_abs, round(avg(case when abs(rel) > 0.05 then 1.0::double else 0.0::double end), 6) as share_over_5 from j group by lag
    """.replace("date_diff('week', r.time, r.issue)", "(r.issue - r.time) // 7"))  # fmt: skip
def revision_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far values of each lag are from final; zero finals count in n and in the share."""
    r = log(spark, sf_dir)
    final = vintage.load_vintage(r).select("geo", "time", F.col("value").alias("f"))
    j = r.join(final, ["geo", "time"]).filter("value is not null and f is not null")
    j = j.select((F.datediff("issue", "time") / 7).cast("int").alias("lag"), F.when(F.col("f") != 0, F.col("value") / F.col("f") - 1).alias("rel"))
    per = j.groupBy("lag").agg(F.count("*").alias("n"), F.avg(F.when(F.abs("rel") > 0.05, 1.0).otherwise(0.0)).alias("share_over_5"))
    middles = stats.quantiles(j, ["lag"], "rel", {"median_rel": 0.5}).join(stats.quantiles(j.withColumn("size", F.abs("rel")), ["lag"], "size", {"median_abs": 0.5}), "lag")
    return r6(per.join(middles, "lag", "left").select("lag", "n", "median_rel", "median_abs", "share_over_5"), "median_rel", "median_abs", "share_over_5")


@query("official_coverage", REV + """
    , d as (select geo, issue, bool_or(value is not null) as has from rev group by all), f as (select geo, time, min((issue - time) // 7) as lag from rev where value is not null group by all)
    select d.geo, count(*) as dates, count(*) filter (has) as with_data, min(issue) filter (has) as first_date, any_value(l.mid) as typical_lag, any_value(l.top) as worst_lag
    from d left join (select geo, median(lag)::double as mid, max(lag)::int as top from f group by geo) l on d.geo = l.geo group by d.geo
    """)  # fmt: skip
def official_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per site: dates, dates with any value, the first of these, and how late weeks first appear."""
    r = log(spark, sf_dir)
    d = r.groupBy("geo", "issue").agg(F.bool_or(F.col("value").isNotNull()).alias("has")).groupBy("geo").agg(F.count("*").alias("dates"), F.count_if("has").alias("with_data"), F.min(F.when(F.col("has"), F.col("issue"))).alias("first_date"))
    f = r.filter("value is not null").groupBy("geo", "time").agg(F.min((F.datediff("issue", "time") / 7).cast("int")).alias("lag"))
    lags = f.groupBy("geo").agg(F.median("lag").alias("typical_lag"), F.max("lag").alias("worst_lag"))
    return d.join(lags, "geo", "left")


@query("lag_pivot_backfill", REV + """
    , p as (select geo, issue, """ + ", ".join(f"max(value) filter ((issue - time) // 7 = {k}) as y{k}" for k in range(9)) + """ from rev group by all)
    select geo, issue, round(coalesce(y1, y2, y3, y4, y5, y6, y7, y8), 6) as last, round(coalesce(y2, y3, y4, y5, y6, y7, y8), 6) as lag2, round(coalesce(y3, y4, y5, y6, y7, y8), 6) as lag3 from p
    """)  # fmt: skip
def lag_pivot_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per site and date: newest known value and the next lags, filled from older ones."""
    lag = (F.datediff("issue", "time") / 7).cast("int")
    wide = log(spark, sf_dir).groupBy("geo", "issue").agg(*[F.max(F.when(lag == k, F.col("value"))).alias(f"y{k}") for k in range(9)])
    fill = lambda k: F.coalesce(*[F.col(f"y{j}") for j in range(k, 9)])
    return r6(wide.select("geo", "issue", fill(1).alias("last"), fill(2).alias("lag2"), fill(3).alias("lag3")), "last", "lag2", "lag3")


_WEEKLY = "with w as (select distinct site_id as geo, week_end as time, ed_resp_final as v from county_week where ed_resp_final is not null)"


def weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "county_week").select(F.col("site_id").alias("geo"), F.col("week_end").alias("time"), F.col("ed_resp_final").alias("v")).filter("v is not null").distinct()


_EXAMPLES = _WEEKLY + """
    , l as (select *, lag(v, 1) over s as v1, lag(v, 2) over s as v2, lag(v, 3) over s as v3, lag(time, 3) over s as t3 from w window s as (partition by geo order by time)),
    e as (select geo, time, ln(greatest(v1, 0.05)) as level, ln(greatest(v1, 0.05)) - ln(greatest(v2, 0.05)) as d1, ln(greatest(v2, 0.05)) - ln(greatest(v3, 0.05)) as d2,
          ln(greatest(v, 0.05)) - ln(greatest(v1, 0.05)) as y from l where time - t3 = 21)"""


def examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Momentum design with target: rows whose third week back is exactly 21 days earlier."""
    by = Window.partitionBy("geo").orderBy("time")
    lagged = weekly(spark, sf_dir).withColumns({f"v{k}": F.lag("v", k).over(by) for k in (1, 2, 3)} | {"t3": F.lag("time", 3).over(by)}).filter(F.datediff("time", "t3") == 21)
    log_ = lambda c: F.ln(F.greatest(F.col(c), F.lit(0.05)))
    return lagged.select("geo", "time", log_("v1").alias("level"), (log_("v1") - log_("v2")).alias("d1"), (log_("v2") - log_("v3")).alias("d2"), (log_("v") - log_("v1")).alias("y"), F.col("v").alias("final"), F.col("v1").alias("last"))


@query("history_examples", _EXAMPLES + """
    select geo, time, round(level, 6) as level, round(d1, 6) as d1, round(d2, 6) as d2, round(y, 6) as y, round(sin(2 * pi() / 365.25 * dayofyear(time)), 6) as sin1, round(cos(2 * pi() / 365.25 * dayofyear(time)), 6) as cos1 from e
    """)  # fmt: skip
def history_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The momentum design with yearly harmonics and its target."""
    h = harmonics("time", 1)
    return r6(examples(spark, sf_dir).select("geo", "time", "level", "d1", "d2", "y", h["sin1"].alias("sin1"), h["cos1"].alias("cos1")), "level", "d1", "d2", "y", "sin1", "cos1")


def training_set(spark: SparkSession, sf_dir: str, grid: DataFrame) -> DataFrame:
    """The examples of all origins of ``grid``."""
    labels = grid.filter("value is not null").select("geo", F.col("as_of").alias("origin"), "time", F.col("value").alias("label"))
    lag = (F.datediff("issue", "time") / 7).cast("int")
    feats = log(spark, sf_dir).groupBy("geo", F.col("issue").alias("as_of")).agg(*[F.max(F.when(lag == k, F.col("value"))).alias(f"y{k}") for k in (1, 2)])
    return r6(vintage.honest_examples(feats, labels, 14, 56).select("origin", "geo", "time", "label", "y1", "y2"), "label", "y1", "y2")


@query("honest_training_set", _SLICES + """
    , lab as (select geo, as_of as origin, time, ed_resp as label from grid where ed_resp is not null),
    feat as (select geo, issue as time, max(ed_resp) filter ((issue - time) // 7 = 1) as y1, max(ed_resp) filter ((issue - time) // 7 = 2) as y2 from rev group by geo, issue)
    select l.origin, l.geo, l.time, round(l.label, 6) as label, round(f.y1, 6) as y1, round(f.y2, 6) as y2 from lab l join feat f on f.geo = l.geo and f.time = l.time where l.origin - l.time between 14 and 56
    """)  # fmt: skip
def honest_training_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The training set for every origin of the table."""
    r = log(spark, sf_dir)
    grid = vintage.grid_slices(r, r.select("geo").distinct(), origin_dates(spark, sf_dir), 8, ["value"])
    return training_set(spark, sf_dir, grid)


def settled(spark: SparkSession, sf_dir: str, dates: list[dt.date]) -> DataFrame:
    days = F.array(*[F.lit(d).cast("date") for d in dates])
    pool = weekly(spark, sf_dir).select("v", F.explode(F.filter(days, lambda d: F.col("time") <= F.date_sub(d, 56))).alias("origin"))
    return r6(pool.groupBy("origin").agg(F.count("*").alias("examples"), F.avg("v").alias("mean")), "mean")


@query("settled_pool", _WEEKLY + f" select d.as_of as origin, count(*) as examples, round(avg(v), 6) as mean from w join {_DATES} d on w.time <= d.as_of - 56 group by all")
def settled_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many settled weeks every origin of the table may train on."""
    return settled(spark, sf_dir, origin_dates(spark, sf_dir))


# Predictions: last value, seasonal drift and mean of the last three, scored against final.

_PRED = """
    with w as (select site_id as geo, week_end as time, max(ed_resp_final) as v, max(ed_resp_first) as f from county_week where ed_resp_final is not null group by all),
    l as (select geo, time, v as final, f as first, lag(v, 1) over s as a, lag(v, 2) over s as b, lag(v, 3) over s as c from w window s as (partition by geo order by time)),
    p as (select geo, time, final, first, 'naive' as model, a as pred from l where c is not null union all select geo, time, final, first, 'drift', greatest(a + (a - b) / 2, 0) from l where c is not null
          union all select geo, time, final, first, 'mean3', (a + b + c) / 3 from l where c is not null),
    site as (select site_id as geo, max(metro) as metro, bool_or(home) as home from county_week group by site_id)"""


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """geo, metro, home, time, model, pred, first, final: three simple models of the next week, with the first print and the final value."""
    by = Window.partitionBy("geo").orderBy("time")
    t = table(spark, sf_dir, "county_week").filter("ed_resp_final is not null")
    w = t.groupBy(F.col("site_id").alias("geo"), F.col("week_end").alias("time")).agg(F.max("ed_resp_final").alias("final"), F.max("ed_resp_first").alias("first"))
    l = w.withColumns({n: F.lag("final", k).over(by) for n, k in (("a", 1), ("b", 2), ("c", 3))}).filter("c is not null")  # noqa: E741
    a, b, c = F.col("a"), F.col("b"), F.col("c")
    models = F.array(*[F.struct(F.lit(n).alias("model"), x.alias("pred")) for n, x in (("naive", a), ("drift", F.greatest(a + (a - b) / 2, F.lit(0.0))), ("mean3", (a + b + c) / 3))])
    sites = table(spark, sf_dir, "county_week").groupBy(F.col("site_id").alias("geo")).agg(F.max("metro").alias("metro"), F.bool_or("home").alias("home"))
    return l.select("geo", "time", "final", "first", F.explode(models).alias("m")).select("geo", "time", "final", "first", "m.model", "m.pred").join(sites, "geo")


_METRICS = """count(pred - final) as n, round(avg(abs(pred - final)), 6) as mae, round(sqrt(avg((pred - final) * (pred - final))), 6) as rmse,
    round(1 - sum((pred - final) * (pred - final)) / nullif(sum(final * final) - count(*) * avg(final) * avg(final), 0), 6) as r2"""


@query("metrics_summary", _PRED + f"""
    , g as (select p.*, unnest(['all', case when home then 'home' else 'comparison' end, 'metro:' || metro]) as grp from p join site s on p.geo = s.geo), m as (select grp, model, {_METRICS} from g group by all)
    select m.*, round(case when b.mae > 0 then 1 - m.mae / b.mae end, 4) as skill from m left join m b on b.grp = m.grp and b.model = 'naive'
    """)  # fmt: skip
def metrics_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors by model over overlapping groups, with skill against the naive model."""
    g = stats.overlapping_groups(predictions(spark, sf_dir), "metro", "home")
    m = r6(g.groupBy("grp", "model").agg(*stats.metrics()[:4]), "mae", "rmse", "r2")
    return stats.skill(m, ["grp"], "model", "naive").withColumn("skill", F.round("skill", 4))


@query("metrics_gap_closed", _PRED + """
    select model, count(*) as n, round(1 - sum(abs(pred - final)) filter (abs(first - final) > 1e-9) / sum(abs(first - final)) filter (abs(first - final) > 1e-9), 6) as gap_total,
           round(median(case when abs(first - final) > 1e-9 then 1 - abs(pred - final) / abs(first - final) end), 6) as gap_median from p group by model
    """)  # fmt: skip
def metrics_gap_closed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of the gap between first and final value each model closes."""
    p = predictions(spark, sf_dir)
    m = p.groupBy("model").agg(*stats.metrics())
    middle = stats.quantiles(p.withColumn("closed", stats.gap_closed("pred", "first", "final")), ["model"], "closed", {"gap_median": 0.5})
    return r6(m.join(middle, "model", "left").select("model", "n", "gap_total", "gap_median"), "gap_total", "gap_median")


@query("metrics_complete_pairs", _PRED + """
    , q as (select * from p where not (model = 'drift' and final > 8)), k as (select geo, time from q group by all having count(distinct model) = 3)
    select model, count(*) as n, round(avg(abs(pred - final)), 6) as mae from q semi join k on q.geo = k.geo and q.time = k.time group by model
    """)  # fmt: skip
def metrics_complete_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores on the weeks that all models have predicted, where one of them has gaps."""
    q = predictions(spark, sf_dir).filter("not (model = 'drift' and final > 8)")
    return r6(stats.complete_pairs(q, ["geo", "time"], "model", 3).groupBy("model").agg(F.count("*").alias("n"), F.avg(F.abs(F.col("pred") - F.col("final"))).alias("mae")), "mae")


@query("metrics_series_dedupe", _PRED + " select model, metro, time, round(first, 6) as first, round(final, 6) as final, min(p.geo) as geo from p join site s on p.geo = s.geo group by model, metro, time, p.first, p.final")
def metrics_series_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per series that several sites share; the lowest site stays."""
    p = predictions(spark, sf_dir)
    return r6(p.groupBy("model", "metro", "time", "first", "final").agg(F.min("geo").alias("geo")), "first", "final")


@query("sanity_checks", _PRED + """
    , c as (select 2 * greatest(max(final), max(first)) as top from p), q as (select model, geo, time, case when model = 'drift' and pred = 0 then null when model = 'mean3' and geo % 50 = 0 then pred * 40 else pred end as pred from p)
    select model, problem, count(*) as n from (select model, case when pred is null then 'missing' when pred < 0 then 'negative' when pred > c.top then 'above twice the maximum' end as problem from q, c) where problem is not null group by all
    """)  # fmt: skip
def sanity_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions that are missing, negative or above twice the largest value seen, by model."""
    p = predictions(spark, sf_dir)
    top = p.agg((2 * F.greatest(F.max("final"), F.max("first"))).alias("v")).first()["v"]
    spoilt = F.when((F.col("model") == "drift") & (F.col("pred") == 0), None).when((F.col("model") == "mean3") & (F.col("geo") % 50 == 0), F.col("pred") * 40).otherwise(F.col("pred"))
    q = p.select("model", spoilt.alias("pred"))
    problem = F.when(F.col("pred").isNull(), "missing").when(F.col("pred") < 0, "negative").when(F.col("pred") > F.lit(top), "above twice the maximum")
    return q.select("model", problem.alias("problem")).filter("problem is not null").groupBy("model", "problem").agg(F.count("*").alias("n"))


@query("paired_wilcoxon", _PRED + """
    , d as (select metro, round(abs(a.pred - a.final) - abs(b.pred - b.final), 6) as d from p a join p b on a.geo = b.geo and a.time = b.time and a.model = 'mean3' and b.model = 'naive' join site s on s.geo = a.geo),
    r as (select metro, d, rank() over (partition by metro order by abs(d)) + (count(*) over (partition by metro, abs(d)) - 1) / 2.0::double as rk, count(*) over (partition by metro, abs(d)) as t from d where d <> 0),
    s as (select metro, count(*) as m, sum(case when d > 0 then rk else 0 end) as w, sum(t * t - 1)::double as tt from r group by metro), n as (select metro, count(*) as n from d group by metro)
    select n.metro, n.n, s.m, w, round(z, 6) as z, round(least(1, u * (0.254829592::double + u * (-0.284496736::double + u * (1.421413741::double + u * (-1.453152027::double + u * 1.061405429::double)))) * exp(-z * z / 2)), 3) as p
    from (select *, 1 / (1 + abs(z) / sqrt(2.0::double) * 0.3275911::double) as u from (select *, (w - m * (m + 1) / 4.0::double) / sqrt(m::double * (m + 1) * (2 * m + 1) / 24.0::double - tt / 48.0::double) as z from s)) s join n on n.metro = s.metro
    """)  # fmt: skip
def paired_wilcoxon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paired signed-rank test of two models per metro; p is exact for few pairs without ties, else by the normal approximation."""
    p = predictions(spark, sf_dir).withColumn("e", F.abs(F.col("pred") - F.col("final")))
    wide = p.groupBy("metro", "geo", "time").agg(*[F.max(F.when(F.col("model") == m, F.col("e"))).alias(m) for m in ("mean3", "naive")])
    return stats.wilcoxon(wide, ["metro"], "mean3", "naive").select("metro", "n", "m", "w", F.round("z", 6).alias("z"), F.round("p", 3).alias("p"))


#: The models from the simplest up; each is tested against the first and against the one before it.
LADDER = ("naive", "drift", "mean3")


@query("ladder_tests")
def ladder_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every model against the naive one and against the rung below it per metro, with Holm's adjustment over all tests of a metro."""
    p = predictions(spark, sf_dir).withColumn("e", F.abs(F.col("pred") - F.col("final")))
    wide = p.groupBy("metro", "geo", "time").agg(*[F.max(F.when(F.col("model") == m, F.col("e"))).alias(m) for m in LADDER])
    tests = [(m, vs) for below, m in zip(LADDER, LADDER[1:]) for vs in dict.fromkeys((LADDER[0], below))]
    rows = F.array(*[F.struct(F.lit(m).alias("model"), F.lit(vs).alias("vs"), F.col(m).alias("e"), F.col(vs).alias("base")) for m, vs in tests])
    tested = stats.wilcoxon(wide.select("metro", F.explode(rows).alias("r")).select("metro", "r.*"), ["metro", "model", "vs"], "e", "base")
    return stats.holm(tested, ["metro"], "p")


_P = "with t as (select p_partkey as k, p_brand as fam, case when p_partkey % 97 = 0 then null else 1.0::double / (p_partkey % 1000 + 2) * (1 + p_size) / 60 end as p from part)"


def p_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    p = F.when(k % 97 != 0, F.lit(1.0) / (k % 1000 + 2) * (1 + F.col("p_size")) / 60)
    return table(spark, sf_dir, "part").select(k.alias("k"), F.col("p_brand").alias("fam"), p.alias("p"))


@query("adjust_holm", _P + """
    , r as (select *, row_number() over (partition by fam order by p, k) as rk, count(*) over (partition by fam) as m from t where p is not null)
    select k, fam, round(least(1.0::double, max(p * (m - rk + 1)) over (partition by fam order by rk rows between unbounded preceding and current row)), 9) as p_holm from r union all select k, fam, null from t where p is null
    """)  # fmt: skip
def adjust_holm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Holm's step-down adjustment within families; nulls do not count."""
    return stats.holm(p_values(spark, sf_dir), ["fam"], "p").select("k", "fam", F.round("p_holm", 9).alias("p_holm"))


@query("adjust_false_discovery", _P + """
    , r as (select *, row_number() over (partition by fam order by p, k) as rk, count(*) over (partition by fam) as m from t where p is not null)
    select k, fam, round(least(1.0::double, min(p * m / rk) over (partition by fam order by rk rows between current row and unbounded following)), 9) as p_fdr from r union all select k, fam, null from t where p is null
    """)  # fmt: skip
def adjust_false_discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Step-up false discovery adjustment within families."""
    return stats.benjamini_hochberg(p_values(spark, sf_dir), ["fam"], "p").select("k", "fam", F.round("p_fdr", 9).alias("p_fdr"))


@query("rank_correlation", """
    with r as (select p_brand, rank() over (partition by p_brand order by p_size) + (count(*) over (partition by p_brand, p_size) - 1) / 2.0::double as a,
                      rank() over (partition by p_brand order by p_retailprice) + (count(*) over (partition by p_brand, p_retailprice) - 1) / 2.0::double as b from part)
    select p_brand, count(*) as n, round(corr(a, b), 6) as rho from r group by p_brand
    """)  # fmt: skip
def rank_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Correlation of average ranks."""
    s = stats.spearman(table(spark, sf_dir, "part"), ["p_brand"], "p_size", "p_retailprice")
    return r6(s, "rho")


@query("bootstrap_interval")
def bootstrap_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Poisson bootstrap interval of the mean order price."""
    return stats.bootstrap_mean(table(spark, sf_dir, "orders"), "o_orderkey", "o_totalprice", reps=100)


@query("snapshot_partitions", "select issue, count(*) as rows from (select distinct site_id, week_end, as_of as issue from county_week) group by issue")
def snapshot_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The issues of a source and their sizes."""
    picked = snapshot_changes.latest_delivery(table(spark, sf_dir, "county_week"), ["site_id", "week_end"], "as_of", "ed_resp", "loaded_at")
    return picked.groupBy(F.col("as_of").alias("issue")).agg(F.count("*").alias("rows"))


@query("snapshot_contract", """
    select rule, n::bigint as n from (select count(*) filter (site_id is null) as blank_geo, count(*) filter (week_end is null) as null_time, count(*) filter (as_of < week_end) as issue_before_time,
           (select count(*) from (select 1 from county_week group by site_id, week_end, as_of having count(*) > 1)) as repeated_key from county_week) unpivot (n for rule in (blank_geo, null_time, issue_before_time, repeated_key))
    """)  # fmt: skip
def snapshot_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows break each rule of the snapshot contract."""
    t = table(spark, sf_dir, "county_week")
    found = t.agg(F.count_if(F.col("site_id").isNull()).alias("blank_geo"), F.count_if(F.col("week_end").isNull()).alias("null_time"), F.count_if(F.col("as_of") < F.col("week_end")).alias("issue_before_time"))
    repeated = t.groupBy("site_id", "week_end", "as_of").count().agg(F.count_if(F.col("count") > 1).alias("n")).select(F.lit("repeated_key").alias("rule"), "n")
    return found.unpivot([], ["blank_geo", "null_time", "issue_before_time"], "rule", "n").unionByName(repeated)


@query("reliable_sites", REV + """
    , recent as (select geo, value > 0 as active from (select *, row_number() over (partition by geo order by time desc) as rn from (select geo, time, arg_max(struct_pack(v := value), issue).v as value from rev group by all) where value is not null) where rn <= 8)
    select geo, round(avg(active::int), 6) as active from recent group by geo having avg(active::int) >= 0.5
    """)  # fmt: skip
def reliable_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sites active in at least half of their last eight present weeks."""
    final = vintage.load_vintage(log(spark, sf_dir)).filter("value is not null")
    recent = final.withColumn("rn", F.row_number().over(Window.partitionBy("geo").orderBy(F.desc("time")))).filter("rn <= 8")
    share = recent.groupBy("geo").agg(F.avg((F.col("value") > 0).cast("int")).alias("active")).filter("active >= 0.5")
    return r6(share, "active")
