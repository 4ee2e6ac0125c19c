"""Relational operators: joins, aggregates, windows, order, sets and shapes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.calendar import week_end
from tidemark.operators import asof, stats, vintage
from tidemark.plans.registry import Registry
from tidemark.sources.tables import table

REGISTRY = Registry()
query = REGISTRY.query

#: The Saturday on or after a date, in DuckDB.
SAT = "({0}::date + ((6 - dayofweek({0}::date)) % 7)::integer)::date"


def r6(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


def week_counts(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    e = table(spark, sf_dir, "events").filter(F.col("event_type") == kind)
    return e.groupBy("user_id", week_end("ts").alias("week")).agg(F.count("*").alias(kind))


# Joins


@query("join_full_outer", f"""
    with w as (select user_id, {SAT.format('ts')} as week, event_type, count(*) as n from events group by all)
    select coalesce(a.user_id, b.user_id) as user_id, coalesce(a.week, b.week) as week, a.n as click, b.n as purchase
    from (select * from w where event_type = 'click') a full outer join (select * from w where event_type = 'purchase') b on a.user_id = b.user_id and a.week = b.week
    """)  # fmt: skip
def join_full_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two weekly signals side by side, weeks of either kept."""
    return week_counts(spark, sf_dir, "click").join(week_counts(spark, sf_dir, "purchase"), ["user_id", "week"], "full_outer")


@query("join_inner_three", f"""
    with w as (select user_id, {SAT.format('ts')} as week, event_type, count(*) as n from events group by all)
    select a.user_id, a.week, a.n + b.n + c.n as total from (select * from w where event_type = 'click') a
    join (select * from w where event_type = 'purchase') b using (user_id, week) join (select * from w where event_type = 'view') c using (user_id, week)
    """)  # fmt: skip
def join_inner_three(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weeks that have all three signals, with their strict sum."""
    kinds = ("click", "purchase", "view")
    a, b, c = (week_counts(spark, sf_dir, k) for k in kinds)
    return a.join(b, ["user_id", "week"]).join(c, ["user_id", "week"]).select("user_id", "week", (F.col("click") + F.col("purchase") + F.col("view")).alias("total"))


@query("join_left_grid", """
    select s.site_id, w.week::date as week_end, count(r.reading_id) as readings from (select distinct site_id from ed_readings) s
    cross join (select unnest(generate_series(min(week_end)::date + ((6 - dayofweek(min(week_end)::date)) % 7)::integer, max(week_end)::date + 6, interval 7 day)) as week from ed_readings) w
    left join (select distinct reading_id, site_id, week_end from ed_readings) r on r.site_id = s.site_id and r.week_end >= w.week - interval 6 day and r.week_end < w.week + interval 1 day
    group by all
    """)  # fmt: skip
def join_left_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A grid of sites and weeks, with the readings of each cell; empty cells stay."""
    r = table(spark, sf_dir, "ed_readings").select("reading_id", "site_id", "week_end").distinct()
    first, last = r.agg(F.min(week_end("week_end")), F.max(week_end("week_end"))).first()  # a calendar
    weeks = F.explode(F.sequence(F.lit(first), F.lit(last), F.expr("interval 7 days"))) if first else F.lit(None).cast("date")
    grid = r.select("site_id").distinct().select("site_id", weeks.alias("week_end"))
    counts = r.groupBy("site_id", week_end("week_end").alias("week_end")).agg(F.count("*").alias("readings"))
    return grid.join(counts, ["site_id", "week_end"], "left").fillna(0, ["readings"])


@query("join_lookup", "select c.c_custkey, c.c_name, n.n_name, r.r_name from customer c left join nation n on c.c_nationkey = n.n_nationkey left join region r on n.n_regionkey = r.r_regionkey")
def join_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names looked up through two dimension tables."""
    c, n, r = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    return c.join(n, F.col("c_nationkey") == F.col("n_nationkey"), "left").join(r, F.col("n_regionkey") == F.col("r_regionkey"), "left").select("c_custkey", "c_name", "n_name", "r_name")


@query("join_semi", "select o_orderkey, o_custkey from orders where o_custkey in (select c_custkey from customer where c_mktsegment = 'BUILDING')")
def join_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of the customers in a set of keys."""
    keys = table(spark, sf_dir, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, sf_dir, "orders").join(keys, "o_custkey", "left_semi").select("o_orderkey", "o_custkey")


@query("join_anti_upsert", """
    with new as (select c_custkey, c_name, c_acctbal + 1 as c_acctbal from customer where c_nationkey = 3)
    select c_custkey, c_name, round(c_acctbal, 6) as c_acctbal from (
        select c_custkey, c_name, c_acctbal from customer where c_custkey not in (select c_custkey from new) union all select * from new)
    """)  # fmt: skip
def join_anti_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New rows take the place of old ones with their key."""
    old = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    new = table(spark, sf_dir, "customer").filter("c_nationkey = 3").select("c_custkey", "c_name", (F.col("c_acctbal") + 1).alias("c_acctbal"))
    return r6(vintage.upsert(old, new, ["c_custkey"]), "c_acctbal")


@query("join_range", """
    select o.origin_id, count(*) as examples, round(avg(w.ed_resp_final), 6) as mean_final from (select distinct origin_id, site_id, as_of from origins where as_of is not null) o
    join (select distinct site_id, week_end, ed_resp_final from county_week) w on o.site_id = w.site_id and w.week_end between o.as_of - 56 and o.as_of - 14 group by o.origin_id
    """)  # fmt: skip
def join_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each origin with the weeks of its site in a window before it."""
    o = table(spark, sf_dir, "origins").select("origin_id", "site_id", "as_of").distinct()
    w = table(spark, sf_dir, "county_week").select("site_id", "week_end", "ed_resp_final").distinct()
    near = asof.range_join(o, w, ["site_id"], F.date_sub("as_of", 56), F.date_sub("as_of", 14), "week_end")
    return r6(near.groupBy("origin_id").agg(F.count("*").alias("examples"), F.avg("ed_resp_final").alias("mean_final")), "mean_final")


@query("join_asof_forward", """
    with k as (select distinct finding_id, site_id, try_cast(left(trim(known_by), 10) as date) as day from findings), o as (select distinct origin_id, site_id, as_of from origins where as_of is not null)
    select o.origin_id, coalesce(min(k.day) filter (k.day >= o.as_of), max(k.day)) as day from o join k on o.site_id = k.site_id and k.day is not null group by o.origin_id
    """)  # fmt: skip
def join_asof_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first day on or after each origin on which its site published, else its last."""
    day = F.try_to_date(F.substring(F.trim("known_by"), 1, 10), "yyyy-MM-dd")
    k = table(spark, sf_dir, "findings").select("site_id", day.alias("day")).filter("day is not null and site_id is not null").distinct()
    o = table(spark, sf_dir, "origins").select("origin_id", "site_id", "as_of").filter("as_of is not null").distinct()
    # Time reversed: the latest version at or before the negative of a day is the earliest on or after it.
    back = lambda df, c: df.withColumn("_back", -F.unix_date(c))
    found = asof.asof_join(back(o, "as_of"), back(k, "day"), ["site_id"], "_back", "origin_id", "_back", "day", [])
    last = k.groupBy("site_id").agg(F.max("day").alias("last"))
    return found.join(last, "site_id").select("origin_id", F.coalesce("version.order", "last").alias("day"))


@query("join_self_offset", """
    with w as (select distinct site_id, week_end, ed_resp_final as v from county_week)
    select a.site_id, a.week_end, round(a.v - b.v, 6) as change from w a join w b on a.site_id = b.site_id and b.week_end = a.week_end - 14
    """)  # fmt: skip
def join_self_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each week against the week two before it."""
    w = table(spark, sf_dir, "county_week").select("site_id", "week_end", F.col("ed_resp_final").alias("v")).distinct()
    earlier = w.select("site_id", F.date_add("week_end", 14).alias("week_end"), F.col("v").alias("b"))
    return w.join(earlier, ["site_id", "week_end"]).select("site_id", "week_end", F.round(F.col("v") - F.col("b"), 6).alias("change"))


@query("join_newest_known", """
    with r as (select * from (select *, row_number() over (partition by site_id, week_end, as_of order by loaded_at desc, ed_resp desc nulls last) as rn from county_week) where rn = 1)
    select site_id, as_of, min(lag) as lag, arg_min(round(ed_resp, 6), lag) as newest from r where lag >= 1 and ed_resp is not null group by site_id, as_of
    """)  # fmt: skip
def join_newest_known(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per site and as_of, the newest settled value: smallest lag of one or more with a value."""
    rows = table(spark, sf_dir, "county_week").groupBy("site_id", "week_end", "as_of", "lag").agg(F.max(F.struct("loaded_at", "ed_resp")).alias("t")).withColumn("v", F.col("t.ed_resp"))
    known = rows.filter("lag >= 1 and v is not null")
    return known.groupBy("site_id", "as_of").agg(F.min("lag").alias("lag"), F.min_by(F.round("v", 6), "lag").alias("newest"))


# Aggregates


@query("agg_weekly_station", f"""
    select site_id, {SAT.format('week_end')} as week, round(avg(ed_resp), 6) as mean, round(sum(ed_resp), 6) as total, count(ed_resp) as n
    from (select distinct * from ed_readings) group by all
    """)  # fmt: skip
def agg_weekly_station(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean, sum (null if there is no value) and count per site and week."""
    r = table(spark, sf_dir, "ed_readings").distinct()
    return r6(r.groupBy("site_id", week_end("week_end").alias("week")).agg(F.avg("ed_resp").alias("mean"), F.sum("ed_resp").alias("total"), F.count("ed_resp").alias("n")), "mean", "total")


@query("agg_weighted_mean", """
    select l_orderkey % 500 as grp, round(case when sum(w) > 0 then sum(w * v) / sum(w) else avg(v) end, 6) as mean
    from (select l_orderkey, case when l_linenumber = 1 then 0 else greatest(l_quantity - 40, 0) end as w, l_extendedprice as v from lineitem) group by all
    """)  # fmt: skip
def agg_weighted_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A weighted mean that falls back to the plain mean where no weight is left."""
    w = F.when(F.col("l_linenumber") == 1, 0.0).otherwise(F.greatest(F.col("l_quantity") - 40, F.lit(0.0)))
    v = F.col("l_extendedprice")
    mean = F.when(F.sum(w) > 0, F.sum(w * v) / F.when(F.sum(w) > 0, F.sum(w))).otherwise(F.avg(v))
    return table(spark, sf_dir, "lineitem").groupBy((F.col("l_orderkey") % 500).alias("grp")).agg(F.round(mean, 6).alias("mean"))


@query("agg_distinct_and_lists", """
    select metro, count(distinct fips) as counties, array_to_string(list_sort(list(distinct state)), ',') as states, bool_or(population > 100000) as any_large, count(*) filter (population < 20000) as small from counties group by metro
    """)  # fmt: skip
def agg_distinct_and_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact distinct counts, a sorted distinct list, any, and a conditional count."""
    return table(spark, sf_dir, "counties").groupBy("metro").agg(
        F.count_distinct("fips").alias("counties"), F.array_join(F.array_sort(F.collect_set("state")), ",").alias("states"),
        F.bool_or(F.col("population") > 100000).alias("any_large"), F.count_if(F.col("population") < 20000).alias("small"),
    )


@query("agg_two_levels", """
    with m as (select site_id, week_end, min(lag) as first_lag from county_week where ed_resp is not null group by all)
    select site_id, round(avg((first_lag = 1)::int), 6) as share_next_week, median(first_lag) as typical, max(first_lag) as worst from m group by site_id
    """)  # fmt: skip
def agg_two_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How soon weeks are first published: least lag per week, then share, median and worst per site."""
    m = table(spark, sf_dir, "county_week").filter("ed_resp is not null").groupBy("site_id", "week_end").agg(F.min("lag").alias("first_lag"))
    return m.groupBy("site_id").agg(F.round(F.avg((F.col("first_lag") == 1).cast("int")), 6).alias("share_next_week"), F.median("first_lag").alias("typical"), F.max("first_lag").alias("worst"))


@query("agg_spread", "select c_mktsegment, count(*) as n, round(avg(c_acctbal), 6) as mean, round(stddev_samp(c_acctbal), 6) as sd, round(median(c_acctbal), 6) as mid from customer group by 1")
def agg_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Count, mean, sample deviation and exact median."""
    return r6(table(spark, sf_dir, "customer").groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.avg("c_acctbal").alias("mean"), F.stddev_samp("c_acctbal").alias("sd"), F.median("c_acctbal").alias("mid")), "mean", "sd", "mid")


@query("agg_quantiles", """
    select o_orderpriority, round(quantile_cont(o_totalprice, 0.1), 6) as q10, round(quantile_cont(o_totalprice, 0.5), 6) as q50, round(quantile_cont(o_totalprice, 0.9), 6) as q90 from orders group by 1
    """)  # fmt: skip
def agg_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact quantiles with linear interpolation."""
    return r6(stats.quantiles(table(spark, sf_dir, "orders"), ["o_orderpriority"], "o_totalprice", {"q10": 0.1, "q50": 0.5, "q90": 0.9}), "q10", "q50", "q90")


@query("agg_peak_week", """
    with m as (select fips, week_end, avg(ed_resp_final) as v from (select distinct site_id, fips, week_end, ed_resp_final from county_week) group by all)
    select fips, round(max(v), 6) as peak, arg_max(week_end, struct_pack(v := v, w := week_end)) as week from m where v is not null group by fips
    """)  # fmt: skip
def agg_peak_week(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The week with a county's highest mean; the later of equal ones."""
    m = table(spark, sf_dir, "county_week").select("site_id", "fips", "week_end", "ed_resp_final").distinct().groupBy("fips", "week_end").agg(F.avg("ed_resp_final").alias("v"))
    return m.filter("v is not null").groupBy("fips").agg(F.round(F.max("v"), 6).alias("peak"), F.max_by("week_end", F.struct("v", "week_end")).alias("week"))


@query("agg_share_by_key", "select metro, round(avg(fetched_ok = 'True')::double, 6) as fetched, count(*) as n from (select distinct * from articles) group by metro".replace("avg(fetched_ok = 'True')", "avg((fetched_ok = 'True')::int)"))
def agg_share_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of a condition and the size of each group."""
    return table(spark, sf_dir, "articles").distinct().groupBy("metro").agg(F.round(F.avg((F.col("fetched_ok") == "True").cast("int")), 6).alias("fetched"), F.count("*").alias("n"))


@query("agg_overlapping_groups", """
    with r as (select distinct site_id, metro, home, week_end, ed_resp_final as v from county_week),
    g as (select 'all' as grp, v from r union all select case when home then 'home' else 'comparison' end, v from r union all select 'metro:' || metro, v from r)
    select grp, count(v) as n, round(avg(v), 6) as mean from g group by grp
    """)  # fmt: skip
def agg_overlapping_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One pass over rows that belong to several groups at once."""
    r = table(spark, sf_dir, "county_week").select("site_id", "metro", "home", "week_end", F.col("ed_resp_final").alias("v")).distinct()
    return stats.overlapping_groups(r, "metro", "home").groupBy("grp").agg(F.count("v").alias("n"), F.round(F.avg("v"), 6).alias("mean"))


@query("agg_global", "select count(*) as n, round(avg(l_quantity), 6) as mean, round(sqrt(avg(l_quantity * l_quantity)), 6) as rms, min(l_shipdate)::date as first_day, max(l_shipdate)::date as last_day from lineitem")
def agg_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scalar reductions of a whole table."""
    q = F.col("l_quantity")
    return table(spark, sf_dir, "lineitem").agg(F.count("*").alias("n"), F.round(F.avg(q), 6).alias("mean"), F.round(F.sqrt(F.avg(q * q)), 6).alias("rms"), F.min("l_shipdate").cast("date").alias("first_day"), F.max("l_shipdate").cast("date").alias("last_day"))


# Windows


@query("window_first_and_last", """
    select site_id, week_end, unit, max(v) filter (up = 1) as first_value, max(v) filter (down = 1) as last_value from (
        select site_id, week_end, unit, ed_resp_final as v, row_number() over (partition by site_id, week_end, unit order by as_of, arrival_id) as up,
               row_number() over (partition by site_id, week_end, unit order by as_of desc, arrival_id desc) as down
        from (select distinct arrival_id, site_id, week_end, unit, as_of, ed_resp_final from ed_arrivals)) group by all
    """)  # fmt: skip
def window_first_and_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first and the last record per key; as aggregates, so that no key is sorted."""
    r = table(spark, sf_dir, "ed_arrivals").select("arrival_id", "site_id", "week_end", "unit", "as_of", "ed_resp_final").distinct()
    order = F.struct("as_of", "arrival_id")
    return r.groupBy("site_id", "week_end", "unit").agg(F.min_by("ed_resp_final", order).alias("first_value"), F.max_by("ed_resp_final", order).alias("last_value"))


@query("window_lags", """
    with w as (select distinct site_id, week_end, ed_resp_final as v from county_week where ed_resp_final is not null)
    select site_id, week_end, round(ln(greatest(v, 0.05)) - case when lag(v) over (partition by site_id order by week_end) is not null then ln(greatest(lag(v) over (partition by site_id order by week_end), 0.05)) end, 6) as d1,
           lag(v, 2) over (partition by site_id order by week_end) as lag2, lag(v, 3) over (partition by site_id order by week_end) as lag3 from w
    """)  # fmt: skip
def window_lags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row offsets and the difference of logarithms."""
    w = table(spark, sf_dir, "county_week").select("site_id", "week_end", F.col("ed_resp_final").alias("v")).filter("v is not null").distinct()
    by = Window.partitionBy("site_id").orderBy("week_end")
    log = lambda c: F.ln(F.greatest(c, F.lit(0.05)))
    before = F.lag("v").over(by)
    return w.select("site_id", "week_end", F.round(log(F.col("v")) - F.when(before.isNotNull(), log(before)), 6).alias("d1"), F.lag("v", 2).over(by).alias("lag2"), F.lag("v", 3).over(by).alias("lag3"))


@query("window_group_counts", "select o_orderkey, count(*) over (partition by o_custkey) as of_customer, round(o_totalprice / sum(o_totalprice) over (partition by o_custkey), 6) as share from orders")
def window_group_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Group sizes and shares brought back to every row."""
    w = Window.partitionBy("o_custkey")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.count("*").over(w).alias("of_customer"), F.round(F.col("o_totalprice") / F.sum("o_totalprice").over(w), 6).alias("share"))


@query("window_running", """
    select c_nationkey, c_custkey, max(c_acctbal) over (partition by c_nationkey order by c_custkey rows between unbounded preceding and current row) as high,
           min(c_acctbal) over (partition by c_nationkey order by c_custkey rows between current row and unbounded following) as low_ahead from customer
    """)  # fmt: skip
def window_running(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cumulative maximum, and minimum of what is to come."""
    w = Window.partitionBy("c_nationkey").orderBy("c_custkey")
    return table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey", F.max("c_acctbal").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("high"), F.min("c_acctbal").over(w.rowsBetween(0, Window.unboundedFollowing)).alias("low_ahead"))


@query("window_average_rank", "select p_partkey, p_brand, rank() over (partition by p_brand order by p_size) + (count(*) over (partition by p_brand, p_size) - 1) / 2.0::double as avg_rank from part")
def window_average_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranks with ties averaged."""
    return stats.average_ranks(table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size"), ["p_brand"], "p_size", "avg_rank").select("p_partkey", "p_brand", "avg_rank")


@query("window_gap_fill", """
    with w as (select distinct site_id, week_end, ed_resp_final as v from county_week where ed_resp_final is not null),
    s as (select *, lead(week_end) over (partition by site_id order by week_end) as nw, lead(v) over (partition by site_id order by week_end) as nv from w),
    g as (select *, unnest(range(0, coalesce((nw - week_end) // 7, 1))) as k from s)
    select site_id, week_end + (7 * k)::integer as week, round(case when k = 0 then v else v + (nv - v) * k / ((nw - week_end) // 7) end, 6) as v from g
    """)  # fmt: skip
def window_gap_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A regular weekly grid with linear interpolation over gaps."""
    w = table(spark, sf_dir, "county_week").select("site_id", "week_end", F.col("ed_resp_final").alias("v")).filter("v is not null").distinct()
    by = Window.partitionBy("site_id").orderBy("week_end")
    s = w.withColumns({"nw": F.lead("week_end").over(by), "nv": F.lead("v").over(by)}).withColumn("n", F.coalesce((F.datediff("nw", "week_end") / 7).cast("int"), F.lit(1)))
    g = s.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    value = F.when(F.col("k") == 0, F.col("v")).otherwise(F.col("v") + (F.col("nv") - F.col("v")) * F.col("k") / F.col("n"))
    return g.select("site_id", F.date_add("week_end", F.col("k") * 7).alias("week"), F.round(value, 6).alias("v"))


@query("window_last_rows", """
    select site_id, round(avg(v) filter (rn <= 7), 6) as recent, round(avg(v) filter (rn > 7), 6) as before, count(*) as n from (
        select site_id, ed_resp as v, row_number() over (partition by site_id order by week_end desc, reading_id desc) as rn from (select distinct reading_id, site_id, week_end, ed_resp from ed_readings)
        where ed_resp between 0 and 100) group by site_id
    """)  # fmt: skip
def window_last_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last seven readings of a site against those before."""
    r = table(spark, sf_dir, "ed_readings").select("reading_id", "site_id", "week_end", "ed_resp").distinct().filter("ed_resp between 0 and 100")
    n = r.withColumn("rn", F.row_number().over(Window.partitionBy("site_id").orderBy(F.desc("week_end"), F.desc("reading_id"))))
    return r6(n.groupBy("site_id").agg(F.avg(F.when(F.col("rn") <= 7, F.col("ed_resp"))).alias("recent"), F.avg(F.when(F.col("rn") > 7, F.col("ed_resp"))).alias("before"), F.count("*").alias("n")), "recent", "before")


@query("window_steps_back", """
    with w as (select distinct site_id, week_end, ed_resp_final as v from county_week where ed_resp_final is not null), s as (
        select site_id, week_end, v, coalesce(lag(v, 3) over (partition by site_id order by week_end), first_value(v) over (partition by site_id order by week_end)) as base from w)
    select site_id, week_end, round(100 * (v / nullif(base, 0) - 1), 6) as pct from s
    """)  # fmt: skip
def window_steps_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change in percent against three rows back, or the first row where there are fewer."""
    w = table(spark, sf_dir, "county_week").select("site_id", "week_end", F.col("ed_resp_final").alias("v")).filter("v is not null").distinct()
    by = Window.partitionBy("site_id").orderBy("week_end")
    base = F.coalesce(F.lag("v", 3).over(by), F.first("v").over(by))
    return w.select("site_id", "week_end", F.round(100 * (F.col("v") / F.when(base != 0, base) - 1), 6).alias("pct"))


@query("window_islands", """
    with s as (select user_id, event_id, ts, event_type, case when event_type = lag(event_type) over (partition by user_id order by ts, event_id) then 0 else 1 end as starts from events),
    r as (select *, sum(starts) over (partition by user_id order by ts, event_id rows between unbounded preceding and current row) as run from s)
    select user_id, run::bigint as run, min(event_type) as event_type, count(*) as n from r group by user_id, run
    """)  # fmt: skip
def window_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of equal rows, numbered by a running sum of their starts."""
    by = Window.partitionBy("user_id").orderBy("ts", "event_id")
    s = table(spark, sf_dir, "events").withColumn("starts", F.when(F.col("event_type") == F.lag("event_type").over(by), 0).otherwise(1))
    return s.withColumn("run", F.sum("starts").over(by.rowsBetween(Window.unboundedPreceding, 0))).groupBy("user_id", "run").agg(F.min("event_type").alias("event_type"), F.count("*").alias("n"))


# Order and top rows


@query("top_rows", "select o_orderkey, o_totalprice, row_number() over (order by o_totalprice desc, o_orderkey) as place from orders order by o_totalprice desc, o_orderkey limit 25")
def top_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 25 dearest orders: the report is the feature."""
    top = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25)
    return top.withColumn("place", F.row_number().over(Window.orderBy(F.desc("o_totalprice"), "o_orderkey")))  # over 25 rows


@query("top_per_group", """
    select l_suppkey, l_orderkey, l_linenumber, l_extendedprice from (
        select *, row_number() over (partition by l_suppkey order by l_extendedprice desc, l_orderkey, l_linenumber) as rn from lineitem) where rn <= 3
    """)  # fmt: skip
def top_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three largest rows per group; Spark limits each partition's groups before the exchange."""
    w = Window.partitionBy("l_suppkey").orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber")
    return table(spark, sf_dir, "lineitem").withColumn("rn", F.row_number().over(w)).filter("rn <= 3").select("l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice")


@query("top_extreme_keys", "select n_regionkey, arg_max(n_name, n_nationkey) as last_nation, arg_min(n_name, n_nationkey) as first_nation from nation group by 1")
def top_extreme_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The row at a maximum and at a minimum."""
    return table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.max_by("n_name", "n_nationkey").alias("last_nation"), F.min_by("n_name", "n_nationkey").alias("first_nation"))


# Sets


@query("set_union_all", "select 'customer' as kind, c_nationkey as nation, count(*) as n from customer group by all union all select 'supplier', s_nationkey, count(*) from supplier group by all")
def set_union_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of two frames, aligned by name."""
    a = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count("*").alias("n")).withColumn("kind", F.lit("customer"))
    b = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("nation")).agg(F.count("*").alias("n")).withColumn("kind", F.lit("supplier"))
    return a.unionByName(b, allowMissingColumns=True).select("kind", "nation", "n")


@query("set_intersect", "select c_nationkey as k from customer where c_acctbal > 9000 intersect select s_nationkey from supplier")
def set_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys in both sets."""
    return table(spark, sf_dir, "customer").filter("c_acctbal > 9000").select(F.col("c_nationkey").alias("k")).intersect(table(spark, sf_dir, "supplier").select("s_nationkey"))


@query("set_except", "select p_partkey as k from part except select l_partkey from lineitem where l_quantity > 49")
def set_except(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of one set that are not in another."""
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k")).subtract(table(spark, sf_dir, "lineitem").filter("l_quantity > 49").select("l_partkey"))


@query("set_union_distinct", "select c_nationkey as k from customer union select s_nationkey from supplier")
def set_union_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of either set."""
    return table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")).union(table(spark, sf_dir, "supplier").select("s_nationkey")).distinct()


@query("set_distinct_on_subset", "select l_partkey, l_suppkey, min(l_orderkey) as l_orderkey from lineitem group by all")
def set_distinct_on_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per subset of columns, chosen by an order rather than by chance."""
    return table(spark, sf_dir, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.min("l_orderkey").alias("l_orderkey"))


@query("set_repeated_keys", "select site_id, week_end, as_of, count(*) as n from (select distinct * from county_week) group by all having count(*) > 1")
def set_repeated_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that are delivered more than once with different content."""
    return table(spark, sf_dir, "county_week").distinct().groupBy("site_id", "week_end", "as_of").agg(F.count("*").alias("n")).filter("n > 1")


@query("set_frame_difference", """
    select side, n::bigint as n from (select 'left' as side, (select count(*) from (select o_custkey from orders except all select c_custkey from customer)) as n
    union all select 'right', (select count(*) from (select c_custkey from customer except all select o_custkey from orders)))
    """)  # fmt: skip
def set_frame_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each frame that the other does not hold as often."""
    a, b = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k")), table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))
    return a.exceptAll(b).agg(F.lit("left").alias("side"), F.count("*").alias("n")).unionByName(b.exceptAll(a).agg(F.lit("right").alias("side"), F.count("*").alias("n")))


# Shapes


@query("shape_pivot", """
    select user_id, count(*) filter (event_type = 'view') as view, count(*) filter (event_type = 'click') as click, count(*) filter (event_type = 'purchase') as purchase from events group by user_id
    """)  # fmt: skip
def shape_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows to columns, with the columns named in advance."""
    kinds = ["view", "click", "purchase"]
    return table(spark, sf_dir, "events").groupBy("user_id").pivot("event_type", kinds).count().fillna(0, kinds)


@query("shape_unpivot", """
    select site_id, week_end, as_of, signal, round(value, 6) as value from (select distinct site_id, week_end, as_of, loaded_at, ed_covid as covid, ed_flu as flu, ed_rsv as rsv from county_week)
    unpivot (value for signal in (covid, flu, rsv))
    """)  # fmt: skip
def shape_unpivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A wide table to one row per signal, without blanks."""
    wide = table(spark, sf_dir, "county_week").select("site_id", "week_end", "as_of", "loaded_at", F.col("ed_covid").alias("covid"), F.col("ed_flu").alias("flu"), F.col("ed_rsv").alias("rsv")).distinct()
    long = wide.unpivot(["site_id", "week_end", "as_of"], ["covid", "flu", "rsv"], "signal", "value").filter("value is not null")
    return r6(long, "value")


@query("shape_explode_list", "select p_partkey, word, pos from (select p_partkey, unnest(string_split(p_name, ' ')) as word, unnest(range(0, len(string_split(p_name, ' '))))::int as pos from part)")
def shape_explode_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A list to rows with positions."""
    return table(spark, sf_dir, "part").select("p_partkey", F.posexplode(F.split("p_name", " ")).alias("pos", "word")).select("p_partkey", "word", "pos")


@query("shape_parallel_arrays", """
    select c_nationkey, k, v from (select c_nationkey, unnest(list_sort(list(c_custkey))) as k, unnest(list(c_acctbal order by c_custkey)) as v from customer group by c_nationkey)
    """)  # fmt: skip
def shape_parallel_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parallel arrays to rows."""
    pairs = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.array_sort(F.collect_list(F.struct("c_custkey", "c_acctbal"))).alias("p"))
    arrays = pairs.select("c_nationkey", F.col("p.c_custkey").alias("ks"), F.col("p.c_acctbal").alias("vs"))
    return arrays.select("c_nationkey", F.inline(F.arrays_zip("ks", "vs"))).withColumnsRenamed({"ks": "k", "vs": "v"})
