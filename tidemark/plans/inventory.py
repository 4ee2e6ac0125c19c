"""Place names, argument checks, feature builders, synthetic news and decisions on labelers as queries."""

from __future__ import annotations

import datetime as dt
from itertools import product

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import features, guards, models, places, sampling, stats
from tidemark.plans.analysis import _RATINGS, later_weeks, ratings
from tidemark.plans.point_in_time import examples
from tidemark.plans.registry import Registry
from tidemark.plans.relational import r6
from tidemark.session import durable
from tidemark.sources.tables import number, table

REGISTRY = Registry()
query = REGISTRY.query

# Places

_STATES = ", ".join(f"('{n}', '{c}')" for n, c in places.STATE_CODES.items())


_FOLDED = "trim(regexp_replace(regexp_replace(lower(n.said), '[.''’]', '', 'g'), '[^a-z0-9]+', ' ', 'g'))"


@query("place_state_code", f"""
    with m(name, code) as (values {_STATES}),
    n as (select n_nationkey, case n_nationkey % 4 when 0 then 'New ' || case n_nationkey % 3 when 0 then 'York' when 1 then 'Jersey' else 'Land' end when 1 then ' mo.' when 2 then 'SOUTH  Dakota' else n_name end as said from nation)
    select n.n_nationkey, coalesce(m.code, c.code) as code from n left join m on m.name = {_FOLDED} left join (select distinct code from m) c on c.code = upper({_FOLDED})
    """)  # fmt: skip
def place_state_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State codes of names in several spellings; names of no state give none."""
    k = F.col("n_nationkey")
    new = F.concat(F.lit("New "), F.when(k % 3 == 0, "York").when(k % 3 == 1, "Jersey").otherwise("Land"))
    said = F.when(k % 4 == 0, new).when(k % 4 == 1, " mo.").when(k % 4 == 2, "SOUTH  Dakota").otherwise(F.col("n_name"))
    return table(spark, sf_dir, "nation").select("n_nationkey", places.state_code(said).alias("code"))


_KEY = "replace(regexp_replace(regexp_replace(regexp_replace(trim(regexp_replace(regexp_replace(lower({0}), '[.''’]', '', 'g'), '[^a-z0-9]+', ' ', 'g')), '\\bsainte\\b', 'ste', 'g'), '\\bsaint\\b', 'st', 'g'), ' (city and borough|census area|municipality|municipio|borough|county|parish)$', ''), ' ', '')"
_INDEX = f"""
    with idx as (select state as st, {_KEY.format('county_name')} as key, min(fips) as fips, count(distinct fips) as n from counties group by all),
    names as (select fips as asked, state, case when fips::int % 3 = 0 then regexp_replace(county_name, ' (County|Parish)$', '') when fips::int % 3 = 1 then upper(county_name) else county_name || ' City' end as name from counties),
    tiers as (select asked, state, name, unnest([1, 2, 3]) as tier, unnest([{_KEY.format('name')}, case when {_KEY.format('name')} like '%city' then regexp_replace({_KEY.format('name')}, 'city$', '') end, {_KEY.format('name')} || 'city']) as key from names),
    hits as (select t.asked, arg_min(struct_pack(f := i.fips, n := i.n), t.tier) as b from tiers t join idx i on i.st = t.state and i.key = t.key group by t.asked)"""


@query("place_county_lookup", _INDEX + " select n.asked, case when b.n = 1 then b.f end as fips, case when b is null then 'unknown' when b.n > 1 then 'ambiguous' else 'found' end as lookup from names n left join hits h on h.asked = n.asked")
def place_county_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """County codes of names as people write them, with their state; the key with and without 'city' comes after the key itself."""
    c = table(spark, sf_dir, "counties")
    n = F.col("fips").cast("int")
    name = F.when(n % 3 == 0, F.regexp_replace("county_name", " (County|Parish)$", "")).when(n % 3 == 1, F.upper("county_name")).otherwise(F.concat("county_name", F.lit(" City")))
    asked = c.select(F.col("fips").alias("asked"), "state", name.alias("name"))
    return places.lookup_counties(asked, "state", "name", places.county_index(c, "fips", "state", "county_name", True), True).select("asked", "fips", "lookup")


_SERVED = f"""
    with idx as (select state as st, {_KEY.format('county_name')} as key, min(fips) as fips, count(distinct fips) as n from counties group by all),
    firsts as (select metro, min(county_name) as other from counties group by metro),
    sites as (select s.site_id as site, c.state, c.county_name || ', ' || f.other || ',, Nowhere in Particular' as served from (select site_id, max(fips) as fips from county_week group by site_id) s join counties c on c.fips = s.fips join firsts f on f.metro <> c.metro),
    parts as (select distinct site, state, trim(p) as name, pos - 1 as position from (select site, state, unnest(string_split(served, ',')) as p, unnest(range(1, len(string_split(served, ',')) + 1)) as pos from sites) where trim(p) <> ''),
    own as (select p.*, i.fips as own_fips from parts p left join idx i on i.st = p.state and i.key = {_KEY.format('p.name')} and i.n = 1),
    alone as (select key, min(fips) as fips from idx group by key having count(*) = 1 and max(n) = 1),
    mapped as (select o.site, o.position, o.name, coalesce(own_fips, a.fips) as fips, case when own_fips is not null then 'own' when a.fips is not null then 'elsewhere' else 'unmapped' end as how from own o left join alone a on a.key = {_KEY.format('o.name')}),
    first_of as (select site, fips, min(position) as position from mapped where fips is not null group by all)
    select site, fips, how, count(*) as names from (select m.* from mapped m join first_of f on m.site = f.site and m.fips = f.fips and m.position = f.position union all select * from mapped where fips is null) group by all"""


@query("place_served_counties", _SERVED)
def place_served_counties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counties of lists of county names: found in the site's state, in one other state only, or not at all."""
    c = table(spark, sf_dir, "counties")
    firsts = c.groupBy(F.col("metro").alias("_m")).agg(F.min("county_name").alias("other"))
    sites = table(spark, sf_dir, "county_week").groupBy(F.col("site_id").alias("site")).agg(F.max("fips").alias("fips")).join(c, "fips")
    lists = sites.join(F.broadcast(firsts), F.col("metro") != F.col("_m")).select("site", "state", F.concat("county_name", F.lit(", "), "other", F.lit(",, Nowhere in Particular")).alias("served"))  # a row per metro
    found = places.served_counties(lists, "site", "state", "served", places.county_index(c, "fips", "state", "county_name", True), True)
    return found.groupBy("site", "fips", "how").agg(F.count("*").alias("names"))


@query("place_hint", """
    select doc_id, case when a > 0 and b = 0 then 'county' when b > 0 and a = 0 then 'city' else '' end as hint from (
        select doc_id, len(regexp_extract_all(lower(coalesce(text, '')), '[a-z]+ county')) as a, len(regexp_extract_all(lower(coalesce(text, '')), 'city of [a-z]+|[a-z]+ city')) as b from documents)
    """)  # fmt: skip
def place_hint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a text names a county only, or a city only."""
    return table(spark, sf_dir, "documents").select("doc_id", places.one_of_two("text", "[a-z]+ county", "city of [a-z]+|[a-z]+ city", ("county", "city")).alias("hint"))


@query("place_region_label", """
    select metro, arg_max(county_name, struct_pack(p := population, c := county_name)) || case count(*) when 1 then '' when 2 then ' and 1 nearby county' else ' and ' || (count(*) - 1)::varchar || ' nearby counties' end as label from counties group by metro
    """)  # fmt: skip
def place_region_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A region by its largest county and how many others it has."""
    return places.region_label(table(spark, sf_dir, "counties"), "metro", "county_name", "population")


@query("place_contiguous", "select left(fips, 2) not in ('02', '15', '60', '66', '69', '72', '78') as contiguous, count(*) as n from counties group by 1")
def place_contiguous(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counties inside and outside the contiguous states."""
    return table(spark, sf_dir, "counties").groupBy(places.contiguous("fips").alias("contiguous")).agg(F.count("*").alias("n"))


@query("place_rounded_rings", "select fips, [[round(lon, 1), round(lat, 1)], [round(lon + 0.25, 1), round(lat + 0.25, 1)]]::varchar as ring from counties")
def place_rounded_rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coordinates of rings with fewer digits."""
    ring = F.array(F.array("lon", "lat"), F.array(F.col("lon") + 0.25, F.col("lat") + 0.25))
    rounded = places.rounded_ring(ring, 1)
    return table(spark, sf_dir, "counties").select("fips", F.concat(F.lit("["), F.array_join(F.transform(rounded, lambda p: F.concat(F.lit("["), F.array_join(F.transform(p, lambda x: x.cast("string")), ", "), F.lit("]"))), ", "), F.lit("]")).alias("ring"))


# Arguments


@query("guard_epiweek", """
    select o_orderkey, regexp_full_match(trim(said), '[0-9]{6}') and coalesce(try_cast(substr(trim(said), 5, 2) as int) between 1 and 53, false) as ok
    from (select o_orderkey, case when o_orderkey % 3 = 0 then strftime(o_orderdate, '%Y%m%d') when o_orderkey % 3 = 1 then ' ' || (year(o_orderdate) * 100 + o_orderkey % 60)::varchar else strftime(o_orderdate, '%Y-%m') end as said from orders)
    """)  # fmt: skip
def guard_epiweek(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which arguments are epidemiological weeks; calendar dates are not."""
    k, d = F.col("o_orderkey"), F.col("o_orderdate")
    said = F.when(k % 3 == 0, F.date_format(d, "yyyyMMdd")).when(k % 3 == 1, F.concat(F.lit(" "), (F.year(d) * 100 + k % 60).cast("string"))).otherwise(F.date_format(d, "yyyy-MM"))
    return table(spark, sf_dir, "orders").select("o_orderkey", guards.is_epiweek(said).alias("ok"))


@query("guard_as_of", """
    select finding_id, case when trim(coalesce(known_by, '')) = '' then null when d is null then 'no date' when d > date '2025-12-31' then 'future' when d < date '2025-11-01' then 'before the archive' end as problem
    from (select distinct finding_id, known_by, try_cast(left(trim(known_by), 10) as date) as d from findings)
    """)  # fmt: skip
def guard_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with dates that are asked for: none, to come, or before the archive begins."""
    f = table(spark, sf_dir, "findings").select("finding_id", "known_by").distinct()
    return f.select("finding_id", guards.as_of_problem("known_by", dt.date(2025, 11, 1), dt.date(2025, 12, 31)).alias("problem"))


# Weekly features of every origin date

_DAILY = """
    with r as (select distinct reading_id, site_id, week_end::date as day, case when not isnan(ed_resp) then ed_resp end as v from ed_readings where site_id is not null and week_end is not null),
    station as (select c.fips, min(w.site_id) as station from counties c join county_week w on w.fips = c.fips group by c.fips),
    asked as (select distinct as_of from origins where as_of is not null),
    wk as (select site_id as station, day, (day + ((6 - dayofweek(day)) % 7)::integer)::date as week_end, v from r)"""


@query("feature_station_weeks", _DAILY + """
    select s.fips, a.as_of, w.week_end, round(avg(v), 6) as mean, round(max(v), 6) as highest, round(sum(v), 6) as total, count(v) as n_days
    from asked a join wk w on w.day <= a.as_of - 7 and w.week_end > a.as_of - 35 join station s on s.station = w.station group by all
    """)  # fmt: skip
def feature_station_weeks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly means, extremes and sums of a station's days for each county that it serves, as visible on every origin date a week later."""
    daily = table(spark, sf_dir, "ed_readings").filter("site_id is not null and week_end is not null").select("reading_id", F.col("site_id").alias("station"), F.col("week_end").cast("date").alias("day"), number("ed_resp").alias("v")).distinct()
    stations = table(spark, sf_dir, "counties").select("fips").join(table(spark, sf_dir, "county_week").select("fips", "site_id"), "fips").groupBy("fips").agg(F.min("site_id").alias("station"))
    dates = sorted(r[0] for r in table(spark, sf_dir, "origins").select("as_of").filter("as_of is not null").distinct().toLocalIterator())  # a calendar
    out = features.station_weeks(daily, stations, "station", "fips", "day", dates, {"mean": F.avg("v"), "highest": F.max("v"), "total": F.sum("v"), "n_days": F.count("v")}, lag_days=7, history_days=35)
    return r6(out, "mean", "highest", "total")


@query("feature_site_levels", """
    with last_row as (select site_id, week_end, as_of, arg_max(struct_pack(v := ww_flu), loaded_at).v as v from county_week group by all),
    named as (select l.site_id, l.week_end, l.as_of, l.v, unnest([c.fips, d.fips]) as fips, c.population * 1.0::double / 10 as w from last_row l join (select site_id, max(fips) as fips from county_week group by site_id) s on s.site_id = l.site_id
              join counties c on c.fips = s.fips join (select metro, min(fips) as fips from counties group by metro) d on d.metro = c.metro),
    one as (select distinct * from named where v is not null)
    select fips, as_of, week_end, round(case when sum(w) > 0 then sum(w * least(v, 10)) / sum(w) else avg(least(v, 10)) end, 6) as level, count(distinct site_id) as sites from one group by all
    """)  # fmt: skip
def feature_site_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Levels of sites that serve their own county and the first of their metro: capped, weighted by population, counted in full in each."""
    w, c = table(spark, sf_dir, "county_week"), table(spark, sf_dir, "counties")
    rows = w.groupBy("site_id", "week_end", "as_of").agg(F.max_by(F.struct("ww_flu"), "loaded_at").alias("t")).select("site_id", "week_end", "as_of", F.col("t.ww_flu").alias("v"))
    first = c.groupBy(F.col("metro").alias("_m")).agg(F.min("fips").alias("_first"))
    served = w.groupBy("site_id").agg(F.max("fips").alias("own")).join(c, F.col("own") == F.col("fips")).join(first, F.col("metro") == F.col("_m"))
    served = served.select("site_id", F.explode(F.array_distinct(F.array("own", "_first"))).alias("fips"), (F.col("population") / 10).alias("population"))
    return r6(features.site_levels(rows.join(served, "site_id"), "site_id", "fips", ["as_of", "week_end"], "v", "population", cap=10.0), "level")


# Synthetic news, and what it takes to see its worth

_PLACED = """
    with w as (select site_id as geo, week_end as time, max(ed_resp_final) as v, max(news_n) as news_n from county_week where ed_resp_final is not null group by all),
    r as (select *, case when v > 0 then ln(v) end - lag(case when v > 0 then ln(v) end) over (partition by geo order by time) as rise from w),
    a as (select *, sum((coalesce(news_n, 0) > 0)::int) over g as reals, count(*) over g as weeks, count(rise) over g as rises from r window g as (partition by geo)),
    k as (select *, least(greatest(round(reals * 1.5::double)::bigint, 1), weeks) as k from a), h as (select *, least(round(k * 0.6::double)::bigint, rises) as hits, case when rise is not null then row_number() over (partition by geo order by rise desc nulls last, time) end as rk from k),
    p as (select *, coalesce(rk <= greatest(hits, ceil(rises * 0.1::double)), false) as pool from h),
    d as (select *, pool and row_number() over (partition by geo, pool order by md5(geo::varchar || '|' || time::varchar || '|11')) <= hits as hit from p),
    o as (select *, row_number() over (partition by geo, hit order by md5(geo::varchar || '|' || time::varchar || '|12')) as other from d)
    select geo, time, case when hit then 'rise' when other <= k - hits then 'other' end as placed from o"""


def news_weeks(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "county_week").filter("ed_resp_final is not null")
    return t.groupBy(F.col("site_id").alias("geo"), F.col("week_end").alias("time")).agg(F.max("ed_resp_final").alias("v"), F.max("news_n").alias("news_n"))


@query("news_placed", _PLACED)
def news_placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where synthetic news goes: half as much again as there is, three fifths of it on a site's greatest rises."""
    return sampling.place_synthetic(news_weeks(spark, sf_dir), "geo", "time", "v", "news_n", 0.6, 1.5, 11).select("geo", "time", "placed")


@query("power_table")
def power_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often the worth of synthetic news is seen, by how much there is and how well it is placed: gains of a ridge with news over one without, on later weeks, five runs each."""
    settings = [(i, scale, precision) for i, (scale, precision, _) in enumerate(product((1.0, 3.0), (0.0, 0.5, 1.0), range(5)))]
    runs = F.array(*[F.struct(F.lit(i).alias("run"), F.lit(s).alias("scale"), F.lit(p).alias("precision"), F.lit(100 + 2 * i).alias("seed")) for i, s, p in settings])
    asked = news_weeks(spark, sf_dir).withColumn("r", F.explode(runs)).select("geo", "time", "v", "news_n", "r.*")
    placed = sampling.place_synthetic(asked, "geo", "time", "v", "news_n", F.col("precision"), F.col("scale"), F.col("seed"), "run")
    e = examples(spark, sf_dir)
    e = e.withColumn("late", later_weeks(e)).join(placed.select("geo", "time", "run", F.col("placed").isNotNull().cast("double").alias("news")), ["geo", "time"])
    each = durable(e.select("geo", "time", "late", "y", "level", "d1", "d2", "last", "final", "run", "news"))
    scored = each.filter("late")
    for name, names in (("plain", ["level", "d1", "d2"]), ("with_news", ["level", "d1", "d2", "news"])):
        fits = models.ridge_fit(each.filter("not late"), ["run"], names, "y")
        scored = models.grouped_predict(scored, fits, ["run"], names).withColumn(name, F.abs(F.col("last") * F.exp("pred") - F.col("final"))).drop("pred")
    tests = stats.wilcoxon(scored, ["run"], "with_news", "plain").select("run", "p")
    gains = scored.groupBy("run").agg((F.avg("plain") - F.avg("with_news")).alias("gain"))
    plan = spark.createDataFrame(settings, "run int, scale double, precision double")
    per = gains.join(tests, "run").join(F.broadcast(plan), "run")  # a row per run
    found = (F.col("gain") > 0) & (F.col("p") < 0.05)
    return per.groupBy("scale", "precision").agg(F.count("*").alias("runs"), F.round(F.avg("gain"), 6).alias("mean_gain"), F.round(F.median("gain"), 6).alias("median_gain"), F.round(F.median("p"), 4).alias("median_p"), F.round(F.avg(found.cast("int")), 4).alias("detected"))


# Labelers against each other


@query("label_decision", _RATINGS + """
    , j as (select labeler, coalesce(ra, '-') as a, coalesce(rb, '-') as b, count(*) as n from ratings group by all),
    k as (select t.labeler, t.n, 1 - (o / t.n::double) / nullif(1 - coalesce(s, 0) / (t.n * t.n)::double, 0) as kappa, 1 - o / t.n::double as same
          from (select labeler, sum(n) as n, coalesce(sum(n) filter (a <> b), 0) as o from j group by labeler) t left join (
          select x.labeler, sum(x.n * y.n) as s from (select labeler, a, sum(n) as n from j group by all) x join (select labeler, b, sum(n) as n from j group by all) y on x.labeler = y.labeler and x.a = y.b group by x.labeler) e on t.labeler = e.labeler),
    ref as (select sum(kappa * n) / sum(n) as kappa, sum(same * n) / sum(n) as same from k where labeler <> 'adjudicated')
    select k.labeler, round(k.kappa, 6) as kappa, round(ref.kappa, 6) as usual, case when k.kappa is null or ref.kappa is null then case when k.same < ref.same then 'below the usual agreement' else 'acceptable by agreement' end
           when k.kappa < ref.kappa then 'below the usual kappa' else 'acceptable' end as decision from k, ref
    """)  # fmt: skip
def label_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a labeler's kappa reaches the usual one of all labelers; where kappa is undefined, agreement decides."""
    k = durable(stats.grouped_kappa(ratings(spark, sf_dir), ["labeler"], "ra", "rb", "n"))
    own = k.filter("labeler <> 'adjudicated'")
    ref = own.agg((F.sum(F.col("kappa") * F.col("n")) / F.sum("n")).alias("kappa"), (F.sum((1 - F.col("observed")) * F.col("n")) / F.sum("n")).alias("same")).first()  # one row
    usual, same = (F.lit(ref[c]).cast("double") for c in ("kappa", "same"))
    by_agreement = F.when(1 - F.col("observed") < same, "below the usual agreement").otherwise("acceptable by agreement")
    decision = F.when(F.col("kappa").isNull() | usual.isNull(), by_agreement).when(F.col("kappa") < usual, "below the usual kappa").otherwise("acceptable")
    return k.select("labeler", F.round("kappa", 6).alias("kappa"), F.round(usual, 6).alias("usual"), decision.alias("decision"))
