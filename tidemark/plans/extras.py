"""Pages, model answers, shared sites, ablations, placebo and power as queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import pages, text
from tidemark.operators import grounding, models, sampling
from tidemark.plans.analysis import later_weeks
from tidemark.plans.point_in_time import _WEEKLY, examples, weekly
from tidemark.plans.registry import Registry
from tidemark.plans.relational import r6
from tidemark.plans.text_calendar import _TIERS, quoted
from tidemark.sources.tables import table

REGISTRY = Registry()
query = REGISTRY.query


@query("page_published")
def page_published(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Publication days from a page per article that carries what the catalog has, as structured data or as a meta tag; none where that is no ISO time."""
    a = table(spark, sf_dir, "articles").select("article_id", F.coalesce(F.trim("published"), F.lit("")).alias("p")).distinct()
    linked = F.concat(F.lit('<script type="application/ld+json">{"@graph":[{"datePublished": "'), "p", F.lit('"}]}</script>'))
    tag = F.concat(F.lit('<meta name="pubdate" content="'), "p", F.lit('">'))
    page = F.when(F.crc32(F.col("article_id").cast("binary")) % 2 == 0, linked).otherwise(tag)
    return a.select("article_id", pages.published(page).alias("x")).select("article_id", "x.day", "x.source")


@query("label_json", """
    select label_id, case when lower(trim(relevant)) in ('y', 'yes', 'true', '1', 't') then 'y' when lower(trim(relevant)) in ('n', 'no', 'false', '0', 'f') then 'n' end as relevant,
           nullif(regexp_extract(trim(concern), '^[+]?0*([0-3])([.]0*)?$', 1), '') as concern, case when label_id % 10 = 0 then 'not a JSON object' end as error
    from (select distinct label_id, case when label_id % 10 <> 0 then relevant end as relevant, case when label_id % 10 <> 0 then concern end as concern from human_labels)
    """)  # fmt: skip
def label_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels read from JSON answers; every tenth answer is none."""
    h = table(spark, sf_dir, "human_labels").select("label_id", "relevant", "illness", "concern").distinct()
    answer = F.when(F.col("label_id") % 10 == 0, F.lit("I cannot say.")).otherwise(F.to_json(F.struct("relevant", "illness", "concern")))
    return h.select("label_id", pages.json_label(answer).alias("x")).select("label_id", "x.relevant", "x.concern", "x.error").distinct()


@query("label_prompt_hash", "select labeler, substr(sha256('{\"labeler\":\"' || labeler || '\"}'), 1, 16) as hash, count(*) as n from (select distinct * from human_labels) group by all")
def label_prompt_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixteen digits that name a configuration."""
    h = table(spark, sf_dir, "human_labels").distinct()
    return h.groupBy("labeler", F.substring(F.sha2(F.to_json(F.struct("labeler")), 256), 1, 16).alias("hash")).agg(F.count("*").alias("n"))


@query("quote_summary", _TIERS.replace("select label_id, doc_id, case when told", "select method, count(*) as n from (select label_id, doc_id, case when told") + ") group by method")
def quote_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many quotes each tier settles."""
    return grounding.match_quotes(quoted(spark, sf_dir), "quote", "text", fuzzy=False).groupBy("method").agg(F.count("*").alias("n"))


@query("quote_names_place", """
    with c as (select fips, lower(regexp_replace(county_name, ' (County|Parish|city)$', '')) as name from counties), f as (select distinct article_id, title from articles where title is not null)
    select distinct f.article_id, c.fips from f join c on contains(' ' || trim(regexp_replace(lower(f.title), '[^a-z]+', ' ', 'g')) || ' ', ' ' || c.name || ' ')
    """)  # fmt: skip
def quote_names_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counties that a title names, by whole words: runs of words look counties up, so titles and counties are never paired."""
    c = table(spark, sf_dir, "counties").select("fips", F.lower(F.regexp_replace("county_name", " (County|Parish|city)$", "")).alias("name"))
    most = c.agg(F.max(F.size(F.split("name", " ")))).first()[0] or 1  # one number
    words = F.split(F.trim(F.regexp_replace(F.lower("title"), "[^a-z]+", " ")), " ")
    runs = F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), F.lit(most)), lambda n: F.transform(F.sequence(F.lit(1), F.size(words)), lambda i: F.array_join(F.slice(words, i, n), " ")))))
    t = table(spark, sf_dir, "articles").filter("title is not null").select("article_id", "title").distinct().select("article_id", F.explode(runs).alias("name"))
    return t.join(c, "name").select("article_id", "fips").distinct()


@query("text_fold", "select n_nationkey, trim(regexp_replace(regexp_replace(lower(n_name || ' Ste. O''Côté'), '[.'']', '', 'g'), '[^a-z0-9ôé]+', ' ', 'g')).replace('ô', 'o').replace('é', 'e') as folded from nation")
def text_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names without case, accents and signs."""
    return table(spark, sf_dir, "nation").select("n_nationkey", text.fold(F.concat("n_name", F.lit(" Ste. O'Côté"))).alias("folded"))


# Variants of a model, all in one plan

VARIANTS = {"full": ["level", "d1", "d2", "sin1", "cos1"], "no_season": ["level", "d1", "d2"], "no_momentum": ["level", "sin1", "cos1"]}


def design(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.functions.calendar import harmonics

    h = harmonics("time", 1)
    sites = table(spark, sf_dir, "county_week").groupBy(F.col("site_id").alias("geo")).agg(F.max("metro").alias("metro"))
    return examples(spark, sf_dir).withColumns({"sin1": h["sin1"], "cos1": h["cos1"]}).join(sites, "geo")


@query("model_ablation")
def model_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The error of the model without a group of features: a dropped feature is a constant, so all variants are one fit per group."""
    every = VARIANTS["full"]
    d = design(spark, sf_dir)
    rows = F.array(*[F.struct(F.lit(v).alias("variant"), *[(F.col(f) if f in kept else F.lit(0.0)).alias(f) for f in every]) for v, kept in VARIANTS.items()])
    long = d.select("geo", "time", "y", "last", "final", F.explode(rows).alias("r")).select("geo", "time", "y", "last", "final", "r.*")
    early = long.filter("time < date '2025-12-20'")
    scored = models.grouped_predict(long.filter("time >= date '2025-12-20'"), models.ridge_fit(early, ["variant"], every, "y"), ["variant"], every)
    value = F.col("last") * F.exp("pred")
    return scored.groupBy("variant").agg(F.count("*").alias("n"), F.round(F.avg(F.abs(value - F.col("final"))), 6).alias("mae"), F.round(F.avg(F.abs(F.col("last") - F.col("final"))), 6).alias("naive_mae"))


@query("model_leave_one_out")
def model_leave_one_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each metro predicted by a model that has not seen it: sums of products of all less its own."""
    d = design(spark, sf_dir)
    sums = models.ridge_sums(d.filter("metro is not null"), ["metro"], VARIANTS["full"], "y")
    fits = models.ridge_solve(models.other_sums(sums, "metro"), ["metro"], VARIANTS["full"]).withColumnRenamed("metro", "holdout")
    scored = models.grouped_predict(d.withColumn("holdout", F.col("metro")), fits, ["holdout"], VARIANTS["full"])
    value = F.col("last") * F.exp("pred")
    return scored.groupBy("holdout").agg(F.count("*").alias("n"), F.round(F.avg(F.abs(value - F.col("final"))), 6).alias("mae"), F.round(F.avg(F.abs(F.col("last") - F.col("final"))), 6).alias("naive_mae"))


@query("model_placebo")
def model_placebo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Is momentum worth its error on later weeks? Its gain against gains with momentum shuffled within sites: p = (1 + as good) / (runs + 1).

    Rows carry the shuffled values of all runs, so the table is read once.
    """
    runs = 9
    d = design(spark, sf_dir).select("geo", "time", "y", "level", "d1")
    d = d.withColumn("late", later_weeks(d))
    values = sampling.shuffles_within(d, "geo", "time", "d1", list(range(1, runs + 1)))
    each = values.select("late", "y", "level", F.posexplode("values").alias("run", "d1"))
    fits = models.ridge_fit(each.filter("not late"), ["run"], ["level", "d1"], "y")
    scored = models.grouped_predict(each.filter("late"), fits, ["run"], ["level", "d1"]).groupBy("run").agg(F.avg(F.abs(F.col("pred") - F.col("y"))).alias("e"))
    first = F.max(F.when(F.col("run") == 0, F.col("e")))
    one = scored.agg(first.alias("real"), F.collect_list(F.when(F.col("run") > 0, F.col("e"))).alias("fakes"))  # a handful of runs
    better = F.size(F.filter("fakes", lambda x: x <= F.col("real")))
    return one.select(F.round("real", 6).alias("real_error"), F.lit(runs).alias("runs"), ((1 + better) / F.lit(runs + 1)).alias("p"))


@query("model_season_only", _WEEKLY + """
    , m as (select w.*, ln(greatest(v, 0.05)) as y, cos(2 * pi() / 365.25 * dayofyear(time)) as c, geo % 4 as grp from w), s as (select grp, count(*)::double as n, avg(c) as mc, avg(y) as my, sum(c * c) as cc, sum(c * y) as cy from m group by grp),
    b as (select *, (cy - n * mc * my) / (cc - n * mc * mc) as slope from s)
    select grp, n::bigint as n, round(my - slope * mc, 4) as intercept, round(slope, 4) as slope from b
    """)  # fmt: skip
def model_season_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model without any official value: the season alone, unpenalised, for groups of sites."""
    from tidemark.functions.calendar import harmonics

    m = weekly(spark, sf_dir).select((F.col("geo") % 4).alias("grp"), F.ln(F.greatest("v", F.lit(0.05))).alias("y"), harmonics("time", 1)["cos1"].alias("c"))
    fit = models.ridge_fit(m, ["grp"], ["c"], "y", free=("c",))
    return fit.select("grp", "n", F.round(F.element_at("beta", 1), 4).alias("intercept"), F.round(F.element_at("beta", 2), 4).alias("slope"))


@query("small_groups", "select metro, category, count(*) as n, round(avg(label), 6) as mean from (select distinct f.finding_id, f.category, f.label, w.metro from findings f join (select site_id, max(metro) as metro from county_week group by site_id) w on w.site_id = f.site_id) group by all having count(*) >= 30")
def small_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of findings that are large enough to report."""
    sites = table(spark, sf_dir, "county_week").groupBy("site_id").agg(F.max("metro").alias("metro"))
    f = table(spark, sf_dir, "findings").select("finding_id", "site_id", "category", "label").distinct().join(sites, "site_id").select("finding_id", "category", "label", "metro").distinct()
    return r6(f.groupBy("metro", "category").agg(F.count("*").alias("n"), F.avg("label").alias("mean")).filter("n >= 30"), "mean")


@query("feature_availability", """
    select signal, n::bigint as n from (select count(ed_covid) as ed_covid, count(ed_flu) as ed_flu, count(temp_mean_f) as temp_mean_f, count(ww_flu) as ww_flu, count(news_concern) as news_concern from county_week)
    unpivot (n for signal in (ed_covid, ed_flu, temp_mean_f, ww_flu, news_concern))
    """)  # fmt: skip
def feature_availability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many values each feature has: which models can be fitted at all."""
    names = ["ed_covid", "ed_flu", "temp_mean_f", "ww_flu", "news_concern"]
    return table(spark, sf_dir, "county_week").agg(*[F.count(c).alias(c) for c in names]).unpivot([], names, "signal", "n")


@query("top_per_site_group", """
    with w as (select distinct site_id, fips, ed_resp_final as v, week_end from county_week where ed_resp_final is not null), m as (select site_id, max(fips) as fips, avg(v) as v from w group by site_id)
    select fips, site_id, round(v, 6) as v, n as members from (select *, count(*) over (partition by fips) as n, row_number() over (partition by fips order by v desc, site_id) as rn from m) where rn = 1
    """)  # fmt: skip
def top_per_site_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The site with the highest mean in each county, with how many sites the county has."""
    w = table(spark, sf_dir, "county_week").select("site_id", "fips", F.col("ed_resp_final").alias("v"), "week_end").filter("v is not null").distinct()
    m = w.groupBy("site_id").agg(F.max("fips").alias("fips"), F.avg("v").alias("v"))
    by = Window.partitionBy("fips")
    out = m.withColumns({"members": F.count("*").over(by), "rn": F.row_number().over(by.orderBy(F.desc("v"), "site_id"))}).filter("rn = 1")
    return r6(out.select("fips", "site_id", "v", "members"), "v")


@query("spatial_change_bins", _WEEKLY + """
    , d as (select a.geo, a.time, a.v - b.v as change from w a join w b on b.geo = a.geo and b.time = a.time - 7), q as (select quantile_cont(abs(change), 0.9) / 2 as x from d),
    n as (select greatest(arg_min(m * pow(10.0::double, floor(log10(x))), abs(ln(m * pow(10.0::double, floor(log10(x)))) - ln(x))), 0.1) as a from q, (select unnest([1.0, 2.0, 2.5, 5.0, 10.0])::double as m) t),
    k as (select a, least(greatest(arg_min(m * pow(10.0::double, floor(log10(a / 4))), abs(ln(m * pow(10.0::double, floor(log10(a / 4)))) - ln(a / 4))), 0.1), a / 2) as b from n, (select unnest([1.0, 2.0, 2.5, 5.0, 10.0])::double as m) t group by a)
    select case when change <= -2 * a then -3 when change <= -a then -2 when change <= -b then -1 when change <= b then 0 when change <= a then 1 when change <= 2 * a then 2 else 3 end::int as bin, count(*) as n from d, k group by 1
    """)  # fmt: skip
def spatial_change_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly changes on a symmetric scale whose breaks follow from their spread."""
    from tidemark.operators import spatial

    w = weekly(spark, sf_dir)
    before = w.select("geo", F.date_add("time", 7).alias("time"), F.col("v").alias("b"))
    d = w.join(before, ["geo", "time"]).select((F.col("v") - F.col("b")).alias("change"))
    inner, outer = spatial.change_breaks(d, "change")
    return d.groupBy(spatial.change_bin("change", inner, outer).alias("bin")).agg(F.count("*").alias("n"))


@query("model_boosted_local")
def model_boosted_local(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boosted trees on all sites' history, then a ridge per metro on what they leave."""
    features = ["level", "d1", "d2"]
    d = models.assembled(design(spark, sf_dir), features)
    early = F.col("time") < F.lit("2025-12-20").cast("date")
    base = models.tree_model("boosted", "y").fit(d.filter(early)).transform(d).withColumn("left", F.col("y") - F.col("prediction")).drop("_features")
    fits = models.ridge_fit(base.filter(early), ["metro"], ["d1", "cos1"], "left")
    scored = models.grouped_predict(base.filter(~early), fits, ["metro"], ["d1", "cos1"])
    error = lambda p: F.round(F.avg(F.abs(F.col("last") * F.exp(p) - F.col("final"))), 4)
    return scored.agg(F.count("*").alias("n"), error(F.col("prediction")).alias("base_mae"), error(F.col("prediction") + F.col("pred")).alias("local_mae"))
