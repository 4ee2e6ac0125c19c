"""Label statistics, duplicates, clusters, models and samples as queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import labels
from tidemark.functions.calendar import harmonics
from tidemark.operators import dedupe, models, sampling, spatial, stats, votes
from tidemark.plans.point_in_time import _EXAMPLES, examples, weekly
from tidemark.plans.registry import Registry
from tidemark.plans.relational import r6
from tidemark.session import durable
from tidemark.sources.tables import table

REGISTRY = Registry()
query = REGISTRY.query


def label_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """item, annotator, relevant, illness, concern: each labeler's latest valid answers per article."""
    answers = {"relevant": labels.relevant_answer("relevant"), "illness": labels.illness_answer("illness"), "concern": labels.concern_answer("concern")}
    practice = F.trim("is_example").isin("1", "1.0")
    return votes.latest_votes(table(spark, sf_dir, "human_labels"), "article_id", "labeler", "labeled_at", "label_id", practice, answers)


_VOTES = """
    with picked as (
        select distinct article_id, trim(labeler) as labeler, labeled_at, label_id, lower(trim(relevant)) as r, trim(concern) as c from human_labels
        where coalesce(trim(is_example), '') not in ('1', '1.0') and article_id is not null and labeler is not null and trim(labeler) <> ''
    ), last_row as (select * from (select *, row_number() over (partition by article_id, labeler order by labeled_at desc nulls last, label_id desc) as rn from picked) where rn = 1),
    votes as (select article_id, labeler, case when r in ('y', 'yes', 'true', '1', 't') then 'y' when r in ('n', 'no', 'false', '0', 'f') then 'n' end as rel,
              try_cast(nullif(regexp_extract(c, '^[+]?0*([0-3])([.]0*)?$', 1), '') as int) as con from last_row)"""


@query("label_unanimous", _VOTES + """
    select article_id, coalesce(max(rel) filter (labeler = 'adjudicated'), case when min(rel) filter (labeler <> 'adjudicated') = max(rel) filter (labeler <> 'adjudicated') and count(rel) filter (labeler <> 'adjudicated') = count(*) filter (labeler <> 'adjudicated')
           then max(rel) filter (labeler <> 'adjudicated') end) as relevant from votes group by article_id
    """)  # fmt: skip
def label_unanimous(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The adjudicated answer, else the one all labelers gave, else null."""
    own = F.col("annotator") != "adjudicated"
    r = F.when(own, F.col("relevant"))
    agreed = F.when((F.min(r) == F.max(r)) & (F.count(r) == F.count_if(own)), F.max(r))
    return label_votes(spark, sf_dir).groupBy(F.col("item").alias("article_id")).agg(F.coalesce(F.max(F.when(~own, F.col("relevant"))), agreed).alias("relevant"))


@query("label_progress", _VOTES + " select labeler, count(*) as articles, count(rel) as answered, count(*) filter (article_id in (select article_id from votes where labeler = 'adjudicated')) as settled from votes group by labeler")
def label_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many articles each labeler has done, and how many of these are settled."""
    v = label_votes(spark, sf_dir)
    settled = v.filter("annotator = 'adjudicated'").select("item", F.lit(1).alias("s"))
    return v.join(settled, "item", "left").groupBy(F.col("annotator").alias("labeler")).agg(F.count("*").alias("articles"), F.count("relevant").alias("answered"), F.count("s").alias("settled"))


# Every labeler against all others of the same articles: a rating is one vote and one other vote on its article. Votes
# are counted per article and answer first, so labelers are never paired.

_RATINGS = _VOTES + """
    , ratings as (select a.labeler, a.article_id, a.rel as ra, b.rel as rb, a.con as ca, b.con as cb from votes a join votes b on a.article_id = b.article_id and a.labeler <> b.labeler)"""


def ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """labeler, a_rel, b_rel, a_con, b_con, n: answers of each labeler and how many votes of others on its articles gave the other pair."""
    v = label_votes(spark, sf_dir).select("item", F.col("annotator").alias("labeler"), F.col("relevant").alias("rel"), F.col("concern").cast("int").alias("con"))
    answers = v.groupBy("item", "rel", "con").agg(F.count("*").alias("n"))  # at most 3 x 5 per article
    given = answers.groupBy("item").agg(F.collect_list(F.struct("rel", "con", "n")).alias("others"))
    each = v.join(given, "item").select("labeler", F.col("rel").alias("ra"), F.col("con").alias("ca"), F.explode("others").alias("o"))
    own = F.col("ra").eqNullSafe(F.col("o.rel")) & F.col("ca").eqNullSafe(F.col("o.con"))
    left = each.select("labeler", "ra", "ca", F.col("o.rel").alias("rb"), F.col("o.con").alias("cb"), (F.col("o.n") - own.cast("int")).alias("n"))
    return left.filter("n > 0").groupBy("labeler", "ra", "ca", "rb", "cb").agg(F.sum("n").alias("n"))


@query("label_confusion", _RATINGS + " select labeler, coalesce(ra, '(none)') as a, coalesce(rb, '(none)') as b, count(*) as n from ratings group by all")
def label_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each labeler's answers against those of all others."""
    named = lambda c: F.coalesce(F.col(c), F.lit("(none)"))
    return ratings(spark, sf_dir).groupBy("labeler", named("ra").alias("a"), named("rb").alias("b")).agg(F.sum("n").alias("n"))


@query("label_kappa", _RATINGS + """
    , j as (select labeler, coalesce(ra, '-') as a, coalesce(rb, '-') as b, count(*) as n from ratings group by all), t as (select labeler, sum(n) as n, coalesce(sum(n) filter (a <> b), 0) as o from j group by labeler),
    e as (select x.labeler, sum(x.n * y.n) as s from (select labeler, a, sum(n) as n from j group by all) x join (select labeler, b, sum(n) as n from j group by all) y on x.labeler = y.labeler and x.a = y.b group by x.labeler)
    select t.labeler, t.n::bigint as n, round(o / t.n::double, 6) as observed, round(1 - coalesce(s, 0) / (t.n * t.n)::double, 6) as expected,
           round(1 - (o / t.n::double) / nullif(1 - coalesce(s, 0) / (t.n * t.n)::double, 0), 6) as kappa from t left join e on t.labeler = e.labeler
    """)  # fmt: skip
def label_kappa(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unweighted kappa of each labeler against all others; a missing answer is a category."""
    return r6(stats.grouped_kappa(ratings(spark, sf_dir), ["labeler"], "ra", "rb", "n"), "observed", "expected", "kappa")


@query("label_kappa_quadratic", _RATINGS + """
    , p as (select * from ratings where ca is not null and cb is not null), m as (select labeler, count(*) as n, sum((ca - cb) * (ca - cb)) as o from p group by labeler),
    e as (select x.labeler, sum((x.ca - y.cb) * (x.ca - y.cb) * x.n * y.n) as s from (select labeler, ca, count(*) as n from p group by all) x join (select labeler, cb, count(*) as n from p group by all) y on x.labeler = y.labeler group by x.labeler)
    select m.labeler, n, round(o / n::double, 6) as observed, round(s / (n * n)::double, 6) as expected, round(1 - (o / n::double) / nullif(s / (n * n)::double, 0), 6) as kappa from m join e on m.labeler = e.labeler
    """)  # fmt: skip
def label_kappa_quadratic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quadratically weighted kappa of an ordered answer, of each labeler against all others."""
    return r6(stats.grouped_kappa(ratings(spark, sf_dir), ["labeler"], "ca", "cb", "n", "quadratic"), "observed", "expected", "kappa")


@query("label_percent_agreement", _RATINGS + " select labeler, count(*) as n, round(avg((ra is not distinct from rb)::int), 6) as relevant, round(avg((ca is not distinct from cb)::int), 6) as concern from ratings group by labeler")
def label_percent_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of equal answers of each labeler and all others, nulls equal to nulls."""
    same = lambda a, b: F.round(F.sum(F.when(F.col(a).eqNullSafe(F.col(b)), F.col("n")).otherwise(0)) / F.sum("n"), 6)
    return ratings(spark, sf_dir).groupBy("labeler").agg(F.sum("n").alias("n"), same("ra", "rb").alias("relevant"), same("ca", "cb").alias("concern"))


@query("label_precision_recall", _RATINGS + """
    , k as (select labeler, ca as cls from ratings where ca is not null union select labeler, cb from ratings where cb is not null)
    select k.labeler, k.cls::varchar as cls, count(*) filter (cb = k.cls) as support, round(count(*) filter (ca = k.cls and cb = k.cls) / nullif(count(*) filter (ca = k.cls), 0)::double, 6) as precision,
           round(count(*) filter (ca = k.cls and cb = k.cls) / nullif(count(*) filter (cb = k.cls), 0)::double, 6) as recall,
           round(2 * count(*) filter (ca = k.cls and cb = k.cls) / (count(*) filter (ca = k.cls) + count(*) filter (cb = k.cls))::double, 6) as f1 from k join ratings r on k.labeler = r.labeler group by k.labeler, k.cls
    """)  # fmt: skip
def label_precision_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision, recall and F1 per class of each labeler against all others."""
    return r6(stats.grouped_precision_recall(ratings(spark, sf_dir), ["labeler"], "ca", "cb", "n"), "precision", "recall", "f1")


@query("label_disagreements", _VOTES + """
    select article_id, count(*) as labelers, count(distinct coalesce(rel, '-')) > 1 as relevant, case when bool_or(coalesce(rel = 'y', false)) then count(distinct coalesce(con, -1)) > 1 end as concern from votes group by article_id having count(*) > 1
    """)  # fmt: skip
def label_disagreements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields in which any of an article's labelers differ; concern only counts where one found the article relevant."""
    differ = lambda c, none: F.min(F.coalesce(c, none)) < F.max(F.coalesce(c, none))
    v = label_votes(spark, sf_dir).groupBy(F.col("item").alias("article_id")).agg(
        F.count("*").alias("labelers"), differ(F.col("relevant"), F.lit("-")).alias("relevant"),
        F.when(F.max(F.coalesce(F.col("relevant") == "y", F.lit(False))), differ(F.col("concern").cast("int"), F.lit(-1))).alias("concern"),
    )
    return v.filter("labelers > 1")


# Catalogue and duplicates


@query("catalog_precedence", """
    with a as (select distinct *, case found_via when 'manual' then 0 when 'search' then 1 else 2 end as rk from articles)
    select outlet, arg_min(nullif(trim(fips_guess), ''), struct_pack(r := rk, i := article_id)) filter (nullif(trim(fips_guess), '') is not null) as fips_guess,
           arg_min(nullif(trim(date_source), ''), struct_pack(r := rk, i := article_id)) filter (nullif(trim(date_source), '') is not null) as date_source from a group by outlet
    """)  # fmt: skip
def catalog_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per outlet; each column from the most trusted row that has it."""
    rank = F.when(F.col("found_via") == "manual", 0).when(F.col("found_via") == "search", 1).otherwise(2)
    a = table(spark, sf_dir, "articles").distinct().withColumn("rk", rank)
    return dedupe.merge_by_precedence(a, "outlet", "rk", "article_id", ["fips_guess", "date_source"])


@query("title_duplicates", """
    with k as (select distinct article_id, trim(regexp_replace(regexp_replace(lower(title), '\\s+[|–—-]\\s+[^|–—]*$', ''), '[^a-z0-9]+', ' ', 'g')) as key, published from articles)
    select article_id, dup_of from (select article_id, first_value(article_id) over (partition by key order by coalesce(published, ''), article_id) as dup_of from k where length(key) >= 25) where article_id <> dup_of
    """)  # fmt: skip
def title_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles whose title an earlier one has."""
    from tidemark.functions.text import title_key

    a = table(spark, sf_dir, "articles").select("article_id", "published", title_key("title").alias("key")).distinct()
    return dedupe.title_duplicates(a, "article_id", "key", F.coalesce("published", F.lit("")))


_NEAR = """
    with recursive d as (select doc_id, fetched_at, text from documents where text is not null), t as (select min(doc_id) as id, text from d group by text),
    l as (select id, regexp_extract_all(lower(text), '[a-z0-9]+') as ws from t), w as (select id, unnest(ws) as w, unnest(range(0, len(ws))) as i from l),
    r as (select id, w || ' ' || lead(w, 1) over p || ' ' || lead(w, 2) over p || ' ' || lead(w, 3) over p || ' ' || lead(w, 4) over p as h from w window p as (partition by id order by i)),
    s as (select distinct id, hash(h) as h from r where h is not null), n as (select id, count(*) as n from s group by id),
    c as (select a.id as a, b.id as b, count(*) as k from s a join s b on a.h = b.h and a.id < b.id group by a.id, b.id),
    near as (select a, b from c join n x on x.id = a join n y on y.id = b where k / (x.n + y.n - k)::double >= 0.8 - 1e-9),
    sides as (select a as u, b as v from near union select b, a from near),
    reach as (select u, v from sides union select r.u, s.v from reach r join sides s on r.v = s.u),
    low as (select u, least(min(v), u) as c from reach group by u),
    classes as (select d.doc_id as item, coalesce(low.c, t.id) as class_id, d.fetched_at from d join t on d.text = t.text left join low on low.u = t.id)"""


@query("near_duplicate_classes", _NEAR + " select item, class_id from classes")
def near_duplicate_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document with the class of texts it is connected to by runs of five words."""
    return dedupe.near_duplicates(table(spark, sf_dir, "documents"), "doc_id", "text")


@query("near_duplicate_roots", _NEAR + " select item, case when item <> root then root end as dup_of from (select item, first_value(item) over (partition by class_id order by fetched_at nulls last, item) as root from classes)")
def near_duplicate_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document with the earliest fetched one of its class, null for that one itself."""
    docs = table(spark, sf_dir, "documents")
    return dedupe.roots(dedupe.near_duplicates(docs, "doc_id", "text"), docs.select(F.col("doc_id").alias("item"), F.col("fetched_at").alias("at")))


# Clusters over counties: cells of one degree, and county means of the final share.

_CELLS = """
    with v as (select c.fips, floor(lon)::int as col, floor(lat)::int as row, avg(w.v) as v from counties c join (select distinct site_id, fips, week_end, ed_resp_final as v from county_week) w on c.fips = w.fips group by all),
    cell as (select min(fips) as k, row, col, avg(v) as v from v where v is not null group by row, col), e as (select a.k as src, b.k as dst from cell a join cell b on abs(a.row - b.row) <= 1 and abs(a.col - b.col) <= 1 and a.k <> b.k)"""


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = table(spark, sf_dir, "county_week").select("site_id", "fips", "week_end", F.col("ed_resp_final").alias("v")).distinct()
    v = table(spark, sf_dir, "counties").join(w, "fips").groupBy("fips", F.floor("lon").cast("int").alias("col"), F.floor("lat").cast("int").alias("row")).agg(F.avg("v").alias("v")).filter("v is not null")
    return v.groupBy("row", "col").agg(F.min("fips").alias("k"), F.avg("v").alias("v"))


@query("spatial_grid_edges", _CELLS + " select src, dst from e")
def spatial_grid_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells that touch at a side or a corner."""
    return spatial.grid_edges(cells(spark, sf_dir), "k", "row", "col")


@query("spatial_gi_star", _CELLS + """
    , g as (select count(*)::double as n, avg(v) as m, stddev_pop(v) as s from cell), l as (select src, dst from e union all select k, k from cell),
    t as (select l.src as k, sum(c.v) as t, count(*)::double as w from l join cell c on c.k = l.dst group by l.src)
    select k, round((t - m * w) / (s * sqrt((n * w - w * w) / (n - 1))), 6) as z from t, g
    """)  # fmt: skip
def spatial_gi_star(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hot and cold spots by the Getis-Ord statistic."""
    c = cells(spark, sf_dir)
    return r6(spatial.gi_star(c, spatial.grid_edges(c, "k", "row", "col"), "k", "v"), "z")


@query("spatial_local_moran", _CELLS + """
    , g as (select avg(v) as m, var_pop(v) as s2 from cell), t as (select e.src as k, avg(c.v - g.m) as lag from e join cell c on c.k = e.dst, g group by e.src)
    select t.k, round((c.v - g.m) * t.lag / g.s2, 6) as i, (case when c.v - g.m > 0 then 'H' else 'L' end) || (case when t.lag > 0 then 'H' else 'L' end) as quadrant from t join cell c on c.k = t.k, g
    """)  # fmt: skip
def spatial_local_moran(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Local Moran's I with its quadrant."""
    c = cells(spark, sf_dir)
    return r6(spatial.local_moran(c, spatial.grid_edges(c, "k", "row", "col"), "k", "v"), "i")


def tied_cells(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Cells, and the links of those that touch, islands tied to the nearest cell."""
    c = durable(cells(spark, sf_dir))
    edges, _ = spatial.attach_islands(spatial.grid_edges(c, "k", "row", "col"), c, "k", "col", "row", 1.5)
    return c, edges


@query("spatial_hot_spots")
def spatial_hot_spots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hot and cold spots by 9,999 permutations, with the false discovery rate over the map."""
    c, edges = tied_cells(spark, sf_dir)
    return spatial.hot_spots(c, edges, "k", "v")


@query("spatial_clusters")
def spatial_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters and outliers by local Moran's I, with 9,999 permutations."""
    c, edges = tied_cells(spark, sf_dir)
    return spatial.local_clusters(c, edges, "k", "v")


_TIED = _CELLS + """
    , d as (select a.k as src, b.k as dst, row_number() over (partition by a.k order by sqrt((a.row - b.row) ** 2 + (a.col - b.col) ** 2), b.k) as rn from cell a join cell b on a.k <> b.k where a.k not in (select src from e)),
    tied as (select src, dst from e union select src, dst from d where rn = 1 union select dst, src from d where rn = 1)"""


@query("spatial_islands", _TIED + " select src, dst from tied")
def spatial_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of cells, with those that touch no other tied to the nearest."""
    return tied_cells(spark, sf_dir)[1]


@query("spatial_ring_edges", _CELLS + " select src, dst from e")
def spatial_ring_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells as square shapes that share a point of their rings."""
    c = cells(spark, sf_dir)
    corner = lambda a, b: F.array((F.col("col") + a).cast("double"), (F.col("row") + b).cast("double"))
    return spatial.ring_edges(c.withColumn("ring", F.array(corner(0, 0), corner(1, 0), corner(1, 1), corner(0, 1), corner(0, 0))), "k", "ring")


@query("spatial_near_edges", "select a.fips as src, b.fips as dst, round(sqrt((a.lon - b.lon) ** 2 + (a.lat - b.lat) ** 2), 6) as distance from counties a join counties b on a.fips <> b.fips and sqrt((a.lon - b.lon) ** 2 + (a.lat - b.lat) ** 2) <= 0.7")
def spatial_near_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counties whose centres are near, through a grid of cells."""
    return r6(spatial.near_edges(table(spark, sf_dir, "counties"), "fips", "lon", "lat", 0.7), "distance")


@query("spatial_nearest", "select fips, round((lon + 90) ** 2 + (lat - 39) ** 2, 6) as d2 from counties order by (lon + 90) ** 2 + (lat - 39) ** 2, fips limit 40")
def spatial_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 40 counties nearest to a place: the report is the feature."""
    return r6(spatial.nearest(table(spark, sf_dir, "counties"), "fips", "lon", "lat", (-90.0, 39.0), 40), "d2")


@query("spatial_box", "select fips, population from counties where lon between -92.5 and -88.5 and lat between 37.5 and 40.5")
def spatial_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counties whose centre is in a box."""
    c = table(spark, sf_dir, "counties")
    return c.filter(spatial.bbox_overlap(F.col("lon"), F.col("lat"), F.col("lon"), F.col("lat"), (-92.5, 37.5, -88.5, 40.5))).select("fips", "population")


@query("spatial_polygon", "select fips, population from counties where lon > -93 and lat > 37 and lat < 41 and lon - (-93) < (41 - lat) * 2")
def spatial_polygon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counties inside a triangle."""
    ring = [(-93.0, 37.0), (-85.0, 37.0), (-93.0, 41.0)]
    return table(spark, sf_dir, "counties").filter(spatial.in_polygon(F.col("lon"), F.col("lat"), ring)).select("fips", "population")


@query("spatial_breaks", "select array_to_string(list_sort(list_distinct(list_concat([0.0::double], list_transform(quantile_cont(p, [1/7, 2/7, 3/7, 4/7, 5/7, 6/7]), lambda x: round_even(x * 2, 0) / 2), [ceil(max(p))]))), ' ') as breaks from (select population / 10000.0::double as p from counties)")
def spatial_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class breaks of a map."""
    b = spatial.class_breaks(table(spark, sf_dir, "counties").select((F.col("population") / 10000).alias("p")), "p")
    return b.select(F.array_join("breaks", " ").alias("breaks"))


@query("spatial_outline", _CELLS + " , s as (select fips as k, metro as g from counties) select src, dst, a.g as ga, b.g as gb from e join s a on a.k = src join s b on b.k = dst where a.g <> b.g and src < dst")
def spatial_outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where groups of cells meet."""
    c = cells(spark, sf_dir)
    groups = table(spark, sf_dir, "counties").select(F.col("fips").alias("k"), F.col("metro").alias("g"))
    return spatial.outline_edges(spatial.grid_edges(c, "k", "row", "col"), groups, "k", "g")


@query("spatial_projection", """
    with k as (select radians(29.5) as p1, radians(45.5) as p2, radians(23) as p0, 6371.0::double as r), c as (select *, (sin(p1) + sin(p2)) / 2 as n, cos(p1) ** 2 + (sin(p1) + sin(p2)) * sin(p1) as c from k),
    t as (select fips, n * radians(lon + 96) as th, r * sqrt(c - 2 * n * sin(radians(lat))) / n as rho, r * sqrt(c - 2 * n * sin(p0)) / n as rho0 from counties, c)
    select fips, round(rho * sin(th), 6) as x, round(rho0 - rho * cos(th), 6) as y from t
    """)  # fmt: skip
def spatial_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal-area coordinates of county centres."""
    x, y = spatial.albers(F.col("lon"), F.col("lat"))
    return r6(table(spark, sf_dir, "counties").select("fips", x.alias("x"), y.alias("y")), "x", "y")


@query("spatial_join_report", "select 'without values' as side, count(*) as n from counties where fips not in (select fips from county_week) union all select 'without shape', count(distinct fips) from county_week where fips not in (select fips from counties) union all select 'matched', count(*) from counties where fips in (select fips from county_week)")
def spatial_join_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How two sets of keys cover each other."""
    a, b = table(spark, sf_dir, "counties").select("fips"), table(spark, sf_dir, "county_week").select("fips").distinct()
    say = lambda df, s: df.agg(F.lit(s).alias("side"), F.count("*").alias("n"))
    return say(a.join(b, "fips", "left_anti"), "without values").unionByName(say(b.join(a, "fips", "left_anti"), "without shape")).unionByName(say(a.join(b, "fips", "left_semi"), "matched"))


# Models


@query("model_ridge", _EXAMPLES + ", q as (select site % 5 as grp, d1, y from (select geo as site, d1, y from e)), m as (select grp, count(*) as n, avg(d1) as mx, avg(y) as my, sum(d1 * d1) - count(*) * avg(d1) * avg(d1) as sxx, sum(d1 * y) - count(*) * avg(d1) * avg(y) as sxy from q group by grp) select grp, n, round(sxy / sqrt(sxx / n) / (n + 1.00000001) / sqrt(sxx / n), 5) as slope, round(my - mx * (sxy / sqrt(sxx / n) / (n + 1.00000001) / sqrt(sxx / n)), 5) as intercept from m")
def model_ridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ridge of the log change on momentum, for groups of sites."""
    e = examples(spark, sf_dir).withColumn("grp", F.col("geo") % 5)
    fit = models.ridge_fit(e, ["grp"], ["d1"], "y")
    return fit.select("grp", "n", F.round(F.element_at("beta", 2), 5).alias("slope"), F.round(F.element_at("beta", 1), 5).alias("intercept"))


#: The rungs of the ladder: features of each model.
RUNGS = {"level": ["level"], "momentum": ["level", "d1", "d2"], "season": ["level", "d1", "d2", "sin1", "cos1"]}


@query("model_rolling")
def model_rolling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ladder over all origins: each rung is refitted every four weeks on what had settled two weeks before, and scored at every origin.

    Sums of products per week add up to those of every fit, so rows are read once and never
    repeated; a feature that a rung lacks is a constant.
    """
    h = harmonics("time", 1)
    e = examples(spark, sf_dir).withColumns({"sin1": h["sin1"], "cos1": h["cos1"]})
    days = sorted(r[0] for r in e.select("time").distinct().toLocalIterator())[6:]  # a calendar
    fit_of = models.refit_schedule(days)
    every = RUNGS["season"]
    sums = durable(models.ridge_sums(e, ["time"], every, "y"))  # a row per week
    at_fit = durable(models.running_sums(sums, "time", 14, sorted(set(fit_of.values()))))
    calendar = spark.createDataFrame([(d, f) for d, f in fit_of.items()], "time date, origin date")
    scored = None
    for rung, features in RUNGS.items():
        kept = [every.index(f) for f in features]
        named = {**{f"s_x{i}": f"s_x{j}" for j, i in enumerate(kept)}, "s_y": "s_y", **{f"p_x{i}_x{k}": f"p_x{j}_x{m}" for j, i in enumerate(kept) for m, k in enumerate(kept) if k >= i}, **{f"p_x{i}_y": f"p_x{j}_y" for j, i in enumerate(kept)}, "p_y_y": "p_y_y"}
        fits = models.ridge_solve(at_fit.select("origin", "n", *[F.col(a).alias(b) for a, b in named.items()]), ["origin"], features)
        part = models.grouped_predict(e.join(F.broadcast(calendar), "time"), fits, ["origin"], features).select("time", F.lit(rung).alias("rung"), "last", "final", (F.col("last") * F.exp("pred")).alias("value"))  # a row per week
        scored = part if scored is None else scored.unionByName(part)
    return scored.groupBy(F.col("time").alias("origin"), "rung").agg(F.count("*").alias("n"), F.round(F.avg(F.abs(F.col("value") - F.col("final"))), 6).alias("mae"), F.round(F.avg(F.abs(F.col("last") - F.col("final"))), 6).alias("naive_mae"))


@query("model_autoregression")
def model_autoregression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An autoregression on differences per site."""
    return r6(models.ar_differences(weekly(spark, sf_dir), "geo", "time", "v", least=10), "a1", "a2", "last", "forecast")


def later_weeks(e: DataFrame, share: float = 0.7):
    """Whether a row of ``e`` is in the weeks after the first ``share`` of all weeks: a calendar reaches the driver."""
    weeks = sorted(r[0] for r in e.select("time").distinct().toLocalIterator())
    return F.col("time") > F.lit(weeks[int(share * (len(weeks) - 1))]) if weeks else F.lit(True)


def _scored(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    data = models.assembled(examples(spark, sf_dir), ["level", "d1", "d2"])
    late = later_weeks(data)
    fitted = models.tree_model(kind, "y").fit(data.filter(~late))
    out = fitted.transform(data.filter(late)).withColumn("value", F.col("last") * F.exp("prediction"))
    return out.agg(F.lit(kind).alias("model"), F.count("*").alias("n"), F.round(F.avg(F.abs(F.col("value") - F.col("final"))), 4).alias("mae"), F.round(F.avg(F.abs(F.col("last") - F.col("final"))), 4).alias("naive_mae"))


@query("model_boosted")
def model_boosted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boosted trees on history, scored on later weeks."""
    return _scored(spark, sf_dir, "boosted")


@query("model_forest")
def model_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A random forest on history, scored on later weeks."""
    return _scored(spark, sf_dir, "forest")


@query("model_kernel")
def model_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A kernel machine by random Fourier features and a ridge, fitted on history and scored on later weeks."""
    e, names = models.fourier_features(examples(spark, sf_dir).withColumn("grp", F.lit(1)), ["level", "d1", "d2"])
    late = e.withColumn("late", later_weeks(e))
    scored = models.grouped_predict(late.filter("late"), models.ridge_fit(late.filter("not late"), ["grp"], names, "y"), ["grp"], names)
    return scored.agg(F.count("*").alias("n"), F.round(F.avg(F.abs(F.col("last") * F.exp("pred") - F.col("final"))), 4).alias("mae"), F.round(F.avg(F.abs(F.col("last") - F.col("final"))), 4).alias("naive_mae"))


# Samples


_ALLOCATED = """
    with a as (select distinct article_id, coalesce(stratum, '-') as stratum, coalesce(metro, '-') as metro from articles), s as (select stratum, count(*) as size from a group by stratum),
    q as (select *, least(60, sum(size) over ())::bigint as wanted, count(*) over () as strata, size * least(60, sum(size) over ()) / (sum(size) over ())::double as quota from s),
    f as (select *, case when wanted >= strata then greatest(floor(quota), 1) else floor(quota) end::bigint as base from q),
    m as (select *, wanted - sum(base) over () as missing, row_number() over (order by quota - floor(quota) desc, stratum desc) as rank from f),
    u as (select stratum, missing, rank, unnest(range(1, 1 + case when missing > 0 then least(size - base, missing) else least(base - 1, -missing) end::bigint)) as round from m),
    t as (select stratum, count(*) as moved from (select *, row_number() over (order by round, case when missing > 0 then rank else -rank end) as turn from u) where turn <= abs(missing) group by stratum),
    takes as (select m.stratum, size, (base + sign(missing) * coalesce(moved, 0))::bigint as take from m left join t on m.stratum = t.stratum)"""


@query("sample_allocation", _ALLOCATED + " select stratum, size, take from takes")
def sample_allocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """60 articles over the strata in proportion, one at least of each."""
    return allocation(strata(spark, sf_dir))


def strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "articles")
    return a.select("article_id", F.coalesce("stratum", F.lit("-")).alias("stratum"), F.coalesce("metro", F.lit("-")).alias("metro")).distinct()


def allocation(rows: DataFrame) -> DataFrame:
    return sampling.allocate(rows.groupBy("stratum").agg(F.count("*").alias("size")), "stratum", "size", 60)


@query("sample_systematic", _ALLOCATED + """
    , r as (select a.*, row_number() over (partition by stratum order by metro, md5(article_id || '|4109'), article_id)::double as upto from a),
    p as (select r.*, size / take::double as step, ('0x' || substr(md5(r.stratum || '|4109'), 1, 8))::bigint / 4294967296.0::double * (size / take::double) as start from r join takes t on r.stratum = t.stratum where take > 0)
    select article_id, stratum from p where greatest(ceil((upto - start) / step), 0) > greatest(ceil((upto - 1 - start) / step), 0)
    """)  # fmt: skip
def sample_systematic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evenly spaced articles per stratum from a random start, by metro and a seeded order."""
    rows = strata(spark, sf_dir)
    return sampling.systematic(rows, "stratum", allocation(rows), "metro", "article_id", 4109).select("article_id", "stratum")


@query("sample_shuffle", """
    with w as (select distinct site_id, week_end, ed_resp_final as v from county_week where ed_resp_final is not null), a as (select *, row_number() over (partition by site_id order by week_end) as i from w),
    b as (select site_id, v, row_number() over (partition by site_id order by md5(site_id::varchar || '|' || week_end::varchar || '|7')) as i from w)
    select a.site_id, a.week_end, b.v from a join b on a.site_id = b.site_id and a.i = b.i
    """)  # fmt: skip
def sample_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A placebo: each site's values permuted over its weeks."""
    w = table(spark, sf_dir, "county_week").select("site_id", "week_end", F.col("ed_resp_final").alias("v")).filter("v is not null").distinct()
    return sampling.shuffle_within(w, "site_id", "week_end", ["v"], 7).select("site_id", "week_end", "v")


@query("sample_rises", """
    with w as (select distinct site_id, week_end, ed_resp_final as v from county_week where ed_resp_final is not null),
    r as (select site_id, week_end, ln(greatest(v, 0.05)) - ln(greatest(lag(v) over (partition by site_id order by week_end), 0.05)) as rise, lag(v) over (partition by site_id order by week_end) as p from w),
    k as (select *, row_number() over (partition by site_id order by rise desc, week_end) as rn, count(*) over (partition by site_id) as n from r where p is not null)
    select site_id, week_end, round(rise, 6) as rise from k where rn <= ceil(n / 10.0::double)
    """)  # fmt: skip
def sample_rises(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each site's top tenth of rises: where synthetic news would be placed."""
    w = table(spark, sf_dir, "county_week").select("site_id", "week_end", F.col("ed_resp_final").alias("v")).filter("v is not null").distinct()
    by = Window.partitionBy("site_id").orderBy("week_end")
    before = F.lag("v").over(by)
    r = w.withColumns({"p": before}).filter("p is not null").withColumn("rise", F.ln(F.greatest("v", F.lit(0.05))) - F.ln(F.greatest("p", F.lit(0.05))))
    k = r.withColumns({"rn": F.row_number().over(Window.partitionBy("site_id").orderBy(F.desc("rise"), "week_end")), "n": F.count("*").over(Window.partitionBy("site_id"))})
    return r6(k.filter(F.col("rn") <= F.ceil(F.col("n") / 10)).select("site_id", "week_end", "rise"), "rise")
