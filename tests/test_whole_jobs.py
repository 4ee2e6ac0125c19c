"""Queries that take the whole of their tables, not a fixed part of them."""

import importlib

import duckdb
import numpy as np
from pyspark.sql import functions as F

from tidemark.operators import spatial
from tidemark.plans.catalog import all_queries
from tidemark.plans.point_in_time import SIGNALS
from tidemark.sources.tables import table

QUERIES = all_queries()


def test_the_fact_table_has_every_origin_and_signal(spark, sf_small):
    df = importlib.import_module("__spark_entry__").entry(spark).cache()
    t = table(spark, sf_small, "county_week")
    dates = {r[0] for r in t.select("as_of").distinct().collect()}
    assert len(dates) > 6 and {r[0] for r in df.select("as_of").distinct().collect()} == dates
    assert df.count() == t.select("site_id").distinct().count() * len(dates) * 9
    seen = df.agg(*[F.count(s).alias(s) for s in SIGNALS]).first()
    assert all(seen[s] > 0 for s in SIGNALS)
    df.unpersist()


def test_other_dates_give_other_slices(spark, tmp_path):
    con = duckdb.connect()
    con.execute(f"copy (select * replace ((as_of + interval 5 year)::date as as_of, (week_end + interval 5 year)::date as week_end) from '/root/testdata/sf0.001/county_week.parquet') to '{tmp_path}/county_week.parquet'")
    for name in ("county_week_full", "vintage_each_date"):
        years = {r[0] for r in QUERIES[name].build(spark, str(tmp_path)).select(F.year("as_of")).distinct().collect()}
        assert years and min(years) >= 2030, name
    assert QUERIES["settled_pool"].build(spark, str(tmp_path)).agg(F.max("origin")).first()[0].year >= 2030


def test_articles_are_dated_in_all_formats_by_local_day(spark, tmp_path):
    texts = ["2025-12-20", "2025-12-21T03:00:00Z", "20251220", "12/20/2025", "Dec 20, 2025 9:30 pm", "20 de diciembre de 2025", "1766268000", "Sat, 20 Dec 2025 23:30:00 -0500", "soon", None, "2025-12-20 23:59"]
    rows = [(f"a{i}", "ash" if i % 2 else "nowhere", t, "True", "") for i, t in enumerate(texts)] + [("z", "ash", "2025-12-21T03:00:00Z", "True", "")]
    spark.createDataFrame(rows, "article_id string, metro string, published string, fetched_ok string, dup_of string").write.parquet(f"{tmp_path}/articles.parquet")
    spark.createDataFrame([("ash", "America/Chicago")], "metro string, tz string").write.parquet(f"{tmp_path}/metros.parquet")
    spark.createDataFrame([(r[0], "2", "y") for r in rows], "article_id string, concern string, relevant string").write.parquet(f"{tmp_path}/human_labels.parquet")
    day = {r.article_id: str(r.day) for r in QUERIES["article_published"].build(spark, str(tmp_path)).collect()}
    assert len(day) == len(rows) and day["a8"] == day["a9"] == "None"
    assert {k for k, d in day.items() if d == "2025-12-20"} == set(day) - {"a8", "a9"}
    news = {(r.metro, str(r.week)): (r.articles, r.concern) for r in QUERIES["region_news"].build(spark, str(tmp_path)).collect()}
    assert sum(n for n, _ in news.values()) == len(rows) and news["ash", "None"] == (1, 2.0) and news["nowhere", "None"] == (1, 2.0)
    assert {r.article_id for r in QUERIES["region_cited"].build(spark, str(tmp_path)).collect()} == {k for k, d in day.items() if d != "None"}


def test_every_readable_date_is_used(spark, sf_small):
    """As many articles have a day as p4 finds instants for."""
    days = QUERIES["article_published"].build(spark, sf_small).filter("day is not null").select("article_id").distinct().count()
    found = QUERIES["p4_found"].build(spark, sf_small).filter("field = 'published'").select("article_id").distinct().count()
    assert days >= found > 0


def test_labels_of_any_labelers_count(spark, tmp_path):
    """A feed without human_b and human_k: two of three agree, one differs; a fourth stands alone."""
    rows = [(k, f"a{k // 3}", who, f"2025-12-0{k % 3 + 1}", rel, con, "") for k, (who, rel, con) in enumerate([("x", "y", "2"), ("y", "yes", "2"), ("z", "n", None)] * 4)] + [(99, "b", "w", "2025-12-01", "y", "1", "")]
    spark.createDataFrame(rows, "label_id long, article_id string, labeler string, labeled_at string, relevant string, concern string, is_example string").withColumns({"labeled_at": F.col("labeled_at").cast("timestamp"), "illness": F.lit("none")}).write.parquet(f"{tmp_path}/human_labels.parquet")
    run = lambda name: QUERIES[name].build(spark, str(tmp_path)).collect()
    assert {(r.labeler, r.a, r.b): r.n for r in run("label_confusion")} == {("x", "y", "y"): 4, ("x", "y", "n"): 4, ("y", "y", "y"): 4, ("y", "y", "n"): 4, ("z", "n", "y"): 8}
    assert {r.labeler: (r.n, r.relevant, r.concern) for r in run("label_percent_agreement")} == {"x": (8, 0.5, 0.5), "y": (8, 0.5, 0.5), "z": (8, 0.0, 0.0)}
    assert sorted((r.article_id, r.labelers, r.relevant, r.concern) for r in run("label_disagreements")) == [(f"a{i}", 3, True, True) for i in range(4)]
    assert {r.labeler: r.kappa for r in run("label_kappa")}["z"] == 0.0


def test_each_rung_is_tested_against_the_first_and_the_one_below(spark, sf_small):
    rows = QUERIES["ladder_tests"].build(spark, sf_small).collect()
    metros = {r.metro for r in rows}
    assert metros and {(r.metro, r.model, r.vs) for r in rows} == {(m, *t) for m in metros for t in (("drift", "naive"), ("mean3", "naive"), ("mean3", "drift"))}
    naive = {(r.metro): (r.n, r.m, r.w) for r in rows if (r.model, r.vs) == ("mean3", "naive")}
    assert naive == {r.metro: (r.n, r.m, r.w) for r in QUERIES["paired_wilcoxon"].build(spark, sf_small).collect()}
    assert all(r.p <= r.p_holm <= 1 for r in rows)


def test_permutations_draw_from_the_whole_map(spark):
    """p and z are those of draws from all of 3,000 values but the cell's own, in the order of the cells' hashes."""
    v = spark.range(3000).select(F.col("id").alias("k"), (F.col("id") * 1.0).alias("v"))
    edges = spark.createDataFrame([(1, 2500), (1, 2600), (7, 2)], "src long, dst long")
    got = {r.k: r for r in spatial.permutation_test(v, edges, "k", "v", rounds=999).collect()}
    order = np.array([r[0] for r in v.orderBy(F.xxhash64("k", F.lit(4109)), "k").select("v").collect()])
    _, draws = spatial._draws(v, [1, 2], 999, 4109)
    ranks, values = draws[2]
    assert (order[ranks] == values).all() and all(len(set(r)) == 3 for r in ranks)
    means = np.where((values[:, :2] == 1.0).any(axis=1), np.where(values[:, :2] == 1.0, values[:, 2:], values[:, :2]).mean(axis=1), values[:, :2].mean(axis=1))
    assert got[1].p == min(1.0, 2 * (min((means >= 2550).sum(), (means <= 2550).sum()) + 1) / 1000)
    assert abs(got[1].z - (2550 - means.mean()) / means.std()) < 1e-9 and set(got) == {1, 7} and got[7].z < -1.5


def test_planted_cluster_is_hot_and_islands_are_tied(spark):
    rows = [(8 * r + c, r, c, (10.0 if r < 3 and c < 3 else 1.0) + 0.01 * ((r * 5 + c * 3) % 7)) for r in range(8) for c in range(8)] + [(99, 20, 20, 1.0)]
    df = spark.createDataFrame(rows, "k int, r int, c int, v double")
    edges, islands = spatial.attach_islands(spatial.grid_edges(df, "k", "r", "c"), df, "k", "c", "r", 1.5)
    assert [r.k for r in islands.collect()] == [99]
    assert {(r.src, r.dst) for r in edges.collect() if 99 in (r.src, r.dst)} == {(99, 63), (63, 99)}
    kinds = {r.k: r["class"] for r in spatial.hot_spots(df, edges, "k", "v").collect()}
    # Nine of 65 cells are hot: eight hot neighbours are never drawn, three are about once in 1,000 rounds.
    assert len(kinds) == 65 and kinds[9] == "Hot spot 99%" and all(kinds[8 * r + c].startswith("Hot spot") for r in range(2) for c in range(2)) and kinds[62] == "Not significant"
    lisa = {r.k: r["class"] for r in spatial.local_clusters(df, edges, "k", "v").collect()}
    assert lisa[0] == lisa[9] == "High-High" and lisa[62] == "Not significant"
    assert spatial.clusters(df.limit(2), edges, "k", "v", "level", 99).collect() == []
