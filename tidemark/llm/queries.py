"""Queries of the training-text problems, over whole tables and whole texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import labels
from tidemark.llm import consensus, mixing, packing, quality
from tidemark.llm.tokens import with_token_counts
from tidemark.plans.analysis import label_votes
from tidemark.plans.registry import Registry
from tidemark.session import durable
from tidemark.sources.tables import table

REGISTRY = Registry()
#: The containers' limits besides tokens.
LIMITS = packing.Limits(tokens_per_segment=16, loss_share=0.98)


# 6. Consensus


def fitted_consensus(spark: SparkSession, sf_dir: str) -> consensus.Consensus:
    return consensus.fit_consensus(label_votes(spark, sf_dir), labels.ANSWERS, "adjudicated")


@REGISTRY.query("p6_found")
def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consensus answers of the articles with three labelers or more."""
    return fitted_consensus(spark, sf_dir).answers().filter("labelers >= 3").select(F.col("item").alias("article_id"), "field", "answer")


@REGISTRY.query("p6_answers")
def p6_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consensus of every article with its probability and the agreement of its votes."""
    return fitted_consensus(spark, sf_dir).answers().withColumnRenamed("item", "article_id")


@REGISTRY.query("p6_reliability")
def p6_reliability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each labeler's expected reliability per field, stabilised by their type."""
    return fitted_consensus(spark, sf_dir).reliability().withColumnRenamed("annotator", "labeler")


_P6 = """
    with picked as (
        select distinct article_id, trim(labeler) as labeler, labeled_at, label_id, lower(trim(relevant)) as r, lower(illness) as i, trim(concern) as c
        from human_labels where coalesce(trim(is_example), '') not in ('1', '1.0') and article_id is not null and labeler is not null and trim(labeler) not in ('', 'adjudicated')
    ), last_row as (
        select * from (select *, row_number() over (partition by article_id, labeler order by labeled_at desc nulls last, label_id desc) as rn from picked) where rn = 1
    ), parts as (
        select *, list_sort(list_distinct(list_filter(list_transform(string_split(regexp_replace(i, '[,;]', '|', 'g'), '|'), lambda p: trim(p)), lambda p: p <> ''))) as p from last_row
    ), wide as (
        select article_id, case when r in ('y', 'yes', 'true', '1', 't') then 'y' when r in ('n', 'no', 'false', '0', 'f') then 'n' end as relevant,
               case when p = ['none'] then 'none' when len(p) > 0 and len(list_filter(p, lambda x: x not in ('covid', 'flu', 'rsv', 'respiratory_general'))) = 0 then array_to_string(p, '|') end as illness,
               nullif(regexp_extract(c, '^[+]?0*([0-3])([.]0*)?$', 1), '') as concern
        from parts
    ), votes as (
        select article_id, 'relevant' as field, relevant as v from wide union all select article_id, 'illness', illness from wide union all select article_id, 'concern', concern from wide
    ), cells as (select article_id, field, v, count(*) as n from votes where v is not null group by all),
    items as (select article_id, field, sum(n) as m, sum(n * (n - 1)) as same from cells group by all having sum(n) > 1),
    shared as (select c.field, c.v, sum(c.n) as n from cells c join items i on c.article_id = i.article_id and c.field = i.field group by all),
    chance as (select field, sum(n * (n - 1))::double / (sum(n) * (sum(n) - 1))::double as expected from shared group by field),
    seen as (select field, count(*) as items, sum(m)::bigint as votes, sum(same::double / (m - 1)::double) / sum(m)::double as observed from items group by field)
    select s.field, s.items, s.votes, round(s.observed, 6) as observed, round(c.expected, 6) as expected, round(1 - (1 - s.observed) / (1 - c.expected), 6) as alpha
    from seen s join chance c on s.field = c.field
"""


@REGISTRY.query("p6_agreement", _P6)
def p6_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Krippendorff's alpha of each field over the labelers' votes."""
    alpha = consensus.nominal_alpha(label_votes(spark, sf_dir), list(labels.ANSWERS), "adjudicated")
    return alpha.withColumns({c: F.round(c, 6) for c in ("observed", "expected", "alpha")})


# 8. Containers


def packed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    sized = with_token_counts(docs, "text", "tokens", "prompt").select("id", "tokens", "prompt")
    sizes = {r["pack_name"]: r["capacity_tokens"] for r in table(spark, sf_dir, "pack_sizes").collect()}  # a fixed table
    return packing.pack_texts(sized, sizes, LIMITS)


@REGISTRY.query("p8_pack")
def p8_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The container of every document, or of its pieces, for each pack."""
    return packed_documents(spark, sf_dir).withColumnRenamed("id", "doc_id")


@REGISTRY.query("p8_report")
def p8_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers and the share of their space used, for each pack."""
    return packing.pack_report(packed_documents(spark, sf_dir))


# 9. Mixture


def mixture(spark: SparkSession, sf_dir: str) -> mixing.Mixture:
    targets = {r["source"]: (r["target_share"], r["max_repeats"]) for r in table(spark, sf_dir, "mix_targets").filter("source is not null").collect()}  # a fixed table
    docs = table(spark, sf_dir, "documents").join(F.broadcast(table(spark, sf_dir, "mix_targets").select("source").distinct()), "source", "left_semi")  # a fixed table
    sized = with_token_counts(docs.select(F.col("doc_id").alias("id"), "source", "text", F.sha2("text", 256).alias("hash")), "text").select("id", "source", "hash", "tokens")
    return mixing.mix_sources(durable(sized), targets)


@REGISTRY.query("p9_mix")
def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The training order: each use of a document with its position, sorted over ranges."""
    return mixture(spark, sf_dir).placed.withColumnRenamed("id", "doc_id").orderBy("position", "source", "doc_id", "copy")


@REGISTRY.query("p9_shares")
def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and actual share of each listed source."""
    return mixing.share_report(mixture(spark, sf_dir))


@REGISTRY.query("p9_curriculum")
def p9_curriculum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of each source in each tenth of the run, against its scheduled share of that tenth."""
    mixed = mixture(spark, sf_dir)
    tenth = F.least(F.floor(F.col("position") * 10), F.lit(9)).cast("int")
    per = mixed.placed.groupBy(tenth.alias("tenth"), "source").agg(F.sum("tokens").alias("tokens"))
    plan = spark.createDataFrame([(s.source, s.weight, s.slope) for s in mixed.shares], "source string, weight double, slope double")
    scheduled = F.col("weight") * (1 + F.col("slope") * (1 - (F.col("tenth") + 0.5) / 5))
    return per.join(plan, "source").select("tenth", "source", "tokens", scheduled.alias("scheduled_share"))


def document_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"), "doc_id", "text", "lang")


@REGISTRY.query("p10_found")
def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that are mostly not running sentences, or have no word."""
    return document_quality(spark, sf_dir).filter("not_prose").select(F.col("id").alias("doc_id"))


@REGISTRY.query("p10_statistics")
def p10_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of every document with their robust z-scores in its language and the tails they lie in."""
    return document_quality(spark, sf_dir).withColumnRenamed("id", "doc_id")


@REGISTRY.query("p10_quantiles")
def p10_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantiles of every statistic per language, and over all ('*')."""
    stats = quality.text_statistics(table(spark, sf_dir, "documents"), "doc_id", "text", "lang")
    ranks = (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)
    return quality.quantiles(quality.merged(quality.language_sketches(stats), "lang"), ranks).withColumn("ranks", F.array(*[F.lit(r) for r in ranks]))
