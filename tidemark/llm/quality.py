"""Per-document text statistics, and how unusual each is in the document's language.

Statistics come from one pass over whole texts in Arrow batches. Per language and statistic a
mergeable quantile sketch is built map-side, apart for texts that read as language (a share of
common words) and for others; merged, they are the distributions of all texts. Median and
quartiles of the former turn values into robust z-scores, so that junk, however common, does not
widen them. Sketches have a fixed size, so only languages x statistics of them are moved.

The tails decide: a text with words but far too few common ones is junk; a text whose statistics
all lie inside the tails, and within BOUNDS that hold whatever the sketches say, is prose. Only
texts left open are classified line by line: those outside the bounds, which no tail can call
prose, while their statistics are taken, and those that only the sketches leave open afterwards.

Defined results: null and empty texts have no word, zeros for all statistics, and take no part in
the sketches; an unknown language is 'und'; a language of fewer than ``least`` reading texts is
compared with all reading texts, and if these are fewer than that too, no tail decides; a spread
of zero counts as that of SPREAD_FLOOR; ids are unique.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.prose import COMMON_SHARE, STATISTICS, prose_share, statistics
from tidemark.session import durable

#: The least spread by which a statistic's deviations are scaled.
SPREAD_FLOOR = {
    "words": 20.0, "mean_word_length": 0.3, "symbol_ratio": 0.01, "digit_ratio": 0.02, "lines": 2.0, "ended_line_share": 0.05, "common_word_share": 0.03,
    "short_line_share": 0.05, "longest_word": 2.0,
}
#: The statistics that tell prose from other text, and the side on which their tail tells against prose.
AGAINST = {"symbol_ratio": 1, "digit_ratio": 1, "ended_line_share": -1, "common_word_share": -1, "short_line_share": 1, "mean_word_length": 0}
#: A text outside these is never called prose by its tails: most lines end as sentences do, few are short, and it reads as language.
BOUNDS = {"ended_line_share": (0.75, 1.0), "short_line_share": (0.0, 0.5), "common_word_share": (COMMON_SHARE, 1.0), "symbol_ratio": (0.0, 0.12)}
#: A text with a smaller share of common words cannot be prose by half: running lines have COMMON_SHARE of them, and at least a quarter of the words.
NO_LANGUAGE = 0.03
#: z-scores within which a statistic speaks for prose, and beyond which it speaks for junk.
NEAR, FAR = 3.5, 5.0
#: Languages that are joined back by broadcast; more are joined by key.
BROADCAST_LANGUAGES = 5000
#: Ids of texts that are looked at again by broadcast (about 16 MB); more are joined by key.
BROADCAST_IDS = 1_000_000
ALL = "*"


def always_open(values: list[float]) -> bool:
    """Whether a text with these STATISTICS is left open whatever the sketches say."""
    known = dict(zip(STATISTICS, values, strict=True))
    return known["words"] > 0 and known["common_word_share"] >= NO_LANGUAGE and any(not low <= known[s] <= high for s, (low, high) in BOUNDS.items())


def text_statistics(docs: DataFrame, doc_id: str, text: str, lang: str) -> DataFrame:
    """id, lang, the STATISTICS of each document's whole text, and prose_share where the text is open whatever the sketches say."""

    @F.pandas_udf("array<double>")
    def measure(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            values = statistics(t)
            out.append([*values, prose_share(t) if always_open(values) else None])
        return pd.Series(out, dtype=object)

    language = F.coalesce(F.nullif(F.lower(F.trim(F.col(lang))), F.lit("")), F.lit("und"))
    measured = docs.select(F.col(doc_id).alias("id"), language.alias("lang"), measure(F.coalesce(F.col(text), F.lit(""))).alias("_s"))
    return measured.select("id", "lang", *[F.element_at("_s", i + 1).alias(s) for i, s in enumerate([*STATISTICS, "prose_share"])])


def language_sketches(stats: DataFrame) -> DataFrame:
    """lang, reads, documents and a quantile sketch per statistic, over documents with a word; lang '*' merges all languages.

    ``reads``: texts with a share of common words as running lines have it, and the others.
    """
    reads = (F.col("common_word_share") >= COMMON_SHARE).alias("reads")
    per = stats.filter("words > 0").groupBy("lang", reads).agg(F.count("*").alias("documents"), *[F.kll_sketch_agg_double(s).alias(s) for s in STATISTICS])
    per = durable(per)
    return per.unionByName(merged(per.withColumn("lang", F.lit(ALL)), "lang", "reads"))


def merged(sketches: DataFrame, *by: str) -> DataFrame:
    """The sketches of the groups ``by``, from those of their parts."""
    return sketches.groupBy(*by).agg(F.sum("documents").alias("documents"), *[F.kll_merge_agg_double(s).alias(s) for s in STATISTICS])


def quantiles(sketches: DataFrame, ranks: tuple[float, ...] = (0.25, 0.5, 0.75)) -> DataFrame:
    """lang, documents, statistic, values at ``ranks``."""
    wanted = F.array(*[F.lit(float(r)) for r in ranks])
    rows = F.array(*[F.struct(F.lit(s).alias("statistic"), F.kll_sketch_get_quantile_double(F.col(s), wanted).alias("values")) for s in STATISTICS])
    return sketches.select("lang", "documents", F.explode(rows).alias("r")).select("lang", "documents", "r.*")


def levels_of(sketches: DataFrame) -> DataFrame:
    """lang, documents and statistic = struct(mid, spread) of texts that read as language."""
    v = F.col("values")
    floor: Column = F.lit(0.0)
    for s, f in SPREAD_FLOOR.items():
        floor = F.when(F.col("statistic") == s, F.lit(f)).otherwise(floor)
    scaled = quantiles(sketches.filter("reads")).select("lang", "documents", "statistic", F.struct(F.element_at(v, 2).alias("mid"), F.greatest((F.element_at(v, 3) - F.element_at(v, 1)) / 1.349, floor).alias("spread")).alias("level"))
    return scaled.groupBy("lang").agg(F.max("documents").alias("documents"), *[F.max(F.when(F.col("statistic") == s, F.col("level"))).alias(s) for s in STATISTICS])


def scored(stats: DataFrame, levels: DataFrame, least: int) -> DataFrame:
    """``stats`` with z_ of every statistic, null where nothing can be compared; ``levels``: of :func:`levels_of`, by language and for all."""
    own = levels.filter(F.col("lang") != ALL).filter(F.col("documents") >= least).select(F.col("lang").alias("_l"), *[F.col(s).alias(f"_own_{s}") for s in STATISTICS])
    own = F.broadcast(own) if own.count() <= BROADCAST_LANGUAGES else own
    every = levels.filter(F.col("lang") == ALL).filter(F.col("documents") >= least).select(F.lit(1).alias("_one"), *[F.col(s).alias(f"_all_{s}") for s in STATISTICS])
    both = stats.join(own, F.col("lang") == F.col("_l"), "left").withColumn("_k", F.lit(1)).join(F.broadcast(every), F.col("_k") == F.col("_one"), "left")  # one row
    z = {}
    for s in STATISTICS:
        level = F.coalesce(f"_own_{s}", f"_all_{s}")
        z[f"z_{s}"] = F.when(F.col("words") > 0, (F.col(s) - level["mid"]) / level["spread"])
    return both.select(*stats.columns, *[c.alias(n) for n, c in z.items()])


def verdict_by_tails(near: float = NEAR, far: float = FAR) -> Column:
    """'junk' or 'prose' where the tails decide, null where they leave a text open."""
    inside = F.lit(True)
    for s, side in AGAINST.items():
        z = F.abs(f"z_{s}") if side == 0 else F.col(f"z_{s}") * side
        inside = inside & (z <= near)
    for s, (low, high) in BOUNDS.items():
        inside = inside & F.col(s).between(low, high)
    speechless = (F.col("common_word_share") < NO_LANGUAGE) & (F.col("z_common_word_share") <= -far)
    return F.when(F.col("words") == 0, "junk").when(speechless, "junk").when(inside, "prose")


def quality(docs: DataFrame, doc_id: str, text: str, lang: str, tail: float = 3.5, least: int = 50) -> DataFrame:
    """id, lang, the statistics, z_ of each in the language, tails (names beyond ``tail``), decided_by, prose_share, not_prose.

    ``decided_by``: 'tails' or 'lines'; ``prose_share``, the share of characters in running
    sentences, is measured where the tails leave a text open, and null elsewhere. ``not_prose``
    marks documents that hold no word at all, or of which more than half is not running sentences.
    """
    stats = durable(text_statistics(docs, doc_id, text, lang))  # numbers only: no text is moved or written
    levels = durable(levels_of(language_sketches(stats)))
    said = scored(stats, levels, least).withColumn("_said", verdict_by_tails())

    @F.pandas_udf("double")
    def lines(texts: pd.Series) -> pd.Series:
        return pd.Series([prose_share(t) for t in texts], dtype=float)

    left = durable(said.filter("_said is null and prose_share is null").select(F.col("id").alias("_id")).distinct())
    left = F.broadcast(left) if left.count() <= BROADCAST_IDS else left
    looked = docs.select(F.col(doc_id).alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("_text")).join(left, "_id", "left_semi").select("_id", lines("_text").alias("_share"))
    checked = said.join(looked, F.col("id") == F.col("_id"), "left").withColumn("prose_share", F.when(F.col("_said").isNull(), F.coalesce("prose_share", "_share")))
    beyond = F.array_compact(F.array(*[F.when(F.abs(f"z_{s}") > tail, F.lit(s)) for s in STATISTICS]))
    return checked.select(
        "id", "lang", *STATISTICS, *[f"z_{s}" for s in STATISTICS], F.when(F.col("words") > 0, beyond).otherwise(F.array(F.lit("words"))).alias("tails"),
        F.when(F.col("_said").isNull(), "lines").otherwise("tails").alias("decided_by"), "prose_share", F.coalesce(F.col("_said") == "junk", F.col("prose_share") < 0.5).alias("not_prose"),
    )
