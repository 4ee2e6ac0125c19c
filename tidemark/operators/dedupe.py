"""Catalogue merging and duplicate texts."""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructType

from tidemark.functions.shingle_sets import order_of, parts_of, shingle_sets
from tidemark.session import durable, remove, scratch_path, stored

#: Texts that share a shingle of their prefixes up to which all are paired.
PAIRED_TEXTS = 1000
#: Copies to leave out, or items of which the texts are taken apart again, up to which they are broadcast.
BROADCAST_ASKED = 100_000
#: Slots of the table of rarity, and how many of them are summed at once.
SLOTS, CHUNK = 1 << 22, 1 << 14


def slot_of(s: np.ndarray) -> np.ndarray:
    """The slot of the table of rarity for each hash."""
    return (s & np.uint64(SLOTS - 1)).astype(np.int64)


def merge_by_precedence(df: DataFrame, key: str, rank: str, seq: str, columns: list[str]) -> DataFrame:
    """One row per key: each column from the row of lowest (rank, seq) that has it; blanks count as missing.

    An aggregate per column, so that no key is sorted.
    """
    order = F.struct(rank, seq)
    filled = lambda c: F.nullif(F.trim(c), F.lit(""))
    return df.groupBy(key).agg(*[F.min_by(filled(c), F.when(filled(c).isNotNull(), order)).alias(c) for c in columns])


def title_duplicates(df: DataFrame, item: str, key: str, order: Column, least: int = 25) -> DataFrame:
    """item, dup_of: items whose key of at least ``least`` characters an earlier item has; the earliest is named."""
    usable = df.filter(F.length(key) >= least)
    first = usable.groupBy(key).agg(F.min(F.struct(order.alias("o"), F.col(item).alias("root"))).alias("m"))
    joined = usable.select(item, key).join(first, key)
    return joined.filter(F.col(item) != F.col("m.root")).select(item, F.col("m.root").alias("dup_of"))


def components(links: DataFrame) -> DataFrame:
    """item, c: the least item that each item of ``links`` (a, b) is connected to.

    Minimum over neighbours and a jump to the neighbour's own minimum, until nothing moves; each
    round is a join and an aggregate over the links. Rounds are written and read as tables: a
    checkpoint keeps the size that its plan was estimated at, a product over the joins whose digits
    double in every round, in the driver's memory.
    """
    spark = links.sparkSession
    root = scratch_path(spark, "components")
    try:
        both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(links.select(F.col("b").alias("u"), F.col("a").alias("v")))
        edges = stored(both.distinct(), f"{root}/edges")
        label = stored(edges.select("u").distinct().select("u", F.col("u").alias("c"), F.col("u").alias("old")), f"{root}/0")
        for turn in itertools.count(1):
            heard = edges.join(label.select(F.col("u").alias("v"), "c"), "v").groupBy("u").agg(F.min("c").alias("near"))
            lower = label.select("u", "c").join(heard, "u").select("u", F.least("c", "near").alias("c0"), F.col("c").alias("old"))
            jump = label.select(F.col("u").alias("c0"), F.col("c").alias("c1"))
            label = stored(lower.join(jump, "c0", "left").select("u", F.least("c0", F.coalesce("c1", "c0")).alias("c"), "old"), f"{root}/{turn}")
            remove(spark, f"{root}/{turn - 1}")
            if label.filter("c <> old").isEmpty():
                return durable(label.select(F.col("u").alias("item"), "c"))
    finally:
        remove(spark, root)


def _rarity(texts: DataFrame, k: int) -> bytes:
    """A level per slot of shingle hashes: in how many of the texts (item, text) its shingles occur, exactly below 16, then in steps.

    A fixed number of bytes, whatever the texts. Shingles of a slot share a level, so a common one may
    lend its level to a rare one; a level of 1 says that no other text has the shingle.
    """

    def count(batches):
        slots = np.zeros(SLOTS, np.uint32)
        for batch in batches:
            for part in parts_of(batch.column(0)):
                np.add.at(slots, slot_of(shingle_sets(part, k)[1]), np.uint32(1))
        each = [x.tobytes() if x.any() else None for x in slots.reshape(-1, CHUNK)]
        yield pa.RecordBatch.from_pylist([{"chunk": c, "counts": x} for c, x in enumerate(each) if x], pa.schema({"chunk": pa.int32(), "counts": pa.binary()}))

    def levels(rows: pa.Table) -> pa.Table:
        total = np.zeros(CHUNK, np.uint64)
        for x in rows.column("counts"):
            total += np.frombuffer(x.as_py(), np.uint32)
        steps = 16 + np.floor(4 * np.log2(np.maximum(total, 16) / 16))
        return pa.table({"chunk": rows.column("chunk").slice(0, 1), "levels": [np.where(total < 16, total, steps).astype(np.uint8).tobytes()]})

    counted = texts.select("text").mapInArrow(count, "chunk int, counts binary")
    found = {r.chunk: r.levels for r in counted.groupBy("chunk").applyInArrow(levels, "chunk int, levels binary").collect()}
    return b"".join(found.get(c, bytes(CHUNK)) for c in range(SLOTS // CHUNK))


def _prefixes(texts: DataFrame, rarity, k: int, threshold: float) -> DataFrame:
    """item, cls, n, skip, s: per text (item, cls, text) with shingles the first of them in the order of rarity, after ``skip`` that no other text has."""
    kinds = {f.name: f for f in texts.schema}
    schema = StructType([kinds["item"], kinds["cls"]]).add("n", IntegerType()).add("skip", IntegerType()).add("s", ArrayType(LongType()))
    within = _within(threshold)

    def take(batches):
        level_of = np.frombuffer(rarity.value, np.uint8)
        for batch in batches:
            at = 0
            for part in parts_of(batch.column(2)):
                doc, s = shingle_sets(part, k)
                n = np.bincount(doc, minlength=len(part))
                level = level_of[slot_of(s)]
                order = order_of(doc, s, level)
                doc, s, level = doc[order], s[order], level[order]
                place = np.arange(len(doc)) - (np.cumsum(n) - n)[doc] + 1
                first = place <= (n - np.ceil(n * within) + 1)[doc]
                skip = np.bincount(doc[level <= 1], minlength=len(part))
                kept = first & (level > 1)
                size = np.bincount(doc[kept], minlength=len(part))
                has = np.flatnonzero(size)
                lists = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(size[has])]).astype(np.int32), s[kept].view(np.int64))
                own = batch.slice(at, len(part)).take(pa.array(has))
                yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), pa.array(n[has], pa.int32()), pa.array(skip[has], pa.int32()), lists], ["item", "cls", "n", "skip", "s"])
                at += len(part)

    return texts.select("item", "cls", "text").mapInArrow(take, schema)


def _shared(pairs: DataFrame, k: int) -> DataFrame:
    """a, b, sa, sb, shared: how many distinct shingles the texts ta and tb of each pair have, and share."""
    kinds = {f.name: f for f in pairs.schema}
    schema = StructType([kinds["a"], kinds["b"]]).add("sa", IntegerType()).add("sb", IntegerType()).add("shared", IntegerType())

    def take(batches):
        for batch in batches:
            at = 0
            for part in parts_of(batch.column(2)):
                other = batch.column(3).slice(at, len(part)).cast(pa.large_string())
                (x, s), (y, t) = shingle_sets(part, k), shingle_sets(other, k)
                doc, both = np.concatenate([x, y]), np.concatenate([s, t])
                order = order_of(doc, both)
                doc, both = doc[order], both[order]
                twice = (doc[1:] == doc[:-1]) & (both[1:] == both[:-1])
                counts = [pa.array(np.bincount(d, minlength=len(part)), pa.int32()) for d in (x, y, doc[1:][twice])]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(part)), batch.column(1).slice(at, len(part)), *counts], schema.names)
                at += len(part)

    return pairs.select("a", "b", "ta", "tb").mapInArrow(take, schema)


def _within(threshold: float) -> float:
    """The threshold less what rounding may take from a similarity that reaches it."""
    return threshold - 2e-9


def _meeting(threshold: float, x: str, y: str, places: tuple[str, str]) -> tuple[Column, Column]:
    """Whether a shared shingle counts for a pair of ``x`` and ``y`` shingles, and how many that count the pair must share.

    Similar texts share at least o shingles. By the order of rarity, after the m-th shared one there
    are at most the rest of either text, so its places leave o - m or more; that holds for the first m
    shared ones, which lie within both prefixes as long as m is not above o less the shorter rest, plus 1.
    """
    within = _within(threshold)
    n = F.col(x) + F.col(y)
    o = F.ceil(n * (within / (1 + threshold)))
    rest = F.greatest(F.ceil(F.col(x) * within), F.ceil(F.col(y) * within))
    least = F.greatest(F.lit(1), F.least(o - rest + 1, F.lit(1) + F.floor(n / 100)))
    fits = (F.col(x) >= F.col(y) * within) & (F.col(y) >= F.col(x) * within)
    return fits & (F.least(F.col(x) - F.col(places[0]), F.col(y) - F.col(places[1])) + least >= o), least


def _similar(pairs: DataFrame, rows: DataFrame, chosen: DataFrame, root: str, k: int, threshold: float) -> DataFrame:
    """The ``pairs`` (a, b) whose shingle sets are similar enough; only their texts are taken apart again.

    Texts are moved, not their shingles, which take several times their space.
    """
    asked = stored(pairs.select(F.explode(F.array("a", "b")).alias("item")).distinct().join(chosen, "item"), f"{root}/asked")
    looked = rows.join(F.broadcast(asked), ["item", "cls"], "left_semi") if asked.count() <= BROADCAST_ASKED else rows
    for x in ("a", "b"):
        pairs = pairs.join(asked.withColumnsRenamed({"item": x, "cls": f"c{x}"}), x)
    for x in ("a", "b"):
        pairs = pairs.join(looked, (F.col(x) == F.col("item")) & (F.col(f"c{x}") == F.col("cls"))).drop("item", "cls").withColumnRenamed("text", f"t{x}")
    found = _shared(pairs, k).filter(F.col("shared") / (F.col("sa") + F.col("sb") - F.col("shared")) >= threshold - 1e-9)
    return stored(found.select("a", "b").distinct(), f"{root}/similar")


def near_duplicates(df: DataFrame, item: str, text: str, k: int = 5, threshold: float = 0.8, paired: int = PAIRED_TEXTS) -> DataFrame:
    """item, class_id: texts connected by a Jaccard similarity of their ``k``-word shingles of ``threshold`` or more, under the least item.

    Exact copies are found by hash and stand for each other; only the least item's text is compared,
    and texts are never shuffled for that. Prefix filter: the shingles of a text are ordered by
    rarity, and two texts can only be similar enough if they share one of their first
    n - ceil(threshold n) + 1, at places that leave enough others to share, and the more of these the
    longer they are. The order is the same for all texts, and any such order gives the same classes,
    so rarity is counted in a table of fixed size.

    Of texts that share such a shingle all are paired, as long as they are not more than ``paired``.
    Beyond it they are first compared with the least one of about their length only, and connected
    ones need no more comparison; then those of different classes are paired. So a group of m texts
    that resemble each other costs m comparisons, and no link that would connect two classes is lost.

    Texts shorter than ``k`` words have no shingles and are similar to exact copies only; null
    texts have no row; repeated items count once.
    """
    spark = df.sparkSession
    root = scratch_path(spark, "near")
    try:
        rows = df.filter(F.col(text).isNotNull()).select(F.col(item).alias("item"), F.unhex(F.sha2(text, 256)).alias("cls"), F.lower(text).alias("text"))
        keyed = stored(rows.groupBy("item", "cls").agg(F.count("*").alias("rows")), f"{root}/keyed")
        first = stored(keyed.groupBy("cls").agg(F.min("item").alias("representative")), f"{root}/first")
        members = durable(keyed.join(first, "cls").select("item", "representative"))
        # An item with several texts is compared by one of them.
        chosen = stored(first.groupBy(F.col("representative").alias("item")).agg(F.min("cls").alias("cls")), f"{root}/chosen")
        copies = stored(keyed.join(chosen, ["item", "cls"], "left_anti").select("item", "cls"), f"{root}/copies")
        few = copies.count() <= BROADCAST_ASKED
        rows = rows.join(F.broadcast(copies), ["item", "cls"], "left_anti") if few else rows
        rarity = spark.sparkContext.broadcast(_rarity(rows, k))
        whole = _prefixes(rows, rarity, k, threshold)
        whole = whole if few else whole.join(chosen, ["item", "cls"], "left_semi")
        whole = whole if keyed.filter("rows > 1").isEmpty() else whole.dropDuplicates(["item"])
        prefix = stored(whole.select("item", "n", "skip", F.posexplode("s").alias("i", "h")).select("h", "item", "n", (F.col("skip") + F.col("i") + 1).alias("place")), f"{root}/prefix")
        rarity.destroy()
        remove(spark, f"{root}/keyed")
        remove(spark, f"{root}/first")
        pairs, near = _pairs(prefix, rows, chosen, root, k, threshold, paired)
        remove(spark, f"{root}/prefix")
        similar = _similar(pairs, rows, chosen, f"{root}/across", k, threshold)
        found = components(near.unionByName(similar) if near else similar)
        return members.join(found.select(F.col("item").alias("representative"), "c"), "representative", "left").select("item", F.coalesce("c", "representative").alias("class_id"))
    finally:
        remove(spark, root)


def _pairs(prefix: DataFrame, rows: DataFrame, chosen: DataFrame, root: str, k: int, threshold: float, paired: int) -> tuple[DataFrame, DataFrame | None]:
    """The pairs (a, b) left to compare, and those found similar before, where more than ``paired`` texts share a shingle."""
    side = lambda d, x: d.select("h", F.col("item").alias(x), F.col("n").alias(f"n{x}"), F.col("place").alias(f"p{x}"), *[F.col(c).alias(f"{c}{x}") for c in ("c", "most") if c in d.columns])
    meets, least = _meeting(threshold, "nx", "ny", ("px", "py"))
    listed = lambda d: d.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), least.alias("least"))
    heavy = stored(prefix.groupBy("h").count().filter(F.col("count") > paired).select("h"), f"{root}/heavy")
    near = None
    if heavy.isEmpty():
        met = listed(side(prefix, "x").join(side(prefix, "y"), "h").filter((F.col("x") < F.col("y")) & meets))
    else:
        light = prefix.join(heavy, "h", "left_anti")
        met = listed(side(light, "x").join(side(light, "y"), "h").filter((F.col("x") < F.col("y")) & meets))
        crowd = stored(prefix.join(heavy, "h", "left_semi"), f"{root}/crowd")
        banded = crowd.withColumn("band", F.floor(F.ln("n") / F.ln(F.lit(1 / threshold))) if threshold < 1 else F.col("n"))
        lead = banded.groupBy("h", "band").agg(F.min(F.struct("item", "n", "place")).alias("m")).select("h", "band", F.col("m.item").alias("x"), F.col("m.n").alias("nx"), F.col("m.place").alias("px"))
        stars = banded.withColumnsRenamed({"item": "y", "n": "ny", "place": "py"}).join(lead, ["h", "band"]).filter((F.col("x") != F.col("y")) & meets)
        near = _similar(stored(stars.select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(), f"{root}/stars"), rows, chosen, f"{root}/near", k, threshold)
        placed = stored(crowd.join(components(near), "item", "left").select("h", "item", "n", "place", F.coalesce("c", "item").alias("c")), f"{root}/placed")
        # Where texts of several classes share a shingle, all but its largest class are compared with the others.
        sizes = placed.groupBy("h", "c").agg(F.count("*").alias("m"))
        mixed = sizes.groupBy("h").agg(F.max_by("c", F.struct("m", "c")).alias("most"), F.count("*").alias("classes")).filter("classes > 1").select("h", "most")
        open_ = stored(placed.join(mixed, "h"), f"{root}/open")
        once = (F.col("cx") < F.col("cy")) | (F.col("cy") == F.col("mosty"))
        met = met.unionByName(listed(side(open_.filter("c <> most"), "x").join(side(open_, "y"), "h").filter((F.col("cx") != F.col("cy")) & once & meets)))
    counted = met.groupBy("a", "b").agg(F.count("*").alias("k"), F.max("least").alias("least"))
    return stored(counted.filter("k >= least").select("a", "b"), f"{root}/pairs"), near


def roots(classes: DataFrame, order: DataFrame) -> DataFrame:
    """item, dup_of: the earliest item of each class by ``order`` (item, at; a null is last, equal times: the lesser item), null for itself."""
    placed = classes.join(order, "item", "left")
    earliest = F.min(F.struct(F.col("at").isNull().alias("late"), "at", "item"))
    first = placed.groupBy("class_id").agg(earliest.alias("m")).select("class_id", F.col("m.item").alias("root"))
    return classes.join(first, "class_id").select("item", F.when(F.col("item") != F.col("root"), F.col("root")).alias("dup_of"))
