"""Near duplicates on larger groups: what the driver holds, hot shingles, and the runs of words in Arrow batches."""

import itertools
import random
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.functions import shingle_sets
from tidemark.functions import text as tx
from tidemark.operators import dedupe
from tidemark.plans.catalog import all_queries
from tidemark.session import shared_root


def estimate(df):
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def classes_of(texts, threshold=0.8):
    """The least number of those that each text is connected to, from all pairs."""
    sets = [{tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for t in texts]
    root = list(range(len(texts)))
    for a, b in itertools.combinations(range(len(texts)), 2):
        same = sets[a] and sets[b] and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]) - 1e-9
        if (same or texts[a] == texts[b]) and root[a] != root[b]:
            low, high = sorted((root[a], root[b]))
            root = [low if r == high else r for r in root]
    return dict(enumerate(root))


def templated(seed, groups=12, each=12):
    """Texts of all lengths that share half of their sentences with others; some differ in a few words only."""
    rng = random.Random(seed)
    sentences = [" ".join(rng.choice("abcdefghijklmnopqrstuvwxyz") + str(rng.randint(0, 9)) for _ in range(8)) for _ in range(30)]
    texts = []
    for _ in range(groups):
        base = " ".join(rng.choice(sentences) for _ in range(rng.choice([1, 2, 5, 20, 40]))).split()
        for _ in range(each):
            other = list(base)
            for _ in range(rng.randint(0, 4)):
                other[rng.randrange(len(other))] = f"x{rng.randint(0, 5)}"
            texts.append(" ".join(other))
    return texts


def test_estimated_sizes_do_not_grow_by_rounds(spark):
    """Each round squared the estimate, a number that the driver keeps."""
    links = spark.createDataFrame([(i, i + 1) for i in range(200)], "a long, b long")
    found = dedupe.components(links)
    assert estimate(found) < 2**63 and {r.c for r in found.collect()} == {0}


def test_plan_of_classes_is_of_its_size(spark, sf_small):
    assert estimate(all_queries()["near_duplicate_classes"].build(spark, sf_small)) < 2**100


def test_plan_of_roots_is_of_its_size(spark, sf_small):
    roots = all_queries()["near_duplicate_roots"].build(spark, sf_small)
    assert estimate(roots) < 2**200
    named = {r.dup_of for r in roots.collect() if r.dup_of is not None}
    assert named and named <= {r.item for r in roots.filter("dup_of is null").collect()}


@pytest.mark.parametrize("threshold", [0.6, 0.8, 1.0])
def test_hot_shingles_give_the_same_classes(spark, threshold):
    texts = templated(int(10 * threshold))
    want = classes_of(texts, threshold)
    assert 1 < len(set(want.values())) < len(texts) - 10
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    for paired in (3, 1000):
        assert {r.item: r.class_id for r in dedupe.near_duplicates(df, "id", "text", threshold=threshold, paired=paired).collect()} == want, paired


def test_slots_only_order(spark, monkeypatch):
    """All shingles in a few slots: rarity says nothing, and the classes stay."""
    monkeypatch.setattr(dedupe, "_rarity", lambda texts, k: bytes([9]) * dedupe.SLOTS)
    texts = templated(3, 6)
    df = spark.createDataFrame([(str(1000 + i), t) for i, t in enumerate(texts)], "id string, text string")
    got = {int(r.item) - 1000: int(r.class_id) - 1000 for r in dedupe.near_duplicates(df, "id", "text").collect()}
    assert got == classes_of(texts)


def test_nothing_is_left_in_the_shared_folder(spark):
    folders = lambda: {p.name for p in Path(shared_root(spark).removeprefix("file:")).glob("tidemark-*")}
    before = folders()
    df = spark.createDataFrame([(1, "a b c d e f g"), (2, "a b c d e f g"), (3, None)], "id int, text string")
    assert sorted((r.item, r.class_id) for r in dedupe.near_duplicates(df, "id", "text").collect()) == [(1, 1), (2, 1)]
    assert folders() == before


def test_runs_of_words_as_in_the_expression(spark):
    texts = ["", "a b c d", "a b c d e", "A,b.C;d\te\nF", "é a b c d e é", "a b c d eé f g", "1 2 3 4 5 1 2 3 4 5 6", "x" * 40 + " b c d e " + "x" * 41 + " b c d e", "abcdefgh abcdefg abcdefghi a b", "a b c d e", " - ", "ab c d e f", "a bc d e f", "K b c d e İ f g h i j"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string").select("id", F.lower("text").alias("low"), tx.shingles("text", 5).alias("s"))
    found = df.orderBy("id").collect()
    array = pa.array(["skipped words before the slice begins"] + [r.low for r in found], pa.large_string()).slice(1)
    doc, s = shingle_sets.shingle_sets(array, 5)
    by = {}
    for d, h in zip(doc.tolist(), s.tolist(), strict=True):
        by.setdefault(d, set()).add(h)
    for a, b in itertools.combinations_with_replacement(range(len(texts)), 2):
        assert len(by.get(a, set()) & by.get(b, set())) == len(set(found[a].s) & set(found[b].s)), (texts[a], texts[b])
    assert [p.to_pylist() for p in shingle_sets.parts_of(pa.array(["a", "b"]))] == [["a", "b"]] and list(shingle_sets.parts_of(pa.array([], pa.string()))) == []


def test_parts_keep_order_and_texts(monkeypatch):
    monkeypatch.setattr(shingle_sets, "PART_BYTES", 10)
    texts = ["a" * n for n in (3, 30, 0, 5, 5, 1, 0)]
    parts = [p.to_pylist() for p in shingle_sets.parts_of(pa.array(["z", *texts]).slice(1))]
    assert parts == [["aaa"], ["a" * 30], ["", "aaaaa", "aaaaa"], ["a", ""]]


def test_order_where_leading_bits_are_equal():
    rng = np.random.default_rng(5)
    for docs, high in ((5, 2**10), (5, 2**64 - 1), (3_000_000, 4)):
        doc, s, level = rng.integers(0, docs, 2000), rng.integers(0, high, 2000, np.uint64), rng.integers(0, 256, 2000).astype(np.uint8)
        for by in ((doc, s), (doc, s, level)):
            rows = list(zip(*[x.tolist() for x in ([doc, s] if len(by) == 2 else [doc, level, s])], strict=True))
            assert [rows[i] for i in shingle_sets.order_of(*by)] == sorted(rows)
