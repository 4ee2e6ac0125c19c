"""Consensus labels on small inputs."""

import random

import pytest

from tidemark.llm import consensus


def test_consensus_beats_majority_with_bad_annotators(spark):
    rng = random.Random(11)
    good = {f"g{i}": 0.95 for i in range(3)} | {f"b{i}": 0.3 for i in range(5)} | {"rare": 0.95}
    data, truth = [], {}
    for item in range(600):
        truth[item] = rng.choice("yn")
        for a in rng.sample(sorted(good), 5):
            if a == "rare" and item > 20:
                continue
            said = truth[item] if rng.random() < good[a] else ("y" if truth[item] == "n" else "n")
            data.append((item, a, said))
    data += [(0, "adjudicated", "y" if truth[0] == "n" else "n"), (7000, "g0", None)]
    votes = spark.createDataFrame(data, "item long, annotator string, relevant string")
    fit = consensus.fit_consensus(votes, {"relevant": ["n", "y"]}, "adjudicated")
    got = {r.item: r for r in fit.answers().collect()}
    right = sum(got[i].answer == truth[i] for i in range(1, 600)) / 599
    majority = sum(max("ny", key=lambda v: sum(1 for it, _, s in data if it == i and s == v)) == truth[i] for i in range(1, 600)) / 599
    assert right > 0.93 and right > majority + 0.1
    assert got[0].answer != truth[0] and got[7000].votes == 0 and got[7000].support is None
    rel = {r.annotator: r.reliability for r in fit.reliability().collect()}
    assert min(rel["g0"], rel["g1"], rel["g2"]) > 0.85 > 0.5 > max(rel[f"b{i}"] for i in range(5))
    assert 0.6 < rel["rare"] <= 1


def test_consensus_of_nothing(spark):
    votes = spark.createDataFrame([], "item long, annotator string, relevant string")
    fit = consensus.fit_consensus(votes, {"relevant": ["n", "y"]}, "adjudicated")
    assert fit.answers().collect() == [] and fit.reliability().collect() == []
    alone = spark.createDataFrame([(1, "adjudicated", "y"), (2, "adjudicated", None)], votes.schema)
    got = {r.item: (r.answer, r.labelers) for r in consensus.fit_consensus(alone, {"relevant": ["n", "y"]}, "adjudicated").answers().collect()}
    assert got == {1: ("y", 0), 2: ("y", 0)}


def test_digamma():
    import numpy as np

    assert consensus.digamma(np.array([1.0, 0.5, 10.0])) == pytest.approx([-0.5772156649, -1.9635100260, 2.2517525890], abs=1e-8)


def crowd(spark, annotators=60, items=500, seed=5):
    rng = random.Random(seed)
    skill = {f"a{i:02}": rng.choice([0.95, 0.7, 0.3]) for i in range(annotators)}
    data, truth = [], {}
    for item in range(items):
        truth[item] = rng.choice("xyz")
        for a in rng.sample(sorted(skill), rng.choice([3, 4, 6])):
            data.append((item, a, truth[item] if rng.random() < skill[a] else rng.choice("xyz"), rng.choice(["n", "y", None])))
    data += [(0, "adjudicated", "z", None), (9000, "a01", None, None)]
    return spark.createDataFrame(data, "item long, annotator string, kind string, other string"), truth


def test_annotators_in_a_table_give_the_same_consensus(spark):
    """Beyond the bound on what the driver holds, answers and reliabilities are the same."""
    votes, _ = crowd(spark)
    options = {"kind": ["x", "y", "z"], "other": ["n", "y"]}
    small = consensus.fit_consensus(votes, options, "adjudicated", rounds=3, tolerance=0)
    large = consensus.fit_consensus(votes, options, "adjudicated", rounds=3, tolerance=0, held=10)
    assert isinstance(large.fitted, consensus.KeyedAnnotators) and isinstance(small.fitted, consensus.HeldAnnotators)
    a, b = ({(r.item, r.field): r for r in fit.answers().collect()} for fit in (small, large))
    assert a.keys() == b.keys() and len(a) == 2 * 501
    for k in a:
        assert (a[k].labelers, a[k].votes, a[k].support if a[k].answer == b[k].answer else None) == (b[k].labelers, b[k].votes, b[k].support if a[k].answer == b[k].answer else None)
        assert a[k].probability == pytest.approx(b[k].probability, abs=0.02)
    assert sum(a[k].answer == b[k].answer for k in a) >= 0.99 * len(a)
    ra, rb = ({(r.annotator, r.field): r for r in fit.reliability().collect()} for fit in (small, large))
    assert ra.keys() == rb.keys() and len(ra) == 120
    for k in ra:
        assert ra[k].votes == rb[k].votes and ra[k].reliability == pytest.approx(rb[k].reliability, abs=0.02)
