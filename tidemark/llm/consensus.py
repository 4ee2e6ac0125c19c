"""Consensus of several annotators by a community confusion model.

Annotators belong to a few types; a type has one confusion matrix, and an annotator's own
matrix is drawn around the type's. Variational updates alternate between the items' answer
probabilities, the annotators' types and the matrices. An annotator with few votes is pulled to
the type, one with many follows their own.

Items with the same votes are one pattern with a count, so a round passes over patterns. Up to
HELD_ANNOTATORS annotators, their matrices are held by the driver and sent to the tasks; beyond
that they stay in a table by annotator that votes are joined with, and the driver holds the
types' matrices only. Both ways are the same model with the same updates.

Defined results: rows with a null item or annotator are ignored, practice rows too; an
annotator's latest row per item counts (equal times: the larger id); an invalid answer is no
vote; an item without any valid vote for a field gets the answer that is most common overall.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import durable

#: Annotators whose matrices the driver holds: with 16 answers, 8 MB a field.
HELD_ANNOTATORS = 4096


def digamma(x: np.ndarray) -> np.ndarray:
    """The derivative of log gamma for positive x, by recurrence and asymptotic series."""
    x = np.asarray(x, dtype=float).copy()
    out = np.zeros_like(x)
    for _ in range(6):
        low = x < 6
        out -= np.where(low, 1 / x, 0)
        x = np.where(low, x + 1, x)
    f = 1 / (x * x)
    return out + np.log(x) - 0.5 / x - f * (1 / 12 - f * (1 / 120 - f / 252))


def annotator_ids(votes: DataFrame, settles: str) -> DataFrame:
    """annotator, a: a number per annotator in the order of their names."""
    names = votes.filter(F.col("annotator") != settles).select("annotator").distinct().orderBy("annotator")
    return durable(names.rdd.zipWithIndex().map(lambda x: (x[0][0], x[1])).toDF("annotator string, a long"))


def vote_lists(votes: DataFrame, answers: dict[str, list[str]], ids: DataFrame, settles: str) -> DataFrame:
    """item, field, labelers, settled, a, v: a row per item and field with its votes as sorted lists of numbers.

    ``labelers`` counts the item's annotators but for ``settles``; ``settled`` is that one's answer.
    """
    cases = F.array(*[F.struct(F.lit(f).alias("field"), F.try_element_at(F.create_map(*[F.lit(x) for i, o in enumerate(options) for x in (o, i)]), F.col(f)).alias("v")) for f, options in answers.items()])
    long = votes.join(ids, "annotator", "left").select("item", "annotator", "a", F.explode(cases).alias("c")).select("item", "annotator", "a", "c.field", "c.v")
    labeler = F.col("annotator") != settles
    voted = labeler & F.col("v").isNotNull()
    return long.groupBy("item", "field").agg(
        F.count(F.when(labeler, 1)).alias("labelers"),
        F.max(F.when(~labeler, F.col("v"))).alias("settled"),
        F.array_sort(F.collect_list(F.when(voted, F.struct("a", "v")))).alias("_pairs"),
    ).select("item", "field", "labelers", "settled", F.col("_pairs.a").alias("a"), F.col("_pairs.v").alias("v"))


# The model, in numbers


@dataclass
class Types:
    """What all annotators of a field share: expected log answers, type sizes, the types' matrices [type, truth, vote]."""

    log_truth: np.ndarray
    size: np.ndarray
    matrices: np.ndarray


def prior_matrix(k: int) -> np.ndarray:
    """Pseudo-counts of a type's matrix: right answers more likely than wrong ones."""
    return np.full((k, k), 0.3 / k) + np.eye(k) * 1.5


def first_types(right: np.ndarray, cuts: np.ndarray, types: int) -> np.ndarray:
    """Starting responsibilities [annotator, type] by how often an annotator is right: the best in the first type."""
    r = np.full((len(right), types), 0.1 / types)
    r[np.arange(len(right)), (right[:, None] < cuts[None, :]).sum(axis=1)] += 0.9
    return r / r.sum(axis=1, keepdims=True)


def next_types(votes: np.ndarray, old: Types) -> np.ndarray:
    """Responsibilities from expected counts [annotator, truth, vote] and the types' matrices."""
    log_type = digamma(old.matrices) - digamma(old.matrices.sum(axis=2, keepdims=True))
    log = np.einsum("akv,mkv->am", votes, log_type) + np.log(old.size + 1e-9)
    r = np.exp(log - log.max(axis=1, keepdims=True)) if len(log) else log
    return r / np.maximum(r.sum(axis=1, keepdims=True), 1e-300)


def own_matrices(votes: np.ndarray, r: np.ndarray, matrices: np.ndarray, strength: float) -> np.ndarray:
    """Pseudo-counts of the annotators' own matrices, drawn around their types'."""
    return strength * np.einsum("am,mkv->akv", r, matrices / matrices.sum(axis=2, keepdims=True)) + votes


def expected_log(counts: np.ndarray) -> np.ndarray:
    """Expected logarithms of the rows of Dirichlet matrices."""
    return digamma(np.maximum(counts, 1e-6)) - digamma(counts.sum(axis=-1, keepdims=True))


def rightness(votes: np.ndarray) -> np.ndarray:
    """The share of an annotator's votes that equal the expected truth."""
    return np.trace(votes, axis1=1, axis2=2) / np.maximum(votes.sum(axis=(1, 2)), 1e-9)


# Annotators held by the driver


@dataclass
class FieldModel:
    """Parameters of one field; ``log_votes[a, truth, vote]`` are expected logarithms, ``own`` the matrices' counts."""

    types: Types
    r: np.ndarray
    own: np.ndarray
    log_votes: np.ndarray


def _posterior(pdf: pd.DataFrame, model: FieldModel | None, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Answer probabilities per row; and row, annotator and answer of every vote."""
    counts = pdf["a"].map(len).to_numpy()
    row = np.repeat(np.arange(len(pdf)), counts)
    a = np.concatenate([*pdf["a"], np.empty(0, int)]).astype(int)
    v = np.concatenate([*pdf["v"], np.empty(0, int)]).astype(int)
    if model is None:
        q = np.full((len(pdf), size), 0.01)
        np.add.at(q, (row, v), 1.0)
    else:
        log = np.tile(model.types.log_truth, (len(pdf), 1))
        np.add.at(log, row, model.log_votes[a, :, v])
        q = np.exp(log - log.max(axis=1, keepdims=True))
    q /= q.sum(axis=1, keepdims=True)
    settled = pdf["settled"].to_numpy(dtype=float, na_value=np.nan)
    fixed = ~np.isnan(settled)
    q[fixed] = 0
    q[np.flatnonzero(fixed), settled[fixed].astype(int)] = 1
    return q, row, a, v


def _expected_counts(patterns: DataFrame, models: dict[str, FieldModel | None], sizes: dict[str, int], annotators: int) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Per field: expected counts [annotator, truth, vote], and expected answers [truth]."""

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        votes = {f: np.zeros((annotators, k, k)) for f, k in sizes.items()}
        truth = {f: np.zeros(k) for f, k in sizes.items()}
        for pdf in batches:
            for f, part in pdf.groupby("field"):
                q, row, a, v = _posterior(part, models[f], sizes[f])
                q = q * part["n"].to_numpy(dtype=float)[:, None]
                truth[f] += q.sum(axis=0)
                np.add.at(votes[f].transpose(0, 2, 1), (a, v), q[row])
        for f, k in sizes.items():
            a, t, v = np.nonzero(votes[f])
            yield pd.DataFrame({"field": f, "a": np.r_[a, np.full(k, -1)], "t": np.r_[t, np.arange(k)], "v": np.r_[v, np.zeros(k, int)], "n": np.r_[votes[f][a, t, v], truth[f]]})

    sums = patterns.mapInPandas(partial, "field string, a int, t int, v int, n double").groupBy("field", "a", "t", "v").agg(F.sum("n").alias("n")).toPandas()
    out = {}
    for f, k in sizes.items():
        votes, truth = np.zeros((annotators, k, k)), np.zeros(k)
        part = sums[sums["field"] == f]
        own = part["a"].to_numpy() >= 0
        votes[part["a"][own], part["t"][own], part["v"][own]] = part["n"][own]
        truth[part["t"][~own]] = part["n"][~own]
        out[f] = votes, truth
    return out


def update_field(votes: np.ndarray, truth: np.ndarray, old: FieldModel | None, types: int, strength: float) -> FieldModel:
    """One variational update of types, shared matrices and annotators' matrices from expected counts."""
    if old is None:
        right = rightness(votes)
        cuts = np.quantile(right, [1 - (j + 1) / types for j in range(types - 1)]) if len(right) else np.zeros(types - 1)
        r = first_types(right, cuts, types)
    else:
        r = next_types(votes, old.types)
    matrices = prior_matrix(len(truth)) + np.einsum("am,akv->mkv", r, votes)
    own = own_matrices(votes, r, matrices, strength)
    size = r.mean(axis=0) if len(r) else np.full(types, 1 / types)
    return FieldModel(Types(digamma(truth + 1.0) - digamma((truth + 1.0).sum()), size, matrices), r, own, expected_log(own))


class HeldAnnotators:
    """The updates with all annotators' matrices on the driver: expected counts per annotator come to it each round."""

    def __init__(self, patterns: DataFrame, sizes: dict[str, int], annotators: int, types: int, strength: float) -> None:
        self.patterns, self.sizes, self.annotators, self.kinds, self.strength = patterns, sizes, annotators, types, strength
        self.models: dict[str, FieldModel | None] = dict.fromkeys(sizes)
        self.counts: dict[str, tuple[np.ndarray, np.ndarray]] = {}

    def step(self) -> dict[str, np.ndarray]:
        """One round; returns the expected counts that convergence is judged by."""
        self.counts = _expected_counts(self.patterns, self.models, self.sizes, self.annotators)
        self.models = {f: update_field(*self.counts[f], self.models[f], self.kinds, self.strength) for f in self.sizes}
        return {f: np.r_[self.counts[f][0].ravel(), self.counts[f][1]] for f in self.sizes}

    def posteriors(self, lists: DataFrame) -> DataFrame:
        """item, field, labelers, v, q: the probability of every answer."""
        models, sizes = self.models, self.sizes

        def decide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for f, part in pdf.groupby("field"):
                    q, *_ = _posterior(part, models[f], sizes[f])
                    yield pd.DataFrame({"item": part["item"], "field": f, "labelers": part["labelers"], "v": part["v"], "q": list(q)})

        kind = lists.schema["item"].dataType.simpleString()
        return lists.select("item", "field", "labelers", "settled", "a", "v").mapInPandas(decide, f"item {kind}, field string, labelers bigint, v array<int>, q array<double>")

    def annotators_of(self, spark) -> DataFrame:
        """a, field, votes, raw, reliability, type."""
        rows = []
        for f, m in self.models.items():
            rows += _reliability(f, np.arange(self.annotators), self.counts[f][0], self.counts[f][1], m.own, m.r).itertuples(index=False, name=None)
        return spark.createDataFrame([tuple(x.item() if hasattr(x, "item") else x for x in r) for r in rows], "field string, a bigint, votes bigint, raw double, reliability double, type int")


def _reliability(field: str, a: np.ndarray, votes: np.ndarray, truth: np.ndarray, own: np.ndarray, r: np.ndarray) -> pd.DataFrame:
    share = truth / max(truth.sum(), 1e-9)
    n = votes.sum(axis=(1, 2))
    matrices = own / own.sum(axis=2, keepdims=True)
    expected = np.einsum("k,akk->a", share, matrices)
    raw = np.trace(votes, axis1=1, axis2=2) / np.maximum(n, 1e-9)
    out = pd.DataFrame({"field": field, "a": a, "votes": np.round(n).astype(int), "raw": raw, "reliability": expected, "type": r.argmax(axis=1).astype(int) if len(r) else []})
    return out[out["votes"] > 0]


# Annotators in a table


class KeyedAnnotators:
    """The same updates with annotators in tables by (field, a): votes are joined with their parameters.

    Per round, sums over types reach the driver: types x answers², whatever the number of annotators.
    """

    def __init__(self, patterns: DataFrame, sizes: dict[str, int], types: int, strength: float) -> None:
        self.sizes, self.kinds, self.strength, self.width = sizes, types, strength, max(sizes.values(), default=0)
        self.spark = patterns.sparkSession
        self.patterns = durable(patterns.withColumn("p", F.monotonically_increasing_id()))
        self.types: dict[str, Types] | None = None
        self.truth: dict[str, np.ndarray] = {}
        self.params: DataFrame | None = None
        self.matrix: DataFrame | None = None

    def _long(self, df: DataFrame, key: list[str]) -> DataFrame:
        return df.select(*key, "field", "settled", F.explode_outer(F.arrays_zip("a", "v")).alias("_s")).select(*key, "field", "settled", F.col("_s.a").alias("a"), F.col("_s.v").alias("v"))

    def _probabilities(self, df: DataFrame, key: list[str]) -> DataFrame:
        """``key``, field, q of rows with vote lists: sums of the votes' expected logarithms, normalised."""
        long, options = self._long(df, key), range(self.width)
        if self.types is None:
            logs = long.groupBy(*key, "field", "settled").agg(*[F.sum(F.when(F.col("v") == t, 1.0).otherwise(0.0)).alias(f"l{t}") for t in options])
            weight = [F.when(F.col("k") > t, F.col(f"l{t}") + 0.01).otherwise(0.0) for t in options]
        else:
            known = long.join(self.params, ["field", "a", "v"], "left")
            logs = known.groupBy(*key, "field", "settled").agg(*[F.coalesce(F.sum(F.get("log", F.lit(t))), F.lit(0.0)).alias(f"l{t}") for t in options])
            weight = [F.when(F.col("k") > t, F.exp(F.col(f"l{t}") + F.get("log_truth", F.lit(t)) - F.col("top"))).otherwise(0.0) for t in options]
        shared = self.spark.createDataFrame([(f, k, (self.types[f].log_truth.tolist() if self.types else [0.0] * k)) for f, k in self.sizes.items()], "field string, k int, log_truth array<double>")
        logs = logs.join(F.broadcast(shared), "field")  # a row per field
        logs = logs.withColumn("top", F.greatest(*[F.when(F.col("k") > t, F.col(f"l{t}") + F.get("log_truth", F.lit(t))) for t in options], F.lit(-1e300)))
        logs = logs.withColumn("w", F.array(*weight))
        total = F.aggregate("w", F.lit(0.0), lambda x, y: x + y)
        one = F.transform(F.sequence(F.lit(0), F.lit(self.width - 1)), lambda t: F.when(t == F.col("settled"), 1.0).otherwise(0.0))
        return logs.select(*key, "field", F.when(F.col("settled").isNotNull(), one).otherwise(F.transform("w", lambda x: x / total)).alias("q"))

    def step(self) -> dict[str, np.ndarray]:
        """One round; returns the shared sums that convergence is judged by."""
        sizes, kinds, strength, options = self.sizes, self.kinds, self.strength, range(self.width)
        q = durable(self._probabilities(self.patterns, ["p", "n"]))
        sums = q.groupBy("field").agg(*[F.sum(F.get("q", F.lit(t)) * F.col("n")).alias(f"t{t}") for t in options]).collect()  # a row per field
        self.truth = {f: np.zeros(k) for f, k in sizes.items()} | {r["field"]: np.array([r[f"t{t}"] for t in range(sizes[r["field"]])]) for r in sums}
        votes = self._long(self.patterns, ["p"]).filter("a is not null").select("p", "field", "a", "v").join(q.select("p", "n", "q"), "p")
        cells = votes.groupBy("field", "a", "v").agg(F.array(*[F.sum(F.get("q", F.lit(t)) * F.col("n")) for t in options]).alias("c"))
        self.matrix = durable(cells.groupBy("field", "a").agg(F.collect_list(F.struct("v", "c")).alias("m")))
        old, cuts = self.types, {}
        if old is None:
            right = self.matrix.select("field", (F.aggregate("m", F.lit(0.0), lambda x, y: x + F.get(y["c"], y["v"])) / F.greatest(F.aggregate("m", F.lit(0.0), lambda x, y: x + F.aggregate(y["c"], F.lit(0.0), lambda s, z: s + z)), F.lit(1e-9))).alias("right"))
            found = right.groupBy("field").agg(F.percentile_approx("right", F.array(*[F.lit(1 - (j + 1) / kinds) for j in range(kinds - 1)]), 10000).alias("cuts")).collect() if kinds > 1 else []  # a row per field
            cuts = {r["field"]: np.array(r["cuts"]) for r in found}

        def shares(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for f, part in pdf.groupby("field"):
                    m = dense(part["m"], sizes[f])
                    r = first_types(rightness(m), cuts.get(f, np.zeros(kinds - 1)), kinds) if old is None else next_types(m, old[f])
                    yield pd.DataFrame({"field": f, "a": part["a"], "r": list(r), "m": part["m"]})

        self.shares = durable(self.matrix.select("field", "a", "m").mapInPandas(shares, "field string, a bigint, r array<double>, m array<struct<v:int,c:array<double>>>"))
        kind = self.shares.select("field", F.posexplode("r").alias("type", "r"), "m").select("field", "type", "r", F.explode("m").alias("x")).select("field", "type", "r", F.col("x.v").alias("v"), F.posexplode("x.c").alias("t", "c"))
        added = kind.groupBy("field", "type", "t", "v").agg(F.sum(F.col("r") * F.col("c")).alias("n")).collect()  # types x answers² numbers
        size = self.shares.groupBy("field").agg(*[F.avg(F.get("r", F.lit(j))).alias(f"s{j}") for j in range(kinds)]).collect()  # a row per field
        by_field = {r["field"]: np.array([r[f"s{j}"] for j in range(kinds)]) for r in size}
        matrices = {f: np.repeat(prior_matrix(k)[None], kinds, axis=0) for f, k in sizes.items()}
        for x in added:
            if x["t"] < sizes[x["field"]]:
                matrices[x["field"]][x["type"], x["t"], x["v"]] += x["n"]
        self.types = {f: Types(digamma(self.truth[f] + 1) - digamma((self.truth[f] + 1).sum()), by_field.get(f, np.full(kinds, 1 / kinds)), matrices[f]) for f in sizes}
        now = self.types

        def logs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for f, part in pdf.groupby("field"):
                    own = own_matrices(dense(part["m"], sizes[f]), np.stack(part["r"].to_numpy()), now[f].matrices, strength)
                    log = expected_log(own).transpose(0, 2, 1)  # [a, vote, truth]
                    k = sizes[f]
                    yield pd.DataFrame({"field": f, "a": np.repeat(part["a"].to_numpy(), k), "v": np.tile(np.arange(k), len(part)), "log": list(log.reshape(-1, k))})

        self.params = durable(self.shares.mapInPandas(logs, "field string, a bigint, v int, log array<double>"))
        return {f: np.r_[now[f].matrices.ravel(), self.truth[f]] for f in sizes}

    def posteriors(self, lists: DataFrame) -> DataFrame:
        """item, field, labelers, v, q: the probability of every answer."""
        q = self._probabilities(lists.select("item", "field", "settled", "a", "v"), ["item"])
        return lists.select("item", "field", "labelers", "v").join(q, ["item", "field"])

    def annotators_of(self, spark) -> DataFrame:
        """a, field, votes, raw, reliability, type."""
        now, truth, sizes, strength = self.types, self.truth, self.sizes, self.strength

        def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for f, part in pdf.groupby("field"):
                    m, r = dense(part["m"], sizes[f]), np.stack(part["r"].to_numpy())
                    yield _reliability(f, part["a"].to_numpy(), m, truth[f], own_matrices(m, r, now[f].matrices, strength), r)

        return self.shares.mapInPandas(rows, "field string, a bigint, votes bigint, raw double, reliability double, type int")


def dense(cells: pd.Series, k: int) -> np.ndarray:
    """Counts [annotator, truth, vote] from lists of (vote, counts per truth)."""
    out = np.zeros((len(cells), k, k))
    for i, own in enumerate(cells):
        for x in own:
            out[i, :, x["v"]] = np.asarray(x["c"])[:k]
    return out


@dataclass
class Consensus:
    """A fitted model: ``answers`` (item, field, labelers, answer, probability, votes, support, pair_agreement) and ``reliability``."""

    lists: DataFrame
    ids: DataFrame
    options: dict[str, list[str]]
    fitted: HeldAnnotators | KeyedAnnotators
    rounds: int

    def answers(self) -> DataFrame:
        """The best supported answer of every item and field, and how far its votes agree with it."""
        names = self.lists.sparkSession.createDataFrame([(f, o) for f, o in self.options.items()], "field string, options array<string>")
        q = self.fitted.posteriors(self.lists).join(F.broadcast(names), "field")  # a row per field
        best = F.array_position("q", F.array_max("q")).cast("int")
        n, same = F.size("v").cast("long"), F.filter("v", lambda x: x == F.col("_best") - 1)
        kinds = F.array_distinct("v")
        pairs = F.aggregate(kinds, F.lit(0).cast("long"), lambda s, x: s + F.size(F.filter("v", lambda y: y == x)).cast("long") * (F.size(F.filter("v", lambda y: y == x)) - 1))
        done = q.withColumn("_best", best)
        return done.select(
            "item", "field", "labelers", F.element_at("options", F.col("_best")).alias("answer"), F.element_at("q", F.col("_best")).alias("probability"), n.alias("votes"),
            F.when(n > 0, F.size(same) / n).alias("support"), F.when(n > 1, pairs / (n * (n - 1))).alias("pair_agreement"),
        )

    def reliability(self) -> DataFrame:
        """annotator, field, votes, raw (share equal to the consensus), reliability (expected, stabilised), type; of annotators with a valid vote."""
        return self.fitted.annotators_of(self.lists.sparkSession).join(self.ids, "a").select("annotator", "field", "votes", "raw", "reliability", "type")


def fit_consensus(votes: DataFrame, options: dict[str, list[str]], settles: str, types: int = 3, strength: float = 20.0, rounds: int = 15, tolerance: float = 1e-4, held: int = HELD_ANNOTATORS) -> Consensus:
    """Fit the model to ``votes`` (item, annotator, one column per field of ``options``).

    ``strength``: how many votes per answer the type's matrix weighs in an annotator's own.
    """
    ids = annotator_ids(votes, settles)
    annotators = ids.count()
    lists = durable(vote_lists(votes, options, F.broadcast(ids) if annotators <= held else ids, settles))
    patterns = durable(lists.groupBy("field", "settled", "a", "v").agg(F.count("*").alias("n")))
    sizes = {f: len(o) for f, o in options.items()}
    fitted = HeldAnnotators(patterns, sizes, annotators, types, strength) if annotators <= held else KeyedAnnotators(patterns, sizes, types, strength)
    before, done = None, 0
    for done in range(1, rounds + 1):  # noqa: B007
        now = fitted.step()
        if before is not None and max(np.abs(now[f] - before[f]).sum() / max(now[f].sum(), 1) for f in options) < tolerance:
            break
        before = now
    return Consensus(lists, ids, options, fitted, done)


def nominal_alpha(votes: DataFrame, fields: list[str], settles: str) -> DataFrame:
    """field, items, votes, observed, expected, alpha: Krippendorff's alpha over items with two votes or more."""
    cases = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("v")) for f in fields])
    long = votes.filter(F.col("annotator") != settles).select("item", F.explode(cases).alias("c")).select("item", "c.field", "c.v").filter("v is not null")
    cells = long.groupBy("item", "field", "v").agg(F.count("*").alias("n"))
    items = cells.groupBy("item", "field").agg(F.sum("n").alias("m"), F.sum(F.col("n") * (F.col("n") - 1)).alias("same")).filter("m > 1")
    shared = cells.join(items.select("item", "field"), ["item", "field"], "left_semi").groupBy("field", "v").agg(F.sum("n").alias("n"))
    chance = shared.groupBy("field").agg((F.sum(F.col("n") * (F.col("n") - 1)) / (F.sum("n") * (F.sum("n") - 1))).alias("expected"))
    seen = items.groupBy("field").agg(F.count("*").alias("items"), F.sum("m").alias("votes"), (F.sum(F.col("same") / (F.col("m") - 1)) / F.sum("m")).alias("observed"))
    alpha = F.when(F.col("expected") < 1, 1 - (1 - F.col("observed")) / (1 - F.col("expected")))
    return seen.join(chance, "field").select("field", "items", "votes", "observed", "expected", alpha.alias("alpha"))
