"""Mixing sources to target shares of tokens along a curriculum.

Each source has a weight schedule over the training run t in [0, 1]: its target share, tilted
so that it rises or falls linearly; at every t the weights add up to one, and each integrates
to its target share. The integral is the source's cumulative token demand. Texts of a source
come in a random order; a text's position is where the demand reaches the text's cumulative
tokens, found by inverting the integral. Sorting all texts by position, over ranges, gives the
training order.

The total is as large as the scarcest source allows at its target share and cap of repeats.
Full passes over a source take every text once; the last, partial pass takes texts in random
order up to the demand, and then smaller ones into the remaining gap.

Defined results: a text counts once however many documents hold it, and belongs to the listed
source with the least text that has it, so that no text occurs more often than its source's
cap; null and empty texts and unlisted sources are not used; a listed source without text gets
nothing, and the others share the total in proportion; repeated ids count once; targets that
are null or not positive count as zero.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.skew import prefix_sums
from tidemark.session import durable

#: Per-source numbers are joined by broadcast up to so many listed sources (about 1 MB), and by key beyond.
BROADCAST_SOURCES = 10_000
#: Texts per piece of a source's running sum.
SHARD_TEXTS = 100_000
#: Passes that fill the gap below the demand with smaller texts.
FILL_PASSES = 3
#: The part of its demand and of its target share that a source must reach to be reported as met.
MET = 0.99


@dataclass(frozen=True)
class Share:
    """One source: ``weight`` of the total, ``slope`` of its schedule, whole passes and the tokens of the last pass."""

    source: str
    target: float
    weight: float
    slope: float
    supply: int
    texts: int
    max_repeats: int
    demand: int
    passes: int
    rest: int


def _with_numbers(df: DataFrame, rows: list[tuple], names: str) -> DataFrame:
    """``df`` with numbers of its rows' sources: ``rows`` of (source, numbers...), ``names`` the columns' types; rows of other sources are dropped."""
    numbers = df.sparkSession.createDataFrame(rows, f"source string, {names}")
    return df.join(F.broadcast(numbers) if len(rows) <= BROADCAST_SOURCES else numbers, "source")


def distinct_texts(docs: DataFrame, targets: dict[str, tuple[float, int]]) -> DataFrame:
    """id, source, tokens, copies: one row per distinct text of the listed sources, at the source that has least text.

    ``docs``: id, source, hash (of the text), tokens.
    """
    held = _with_numbers(docs.filter("tokens > 0 and id is not null").select("id", "source", "hash", "tokens"), [(s, 0) for s in targets], "listed int").drop("listed")
    supply = held.groupBy("source").agg(F.sum("tokens").alias("n")).collect()  # a row per listed source
    ranks = [(r["source"], i) for i, r in enumerate(sorted(supply, key=lambda r: (r["n"], r["source"])))]
    ranked = _with_numbers(held, ranks, "rank int")
    first = ranked.groupBy("hash").agg(F.min(F.struct("rank", "id", "source", "tokens")).alias("t"), F.count("*").alias("copies"))
    return first.select("t.id", "t.source", "t.tokens", "copies")


def plan_shares(supply: dict[str, tuple[int, int, float]], targets: dict[str, tuple[float, int]], tilt: float, total: int | None) -> list[Share]:
    """Demand of every listed source. ``supply``: tokens, texts, mean tokens; ``targets``: share, most repeats.

    Sources of short texts come early and those of long ones late, by ``tilt`` in [0, 1).
    """
    wanted = {s: (max(float(w or 0), 0.0), max(int(r or 0), 0)) for s, (w, r) in targets.items()}
    live = {s: w for s, (w, r) in wanted.items() if w > 0 and r > 0 and supply.get(s, (0, 0, 0.0))[0] > 0}
    scale = sum(live.values())
    weight = {s: w / scale for s, w in live.items()}
    if not weight:
        return [Share(s, w, 0.0, 0.0, *supply.get(s, (0, 0, 0.0))[:2], r, 0, 0, 0) for s, (w, r) in wanted.items()]
    most = min(supply[s][0] * wanted[s][1] / weight[s] for s in weight)
    total = int(most) if total is None else min(int(total), int(most))
    order = sorted(weight, key=lambda s: (supply[s][2], s))
    raw = {s: tilt * (1 - 2 * i / max(len(order) - 1, 1)) for i, s in enumerate(order)}
    mean = sum(weight[s] * raw[s] for s in order)
    slope = {s: raw[s] - mean for s in order}
    top = max(abs(a) for a in slope.values())
    if top > 0.95:
        slope = {s: a * 0.95 / top for s, a in slope.items()}
    out = []
    for s, (w, r) in wanted.items():
        tokens, texts, _ = supply.get(s, (0, 0, 0.0))
        demand = min(int(total * weight.get(s, 0.0)), tokens * r)
        passes = demand // tokens if tokens else 0
        out.append(Share(s, w, weight.get(s, 0.0), slope.get(s, 0.0), tokens, texts, r, demand, passes, demand - passes * tokens))
    return out


def _pieces(texts: int) -> int:
    return max(1, -(-texts // SHARD_TEXTS))


def _partial_pass(texts: DataFrame, shares: list[Share], seed: int) -> DataFrame:
    """The texts of each source's last pass: a random prefix within the demand, then smaller texts into the gap."""
    u = (F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 40)) / float(1 << 40)).alias("u")
    pieces = {s.source: _pieces(s.texts) for s in shares}
    gap = {s.source: s.rest for s in shares if s.rest > 0}
    pool, chosen = texts, None
    for k in range(FILL_PASSES):
        left = [(s, n, pieces[s]) for s, n in gap.items() if n > 0]
        if not left:
            break
        fits = _with_numbers(pool.select("id", "source", "tokens", u), left, "room bigint, pieces int").filter("tokens <= room").withColumn("_piece", F.floor(F.col("u") * F.col("pieces")))
        sums = prefix_sums(fits, ["source"], ["u", "id"], "tokens", "upto", "_piece")
        took = durable(sums.filter("upto <= room").select("id", "source", "tokens"))
        for r in took.groupBy("source").agg(F.sum("tokens").alias("n")).collect():  # a row per listed source
            gap[r["source"]] -= r["n"]
        chosen = took if chosen is None else chosen.unionByName(took)
        if k + 1 < FILL_PASSES:
            pool = durable(pool.select("id", "source", "tokens").join(took.select("id"), "id", "left_anti"))
    return chosen if chosen is not None else texts.limit(0).select("id", "source", "tokens")


@dataclass(frozen=True)
class Mixture:
    """The plan and the placed texts: ``placed`` has position, source, id, copy, tokens."""

    shares: list[Share]
    placed: DataFrame


def mix_sources(docs: DataFrame, targets: dict[str, tuple[float, int]], tilt: float = 0.6, total: int | None = None, seed: int = 7) -> Mixture:
    """Place texts of ``docs`` (id, source, hash, tokens) so that sources meet ``targets`` (share, most repeats).

    Texts are known by their hash, so no text is kept, moved or written. The driver holds a few
    numbers per listed source: the list is a configuration.
    """
    texts = durable(distinct_texts(docs, targets))
    found = texts.groupBy("source").agg(F.sum("tokens").alias("n"), F.count("*").alias("c"), F.avg("tokens").alias("m")).collect()  # a row per listed source
    shares = plan_shares({r["source"]: (r["n"], r["c"], r["m"]) for r in found}, targets, tilt, total)
    planned = _with_numbers(texts, [(s.source, s.passes, _pieces(s.texts)) for s in shares], "passes int, pieces int")
    whole = planned.filter("passes > 0").select("id", "source", "tokens", F.explode(F.sequence(F.lit(1), F.col("passes"))).alias("copy"), "pieces")
    last = _with_numbers(_partial_pass(texts, shares, seed), [(s.source, s.passes + 1, _pieces(s.texts)) for s in shares], "copy int, pieces int").select("id", "source", "tokens", "copy", "pieces")
    u = F.pmod(F.xxhash64("id", "copy", F.lit(seed)), F.lit(1 << 40)) / float(1 << 40)
    used = whole.unionByName(last).withColumn("u", u).withColumn("_piece", F.col("copy") * F.col("pieces") + F.floor(F.col("u") * F.col("pieces")))
    used = durable(prefix_sums(used, ["source"], ["copy", "u", "id"], "tokens", "upto", "_piece"))
    sums = {r["source"]: r["n"] for r in used.groupBy("source").agg(F.sum("tokens").alias("n")).collect()}  # a row per listed source
    placed = _with_numbers(used, [(s.source, float(max(sums.get(s.source, 1), 1)), s.slope) for s in shares], "total double, a double")
    share, a = (F.col("upto") - F.col("tokens") / 2) / F.col("total"), F.col("a")
    # The inverse of D(t) = (1 + a) t - a t^2, in a form that holds for a = 0.
    position = 2 * share / ((1 + a) + F.sqrt((1 + a) * (1 + a) - 4 * a * share))
    return Mixture(shares, placed.select(position.alias("position"), "source", "id", "copy", "tokens"))


def share_report(mixture: Mixture) -> DataFrame:
    """Per listed source: target and actual share, texts and tokens there and used, most repeats, and a note.

    The note is 'no text', 'not used' (texts, but none placed), 'short' (less than MET of the tokens
    wanted or of the target share) or 'met'.
    """
    per = mixture.placed.groupBy("source").agg(F.sum("tokens").alias("tokens_used"), F.countDistinct("id").alias("texts_used"), F.max("copy").alias("most_repeats"))
    total = mixture.placed.agg(F.sum("tokens")).first()[0] or 0
    rows = [(s.source, s.target, s.weight, s.max_repeats, s.texts, s.supply, s.demand) for s in mixture.shares]
    plan = mixture.placed.sparkSession.createDataFrame(rows, "source string, target_share double, feasible_share double, max_repeats int, texts bigint, tokens_available bigint, tokens_wanted bigint")
    filled = plan.join(per, "source", "left").fillna(0, ["tokens_used", "texts_used", "most_repeats"])
    shared = filled.withColumn("actual_share", F.col("tokens_used") / F.lit(float(max(total, 1))))
    short = (F.col("tokens_used") < MET * F.col("tokens_wanted")) | (F.col("actual_share") < MET * F.col("target_share") / F.lit(max(sum(s.target for s in mixture.shares), 1.0)))
    note = F.when(F.col("tokens_available") == 0, "no text").when(F.col("tokens_used") == 0, "not used").when(short, "short").otherwise("met")
    return shared.withColumn("note", note)
