"""Filling fixed-capacity containers with texts under several limits at once.

Vector bin packing by the dot-product heuristic: an open container takes, among the items that
fit it, the one whose demands (tokens, segments, loss-bearing tokens) have the largest dot
product with what the container has left, each dimension weighted by the items' mean demand;
when nothing fits, it is closed and the next is opened.

Items are spread over blocks of bounded size by a hash, and each block is packed on its own, so
work grows with the data and no task with it. Containers that a block leaves poorly filled are
taken apart, and their items packed again in fewer, mixed blocks, for a fixed number of rounds.

Defined results: a text above the capacity is split into pieces, all full but the last, and no
other text is split; null and empty texts have no tokens and go into no container (status
'empty'); repeated rows of an id count once; a text at exactly the capacity fills a container.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.session import durable

#: Tokens per block, in capacities, and items per block at most on average.
BLOCK_CAPACITIES = 48
BLOCK_ITEMS = 2000
#: A container filled below this share is taken apart for the next round.
WELL_FILLED = 0.985


@dataclass(frozen=True)
class Limits:
    """What a container may hold besides ``capacity`` tokens: segments, and a share of loss-bearing tokens.

    ``tokens_per_segment``: a container of c tokens takes at most c / tokens_per_segment segments.
    ``loss_share``: at most this share of the capacity may bear loss.
    """

    tokens_per_segment: int = 16
    loss_share: float = 1.0

    def vector(self, capacity: int) -> np.ndarray:
        return np.array([capacity, max(1, capacity // self.tokens_per_segment), max(1, int(capacity * self.loss_share))], dtype=float)


def fill_containers(demands: np.ndarray, limits: np.ndarray) -> np.ndarray:
    """Container numbers, from 0, of items with ``demands`` (items x dimensions).

    Equal items are one type with a count. Types are in the order of their first demand, largest
    first, so those that fit a container's remaining space are a suffix, and ties of the dot
    product go to the larger item. An item beyond a limit in another dimension than the first
    still gets a container, of its own.
    """
    kinds, kind_of, counts = np.unique(-demands, axis=0, return_inverse=True, return_counts=True)
    unit = -kinds / limits
    members = np.split(np.argsort(kind_of.ravel(), kind="stable"), np.cumsum(counts)[:-1])
    weight = demands.mean(axis=0) / limits if len(demands) else np.ones(demands.shape[1])
    weighted, number = unit * weight, np.arange(len(unit))
    left_of, out = counts.copy(), np.zeros(len(demands), dtype=np.int64)
    keep, rest_dims, container, open_items, dead = -unit[:, 0], range(1, unit.shape[1]), 0, len(demands), 0
    while open_items:
        left, took = np.ones(unit.shape[1]), False
        while open_items:
            first = int(np.searchsorted(keep, -left[0] - 1e-12))
            score = weighted[first:] @ left
            for d in rest_dims:
                score[unit[first:, d] > left[d] + 1e-12] = -1.0
            k = first + int(score.argmax()) if len(score) else -1
            if k < 0 or score[k - first] < 0:
                if took:
                    break
                k = int(np.flatnonzero(left_of[number] > 0)[0])  # beyond a limit by itself
            kind = number[k]
            left_of[kind] -= 1
            out[members[kind][left_of[kind]]] = container
            left, took, open_items = left - unit[k], True, open_items - 1
            if not left_of[kind]:
                unit[k, -1] = np.inf  # never fits again
                weighted[k], dead = 0.0, dead + 1
                if dead > 64 and dead * 2 > len(number):
                    alive = left_of[number] > 0
                    unit, weighted, number, keep, dead = unit[alive], weighted[alive], number[alive], keep[alive], 0
        container += 1
    return out


def _packs(capacities: dict[str, int]) -> Column:
    return F.array(*[F.struct(F.lit(n).alias("pack"), F.lit(c).cast("int").alias("capacity")) for n, c in sorted(capacities.items())])


def split_items(docs: DataFrame, capacities: dict[str, int]) -> DataFrame:
    """pack, capacity, id, piece, tokens, loss: an item per text and pack, or several for a text above the capacity.

    ``docs``: id, tokens, prompt (tokens without loss, at the start).
    """
    rows = docs.select("id", "tokens", "prompt", F.explode(_packs(capacities)).alias("_k")).select("id", "tokens", "prompt", "_k.pack", "_k.capacity")
    pieces = F.greatest(F.ceil(F.col("tokens") / F.col("capacity")), F.lit(1)).cast("int")
    rows = rows.withColumn("piece", F.explode(F.sequence(F.lit(0), pieces - 1)))
    start = F.col("piece").cast("long") * F.col("capacity")
    size = F.least(F.col("capacity").cast("long"), F.col("tokens") - start)
    free = F.greatest(F.least(F.col("prompt") - start, size), F.lit(0))
    return rows.select("pack", "capacity", "id", "piece", size.alias("tokens"), (size - free).alias("loss"))


def _pack_round(items: DataFrame, capacities: dict[str, int], limits: Limits, seed: int) -> DataFrame:
    """``items`` with block and container, unique together within the round and pack."""
    loads = items.groupBy("pack").agg(F.sum("tokens").alias("t"), F.count("*").alias("n")).collect()  # a row per pack
    blocks = {r["pack"]: max(1, math.ceil(r["n"] / BLOCK_ITEMS), math.ceil(r["t"] / (capacities[r["pack"]] * BLOCK_CAPACITIES))) for r in loads}
    count = F.lit(1)
    for pack, n in blocks.items():
        count = F.when(F.col("pack") == pack, F.lit(n)).otherwise(count)
    placed = items.withColumn("block", F.pmod(F.xxhash64("id", "piece", F.lit(seed)), count))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["id", "piece"])
        demands = np.column_stack([pdf["tokens"], np.ones(len(pdf)), pdf["loss"]]).astype(float)
        pdf["container"] = fill_containers(demands, limits.vector(int(pdf["capacity"].iloc[0])))
        return pdf

    # As many tasks as blocks, up to the session's shuffle partitions: items are small, so sizes in bytes would leave too few.
    tasks = min(sum(blocks.values()) or 1, int(items.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    placed = placed.repartition(tasks, "pack", "block")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in placed.schema)
    return placed.groupBy("pack", "block").applyInPandas(pack, fields + ", container bigint")


def pack_texts(docs: DataFrame, capacities: dict[str, int], limits: Limits | None = None, rounds: int = 3) -> DataFrame:
    """pack, capacity, id, piece, tokens, loss, container, status of every text in every pack.

    ``docs``: id, tokens, prompt. ``capacities``: tokens by name, a handful; capacities below one
    token are errors. ``container`` is a text that is unique within its pack.
    """
    limits = limits or Limits()
    if any(c < 1 for c in capacities.values()):
        raise ValueError("a container holds at least one token")
    sized = docs.select("id", F.coalesce("tokens", F.lit(0)).cast("long").alias("tokens"), F.coalesce("prompt", F.lit(0)).cast("long").alias("prompt")).dropDuplicates(["id"])
    sized = durable(sized)
    items = split_items(sized.filter("tokens > 0"), capacities)
    done = [items.filter("tokens = capacity").withColumn("container", F.concat_ws("-", F.lit("full"), "id", "piece"))]
    rest = items.filter("tokens < capacity")
    for r in range(rounds):
        packed = durable(_pack_round(rest, capacities, limits, r))
        name = F.concat_ws("-", F.lit(f"r{r}"), "block", "container")
        if r + 1 == rounds:
            done.append(packed.select(*items.columns, name.alias("container")))
            break
        fill = packed.groupBy("pack", "block", "container").agg((F.sum("tokens") / F.max("capacity")).alias("_fill"))
        packed = packed.join(fill, ["pack", "block", "container"])
        done.append(packed.filter(F.col("_fill") >= WELL_FILLED).select(*items.columns, name.alias("container")))
        rest = durable(packed.filter(F.col("_fill") < WELL_FILLED).select(*items.columns))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    empty = sized.filter("tokens = 0").select("id", F.explode(_packs(capacities)).alias("_k"))
    none = empty.select("_k.pack", "_k.capacity", "id", F.lit(0).alias("piece"), F.lit(0).cast("long").alias("tokens"), F.lit(0).cast("long").alias("loss"), F.lit(None).cast("string").alias("container"))
    status = F.when(F.col("container").isNull(), "empty").when(F.col("container").startswith("full-"), "full").otherwise("packed")
    return out.unionByName(none).withColumn("status", status)


def pack_report(packed: DataFrame) -> DataFrame:
    """Per pack: containers, texts, pieces, tokens, the share of space used, mean and most segments, loss share."""
    per = packed.filter("container is not null").groupBy("pack", "capacity", "container").agg(F.sum("tokens").alias("t"), F.count("*").alias("s"), F.sum("loss").alias("l"))
    return per.groupBy("pack", "capacity").agg(
        F.count("*").alias("containers"),
        F.sum("s").alias("segments"),
        F.sum("t").alias("tokens"),
        (F.sum("t") / (F.count("*") * F.max("capacity"))).alias("space_used"),
        F.max("s").alias("most_segments"),
        F.max("t").alias("most_tokens"),
        F.max("l").alias("most_loss"),
    )
