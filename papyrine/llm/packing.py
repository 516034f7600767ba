"""Filling containers of fixed capacity, by hierarchical multi-length packing.

Pieces are routed to tiers by their length, from those longer than half a container downwards. Each tier is packed in
turn: its pieces first fill the tightest gaps that longer tiers left, then open containers of their own. Only the
histogram of lengths goes to the driver, at most one number for each possible length, whatever the number of texts; the
plan that comes back says for ranges of equally long pieces which range of containers they go to, and its size too
depends on the capacity alone. Containers are dealt to step groups in the order of their fill, to and fro, so that
groups hold about the same number of tokens.

Defined results
* a text longer than the capacity is split into full pieces and a rest; no other text is split
* null and empty texts have no tokens: they come out with piece 0, no container and no step group
* equal lengths are ordered by key and piece; rows given twice are packed twice
* an empty table gives an empty result
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from papyrine.operators.common import cut

CAPACITY = 2048
#: Tiers by the longest piece they take, as parts of the capacity.
TIERS = (1.0, 0.5, 0.25, 0.125)
GROUP = 64
#: Equally long pieces are numbered in so many blocks, so that no length is sorted in one task.
BLOCKS = 256


def tier_of(size: int, capacity: int) -> int:
    return max(i for i, t in enumerate(TIERS) if size <= capacity * t)


def plan(histogram: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int]], list[tuple[int, int, int]]]:
    """(size, first rank, count, first container) rows, and (first container, count, gap) of all containers."""
    gaps: dict[int, list[tuple[int, int]]] = {capacity: []}
    known = [capacity]
    rows, opened = [], 0

    def put(gap: int, first: int, count: int) -> None:
        if gap not in gaps:
            gaps[gap] = []
            bisect.insort(known, gap)
        gaps[gap].append((first, count))

    sizes = sorted((s for s in histogram if s > 0), reverse=True)
    for tier in range(len(TIERS)):
        for s in (x for x in sizes if tier_of(x, capacity) == tier):
            left, rank = histogram[s], 0
            while left:
                at = bisect.bisect_left(known, s)
                while at < len(known) and not gaps[known[at]]:
                    at += 1
                if at == len(known):  # as many new containers as this length fills by itself
                    need = -(-left // (capacity // s))
                    put(capacity, opened, need)
                    opened += need
                    continue
                gap = known[at]
                first, count = gaps[gap].pop()
                k = min(count, left)
                rows.append((s, rank, k, first))
                if k < count:
                    gaps[gap].append((first + k, count - k))
                put(gap - s, first, k)
                rank, left = rank + k, left - k
    return rows, sorted((first, count, gap) for gap, own in gaps.items() for first, count in own)


def pack(sizes: DataFrame, key: str, size: str, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """(key, piece, start, n_tokens, tier, container, step_group) of every piece; start is the first token in its text."""
    spark = sizes.sparkSession
    full = F.expr(f"greatest(1, cast(ceil({size} / {capacity}) as int))")
    pieces = sizes.select(F.col(key).alias("key"), F.coalesce(F.col(size), F.lit(0)).cast("long").alias("size")).withColumn("size", F.greatest("size", F.lit(0)))
    full = F.greatest(F.lit(1), F.ceil(F.col("size") / F.lit(capacity))).cast("int")
    pieces = pieces.select("key", "size", F.explode(F.sequence(F.lit(0), full - 1)).alias("piece"))
    pieces = cut(pieces.select("key", "piece", F.least(F.lit(capacity), F.col("size") - F.col("piece") * capacity).cast("int").alias("n_tokens"), F.pmod(F.xxhash64("key", "piece"), F.lit(BLOCKS)).cast("int").alias("block")))
    counts = cut(pieces.where("n_tokens > 0").groupBy("n_tokens", "block").agg(F.count(F.lit(1)).alias("n")))
    histogram = {r["n_tokens"]: r["n"] for r in counts.groupBy("n_tokens").agg(F.sum("n").alias("n")).collect()}
    rows, containers = plan(histogram, capacity)
    before = Window.partitionBy("n_tokens").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offset = counts.select("n_tokens", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("n_tokens", "block").orderBy("key", "piece")
    ranked = pieces.where("n_tokens > 0").withColumn("r", F.row_number().over(inside) - 1).join(offset, ["n_tokens", "block"]).withColumn("rank", F.col("r") + F.col("offset"))
    # Step groups: containers in the order of their gap, dealt to and fro.
    order, base, fills = sorted(containers, key=lambda x: (x[2], x[0])), 0, []
    for first, count, _ in order:
        fills.append((first, base))
        base += count
    placed = _placed(ranked, key="key", rows=rows, fills=sorted(fills), groups=max(1, -(-base // group)))
    nothing = pieces.where("n_tokens = 0").select("key", "piece", "n_tokens", F.lit(None).cast("long").alias("container"), F.lit(None).cast("long").alias("step_group"))
    every = placed.select("key", "piece", "n_tokens", "container", "step_group").unionByName(nothing)
    tier = F.lit(0)
    for i, t in enumerate(TIERS):
        tier = F.when(F.col("n_tokens") <= int(capacity * t), i).otherwise(tier)
    return every.select(F.col("key").alias(key), "piece", (F.col("piece").cast("long") * capacity).alias("start"), "n_tokens", tier.alias("tier"), "container", "step_group")


def _placed(ranked: DataFrame, key: str, rows: list[tuple[int, int, int, int]], fills: list[tuple[int, int]], groups: int) -> DataFrame:
    """Container and step group of each numbered piece: binary searches in the plan, whose size depends on the capacity only."""
    by_size: dict[int, list[tuple[int, int]]] = {}
    for s, r, _, c in rows:
        by_size.setdefault(s, []).append((r, c))
    ranges = {s: np.array(sorted(v), np.int64) for s, v in by_size.items()}
    firsts, bases = np.array([f for f, _ in fills], np.int64), np.array([b for _, b in fills], np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size, rank = b.column(2).to_numpy(zero_copy_only=False), b.column(3).to_numpy(zero_copy_only=False)
            container = np.empty(len(size), np.int64)
            for s in np.unique(size).tolist():
                own = size == s
                r = ranges[s]
                at = np.searchsorted(r[:, 0], rank[own], "right") - 1
                container[own] = r[at, 1] + rank[own] - r[at, 0]
            at = np.searchsorted(firsts, container, "right") - 1
            place = (bases[at] + container - firsts[at]) % (2 * groups)
            turn = np.where(place < groups, place, 2 * groups - 1 - place)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(container), pa.array(turn)], names=["key", "piece", "n_tokens", "container", "step_group"])

    kind = ranked.schema[key].dataType.simpleString()
    return ranked.select("key", "piece", "n_tokens", F.col("rank").cast("long").alias("rank")).mapInArrow(run, f"key {kind}, piece int, n_tokens int, container long, step_group long")
