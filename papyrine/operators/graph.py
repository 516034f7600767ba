"""Operators over graphs and metagraphs given as link tables: pairs of a document, degrees, components, roll-ups.

Defined results: null ids take part in no join; empty tables give empty results; extra columns are ignored unless named.
Hot keys: pairs are ordered by rank and bounded where the operator says so; whole groups are never collected.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from papyrine.operators.common import cut


def consecutive(df: DataFrame, by: list[str], order: list[str], node: str) -> DataFrame:
    """(by, source_id, target_id): each row with the one that follows it in its group."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.select(*by, F.col(node).alias("source_id"), F.lead(node).over(w).alias("target_id")).where("target_id is not null")


def co_members(links: DataFrame, by: list[str], node: str, order: str, most: int) -> DataFrame:
    """Pairs of nodes that share a member, later to earlier, among the first ``most`` nodes of each member."""
    w = Window.partitionBy(*by).orderBy(order, node)
    r = links.select(*by, F.col(node).alias("n"), F.col(order).alias("o"), F.row_number().over(w).alias("r")).where(F.col("r") <= most)
    a, b = r.select(*by, F.col("n").alias("source_id"), F.col("r").alias("ra")), r.select(*by, F.col("n").alias("target_id"), F.col("r").alias("rb"))
    return a.join(b, by).where("ra > rb").select(*by, "source_id", "target_id")


def member_classes(links: DataFrame, by: list[str], node: str, order: str) -> DataFrame:
    """All pairs of nodes that share a member, as class and count: (by, node, place, earlier, n).

    A node links to each of the ``earlier`` nodes of smaller place; the n nodes of a class make n * (n - 1) / 2 pairs.
    """
    of = Window.partitionBy(*by)
    place = F.row_number().over(of.orderBy(order, node))
    return links.select(*by, node, place.cast("long").alias("place"), (place - 1).cast("long").alias("earlier"), F.count(F.lit(1)).over(of).alias("n"))


def nearest_earlier(links: DataFrame, by: list[str], node: str, order: str, most: int) -> DataFrame:
    """For each node its ``most`` nearest earlier nodes that share a member, found member by member.

    The nearest earlier nodes overall are among the nearest ones of each shared member, so each member only hands over
    that many: windows instead of all pairs.
    """
    w = Window.partitionBy(*by).orderBy(order, node)
    cols = [F.lag(F.struct(F.col(order).alias("o"), F.col(node).alias("n")), k).over(w).alias(f"b{k}") for k in range(1, most + 1)]
    keys = [c for c in by if c != "symbol"]
    x = links.select(*by, node, order, *cols)
    x = x.select(*keys, node, F.col(order).alias("own"), F.explode(F.array_compact(F.array(*[F.col(f"b{k}") for k in range(1, most + 1)]))).alias("b")).where("b.o < own").select(*keys, F.col(node).alias("source_id"), F.col("b.n").alias("target_id"), F.col("b.o").alias("o")).distinct()
    top = Window.partitionBy(*keys, "source_id").orderBy(F.desc("o"), "target_id")
    return x.withColumn("r", F.row_number().over(top)).where(F.col("r") <= most).drop("o", "r")


def degrees(edges: DataFrame, by: list[str], source: str = "source_id", target: str = "target_id") -> DataFrame:
    ends = edges.select(*by, F.explode(F.array(source, target)).alias("node_id")).where("node_id is not null")
    return ends.groupBy(*by, "node_id").agg(F.count(F.lit(1)).alias("degree"))


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each node of a batch of edges with the smallest node it hangs together with inside the batch."""
    for b in batches:
        root: dict[str, str] = {}

        def find(x: str) -> str:
            top = x
            while root[top] != top:
                top = root[top]
            while root[x] != top:
                root[x], x = top, root[x]
            return top

        for x, y in zip(b.column("a").to_pylist(), b.column("b").to_pylist(), strict=True):
            x, y = find(root.setdefault(x, x)), find(root.setdefault(y, y))
            if x != y:
                root[max(x, y)] = min(x, y)
        pairs = [(x, find(x)) for x in list(root)]
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in pairs], pa.string()), pa.array([y for _, y in pairs], pa.string())], names=["a", "b"])


def components(nodes: DataFrame, edges: DataFrame, by: str, node: str) -> DataFrame:
    """(by, node, component): smallest node id that can be reached, edges taken both ways.

    Edges are first contracted to stars inside Arrow batches, as they lie. Then large and small stars alternate: every node
    links its larger neighbours to the smallest node it knows, then itself and its smaller ones, until nothing changes. All
    steps are keyed by single nodes, with partial minima, so no paper is one task, and the rounds grow with the logarithm
    of the size.
    """
    key = F.concat_ws("\x01", by, node)
    known = cut(nodes.select(key.alias("k")).distinct())
    both = edges.select(F.concat_ws("\x01", by, "source_id").alias("a"), F.concat_ws("\x01", by, "target_id").alias("b")).where("a <> b")
    both = both.join(known.withColumnRenamed("k", "a"), "a", "left_semi").join(known.withColumnRenamed("k", "b"), "b", "left_semi").select("a", "b")
    e = cut(both.mapInArrow(_forest, "a string, b string").where("a <> b").distinct())  # from larger to smaller
    low = lambda x: x.groupBy("u").agg(F.min("v").alias("m"))
    count = -1
    while True:
        ways = e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select("b", "a"))
        large = ways.join(low(ways), "u").where("v > u").select(F.col("v").alias("a"), F.least("m", "u").alias("b")).where("a <> b").distinct()
        down = large.select(F.col("a").alias("u"), F.col("b").alias("v"))
        mins = low(down)
        small = down.join(mins, "u").select(F.explode(F.array("u", "v")).alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        new = cut(small)
        n = new.select(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).head()
        e = new
        if n == count:
            break
        count = n
    part = F.split("k", "\x01")
    label = known.join(e.select(F.col("a").alias("k"), "b"), "k", "left").select("k", F.coalesce("b", "k").alias("l"))
    return label.select(part[0].alias(by), part[1].alias(node), F.element_at(F.split("l", "\x01"), -1).alias("component"))


def limited_edges(edges: DataFrame, by: str, order: list[str], cap: int) -> DataFrame:
    """Edges (by, source_id, target_id, ...) that a pass in the given order takes if each end may have ``cap`` of them.

    Rounds instead of one pass: an edge is taken as soon as fewer edges are undecided before it at either end than the end
    has places left, as those all leave it room, and given up once an end is full. The result is that of the pass, edge by
    edge. Every round sorts the edges of one node at a time, never those of a paper.
    """
    tie = F.struct(*order)
    columns = edges.columns
    open_ = cut(edges.where("source_id is not null and target_id is not null and source_id <> target_id").distinct().withColumn("_id", F.xxhash64(by, *order)))
    taken = cut(open_.where("false"))
    while not open_.isEmpty():
        used = taken.select(by, F.explode(F.array("source_id", "target_id")).alias("_n")).groupBy(by, "_n").agg(F.count(F.lit(1)).alias("_used"))
        ends = open_.select(by, "_id", tie.alias("_o"), F.explode(F.array("source_id", "target_id")).alias("_n")).join(used, [by, "_n"], "left")
        ranked = ends.select("_id", "_o", by, (F.row_number().over(Window.partitionBy(by, "_n").orderBy("_o")) + F.coalesce("_used", F.lit(0))).alias("_rank"), F.coalesce("_used", F.lit(0)).alias("_used"))
        state = ranked.groupBy(by, "_id", "_o").agg(F.max("_rank").alias("_rank"), F.max("_used").alias("_used")).select(by, "_id", "_o", "_rank", "_used")
        decided = cut(open_.withColumn("_o", tie).join(state, [by, "_id", "_o"]))
        new = decided.where((F.col("_rank") <= cap) & (F.col("_used") < cap)).select(*open_.columns)
        taken = cut(taken.unionByName(new))
        open_ = cut(decided.where((F.col("_rank") > cap) & (F.col("_used") < cap)).select(*open_.columns))
    return taken.select(*columns)


def rolled_up(contains: DataFrame, own: DataFrame) -> DataFrame:
    """(document_id, id, mass) of containers: sums over (document_id, parent, child) from below, rounded to four places.

    Leaves have their own mass (document_id, id, mass); a member that is neither leaf nor container has none; a container
    without any mass has 1. Containers are settled as soon as all containers inside them are, whatever the depth; those on
    a cycle, or above one, end with 1.
    """
    key = ["document_id", "id"]
    containers = contains.select("document_id", F.col("parent").alias("id")).distinct()
    inner = cut(contains.join(containers.withColumnRenamed("id", "child"), ["document_id", "child"], "left_semi").select("document_id", "parent", "child").distinct())
    leaves = contains.join(inner, ["document_id", "parent", "child"], "left_anti").join(own.withColumnRenamed("id", "child"), ["document_id", "child"])
    base = leaves.groupBy("document_id", F.col("parent").alias("id")).agg(F.sum("mass").alias("mass"))
    waiting = cut(containers.join(base, key, "left").select(*key, F.coalesce("mass", F.lit(0.0)).alias("mass")))
    done = waiting.where("false")
    while not waiting.isEmpty():
        blocked = inner.join(waiting.select("document_id", F.col("id").alias("child")), ["document_id", "child"], "left_semi").select("document_id", F.col("parent").alias("id")).distinct()
        ready = cut(waiting.join(blocked, key, "left_anti").select(*key, F.when(F.round("mass", 4) != 0, F.round("mass", 4)).otherwise(1.0).alias("mass")))
        if ready.isEmpty():
            return done.unionByName(waiting.select(*key, F.lit(1.0).alias("mass")))
        done = cut(done.unionByName(ready))
        passed = inner.join(ready.withColumnRenamed("id", "child"), ["document_id", "child"]).groupBy("document_id", F.col("parent").alias("id")).agg(F.sum("mass").alias("more"))
        waiting = cut(waiting.join(ready, key, "left_anti").join(passed, key, "left").select(*key, (F.col("mass") + F.coalesce("more", F.lit(0.0))).alias("mass")))
    return done
