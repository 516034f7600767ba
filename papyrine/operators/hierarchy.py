"""Parent-child links to full hierarchies.

Three steps, each a number of rounds that grows with the logarithm of the depth or size, never with the depth itself:

1. Leaves are peeled in doubling steps: with f the parent function, the nodes that are left after 2^k rounds of leaf
   peeling are the image of f^(2^k). When no more nodes reach a root and that image stops shrinking, it is exactly the
   nodes on cycles.
2. For the rooted rest, an Euler tour: each node has an entry and an exit arc, each arc one successor.
3. List ranking of the tour: lists are first contracted inside blocks of nearby arcs (bounded numpy work), then the few
   arcs that other blocks point to are ranked by pointer doubling, then all arcs read off their rank. Entry and exit
   give depth, root, ancestors and descendants: a node's descendants are those whose entry lies in its interval. Pairs
   are found by cutting intervals into blocks of powers of two, so that they are joined by equality; the ancestors of a
   node in the order of their entries are its path.

Defined results
* a null, blank or unknown parent makes a root (depth 1); parents are compared letter for letter
* several rows of a node: the latest loaded_at counts, then the larger values of the remaining columns
* a null node id is a node of its own without children (one per tree)
* a node on or below a cycle has no depth, path or interval; its root is the smallest id on that cycle
* empty input gives an empty result; extra columns are ignored, so their names cannot clash
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from papyrine.operators.common import cut

#: Siblings are ordered in blocks of so many values of `ord`, so that a parent of any number of children is split.
SIBLING_BLOCK = 4096
#: Nodes without ``ord`` are spread over so many blocks.
NO_ORDER_BLOCKS = 64


def latest(df: DataFrame, keys: list[str], when: str, values: list[str]) -> DataFrame:
    """The row of each key with the latest ``when``; ties go to the larger values."""
    best = F.max(F.struct(F.col(when), *[F.col(v) for v in values])).alias("best")
    return df.groupBy(*keys).agg(best).select(*keys, *[F.col(f"best.{v}").alias(v) for v in values])


def links(df: DataFrame, tree: str, node: str, parent: str, order: str | None = None) -> DataFrame:
    """(tree, id, parent, ord): parents that are null, blank or no node of the tree become null."""
    nodes = df.select(F.col(tree).alias("tree"), F.col(node).alias("id"), F.col(parent).alias("parent"), (F.col(order) if order else F.lit(None)).cast("int").alias("ord"))
    known = nodes.select(F.col("tree").alias("k_tree"), F.col("id").alias("k_id")).where("k_id is not null")
    return nodes.join(known, F.col("tree").eqNullSafe(F.col("k_tree")) & (F.col("parent") == F.col("k_id")), "left").select("tree", "id", F.col("k_id").alias("parent"), "ord")


def _double(left: DataFrame, right: DataFrame, ptr: str, columns: list[str]) -> DataFrame:
    """left joined with what ``right`` says about the node that ``ptr`` points to (columns get the prefix n_)."""
    r = right.select(F.col("tree").alias("n_tree"), F.col("id").alias("n_id"), *[F.col(c).alias(f"n_{c}") for c in columns])
    return left.join(r, F.col("tree").eqNullSafe(F.col("n_tree")) & (F.col(ptr) == F.col("n_id")), "left")


def cycles(nodes: DataFrame) -> DataFrame:
    """(tree, id, cycle_root) of every node whose parents run into a cycle; see step 1."""
    state = cut(nodes.where("id is not null").select("tree", "id", F.col("parent").alias("ptr")))
    waiting = -1
    while True:  # nodes whose pointer still has somewhere to go
        open_nodes = state.where("ptr is not null")
        n = open_nodes.count()
        if n == 0:
            return state.where("false").select("tree", "id", F.col("id").alias("cycle_root"))
        if n == waiting:
            break
        waiting = n
        state = cut(_double(open_nodes, state, "ptr", ["ptr"]).select("tree", "id", F.col("n_ptr").alias("ptr")))
    # What is left is closed under the pointers; go on until the image no longer shrinks.
    state, size = open_nodes, waiting
    while True:
        image = state.select("tree", F.col("ptr").alias("id")).distinct().count()
        if image == size:
            break
        size = image
        state = cut(_double(state, state, "ptr", ["ptr"]).select("tree", "id", F.col("n_ptr").alias("ptr")))
    on_cycle = cut(state.select("tree", F.col("ptr").alias("id")).distinct())
    # Smallest id over windows of the cycle that double in length.
    ring = cut(_double(on_cycle.withColumn("self", F.col("id")), nodes, "self", ["parent"]).select("tree", "id", F.col("n_parent").alias("ptr"), F.col("id").alias("low")))
    while True:
        ring2 = cut(_double(ring, ring, "ptr", ["ptr", "low"]).select("tree", "id", F.col("n_ptr").alias("ptr"), F.least("low", "n_low").alias("low"), (F.col("n_low") < F.col("low")).alias("moved")))
        ring = ring2.select("tree", "id", "ptr", "low")
        if ring2.where("moved").isEmpty():
            break
    return _double(state, ring, "ptr", ["low"]).select("tree", "id", F.col("n_low").alias("cycle_root"))


def _block(node: str) -> Column:
    """The block of ``ord`` that a node is in; nodes without one are spread over blocks by their id."""
    return F.coalesce(F.floor(F.col("ord") / SIBLING_BLOCK), -1 - F.pmod(F.xxhash64(node), F.lit(NO_ORDER_BLOCKS))).cast("int")


def _tour(nodes: DataFrame) -> DataFrame:
    """Arcs of the Euler tour (tree, id, up, ord, next_id, next_up, d): d is +1 on entry and -1 on exit.

    Siblings are linked inside blocks of ``ord`` and then from block to block, so no parent is sorted in one task.
    """
    block = _block("id")
    kids = nodes.where("parent is not null").withColumn("block", block)
    w = Window.partitionBy("tree", "parent", "block").orderBy(F.col("ord").asc_nulls_first(), "id")
    kids = kids.withColumn("sib", F.lead("id").over(w)).withColumn("first", F.row_number().over(w) == 1)
    heads = kids.where("first").select("tree", "parent", "block", "id")
    wb = Window.partitionBy("tree", "parent").orderBy("block")
    heads = heads.select("tree", "parent", "block", "id", F.lead("id").over(wb).alias("after"), (F.row_number().over(wb) == 1).alias("eldest"))
    same = F.col("tree").eqNullSafe(F.col("h_tree")) & (F.col("parent") == F.col("h_parent")) & (F.col("block") == F.col("h_block"))
    follow = heads.where("after is not null").select(F.col("tree").alias("h_tree"), F.col("parent").alias("h_parent"), F.col("block").alias("h_block"), "after")
    kids = kids.join(follow, same, "left").select("tree", "id", F.coalesce("sib", "after").alias("sib"))
    eldest = heads.where("eldest").select(F.col("tree").alias("e_tree"), F.col("parent").alias("e_parent"), F.col("id").alias("eldest_id"))
    k = kids.select(F.col("tree").alias("s_tree"), F.col("id").alias("s_id"), "sib")
    full = (
        nodes.join(eldest, F.col("tree").eqNullSafe(F.col("e_tree")) & (F.col("id") == F.col("e_parent")), "left")
        .join(k, F.col("tree").eqNullSafe(F.col("s_tree")) & (F.col("id") == F.col("s_id")), "left")
    )
    down = F.struct(F.lit(False).alias("up"), F.coalesce("eldest_id", "id").alias("next_id"), F.col("eldest_id").isNull().alias("next_up"), F.lit(1).alias("d"))
    up = F.struct(F.lit(True).alias("up"), F.coalesce("sib", "parent").alias("next_id"), F.col("sib").isNull().alias("next_up"), F.lit(-1).alias("d"))
    return full.select("tree", "id", "ord", F.explode(F.array(down, up)).alias("a")).select("tree", "id", "ord", "a.up", "a.next_id", "a.next_up", "a.d")


def _contract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Follow each arc for as long as its successors lie in the same batch: steps and d summed up, last arc kept."""
    for b in batches:
        n = len(b)
        tree = b["tree"].where(b["tree"].notna(), None).to_numpy(object)  # null is a tree of its own
        index = {(t, i, u): k for k, (t, i, u) in enumerate(zip(tree, b["id"], b["up"], strict=True))}
        nxt = np.fromiter((index.get((t, i, u), n) if i is not None else n for t, i, u in zip(tree, b["next_id"], b["next_up"], strict=True)), np.int64, n)
        steps, d = np.ones(n + 1, np.int64), np.append(b["d"].to_numpy(np.int64), 0)
        steps[n] = 0
        ptr, last = np.append(nxt, n), np.arange(n + 1)
        last = np.where(ptr == n, last, ptr)
        ptr_last = np.where(ptr == n, np.arange(n + 1), ptr)
        # Pointer doubling on the arc before the one that leaves: an arc that leaves points to itself with no weight.
        w_s, w_d = np.where(ptr == n, 0, steps), np.where(ptr == n, 0, d)
        while True:
            new = ptr_last[ptr_last]
            if np.array_equal(new, ptr_last):
                break
            w_s, w_d, ptr_last = w_s + w_s[ptr_last], w_d + w_d[ptr_last], new
        end = ptr_last[:n]
        out = b[["tree", "id", "up"]].copy()
        out["steps"] = w_s[:n] + 1
        out["sum_d"] = w_d[:n] + d[end]
        out["last_id"] = b["id"].to_numpy(object)[end]
        out["to_id"] = b["next_id"].to_numpy(object)[end]
        out["to_up"] = b["next_up"].to_numpy(bool)[end]
        yield out


def _ranked(arcs: DataFrame) -> DataFrame:
    """(tree, id, up, to_end, d_to_end, root): arcs from here to the end of the tour, and what d sums up to on the way."""
    near = arcs.repartition("tree", _block("id")).sortWithinPartitions("tree", "ord", "id")
    short = cut(near.mapInPandas(_contract, "tree string, id string, up boolean, steps long, sum_d long, last_id string, to_id string, to_up boolean"))
    key = lambda i, u: F.concat(F.when(u, F.lit("u")).otherwise(F.lit("d")), i)
    short = short.withColumn("arc", key(F.col("id"), F.col("up"))).withColumn("to", key(F.col("to_id"), F.col("to_up")))
    entered = short.where("to is not null").select(F.col("tree").alias("x_tree"), F.col("to").alias("x")).distinct()
    state = cut(short.join(entered, F.col("tree").eqNullSafe(F.col("x_tree")) & (F.col("arc") == F.col("x")), "left_semi").select("tree", F.col("arc").alias("id"), F.col("to").alias("ptr"), "steps", "sum_d", "last_id"))
    while not state.where("ptr is not null").isEmpty():
        state = cut(
            _double(state, state, "ptr", ["ptr", "steps", "sum_d", "last_id"]).select(
                "tree", "id", F.col("n_ptr").alias("ptr"), (F.col("steps") + F.coalesce("n_steps", F.lit(0))).alias("steps"), (F.col("sum_d") + F.coalesce("n_sum_d", F.lit(0))).alias("sum_d"), F.coalesce("n_last_id", "last_id").alias("last_id")
            )
        )
    done = _double(short.withColumnRenamed("id", "node").withColumnRenamed("arc", "id"), state, "to", ["steps", "sum_d", "last_id"])
    return done.select("tree", F.col("node").alias("id"), "up", (F.col("steps") + F.coalesce("n_steps", F.lit(0))).alias("to_end"), (F.col("sum_d") + F.coalesce("n_sum_d", F.lit(0))).alias("d_to_end"), F.coalesce("n_last_id", "last_id").alias("root"))


def hierarchy(df: DataFrame, tree: str, node: str, parent: str, order: str | None = None) -> DataFrame:
    """(tree, id, parent, root, depth, entry, exit, n_descendants, cyclic) of each node.

    entry and exit are numbers inside the node's own root: b is a descendant of a if both have the same tree and root
    and a.entry < b.entry < a.exit. Nodes that never reach a root have cyclic = true, nulls, and as root the smallest
    id on their cycle.
    """
    nodes = cut(links(df, tree, node, parent, order))
    lost = cut(cycles(nodes))
    lost_key = lost.select(F.col("tree").alias("l_tree"), F.col("id").alias("l_id"))
    rooted = nodes.where("id is not null").join(lost_key, F.col("tree").eqNullSafe(F.col("l_tree")) & (F.col("id") == F.col("l_id")), "left_anti")
    ranks = _ranked(_tour(rooted))
    per_node = ranks.groupBy("tree", "id").agg(
        F.max(F.when(~F.col("up"), F.col("to_end"))).alias("a"), F.max(F.when(F.col("up"), F.col("to_end"))).alias("b"), F.max(F.when(F.col("up"), F.col("d_to_end"))).alias("d"), F.max("root").alias("root")
    )
    # From the exit arc on, only the node and its ancestors are left, one exit each: depth is minus the sum of d.
    flat = per_node.select("tree", "id", "root", (-F.col("d")).cast("int").alias("depth"), (-F.col("a")).alias("entry"), (-F.col("b")).alias("exit"), ((F.col("a") - F.col("b") - 1) / 2).cast("long").alias("n_descendants"), F.lit(False).alias("cyclic"))
    none = nodes.where("id is null").distinct().select("tree", "id", F.col("id").alias("root"), F.lit(1).alias("depth"), F.lit(-2).cast("long").alias("entry"), F.lit(-1).cast("long").alias("exit"), F.lit(0).cast("long").alias("n_descendants"), F.lit(False).alias("cyclic"))
    cyc = lost.select("tree", "id", F.col("cycle_root").alias("root"), F.lit(None).cast("int").alias("depth"), F.lit(None).cast("long").alias("entry"), F.lit(None).cast("long").alias("exit"), F.lit(None).cast("long").alias("n_descendants"), F.lit(True).alias("cyclic"))
    every = flat.unionByName(none).unionByName(cyc)
    p = nodes.select(F.col("tree").alias("p_tree"), F.col("id").alias("p_id"), "parent")
    return every.join(p, F.col("tree").eqNullSafe(F.col("p_tree")) & F.col("id").eqNullSafe(F.col("p_id")), "left").select("tree", "id", "parent", "root", "depth", "entry", "exit", "n_descendants", "cyclic")


def descendants(h: DataFrame) -> DataFrame:
    """(tree, ancestor, id, ancestor_entry) for every pair: the nodes whose entry lies in the ancestor's interval.

    Both sides are cut into blocks of powers of two inside their root: an interval into the fewest that cover it, an entry
    into the one of each level that holds it. A pair meets in exactly one block, so nothing is compared that is no pair.
    """
    rooted = h.where("not cyclic and id is not null").select("tree", "root", "id", (-F.col("entry")).alias("a"), (-F.col("exit")).alias("b"))
    level = lambda c: F.floor(F.log2(c.cast("double"))).cast("int")
    # Levels that any interval of a root can have: those of its own.
    top = rooted.where("id = root").select(F.col("tree").alias("t_tree"), F.col("root").alias("t_root"), level(F.col("a")).alias("top"))
    # Descendants have their entry between the exit and the entry of the ancestor: [b + 1, a - 1].
    start = F.struct((F.col("b") + 1).alias("lo"), (F.col("a") - 1).alias("hi"), F.array().cast("array<struct<level: int, block: bigint>>").alias("out"))

    def step(s: Column, k: Column) -> Column:
        own = s["lo"] <= s["hi"]
        left, right = own & (s["lo"] % 2 == 1), own & (s["hi"] % 2 == 0)
        block = lambda x: F.struct(k.cast("int").alias("level"), x.alias("block"))
        taken = F.array_compact(F.array(F.when(left, block(s["lo"])), F.when(right & ~(left & (s["lo"] == s["hi"])), block(s["hi"]))))
        lo, hi = F.when(left, s["lo"] + 1).otherwise(s["lo"]), F.when(right, s["hi"] - 1).otherwise(s["hi"])
        return F.struct(F.shiftright(lo, 1).alias("lo"), F.when(own, F.shiftright(hi, 1)).otherwise(F.lit(-1)).cast("long").alias("hi"), F.concat(s["out"], taken).alias("out"))

    covers = rooted.where("a - b > 1").select("tree", "root", F.col("id").alias("ancestor"), (-F.col("a")).alias("ancestor_entry"), F.aggregate(F.sequence(F.lit(0), level(F.col("a"))), start, step)["out"].alias("blocks"))
    covers = covers.select(F.col("tree").alias("c_tree"), F.col("root").alias("c_root"), "ancestor", "ancestor_entry", F.explode("blocks").alias("c")).select("c_tree", "c_root", "ancestor", "ancestor_entry", F.col("c.level").alias("c_level"), F.col("c.block").alias("c_block"))
    held = rooted.where("id <> root").join(top, F.col("tree").eqNullSafe(F.col("t_tree")) & (F.col("root") == F.col("t_root")))
    held = held.select("tree", "root", "id", "a", F.explode(F.sequence(F.lit(0), "top")).alias("level")).select("tree", "root", "id", "level", F.expr("shiftright(a, level)").alias("block"))
    same = F.col("tree").eqNullSafe(F.col("c_tree")) & (F.col("root") == F.col("c_root")) & (F.col("level") == F.col("c_level")) & (F.col("block") == F.col("c_block"))
    return held.join(covers, same).select("tree", "ancestor", "id", "ancestor_entry")


def paths(h: DataFrame, separator: str = " / ") -> DataFrame:
    """(tree, id, path): the ids from the root to each rooted node, which are its ancestors in the order of their entries.

    The result is as long as the sum of all depths, so it is made only where paths are asked for.
    """
    above = descendants(h).groupBy("tree", "id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ancestor_entry", "ancestor"))), lambda x: x["ancestor"]).alias("above"))
    above = above.select(F.col("tree").alias("u_tree"), F.col("id").alias("u_id"), "above")
    nodes = h.where("not cyclic and id is not null").select("tree", "id")
    x = nodes.join(above, F.col("tree").eqNullSafe(F.col("u_tree")) & (F.col("id") == F.col("u_id")), "left")
    return x.select("tree", "id", F.concat_ws(separator, "above", F.array("id")).alias("path"))
