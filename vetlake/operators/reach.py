"""Reachability with hop numbers in rounds that follow the logarithm of long paths.

The first hops go one join at a time, since most graphs end there.  What is left is shrunk instead of
walked.  All names reached so far melt into one root per key.  A node with a single predecessor hangs on
it; pointers from such nodes to their predecessors are doubled (each round a pointer is replaced by the
pointer of its target), so a run of n nodes finds the node it hangs on, and its distance, in log2(n) rounds.
Edges then start from there, parallel edges become the shortest of them, edges within one node go,
and nodes that had several predecessors may now have one: the graph shrinks until none has.
Circles entered at one place fold up this way; circles nobody enters are dropped.  A rest
in which every node has several predecessors is relaxed by weighted rounds.  Hop numbers are exact throughout.

A round is one join and one staged table.  Nothing is collected but whether a table is empty and how many
pointers still move.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import drop_table, stage_table

# Hops walked before the rest is shrunk.
WALKED = 4
_ROOT = ""  # names carry a mark in front, so no name is the root


def _least(edges: DataFrame, k: list[str]) -> DataFrame:
    """One edge per pair of nodes, the shortest, none within a node."""
    return edges.where("src <> dst").groupBy(*k, "src", "dst").agg(F.min("w").alias("w"))


def _hang(single: DataFrame, k: list[str], trace: list[str]) -> DataFrame:
    """``node, anchor, depth``: the node that the chain of single predecessors ends at; null anchor on circles.

    ``single``: node, anchor (its predecessor), depth (the edge's length).
    """
    now, moving = single.withColumn("moves", F.lit(True)), None
    for n in count(1):
        # the last pointers have their own next pointer; those of them that have none are anchors
        over = now.select(*k, F.col("node").alias("anchor"), F.col("anchor").alias("next"), F.col("depth").alias("more"), F.col("moves").alias("goes_on"))
        step = now.join(over, [*k, "anchor"], "left")
        # a pointer that took over one at rest is at rest too, without a round to see that
        far = stage_table(step.select(*k, "node", F.coalesce("next", "anchor").alias("anchor"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.coalesce("goes_on", F.lit(False)).alias("moves")), "pointers")
        trace.append(f"double {n}")
        left = far.where("moves").count()
        if left in (0, moving):
            # pointers that still move when no other comes to rest run in circles
            return far.select(*k, "node", F.when(~F.col("moves"), F.col("anchor")).alias("anchor"), "depth")
        if n > 1:
            drop_table(now)
        now, moving = far, left


def _relax(graph: DataFrame, found: DataFrame, k: list[str], trace: list[str]) -> DataFrame:
    """Shortest distances from the roots over ``graph``, one weighted round after the other."""
    front = found
    while True:
        reached = graph.join(front.select(*k, F.col("node").alias("src"), "hop"), [*k, "src"]).groupBy(*k, F.col("dst").alias("node")).agg(F.min(F.col("hop") + F.col("w")).alias("hop"))
        better = reached.join(found.select(*k, "node", F.col("hop").alias("old")), [*k, "node"], "left").where("old is null or hop < old").drop("old")
        front = stage_table(better, "relaxed")
        trace.append("relax")
        if front.isEmpty():
            return found
        found = stage_table(found.unionByName(front).groupBy(*k, "node").agg(F.min("hop").alias("hop")), "distances")


def _walked(edges: DataFrame, seeds: DataFrame, k: list[str], hops: int, trace: list[str]) -> tuple[DataFrame, DataFrame, bool]:
    """Marked edges, nodes within ``hops`` and whether that is all."""
    mark = lambda c: F.concat(F.lit("="), F.col(c).cast("string"))
    # edges and seeds are read every round: computed once, so what is behind them is scanned once
    e = stage_table(edges.select(*k, mark("src").alias("src"), mark("dst").alias("dst")).where("src <> dst").distinct(), "edges")
    front = stage_table(seeds.select(*k, mark("name").alias("node")).where("node is not null").distinct().withColumn("hop", F.lit(0).cast("long")), "reached")
    known = front
    for hop in range(1, hops + 1):
        nxt = e.join(front.select(*k, F.col("node").alias("src")), [*k, "src"]).select(*k, F.col("dst").alias("node")).distinct()
        front = stage_table(nxt.join(known, [*k, "node"], "left_anti").withColumn("hop", F.lit(hop).cast("long")), "reached")
        trace.append(f"hop {hop}")
        if front.isEmpty():
            return e, known, True
        known = known.unionByName(front)
    return e, known, False


def _named(nodes: DataFrame, k: list[str]) -> DataFrame:
    return nodes.select(*k, F.expr("substring(node, 2)").alias("name"), "hop")


def walk(edges: DataFrame, seeds: DataFrame, keys: tuple[str, ...], hops: int) -> DataFrame:
    """Names within ``hops`` of the seeds, one join a hop."""
    return _named(_walked(edges, seeds, list(keys), hops, [])[1], list(keys))


def reach(edges: DataFrame, seeds: DataFrame, keys: tuple[str, ...] = ("skill_id", "path"), walked: int = WALKED, trace: list[str] | None = None) -> DataFrame:
    """Names reachable from the seeds: keys, name, hop (the least number of edges).

    ``edges``: keys, src, dst; ``seeds``: keys, name.  ``trace`` receives one entry per round.
    """
    k, trace = list(keys), [] if trace is None else trace
    e, known, complete = _walked(edges, seeds, k, walked, trace)
    if complete:
        return _named(known, k)
    src = known.select(*k, F.col("node").alias("src"), "hop")
    entering = e.join(src, [*k, "src"]).select(*k, F.lit(_ROOT).alias("src"), "dst", (F.col("hop") + 1).alias("w"))
    inner = e.join(src, [*k, "src"], "left_anti").withColumn("w", F.lit(1).cast("long"))
    rest = entering.unionByName(inner).join(known.select(*k, F.col("node").alias("dst")), [*k, "dst"], "left_anti")
    graph = stage_table(_least(rest, k), "graph")
    levels: list[DataFrame] = []
    while True:
        # what starts at a node that nothing enters is never reached
        entered = graph.select(*k, F.col("dst").alias("src")).distinct()
        graph = stage_table(graph.where(F.col("src") == _ROOT).unionByName(graph.where(F.col("src") != _ROOT).join(entered, [*k, "src"], "left_semi").select(*graph.columns)), "graph")
        one = graph.groupBy(*k, F.col("dst").alias("node")).agg(F.count("*").alias("n"), F.min("src").alias("anchor"), F.min("w").alias("depth")).where("n = 1").drop("n")
        single = stage_table(one, "single")
        if single.isEmpty():
            break
        up = _hang(single, k, trace)
        levels.append(up)
        others = graph.join(single.select(*k, F.col("node").alias("dst")), [*k, "dst"], "left_anti")
        at = up.select(*k, F.col("node").alias("src"), "anchor", "depth", F.lit(True).alias("hung"))
        moved = others.join(at, [*k, "src"], "left").where("hung is null or anchor is not null")
        graph = stage_table(_least(moved.select(*k, F.coalesce("anchor", "src").alias("src"), "dst", (F.col("w") + F.coalesce("depth", F.lit(0))).alias("w")), k), "graph")
        trace.append("shrink")
        if graph.isEmpty():
            break
    found = known.select(*k).distinct().select(*k, F.lit(_ROOT).alias("node"), F.lit(0).cast("long").alias("hop"))
    if not graph.isEmpty():
        found = _relax(graph, stage_table(found, "distances"), k, trace)
    for up in reversed(levels):
        hung = up.join(found.select(*k, F.col("node").alias("anchor"), "hop"), [*k, "anchor"]).select(*k, "node", (F.col("hop") + F.col("depth")).alias("hop"))
        found = stage_table(found.unionByName(hung), "distances")
    return _named(known.unionByName(found.where(F.col("node") != _ROOT)), k)
