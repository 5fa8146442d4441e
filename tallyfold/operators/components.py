"""Strongly connected components of a table of edges, in rounds of joins.

Three kinds of rounds, each linear in the edges that are left:

- trimming: a node without a way in or without a way out is a component of its own and goes;
- contraction: a node with one way in is replaced by its predecessor, one with one way out by its successor, an independent
  set of about a quarter of them a round, so that chains and rings shrink to nothing in logarithmically many rounds;
- colouring of what remains: every node takes the least node that reaches it, then each colour's own node is sought backward
  within its colour. What finds it is a component; the rest goes on.

A contracted node belongs to its neighbour's component if one of the edges that replaced it lies within a component; this is
told in the reverse order of the rounds. Every round is written to the shared folder; no round holds pairs of nodes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfold.sources.shared import materialize

MAX_ROUNDS = 400


def _degrees(edges: DataFrame) -> DataFrame:
    """``id, ins, outs, before, after`` of the nodes with a way in and a way out; before and after are their least neighbours."""
    ins = edges.groupBy(F.col("target").alias("id")).agg(F.count("*").alias("ins"), F.min("source").alias("before"))
    outs = edges.groupBy(F.col("source").alias("id")).agg(F.count("*").alias("outs"), F.min("target").alias("after"))
    return ins.join(outs, "id")


def contracted(edges: DataFrame, salt: int) -> tuple[DataFrame, DataFrame]:
    """Distinct edges without loops after one round of trimming and contraction, and ``(id, anchor, far)`` of contracted nodes.

    ``far`` are the ends of the edges that replaced the node. A coin by hash keeps anchors in place: a node goes only if its
    coin shows heads and its anchor's tails.
    """
    heads = lambda c: F.xxhash64(c, F.lit(salt)).bitwiseAND(F.lit(1)) == 1
    anchor = F.when(F.col("ins") == 1, F.col("before")).when(F.col("outs") == 1, F.col("after"))
    live = _degrees(edges).select("id", (F.col("ins") == 1).alias("by_source"), anchor.alias("anchor"))
    live = live.withColumn("anchor", F.when(heads(F.col("id")) & ~heads(F.col("anchor")), F.col("anchor")))
    live = materialize(live)
    end = lambda side: live.select(F.col("id").alias(side), F.when(F.col("by_source") == (side == "source"), F.col("anchor")).alias(f"{side}_to"))
    moved = edges.join(end("source"), "source").join(end("target"), "target")
    # the edge between a contracted node and its anchor goes with the node
    gone = live.where("anchor is not null").select(F.when(F.col("by_source"), F.col("anchor")).otherwise(F.col("id")).alias("source"), F.when(F.col("by_source"), F.col("id")).otherwise(F.col("anchor")).alias("target"))
    moved = moved.join(gone, ["source", "target"], "left_anti")
    moved = materialize(moved.select("source", "target", "source_to", "target_to", F.coalesce("source_to", "source").alias("s"), F.coalesce("target_to", "target").alias("t")))
    by_source = moved.where("source_to is not null").select(F.col("source").alias("id"), F.col("source_to").alias("anchor"), F.col("t").alias("far"))
    by_target = moved.where("target_to is not null").select(F.col("target").alias("id"), F.col("target_to").alias("anchor"), F.col("s").alias("far"))
    left = materialize(moved.where("s <> t").select(F.col("s").alias("source"), F.col("t").alias("target")).distinct())
    return left, by_source.unionByName(by_target)


def coloured(edges: DataFrame) -> DataFrame:
    """``(id, component)`` of one component for each colour that has one; ``edges`` are distinct and without loops."""
    nodes = edges.select(F.col("source").alias("id")).union(edges.select(F.col("target").alias("id"))).distinct()
    colours, before = materialize(nodes.withColumn("colour", F.col("id"))), None
    for _ in range(MAX_ROUNDS):
        reached = edges.join(colours.withColumnRenamed("id", "source"), "source").groupBy(F.col("target").alias("id")).agg(F.min("colour").alias("other"))
        step = colours.join(reached, "id", "left").select("id", F.least("colour", "other").alias("colour"))
        # what reaches my colour reaches me, too
        shortcut = colours.select(F.col("id").alias("colour"), F.col("colour").alias("further"))
        colours = materialize(step.join(shortcut, "colour").select("id", F.least("colour", "further").alias("colour")))
        now = colours.agg(F.sum(F.xxhash64("id", "colour").cast("decimal(20,0)"))).first()[0]
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"colours did not settle in {MAX_ROUNDS} rounds")
    own = lambda side: colours.select(F.col("id").alias(side), F.col("colour").alias(f"{side}_colour"))
    inner = materialize(edges.join(own("source"), "source").join(own("target"), "target").where("source_colour = target_colour").select("source", "target"))
    found = fresh = materialize(colours.where("id = colour").select("id"))
    for _ in range(MAX_ROUNDS):
        fresh = materialize(inner.join(fresh.withColumnRenamed("id", "target"), "target").select(F.col("source").alias("id")).distinct().join(found, "id", "left_anti"))
        if fresh.isEmpty():
            return materialize(found.join(colours, "id").select("id", F.col("colour").alias("component")))
        found = found.unionByName(fresh)
    raise RuntimeError(f"a component is deeper than {MAX_ROUNDS} rounds")


def strong_components(edges: DataFrame) -> DataFrame:
    """``(id, component, size)`` of the nodes that lie on a cycle; ``component`` is its least node.

    ``edges`` are ``source, target``; repeated edges count once, edges with a null end not at all. A node with an edge to itself
    is a component of one. Nodes on no cycle are left out.
    """
    whole = materialize(edges.select("source", "target").where("source is not null and target is not null").distinct())
    loops = whole.where("source = target").select(F.col("source").alias("id"), F.col("source").alias("component"))
    rest, removed, known = whole.where("source <> target"), [], []
    rounds = 0
    left = rest.count()
    while left:
        while left:
            if (rounds := rounds + 1) > MAX_ROUNDS:
                raise RuntimeError(f"the graph did not shrink in {MAX_ROUNDS} rounds")
            rest, gone = contracted(rest, rounds)
            removed.append(gone)
            before, left = left, rest.count()
            if left > 0.95 * before and not _shrinks(rest):
                break
        if left:
            found = coloured(rest)
            known.append(found)
            out = lambda side, found=found: found.select(F.col("id").alias(side))
            rest = materialize(rest.join(out("source"), "source", "left_anti").join(out("target"), "target", "left_anti").select("source", "target"))
            left = rest.count()
    parts = loops.limit(0)
    for found in known:
        parts = parts.unionByName(found)
    parts = materialize(parts)
    for gone in reversed(removed):
        of = lambda c, parts=parts: parts.select(F.col("id").alias(c), F.col("component").alias(f"{c}_part"))
        both = gone.join(of("anchor"), "anchor", "left").join(of("far"), "far", "left")
        mine = F.coalesce("anchor_part", "anchor")
        parts = parts.unionByName(materialize(both.where(mine == F.coalesce("far_part", "far")).select("id", mine.alias("component")).distinct()))
    named = parts.unionByName(parts.select(F.col("component").alias("id"), "component")).distinct()
    sizes = materialize(named.groupBy("component").agg(F.min("id").alias("least"), F.count("*").alias("size")))
    out = materialize(named.join(sizes, "component").select("id", F.col("least").alias("component"), "size").where("size > 1"))
    alone = loops.join(out, "id", "left_anti").withColumn("size", F.lit(1).cast("long"))
    return out.unionByName(alone)


def _shrinks(edges: DataFrame) -> bool:
    """Whether another round can trim or contract anything."""
    ends: Column = (F.col("ins") == 1) | (F.col("outs") == 1)
    nodes = edges.select(F.col("source").alias("id")).union(edges.select(F.col("target").alias("id"))).distinct().count()
    degrees = _degrees(edges).agg(F.count("*").alias("n"), F.count_if(ends).alias("thin")).first()
    return degrees["n"] < nodes or degrees["thin"] > 0
