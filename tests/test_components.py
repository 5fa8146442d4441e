"""Strongly connected components against reachability, and a ring that no walk along its edges could finish in time."""

import random

from tallyfold.operators.components import contracted, strong_components


def plain(edges):
    ahead, back = {}, {}
    for a, b in edges:
        for x in (a, b):
            ahead.setdefault(x, set())
            back.setdefault(x, set())
        ahead[a].add(b)
        back[b].add(a)

    def reached(start, graph):
        seen, todo = {start}, [start]
        while todo:
            fresh = graph[todo.pop()] - seen
            seen |= fresh
            todo += fresh
        return seen

    parts = {x: reached(x, ahead) & reached(x, back) for x in ahead}
    return {(x, min(p), len(p)) for x, p in parts.items() if len(p) > 1 or x in ahead[x]}


def found(spark, edges):
    rows = strong_components(spark.createDataFrame(edges, "source string, target string")).collect()
    assert len(rows) == len({r["id"] for r in rows})
    return {tuple(r) for r in rows}


def test_components_equal_reachability(spark):
    """Sparse and dense parts, loops, repeated edges, nodes between cycles, tails; a null end is no edge."""
    rng = random.Random(7)
    edges = [(f"n{rng.randrange(90)}", f"n{rng.randrange(90)}") for _ in range(120)] + [(f"d{rng.randrange(12)}", f"d{rng.randrange(12)}") for _ in range(60)] + [("d1", "n3"), ("x", "x"), ("y", "x"), ("d1", "n3")]
    assert found(spark, [*edges, ("n1", None), (None, "n1")]) == plain(edges)


def test_no_cycles(spark):
    assert found(spark, [("a", "b"), ("b", "c"), ("a", "c")]) == set() and found(spark, []) == set()


def test_long_ring(spark):
    """10,000 nodes in a ring with tails: logarithmically many rounds."""
    n = 10_000
    edges = [(f"r{i}", f"r{(i + 1) % n}") for i in range(n)] + [(f"r{i}", f"t{i}") for i in range(0, n, 10)]
    assert found(spark, edges) == {(f"r{i}", "r0", n) for i in range(n)}


def test_a_round_keeps_edges_few(spark):
    """Contraction never adds edges, and takes a good part of a chain."""
    chain = spark.createDataFrame([(i, i + 1) for i in range(2000)] + [(2000, 0)], "source long, target long")
    left, gone = contracted(chain, 1)
    assert left.count() < 0.85 * 2001 and gone.select("id").distinct().count() + left.count() == 2001
