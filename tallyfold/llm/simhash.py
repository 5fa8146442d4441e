"""SimHash near-duplicates by vantage-point trees over fingerprints.

Equal fingerprints are merged first. A vantage-point tree is built from a bounded sample of them: each node holds a vantage
fingerprint and a radius, and splits the rest by their distance to it. A fingerprint goes to every leaf shard that can hold
a point within one bit of it; the triangle inequality prunes the other branches. Two fingerprints at two bits or less have a
point within one bit of both, so they meet in that point's shard: no link is lost, and fingerprints near a boundary are
simply in several shards. A shard above ``SHARD`` fingerprints gets a tree of its own from a sample of its own, and so on,
so that the trees grow with the data. A shard is searched the same way down to small blocks, which are compared in full.

What no vantage point separates (many distinct fingerprints within few bits) is linked through its points within one bit: in
the task where it is part of a shard, as a shuffle where it is a whole shard above ``SHARD``. A block gives only a star for
each of its components, never all pairs. Components are found by rounds of large-star and small-star, written to the shared
folder after each round.

Null texts and texts without words have fingerprint zero. Null ids never are a component's id unless it has no other.
Repeated rows are each kept in the classes. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfold.llm import similar
from tallyfold.llm.common import drop, materialize, python_ready

BITS = 2  # of difference that link
#: Fingerprints that the first tree and a shard's own tree are built from, and their leaves at most.
SAMPLE, MAX_LEAVES = 1 << 15, 4096
OWN_SAMPLE, OWN_LEAVES = 1 << 12, 64
MAX_DEPTH = 5  # of trees in trees, so that a leaf's number fits 64 bits
LEAF = 4096  # fingerprints for each shard, about
SHARD = 1 << 18
BLOCK = 512
MAX_ROUNDS = 64
MARKS = 1 << 26  # bits that mark rows which do not simply stay
Nodes = list[tuple[int, int, int, int]]  # vantage, radius, left, right; a child below zero is leaf ~child


def fingerprint(text: str | None) -> int:
    return fingerprint_of(similar.words_of(text))


def fingerprint_of(words: list[bytes]) -> int:
    """Majority bits over the hashes of all three-word shingles, as a signed 64-bit integer."""
    if not words:
        return 0
    shingles = map(b" ".join, zip(words, words[1:], words[2:], strict=False)) if len(words) > 2 else [b" ".join(words)]
    hashes = np.fromiter((xxhash.xxh64_intdigest(s, 42) for s in shingles), dtype="<u8")
    counts = np.zeros(64, dtype=np.int64)
    for start in range(0, len(hashes), 1 << 16):
        part = hashes[start : start + (1 << 16)]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<i8")[0])


def with_fingerprint(docs: DataFrame, text: str = "text", name: str = "fp") -> DataFrame:
    python_ready(docs.sparkSession)

    @F.pandas_udf("long")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([fingerprint(t) for t in texts], dtype="int64")

    return docs.withColumn(name, run(F.col(text)))


def distances(points: np.ndarray, vantage: np.uint64) -> np.ndarray:
    return np.bitwise_count(points ^ vantage)


def choose_split(points: np.ndarray) -> tuple[np.uint64, int] | None:
    """The vantage and radius with the fewest points on both sides of the boundary; None if no split is worth it."""
    best = None
    for v in points[:: max(1, len(points) // 8)][:8]:
        counts = np.bincount(distances(points, v), minlength=66)
        below = np.cumsum(counts)
        left, right = np.append(below[1:], below[-1]), below[-1] - np.concatenate(([0], below[:-1]))
        largest = np.maximum(left, right) + (left + right - len(points))
        radius = int(np.argmin(largest[:64]))
        if best is None or largest[radius] < best[0]:
            best = (int(largest[radius]), v, radius)
    return (best[1], best[2]) if best and best[0] < 0.9 * len(points) else None


def build(points: np.ndarray, leaf: float) -> Nodes:
    """The tree over the sample ``points`` with about ``leaf`` of them in a leaf; empty if no split is worth it."""
    nodes: list[list[int]] = []
    leaves = 0
    todo = [(points, None)]
    while todo:
        own, slot = todo.pop()
        split = choose_split(own) if len(own) > leaf and len(nodes) < MAX_LEAVES else None
        me = len(nodes) if split else ~leaves
        if slot:
            nodes[slot[0]][slot[1]] = me
        if not split:
            leaves += 1
            continue
        nodes.append([int(split[0]), split[1], 0, 0])
        d = distances(own, split[0])
        todo += [(own[d <= split[1]], (me, 2)), (own[d > split[1]], (me, 3))]
    return [tuple(n) for n in nodes]


def shards_of(points: np.ndarray, nodes: Nodes) -> tuple[np.ndarray, np.ndarray]:
    """(row, leaf) pairs: every leaf that may hold a point within one bit of the row's fingerprint."""
    rows, leaves = [], []
    todo = [(np.arange(len(points)), 0 if nodes else ~0)]
    while todo:
        own, at = todo.pop()
        if not len(own):
            continue
        if at < 0:
            rows.append(own)
            leaves.append(np.full(len(own), ~at, dtype=np.int32))
            continue
        vantage, radius, left, right = nodes[at]
        d = distances(points[own], np.uint64(vantage)).astype(np.int16)
        todo += [(own[d - 1 <= radius], left), (own[d + 1 > radius], right)]
    return (np.concatenate(rows), np.concatenate(leaves)) if rows else (np.zeros(0, dtype=int), np.zeros(0, dtype=np.int32))


def star(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(point, root) for the points of a block that link to others; the root is the component's least index."""
    near = np.bitwise_count(points[:, None] ^ points[None, :]) <= BITS
    if near.sum() == len(points):
        return points[:0], points[:0]
    label = np.arange(len(points))
    while True:
        new = np.where(near, label[None, :], len(points)).min(axis=1)
        new = new[new]
        if (new == label).all():
            break
        label = new
    linked = label != np.arange(len(points))
    return points[linked], points[label[linked]]


def ball(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links through the points within one bit: each such point links its fingerprints to the least of them."""
    masks = np.concatenate(([0], 1 << np.arange(64, dtype=np.uint64))).astype("<u8")
    near, own = (points[:, None] ^ masks[None, :]).ravel(), np.repeat(points, len(masks))
    order = np.lexsort((own, near))
    near, own = near[order], own[order]
    first = np.flatnonzero(np.concatenate(([True], near[1:] != near[:-1])))
    least = np.repeat(own[first], np.diff(np.append(first, len(near))))
    linked = own != least
    pairs = np.unique(np.stack([own[linked], least[linked]]), axis=1)
    return pairs[0], pairs[1]


def links(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stars of all blocks of a shard, and the links of what no vantage point separates."""
    a, b, todo = [], [], [points]
    while todo:
        own = todo.pop()
        split = choose_split(own) if len(own) > BLOCK else None
        if split:
            d = distances(own, split[0]).astype(np.int16)
            todo += [own[d - 1 <= split[1]], own[d + 1 > split[1]]]
            continue
        x, y = star(own) if len(own) <= 2 * BLOCK else ball(own)
        a.append(x)
        b.append(y)
    return np.concatenate(a), np.concatenate(b)


def trees(placed: DataFrame, sizes: dict[int, int], sample: int, leaves: int) -> dict[int, Nodes]:
    """A tree for each of the given leaves of ``placed``, from about ``sample`` of its fingerprints; at most ``leaves`` nodes each."""
    some = placed.join(placed.sparkSession.createDataFrame(list(sizes.items()), "leaf long, size long"), "leaf")
    some = some.where(F.pmod(F.xxhash64("fp"), F.lit(1 << 30)) < F.lit(float(sample << 30)) / F.col("size"))

    def grow(part: pd.DataFrame) -> pd.DataFrame:
        own = np.unique(part["fp"].to_numpy(dtype="<i8").view("<u8"))
        nodes = build(own, max(2.0, len(own) / min(leaves, max(2, part["size"].iloc[0] // LEAF))))
        vantages = np.array([n[0] for n in nodes], dtype="<u8").view("<i8").tolist()
        return pd.DataFrame({"leaf": [part["leaf"].iloc[0]], "nodes": [[(v, *n[1:]) for v, n in zip(vantages, nodes, strict=True)]]})

    schema = "leaf long, nodes array<struct<vantage:long,radius:int,left:int,right:int>>"
    grown = some.groupBy("leaf").applyInPandas(grow, schema).collect()
    return {r["leaf"]: [(n[0] & (1 << 64) - 1, *n[1:]) for n in r["nodes"]] for r in grown}


def place(placed: DataFrame, by_leaf: dict[int, Nodes]) -> DataFrame:
    """``fp, leaf`` with every fingerprint in all leaves of its leaf's tree that may hold a point within one bit of it."""
    sent = placed.sparkSession.sparkContext.broadcast(by_leaf)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for leaf, part in batch.groupby("leaf"):
                values = part["fp"].to_numpy(dtype="<i8")
                rows, leaves = shards_of(values.view("<u8"), sent.value[leaf])
                yield pd.DataFrame({"fp": values[rows], "leaf": (leaf + 1) * (MAX_LEAVES + 1) + leaves.astype(np.int64)})

    return materialize(placed.mapInPandas(assign, "fp long, leaf long"))


def near_links(fps: DataFrame) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column ``fp``) that connect all of them within ``BITS`` bits."""

    def search(batch: pd.DataFrame) -> pd.DataFrame:
        a, b = links(np.unique(batch["fp"].to_numpy(dtype="<i8").view("<u8")))
        return pd.DataFrame({"a": a.view("<i8"), "b": b.view("<i8")})

    found, placed = [], materialize(fps.select("fp", F.lit(0).cast("long").alias("leaf")))
    sizes, sample, leaves, depth = {0: placed.count()}, SAMPLE, MAX_LEAVES, 0
    if sizes[0] > LEAF:
        # at most a row for each leaf and a tree of bounded size for each large one come back
        while sizes:
            grown = trees(placed, sizes, sample, leaves) if depth < MAX_DEPTH else {}
            by_leaf = {k: nodes for k, nodes in grown.items() if nodes}
            whole = [k for k in sizes if k not in by_leaf]
            if whole:
                found.append(dense_links(placed.where(F.col("leaf").isin(whole)).select("fp")))
            if not by_leaf:
                break
            inner = place(placed.where(F.col("leaf").isin(list(by_leaf))), by_leaf)
            sizes = {r["leaf"]: r["n"] for r in inner.groupBy("leaf").agg(F.count("*").alias("n")).where(F.col("n") > SHARD).collect()}
            large = F.col("leaf").isin(list(sizes)) if sizes else F.lit(False)
            found.append(inner.where(~large).groupBy("leaf").applyInPandas(search, "a long, b long"))
            placed, sample, leaves, depth = inner.where(large), OWN_SAMPLE, OWN_LEAVES, depth + 1
    else:
        found.append(placed.groupBy("leaf").applyInPandas(search, "a long, b long"))
    return reduce(DataFrame.unionByName, found)


def dense_links(fps: DataFrame) -> DataFrame:
    """Links through the points within one bit: each such point links its fingerprints to the least of them."""
    points = F.concat(F.array("fp"), F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.col("fp").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i))))
    near = fps.distinct().select("fp", F.explode(points).alias("point"))
    least = near.groupBy("point").agg(F.min("fp").alias("b"), F.count("*").alias("n")).where("n > 1")
    return near.join(least, "point").where("fp <> b").select(F.col("fp").alias("a"), "b").distinct()


def connected(edges: DataFrame) -> DataFrame:
    """(node, root) of all nodes of the links (a, b); the root is the component's least node."""

    def shape(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())

    edges = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = shape(edges)
    for _ in range(MAX_ROUNDS):
        if not before[0]:
            break
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        old, edges = edges, materialize(small.distinct())
        drop(old)
        after = shape(edges)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def rooted(fps: DataFrame) -> DataFrame:
    """``fp, root`` of distinct fingerprints: the least fingerprint among all linked to it."""
    fps = materialize(fps)
    roots = connected(near_links(fps))
    return materialize(fps.join(roots, fps["fp"] == roots["node"], "left").select("fp", F.coalesce("root", "fp").alias("root")))


def classes(prints: DataFrame, doc_id: str = "doc_id", roots: DataFrame | None = None) -> DataFrame:
    """One row for each fingerprint: ``fp, root, component_id`` (the least id among all linked to it).

    ``prints`` has the ids and ``fp``; it is read several times: materialize it. ``roots`` are those of ``rooted``, maybe wider.
    """
    roots = rooted(prints.select("fp").distinct()) if roots is None else roots
    named = materialize(prints.groupBy("fp").agg(F.min(doc_id).alias("own")).join(roots, "fp"))
    least = materialize(named.groupBy("root").agg(F.min("own").alias("component_id")))
    return materialize(named.select("fp", "root").join(least, "root").select("fp", "root", "component_id"))


def components(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``fp, doc_id, root, component_id`` for each row of ``docs``."""
    prints = materialize(with_fingerprint(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "text").select("doc_id", "fp"))
    return prints.join(classes(prints), "fp")


def sketched(docs: DataFrame, order: tuple[np.ndarray, np.ndarray] | None) -> DataFrame:
    """``id, row, key, fp`` of ``docs`` (``id``, ``t``), and ``n, prefix, bits`` of ``similar.sketch`` for a given order of shingles."""
    spark = docs.sparkSession
    python_ready(spark)
    sent = spark.sparkContext.broadcast(order)
    more = {"n": "int", "prefix": "array<long>", "bits": "array<long>"} if order else {}

    @F.pandas_udf("struct<" + ", ".join(f"{c}: {t}" for c, t in {"fp": "long", **more}.items()) + ">")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = []
            for t in texts:
                words = similar.words_of(t)
                rows.append((fingerprint_of(words), *(similar.sketch(words, sent.value) if order else ())))
            yield pd.DataFrame(rows, columns=["fp", *more])

    rows = docs.select("id", F.monotonically_increasing_id().alias("row"), F.xxhash64("t").alias("key"), run("t").alias("s"))
    return materialize(rows.select("id", "row", "key", "s.*"))


def keep_one(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", similar_too: bool = False) -> DataFrame:
    """One row of each component: the one with its id; among rows with this id, one of the least fingerprint.

    ``similar_too`` also links texts whose five-word shingles have a similarity of 0.8 or more. Keepers are chosen on narrow
    rows. Rows that go, or that repeat, are marked in a bitmap of bounded size by a hash of id and checksum of the text; documents
    that no mark meets stay without being shuffled, the others meet the narrow rows exactly. The more marks, the more documents are
    looked at needlessly, with the same result.
    """
    source = docs.select(F.col(doc_id).alias("id"), F.xxhash64(text).alias("key"), F.struct("*").alias("row"))
    texts = docs.select(F.xxhash64(text).alias("key"), F.col(doc_id).alias("id"), F.col(text).alias("text"))
    if similar_too:
        python_ready(docs.sparkSession)
    prints = sketched(docs.select(F.col(doc_id).alias("id"), F.col(text).alias("t")), similar.common_shingles(texts) if similar_too else None)
    roots = rooted(prints.select("fp").distinct())
    if similar_too:
        by_key = materialize(prints.groupBy("key").agg(F.min("id").alias("id"), F.min("fp").alias("fp")).join(roots, "fp").select("key", "id", "root"))
        more = similar.links(prints.select("key", "n", "prefix", "bits"), by_key.select("key", "root"), texts, by_key.select("key", "id"), connected)
        wider = materialize(connected(more).select("node", F.col("root").alias("wider")))
        roots = materialize(roots.join(wider, roots["root"] == wider["node"], "left").select("fp", F.coalesce("wider", "root").alias("root")))
    all_rows = prints.select("id", "row", "key", "fp").join(classes(prints.select("id", "fp"), "id", roots), "fp")
    own = all_rows.where(F.col("id").eqNullSafe(F.col("component_id")))
    chosen = own.groupBy("root", "component_id").agg(F.min_by(F.struct("id", "key"), F.struct("fp", "row")).alias("kept"))
    chosen = chosen.select(F.col("kept.id").alias("kept_id"), F.col("kept.key").alias("kept_key"))
    same = lambda x, y: F.col(f"{x}id").eqNullSafe(F.col(f"{y}id")) & (F.col(f"{x}key") == F.col(f"{y}key"))
    times = prints.groupBy("id", "key").agg(F.count("*").alias("times"))
    times = materialize(times.join(chosen, same("", "kept_"), "left").select("id", "key", "times", F.col("kept_key").isNotNull().alias("kept")))
    drop(prints)
    source = with_mark(source, times.where("not kept or times > 1"))
    seen = source.where("mark").join(times.where("kept").select(F.col("id").alias("kept_id"), F.col("key").alias("kept_key"), "times"), same("", "kept_"))
    kept = source.where("not mark").select("row.*").unionByName(seen.where("times = 1").select("row.*"))
    if times.where("kept and times > 1").isEmpty():
        return kept
    return kept.unionByName(seen.where("times > 1").dropDuplicates(["kept_id", "kept_key"]).select("row.*"))


def with_mark(rows: DataFrame, marked: DataFrame) -> DataFrame:
    """Add ``mark``: true for all rows whose ``id, key`` stand in ``marked``, and for a few others.

    A bitmap of up to ``MARKS`` bits, about 64 for each marked row, is sent as at most ``MARKS`` / 64 words of it.
    """
    bits = min(MARKS, max(1 << 12, 1 << (64 * marked.count()).bit_length()))
    spot = F.pmod(F.xxhash64("id", "key"), F.lit(bits))
    word, shift = F.shiftright(spot, 6), F.pmod(spot, F.lit(64)).cast("int")
    words = marked.select(word.alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), shift).alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("word_bits"))
    met = rows.withColumn("word", word).withColumn("shift", shift).join(F.broadcast(words), "word", "left")
    one = F.call_function("shiftright", F.col("word_bits"), F.col("shift")).bitwiseAND(F.lit(1)) == 1
    return met.withColumn("mark", F.coalesce(one, F.lit(False))).drop("word", "shift", "word_bits")
