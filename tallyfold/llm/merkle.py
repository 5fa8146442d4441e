"""A Merkle manifest of a table: one ternary hash tree for each group of rows and one over the groups' roots.

The tree is stored as aligned subtrees of ``HEIGHT`` levels, one row of a table each. Inside such a block the nodes lie in van
Emde Boas order: the upper half of the levels first, then each lower subtree, both laid out the same way; ``addresses`` gives
the place of every node, for building and for finding siblings. The roots of a group's blocks are the leaves of its next
blocks, and so on until each group has one block; the groups' roots are then a tree of their own, built the same way.

Leaves are placed by range partitions and offsets, never by one task; a block has 729 leaves at most, so a group of any size
is spread. Upper blocks hand the siblings above them down to their members, one short text for each block. Only the root
comes to the driver.

Rows ascend by id within a group, null ids first, equal ids by their leaf; rows that repeat entirely are interchangeable.
The null group comes first, then groups by their UTF-8 bytes. Null fields count as ``-``, empty texts as ``0:``. A lone leaf
is its group's root and has no siblings; an empty table gives no rows. Long texts are hashed inside the scan. Further columns
do not matter, as fields are named.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import cache
from hashlib import sha256

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyfold.llm.common import materialize, python_ready

ARITY, HEIGHT = 3, 6
LEAVES = ARITY**HEIGHT
DIGEST = 32
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
ROWS = 4096  # of a result handed back at once


@cache
def addresses(levels: int) -> tuple[np.ndarray, ...]:
    """For each depth of a full tree of so many levels, the places of its nodes in van Emde Boas order."""
    if levels == 1:
        return (np.zeros(1, dtype=np.int64),)
    upper, lower = levels // 2, levels - levels // 2
    nodes = lambda n: (ARITY**n - 1) // (ARITY - 1)
    starts = nodes(upper) + np.arange(ARITY**upper) * nodes(lower)
    return (*addresses(upper), *[(starts[:, None] + a[None, :]).ravel() for a in addresses(lower)])


def height_of(n: int, block: int) -> int:
    """Levels of hashes above the leaves: later blocks of a group are as high as full ones, a lone block only as needed."""
    return HEIGHT if block else next(h for h in range(HEIGHT + 1) if ARITY**h >= n)


def digest(parts: str) -> bytes:
    return sha256(parts.encode()).digest()


def build(leaves: Sequence[bytes], height: int) -> bytes:
    """The block over ``leaves``: every node at its address, the root first; places without a node stay zero."""
    places = addresses(height + 1)
    out = bytearray(DIGEST * (int(places[-1].max()) + 1))
    row = list(leaves)
    for depth in range(height, -1, -1):
        for at, node in zip((places[depth] * DIGEST).tolist(), row, strict=False):
            out[at : at + DIGEST] = node
        if depth:
            row = [digest("".join(x.hex() for x in row[i : i + ARITY])) for i in range(0, len(row), ARITY)]
    return bytes(out)


def node(nodes: bytes, place: int) -> str:
    return nodes[place * DIGEST : (place + 1) * DIGEST].hex()


def steps(nodes: bytes, n: int, height: int) -> list[str]:
    """For each leaf, ``before:after`` (siblings as hex text) of every level from the leaf up, joined by ``;``."""
    places, at_depth = addresses(height + 1), []
    for depth in range(height, 0, -1):
        row = [node(nodes, p) for p in places[depth][:n].tolist()]
        own = []
        for i in range(n):
            first = i - i % ARITY
            own.append("".join(row[first:i]) + ":" + "".join(row[i + 1 : first + ARITY]))
        at_depth.append(own)
        n = -(-n // ARITY)
    return [";".join(own[i // ARITY**k] for k, own in enumerate(at_depth)) for i in range(len(at_depth[0]))] if at_depth else [""]


def joined(low: str, high: str) -> str:
    return f"{low};{high}" if low and high else low or high


def fold(leaf: str, path: str) -> str:
    """The root that ``leaf`` and its siblings give."""
    for step in path.split(";") if path else ():
        before, after = step.split(":")
        leaf = sha256(f"{before}{leaf}{after}".encode()).hexdigest()
    return leaf


def siblings_digest(path: str) -> str:
    return sha256(path.replace(":", "").replace(";", "").encode()).hexdigest()


def leaf_hash(fields: Sequence[Column]) -> Column:
    """SHA-256 (binary) over the fields: ``-`` for null, else UTF-8 bytes, a colon and the value."""
    one = lambda c: F.when(c.isNull(), "-").otherwise(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c))
    return F.unhex(F.sha2(F.concat(*[one(c.cast("string")) for c in fields]), 256))


def ranked(rows: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """Add ``rank`` (from 0) within ``key``: range partitions, and for each the rows of its keys in earlier ones."""
    placed = rows.repartitionByRange(key, *order).sortWithinPartitions(key, *order)
    placed = materialize(placed.select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("_at")))
    runs = placed.groupBy(key, "_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition at most
    runs = materialize(runs.select(key, "_part", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift")))
    return placed.join(runs, [key, "_part"]).withColumn("rank", F.col("_at") + F.col("_shift")).drop("_part", "_at", "_shift")


def stored(rows: DataFrame, payload: Sequence[str] = ()) -> DataFrame:
    """Blocks ``key, block, n, nodes, top`` of ``rows`` (``key, rank, hash``); payload columns (strings or binary) become arrays in leaf order."""
    kinds = dict(rows.dtypes)

    def store(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("rank")
        block = int(part["block"].iloc[0])
        nodes = build([bytes(x) for x in part["hash"]], height_of(len(part), block))
        own = {c: [part[c].tolist()] for c in payload}
        return pd.DataFrame({"key": [part["key"].iloc[0]], "block": [block], "n": [len(part)], "nodes": [nodes], "top": [nodes[:DIGEST]], **own})

    schema = "key string, block long, n int, nodes binary, top binary" + "".join(f", {c} array<{kinds[c]}>" for c in payload)
    cut = rows.select("key", "rank", "hash", *payload, F.floor(F.col("rank") / F.lit(LEAVES)).cast("long").alias("block"))
    return materialize(cut.groupBy("key", "block").applyInPandas(store, schema))


def raised(blocks: DataFrame) -> list[DataFrame]:
    """``blocks`` and the blocks over them, until every key has one: lowest first."""
    levels = [blocks]
    while not levels[-1].where("block > 0").isEmpty():
        levels.append(stored(levels[-1].select("key", F.col("block").alias("rank"), F.col("top").alias("hash"))))
    return levels


@dataclass
class Manifest:
    """Blocks of the groups (``groups``) and of the tree over the groups' roots (``whole``), lowest level first."""

    groups: list[DataFrame]
    order: DataFrame  # key, rank, hash of each group's root
    whole: list[DataFrame]
    root: str | None


def manifest(leaves: DataFrame, order: Sequence[str], payload: Sequence[str] = ()) -> Manifest:
    """The manifest of ``leaves`` (``key`` not null, ``hash``, and the columns of ``order``, which are never null together with a tie)."""
    groups = raised(stored(ranked(leaves, "key", order), payload))
    roots = groups[-1].select(F.lit("").alias("key"), F.col("key").alias("member"), F.col("top").alias("hash"))
    placed = materialize(ranked(roots, "key", ["member"]))
    whole = raised(stored(placed))
    top = whole[-1].select(F.lower(F.hex("top"))).first()
    return Manifest(groups, placed, whole, top[0] if top else None)


def handed_down(blocks: DataFrame, above: DataFrame) -> DataFrame:
    """``key, block, path, subroot`` for each leaf of ``blocks``: its own siblings, then those that ``above`` has for the block."""

    def expand(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for key, block, n, nodes, path, subroot in batch.itertuples(index=False, name=None):
                own = [joined(s, path) for s in steps(nodes, n, height_of(n, block))]
                yield pd.DataFrame({"key": key, "block": block * LEAVES + np.arange(n), "path": own, "subroot": subroot})

    rows = blocks.join(above, ["key", "block"]).select("key", "block", "n", "nodes", "path", "subroot")
    return materialize(rows.mapInPandas(expand, "key string, block long, path string, subroot string"))


def paths_above(made: Manifest) -> DataFrame:
    """``key, block, path, subroot`` for each lowest block of the groups: the siblings from its root up to the manifest's."""
    above = made.whole[-1].select("key", "block", F.lit("").alias("path"), F.lit("").alias("subroot"))
    for blocks in reversed(made.whole):
        above = handed_down(blocks, above)
    named = above.join(made.order.select(F.col("rank").alias("block"), "member", "hash"), "block")
    above = named.select(F.col("member").alias("key"), F.lit(0).cast("long").alias("block"), "path", F.lower(F.hex("hash")).alias("subroot"))
    for blocks in reversed(made.groups[1:]):
        above = handed_down(blocks, above)
    return above


def audit(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", fields: Sequence[str] = FIELDS, text: str = "text", tampered: Column | None = None) -> DataFrame:
    """``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified`` for each row of ``docs``.

    ``tampered`` is the text as found now (null where it is unchanged, as by default everywhere): its leaf is folded with the
    siblings of the manifest, and a row is verified if that gives the manifest's root.
    """
    python_ready(docs.sparkSession)
    own = [docs[c] for c in fields]
    now = F.lit(None).cast("string") if tampered is None else tampered
    changed = F.when(now.isNotNull(), leaf_hash([now if c == text else docs[c] for c in fields]))
    key = F.coalesce(F.concat(F.lit("s"), docs[source].cast("string")), F.lit(""))  # keeps the order, null first
    rows = docs.select(key.alias("key"), docs[doc_id].alias("id"), docs[doc_id].cast("string").alias("name"), leaf_hash(own).alias("hash"), changed.alias("found"), F.monotonically_increasing_id().alias("row"))
    made = manifest(materialize(rows), ["id", "hash", "row"], ["name", "found"])

    def prove(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ("doc_id", "leaf", "subroot", "proof_sha256", "folded_root")
        out: list[tuple] = []
        for batch in batches:
            for block, n, nodes, names, found, path, subroot in batch.itertuples(index=False, name=None):
                height = height_of(n, block)
                leaves = [node(nodes, p) for p in addresses(height + 1)[height][:n].tolist()]
                for name, leaf, other, low in zip(names, leaves, found, steps(nodes, n, height), strict=True):
                    whole = joined(low, path)
                    out.append((name, leaf, subroot, siblings_digest(whole), fold(leaf if other is None else other.hex(), whole)))
                if len(out) >= ROWS:
                    yield pd.DataFrame(out, columns=columns)
                    out = []
        if out:
            yield pd.DataFrame(out, columns=columns)

    blocks = made.groups[0].join(paths_above(made), ["key", "block"]).select("block", "n", "nodes", "name", "found", "path", "subroot")
    proved = blocks.mapInPandas(prove, "doc_id string, leaf string, subroot string, proof_sha256 string, folded_root string")
    root = F.lit(made.root).cast("string")
    return proved.select(F.col("doc_id").cast(docs.schema[doc_id].dataType).alias("doc_id"), "leaf", "subroot", root.alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == root).alias("verified"))


def without_newlines(doc_id: Column, text: Column) -> Column:
    """The tampered text of the rows whose id has an even checksum: its newlines are gone; null elsewhere."""
    return F.when(F.crc32(doc_id.cast("string").cast("binary")) % 2 == 0, F.replace(text, F.lit("\n"), F.lit("")))
