"""Sharding along a Hilbert curve over quantised metadata.

Language, source and size are quantised to ``BITS`` bits each; the curve index of that cell orders the rows, so that a run
of rows stays close in all three and files can be pruned by any. Languages and sources are quantised by their quantiles in
alphabetical order, so that neighbouring coordinates are neighbouring names. Runs are cut by row count (law ``rows``: counts at most
one apart). Equal texts take the metadata of one of them and follow each other in the order.

Null texts have size 16 and the checksum of the empty text, and form one group with empty ones; null languages and sources
have a cell value of their own. Ties in the whole order (same text, same id) are rows that cannot be told apart. An empty
table gives no rows. Other columns of the input are not read.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyfold.llm.common import let, materialize

BITS = 5
DIMS = 3
SHARDS = 40
#: monotonically_increasing_id: the partition above these bits, the row's place in it below.
PLACE_BITS = 33


def curve_tables(dims: int = DIMS) -> tuple[list[int], list[int]]:
    """Digit and next state for each (state, cell of the level), from the Gray code; a state is an entry corner and a direction."""
    size = 1 << dims
    rotl = lambda x, k: ((x << k % dims) | (x >> (dims - k % dims))) & (size - 1)
    rotr = lambda x, k: rotl(x, dims - k % dims)
    gray = lambda i: i ^ (i >> 1)
    place = {gray(i): i for i in range(size)}
    trailing = lambda i: (i & -i).bit_length() - 1 if i else 0
    ones = lambda i: next(k for k in range(dims + 1) if not i >> k & 1)
    entry = lambda w: 0 if w == 0 else gray(2 * ((w - 1) // 2))
    turn = lambda w: 0 if w == 0 else ones(w - 1) % dims if w % 2 == 0 else ones(w) % dims
    digits, states = [], []
    for state in range(size * dims):
        corner, direction = divmod(state, dims)
        for cell in range(size):
            w = place[rotr(cell ^ corner, direction + 1)]
            digits.append(w)
            states.append((corner ^ rotl(entry(w), direction + 1)) * dims + (direction + turn(w) + 1) % dims)
    return digits, states


def curve_index(values: list[Column], bits: int = BITS) -> Column:
    """Hilbert index of a cell whose coordinates are ``values`` (ints below 2**bits)."""
    dims = len(values)
    digits, states = (F.array(*[F.lit(x) for x in t]) for t in curve_tables(dims))
    point = F.array(*values)

    def walk(p: Column) -> Column:
        def step(acc: Column, level: Column) -> Column:
            bit = lambda d: F.call_function("shiftright", F.get(p, F.lit(d)), level).bitwiseAND(F.lit(1))
            cell = sum((bit(d) * (1 << (dims - 1 - d)) for d in range(1, dims)), bit(0) * (1 << (dims - 1)))
            at = acc["state"] * (1 << dims) + cell
            return F.struct((acc["h"] * (1 << dims) + F.get(digits, at)).alias("h"), F.get(states, at).alias("state"))

        return F.aggregate(F.sequence(F.lit(bits - 1), F.lit(0)), F.struct(F.lit(0).alias("h"), F.lit(0).alias("state")), step, lambda acc: acc["h"])

    return let(point, walk)


def name_bounds(rows: DataFrame, name: str) -> list[tuple[str, int]]:
    """The least name of each cell and the cell: names in alphabetical order, each at the share of all rows that come before it.

    Rows are counted by name before the shuffle; the distinct names are sorted over all tasks, and a row for each task and one
    for each cell come back, however many names there are. A name stands in one cell only.
    """
    names = rows.where(F.col(name).isNotNull()).groupBy(F.col(name).alias("name")).agg(F.count("*").alias("n"))
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = materialize(names.repartitionByRange(parts, "name").withColumn("part", F.spark_partition_id()))
    sums = sorted((r["part"], r["n"]) for r in names.groupBy("part").agg(F.sum("n").alias("n")).collect())
    if not sums:
        return []
    starts = dict(zip((p for p, _ in sums), itertools.accumulate((n for _, n in sums), initial=0), strict=False))
    before = F.create_map(*[F.lit(x) for item in starts.items() for x in item])
    inside = Window.partitionBy("part").orderBy("name").rowsBetween(Window.unboundedPreceding, -1)
    place = F.element_at(before, F.col("part")) + F.coalesce(F.sum("n").over(inside), F.lit(0))
    cell = F.floor(place * F.lit((1 << BITS) - 1) / F.lit(sum(n for _, n in sums)))
    cells = names.select("name", cell.alias("cell")).groupBy("cell").agg(F.min("name").alias("least")).collect()
    return [(r["least"], r["cell"]) for r in sorted(cells, key=lambda r: r["cell"])]


def quantised(lang: Column, source: Column, size: Column, langs: list[tuple[str, int]], sources: list[tuple[str, int]]) -> list[Column]:
    """Names by their cell in alphabetical order (0 for null), sizes by half powers of two."""
    top = (1 << BITS) - 1

    def name(c: Column, bounds: list[tuple[str, int]]) -> Column:
        known = F.array(*[F.struct(F.lit(least).alias("least"), F.lit(cell + 1).alias("cell")) for least, cell in bounds])
        return F.coalesce(F.array_max(F.transform(F.filter(known, lambda x: x["least"] <= c), lambda x: x["cell"])) if bounds else F.lit(0), F.lit(0))

    return [name(lang, langs), name(source, sources), F.least(F.lit(top), F.floor(2 * F.log2(size / 16)).cast("int"))]


def ordered(docs: DataFrame) -> DataFrame:
    """``doc_id, size, text_crc32, h, rank`` with the rank gapless from 0 along the curve.

    One range shuffle of narrow rows sorts them; each row's rank is its place in its partition plus the partitions before.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", F.col("lang").alias("lang"), F.col("source").alias("source"), (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("digest"))
    rows = materialize(rows)
    same = ["digest", "text_crc32", "size"]
    groups = rows.groupBy(*same).agg(F.min(F.struct(F.col("lang"), F.col("source"))).alias("meta"))
    cells = quantised(F.col("meta.lang"), F.col("meta.source"), F.col("size"), name_bounds(rows, "lang"), name_bounds(rows, "source"))
    groups = materialize(groups.select(*same, curve_index(cells).alias("h")))
    keyed = rows.select("doc_id", *same).join(groups, same)
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["h", "digest", "text_crc32", "size", F.xxhash64("doc_id"), "doc_id"]
    placed = materialize(keyed.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()))
    part = F.shiftrightunsigned("at", PLACE_BITS)
    counts = sorted((r["p"], r["n"]) for r in placed.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect())  # a row for each partition
    before, offsets = 0, {}
    for p, n in counts:
        offsets[p] = before
        before += n
    starts = F.array(*[F.lit(offsets.get(p, 0)).cast("long") for p in range(max(offsets, default=0) + 1)])
    place = F.col("at").bitwiseAND(F.lit((1 << PLACE_BITS) - 1))
    return placed.select("doc_id", "size", "text_crc32", "h", (F.get(starts, part.cast("int")) + place).alias("rank"), F.lit(before).cast("long").alias("total"))


def shards(docs: DataFrame, n: int = SHARDS) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard, h``: shard is rank x n div total, slot the place in the shard."""
    rows = ordered(docs)
    shard = F.expr(f"(rank * {n}L) div total")
    first = F.expr(f"(shard * total + {n - 1}L) div {n}L")
    out = rows.withColumn("shard", shard)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), (F.col("rank") - first).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "h")
