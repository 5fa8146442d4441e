"""One SHA-256 over an ordered sequence of rows, by a tree over rank ranges."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfold.operators.windows import global_rank
from tallyfold.sources.shared import materialize

BLOCK = 4096
#: Characters of a hash, and a block that holds any number of lines.
HEX, ALL = 64, 1 << 62


def pieces(level: DataFrame, block: int) -> DataFrame:
    """``_block, place, n, text`` of ``place, hash``: the joined hashes of ``n`` consecutive places of a block; of a whole block, their hash.

    Rows may come in any order. Where they come by place, as they are read after a sort, only blocks at the ends of what a task reads
    are in more than one piece, and of all others one hash is left to be shuffled.
    """
    columns = ("_block", "place", "n", "text")
    schema = pa.schema(list(zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)))

    def made(found: list[tuple[int, str]]) -> pa.RecordBatch:
        rows = [(place // block, place, len(text) // HEX, text) for place, text in found]
        rows = [(*row, hashlib.sha256(text.encode()).hexdigest() if row[-1] == block else text) for *row, text in rows]
        return pa.RecordBatch.from_pylist([dict(zip(columns, row, strict=True)) for row in rows], schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, held = 0, ""  # the last piece may go on in the next batch
        for batch in batches:
            places, hashes, found = batch.column("place").to_numpy(), batch.column("hash").to_pylist(), []
            cuts = (np.flatnonzero((np.diff(places) != 1) | (places[1:] % block == 0)) + 1).tolist()
            for start, end in zip([0, *cuts], [*cuts, len(hashes)], strict=True) if hashes else ():
                place = int(places[start])
                if held and (place % block == 0 or place != first + len(held) // HEX):
                    found.append((first, held))
                    held = ""
                first, held = first if held else place, held + "".join(hashes[start:end])
            if found:
                yield made(found)
        if held:
            yield made([(first, held)])

    return level.mapInArrow(run, "_block long, place long, n long, text string")


def ordered_digest(rows: DataFrame, order: Sequence, line: Column, block: int = BLOCK, levels: int | None = None) -> DataFrame:
    """One row ``n, digest``: how many rows there are and a hash that changes with any row and with their order.

    Each line is hashed; the hashes (hex) of ``block`` lines by rank are joined and hashed, then those of ``block`` blocks, until
    one is left. No task holds more than ``block`` hashes at once; where ``levels`` is given, the last of so many levels joins all that
    are left (of n lines, one in ``block ** (levels - 1)``). ``order`` must tell rows apart that differ. Null lines count as ``null``;
    no rows at all give the hash of nothing. ``rows`` are shuffled and written as they are, so let ``line`` be made of their columns:
    lines and their hashes, which are longer and do not compress, come into being after the sort and stay inside tasks.
    """
    ranked = global_rank(rows, order, "_rank")
    level = ranked.select((F.col("_rank") - 1).cast("long").alias("place"), F.sha2(F.coalesce(line, F.lit("null")), 256).alias("hash"))
    size = ALL if levels == 1 else block
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "text"))), lambda x: x["text"]), "")
    hashed = F.when(F.max("n") == size, F.max("text")).otherwise(F.sha2(joined, 256))
    level = materialize(pieces(level, size).groupBy("_block").agg(F.sum("n").alias("n"), hashed.alias("hash")).withColumnRenamed("_block", "place"))
    n, left = level.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    level_no = 1
    while left > 1:
        level_no += 1
        joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "hash"))), lambda x: x["hash"]), "")
        place = F.lit(0).cast("long") if level_no == levels else F.floor(F.col("place") / F.lit(block)).cast("long")
        level = materialize(level.groupBy(place.alias("_block")).agg(F.sha2(joined, 256).alias("hash")).select(F.col("_block").alias("place"), "hash"))
        left = level.count()
    return level.agg(F.lit(n).cast("long").alias("n"), F.coalesce(F.max("hash"), F.sha2(F.lit(""), 256)).alias("digest"))
