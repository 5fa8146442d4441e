"""Links between texts whose sets of five-word shingles have a similarity (Jaccard) of 0.8 or more.

Shingles stand in one order for all texts: by how common they are in a bounded sample, then by hash. Of two similar texts
with n shingles at most, at least 4 n / 5 are shared, so that the first n / 5 + 1 of both share one (prefix filter). The sample
only decides how many texts share a prefix shingle, never which links are found. ``sketch`` gives these prefixes in one pass.

Only prefix shingles whose texts lie in several components count (what is linked already needs no link). In each round every
text outside a shingle's first component meets some texts of other components there, drawn by a hash, and is compared in full with
the one that it shares most shingles with; what this links becomes one component. These rounds see an eighth of the shingles, as
near copies share most. At last all pairs that share any prefix shingle but lie in different components still are compared. Two exact
bounds sort out pairs before any text is read: how far into both prefixes the shared shingle stands, and the bits in which the
parities of the shingle hashes differ (each is a shingle that only one of the two has). A text has about as many parity bits as
shingles, so the bound holds for long texts, too; of two texts the finer bits are folded onto the coarser ones.

These last pairs are never rows of a join: the rows of a shingle are dealt into blocks, and each task compares the bits of two
blocks by itself (``nearest``). Of each row it gives the ``NEAREST`` texts that the bounds allow. Where a row has more of them, what the
nearest link becomes one component and the rest is looked at again; where that links nothing more, all are given. So texts that
no link joins meet in arithmetic only, and rows grow with the texts.

Words are cut at ASCII blanks and compared in lower case; a text under five words is one shingle. Null texts and texts
without words have no link. The result has links enough to connect what is similar, not every similar pair.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfold.llm.common import drop, materialize

WORDS = 5
#: Texts are similar when SHARE[1] * shared shingles >= SHARE[0] * all shingles of both.
SHARE = (4, 5)
#: Texts whose shingles are counted for the order, and most shingles of the order that are sent.
SAMPLE = 1 << 14
MAX_COMMON = 200_000
#: Rounds before all pairs are compared: one of how many shingles they see, and how many texts of each are drawn.
ROUNDS = ((8, (4, 16, 16)),)
#: Rows of a shingle in a block and most blocks of a shingle, texts given for each row, and pairs that a task compares at once.
BLOCK, MOST_BLOCKS = 256, 16
NEAREST = 4
PAIRS = 1 << 18
#: Words of parity bits that stand beside each row of a shingle; longer ones are folded, and ``near`` has all of them.
FOLDED = 16
#: Keys that are sent to all executors to pick texts; more keys are joined by a shuffle.
MAX_SENT = 1 << 20


def shingles(words: list[bytes]) -> set[bytes]:
    if len(words) < WORDS:
        return {b" ".join(words)} if words else set()
    return set(map(b" ".join, zip(*[words[i:] for i in range(WORDS)], strict=False)))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").lower().split()


def hashes(words: list[bytes]) -> np.ndarray:
    found = shingles(words)
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(s) for s in found), dtype="<u8", count=len(found)))


def prefix(found: np.ndarray, common: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The first hashes of a text in the common order, as many as a similar text must share one of."""
    if not len(found):
        return found
    size = len(found) - -(-SHARE[0] * len(found) // SHARE[1]) + 1
    if not len(common):
        return found[:size]
    at = np.minimum(np.searchsorted(common, found), len(common) - 1)
    return found[np.lexsort((found, np.where(common[at] == found, count[at], 0)))[:size]]


def parity(found: np.ndarray) -> np.ndarray:
    """For each residue of the hashes whether an odd number of them has it; as many residues as the next power of two (64 at least)."""
    size = max(64, 1 << (len(found) - 1).bit_length()) if len(found) else 64
    odd = np.bincount((found >> np.uint64(32)).astype(np.int64) % size, minlength=size) & 1
    return np.packbits(odd.astype(np.uint8)).view("<i8")


def sketch(words: list[bytes], order: tuple[np.ndarray, np.ndarray]) -> tuple[int, np.ndarray, np.ndarray]:
    """How many shingles a text has, its prefix and its parities."""
    found = hashes(words)
    return len(found), prefix(found, *order).view("<i8"), parity(found)


def similar(a: str | None, b: str | None) -> bool:
    x, y = shingles(words_of(a)), shingles(words_of(b))
    both = len(x & y)
    return both > 0 and SHARE[1] * both >= SHARE[0] * (len(x) + len(y) - both)


def apart() -> Column:
    """In how many parity bits two texts differ (the other's columns end in ``_``): no more than the shingles only one has.

    Sizes within the bound of ``possible`` differ by a factor of 5 / 4 at most, so one halving makes the bits equally long.
    """

    def halved(bits: str, other: str) -> Column:
        half = (F.size(bits) / 2).cast("int")
        return F.when(F.size(bits) > F.size(other), F.zip_with(F.slice(bits, 1, half), F.slice(bits, half + 1, half), lambda x, y: x.bitwiseXOR(y))).otherwise(F.col(bits))

    differing = F.zip_with(halved("bits", "bits_"), halved("bits_", "bits"), lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    return F.aggregate(differing, F.lit(0), lambda total, n: total + n)


def possible() -> Column:
    """Whether two texts may be similar whose first shared shingle stands at ``at``: SHARE[0] / sum(SHARE) of both are shared."""
    return sum(SHARE) * F.least(F.col("n") - F.col("at"), F.col("n_") - F.col("at_")) >= SHARE[0] * (F.col("n") + F.col("n_"))


def common_shingles(texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (sorted) that several texts of a sample have, and in how many."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"token": np.concatenate([hashes(words_of(t)) for t in batch["text"]] or [np.zeros(0, "<u8")]).view("<i8")})

    total = texts.count()
    some = texts.where(F.pmod(F.xxhash64("key"), F.lit(1 << 30)) < int(min(1.0, SAMPLE / max(1, total)) * (1 << 30)))
    rows = some.select("text").mapInPandas(run, "token long").groupBy("token").agg(F.count("*").alias("n")).where("n > 2")
    got = rows.orderBy(F.desc("n"), "token").limit(MAX_COMMON).toPandas()
    tokens, count = got["token"].to_numpy(dtype="<i8").view("<u8"), got["n"].to_numpy(dtype=np.int64)
    order = np.argsort(tokens)
    return tokens[order], count[order]


OWN = ("key", "n", "at", "root")


def open_rows(rows: DataFrame) -> DataFrame:
    """The rows of shingles (``token``) that several components share, with the first of these as ``first``."""
    tokens = rows.groupBy("token").agg(F.min("root").alias("first"), F.max("root").alias("last")).where("first <> last").select("token", "first")
    return rows.join(materialize(tokens), "token")


def partnered(tokens: DataFrame) -> DataFrame:
    """The rows of ``tokens`` (``token, key, n, at``) whose shingle other texts have, too, of sizes that ``possible`` allows.

    ``most`` is four times the greatest size of a similar text. Counts and rows read the same exchange, so that the prefixes are
    shuffled once; a frequent shingle's rows only pass by, none are gathered. (``coalesce`` keeps Spark from adding null checks to
    one side only, after which the exchanges would differ.)
    """
    tokens = tokens.withColumn("most", sum(SHARE) * (F.col("n") - F.col("at")) - SHARE[0] * F.col("n")).repartition("token")
    seen = tokens.groupBy("token").agg(F.min("key").alias("a"), F.max("key").alias("b"), F.min("n").alias("least"), F.max("most").alias("widest"), F.min("at").alias("first"))
    fits = (SHARE[0] * F.col("least") <= F.col("most")) & (SHARE[0] * F.col("n") <= F.col("widest")) & (F.col("first") <= F.col("at"))
    return tokens.join(seen.where("a <> b"), "token").where(F.coalesce(fits, F.lit(False))).select("token", "key", "n", "at")


def shared_prefixes(sketches: DataFrame, roots: DataFrame, every: int = 1) -> DataFrame:
    """``token, first`` and ``OWN``: the texts (by ``key``, once each) of the prefix shingles that several components share.

    Of the shingles about one of ``every`` counts, the same ones for all texts. ``at`` is the shingle's place in the text's prefix.
    ``roots`` (``key, root``) meet only the rows of shingles that several texts have.
    """
    tokens = sketches.select("key", "n", F.posexplode("prefix").alias("at", "token")).where(F.pmod("token", F.lit(every)) == 0)
    several = materialize(partnered(tokens))
    rows = materialize(several.dropDuplicates(["token", "key"]).join(roots, "key").select("token", *OWN))
    out = materialize(open_rows(rows).select("token", "first", *OWN))
    drop(several, rows)
    return out


def picked(table: DataFrame, pairs: DataFrame) -> DataFrame:
    """One row of ``table`` for each ``key`` among pairs (a, b). Few keys are sent to all executors, so that the table stays in place."""
    wanted = materialize(pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct())
    some = F.broadcast(wanted) if wanted.count() <= MAX_SENT else wanted
    found = materialize(table.join(some, "key", "leftsemi").dropDuplicates(["key"]))
    drop(wanted)
    return found


def near(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """The pairs (a, b) of keys whose parity bits allow similar texts."""
    found = picked(sketches.select("key", "n", "bits"), pairs)
    for c, end in (("a", ""), ("b", "_")):
        pairs = pairs.join(found.select(F.col("key").alias(c), F.col("n").alias(f"n{end}"), F.col("bits").alias(f"bits{end}")), c)
    out = materialize(pairs.where(sum(SHARE) * apart() <= (SHARE[1] - SHARE[0]) * (F.col("n") + F.col("n_"))).select("a", "b"))
    drop(found)
    return out


def verified(pairs: DataFrame, texts: DataFrame, ids: DataFrame) -> DataFrame:
    """The pairs (a, b) of keys whose texts are similar.

    ``ids`` names one row of ``texts`` for each key, so that copies need not be sorted out. Few pairs are sent to all executors; then
    only the texts of both ends are shuffled, each once a pair, and a group's texts are dealt by pair, not by key.
    """
    ends = F.explode(F.array(*[F.struct(F.lit(side).alias("side"), F.col(side).alias("key")) for side in ("a", "b")])).alias("end")
    wanted = materialize(pairs.select("a", "b", ends).select("a", "b", "end.*").join(ids.select("key", "id"), "key"))
    some = wanted.select("a", "b", "side", F.col("key").alias("key_"), F.col("id").alias("id_"))
    some = F.broadcast(some) if some.count() <= MAX_SENT else some
    found = texts.join(some, (F.col("key") == F.col("key_")) & F.col("id").eqNullSafe(F.col("id_")))
    both = found.groupBy("a", "b").agg(*[F.max(F.when(F.col("side") == side, F.col("text"))).alias(f"t{side}") for side in ("a", "b")])

    @F.pandas_udf("boolean")
    def check(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([similar(x, y) for x, y in zip(a, b, strict=True)], dtype=bool)

    out = materialize(both.where(check("ta", "tb")).select("a", "b"))
    drop(wanted)
    return out


def met(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs of texts of different components that share a shingle and may be similar; the right one's columns end in ``_``."""
    right = right.select("token", *[F.col(c).alias(f"{c}_") for c in OWN])
    return left.join(right, "token").where((F.col("root") != F.col("root_")) & possible())


def dealt(rows: DataFrame, bits: DataFrame) -> DataFrame:
    """Rows of shingles in cells (``token, x, y``), each cell in one task: two blocks of a shingle's rows (``own`` is x or y) or twice one.

    A row stands in at most ``MOST_BLOCKS`` cells. ``bits`` has the parities of each ``key``; they are folded to ``FOLDED`` words.
    """
    parts = rows.groupBy("token").agg(F.count("*").alias("c")).where(F.col("c") > BLOCK)
    parts = parts.select("token", F.least(F.lit(MOST_BLOCKS), F.ceil(F.col("c") / BLOCK)).cast("int").alias("parts"))
    every = lambda i: F.aggregate(F.sequence(i, F.size("bits") - 1, F.lit(FOLDED)), F.lit(0).cast("long"), lambda acc, j: acc.bitwiseXOR(F.get("bits", j)))
    short = bits.select("key", F.when(F.size("bits") > FOLDED, F.transform(F.sequence(F.lit(0), F.lit(FOLDED - 1)), every)).otherwise(F.col("bits")).alias("bits"))
    out = rows.join(parts, "token", "left").withColumn("parts", F.coalesce("parts", F.lit(1))).join(short, "key")
    out = out.withColumn("own", F.pmod(F.xxhash64("key"), "parts").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    out = out.select("token", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", "key", "root", "n", "at", "bits")
    cells = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # narrow rows, much arithmetic
    return out.repartition(cells, "token", "x", "y").sortWithinPartitions("token", "x", "y")


def meetings(rows: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places of two rows of a cell that the bounds allow, and their distance; ``rows`` holds whole cells of ``dealt``."""
    size = len(rows)
    token, x, y, own, root, n, at = (rows[c].to_numpy() for c in ("token", "x", "y", "own", "root", "n", "at"))
    lists = rows["bits"].combine_chunks()
    words = np.diff(lists.offsets.to_numpy())
    full = np.zeros((size, max(words, default=1)), dtype="<u8")  # bitwise_count takes the absolute value of signed numbers
    full[np.arange(full.shape[1]) < words[:, None]] = lists.flatten().to_numpy().view("<u8")
    half = np.zeros_like(full)
    for w in np.unique(words[words > 1]).tolist():
        half[words == w, : w // 2] = full[words == w, : w // 2] ^ full[words == w, w // 2 : w]
    cuts = np.flatnonzero((token[1:] != token[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])) + 1
    ends = np.repeat(np.append(cuts, size), np.diff(np.concatenate(([0], cuts, [size]))))
    later = ends - np.arange(size) - 1
    total = np.concatenate(([0], np.cumsum(later)))
    first = 0
    while first < size:
        last = max(first + 1, int(np.searchsorted(total, total[first] + PAIRS, "right")) - 1)
        p = np.repeat(np.arange(first, last), later[first:last])
        q = np.arange(total[first], total[last]) - total[p] + p + 1
        first = last
        both = n[p] + n[q]
        keep = (root[p] != root[q]) & ((own[p] != own[q]) | (x[p] == y[p])) & (sum(SHARE) * np.minimum(n[p] - at[p], n[q] - at[q]) >= SHARE[0] * both)
        p, q, both = p[keep], q[keep], both[keep]
        side = lambda i, j: np.where((words[i] > words[j])[:, None], half[i], full[i])
        distance = np.bitwise_count(side(p, q) ^ side(q, p)).sum(axis=1, dtype=np.int64)
        keep = sum(SHARE) * distance <= (SHARE[1] - SHARE[0]) * both
        yield p[keep], q[keep], distance[keep] / both[keep]


def nearest_of(rows: pa.Table, most: int | None) -> Iterator[pa.RecordBatch]:
    """Pairs (key, key_) of ``meetings``: all, or those with the ``most`` nearest of either row, and whether one of their rows has more."""
    key, seen = rows["key"].to_numpy(), np.zeros(len(rows), dtype=np.int64)
    held: tuple[np.ndarray, ...] = (seen[:0], seen[:0], np.zeros(0))
    batch = lambda a, b, more: pa.RecordBatch.from_arrays([pa.array(key[a]), pa.array(key[b]), pa.array(more)], names=["key", "key_", "more"])
    for p, q, distance in meetings(rows):
        if most is None:
            yield batch(p, q, np.zeros(len(p), dtype=bool))
        elif len(p):
            a, b, d = (np.concatenate(c) for c in zip(held, (p, q, distance), (q, p, distance), strict=True))
            seen += np.bincount(p, minlength=len(rows)) + np.bincount(q, minlength=len(rows))
            order = np.lexsort((key[b], d, a))
            a, b, d = a[order], b[order], d[order]
            keep = np.arange(len(a)) - np.searchsorted(a, a) < most
            held = a[keep], b[keep], d[keep]
    if len(held[0]):
        a, b = np.divmod(np.unique(np.minimum(*held[:2]) * len(rows) + np.maximum(*held[:2])), len(rows))
        yield batch(a, b, (seen[a] > most) | (seen[b] > most))


def nearest(rows: DataFrame, bits: DataFrame, most: int | None) -> DataFrame:
    """``key, key_, more``: pairs of texts of different components that share a shingle and that the bounds allow, at most ``most``
    for each row of ``rows`` (``more`` where it has others besides) or all of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, size = [], 0
        for batch in batches:
            waiting.append(batch)
            size += len(batch)
            if size >= 1 << 14:
                whole = pa.Table.from_batches(waiting)
                cell = [whole[c].to_numpy() for c in ("token", "x", "y")]
                open_from = int(np.argmax(np.logical_and.reduce([c == c[-1] for c in cell])))  # the last cell may go on; cells are sorted
                if open_from:
                    yield from nearest_of(whole.slice(0, open_from).combine_chunks(), most)
                waiting = whole.slice(open_from).to_batches()
                size = 0 if open_from else -len(whole)  # a large cell is looked at again when it has doubled
        if waiting:
            yield from nearest_of(pa.Table.from_batches(waiting).combine_chunks(), most)

    return materialize(dealt(rows, bits).mapInArrow(run, "key long, key_ long, more boolean"))


def linked(pairs: DataFrame, roots: DataFrame, texts: DataFrame, ids: DataFrame, sketches: DataFrame) -> DataFrame:
    """Links (a, b) of components, for the similar ones among pairs (a, b) of keys."""
    found = verified(near(pairs, sketches), texts, ids)
    for c in ("a", "b"):
        found = found.join(roots.select(F.col("key").alias(c), F.col("root").alias(f"root_{c}")), c)
    return materialize(found.select(F.col("root_a").alias("a"), F.col("root_b").alias("b")))


def links(sketches: DataFrame, roots: DataFrame, texts: DataFrame, ids: DataFrame, connected: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Links (a, b) of components that connect all those with similar texts.

    ``sketches`` has ``key`` (equal for equal texts only) and ``sketch``'s ``n, prefix, bits``; ``roots`` has the component ``root``
    of each ``key`` once; ``texts`` has ``key, id, text``, and ``ids`` one of its ``id`` for each ``key``. All are read several times. ``connected`` gives (node, root) of links.
    """
    tried = found = None
    ordered = [F.least("key", "key_").alias("a"), F.greatest("key", "key_").alias("b")]

    def compare(pairs: DataFrame) -> DataFrame | None:
        """The components that these pairs of keys link, if any are left to compare."""
        nonlocal tried, found
        pairs = pairs.select(*ordered).distinct()
        pairs = materialize(pairs if tried is None else pairs.join(tried, ["a", "b"], "leftanti"))
        if pairs.isEmpty():
            return None
        tried = pairs if tried is None else tried.unionByName(pairs)
        new = linked(pairs, roots, texts, ids, sketches)
        found = new if found is None else found.unionByName(new)
        return None if new.isEmpty() else materialize(connected(new).select(F.col("node").alias("root"), F.col("root").alias("merged")))

    def moved(table: DataFrame, merged: DataFrame) -> DataFrame:
        return table.join(merged, "root", "left").withColumn("root", F.coalesce("merged", "root")).drop("merged")

    for every, draws in ROUNDS:
        rows = shared_prefixes(sketches, roots, every)
        for nth, n in enumerate(draws):
            part = F.pmod(F.xxhash64("key", "token", F.lit(nth)), F.lit(n))
            drawn = rows.groupBy("token", part.alias("part")).agg(F.min_by("key", F.xxhash64("key")).alias("key")).select("token", "key")
            # of any two components one is not the first
            shared = met(rows.where("root <> first"), drawn.join(rows, ["token", "key"])).groupBy("key", "key_").agg(F.count("*").alias("shared"))
            merged = compare(shared.groupBy("key").agg(F.max_by("key_", F.struct("shared", "key_")).alias("key_")))
            if merged is not None:
                old, rows = rows, materialize(open_rows(materialize(moved(rows, merged).select("token", *OWN))).select("token", "first", *OWN))
                roots = materialize(moved(roots, merged).select("key", "root"))
                drop(old)
        drop(rows)
    rows, most = shared_prefixes(sketches, roots), NEAREST
    bits = picked(sketches.select("key", "bits"), rows.select(F.col("key").alias("a"), F.col("key").alias("b")))
    while True:
        pairs = nearest(rows, bits, most)
        more = not pairs.where("more").isEmpty()
        merged = compare(pairs.select("key", "key_"))
        if not more:
            break
        if merged is None:
            most = None
        else:
            old, rows = rows, materialize(open_rows(materialize(moved(rows, merged).select("token", *OWN))).select("token", "first", *OWN))
            roots = materialize(moved(roots, merged).select("key", "root"))
            drop(old)
        drop(pairs)
    drop(rows, bits, pairs)
    return roots.select(F.col("root").alias("a"), F.col("root").alias("b")).limit(0) if found is None else found
