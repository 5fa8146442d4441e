"""Benchmark decontamination by pigeonhole edit matching.

Texts and items are normalised (lower case; runs of ASCII characters that are neither letters nor digits become one
blank). An item of m bytes may be matched with k = m // 10 edits. It is split into k + 1 pieces: wherever it occurs with at
most k edits, one piece stands unchanged. Exact piece hits are found with numpy over a whole batch of texts (anchors of eight
bytes, five for shorter pieces; a bit table, then the piece itself), and verified with Myers' bit-parallel distance: first
the item's 64-byte segments, one word each and many hits at once, whose distances add up to no more than the item's; then
the whole item for what is left.

The items are read in blocks of about ``BLOCK_BYTES``, one after the other; each is sent to the executors and meets all
texts, which are searched whole. With one block the work is narrow: no shuffle. With several, each block's hits are written by
the text's checksum before the next block is read, and joined to the rows at the end.

Null or empty texts hold no item; null, empty and blank items are in no text. Items under eight bytes (budget 0) must stand
between blanks. Equal items are all reported. Repeated rows are searched one by one. Other columns are kept untouched.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfold.llm.common import free_name, materialize, python_ready

ERROR_SHARE = 10
#: Bytes of anchors; the shortest piece of an item (ten bytes, one edit) has five.
ANCHOR, SHORT_ANCHOR = 8, 5
BLOCK_BYTES = 8 << 20
TABLE_BITS = 19
#: Bytes of an item that one machine word compares, bytes of text and hits that are looked at in one go.
WORD = 64
CHUNK = 1 << 20
HITS = 1 << 14
BATCH_BYTES = 4 << 20
BLANKS = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
MIX = np.uint64(0x9E3779B97F4A7C15)
MATCHES = "array<struct<item_id:long,distance:int>>"


def normalise(text: str) -> bytes:
    return b" ".join(text.lower().encode("utf-8", "replace").translate(BLANKS).split())


def alphabet(pattern: bytes) -> dict[int, int]:
    """For each byte of the pattern the bits of its places."""
    bits: dict[int, int] = {}
    for i, c in enumerate(pattern):
        bits[c] = bits.get(c, 0) | 1 << i
    return bits


def myers(pattern: bytes, text: bytes, bits: dict[int, int] | None = None) -> int:
    """Least edit distance of the pattern to any substring of the text, one column of bits for each byte of the text."""
    m = len(pattern)
    if not m:
        return 0
    bits = alphabet(pattern) if bits is None else bits
    mask, high = (1 << m) - 1, 1 << (m - 1)
    up, down, score, best = mask, 0, m, m
    for c in text:
        eq = bits.get(c, 0)
        diagonal = (((eq & up) + up) ^ up) | eq | down
        more, less = (down | ~(diagonal | up)) & mask, up & diagonal
        if more & high:
            score += 1
        elif less & high:
            score -= 1
            best = min(best, score)
        more, less = more << 1, less << 1
        up, down = (less | ~(diagonal | more)) & mask, more & diagonal & mask
    return best


class Pieces:
    """Pieces of items, filed under their first ``width`` bytes; their last ``width`` bytes make the rest."""

    def __init__(self, width: int, rows: list[tuple[bytes, int, int]]) -> None:
        """``rows`` have a piece, its item and its place there; a piece has no more than twice the width."""
        word = lambda parts: np.frombuffer(b"".join(p.ljust(8, b"\0") for p in parts), dtype="<u8")
        self.width, self.mask = width, np.uint64((1 << 8 * width) - 1)
        starts, ends = word([p[:width] for p, _, _ in rows]), word([p[-width:] for p, _, _ in rows])
        order = np.argsort(starts, kind="stable")
        starts, self.ends = starts[order], ends[order]
        self.length, self.item, self.offset = (np.array(x, dtype=np.int64)[order] for x in zip(*[(len(p), n, at) for p, n, at in rows], strict=True))
        self.anchors = np.unique(starts)
        self.low, self.high = np.searchsorted(starts, self.anchors), np.searchsorted(starts, self.anchors, "right")
        self.table = np.zeros(1 << TABLE_BITS, dtype=bool)
        self.table[self.slot(self.anchors)] = True

    @staticmethod
    def slot(keys: np.ndarray) -> np.ndarray:
        return (keys * MIX) >> np.uint64(64 - TABLE_BITS)

    def find(self, words: np.ndarray, n: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(item, start of the item, place of the piece) for each piece that stands in the text, whose bytes overlap in ``words``."""
        for at in range(0, n, CHUNK):
            keys = words[at : min(n, at + CHUNK)] & self.mask
            places = np.flatnonzero(self.table[self.slot(keys)])
            keys = keys[places]
            anchor = np.minimum(np.searchsorted(self.anchors, keys), len(self.anchors) - 1)
            exact = self.anchors[anchor] == keys
            places, anchor = places[exact] + at, anchor[exact]
            if not len(anchor):
                continue
            counts = self.high[anchor] - self.low[anchor]
            piece = np.repeat(self.low[anchor] - np.concatenate(([0], np.cumsum(counts)[:-1])), counts) + np.arange(counts.sum())
            places = np.repeat(places, counts)
            last = places + self.length[piece] - self.width
            whole = np.flatnonzero(last < n)
            whole = whole[words[last[whole]] & self.mask == self.ends[piece[whole]]]
            places, piece = places[whole], piece[whole]
            yield self.item[piece], places - self.offset[piece], places


class Items:
    """A block of items, ready for searching batches of texts."""

    def __init__(self, rows: list[tuple[int, str]]) -> None:
        by_text: dict[bytes, list[int]] = {}
        for item_id, text in rows:
            if found := normalise(text):
                by_text.setdefault(found, []).append(item_id)
        self.ids, self.texts = list(by_text.values()), list(by_text)
        self.bits = [alphabet(t) for t in self.texts]
        self.errors = np.array([len(t) // ERROR_SHARE for t in self.texts], dtype=np.int64)
        self.short = [n for n, t in enumerate(self.texts) if len(t) < ANCHOR]
        pieces, segments = [], []
        self.first_segment = []
        for n, (text, k) in enumerate(zip(self.texts, self.errors.tolist(), strict=True)):
            self.first_segment.append(len(segments))
            if (m := len(text)) < ANCHOR:
                continue
            cuts = [i * m // (k + 1) for i in range(k + 2)]
            pieces += [(text[x:y], n, x) for x, y in zip(cuts, cuts[1:], strict=False)]
            segments += [(x, text[x : x + WORD]) for x in range(0, m, WORD)]
        by_width = ((ANCHOR, [p for p in pieces if len(p[0]) >= ANCHOR]), (SHORT_ANCHOR, [p for p in pieces if len(p[0]) < ANCHOR]))
        self.pieces = [Pieces(width, part) for width, part in by_width if part]
        self.first_segment = np.array([*self.first_segment, len(segments)])
        self.segment_at = np.array([x for x, _ in segments], dtype=np.int64)
        self.segment_length = np.array([len(t) for _, t in segments], dtype=np.int64)
        self.segment_bits = np.zeros((len(segments), 256), dtype=np.uint64)
        for i, (_, t) in enumerate(segments):
            for c, bits in alphabet(t).items():
                self.segment_bits[i, c] = bits

    def hits(self, data: bytes, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(item, start, text): where an item would start for a piece of it to stand where it does, in which text; each once.

        ``firsts`` has the texts' first places. The start may lie before its text, even before the text before it.
        """
        words = np.ndarray((len(data),), "<u8", data + bytes(ANCHOR - 1), strides=(1,))  # overlapping, one at each byte
        found = [(np.zeros(0, np.int64),) * 3]
        for pieces in self.pieces:
            found += [(item, start, np.searchsorted(firsts, place, "right") - 1) for item, start, place in pieces.find(words, len(data))]
        once = np.unique(np.stack([np.concatenate(x) for x in zip(*found, strict=True)]), axis=1)
        return once[0], once[1], once[2]

    def sieve(self, item: np.ndarray, start: np.ndarray, data: np.ndarray) -> np.ndarray:
        """Which hits stay possible: an item's distance is no less than the sum of its 64-byte segments' least distances."""
        alive, spent = np.arange(len(item)), np.zeros(len(item), dtype=np.int64)
        for nth in range(int((self.first_segment[1:] - self.first_segment[:-1]).max(initial=0))):
            own = alive[self.first_segment[item[alive]] + nth < self.first_segment[item[alive] + 1]]
            for part in range(0, len(own), HITS):
                rows = own[part : part + HITS]
                segment, k = self.first_segment[item[rows]] + nth, self.errors[item[rows]]
                spent[rows] += self.segment_distance(segment, start[rows] + self.segment_at[segment] - k, self.segment_length[segment] + 2 * k, data)
            alive = alive[spent[alive] <= self.errors[item[alive]]]
            if not len(alive):
                break
        return alive

    def segment_distance(self, segment: np.ndarray, begin: np.ndarray, width: np.ndarray, data: np.ndarray) -> np.ndarray:
        """Myers' columns for many segments at once, a 64-bit word each; text beyond a window can only lower the distance."""
        length = self.segment_length[segment]
        high = np.uint64(1) << (length - 1).astype(np.uint64)
        up, down = np.full(len(segment), ~np.uint64(0)), np.zeros(len(segment), dtype=np.uint64)
        score, best, one = length.copy(), length.copy(), np.uint64(1)
        for j in range(int(width.max(initial=0))):
            eq = self.segment_bits[segment, data[np.clip(begin + j, 0, len(data) - 1)]]
            diagonal = (((eq & up) + up) ^ up) | eq | down
            more, less = down | ~(diagonal | up), up & diagonal
            score += ((more & high) != 0).astype(np.int64) - ((less & high) != 0)
            np.minimum(best, score, out=best)
            more, less = more << one, less << one
            up, down = less | ~(diagonal | more), more & diagonal
        return best

    def search(self, texts: list[bytes]) -> list[dict[int, int]]:
        """For each text the least distance of each item (by number) that occurs within its budget."""
        data = b"\0".join(texts) + b"\0"
        found: list[dict[int, int]] = [{} for _ in texts]
        firsts = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])))
        item, start, doc = self.hits(data, firsts)
        left = self.sieve(item, start, np.frombuffer(data, dtype=np.uint8))
        places: dict[tuple[int, int], list[int]] = {}
        for n, s, d in zip(item[left].tolist(), start[left].tolist(), doc[left].tolist(), strict=True):
            places.setdefault((d, n), []).append(s - int(firsts[d]))
        for (d, n), starts in places.items():
            best = self.least(texts[d], n, sorted(starts))
            if best <= self.errors[n]:
                found[d][n] = best
        for n in self.short:
            for d, text in enumerate(texts):
                if b" " + self.texts[n] + b" " in b" " + text + b" ":
                    found[d][n] = 0
        return found

    def least(self, text: bytes, n: int, starts: list[int]) -> int:
        """Least distance of an item around the given starts; starts close to each other share a window."""
        item, k = self.texts[n], int(self.errors[n])
        best, at = len(item), 0
        while at < len(starts) and best:
            end = at
            while end + 1 < len(starts) and starts[end + 1] - starts[end] <= k:
                end += 1
            window = text[max(0, starts[at] - k) : max(0, starts[end] + len(item) + k)]
            best = 0 if item in window else min(best, myers(item, window, self.bits[n]))
            at = end + 1
        return best


def groups(texts: pd.Series) -> Iterator[list[str | None]]:
    """Consecutive texts of about ``BATCH_BYTES`` together; a longer text stands alone."""
    group, size = [], 0
    for t in texts:
        if group and size + len(t or "") > BATCH_BYTES:
            yield group
            group, size = [], 0
        group.append(t)
        size += len(t or "")
    if group:
        yield group


def blocks(items: DataFrame, item_id: str, text: str) -> list[DataFrame]:
    """The items with text, in blocks of about ``BLOCK_BYTES`` by their checksum."""
    rows = items.select(F.col(item_id).alias("item_id"), F.col(text).alias("text")).where("text is not null and item_id is not null")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, math.ceil(size / BLOCK_BYTES))
    return [rows] if n == 1 else [rows.where(F.pmod(F.xxhash64("text", "item_id"), F.lit(n)) == k) for k in range(n)]


def searched(block: DataFrame, text: Column) -> tuple[Column, Broadcast]:
    """The matches of a block's items in a text; the broadcast may be given up once the Column is evaluated."""
    sent = block.sparkSession.sparkContext.broadcast([tuple(r) for r in block.collect()])

    @F.pandas_udf(MATCHES)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        ready = Items(sent.value)
        for texts in batches:
            out: list[dict[int, int]] = []
            for group in groups(texts):
                out += ready.search([normalise(t or "") for t in group])
            yield pd.Series([[{"item_id": i, "distance": d} for n, d in found.items() for i in ready.ids[n]] for found in out])

    return run.asNondeterministic()(text), sent  # else a filter on it would run it twice


def matches(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Add ``matches``: an array of (item_id, distance) of the items that the text holds. A column of this name is replaced."""
    python_ready(docs.sparkSession)
    parts = blocks(items, item_id, item_text)
    if len(parts) == 1:
        return docs.withColumn("matches", F.array_sort(searched(parts[0], F.col(text))[0]))
    checksum = F.sha2(F.col(text), 256)
    found = []
    for part in parts:
        column, sent = searched(part, F.col("t"))
        rows = docs.select(F.col(text).alias("t"), checksum.alias("key")).select("key", column.alias("m")).where(F.size("m") > 0)
        found.append(materialize(rows.dropDuplicates(["key"])))
        sent.destroy()
    key, every = free_name(docs, "checksum"), free_name(docs, "every")
    by_text = materialize(reduce(DataFrame.unionByName, found).groupBy(F.col("key").alias(key)).agg(F.array_sort(F.flatten(F.collect_list("m"))).alias(every)))
    joined = docs.withColumn(key, checksum).join(by_text, key, "left")
    return joined.withColumn("matches", F.coalesce(every, F.array().cast(MATCHES))).drop(key, every)


def clean(docs: DataFrame, items: DataFrame, text: str = "text") -> DataFrame:
    """The rows whose text holds no item."""
    kept = docs.select(F.col(text).alias("text"), F.struct("*").alias("row"))
    return matches(kept, items).where(F.size("matches") == 0).select("row.*")
