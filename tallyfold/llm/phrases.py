"""Phrase collocations: exact counts of word sequences by HAT-tries, and how much more often words meet than they part.

Each task numbers its words and counts phrases in a shallow trie over the digits of their word ids, the first word on top.
Hash containers hang below it; one above ``BURST`` entries bursts into one for each next digit. Above ``ENTRIES`` entries the
subtrees that have repeated least are spilled, each as one sorted run, until half the room is free; what is left is written the
same way at the end. The runs are rows of (lang, phrase, count), merged by Spark for each phrase, so a hot first word is
spread over all partitions.

Phrases are counted length by length. A phrase can only reach the least count if both its parts without the first and
without the last word do, so a bitmap of fixed size (``BITS``) marks those; what it does not mark is not counted. It may mark
too much, never too little: counts that reach the least count are exact at every size.

Texts are lower-cased (A-Z), cut into pieces at ``.,;:!?`` and line ends and into words at blanks and tabs. Null and empty texts
have no words; a null lang is ``und``. Repeated rows count each time. Ties in score and count go by the phrase's bytes. An empty
table gives no rows; long texts are taken whole, further columns do not matter.
"""

from __future__ import annotations

from collections import _count_elements  # what Counter.update runs, for a plain dict
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfold.llm.common import materialize, python_ready
from tallyfold.llm.merkle import ranked

LEAST, LONGEST, SHARE, FIRST = 10, 3, 50, 2000
BURST, ENTRIES, RUN_ROWS = 1 << 12, 1 << 19, 1 << 15
TAKEN = 1 << 21  # characters cut into words at once, or one longer text
WORD_BITS, DIGIT = 21, 7  # of a word's number in a task (three fit 64 bits) and of a step in the trie
MOST_WORDS = 1 << 20  # numbers of a task before everything is spilled and numbering starts anew
SEGMENT = 1 << 19  # words numbered at once
BITS, SEGMENTS = 1 << 26, 1 << 10  # of the bitmap, and the rows that it comes to the driver in
MIX = np.uint64(0x9E3779B97F4A7C15)
#: Bytes that end a piece become line ends, tabs become blanks, A-Z become a-z.
PLAIN = bytes.maketrans(b".,;:!?\x0b\x0c\r\tABCDEFGHIJKLMNOPQRSTUVWXYZ", b"\n\n\n\n\n\n\n\n\n abcdefghijklmnopqrstuvwxyz")
END = -1  # number of a piece's end


def words_of(texts: bytes) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The words of (joined) texts, dictionary-encoded, and the number of words before each end of a piece."""
    plain = np.frombuffer(texts.translate(PLAIN), dtype=np.uint8)
    inside = np.concatenate(([False], (plain != 10) & (plain != 32), [False]))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, lengths = edges[::2], edges[1::2] - edges[::2]
    offsets = np.concatenate(([0], np.cumsum(lengths)))
    words = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(plain[inside[1:-1]])])
    return words.dictionary_encode(), np.searchsorted(starts, np.flatnonzero(plain == 10))


class Node(dict):
    """Children by the next digit of the key."""


class Trie:
    """Counts of keys: word ids packed into 64 bits, first word on top. Digits lead to hash containers that burst when full."""

    def __init__(self, length: int) -> None:
        self.top = WORD_BITS * length - DIGIT
        self.root: Node | dict[int, int] = {}
        self.entries = 0

    def add(self, keys: np.ndarray) -> None:
        """``keys`` ascend and may repeat."""
        self.root = self._add(self.root, keys, self.top)

    def _add(self, node: Node | dict[int, int], keys: np.ndarray, shift: int) -> Node | dict[int, int]:
        if type(node) is not Node:
            before = len(node)
            _count_elements(node, keys.tolist())
            self.entries += len(node) - before
            return self._burst(node, shift) if len(node) > BURST and shift >= 0 else node
        for digit, part in self._parts(keys, shift):
            node[digit] = self._add(node.get(digit, {}), keys[part], shift - DIGIT)
        return node

    def _burst(self, box: dict[int, int], shift: int) -> Node:
        keys = np.fromiter(box.keys(), dtype=np.int64, count=len(box))
        counts = np.fromiter(box.values(), dtype=np.int64, count=len(box))
        order = np.argsort(keys)
        keys, counts = keys[order], counts[order]
        return Node((digit, dict(zip(keys[part].tolist(), counts[part].tolist(), strict=True))) for digit, part in self._parts(keys, shift))

    @staticmethod
    def _parts(keys: np.ndarray, shift: int) -> list[tuple[int, slice]]:
        digits = keys >> shift & (1 << DIGIT) - 1
        cuts = np.flatnonzero(np.concatenate(([True], digits[1:] != digits[:-1], [True]))).tolist() if len(keys) else []
        return [(int(digits[a]), slice(a, b)) for a, b in zip(cuts, cuts[1:], strict=False)]

    def spill(self, leave: int) -> Iterator[dict[int, int]]:
        """Containers leave, those whose entries repeat least first, until at most ``leave`` entries remain."""
        if type(self.root) is not Node:
            self.root = Node({0: self.root})  # one container: it goes whole
        found, todo = [], [self.root]
        while todo:
            node = todo.pop()
            for digit, child in node.items():
                if type(child) is Node:
                    todo.append(child)
                elif child:
                    found.append((sum(child.values()) / len(child), len(found), node, digit))
        for _, _, node, digit in sorted(found, key=lambda x: x[:2]):
            if self.entries <= leave:
                break
            box = node.pop(digit)
            self.entries -= len(box)
            yield box
        if not self.entries:
            self.root = {}


def cell(hashes: list[np.ndarray]) -> np.ndarray:
    """The bit of phrases given by the hashes of their words, one array a position."""
    out = hashes[0]
    for h in hashes[1:]:
        out = (out ^ (out >> np.uint64(29))) * MIX + h
    return (out >> np.uint64(65 - BITS.bit_length())).astype(np.int64)


def marked(bitmap: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (bitmap[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) != 0


class Counter:
    """Counts the phrases of ``length`` words in one task's texts."""

    def __init__(self, length: int, bitmap: np.ndarray | None):
        self.length, self.bitmap = length, bitmap
        self.clear()

    def clear(self) -> None:
        self.trie = Trie(self.length)
        self.names: list[str] = []  # of each number; langs and hashes go beside them
        self.langs: list[str] = []
        self.hashes: list[int] = []
        self.numbers: dict[str, dict[str, int]] = {}
        self.words: dict[str, int] = {}

    def number(self, lang: str, words: list[str]) -> list[int]:
        """The numbers of distinct words; a new one gets the next number of the task, and its hash is noted."""
        own = self.numbers.setdefault(lang, {})
        if fresh := [w for w in words if w not in own]:
            seed = xxhash.xxh64_intdigest(lang.encode(), 42)
            own.update(zip(fresh, range(len(self.names), len(self.names) + len(fresh)), strict=True))
            self.names += fresh
            self.langs += [lang] * len(fresh)
            self.hashes += [xxhash.xxh64_intdigest(w.encode(), seed) for w in fresh]
        return [own[w] for w in words]

    def take(self, lang: str, words: list[str], ids: np.ndarray, first: int) -> None:
        """Count the phrases that start in the first ``first`` places of ``ids``, places in ``words`` or ``END``."""
        numbers, k = np.array([*self.number(lang, words), END], dtype=np.int64), self.length
        ids = numbers[ids]
        starts = np.flatnonzero(np.logical_and.reduce([ids[j : len(ids) - k + 1 + j] >= 0 for j in range(k)])) if len(ids) >= k else ids[:0]
        starts = starts[starts < first]
        if self.bitmap is not None and len(starts):
            hashes = np.array(self.hashes, dtype=np.uint64)
            at = lambda shift: cell([hashes[ids[starts + shift + j]] for j in range(k - 1)])
            starts = starts[marked(self.bitmap, at(0)) & marked(self.bitmap, at(1))]
        keys = np.zeros(len(starts), dtype=np.int64)
        for j in range(k):
            keys = keys << WORD_BITS | ids[starts + j]
        keys.sort()
        self.trie.add(keys)

    def spilled(self, leave: int) -> Iterator[pa.RecordBatch]:
        """Subtrees as sorted runs of lang, phrase and count."""
        names, langs, held, n = None, None, [], 0
        for box in self.trie.spill(leave):
            names, langs = (pa.array(self.names, pa.string()), pa.array(self.langs, pa.string())) if names is None else (names, langs)
            held.append(box)
            n += len(box)
            if n >= RUN_ROWS:
                yield self.run(held, names, langs)
                held, n = [], 0
        if held:
            yield self.run(held, names, langs)

    def run(self, boxes: list[dict[int, int]], names: pa.StringArray, langs: pa.StringArray) -> pa.RecordBatch:
        n = sum(map(len, boxes))
        keys, counts = np.fromiter(chain.from_iterable(boxes), np.int64, n), np.fromiter(chain.from_iterable(b.values() for b in boxes), np.int64, n)
        order, mask = np.argsort(keys), (1 << WORD_BITS) - 1
        keys, counts = keys[order], counts[order]
        words = [names.take(pa.array(keys >> WORD_BITS * j & mask)) for j in range(self.length - 1, -1, -1)]
        phrases = pc.binary_join_element_wise(*words, " ") if self.length > 1 else words[0]
        return pa.RecordBatch.from_arrays([langs.take(pa.array(keys & mask)), phrases, pa.array(counts)], names=["lang", "phrase", "a"])

    def emptied(self) -> Iterator[pa.RecordBatch]:
        """What is left; for single words also the number of all words, under the empty phrase."""
        yield from self.spilled(-1)
        if self.length == 1 and self.words:
            yield pa.RecordBatch.from_pydict({"lang": list(self.words), "phrase": [""] * len(self.words), "a": list(self.words.values())})
        self.clear()

    def over(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[str, list[str]] = {}
        size = 0
        for batch in batches:
            for text, lang in zip(batch.column("text"), batch.column("lang"), strict=True):
                own = text.as_py()
                waiting.setdefault(lang.as_py(), []).append(own)
                size += len(own)
                if size > TAKEN:
                    yield from self.taken(waiting)
                    waiting, size = {}, 0
        yield from self.taken(waiting)
        yield from self.emptied()

    def taken(self, waiting: dict[str, list[str]]) -> Iterator[pa.RecordBatch]:
        """Count the texts; a segment has so few words that their numbers fit."""
        for lang, texts in waiting.items():
            words, ends = words_of(b"".join(t.encode() + b"\n" for t in texts))
            self.words[lang] = self.words.get(lang, 0) + len(words)
            ids = np.insert(words.indices.to_numpy().astype(np.int64), ends, END)
            for i in range(0, len(ids), SEGMENT):
                part, names = ids[i : i + SEGMENT + self.length - 1], words.dictionary
                if len(names) > SEGMENT:
                    own, place = np.unique(np.append(part, END), return_inverse=True)  # END is the first
                    part, names = place[:-1] - 1, names.take(pa.array(own[1:]))
                self.take(lang, names.to_pylist(), part, SEGMENT)
                if len(self.names) > MOST_WORDS:
                    yield from self.emptied()
                elif self.trie.entries > ENTRIES:
                    yield from self.spilled(ENTRIES // 2)


def counted(docs: DataFrame, length: int, bitmap: np.ndarray | None) -> DataFrame:
    """``lang, phrase, a`` of the phrases of ``length`` words that the bitmap of shorter ones leaves, over all of ``docs`` (``lang, text``)."""
    sent = docs.sparkSession.sparkContext.broadcast(bitmap)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from Counter(length, sent.value).over(batches)

    return docs.mapInArrow(count, "lang string, phrase string, a long").groupBy("lang", "phrase").agg(F.sum("a").alias("a"))


def bitmap_of(phrases: DataFrame) -> np.ndarray:
    """The bits of all phrases; ``SEGMENTS`` rows come back at most, one bit of them for each of ``BITS``."""
    words, size = BITS >> 6, (BITS >> 6) // SEGMENTS

    def bits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            hashes = [[xxhash.xxh64_intdigest(w, xxhash.xxh64_intdigest(lang.encode(), 42)) for w in phrase.encode().split(b" ")] for lang, phrase in zip(batch["lang"], batch["phrase"], strict=True)]
            at = cell(list(np.array(hashes, dtype=np.uint64).T))
            yield pd.DataFrame({"at": at >> 6, "mask": (np.uint64(1) << (at & 63).astype(np.uint64)).view(np.int64)})

    def pack(part: pd.DataFrame) -> pd.DataFrame:
        own = np.zeros(size, dtype=np.int64)
        own[part["at"].to_numpy() % size] = part["mask"].to_numpy()
        return pd.DataFrame({"segment": [int(part["at"].iloc[0]) // size], "bits": [own.tobytes()]})

    masks = phrases.mapInPandas(bits, "at long, mask long").groupBy("at").agg(F.bit_or("mask").alias("mask"))
    found = masks.groupBy(F.floor(F.col("at") / F.lit(size)).alias("segment")).applyInPandas(pack, "segment long, bits binary").collect()
    out = np.zeros(words, dtype=np.uint64)
    for r in found:
        out[r["segment"] * size : (r["segment"] + 1) * size] = np.frombuffer(r["bits"], dtype=np.uint64)
    return out


def frequent(docs: DataFrame, least: int = LEAST, longest: int = LONGEST) -> list[DataFrame]:
    """Tables ``lang, phrase, a`` of all phrases counted ``least`` times or more, by length from 1; the first also has
    the number of words of each lang under the empty phrase. ``docs`` has ``lang, text``, neither null."""
    if not 1 <= longest <= 3:
        raise ValueError("phrases of one to three words")
    tables, bitmap = [], None
    for length in range(1, longest + 1):
        if length > 1:
            bitmap = bitmap_of(tables[-1].where("phrase <> ''"))
        tables.append(materialize(counted(docs, length, bitmap).where((F.col("a") >= least) | (F.col("phrase") == ""))))
    return tables


def scored(tables: list[DataFrame]) -> DataFrame:
    """``lang, phrase, a, l, r, score`` of all candidates: the cut with the lowest score, ties to the earliest."""
    parts = tables[0]
    for t in tables[1:]:
        parts = parts.unionByName(t)
    candidates = parts.where(F.contains("phrase", F.lit(" ")))
    words = F.split("phrase", " ")
    cuts = candidates.select("lang", "phrase", "a", words.alias("w"), F.explode(F.sequence(F.lit(1), F.size(words) - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", F.array_join(F.slice("w", F.lit(1), F.col("k")), " ").alias("left"), F.array_join(F.slice("w", F.col("k") + 1, F.size("w")), " ").alias("right"))
    left = parts.select("lang", F.col("phrase").alias("left"), F.col("a").alias("l"))
    right = parts.select("lang", F.col("phrase").alias("right"), F.col("a").alias("r"))
    both = materialize(cuts.join(left, ["lang", "left"]).join(right, ["lang", "right"]).select("lang", "phrase", "a", "k", "l", "r"))
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    both = both.withColumn("score", F.call_function("div", F.lit(1_000_000).cast("decimal(7,0)") * (wide("a") * wide("a")).cast("decimal(31,0)"), wide("l") * wide("r")))
    best = both.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "l", "r", "a")).alias("c"))
    return best.select("lang", "phrase", "c.a", "c.l", "c.r", "c.score")


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, longest: int = LONGEST, share: int = SHARE, first: int = FIRST) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: each lang's first phrases by score, count and bytes of the phrase.

    Dropped are phrases inside a longer candidate that has ``share`` percent of their count or more.
    """
    python_ready(docs.sparkSession)
    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.coalesce(text, F.lit("")).alias("text"))
    tables = frequent(rows, least, longest)
    best = materialize(scored(tables))
    words = F.split("phrase", " ")
    inner = F.filter(
        F.flatten(F.transform(F.sequence(F.lit(2), F.size(words) - 1), lambda n: F.transform(F.sequence(F.lit(1), F.size(words) - n + 1), lambda i: F.array_join(F.slice(words, i, n), " ")))),
        lambda p: p != "",
    )
    longer = best.where(F.size(words) > 2).select("lang", "a", F.explode(inner).alias("phrase")).groupBy("lang", "phrase").agg(F.max("a").alias("inside"))
    kept = best.join(materialize(longer), ["lang", "phrase"], "left").where(F.col("inside").isNull() | (100 * F.col("inside") < share * F.col("a")))
    order = kept.select("lang", "phrase", "a", "l", "r", "score", (-F.col("score")).alias("down"), (-F.col("a")).alias("fewer"))
    top = ranked(materialize(order), "lang", ["down", "fewer", "phrase"]).where(F.col("rank") < first)
    n = tables[0].where("phrase = ''").select("lang", F.col("a").alias("n"))
    out = top.join(n, "lang").select("lang", (F.col("rank") + 1).alias("rank"), "phrase", "a", "l", "r", "n", "score")
    return out
