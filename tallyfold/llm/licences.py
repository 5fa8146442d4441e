"""License scans: a positional rare-token index over license templates.

A template is a short license text with one mandatory key phrase inside. The words of the key phrases are the vocabulary;
one aggregation over the corpus gives their document frequencies. Each template is posted under the two rarest words of
its key phrase, with their positions. A file's words are looked up among these; postings of one template must agree on
where the key phrase would start (relative position), and the phrase is then verified word by word at that place.

Null texts count as empty: no words, no labels, score 0. Ties in rarity go to the word first in alphabetical order.
Repeated rows are scanned one by one; whole texts are read whatever their length. Other columns are kept untouched.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfold.llm.common import free_name, let, lower_ascii

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    key: str  # the mandatory phrase, part of the text

    @property
    def words(self) -> list[str]:
        return self.text.split()

    @property
    def key_words(self) -> list[str]:
        return self.key.split()

    @property
    def key_at(self) -> int:
        return next(i for i in range(len(self.words)) if self.words[i : i + len(self.key_words)] == self.key_words)


def phrase(label: str, text: str) -> Template:
    return Template(label, text, text)


BASE = (phrase("cc-by", "cc by"), phrase("gpl", "general public license"), phrase("reserved", "all rights reserved"))
#: The method's own labels: versions and licenses that the base phrases do not tell apart.
METHOD = (
    Template("gpl-3.0", "this work is licensed under the gnu general public license version 3", "general public license version 3"),
    Template("cc-by-nc-4.0", "licensed under cc by nc 4 0", "cc by nc 4 0"),
    Template("mit", "released under the mit license", "mit license"),
    Template("apache-2.0", "licensed under the apache license version 2 0", "apache license version 2 0"),
    Template("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", "mozilla public license v 2 0"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution and use in source and binary forms"),
)


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(lower_ascii(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def document_frequencies(docs: DataFrame, text: str, templates: tuple[Template, ...]) -> dict[str, int]:
    """In how many files each key word occurs; at most one row for each key word comes back."""
    vocabulary = F.array(*[F.lit(w) for w in sorted({w for t in templates for w in t.key_words})])
    found = docs.select(F.explode(F.array_intersect(words_of(F.col(text)), vocabulary)).alias("w"))
    return {r["w"]: r["n"] for r in found.groupBy("w").agg(F.count("*").alias("n")).collect()}


def scan(docs: DataFrame, text: str = "text", base: tuple[Template, ...] = BASE, method: tuple[Template, ...] = METHOD) -> DataFrame:
    """Add ``n_words, n_base, first_word, last_word, base_labels, labels, score``. Columns of these names are replaced.

    ``score`` is the largest share of a verified template's words that stand where the template has them; 0 without any.
    """
    templates = base + method
    seen = document_frequencies(docs, text, templates)
    anchors = [sorted(set(t.key_words), key=lambda w: (seen.get(w, 0), w))[:2] for t in templates]
    rare = F.array(*[F.lit(w) for w in sorted({w for a in anchors for w in a})])

    def places(t: Template, words: tuple[str, ...], ws: Column, hits: Column) -> Column:
        """Verified starts of the template's key phrase."""

        def starts_by(word: str) -> Column:
            return F.transform(F.filter(hits, lambda x: x["w"] == word), lambda x: x["i"] - t.key_words.index(word))

        starts = [starts_by(w) for w in words]
        agreed = starts[0] if len(starts) == 1 else F.array_intersect(*starts)
        key = F.array(*[F.lit(w) for w in t.key_words])
        return F.filter(agreed, lambda s: F.when(s >= 0, F.slice(ws, s + 1, F.lit(len(t.key_words))) == key).otherwise(False))

    def alike(t: Template, ws: Column, s: Column) -> Column:
        """Share of the template's words in place, given where its key phrase starts."""
        at = lambda j: F.get(ws, s + F.lit(j - t.key_at))
        return sum((F.coalesce((at(j) == w).cast("int"), F.lit(0)) for j, w in enumerate(t.words)), F.lit(0)) / F.lit(float(len(t.words)))

    def found(ws: Column) -> Column:
        hits = F.filter(F.transform(ws, lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda x: F.array_contains(rare, x["w"]))

        def inside(h: Column) -> Column:
            def of(k: int, t: Template) -> Column:
                return F.transform(places(t, tuple(anchors[k]), ws, h), lambda s: F.struct(F.lit(k).alias("k"), s.alias("s"), alike(t, ws, s).alias("share")))

            return F.concat(*[of(k, t) for k, t in enumerate(templates)])

        return let(hits, inside)

    none = F.array().cast("array<struct<k:int,s:int,share:double>>")
    result = let(words_of(F.col(text)), lambda ws: F.struct(F.size(ws).cast("long").alias("n"), F.when(F.arrays_overlap(ws, rare), found(ws)).otherwise(none).alias("found")))
    r, f = free_name(docs, "result"), free_name(docs, "found")
    out = docs.withColumn(r, result).withColumn(f, F.col(r)["found"])
    names = F.array(*[F.lit(t.label) for t in templates])
    own = F.transform(F.filter(f, lambda x: x["k"] < len(base)), lambda x: x["s"].cast("long"))
    label_list = lambda part: F.array_join(F.array_sort(F.array_distinct(F.transform(part, lambda x: F.get(names, x["k"])))), ",")
    return out.withColumns({
        "n_words": F.col(r)["n"],
        "n_base": F.size(own).cast("long"),
        "first_word": F.array_min(own),
        "last_word": F.array_max(own),
        "base_labels": label_list(F.filter(f, lambda x: x["k"] < len(base))),
        "labels": label_list(F.col(f)),
        "score": F.coalesce(F.array_max(F.transform(f, lambda x: x["share"])), F.lit(0.0)),
    }).drop(r, f)
