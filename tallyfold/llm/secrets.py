"""Secret scans: fixed patterns plus character Markov models of random strings and ordinary identifiers.

Two first-order models over the letters (case folded), digits and ``+/_.=-`` are counted in one aggregation over the
corpus: ``random`` from strings that the fixed patterns label as secrets, ``ordinary`` from all words and identifiers of eight
characters or more that no fixed pattern touches. Labelled samples, such as ``random_strings``, have half the say in each model
that they hold rows of, whatever the corpus' size: a corpus labels only the kinds of secrets that its patterns know. A long
token that no fixed pattern covers is a secret when its log-likelihood ratio exceeds ``MIN_LLR``.

Null texts count as empty. Spans of one kind never overlap; across kinds they may. Ties in start go to the kind listed
first. Repeated rows are scanned one by one and count as often in the models; an empty corpus leaves both models uniform,
and then no ratio exceeds the threshold. Offsets are code points, the end exclusive. Other columns are kept untouched.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfold.llm.common import let

KINDS = ("assign", "access", "hex", "random")
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Runs below the least length fail wherever they begin, so the least length can stand in the pattern.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
LEAST_VALUE = 6
TOKEN = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}"
#: What stands for a fixed pattern's span where ordinary words are read; a word next to it is part of a labelled one.
TAKEN = "\x00"
WORD = r"(?<![A-Za-z0-9+/_=\x00-])[A-Za-z0-9+/_=-]{8,}+(?!\x00)"
SYMBOLS = "abcdefghijklmnopqrstuvwxyz0123456789+/_.=-"
#: Least log-likelihood ratio (in nats, over a whole token) of random to ordinary.
MIN_LLR = 10.0
SPAN = "struct<s:int,k:int,e:int>"


def spans_of(text: Column, pattern: str, kind: int, keep=None) -> Column:
    """Spans of all leftmost, non-overlapping matches, from the lengths of the pieces between them and of the matches.

    ``keep`` is a (group, predicate) pair; matches whose group fails it are passed over but still consume their characters.
    """
    group, test = keep or (0, lambda g: F.lit(True))

    def walk(all_text: Column) -> Column:
        pieces = F.transform(F.split(all_text, pattern, -1), lambda x: F.length(x))
        matches = F.regexp_extract_all(all_text, F.lit(pattern), F.lit(0))
        lengths = F.transform(matches, lambda x: F.length(x))
        good = F.transform(F.regexp_extract_all(all_text, F.lit(pattern), F.lit(group)), test)
        zipped = F.arrays_zip(pieces.alias("p"), lengths.alias("m"), good.alias("g"))
        start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPAN}>").alias("out"))

        def step(acc: Column, x: Column) -> Column:
            s = acc["at"] + x["p"]
            e = s + F.coalesce(x["m"], F.lit(0))
            span = F.struct(s.alias("s"), F.lit(kind).alias("k"), e.alias("e"))
            return F.struct(e.alias("at"), F.when(x["m"].isNotNull() & x["g"], F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

        return F.aggregate(zipped, start, step, lambda acc: acc["out"])

    return F.when(F.rlike(text, F.lit(pattern)), let(text, walk)).otherwise(F.array().cast(f"array<{SPAN}>"))


def transitions(tokens: Column) -> Column:
    """Pairs of neighbouring symbols of the tokens, case folded; a blank stands before each token's first."""
    return F.regexp_extract_all(F.concat(F.lit(" "), F.lower(F.array_join(tokens, " "))), F.lit("(?=(.[^ ]))"), F.lit(1))


def random_strings(spark: SparkSession, n: int = 4096) -> DataFrame:
    """Labelled samples (``token, random``): ``n`` strings of 43 characters in base 64, from checksums of numbers."""
    return spark.range(n).select(F.rtrim(F.lit("="), F.base64(F.unhex(F.sha2(F.col("id").cast("string"), 256)))).alias("token"), F.lit(True).alias("random"))


def counted(tokens: DataFrame) -> dict[tuple[int, str, str], int]:
    """How often each pair of symbols occurs in ``random`` (0 or 1), ``ts`` (arrays of pairs): at most 2 x 43 x 42 rows."""
    pairs = tokens.select("random", F.explode("ts").alias("t")).groupBy("random", "t").agg(F.count("*").alias("n"))
    return {(r["random"], r["t"][0].strip(), r["t"][1]): r["n"] for r in pairs.collect()}


def train(docs: DataFrame, text: str = "text", samples: DataFrame | None = None) -> list[float]:
    """Log P_random(b | a) - log P_ordinary(b | a) with add-one smoothing, row by row over ("" + SYMBOLS) x SYMBOLS.

    ``samples`` has labelled strings (``token``, ``random`` true or false); null tokens and labels count nothing.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    values = F.concat(
        F.regexp_extract_all(body, F.lit(ASSIGN), F.lit(2)), F.regexp_extract_all(body, F.lit(ACCESS), F.lit(0)), F.regexp_extract_all(body, F.lit(HEX), F.lit(0))
    )
    values = F.filter(values, lambda v: F.rlike(v, F.lit("[0-9]")) & (F.length(v) >= 12))
    rest = body
    for pattern in (ASSIGN, ACCESS, HEX):
        rest = F.regexp_replace(rest, pattern, TAKEN)
    words = F.regexp_extract_all(rest, F.lit(WORD), F.lit(0))
    kinds = F.array(*[F.struct(F.lit(random).alias("random"), transitions(tokens).alias("ts")) for random, tokens in ((1, values), (0, words))])
    sources = [counted(docs.select(F.inline(kinds)))]
    if samples is not None:
        strings = F.regexp_extract_all("token", F.lit("[A-Za-z0-9+/_.=-]+"), F.lit(0))
        sources.append(counted(samples.select(F.col("random").cast("int").alias("random"), transitions(strings).alias("ts")).where("random is not null and ts is not null")))
    table = []
    for a in ["", *SYMBOLS]:
        logs = []
        for random in (1, 0):
            shares = []
            for at, counts in enumerate(sources):
                row = [counts.get((random, a, b), 0) + 1 for b in SYMBOLS]
                if at == 0 or any(k == random for k, _, _ in counts):
                    shares.append([n / sum(row) for n in row])
            logs.append([math.log(sum(p) / len(p)) for p in zip(*shares, strict=True)])
        table += [x - y for x, y in zip(*logs, strict=True)]
    return table


def ratio(token: Column, model: list[float]) -> Column:
    """Log-likelihood ratio of a token of TOKEN's characters."""
    table = F.split(F.lit(",".join(map(repr, model))), ",").cast("array<double>")
    width = len(SYMBOLS)
    code = lambda c: F.instr(F.lit(SYMBOLS), c)
    ids = F.transform(F.split(F.lower(token), ""), code)
    terms = let(ids, lambda xs: F.transform(xs, lambda x, i: F.get(table, F.when(i > 0, F.get(xs, i - 1)).otherwise(0) * width + x - 1)))
    return F.aggregate(terms, F.lit(0.0), lambda a, t: a + t)


def scan(docs: DataFrame, text: str = "text", model: list[float] | None = None, samples: DataFrame | None = None) -> DataFrame:
    """Add ``base`` and ``found``: arrays of (s start, k kind number, e end), by start then kind. Same-named columns are replaced.

    ``base`` holds the fixed patterns' spans, ``found`` also those of the models. Without ``model`` it is trained on ``docs``
    and the labelled ``samples``.
    """
    model = train(docs, text, samples) if model is None else model
    body = F.coalesce(F.col(text), F.lit(""))
    base = F.array_sort(F.concat(
        spans_of(body, ASSIGN, 0, (2, lambda g: F.length(g) >= LEAST_VALUE)), spans_of(body, ACCESS, 1), spans_of(body, HEX, 2)
    ))
    out = docs.withColumn("base", base)
    more = spans_of(body, TOKEN, 3, (0, lambda g: ratio(g, model) > MIN_LLR))
    apart = lambda x: ~F.exists("base", lambda b: (b["s"] < x["e"]) & (x["s"] < b["e"]))
    return out.withColumn("found", F.array_sort(F.concat("base", F.filter(more, apart))))


def as_text(spans: Column) -> Column:
    """``kind:start:end`` of each span, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"], x["e"])), ",")


def redact(text: Column, spans: Column, mask: str = "[SECRET]") -> Column:
    """The text with every span (or run of overlapping spans) replaced by ``mask``; null stays null."""

    def cut(all_text: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

        def step(acc: Column, x: Column) -> Column:
            new = x["s"] >= acc["at"]
            piece = F.concat(F.substring(all_text, acc["at"] + 1, x["s"] - acc["at"]), F.lit(mask))
            return F.struct(F.greatest(acc["at"], x["e"]).alias("at"), F.when(new, F.concat(acc["out"], F.array(piece))).otherwise(acc["out"]).alias("out"))

        done = F.aggregate(spans, start, step)
        return let(done, lambda d: F.concat(F.array_join(d["out"], ""), F.substring(all_text, d["at"] + 1, F.length(all_text))))

    return F.when(F.size(spans) > 0, let(text, cut)).otherwise(text)
