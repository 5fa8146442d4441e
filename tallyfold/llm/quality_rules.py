"""Quality rules at host level.

Every text gets rule counts and a base verdict. Failures are then aggregated by host (partial sums first, so one host with
a third of all rows costs no more), host rates are shrunk with a beta prior fitted to the hosts by moments, and a host
whose shrunken rate is above ``MAX_RATE`` takes its remaining documents with it. The host verdicts are joined back to the
rule counts, not to the texts.

Null texts have no words and fail. Null hosts form one host of their own. Repeated rows count as often as they occur.
With no host at all the prior is even. Texts are read whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfold.llm.common import free_name, let, materialize

SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
SYMBOL = r"[#*$%&|<>]"
WINDOW = 5
MAX_RATE = 0.8


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def repeated_words(ws: Column) -> Column:
    """How many words lie in a window of five words that the text holds twice or more.

    Hashes of the windows tell most texts without any repetition apart; only the others compare the windows themselves.
    """
    n = F.size(ws)
    at = F.sequence(F.lit(0), n - WINDOW)
    hashes = F.transform(at, lambda i: F.xxhash64(*[F.get(ws, i + k) for k in range(WINDOW)]))

    def covered(windows: Column) -> Column:
        """Sorted (window, place) pairs; equal neighbours are repeats."""
        same = lambda j, x: F.get(windows, j)["w"] == x["w"]
        twice = F.transform(windows, lambda x, j: F.when(F.coalesce(same(j - 1, x), F.lit(False)) | F.coalesce(same(j + 1, x), F.lit(False)), x["i"]))
        places = F.array_sort(F.filter(twice, lambda i: i.isNotNull()))
        step = lambda acc, p: F.struct((acc["n"] + F.least(F.lit(WINDOW), p - acc["last"])).alias("n"), p.alias("last"))
        first = F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last"))
        return F.aggregate(places, first, step, lambda acc: acc["n"])

    exact = let(F.array_sort(F.transform(at, lambda i: F.struct(F.concat_ws(" ", F.slice(ws, i + 1, F.lit(WINDOW))).alias("w"), i.alias("i")))), covered)
    any_twice = let(hashes, lambda h: F.size(F.array_distinct(h)) < F.size(h))
    return F.when(n < WINDOW, F.lit(0)).otherwise(F.when(any_twice, exact).otherwise(F.lit(0)))


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed``. Same-named columns are replaced."""
    body = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(body, "\n", -1), lambda x: F.rlike(x, F.lit(WORD)))
    counted = let(words_of(body), lambda ws: F.struct(F.size(ws).cast("long").alias("n"), repeated_words(ws).cast("long").alias("r")))
    counts = free_name(docs, "counts")
    out = docs.withColumn(counts, counted)
    out = out.withColumns({
        "n_words": F.col(counts)["n"],
        "word_chars": (F.length(body) - F.regexp_count(body, F.lit(SPACE))).cast("long"),
        "n_symbols": F.regexp_count(body, F.lit(SYMBOL)).cast("long"),
        "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_repeat_words": F.col(counts)["r"],
    }).drop(counts)
    return out.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))


def host_verdicts(measured: DataFrame, host: str) -> DataFrame:
    """One row for each host: ``host, n_docs, n_failed, shrunken_rate, host_kept``.

    The beta prior has the mean and variance of the hosts' rates; where these leave none (one host, or equal rates) it
    weighs as much as two documents.
    """
    hosts = measured.groupBy(F.col(host).alias("host")).agg(F.count("*").alias("n_docs"), F.sum(F.col("base_failed").cast("long")).alias("n_failed"))
    rate = F.col("n_failed") / F.col("n_docs")
    prior = hosts.agg(F.avg(rate).alias("m"), F.var_pop(rate).alias("v"))
    weight = F.when(F.col("v") > 0, F.greatest(F.lit(2.0), F.col("m") * (1 - F.col("m")) / F.col("v") - 1)).otherwise(F.lit(2.0))
    prior = prior.select(F.col("m"), weight.alias("weight"))
    shrunken = (F.col("n_failed") + F.col("m") * F.col("weight")) / (F.col("n_docs") + F.col("weight"))
    out = hosts.join(F.broadcast(prior)).withColumn("shrunken_rate", shrunken)  # the prior is one row
    return out.select("host", "n_docs", "n_failed", "shrunken_rate", (F.col("shrunken_rate") <= MAX_RATE).alias("host_kept"))


def judge(measured: DataFrame, host: str) -> DataFrame:
    """Add ``kept``: false where the base rules or the document's host fail. ``measured`` is read twice: materialize it."""
    own, other, good = (free_name(measured, c) for c in ("own_host", "judged_host", "good_host"))
    verdicts = host_verdicts(measured, host).select(F.col("host").alias(other), F.col("host_kept").alias(good))
    joined = measured.withColumn(own, F.col(host)).join(verdicts, F.col(own).eqNullSafe(F.col(other)), "left")
    return joined.withColumn("kept", ~F.col("base_failed") & F.coalesce(good, F.lit(True))).drop(own, other, good)


def quality(docs: DataFrame, text: str = "text", host: str = "source", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Rule counts and verdicts of all documents, with the columns in ``keep`` but without texts."""
    slim = docs.select(*[F.col(c) for c in keep], F.col(text).alias("_text"), F.col(host).alias("_source"))
    return judge(materialize(measure(slim, "_text").drop("_text")), "_source").drop("_source")


def keep(docs: DataFrame, text: str = "text", host: str = "source") -> DataFrame:
    """The rows that neither the base rules nor their host's verdict reject, with their columns unchanged.

    Texts are measured once: every row is written with its verdict, without its columns where it fails already. Then only
    the rejected hosts are joined to the rows; their table is written first, so that Spark knows its size.
    """
    packed = docs.select(F.col(text).alias("text"), F.col(host).alias("source"), F.struct("*").alias("row"))
    measured = measure(packed, "text").select("source", "base_failed", F.when(~F.col("base_failed"), F.col("row")).alias("row"))
    judged = materialize(measured)
    rejected = materialize(host_verdicts(judged, "source").where(~F.col("host_kept")).select(F.col("host").alias("rejected")))
    return judged.where(~F.col("base_failed")).join(rejected, F.col("source").eqNullSafe(F.col("rejected")), "left_anti").select("row.*")
