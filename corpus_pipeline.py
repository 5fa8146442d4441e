"""From raw documents to token ids: quality rules, near-duplicates, benchmark passages, secrets, BPE.

Null and empty texts fail the quality rules; in any other stage they count as empty and stay. Null hosts are one host, null
ids are the last choice of a group of near-duplicates, and repeated rows count as near-duplicates of each other. Empty tables
give empty tables, and further columns pass through the stages whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfold.llm import bpe, decontaminate, quality_rules, secrets, simhash
from tallyfold.llm.common import materialize, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules or their host's verdict reject go."""
    return quality_rules.keep(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: the one with the least id.

    Near are texts within two bits of fingerprint or with 0.8 of their five-word shingles in common.
    """
    return simhash.keep_one(docs, similar_too=True)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the text; ``n_chars`` follows it. Every document stays."""
    rows = secrets.scan(docs.select("text", F.struct("*").alias("row")), samples=secrets.random_strings(spark))
    masked = secrets.redact(F.col("text"), F.col("found"))
    changed = rows.select("row", F.size("found").alias("n"), masked.alias("masked"))
    own = lambda c: F.col("row")[c]
    columns = {"text": F.col("masked"), "n_chars": F.when(F.col("n") > 0, F.length("masked").cast("long")).otherwise(own("n_chars"))}
    return changed.select(*[columns.get(c, own(c)).alias(c) for c in docs.columns])


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, with their checksum and that of the decoded bytes."""
    import public_tokenizers

    coded = bpe.tokenize(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=True)
    return coded.select("doc_id", "lang", "source", "n_tokens", "ids", "ids_sha256", "decoded_sha256")


STAGES = [("quality rules", quality), ("near-duplicates", near_duplicates), ("decontamination", decontamination), ("secrets", redaction), ("tokens", tokens)]

#: Trained models and linked groups are beyond SQL; tests/llm/test_pipeline.py has the brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's rows are written to the shared folder before the next reads them."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
