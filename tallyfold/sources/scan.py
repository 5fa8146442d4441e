"""Bounded, receipted scans of files, JSON records, catalogs and tables."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tallyfold.functions.text import LINE_END, list_cell
from tallyfold.operators.windows import global_rank


@dataclass(frozen=True)
class Limits:
    """Protective limits of a text export; they are reported, not enforced."""

    files: int = 10_000
    file_bytes: int = 16 * 2**20
    total_bytes: int = 512 * 2**20
    lines: int = 2_000_000


def line_count(text: Column) -> Column:
    ends = F.regexp_count(text, F.lit(LINE_END))
    return F.when(text == "", 0).otherwise(ends + F.when(F.rlike(text, F.lit(f"(?:{LINE_END})\\z")), 0).otherwise(1))


def binary_files(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)


def scan_text_files(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """``path, text, sha256, bytes, lines, problem``: text is null where a file is no UTF-8 or holds NUL, and problem says so.

    Spark's file listing gives no row for an empty file.
    """
    files = binary_files(spark, root, pattern)
    raw = F.col("content").cast("string")
    problem = F.when(~F.is_valid_utf8(raw), "not UTF-8").when(F.contains(raw, F.lit("\0")), "NUL")
    out = files.select("path", "content", F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes"), problem.alias("problem"))
    text = F.when(F.col("problem").isNull(), raw)
    return out.select("path", text.alias("text"), "sha256", "bytes", line_count(text).alias("lines"), "problem")


def check_limits(files: DataFrame, limits: Limits | None = None) -> DataFrame:
    """``(check, value, most, ok)`` of a file table with ``bytes`` and ``lines``."""
    limits = limits or Limits()
    sums = files.agg(F.count("*").alias("files"), F.max("bytes").alias("file_bytes"), F.sum("bytes").alias("total_bytes"), F.sum("lines").alias("lines"))
    sums = sums.select(*[F.coalesce(F.col(c).cast("long"), F.lit(0)).alias(c) for c in sums.columns])
    most = F.create_map(*[F.lit(x) for kv in vars(limits).items() for x in kv])
    rows = sums.unpivot([], sums.columns, "check", "value").withColumn("most", F.element_at(most, F.col("check")).cast("long"))
    return rows.withColumn("ok", F.col("value") <= F.col("most"))


@F.pandas_udf(StringType())
def portable_name(path: pd.Series) -> pd.Series:
    """NFC and case folding, as case-insensitive file systems compare names."""
    import unicodedata

    return path.map(lambda p: None if p is None else unicodedata.normalize("NFC", unicodedata.normalize("NFC", p).casefold()))


def path_collisions(files: DataFrame, path: str = "path") -> DataFrame:
    """``(key, problem)``: names that are one on a case-insensitive system, and names that are a file and a folder."""
    rows = files.select(portable_name(F.col(path)).alias("key"))
    twice = rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key", F.lit("same name").alias("problem"))
    parts = F.split("key", "/")
    parents = rows.select(F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(parts) - 1)), lambda n: F.when(n < F.size(parts), F.array_join(F.slice(parts, F.lit(1), n), "/")))).alias("key"))
    return twice.unionByName(rows.join(parents.where("key is not null").distinct(), "key", "left_semi").distinct().select("key", F.lit("file and folder").alias("problem")))


def manifest_rows(rows: DataFrame) -> DataFrame:
    """Manifest cells as lists; a blank condition is ``Unknown``."""
    blank = F.coalesce(F.trim("condition"), F.lit("")) == ""
    return rows.withColumns({"inputs": list_cell(F.col("inputs")), "outputs": list_cell(F.col("outputs")), "condition": F.when(blank, "Unknown").otherwise(F.trim("condition"))})


def strict_json(rows: DataFrame, raw: str) -> tuple[DataFrame, DataFrame]:
    """Rows whose text is one JSON document without duplicate keys or non-finite numbers, as ``document``; and the others."""
    parsed = rows.withColumn("document", F.try_parse_json(F.col(raw)))
    return parsed.where("document is not null"), parsed.where("document is null").drop("document")


def catalog_entries(entries: DataFrame, origin: str) -> DataFrame:
    """``(key, name, origin)`` for each name and alias, upper-cased."""
    names = F.array_distinct(F.transform(F.concat(F.array("name"), "aliases"), F.upper))
    return entries.select(F.explode(names).alias("key"), "name", F.lit(origin).alias("origin"))


def catalog_listing(tables: DataFrame, schema: str | None = None, like: str | None = None) -> DataFrame:
    """Distinct ``(creator, name)`` in order, optionally of one schema or a name pattern."""
    out = tables.select("creator", "name").distinct()
    out = out.where(F.col("creator") == schema) if schema is not None else out
    return (out.where(F.col("name").like(like)) if like is not None else out).orderBy("creator", "name")


def describe(df: DataFrame, schema: str, table: str) -> DataFrame:
    """``(schema, table, name, type, nullable, ordinal)`` of a table's columns, in order."""
    rows = [(schema, table, f.name, f.dataType.simpleString(), f.nullable, i) for i, f in enumerate(df.schema.fields, 1)]
    return df.sparkSession.createDataFrame(rows, "schema string, table string, name string, type string, nullable boolean, ordinal int")


def after_cursor(keys: Sequence[str], cursor: Sequence) -> Column:
    """Keyset predicate: rows that come after the cursor in the order of the keys."""
    terms = []
    for i, key in enumerate(keys):
        same = [F.col(k) == v for k, v in zip(keys[:i], cursor, strict=False)]
        terms.append(reduce(Column.__and__, [*same, F.col(key) > cursor[i]]))
    return reduce(Column.__or__, terms)


def keyset_page(df: DataFrame, keys: Sequence[str], n: int, cursor: Sequence | None = None) -> DataFrame:
    """The next page, with ``has_more`` on each row; n + 1 rows are read to know."""
    rows = df.where(after_cursor(keys, cursor)) if cursor is not None else df
    page = rows.orderBy(*keys).limit(n + 1)
    w = Window.orderBy(*keys)  # over n + 1 rows
    numbered = page.withColumn("_rn", F.row_number().over(w)).withColumn("has_more", F.max("_rn").over(Window.partitionBy()) > n)
    return numbered.where(F.col("_rn") <= n).drop("_rn")


def pages(df: DataFrame, keys: Sequence[str], page: int, size: Column) -> DataFrame:
    """Add ``bytes``, ``rank``, ``page`` (from 0) and ``running``, the bytes up to and with the row."""
    ranked = global_rank(df.withColumn("bytes", size), list(keys), "rank", {"running": "bytes"})
    return ranked.withColumn("page", F.floor((F.col("rank") - 1) / page))


def keyset_receipt(df: DataFrame, keys: Sequence[str], page: int, max_pages: int, max_bytes: int, size: Column) -> DataFrame:
    """One row: ``status, reason, rows, pages, bytes`` of a traversal that stops before the first page over a budget.

    A traversal that ends exactly at its page limit is PARTIAL: it cannot know that nothing follows.
    """
    by_page = pages(df, keys, page, size).groupBy("page").agg(F.count("*").alias("n"), F.sum("bytes").alias("b"), F.max("running").alias("upto"))
    fits = (F.col("page") < max_pages) & (F.col("upto") <= max_bytes)
    out = by_page.agg(
        F.coalesce(F.sum(F.when(fits, F.col("n"))), F.lit(0)).alias("rows"),
        F.count_if(fits).alias("pages"),
        F.coalesce(F.sum(F.when(fits, F.col("b"))), F.lit(0)).alias("bytes"),
        F.coalesce(F.bool_or(F.col("upto") > max_bytes), F.lit(False)).alias("_over"),
    )
    reason = F.when(F.col("pages") >= max_pages, "page limit").when(F.col("_over"), "byte limit")
    return out.select(F.when(reason.isNull(), "COMPLETE").otherwise("PARTIAL").alias("status"), reason.alias("reason"), "rows", "pages", "bytes")


def bounded_read(df: DataFrame, max_rows: int, order: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """At most ``max_rows`` rows in order, values that JSON lacks as text; and ``(status, rows)``."""
    keep = ("string", "boolean", "tinyint", "smallint", "int", "bigint", "float", "double")
    rows = df.orderBy(*order).limit(max_rows).select(*[F.col(c) if t in keep else F.col(c).cast("string").alias(c) for c, t in df.dtypes])
    n = df.agg(F.count("*").alias("n"))
    receipt = n.select(F.when(F.col("n") >= max_rows, "PARTIAL").otherwise("COMPLETE").alias("status"), F.least("n", F.lit(max_rows)).alias("rows"))
    return rows, receipt


def sample_rows(df: DataFrame, n: int) -> DataFrame:
    """A few rows, marked as a sample."""
    return df.limit(n).withColumn("coverage", F.lit("sample_only"))


def baseline_categories(document: DataFrame) -> DataFrame:
    """``(key, label, count)`` of a baseline document with a ``categories`` array."""
    return document.select(F.explode("categories").alias("c")).select("c.key", "c.label", "c.count")


def bound_files(bindings: DataFrame, files: DataFrame) -> DataFrame:
    """Bindings ``(logical_id, path)`` with ``available`` and ``bytes``."""
    listing = files.select("path", F.col("bytes"), F.lit(True).alias("_there"))
    return bindings.join(listing, "path", "left").withColumn("available", F.coalesce("_there", F.lit(False))).drop("_there")


def document_field(rows: DataFrame, document: str, path: str, kind: str) -> Column:
    """One field of a stored JSON document by path; null where absent or of another kind."""
    return F.try_variant_get(F.try_parse_json(F.col(document)), path, kind)


def jdbc_table(spark: SparkSession, url: str, table: str, column: str, low: int, high: int, parts: int, **options: str) -> DataFrame:
    """A database table read in parallel ranges of a numeric column; filters and columns are pushed to the database."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, partitionColumn=column, lowerBound=low, upperBound=high, numPartitions=parts, **options).load()
