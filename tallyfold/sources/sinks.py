"""Sinks: NDJSON under budgets, guarded CSV, chunked text, numbered parts, write-once versions and their checks."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from tallyfold.functions.text import guarded
from tallyfold.operators.digest import BLOCK, ordered_digest
from tallyfold.operators.windows import global_rank
from tallyfold.sources.scan import pages


def export_ndjson(df: DataFrame, keys: Sequence[str], path: str, max_rows: int, page: int, max_bytes: int, block: int = BLOCK) -> DataFrame:
    """Write whole pages as NDJSON while rows and bytes last; ``status, reason, rows, pages, bytes, digest``.

    ``digest`` is the ordered digest of the lines as read back, by their keys. An export that reaches its row limit is PARTIAL.
    """
    lines = df.withColumn("_line", F.to_json(F.struct("*"), {"ignoreNullFields": "false"}))
    paged = pages(lines, keys, page, F.octet_length("_line") + 1)
    ends = paged.groupBy("page").agg(F.max("rank").alias("_to"), F.max("running").alias("_upto"))
    kept = ends.where((F.col("_to") <= max_rows) & (F.col("_upto") <= max_bytes)).select("page")
    out = paged.join(kept, "page", "left_semi")
    out.select(F.col("_line").alias("value")).write.mode("errorifexists").text(path)
    written = df.sparkSession.read.text(path)
    receipt = written.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.octet_length("value") + 1), F.lit(0)).alias("bytes"))
    own = F.from_json("value", df.select(*keys).schema)
    digest = ordered_digest(written.select("value", *[own[k].alias(k) for k in keys]), keys, F.col("value"), block).select("digest")
    totals = ends.agg(F.coalesce(F.max("_to"), F.lit(0)).alias("_rows"), F.coalesce(F.max("_upto"), F.lit(0)).alias("_bytes"), F.count_if((F.col("_to") <= max_rows) & (F.col("_upto") <= max_bytes)).alias("pages"))
    reason = F.when(F.col("_bytes") > max_bytes, "byte limit").when(F.col("_rows") >= max_rows, "row limit")
    return receipt.join(totals).join(digest).select(F.when(reason.isNull(), "COMPLETE").otherwise("PARTIAL").alias("status"), reason.alias("reason"), "rows", "pages", "bytes", "digest")  # one row each


def guard_formulas(df: DataFrame) -> DataFrame:
    """Text cells safe for spreadsheets; lists, maps and structs as JSON."""
    nested = ("array", "struct", "map")
    return df.select(*[F.to_json(c).alias(c) if t.startswith(nested) else guarded(F.col(c)).alias(c) if t == "string" else F.col(c) for c, t in df.dtypes])


def write_csv(df: DataFrame, path: str) -> None:
    guard_formulas(df).write.mode("errorifexists").option("header", True).option("escape", '"').csv(path)


def write_json(df: DataFrame, path: str) -> None:
    """JSON lines with the columns in alphabetical order."""
    df.select(*sorted(df.columns)).write.mode("errorifexists").json(path)


@F.pandas_udf(ArrayType(StringType()))
def utf16_chunks(text: pd.Series, size: pd.Series) -> pd.Series:
    """Pieces of at most ``size`` UTF-16 units that never cut a character."""

    def cut(t: str | None, n: int) -> list[str] | None:
        if t is None:
            return None
        out, start, units = [], 0, 0
        for i, c in enumerate(t):
            width = 2 if ord(c) > 0xFFFF else 1
            if units + width > n:
                out.append(t[start:i])
                start, units = i, 0
            units += width
        return [*out, t[start:]]

    return pd.Series([cut(t, n) for t, n in zip(text, size, strict=True)])


def chunk_text(df: DataFrame, key: str, text: str, size: int = 30_000) -> DataFrame:
    """``(key, chunk_no, chunk, sha256)``; texts without characters beyond 16 bits stay on SQL functions."""
    wide = F.length(text) * 2 != F.octet_length(F.encode(text, "UTF-16LE"))
    rows = df.select(key, F.col(text).alias("_text"), F.sha2(text, 256).alias("sha256"), wide.alias("_wide"))
    at = F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.length("_text") - 1) / size).cast("int")))
    plain = F.transform(at, lambda i: F.substring(F.col("_text"), i * size + 1, F.lit(size)))
    narrow = rows.where("not _wide").select(key, "sha256", F.posexplode(plain).alias("chunk_no", "chunk"))
    rest = rows.where("_wide").select(key, "sha256", F.posexplode(utf16_chunks("_text", F.lit(size))).alias("chunk_no", "chunk"))
    return narrow.unionByName(rest)


def split_parts(df: DataFrame, keys: Sequence[str], limit: int) -> DataFrame:
    """Add ``part`` (from 1): at most ``limit - 1`` rows in each, as one line is the header's."""
    return global_rank(df, list(keys), "_rank").withColumn("part", (F.floor((F.col("_rank") - 1) / (limit - 1)) + 1).cast("int")).drop("_rank")


def written_rows(source: DataFrame, written: DataFrame, part: str) -> DataFrame:
    """``(part, rows, written, equal)`` after reading back."""
    count = lambda df, name: df.groupBy(part).agg(F.count("*").alias(name))
    both = count(source, "rows").join(count(written, "written"), part, "full")
    return both.withColumn("equal", F.col("rows").eqNullSafe(F.col("written")))


def next_version(spark: SparkSession, path: str) -> int:
    """One more than the largest ``version=N`` folder."""
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = fs_path.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(fs_path)] if fs.exists(fs_path) else []
    return max([int(n.partition("=")[2]) for n in names if n.startswith("version=") and n.partition("=")[2].isdigit()], default=0) + 1


def write_version(df: DataFrame, path: str) -> int:
    """Write once to the next version and return its number; an existing version is never overwritten."""
    version = next_version(df.sparkSession, path)
    df.write.mode("errorifexists").parquet(f"{path}/version={version}")
    return version
