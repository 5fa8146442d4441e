"""Small helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once and use it many times in ``body``, also inside other lambdas.

    A plain Column used twice inside a lambda is evaluated again for each element; a lambda variable is not.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z so that no other character turns into an ASCII one.

    ``lower`` also maps U+212A to k and U+0130 to i plus a mark, so texts with either go through ``translate``.
    Other non-ASCII capitals may be lowered; callers compare ASCII words only.
    """
    odd = F.contains(text, F.lit("\u212a")) | F.contains(text, F.lit("\u0130"))
    return F.when(odd, F.translate(text, UPPER, LOWER)).otherwise(F.lower(text))


def free_name(df: DataFrame, base: str) -> str:
    """A column name that clashes with none of ``df`` (Spark compares names without case)."""
    taken, name = {c.lower() for c in df.columns}, base
    while name.lower() in taken:
        name += "_"
    return name


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; on one machine a temporary one where the session names none."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: lineage ends there and lost executors do not matter."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete the files of materialized tables that nothing reads any more, and those of shuffles behind them.

    Spark deletes a finished shuffle's files once the driver's JVM has collected the objects that name it. A driver with free
    memory may not do so for long, while the executors' disks fill up; so it is asked to.
    """
    for t in tables:
        jvm = t.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(t.scratch_path)
        path.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
    for t in tables[:1]:
        t.sparkSession._jvm.System.gc()


def python_ready(spark: SparkSession, rows: int = 512) -> None:
    """Send this package to the Python workers once, and keep Arrow batches small, so that a worker holds few long texts."""
    if not any("tallyfold" in name for name in spark.sparkContext._python_includes):
        root = Path(__file__).resolve().parents[1]
        with zipfile.ZipFile(Path(tempfile.mkdtemp(prefix="package-"), "tallyfold.zip"), "w") as out:
            for source in root.rglob("*.py"):
                out.write(source, source.relative_to(root.parent))
        spark.sparkContext.addPyFile(str(out.filename))
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
