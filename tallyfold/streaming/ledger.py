"""An append-only event log: tails, latest states, once-only acceptance and transitions, in batch and as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

TAIL = 2000


def tail(events: DataFrame, process: str, process_id, after: int, seq: str = "seq", most: int = TAIL) -> DataFrame:
    """The next events of one process after a cursor, in order."""
    return events.where((F.col(process) == process_id) & (F.col(seq) > after)).orderBy(seq).limit(most)


def latest_state(events: DataFrame, key: str, state: str, *order: str) -> DataFrame:
    """``(key, state)``: the state of the last event; works on a stream too (update or complete mode)."""
    return events.groupBy(key).agg(F.max_by(state, F.struct(*order)).alias(state))


def first_accepted(events: DataFrame, key: str, valid, *order: str) -> DataFrame:
    """Events with ``outcome``: the first valid one of a key is accepted, later ones refused, invalid ones invalid."""
    w = Window.partitionBy(key).orderBy((~valid).cast("int"), *order)
    n = F.row_number().over(w)
    return events.withColumn("outcome", F.when(~valid, "invalid").when(n == 1, "accepted").otherwise("refused"))


def illegal_transitions(events: DataFrame, key: str, state: str, allowed: DataFrame, *order: str) -> DataFrame:
    """Events whose step from the previous state is not in ``allowed`` (from_state, to_state); a first event may have any."""
    w = Window.partitionBy(key).orderBy(*order)
    steps = events.withColumn("from_state", F.lag(state).over(w)).where("from_state is not null").withColumn("to_state", F.col(state))
    return steps.join(F.broadcast(allowed.distinct()), ["from_state", "to_state"], "left_anti")  # a table of states: a few rows


def over_retried(events: DataFrame, key: str, state: str, retry: str, most: int = 3) -> DataFrame:
    """``(key, retries)`` beyond the limit."""
    return events.where(F.col(state) == retry).groupBy(key).agg(F.count("*").alias("retries")).where(F.col("retries") > most)


def merge_new(target: DataFrame, source: DataFrame, key: str, content: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows to insert (their key is not there yet and has one content), and conflicts (same key, other content).

    Several contents of one new key are all conflicts: none of them is inserted.
    """
    rows = source.dropDuplicates([key, *content])
    several = rows.groupBy(key).agg(F.count("*").alias("_n")).where("_n > 1").select(key)
    new = rows.join(target.select(key), key, "left_anti")
    held = target.select(key, F.struct(*content).alias("_held"))
    changed = rows.join(held, key).where(~F.struct(*content).eqNullSafe(F.col("_held"))).drop("_held")
    return new.join(several, key, "left_anti"), changed.unionByName(new.join(several, key, "left_semi"))


def new_snapshots(snapshots: DataFrame, process: str, document: str, seq: str) -> DataFrame:
    """The first snapshot of each document of a process."""
    return snapshots.withColumn("digest", F.sha2(document, 256)).groupBy(process, "digest").agg(F.min(seq).alias(seq))


def accept_reports(reports: DataFrame, controls: DataFrame, process: str) -> DataFrame:
    """Reports with ``accepted``: their control revision must still be the latest one."""
    last = controls.groupBy(process).agg(F.max("control_revision").alias("_latest"))
    return reports.join(last, process, "left").withColumn("accepted", F.col("control_revision").eqNullSafe(F.col("_latest"))).drop("_latest")


def history(snapshots: DataFrame, demo: DataFrame, process: str, seq: str) -> DataFrame:
    """Accepted snapshots in order, demo processes left out."""
    return snapshots.join(demo.where("demo").select(process), process, "left_anti").orderBy(seq)


def stream_events(spark: SparkSession, path: str, schema, max_files: int | None = None) -> DataFrame:
    """The log folder as a stream; the query's checkpoint is the cursor."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", max_files) if max_files else reader).parquet(path)


def append_events(events: DataFrame, path: str, checkpoint: str):
    """Append a stream of events to a log folder, once each."""
    return events.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def run_to_table(stream: DataFrame, path: str, mode: str, checkpoint: str) -> DataFrame:
    """Run a stream over what is there; each micro-batch is written by executors to ``path/batch=N``, anew if it runs again.

    The table is read back with its ``batch``. Nothing of it passes through the driver.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return read_batches(stream.sparkSession, path, stream.schema)


def read_batches(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The batches under ``path``, also where there is none yet."""
    whole = StructType([*schema.fields, StructField("batch", LongType())])
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)
    return spark.read.schema(whole).option("basePath", path).parquet(path) if there else spark.createDataFrame([], whole)


def stream_latest(events: DataFrame, key: str, state: str, *order: str, path: str, checkpoint: str) -> DataFrame:
    """``(key, state)`` after all of a stream: keyed state in the stream, of which each batch writes the keys that changed."""
    table = run_to_table(latest_state(events, key, state, *order), path, "update", checkpoint)
    return table.groupBy(key).agg(F.max_by(state, "batch").alias(state))


def stream_once(events: DataFrame, key: str, valid: str, order: str, path: str, checkpoint: str) -> DataFrame:
    """``(key, order, outcome, batch)`` of a stream: the first valid event of a key is accepted, in its batch by ``order``.

    Earlier batches come first. What they accepted is the state: it is read from the table itself (a partition of its own), up
    to the batch before, so a batch that runs again decides alike. A key's first event is found by an aggregate, so a hot key
    is never gathered.
    """
    spark = events.sparkSession
    slim = events.select(key, order, F.coalesce(valid, F.lit(False)).alias("_valid"))
    schema = StructType([*slim.drop("_valid").schema.fields, StructField("outcome", StringType())])

    def decide(batch: DataFrame, number: int) -> None:
        held = read_batches(spark, path, schema).where((F.col("batch") < number) & (F.col("outcome") == "accepted")).select(key)
        rows = batch.withColumn("_row", F.monotonically_increasing_id())
        first = rows.where("_valid").groupBy(key).agg(F.min(F.struct(order, "_row")).alias("_first")).join(held, key, "left_anti")
        taken = F.col("_first").isNotNull() & (F.struct(order, "_row") == F.col("_first"))
        out = rows.join(first, key, "left").withColumn("outcome", F.when(~F.col("_valid"), "invalid").when(taken, "accepted").otherwise("refused"))
        out.select(key, order, "outcome").write.mode("overwrite").partitionBy("outcome").parquet(f"{path}/batch={number}")

    slim.writeStream.foreachBatch(decide).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return read_batches(spark, path, schema)


def merge_stream(events: DataFrame, target: str, key: str, content: list[str], checkpoint: str):
    """Insert new keys of a stream into a Parquet table, batch by batch; conflicts go to ``target + '_conflicts'`` by ``batch``.

    A batch that runs again finds its own rows there with the same content and writes its conflicts anew.
    """
    spark = events.sparkSession

    def insert(batch: DataFrame, batch_id: int) -> None:
        held = spark.read.schema(batch.select(key, *content).schema).parquet(target)
        # the second write must not read what the first one changes: conflicts go first
        fresh, conflicts = merge_new(held, batch.select(key, *content), key, content)
        conflicts.write.mode("overwrite").parquet(f"{target}_conflicts/batch={batch_id}")
        fresh.write.mode("append").parquet(target)

    spark.createDataFrame([], events.select(key, *content).schema).write.mode("append").parquet(target)
    return events.writeStream.foreachBatch(insert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, ts: str, kind: str, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Extension: tumbling counts over event time with a watermark."""
    rows = events.withWatermark(ts, late) if events.isStreaming else events
    return rows.groupBy(F.window(ts, size), kind).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), kind, "n")
