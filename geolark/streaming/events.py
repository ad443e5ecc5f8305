"""Event counts and rate limits as Structured Streaming."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.shared import new_folder


def stream(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A Parquet file, or the files of a folder, as a stream."""
    reader = spark.readStream.schema(schema)
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    if target.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(target).isDirectory():
        return reader.parquet(path)
    folder, _, name = path.rpartition("/")
    return reader.option("pathGlobFilter", name).option("recursiveFileLookup", "true").parquet(folder)


def counts(events: DataFrame) -> DataFrame:
    """(user_id, event_type, n): state is one row a key."""
    return events.groupBy("user_id", "event_type").agg(F.count("*").alias("n"))


def windowed_counts(events: DataFrame, every: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """(window_start, user_id, n) in clock-aligned windows; windows older than the watermark leave the state."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return rows.groupBy(F.window("ts", every).alias("w"), "user_id").agg(F.count("*").alias("n")).select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), "user_id", "n")


def over_limit(events: DataFrame, limit: int, every: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """The windows in which a user exceeds the limit."""
    return windowed_counts(events, every, late).where(F.col("n") > limit)


def run_once(result: DataFrame, mode: str = "append", keys: Sequence[str] = ()) -> DataFrame:
    """Process what there is and return it as a table: each batch is written by its tasks to the shared folder, which is read back.

    In complete mode the last batch is the result. In update mode a row with the same `keys` as one of an earlier batch replaces it.
    """
    spark, schema = result.sparkSession, result.schema
    name = new_folder(spark, "stream")
    batches: set[int] = set()

    def write(batch: DataFrame, n: int) -> None:
        batch.withColumn("_batch", F.lit(n).cast("long")).write.mode("overwrite").parquet(f"{name}/rows-{n}")
        batches.add(n)

    q = result.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{name}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    if error := q.exception():
        raise error
    if not batches:
        return spark.createDataFrame([], schema)
    read = [max(batches)] if mode == "complete" else sorted(batches)
    rows = spark.read.schema(T.StructType([*schema.fields, T.StructField("_batch", T.LongType())])).parquet(*(f"{name}/rows-{n}" for n in read))
    if keys and len(read) > 1:
        rows = rows.groupBy(*keys).agg(F.max_by(F.struct("*"), "_batch").alias("_last")).select("_last.*")
    return rows.select(*schema.names)


def to_files(result: DataFrame, path: str, checkpoint: str):
    """Continuous append to Parquet; restarts continue from the checkpoint."""
    return result.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").start()
