"""Keyed tables in buckets: a merge rewrites the buckets that it touches and leaves the files of the others as they are."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Buckets of a table, and the most that a table may have.
BUCKETS, MOST_BUCKETS = 64, 4096


def _bucket(keys: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def create(rows: DataFrame, path: str, keys: list[str], buckets: int = BUCKETS) -> None:
    """Write `rows` as a table with `buckets` folders, by the hash of the keys."""
    if not 0 < buckets <= MOST_BUCKETS:
        raise ValueError(f"a table has 1 to {MOST_BUCKETS} buckets")
    rows.withColumn("_bucket", _bucket(keys, buckets)).repartition("_bucket").write.partitionBy("_bucket").parquet(path)
    rows.sparkSession.createDataFrame([(buckets, keys)], "buckets int, keys array<string>").coalesce(1).write.json(f"{path}.layout")


def read(spark: SparkSession, path: str) -> DataFrame:
    """The table's rows."""
    return spark.read.parquet(path).drop("_bucket")


def merge(spark: SparkSession, path: str, new: DataFrame, rule: Callable[[DataFrame, DataFrame], DataFrame]) -> list[int]:
    """Replace the buckets that have keys of `new` by rule(their rows, `new`); the numbers of these buckets.

    The rule, such as upsert() or insert_missing(), must treat keys apart. Only the touched buckets are read. They are written beside the table and
    take their folders' places when all are written; one merge at a time.
    """
    layout = spark.read.json(f"{path}.layout").first()
    fresh = new.withColumn("_bucket", _bucket(layout["keys"], layout["buckets"]))
    touched = sorted(r[0] for r in fresh.select("_bucket").distinct().collect())  # MOST_BUCKETS numbers at most
    if not touched:
        return []
    current = spark.read.parquet(path).where(F.col("_bucket").isin(touched)).drop("_bucket")
    merged = rule(current, new).withColumn("_bucket", _bucket(layout["keys"], layout["buckets"]))
    merged.repartition("_bucket").write.partitionBy("_bucket").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)
    return touched
