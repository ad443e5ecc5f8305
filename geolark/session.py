"""Session settings that follow the size of the input."""

from __future__ import annotations

import math

from pyspark.sql import SparkSession

#: Bytes of one shuffle partition and of one scan split that a task holds with room to spare.
PARTITION_BYTES = 128 << 20


def settings(input_bytes: int, cores: int, shuffled_share: float = 1.0) -> dict[str, str]:
    """Spark settings for a job over `input_bytes` on `cores` cores, of which `shuffled_share` crosses a shuffle.

    Shuffle partitions are at least three a core and at most PARTITION_BYTES each; adaptive execution merges those that turn out
    small and splits skewed join partitions. Splits shrink where the input is too small to occupy the cores.
    """
    parts = max(3 * cores, math.ceil(input_bytes * shuffled_share / PARTITION_BYTES))
    split = min(PARTITION_BYTES, max(4 << 20, input_bytes // max(1, 3 * cores)))
    return {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(PARTITION_BYTES // 2),
        "spark.sql.shuffle.partitions": str(parts),
        "spark.sql.files.maxPartitionBytes": str(split),
        "spark.sql.session.timeZone": "UTC",
        # texts can be long: batches for Python stay small
        "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    }


def session(app: str, input_bytes: int, cores: int, **more: str) -> SparkSession:
    return SparkSession.builder.appName(app).config(map=settings(input_bytes, cores) | more).getOrCreate()
