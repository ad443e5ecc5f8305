"""Shared helpers: materialised intermediates, row keys and global prefix sums."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Folders of this driver's intermediates.
_folders: list[str] = []
#: Rows of documents, and the columns a pipeline stage hands on.
DOCUMENT_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor sees: spark.checkpoint.dir, or one of our own where a local session has none (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="geolark-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def _delete(spark: SparkSession, path: str) -> None:
    if not path:
        return
    try:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session has ended: nothing can be deleted any more
        return


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder in the shared one, deleted when the driver ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _folders.append(path)
    if len(_folders) == 1:
        atexit.register(release, spark)
    return path


def folders_made() -> int:
    """How many folders there are by now; what release() takes to free only later ones."""
    return len(_folders)


def release(spark: SparkSession, since: int = 0, keep: DataFrame | None = None) -> None:
    """Delete the folders made after the first `since`, but for that of `keep`. What was read from them can't be computed any more."""
    own = getattr(keep, "_written_to", "")
    for path in _folders[since:]:
        if path != own:
            _delete(spark, path)
    _folders[since:] = [own] if own in _folders[since:] else []


def materialize(df: DataFrame, name: str, replaces: DataFrame | None = None) -> DataFrame:
    """Write `df` to the shared folder and read it again: later passes restart from the files when an executor is lost.

    The files of `replaces`, an earlier result of this function that nothing else reads any more, are deleted.
    """
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.parquet(path)
    if replaces is not None:
        _delete(spark, getattr(replaces, "_written_to", ""))
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def dealt_join(rows: DataFrame, single: DataFrame, key: str, salt: list[str], per_copy: int = 2000) -> DataFrame:
    """`rows` joined with `single` (one row a `key`), a popular key dealt by the hash of `salt` over copies of its row, one for each `per_copy` rows.

    No task gets all rows of a key, however many there are, and the copies grow with the rows they serve.
    """
    copies = rows.groupBy(key).agg(F.ceil(F.count("*") / per_copy).cast("int").alias("_copies")).where("_copies > 1")
    copies = materialize(copies, "copies")  # only popular keys: a short table
    spread = F.coalesce("_copies", F.lit(1))
    nth = F.pmod(F.xxhash64(*salt), spread).cast("int")
    left = rows.join(copies, key, "left").withColumn("_nth", nth).drop("_copies")
    right = single.join(copies, key, "left").withColumn("_nth", F.explode(F.sequence(F.lit(0), spread - 1))).drop("_copies")
    return left.join(right, [key, "_nth"]).drop("_nth")


def packed(df: DataFrame, **keys: Column) -> DataFrame:
    """`df` as one struct column `_row` plus the given keys, so that no column of the caller clashes with ours."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"), *[v.alias(k) for k, v in keys.items()])


def running_totals(df: DataFrame, order: list[str], totals: dict[str, str], partitions: int | None = None) -> DataFrame:
    """`df` with a column for each {name: column} of `totals`: the inclusive running sum in the global order of `order`.

    The rows are range-partitioned, so no task gets more than its range; a single task sees one row
    a partition only (the partitions' sums), never the data.
    """
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id())
    ranged = materialize(ranged, "ranged")  # both uses below must see the same ranges
    sums = ranged.groupBy("_part").agg(*[F.sum(v).alias(f"_sum_{k}") for k, v in totals.items()])
    ahead = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select("_part", *[F.coalesce(F.sum(f"_sum_{k}").over(ahead), F.lit(0)).alias(f"_before_{k}") for k in totals])
    within = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    # one row a partition: bounded by the partition count, not by the data
    joined = ranged.join(F.broadcast(before), "_part")
    return joined.select(*df.columns, *[(F.sum(v).over(within) + F.col(f"_before_{k}")).alias(k) for k, v in totals.items()])
