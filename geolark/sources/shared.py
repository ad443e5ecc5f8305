"""The folder that the driver and all executors see."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Folders of this driver's intermediates, deleted when it ends.
_folders: list[str] = []


def delete(spark: SparkSession, path: str) -> None:
    """Delete a file or folder on any file system that Spark knows; one that isn't there is no error."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def _delete_all(spark: SparkSession) -> None:
    for path in _folders:
        try:
            delete(spark, path)
        except Exception:  # the session has ended: nothing can be deleted any more
            return


def new_folder(spark: SparkSession, name: str) -> str:
    """A path for intermediate files under spark.checkpoint.dir; a local session without one gets a folder of its own, a cluster an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file:" + tempfile.mkdtemp(prefix="geolark-")
        spark.sparkContext.setCheckpointDir(found)
    path = f"{found}/{name}-{uuid.uuid4().hex}"
    _folders.append(path)
    if len(_folders) == 1:
        atexit.register(_delete_all, spark)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` as a table in the shared folder: later passes read the files, whatever becomes of the executors that made them."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
