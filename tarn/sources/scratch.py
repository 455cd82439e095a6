"""Tables between the steps of a run, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, read from the session (``spark.checkpoint.dir``).

    Where it is unset a folder of our own is set, in local mode (tests); on a cluster that would be another disk on each
    machine, so there it is an error.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at
    set_to = spark.sparkContext._jsc.sc().getCheckpointDir()
    if set_to.isDefined():
        return set_to.get()
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir isn't set: the folder that driver and executors share")
    own = tempfile.mkdtemp(prefix="tarn-")
    spark.sparkContext.setCheckpointDir(own)
    delete_on_exit(spark, own)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has; what is written there is deleted when the session's JVM ends."""
    path = f"{shared_dir(spark).rstrip('/')}/tarn-{name.partition('.')[0]}-{uuid.uuid4().hex}{''.join(name.partition('.')[1:])}"
    delete_on_exit(spark, path)
    return path


def delete_on_exit(spark: SparkSession, path: str) -> None:
    """Delete a path when the session's JVM ends."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)


def written(df: DataFrame, name: str) -> DataFrame:
    """The same rows, written once as Parquet in the shared folder."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
