"""The folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir, else its checkpoint folder. Where neither is set, a temporary folder on one machine
    (tests); on a cluster that is an error, as executors would write where nobody else reads."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="spark-shared-")
        spark.sparkContext.setCheckpointDir(named)
    return named


def ensure_checkpoints(spark: SparkSession) -> None:
    """Let checkpoint() write to the shared folder."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder, if the session still runs."""
    jsc = spark.sparkContext._jsc
    if jsc is not None and not jsc.sc().isStopped():
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(jsc.hadoopConfiguration()).delete(target, True)


def own_folder(spark: SparkSession, kind: str) -> str:
    """A new folder below the shared one, removed when the process ends."""
    path = f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"
    atexit.register(remove, spark, path)
    return path


def stored(df: DataFrame) -> DataFrame:
    """`df` written once as Parquet in the shared folder and read back: row numbers given by a task stay what they were."""
    path = own_folder(df.sparkSession, "framelake")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
