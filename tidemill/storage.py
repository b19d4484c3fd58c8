"""Tables kept between the jobs of one query."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """A folder that the driver and all executors see: the session's ``spark.checkpoint.dir``. Where that is unset, a local
    session gets a temporary one, and a cluster an error, as its executors would not see it."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        given = context.getConf().get("spark.checkpoint.dir")
        if not given and context.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors see")
        context.setCheckpointDir(given or tempfile.mkdtemp("-checkpoints"))
    return context._jsc.sc().getCheckpointDir().get()


def new_folder(spark: SparkSession, name: str) -> str:
    """The path of a folder that isn't there yet, in the shared one."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the shared one that no later step reads."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def saved(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back, where several parts of a plan read it: the lineage is cut, and a lost
    executor costs nothing. Spark deletes it when it is no longer referred to, if the session is started with
    ``spark.cleaner.referenceTracking.cleanCheckpoints``."""
    shared_folder(df.sparkSession)
    out = df.checkpoint()
    out._longest = dict(getattr(df, "_longest", {}))  # see frames.longest
    return out
