"""Tables written once in the shared folder and read again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Sizes from which Spark's figure of a plan's input is no measurement (as of local rows).
UNKNOWN = 1 << 60


def fresh(spark: SparkSession, label: str) -> str:
    """A new path in the folder that the session names in ``spark.checkpoint.dir``.

    What is written there outlives any executor and goes when the driver's JVM ends.
    Where the setting is unset a folder is made on one machine (tests); a cluster raises.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", root)
    path = f"{root.rstrip('/')}/larkspur/{label}-{uuid.uuid4().hex}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def staged(df: DataFrame, label: str) -> DataFrame:
    """``df`` written as Parquet in a fresh shared path, and read again."""
    path = fresh(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Bytes of stored input of a task of costly work, and such tasks a core at least.
TASK_BYTES, TASKS = 4 << 20, 3


def spread(df: DataFrame, *keys: str, like: DataFrame | None = None) -> DataFrame:
    """``df`` dealt out evenly, before work that costs more than the reading of its rows;
    by ``keys`` where given, so that groups of these need no other exchange.  ``like`` is
    what the number of tasks goes by where ``df`` is made small, but works out large.

    A small file of many rows is read by one task (a row group can't be divided), which
    then did all the work.
    """
    leaves = (df if like is None else like)._jdf.queryExecution().optimizedPlan().collectLeaves()  # a join's own figure is a product
    size = sum(int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size()))
    tasks = df.sparkSession.sparkContext.defaultParallelism * TASKS
    return df.repartition(tasks if size >= UNKNOWN else max(tasks, size // TASK_BYTES), *keys)
