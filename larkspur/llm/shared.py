"""Shared folders, staged tables and column hygiene for the operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word rule: space and the control characters 09-0D.
WORD_BREAKS = "\t\n\x0b\x0c\r"


def shared_root(spark: SparkSession) -> str:
    """Folder that the driver and all executors see.

    It is what the session names in ``spark.checkpoint.dir``.  Where that is unset
    and all runs on one machine (tests), a temporary folder is made once and set as the
    session's checkpoint folder; on a cluster that raises.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", root)
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def shared_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder, deleted when the driver's JVM ends."""
    path = f"{shared_root(spark)}/larkspur/{label}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def shared_file(spark: SparkSession, name: str, raw: bytes) -> str:
    """Write one small file of the driver's into the shared folder; returns its address."""
    path = f"{shared_path(spark, 'file')}/{name}"
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    out = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(hadoop)
    try:
        out.write(raw)
    finally:
        out.close()
    return path


def staged(df: DataFrame, label: str, compression: str = "snappy") -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    This cuts the lineage at files that survive the loss of any executor.
    """
    spark = df.sparkSession
    path = shared_path(spark, label)
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_staged(df: DataFrame) -> None:
    """Delete the files of a staged table that no later step reads."""
    spark = df.sparkSession
    root = shared_root(spark).removeprefix("file://")
    jvm = spark.sparkContext._jvm
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if root in folder and "/larkspur/" in folder:
            hadoop = jvm.org.apache.hadoop.fs.Path(folder)
            hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str = "text"):
    """The text, with null read as the empty text."""
    return F.coalesce(F.col(column), F.lit(""))


def spaced(text):
    """``text`` with every word break made a plain space (literal replaces, no regex)."""
    for c in WORD_BREAKS:
        text = F.replace(text, F.lit(c), F.lit(" "))
    return text


def words_of(text):
    """Array of the maximal runs of characters other than space and 09-0D."""
    return F.array_remove(F.split(spaced(text), " "), "")


def most_frequent(counts: DataFrame, size: int) -> DataFrame:
    """The ``size`` rows of a staged counts(word, n) with the largest n, ties by word.

    A first pass counts words by sixteenths of a power of two, a few hundred rows, and
    finds the range that the last place is in; only words of that range and above are
    sorted.
    """
    bucket = F.floor(16 * F.log2("n"))
    sizes = dict(counts.groupBy(bucket.alias("b")).count().collect())
    left, least = size, None
    for b in sorted(sizes, reverse=True):
        least, left = b, left - sizes[b]
        if left <= 0:
            break
    return counts.where(bucket >= (0 if least is None else least)).select("word", "n").orderBy(F.desc("n"), "word").limit(size)


def row_keys(df: DataFrame) -> dict:
    """Two hashes (96 bits) of all columns of a row, nulls told apart: never null, so
    that joins by them need no other key.  Equal rows share them; of n unequal rows two
    share them with a chance of n * n / 2^97."""
    columns = [F.col(f"`{c}`") for c in df.columns]
    nulls = [c.isNull() for c in columns]
    return {"__k1": F.xxhash64(*nulls, *columns), "__k2": F.hash(*nulls, *columns)}


def whole_rows(df: DataFrame, **more) -> DataFrame:
    """``df`` as one struct column ``row`` beside its row keys and the columns ``more``, so
    that no name of its own meets one of an operator's."""
    return df.select(*[x.alias(k) for k, x in row_keys(df).items()], F.struct(*[F.col(f"`{c}`").alias(c) for c in df.columns]).alias("row"), *[x.alias(k) for k, x in more.items()])
