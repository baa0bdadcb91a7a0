"""Documents from folders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folders never read (fixed values).
IGNORED = ("node_modules", ".git", ".cache", "vendor", "dist", "build")


def documents(spark: SparkSession, root: str, glob: str = "*.md", ignored: tuple[str, ...] = ()) -> DataFrame:
    """(path, body, modified_at, bytes) of the files below ``root`` whose name fits
    ``glob``; paths with an ignored or a dot part and blank files are left out."""
    files = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter=glob)
    base = F.lit("/" + root.split("://", 1)[-1].strip("/") + "/")
    path = F.element_at(F.split(F.regexp_replace(F.col("_metadata.file_path"), "^[a-z]+:/*", "/"), base, 2), -1)
    rows = files.select(path.alias("path"), F.col("value").alias("body"), F.col("_metadata.file_modification_time").alias("modified_at"), F.col("_metadata.file_size").alias("bytes"))
    bad = F.exists(F.split("path", "/"), lambda p: p.startswith(".") | p.isin(*IGNORED, *ignored))
    return rows.where(~bad & F.col("body").rlike(r"\S"))
