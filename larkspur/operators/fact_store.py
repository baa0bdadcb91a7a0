"""A stored table of validity intervals that late facts are put into.

Keys (subject and predicate) lie in buckets by hash, a folder a bucket.  A batch of facts
rewrites the buckets of its own keys under its number: their stored facts and the new
ones are put in order again, which closes, reopens and splits intervals as if all had come
at once.  A bucket's newest finished version counts, so a batch that failed midway, or
comes again, is written again under its number with the same result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.operators import knowledge
from larkspur.operators.text_index import _files, _finish, generations

BUCKETS = 64


def _newest(spark: SparkSession, path: str, below: int | None = None) -> dict[int, int]:
    """{bucket: its newest finished version}, of those below a number."""
    out: dict[int, int] = {}
    for version in generations(spark, path):
        folder, fs = _files(spark, f"{path}/facts/version={version}")
        if (below is None or version < below) and fs.exists(folder):
            out |= {int(s.getPath().getName().split("=")[1]): version for s in fs.listStatus(folder) if "bucket=" in s.getPath().getName()}
    return out


def _stored(spark: SparkSession, path: str, buckets: dict[int, int]) -> DataFrame | None:
    folders = [f"{path}/facts/version={v}/bucket={b}" for b, v in sorted(buckets.items())]
    return spark.read.option("basePath", f"{path}/facts").parquet(*folders).drop("version", "bucket") if folders else None


def put(facts: DataFrame, path: str, number: int, buckets: int = BUCKETS) -> None:
    """Put facts(id, subject, predicate, object, valid_from, ingested) into the table as
    batch ``number``; batches may come in any order of their facts, each number once or
    again.  A fact whose id is stored already replaces it if its key is the same."""
    spark = facts.sparkSession
    facts = facts.select("id", "subject", "predicate", "object", "valid_from", "ingested")
    key = F.pmod(F.xxhash64(knowledge.entity_slug(F.col("subject")), F.lower("predicate")), F.lit(buckets)).cast("int")
    new = facts.withColumn("bucket", key)
    touched = {r.bucket for r in new.select("bucket").distinct().collect()}  # at most ``buckets``
    known = {b: v for b, v in _newest(spark, path, number).items() if b in touched}
    old = _stored(spark, path, known)
    rows = new if old is None else old.join(new.select("id"), "id", "left_anti").withColumn("bucket", key).unionByName(new)
    if touched:
        rows.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/facts/version={number}")
    _finish(spark, path, number)


def current(spark: SparkSession, path: str) -> DataFrame:
    """The intervals of all facts put so far, as ``knowledge.build`` makes them."""
    rows = _stored(spark, path, _newest(spark, path))
    if rows is None:
        raise FileNotFoundError(f"no facts at {path}")
    return knowledge.build(rows)


def put_stream(facts: DataFrame, path: str, checkpoint: str, buckets: int = BUCKETS):
    """Put every batch of a stream of facts under the batch's own number."""
    return facts.writeStream.foreachBatch(lambda batch, number: put(batch, path, number, buckets)).option("checkpointLocation", checkpoint)
