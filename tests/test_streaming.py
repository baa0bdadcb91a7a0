from pyspark.sql import functions as F

from larkspur.operators import lexical
from larkspur.streaming import access


def test_postings_of_a_stream(spark, tmp_path):
    """Two files, a batch each; a restart from the same checkpoint adds nothing."""
    schema = "doc_id long, path string, title string, body string"
    one = spark.createDataFrame([(1, "a.md", "one", "two two three"), (2, "b.md", None, "")], schema)
    two = spark.createDataFrame([(3, "c.md", "four", "two")], schema)
    source, out, mark = (str(tmp_path / x) for x in ("docs", "postings", "mark"))
    for df in (one, two):
        df.coalesce(1).write.mode("append").parquet(source)
    for _ in range(2):
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
        access.index_batches(stream, out, mark).trigger(availableNow=True).start().awaitTermination()
    found = spark.read.parquet(out).select("doc_id", "term", "tf")
    want = lexical.postings(one.unionByName(two))
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.select("doc_id", "term", "tf").collect()))


def test_sessions_and_counts_of_a_stream(spark, tmp_path):
    rows = [(1, "2024-01-01 10:00:00"), (1, "2024-01-01 10:10:00"), (1, "2024-01-01 12:00:00"), (2, "2024-01-01 10:00:00"), (9, "2024-01-09 00:00:00")]
    source = str(tmp_path / "events")
    spark.createDataFrame(rows, "user_id long, ts string").select("user_id", F.to_timestamp("ts").alias("ts")).coalesce(1).write.parquet(source)
    stream = spark.readStream.schema("user_id long, ts timestamp").parquet(source)
    query = access.sessions(stream).writeStream.format("memory").queryName("sessions").outputMode("append").start()
    query.processAllAvailable()
    query.stop()
    got = sorted((r.user_id, r.accesses) for r in spark.table("sessions").collect())
    assert got == [(1, 1), (1, 2), (2, 1)]  # the last user's session is still open
