from foliospark.streaming import jobs


def _stream(spark, tmp_path, batches, schema):
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def test_progress_keeps_the_latest(spark, tmp_path):
    schema = "user_id string, book_id string, pages int, synced_at long"
    s = _stream(spark, tmp_path, [[("u", "b", 1, 10)], [("u", "b", 9, 5), ("v", "b", 3, 1)], [("u", "b", 7, 20)]], schema)
    jobs.latest_progress(s, str(tmp_path / "t"), str(tmp_path / "c")).awaitTermination()
    rows = spark.read.parquet(str(tmp_path / "t")).orderBy("user_id").collect()
    assert [(r.user_id, r.pages) for r in rows] == [("u", 7), ("v", 3)]


def test_backoff_counts_failures_in_a_row(spark, tmp_path):
    s = _stream(spark, tmp_path, [[("a", i, False) for i in range(5)], [("a", 9, True), ("a", 10, False)]], "source string, at int, ok boolean")
    q = jobs.backoff(s).writeStream.outputMode("update").format("memory").queryName("waits").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r.failures, r.wait) for r in spark.table("waits").collect()} == {(5, 120), (1, 0)}
