from pyspark.sql import functions as F

from siltworks.streaming import jobs


def test_sessions_and_windows(spark, data, tmp_path):
    events = spark.read.parquet(f"{data}/events.parquet")
    src = str(tmp_path / "in")
    events.select(F.col("user_id").cast("string").alias("session"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("role"), F.col("props").alias("content")).repartition(2).write.parquet(src)
    stream = lambda: spark.readStream.schema(spark.read.parquet(src).schema).parquet(src)
    q = jobs.session_histories(stream(), idle="400 days", keep=5).writeStream.format("memory").queryName("hist").outputMode("update").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c1")).start()
    q.awaitTermination(120)
    got = {r.session: (r.seen, r.kept) for r in spark.table("hist").groupBy("session").agg(F.max("seen").alias("seen"), F.max("kept").alias("kept")).collect()}
    want = {str(r.user_id): (r["count"], min(5, r["count"])) for r in events.groupBy("user_id").count().collect()}
    assert got == want
    q = jobs.activity(stream(), late="400 days").writeStream.format("memory").queryName("act").outputMode("update").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c2")).start()
    q.awaitTermination(120)
    assert spark.table("act").groupBy("start", "role").agg(F.max("n").alias("n")).agg(F.sum("n")).first()[0] == events.count()


def test_watch_folder(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("one")
    seen = []
    take = lambda df, n: seen.extend(r.filename for r in df.select("filename").collect())
    jobs.watch_folder(spark, str(tmp_path / "in"), str(tmp_path / "c"), take).awaitTermination(60)
    (tmp_path / "in" / "b.md").write_text("two")
    jobs.watch_folder(spark, str(tmp_path / "in"), str(tmp_path / "c"), take).awaitTermination(60)
    assert seen == ["a.txt", "b.md"]
