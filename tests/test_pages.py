from pyspark.sql import functions as F

from siltworks.operators import conversation, metrics, neighbours, pages
from siltworks.streaming import jobs


def test_placeholders_and_zones(spark):
    rows = spark.createDataFrame([("f", 1, "a"), ("f", 2, "<img>"), ("f", 3, "<img>"), ("f", 4, None), ("g", 1, "<img>")], "f string, n int, t string")
    fill = spark.createDataFrame([("f", "one", 5), ("h", "x", 1)], "f string, d string, o int")
    got = {(r.f, r.n, r.t) for r in pages.filled(rows, "f", "n", "t", F.col("t") == "<img>", fill, "d", "o").collect()}
    assert got == {("f", 1, "a"), ("f", 2, "one"), ("f", 4, None)}
    z = spark.createDataFrame([(1.0, 2.0, None), (9.0, 2.0, 8.0), (5.0, None, None)], "y double, h double, f double").select(pages.in_zone(F.col("y"), F.col("h"), F.col("f")))
    assert [r[0] for r in z.collect()] == ["header", "footer", "body"]


def test_guards_and_counts(spark):
    d = spark.createDataFrame([(1, "abc"), (2, "abcdef"), (3, None)], "k long, t string")
    good, bad = pages.guarded(d, F.length("t"), 4)
    assert {r.k for r in good.collect()} == {1, 3} and bad.first().error == "too large: 6"
    s = pages.cache_stats(d, d.where("k = 1"), F.md5(F.encode("t", "UTF-8"))).first()
    assert (s.hits, s.misses, s.hit_rate) == (1, 2, 0.333)
    assert pages.cache_stats(d.limit(0), d, F.col("t")).first().hit_rate == 0
    e = pages.empty_reason(spark.createDataFrame([("a", True), ("a", False), ("b", None)], "g string, on boolean"), "g", F.coalesce("on", F.lit(False)))
    assert {(r.g, r.reason) for r in e.collect()} == {("a", "no match"), ("b", "all inactive")}
    m = spark.createDataFrame([([("a", "1"), (" ", "2"), ("b", " "), ("a", "3")],)], "h array<struct<key: string, value: string>>").select(pages.header_map(F.col("h"))).first()[0]
    assert m == {"a": "3"}
    assert [r[0] for r in spark.createDataFrame([(".PNG",), (".x",)], "s string").select(pages.media_type(F.col("s"))).collect()] == ["image/png", "image/jpeg"]
    b = metrics.batches(spark.createDataFrame([(1, True), (1, False), (2, True), (3, False)], "b int, f boolean"), "b", F.col("f"))
    assert {(r.b, r.status) for r in b.collect()} == {(1, "partial_success"), (2, "FAILED"), (3, "success")}
    assert {(r.b, r.n, r.rate) for r in metrics.shares(spark.createDataFrame([("x",), ("x",), ("y",)], "b string"), "b").collect()} == {("x", 2, 66.7), ("y", 1, 33.3)}


def test_csv_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text("x,y\n1,\n2,b\n")
    s = jobs.csv_rows(spark, str(tmp_path / "in"), "x string, y string")
    q = s.writeStream.format("memory").queryName("csvrows").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination(60)
    assert {r.row_text for r in spark.table("csvrows").collect()} == {"x: 1", "x: 2 | y: b"}


def test_previous_across_pieces(spark):
    rows = [("a", i, i % 3) for i in range(50)] + [("b", None, 1), ("b", 3, 1), (None, 1, 1)]
    df = spark.createDataFrame(rows, "k string, o int, v int")
    got = {(r.k, r.o): r.previous and (r.previous.o, r.previous.v) for r in neighbours.with_previous(df, "k", ["o"], ["o", "v"], F.floor(F.col("o") / 7)).collect()}
    assert all(got["a", i] == (i - 1, (i - 1) % 3) for i in range(1, 50)) and got["a", 0] is None
    assert got["b", None] is None and got["b", 3] == (None, 1)
    left = conversation.without_repeats(df.where("k = 'b'"), "k", ["o"], ["v"], F.floor(F.col("o") / 7))
    assert [(r.k, r.o) for r in left.collect()] == [("b", None)]
