import pytest
from pyspark.sql import functions as F

from siltworks.engine import NOTHING_FOUND, Conversation, Engine
from siltworks.operators import chunking, conversation, listing, payload, rows, search, store


def test_units():
    md = "# Head\npara one\ngoes on\n\n- a\n- b\n```py\nx = 1\n```\nafter\n```\nopen"
    assert chunking.units(md) == [("heading", "# Head"), ("paragraph", "para one goes on"), ("list", "- a\n- b"), ("code_block", "```py\nx = 1\n```"), ("paragraph", "after"), ("code_block", "```\nopen")]


def test_cut_and_windows():
    s = " ".join(f"Sentence number {i} is here." for i in range(40))
    parts = chunking.cut(s, 30, 5)
    assert all(chunking.tokens(p) <= 36 for p in parts) and " ".join(parts) == s
    w = chunking.windows("x" * 1000, 50, 10)
    assert all(len(p) <= 240 for p in w) and len(w) == 7
    assert chunking.tail("aaaa bbbb cccc", 2) == "bbbb cccc"


def test_fold_keeps_heading_and_overlap():
    conf = chunking.Settings(target=60, overlap=4, alike=0.0)
    long = "Bait boxes stand along the wall and are checked twice a week by the crew. " * 2
    out = chunking.chunk_text(f"# Short\n\n{long}\n\n{long}\n\n{long}", conf)
    assert out[0]["text"].startswith("# Short Bait") and [c["chunk_index"] for c in out] == list(range(1, len(out) + 1))
    assert all(chunking.tokens(c["text"]) <= 60 for c in out)
    assert chunking.chunk_text(" \n", conf) == [] and chunking.chunk_text(None, conf) == []


def test_tiny_chunks_join_once():
    assert chunking.merged([(1, "a", "x"), (2, "a", "y"), (3, "a", "z" * 80)], 10, 30) == [(1, "semantic_merged", "x y"), (3, "a", "z" * 80)]
    assert chunking.merged([(1, "a", "z" * 80), (2, "a", "y")], 10, 30) == [(1, "semantic_merged", "z" * 80 + " y")]


def test_chunk_table(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").withColumn("chunk_index", F.lit(7)).withColumn("k", F.lit(1))
    ch = chunking.chunk(docs, "doc_id", conf=chunking.Settings(target=100), scope={"file_id": F.col("file_id")})
    got = ch.collect()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r.chunk_index)
        assert r.text.strip() and r.char_count == len(r.text) and r.token_count == max(1, len(r.text) // 4)
    assert all(sorted(v) == list(range(1, len(v) + 1)) for v in by.values()) and len(by) == docs.count()
    cut = chunking.chunk(spark.createDataFrame([(1, "a b---c d--- "), (2, None)], "k long, text string"), "k", delimiter="---")
    assert [(r.k, r.chunk_index, r.text) for r in cut.orderBy("k", "chunk_index").collect()] == [(1, 1, "a b"), (1, 2, "c d")]


def test_global_numbers(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("v"))
    got = {r.v: r.global_index for r in chunking.globally_numbered(df, ["v"], parts=5).collect()}
    assert got == {i: i for i in range(1000)}


def test_filters(spark):
    df = spark.createDataFrame([(1, "a", True), (2, "b", True), (3, "a", False), (4, None, True)], "id long, k string, is_active boolean")
    eq = lambda k, v: {"key": k, "match": {"value": v}}
    ids = lambda t: [r.id for r in df.where(search.compiled(t)).orderBy("id").collect()]
    assert ids(None) == [1, 2, 3, 4] and ids({"must": eq("k", "a")}) == [1, 3] and ids({"must_not": [eq("k", "a")]}) == [2, 4]
    assert ids({"should": [eq("k", "b"), eq("id", 3)]}) == [2, 3]
    tree = search.required({"must": [eq("is_active", False), eq("k", "a")]}, eq("is_active", True))
    assert ids(tree) == [1] and len(tree["must"]) == 2


def test_search(spark):
    pts = spark.createDataFrame([(i, [float(i == j) for j in range(4)]) for i in range(4)] + [(9, None), (10, [0.0] * 4), (11, [1.0])], "vec_id long, embedding array<float>")
    assert [r.vec_id for r in search.top_k(pts, [1, 1, 0, 0], 5, 0.1).collect()] == [0, 1]
    q = spark.createDataFrame([(5, [1.0, 1.0, 0.0, 0.0]), (6, None)], "query_id long, vector array<float>")
    assert [(r.query_id, r.vec_id, r["rank"]) for r in search.top_k_batch(pts, q, 5, 0.1).orderBy("rank").collect()] == [(5, 0, 1), (5, 1, 2)]
    assert search.top_k_batch(pts, q.limit(0)).count() == 0
    e = search.hashed_embedding(spark.createDataFrame([(1, "a b"), (2, None)], "k long, t string"), "k", "t", 8).orderBy("k").collect()
    assert len(e[0].dense) == 8 and abs(sum(x * x for x in e[0].dense) - 1) < 1e-6 and sum(e[1].dense) == 0


def test_point_table(spark, tmp_path):
    s = store.PointStore(spark, f"file://{tmp_path}/s")
    row = lambda *r: spark.createDataFrame(list(r), "point_id string, file_id string, is_active boolean, v int, dense array<float>")
    s.upsert("main", row(("a", "f", True, 1, [1.0]), ("a", "f", True, 2, [1.0]), ("b", "g", True, 1, [1.0]), (None, "g", True, 1, [1.0])), "v")
    assert {(r.point_id, r.v) for r in s.read("main").collect()} == {("a", 2), ("b", 1)}
    s.upsert("main", row(("b", "g", True, 5, [1.0]), ("c", None, True, 1, [1.0])), "v")
    assert {(r.point_id, r.v) for r in s.read("main").collect()} == {("a", 2), ("b", 5), ("c", 1)}
    assert s.set_active("main", "f", False) == 1 and s.set_active("main", "none", False) == 0
    assert {r.point_id for r in s.read("main").where("is_active").collect()} == {"b", "c"}
    s.clone("main", "copy")
    assert s.delete("main", "f") == {"matched": 1, "remaining": 0} and s.count("main") == 2 and s.count("copy") == 3
    assert s.names() == ["copy", "main"]
    with pytest.raises(ValueError):
        s.delete("main", "f")
    with pytest.raises(ValueError):
        s.create("main", row(("a", "f", True, 1, [1.0])))
    with pytest.raises(ValueError):
        s.upsert("main", row(("a", "f", True, 1, [1.0, 2.0])), "v")
    s.drop("copy")
    assert s.names() == ["main"]


def test_listing(spark):
    pts = spark.createDataFrame([("f", 1, "2024", True), ("f", 2, "2025", True), (" ", 3, "2025", True), ("g", 4, "2023", False), (None, 5, "x", True)], "file_id string, o long, at string, on boolean")
    files = listing.by_file(pts, "file_id", "o", "at", ["o"], "on")
    assert [tuple(r) for r in files.collect()] == [("f", 2, 1, "2025")]
    reg = listing.registry_state(spark.createDataFrame([(1, "f", "queued", 1), (2, "f", "active", 2), (3, "h", "failed", 1), (4, "i", "deleted", 1), (5, None, "active", 9)], "registry_id long, file_id string, status string, updated_at long"))
    assert {(r.file_key, r.status) for r in listing.status(files, reg).collect()} == {("f", "active"), ("h", "failed"), ("i", "deleted")}
    assert {(r.file_key, r.origin) for r in listing.merged_listing(files, reg).collect()} == {("f", "points"), ("h", "registry")}


def test_rows_and_payload(spark):
    df = spark.createDataFrame([(1, " x ", "N/A"), (2, None, ""), (3, "nan", "y")], "n long, a string, b string")
    assert [r[0] for r in df.select(rows.as_text(["a", "b"], F.col("n"))).collect()] == ["Row 1: a: x | b: N/A", "Row 2: (empty row)", "Row 3: a: nan | b: y"]
    assert [r[0] for r in df.select(rows.as_text(["a", "b"], F.col("n"), sheet="S")).collect()] == ["Sheet: S | Row 1: a: x", "Sheet: S | Row 2: (empty row)", "Sheet: S | Row 3: b: y"]
    m = spark.createDataFrame([({"api_key": "k", "Token2": "t", "name": "n"},), (None,)], "m map<string,string>").select(payload.redacted(F.col("m")).alias("m")).collect()
    assert m[0].m == {"api_key": "[REDACTED]", "Token2": "[REDACTED]", "name": "n"} and m[1].m is None


def test_messages(spark):
    h = spark.createDataFrame([("s", [("user", " a  b", None, None), ("system", "x", None, None), (None, None, "q", "r"), (None, None, " ", "z")])], "s string, h array<struct<role: string, content: string, question: string, answer: string>>")
    got = [(r.role, r.content) for r in conversation.expanded(h, "s", "h").orderBy("seq").collect()]
    assert got == [("user", "a b"), ("user", "q"), ("assistant", "r")]


def test_conversation_contracts():
    seen = []
    hits = [{"text": x} for x in ("One", "", "Two", "Ignored")]
    c = Conversation(lambda q, h: seen.append(list(h)) or f"rw {q}", lambda q: hits if "none" not in q else [], lambda q, t: " ".join(t))
    assert c.session_of("u") == c.session_of("u") != c.session_of("v")
    with pytest.raises(ValueError):
        c.ask("  ")
    assert c.ask("none", user_id="n")["answer"] == NOTHING_FOUND
    first = c.ask("q1", session_id="s")
    assert first["answer"] == "One Two" and first["query"] == "rw q1"
    c.ask("q2", session_id="s")
    assert [m["content"] for m in seen[-1]] == ["q1", "One Two"]
    c.ask("q3", session_id="s", history=[{"role": "user", "content": "a"}, {"role": "assistant", "content": "b"}])
    assert len(c.sessions["s"]) == 4
    c.ask("q", session_id="t", history=[{"question": "a", "answer": "b"}, {"question": " ", "answer": "x"}, {"question": "only"}])
    assert len(c.sessions["t"]) == 5


def test_engine(spark, tmp_path):
    e = Engine(spark, f"file://{tmp_path}/e", conf=chunking.Settings(target=40))
    docs = spark.createDataFrame([("f1", "Bait boxes stand along the wall. They are checked weekly."), ("f2", "Clean the nozzle after each use."), (None, "lost"), ("f3", "")], "file_id string, text string")
    e.ingest(docs)
    e.ingest(docs)
    assert {(r.file_key, r.chunk_count) for r in e.list_files().collect()} == {("f1", 1), ("f2", 1)}
    assert e.retrieve("clean the nozzle after use", threshold=0.3).first().file_id == "f2"
    assert e.delete_file("f2") == {"matched": 1, "remaining": 0}
    assert e.retrieve("clean the nozzle after use", threshold=0.9).count() == 0
    with pytest.raises(ValueError):
        e.retrieve(" ")
