import hashlib
import uuid

import pytest
from pyspark.sql import functions as F

from siltworks.functions import ids, jsonops, markup, text, urls
from siltworks.operators import listing, search
from siltworks.sources import files, tabular


def one(spark, expr, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expr.alias("y")).first().y


X = None


@pytest.fixture(autouse=True)
def column(spark):
    global X
    X = F.col("x")


@pytest.mark.parametrize("name", ["Ünïcode näme", "", "a|b::c"])
def test_uuid5(spark, name):
    assert one(spark, ids.uuid5(X), name) == str(uuid.uuid5(uuid.NAMESPACE_URL, name))
    assert one(spark, ids.uuid5(X, ids.DNS), name) == str(uuid.uuid5(uuid.NAMESPACE_DNS, name))


def test_ids(spark):
    t = "  Some text \n" * 20
    want = hashlib.sha256(f"f1|{t[:100].strip()}|{len(t)}|3|paragraph".encode()).hexdigest()[:16]
    assert one(spark, ids.chunk_id(X, F.lit(3), F.lit("paragraph"), ids.scope({"file_id": F.lit("f1"), "source": F.lit("")})), t) == want
    assert one(spark, ids.row_id(X, F.lit("row"), F.lit(2)), "f.csv") == str(uuid.uuid5(uuid.NAMESPACE_DNS, "f.csv::row::2"))
    assert one(spark, ids.seeded_id(X, F.lit(" "), F.lit(5)), "kb") == str(uuid.uuid5(uuid.NAMESPACE_DNS, "kb|5"))
    assert one(spark, ids.uuid5(X), None) is None


def test_text(spark):
    assert one(spark, text.squeeze(X), "  a \n b ") == "a b" and one(spark, text.squeeze(X), None) == ""
    assert [one(spark, text.token_count(X), v) for v in (None, "", "abc", "a" * 41)] == [0, 0, 1, 10]
    assert [one(spark, text.word_tokens(X), v) for v in (None, " ", "a  b")] == [0, 0, 2]
    assert one(spark, text.sentences(X), "One is. Two! three? Four") == ["One is.", "Two! three?", "Four"]
    assert one(spark, text.overlap_tail(X, 3), "alpha beta gamma delta") == "beta gamma delta" and one(spark, text.overlap_tail(X, 0), "a b") == ""
    assert one(spark, text.char_windows(X, 5, 1, 1), "a" * 34) == ["a" * 20, "a" * 18] and one(spark, text.char_windows(X, 5, 1, 1), "") == []
    assert one(spark, text.safe_filename(X), "/a/b c?.pdf") == "b_c_.pdf" and one(spark, text.safe_filename(X), None) == "upload.pdf"
    assert [one(spark, text.truth(X), v) for v in ("YES ", "off", "?", None)] == [True, False, True, True]
    assert one(spark, text.running_head(X), "Page 3 of 12  Report 2024") == "report"
    assert one(spark, text.safe_path(X), "../a/./.env\\b?.txt") == "a/_.env/b_.txt"
    assert one(spark, text.page_number(X), "x\n## PAGE 12") == 12 and one(spark, text.page_number(X), None) == 1
    assert one(spark, text.ocr_clean(X), "a\r\n\r\n\n\nb \t c ") == "a\n\nb c"
    assert one(spark, text.jaccard(X, F.lit("gamma beta")), "beta delta") == pytest.approx(1 / 3) and one(spark, text.jaccard(X, X), None) == 0
    assert one(spark, text.clean_query(X), "Standalone query: 'what is it'") == "what is it"
    assert one(spark, text.last_question(X), "Question: a\nx\nquestion:  b \n") == "b" and one(spark, text.last_question(X), "none") is None
    assert one(spark, text.contains_any(X, ["eye", "swallow"]), "in my EYES") is True


def test_urls(spark):
    assert one(spark, urls.normal(X), " HTTPS://A.Example/B/?q=1#x ") == "https://a.example/B"
    assert one(spark, urls.normal(X, keep_query=True), "http://a.b/c?q=1") == "http://a.b/c?q=1"
    assert [one(spark, urls.normal(X), v) for v in (None, "ftp://a/b", "/x", "http:///x")] == [""] * 4
    assert one(spark, urls.in_scope(X, "a.b", subdomains=True, root_path="/d", by_path=True), "http://c.a.b/d/e") is True
    assert one(spark, urls.page_like(X), "http://a.b/x.PDF") is False and one(spark, urls.page_like(X), "http://a.b/x.csv") is False
    assert one(spark, urls.title(X), "http://a.b/the-long_way/") == "the long way" and one(spark, urls.slug(X), "http://a.b/") == "home"
    digest = hashlib.md5(b"http://a.b/c").hexdigest()[:8]
    assert one(spark, urls.page_filename(X, F.lit("A title")), "http://a.b/c") == f"c_A_title_{digest}.html"


def test_markup(spark):
    html = '<html><head><title>T &amp; U</title><style>x{}</style></head><body><h2>B</h2><h1>A</h1><p>One <b>two</b></p><a href="/x">go</a><script>no()</script></body></html>'
    assert one(spark, markup.title(X), html) == "T & U"
    assert [(h.level, h.text) for h in one(spark, markup.headings(X), html)] == [(1, "A"), (2, "B")]
    md = one(spark, markup.to_markdown(X), html)
    assert md.startswith("# T & U\n") and "One two go" in md and "- [go](/x)" in md and "no()" not in md
    many = "".join(f'<a href="/{i}">l{i}</a>' for i in range(53))
    assert "... and 3 more" in one(spark, markup.to_markdown(X), many)
    assert one(spark, markup.distinct_blocks(X), "A b\n\nc\n\n a  B") == "A b\n\nc"
    assert one(spark, markup.without_title(X, F.lit("T")), "# T\n\nbody") == "body" and one(spark, markup.without_title(X, F.lit("U")), "# T\n\nbody") == "# T\n\nbody"


def test_json(spark):
    assert one(spark, jsonops.pick(X, "a.b[0]"), '{"a":{"b":[5]}}') == "5" and one(spark, jsonops.pick(X, "a"), "no json") is None
    assert one(spark, jsonops.pick(X, "$.a[*].b"), '{"a":[{"b":1},{"b":2}]}') == "[1,2]"
    assert one(spark, jsonops.records(X), '{"data":[],"items":[{"a":1},{"a":2}]}') == ['{"a":1}', '{"a":2}']
    assert one(spark, jsonops.records(X), "[1,2]") == ["1", "2"] and one(spark, jsonops.records(X), '{"a":1}') == ['{"a":1}'] and one(spark, jsonops.records(X), "x") == []
    assert one(spark, jsonops.flat(X), '{"b":"x","a":null}') == "a: null\nb: x"
    assert one(spark, jsonops.display_name(X, F.lit(3)), '{"title":"t"}') == "t" and one(spark, jsonops.display_name(X, F.lit(3)), "{}") == "Entry 3"
    assert one(spark, jsonops.with_source(X, F.lit("u")), "{}") == '{"_source_url":"u"}' and one(spark, jsonops.with_source(X, F.lit("u")), "5") == '{"value":5,"_source_url":"u"}'
    assert one(spark, jsonops.project(X, ["a", "c"]), '{"a":1,"b":2}') == {"a": "1"}
    with pytest.raises(ValueError):
        jsonops.path("a..b")


def test_numbers_with_defaults(spark):
    df = spark.createDataFrame([(None,), ("",), (" 7 ",), ("-3",), ("3.5",), ("x",), ("12345678901",)], "s string")
    got = [tuple(r) for r in df.select(text.safe_int(F.col("s"), 2, 1), text.safe_float(F.col("s"), 0.5)).collect()]
    assert got == [(2, 0.5), (2, 0.5), (7, 7.0), (1, -3.0), (2, 3.5), (2, 0.5), (2, 12345678901.0)]


def test_rebuilt_keeps_nesting_and_leaves_out_what_is_missing(spark):
    df = spark.createDataFrame([('{"a":{"b":1,"c":"x"},"l":[{"n":1},{"n":2}]}',), ("{}",), ("no",), (None,), ('{"a":5}',)], "s string")
    got = [r[0] for r in df.select(jsonops.rebuilt(F.col("s"), ["a.b", "a.d", "l[*].n"])).collect()]
    assert got == ['{"a":{"b":1},"l[*].n":[1,2]}', "{}", None, None, "{}"]


def test_faults_of_files_and_counts_of_xml(spark):
    df = spark.createDataFrame([(None, 1), ("a.csv", 0), ("a.csv", None), ("a.CSV", 3), ("a.exe", 3), ("a", 3)], "n string, size long")
    assert [r[0] for r in df.select(files.fault(F.col("n"), F.col("size"), (".csv",))).collect()] == ["no name", "empty", "empty", None, "unsupported: .exe", "unsupported: "]
    x = spark.createDataFrame([('<a k="1"><b/><b z="2" y="3">t</b></a>',), (None,)], "x string")
    assert [r[0] and tuple(r[0]) for r in x.select(tabular.xml_counts(F.col("x"))).collect()] == [(3, 3), None]


def test_first_places_and_texts_after_the_cut(spark):
    df = spark.createDataFrame([("b", 3), ("a", 2), ("b", 1), (None, 0), (" ", 0)], "k string, i long")
    assert sorted(map(tuple, listing.in_order(df, "k", "i").collect())) == [("a", 2), ("b", 1)]
    assert listing.in_order(df.limit(0), "k", "i").count() == 0
    hits = spark.createDataFrame([(1, 1, "x"), (1, 2, " "), (1, 3, None), (1, 4, "y")], "q long, rank int, text string")
    assert [tuple(r) for r in search.best_texts(hits, "q").collect()] == [(1, 1, "x")]
