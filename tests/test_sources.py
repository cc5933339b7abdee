import io
import json
import zipfile

from pyspark.sql import functions as F

from siltworks.sources import files, jsonfiles, tabular, web


def zipped(members):
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        for n, c in members.items():
            z.writestr(n, c)
    return b.getvalue()


def test_files_and_archives(spark, tmp_path):
    inner = zipped({"deep.txt": "deep"})
    (tmp_path / "a.zip").write_bytes(zipped({"x/one.txt": "one", "__MACOSX/one.txt": "no", ".env": "no", "p.png": b"no", "n.zip": inner, "../up.md": "up"}))
    (tmp_path / "bad.zip").write_bytes(b"not a zip")
    (tmp_path / "t.md").write_text("# hi")
    (tmp_path / "skip.exe").write_bytes(b"x")
    f = files.files(spark, str(tmp_path))
    assert {(r.filename, r.route) for r in f.collect()} == {("a.zip", "archive"), ("bad.zip", "archive"), ("t.md", "text")}
    m = files.members(f.where("route = 'archive'"))
    got = {(r.member, bytes(r.content).decode() if r.content else None, r.depth) for r in m.where("error is null").collect()}
    assert got == {("x/one.txt", "one", 0), ("deep.txt", "deep", 1), ("up.md", "up", 0)}
    assert m.where("error is not null").count() == 1 and m.select("file_id").distinct().count() >= 3
    tot = {r.path.rsplit("/", 1)[1]: (r.members, r.errors) for r in files.archive_totals(m).collect()}
    assert tot == {"a.zip": (3, 0), "bad.zip": (0, 1)}
    t = tabular.read_texts(f.where("route = 'text'")).first()
    assert t.text == "# hi"


def test_csv(spark, tmp_path):
    (tmp_path / "s.csv").write_text('a;b;c\n1; ;x\n2;"two\nlines";\n3\n')
    df = tabular.read_csv(spark, str(tmp_path / "s.csv"))
    assert df.columns == ["a", "b", "c"] and df.count() == 3
    out = tabular.rows_as_chunks(df.withColumn("n", F.monotonically_increasing_id() + 1), ["a", "b", "c"], "n", "s.csv").orderBy("chunk_index").collect()
    assert [r.text for r in out] == ["Row 1: a: 1 | c: x", "Row 2: a: 2 | b: two\nlines", "Row 3: a: 3"]
    assert tabular.sniffed("a\tb\n1\t2\n") == "\t" and tabular.sniffed("word") == ","


W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def test_office_files(spark):
    sheet = '<worksheet><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1" t="inlineStr"><is><t>Size</t></is></c></row><row><c r="A2" t="s"><v>1</v></c><c r="C2"><v>5</v></c></row><row><c r="A3"><v>N/A</v></c><c r="C3"><v>7</v></c></row></sheetData></worksheet>'
    xlsx = zipped({"xl/workbook.xml": '<workbook><sheets><sheet name="S1"/></sheets></workbook>', "xl/sharedStrings.xml": "<sst><si><t>Name</t></si><si><r><t>Pu</t></r><r><t>mp</t></r></si></sst>", "xl/worksheets/sheet1.xml": sheet})
    body = f'<w:document {W}><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Top</w:t></w:r></w:p><w:p><w:r><w:t>Text</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr><w:tr><w:tc><w:p><w:r><w:t>c</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>'
    df = spark.createDataFrame([("x.xlsx", ".xlsx", xlsx), ("bad.xlsx", ".xlsx", b"?")], "path string, suffix string, content binary")
    rows = tabular.read_sheets(df).collect()
    assert [(r.sheet, r.row_number, r.cells) for r in rows if not r.error] == [("S1", 1, {"Name": "Pump", "Size": "5"})] and sum(r.error is not None for r in rows) == 1
    assert tabular.sheet_text(tabular.read_sheets(df)).first().text == "Sheet: S1 | Row 1: Name: Pump | Size: 5"
    docs = spark.createDataFrame([("d.docx", ".docx", zipped({"word/document.xml": body})), ("e.xml", ".xml", b'<r xmlns="u"><a k="1">x</a>tail</r>'), ("bad.docx", ".docx", b"?"), ("l.txt", ".txt", "é".encode("latin-1")), ("n.txt", ".txt", None)], "path string, suffix string, content binary")
    got = {r.path: (r.text, r.error) for r in tabular.read_texts(docs).collect()}
    assert got["d.docx"][0] == "# Top\n\nText\n\n| a | b |\n| --- | --- |\n| c |  |"
    assert got["e.xml"][0] == "[r]\n  [a k=1] x\n  tail" and got["bad.docx"][1] and got["l.txt"][0] == "é" and got["n.txt"] == (None, None)


def test_crawl(spark):
    page = lambda *l: "".join(f'<a href="{x}">t</a>' for x in l)
    pages = spark.createDataFrame([("http://s.x/", page("/a", "b", "http://o.y/z", "/f.pdf")), ("http://s.x/a", page("/", "/c#q")), ("http://s.x/b", page("//s.x/d")), ("http://s.x/c", page("e")), ("http://s.x/d", ""), ("http://s.x/e", "")], "url string, html string")
    got = {r.url: r.depth for r in web.crawl(spark, ["HTTP://s.x"], web.from_table(pages), "s.x", depth=2).collect()}
    assert got == {"http://s.x/": 0, "http://s.x/a": 1, "http://s.x/b": 1, "http://s.x/c": 2, "http://s.x/d": 2}
    assert web.crawl(spark, ["http://s.x"], web.from_table(pages), "s.x", most=2).count() == 2
    assert web.crawl(spark, ["http://s.x"], web.from_table(pages), "s.x", exclude=["/a"]).where("url like '%/a'").count() == 0


def test_json_and_html_files(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": 1, "name": "x"}\n\n{"id": \n[2]\n')
    got = jsonfiles.read_lines(spark, str(tmp_path / "a.jsonl")).collect()
    assert [(r.record, r.error) for r in got] == [('{"id": 1, "name": "x"}', None), (None, "no JSON"), ("[2]", None)]
    (tmp_path / "b.json").write_text('{"status": "ok", "items": [{"title": "T"}, {"id": 5}, {}]}')
    (tmp_path / "c.json").write_text("{")
    (tmp_path / "d.json").write_text("")
    got = {(r.path.rsplit("/", 1)[1], r.entry): (r.name, r.error) for r in jsonfiles.read_json(spark, str(tmp_path / "*.json")).collect()}
    assert got == {("b.json", 1): ("T", None), ("b.json", 2): ("5", None), ("b.json", 3): ("Entry 3", None), ("c.json", None): (None, "no JSON")}
    (tmp_path / "p.html").write_text('<html><title>A</title><h2>B</h2><a href="/c">d</a></html>')
    (tmp_path / "q.html").write_text("")
    got = {r.path.rsplit("/", 1)[1]: (r.title, len(r.headings), len(r.links)) for r in jsonfiles.read_html(spark, str(tmp_path / "*.html")).collect()}
    assert got["p.html"] == ("A", 1, 1) and got.get("q.html", ("", 0, 0)) == ("", 0, 0)


def test_union_keeps_failures_apart(spark, tmp_path):
    (tmp_path / "a.csv").write_text("k,v\n1,x\n")
    (tmp_path / "b.csv").write_text("k;w\n2;y\n")
    u = files.union({"csv": lambda: tabular.read_csv(spark, str(tmp_path)), "gone": lambda: tabular.read_csv(spark, str(tmp_path / "no"))}, spark)
    got = {(r.source, r.k, r.v, r.w, r.error is None) for r in u.collect()}
    assert got == {("csv", "1", "x", None, True), ("csv", "2", None, "y", True), ("gone", None, None, None, False)}
    assert files.union({}, spark).count() == 0


def test_sitemap_and_paging():
    assert web.following(1, 2, 2, {"total_pages": "3"}) == 2 and web.following(9, 2, 2, {"page": 1, "total_pages": 3}) == 2
    assert web.following(0, 2, 2, {"offset": 2, "total_items": 5}) == 4 and web.following(0, 2, 1, {"offset": 4, "total_items": 5}) is None
    assert web.sitemap('<urlset xmlns="n"><url><loc> u1 </loc></url><url><loc>u1</loc></url></urlset>') == ([], ["u1"])
    assert web.sitemap("<sitemapindex><sitemap><loc>m</loc></sitemap></sitemapindex>") == (["m"], []) and web.sitemap("<") == ([], [])
    assert web.following(1, 20, 20, {}) == 2 and web.following(1, 20, 3, {}) is None and web.following(1, 20, 20, {"has_next": False}) is None
    assert web.following(4, 2, 2, {"next_page": 4}) is None and web.following(1, 2, 2, {"pagination": {"total_pages": 1}}) is None


def test_paged_api(spark, tmp_path):
    for p in (1, 2):
        (tmp_path / f"p{p}.json").write_text(json.dumps({"items": [{"id": p}], "total_pages": 2}))
    spark.dataSource.register(web.PagedApi)
    got = spark.read.format("paged_api").option("url", f"file://{tmp_path}/p{{page}}.json").load().collect()
    assert [r.page for r in got] == [1, 2]
