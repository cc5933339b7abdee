"""The training-data operators against brute force and over awkward rows."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from siltworks.llm import encoding, history, leakage, mainbody, ordermin, packing, queries, scans, templates

WORD = re.compile(r"[^\W_]+")
RNG = random.Random(11)
VOCAB = [a + b + c for a in "bdfgklmnpr" for b in "aeiou" for c in ("mer", "tas", "lin", "vok", "dun", "sib", "gop", "zel")]


def number(w):
    return int.from_bytes(hashlib.md5(w.encode()).digest()[:7], "big")


def words(t):
    return WORD.findall((t or "").lower())


def alike(a, b):
    x, y = Counter(words(a)), Counter(words(b))
    return min(sum(x.values()), sum(y.values())) >= 20 and 10 * sum((x & y).values()) >= 7 * sum((x | y).values())


def text(n):
    return " ".join(RNG.choices(VOCAB, k=n))


def edited(t, share):
    w = t.split()
    for i in range(len(w)):
        if RNG.random() < share:
            w[i] = RNG.choice(VOCAB)
    return " ".join(w)


def shuffled_sentences(t):
    w = t.split()
    k = len(w) // 3
    return " ".join(w[k:] + w[:k])


def corpus(n=60):
    base = [text(RNG.randint(15, 120)) for _ in range(n)]
    more = [edited(RNG.choice(base), RNG.choice([0.0, 0.05, 0.1, 0.15, 0.25])) for _ in range(n)] + [shuffled_sentences(b) for b in base[:10]]
    return base + more + [base[0]] * 5 + [None, "", "one two", "x " * 5000]


FILES = "file_id string, source_url string"


# ---- 1 -----------------------------------------------------------------------------------------------------------------


def p1_brute(chunks, files, least=5, share=0.1):
    host = defaultdict(set)
    for f, u in files:
        if f and u:
            h = re.sub(r"^www\.", "", re.sub(r"^\w+://", "", u.strip().lower()).split("/")[0])
            host[f].add(h)
    norm = lambda x: " ".join(re.sub(r"\d+", "", x.lower()).split())
    count, size = Counter(), Counter()
    for _, f, t in chunks:
        for h in host.get(f, ()):
            size[h] += 1
            count.update({(h, norm(x)) for x in (t or "").split("\n") if x.strip()})
    return {
        (k, i) for k, f, t in chunks for h in host.get(f, ()) for i, x in enumerate((t or "").split("\n"), 1) if x.strip() and count[h, norm(x)] >= least and count[h, norm(x)] >= share * size[h]
    }


def test_repeated_lines(spark):
    files = [("a", "HTTPS://www.One.example/x"), ("a", "http://one.example"), ("b", "https://two.example"), ("c", None), (None, "http://three.example")]
    chunks = []
    for k in range(60):
        f = ["a", "b", "c", None][k % 4]
        lines = [f"Own line {VOCAB[k]} here", "Share this page", f"Page {k} of 90", "  SHARE  this page ", "", f"By the {VOCAB[k % 3]} team", str(k)]
        RNG.shuffle(lines)
        chunks.append((k, f, None if k == 7 else "" if k == 8 else "\n".join(lines)))
    c = spark.createDataFrame(chunks, "chunk_key long, file_id string, text string").withColumn("line", F.lit(1)).withColumn("source_url", F.lit("no"))
    f = spark.createDataFrame(files, FILES)
    got = {tuple(r) for r in templates.repeated_places(c, f).collect()}
    assert got == p1_brute(chunks, files) and got
    clean = {r.chunk_key: r.clean_text for r in templates.without_repeated(c, f).collect()}
    assert len(clean) == 60 and clean[7] is None and "Share" not in clean[0] and clean[2] == chunks[2][2]
    assert templates.repeated_places(c.limit(0), f).count() == 0


def test_template_slots(spark):
    exact = spark.createDataFrame([(1, 1, f"by the {n} team", 2) for n in ("red", "blue", "green")] + [(1, 1, "by the way out", 1)], "src long, leaf long, line string, n long")
    got = {r.line: (r.template, r.covers) for r in templates._templates(exact).collect()}
    assert got["by the red team"] == ("by the <*> team", 6) and got["by the way out"] == ("by the way out", 1)


def test_bylines_that_differ_in_a_name_are_removed(spark):
    chunks = [(k, "a", "\n".join([f"Words of {VOCAB[k]} and {VOCAB[k + 50]}", f"Written by {VOCAB[k]} for this page", text(12)])) for k in range(30)]
    c = spark.createDataFrame(chunks, "chunk_key long, file_id string, text string")
    f = spark.createDataFrame([("a", "https://one.example")], FILES)
    assert templates.repeated_places(c, f).count() == 0
    clean = {r.chunk_key: r.clean_text.split("\n") for r in templates.without_repeated(c, f).collect()}
    assert all(clean[k] == [t.split("\n")[0], t.split("\n")[2]] for k, _, t in chunks)


# ---- 2 -----------------------------------------------------------------------------------------------------------------


def test_near_pairs(spark):
    texts = corpus()
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, texts[0])]
    df = spark.createDataFrame(rows, "k long, text string").withColumn("id", F.lit("x")).withColumn("n", F.lit(1)).withColumn("a", F.lit(0))
    got = [tuple(r) for r in ordermin.all_pairs(*ordermin.near_pairs(df, "k", "text")).collect()]
    want = {(i, j) for i, a in enumerate(texts) for j, b in enumerate(texts) if i < j and alike(a, b)}
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 40
    g = {r.k: r.group_id for r in ordermin.groups(df, "k", "text").collect()}
    for a, b in want:
        assert g[a] == g[b]
    assert ordermin.all_pairs(*ordermin.near_pairs(df.limit(0), "k", "text")).count() == 0


def test_order_is_part_of_a_sample():
    import numpy as np

    t = RNG.sample(VOCAB, 90)
    h = np.array([number(w) & (2**63 - 1) for w in t], dtype=np.uint64)
    r = h[::-1].copy()
    off = np.array([0, 90])
    same = ordermin.samples(h, off, k=1, ordered=False) == ordermin.samples(r, off, k=1, ordered=False)
    ordered = ordermin.samples(h, off, k=1) == ordermin.samples(r, off, k=1)
    assert same.all() and not ordered.any()


def test_hot_samples_lose_no_pair(spark, monkeypatch):
    base = text(60)
    texts = [edited(base, 0.04) for _ in range(60)] + corpus(20)
    df = spark.createDataFrame(list(enumerate(texts)), "k long, text string")
    found = lambda: sorted(map(tuple, ordermin.all_pairs(*ordermin.near_pairs(df, "k", "text")).collect()))
    whole = found()
    monkeypatch.setattr(ordermin, "HOT", 8)
    assert found() == whole and len(whole) > 1000


def test_what_meets_is_sifted_in_the_join(spark, monkeypatch):
    import os

    base = text(60)
    texts = [base + " " + text(50) for _ in range(60)] + [edited(base, 0.05) for _ in range(10)]
    df = spark.createDataFrame(list(enumerate(texts)), "k long, text string")
    made, keep = {}, ordermin.stored
    met = lambda d, label: made.setdefault(label, []).append(keep(d, label)) or made[label][-1]
    monkeypatch.setattr(ordermin, "stored", met)
    monkeypatch.setattr(ordermin, "small", lambda d, *_: d)
    monkeypatch.setattr(ordermin, "dropped", lambda *_: None)
    pairs, members = ordermin.near_pairs(df, "k", "text")
    want = {(i, j) for i, a in enumerate(texts) for j, b in enumerate(texts) if i < j and alike(a, b)}
    assert {tuple(r) for r in ordermin.all_pairs(pairs, members).collect()} == want and want
    # 60 texts share half of their words: none of their pairs leaves the join
    assert all(t.where("a < 60 and b < 60").isEmpty() for t in made["near-met"])
    monkeypatch.undo()
    left = ordermin.near_pairs(df, "k", "text")
    assert all(os.path.isdir(t._stored_at.removeprefix("file://")) for t in left)


def test_samples_of_one_row_never_meet_a_sketch(spark, monkeypatch):
    rng = random.Random(5)
    own = [rng.choices(VOCAB, k=60) for _ in range(40)]
    texts = [" ".join(w) for w in own] + [" ".join([*w[:30], "other", *w[31:]]) for w in own[:5]]
    df = spark.createDataFrame(list(enumerate(texts)), "k long, text string")
    seen, plans, meet = [], [], ordermin._met
    monkeypatch.setattr(ordermin, "small", lambda d, *_: d)

    def met(rows):
        seen.extend(r.id for r in rows.select("id").distinct().collect())
        out = meet(rows.hint("merge"))
        out.collect()
        plans.append(out._jdf.queryExecution().executedPlan().toString())
        return out

    monkeypatch.setattr(ordermin, "_met", met)
    pairs, members = ordermin.near_pairs(df, "k", "text")
    assert {tuple(r) for r in ordermin.all_pairs(pairs, members).collect()} == {(i, i + 40) for i in range(5)}
    # texts without a like are dropped before sketches are joined to them, and the rows that meet are shuffled once for both sides
    assert set(seen) == {*range(5), *range(40, 45)}
    assert plans and all("ReusedExchange" in p for p in plans)


def test_shared_words_are_counted_with_repetition():
    import numpy as np

    rng = random.Random(5)
    a, b = ([rng.choices(range(30), k=rng.randint(0, 60)) for _ in range(5000)] for _ in range(2))
    flat = lambda ts: (ordermin.W.mix(np.array([x for t in ts for x in t], np.uint64)), np.concatenate([[0], np.cumsum([len(t) for t in ts])]))
    assert ordermin.shared_words(*flat(a), *flat(b)).tolist() == [sum((Counter(x) & Counter(y)).values()) for x, y in zip(a, b, strict=True)]


def test_one_very_long_text():
    import numpy as np

    h = np.arange(300_000, dtype=np.uint64) + np.uint64(9)
    assert ordermin.samples(h, np.array([0, 0, 300_000]), sketches=4).shape == (2, 4)


def test_banded_alignment():
    import numpy as np

    pairs = [(text(60).split(), None) for _ in range(20)]
    pairs = [(a, edited("pre " * RNG.randint(0, 9) + " ".join(a), 0.1).split()) for a, _ in pairs] + [([], ["x"]), (["x"], [])]

    def flat(side):
        v = [np.array([number(w) & (2**63 - 1) for w in s[side]], dtype=np.uint64) for s in pairs]
        return np.concatenate(v), np.concatenate([[0], np.cumsum([len(x) for x in v])])

    def lcs(a, b):
        d = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                d[i + 1][j + 1] = d[i][j] + 1 if x == y else max(d[i][j + 1], d[i + 1][j])
        return d[-1][-1]

    got = ordermin.aligned_words(*flat(0), *flat(1))
    assert [int(x) for x in got] == [lcs(a, b) for a, b in pairs]
    bag = ordermin.shared_words(*flat(0), *flat(1))
    assert [int(x) for x in bag] == [sum((Counter(a) & Counter(b)).values()) for a, b in pairs]


# ---- 3 -----------------------------------------------------------------------------------------------------------------


def test_main_body(spark):
    files, pages = [], []
    for s in range(6):
        files.append((f"f{s}", f"https://site{'abcdef'[s]}-x.example/"))
        for p in range(12):
            title = f"How to keep {VOCAB[RNG.randrange(300)]} out of {VOCAB[RNG.randrange(300)]}"
            body = [title, f"The {text(9)} is found here. It {text(12)}.", f"The {VOCAB[RNG.randrange(300)]}", f"Then {text(20)}. And {text(8)}.", f"- {VOCAB[p]}", f"- {VOCAB[p + 40]}", f"Last {text(15)}. So {text(5)}."]
            teasers = ["You may also like"] + [f"How to keep {VOCAB[RNG.randrange(300)]} out of {VOCAB[RNG.randrange(300)]}" for _ in range(3)]
            page = [f"Home{s} | News{s} | Shop{s} | Help{s}", *body, *teasers, "Site map", f"© 20{p:02d} Site group. All rights kept."]
            pages.append((100 * s + p, f"f{s}", "\n".join(page), len(body)))
    df = spark.createDataFrame([p[:3] for p in pages] + [(9001, "f0", None), (9002, None, "Only a line here."), (9003, "f1", ""), (None, "f1", "x")], "page_id long, file_id string, text string").withColumn("rows", F.lit(1)).withColumn("host", F.lit("h"))
    f = spark.createDataFrame(files, FILES)
    got = defaultdict(set)
    for r in mainbody.body_places(df, f).collect():
        got[r.page_id].add(r.line_no)
    exact = sum(got[k] == set(range(2, 2 + n)) for k, _, _, n in pages)
    assert exact >= 0.95 * len(pages)
    assert got[9002] == {1} and 9001 not in got and 9003 not in got
    assert {r.page_id: r.body for r in mainbody.bodies(df, f).collect()}[9001] is None
    assert mainbody.body_places(df.limit(0), f).count() == 0


def test_announcer_of_a_site_in_a_larger_table(spark):
    # one site's teaser heading stands on five pages, among 2,000 pages whose furniture makes 120,000 counts
    title = lambda: f"How to keep {VOCAB[RNG.randrange(300)]} out of {VOCAB[RNG.randrange(300)]}"
    article = lambda: [title(), f"The {text(9)} is found here. It {text(12)}.", f"Then {text(20)}. And {text(8)}.", f"Last {text(15)}. So {text(5)}."]
    pages = [(p, "f", "\n".join([*article(), "From our barn", title(), title(), title()])) for p in range(5)]
    menu = [f"{a} {b}" for a in VOCAB[:60] for b in ("page",)]
    pages += [(100 + p, f"g{p % 2}", "\n".join([*article()[:2], *menu])) for p in range(2000)]
    df = spark.createDataFrame(pages, "page_id long, file_id string, text string")
    f = spark.createDataFrame([("f", "https://kd-x.example/"), ("g0", "https://qa-x.example/"), ("g1", "https://qb-x.example/")], FILES)
    got = defaultdict(set)
    for r in mainbody.body_places(df, f).where("page_id < 100").collect():
        got[r.page_id].add(r.line_no)
    assert all(not got[p] & {5, 6, 7, 8} and {2, 3, 4} <= got[p] for p in range(5))


def test_copies_of_an_article_are_no_furniture(spark):
    page = lambda: "\n".join([f"The {text(9)} is found here. It {text(12)}.", f"Then {text(20)}. And {text(8)}.", f"Last {text(15)}. So {text(5)}.", "Home and all our news", "Site map and help"])
    copy = page()
    pages = [(p, "f", page()) for p in range(8)] + [(100 + p, "f", copy) for p in range(6)]
    df = spark.createDataFrame(pages, "page_id long, file_id string, text string")
    got = mainbody.body_places(df, spark.createDataFrame([("f", "https://kd-x.example/")], FILES)).where("page_id >= 100").collect()
    assert {(r.page_id, r.line_no) for r in got} == {(100 + p, n) for p in range(6) for n in (1, 2, 3)}


# ---- 4 -----------------------------------------------------------------------------------------------------------------


def p4_brute(old, new):
    taken, out = list(old), set()
    for k, _, t in sorted(new, key=lambda r: (r[1], r[0])):
        if len(words(t)) < 20:
            continue
        if any(alike(t, o) for o in taken):
            out.add(k)
        else:
            taken.append(t)
    return out


def test_batches_against_history(spark):
    old = corpus(40)
    new = [(i, RNG.randint(1, 3), edited(RNG.choice([*old[:40], *map(text, (30, 60))]) or "", RNG.choice([0.0, 0.1, 0.2]))) for i in range(80)]
    new += [(100 + i, 3, t) for i, (_, _, t) in enumerate(new[:10])] + [(200, 1, None), (201, 2, "")]
    hist = spark.createDataFrame(list(enumerate(old)), "id long, text string").withColumn("origin", F.lit(5)).withColumn("n", F.lit(5))
    batch = spark.createDataFrame(new, "k long, batch int, text string").withColumn("id", F.lit("c")).withColumn("x", F.lit(5))
    want = p4_brute(old, new)

    def run(parts):
        h = history.History(spark)
        h.begin(hist, "id")
        out = set()
        for p in parts:
            out |= {r[0] for r in history.refused(h, p, "k", "batch").collect()}
        h.drop()
        return out

    assert run([batch]) == want and want
    assert run([batch.where(f"batch = {b}") for b in (1, 2, 3)]) == want
    assert run([batch.limit(0)]) == set()


def test_batches_beyond_rarest_chunks(spark):
    # the alike record shares only chunks that are commoner than an inserted line of unrelated records
    blocks, menu = [text(30) for _ in range(4)], text(30)
    old = [f"{b} {text(60)}" for b in blocks for _ in range(150)] + [f"{menu} {text(60)}" for _ in range(135)] + [" ".join(blocks)]
    x = " ".join([blocks[2], blocks[0], menu, blocks[3], blocks[1]])
    hist = spark.createDataFrame(list(enumerate(old)), "id long, text string")
    h = history.History(spark)
    h.begin(hist, "id")
    batch = spark.createDataFrame([(1, 1, x), (2, 1, text(100))], "k long, batch int, text string")
    assert alike(x, old[-1]) and {r[0] for r in history.refused(h, batch, "k", "batch").collect()} == {1}
    h.drop()


def test_edited_places_do_not_outweigh_common_chunks(spark):
    # 60 chunks that nobody else holds beside six that a fifth of the records hold: all six are looked up
    mine = spark.createDataFrame([(1, k, 30) for k in range(66)], "id long, chunk long, bytes int")
    holders = spark.createDataFrame([(k, 0, None, 1) for k in range(60)] + [(k, 150, 5, 151) for k in range(60, 66)], "chunk long, held long, first long, n long")
    assert {r.chunk for r in history.looked_up(mine, holders, 736).collect()} == set(range(60, 66))


def test_chunk_lists_go_once_the_postings_are_written(spark):
    rows = spark.createDataFrame(list(enumerate(corpus(10))), "k long, text string")
    h = history.History(spark)
    h.begin(rows, "k")
    assert "chunks" not in h.records().columns and h.postings().count() > h.records().count() > 0
    h.drop()


def test_popular_blocks_beside_rare_pieces(spark):
    # the row is ten popular blocks in another order than its twin and two rare pieces that other records hold
    blocks, rare = [text(12) for _ in range(10)], [text(9), text(9)]
    old = [f"{RNG.choice(blocks)} {RNG.choice(blocks)} {text(60)}" for _ in range(600)] + [f"{p} {text(50)}" for p in rare for _ in range(2)] + [" ".join(blocks)]
    x = " ".join([*rare, *blocks[5:], *blocks[:5]])
    hist = spark.createDataFrame(list(enumerate(old)), "id long, text string")
    h = history.History(spark)
    h.begin(hist, "id")
    batch = spark.createDataFrame([(1, 1, x), (2, 1, text(100))], "k long, batch int, text string")
    assert alike(x, old[-1]) and {r[0] for r in history.refused(h, batch, "k", "batch").collect()} == {1}
    h.drop()


def test_history_reopens_in_another_session(spark, tmp_path):
    old, path = corpus(30), f"file://{tmp_path}/history"
    hist = spark.createDataFrame(list(enumerate(old)), "id long, text string")
    a, b = text(50), text(70)
    h = history.History(spark, path, buckets=4)
    h.begin(hist, "id")
    one = spark.createDataFrame([(1, 1, a), (2, 1, edited(old[0] + " " + old[1], 0.02))], "k long, batch int, text string")
    assert history.refused(h, one, "k", "batch").count() == int(any(alike(r.text, o) for r in one.where("k = 2").collect() for o in old))
    h.drop()
    other = spark.newSession()
    again = history.History(other, path)
    assert again.buckets == 4
    two = other.createDataFrame([(1, 2, edited(a, 0.05)), (2, 2, b), (3, 2, next(o for o in old if len(words(o)) >= 20))], "k long, batch int, text string")
    assert {r[0] for r in history.refused(again, two, "k", "batch").collect()} == {1, 3}
    assert again.records().select("origin").distinct().count() == 3
    again.drop()


def test_covered_words_never_exceed_shared_ones():
    import numpy as np

    pairs = [(text(80), edited(text(80), 0.1)) for _ in range(10)] + [(t, edited(t, 0.1)) for t in (text(90) for _ in range(10))]

    def flat(side):
        v = [np.array([(number(w) << 8) & (2**63 - 1) | 3 for w in words(p[side])], dtype=np.uint64) for p in pairs]
        return np.concatenate(v), np.concatenate([[0], np.cumsum([len(x) for x in v])])

    low, all_ = history.covered_words(*flat(0), *flat(1)), ordermin.shared_words(*flat(0), *flat(1))
    assert (low <= all_).all() and (low[10:] > 20).all()


def test_chunks_survive_edits():
    import numpy as np

    h = np.array([(number(w) << 8) & (2**63 - 1) | 3 for w in text(200).split()], dtype=np.uint64)
    r, a, *_ = history.chunk_hashes(h, np.array([0, 200]))
    _, b, *_ = history.chunk_hashes(np.concatenate([h[:90], h[91:]]), np.array([0, 199]))
    assert len(set(a) - set(b)) <= 3 and len(a) > 20 and set(r) == {0}


# ---- 5 -----------------------------------------------------------------------------------------------------------------


def test_scans(spark):
    body = "the night porter must lock bath trap before dusk and report on grain hopper at once".split()
    rows = []
    for p in range(1, 13):
        lines = [f"FIELD HANDBOOK    {p}"] + [" ".join(RNG.choices(body, k=7)) for _ in range(12)]
        lines[1] += " the"
        rows.append([p, "f", p, lines])
    rows[2][3][2] += " l0ck it"
    rows[3][3][1] = rows[3][3][1][: -len("the")] + "ha-"
    rows[3][3][2] = "mmer " + rows[3][3][2]
    rows[4][3][-1] = rows[4][3][-1] + " gra-"
    rows[5][3][1] = "in " + rows[5][3][1]
    rows[4][3][-1] = rows[4][3][-1].replace("gra-", "gra\xad")
    rows[6][3][3] += " a well-kept hammer and more grain"
    data = [(a, f, p, "\n".join(x)) for a, f, p, x in rows] + [(50, None, None, None), (51, "f2", 1, ""), (52, "f", 6, "\n".join(rows[5][3])), (53, "g", 1, "word " * 30000)]
    df = spark.createDataFrame(data, "scan_id long, file_id string, page_no int, text string").withColumn("id", F.lit(1)).withColumn("line", F.lit(1)).withColumn("word", F.lit("w"))
    s = scans.Scans(df)
    got = {tuple(r) for r in s.found().collect()}
    assert {(i, 1) for i in range(1, 13)} <= {(a, n) for a, n, k, _ in got if k == "furniture"}
    assert (3, 3, "misread", "lock") in got and (4, 2, "split", "hammer") in got and (5, 13, "split", "grain") in got
    assert not [x for x in got if x[2] == "misread" and x[0] != 3]
    flow = [r.text for r in s.paragraphs().where("file = 'f'").collect()]
    assert len(flow) == 1 and "grain" in flow[0] and "gra\xad" not in flow[0] and "HANDBOOK" not in flow[0] and "l0ck" not in flow[0]
    assert scans.Scans(df.limit(0)).found().count() == 0


def test_scans_without_page_and_with_gaps(spark):
    body = "the night porter must lock bath trap before dusk and report on grain hopper at once".split()
    page = lambda *own: "\n".join([*own, *(" ".join(RNG.choices(body, k=7)) for _ in range(9))])
    data = [(1, "f", 1, page() + "\nreport on gra-"), (2, "f", 4, page("in hopper at once")), (3, "f", None, page("alone it stands")), (4, "f", None, page("alone again")), (5, None, None, page("no file at all"))]
    df = spark.createDataFrame(data, "scan_id long, file_id string, page_no int, text string")
    s = scans.Scans(df)
    assert (1, 10, "split", "grain") in {tuple(r) for r in s.found().collect()}
    flow = s.paragraphs().collect()
    assert sorted(len(r.text.split()) for r in flow if r.page is not None) == [sum(len(t.split()) for _, _, p, t in data if p) - 1]
    assert sorted(r.text.split()[1] for r in flow if r.page is None) == ["again", "file", "it"]


def test_exchanges_are_learned(spark):
    vocab = [a + b + c + d for a in "bdgkp" for b in "aou" for c in ("mes", "tev", "den", "zeg") for d in ("or", "an")]
    counts = [(w, 40) for w in vocab] + [(w.replace("e", "c"), 1) for w in vocab[::3]] + [(w.replace("m", "rn"), 2) for w in vocab if "m" in w] + [("bozegax", 1)]
    got = {(r.a, r.b) for r in scans.exchanges(spark.createDataFrame(counts, "w string, n long")).collect()}
    assert got == {("c", "e"), ("rn", "m")}
    assert scans.exchanges(spark.createDataFrame([], "w string, n long")).count() == 0


def test_paragraph_over_a_block_of_pages(spark):
    data = [(p, "f", p, text(30)) for p in range(scans.BLOCK - 2, scans.BLOCK + 3)]
    df = spark.createDataFrame(data, "scan_id long, file_id string, page_no int, text string")
    got = scans.Scans(df).paragraphs().collect()
    assert [(r.page, r.piece) for r in got] == [(scans.BLOCK - 2, 0)] and len(got[0].text.split()) == 150


# ---- 6 -----------------------------------------------------------------------------------------------------------------


def test_best_two_fit():
    for _ in range(20):
        cap = RNG.randint(50, 300)
        items = [(RNG.randint(1, cap), i) for i in range(RNG.randint(0, 400))]
        home = packing.pack(items, cap)
        load = Counter()
        for size, i in items:
            load[home[i]] += size
        assert all(v <= cap for v in load.values()) and len(home) == len(items)
        assert len(load) <= -(-sum(s for s, _ in items) // cap) * 1.25 + 1
    # greedy alone leaves 1; the two that fit the gap of the smallest fill it
    assert len(set(packing.pack([(6, 0), (3, 1), (2, 2), (2, 3), (7, 4)], 10))) == 2


def test_containers(spark):
    docs = [(i, text(RNG.randint(1, 200))) for i in range(300)] + [(900, None), (901, ""), (902, text(9000)), (None, "x"), (5, "again")]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("kind", F.lit(1)).withColumn("size", F.lit(1))
    caps = spark.createDataFrame([("s", 256), ("l", 1024), (None, 5), ("z", 0)], "container_type string, capacity_tokens int")
    out = packing.containers(df, caps, group=50).collect()
    load, parts = Counter(), defaultdict(list)
    for r in out:
        load[r.container_type, r.container] += r.tokens
        parts[r.container_type, r.doc_id].append(r)
    assert max(v for (t, _), v in load.items() if t == "s") <= 256 and max(v for (t, _), v in load.items() if t == "l") <= 1024
    assert {d for t, d in parts if t == "s"} == {d for d, _ in docs if d is not None} == {d for t, d in parts if t == "l"}
    for (t, d), rs in parts.items():
        if d != 5:
            assert len(rs) == max(1, -(-sum(r.tokens for r in rs) // (256 if t == "s" else 1024)))
    assert packing.containers(df.limit(0), caps).count() == 0


# ---- 7 -----------------------------------------------------------------------------------------------------------------


def test_leaks(spark):
    items = [(i, text(n)) for i, n in enumerate([5, 8, 11, 12, 13, 40, 60])] + [(90, None), (91, "!!"), (None, text(30)), (5, text(20))]
    docs = [(i, text(80)) for i in range(20)]
    for k in range(20, 60):
        _, t = RNG.choice([x for x in items[:7]])
        w = t.split()
        n = RNG.choice([11, 12, 20, len(w)])
        a = RNG.randint(0, max(0, len(w) - n))
        docs.append((k, f"{text(9)}, {', '.join(w[a : a + n]).upper()} {text(RNG.choice([0, 3000]))}"))
    docs += [(70, None), (71, ""), (None, items[5][1]), (20, docs[20][1])]
    grams = defaultdict(set)
    for i, t in items:
        w = words(t)
        n = min(12, len(w))
        if n and i is not None:
            for a in range(len(w) - n + 1):
                grams[n, tuple(w[a : a + n])].add(i)
    want = set()
    for d, t in docs:
        w = words(t)
        for n in range(1, 13):
            for a in range(len(w) - n + 1):
                want |= {(d, i) for i in grams.get((n, tuple(w[a : a + n])), ()) if d is not None}
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit(1)).withColumn("key", F.lit(1))
    it = spark.createDataFrame(items, "item_id long, text string").withColumn("id", F.lit(1)).withColumn("suite", F.lit("s"))
    got = [tuple(r) for r in leakage.leaks(df, it).collect()]
    assert set(got) == want and len(got) == len(want) > 15
    assert leakage.leaks(df.limit(0), it).count() == 0 and leakage.leaks(df, it.limit(0)).count() == 0


# ---- 8 -----------------------------------------------------------------------------------------------------------------

CLEAN = ["Le café près de la forêt a été fermé à l’été.", "Смешайте воду и проверяйте ловушки каждое утро.", "Die Gärtnerin schützt die Kühlräume – täglich.", "The crew’s “Wexnoshield” holds — at 20 °C."]


def garble(t, kind):
    if kind == "latin":
        return t.encode("utf-8").decode("latin-1")
    if kind == "twice":
        s = lambda x: "".join(bytes([b]).decode("cp1252", "ignore") or chr(b) for b in x.encode("utf-8"))
        return s(s(t))
    if kind == "mac":
        return t.encode("utf-8").decode("mac_roman")
    if kind == "koi":
        return t.encode("koi8_r").decode("cp1251")
    return t.encode("cp1251").decode("cp1252")


def test_encoding(spark):
    docs, want, k = [], {}, 0
    for t in CLEAN:
        for _ in range(60):
            docs.append((k, t))
            k += 1
    cases = [(t, kind) for t in CLEAN for kind in ("latin", "twice", "mac")] + [(CLEAN[1], "koi"), (CLEAN[1], "1251")]
    for t, kind in cases:
        docs.append((k, garble(t, kind)))
        want[k] = t
        k += 1
    docs.append((k, CLEAN[0] + " " + garble(CLEAN[0], "latin")))
    want[k] = CLEAN[0] + " " + CLEAN[0]
    docs += [(k + 1, "caf� froid"), (k + 2, None), (k + 3, ""), (None, "cafÃ©"), (k + 4, "plain " * 20000)]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("id", F.lit(1)).withColumn("t", F.lit(1)).withColumn("piece", F.lit(1))
    got = {r.doc_id: (r.restored, r.lost) for r in encoding.repair(df).collect()}
    assert got.pop(k + 1) == ("café froid", True)
    assert got == {i: (t, False) for i, t in want.items()}
    assert encoding.repair(df.limit(0)).count() == 0


def test_lost_bytes(spark):
    clean = ["Die Gärtnerin schützt die Kühlräume täglich.", "El Índice está aquí.", "Смешайте воду и проверяйте ловушки каждое утро."]
    docs = [(i, clean[i % 3]) for i in range(90)]
    t = clean[0]
    utf = lambda s: "".join(c if ord(c) < 128 else encoding.LOST * len(c.encode()) for c in s)
    damaged = {
        900: (t.replace("ü", encoding.LOST), t),  # one mark a letter
        901: (utf(t), t),  # one mark a byte of UTF-8
        902: ("".join(bytes([b]).decode("cp1252", "replace") for b in "El Índice".encode()), "El Índice"),  # garbled and lost in one word
        903: (clean[2].replace("проверяйте", "прове" + encoding.LOST + "яйте"), clean[2]),
        904: ("Xq" + encoding.LOST + "zv " + encoding.LOST, "Xq" + encoding.LOST + "zv " + encoding.LOST),
        905: (encoding.LOST * 3000, encoding.LOST * 3000),
    }
    df = spark.createDataFrame(docs + [(k, a) for k, (a, _) in damaged.items()], "doc_id long, text string")
    got = {r.doc_id: (r.restored, r.lost) for r in encoding.repair(df).collect()}
    assert got == {k: (b, True) for k, (_, b) in damaged.items()}


def test_lost_bytes_of_words_with_one_known_letter(spark):
    docs = [(i, "Le dû est là, ïbë.") for i in range(40)]
    damaged = {900: ("d� pour", "dû pour"), 901: ("�à", "�à"), 902: ("l�", "là"), 903: ("�b�", "ïbë"), 904: ("a � b", "a � b")}
    df = spark.createDataFrame(docs + [(k, a) for k, (a, _) in damaged.items()], "doc_id long, text string")
    got = {r.doc_id: r.restored for r in encoding.repair(df).collect()}
    assert got == {k: b for k, (_, b) in damaged.items()}


# ---- all ---------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query_runs(spark, data, name):
    df = queries.queries()[name](spark, data)
    assert df.count() > 0 and df.columns


def test_restored_digest(spark, data):
    rows = queries.queries()["p8_found"](spark, data).collect()
    assert all(r.restored_md5 == "" or len(r.restored_md5) == len(hashlib.md5(b"").hexdigest()) for r in rows)
