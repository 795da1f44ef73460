"""Files as tables, and streams against their batch forms."""

import json
import os
import time
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from folioflow.operators import enrich
from folioflow.sources import library as L
from folioflow.streaming import streams as S


def put(folder, files):
    folder.mkdir(parents=True, exist_ok=True)
    for name, content in files.items():
        (folder / name).write_text(content if isinstance(content, str) else json.dumps(content))
    return str(folder)


def test_scan_library(spark, tmp_path):
    path = put(tmp_path / "lib", {
        "a.metadata": {"visibleName": "A", "type": "DocumentType", "parent": "", "createdTime": "1700", "lastOpenedPage": 3, "deleted": False},
        "b.metadata": {"visibleName": None, "type": "CollectionType", "parent": None, "createdTime": 5, "lastOpenedPage": " 7 "},
        "c.metadata": {"type": 4, "parent": "trash", "createdTime": "x", "lastOpenedPage": {}},
        "d.metadata": "{ not json",
        "e.content": "{}",
    })
    got = {r.uuid: tuple(r)[1:] for r in L.scan_library(spark, path).collect()}
    assert got == {"a": ("A", "document", "", False, 1700, 3), "b": ("", "folder", "", False, 5, 7), "c": ("", "other", "trash", False, 0, None)}
    assert [r.uuid for r in L.scan_library_since(spark, path, 5).collect()] == ["a", "b"]


def test_page_tables(spark, tmp_path):
    pages = [("p1", "bb", 0, 5), ("p2", "aa", 0, None), ("p3", "ab", 1, 9), ("", "ac", 0, 6)]
    path = put(tmp_path / "c", {
        "one.content": {"pages": ["x", "y", "z"], "redirectionPageMap": [1, -1, 0]},
        "two.content": {"cPages": {"pages": [{"id": i, "idx": {"value": x}, "deleted": {"value": d}, **({"redir": {"value": r}} if r is not None else {})} for i, x, d, r in pages]}},
        "bad.content": "[",
    })
    table = L.scan_page_table(spark, path).cache()
    ids = {(r.book, r.page_id): r.ordinal for r in L.page_id_lookup(table).collect()}
    assert ids == {("one", "x"): 0, ("one", "y"): 1, ("one", "z"): 2, ("two", "p2"): 0, ("two", "p1"): 1}
    ask = spark.createDataFrame([("one", 0), ("one", 1), ("one", 9), ("two", 1), ("two", 2), ("none", 4)], "book string, page int")
    assert {(r.book, r.page): r.pdf_page for r in L.pdf_of(ask, table).collect()} == {("one", 0): 1, ("one", 1): 1, ("one", 9): 9, ("two", 1): 6, ("two", 2): 5, ("none", 4): 4}
    assert {r.book: r.pages for r in L.pdf_total(table).collect()} == {"one": 2, "two": 7}
    back = L.doc_of(spark.createDataFrame([("one", 0), ("two", 5), ("two", 1)], "book string, pdf_page int"), table)
    assert {(r.book, r.pdf_page): r.page for r in back.collect()} == {("one", 0): 2, ("two", 5): 2, ("two", 1): 1}


def test_logs_and_lists(spark, tmp_path):
    log = "\n".join([json.dumps({"device": "d", "at": i, "files": {"f": "h"}}) for i in range(30)] + ["{ broken", ""])
    got = L.read_deploy_log(spark, put(tmp_path / "l", {"log.json": log})).collect()
    assert sorted(r.at for r in got) == [*range(10, 30)] and got[0].label == "" and got[0].dirty is False and got[0].files == {"f": "h"}
    text = f"# comment\n{'AB' * 32}  my unit \n{'cd' * 32}\nshort x\n"
    assert {tuple(r) for r in L.read_allowlist(spark, put(tmp_path / "a", {"list.txt": text})).collect()} == {("ab" * 32, "my unit"), ("cd" * 32, "")}


def full_entry(i, **more):
    """An entry with a value in each of its fields."""
    return {
        "id": f"e{i}", "page": "p", "page_index": i, "chapter": 2, "chapter_title": "Two", "subhead": "Sub", "quote": {"id": "q", "text": "said", "color": "#fff", "rects": [[1.0, 2.5, 3.0, 4.0]]},
        "ink": {"strokes": ["1:2", "1:3"], "bbox": [0.0, 1.0, 2.0, 3.5], "hash": "h", "crop": "c.png"}, "drafts": [{"text": "d1", "backend": "m", "at": 5, "hash": "h"}, {"text": "d0", "backend": "m", "at": 4, "hash": "g"}],
        "text": "é \"x\"\n", "style": "bullet", "ask_ai": True, "question": "why", "answer": {"text": "so", "backend": "m", "at": 6, "brief": "why"}, "status": "reviewed", "destination": "notebook", "source": "koreader_vocab",
        "review": {"due": 9, "interval_days": 3, "streak": 1, "last": 8}, "created": 1, "updated": 2,
    } | more


def test_books_and_quarantine(spark, tmp_path):
    import json

    least = {"id": "m", "page": "p", "page_index": 0, "created": 1, "updated": 1}
    book = lambda u, *entries, **more: {"uuid": u, "title": u, "entries": [*entries]} | more
    docs = {
        "a": book("a", full_entry(0), least, author="Me", chapters=["One", "Two"], page_mtimes={"p": 7}),
        "b": book("b", full_entry(1)),
        "empty": book("empty"),
        "word": book("word", full_entry(2), full_entry(3, status="new word")),
        "lacks": book("lacks", {k: v for k, v in least.items() if k != "created"}),
        "half": book("half", full_entry(4, ink={"strokes": [], "bbox": [0, 0, 0, 0]})),
        "kind": book("kind", full_entry(5, page_index="five")),
    }
    path = put(tmp_path / "books", {f"{u}.json": json.dumps(d, indent=1) for u, d in docs.items()} | {"bad.json": '{"uuid": "bad", "entries": ['})
    entries, quarantine = L.read_entries(spark, path)
    assert {r.book for r in quarantine.collect()} == {"word", "lacks", "half", "kind", "bad"}
    got = {(r.book, r.seq): r.asDict(True) for r in entries.collect()}
    assert set(got) == {("a", 0), ("a", 1), ("b", 0)}
    assert {k: v for k, v in got["a", 0].items() if k not in ("book", "seq")} == full_entry(0)
    plain = {"chapter_title": "", "style": "body", "ask_ai": False, "status": "mined", "destination": "both", "source": "xochitl", "drafts": [], "quote": None, "ink": None, "review": None, "text": None}
    assert plain.items() <= got["a", 1].items()
    books = L.read_books(spark, path)
    assert {r.book: (r.author, r.chapters, r.page_mtimes) for r in books.collect()} == {"a": ("Me", ["One", "Two"], {"p": 7}), "b": ("", [], {}), "empty": ("", [], {})}
    new = entries.withColumn("text", F.when(F.col("book") == "b", "new").otherwise(F.col("text"))).union(entries.limit(1).withColumn("book", F.lit("bad")))
    assert [r.book for r in L.changed_books(new, entries, quarantine).collect()] == ["b"]
    stamp = (tmp_path / "books" / "a.json").stat().st_mtime_ns
    L.write_entries(new, entries, quarantine, books, path)
    assert json.loads((tmp_path / "books" / "b.json").read_text()) == book("b", full_entry(1, text="new"), author="", chapters=[], page_mtimes={})
    assert (tmp_path / "books" / "a.json").stat().st_mtime_ns == stamp and (tmp_path / "books" / "bad.json").read_text().endswith("[")
    got["b", 0]["text"] = "new"
    # written and read again, each field is what it was; the last entry of a book goes and its document stays
    out = str(tmp_path / "out")
    L.write_entries(entries, entries.limit(0), quarantine, books, out)
    again = L.read_entries(spark, out)[0]
    assert {(r.book, r.seq): r.asDict(True) for r in again.collect()} == got
    L.write_entries(again.where("book = 'a'"), again, quarantine, books, out)
    assert json.loads((tmp_path / "out" / "b.json").read_text())["entries"] == []
    assert sorted(p.name for p in (tmp_path / "out").iterdir() if not p.name.startswith(".")) == ["a.json", "b.json"]


def test_vault(spark, tmp_path):
    piece = "book string, title string, chapter long, file string, page_index long, id long, piece string"
    rows = [("b", "B/1", 0, "第1章 x", -1, -1, "---\n"), ("b", "B/1", 0, "第1章 x", 2, 1, "two\nlines\n"), ("b", "B/1", 0, "第1章 x", 1, 7, "one\n"), ("b", "B/1", 1, "第2章 y", -1, -1, "head")]
    prints = spark.createDataFrame([("b", 0, "f0"), ("b", 1, "f1")], "book string, chapter long, fingerprint string")
    none, vault = spark.createDataFrame([], "book string, chapter long, recorded string"), str(tmp_path / "vault")
    got = L.sink_vault(spark.createDataFrame(rows, piece).repartition(3), prints, none, vault)
    files = lambda: {str(p.relative_to(vault)): p.read_text() for p in (tmp_path / "vault").rglob("*.md")}
    assert files() == {"B_1/第1章 x.md": "---\n\none\n\ntwo\nlines\n\n", "B_1/第2章 y.md": "head\n"} and not [*(tmp_path / "vault").glob("_*")]
    (tmp_path / "vault" / "B_1" / "第1章 x.md").write_text("kept, as its chapter didn't change")
    changed = spark.createDataFrame([("b", 0, "f0"), ("b", 1, "f2")], prints.schema)
    again = L.sink_vault(spark.createDataFrame([*rows[:3], (*rows[3][:6], "new head")], piece), changed, got, vault)
    assert files() == {"B_1/第1章 x.md": "kept, as its chapter didn't change", "B_1/第2章 y.md": "new head\n"}
    assert {tuple(r) for r in again.collect()} == {("b", 0, "f0"), ("b", 1, "f2")}


def test_opf(spark):
    opf = """<?xml version="1.0"?><package xmlns="http://www.idpf.org/2007/opf"><!-- <item id="no" href="no"/> --><metadata xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:title> </dc:title><dc:title>Book</dc:title><dc:creator>Me</dc:creator></metadata>
    <manifest><item id="a" href="a.html"/><item id="b" href="b.html"/></manifest><spine page-progression-direction=" RTL "><itemref idref="b"/><itemref idref="a"/></spine></package>"""
    r = L.extract_opf(spark.createDataFrame([("u", opf)], "uuid string, text string")).first()
    assert (r.title, r.creator, r.rtl, r.spine) == ("Book", "Me", True, ["b", "a"]) and [(x["id"], x["href"]) for x in r.manifest] == [("a", "a.html"), ("b", "b.html")]


def test_enrich(spark):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(["a", "", "bc"])], "id long, text string").coalesce(1)
    got = {r.id: (r.result, r.ok, r.prompt_tokens) for r in enrich.enrich_rows(rows, "id", "text").collect()}
    assert got == {0: ("A", True, 1), 1: (None, False, 0), 2: ("BC", True, 2)}
    bad = spark.createDataFrame([(i, "") for i in range(9)], "id long, text string").coalesce(1)
    assert enrich.enrich_rows(bad, "id", "text").count() == 3
    nulls = spark.createDataFrame([(i, None) for i in range(5)] + [(9, "a")], "id long, text string").coalesce(1)
    assert [(r.id, r.ok) for r in enrich.enrich_rows(nulls, "id", "text").collect()] == [(9, True)]


T0 = datetime(2024, 1, 1)


def stream(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).parquet(path)


def drain(frame, name, tmp_path, mode="append"):
    frame.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start().awaitTermination()
    return frame.sparkSession.table(name).collect()


def at(s):
    return T0 + timedelta(seconds=s)


def test_debounce_stream_equals_batch(spark, tmp_path):
    schema = "user_id long, at timestamp, event_type string"
    rows = [(1, at(0), "a"), (1, at(2), "b"), (1, at(3), "a"), (1, at(20), "c"), (2, at(1), "a"), (9, at(500), "end")]
    got = drain(S.debounce(stream(spark, str(tmp_path / "in"), rows, schema)), "debounced", tmp_path)
    batch = S.bursts(spark.createDataFrame(rows, schema), "4 seconds").where("user_id <> 9").collect()
    assert {(r.user_id, r.first_at, r.changes, r.names) for r in got} == {(r.user_id, r.window.start, r.changes, r.names) for r in batch} and len(got) == 3


def test_tags(spark, tmp_path):
    schema = "event_id long, event_type string"
    a, b = (stream(spark, str(tmp_path / x), [(i, t)], schema) for i, x, t in ((1, "t1", "click"), (2, "t2", "odd")))
    assert {(r.event_id, r.svc) for r in drain(S.tag_stream(a, b), "tagged", tmp_path)} == {(1, "ink"), (2, "other")}


def test_await_render(spark, tmp_path):
    d = stream(spark, str(tmp_path / "d"), [("a", at(0)), ("b", at(0)), ("z", at(90_000))], "uuid string, delivered_at timestamp")
    r = stream(spark, str(tmp_path / "r"), [("a", at(100)), ("b", at(700)), ("z", at(90_001))], "uuid string, rendered_at timestamp")
    got = {(x.uuid, x.render) for x in drain(S.await_render(d, r), "renders", tmp_path)}
    assert got == {("a", "ok"), ("b", "timeout"), ("z", "ok")}


def test_gate(spark, tmp_path):
    checks = stream(spark, str(tmp_path / "g"), [("u", at(3600 * h), h % 2) for h in range(0, 50)], "user string, at timestamp, due int")
    assert [r.fired_at for r in drain(S.auto_review_gate(checks), "fired", tmp_path)] == [at(3600 * h) for h in (1, 21, 41)]


def test_snapshot_expiry(spark):
    p = spark.createDataFrame([("a", 10_000_000_000), ("b", 10_000_000_000), ("a", 1)], "uuid string, at_ms long")
    got = S.snapshot_expiry(p, spark.createDataFrame([("a",)], "uuid string"), 10_000_000_001).collect()
    assert [tuple(r) for r in got] == [("a", 10_000_000_000)]
    assert S.late_rows(spark.createDataFrame([(at(0),), (at(9),)], "at timestamp"), "at", at(5)).count() == 1


def test_names_claims_and_choices(spark):
    from folioflow.operators import catalog as C

    asked = spark.createDataFrame([("f", "A", 1), ("f", "A", 2), ("f", "B", 3), ("g", "A", 4), ("f", "C", 5), ("f", "C", 6)], "folder string, name string, seq int")
    taken = spark.createDataFrame([("f", "A"), ("f", "A 2"), ("f", "A 4"), ("f", "C 2")], "folder string, name string")
    assert {r.seq: r.given for r in C.unique_names(asked, taken).collect()} == {1: "A 3", 2: "A 5", 3: "B", 4: "A", 5: "C", 6: "C 3"}
    docs = "uuid string, created_ms long, name string, size long, hash string"
    ups = spark.createDataFrame([("u", 5000, "n", 3, "h"), ("v", 5000, "m", 4, "i"), ("w", 5000, "k", 9, "z")], "upload string, at_ms long, name string, size long, hash string")
    after = spark.createDataFrame([("old", 4000, "n", 3, "h"), ("new", 4500, "n", 3, "h"), ("late", 100, "m", 4, "i"), ("a", 6000, "q", 9, "z"), ("b", 6000, "q", 9, "z")], docs)
    before = after.where("uuid = 'old'")
    assert {r.upload: r.uuid for r in C.claim_new_docs(ups, before, after).collect()} == {"u": "new", "v": None, "w": None}
    files = spark.createDataFrame([("b", "x/Nav.xhtml", 2, None, "t.ncx"), ("b", "mynav.xhtml", 1, None, "t.ncx"), ("b", "o.ncx", 0, None, "t.ncx"), ("c", "n1nav.xhtml", 0, "d.xhtml", None), ("c", "d.xhtml", 1, "d.xhtml", None)], "book string, path string, pos int, declared_nav string, declared_ncx string")
    assert {r.book: (r.nav, r.ncx) for r in C.toc_source_choice(files).collect()} == {"b": ("x/Nav.xhtml", "o.ncx"), "c": ("d.xhtml", None)}
    items = spark.createDataFrame([("b", 0, "p.png", True, False, True), ("b", 1, "d.png", True, True, False), ("c", 0, "x.html", False, False, False)], "book string, pos int, path string, is_image boolean, declared boolean, cover_property boolean")
    images = spark.createDataFrame([("c", 0, True, 0, "nav.png"), ("c", 1, False, 0, None), ("c", 2, False, 1, "second.png"), ("c", 2, False, 0, "first.png")], "book string, spine_pos int, is_nav boolean, pos int, path string")
    assert {r.book: r.cover for r in C.cover_choice(items, images).collect()} == {"b": "d.png", "c": "first.png"}


def test_scan_and_claims(spark, tmp_path):
    from folioflow.operators import catalog as C

    box = "page long, stroke_no long, tool string, n_points long, x0 double, y0 double, x1 double, y1 double"
    strokes = spark.createDataFrame([(1, 1, "ballpoint", 3, 0.0, 0.0, 9.0, 9.0), (1, 2, "ballpoint", 3, 12.0, 0.0, 20.0, 9.0), (2, 3, "ballpoint", 3, 0.0, 0.0, 9.0, 9.0)], box)
    marks = spark.createDataFrame([(1, 7, 0.0, 20.0, 9.0, 30.0), (1, 8, 900.0, 900.0, 910.0, 910.0)], "page long, hl_no long, x0 double, y0 double, x1 double, y1 double")
    stored = spark.createDataFrame([], "book string, page long, seq long, id string, status string, ink_hash string, strokes array<string>, quote_id string")
    state = spark.createDataFrame([("b", 2, 99)], "book string, page long, mtime long")
    pages = spark.createDataFrame([(5, "b", 1), (6, "b", 1), (7, "b", 2)], "page_key long, book string, page long")
    got = C.scan_to_claims(strokes, marks, stored, pages, state).collect()
    assert sorted((r.page, r.pos, r.outcome) for r in got) == [(1, 1, "added"), (1, (1 << 60) + 8, "added")]


def test_inbox(spark, tmp_path):
    box, big = tmp_path / "drop", 60_000_000
    box.mkdir()
    (box / "old.epub").write_bytes(b"1" * big)  # of any size
    (box / ".part").write_bytes(b"1")
    (box / "bad.epub").write_bytes(b"3")
    for name in ("old.epub", ".part", "bad.epub"):
        os.utime(box / name, (1_700_000_000, 1_700_000_000))
    (box / "new.epub").write_bytes(b"22")
    os.utime(box / "new.epub", (time.time() + 15,) * 2)  # too young for the first ticks
    seen = []

    def take(files):
        seen.append([(r.path.rsplit("/", 1)[1], r.n) for r in files.selectExpr("path", "length(content) n").collect()])
        return files.selectExpr("path", "modified", "CASE WHEN length = 1 THEN 'too short' END reason")

    query = S.stream_inbox(spark, str(box), str(tmp_path / "taken"), take, str(tmp_path / "cp"), quiet_s=1, every="1 second")
    try:
        end = time.time() + 60
        while time.time() < end and not any(("new.epub", 2) in x for x in seen):
            time.sleep(0.5)
    finally:
        query.stop()
    assert sorted(seen[0]) == [("bad.epub", 1), ("old.epub", big)] and sorted(x for s in seen for x in s) == [("bad.epub", 1), ("new.epub", 2), ("old.epub", big)]
    record = {r.path.rsplit("/", 1)[1]: r.reason for r in spark.read.parquet(str(tmp_path / "taken")).collect()}
    assert record == {"old.epub": None, "bad.epub": "too short", "new.epub": None} or record == {"old.epub": None, "bad.epub": "too short"}


def test_failures_that_are_kept(spark):
    rows = [(f"f{d}{i}", datetime(2024, 1, d, i), 10, "why") for d in (1, 2, 3) for i in range(3)] + [("fine", datetime(2024, 1, 9), 500, None)]
    got = S.kept_failures(spark.createDataFrame(rows, S.FILE + ", reason string"), 45).collect()
    assert {r.path for r in got} == {"f30", "f31", "f32", "f22"}


def test_bounded_lockout(spark, tmp_path):
    fail = lambda ip, *t: [(ip, at(x), False) for x in t]
    rows = [*fail("a", 0, 1), *fail("b", 2, 3, 4), *fail("c", 5), *fail("d", 6), *fail("a", 7, 8, 9)]  # b is locked; c and then a lose their place
    got = drain(S.bounded_lockout_stream(stream(spark, str(tmp_path / "f"), rows, "ip string, at timestamp, ok boolean"), cap=2, limit=3, shards=1), "bounded", tmp_path)
    assert sorted((r.ip, r.locked_at) for r in got) == [("a", at(9)), ("b", at(4))]


def test_packages_are_parsed_once(spark):
    text = '<package><metadata><title> <b>no</b> A<i>x</i>B &amp; C</title><title>D</title></metadata><manifest><item id="1" href="a&lt;"/><item href="b"/></manifest><spine page-progression-direction=" RTL"><itemref/><itemref idref="q"/></spine></package>'
    files = spark.createDataFrame([("a", text), ("b", ""), ("c", None), ("d", "<package><spine/></package>")], "uuid string, text string")
    found = L.extract_opf(files)
    assert "xpath" not in found._jdf.queryExecution().optimizedPlan().toString()
    rows = {r.uuid: r for r in found.collect()}
    a, b, c, d = (rows[k] for k in "abcd")
    assert (a.title, a.creator, a.rtl, a.spine) == ("A", None, True, ["q"]) and [tuple(m) for m in a.manifest] == [("1", "a<"), (None, "b")]
    assert list(b[1:]) == [None] * 5 == list(c[1:])
    assert (d.title, d.rtl, d.manifest, d.spine) == (None, False, [], [])
