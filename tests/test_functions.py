"""Text functions and the lifecycle on cases made by hand."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from folioflow.functions import text as T
from folioflow.operators import ledger, lifecycle, mining, skew
from folioflow.operators.graph import components


def one(spark, column, *values):
    return [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").orderBy("i").select(column).collect()]


MARKERS = [
    ("- buy ink", "bullet", "buy ink"), ("• first\nnext line", "bullet", "first\nnext line"), ("7. count", "numbered", "count"), ("33、item", "numbered", "item"), ("□ seek", "checkbox", "seek"), ("口 seek", "checkbox", "seek"), ("☐", "checkbox", ""),
    ("## chapter", "heading1", "chapter"), ("##chapter", "heading1", "chapter"), ("### below", "heading2", "below"), ("##### far below", "heading2", "far below"), ("###", None, "###"), ("- [ ] task", "checkbox", "task"), ("* [] task", "checkbox", "task"),
    ("-[x] task", "checkbox", "task"), ("[X] task", "checkbox", "task"), ("［　］ broad", "checkbox", "broad"), ("- [sic] task", "bullet", "[sic] task"), ("[12] source", None, "[12] source"), ("口袋里", None, "口袋里"), ("· dot", "bullet", "dot"), ("—dash", "bullet", "dash"),
    ("-40 outside", None, "-40 outside"), ("1999 then", None, "1999 then"), ("2.72 is e", None, "2.72 is e"), ("9)nine", "numbered", "nine"), ("1234. too long", None, "1234. too long"), ("# only one", None, "# only one"), ("  - led by blanks", "bullet", "led by blanks"), ("", None, ""),
]


def test_leading_marker(spark):
    got = one(spark, T.leading_marker(F.col("v")), *[m[0] for m in MARKERS])
    assert [(r.style, r.text) for r in got] == [m[1:] for m in MARKERS]


NAMES = [
    ("山路 - 卷07 -- somebody -- 山路 - 卷07, 1999", "山路 - 07卷"), ("山路 9卷 [完] -- x", "山路 - 9卷"), ("山路(卷三) -- 某人", "山路 - 三卷"), ("山路-海边", "山路-海边"), ("山路 中册", "山路 - 中册"), ("山路 - 上", "山路 - 上"),
    ("山路 - 第四部", "山路 - 四部"), ("山路Vol.8", "山路 - 8卷"), ("山路 vol 15", "山路 - 15卷"), ("山路 - 集6", "山路 - 6集"), ("山路册两", "山路 - 两册"), ("山路 第二十卷", "山路 - 二十卷"), ("山路（终）", "山路"), ("山路 第9回", "山路 - 第9回"),
    ("山路（第 七 季）", "山路 - 第七季"), ("山路第9回", "山路第9回"), ("路在山中", "路在山中"), ("  plain name  ", "plain name"), (" -- who", "-- who"), ("", ""), ("a-b: 第 12 册", "a-b - 12册"), ("卷5", "卷5"), ("x 3 卷", "x - 3卷"), ("x 第 3 次", "x 第 3 次"), ("山路(海) - 下卷 (完结)", "山路(海) - 下卷"),
]


def test_canonical_name(spark):
    got = one(spark, T.canonical_name(F.col("v")), *[n[0] for n in NAMES])
    assert got == [n[1] for n in NAMES]
    assert one(spark, T.canonical_name(F.col("v")), *got) == got


def test_markdown(spark):
    lines = ["# T", "## h", "### k", "- [x] done", "* a **bold** word", "3) n", "plain _em_ and * one", "#tag", "# ", "   "]
    got = [(r.style, r.text) for r in one(spark, T.md_line(F.col("v")), *lines)]
    assert got == [("title", "T"), ("heading1", "h"), ("heading2", "k"), ("checkbox", "done"), ("bullet", "a bold word"), ("numbered", "n"), ("plain", "plain em and * one"), ("plain", "#tag"), ("title", ""), ("plain", "")]


def fnv(data: bytes) -> str:
    h = 0xCBF29CE484222325
    for b in data:
        h = (h ^ b) * 0x100000001B3 % (1 << 64)
    return f"{h:016x}"


def test_fnv(spark):
    texts = ["", "a", "foobar", "中文 note", "x" * 300]
    assert one(spark, T.fnv64(F.col("v")), *texts) == [fnv(t.encode()) for t in texts] and fnv(b"") == "cbf29ce484222325"


def test_paths_and_names(spark):
    assert one(spark, T.path_normalise(F.lit("a/b"), F.col("v")), "c.html", "../c.html", "./x//y", "../../../z", "/abs/q") == ["a/b/c.html", "a/c.html", "a/b/x/y", "z", "abs/q"]
    assert one(spark, T.file_ext(F.col("v")), "B.EPUB", ".hidden", "none", "a.b.Pdf") == ["epub", "", "", "pdf"]
    assert one(spark, T.percent_decode(F.col("v")), "a%20b+c", "100%", "%E4%B8%AD") == ["a b+c", "100%", "中"]
    long = "中" * 90
    (short,) = one(spark, T.sidecar_name(F.col("v")), long)
    assert len(short.encode()) <= 255 and short.startswith("." + "中" * 66 + ".") and one(spark, T.sidecar_name(F.col("v")), "a.epub") == [".a.epub.delivered"]


def test_clusters_by_hand(spark):
    box = [("p", 1, "ballpoint", 0, 0, 10, 10), ("p", 2, "ballpoint", 40, 0, 50, 10), ("p", 3, "ballpoint", 500, 500, 510, 510), ("p", 4, "highlighter", 20, 0, 30, 10), ("p", 5, "ballpoint", 80, 0, 90, 10)]
    strokes = spark.createDataFrame([(*x[:3], *map(float, x[3:])) for x in box], "page string, stroke_no long, tool string, x0 double, y0 double, x1 double, y1 double")
    got = {(r.cluster, r.strokes) for r in mining.clusters(strokes).collect()}
    assert got == {(1, 3), (3, 1)}
    marks = spark.createDataFrame([("p", 1, 0.0, 148.0, 10.0, 160.0), ("p", 2, 600.0, 600.0, 610.0, 610.0)], "page string, hl_no long, x0 double, y0 double, x1 double, y1 double")
    paired = {r.cluster: r.hl_no for r in mining.nearest_highlight(mining.clusters(strokes), marks).collect()}
    assert paired == {1: 1, 3: 2}
    assert {r.hl_no for r in mining.nearest_highlight(mining.clusters(strokes), marks, gap=130.0).collect()} == {None, 2}


def test_fingerprint_in_any_order(spark):
    schema = "page string, cluster long, stroke_no long, n_points long, x0 double, y0 double, x1 double, y1 double"
    a = [("p", 1, 1, 3, 0.0, 0.0, 5.4, 9.0), ("p", 1, 2, 4, 1.0, 1.0, 2.0, 2.0)]
    b = [a[1], ("p", 1, 1, 3, 0.0, 0.0, 5.0, 9.0)]
    c = [a[0], ("p", 1, 2, 5, 1.0, 1.0, 2.0, 2.0)]
    x, y, z = (mining.fingerprints(spark.createDataFrame(r, schema)).first().hash for r in (a, b, c))
    assert x == y != z and x == fnv(b"1|3|0|0|5|9;2|4|1|1|2|2")


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)], "a long, b long")
    assert {r.label for r in components(links).collect()} == {0}
    assert components(links.limit(0)).count() == 0


def test_components_within_groups(spark):
    from folioflow.operators.graph import components_within

    links = [(g, g * 1000 + i, g * 1000 + i + 1) for g in range(40) for i in range(0, 60, 1) if i % 7 != 6]
    frame = spark.createDataFrame(links, "page long, a long, b long").repartition(5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "17")
    try:
        got = {(r.node, r.label) for r in components_within(frame, "page").collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == {(r.node, r.label) for r in components(frame.select("a", "b")).collect()}


def test_lockout_fold(spark):
    times = [("::ffff:10.0.0.1", t) for t in (0, 10, 20, 30, 40, 45, 61, 200)] + [("10.0.0.2", t) for t in range(0, 1000, 20)]
    got = {r.ip: r.locks for r in ledger.lockout_fold(spark.createDataFrame(times, "ip string, at long")).collect()}
    # locked at 40 until the failure at 0 is a minute old; the one at 45 is ignored, that at 61 locks again
    assert got == {"10.0.0.1": [40, 61], "10.0.0.2": []}


def test_commands(spark):
    entry = spark.createDataFrame([(1,)], "id long").select("id", F.expr(f"CAST(struct('mined', NULL, 'body', array(), NULL, NULL, 'both', true, NULL, 0, NULL, 0, 0) AS {lifecycle.STATE})").alias("state"))
    log = [("request", None), ("draft", "- first"), ("draft", "## second"), ("edit", "1. mine "), ("draft", "# third"), ("remembered", None), ("skip", None), ("edit", "no"), ("restore", None), ("edit", " "), ("revoke", None), ("revive", None), ("fly", None)]
    frame = spark.createDataFrame([(1, i, c, a, 100 + i) for i, (c, a) in enumerate(log)], "id long, seq long, cmd string, arg string, at long")
    states = []
    for n in range(1, len(log) + 1):
        states.append(lifecycle.apply_commands(entry, frame.where(F.col("seq") < n)).first().state)
    assert [s.status for s in states] == ["pending", "draft", "draft", "reviewed", "reviewed", "reviewed", "skipped", "skipped", "mined", "draft", "revoked", "draft", "draft"]
    assert states[2].style == "heading1" and states[3].style == "numbered" and states[3].text == "mine" and states[4].style == "numbered"
    assert [d.text for d in states[4].drafts] == ["# third", "second", "first"] and (states[5].streak, states[5].due) == (1, 105 + 3 * 86400) and states[5].updated == 104
    assert (states[7].rejected, states[-1].rejected) == (1, 2)


def page(kind, rows):
    names = {"drafts": ["book", "page", "pos", "ink_hash", "strokes", "quote_id"], "entries": ["book", "page", "seq", "id", "status", "ink_hash", "strokes", "quote_id"]}[kind]
    return pd.DataFrame([("b", "p", *r) for r in rows], columns=names)


@pytest.mark.parametrize(
    "drafts, entries, want",
    [
        ([(0, "h", ["1"], None)], [], {(0, None, "added")}),
        ([(0, "h", ["1"], None)], [(0, "e", "reviewed", "h", ["1"], None)], {(0, "e", "unchanged")}),
        ([(0, "h2", ["1", "2"], None)], [(0, "e", "reviewed", "h", ["1"], None)], {(0, "e", "changed")}),
        ([], [], set()),
        ([(0, "x", ["9"], None)], [(0, "e", "reviewed", "h", ["1"], None)], {(0, None, "added"), (None, "e", "revoked")}),
        ([(0, "x", ["9"], None)], [(0, "e", "skipped", "h", ["1"], None)], {(0, None, "added")}),
        ([(0, "h", ["1"], "q")], [(0, "e", "reviewed", None, None, "q")], {(0, "e", "changed")}),
        ([(0, "h", ["1"], "q")], [(0, "e", "skipped", None, None, "q")], {(0, None, "added")}),
        ([(0, None, None, "q")], [(0, "e", "reviewed", "h", ["1"], "q")], {(0, "e", "changed")}),
        ([(0, "h", ["1"], None)], [(0, "e", "revoked", "h", ["1"], None)], {(0, "e", "revived")}),
        ([(0, "h", ["1"], None), (1, "h", ["1"], None)], [(0, "e", "mined", "h", ["1"], None)], {(0, "e", "unchanged"), (1, None, "added")}),
    ],
)
def test_claims(drafts, entries, want):
    got = lifecycle.claim_page(page("drafts", drafts), page("entries", entries))
    assert {(None if pd.isna(r.pos) else r.pos, r.id, r.outcome) for r in got.itertuples()} == want


def test_merge_twice_changes_nothing(spark):
    schema = "book string, page string, pos long, ink_hash string, strokes array<string>, quote_id string"
    drafts = spark.createDataFrame([("b", f"p{i % 3}", i, f"h{i}", [str(i)], None) for i in range(9)], schema)
    stored = drafts.select("book", "page", F.col("pos").alias("seq"), F.col("ink_hash").alias("id"), F.lit("mined").alias("status"), "ink_hash", "strokes", "quote_id")
    first = lifecycle.merge_claim(drafts, stored.limit(0))
    assert {r.outcome for r in first.collect()} == {"added"} and {r.outcome for r in lifecycle.merge_claim(drafts, stored).collect()} == {"unchanged"}
    ids = lifecycle.new_ids(first, drafts.select("book", "page", "pos", F.lit("s").alias("seed"))).collect()
    assert len({r.id for r in ids}) == 9


def test_spread_join(spark):
    from folioflow.operators.skew import spread_join

    many = spark.createDataFrame([(0, i) for i in range(1000)] + [(1, 5000), (2, 6000), (9, 7000)], "k long, v long")
    one = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c"), (3, "d")], "k long, t string")
    got = sorted((r.k, r.v, r.t) for r in spread_join(many, one, "k", "v").collect())
    assert got == sorted((r.k, r.v, r.t) for r in many.join(one, "k").collect()) and len(got) == 1002
    assert spread_join(many.where("k > 0"), one, "k", "v").count() == 2


@pytest.mark.parametrize("how, bound", [("inner", 100_000), ("left", 100_000), ("left", 1)])
def test_spread_join(spark, monkeypatch, how, bound):
    """The same rows as a plain join, whichever keys are dealt out."""
    monkeypatch.setattr(skew, "BROADCAST_KEYS", bound)
    many = spark.createDataFrame([(k, "x", i) for i, k in enumerate([1] * 50 + [2] * 30 + [3] * 2 + [4] * 9)], "k long, m string, v long")
    one = spark.createDataFrame([(k, "x", f"r{k}") for k in (1, 2, 3, 5)], "k long, m string, w string")
    got = skew.spread_join(many, one, ["k", "m"], "v", rows=5, how=how)
    assert sorted(map(str, got.select("k", "v", "w").collect())) == sorted(map(str, many.join(one, ["k", "m"], how).select("k", "v", "w").collect()))
