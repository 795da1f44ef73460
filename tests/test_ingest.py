"""Ingestion of a scan: one pass from drafts to entries, and what it leaves on the disks."""

import os
import time
from pathlib import Path

from pyspark.sql import functions as F
from test_merge_claims import DRAFT, ENTRY, by_rules, some_pages

from folioflow import store
from folioflow.operators import catalog, lifecycle, mining
from folioflow.streaming.upserts import Upserts

BOX = "page long, stroke_no long, tool string, n_points long, x0 double, y0 double, x1 double, y1 double"


def fnv(text):
    h = 0xCBF29CE484222325
    for b in text.encode():
        h = (h ^ b) * 0x100000001B3 % (1 << 64)
    return f"{h:016x}"


def test_hashes_of_many_texts():
    texts = ["", "a", "日本\U0001f600", "\x00\x80", "z" * 300, "a", "b/1/" + "0f" * 32]
    assert lifecycle.fnv64_of(texts) == [fnv(t) for t in texts] and lifecycle.fnv64_of([]) == [] and lifecycle.fnv64_of([""]) == [fnv("")]


def merged(drafts, entries):
    """The entries that are added or changed, by the rules one by one."""
    out = set()
    row = lambda *r: (*r[:6], None if r[6] is None else tuple(r[6]), r[7])
    for p in {d[1] for d in drafts}:
        own, stored, seeds = {d[2]: d for d in drafts if d[1] == p}, {e[3]: e for e in entries if e[1] == p}, []
        for pos, id, outcome in by_rules(list(own.values()), list(stored.values())):
            if outcome == "revoked":
                b, p, seq, id, _, *ink = stored[id]
                out.add(row(b, p, id, seq, "revoked", *ink))
            elif outcome == "added":
                b, p, pos, *ink = own[pos]
                seed = ink[0] or ink[2]
                n, parts = seeds.count(seed), [] if seed is None else [seed]
                seeds.append(seed)
                parts = ["#".join([*parts, str(n)])] if n else parts
                out.add(row(b, p, fnv("/".join([b, str(p), *parts])), pos, "mined", *ink))
            elif outcome != "unchanged":
                out.add(row(*own[pos][:2], id, stored[id][2], "mined" if outcome == "revived" else stored[id][4], *own[pos][3:]))
    return out


def test_entries_in_the_pass_of_the_claims(spark):
    drafts, entries = some_pages(seed=7, pages=60)
    expected = merged(drafts, entries)
    assert {r[4] for r in expected} >= {"mined", "reviewed", "revoked"}
    earlier = [(*e[:4], "archived", "z", ["99"], "q") for e in entries]  # versions that later ones cover
    both = spark.createDataFrame(earlier, ENTRY).withColumn("_version", F.lit(0)).union(spark.createDataFrame(entries, ENTRY).withColumn("_version", F.lit(1)))
    for stored in (spark.createDataFrame(entries, ENTRY), both):
        got = lifecycle.merge_entries(spark.createDataFrame(drafts, DRAFT), stored)
        assert got._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
        rows = [(*r[:6], None if r.strokes is None else tuple(r.strokes), r.quote_id) for r in got.collect()]
        assert len(rows) == len(expected) and set(rows) == expected


def some_strokes(spark, pages=30):
    rows = [(p, 10 * p + i, "ballpoint", 3, 30.0 * (i * (p % 4)), 0.0, 30.0 * (i * (p % 4)) + 9, 9.0) for p in range(pages) for i in range(5)]
    return spark.createDataFrame(rows, BOX), {(p, 10 * p + i, 10 * p + (i if p % 4 > 1 else 0)) for p in range(pages) for i in range(5)}


def test_labels_meet_strokes_on_their_page(spark):
    strokes, expected = some_strokes(spark)
    found = mining.labelled(strokes)
    assert found.columns == [*strokes.columns, "cluster"]
    assert {(r.page, r.stroke_no, r.cluster) for r in found.collect()} == expected
    plan = lifecycle.inked_drafts(strokes)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan


def test_tables_of_a_scan_go_with_it(spark):
    there = lambda: set(os.listdir(store.shared_dir(spark)))
    strokes, labels = some_strokes(spark)
    changed = spark.createDataFrame([("b", p) for p in range(30)], "book string, page long")
    marks, before = spark.createDataFrame([], "page long, hl_no long, x0 double, y0 double, x1 double, y1 double"), there()
    with store.Steps(spark) as steps:
        entries = catalog.ingest(strokes, marks, spark.createDataFrame([], ENTRY), changed, steps)
        assert [n.split("-")[0] for n in there() - before] == ["drafts"]
        assert entries.count() == len({x[2] for x in labels})
    assert there() == before


def test_tables_that_are_passing(spark):
    there = lambda: {n.split("-")[0] for n in os.listdir(store.shared_dir(spark)) if n.startswith("passing")}
    with store.passing():
        a = store.made(lambda: store.cut(spark.range(5), "passing1"), "passing2")
        assert a.count() == 5 and there() == {"passing2"}
    assert not there()
    assert store.made(lambda: store.cut(spark.range(5), "passing1"), "passing3").count() == 5 and there() == {"passing3"}


def test_a_step_leaves_no_shuffle(spark, tmp_path):
    where = (os.environ.get("SPARK_LOCAL_DIRS") or spark.sparkContext.getConf().get("spark.local.dir")).split(",")
    there = lambda: {f for d in where for f in Path(d).rglob("shuffle_*.data")}
    rows, before = spark.range(0, 1000, 1, 4).repartition(3, "id"), there()
    table = Upserts(spark, str(tmp_path / "table"), "id long", "id")
    assert store.cut(rows).count() == 1000
    table.merge(rows, 0)
    table.merge(rows.where("id < 3"), 1)
    table.compact(1)
    end = time.time() + 20
    kept = lambda: {f for f in there() - before if f.stat().st_size > 2000}  # noqa: E731  # the counts' own shuffles are less
    while time.time() < end and kept():
        time.sleep(0.2)
    assert not kept()
    assert table.read().count() == 1000
