"""A scan's drafts: clusters are found once for both their ink and their highlights, and ids are hashed by whole numbers."""

from pyspark.sql import functions as F

from folioflow.functions import text as T
from folioflow.operators import catalog, mining

BOX = "x0 double, y0 double, x1 double, y1 double"


def test_clusters_of_a_scan_are_found_once(spark, monkeypatch):
    calls, labelled = [], mining.labelled
    monkeypatch.setattr(mining, "labelled", lambda strokes: calls.append(1) or labelled(strokes))
    strokes = spark.createDataFrame([(1, 1, "ballpoint", 3, 0.0, 0.0, 9.0, 9.0), (1, 2, "ballpoint", 3, 12.0, 0.0, 20.0, 9.0), (1, 3, "ballpoint", 3, 900.0, 0.0, 910.0, 9.0), (2, 4, "ballpoint", 3, 0.0, 0.0, 9.0, 9.0)], f"page long, stroke_no long, tool string, n_points long, {BOX}")
    marks = spark.createDataFrame([(1, 7, 0.0, 20.0, 9.0, 30.0), (1, 8, 400.0, 900.0, 410.0, 910.0), (2, 9, 0.0, 0.0, 9.0, 9.0)], f"page long, hl_no long, {BOX}")
    changed = spark.createDataFrame([("b", 1)], "book string, page long")
    got = {(r.page, r.pos, tuple(r.strokes or ()), r.quote_id) for r in catalog.scan_drafts(strokes, marks, changed).collect()}
    assert got == {(1, 1, ("1", "2"), "7"), (1, 3, ("3",), None), (1, (1 << 60) + 8, (), "8")}
    assert len(calls) == 1


def test_hash_without_decimals(spark):
    def fnv(data):
        h = 0xCBF29CE484222325
        for b in data:
            h = (h ^ b) * 0x100000001B3 % (1 << 64)
        return f"{h:016x}"

    texts = ["", "a", "\x00", "\x80\x9f\xff", "\n\r\n", "日本\U0001f600", "z" * 300, "".join(map(chr, range(256)))]
    frame = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.fnv64(F.col("t")).alias("h"))
    assert {r.t: r.h for r in frame.collect()} == {t: fnv(t.encode()) for t in texts}
    assert "decimal" not in frame._jdf.queryExecution().analyzed().toString()
