"""Streams in the order of their time: rows that come in any cut and order, alarms without a further row, batches that run twice."""

import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from folioflow.operators import lifecycle
from folioflow.streaming import streams as S, timed as T
from folioflow.streaming.upserts import Upserts, upserted

T0 = datetime(2024, 1, 1)
MICROS = 1_000_000


def at(s):
    return T0 + timedelta(seconds=s)


def batches(spark, path, parts, schema):
    """A stream whose micro-batches are the given lists of rows."""
    for rows in parts:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
        time.sleep(0.02)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def drain(frame, name, tmp_path):
    frame.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start().awaitTermination()
    rows = frame.sparkSession.table(name).collect()
    zero = round((T0 - datetime(1970, 1, 1)).total_seconds()) * MICROS
    return sorted((*r[:-1], (r[-1] - zero) / MICROS) for r in rows)


def test_locks_and_unlocks(spark, tmp_path):
    fail = lambda ip, *t: [(ip, at(x), False) for x in t]
    schema = "ip string, at timestamp, ok boolean"
    # x: locked at 40 until the first failure is a minute old; that at 45 doesn't count, that at 61 locks again. y: a success unlocks
    parts = [fail("x", 20, 0, 10) + fail("y", 3, 2, 1), fail("x", 40, 30) + fail("y", 5, 4), fail("x", 45, 61) + [("y", at(30), True)], fail("y", 70, 71), [("tick", at(5000), True)], [("tick", at(5001), True)]]
    got = drain(T.lock_stream(batches(spark, str(tmp_path / "in"), parts, schema), limit=5, seconds=60, late="1 minute"), "locks", tmp_path)
    assert got == [("x", "locked", 40.0), ("x", "locked", 61.0), ("x", "unlocked", 60.0), ("x", "unlocked", 70.0), ("y", "locked", 5.0), ("y", "unlocked", 30.0)]


def test_hand_outs_end_by_themselves(spark, tmp_path):
    ask = lambda item, *t: [(item, at(x), False) for x in t]
    schema = "item string, at timestamp, done boolean"
    parts = [ask("i", 0, 5, 20) + ask("j", 0, 15), ask("i", 40) + [("j", at(20), True)], ask("k", 50, 70, 90, 200), ask("j", 300), [("tick", at(5000), True)], [("tick", at(5001), True)]]
    got = drain(T.hand_out_stream(batches(spark, str(tmp_path / "in"), parts, schema), quiet=15, most=3), "hands", tmp_path)
    hand = [("i", 0), ("i", 20), ("i", 40), ("j", 0), ("j", 15), ("j", 300), ("k", 50), ("k", 70), ("k", 90), ("k", 200)]
    assert got == sorted([(i, "hand", float(t)) for i, t in hand] + [("i", "give_up", 55.0), ("k", "give_up", 105.0)])


@pytest.mark.parametrize("cut", [1, 3])
def test_wakeups_by_generation(spark, tmp_path, cut):
    rows = [("a", at(x)) for x in (1, 2, 3, 8, 30, 31)] + [("b", at(4))]
    parts = [rows[i::cut] for i in range(cut)] + [[("tick", at(5000))], [("tick", at(5001))]]
    got = drain(T.wakeups(batches(spark, str(tmp_path / "in"), parts, "area string, at timestamp"), busy=5, late="1 minute"), f"woken{cut}", tmp_path)
    # the changes at 2 and 3 are seen together at 6, that at 8 when the reader is free at 11
    assert [r for r in got if r[0] != "tick"] == [("a", 1, 1.0), ("a", 3, 6.0), ("a", 4, 11.0), ("a", 5, 30.0), ("a", 6, 35.0), ("b", 1, 4.0)]


COMMANDS = "id long, at timestamp, seq long, cmd string, arg string, done_at long"


def test_commands_in_any_order_and_late_ones(spark, tmp_path):
    text = lambda rows: [(1, at(t), n, c, a, 100 + n) for t, n, c, a in rows]
    parts = [
        text([(20, 2, "edit", "second"), (10, 1, "draft", "first")]),
        text([(40, 4, "skip", None), (15, 9, "archive", None), (30, 3, "edit", "third")]),  # within the time still, and before the edits
        text([(100, 5, "restore", None), (5, 7, "edit", "too late")]),
        text([(300, 6, "revoke", None), (1, 8, "edit", "too late again")]),
        text([(9000, 10, "fly", None)]),
    ]
    entry = spark.createDataFrame([(1,), (2,)], "id long").select("id", F.expr(f"CAST(struct('mined', NULL, 'body', array(), NULL, NULL, 'both', true, NULL, 0, NULL, 0, 0) AS {lifecycle.STATE})").alias("state"))
    table = Upserts(spark, str(tmp_path / "entries"), f"id long, state {lifecycle.STATE}", "id")
    late = Upserts(spark, str(tmp_path / "late"), "seq long, id long, cmd string", "seq")
    table.merge(entry, -1)
    S.apply_command_stream(batches(spark, str(tmp_path / "in"), parts, COMMANDS), table, late, str(tmp_path / "cp"), "30 seconds").awaitTermination()
    assert {r.seq for r in late.read().collect()} == {7, 8}
    on_time = [c for p in parts for c in p if c[2] not in (7, 8, 10)]
    log = spark.createDataFrame([(c[0], i, *c[3:]) for i, c in enumerate(sorted(on_time, key=lambda c: c[1]))], "id long, seq long, cmd string, arg string, at long")
    expected = {r.id: r.state for r in lifecycle.apply_commands(entry, log).collect()}
    assert {r.id: r.state for r in table.read().collect()} == expected
    assert expected[1].status == "revoked" and table.read().count() == 2


def test_upserts_and_a_batch_that_runs_twice(spark, tmp_path):
    calls = "at timestamp, model string, called long, ok boolean, prompt_tokens long, completion_tokens long"
    parts = [[(at(0), "m", 1, True, 1, 2), (at(1), "n", 2, False, 9, 9)], [(at(2), "m", 3, True, 3, 4)], [(at(3), "n", 4, True, 5, 6)], [(at(4), "o", 5, True, 7, 8)]]
    table = Upserts(spark, str(tmp_path / "usage"), S.USAGE, "model")
    upserted(S.usage_stream(batches(spark, str(tmp_path / "in"), parts, calls)), table, str(tmp_path / "cp"), every=2).awaitTermination()
    expected = {("m", 2, 2, 0, 4, 6, 3), ("n", 2, 1, 1, 5, 6, 4), ("o", 1, 1, 0, 7, 8, 5)}
    rows = lambda **a: {tuple(r) for r in table.read(**a).collect()}
    assert rows() == expected and rows(before=3) == {("m", 2, 2, 0, 4, 6, 3), ("n", 2, 1, 1, 5, 6, 4)}
    assert table.versions() == (2, [3])  # compacted on the way
    again = spark.createDataFrame([("o", 1, 1, 0, 7, 8, 5)], S.USAGE)
    table.merge(again, 3)
    assert rows() == expected
    table.compact(3)
    assert rows() == expected and table.versions() == (3, [])
    assert not (tmp_path / "usage" / "version=0").exists()
    (tmp_path / "usage" / "version=9").mkdir()  # a version that isn't whole
    assert rows() == expected


def test_ingest_merges_and_repeats(spark, tmp_path):
    box = "page long, stroke_no long, tool string, n_points long, x0 double, y0 double, x1 double, y1 double"
    first = [(1, 1, "ballpoint", 3, 0.0, 0.0, 9.0, 9.0), (1, 3, "ballpoint", 3, 300.0, 0.0, 310.0, 9.0), (2, 4, "ballpoint", 3, 0.0, 0.0, 9.0, 9.0)]
    scans = [first, [first[0], (1, 2, "ballpoint", 3, 12.0, 0.0, 20.0, 9.0)], [first[0], (1, 2, "ballpoint", 3, 12.0, 0.0, 20.0, 9.0)]]
    marks = spark.createDataFrame([(1, 7, 0.0, 20.0, 9.0, 30.0)], "page long, hl_no long, x0 double, y0 double, x1 double, y1 double")
    pages = "page_key long, book string, page long"
    table = Upserts(spark, str(tmp_path / "entries"), S.ENTRY, "book", "page", "id")
    scan = lambda n: spark.createDataFrame(scans[n], box)
    changes = batches(spark, str(tmp_path / "in"), [[(1, "b", 1), (2, "b", 1), (3, "b", 2)], [(4, "b", 1)], [(5, "b", 1)]], pages)
    S.ingest_stream(changes, table, scan, marks, str(tmp_path / "cp")).awaitTermination()
    rows = lambda: sorted((r.page, r.status, sorted(r.strokes), r.quote_id) for r in table.read().collect())
    expected = [(1, "mined", ["1", "2"], "7"), (1, "revoked", ["3"], None), (2, "mined", ["4"], None)]
    assert rows() == expected
    for name in ("2", ".2.crc"):
        (tmp_path / "cp" / "commits" / name).unlink()  # as if the program had ended before the last commit
    S.ingest_stream(spark.readStream.schema(pages).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), table, scan, marks, str(tmp_path / "cp")).awaitTermination()
    assert rows() == expected


def test_positions_expire(spark, tmp_path):
    schema, path = "uuid string, what string, device string, page long, at_ms long", str(tmp_path / "in")
    put = lambda *rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    ask = lambda *books: put(*((b, "ask", None, None, 9) for b in books))
    put(("a", "put", "d1", 1, 1), ("a", "put", "d1", 3, 3), ("a", "put", "d2", 2, 2), ("b", "put", "d1", 7, 1), ("c", "put", "d1", 8, 1))
    seen = []
    query = T.position_stream(spark.readStream.schema(schema).parquet(path), days=12 / 86_400).writeStream.foreachBatch(lambda b, n: seen.extend(tuple(r) for r in b.collect())).option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="500 milliseconds").start()

    def until(fits):
        end = time.time() + 60
        while time.time() < end and not fits():
            time.sleep(0.2)
        assert fits(), seen

    try:
        until(lambda: query.lastProgress and sum(p["numInputRows"] for p in query.recentProgress) >= 5)
        put(("b", "gone", None, None, 2))
        ask("a")
        until(lambda: len(seen) == 2)
        assert sorted(seen) == [("a", "d1", 3, 3), ("a", "d2", 2, 2)]
        time.sleep(13)
        put(("c", "put", "d3", 9, 4))
        ask("a", "b", "c")
        until(lambda: len(seen) == 3)
        assert seen[2] == ("c", "d3", 9, 4)
    finally:
        query.stop()
