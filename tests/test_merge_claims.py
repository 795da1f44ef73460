"""Claims of drafts on stored entries: the rules one by one against the queues, and what a large page costs."""

import hashlib
import random

import pandas as pd

from folioflow.functions import entries as E
from folioflow.operators import lifecycle

DRAFT = "book string, page long, pos long, ink_hash string, strokes array<string>, quote_id string"
ENTRY = "book string, page long, seq long, id string, status string, ink_hash string, strokes array<string>, quote_id string"


def by_rules(drafts, entries):
    """(pos, id, outcome) of a page, by looking through all its entries for each rule."""
    free, rows = sorted(entries, key=lambda e: e[2]), []
    first = lambda test: next((e for e in free if test(e)), None)
    for _, _, pos, ink, strokes, quote in sorted(drafts, key=lambda d: d[2]):
        found, outcome = None, "added"
        for revoked in (False, True):
            of_state = lambda e, r=revoked: (e[4] == "revoked") == r
            if ink is not None:
                found = first(lambda e: of_state(e) and e[5] == ink) or first(lambda e: of_state(e) and e[5] is not None and set(e[6] or ()) & set(strokes or ()))
            elif quote is not None:
                found = first(lambda e: of_state(e) and e[5] is None and e[7] == quote)
            if not found and not revoked and quote is not None:
                found = first(lambda e: e[4] not in E.TERMINAL and (e[5] is None) == (ink is not None) and e[7] == quote)
            if found:
                outcome = "revived" if revoked else "unchanged" if found[5] == ink else "changed"
                free.remove(found)
                break
        rows.append((pos, found[3] if found else None, outcome))
    return rows + [(None, e[3], "revoked") for e in free if e[4] not in E.TERMINAL and (e[5], e[7]) != (None, None)]


def some_pages(seed=5, pages=40):
    r = random.Random(seed)
    strokes = lambda: [str(r.randrange(12)) for _ in range(r.randrange(1, 4))]
    quote = lambda: r.choice([None, "q", "r", "s"])
    content = lambda: (r.choice("abcd"), r.choice([None, strokes(), strokes()])) if r.random() < 0.6 else (None, None)
    drafts = [("b", p, i, *content(), quote()) for p in range(pages) for i in range(r.randrange(7))]
    status = ("mined", "reviewed", "skipped", "revoked", "archived", "revoked")
    entries = [("b", p, i, f"{p}-{i}", r.choice(status), *content(), quote()) for p in range(pages) for i in range(r.randrange(8))]
    return drafts, entries


def test_all_rules_on_many_pages(spark):
    drafts, entries = some_pages()
    expected = set()
    for p in {d[1] for d in drafts}:  # a page without drafts wasn't scanned
        expected |= {("b", p, *row) for row in by_rules([d for d in drafts if d[1] == p], [e for e in entries if e[1] == p])}
    assert {o[4] for o in expected} == {"added", "changed", "unchanged", "revoked", "revived"}
    odd = [("b", None, 1, "a", ["1"], None), (None, 3, 1, "a", ["1"], None)]
    claims = lifecycle.merge_claim(spark.createDataFrame(drafts + odd, DRAFT), spark.createDataFrame(entries, ENTRY))
    got = [tuple(r) for r in claims.collect()]
    assert len(got) == len(expected) and set(got) == expected


def test_pages_that_go_on_in_the_next_batch(spark):
    drafts, entries = some_pages(seed=6)
    frames = spark.createDataFrame(drafts, DRAFT), spark.createDataFrame(entries, ENTRY)
    whole = {tuple(r) for r in lifecycle.merge_claim(*frames).collect()}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        assert {tuple(r) for r in lifecycle.merge_claim(*frames).collect()} == whole
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_pages_stream_by(spark):
    """One shuffle to the pages and no call of Python by group."""
    drafts, entries = some_pages(pages=3)
    plan = lifecycle.merge_claim(spark.createDataFrame(drafts, DRAFT), spark.createDataFrame(entries, ENTRY))._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "CoGroup" not in plan and plan.count("Exchange") == 1


def test_a_large_page_is_no_square():
    """Drafts look at the entries they may take: comparisons grow with the page and not with its square."""
    compared = 0

    class Text(str):
        __hash__ = str.__hash__

        def __eq__(self, other):
            nonlocal compared
            compared += 1
            return str.__eq__(self, other)

    n = 1500
    drafts = pd.DataFrame([("b", 1, i, Text(f"new{i}"), [Text(f"s{i}")], None) for i in range(n)], columns=["book", "page", "pos", "ink_hash", "strokes", "quote_id"])
    entries = pd.DataFrame([("b", 1, i, str(i), "mined", Text(f"old{i}"), [Text(f"s{n - 1 - i}")], None) for i in range(n)], columns=["book", "page", "seq", "id", "status", "ink_hash", "strokes", "quote_id"])
    got = lifecycle.claim_page(drafts, entries)
    assert set(zip(got["pos"], got["id"], got["outcome"])) == {(i, str(n - 1 - i), "changed") for i in range(n)}
    assert compared < 40 * n


def test_strokes_are_listed_once(spark):
    """Ink and strokes of a cluster come from one list, in its order."""
    box = "page long, stroke_no long, tool string, n_points long, x0 double, y0 double, x1 double, y1 double"
    strokes = spark.createDataFrame([(1, n, "ballpoint", 3, 0.0, 0.0, 9.0, 9.0) for n in (10, 9, 2)], box)
    found = lifecycle.inked_drafts(strokes)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("collect_list(") == 1
    row = found.first()
    assert row.strokes == ["2", "9", "10"] and row.ink_hash == hashlib.sha256(b"2;9;10").hexdigest()
