"""The trie of conversations against one that is built turn by turn."""

import hashlib
import math
import random
import zlib

import pytest

from folioflow.llm import prefix_trie

SCHEMA = "depth string, conv_id long, turn long, role string, text string, pos int"


def brute(rows, rebuild=True):
    """(conv_id, depth, parent, members, children, leaves, saved, ends) of every node."""
    convs = {}
    for _, c, turn, role, text, *_ in rows:
        if c is not None:
            convs.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for *_, r, t in sorted(v)] for c, v in convs.items()}
    if rebuild:
        h = lambda c: zlib.crc32(str(c).encode()) % 6
        base = lambda c: own.get(c - int(math.fmod(c, 100)), [])
        own = {c: base(c)[: h(c)] + v[h(c) :] for c, v in own.items()}
    members = {}
    for c, v in own.items():
        for d in range(len(v) + 1):
            members.setdefault(tuple(v[:d]), []).append(c)
    children = {}
    for p in members:
        if p:
            children.setdefault(p[:-1], []).append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        kids = children.get(p, [])
        leaves[p] = sum(leaves[k] for k in kids) if kids else 1
        saved[p] = sum(saved[k] for k in kids) + (len(members[p]) - 1) * (len(p[-1][1]) if p else 0)
    sha = lambda p: hashlib.sha256(",".join(str(c) for c in sorted(members[p]) if len(own[c]) == len(p)).encode()).hexdigest()
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children.get(p, [])), leaves[p], saved[p], sha(p)) for p, m in members.items())


def key(r):
    return tuple((x is None, x if x is not None else 0) for x in r)


def check(spark, rows, rebuild=True, **sizes):
    turns = spark.createDataFrame(rows, SCHEMA).repartition(3)
    base, h = prefix_trie.rule() if rebuild else (None, None)
    found = prefix_trie.conversation_trie(turns, base=base, h=h, **sizes)
    assert found.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    got = sorted((tuple(r) for r in found.collect()), key=key)
    expected = sorted(brute(rows, rebuild), key=key)
    assert len(got) == len(expected)
    assert got == expected


def conversations(seed, n=120, texts=3, most=7):
    pick = random.Random(seed)
    rows = []
    for c in range(n):
        for t in range(pick.randint(1, most)):
            rows.append(("x", c * pick.choice([1, 1, 1, 7]), t, pick.choice(["user", "assistant"]), pick.choice(["", "ab", "éa🙂", "longer text"][:texts]), 5))
    seen, out = set(), []  # a conversation's turns are numbered once
    for r in rows:
        if (r[1], r[2]) not in seen:
            seen.add((r[1], r[2]))
            out.append(r)
    return out


@pytest.mark.parametrize("seed, shard_rows, head", [(1, 8192, 64), (3, 6, 64), (5, 17, 2), (6, 5, 5)])
def test_equals_brute_force(spark, seed, shard_rows, head):
    check(spark, conversations(seed), shard_rows=shard_rows, head=head)


def test_groups_of_copies_over_many_shards(spark):
    """A third of the conversations are equal, and a first turn is in all of them."""
    same = [("x", 1000 + c, t, "user", f"turn {t}", 0) for c in range(90) for t in range(5)]
    rest = [("x", 3000 + c, t, "user", f"turn {t if t < 2 else (c, t)}", 0) for c in range(100) for t in range(4)]
    check(spark, same + rest, rebuild=False, shard_rows=8)
    check(spark, same + rest, rebuild=False, shard_rows=8, head=3)


def test_very_long_conversations(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "BUCKET", 16)
    rows = [("x", c, t, "user", f"t{t}" if t < 150 or c % 2 else f"{c} {t}", 0) for c in range(6) for t in range(200 + c)]
    rows += [("x", 50, t, "user", f"t{t}", 0) for t in range(64)] + [("x", 51, t, "user", f"t{t}", 0) for t in range(65)]
    check(spark, rows, rebuild=False, shard_rows=3)
    check(spark, rows, shard_rows=3, head=10)


def test_odd_rows(spark):
    rows = [
        ("x", 0, 0, None, "a", 1),
        ("x", 0, None, "user", None, 1),
        ("x", 1, 3, "", "a", None),
        ("x", 1, 3, "", "a", None),
        ("x", 1, 3, "", "b", None),
        ("x", 2, 0, "user", "a" * 100_000, 1),
        ("x", None, 0, "user", "a", 1),
        ("x", -3, 0, "user", "z", 1),
        ("x", 205, 0, "user", "no base", 1),
    ]
    check(spark, rows, rebuild=False)
    check(spark, [r for r in rows if r[1] is None or r[1] >= 0], shard_rows=1)
    assert prefix_trie.conversation_trie(spark.createDataFrame([], SCHEMA)).count() == 0


def test_numbering_over_partitions(spark):
    """A conversation that holds most rows lies in several partitions."""
    from folioflow.store import Steps

    rows = spark.range(3000).selectExpr("IF(id % 10 < 8, 7, id) AS conv", "3000 - id AS turn", "id AS hi", "id AS lo", "id AS chars")
    with Steps(spark) as steps:
        got = prefix_trie.numbered(rows, steps)
        assert got.count() == 3000
        big = [r[0] for r in got.where("conv = 7").orderBy("hi", ascending=False).select("pos").collect()]
        assert big == list(range(2400))
        assert got.where("conv <> 7").agg({"pos": "max"}).first()[0] == 0
