"""Operators across texts and vectors, against brute force on small fixtures."""

import math
import random
import re
import string
import time
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from folioflow.llm import decontaminate, hash_forest, jaccard_join, line_dedup
from folioflow.operators.graph import components


def sentence(pick, n):
    return " ".join("".join(pick.choices("etaoinshr", k=pick.randint(2, 6))) for _ in range(n))


def documents(seed=1, n=150):
    pick = random.Random(seed)
    base = [sentence(pick, pick.randint(3, 120)) for _ in range(20)]
    common = sentence(pick, 30)
    out = []
    for i in range(n):
        kind = pick.random()
        words = pick.choice(base).split() if kind < 0.7 else sentence(pick, pick.randint(1, 80)).split()
        for _ in range(pick.choice([0, 0, 1, 1, 2, 4])):
            words[pick.randrange(len(words))] = pick.choice(["zz", "yy", "XX"])
        text = " ".join(words)
        out.append(text + ("\n" + common if pick.random() < 0.4 else ""))
    return out + [None, "", " ", "a", "A b", "a b c d", "A B c D", "é " * 3000]


def shingle_set(t, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase)))
    return frozenset(zip(*[w[i:] for i in range(k)])) if len(w) >= k else frozenset([tuple(w)] if w else [])


def brute_classes(texts, k, percent):
    sets, parent = [shingle_set(t, k) for t in texts], list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, s in enumerate(sets):
        for j in range(i):
            if s and 100 * len(s & sets[j]) >= percent * len(s | sets[j]):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return {i: (len(s), find(i)) for i, s in enumerate(sets)}


@pytest.mark.parametrize("k, percent, seed", [(4, 85, 1), (5, 80, 2)])
def test_jaccard_join(spark, k, percent, seed):
    texts = documents(seed)
    rows = [(i, t, "x", 1) for i, t in enumerate(texts)] + [(3, texts[3], "x", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key string, n int").repartition(3)
    got = jaccard_join.near_duplicates(docs, k=k, percent=percent).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_classes(texts, k, percent)


def test_trees_find_all_pairs():
    pick = np.random.default_rng(3)
    base = pick.integers(0, 1 << 63, 400).astype(np.uint64) * np.uint64(2)
    sets = [np.unique(np.concatenate([pick.choice(base[i % 4 * 100 : i % 4 * 100 + 100], 97, False), pick.integers(0, 1 << 63, 2).astype(np.uint64)])) for i in range(300)]
    n, point = np.array([len(s) for s in sets]), np.stack([jaccard_join.corner(s) for s in sets])
    component = np.where(np.arange(300) % 4 == 0, 0, np.arange(300))
    tree = np.array([0] * 150 + [2] * 40 + [3] * 60 + [4] + [7] * 9 + [9] * 10 + [10] * 30)  # 2 meets 3; 7 and 9 have nobody to meet
    got = [tuple(sorted(p)) for x in jaccard_join.block_pairs(tree, np.arange(300), n, point, component, 85) for p in zip(*(y.tolist() for y in x))]
    meet = lambda i, j: tree[i] == tree[j] in (0, 4, 10) or (tree[i], tree[j]) == (2, 3)
    want = {(i, j) for i in range(300) for j in range(i + 1, 300) if meet(i, j) and component[i] != component[j] and 100 * len(np.intersect1d(sets[i], sets[j])) >= 85 * len(np.union1d(sets[i], sets[j]))}
    assert len(want) > 100 and want <= {*got} and len({*got}) == len(got)
    assert all(meet(i, j) for i, j in got) and len(got) < 150 * 149 // 2 / 3


def test_bound_of_very_long_texts():
    whole = np.unique(np.random.default_rng(6).integers(0, 1 << 63, 5_000_000).astype(np.uint64) * np.uint64(2))
    n = np.array([len(whole) - 1] * 2)
    binary = lambda f: pa.array([f(s).tobytes() for s in (whole[1:], whole[:-1])], pa.binary())
    p = binary(jaccard_join.points)
    shared = jaccard_join.shared_at_most(p.slice(0, 1), p.slice(1, 1))
    assert shared[0] >= len(whole) - 2 and jaccard_join.enough(shared, n.sum(keepdims=True), 85).all()
    corners = np.stack([jaccard_join.corner(s) for s in (whole[1:], whole[:-1])])
    assert corners.max() == 65535
    assert [(x.tolist(), y.tolist()) for x, y in jaccard_join.block_pairs(np.zeros(2, int), np.arange(2), n, corners, np.arange(2), 85)] == [([0], [1])]


def test_large_blocks_are_dealt_out(spark, monkeypatch):
    """With tiles of a few nodes the result is the same: no pair is lost between strata or parts."""
    monkeypatch.setattr(jaccard_join, "TILE", 3)
    texts = documents(4, 120)
    texts += [" ".join(["the same words in a row"] * 9 + [x]) for x in sentence(random.Random(8), 40).split()]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.near_duplicates(docs).collect()} == brute_classes(texts, 4, 85)


def test_pairs_that_only_the_trees_find(spark):
    """Steps of a chain: neighbours link, and no node of a block but the next ones is near its leader."""
    words = sentence(random.Random(9), 400).split()
    texts = [" ".join(words[i : i + 120]) for i in range(0, 200, 6)]
    want = brute_classes(texts, 4, 85)
    assert {c for _, c in want.values()} == {0}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.near_duplicates(docs).collect()} == want


def test_jaccard_join_empty_and_null_keys(spark):
    docs = spark.createDataFrame([(None, "a b c d e"), (7, "A b c d e"), (None, None)], "doc_id long, text string")
    assert sorted(map(str, (tuple(r) for r in jaccard_join.near_duplicates(docs).drop("version").collect()))) == ["(7, 2, 7)", "(None, 0, None)", "(None, 2, 7)"]
    assert jaccard_join.near_duplicates(docs.limit(0)).count() == 0


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501), (501, 500), (900, 900)], "a long, b long")
    got = {r.node: r.label for r in components(links).collect()}
    assert got == {**{i: 0 for i in range(201)}, 500: 500, 501: 500}


def words_of(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase)))


def brute_leaks(docs, items):
    out = set()
    for i, q in items:
        k = min(5, len(words_of(q)))
        if k:
            grams = lambda t: {tuple(w[j : j + k]) for w in [words_of(t)] for j in range(len(w) - k + 1)}
            qs = grams(q)
            for d, t in docs:
                shared = len(qs & grams(t))
                if shared >= 0.8 * len(qs):
                    out.add((d, i, len(qs), shared))
    return out


def test_leaks(spark, monkeypatch):
    pick = random.Random(5)
    items = [(i, sentence(pick, n)) for i, n in enumerate([1, 3, 5, 6, 9, 14, 20, 30, 45, 60, 90, 200, 15, 35])] + [(90, None), (91, "!"), (3, "twice the same"), (3, "twice the same")]
    docs = []
    for i in range(120):
        t = sentence(pick, pick.randint(0, 400)).split()
        if pick.random() < 0.7:
            q = pick.choice(items)[1] or ""
            q = q.upper() if pick.random() < 0.3 else q
            if pick.random() < 0.2 and q:
                q = " ".join(x if pick.random() > 0.02 else "zz" for x in q.split())
            at = pick.randint(0, len(t))
            t[at:at] = [q]
        docs.append((i, " ".join(t)))
    docs += [(200, None), (201, "")]
    d = spark.createDataFrame([(a, b, 0) for a, b in docs], "doc_id long, text string, item_id int").repartition(3)
    b = spark.createDataFrame([(a, b, 0) for a, b in items], "item_id long, text string, doc_id int")
    run = lambda x, y: {(r.doc_id, r.item_id, r.n_item_shingles, r.n_shared) for r in decontaminate.find_leaks(x, y).collect()}
    want = brute_leaks(docs, items)
    assert len(want) > 40 and run(d, b) == want
    monkeypatch.setattr(decontaminate, "ITEMS_PER_BLOCK", 4)
    assert run(d, b) == want
    assert run(d.limit(0), b) == set() == run(d, b.limit(0))


def test_items_in_distant_parts(spark):
    """An item is found in up to six parts that lie far apart, though no window holds more than one of them."""
    pick = random.Random(6)
    items = [(i, sentence(pick, 120)) for i in range(25)]
    docs = []
    for parts in (1, 2, 4, 6):
        for i, q in items:
            w, out = q.split(), []
            for j in range(parts):
                out += w[j * len(w) // parts : (j + 1) * len(w) // parts] + sentence(pick, 300).split()
            docs.append((len(docs), " ".join(out)))
    docs.append((len(docs), sentence(pick, 60_000) + " " + items[0][1] + " " + sentence(pick, 60_000)))
    want = brute_leaks(docs, items)
    found = decontaminate.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert len(want) == 101 and {(r.doc_id, r.item_id, r.n_item_shingles, r.n_shared) for r in found} == want


def test_line_dedup(spark):
    pick = random.Random(3)
    p, q, short = sentence(pick, 30), [sentence(pick, 10) for _ in range(4)], sentence(pick, 6)
    own = [sentence(pick, 40) for _ in range(9)]
    texts = {
        1: "\n".join([own[0], p, short]),
        2: "\n".join([own[1], *q]),
        3: "\n".join([p, own[2], short]),  # p goes, the short line stays
        4: "\n".join([own[3], *q[:3], "", q[3], own[4]]),  # q goes, over a blank line
        5: "\n".join([own[5], q[0], own[6], q[1]]),  # no block of q is long enough
        6: own[0] + "\n" + p + "\n" + short,  # a copy: nothing is left
        7: "\n".join([p, own[7], *q, p]),  # out of order, and twice
        8: None,
        9: "",
    }
    rows = [(i, t, "x", 5) for i, t in texts.items()] + [(3, texts[3], "x", 5), (None, p, "x", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, removed string, lines int").repartition(3)
    got = line_dedup.dedupe_lines(docs).collect()
    assert len(got) == len(rows)
    out = {r.doc_id: r for r in got}
    assert {i: out[i].text for i in (1, 2, 5, 8, 9)} == {i: texts[i] for i in (1, 2, 5, 8, 9)}
    assert out[3].text == own[2] + "\n" + short and (out[3].n_lines, out[3].n_removed, out[3].removed) == (3, 1, "0-0")
    assert out[4].text == own[3] + "\n" + own[4] and out[4].removed == "1-5"
    assert out[6].text == "" and out[7].text == own[7] and out[None].text == ""
    assert out[3].lines == 5 and line_dedup.dedupe_lines(docs.limit(0)).count() == 0


def test_patience_blocks():
    a, b = [1, 2, 3, 4, 5, 6], [9, 4, 5, 6, 1, 2, 3, 4, 5, 6]
    assert line_dedup.blocks(a, b, [10] * 10, 25) == [(1, 4), (4, 10)]
    assert line_dedup.blocks(a, [7, 8], [10] * 2, 25) == [] == line_dedup.blocks(a, [], [], 25)


def test_patience_decides(monkeypatch):
    a, b = [*range(20)], [*range(12, 20), 50, *range(6), 51, 3, 4, 5, 6]
    found = line_dedup.shared_blocks(a, b, [10] * len(b), 25)
    assert found == [(0, 9, 6), (3, 16, 4), (12, 0, 8)]
    assert line_dedup.patience(found) == [[(12, 0, 8)], [(0, 9, 6)], [(3, 16, 4)]]
    pick = random.Random(7)
    for _ in range(300):
        x, y = ([pick.randrange(6) for _ in range(pick.randint(0, 40))] for _ in range(2))
        piles = line_dedup.patience(found := line_dedup.shared_blocks(x, y, [10] * len(y), 25))
        assert sorted(p for pile in piles for p in pile) == sorted(found)
        for pile in piles:
            assert all(i + n <= u and j + n <= v for (i, j, n), (u, v, _) in zip(pile, pile[1:]))
        assert all(x[i : i + n] == y[j : j + n] for i, j, n in found)
    whole = line_dedup.blocks(a, b, [10] * len(b), 25)
    first = line_dedup.patience
    monkeypatch.setattr(line_dedup, "patience", lambda f: first(f)[:1])
    assert line_dedup.blocks(a, b, [10] * len(b), 25) == [(0, 8)] != whole
    monkeypatch.setattr(line_dedup, "patience", lambda _: [])
    assert line_dedup.blocks(a, b, [10] * len(b), 25) == []


def test_blocks_of_lines_that_also_stand_alone(spark):
    a, b = [1, 90, 2, 91, 3, 92, 1, 2, 3], [1, 2, 3]
    assert line_dedup.blocks(a, b, [10] * 3, 25) == [(0, 3)]
    assert line_dedup.blocks([1, 90, 2, 91, 3, 92, 1, 2, 3], [8, 1, 2, 3, 9], [10, 20, 20, 4, 10], 25) == [(1, 4)]  # to its end
    pick = random.Random(4)
    for _ in range(400):
        a, b = ([pick.randrange(4) for _ in range(pick.randint(0, 14))] for _ in range(2))
        words = [5 * x + 4 for x in b]
        found = line_dedup.blocks(a, b, words, 25)
        got = [j for x, y in found for j in range(x, y)]
        inside = lambda x, y: any(a[i : i + y - x] == b[x:y] for i in range(len(a)))
        want = {j for x in range(len(b)) for y in range(x + 1, len(b) + 1) if sum(words[x:y]) >= 25 and inside(x, y) for j in range(x, y)}
        assert sorted(want) == sorted(got)
    line = [sentence(pick, 10) for _ in range(8)]
    docs = spark.createDataFrame([(1, "\n".join([line[0], line[3], line[1], line[4], line[2], line[5], *line[:3]])), (2, "\n".join([*line[:3], line[7]]))], "doc_id long, text string")
    assert {r.doc_id: r.removed for r in line_dedup.dedupe_lines(docs).collect()} == {1: "", 2: "0-2"}


def brute_dedup(docs, least=25):
    """(key, text) -> places of the lines that are in a block of ``least`` words that any earlier document has."""
    order = sorted({(k is None, k or 0, v, t or "") for k, t, v in docs})
    lines = [[(i, x.strip()) for i, x in enumerate(t.split("\n")) if x.split()] for *_, t in order]
    out = {}
    for d, (none, key, _, text) in enumerate(order):
        mine, gone = [x for _, x in lines[d]], set()
        for e in range(d):
            whole = "\n" + "\n".join(x for _, x in lines[e]) + "\n"
            for i in range(len(mine)):
                for j in range(i + 1, len(mine) + 1):
                    if "\n" + "\n".join(mine[i:j]) + "\n" not in whole:
                        break
                    if sum(len(x.split()) for x in mine[i:j]) >= least:
                        gone.update(range(i, j))
        out[None if none else key, text] = {lines[d][i][0] for i in gone}
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_line_dedup_equals_all_pairs(spark, seed):
    pick = random.Random(seed)
    pool = [sentence(pick, n) for n in (2, 3, 4, 5, 6, 8, 10, 12, 20, 30) for _ in range(3)]
    passages = [[pick.choice(pool) for _ in range(pick.randint(2, 6))] for _ in range(8)]
    docs = []
    for i in range(60):
        lines = []
        for _ in range(pick.randint(0, 4)):
            lines += pick.choice(passages) if pick.random() < 0.7 else [pick.choice(pool)] if pick.random() < 0.5 else [sentence(pick, pick.randint(1, 40)), "", " "]
        docs.append((pick.choice([i, i, i // 2, None]), "\n".join(lines)))
    a, b = sentence(pick, 30), sentence(pick, 5)
    docs += [(100, a), (101, f"{a}\n{b}"), (102, f"{a}\n{b}")]  # the third has all of the second
    docs += [docs[3], docs[3], (None, None), (None, None), (55, "")] + [(103, "\n".join([*passages[0], *pool, *passages[1]]))]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    version = {(r.doc_id, r.text): r.v for r in frame.selectExpr("doc_id", "text", "xxhash64(text) v").collect()}
    want = brute_dedup([(k, t, version[k, t]) for k, t in docs if t is not None])
    got = line_dedup.dedupe_lines(frame.withColumn("_key", frame["doc_id"]).withColumn("run", frame["text"])).collect()
    assert len(got) == len(docs) and all(r._key == r.doc_id for r in got)
    assert sum(map(len, want.values())) > 100
    for r in got:
        ranges = [tuple(map(int, x.split("-"))) for x in r.removed.split(",") if x]
        gone = {i for x, y in ranges for i in range(x, y + 1)}
        text = (r.run or "").split("\n")
        assert {i for i in gone if text[i].split()} == (want[r.doc_id, r.run] if r.run is not None else set())
        assert r.text is None if r.run is None else r.text == "\n".join(x for i, x in enumerate(text) if i not in gone)


def test_alignment_of_very_long_texts():
    n = 20_000
    began = time.time()
    assert line_dedup.blocks([*range(n)], [*range(n)], [5] * n, 25) == [(0, n)]
    assert line_dedup.blocks([*range(n)], [*range(n)][::-1], [5] * n, 25) == []  # a reversed copy
    found = line_dedup.blocks([*range(n)], [*range(n)][::-1], [30] * n, 25)  # each line is enough
    assert {j for x, y in found for j in range(x, y)} == {*range(n)}
    same = line_dedup.blocks([7, 8] * (n // 2), [8, 7] * (n // 2), [5] * n, 25)
    assert {j for x, y in same for j in range(x, y)} == {*range(n)}
    assert time.time() - began < 10


def vectors(spark, n=1200, seed=0):
    pick = np.random.default_rng(seed)
    x = pick.standard_normal((n, 16)).astype(np.float32)
    x[100:400] = x[50]  # a group of equal vectors
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)]
    odd = [(5000, None, 1), (5050, [0.0] * 16, 1), (5100, [float("nan")] * 16, 1), (5150, [float("inf")] * 16, 1), (5200, [None] * 16, 1), (5250, [], 1), (None, x[0].tolist(), 1), (5300, [1.0, 2.0], 1), (5301, [2.0, 4.0], 1)]
    return spark.createDataFrame(rows + odd + [rows[7]], "vec_id long, embedding array<float>, score int"), x.astype(float)


def test_forest(spark):
    frame, x = vectors(spark)
    got = defaultdict(list)
    for r in hash_forest.nearest(frame, frame["vec_id"] % 50 == 0, shard_rows=500).collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    assert {*got} == {*range(0, 1200, 50), 5300} and [x[:2] for x in got[5300]] == [(1, 5301)]
    hits = 0
    for q in range(0, 1200, 50):
        cosine = (x * x[q]).sum(1) / np.sqrt((x * x).sum(1)) / np.sqrt((x[q] * x[q]).sum())
        best = [v for v in sorted(range(len(x)), key=lambda v: (-round(cosine[v], 12), v)) if v != q][:5]
        found = sorted(got[q])
        assert [r for r, _, _ in found] == [1, 2, 3, 4, 5] and all(abs(s - cosine[v]) < 1e-12 for _, v, s in found)
        hits += len({v for _, v, _ in found} & {*best})
        if q in (50, *range(100, 400, 50)):
            assert [v for _, v, _ in found] == best
    assert hits / (5 * 24) >= 0.9
    assert hash_forest.nearest(frame.limit(0), frame["vec_id"] % 50 == 0).count() == 0


def test_forest_prunes():
    x = np.random.default_rng(4).standard_normal((1500, 64))
    forest, asked = hash_forest.Forest(x), x[:40]
    cosine = (asked @ x.T) / np.sqrt((x * x).sum(1)) / np.sqrt((asked * asked).sum(1, keepdims=True))
    hits = share = 0
    for i, rows in enumerate(forest.candidates(asked, int(hash_forest.GATHER * len(x)))):
        best = [v for v in np.argsort(-cosine[i]) if v != i][:5]
        hits, share = hits + np.isin(best, rows).sum(), share + len(rows) / len(x)
    assert hits / 200 >= 0.9 and share / 40 <= 0.5


def test_forest_ignores_other_columns(spark):
    rows = [(i, [float(i % 7), 1.0, float(i % 3)], i, i, i, "x", False) for i in range(60)]
    names = "vec_id long, embedding array<double>, query_id int, rank int, id long, x string, query boolean"
    frame = spark.createDataFrame(rows, names)
    got = hash_forest.nearest(frame, frame["vec_id"] % 50 == 0).collect()
    plain = hash_forest.nearest(frame.select("vec_id", "embedding"), frame["vec_id"] % 50 == 0).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, plain)) and len(got) == 10


def test_very_large_and_small_components(spark):
    rows = [(0, [1e200, 1e200]), (1, [1e200, 1e199]), (2, [1.0, 1.0]), (3, [1e-200, 2e-200]), (4, [5e-324, 0.0]), (5, [-1e308, 1e308]), (6, [3.0, 1e-300])]
    got = hash_forest.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.lit(True), k=6).collect()
    assert len(got) == 42
    exact = lambda x: [v / max(map(abs, x)) for v in x]
    vectors = {i: exact(x) for i, x in rows}
    for r in got:
        a, b = vectors[r.query_id], vectors[r.vec_id]
        assert abs(r.score - sum(p * q for p, q in zip(a, b)) / math.hypot(*a) / math.hypot(*b)) < 1e-12
