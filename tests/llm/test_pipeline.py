"""The pipeline on a small table, and the registry's names."""

import random

import pytest

from folioflow.llm import registry

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_names():
    assert sorted(int(q[2:].split("_")[0]) for q in registry.queries()) == [*range(1, 11)]


def test_pipeline(spark, tmp_path):
    pick = random.Random(1)
    say = lambda n: " ".join("".join(pick.choices("etaoinshr", k=pick.randint(2, 6))) for _ in range(n))
    texts = [say(80) for _ in range(12)]
    item = say(30)
    texts[3] = texts[1]  # a copy
    texts[5] = " ".join(["zz", *texts[2].split()[1:]])  # a near copy, in one line
    texts[7] = say(40) + " " + item + " " + say(10)  # a leak
    texts += ["12 34 !!", None]  # no language
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert sorted(got) == [0, 1, 2, 4, 6, 8, 9, 10, 11]
    assert got[1].n_tokens == len(got[1].ids) > 0 and got[1].text == texts[1]
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs_out = stage(spark, docs.limit(0), str(tmp_path))
        assert docs_out.count() == 0 and docs_out.columns[:5] == docs.columns


def test_one_row_of_each_group_stays(spark, tmp_path):
    pick = random.Random(2)
    say = lambda n: " ".join("".join(pick.choices("etaoinshr", k=pick.randint(2, 6))) for _ in range(n))
    near = lambda t, w: " ".join([w, *t.split()[1:]])
    a, b, c, d, e, f = (say(80) for _ in range(6))
    rows = [(1, a), (1, a), (1, near(a, "zz")), (9, near(a, "yy"))]  # repeated rows, and similar texts under one key
    rows += [(None, b), (None, b), (None, near(b, "zz"))]  # a group of null keys alone
    rows += [(None, c), (4, c), (4, c)]  # a group with a key and without
    rows += [(1, d), (None, e), (7, f)]  # other texts of keys that have groups stay
    bare = [(5, " "), (5, " "), (None, ""), (6, None)]  # nothing is similar to these
    docs = spark.createDataFrame([(k, t, "en", s, len(t or "")) for s in "sr" for k, t in rows] + [(k, t, "en", "s", 0) for k, t in bare], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.near_duplicate_stage(spark, docs.repartition(3), str(tmp_path)).collect()
    found = sorted((str(r.doc_id), r.text) for r in got if (r.text or "").strip())
    of_a, of_b = [x for x in found if x[1].split()[1:] == a.split()[1:]], [x for x in found if x[1].split()[1:] == b.split()[1:]]
    assert len(of_a) == 1 and of_a[0][0] == "1" and len(of_b) == 1 and of_b[0][0] == "None"
    assert sorted(x for x in found if x not in of_a + of_b) == sorted([("4", c), ("1", d), ("None", e), ("7", f)])
    assert {r.source for r in got if (r.text or "").strip()} == {"r"}
    assert sorted(map(str, ((r.doc_id, r.text) for r in got if not (r.text or "").strip()))) == sorted(map(str, bare))


def test_only_rows_that_leak_go(spark, tmp_path, monkeypatch):
    pick = random.Random(3)
    say = lambda n: " ".join("".join(pick.choices("etaoinshr", k=pick.randint(2, 6))) for _ in range(n))
    items = [say(30), say(6), say(3)]
    spark.createDataFrame([*enumerate(items), (9, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    clean = [(k, say(40)) for k in (None, None, 1, 1, 2)] + [(None, None), (3, "")]
    leaking = [(k, f"{say(20)} {x} {say(5)}") for k, x in zip((None, 1, 4), items)]
    docs = spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in clean + leaking], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    for per_block in (20_000, 1):
        monkeypatch.setattr(corpus_pipeline.decontaminate, "ITEMS_PER_BLOCK", per_block)
        got = corpus_pipeline.decontamination_stage(spark, docs, str(tmp_path))
        assert sorted(map(str, ((r.doc_id, r.text) for r in got.collect()))) == sorted(map(str, clean)) and got.columns == docs.columns


def test_pipeline_equals_brute_force(spark, tmp_path):
    from test_corpus_operators import brute_classes, brute_dedup, brute_leaks, sentence
    from test_text_operators import VOCABULARY, naive_language

    import public_tokenizers
    from tokenizers import Tokenizer

    pick = random.Random(7)
    passages = [[sentence(pick, pick.randint(3, 20)) for _ in range(4)] for _ in range(5)]
    items = [(i, sentence(pick, pick.choice([4, 12, 40]))) for i in range(6)]
    whole = [sentence(pick, 90) for _ in range(6)]
    rows = []
    for i in range(130):
        kind, lines = pick.random(), [sentence(pick, pick.randint(5, 60))]
        if kind < 0.3:
            w = pick.choice(whole).split()
            w[pick.randrange(len(w))] = "zz"
            lines = [" ".join(w)]
        elif kind < 0.6:
            lines += pick.choice(passages)
        elif kind < 0.7:
            lines.append(pick.choice(items)[1])
        rows.append((pick.choice([i, i, i + 500]), "\n".join(lines)))
    rows = list({k: (k, t) for k, t in rows}.values())
    rows += [rows[3], rows[3], (700, None), (701, ""), (702, "12 !"), (703, sentence(pick, 9000)), (704, "\n".join(passages[0]))]
    docs = [(k, t, "en", "s", len(t or ""), "k", 1, "n", 2, "r") for k, t in rows]
    schema = "doc_id long, text string, lang string, source string, n_chars long, key string, version int, node string, n_removed int, lang_pred string"
    spark.createDataFrame(docs, schema).repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    table = spark.read.parquet(f"{tmp_path}/documents.parquet")
    model = corpus_pipeline.language.fit(table.where(~corpus_pipeline.language.held_out()))
    kept = [(k, t) for k, t in rows if not naive_language(model, t)[2]]
    assert {k for k, _ in rows} - {k for k, _ in kept} <= {700, 701, 702} | {k for k, t in rows if len(t or "") < 60}
    gone = brute_dedup([(k, t, 0) for k, t in kept])
    cut = [(k, "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone[k, t]), bool(gone[k, t])) for k, t in kept]
    left = [(k, t) for k, t, removed in cut if t.strip() or not removed]
    classes = brute_classes([t for _, t in left], 5, 80)
    least = {}
    for i, (k, _) in enumerate(left):
        least.setdefault(classes[i][1], []).append(k)
    unique = {min(v): None for v in least.values()}
    single = {k: t for k, t in left if k in unique}
    leaks = {d for d, *_ in brute_leaks([*single.items()], items)}
    want = {k: t for k, t in single.items() if k not in leaks}
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id: r.text for r in got} == want and len(got) == len(want) < len({k for k, _ in rows}) - 30 and leaks
    library = Tokenizer.from_file(public_tokenizers.path(VOCABULARY))
    for r in got:
        ids = library.encode(r.text, add_special_tokens=False).ids
        assert r.ids == ids and r.decoded == library.decode(ids, skip_special_tokens=False) and r.n_tokens == len(ids)
