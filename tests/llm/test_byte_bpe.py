"""Byte-level BPE against the tiktoken library."""

import base64
import hashlib
import random
import time

import numpy as np
import pytest

from folioflow.llm import byte_bpe

RANKS = "byte_bpe_multi_50k.tiktoken"
TEXTS = [
    None,
    "",
    " ",
    "a",
    "'s",
    "it's 's \n's ''s !'s a'lll we'REally they're'll've'd 'm'",
    "a  b   c\n\n d \t e　 f\n",
    "x=1;y²=Ⅻ٣ 12 345",
    "中文字 🙂🙂 é é ǅ ﬁ <|endoftext|>",
    "the and of to " * 3000,
    "​\u0085\x1c\x1d\x00'’s",
    "   ",
    "\n \n  x",
]


@pytest.fixture(scope="module")
def library():
    import public_tokenizers as P
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path(RANKS), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def random_texts(n, seed=3):
    pick = random.Random(seed)
    letters = "ab''ststrevemlldD  \n\t12!.é中 　ǅ²🙂"
    return ["".join(pick.choice(letters) for _ in range(pick.randint(0, 40))) for _ in range(n)]


def encode(texts):
    raw = [(t or "").encode() for t in texts]
    offsets = np.cumsum([0, *map(len, raw)])
    bpe = byte_bpe.load(RANKS)
    ids, ends, first = bpe.encode(np.frombuffer(b"".join(raw), np.uint8), offsets)
    assert bpe.decode(ids, ends) == bpe.decode(ids) == b"".join(raw)
    assert [int(ends[j - 1]) for i, j in zip(first, first[1:]) if j > i] == [int(e) for b, e in zip(offsets, offsets[1:]) if e > b]
    return [ids[i:j].tolist() for i, j in zip(first, first[1:])]


def test_ids_equal_library(library):
    texts = TEXTS + random_texts(5000)
    for t, ids in zip(texts, encode(texts)):
        assert ids == library.encode_ordinary(t or ""), t


def test_every_code_point(library):
    import unicodedata

    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000 and unicodedata.category(chr(c)) != "Cn"][:: 7]
    texts = [f"a{c}a1{c}1 {c}!{c}!\n{c}" for c in map(chr, points)]
    assert encode(texts) == library.encode_ordinary_batch(texts)


def test_scan_composes_transitions():
    """The scan gives the states that one step after another gives, over several rows of the matrix."""
    a, pick = byte_bpe.automaton(), np.random.default_rng(5)
    for n in (1, 2, byte_bpe.ROW - 1, byte_bpe.ROW, byte_bpe.ROW + 1, 9 * byte_bpe.ROW + 17):
        kinds = pick.integers(0, 9, n)
        state, states = byte_bpe.FREE, []
        for k in kinds.tolist():
            state = byte_bpe.step(state, k)[0]
            states.append(state)
        assert byte_bpe.scanned(a.of[kinds], a).tolist() == states


def test_composition_is_associative():
    a, pick = byte_bpe.automaton(), np.random.default_rng(6)
    f, g, h = pick.integers(0, len(a.after), (3, 5000))
    assert (a.compose[a.compose[f, g], h] == a.compose[f, a.compose[g, h]]).all()
    assert (a.after[a.compose[f, g], 3] == a.after[g, a.after[f, 3]]).all()


def test_merging_many_equals_merging_one():
    bpe, pick = byte_bpe.load(RANKS), random.Random(4)
    pieces = [bytes(pick.choices(b"theanouri stq", k=pick.randint(2, byte_bpe.SHORT))) for _ in range(3000)]
    for p, ids in zip(pieces, bpe.merge_many(pieces)):
        assert np.frombuffer(ids, np.int32).tolist() == bpe._merge_long(p) == (bpe.merge(p) if p not in bpe.ranks else bpe._merge_long(p)), p


def test_equal_hashes_are_told_apart(library, monkeypatch):
    monkeypatch.setattr(byte_bpe, "range_hashes", lambda data, start, end: np.zeros(len(start), np.uint64))
    texts = ["one two three", "four five one"]
    assert encode(texts) == library.encode_ordinary_batch(texts)


def test_cache_of_two_generations(library, monkeypatch):
    monkeypatch.setattr(byte_bpe, "CACHE_ENTRIES", 5)
    texts = random_texts(200, seed=8)
    for t in texts:
        assert encode([t]) == [library.encode_ordinary(t)]


@pytest.mark.parametrize("text", ["a" * 100_000, "ab" * 50_000, "!" * 50_000 + " " * 50_000 + "x", "中" * 30_000])
def test_very_long_slices(library, text):
    began = time.time()
    ids = encode([text])[0]
    assert time.time() - began < 20
    assert byte_bpe.load(RANKS).decode(np.array(ids)) == text.encode()
    if text[0] == "!":  # the library is quadratic in long runs of letters
        assert ids == library.encode_ordinary(text)


def test_queries(spark, library):
    rows = [("x", i, t, "en", 7) for i, t in enumerate(TEXTS)] + [("x", 3, TEXTS[3], "en", 7), (None, None, "null key", None, None)]
    docs = spark.createDataFrame(rows, "ids string, doc_id long, text string, lang string, id_ends int").repartition(3)
    expected = []
    for _, i, t, *_ in rows:
        ids = library.encode_ordinary(t or "")
        expected.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    order = lambda x: (x[0] is not None, x)
    assert sorted(map(tuple, byte_bpe.digest_texts(docs, RANKS).collect()), key=order) == sorted(expected, key=order)
    encoded = byte_bpe.encode_texts(docs, RANKS)
    assert encoded.columns == ["doc_id", "text", "lang", "ids", "id_ends"]
    for r in byte_bpe.decode_texts(encoded.withColumnRenamed("text", "before"), RANKS).collect():
        assert r["text"] == (r["before"] or "") and r["ids"] == library.encode_ordinary(r["text"])
        assert r["id_ends"] == list(np.cumsum([len(library.decode_single_token_bytes(i)) for i in r["ids"]]))
    assert byte_bpe.digest_texts(docs.limit(0), RANKS).count() == byte_bpe.decode_texts(encoded.limit(0), RANKS).count() == 0
