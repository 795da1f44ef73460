"""Benchmark decontamination by size-partitioned MinHash containment search (operator 3).

Test items are short, documents are long, so the Jaccard similarity of a whole document with an item tells nothing. Items
are therefore partitioned by size, and for each size class every document is seen through windows a quarter longer than
the longest items of that class, one quarter of the class's size on each time. A window and an item that share a MinHash
value under any of ``PERMUTATIONS`` are a candidate, which is verified by the exact part of the item's shingles that the
whole document has. An item that lies wholly in a document is missed with probability below 1e-5, one of which it holds
the least part that counts in one place with probability below 1e-3. Items in several distant parts are in no one window;
each part still gives its own chances (tests split items into up to six parts and miss none). Items of up to ``TINY``
shingles are looked up by every shingle.

Shingles are five words, without case and signs; an item of fewer words has one of all its words, which is compared with
the documents' runs of as many words.

The items are the stated query set: blocks of about ``ITEMS_PER_BLOCK`` are sent to the tasks, and the documents are
passed over once for each block. Where there are several, one is held at a time, and what it finds is written before the
next. Documents are never shuffled.

Edge cases: null, empty or wordless items and documents match nothing; very long documents are taken whole, a few MB of words at a
time; nothing can tie: every pair over the threshold is a row; repeated rows give repeated rows; an empty side gives an
empty result; other columns, whatever their names, are ignored (by ``without_leaks``: kept).
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..store import Steps, cut
from .words import NOT_WORD, shingles, slices, word_hashes

SHINGLE = 5
THRESHOLD = 0.8
PERMUTATIONS = 16
ITEMS_PER_BLOCK = 20_000
#: Items of so many shingles at most need no windows.
TINY = 8
#: The least size class; each further one is larger by the square root of 2.
LEAST_CLASS = 16
#: Shingles of a block; windows are made of whole blocks.
BLOCK = 4

_A = (np.random.default_rng(20).integers(1, 1 << 63, PERMUTATIONS, np.uint64) << np.uint64(1)) | np.uint64(1)


def size_class(n: int) -> int:
    if n <= TINY:
        return 0
    size = float(LEAST_CLASS)
    while size < n:
        size *= 2**0.5
    return int(size)


class Lookup:
    """Items by a 64-bit value; a table of bits turns away most values that no item has."""

    def __init__(self, values: np.ndarray, rows: np.ndarray):
        order = np.argsort(values, kind="stable")
        self.values, self.rows = values[order], rows[order]
        self.bits = np.zeros(1 << 18, bool)
        self.bits[self._place(values)] = True

    @staticmethod
    def _place(values: np.ndarray) -> np.ndarray:
        return (values >> np.uint64(24)) & np.uint64((1 << 18) - 1)

    def find(self, values: np.ndarray) -> list[tuple[int, int]]:
        """(place in values, item) of everything that is equal."""
        at = np.flatnonzero(self.bits[self._place(values)])
        left, right = (np.searchsorted(self.values, values[at], side) for side in ("left", "right"))
        return [(int(at[i]), int(r)) for i in np.flatnonzero(right > left) for r in self.rows[left[i] : right[i]]]


class Items:
    """A block of test items: their shingles, and by length of shingle and size class their MinHash values."""

    def __init__(self, keys: list, texts: list[str | None], k: int = SHINGLE):
        self.keys, self.sets = [], []
        classes: dict[tuple[int, int], list[int]] = defaultdict(list)
        for first, data, offsets in slices(pa.array(texts, pa.string())):
            words, at = word_hashes(data, offsets, NOT_WORD)
            found, begin = shingles(words, at, k)
            for i, n in enumerate(np.diff(at).tolist()):
                if n:
                    unique = np.unique(found[begin[i] : begin[i + 1]])
                    classes[min(k, n), size_class(len(unique))].append(len(self.sets))
                    self.keys.append(keys[first + i])
                    self.sets.append(unique)
        self.tiny: dict[int, Lookup] = {}
        self.classes: dict[int, list[Lookup]] = {}
        for (length, size), rows in classes.items():
            if size == 0:
                self.tiny[length] = Lookup(np.concatenate([self.sets[r] for r in rows]), np.concatenate([np.full(len(self.sets[r]), r) for r in rows]))
            else:
                self.classes[size] = [Lookup(np.array([(self.sets[r] * a).min() for r in rows], np.uint64), np.array(rows)) for a in _A]


def candidates(items: Items, found: np.ndarray, at: np.ndarray) -> set[tuple[int, int]]:
    """(document, item) pairs that share a MinHash value in some window."""
    n = np.diff(at)
    blocks = -(-n // BLOCK)
    owner = np.repeat(np.arange(len(n)), blocks)
    if not len(owner) or not items.classes:
        return set()
    first = np.cumsum(blocks) - blocks
    within = np.arange(len(owner)) - first[owner]
    last = (first + blocks - 1)[owner]
    # A last block or window that isn't full repeats its last member, which changes no minimum.
    parts = [found[at[owner] + np.minimum(within * BLOCK + r, n[owner] - 1)] for r in range(BLOCK)]
    places = np.arange(len(owner))
    widths = {size: -(-size // BLOCK) + -(-size // (4 * BLOCK)) for size in items.classes}
    stops = {size: np.flatnonzero(within % max(1, size // (4 * BLOCK)) == 0) for size in items.classes}
    ahead, width = {}, 1
    while width * 2 <= max(widths.values()):
        ahead[width] = np.minimum(places + width, last)
        width *= 2
    ends = {}
    for size, w in widths.items():
        half = 1 << (w.bit_length() - 1)
        ends[size] = (half, np.minimum(stops[size] + w - half, last[stops[size]]))
    out = set()
    for p, a in enumerate(_A):
        least = parts[0] * a
        for part in parts[1:]:
            np.minimum(least, part * a, out=least)
        by_width, width = {1: least}, 1
        while width in ahead:
            by_width[width * 2] = np.minimum(by_width[width], by_width[width][ahead[width]])
            width *= 2
        for size, tables in items.classes.items():
            half, end = ends[size]
            window = np.minimum(by_width[half][stops[size]], by_width[half][end])
            out.update((int(owner[stops[size][i]]), r) for i, r in tables[p].find(window))
    return out


def search(items: Items, data: np.ndarray, offsets: np.ndarray, threshold: float = THRESHOLD, k: int = SHINGLE) -> list[tuple[int, int, int, int]]:
    """(document, item, shingles of the item, those in the document) of every verified pair."""
    words, first = word_hashes(data, offsets, NOT_WORD)
    out = []
    for length in {*items.tiny, *([k] if items.classes else [])}:
        found, at = shingles(words, first, length)
        # a text of fewer words has a hash of all of them, which no item of this length has
        pairs = candidates(items, found, at) if length == k else set()
        if length in items.tiny:
            owner = np.repeat(np.arange(len(at) - 1), np.diff(at))
            pairs.update((int(owner[i]), r) for i, r in items.tiny[length].find(found))
        last, unique = -1, None
        for doc, item in sorted(pairs):
            if last != doc:
                last, unique = doc, np.unique(found[at[doc] : at[doc + 1]])
            q = items.sets[item]
            shared = int(np.isin(q, unique, assume_unique=True).sum())
            if shared >= threshold * len(q):
                out.append((doc, item, len(q), shared))
    return out


def block_count(benchmark: DataFrame) -> int:
    return max(1, -(-benchmark.count() // ITEMS_PER_BLOCK))


def item_blocks(benchmark: DataFrame, item: str, item_text: str, blocks: int) -> Iterator[Items]:
    """All test items, in blocks, one after the other."""
    rows = benchmark.select(F.col(item).alias("item"), F.col(item_text).alias("text"))
    for i in range(blocks):
        # a block is a share of the items by hash; one and a half times the mean bounds it, and a hash of the text parts them further
        held = rows.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == i).collect() if blocks > 1 else rows.collect()
        yield Items([r["item"] for r in held], [r["text"] for r in held])


def find_leaks(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Pairs of a document and a test item of which it holds at least ``threshold``."""
    kinds = docs.schema[key].dataType.simpleString(), benchmark.schema[item].dataType.simpleString()
    schema = f"{key} {kinds[0]}, {item} {kinds[1]}, n_item_shingles bigint, n_shared bigint, containment double"

    def leaks(block: Items) -> DataFrame:
        def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in it:
                for row, data, offsets in slices(b.column(1)):
                    hits = search(block, data, offsets, threshold)
                    if hits:
                        doc, item_, size, shared = (np.array(x) for x in zip(*hits))
                        yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(doc + row)), pa.array([block.keys[j] for j in item_]), pa.array(size), pa.array(shared), pa.array(shared / size)], names=[key, item, "n_item_shingles", "n_shared", "containment"])

        return docs.select(F.col(key), F.col(text)).mapInArrow(batches, schema)

    blocks = block_count(benchmark)
    found = None
    for block in item_blocks(benchmark, item, item_text, blocks):
        part = leaks(block) if blocks == 1 else cut(leaks(block), "leaks")
        found = part if found is None else found.unionByName(part)
    return found


def without_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose own text holds less than ``threshold`` of every test item, whatever their keys are."""
    at = docs.columns.index(text)

    def clean(rows: DataFrame, block: Items) -> DataFrame:
        def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in it:
                stays = np.ones(b.num_rows, bool)
                for row, data, offsets in slices(b.column(at)):
                    stays[[row + doc for doc, *_ in search(block, data, offsets, threshold)]] = False
                yield b.filter(pa.array(stays))

        return rows.mapInArrow(batches, rows.schema)

    blocks = block_count(benchmark)
    with Steps(docs.sparkSession) as steps:
        before = None
        for block in item_blocks(benchmark, item, item_text, blocks):
            docs = clean(docs, block)
            if blocks > 1:
                docs = steps.cut(docs, "clean")
                if before is not None:
                    steps.drop(before)
                before = docs
        if before is not None:
            steps.keep(before)
    return docs


ORACLE = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
q AS (SELECT item_id, row_number() OVER () AS q, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
qk AS (SELECT *, least(5, len(w)) AS k FROM q WHERE len(w) > 0),
qs AS (SELECT DISTINCT item_id, q, k, array_to_string(w[i:i + k - 1], ' ') AS s FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS i FROM qk)),
ks AS (SELECT DISTINCT k FROM qk),
ds AS (SELECT DISTINCT doc_id, r, k, array_to_string(w[i:i + k - 1], ' ') AS s FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS i FROM d, ks WHERE len(w) >= k)),
sizes AS (SELECT q, count(*) AS n FROM qs GROUP BY q),
hits AS (SELECT r, doc_id, q, item_id, count(*) AS shared FROM ds JOIN qs USING (k, s) GROUP BY r, doc_id, q, item_id)
SELECT doc_id, item_id, n AS n_item_shingles, shared AS n_shared, shared / n AS containment FROM hits JOIN sizes USING (q) WHERE shared >= 0.8 * n
"""
