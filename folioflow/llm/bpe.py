"""BPE encoding and decoding by a contiguous rank array (operator 5).

Each word is a short array of parts with the merge rank of every adjacent pair beside it. The least rank is found by a
scan, its boundary is deleted, and the ranks of the two neighbours are refreshed, until no pair can merge. Words of over
``SCAN_LIMIT`` parts aren't the short words that the method is for: they keep the same ranks in a heap over a linked list, so
that a text without blanks stays near-linear. Both give what the public tokenizer gives.

Edge cases: a null text is an empty text (no ids, empty decoded text); an empty table has no rows; very long texts are taken
whole; pairs of equal rank (ties) merge from the left; a repeated row gives a repeated row, and null keys stay; other columns
are left alone, whatever their names, but for those that are added; the strings of special tokens inside a text become their
ids, as in the library's default.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import os
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: Words of more parts than this keep their ranks in a heap: a scan's time grows with the square of the length, and the
#: rank array is for short words. The ids are the same.
SCAN_LIMIT = 96
#: Encoded blank-free runs that a Python worker remembers: so many new ones, and those that it remembered before them.
CACHE_ENTRIES = 150_000
#: Longer runs are not remembered.
CACHE_CHARS = 64

_NONE = 1 << 60


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    out, free = [""] * 256, 256
    for b in range(256):
        if b in set(shown):
            out[b] = chr(b)
        else:
            out[b] = chr(free)
            free += 1
    return out


class WordBpe:
    """A vocabulary of the ``tokenizers`` library: NFC, lower case, words and single digits, merges with word ends."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.end: str = model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = [""] * (max([*self.vocab.values(), *self.special.values()]) + 1)
        for t, i in (*self.vocab.items(), *self.special.items()):
            self.tokens[i] = t
        symbols = byte_symbols()
        self.inner = [self.vocab[s] for s in symbols]
        self.last = [self.vocab[s + self.end] for s in symbols]
        self.merges: dict[int, tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merges.setdefault(self.vocab[a] << 20 | self.vocab[b], (rank, self.vocab[a + b]))
        pattern = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")["pattern"]["Regex"]
        self.words = regex.compile(pattern).findall
        self.specials = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")").split if self.special else None
        self.blank = regex.compile(r"\s+").split
        self.runs: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    @staticmethod
    def normal(text: str) -> str:
        """NFC, then each character's own lower case (no rule for a sigma at a word's end)."""
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()

    def merge(self, parts: list[int]) -> list[int]:
        """The rank array: scan for the least rank, delete that boundary, refresh the neighbours."""
        if len(parts) > SCAN_LIMIT:
            return self._merge_long(parts)
        merges, none = self.merges, (_NONE, -1)
        ranks = [merges.get(a << 20 | b, none) for a, b in zip(parts, parts[1:])]
        while ranks:
            least = min(ranks)
            if least[0] == _NONE:
                break
            i = ranks.index(least)
            parts[i] = least[1]
            del parts[i + 1], ranks[i]
            if i:
                ranks[i - 1] = merges.get(parts[i - 1] << 20 | parts[i], none)
            if i < len(ranks):
                ranks[i] = merges.get(parts[i] << 20 | parts[i + 1], none)
        return parts

    def _merge_long(self, parts: list[int]) -> list[int]:
        n, merges = len(parts), self.merges
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(m[0], i, parts[i], parts[i + 1], m[1]) for i in range(n - 1) if (m := merges.get(parts[i] << 20 | parts[i + 1]))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b, new = heapq.heappop(heap)
            j = after[i]
            if parts[i] != a or j < 0 or parts[j] != b:
                continue
            parts[i], parts[j] = new, -1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if m := merges.get(new << 20 | parts[k]):
                    heapq.heappush(heap, (m[0], i, new, parts[k], m[1]))
            if (h := before[i]) >= 0 and (m := merges.get(parts[h] << 20 | new)):
                heapq.heappush(heap, (m[0], h, parts[h], new, m[1]))
        return [p for p in parts if p >= 0]

    def word(self, word: str) -> list[int]:
        b = word.encode()
        return self.merge([*map(self.inner.__getitem__, b[:-1]), self.last[b[-1]]])

    def run(self, run: str) -> bytes:
        """The ids of a text without blanks, as little-endian 32-bit numbers."""
        ids = self.older.get(run)
        if ids is None:
            out: list[int] = []
            for w in self.words(self.normal(run)):
                out += self.word(w)
            ids = np.array(out, "<u4").tobytes()
        if len(run) <= CACHE_CHARS:
            if len(self.runs) >= CACHE_ENTRIES:
                self.older, self.runs = self.runs, {}
            self.runs[run] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """The ids of a whole text, as little-endian 32-bit numbers. Blanks never join words, so runs are independent."""
        if self.specials and "<|" in text:
            return b"".join(np.array([self.special[p]], "<u4").tobytes() if p in self.special else self._plain(p) for p in self.specials(text))
        return self._plain(text)

    def _plain(self, text: str) -> bytes:
        if any(c in text for c in "\x1c\x1d\x1e\x1f"):  # blanks for Python, not for the vocabulary's pattern
            parts = [p for p in self.blank(text) if p]
        else:
            parts = text.split()
        return b"".join([self.runs.get(p) or self.run(p) for p in parts])

    def decode(self, ids: bytes) -> str:
        """The library's text for ids without a decoder: the tokens with a space between."""
        return " ".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(maxsize=2)
def load(path: str) -> WordBpe:
    """A vocabulary file; a bare name is one of the public tokenizers installed where the task runs."""
    if not os.path.isabs(path):
        import public_tokenizers

        path = public_tokenizers.path(path)
    return WordBpe(path)


def encode_texts(docs: DataFrame, vocabulary: str, text: str = "text", ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """``docs`` with an array<int> column of token ids, and with the text that they decode to if a name is given."""
    from pyspark.sql import types as T

    schema = T.StructType([f for f in docs.schema.fields if f.name not in (ids, decoded)])
    schema = schema.add(ids, T.ArrayType(T.IntegerType(), False)).add(decoded, T.StringType()) if decoded else schema.add(ids, T.ArrayType(T.IntegerType(), False))
    keep = [f.name for f in docs.schema.fields if f.name not in (ids, decoded)]

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(vocabulary)
        for b in it:
            texts = b.column(b.schema.get_field_index(text))
            for i in range(0, b.num_rows, 256):
                found = [bpe.encode(t.as_py() or "") for t in texts[i : i + 256]]
                ends = np.concatenate([[0], np.cumsum([len(x) // 4 for x in found])]).astype(np.int32)
                cols = [b.column(b.schema.get_field_index(c))[i : i + 256] for c in keep]
                cols.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(found), np.int32))))
                names = [*keep, ids]
                if decoded:
                    cols.append(pa.array([bpe.decode(x) for x in found], pa.string()))
                    names.append(decoded)
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return docs.select("*").mapInArrow(batches, schema)


def digest_texts(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: the number of ids, and the SHA-256 of the ids and of the text decoded from them.

    The digests are made where the ids are: neither ids nor texts leave the task.
    """

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(vocabulary)
        for b in it:
            n, ids_hash, text_hash = [], [], []
            for t in b.column(1):
                ids = bpe.encode(t.as_py() or "")
                n.append(len(ids) // 4)
                ids_hash.append(hashlib.sha256(ids).hexdigest())
                text_hash.append(hashlib.sha256(bpe.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids_hash, pa.string()), pa.array(text_hash, pa.string())], names=[key, "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(batches, f"{key} {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
