"""Byte-level BPE encoding and decoding with vectorised pre-tokenisation (operator 11).

The pattern of the vocabulary is compiled by hand into a small automaton over classes of code points, and runs without regex:

1. Every code point of a batch of texts gets a class from one lookup table. What the pattern looks ahead for (a blank before
   something else, the letters after an apostrophe) is read off the neighbouring classes and makes a class of its own.
2. A class is a function from the state before a character to the state after it. Composition is associative, and the
   functions that can arise are few (the transition monoid), so composing two is one table lookup. A prefix scan composes
   them: within rows of a matrix all rows at once, then the rows' totals in log2 steps, then the state before each row is
   applied to what stands in it. State and class say whether a slice begins at a character.
3. Equal slices of a batch are found by hash and compared byte by byte; each distinct one is merged once, by pairs of least
   rank, through a cache that a worker keeps; those that it doesn't have are merged together, a step of all of them at a time.
   The ids of a text are gathered from those of its slices.
4. The end of every id in the text's bytes is kept. Decoding puts each id's bytes between these ends.

Edge cases: a null text is an empty text (no ids, empty decoded text); an empty table has no rows; very long texts are taken
whole, and slices of over ``SCAN_LIMIT`` bytes merge through a heap, so that a text of one letter stays near-linear; pairs of equal
rank (ties) merge from the left; a repeated row gives a repeated row, and null keys stay; other columns are left alone,
whatever their names, but for those that are added; the strings of special tokens are ordinary text.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import os
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, types as T

from .words import range_hashes, slices

#: Slices of more bytes than this keep the ranks of their pairs in a heap. The ids are the same.
SCAN_LIMIT = 96
#: Slices of so many bytes are merged many at a time.
SHORT = 32
#: No rank.
NONE = np.int32((1 << 31) - 1)
#: Distinct slices that a worker remembers: so many new ones, and those that it remembered before them.
CACHE_ENTRIES = 150_000
#: Longer slices are not remembered.
CACHE_BYTES = 64
#: Bytes of texts that are arrays at a time.
SLICE_BYTES = 1 << 20
#: Characters in a row of the matrix that is scanned.
ROW = 128

#: The classes of code points, and those that depend on what follows: a blank that something else than a blank
#: follows, and an apostrophe that begins one of the endings 's 't 'm 'd (one letter) or 're 've 'll (two).
LETTER, NUMBER, OTHER, SPACE, BLANK, ONE, TWO, LAST_SPACE, LAST_BLANK = range(9)
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")
#: States after a character: a new slice must begin; inside letters, numbers, others; after a space that joins what follows;
#: inside blanks; one or two letters of an ending to come.
FREE, IN_LETTERS, IN_NUMBERS, IN_OTHERS, JOINING, IN_BLANKS, ONE_MORE, TWO_MORE = range(8)
STATES = 8


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """The class of every code point, by its Unicode category. Characters that a newer Unicode than Python's adds are others."""
    kinds = {"L": LETTER, "N": NUMBER, "Z": BLANK}
    out = np.array([kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(sys.maxunicode + 1)], np.uint8)
    out[[*range(0x09, 0x0E), 0x85]] = BLANK
    out[0x20] = SPACE
    return out


def step(state: int, kind: int) -> tuple[int, bool]:
    """The state after a character of a class, and whether a slice begins with it."""
    if state == TWO_MORE:
        return ONE_MORE, False
    if state == ONE_MORE:
        return FREE, False
    inside = {LETTER: IN_LETTERS, NUMBER: IN_NUMBERS, OTHER: IN_OTHERS}
    if kind in inside:
        return inside[kind], state not in (inside[kind], JOINING)
    if kind in (ONE, TWO):
        return (IN_OTHERS, False) if state in (IN_OTHERS, JOINING) else (ONE_MORE if kind == ONE else TWO_MORE, True)
    if kind == LAST_SPACE:
        return JOINING, True
    if kind == LAST_BLANK:
        return FREE, True
    return IN_BLANKS, state != IN_BLANKS


class Automaton:
    """The transition monoid: ``compose[f, g]`` is f then g, ``after[f, state]`` applies f, ``of`` has the function of each class
    (the second half: at the beginning of a text, whatever the state), ``begins`` whether a slice begins."""

    def __init__(self) -> None:
        kinds = 9
        plain = [tuple(step(s, k)[0] for s in range(STATES)) for k in range(kinds)]
        first = [(step(FREE, k)[0],) * STATES for k in range(kinds)]
        known: dict[tuple[int, ...], int] = {tuple(range(STATES)): 0}
        for f in plain + first:
            known.setdefault(f, len(known))
        todo = list(known)
        while todo:  # closed under composition
            f = todo.pop()
            for g in list(known):
                for h in (tuple(g[s] for s in f), tuple(f[s] for s in g)):
                    if h not in known:
                        known[h] = len(known)
                        todo.append(h)
        functions = list(known)
        self.compose = np.array([[known[tuple(g[s] for s in f)] for g in functions] for f in functions], np.uint16)
        self.after = np.array(functions, np.uint8)
        self.of = np.array([known[f] for f in plain + first], np.uint16)
        self.begins = np.array([[step(s, k)[1] for k in range(kinds)] for s in range(STATES)])


@lru_cache(maxsize=1)
def automaton() -> Automaton:
    return Automaton()


def scanned(functions: np.ndarray, a: Automaton) -> np.ndarray:
    """The state after each character: an inclusive prefix scan of the functions, from ``FREE``."""
    n = len(functions)
    rows = -(-n // ROW)
    grid = np.zeros(rows * ROW, np.uint16)
    grid[:n] = functions
    grid = np.ascontiguousarray(grid.reshape(rows, ROW).T)  # a step is one contiguous line
    for j in range(1, ROW):
        grid[j] = a.compose[grid[j - 1], grid[j]]
    total, reach = grid[-1].copy(), 1
    while reach < rows:  # Hillis and Steele, over rows
        total[reach:] = a.compose[total[:-reach], total[reach:]]
        reach *= 2
    entry = np.full(rows, FREE, np.uint8)
    entry[1:] = a.after[total[:-1], FREE]
    return a.after[grid, entry].T.reshape(-1)[:n]


def lookahead(points: np.ndarray, first: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """Classes with what follows taken in; nothing is seen beyond the end of a text (``first``: begins a text)."""
    n = len(points)
    out = kinds.copy()
    blank = (kinds == SPACE) | (kinds == BLANK)
    before_other = np.zeros(n, bool)
    before_other[:-1] = blank[:-1] & ~blank[1:] & ~first[1:]
    out[before_other & (kinds == SPACE)] = LAST_SPACE
    out[before_other & (kinds == BLANK)] = LAST_BLANK
    marks = np.flatnonzero(points[:-1] == ord("'")) if n > 1 else np.zeros(0, np.int64)
    for ending in ENDINGS:
        at = marks[marks + len(ending) < n]
        fits = np.ones(len(at), bool)
        for i, letter in enumerate(ending, 1):
            fits &= (points[at + i] == ord(letter)) & ~first[at + i]
        out[at[fits]] = ONE if len(ending) == 1 else TWO
    return out


def boundaries(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where slices begin in the UTF-8 bytes of several texts (``offsets``: the texts' begins and the end)."""
    points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
    if not len(points):
        return np.zeros(0, np.int64)
    place = np.flatnonzero((data & 0xC0) != 0x80)  # of each character's first byte
    first = np.zeros(len(points), bool)
    begun = np.searchsorted(place, offsets[:-1][offsets[:-1] < offsets[1:]])
    first[begun] = True
    a, kinds = automaton(), classes()[points]
    kinds = lookahead(points, first, kinds)
    states = scanned(a.of[kinds + np.where(first, 9, 0)], a)
    before = np.empty(len(points), np.uint8)
    before[0], before[1:] = FREE, states[:-1]
    before[first] = FREE
    return place[a.begins[before, kinds]]


def gather(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of each of several ranges, one after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


class ByteBpe:
    """A rank file of the ``tiktoken`` library."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks: dict[bytes, int] = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self.tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.size = np.array([len(t) for t in self.tokens], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.bytes = np.frombuffer(b"".join(self.tokens), np.uint8)
        self.single = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        self._pairs()
        self.new: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def _pairs(self) -> None:
        """The rank of every pair of tokens that can be joined, in a table with open addresses."""
        joined = {}
        for token, rank in self.ranks.items():
            for i in range(1, len(token)):
                if (a := self.ranks.get(token[:i])) is not None and (b := self.ranks.get(token[i:])) is not None:
                    joined[a << 32 | b] = rank
        self.shift = np.uint64(64 - max(4, (4 * len(joined)).bit_length()))
        keys, ranks = np.fromiter(joined.keys(), np.int64, len(joined)), np.fromiter(joined.values(), np.int32, len(joined))
        size = 1 << (64 - int(self.shift))
        self.keys, self.rank_of, self.probes = np.full(size, -1, np.int64), np.full(size, NONE, np.int32), 1
        at = self._slot(keys)
        while len(keys):
            free = self.keys[at] < 0
            _, one = np.unique(at[free], return_index=True)  # one a slot
            now = np.flatnonzero(free)[one]
            self.keys[at[now]], self.rank_of[at[now]] = keys[now], ranks[now]
            left = np.ones(len(keys), bool)
            left[now] = False
            keys, ranks, at = keys[left], ranks[left], (at[left] + 1) % size
            self.probes += len(keys) > 0

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def pair_ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair of ids; ``NONE`` if they can't be joined, or one of them is no id (-1)."""
        keys = a.astype(np.int64) << 32 | b
        at = self._slot(keys)
        out = np.where(self.keys[at] == keys, self.rank_of[at], NONE)
        todo = np.flatnonzero((self.keys[at] != keys) & (self.keys[at] >= 0))
        for _ in range(self.probes):
            if not len(todo):
                break
            at[todo] = (at[todo] + 1) % len(self.keys)
            own = self.keys[at[todo]]
            hit = own == keys[todo]
            out[todo[hit]] = self.rank_of[at[todo[hit]]]
            todo = todo[~hit & (own >= 0)]
        out[(a < 0) | (b < 0)] = NONE
        return out

    def merge_many(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of many short slices at once: a row of parts for each, the rank of every pair beside it. In every row that
        has one, the pair of least rank is joined, what follows moves up, and the ranks of its neighbours are refreshed."""
        out = [b""] * len(pieces)
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        order = np.argsort(sizes, kind="stable")
        for at in range(0, len(order), 2048):  # of about one length
            some = order[at : at + 2048]
            width = int(sizes[some[-1]])
            columns = np.arange(width)
            parts = np.full((len(some), width + 1), -1, np.int32)
            parts[:, :width][columns < sizes[some][:, None]] = self.single[np.frombuffer(b"".join([pieces[i] for i in some.tolist()]), np.uint8)]
            ranks = self.pair_ranks(parts[:, :-1].ravel(), parts[:, 1:].ravel()).reshape(len(some), width)
            while True:
                place = ranks.argmin(1)
                least = ranks[np.arange(len(some)), place]
                if (ended := least == NONE).any():
                    flat = parts[ended]
                    ends = 4 * np.cumsum((flat >= 0).sum(1))
                    flat, begin = flat[flat >= 0].tobytes(), 0
                    for i, end in zip(some[ended].tolist(), ends.tolist()):
                        out[i] = flat[begin:end]
                        begin = end
                    go = ~ended
                    some, parts, ranks, place, least = some[go], parts[go], ranks[go], place[go], least[go]
                    if not len(some):
                        break
                row, after = np.arange(len(some)), columns > place[:, None]
                parts[:, :-1] = np.where(after, parts[:, 1:], parts[:, :-1])
                ranks[:, :-1] = np.where(after[:, :-1], ranks[:, 1:], ranks[:, :-1])
                ranks[:, -1] = NONE
                parts[row, place] = least
                ranks[row, place] = self.pair_ranks(least, parts[row, place + 1])
                left = np.flatnonzero(place > 0)
                ranks[left, place[left] - 1] = self.pair_ranks(parts[left, place[left] - 1], least[left])
        return out

    def merge(self, piece: bytes) -> list[int]:
        """The ids of a slice: the adjacent pair of least rank is joined, from the left, until none has a rank."""
        if (whole := self.ranks.get(piece)) is not None:
            return [whole]
        if len(piece) > SCAN_LIMIT:
            return self._merge_long(piece)
        ranks, none = self.ranks.get, len(self.tokens)
        parts = [piece[i : i + 1] for i in range(len(piece))]
        pairs = [ranks(x + y, none) for x, y in zip(parts, parts[1:])]
        while pairs and (least := min(pairs)) < none:
            i = pairs.index(least)
            parts[i] += parts.pop(i + 1)
            del pairs[i]
            if i:
                pairs[i - 1] = ranks(parts[i - 1] + parts[i], none)
            if i < len(pairs):
                pairs[i] = ranks(parts[i] + parts[i + 1], none)
        return [self.ranks[p] for p in parts]

    def _merge_long(self, piece: bytes) -> list[int]:
        n, ranks = len(piece), self.ranks.get
        end, before = [*range(1, n + 1)], [*range(-1, n)]  # of the part that begins at each place; end 0: none begins there
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            middle = end[i]
            if not 0 < middle < n or end[middle] != stop:
                continue
            end[i], end[middle] = stop, 0
            if stop < n:
                before[stop] = i
                if (r := ranks(piece[i : end[stop]])) is not None:
                    heapq.heappush(heap, (r, i, end[stop]))
            if (h := before[i]) >= 0 and (r := ranks(piece[h:stop])) is not None:
                heapq.heappush(heap, (r, h, stop))
        return [self.ranks[piece[i : end[i]]] for i in range(n) if end[i]]

    def ids(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each slice, as 32-bit numbers, from the cache where it has them."""
        out = [*map(self.new.get, pieces)]
        unseen = [i for i, x in enumerate(out) if x is None]
        for i in unseen:
            out[i] = self.older.get(pieces[i])
        fresh = [i for i in unseen if out[i] is None]
        for i in fresh:
            if (whole := self.ranks.get(pieces[i])) is not None:
                out[i] = whole.to_bytes(4, sys.byteorder)
            elif len(pieces[i]) > SHORT:
                out[i] = np.array(self.merge(pieces[i]), np.int32).tobytes()
        short = [i for i in fresh if out[i] is None]
        for i, x in zip(short, self.merge_many([pieces[i] for i in short])):
            out[i] = x
        for i in unseen:
            if len(pieces[i]) <= CACHE_BYTES:
                if len(self.new) >= CACHE_ENTRIES:
                    self.older, self.new = self.new, {}
                self.new[pieces[i]] = out[i]
        return out

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of several texts, where each id ends in ``data``, and where the ids of each text begin (and end)."""
        start = boundaries(data, offsets)
        size = np.diff(np.append(start, len(data)))
        if not len(start):
            return np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
        kind, example = self._distinct(data, start, size)
        raw = data.tobytes()
        each = self.ids([raw[i:j] for i, j in zip(start[example].tolist(), (start + size)[example].tolist())])
        count = np.fromiter(map(len, each), np.int64, len(each)) // 4
        begin = np.cumsum(count) - count
        ids = np.frombuffer(b"".join(each), np.int32)[gather(begin[kind], count[kind])]
        first = np.concatenate([[0], np.cumsum(count[kind])])
        return ids, np.cumsum(self.size[ids]), first[np.searchsorted(start, offsets)]

    @staticmethod
    def _distinct(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each slice which distinct one it is, and an example of each. Equal hashes are compared byte by byte."""
        kind, found = pd.factorize(range_hashes(data, start, start + size))
        example = np.empty(len(found), np.int64)
        example[kind[::-1]] = np.arange(len(kind))[::-1]
        model = example[kind]
        same = np.array_equal(size, size[model]) and np.array_equal(data, data[gather(start[model], size)])
        if not same:  # two slices of one hash: by their bytes
            raw = data.tobytes()
            kind, _ = pd.factorize(np.array([raw[i : i + n] for i, n in zip(start, size)], object))
            example = np.unique(kind, return_index=True)[1]
        return kind, example

    def decode(self, ids: np.ndarray, ends: np.ndarray | None = None) -> bytes:
        """The bytes of ids. ``ends``, as ``encode`` has them, say where each id's bytes go; else their sizes do."""
        size = self.size[ids] if ends is None else np.diff(ends, prepend=0)
        return self.bytes[gather(self.start[ids], size)].tobytes()


@lru_cache(maxsize=2)
def load(path: str) -> ByteBpe:
    """A rank file; a bare name is one of the public tokenizers installed where the task runs."""
    if not os.path.isabs(path):
        import public_tokenizers

        path = public_tokenizers.path(path)
    return ByteBpe(path)


def encode_texts(docs: DataFrame, vocabulary: str, text: str = "text", ids: str = "ids", ends: str = "id_ends") -> DataFrame:
    """``docs`` with an array<int> of token ids and an array<int> of the byte where each of them ends in the text."""
    keep = [f for f in docs.schema.fields if f.name not in (ids, ends)]
    schema = T.StructType([*keep, T.StructField(ids, T.ArrayType(T.IntegerType(), False)), T.StructField(ends, T.ArrayType(T.IntegerType(), False))])

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(vocabulary)
        for b in it:
            for row, data, offsets in slices(b.column(b.schema.get_field_index(text)), SLICE_BYTES):
                found, end, first = bpe.encode(data, offsets)
                counts = np.diff(first)
                end = end - np.repeat(offsets[:-1], counts)
                lists = [pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(x.astype(np.int32))) for x in (found, end)]
                cols = [b.column(b.schema.get_field_index(f.name)).slice(row, len(counts)) for f in keep]
                yield pa.RecordBatch.from_arrays([*cols, *lists], names=[f.name for f in keep] + [ids, ends])

    return docs.select("*").mapInArrow(batches, schema)


def decode_texts(encoded: DataFrame, vocabulary: str, ids: str = "ids", ends: str | None = "id_ends", text: str = "text") -> DataFrame:
    """``encoded`` with the text of its ids (bytes that are no UTF-8 become replacement characters); null ids are none."""
    keep = [f for f in encoded.schema.fields if f.name != text]

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(vocabulary)
        for b in it:
            own = b.column(b.schema.get_field_index(ids))
            end = b.column(b.schema.get_field_index(ends)) if ends else None
            out = []
            for i in range(b.num_rows):
                row = np.array(own[i].as_py() or [], np.int64)
                stop = None if end is None or not end[i].is_valid else np.array(end[i].as_py(), np.int64)
                out.append(bpe.decode(row, stop).decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(f.name)) for f in keep), pa.array(out, pa.string())], names=[f.name for f in keep] + [text])

    return encoded.select("*").mapInArrow(batches, T.StructType([*keep, T.StructField(text, T.StringType())]))


def digest_texts(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: the number of ids, and the SHA-256 of the ids and of the bytes decoded from them.

    The digests are made where the ids are: neither ids nor texts leave the task.
    """

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(vocabulary)
        number = [b"%d," % i for i in range(len(bpe.tokens))]
        number_size = np.array([len(x) for x in number], np.int64)
        number_start, numbers = np.cumsum(number_size) - number_size, np.frombuffer(b"".join(number), np.uint8)
        for b in it:
            for row, data, offsets in slices(b.column(1), SLICE_BYTES):
                ids, ends, first = bpe.encode(data, offsets)
                decoded = bpe.decode(ids, ends)
                written = numbers[gather(number_start[ids], number_size[ids])].tobytes()
                cut = np.concatenate([[0], np.cumsum(number_size[ids])])[first].tolist()
                end = np.concatenate([[0], ends])[first].tolist()
                sha = lambda x: hashlib.sha256(x).hexdigest()
                spans = range(len(offsets) - 1)
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0).slice(row, len(offsets) - 1),
                        pa.array(np.diff(first), pa.int64()),
                        pa.array([sha(written[cut[i] : max(cut[i], cut[i + 1] - 1)]) for i in spans], pa.string()),
                        pa.array([sha(decoded[end[i] : end[i + 1]]) for i in spans], pa.string()),
                    ],
                    names=[key, "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(batches, f"{key} {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
