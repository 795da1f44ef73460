"""Token counts by a compiled finite-state transducer (operator 7).

The tokenizer is one deterministic transducer over the characters of the normalised text. Its states hold what is open of
the current piece (word, run of signs, or a contraction such as ``'re``) and, for the merges, the last token at every place
where a longer token could still begin; every transition carries the number of tokens that it adds to the count of the
text so far (it may take some back when a longer token forms). States and transitions are compiled when first met and kept
in a hash table of numpy arrays, so that all chunks of a batch step through the text together.

A text is cut into chunks of ``CHUNK`` characters, anywhere. A chunk maps the state before it to a state and a count after it.
Its map has the states that occur: first the one that ``WARM`` characters before the chunk lead to from the start state, as states
soon forget what was before them; and an exit that is no entry of the next chunk's map becomes one, for all chunks at once. The
maps are composed by a parallel prefix scan, in as many steps as the logarithm of a text's chunks. So the counts are exact, and a
text without blanks takes as long as one with them once its transitions are compiled.

Edge cases: a null or empty text has 0 bytes and 0 tokens; an empty table has no rows; repeated rows give repeated rows, and null
keys stay; very long texts are taken whole; nothing can tie; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, functions as F

from .bpe import WordBpe, load

#: Characters of a chunk.
CHUNK = 1024
#: Characters before a chunk that guess the state in which it is entered.
WARM = 48
#: Characters that are stepped through together.
SLICE_CHARS = 2_000_000
#: Compiled transitions that a worker keeps; it starts afresh when there are more.
MAX_TRANSITIONS = 1_200_000

#: Stands for a special token inside a text: one past the last character.
SPECIAL = 0x110000

_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
_SPREAD = np.uint64(0x9E3779B97F4A7C15)
_START = ("start",)


class CountTransducer:
    def __init__(self, bpe: WordBpe):
        self.bpe = bpe
        byte_of = {s: b for b, s in enumerate(bpe_symbols())}
        #: Trie of the vocabulary over symbols: a byte, or 256 + a word's last byte.
        self.next: list[dict[int, int]] = [{}]
        self.token: list[int] = [-1]
        self.spelled: dict[int, list[int]] = {}
        for t, i in bpe.vocab.items():
            last = bool(bpe.end) and t.endswith(bpe.end)
            body = t[: -len(bpe.end)] if last else t
            symbols = [byte_of[c] for c in body]
            if last:
                symbols[-1] += 256
            self.spelled[i] = symbols
            node = 0
            for s in symbols:
                if s not in self.next[node]:
                    self.next[node][s] = len(self.next)
                    self.next.append({})
                    self.token.append(-1)
                node = self.next[node][s]
            self.token[node] = i
        self.fits: dict[int, bool] = {}
        self.kinds: dict[str, str] = {}
        self.is_letter, self.is_digit = regex.compile(r"\p{L}").match, regex.compile(r"\p{N}").match
        blank = regex.compile(r"\s").match
        self.resets = np.zeros(SPECIAL + 1, bool)
        self.resets[[c for c in range(0x3001) if blank(chr(c))]] = True
        self.resets[SPECIAL] = True
        self.clear()

    def clear(self) -> None:
        self.opens: list[tuple] = [((), -1)]  # states of the merges
        self.open_ids: dict[tuple, int] = {self.opens[0]: 0}
        self.steps: dict[int, tuple[int, int]] = {}
        self.states: list[tuple] = [_START]
        self.ids: dict[tuple, int] = {_START: 0}
        self._table(1 << 16)

    # -- merges

    def compatible(self, left: int, right: int) -> bool:
        """Whether ``right`` stays a token of its own after ``left`` (-1: at a word's start)."""
        key = (left + 1) << 20 | right
        if (known := self.fits.get(key)) is None:
            inner, last = self.bpe.inner, self.bpe.last
            symbols = (self.spelled[left] if left >= 0 else []) + self.spelled[right]
            whole = self.bpe.merge([inner[s] if s < 256 else last[s - 256] for s in symbols])
            if len(self.fits) > 4_000_000:
                self.fits.clear()
            known = self.fits[key] = whole == ([left, right] if left >= 0 else [right])
        return known

    def step_symbol(self, q: int, symbol: int) -> tuple[int, int]:
        """After one more symbol of a word: the state, and how many tokens the word so far has gained."""
        key = q << 9 | symbol
        if known := self.steps.get(key):
            return known
        entries, last = self.opens[q]
        live, found = [], None
        for node, before, count in (*entries, (0, last, 0)):
            child = self.next[node].get(symbol)
            if child is None:
                continue
            token = self.token[child]
            if found is None and token >= 0 and self.compatible(before, token):
                found = (token, count + 1)
            if self.next[child]:
                live.append((child, before, count))
        if found is None:
            raise AssertionError("the vocabulary has no token for a byte")
        token, gain = found
        state = (tuple((n, b, c - gain) for n, b, c in live), token)
        if (i := self.open_ids.get(state)) is None:
            i = self.open_ids[state] = len(self.opens)
            self.opens.append(state)
        self.steps[key] = (i, gain)
        return i, gain

    def step_char(self, q: int, char: str, last: bool = False) -> tuple[int, int]:
        total, data = 0, char.encode()
        for k, b in enumerate(data):
            q, gain = self.step_symbol(q, b + 256 * (last and k == len(data) - 1))
            total += gain
        return q, total

    # -- pieces

    def kind(self, char: str) -> str:
        if (k := self.kinds.get(char)) is None:
            k = self.kinds[char] = "word" if self.is_letter(char) else "digit" if self.is_digit(char) else "blank" if self.resets[ord(char)] else "sign"
        return k

    def close(self, state: tuple) -> int:
        """Tokens that are added when the text ends here."""
        if state == _START:
            return 0
        if state[0] == "mark":  # an apostrophe, and a letter that may make a contraction
            return sum(self.step_char(0, c, True)[1] for c in state[1])
        return self.step_char(state[1], state[2], True)[1]

    def step(self, state: tuple, cp: int) -> tuple[tuple, int]:
        """One transition: the next state, and the tokens added."""
        if cp == SPECIAL:
            return _START, self.close(state) + 1
        char = chr(cp)
        kind = self.kind(char)
        if state == _START:
            if kind == "blank":
                return _START, 0
            if kind == "digit":
                return _START, self.step_char(0, char, True)[1]
            return (("mark", char) if char == "'" else (kind, 0, char)), 0
        if state[0] == "mark":
            seen = state[1]
            if seen + char in ("'s", "'t", "'m", "'d", "'re", "'ve", "'ll"):
                return _START, len(self.bpe.word(seen + char))
            if seen == "'" and char in ("r", "v", "l"):
                return ("mark", seen + char), 0
            if seen != "'":
                after, n = self.step(("word", 0, seen[1]), cp)
                return after, n + self.step_char(0, "'", True)[1]
            if kind == "sign":
                q, n = self.step_char(0, "'")
                return ("sign", q, char), n
        elif kind == state[0]:
            q, n = self.step_char(state[1], state[2])
            return (kind, q, char), n
        after, n = self.step(_START, cp)
        return after, n + self.close(state)

    # -- the compiled table

    def _table(self, size: int) -> None:
        self.keys = np.full(size, _EMPTY, np.uint64)
        self.to = np.zeros(size, np.int32)
        self.gain = np.zeros(size, np.int32)
        self.used, self.shift = 0, np.uint64(64 - size.bit_length() + 1)

    def _insert(self, keys: np.ndarray, to: np.ndarray, gain: np.ndarray) -> None:
        if self.used + len(keys) > len(self.keys) // 2:
            old = self.keys != _EMPTY
            keys, to, gain = (np.concatenate(x) for x in ((self.keys[old], keys), (self.to[old], to), (self.gain[old], gain)))
            size = len(self.keys)
            while len(keys) > size // 4:
                size *= 2
            self._table(size)
        self.used += len(keys)
        at, left = (keys * _SPREAD) >> self.shift, np.arange(len(keys))
        mask = np.uint64(len(self.keys) - 1)
        while len(left):
            free = self.keys[at[left]] == _EMPTY
            slots, first = np.unique(at[left[free]], return_index=True)
            put = left[free][first]
            self.keys[slots], self.to[slots], self.gain[slots] = keys[put], to[put], gain[put]
            left = np.setdiff1d(left, put, assume_unique=True)
            at[left] = (at[left] + np.uint64(1)) & mask

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """Slots of keys; -1 for those that are not compiled yet."""
        at = (keys * _SPREAD) >> self.shift
        found = self.keys[at]
        off = np.flatnonzero(found != keys)
        if len(off):
            mask = np.uint64(len(self.keys) - 1)
            at = at.astype(np.int64)
            while len(off):
                gone = self.keys[at[off]] == _EMPTY
                at[off[gone]] = -1
                off = off[~gone]
                at[off] = (at[off] + 1) & int(mask)
                off = off[self.keys[at[off]] != keys[off]]
        return at

    def advance(self, states: np.ndarray, cps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys = states.astype(np.uint64) << np.uint64(21) | cps
        at = self._find(keys)
        if at.dtype == np.int64 and (at < 0).any():
            new = np.unique(keys[at < 0])
            to, gain = np.empty(len(new), np.int32), np.empty(len(new), np.int32)
            for i, k in enumerate(new.tolist()):
                state, gain[i] = self.step(self.states[k >> 21], k & 0x1FFFFF)
                if (s := self.ids.get(state)) is None:
                    s = self.ids[state] = len(self.states)
                    self.states.append(state)
                to[i] = s
            self._insert(new, to, gain)
            at = self._find(keys)
        return self.to[at], self.gain[at]

    def run(self, text: np.ndarray, start: np.ndarray, end: np.ndarray, states: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Step through text[start:end] from each state, all lanes together."""
        length = end - start
        order = np.argsort(-length, kind="stable")
        state, at, count = states[order].astype(np.int32), start[order], np.zeros(len(order), np.int64)
        lengths = -length[order]
        for t in range(int(-lengths[0]) if len(lengths) else 0):
            n = int(np.searchsorted(lengths, -t, "left"))
            to, gain = self.advance(state[:n], text[at[:n] + t])
            state[:n] = to
            count[:n] += gain
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        return state[back], count[back]

    def compose(self, chunk: np.ndarray, entry: np.ndarray, exit_: np.ndarray, count: np.ndarray, follows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The maps of all chunks, each a set of lanes entry -> (exit, count), composed with those of the chunks after it: for every
        lane the state at the end of its text and the count up to there. A lane knows the lane that its exit enters in the next chunk;
        each step joins what a lane leads to with what that leads to, so 2, 4, 8, ... chunks are composed, in log2 steps."""
        key = chunk.astype(np.int64) << 32 | entry
        order = np.argsort(key)
        onward = np.flatnonzero(follows[chunk])
        to = np.arange(len(chunk))
        to[onward] = order[np.searchsorted(key, (chunk[onward].astype(np.int64) + 1) << 32 | exit_[onward], sorter=order)]
        held = np.where(to == np.arange(len(chunk)), 0, count)  # of the chunks up to the lane ``to``
        self.scan_steps = 0
        while (to != to[to]).any():
            held, to = held + held[to], to[to]
            self.scan_steps += 1
        return exit_[to], held + count[to]

    def text_counts(self, text: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Token counts of every text."""
        if self.used > MAX_TRANSITIONS:
            self.clear()
        sizes = np.diff(offsets)
        chunks = -(-sizes // CHUNK)
        first = np.concatenate([[0], np.cumsum(chunks)])
        owner = np.repeat(np.arange(len(sizes)), chunks)
        start = offsets[owner] + (np.arange(first[-1]) - first[owner]) * CHUNK
        end = np.minimum(start + CHUNK, offsets[owner + 1])
        inner = np.flatnonzero(np.arange(first[-1]) != first[owner])
        follows = np.append(owner[1:] == owner[:-1], False) if len(owner) else np.zeros(0, bool)
        entries = np.zeros(len(start), np.int32)
        entries[inner] = self.run(text, start[inner] - WARM, start[inner], entries[inner])[0]
        chunk, entry, lanes = np.arange(len(start)), entries, []
        known = np.zeros(0, np.int64)
        while len(chunk):  # the maps get the entries that occur
            exit_, count = self.run(text, start[chunk], end[chunk], entry)
            lanes.append((chunk, entry, exit_, count))
            known = np.union1d(known, chunk.astype(np.int64) << 32 | entry)
            on = follows[chunk]
            new = np.setdiff1d((chunk[on].astype(np.int64) + 1) << 32 | exit_[on], known)
            chunk, entry = new >> 32, (new & 0xFFFFFFFF).astype(np.int32)
        out = np.zeros(len(sizes), np.int64)
        if lanes:
            state, total = self.compose(*(np.concatenate(x) for x in zip(*lanes)), follows)
            some = chunks > 0  # the first lanes are the chunks themselves, a text's first from the start state
            out[some] = total[first[:-1][some]] + np.array([self.close(self.states[s]) for s in state[first[:-1][some]].tolist()], np.int64)
        return out

    def symbols(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        parts: list[str] = []
        marks: list[int] = []
        offsets, at = [0], 0
        for t in texts:
            for p in self.bpe.specials(t) if self.bpe.specials and "<|" in t else (t,):
                if p in self.bpe.special:
                    marks.append(at)
                    p = " "
                else:
                    p = self.bpe.normal(p)
                parts.append(p)
                at += len(p)
            offsets.append(at)
        text = np.frombuffer("".join(parts).encode("utf-32-le"), np.uint32).astype(np.uint64)
        text[marks] = SPECIAL
        return text, np.array(offsets, np.int64)

    def count(self, texts: list[str]) -> np.ndarray:
        text, offsets = self.symbols(texts)
        return self.text_counts(text, offsets)


def bpe_symbols() -> list[str]:
    from .bpe import byte_symbols

    return byte_symbols()


@lru_cache(maxsize=2)
def compiled(vocabulary: str) -> CountTransducer:
    return CountTransducer(load(vocabulary))


def count_tokens(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text", limit: int = 2048) -> DataFrame:
    """Per row: bytes of UTF-8, tokens, and whether they exceed ``limit``."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = compiled(vocabulary)
        for b in it:
            texts = pc.fill_null(b.column(1), "")
            bytes_ = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
            done, row = [], 0
            ends = np.cumsum(bytes_)
            while row < len(texts):
                stop = max(row + 1, int(np.searchsorted(ends, (ends[row - 1] if row else 0) + SLICE_CHARS, "right")))
                done.append(machine.count(texts[row:stop].to_pylist()))
                row = stop
            n = np.concatenate(done) if done else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(bytes_), pa.array(n)], names=[key, "n_bytes", "n_tokens"])

    kind = docs.schema[key].dataType.simpleString()
    counted = docs.select(key, text).mapInArrow(batches, f"{key} {kind}, n_bytes bigint, n_tokens bigint")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
