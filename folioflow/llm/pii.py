"""Personal data by offset-preserving deobfuscation (operator 4).

Two transducers rewrite a text and keep, for every character that they write, the source characters that it stands for:
the first maps look-alike letters, digits of other scripts and wide forms to ASCII and drops invisible characters, the
second turns ``[at]``, ``(dot)``, `` at `` and `` dot `` in addresses to signs and spelled-out digits to digits. Identifiers
are detected in the text as it is (base spans) and in the rewritten text; findings there that hold a rewritten character
and aren't part of a base span of their kind are added, at the source characters that they map back to.

Edge cases: a null or empty text has no spans; an empty table has no rows; repeated rows give repeated rows and null keys stay;
where two added spans tie (same kind and place) one is kept; other columns, whatever their names, are ignored. Very long texts
are taken whole: no pattern begins with a repetition or looks past what it may match, so detection takes time in proportion
to the text, whatever it holds.
"""

from __future__ import annotations

import hashlib
import re
import sys
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

KINDS = ("email", "ip", "card", "phone")

#: Letters of other scripts that look like these.
LOOKALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "І": "I", "Ј": "J", "Ѕ": "S",
    "α": "a", "ο": "o", "ν": "v", "ρ": "p", "υ": "u", "ι": "i", "κ": "k", "ɑ": "a", "ɡ": "g", "ı": "i",
    "\u2024": ".", "\u3002": ".", "\u2027": ".", "\ufe52": ".", "\ufe6b": "@", "\u2010": "-", "\u2011": "-", "\u2012": "-", "\u2013": "-", "\u2014": "-", "\u00a0": " ", "\u202f": " ", "\u2009": " ",
    "\u200b": "", "\u200c": "", "\u200d": "", "\u2060": "", "\ufeff": "", "\u00ad": "",
}
#: Spelled digits.
DIGITS = {"zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9"}
#: A run of so many spelled digits is read as a number; fewer are prose.
SPELLED_RUN = 3

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: A match can't begin within a run of digits: it would have begun at the run's start.
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
#: Whether there can be any: these begin with one class of characters, which the regex engine skips to.
_SOME_IP = re.compile(r"[0-9]\.[0-9]").search
_SOME_CARD = re.compile(r"[0-9](?:[ -]?[0-9]){12}").search
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

_NAMES = "|".join(DIGITS)
#: Ends of domains that a plain "at" before a dotted name is read by.
_ENDS = "com|org|net|edu|gov|info|io|co|eu|uk|de|fr|es"
#: Words after a plain "at" that no address begins with.
_PROSE = r"(?!(?:the|a|an|this|that|my|our|your|his|her|their)\b)"
_REWRITE = re.compile(
    rf"""(?P<at>[\[({{<]\s*(?:at|@)\s*[\])}}>]\s*|&\#64;|&commat;|%40|(?<=[a-z0-9])(?:\s+@\s*|\s*@\s+)(?=[a-z0-9-]+(?:\.[a-z0-9-]+)*\.(?:{_ENDS})\b))
    |(?P<dot>[\[({{<]\s*(?:dot|\.)\s*[\])}}>]\s*|&\#46;|&period;)
    |(?P<named_at>(?<=[a-z0-9])\s+at\s+{_PROSE}(?=[a-z0-9-]+(?:\.[a-z0-9-]+)*\.(?:{_ENDS})\b))
    |(?P<plain_at>(?<=[a-z0-9])\s+at\s+{_PROSE}(?=[a-z0-9-]+(?:(?:\.|\s+dot\s+|\s*[\[({{<]\s*dot\s*[\])}}>]\s*)[a-z0-9-]+)*(?:\s+dot\s+|\s*[\[({{<]\s*dot\s*[\])}}>]\s*)[a-z]{{2,}}))
    |(?P<plain_dot>(?<=[a-z0-9])\s+dot\s+(?=[a-z0-9-]{{2,}}|[0-9]))
    |(?P<digits>\b(?:plus[\s-]+)?(?:{_NAMES})(?:[\s-]+(?:{_NAMES}|[0-9]+))+\b)""",
    re.X | re.I,
)
_TOKEN = re.compile(rf"plus[\s-]+|{_NAMES}|[0-9]+|[\s-]+", re.I)
_SPELLED = re.compile(rf"(?:{_NAMES})[\s-]+(?:{_NAMES}|[0-9])").search
_SIGNS = re.compile(r"[\[({<]\s*(?:at|@|dot|\.)\s*[\])}>]|&#(?:64|46);|&commat;|&period;|%40")
_NAMED = re.compile(rf"\sat\s+[a-z0-9.-]+\.(?:{_ENDS})\b").search
_SPACED = re.compile(r"\s@|@\s").search

#: In the table of the first transducer: a character that stays, and one that goes.
_STAYS, _GOES = -1, 0


@lru_cache(maxsize=1)
def char_table() -> np.ndarray:
    """What the first transducer writes for each character: look-alikes, wide forms (by their rule) and decimal digits."""
    table = np.full(sys.maxunicode + 1, _STAYS, np.int32)
    for c in range(0x80, sys.maxunicode + 1):
        if (d := unicodedata.decimal(chr(c), None)) is not None:
            table[c] = ord(str(d))
    table[0xFF01:0xFF5F] = np.arange(0xFF01, 0xFF5F) - 0xFEE0
    for c, to in LOOKALIKES.items():
        table[ord(c)] = ord(to) if to else _GOES
    return table


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def odd(text: str) -> bool:
    """Whether there is a character that the first transducer rewrites."""
    return not text.isascii() and bool((char_table()[code_points(text)] != _STAYS).any())


def emails(s: str) -> list[tuple[int, int]]:
    """Leftmost, non-overlapping: for each @ the run of local characters before it, and the domain after it."""
    out, pos, at = [], 0, s.find("@")
    while at >= 0:
        start = at
        while start > pos and s[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(s, at + 1)):
            out.append((start, m.end()))
            pos = m.end()
        else:
            pos = at + 1
        at = s.find("@", pos)
    return out


def ips(s: str) -> list[tuple[int, int]]:
    if not _SOME_IP(s):
        return []
    return [m.span() for m in _IP.finditer(s) if all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in m[0].split("."))]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def cards(s: str) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    if not _SOME_CARD(s):
        return out
    for m in _CARD.finditer(s):
        if m.end() - m.start() >= 13:
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append(m.span())
    return out


def phones(s: str) -> list[tuple[int, int]]:
    if "+" not in s:
        return []
    return [m.span() for m in _PHONE.finditer(s) if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15]


FINDERS = {"email": emails, "ip": ips, "card": cards, "phone": phones}


def detect(s: str) -> list[tuple[int, int, int]]:
    """(place of the kind, start, end) of everything found, by kind, then start."""
    return [(k, a, b) for k, kind in enumerate(KINDS) for a, b in FINDERS[kind](s)]


class Tape:
    """A text that the first transducer has rewritten, and for each of its characters the source span and whether it is new."""

    def __init__(self, text: str):
        self.text, self.start, self.new = text, np.arange(len(text)), np.zeros(len(text), bool)
        if odd(text):
            codes = code_points(text)
            to = char_table()[codes]
            self.start = np.flatnonzero(to != _GOES)
            self.new = (to > 0)[self.start]
            self.text = np.where(to > 0, to, codes.astype(np.int32))[self.start].astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
        self.end = self.start + 1

    def replace(self, edits: list[tuple[int, int, str]]) -> None:
        """Edits (start, end, what to write) in order; each written character stands for the whole span."""
        if not edits:
            return
        parts, start, end, new, at = [], [], [], [], 0
        for a, b, out in (*edits, (len(self.text), len(self.text), "")):
            parts.append(self.text[at:a])
            start.append(self.start[at:a])
            end.append(self.end[at:a])
            new.append(self.new[at:a])
            if out:
                parts.append(out)
                start.append(np.full(len(out), self.start[a]))
                end.append(np.full(len(out), self.end[b - 1]))
                new.append(np.ones(len(out), bool))
            at = b
        self.text = "".join(parts)
        self.start, self.end, self.new = (np.concatenate(x) for x in (start, end, new))


def disguised(text: str) -> bool:
    """Whether a transducer could rewrite anything that matters; most texts pass through unchanged."""
    if odd(text):
        return True
    low = text.lower()
    return "dot" in low or bool(_SIGNS.search(low)) or ("@" in low and bool(_SPACED(low))) or (" at " in low and bool(_NAMED(low))) or (sum(map(low.count, DIGITS)) >= SPELLED_RUN and bool(_SPELLED(low)))


def normalise(text: str) -> Tape:
    tape = Tape(text)
    edits: list[tuple[int, int, str]] = []
    for m in _REWRITE.finditer(tape.text):
        if m.lastgroup != "digits":
            begin, last = m.start(), edits[-1][1] if edits else 0
            while m.lastgroup in ("at", "dot") and begin > last and tape.text[begin - 1].isspace():  # the blanks before a bracket
                begin -= 1
            edits.append((begin, m.end(), "@" if m.lastgroup.endswith("at") else "."))
        else:
            tokens = [*_TOKEN.finditer(tape.text, *m.span())]
            if sum(t[0].lower() in DIGITS for t in tokens) >= SPELLED_RUN:
                for t in tokens:
                    low = t[0].lower()
                    if low in DIGITS:
                        edits.append((*t.span(), DIGITS[low]))
                    elif low.startswith("plus"):
                        edits.append((*t.span(), "+"))
                    elif low.isspace() and low != " ":
                        edits.append((*t.span(), " "))
    tape.replace(edits)
    return tape


def scan_text(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans, and the spans that the method adds."""
    base = detect(text)
    if not disguised(text):
        return base, []
    tape, added = normalise(text), []
    rewritten = np.concatenate([[0], np.cumsum(tape.new)])
    for k, a, b in detect(tape.text):
        first, end = int(tape.start[a]), int(tape.end[b - 1])
        if rewritten[b] > rewritten[a] or end - first != b - a:  # written anew, or something dropped in between
            before = bisect_right(base, (k, first, len(text))) - 1  # base spans of a kind don't overlap
            if before < 0 or base[before][0] != k or base[before][2] < end:
                added.append((k, first, end))
    return base, added


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def find_personal_data(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: base spans by kind, their digest, all spans, and how many the method added."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            counts: list[list[int]] = [[], [], [], []]
            digests, spans, more = [], [], []
            for t in b.column(1):
                base, added = scan_text(t.as_py() or "")
                for k in range(4):
                    counts[k].append(sum(x[0] == k for x in base))
                digests.append(hashlib.sha256(joined(base).encode()).hexdigest())
                spans.append(joined(sorted({*base, *added}) if added else base))
                more.append(len(added))
            columns = [b.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()), pa.array(spans, pa.string()), pa.array(more, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[key, *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(batches, f"{key} {kind}, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string, n_added bigint")
