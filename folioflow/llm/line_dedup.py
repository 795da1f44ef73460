"""Line deduplication by pairwise alignment (operator 1).

Each document is the sequence of the hashes of its lines. A run is a block of lines with at least ``MIN_WORDS`` words that
has fewer without its last line, or without its first: so long a run is rare unless it is copied, and runs stand for rare
lines here, as a rare line may be too short to matter and a copied passage is rarely one line. A document that has a run of an
earlier document (by key) is paired with the first document that has that run. The pair is aligned by patience diff over the
blocks of lines that their shared runs make up: a first alignment that keeps the order of both sides, then one of what it has left,
until every block is aligned, also those that stand in another order. Aligned blocks are deleted from the later document.

That is as good as aligning with every earlier document. Let a block of enough words be common to this document and some
earlier one. Each of its lines is in a run that lies in the block: the shortest one that ends with the line if what is before
the line in the block is enough, and else the shortest one that begins with the block. That earlier document has the run, so
the run's first holder is paired with this document and the line is deleted.

Only hashes are shuffled for this, one for each run; a run in a third of all documents gives one pair for each of them and no
more, and is dealt out when it is joined. Texts are shuffled once, to meet the deletions.

Edge cases: a null text stays null and an empty one empty; a very long text is taken whole, in time near-linear in its lines;
rows with equal key and text are one document with one result; rows with equal key and different texts (ties) are ordered by
a hash of the text; null keys come last; lines are compared without blanks at their ends, and blank lines neither match nor
interrupt a block; other columns are kept, but for ``n_lines``, ``n_removed`` and ``removed``, which are replaced.
"""

from __future__ import annotations

from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from ..operators.skew import ROWS_PER_PART, spread_join
from ..store import Steps, cut

MIN_WORDS = 25


def runs(words: list[int], least: int) -> list[tuple[int, int]]:
    """The ranges (end exclusive) of the runs: the shortest from each line on, and the shortest up to each line."""
    out, end, held = [], 0, 0
    for i in range(len(words)):
        while held < least and end < len(words):
            held += words[end]
            end += 1
        if held < least:
            break
        out.append((i, end))
        held -= words[i]
    first, held = 0, 0
    for j in range(len(words)):
        held += words[j]
        while held - words[first] >= least:
            held -= words[first]
            first += 1
        if held >= least:
            out.append((first, j + 1))
    return out


def run_hashes(hashes: list[int], ranges: list[tuple[int, int]]) -> list[int]:
    """The hash of each run; a line's own for a run of one."""
    lines = np.array(hashes, np.int64)
    return [hashes[i] if j == i + 1 else xxhash.xxh3_64_intdigest(lines[i:j].tobytes()) - (1 << 63) for i, j in ranges]


def shared_blocks(a: list[int], b: list[int], words: list[int], least: int) -> list[tuple[int, int, int]]:
    """(place in a, place in b, lines) of the blocks that both have and that hold a run, by their place in b; ``words`` are those of
    b's lines. A run of b is sought at its first place in a, and runs that overlap alike in both are one block."""
    size, known, i = dict(zip(b, words)), {}, 0
    while i < len(a):  # the runs of a that b can have, between lines that b hasn't
        j = i
        while j < len(a) and a[j] in size:
            j += 1
        if j > i:
            ranges = runs([size[x] for x in a[i:j]], least)
            for (x, _), h in zip(ranges, run_hashes(a[i:j], ranges)):
                known.setdefault(h, i + x)
        i = j + 1
    ranges = runs(words, least)
    places = sorted({(known[h] - x, x, y) for (x, y), h in zip(ranges, run_hashes(b, ranges)) if h in known})
    found: list[list[int]] = []  # (shift, first, end)
    for shift, x, y in places:
        if found and found[-1][0] == shift and x <= found[-1][2]:
            found[-1][2] = max(found[-1][2], y)
        else:
            found.append([shift, x, y])
    return sorted((x + shift, x, y - x) for shift, x, y in found)


def patience(found: list[tuple[int, int, int]]) -> list[list[tuple[int, int, int]]]:
    """Blocks dealt to piles by patience: in the order of b, each goes on the pile whose last block ends nearest before it in a, and
    before it in b, too; a new pile begins where there is none. A pile is an alignment that keeps the order of both sides, the
    next pile aligns what the piles before have left."""
    piles: list[list[tuple[int, int, int]]] = []
    ends: list[tuple[int, int]] = []  # where each pile's last block ends in a, and its pile
    for i, j, n in sorted(found, key=lambda x: (x[1], x[0])):
        at = bisect_right(ends, (i, len(piles))) - 1
        if at >= 0 and piles[ends[at][1]][-1][1] + piles[ends[at][1]][-1][2] <= j:
            pile = ends.pop(at)[1]
        else:
            pile = len(piles)
            piles.append([])
        piles[pile].append((i, j, n))
        insort(ends, (i + n, pile))
    return piles


def blocks(a: list[int], b: list[int], words: list[int], least: int) -> list[tuple[int, int]]:
    """Ranges of b's lines (end exclusive, none twice) that patience diff aligns with a in blocks of at least ``least`` words."""
    out, gone = [], bytearray(len(b))
    for alignment in patience(shared_blocks(a, b, words, least)):
        for _, j, n in alignment:
            begin = -1
            for k in range(j, j + n + 1):
                fresh = k < j + n and not gone[k]
                if fresh and begin < 0:
                    begin = k
                elif not fresh and begin >= 0:
                    out.append((begin, k))
                    begin = -1
            gone[j : j + n] = b"\1" * n
    return sorted(out)


def outlines(docs: DataFrame, key: str, text: str, least: int) -> DataFrame:
    """Per document: its identity, and hash, words and place of every line that isn't blank, and its runs."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for i in range(0, b.num_rows, 512):
                part = b.slice(i, 512)
                columns: list[list[list[int]]] = [[], [], [], []]
                for t in part.column(2):
                    hashes, words, places = [], [], []
                    for place, line in enumerate((t.as_py() or "").split("\n")):
                        if n := len(line.split()):
                            hashes.append(xxhash.xxh3_64_intdigest(line.strip().encode()) - (1 << 63))
                            words.append(n)
                            places.append(place)
                    for column, x in zip(columns, (hashes, words, places, sorted({*run_hashes(hashes, runs(words, least))}))):
                        column.append(x)
                kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *(pa.array(c, pa.list_(k)) for c, k in zip(columns, kinds))], names=["key", "version", "lines", "words", "places", "runs"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("key"), F.xxhash64(text).alias("version"), text).mapInArrow(batches, f"key {kind}, version bigint, lines array<bigint>, words array<int>, places array<int>, runs array<bigint>")


def identity(key: str | Column) -> Column:
    """What tells documents apart, in their order: rows with equal key and text are one document."""
    return F.struct(F.col(key).isNull().alias("no_key"), F.col(key).alias("key"), F.col("version"))


def deletions(outlined: DataFrame, least: int, steps: Steps) -> DataFrame:
    """Per later document: the ranges of its lines (first, last) that an earlier document has."""
    some = outlined.where(F.size("runs") > 0)
    held = some.select(identity("key").alias("later"), F.explode("runs").alias("run"))
    holders = held.groupBy("run").agg(F.min("later").alias("earlier"), F.max("later").alias("last"), F.count(F.lit(1)).alias("n")).where(F.col("earlier") != F.col("last"))
    holders = steps.cut(holders.select("run", "earlier", "n"), "holders")
    # a passage of many documents is a run that many rows have
    pairs = spread_join(held, holders.select("run", "earlier"), "run", "later", sizes=holders)
    pairs = steps.cut(pairs.where(F.col("earlier") != F.col("later")).select("earlier", "later").distinct(), "pairs")
    each = some.select(identity("key").alias("id"), "lines", "words", "places").dropDuplicates(["id"])
    own = each.select(F.col("id").alias("later"), "lines", "words", "places")
    # and it has one first holder, whose lines go to several partitions
    both = spread_join(pairs, each.select(F.col("id").alias("earlier"), F.col("lines").alias("first_lines")), "earlier", "later").join(own, "later")

    def align(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in it:
            for at in range(0, whole.num_rows, 512):
                b = whole.slice(at, 512)
                later, out = [], []
                lines, words, places, first = (b.column(i) for i in range(1, 5))
                for i in range(b.num_rows):
                    place = places[i].as_py()
                    if found := blocks(first[i].as_py(), lines[i].as_py(), words[i].as_py(), least):
                        later.append(i)
                        out.append([{"first": place[x], "last": place[y - 1]} for x, y in found])
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(later, pa.int64())), pa.array(out, pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())])))], names=["later", "ranges"])

    kind = both.schema["later"].dataType.simpleString()
    found = both.select("later", "lines", "words", "places", "first_lines").mapInArrow(align, f"later {kind}, ranges array<struct<first:int,last:int>>")
    return found.groupBy("later").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ranges")))).alias("ranges"))


def dedupe_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = MIN_WORDS) -> DataFrame:
    """``docs`` with the lines that an earlier document has taken out of ``text``; ``n_lines``, ``n_removed`` and ``removed``
    (ranges of lines, as ``first-last``) say what became of it."""
    named = ["_dedup_none", "_dedup_key", "_dedup_version"]

    def id_columns(no_key: Column, key: Column, version: Column) -> list[Column]:
        return [c.alias(n) for c, n in zip((no_key, F.coalesce(key.cast("string"), F.lit("")), version), named)]

    with Steps(docs.sparkSession) as steps:
        outlined = steps.cut(outlines(docs, key, text, least), "outlines")
        gone = deletions(outlined, least, steps).select(*id_columns(F.col("later.no_key"), F.col("later.key"), F.col("later.version")), F.col("ranges").alias("_dedup_ranges"))
        gone = cut(gone, "deletions")
        rows = outlined.select(*id_columns(F.col("key").isNull(), F.col("key"), F.col("version"))).groupBy(*named).agg(F.count(F.lit(1)).alias("n"))
        rows = cut(rows.where(F.col("n") > ROWS_PER_PART), "repeats")
    own = docs.drop("n_lines", "n_removed", "removed")
    met = own.select("*", *id_columns(F.col(key).isNull(), F.col(key), F.xxhash64(text)))
    # sort-merge at every size: a broadcast where the deletions happen to be few would only hide what the join takes
    met = spread_join(met, gone.hint("merge"), named, F.monotonically_increasing_id(), sizes=rows, how="left")
    lines = F.split(text, "\n", -1)
    kept = F.filter(lines, lambda _, i: ~F.exists("_dedup_ranges", lambda r: (i >= r["first"]) & (i <= r["last"])))
    some = F.col("_dedup_ranges").isNotNull()
    n_lines = F.coalesce(F.size(lines), F.lit(0)).cast("long")
    return met.withColumns(
        {
            "n_lines": F.when(F.col(text).isNull(), F.lit(0).cast("long")).otherwise(n_lines),
            "_dedup_kept": F.when(some, kept),
            "removed": F.coalesce(F.array_join(F.transform("_dedup_ranges", lambda r: F.concat_ws("-", r["first"], r["last"])), ","), F.lit("")),
        }
    ).select(
        *[F.when(some, F.array_join("_dedup_kept", "\n")).otherwise(F.col(text)).alias(text) if c == text else F.col(c) for c in own.columns],
        "n_lines",
        F.when(some, F.col("n_lines") - F.size("_dedup_kept")).otherwise(F.lit(0)).cast("long").alias("n_removed"),
        "removed",
    )
