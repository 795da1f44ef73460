"""N-gram Jaccard join with a count-vector R-tree (operator 10).

A document is its set of word shingles. Documents with equal sets are one node. The shingles of a node are hashed into
``GROUPS`` groups, and the counts of the groups are its point: two nodes can't share more shingles than the sum of the
minima of their coordinates, nor can members of two subtrees share more than the sum of the minima of their upper corners.

Count vectors of long texts are nearly equidistant, so one tree over everything would prune little. Nodes therefore meet in
the blocks of their rare shingles (an exact filter): two sets of Jaccard similarity s or more have one in common among the
first (1 - s) of each, in any order of all shingles that is the same for both. The order puts shingles that are frequent in
a bounded sample last; it changes the time, not the result. The join then runs in two rounds:

1. In every block, each node is held against the block's leader (the node that most documents share), by the bound that the
   tree has in its leaves, and then by the texts. This joins large groups of copies at a cost in proportion to their size.
2. Every block that still has nodes of different components gets an R-tree over its points, whatever its size, and the
   trees are joined with themselves from the roots down: pairs of tree nodes whose bound or sizes can't make a link, and
   those whose members are all in one component, aren't entered. Pairs that come out are verified on the texts.

So no link between different components is lost, and no group is expanded to all its pairs. Components come from links
by label propagation; a document's component is the least key in it.

A block of more than ``TILE`` nodes is dealt to several tasks: by size (sets that link differ in size by the factor of the
similarity at most, so a node meets its own stratum and the next), and a large stratum by tiles of its pairs. Shingles,
digests and components that very many rows have are dealt out as well when they are joined.

Edge cases: null, empty and wordless texts have no shingles and are linked with nothing; a text with fewer words than a
shingle has one of all its words; very long texts are taken whole, a few MB of words at a time; rows with equal key are kept
apart by their texts, and repeated rows get equal results; of equal keys any is the least; null keys take part, and a
component of null keys alone has the component null; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from ..operators.graph import components
from ..operators.skew import ROWS_PER_PART, spread_join
from ..store import Steps
from .words import BLANK, shingles, slices, word_hashes

#: Groups of shingles, the dimensions of the tree.
GROUPS = 64
#: Single pairs are bounded by finer points: a group for every so many shingles, MOST_GROUPS at most.
SHINGLES_PER_GROUP, MOST_GROUPS = 8, 4096
#: What a full coordinate counts: more than a text has shingles in a group, and 64 of them (``MOST_GROUPS`` / ``GROUPS``) fit.
UNBOUNDED = np.uint32(1 << 25)
#: So many documents' keys (16 bytes each) at most are broadcast to select the texts to verify; more are shuffled.
BROADCAST_KEYS = 500_000
#: Documents of the sample by which frequent shingles are known, and how many of it make a shingle frequent.
SAMPLE_DOCS = 20_000
FREQUENT = 40
#: Members of a node of the tree.
FAN = 8
#: Nodes of a block, or of a stratum of it, that one tree has.
TILE = 1024
#: Pairs of tree nodes, or of points, that are bounded together.
PAIRS = 4096


def text_sets(column: pa.Array, k: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of every text."""
    for _, data, offsets in slices(column):
        words, first = word_hashes(data, offsets, BLANK)
        found, at = shingles(words, first, k)
        for i in range(len(at) - 1):
            yield np.unique(found[at[i] : at[i + 1]])


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def points(s: np.ndarray) -> np.ndarray:
    """Counts of the groups, more groups for larger sets; 255 stands for any number from 255 on."""
    groups = GROUPS
    while groups < MOST_GROUPS and groups * SHINGLES_PER_GROUP < len(s):
        groups *= 2
    return np.minimum(np.bincount((s >> np.uint64(64 - (groups.bit_length() - 1))).astype(np.int64), minlength=groups), 255).astype(np.uint8)


def wide(p: np.ndarray, groups: int = GROUPS) -> np.ndarray:
    """Points (a row each) with fewer groups, and room for sums; a group with a full member is as good as unbounded."""
    p = np.where(p == np.iinfo(p.dtype).max, UNBOUNDED, p.astype(np.uint32))
    if p.shape[1] > groups:
        p = p.reshape(len(p), groups, -1).sum(2, dtype=np.uint32)
    return p


def corner(s: np.ndarray) -> np.ndarray:
    """Counts of the ``GROUPS`` groups of the tree; 65535 stands for any number from 65535 on."""
    return np.minimum(np.bincount((s >> np.uint64(64 - (GROUPS.bit_length() - 1))).astype(np.int64), minlength=GROUPS), 65535).astype(np.uint16)


def binary_rows(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary column, and where each row's begin."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] else np.zeros(0, np.uint8), offsets


def shared_at_most(p: pa.Array, q: pa.Array) -> np.ndarray:
    """For each pair of points the sum of the minima, with as many groups as both have."""
    out = np.empty(len(p), np.int64)
    sides = [binary_rows(c) for c in (p, q)]
    m, n = (np.diff(offsets) for _, offsets in sides)
    for groups in np.unique(m * MOST_GROUPS * 2 + n):
        at = np.flatnonzero(m * MOST_GROUPS * 2 + n == groups)
        each = max(1, PAIRS * GROUPS // int(max(m[at[0]], n[at[0]])))
        for i in range(0, len(at), each):
            some = at[i : i + each]
            x, y = (wide(data[offsets[some][:, None] + np.arange(k[at[0]])], int(min(m[at[0]], n[at[0]]))) for (data, offsets), k in zip(sides, (m, n)))
            out[some] = np.minimum(x, y).sum(1, dtype=np.int64)
    return out


def enough(overlap: np.ndarray, sizes: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of together ``sizes`` shingles can link with this overlap: 100 o >= p (sizes - o)."""
    return (100 + percent) * overlap.astype(np.int64) >= percent * sizes


def frequent_shingles(docs: DataFrame, text: str, k: int, sample: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of at least ``least`` documents of a sample of rows, with their counts: at most the sample's shingles / ``least``."""
    held = docs.select(text).sample(min(1.0, sample / max(1, docs.count())), 20)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for s in text_sets(b.column(0), k):
                if len(s):
                    yield pa.RecordBatch.from_arrays([pa.array(s.view(np.int64))], names=["s"])

    counted = held.mapInArrow(batches, "s bigint").groupBy("s").count().where(F.col("count") >= least).collect()
    values = np.array([r[0] for r in counted], np.int64).view(np.uint64)
    order = np.argsort(values)
    return values[order], np.array([r[1] for r in counted], np.int64)[order]


def outlines(docs: DataFrame, key: str, text: str, k: int, percent: int, frequent: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """Per row: the set's size, its 128-bit digest, its point, its place in the tree and the first shingles in the common order."""
    known, counts = frequent

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                n, high, low, point, place, keys = [], [], [], [], [], []
                for s in text_sets(part.column(2), k):
                    n.append(len(s))
                    digest = xxhash.xxh3_128_intdigest(s.tobytes())
                    high.append((digest >> 64) - (1 << 63))
                    low.append((digest & ((1 << 64) - 1)) - (1 << 63))
                    point.append(points(s).tobytes())
                    place.append(corner(s).tobytes())
                    first = s
                    if len(s) and len(known):
                        at = np.minimum(np.searchsorted(known, s), len(known) - 1)
                        first = s[np.argsort(np.where(known[at] == s, counts[at], 0), kind="stable")]
                    keys.append(first[: prefix_length(len(s), percent) if len(s) else 0].view(np.int64))
                ends = np.concatenate([[0], np.cumsum([len(x) for x in keys])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(keys)))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(n, pa.int32()), pa.array(high, pa.int64()), pa.array(low, pa.int64()), pa.array(point, pa.binary()), pa.array(place, pa.binary()), lists], names=["key", "version", "n", "high", "low", "point", "corner", "keys"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("key"), F.xxhash64(text).alias("version"), text).mapInArrow(batches, f"key {kind}, version bigint, n int, high bigint, low bigint, point binary, corner binary, keys array<bigint>")


def bounded(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (a, b; a written table) whose points allow a link."""
    at = nodes.select("node", "n", "point")
    both = spread_join(pairs, at.toDF("a", "n_a", "point_a"), "a", "b").join(at.toDF("b", "n_b", "point_b"), "b")
    both = both.where((100 * F.col("n_a") >= percent * F.col("n_b")) & (100 * F.col("n_b") >= percent * F.col("n_a")))

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            if b.num_rows:
                ok = enough(shared_at_most(b.column(4), b.column(5)), b.column(2).to_numpy() + b.column(3).to_numpy().astype(np.int64), percent)
                yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(ok)), b.column(1).filter(pa.array(ok))], names=["a", "b"])

    return both.select("a", "b", "n_a", "n_b", "point_a", "point_b").mapInArrow(batches, "a bigint, b bigint")


def verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, key: str, text: str, k: int, percent: int, steps: Steps) -> DataFrame:
    """Those of the pairs (a, b) whose texts' sets link. Only texts that are in some pair are shuffled, once and by pair."""
    used = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    used = steps.cut(used.join(nodes.select("node", F.col("key").alias("_key"), F.col("version").alias("_version")), "node"), "used")
    few = F.broadcast(used) if used.count() <= BROADCAST_KEYS else used
    texts = docs.select(key, text, F.xxhash64(text).alias("_v"))
    texts = texts.join(few, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_v") == F.col("_version"))).select("node", F.col(text).alias("text")).dropDuplicates(["node"])
    # a leader is in many pairs: its text goes to several partitions
    both = spread_join(pairs, texts.toDF("a", "text_a"), "a", "b").join(texts.toDF("b", "text_b"), "b").select("a", "b", "text_a", "text_b")

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for i in range(0, b.num_rows, 512):
                part = b.slice(i, 512)
                ok = []
                for s, t in zip(text_sets(part.column(2), k), text_sets(part.column(3), k)):
                    shared = len(s) + len(t) - len(np.union1d(s, t))
                    ok.append(100 * shared >= percent * (len(s) + len(t) - shared))
                yield pa.RecordBatch.from_arrays([part.column(0).filter(pa.array(ok)), part.column(1).filter(pa.array(ok))], names=["a", "b"])

    found = steps.cut(both.mapInArrow(batches, "a bigint, b bigint"), "links")
    steps.drop(used)
    return found


class CountForest:
    """R-trees over count vectors, one for each run of equal ``tree`` values, packed in the order given. Each node has its
    upper corner, its range of sizes, and its component if all members share it. ``trees`` are the values of the roots."""

    def __init__(self, tree: np.ndarray, n: np.ndarray, point: np.ndarray, component: np.ndarray):
        self.levels = [(point, n, n, component)]
        self.members: list[np.ndarray] = [np.zeros(0, np.int64)]  # of each level above the points: where each node's begin
        while True:
            start = np.flatnonzero(np.append(True, tree[1:] != tree[:-1]))
            if len(start) == len(tree):
                break
            place = np.arange(len(tree)) - np.repeat(start, np.diff(np.append(start, len(tree))))
            at = np.flatnonzero(place % FAN == 0)
            corners, least, most, one = self.levels[-1]
            low, high = np.minimum.reduceat(one, at), np.maximum.reduceat(one, at)
            self.levels.append((np.maximum.reduceat(corners, at, axis=0), np.minimum.reduceat(least, at), np.maximum.reduceat(most, at), np.where(low == high, low, -1)))
            self.members.append(np.append(at, len(tree)))
            tree = tree[at]
        self.trees = tree

    def may_link(self, depth: int, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
        """Which pairs of nodes of a level can have members that link and aren't known to be of one component."""
        corners, least, most, one = self.levels[depth]
        ok = ((one[a] != one[b]) | (one[a] < 0)) & (100 * most[a] >= percent * least[b]) & (100 * most[b] >= percent * least[a])
        at = np.flatnonzero(ok)
        shared = np.minimum(corners[a[at]], corners[b[at]]).sum(1, dtype=np.int64)
        ok[at] = enough(shared, least[a[at]] + least[b[at]], percent)
        return ok

    def join(self, a: np.ndarray, b: np.ndarray, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of points that may link, below pairs of roots; a root with itself gives each pair once."""
        top = len(self.levels) - 1
        if top == 0:
            own = a != b
            a, b = a[own], b[own]
        todo = [(top, a, b)]
        while todo:
            depth, a, b = todo.pop()
            if len(a) > PAIRS:
                todo += [(depth, a[PAIRS:], b[PAIRS:])]
                a, b = a[:PAIRS], b[:PAIRS]
            ok = self.may_link(depth, a, b, percent)
            a, b = a[ok], b[ok]
            if not len(a):
                continue
            if depth == 0:
                yield a, b
                continue
            first = self.members[depth]
            many_a, many_b = (first[x + 1] - first[x] for x in (a, b))
            each = many_a * many_b
            pair = np.repeat(np.arange(len(a)), each)
            place = np.arange(len(pair)) - np.repeat(np.cumsum(each) - each, each)
            x, y = first[a][pair] + place // many_b[pair], first[b][pair] + place % many_b[pair]
            ok = (a != b)[pair] | (x <= y if depth > 1 else x < y)
            todo.append((depth - 1, x[ok], y[ok]))


def block_pairs(tree: np.ndarray, node: np.ndarray, n: np.ndarray, point: np.ndarray, component: np.ndarray, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of nodes that may link, from whole trees: ``tree`` is twice a number, the points being joined with themselves,
    or that number plus one, the points being joined with those of the even tree."""
    order = np.lexsort((n, tree))
    node, tree, n = node[order], tree[order], n[order].astype(np.int64)
    forest = CountForest(tree, n, wide(point[order]), component[order])
    roots = np.arange(len(forest.trees))
    odd = np.flatnonzero(forest.trees % 2 == 1)
    across = odd[(odd > 0) & (forest.trees[odd - 1] == forest.trees[odd] - 1)]
    alone = np.ones(len(roots), bool)
    alone[odd], alone[across - 1] = False, False
    a, b = np.concatenate([roots[alone], across - 1]), np.concatenate([roots[alone], across])
    for i, j in forest.join(a, b, percent):
        yield node[i], node[j]


def tree_pairs(tiles: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs of nodes of one tile (key, tile, side, node, n, corner, component) that may link and are of different
    components. The nodes of side 0 meet those of side 1 if there are any, else each other."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solve(parts: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
            key, tile, side, node, n, component, point = (np.concatenate(x) for x in zip(*parts))
            new = (key[1:] != key[:-1]) | (tile[1:] != tile[:-1])
            tree = 2 * np.cumsum(np.append(0, new)) + side
            for x, y in block_pairs(tree, node, n, point, component, percent):
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["a", "b"])

        held: list[list[np.ndarray]] = []
        for whole in it:
            for i in range(0, whole.num_rows, 4096):
                b = whole.slice(i, 4096)
                columns = [b.column(i).to_numpy() for i in range(6)]
                data, offsets = binary_rows(b.column(6))
                columns.append(data[offsets[0] : offsets[-1]].view(np.uint16).reshape(-1, GROUPS).copy())
                key, tile = columns[:2]
                # the last tile may go on in the next batch
                last = int(np.flatnonzero((key != key[-1]) | (tile != tile[-1]))[-1]) + 1 if (key[0], tile[0]) != (key[-1], tile[-1]) else 0
                if held and (last or (held[-1][0][-1], held[-1][1][-1]) != (key[0], tile[0])):
                    yield from solve([*held, [x[:last] for x in columns]])
                    held = []
                elif last:
                    yield from solve([[x[:last] for x in columns]])
                held.append([x[last:] for x in columns])
        if held:
            yield from solve(held)

    dealt = tiles.select("key", "tile", "side", "node", "n", "component", "corner").repartition("key", "tile").sortWithinPartitions("key", "tile")
    return dealt.mapInArrow(batches, "a bigint, b bigint").distinct()


def tiled(members: DataFrame, blocks: DataFrame, percent: int, steps: Steps) -> DataFrame:
    """The members (key, size, node, n, ...) of blocks (key, size) as tiles: a small block is one tile, in which the nodes meet each other. A large one
    is cut into strata by the size of its nodes, which also visit the stratum below; a large stratum is cut into parts, of
    which each pair is a tile."""
    whole = F.col("size") <= TILE
    small = members.where(whole).withColumns({"tile": F.lit(-1).cast("long"), "side": F.lit(0)})
    if blocks.where(~whole).isEmpty():
        return small
    large = members.where(~whole)
    # a little wider than the similarity, so that rounding can't part two sets that link by more than one stratum
    stratum = F.floor(F.log(F.col("n").cast("double")) / F.lit(float(np.log(100 / percent) * 1.0001)))
    placed = steps.cut(large.withColumn("stratum", F.explode(F.array(stratum, stratum - 1))), "strata")
    sizes = steps.cut(placed.groupBy("key", "stratum").agg(F.count(F.lit(1)).alias("n")), "sizes")
    own = F.pmod(F.xxhash64("node", "key"), F.col("parts")).cast("long")
    cells = spread_join(placed, sizes.select("key", "stratum", F.ceil(F.col("n") / TILE).cast("long").alias("parts")), ["key", "stratum"], "node", sizes=sizes)
    cells = cells.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    tile = ((F.col("stratum") + 1) * (1 << 20) + F.least("own", "other")) * (1 << 20) + F.greatest("own", "other")
    return small.unionByName(cells.withColumns({"tile": tile, "side": (F.col("own") > F.col("other")).cast("int")}).select(*small.columns))


def grouped(docs: DataFrame, key: str, text: str, k: int, percent: int, sample: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The outlines of all rows; per node its digest, copies, the least key and version of its rows, and its component; and
    the number of nodes of each component that has many."""
    docs = docs.select(key, text)
    frequent = frequent_shingles(docs, text, k, sample, FREQUENT)
    with Steps(docs.sparkSession) as steps:
        rows = steps.cut(outlines(docs, key, text, k, percent, frequent), "sets")
        own = F.struct(F.col("key").isNull().alias("no_key"), "key", "version")
        firsts = [F.first(c).alias(c) for c in ("n", "point", "corner", "keys")]
        merged = rows.where("n > 0").groupBy("high", "low").agg(F.min(own).alias("own"), F.count(F.lit(1)).alias("copies"), *firsts)
        # The number of a node begins with how few documents share it: the least number in a block is its leader.
        node = F.monotonically_increasing_id() + F.shiftleft(F.lit(60).cast("long") - F.floor(F.log2("copies")).cast("long"), 56)
        nodes = steps.cut(merged.select("high", "low", "copies", "own.key", "own.version", "n", "point", "corner", "keys", node.alias("node")), "nodes")
        member = nodes.select("node", F.explode("keys").alias("key"))
        blocks = steps.cut(member.groupBy("key").agg(F.min("node").alias("leader"), F.count(F.lit(1)).alias("n")).where("n > 1"), "blocks")
        shared = steps.cut(spread_join(member, blocks.select("key", "leader"), "key", "node", sizes=blocks), "shared")

        met = steps.cut(shared.where("node != leader").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct(), "met")
        first = steps.cut(bounded(met, nodes, percent), "pairs")
        links = verified(first, nodes, docs, key, text, k, percent, steps)
        label = components(links)
        steps.drop(met)

        placed = steps.cut(shared.select("key", "node").join(label, "node", "left").select("key", "node", F.coalesce("label", "node").alias("component")), "placed")
        steps.drop(shared)
        mixed = placed.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count(F.lit(1)).alias("size")).where("low != high").select("key", "size")
        mixed = steps.cut(mixed, "mixed")
        left = spread_join(placed, mixed, "key", "node", sizes=mixed.withColumnRenamed("size", "n")).join(nodes.select("node", "n", "corner"), "node")
        met = steps.cut(tree_pairs(tiled(left, mixed, percent, steps), percent).join(first, ["a", "b"], "left_anti"), "met")
        second = steps.cut(bounded(met, nodes, percent), "pairs")
        more = verified(second, nodes, docs, key, text, k, percent, steps)
        label = components(links.unionByName(more)) if not more.isEmpty() else label
        whole = steps.cut(nodes.select("high", "low", "copies", "key", "version", "node").join(label, "node", "left").select("high", "low", "copies", "key", "version", F.coalesce("label", "node").alias("component")), "whole")
        many = steps.cut(whole.groupBy("component").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > ROWS_PER_PART), "many")
        steps.keep(rows, whole, many)
    return rows, whole, many


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = 4, percent: int = 85, sample: int = SAMPLE_DOCS) -> DataFrame:
    """Per row: its key, a hash of its text (``version``), the size of its set and its component's least key."""
    rows, whole, many = grouped(docs, key, text, k, percent, sample)
    least = whole.groupBy("component").agg(F.min("key").alias("least"))
    classes = spread_join(whole.select("high", "low", "component"), least, "component", F.col("low"), sizes=many).select("high", "low", "least")
    some = rows.where("n > 0").select("key", "version", "n", "high", "low")
    copies = whole.select("high", "low", F.col("copies").alias("n"))
    found = spread_join(some, classes, ["high", "low"], F.monotonically_increasing_id(), sizes=copies)
    found = found.select("key", "version", "n", "least").unionByName(rows.where("n = 0").select("key", "version", "n", F.col("key").alias("least")))
    return found.select(F.col("key").alias(key), "version", F.col("n").cast("long").alias("n_shingles"), F.col("least").alias("component_id"))


def leaders(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = 4, percent: int = 85, sample: int = SAMPLE_DOCS) -> DataFrame:
    """(no_key, key, version) of one document of each component: the least key that isn't null, of its texts the one with
    the least hash. Documents without shingles are in no component."""
    own = F.struct(F.col("key").isNull().alias("no_key"), "key", "version")
    return grouped(docs, key, text, k, percent, sample)[1].groupBy("component").agg(F.min(own).alias("own")).select("own.*")


#: DuckDB SQL for the rows of ``near_duplicates`` without ``version``, with shingles of four words and 85 percent.
ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT r, CASE WHEN len(w) < 4 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i + 3], ' ') END AS s FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
links AS (SELECT a.r AS a, b.r AS b FROM s a JOIN s b ON a.s = b.s AND a.r <> b.r JOIN n x ON a.r = x.r JOIN n y ON b.r = y.r GROUP BY a.r, b.r, x.n, y.n HAVING 100 * count(*) >= 85 * (x.n + y.n - count(*))),
reach(a, b) AS (SELECT r, r FROM d UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT d.doc_id, CAST(coalesce(any_value(n.n), 0) AS BIGINT) AS n_shingles, min(o.doc_id) AS component_id FROM d LEFT JOIN n USING (r) JOIN reach ON reach.a = d.r JOIN d o ON o.r = reach.b GROUP BY d.r, d.doc_id
"""
