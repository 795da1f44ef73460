"""Prefix trie of conversations from padded matrices of turn ids (operator 12).

Every distinct sequence of first turns of some conversation is a node. Conversations are rows of turn ids (120 bits of the
SHA-256 of role and text; texts stay where they are read). The rows are range-sharded in the order of their sequences, with the
conversation's number last, so equal sequences may be any number. In a shard:

1. the ids become small numbers in their order, the rows a matrix that is padded with zeros, and ``lexsort`` orders it;
2. where a column differs from the row before, a mask is set; masks are OR-accumulated along the columns, and so the mask of
   a depth marks the first row of each of its nodes;
3. from the deepest column up, ``reduceat`` over these marks aggregates all nodes of a depth at once: the number and the least
   of their conversations, children, leaves and savings of the subtree (each node's own are put on its first row).

Only nodes on the path of a shard's first or last row can go on in another shard. These come out as parts, under a digest of
their sequence; the parts of a node are added up, and children, leaves and savings of such nodes are carried to those above.

Matrices have ``HEAD`` columns, so that one very long conversation doesn't widen the others' rows. Turns beyond are nodes too:
the few conversations that have them go on as rows (conversation, depth) whose sequence is known by two 64-bit XORs of hashes of place
and turn, with running values in buckets of places; a node is a group of rows, and what a conversation brings from beyond is
put on its row of the matrix. A SHA-256 reads its bytes in order: ids are joined to short pieces where they are, and the
pieces of a node stream through one task in order, one at a time.

Edge cases: a null role or text is empty; rows without conversation take no part; turns are in the order of ``turn``, null
first, and equal ones (ties, repeated rows) in the order of their ids; a conversation without turns ends at the root; an
empty table has no rows, not even the root; very long texts are only hashed; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..operators.skew import spread_join
from ..store import Steps, cut

#: Turns of a conversation that the matrices hold.
HEAD = 64
#: Conversations in a shard.
SHARD_ROWS = 8192
#: Places of a bucket of running values.
BUCKET = 4096
#: Conversation numbers that share all bits but so many low ones are joined to one piece.
PIECE_BITS = 8

NOTHING = hashlib.sha256(b"").hexdigest()
COUNTS = ("n_convs", "n_children", "n_leaves", "saved_tokens")
SHOWN = ("conv_id", "depth", "parent_conv_id", *COUNTS, "ends_sha256")
INNER, BELOW_EDGE, EDGE, ENDS = range(4)


def turn_rows(turns: DataFrame, key: str, turn: str, role: str, text: str) -> DataFrame:
    """Per turn: conversation, place of order, id in two numbers, code points of its text."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role, text))
    digest = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)
    half = lambda at: F.conv(F.substring(digest, at, 15), 16, 10).cast("long")
    return turns.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("conv"), F.col(turn).alias("turn"), half(1).alias("hi"), half(16).alias("lo"), F.length(text).cast("long").alias("chars"))


def numbered(rows: DataFrame, steps: Steps) -> DataFrame:
    """``rows`` with each turn's place (``pos``, from 0) in its conversation. Rows are range-partitioned by conversation and turn and
    numbered within a partition; a conversation that comes from an earlier partition goes on with that one's count."""
    order = [F.col("conv"), F.col("turn").asc_nulls_first(), F.col("hi"), F.col("lo")]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("conv", "hi", "lo", "chars", F.spark_partition_id().alias("part"))

    def places(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, count = None, 0
        for b in it:
            conv = b.column(0).to_numpy()
            if not len(conv):
                continue
            starts = np.flatnonzero(np.concatenate([[True], conv[1:] != conv[:-1]]))
            pos = np.arange(len(conv)) - np.repeat(starts, np.diff(np.append(starts, len(conv))))
            if last == conv[0]:
                pos[: starts[1] if len(starts) > 1 else None] += count
            last, count = conv[-1], int(pos[-1]) + 1
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(pos, pa.int64())], names=[*b.schema.names, "pos"])

    local = steps.cut(ranged.mapInArrow(places, "conv long, hi long, lo long, chars long, part int, pos long"), "turns")
    each = local.groupBy("conv", "part").agg((F.max("pos") + 1).alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("conv").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    # a partition goes on with one conversation at most, so there are no more rows than partitions
    offsets = each.withColumn("before", before).where(F.col("before") > 0).select("conv", "part", "before")
    return local.join(F.broadcast(offsets), ["conv", "part"], "left").select("conv", (F.col("pos") + F.coalesce("before", F.lit(0))).alias("pos"), "hi", "lo", "chars")


def grafted(rows: DataFrame, base: Column, h: Column, most: int) -> tuple[DataFrame, DataFrame]:
    """Each conversation's turns after its first ``h`` behind the first ``h`` (``most`` at most) of conversation ``base``: the turns
    (conv, pos, hi, lo, chars), and all conversations, those without turns too."""
    convs = rows.select("conv").distinct()
    turn = F.struct("pos", "hi", "lo", "chars")
    heads = rows.where(F.col("pos") < most).join(convs.select(base.alias("conv")).distinct(), "conv", "left_semi")
    heads = heads.groupBy(F.col("conv").alias("base")).agg(F.array_sort(F.collect_list(turn)).alias("head"))
    first = convs.select("conv", base.alias("base"), h.alias("h")).join(heads, "base", "left").select("conv", "h", F.slice(F.coalesce("head", F.array().cast("array<struct<pos:bigint,hi:bigint,lo:bigint,chars:bigint>>")), 1, F.col("h")).alias("head"))
    shifts = first.where(F.size("head") < F.col("h")).select("conv", (F.size("head") - F.col("h")).alias("shift"))
    own = spread_join(rows.where(F.col("pos") >= h), shifts, "conv", "pos", rows=SHARD_ROWS, sizes=rows.groupBy("conv").agg(F.count(F.lit(1)).alias("n")), how="left")
    own = own.select("conv", (F.col("pos") + F.coalesce("shift", F.lit(0))).alias("pos"), "hi", "lo", "chars")
    return own.unionByName(first.select("conv", F.explode("head").alias("t")).select("conv", "t.*")), convs


def running(rows: DataFrame, values: dict[str, Column], kind: str, backwards: bool = False) -> DataFrame:
    """``rows`` with running values along ``pos`` of each conversation (``kind``: bit_xor or sum), from its first row or up to its last:
    within buckets of places, and then what the buckets before bring."""
    rows = rows.withColumn("bucket", F.floor(F.col("pos") / BUCKET)).withColumns(values)
    order = F.desc if backwards else F.asc
    add = getattr(F, kind)
    within = W.partitionBy("conv", "bucket").orderBy(order("pos")).rowsBetween(W.unboundedPreceding, 0)
    before = W.partitionBy("conv").orderBy(order("bucket")).rowsBetween(W.unboundedPreceding, -1)
    buckets = rows.groupBy("conv", "bucket").agg(*(add(v).alias(f"_{v}") for v in values))
    buckets = buckets.select("conv", "bucket", *(F.coalesce(add(f"_{v}").over(before), F.lit(0)).alias(f"_{v}") for v in values))
    local = rows.withColumns({v: add(v).over(within) for v in values}).join(buckets, ["conv", "bucket"])
    both = (lambda a, b: a.bitwiseXOR(b)) if kind == "bit_xor" else (lambda a, b: a + b)
    return local.withColumns({v: both(F.col(v), F.col(f"_{v}")) for v in values}).drop("bucket", *(f"_{v}" for v in values))


def digests(pieces: DataFrame, keys: list[str]) -> DataFrame:
    """SHA-256 of each key's pieces of text (``at``, ``ids``), joined with commas in the order of ``at``, as they stream by."""
    kinds = ", ".join(f"{k} {pieces.schema[k].dataType.simpleString()}" for k in keys)

    def stream(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, sha = None, hashlib.sha256()

        def batch(found: list[tuple]) -> pa.RecordBatch:
            kind = lambda i: None if i == len(keys) else schema.field(i).type
            return pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], kind(i)) for i in range(len(keys) + 1)], names=[*keys, "ends_sha256"])

        for b in it:
            schema, found = b.schema, []
            for *key, text in zip(*(b.column(i).to_pylist() for i in range(len(keys))), b.column(len(keys)).to_pylist()):
                if key == own:
                    sha.update(b",")
                else:
                    if own is not None:
                        found.append((*own, sha.hexdigest()))
                    own, sha = key, hashlib.sha256()
                sha.update(text.encode())
            if found:
                yield batch(found)
        if own is not None:
            yield batch([(*own, sha.hexdigest())])

    return pieces.repartition(*keys).sortWithinPartitions(*keys, "at").select(*keys, "ids").mapInArrow(stream, f"{kinds}, ends_sha256 string")


class Shard:
    """The nodes of a shard's rows. ``first`` has the rows' begins in ``hi``, ``lo`` and ``chars``; ``longer`` says which have turns beyond the
    matrix, and ``leaves``, ``saved`` and ``child`` what these bring: leaves and savings, and whether a child's least row is this."""

    def __init__(self, conv, first, hi, lo, chars, longer, leaves, saved, child):
        n = np.diff(first)
        width = int(n.max(initial=0))
        by_id = np.lexsort((lo, hi))
        number = np.empty(len(hi), np.int32)
        fresh = np.ones(len(hi), bool)
        fresh[1:] = (hi[by_id][1:] != hi[by_id][:-1]) | (lo[by_id][1:] != lo[by_id][:-1])
        number[by_id] = np.cumsum(fresh)
        inside = np.arange(width) < n[:, None]
        grid, sizes = np.zeros(inside.shape, np.int32), np.zeros(inside.shape, np.int64)
        grid[inside], sizes[inside] = number, chars
        order = np.lexsort((conv, *grid.T[::-1]))
        self.grid, self.sizes, self.n, self.conv = grid[order], sizes[order], n[order], conv[order]
        self.longer, self.leaves, self.saved, self.child = longer[order], leaves[order], saved[order], child[order]
        changed = np.zeros((len(n), width + 1), bool)
        changed[0] = True
        changed[1:, 1:] = self.grid[1:] != self.grid[:-1]
        self.begins = np.logical_or.accumulate(changed, axis=1)
        short = min(self.n[0], self.n[-1])
        apart = np.flatnonzero(self.grid[0, :short] != self.grid[-1, :short])
        self.same = int(apart[0]) if len(apart) else int(short)  # turns that the first and the last row share
        ids = lambda row: [(int(hi[i]), int(lo[i])) for i in range(first[order[row]], first[order[row] + 1])]
        self.paths = self._path(ids(0)), self._path(ids(-1))

    @staticmethod
    def _path(ids: list[tuple[int, int]]) -> list[str]:
        """The digest of every beginning of a row."""
        sha = hashlib.blake2b(digest_size=16)
        out = [sha.hexdigest()]
        for hi, lo in ids:
            sha.update(hi.to_bytes(8, "little", signed=True) + lo.to_bytes(8, "little", signed=True))
            out.append(sha.hexdigest())
        return out

    def nodes(self, head: int) -> Iterator[dict]:
        """Columns of the nodes, a depth at a time, from the deepest up; a node comes out with its parent's depth."""
        leaves, saved, below = self.leaves.copy(), self.saved.copy(), None
        for d in range(self.grid.shape[1], -1, -1):
            alive = np.flatnonzero(self.n >= d)
            start = np.flatnonzero(self.begins[alive, d])
            row = alive[start]
            count = np.diff(np.append(start, len(alive)))
            least = np.minimum.reduceat(self.conv[alive], start)
            on = (self.n[alive] > d) | self.longer[alive] & (d == head)
            is_open = np.logical_or.reduceat(on, start)
            edge = np.zeros(len(start), np.int8)  # 1: goes on before, 2: after, 3: both
            edge[0] += self.n[0] >= d
            edge[-1] += 2 * (self.n[-1] >= d)
            if d < self.grid.shape[1]:
                kids = np.add.reduceat((self.begins[alive, d + 1] & (self.n[alive] > d)).astype(np.int64), start)
                kids[0] -= self.n[0] > d
                kids[-1] -= (self.n[-1] > d) & ~((self.n[0] > d) & (self.same > d))
            else:
                kids = np.zeros(len(start), np.int64)
            if d == head:
                kids += np.add.reduceat(self.child[alive], start)
            inner = edge == 0
            own = row[inner]
            leaves[own] += ~is_open[inner]
            if d:
                saved[own] += (count[inner] - 1) * self.sizes[own, d - 1]
            ended = ~on
            group, numbers = np.repeat(np.arange(len(start)), count)[ended], self.conv[alive[ended]].astype(str)
            ends, cuts = {}, np.flatnonzero(np.diff(group, prepend=-1))
            for g, i, j in zip(group[cuts].tolist(), cuts.tolist(), [*cuts[1:].tolist(), len(group)]):
                ends[g] = numbers[i:j]
            if below is not None:
                yield self._with_parents(below, row, least, edge, d)
            key = np.where(edge & 1, self.paths[0][d] if d <= self.n[0] else "", self.paths[1][d] if d <= self.n[-1] else "")
            below = {"depth": d, "row": row, "conv": least, "counts": (count, kids, np.add.reduceat(leaves[alive], start), np.add.reduceat(saved[alive], start)), "open": is_open, "chars": self.sizes[row, d - 1] if d else np.zeros(len(row), np.int64), "edge": edge, "key": key, "ends": ends}
        below |= {"parent": np.zeros(len(below["row"]), np.int64), "parent_key": np.full(len(below["row"]), "", object), "parent_edge": np.zeros(len(below["row"]), np.int8)}
        yield below

    def _with_parents(self, below: dict, row: np.ndarray, least: np.ndarray, edge: np.ndarray, d: int) -> dict:
        of = np.searchsorted(row, below["row"], "right") - 1
        key = np.where(edge[of] & 1, self.paths[0][d] if d <= self.n[0] else "", np.where(edge[of] > 0, self.paths[1][d] if d <= self.n[-1] else "", ""))
        return below | {"parent": least[of], "parent_key": key, "parent_edge": edge[of]}


OUT = "kind tinyint, shard int, key string, parent_key string, conv_id long, depth int, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, chars long, open boolean, ends string, path array<string>"


def shard_rows(shard: Shard, number: int, head: int) -> Iterator[pa.RecordBatch]:
    """Rows of ``OUT``: finished nodes, finished but for a parent on the edge, parts of nodes on the edge, pieces of these' ends."""
    names = [c.split(" ")[0] for c in OUT.split(", ")]
    string = pa.string()
    for x in shard.nodes(head):
        size, d = len(x["row"]), x["depth"]
        ends = np.full(size, NOTHING, object)
        pieces = []
        for g, numbers in x["ends"].items():
            if x["edge"][g]:
                for i in range(0, len(numbers), 1 << PIECE_BITS):
                    pieces.append((g, ",".join(numbers[i : i + (1 << PIECE_BITS)]), int(numbers[i])))
            else:
                ends[g] = hashlib.sha256(",".join(numbers).encode()).hexdigest()
        edge = x["edge"] > 0
        kind = np.where(edge, EDGE, np.where(x["parent_edge"] > 0, BELOW_EDGE, INNER)).astype(np.int8)
        path = [shard.paths[0 if e & 1 else 1][:d] if e else None for e in x["edge"].tolist()]
        columns = [
            pa.array(kind),
            pa.array(np.full(size, number, np.int32)),
            pa.array(np.where(edge, x["key"], None), string),
            pa.array(np.where(x["parent_edge"] > 0, x["parent_key"], None), string),
            pa.array(x["conv"]),
            pa.array(np.full(size, d, np.int32)),
            pa.array(x["parent"]),
            *(pa.array(c.astype(np.int64)) for c in x["counts"]),
            pa.array(x["chars"]),
            pa.array(x["open"]),
            pa.array(ends, string),
            pa.array(path, pa.list_(string)),
        ]
        yield pa.RecordBatch.from_arrays(columns, names=names)
        if pieces:
            rows = len(pieces)
            fixed = {"kind": pa.array([ENDS] * rows, pa.int8()), "shard": pa.array([number] * rows, pa.int32()), "key": pa.array([x["key"][g] for g, _, _ in pieces], string), "conv_id": pa.array([c for *_, c in pieces], pa.int64()), "ends": pa.array([t for _, t, _ in pieces], string)}
            yield pa.RecordBatch.from_arrays([fixed.get(n, pa.nulls(rows, columns[i].type)) for i, n in enumerate(names)], names=names)


def heads(rows: DataFrame, n: int, head: int) -> DataFrame:
    """Rows of ``OUT`` for conversations (conv, turns, longer, leaves, saved, child), in ``n`` shards."""
    ranged = rows.repartitionByRange(n, "turns", "conv")

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pa.Table.from_batches(list(it)) if (it := list(it)) else None  # a shard's
        if own is None or not own.num_rows:
            return
        own = own.combine_chunks()
        turns = own["turns"].chunk(0)
        flat = turns.flatten()
        first = np.concatenate([[0], np.cumsum(turns.value_lengths().to_numpy())])
        hi, lo, chars = (flat.field(c).to_numpy() for c in ("hi", "lo", "chars"))
        number = lambda c: own[c].to_numpy()
        yield from shard_rows(Shard(number("conv"), first, hi, lo, chars, own["longer"].to_numpy(), number("leaves"), number("saved"), number("child")), own["part"][0].as_py(), head)

    return ranged.select("conv", "turns", "longer", "leaves", "saved", "child", F.spark_partition_id().alias("part")).mapInArrow(batches, OUT)


def recombined(parts: DataFrame, steps: Steps) -> DataFrame:
    """All nodes, from the rows of ``OUT``: the parts of a node are added up, and its own leaf and savings go to the nodes above."""
    edge = parts.where(F.col("kind") == EDGE).groupBy("key").agg(F.min("conv_id").alias("conv_id"), F.min("depth").alias("depth"), F.min("parent_key").alias("parent_key"), *(F.sum(c).alias(c) for c in COUNTS), F.max("chars").alias("chars"), F.max("open").alias("open"), F.min("path").alias("path"))
    edge = steps.cut(edge, "edge")
    own = edge.select(F.explode(F.concat("path", F.array("key"))).alias("key"), F.when(F.col("open"), 0).otherwise(1).alias("leaf"), ((F.col("n_convs") - 1) * F.col("chars")).alias("worth"))
    above = own.groupBy("key").agg(F.sum("leaf").alias("leaf"), F.sum("worth").alias("worth"))
    kids = edge.where(F.col("parent_key").isNotNull()).groupBy(F.col("parent_key").alias("key")).agg(F.count(F.lit(1)).alias("kids"))
    ends = digests(parts.where(F.col("kind") == ENDS).select("key", F.col("conv_id").alias("at"), F.col("ends").alias("ids")), ["key"])
    least = edge.select("key", F.col("conv_id").alias("least"))
    whole = edge.join(above, "key").join(kids, "key", "left").join(ends, "key", "left").join(least.withColumnRenamed("key", "parent_key"), "parent_key", "left")
    whole = whole.select("conv_id", "depth", F.col("least").alias("parent_conv_id"), "n_convs", (F.col("n_children") + F.coalesce("kids", F.lit(0))).alias("n_children"), (F.col("n_leaves") + F.col("leaf")).alias("n_leaves"), (F.col("saved_tokens") + F.col("worth")).alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(NOTHING)).alias("ends_sha256"))
    inner = parts.where(F.col("kind") == INNER).withColumnRenamed("ends", "ends_sha256").select(*SHOWN)
    # a shard's own copy of what its nodes on the edge have become, so that the root's many children aren't one key
    known = parts.where(F.col("kind") == EDGE).select("shard", "key").join(least, "key").select("shard", F.col("key").alias("parent_key"), "least")
    below = parts.where(F.col("kind") == BELOW_EDGE).join(known, ["shard", "parent_key"]).withColumn("parent_conv_id", F.col("least")).withColumnRenamed("ends", "ends_sha256").select(*SHOWN)
    return inner.unionByName(below).unionByName(whole)


def tails(rows: DataFrame, long: DataFrame, head: int, steps: Steps) -> tuple[DataFrame, DataFrame]:
    """Nodes deeper than ``head``, and what each conversation brings from them (conv, leaves, saved, child). ``long`` has the conversations
    that reach ``head``, with their number of turns ``size``."""
    own = rows.join(long.select("conv"), "conv", "left_semi").withColumns({"x": F.xxhash64("pos", "hi", "lo"), "y": F.xxhash64("lo", "pos", "hi", F.lit(1))})
    path = running(own, {"px": F.col("x"), "py": F.col("y")}, "bit_xor").where(F.col("pos") >= head - 1)
    path = steps.cut(path.select("conv", (F.col("pos") + 1).alias("depth"), "px", "py", F.col("px").bitwiseXOR(F.col("x")).alias("ux"), F.col("py").bitwiseXOR(F.col("y")).alias("uy"), "chars", "pos"), "paths")
    node = ["depth", "px", "py"]
    ended = long.select("conv", F.col("size").alias("depth"))
    nodes = path.groupBy(*node).agg(F.count(F.lit(1)).alias("n_convs"), F.min("conv").alias("conv_id"), F.min("ux").alias("ux"), F.min("uy").alias("uy"), F.max("chars").alias("chars"))
    nodes = steps.cut(nodes, "nodes")
    kids = nodes.where(F.col("depth") > head).groupBy((F.col("depth") - 1).alias("depth"), F.col("ux").alias("px"), F.col("uy").alias("py")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = steps.cut(nodes.join(kids, node, "left").fillna(0, ["n_children"]), "nodes")
    met = spread_join(path, nodes.select(*node, "conv_id", "n_convs", "n_children"), node, "conv", rows=SHARD_ROWS)
    least = F.col("conv") == F.col("conv_id")
    deep = met.where(F.col("depth") > head).withColumns({"leaves": F.when(least & (F.col("n_children") == 0), 1).otherwise(0), "saved": F.when(least, (F.col("n_convs") - 1) * F.col("chars")).otherwise(0), "child": F.when(least & (F.col("depth") == head + 1), 1).otherwise(0)})
    sums = steps.cut(running(deep, {"leaves": F.col("leaves").cast("long"), "saved": F.col("saved").cast("long")}, "sum", backwards=True).select("conv", *node, "leaves", "saved", "child"), "sums")
    brought = sums.where(F.col("depth") == head + 1).select("conv", "leaves", "saved", F.col("child").cast("long").alias("child"))
    total = sums.groupBy(*node).agg(F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))
    last = path.where(F.col("depth") > head).join(ended, ["conv", "depth"], "left_semi")
    pieces = last.groupBy(*node, F.shiftright("conv", PIECE_BITS).alias("at")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv")), lambda c: c.cast("string")), ",").alias("ids"))
    parents = nodes.select(*(c.alias(f"u{i}") for i, c in enumerate((F.col("depth") + 1, F.col("px"), F.col("py")))), F.col("conv_id").alias("parent_conv_id"))
    deeper = nodes.where(F.col("depth") > head).withColumns({"u0": F.col("depth"), "u1": F.col("ux"), "u2": F.col("uy")})
    whole = spread_join(deeper, parents, ["u0", "u1", "u2"], "px", rows=SHARD_ROWS).join(total, node).join(digests(pieces, node), node, "left")
    return whole.select("conv_id", "depth", "parent_conv_id", *COUNTS, F.coalesce("ends_sha256", F.lit(NOTHING)).alias("ends_sha256")), brought


def trie(rows: DataFrame, convs: DataFrame, head: int = HEAD, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """The nodes of the trie of conversations: ``rows`` has their turns (conv, pos from 0 without gaps, hi, lo, chars; a written table), ``convs``
    all conversations (conv)."""
    with Steps(rows.sparkSession) as steps:
        turn = F.struct("pos", "hi", "lo", "chars")
        # a conversation's turns beyond the matrix are only counted here
        each = rows.unionByName(convs.select("conv"), allowMissingColumns=True).groupBy("conv").agg(F.array_sort(F.collect_list(F.when(F.col("pos") < head, turn))).alias("turns"), F.coalesce(F.max("pos") + 1, F.lit(0)).alias("size"))
        each = steps.cut(each, "rows")
        long = each.where(F.col("size") >= head).select("conv", "size")
        n, n_long = each.agg(F.count(F.lit(1)), F.count_if(F.col("size") > head)).first()
        brought = each.select("conv", *(F.lit(0).cast("long").alias(c) for c in ("leaves", "saved", "child"))).limit(0)
        deep = None
        if n_long:
            deep, brought = tails(rows, long, head, steps)
            brought = steps.cut(brought, "brought")
        full = each.join(brought, "conv", "left").fillna(0, ["leaves", "saved", "child"])
        parts = steps.cut(heads(full.withColumn("longer", F.col("size") > head), max(1, -(-n // shard_rows)), head), "parts")
        found = recombined(parts, steps)
        found = found.unionByName(deep) if deep is not None else found
        return cut(found.select(*(F.col(c).cast("string" if c == "ends_sha256" else "long").alias(c) for c in SHOWN)), "trie")


def conversation_trie(turns: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", base: Column | None = None, h: Column | None = None, most: int = 5, head: int = HEAD, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """The trie of the conversations of ``turns``. With ``base`` and ``h`` (of a column ``conv``; ``h`` is ``most`` at most), each conversation is
    first rebuilt: the first ``h`` turns of conversation ``base``, then its own after its first ``h``."""
    with Steps(turns.sparkSession) as steps:
        rows = steps.cut(numbered(turn_rows(turns, key, turn, role, text), steps), "numbered")
        if base is None:
            return trie(rows, rows.select("conv").distinct(), head, shard_rows)
        rebuilt, convs = grafted(rows, base, h, most)
        return trie(steps.cut(rebuilt, "rebuilt"), convs, head, shard_rows)


def rule() -> tuple[Column, Column]:
    """The registered query's rule: the conversation whose beginning a conversation gets, and how many turns."""
    return F.col("conv") - F.col("conv") % 100, (F.crc32(F.col("conv").cast("string").cast("binary")) % 6).cast("int")


#: DuckDB SQL for the rows of the registered query. The CRC-32 is made bit by bit; the sequence of turns is a digest of digests.
ORACLE = r"""
WITH t AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) - 1 AS i, concat(length(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, '')) AS x, length(coalesce(text, '')) AS n FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT c, c - c % 100 AS b, xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], flatten(list_transform(range(1, length(CAST(c AS VARCHAR)) + 1), lambda k: list_transform(range(8), lambda j: CASE WHEN j = 0 THEN ascii(substr(CAST(c AS VARCHAR), k, 1)) ELSE 0 END)))),
 lambda s, y: xor(xor(s, y) >> 1, CASE WHEN xor(s, y) % 2 = 1 THEN CAST(3988292384 AS BIGINT) ELSE 0 END)), CAST(4294967295 AS BIGINT)) % 6 AS h FROM (SELECT DISTINCT c FROM t)),
r AS (SELECT c.c, t.i, t.x, t.n FROM c JOIN t ON t.c = c.b AND t.i < c.h UNION ALL SELECT c.c, t.i + 10, t.x, t.n FROM c JOIN t ON t.c = c.c AND t.i >= c.h),
s AS (SELECT c, row_number() OVER w AS d, n, sha256(string_agg(sha256(x), ',') OVER w) AS p FROM r WINDOW w AS (PARTITION BY c ORDER BY i)),
a AS (SELECT c, 0 AS d, 0 AS n, '' AS p FROM c UNION ALL SELECT c, d, n, p FROM s),
e AS (SELECT c, d, n, p, lag(p) OVER w AS u, d = max(d) OVER (PARTITION BY c) AS ended, min(c) OVER (PARTITION BY d, p) = c AS least, count(*) OVER (PARTITION BY d, p) AS size FROM a WINDOW w AS (PARTITION BY c ORDER BY d)),
f AS (SELECT *, bool_and(ended) OVER (PARTITION BY d, p) AS shut FROM e),
g AS (SELECT *, sum(CASE WHEN shut AND least THEN 1 ELSE 0 END) OVER w AS leaves, sum(CASE WHEN least THEN (size - 1) * n ELSE 0 END) OVER w AS saved FROM f WINDOW w AS (PARTITION BY c ORDER BY d DESC)),
k AS (SELECT d - 1 AS d, u AS p, count(*) AS kids FROM (SELECT DISTINCT d, u, p FROM e WHERE d > 0) GROUP BY d, u),
v AS (SELECT d, p, min(c) AS conv_id, min(u) AS u, count(*) AS n_convs, sum(leaves) AS leaves, sum(saved) AS saved, sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (ended), '')) AS ends FROM g GROUP BY d, p)
SELECT v.conv_id, CAST(v.d AS BIGINT) AS depth, o.conv_id AS parent_conv_id, v.n_convs, CAST(coalesce(k.kids, 0) AS BIGINT) AS n_children, CAST(v.leaves AS BIGINT) AS n_leaves, CAST(v.saved AS BIGINT) AS saved_tokens, v.ends AS ends_sha256
FROM v LEFT JOIN k ON k.d = v.d AND k.p = v.p LEFT JOIN v o ON o.d = v.d - 1 AND o.p = v.u
"""
