"""Hard-negative mining with STR-packed R-trees (operator 13).

Vectors of integers, the components times ``SCALE`` and rounded down, are points; a row's score is its inner product with an
anchor. The positives of an anchor are the nearest other rows of its label; for each positive, the hard negatives are the best rows
of other labels whose score lies between ``low`` and ``high`` percent of the positive's.

The rows are dealt to shards of about ``SHARD_ROWS`` by a hash of their key. A shard packs its points into an R-tree: sorted by label,
and then sort-tile-recursive, a coordinate after another (the widest first), into pages of ``PAGE`` points, and pages into nodes
of ``FANOUT``. A node keeps the least and the largest value of every coordinate, and its labels. For an anchor, each coordinate of
a box gives an interval of products, and their sums bound the scores of all points inside. A best-first queue opens the box with
the highest upper bound; it leaves out boxes that lie outside all score windows, that have no label of the right kind, or whose upper
bound is strictly below the k-th score found so far (boxes that tie with it are opened, as a smaller key may be inside).

Two rounds: the best positives of all shards are merged, and their windows go to the shards again. The anchors are a stated set;
blocks of about ``ANCHOR_ROWS`` of them go to every shard, so each task holds a bounded part of both, however often a label or a
vector occurs. The result is exact. What is scored is at worst all pairs of an anchor and a row: README has the share.

Edge cases: rows without key or label, without vector, or with a null, NaN or infinite component take no part; rows with equal
key (repeated rows, too) are one row, that with the smaller label, then the smaller vector; vectors of different length aren't
compared; ties go to the smaller key; an anchor without positives, or a positive without negatives, has no rows; an empty table has
no rows; other columns, whatever their names, are ignored. Scores are exact; one that no 64-bit number holds is shown, and
compared between shards, as the nearest such number. There is no text here that could be long.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

POSITIVES = 5
NEGATIVES = 5
#: A negative's score in percent of the positive's, at least and at most.
LOW, HIGH = 80, 100
SCALE = 256
SHARD_ROWS = 16384
ANCHOR_ROWS = 4096
PAGE = 256
FANOUT = 8

_LONG = (1 << 63) - 1


def usable(vector: Column) -> Column:
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))


def integers(rows: list[np.ndarray]) -> np.ndarray:
    """floor(SCALE * x) of every component: as doubles where all inner products are then exact, else as Python's integers."""
    x = np.stack([np.asarray(r, np.float64) for r in rows])
    with np.errstate(over="ignore"):
        scaled = np.floor(SCALE * x)
    most = float(np.abs(scaled).max(initial=0))
    if x.shape[1] * most * most < 2.0**53:
        return scaled
    whole = lambda v: int(v) * SCALE if abs(v) >= 2.0**52 else math.floor(v * SCALE)
    return np.array([[whole(v) for v in r] for r in x.tolist()], object).reshape(x.shape)


class RTree:
    """Points in the order of their pages, and the boxes of every level, the root's first."""

    def __init__(self, points: np.ndarray, labels: np.ndarray, keys: np.ndarray, page: int = PAGE, fanout: int = FANOUT):
        packed = self._packed(points, labels, page)
        order, ends = np.concatenate(packed), np.cumsum([len(p) for p in packed])
        self.points, self.labels, self.keys = points[order], labels[order], keys[order]
        starts = np.concatenate([[0], ends[:-1]])
        low, high = np.minimum.reduceat(self.points, starts), np.maximum.reduceat(self.points, starts)
        least, most = np.minimum.reduceat(self.labels, starts), np.maximum.reduceat(self.labels, starts)
        self.pages = [*zip(starts.tolist(), ends.tolist())]
        self.levels = [(low, high, least, most)]
        while len(self.levels[0][0]) > 1:
            low, high, least, most = self.levels[0]
            starts = np.arange(0, len(low), fanout)
            self.levels.insert(0, (np.minimum.reduceat(low, starts), np.maximum.reduceat(high, starts), np.minimum.reduceat(least, starts), np.maximum.reduceat(most, starts)))
        self.fanout, self.scored = fanout, 0

    @staticmethod
    def _packed(points: np.ndarray, labels: np.ndarray, page: int) -> list[np.ndarray]:
        """Sort-tile-recursive: slabs by label, and a slab is cut in two or more along the next coordinate, until it is a page."""
        dims = points.shape[1]
        if points.dtype == object:
            spread = np.argsort([-float(points[:, i].max() - points[:, i].min()) for i in range(dims)], kind="stable")
        else:
            spread = np.argsort(-points.std(axis=0), kind="stable")
        rows = np.argsort(labels, kind="stable")
        runs = np.flatnonzero(np.diff(labels[rows], prepend=labels[rows[0]] - 1)).tolist()
        cuts = [0]
        for i, j in zip(runs, [*runs[1:], len(rows)]):  # small labels share a slab, one of a page or more has its own
            if i > cuts[-1] and (i - cuts[-1] >= page or j - i >= page):
                cuts.append(i)
        out, todo = [], [(rows[i:j], 0) for i, j in zip(cuts, [*cuts[1:], len(rows)])][::-1]
        while todo:
            rows, d = todo.pop()
            pages = -(-len(rows) // page)
            if pages <= 1 or d == dims:
                out += [rows[i : i + page] for i in range(0, len(rows), page)]
                continue
            slabs = max(2, math.ceil(pages ** (1 / (dims - d))))
            size = page * -(-pages // slabs)
            rows = rows[np.argsort(points[rows, spread[d]], kind="stable")]
            todo += [(rows[i : i + size], d + 1) for i in range(0, len(rows), size)][::-1]
        return out

    def bounds(self, anchors: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each level, the least and the largest inner product that a point in each box can have with each anchor: a
        coordinate gives the interval between its products with both ends of the box."""
        up, down = np.maximum(anchors, 0), np.minimum(anchors, 0)
        return [(up.dot(low.T) + down.dot(high.T), up.dot(high.T) + down.dot(low.T)) for low, high, *_ in self.levels]

    def search(self, anchor: np.ndarray, bounds: list[tuple[np.ndarray, np.ndarray]], label: int, same: bool, windows: list[tuple], k: int, but: int | None) -> list[list[tuple]]:
        """For each window (least and largest score; ``None``: open) the first ``k`` (-score, key) of the points of the label, or of all
        others. ``bounds`` are the anchor's, by level; ``but`` is a key to leave out."""
        found: list[list[tuple]] = [[] for _ in windows]
        queue: list[tuple] = []

        def push(level: int, first: int, last: int) -> None:
            low, high = bounds[level]
            _, _, least, most = self.levels[level]
            for i in range(first, last):
                if (least[i] <= label <= most[i]) if same else not least[i] == label == most[i]:
                    heapq.heappush(queue, (-high[i], level, i, low[i]))

        def open_for(low, high) -> list[int]:
            """The windows that a box with these bounds may still add to."""
            return [w for w, (least, most) in enumerate(windows) if (least is None or high >= least) and (most is None or low <= most) and (len(found[w]) < k or high >= -found[w][-1][0])]

        push(0, 0, len(self.levels[0][0]))
        while queue:
            high, level, i, low = heapq.heappop(queue)
            wanted = open_for(low, -high)
            if not wanted:
                continue
            if level + 1 < len(self.levels):
                push(level + 1, i * self.fanout, min((i + 1) * self.fanout, len(self.levels[level + 1][0])))
                continue
            first, last = self.pages[i]
            self.scored += last - first
            score = self.points[first:last].dot(anchor)
            labels, keys = self.labels[first:last], self.keys[first:last]
            fits = (labels == label) if same else (labels != label)
            if but is not None:
                fits &= keys != but
            for w in wanted:
                least, most = windows[w]
                own = fits if least is None else fits & (score >= least)
                own = own if most is None else own & (score <= most)
                if len(found[w]) >= k:
                    own = own & (score >= -found[w][-1][0])
                if not (rows := np.flatnonzero(own)).size:
                    continue
                if len(rows) > k:
                    rows = rows[np.lexsort((keys[rows], -score[rows]))[:k]] if score.dtype != object else np.array(sorted(rows, key=lambda r: (-score[r], keys[r]))[:k])
                found[w] = sorted(found[w] + [(-int(score[r]), int(keys[r])) for r in rows.tolist()])[:k]
        return found


def _clip(score: int) -> int:
    return max(-_LONG - 1, min(_LONG, score))


def _stack(column: pd.Series, others: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """Both columns of vectors as integers of one kind."""
    both = integers([*column, *others])
    return both[: len(column)], both[len(column) :]


def mine(vectors: DataFrame, is_anchor: Column, label: str | Column = "label", key: str = "vec_id", vector: str = "embedding", positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, shard_rows: int = SHARD_ROWS, anchor_rows: int = ANCHOR_ROWS, page: int = PAGE) -> DataFrame:
    """For each row that ``is_anchor`` holds for and each of its positives: the hard negatives (anchor_id, positive_id, rank from 1,
    negative_id, positive_score, negative_score)."""
    label = F.col(label) if isinstance(label, str) else label
    own = vectors.select(F.col(key).cast("long").alias("id"), label.cast("long").alias("label"), F.col(vector).alias("x"), F.coalesce(is_anchor, F.lit(False)).alias("anchor"))
    own = own.where(F.col("id").isNotNull() & F.col("label").isNotNull() & usable(F.col("x")))
    rows = own.groupBy("id").agg(F.min(F.struct("label", "x")).alias("r"), F.max("anchor").alias("anchor")).select("id", "r.label", "r.x", "anchor").withColumn("size", F.size("x"))
    n, asked = rows.agg(F.count(F.lit(1)), F.count_if("anchor")).first()
    shards, parts = max(1, -(-n // shard_rows)), max(1, -(-asked // anchor_rows))
    dealt = rows.select("size", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int").alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), "id", "label", "x")
    part = F.pmod(F.xxhash64("id", F.lit(1)), F.lit(parts)).cast("int").alias("to_part")
    every = F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("to_shard")
    anchors = rows.where("anchor").select(F.col("size").alias("of_size"), part, *(F.col(c).alias(f"of_{c}") for c in ("id", "label", "x")))
    asked_for = ["of_size", every, "to_part", "of_id", "of_label", "of_x"]

    def searched(asking: DataFrame, search: Callable, schema: str) -> DataFrame:
        def run(own: pd.DataFrame, asking: pd.DataFrame) -> pd.DataFrame:
            names = [c.split(" ")[0] for c in schema.split(", ")]
            if not len(own) or not len(asking):
                return pd.DataFrame({c: [] for c in names})
            points, queries = _stack(own["x"], asking["of_x"])
            tree = RTree(points, own["label"].to_numpy(), own["id"].to_numpy(), page)
            out = []
            for at in range(0, len(asking), 512):
                some = asking.iloc[at : at + 512]
                bounds = tree.bounds(queries[at : at + 512])
                for i, row in enumerate(some.itertuples(index=False)):
                    out += search(tree, queries[at + i], [(a[i], b[i]) for a, b in bounds], row)
            return pd.DataFrame(out, columns=names)

        return dealt.groupBy("size", "shard", "part").cogroup(asking.groupBy("of_size", "to_shard", "to_part")).applyInPandas(run, schema)

    def nearest(tree: RTree, anchor: np.ndarray, bounds: list, row) -> list[tuple]:
        return [(row.of_id, v, _clip(-s)) for s, v in tree.search(anchor, bounds, row.of_label, True, [(None, None)], positives, row.of_id)[0]]

    def between(tree: RTree, anchor: np.ndarray, bounds: list, row) -> list[tuple]:
        # low * p <= 100 * n <= high * p, in whole numbers
        windows = [(-(-low * p // 100), high * p // 100) for p in map(int, row.scores)]
        found = tree.search(anchor, bounds, row.of_label, False, windows, negatives, None)
        return [(row.of_id, int(p), int(ps), v, _clip(-s)) for p, ps, best in zip(row.positives, row.scores, found) for s, v in best]

    best = searched(anchors.select(*asked_for), nearest, "anchor_id bigint, positive_id bigint, positive_score bigint")
    rank = F.row_number().over(W.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id"))
    best = best.withColumn("rank", rank).where(F.col("rank") <= positives)
    # an anchor has so many positives at most
    best = best.groupBy(F.col("anchor_id").alias("of_id")).agg(F.array_sort(F.collect_list(F.struct("rank", "positive_id", "positive_score"))).alias("p"))
    windows = anchors.join(best, "of_id").select(*asked_for, F.col("p.positive_id").alias("positives"), F.col("p.positive_score").alias("scores"))
    found = searched(windows, between, "anchor_id bigint, positive_id bigint, positive_score bigint, negative_id bigint, negative_score bigint")
    rank = F.row_number().over(W.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= negatives).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def relabelled() -> Column:
    """The registered query's labels: those of every seventh row are moved on by one."""
    return F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))


#: DuckDB SQL for the rows of the registered query: every anchor against all rows.
ORACLE = """
WITH v AS (SELECT vec_id AS i, CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS BIGINT) AS l, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS x FROM embeddings
 WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT a.i AS a, b.i AS b, a.l = b.l AS same, CAST(list_dot_product(a.x, b.x) AS BIGINT) AS s FROM v a JOIN v b ON a.i <> b.i AND len(a.x) = len(b.x) WHERE a.i % 100 = 0),
p AS (SELECT a, b, s FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC, b) <= 5)
SELECT p.a AS anchor_id, p.b AS positive_id, CAST(row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.s DESC, s.b) AS INTEGER) AS rank, s.b AS negative_id, p.s AS positive_score, s.s AS negative_score
FROM p JOIN s ON s.a = p.a AND NOT s.same AND 80 * p.s <= 100 * s.s AND 100 * s.s <= 100 * p.s QUALIFY rank <= 5
"""
