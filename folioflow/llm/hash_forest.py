"""Approximate nearest neighbours by a hash-prefix forest (operator 2).

Every vector has a string of ``BITS`` hash bits in each of ``TREES`` trees (signs of random projections), and a tree is the
sorted array of these strings. A query descends in every tree to the longest prefix that it has in common with some
string. Then all trees ascend together, a bit at a time, and what lies under the prefixes becomes a candidate, until there
are ``GATHER`` times as many as the shard has distinct vectors. Candidates are scored exactly, by their cosine in double precision.

The vectors are dealt to shards of about ``SHARD_ROWS`` by a hash of their key, each shard has a forest of its own, and the
nearest of all shards are merged. The queries are a stated set, and blocks of about ``QUERY_ROWS`` of them go to every shard.
So each task holds a bounded part of both, and the recall doesn't fall with the number of shards: the nearest of all are
nearer than the nearest of a shard. Equal vectors may be any number: a shard's candidates are distinct vectors, each with all
its rows of that shard, and shards are even.

What is scored is a share of all pairs of a query and a vector. Where vectors are close to uniform on the sphere, as here, no
hash does much better: trees that agree on a longer prefix are few for neighbours at 60 degrees. README has share and recall.

Edge cases: vectors that are null, empty or zero, or that hold null, NaN or infinite components take no part, nor do rows
without a key; very large and very small components count like others; rows with equal key (repeated rows, too) are one row, that with the smaller vector; vectors of different length
aren't compared; ties go to the smaller key; a query with fewer candidates than asked for gets all; an empty table has no
rows; other columns, whatever their names, are ignored. There is no text here that could be long.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

TREES = 128
BITS = 32
#: The part of a shard's distinct vectors that the ascent gathers at least; it stops at a whole bit, so it is more like 0.4.
GATHER = 0.3
SHARD_ROWS = 8192
QUERY_ROWS = 16384
#: Queries that descend and ascend together.
TOGETHER = 128
SEED = 7


def usable(vector: Column) -> Column:
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return vector.isNotNull() & (F.size(vector) > 0) & F.forall(vector, fine) & F.exists(vector, lambda x: x != 0)


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows by a power of two each so that the largest component is near one: exact, but for components that are too small beside it to
    count, and no square overflows or vanishes."""
    _, power = np.frexp(np.abs(x).max(axis=-1, keepdims=True, initial=0))
    return np.ldexp(x, -power)


def exact_cosine(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Row by row, so that equal rows get equal numbers. Rows are ``scaled``."""
    return (x * q).sum(1) / (np.sqrt((x * x).sum(1)) * np.sqrt((q * q).sum()))


class Forest:
    def __init__(self, x: np.ndarray, trees: int = TREES, bits: int = BITS, seed: int = SEED):
        self.planes = np.random.default_rng(seed).standard_normal((trees, x.shape[1], bits))
        self.bits, self.size = bits, len(x)
        codes = self.strings(x)
        self.order = np.argsort(codes, axis=1, kind="stable").astype(np.int32)
        self.sorted = np.take_along_axis(codes, self.order, 1)

    def strings(self, x: np.ndarray) -> np.ndarray:
        """A row of bit strings, as numbers, for each tree."""
        weight = np.uint64(1) << np.arange(self.bits - 1, -1, -1, dtype=np.uint64)
        return np.stack([(((x @ p) > 0).astype(np.uint64) @ weight).astype(np.uint32) for p in self.planes])

    def candidates(self, queries: np.ndarray, enough: int) -> Iterator[np.ndarray]:
        """For each query the rows that the synchronous ascent gathers."""
        for at in range(0, len(queries), TOGETHER):
            yield from self._candidates(self.strings(queries[at : at + TOGETHER]), enough)

    def _candidates(self, codes: np.ndarray, enough: int) -> Iterator[np.ndarray]:
        trees, n = codes.shape
        low, high = np.zeros((self.bits + 1, trees, n), np.int32), np.full((self.bits + 1, trees, n), self.size, np.int32)
        for depth in range(1, self.bits + 1):
            rest = np.uint32((1 << (self.bits - depth)) - 1)
            for t in range(trees):
                low[depth, t] = np.searchsorted(self.sorted[t], codes[t] & ~rest, "left")
                high[depth, t] = np.searchsorted(self.sorted[t], codes[t] | rest, "right")
            if not (high[depth] > low[depth]).any():
                low[depth + 1 :], high[depth + 1 :] = 0, 0
                break
        width = (high - low).sum(1, dtype=np.int64)  # by depth and query, repeats included
        for q in range(n):
            found = np.zeros(self.size, bool)
            depth = int(np.flatnonzero(width[:, q] > 0)[-1])  # the longest prefix in any tree
            while True:
                if width[depth, q] >= enough or depth == 0:
                    for t in range(trees):
                        found[self.order[t, low[depth, t, q] : high[depth, t, q]]] = True
                    if depth == 0 or found.sum() >= enough:
                        break
                depth -= 1
            yield np.flatnonzero(found)


def shard_neighbours(ids: np.ndarray, x: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int, gather: float) -> pd.DataFrame:
    """The k nearest of a shard for each query, by key where the cosine is equal."""
    x, queries = scaled(x), scaled(queries)
    distinct, place = np.unique(x, axis=0, return_inverse=True)
    place = place.ravel()
    by_vector = np.lexsort((ids, place))
    first = np.searchsorted(place[by_vector], np.arange(len(distinct) + 1))
    forest = Forest(distinct)
    unit = distinct / np.sqrt((distinct * distinct).sum(1, keepdims=True))
    out = []
    for i, rows in enumerate(forest.candidates(queries, min(len(distinct), max(k + 1, int(gather * len(distinct)))))):
        near = unit[rows] @ (queries[i] / np.sqrt((queries[i] * queries[i]).sum()))
        least = np.partition(near, -(k + 1))[-(k + 1)] if len(near) > k + 1 else -np.inf
        rows = rows[near >= least - 1e-9]
        found = []
        for r, c in zip(rows, exact_cosine(distinct[rows], queries[i])):
            own = ids[by_vector[first[r] : first[r + 1]]][: k + 1]
            found += [(-c, v) for v in own if v != query_ids[i]]
        out += [(query_ids[i], v, -c) for c, v in sorted(found)[:k]]
    return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])


def nearest(vectors: DataFrame, is_query: Column, k: int = 5, key: str = "vec_id", vector: str = "embedding", gather: float = GATHER, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """For each row that ``is_query`` holds for: its ``k`` nearest other rows (query_id, rank from 1, vec_id, score)."""
    from pyspark.sql import Window as W

    own = vectors.where(F.col(key).isNotNull() & usable(F.col(vector))).withColumn("_query", F.coalesce(is_query, F.lit(False)))
    rows = own.groupBy(F.col(key).cast("long").alias("id")).agg(F.min(vector).alias("x"), F.max("_query").alias("query")).withColumn("size", F.size("x"))
    n, asked = rows.agg(F.count(F.lit(1)), F.count_if("query")).first()
    shards, parts = max(1, -(-n // shard_rows)), max(1, -(-asked // QUERY_ROWS))
    dealt = rows.select("size", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int").alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), "id", "x")
    asking = rows.where("query").select("size", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(parts)).cast("int").alias("part"), "id", "x")

    def search(own: pd.DataFrame, asking: pd.DataFrame) -> pd.DataFrame:
        if not len(own) or not len(asking):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        stack = lambda c: np.stack(c.to_numpy()).astype(np.float64)
        return shard_neighbours(own["id"].to_numpy(), stack(own["x"]), asking["id"].to_numpy(), stack(asking["x"]), k, gather)

    by = ["size", "shard", "part"]
    found = dealt.groupBy(*by).cogroup(asking.groupBy(*by)).applyInPandas(search, "query_id bigint, vec_id bigint, score double")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
