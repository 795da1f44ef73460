"""Connected components of a table of links."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..store import Steps
from .skew import ROWS_PER_PART, spread_join

#: Labels halve their distance to the least one each round; more rounds than this mean that something is wrong.
MAX_ROUNDS = 60


def components(links: DataFrame) -> DataFrame:
    """(node, label) for every node of ``links`` (a, b): the least node that it is linked with, directly or not.

    Each round takes the least label among the neighbours and then the label of that label. All tables stay distributed
    and are written to the shared folder each round; links of one node meet by a pre-aggregated minimum, and a node that
    many are linked with is dealt out when it gives them its label.
    """
    with Steps(links.sparkSession) as steps:
        both = steps.cut(links.select(F.col("a").alias("node"), F.col("b").alias("other")).union(links.select("b", "a")).where("node != other").distinct(), "links")
        degrees = steps.cut(both.groupBy("other").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > ROWS_PER_PART), "degrees")
        labels = steps.cut(both.groupBy("node").agg(F.least(F.col("node"), F.min("other")).alias("label")), "labels")
        for _ in range(MAX_ROUNDS):
            near = spread_join(both, labels.withColumnRenamed("node", "other"), "other", "node", sizes=degrees).groupBy("node").agg(F.min("label").alias("near"))
            lower = steps.cut(labels.join(near, "node").select("node", "label", F.least("label", "near").alias("lower")), "lower")
            roots = labels.select(F.col("node").alias("lower"), F.col("label").alias("root"))
            found = spread_join(lower, roots, "lower", "node", how="left")
            new = steps.cut(found.select("node", F.least("lower", F.coalesce("root", "lower")).alias("label"), F.col("label").alias("old")), "labels")
            steps.drop(lower, labels)
            labels = new
            if new.where("label != old").isEmpty():
                steps.keep(new)
                return new.select("node", "label")
    raise RuntimeError("labels did not settle")


def _least_members(pairs: list[tuple[int, int]]) -> dict[int, int]:
    """The least member of every node's component."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {x: root(x) for x in parent}


def components_within(links: DataFrame, group: str) -> DataFrame:
    """(``group``, node, label) for links (``group``, a, b) that never leave their group, such as strokes of a page: one shuffle
    by group, and each group is solved where it lands. For groups of any size use ``components``."""

    def solve(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(links: list[tuple]) -> pa.RecordBatch:
            found = _least_members([(a, b) for _, a, b in links])
            own = {x: g for g, a, b in links for x in (a, b)}
            return pa.RecordBatch.from_arrays([pa.array([own[x] for x in found], kind), pa.array(found.keys(), pa.int64()), pa.array(found.values(), pa.int64())], names=[group, "node", "label"])

        held: list[tuple] = []
        last = kind = None
        for batch in it:
            if not batch.num_rows:
                continue
            groups, kind = batch.column(0).to_pylist(), batch.column(0).type
            pairs = list(zip(groups, batch.column(1).to_pylist(), batch.column(2).to_pylist()))
            if held and groups[0] != last:
                yield out(held)
                held = []
            last = groups[-1]
            whole = next(i for i in range(len(groups)) if groups[i] == last)  # the last group may go on in the next batch
            if whole:
                yield out(held + pairs[:whole])
                held = []
            held += pairs[whole:]
        if held:
            yield out(held)

    schema = f"{group} {links.schema[group].dataType.simpleString()}, node bigint, label bigint"
    return links.select(group, F.col("a").cast("long"), F.col("b").cast("long")).repartition(group).sortWithinPartitions(group).mapInArrow(solve, schema)
