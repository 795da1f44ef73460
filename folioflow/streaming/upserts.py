"""Tables that streams update: each micro-batch writes the rows that it changes as a version of its own, and a batch that runs
twice writes the same version again."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..store import delete, files, freeing_shuffles

#: Tables stay for long and have hashes and ids in digits, which the default codec doesn't make smaller.
CODEC = "zstd"


class Upserts:
    """A table of rows by key in a shared folder. ``merge`` puts the rows of a batch beside those of earlier ones, ``read`` gives the
    latest of each key, ``compact`` writes them as one base. Nothing is changed in place: a version counts once it is whole."""

    def __init__(self, spark: SparkSession, path: str, schema: str, *keys: str):
        self.spark, self.path, self.schema, self.keys = spark, path.rstrip("/"), schema, keys

    def _whole(self, kind: str) -> list[int]:
        fs, where = files(self.spark, self.path)
        if not fs.exists(where):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(where)]
        found = [int(n.split("=")[1]) for n in names if n.startswith(f"{kind}=")]
        return sorted(v for v in found if fs.exists(files(self.spark, f"{self.path}/{kind}={v}/_SUCCESS")[1]))

    def versions(self, before: int | None = None) -> tuple[int | None, list[int]]:
        """The newest base and the versions after it, of those ``before`` a version."""
        fits = lambda v: before is None or v < before
        base = max(filter(fits, self._whole("base")), default=None)
        return base, [v for v in self._whole("version") if fits(v) and (base is None or v > base)]

    def rows(self, before: int | None = None, of: tuple[str, ...] | None = None) -> DataFrame:
        """What the base and the versions ``before`` one hold, with the ``_version`` that wrote each row; of a key's rows the latest counts.
        ``of`` names the columns that are asked for besides the keys."""
        base, versions = self.versions(before)
        whole = [("version", v) for v in versions] + ([("base", base)] if base is not None else [])
        found = [self.spark.read.schema(self.schema).parquet(f"{self.path}/{kind}={v}").withColumn("_version", F.lit(v)) for kind, v in whole]
        rows = reduce(DataFrame.unionByName, found) if found else self.spark.createDataFrame([], f"{self.schema}, _version int")
        return rows if of is None else rows.select(*[c for c in rows.columns if c in (*self.keys, *of, "_version")])

    def read(self, before: int | None = None, of: tuple[str, ...] | None = None) -> DataFrame:
        """The latest row of each key, of versions ``before`` one; columns as of ``rows``."""
        rows = self.rows(before, of)
        if not self.versions(before)[1]:
            return rows.drop("_version")
        columns = [c for c in rows.columns if c not in (*self.keys, "_version")]
        latest = rows.groupBy(*self.keys).agg(F.max_by(F.struct(*columns), "_version").alias("_row"))
        return latest.select(*self.keys, "_row.*").select(*[c for c in rows.columns if c != "_version"])

    def merge(self, rows: DataFrame, version: int) -> None:
        """The rows that batch ``version`` changes, one for each key. They may be made from ``read(before=version)``."""
        names = self.spark.createDataFrame([], self.schema).columns
        with freeing_shuffles(rows.sparkSession):
            rows.select(*names).write.mode("overwrite").option("compression", CODEC).parquet(f"{self.path}/version={version}")

    def compact(self, upto: int) -> None:
        """All up to version ``upto`` as one base. What the base before it covers is deleted; what this one covers stays until the
        next time, for those who are reading."""
        before = self._whole("base")
        if upto in before or not self.versions(upto + 1)[1]:
            return
        with freeing_shuffles(self.spark):
            self.read(before=upto + 1).write.mode("overwrite").option("compression", CODEC).parquet(f"{self.path}/base={upto}")
        if before:
            gone = [("version", v) for v in self._whole("version") if v <= before[-1]] + [("base", v) for v in before[:-1]]
            for kind, v in gone:
                delete(self.spark, f"{self.path}/{kind}={v}")


def upserted(stream: DataFrame, table: Upserts, checkpoint: str, rows=lambda batch, n: batch, mode: str = "update", every: int = 16):
    """Start a query that merges ``rows(batch, n)`` of every micro-batch into a table, and compacts it after so many of them."""

    def put(batch: DataFrame, n: int) -> None:
        table.merge(rows(batch, n), n)
        if n % every == every - 1:
            table.compact(n - 1)

    return stream.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
