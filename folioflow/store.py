"""Lineage cuts that survive the loss of executors."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from collections import deque
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager, suppress
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

_left: dict[str, SparkSession] = {}
#: The folders of applications on one machine that have no setting.
_own: dict[str, str] = {}
#: The paths that ``passing`` collects in this thread.
_passing: ContextVar[list[str] | None] = ContextVar("passing", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Where it is unset, a session on a single
    machine (``local[...]``, as in tests) gets a folder of its own; a cluster has none that would do, so that is an error."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        application = spark.sparkContext.applicationId
        where = _own[application] = _own.get(application) or tempfile.mkdtemp(prefix="spark-folio-")
    return where.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nobody has; what is written there goes when the program ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _left[path] = spark
    if (noted := _passing.get()) is not None:
        noted.append(path)
    return path


def files(spark: SparkSession, path: str):
    """The file system of a path, and the path for it."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def delete(spark: SparkSession, path: str, address: bool = False) -> None:
    """Delete a file or folder, given by its path or by its address."""
    fs, where = files(spark, path)
    fs.delete(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(spark.sparkContext._jvm.java.net.URI(path)) if address else where, True)


def replace(spark: SparkSession, source: str, target: str) -> None:
    """Move a file (its address, as Spark's ``_metadata.file_path`` has it) over another or to where none is, in one step."""
    fs, to = files(spark, target)
    fs.mkdirs(to.getParent())
    jvm = spark.sparkContext._jvm
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(source)), to, options)


def replace_all(spark: SparkSession, moves, threads: int = 32) -> None:
    """``replace`` for pairs (source, target), many at a time; they are read as they are needed."""
    with ThreadPoolExecutor(threads) as pool:
        waiting = deque()
        for source, target in moves:
            waiting.append(pool.submit(replace, spark, source, target))
            if len(waiting) >= 8 * threads:
                waiting.popleft().result()
        for w in waiting:
            w.result()


#: Partitions of ``put_files`` for each core, so that no task has all files.
PUT_PARTS = 4


def _put_local(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    """Write rows (name, value), sorted by name, as files of a folder that this machine has."""
    name = out = None
    aside = f"{folder}/.put-{uuid.uuid4().hex}"  # a name with a dot isn't listed

    def done() -> None:
        if out:
            out.close()
            parent, own = os.path.split(f"{folder}/{name}")
            os.makedirs(parent, exist_ok=True)
            with suppress(FileNotFoundError):  # the sum of a file that Hadoop wrote there
                os.remove(f"{parent}/.{own}.crc")
            os.replace(aside, f"{parent}/{own}")

    try:
        for batch in batches:
            for n, value in zip(batch.column("name").to_pylist(), batch.column("value").to_pylist()):
                if n != name:
                    done()
                    name, out = n, open(aside, "w", encoding="utf-8", newline="")
                out.write(f"{value or ''}\n")
        done()
    finally:
        if out:
            out.close()
        with suppress(FileNotFoundError):
            os.remove(aside)
    yield from ()


def put_files(rows: DataFrame, path: str) -> None:
    """Write texts (name, value; several rows of a name are lines, in the order of a column ``line`` if there is one) as the files of a folder.
    Each is written aside by one task and moved to its place in one step: by the task itself where the folder is one of the shared file
    system's, else by the driver."""
    spark, path = rows.sparkSession, path.rstrip("/")
    order = ["name", *(["line"] if "line" in rows.columns else [])]
    parts = PUT_PARTS * spark.sparkContext.defaultParallelism  # a number, as small rows would be put together in one task
    own = rows.repartition(parts, "name").sortWithinPartitions(*order).select("name", "value")
    fs, where = files(spark, path)
    if fs.getScheme() == "file":
        fs.mkdirs(where)
        folder = where.toUri().getPath()
        own.mapInArrow(lambda batches: _put_local(batches, folder), "name string").write.format("noop").mode("overwrite").save()
        return
    aside = f"{path}/_aside-{uuid.uuid4().hex}"
    own.write.option("maxRecordsPerFile", 0).partitionBy("name").text(aside)
    if rows.isEmpty():
        return delete(spark, aside)
    written = spark.read.schema("value string, name string").text(aside).select("name", F.col("_metadata.file_path").alias("source")).distinct()
    replace_all(spark, ((r.source, f"{path}/{r.name}") for r in written.toLocalIterator()))
    delete(spark, aside)


def _delete(spark: SparkSession, path: str) -> None:
    delete(spark, path)
    _left.pop(path, None)


def _delete_all() -> None:
    for path, spark in list(_left.items()):
        try:
            _delete(spark, path)
        except Exception:  # the session has ended before the program
            return


atexit.register(_delete_all)


@contextmanager
def _setting(spark: SparkSession, name: str, value: str):
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def placed_by_part_of_keys(spark: SparkSession):
    """Within it, a join of two tables that both lie by some of its keys leaves them where they are."""
    return _setting(spark, "spark.sql.requireAllClusterKeysForCoPartition", "false")


def freeing_shuffles(spark: SparkSession):
    """Within it, what a statement shuffled is deleted when it ends. Else it stays on the disks of the executors until the driver
    collects its garbage, which one with a quiet heap doesn't for half an hour."""
    return _setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def cut(df: DataFrame, name: str = "step") -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back: whatever follows starts from files. They go
    when the program ends, or before by ``Steps``."""
    return _written(df, name)[0]


def _written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    spark = df.sparkSession
    path = scratch(spark, name)
    with freeing_shuffles(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


@contextmanager
def passing():
    """What is written to the shared folder within it, in this thread, goes when it ends; the paths that are taken off its list stay."""
    noted: list[str] = []
    token = _passing.set(noted)
    try:
        yield noted
    finally:
        _passing.reset(token)
        for path in noted:
            if path in _left:
                _delete(_left[path], path)


def _made(make: Callable[[], DataFrame], name: str) -> tuple[DataFrame, str]:
    with passing() as noted:
        table, path = _written(make(), name)
        noted.remove(path)
    if (outer := _passing.get()) is not None:
        outer.append(path)
    return table, path


def made(make: Callable[[], DataFrame], name: str = "step") -> DataFrame:
    """``cut`` of what ``make`` gives. The tables that it cut on its way go as soon as this one is written."""
    return _made(make, name)[0]


class Steps:
    """The cuts of one computation. ``drop`` deletes those that nothing reads any more, once what was made from them has
    been cut itself; leaving the block deletes all but the tables that were given to ``keep``."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def __enter__(self) -> Steps:
        return self

    def cut(self, df: DataFrame, name: str = "step") -> DataFrame:
        table, path = _written(df, name)
        self.paths[id(table)] = (table, path)
        return table

    def made(self, make: Callable[[], DataFrame], name: str = "step") -> DataFrame:
        """``cut`` of what ``make`` gives; the tables that it cut on its way go as soon as this one is written."""
        table, path = _made(make, name)
        self.paths[id(table)] = (table, path)
        return table

    def keep(self, *tables: DataFrame) -> None:
        for t in tables:
            self.paths.pop(id(t), None)

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            _delete(self.spark, self.paths.pop(id(t))[1])

    def __exit__(self, *_) -> None:
        self.drop(*(t for t, _ in list(self.paths.values())))
