"""Streaming forms of the operators. Event time and watermarks stand for the processing time of a single device, so that a
stream can be replayed and gives what its batch form gives. Rows later than the watermark are not part of a result;
``late_rows`` shows them."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import datetime, timedelta, timezone

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.catalog import ingest
from ..operators.ledger import bursts
from ..operators.lifecycle import apply_commands
from ..operators.shelf import tag_events
from ..store import Steps, cut
from . import timed
from .upserts import Upserts


def debounce(changes: DataFrame, quiet: str = "4 seconds", late: str = "10 seconds") -> DataFrame:
    """(user_id, at, event_type) to one row a burst, after ``quiet`` without a change."""
    return bursts(changes.withWatermark("at", late), quiet).select("user_id", F.col("window.start").alias("first_at"), "changes", "names")


def tag_stream(*services: DataFrame) -> DataFrame:
    """The streams of all services as one, tagged."""
    out = services[0]
    for s in services[1:]:
        out = out.unionByName(s)
    return tag_events(out)


USAGE = "model string, calls long, ok long, failed long, prompt_tokens long, completion_tokens long, last_call long"


def usage_stream(calls: DataFrame) -> DataFrame:
    """Running totals of each model from calls (model, called, ok, prompt_tokens, completion_tokens); a failed call counts, its tokens don't.
    In update mode a micro-batch gives the models that it changes, with their totals: rows for ``Upserts``."""
    tokens = lambda c: F.coalesce(F.sum(F.when(F.col("ok"), F.col(c))), F.lit(0)).alias(c)
    return calls.groupBy("model").agg(F.count(F.lit(1)).alias("calls"), F.count_if("ok").alias("ok"), F.count_if(~F.col("ok")).alias("failed"), tokens("prompt_tokens"), tokens("completion_tokens"), F.max("called").alias("last_call"))


def apply_command_stream(commands: DataFrame, entries: Upserts, late: Upserts, checkpoint: str, wait: str = "10 seconds"):
    """Start a query that applies commands (id, at as a time, seq, cmd, arg, done_at) to the entries (id, state) of a table.

    A command waits until the watermark has passed it, so commands are applied in the order of their time, whatever order they
    come in; the fold itself is the batch operator's, over the entries that a micro-batch touches. One that comes when the
    watermark has passed it goes to ``late`` (seq, id, cmd), none is dropped. Both tables take a batch by its number: one that
    runs twice starts from the entries before it and writes the same again.
    """
    spark = commands.sparkSession

    def apply(batch: DataFrame, n: int) -> None:
        with Steps(spark) as steps:
            own = steps.cut(batch, "commands")
            late.merge(own.where("late"), n)
            due = own.where("NOT late")
            touched = entries.read(before=n).join(due.select("id").distinct(), "id", "left_semi")
            place = F.row_number().over(W.partitionBy("id").orderBy("given", "seq")).cast("long").alias("seq")
            entries.merge(apply_commands(touched, due.select("id", place, "cmd", "arg", "at")), n)

    return timed.ordered_commands(commands, wait).writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def await_render(delivered: DataFrame, rendered: DataFrame, seconds: int = 600, late: str = "10 minutes") -> DataFrame:
    """Deliveries (uuid, delivered_at) with their render (uuid, rendered_at) within the time, else ``timeout``."""
    d = delivered.withWatermark("delivered_at", late)
    r = rendered.withColumnRenamed("uuid", "r_uuid").withWatermark("rendered_at", late)
    near = (F.col("uuid") == F.col("r_uuid")) & (F.col("rendered_at") >= F.col("delivered_at")) & (F.col("rendered_at") <= F.col("delivered_at") + F.expr(f"INTERVAL {seconds} SECONDS"))
    return d.join(r, near, "leftOuter").select("uuid", "delivered_at", F.when(F.col("rendered_at").isNull(), "timeout").otherwise("ok").alias("render"))


def snapshot_expiry(positions: DataFrame, library: DataFrame, now_ms: int, days: int = 30) -> DataFrame:
    """Positions that are young enough and whose book is still there."""
    return positions.where(F.col("at_ms") >= now_ms - days * 86_400_000).join(library.select("uuid"), "uuid", "left_semi")


def late_rows(rows: DataFrame, at: str, watermark: datetime) -> DataFrame:
    """What a stream with this watermark leaves out, for a side table."""
    return rows.where(F.col(at) < F.lit(watermark))


def _seconds(t) -> float:
    return pd.Timestamp(t).tz_localize("UTC").timestamp() if pd.Timestamp(t).tzinfo is None else pd.Timestamp(t).timestamp()


def _times(seconds: list[float]) -> pd.Series:
    return pd.to_datetime(pd.Series([round(s * 1e6) for s in seconds], dtype="int64"), unit="us")


class BoundedLockout(StatefulProcessor):
    """The same for all sources of a shard, of which it remembers ``cap`` at most. A new source takes the place of one whose
    failures have all expired, or else of the one that failed least lately, unlocked sources before locked ones: so nobody
    gets out of a lock by failing from other addresses."""

    def __init__(self, cap: int, limit: int = 5, seconds: int = 60):
        self.cap, self.limit, self.seconds = cap, limit, seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.sources = handle.getValueState("sources", "failures map<string,array<double>>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        recent = {ip: list(v) for ip, v in self.sources.get()[0].items()} if self.sources.exists() else {}
        locks = []
        for at, ok, ip in sorted((_seconds(r.at), r.ok, r.ip) for batch in rows for r in batch.itertuples()):
            if ok:
                recent.pop(ip, None)
                continue
            if ip not in recent and len(recent) >= self.cap:
                recent = {k: v for k, v in recent.items() if v[-1] > at - self.seconds}
                if len(recent) >= self.cap:
                    del recent[min(recent, key=lambda k: (len(recent[k]) >= self.limit, recent[k][-1]))]
            held = [x for x in recent.get(ip, []) if x > at - self.seconds]
            if len(held) < self.limit:
                held.append(at)
                if len(held) == self.limit:
                    locks.append((ip, at))
            recent[ip] = held
        self.sources.update((recent,))
        yield pd.DataFrame({"ip": pd.Series([x[0] for x in locks], dtype=object), "locked_at": _times([x[1] for x in locks])})

    def close(self) -> None:
        pass


def bounded_lockout_stream(attempts: DataFrame, cap: int, limit: int = 5, seconds: int = 60, shards: int = 64) -> DataFrame:
    """(ip, at, ok) to (ip, locked_at), with a bound on the sources that are remembered: each of ``shards`` parts has its share."""
    own = attempts.withColumn("shard", F.pmod(F.xxhash64("ip"), F.lit(shards)).cast("int"))
    return own.groupBy("shard").transformWithStateInPandas(BoundedLockout(-(-cap // shards), limit, seconds), "ip string, locked_at timestamp", "Append", "None")


class Gate(StatefulProcessor):
    """At most one firing in a time, and only when something is due."""

    def __init__(self, hours: float = 20):
        self.seconds = hours * 3600

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.fired = handle.getValueState("fired", "at double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last, out = self.fired.get()[0] if self.fired.exists() else float("-inf"), []
        for at, due in sorted((_seconds(r.at), r.due) for batch in rows for r in batch.itertuples()):
            if due > 0 and at - last >= self.seconds:
                last = at
                out.append(at)
        if out:
            self.fired.update((last,))
        yield pd.DataFrame({"user": pd.Series([key[0]] * len(out), dtype=object), "fired_at": _times(out)})

    def close(self) -> None:
        pass


def auto_review_gate(checks: DataFrame, hours: float = 20) -> DataFrame:
    """(user, at, due) to (user, fired_at)."""
    return checks.groupBy("user").transformWithStateInPandas(Gate(hours), "user string, fired_at timestamp", "Append", "None")


FILE = "path string, modified timestamp, length bigint"


def settled_files(spark: SparkSession, path: str, quiet_s: float = 5) -> DataFrame:
    """(path, modified, length, content) of the files of a folder, of any size, that were left alone for the time; names that
    begin with a dot are unfinished, and Spark doesn't list files without content. A younger file is found by a later call."""
    before = datetime.now(timezone.utc) - timedelta(seconds=quiet_s)
    found = spark.read.format("binaryFile").options(modifiedBefore=before.strftime("%Y-%m-%dT%H:%M:%S"), timeZone="UTC", pathGlobFilter="[!.]*").load(path)
    return found.select("path", F.col("modificationTime").alias("modified"), "length", "content")


def stream_inbox(spark: SparkSession, path: str, taken: str, take: Callable[[DataFrame], DataFrame], checkpoint: str, quiet_s: float = 5, every: str = "5 seconds"):
    """Start a query that gives the settled files of a folder to ``take``, each once, and keeps a record of them.

    A file source lists a file once, whatever its age then, so the folder is listed anew at every tick of a clock, and the
    table ``taken`` (path, modified, length, reason) says what is done: ``take`` gets (path, modified, length, content) and
    returns (path, modified, reason), the reason being null for what it took. A file that is written again is a new one. If a
    tick fails after ``take`` and before its record, its files come again.
    """
    spark.createDataFrame([], FILE + ", reason string").write.mode("ignore").parquet(taken)

    def tick(_: DataFrame, n: int) -> None:
        done = spark.read.schema(FILE + ", reason string").parquet(taken)
        new = settled_files(spark, path, quiet_s).join(done.select("path", "modified"), ["path", "modified"], "left_anti")
        outcome = cut(take(new).select("path", "modified", "reason"), "inbox")
        sizes = new.select("path", "modified", "length")
        if not outcome.isEmpty():
            sizes.join(outcome, ["path", "modified"]).select("path", "modified", "length", "reason").write.mode("append").parquet(taken)

    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return ticks.writeStream.foreachBatch(tick).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()


def kept_failures(failed: DataFrame, most_bytes: int = 50 * 1024 * 1024) -> DataFrame:
    """The failed files (path, modified, length, reason) that the archive has room for: the newest, up to the bound. The others'
    content may go. Days are summed first, so only the day in which the bound lies is ordered file by file."""
    day = F.to_date("modified")
    own = failed.where("reason IS NOT NULL").withColumn("_day", day)
    days = own.groupBy("_day").agg(F.sum("length").alias("_bytes"))
    newer = F.coalesce(F.sum("_bytes").over(W.orderBy(F.desc("_day")).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    before = days.withColumn("_newer", newer).where(F.col("_newer") < most_bytes).select("_day", "_newer")
    within = F.sum("length").over(W.partitionBy("_day").orderBy(F.desc("modified"), "path").rowsBetween(W.unboundedPreceding, 0))
    return own.join(F.broadcast(before), "_day").withColumn("_held", within + F.col("_newer")).where(F.col("_held") <= most_bytes).select("path", "modified", "length", "reason")


ENTRY = "book string, page long, id string, seq long, status string, ink_hash string, strokes array<string>, quote_id string"


#: So many changed pages are broadcast to find their entries.
FEW_PAGES = 100_000


def ingest_stream(changes: DataFrame, entries: Upserts, scan: Callable[[int], DataFrame], highlights: DataFrame, checkpoint: str):
    """Start a query that mines the changed pages (page_key, book, page) of every micro-batch and merges them into the entries of a table.

    ``scan(n)`` gives the strokes as batch ``n`` finds them. The batch is merged into the entries as they were before it and is written
    under its number, so one that runs twice changes nothing.
    """
    spark = changes.sparkSession

    def merge(batch: DataFrame, n: int) -> None:
        with Steps(spark) as steps:
            pages = steps.cut(batch.select("book", "page").distinct(), "pages")
            stored = entries.rows(before=n)
            if pages.count() <= FEW_PAGES:  # of many pages all rows go to their page, in the shuffle that the drafts take, too
                stored = stored.join(F.broadcast(pages), ["book", "page"], "left_semi")
            entries.merge(ingest(scan(n), highlights, stored, pages, steps), n)

    return changes.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
