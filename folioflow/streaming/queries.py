"""The streams as queries: each reads a given table as a stream, runs until all of it is read, and returns what it wrote."""

from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import lifecycle
from ..plans.registry import ORACLES, QUERIES
from ..plans.views import view, with_views
from ..store import cut, files, passing, scratch
from . import streams as S, timed as T
from .upserts import Upserts, upserted

_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stream_query(name: str, sql: str) -> Callable:
    """Register a function of (spark, folder of tables)."""

    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[name], ORACLES[name] = f, with_views(sql)
        return f

    return register


@contextmanager
def state_in_rocks(spark: SparkSession):
    """States of any number of keys need a store outside the heap."""
    before = spark.conf.get(_STORE)
    spark.conf.set(_STORE, _ROCKS)
    try:
        yield
    finally:
        spark.conf.set(_STORE, before)


def table_stream(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A given table, a file or a folder of files, as a stream."""
    path = f"{sf_dir}/{table}.parquet"
    fs, where = files(spark, path)
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    return reader.parquet(path) if fs.getFileStatus(where).isDirectory() else reader.option("pathGlobFilter", f"{table}.parquet").parquet(sf_dir)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table_stream(spark, sf_dir, "events").withColumn("at", F.col("ts").cast("timestamp"))


#: Micro-batches that a table is cut into.
SLICES = 4


def sliced(rows: DataFrame, at: str, after: DataFrame | None = None, slices: int = SLICES) -> DataFrame:
    """A table as a stream that comes in several micro-batches: cut by the time ``at`` and written slice by slice, as many files each as
    one trigger reads; ``after`` comes at last and a second later again, so that alarms that the last rows set ring, too."""
    spark, path = rows.sparkSession, scratch(rows.sparkSession, "slices")
    per_slice = spark.sparkContext.defaultParallelism
    first, last = rows.agg(F.min(F.unix_micros(at)), F.max(F.unix_micros(at))).first()
    cut = F.least(F.floor((F.unix_micros(at) - first) * slices / max(1, last - first)), F.lit(slices - 1))
    if after is not None:  # a row for each file
        after = after.withColumn("_file", F.explode(F.sequence(F.lit(1), F.lit(per_slice)))).drop("_file")
    for part in [*(rows.where(cut == i) for i in range(slices)), *([after, after.withColumn(at, F.col(at) + F.expr("INTERVAL 1 SECOND"))] if after is not None else [])]:
        part.repartition(per_slice).write.mode("append").parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", per_slice).parquet(path)


def ticking(rows: DataFrame, key: str, seconds: float) -> DataFrame:
    """A row without meaning that comes so long after all others: the clock goes on when nothing happens."""
    last = rows.agg((F.max("at") + F.expr(f"INTERVAL {seconds} SECONDS")).alias("at"))
    return last.select(*(F.col("at") if f.name == "at" else F.lit("tick").cast(f.dataType).alias(f.name) if f.name == key else F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema.fields))


def given_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "events").withColumn("at", F.col("ts").cast("timestamp"))


def drained(stream: DataFrame, mode: str = "append") -> DataFrame:
    """What the stream wrote once all that is there was read."""
    spark, path, checkpoint = stream.sparkSession, scratch(stream.sparkSession, "drained"), scratch(stream.sparkSession, "checkpoint")
    spark.createDataFrame([], stream.schema).write.parquet(path)
    put = lambda batch, _: batch.write.mode("append" if mode == "append" else "overwrite").parquet(path)
    with state_in_rocks(spark):
        stream.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


@stream_query(
    "usage_stream",
    """SELECT model, CAST(count(*) AS BIGINT) AS calls, CAST(count(*) FILTER (ok) AS BIGINT) AS ok, CAST(count(*) FILTER (NOT ok) AS BIGINT) AS failed, CAST(coalesce(sum(prompt_tokens) FILTER (ok), 0) AS BIGINT) AS prompt_tokens,
 CAST(coalesce(sum(completion_tokens) FILTER (ok), 0) AS BIGINT) AS completion_tokens, max(called) AS last_call FROM v_usage_calls GROUP BY model""",
)
def usage_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of models, of which each micro-batch writes those that it changes; compacted on the way."""
    e = F.col
    calls = given_events(spark, sf_dir).select("at", e("event_id").alias("called"), F.concat(F.lit("m"), (e("user_id") % 5).cast("string")).alias("model"), (e("event_type") != "error").alias("ok"), F.floor(e("value") * 10).alias("prompt_tokens"), F.floor(e("value") * 3).alias("completion_tokens"))
    table = Upserts(spark, scratch(spark, "usage"), S.USAGE, "model")
    with state_in_rocks(spark):
        upserted(S.usage_stream(sliced(calls, "at")), table, scratch(spark, "checkpoint"), every=2).awaitTermination()
    return table.read()


@stream_query(
    "tag_stream",
    "SELECT event_id, event_type, CASE event_type WHEN 'click' THEN 'ink' WHEN 'view' THEN 'book' WHEN 'purchase' THEN 'note' ELSE 'other' END AS svc, CASE event_type WHEN 'click' THEN 'notes' WHEN 'view' THEN 'transfer' WHEN 'purchase' THEN 'notes' ELSE '' END AS tab FROM events",
)
def tag_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two services, of the even and of the odd events, as one stream."""
    rows = events(spark, sf_dir)
    return drained(S.tag_stream(rows.where("event_id % 2 = 0"), rows.where("event_id % 2 = 1")))


_ORDERED = "SELECT *, row_number() OVER (PARTITION BY k ORDER BY s, z) AS n FROM"


@stream_query(
    "coalesced_wakeups",
    f"""WITH RECURSIVE f AS ({_ORDERED} (SELECT user_id AS k, epoch_us(CAST(ts AS TIMESTAMP)) AS s, 0 AS z FROM events)),
r AS (SELECT k, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS until, false AS dirty, []::BIGINT[] AS wakes, []::BIGINT[] AS gens FROM (SELECT DISTINCT k FROM f)
 UNION ALL SELECT k, n, CASE WHEN s >= busy THEN s + 21600000000 ELSE busy END, s < busy, CASE WHEN s >= busy THEN list_append(w, s) ELSE w END, CASE WHEN s >= busy THEN list_append(g, n) ELSE g END FROM
 (SELECT f.k, f.n, f.s, CASE WHEN r.dirty AND r.until <= f.s THEN r.until + 21600000000 ELSE r.until END AS busy, CASE WHEN r.dirty AND r.until <= f.s THEN [r.until] ELSE [] END AS w, CASE WHEN r.dirty AND r.until <= f.s THEN [r.n] ELSE [] END AS g FROM r JOIN f ON f.k = r.k AND f.n = r.n + 1)),
e AS (SELECT k, unnest(wakes) AS s, unnest(gens) AS g FROM r UNION ALL SELECT k, until, n FROM (SELECT *, n = max(n) OVER (PARTITION BY k) AS last FROM r) WHERE last AND dirty)
SELECT CAST(k AS VARCHAR) AS area, CAST(g AS BIGINT) AS generation, CAST(s AS BIGINT) AS at FROM e""",
)
def coalesced_wakeups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events change the area of their user; a reader is busy for six hours."""
    rows = given_events(spark, sf_dir).select(F.col("user_id").cast("string").alias("area"), "at")
    return drained(T.wakeups(sliced(rows, "at", ticking(rows, "area", 90_000)), busy=21_600)).where("area <> 'tick'")


@stream_query(
    "lockout_stream",
    f"""WITH RECURSIVE f AS ({_ORDERED} (SELECT user_id % 20 AS k, epoch_us(CAST(ts AS TIMESTAMP)) AS s, event_type <> 'error' AS z FROM events WHERE event_type IN ('error', 'signup'))),
r AS (SELECT k, CAST(0 AS BIGINT) AS n, []::BIGINT[] AS recent, CAST(0 AS BIGINT) AS s, CAST(NULL AS BIGINT) AS until FROM (SELECT DISTINCT k FROM f)
 UNION ALL SELECT k, n, CASE WHEN z THEN [] WHEN len(kept) >= 3 THEN kept ELSE list_append(kept, s) END, s, CASE WHEN NOT z AND len(kept) = 2 THEN kept[1] + 86400000000 END FROM (SELECT f.k, f.n, f.s, f.z, list_filter(r.recent, lambda x: x > f.s - 86400000000) AS kept FROM r JOIN f ON f.k = r.k AND f.n = r.n + 1)),
locks AS (SELECT k, s, until FROM r WHERE until IS NOT NULL)
SELECT CAST(k AS VARCHAR) AS ip, 'locked' AS event, s AS at FROM locks
UNION ALL SELECT CAST(k AS VARCHAR), 'unlocked', least(until, coalesce((SELECT min(f.s) FROM f WHERE f.k = l.k AND f.z AND f.s > l.s), until)) FROM locks l""",
)
def lockout_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors are failures of a source, and signups are its successes; three failures in a day lock it."""
    rows = given_events(spark, sf_dir).where("event_type IN ('error', 'signup')").select((F.col("user_id") % 20).cast("string").alias("ip"), "at", (F.col("event_type") != "error").alias("ok"))
    return drained(T.lock_stream(sliced(rows, "at", ticking(rows, "ip", 90_000)), limit=3, seconds=86_400)).where("ip <> 'tick'")


@stream_query(
    "retry_escalation",
    f"""WITH RECURSIVE f AS ({_ORDERED} (SELECT user_id AS k, epoch_us(CAST(ts AS TIMESTAMP)) AS s, event_type = 'signup' AS z FROM events WHERE event_type <> 'purchase')),
r AS (SELECT k, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS tries, CAST(NULL AS BIGINT) AS last, CAST(NULL AS BIGINT) AS hand, CAST(NULL AS BIGINT) AS gone FROM (SELECT DISTINCT k FROM f)
 UNION ALL SELECT k, n, CASE WHEN z THEN 0 WHEN due THEN had + 1 ELSE had END, CASE WHEN z THEN NULL WHEN due THEN s ELSE before END, CASE WHEN due AND NOT z THEN s END, gone FROM (SELECT *, before IS NULL OR s - before >= 43200000000 AS due FROM
 (SELECT f.k, f.n, f.s, f.z, over, CASE WHEN over THEN 0 ELSE tries END AS had, CASE WHEN over THEN NULL ELSE last END AS before, CASE WHEN over THEN last + 43200000000 END AS gone FROM (SELECT r.*, f.n AS next, r.tries = 3 AND r.last + 43200000000 <= f.s AS over FROM r JOIN f ON f.k = r.k AND f.n = r.n + 1) r JOIN f ON f.k = r.k AND f.n = r.next))),
e AS (SELECT k, 'hand' AS action, hand AS t FROM r WHERE hand IS NOT NULL UNION ALL SELECT k, 'give_up', gone FROM r WHERE gone IS NOT NULL
 UNION ALL SELECT k, 'give_up', last + 43200000000 FROM (SELECT *, n = max(n) OVER (PARTITION BY k) AS ended FROM r) WHERE ended AND tries = 3)
SELECT CAST(k AS VARCHAR) AS item, action, CAST(t AS BIGINT) AS at FROM e""",
)
def retry_escalation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events ask for the work of their user, twice a day and three times at most; signups say that it is done."""
    rows = given_events(spark, sf_dir).where("event_type <> 'purchase'").select(F.col("user_id").cast("string").alias("item"), "at", (F.col("event_type") == "signup").alias("done"))
    return drained(T.hand_out_stream(sliced(rows, "at", ticking(rows, "item", 90_000)), quiet=43_200, most=3)).where("item <> 'tick'")


@stream_query(
    "auto_review_gate",
    """WITH RECURSIVE f AS (SELECT user_id, epoch_us(CAST(ts AS TIMESTAMP)) / 1e6 AS s, event_id % 3 AS due, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id % 3) AS n FROM events),
r AS (SELECT user_id, CAST(0 AS BIGINT) AS n, CAST(-1e18 AS DOUBLE) AS last, CAST(0 AS DOUBLE) AS s, false AS fires FROM (SELECT DISTINCT user_id FROM f)
 UNION ALL SELECT user_id, n, CASE WHEN fires THEN s ELSE last END, s, fires FROM (SELECT f.user_id, f.n, f.s, r.last, f.due > 0 AND f.s - r.last >= 72000 AS fires FROM r JOIN f ON f.user_id = r.user_id AND f.n = r.n + 1))
SELECT CAST(user_id AS VARCHAR) AS user, CAST(round(s) AS BIGINT) AS fired FROM r WHERE fires""",
)
def auto_review_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two events of three find something due."""
    checks = events(spark, sf_dir).select(F.col("user_id").cast("string").alias("user"), "at", (F.col("event_id") % 3).cast("int").alias("due"))
    return drained(S.auto_review_gate(checks)).select("user", F.round(F.unix_micros("fired_at") / 1e6).cast("long").alias("fired"))


def _command_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The view's commands with the time at which they arrive: every 40th comes ten days after it was given."""
    c = view(spark, sf_dir, "v_commands")
    given = F.col("ts").cast("timestamp")
    return c.select(F.col("entry").alias("id"), given.alias("at"), "seq", "cmd", F.concat(F.lit("draft "), F.col("seq").cast("string")).alias("arg"), (F.col("seq") + 1704067200).alias("done_at"), F.when(F.col("seq") % 40 == 0, given + F.expr("INTERVAL 10 DAYS")).otherwise(given).alias("arrives"))


#: Where each command is cut off: the watermark is a day behind the newest command of the micro-batches before its own.
_ARRIVED = f"""arrived AS (SELECT *, epoch_us(CAST(ts AS TIMESTAMP)) AS given, epoch_us(CAST(ts AS TIMESTAMP)) + CASE WHEN seq % 40 = 0 THEN 864000000000 ELSE 0 END AS arrives FROM v_commands),
batched AS (SELECT *, least(floor((arrives - min(arrives) OVER ()) * {SLICES} / (max(arrives) OVER () - min(arrives) OVER ())), {SLICES} - 1) AS batch FROM arrived),
marks AS (SELECT b.batch, max(x.given) - 86400000000 AS mark FROM (SELECT DISTINCT batch FROM batched) b JOIN batched x ON x.batch < b.batch GROUP BY b.batch),
judged AS (SELECT b.*, coalesce(floor(given / 1000) <= floor(mark / 1000), false) AS late FROM batched b LEFT JOIN marks m ON m.batch = b.batch)"""


def command_stream(spark: SparkSession, sf_dir: str) -> tuple[Upserts, DataFrame]:
    """The entries after the commands of the view, which come in several micro-batches, and the late commands."""
    rows = _command_rows(spark, sf_dir)
    tick = rows.agg((F.max("at") + F.expr("INTERVAL 20 DAYS")).alias("at")).select(F.lit(-1).cast("long").alias("id"), "at", F.lit(-1).cast("long").alias("seq"), F.lit("").alias("cmd"), F.lit("").alias("arg"), F.lit(0).cast("long").alias("done_at"), F.col("at").alias("arrives"))
    table = Upserts(spark, scratch(spark, "entries"), f"id long, state {lifecycle.STATE}", "id")
    table.merge(lifecycle.state_of(view(spark, sf_dir, "v_entries")), -1)
    late = Upserts(spark, scratch(spark, "late"), "seq long, id long, cmd string", "seq")
    with state_in_rocks(spark):
        S.apply_command_stream(sliced(rows, "arrives", tick).drop("arrives"), table, late, scratch(spark, "checkpoint"), "1 day").awaitTermination()
    return table, late.read()


@stream_query("apply_commands_late", f"WITH {_ARRIVED} SELECT seq, entry AS id, cmd FROM judged WHERE late")
def apply_commands_late(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commands that came when the watermark had passed them, one by one."""
    return command_stream(spark, sf_dir)[1]


_FOLD = lifecycle.COMMANDS_SQL.removeprefix("WITH RECURSIVE ").replace("FROM v_commands", "FROM (SELECT * FROM judged WHERE NOT late)")


@stream_query("apply_commands_stream", f"WITH RECURSIVE {_ARRIVED}, {_FOLD}")
def apply_commands_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entries after the commands that weren't late: what the batch fold gives for these."""
    s = F.col("state")
    entries = command_stream(spark, sf_dir)[0].read()
    return entries.select("id", s["status"].alias("status"), s["text"].alias("text"), F.size(s["drafts"]).cast("long").alias("drafts"), s["updated"].alias("updated"), s["rejected"].cast("long").alias("rejected"))


_INGESTED = lifecycle._CLAIM_SQL.replace("stored % 4 AS state", "0 AS state").replace("ORDER BY stored % 4 = 3, ", "ORDER BY ")


@stream_query(
    "ingest_stream",
    f"""{_INGESTED}, h AS (SELECT l.cluster, sha256(string_agg(CAST(stroke_no AS VARCHAR), ';' ORDER BY stroke_no)) AS ink_hash FROM label l GROUP BY l.cluster), h_ AS (SELECT l.cluster, sha256(string_agg(CAST(stroke_no AS VARCHAR), ';' ORDER BY stroke_no)) AS ink_hash FROM label_ l GROUP BY l.cluster)
SELECT c.page, h.ink_hash, 'mined' AS status FROM claims c JOIN h ON h.cluster = c.pos UNION ALL SELECT c.page, h_.ink_hash, 'revoked' FROM claims c JOIN h_ ON CAST(h_.cluster AS VARCHAR) = c.id WHERE c.outcome = 'revoked'""",
)
def ingest_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three scans of all pages, a micro-batch each: the first lacks every fifth stroke, and the third is the second again."""
    highlights = view(spark, sf_dir, "v_highlights").limit(0)
    table = Upserts(spark, scratch(spark, "entries"), S.ENTRY, "book", "page", "id")
    with state_in_rocks(spark), passing():
        strokes = cut(view(spark, sf_dir, "v_strokes"), "strokes")
        pages = cut(strokes.select("page").distinct(), "pages")
        scans = [pages.select(F.col("page").alias("page_key"), F.lit("b").alias("book"), "page", F.lit(i).cast("timestamp").alias("at")) for i in range(3)]
        rows = scans[0].unionByName(scans[1]).unionByName(scans[2])
        of_scan = lambda n: strokes.where("stroke_no % 5 <> 0") if n == 0 else strokes
        S.ingest_stream(sliced(rows, "at", slices=3).drop("at"), table, of_scan, highlights, scratch(spark, "checkpoint")).awaitTermination()
    return table.read(of=("ink_hash", "status")).select("page", "ink_hash", "status")
