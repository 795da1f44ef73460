"""Ledgers: model usage and cost, lockout, batched changes."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from ..functions import entries as E
from ..plans.registry import query


@query(
    "usage_by_model",
    "v_usage_calls",
    sql="""SELECT model, CAST(count(*) AS BIGINT) AS calls, CAST(count(*) FILTER (ok) AS BIGINT) AS ok_calls, CAST(count(*) FILTER (NOT ok) AS BIGINT) AS failed, CAST(sum(CASE WHEN ok THEN prompt_tokens ELSE 0 END) AS BIGINT) AS prompt_tokens,
 CAST(sum(CASE WHEN ok THEN completion_tokens ELSE 0 END) AS BIGINT) AS completion_tokens, max(called) AS last_at, substring(max_by(err, called) FILTER (NOT ok), 1, 200) AS last_error FROM v_usage_calls GROUP BY model""",
)
def usage_by_model(calls: DataFrame) -> DataFrame:
    spent = lambda c: F.sum(F.when(F.col("ok"), F.col(c)).otherwise(0))
    return calls.groupBy("model").agg(
        F.count(F.lit(1)).alias("calls"),
        F.count_if("ok").alias("ok_calls"),
        F.count_if(~F.col("ok")).alias("failed"),
        spent("prompt_tokens").alias("prompt_tokens"),
        spent("completion_tokens").alias("completion_tokens"),
        F.max("called").alias("last_at"),
        F.substring(F.max_by("err", F.when(~F.col("ok"), F.col("called"))), 1, 200).alias("last_error"),
    )


@query(
    "usage_cost",
    "v_usage_calls",
    "v_prices",
    sql="""SELECT coalesce(p.model, u.model) AS model, coalesce(prompt, 0) AS prompt_tokens, coalesce(completion, 0) AS completion_tokens,
 CASE WHEN p.input_per1k > 0 OR p.output_per1k > 0 THEN coalesce(prompt, 0) / 1000.0 * p.input_per1k + coalesce(completion, 0) / 1000.0 * p.output_per1k END AS cost
 FROM v_prices p FULL JOIN (SELECT model, CAST(sum(CASE WHEN ok THEN prompt_tokens ELSE 0 END) AS BIGINT) AS prompt, CAST(sum(CASE WHEN ok THEN completion_tokens ELSE 0 END) AS BIGINT) AS completion FROM v_usage_calls GROUP BY model) u ON p.model = u.model""",
)
def usage_cost(calls: DataFrame, prices: DataFrame) -> DataFrame:
    """Cost of every model that has a price or was used; null where no price is set."""
    used = usage_by_model(calls).select("model", "prompt_tokens", "completion_tokens")
    both = prices.join(used, "model", "full").fillna(0, ["prompt_tokens", "completion_tokens"])
    cost = F.col("prompt_tokens") / 1000.0 * F.col("input_per1k") + F.col("completion_tokens") / 1000.0 * F.col("output_per1k")
    return both.select("model", "prompt_tokens", "completion_tokens", F.when((F.col("input_per1k") > 0) | (F.col("output_per1k") > 0), cost).alias("cost"))


@query("usage_model_set", "v_usage_calls", "v_prices", sql="SELECT model, min(preset) AS preset FROM (SELECT model, 0 AS preset FROM v_prices UNION ALL SELECT model, 1 FROM v_usage_calls) GROUP BY model")
def usage_model_set(calls: DataFrame, prices: DataFrame) -> DataFrame:
    """Priced models (0) first, then the others that were used (1)."""
    return prices.select("model", F.lit(0).alias("preset")).unionByName(calls.select("model", F.lit(1).alias("preset"))).groupBy("model").agg(F.min("preset").alias("preset"))


@query(
    "usage_key",
    "v_usage_calls",
    "v_prices",
    sql="SELECT c.called, CASE WHEN p.model IS NULL THEN concat('custom:', c.model) ELSE c.model END AS usage_key FROM v_usage_calls c LEFT JOIN v_prices p ON c.model = p.model",
)
def usage_key(calls: DataFrame, presets: DataFrame) -> DataFrame:
    found = calls.join(presets.select("model", F.lit(True).alias("preset")), "model", "left")
    return found.select("called", F.when(F.col("preset"), F.col("model")).otherwise(F.concat(F.lit("custom:"), F.col("model"))).alias("usage_key"))


@query(
    "lockout_window",
    "v_auth_failures",
    sql="""WITH RECURSIVE f AS (SELECT ip, ts, epoch_us(CAST(ts AS TIMESTAMP)) AS us, row_number() OVER (PARTITION BY ip ORDER BY ts) AS n FROM v_auth_failures),
r AS (SELECT ip, CAST(0 AS BIGINT) AS n, []::BIGINT[] AS recent, CAST(NULL AS TIMESTAMP) AS ts, false AS locked, false AS locks FROM (SELECT DISTINCT ip FROM f)
 UNION ALL SELECT ip, n, CASE WHEN len(kept) >= 5 THEN kept ELSE list_append(kept, us) END, ts, len(kept) >= 5, len(kept) = 4 FROM (SELECT f.ip, f.n, f.us, CAST(f.ts AS TIMESTAMP) AS ts, list_filter(r.recent, lambda x: f.us - x < 86400000000) AS kept FROM r JOIN f ON f.ip = r.ip AND f.n = r.n + 1))
SELECT ip, ts, locked, locks FROM r WHERE n > 0""",
)
def lockout_window(failures: DataFrame, seconds: int = 86400, limit: int = 5) -> DataFrame:
    """Each failure, whether its source was locked then, and whether it locks it."""
    return lockouts(failures.withColumn("at", F.unix_micros(F.col("ts").cast("timestamp"))), seconds * 1_000_000, limit).select("ip", "ts", "locked", "locks")


def lockouts(failures: DataFrame, window: int, limit: int) -> DataFrame:
    """Failures (ip, at, ...) with ``locked`` and ``locks``. A source is locked by ``limit`` failures within the window until the
    first of them is older than that; failures meanwhile aren't counted, so what counts depends on what was before.

    The rule is sequential within a source. Its failures are read in order, a batch at a time, and no more than ``limit`` of
    them are held, however many a source has.
    """

    def scan(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        source, recent = None, deque()
        for batch in it:
            locked, locks = [], []
            for ip, at in zip(batch["ip"], batch["at"]):
                if ip != source:
                    source, recent = ip, deque()
                while recent and at - recent[0] >= window:
                    recent.popleft()
                locked.append(len(recent) >= limit)
                if not locked[-1]:
                    recent.append(at)
                locks.append(not locked[-1] and len(recent) >= limit)
            yield batch.assign(locked=locked, locks=locks)

    schema = T.StructType([*failures.schema.fields, T.StructField("locked", T.BooleanType()), T.StructField("locks", T.BooleanType())])
    return failures.repartition("ip").sortWithinPartitions("ip", "at").mapInPandas(scan, schema)


def lockout_fold(failures: DataFrame, seconds: int = 60, limit: int = 5) -> DataFrame:
    """Per source the times (``at``, seconds) at which it was locked; a mapped IPv6 address is its IPv4 address."""
    found = lockouts(failures.select(E.canonical_ip(F.col("ip").cast("string")).alias("ip"), F.col("at").cast("long")), seconds, limit)
    return found.groupBy("ip").agg(F.array_sort(F.collect_list(F.when(F.col("locks"), F.col("at")))).alias("locks"))


@query("canonical_ip", "v_auth_failures", sql="SELECT ip, ts, concat('10.0.0.', CAST(ip AS VARCHAR)) AS address FROM v_auth_failures")
def canonical_ip(failures: DataFrame) -> DataFrame:
    """Addresses of failures, every second one written as IPv6."""
    plain = F.concat(F.lit("10.0.0."), F.col("ip").cast("string"))
    return failures.select("ip", "ts", E.canonical_ip(F.when(F.col("ip") % 2 == 0, F.concat(F.lit("::FFFF:"), plain)).otherwise(plain)).alias("address"))


@query(
    "debounce_changes",
    "events",
    sql="""SELECT user_id, min(ts) AS first_at, CAST(count(*) AS BIGINT) AS changes, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS names FROM
 (SELECT *, sum(CASE WHEN ts >= prev + INTERVAL 6 HOUR OR prev IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS burst FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events)) GROUP BY user_id, burst""",
)
def debounce_changes(events: DataFrame, quiet: str = "6 hours") -> DataFrame:
    """One firing for each burst of changes, after a quiet time: the batch form of the stream."""
    return bursts(events.withColumn("at", F.col("ts").cast("timestamp")), quiet).select("user_id", F.col("window.start").cast("timestamp_ntz").alias("first_at"), "changes", "names")


def bursts(events: DataFrame, quiet: str) -> DataFrame:
    """Session windows of (user_id, at, event_type); serves tables and streams."""
    session = F.session_window("at", quiet).alias("window")
    return events.groupBy("user_id", session).agg(F.count(F.lit(1)).alias("changes"), F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("names"))


@query("exhausted_anti", "v_entries", "v_tried", sql="SELECT id, book FROM v_entries e WHERE status IN ('pending','draft') AND NOT EXISTS (SELECT 1 FROM v_tried t WHERE t.attempts >= 3 AND t.book = e.book AND t.id = e.id AND t.updated = e.updated)")
def exhausted_anti(entries: DataFrame, tried: DataFrame, most: int = 3) -> DataFrame:
    """Work without what was tried ``most`` times for the same content."""
    todo = entries.where(F.col("status").isin("pending", "draft"))
    return todo.join(tried.where(F.col("attempts") >= most), ["book", "id", "updated"], "left_anti").select("id", "book")
