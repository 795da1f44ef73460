"""The library and the shelf: folders, names, deliveries, queues, deployments."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions import entries as E, text as T
from ..plans.registry import query
from ..store import cut
from .skew import spread_join

MAX_DEPTH = 64


def live(library: DataFrame) -> DataFrame:
    return library.where((F.col("parent") != "trash") & ~F.col("deleted"))


@query("library_live", "v_library", sql="SELECT uuid, name, kind, parent FROM v_library WHERE parent <> 'trash' AND NOT deleted")
def library_live(library: DataFrame) -> DataFrame:
    return live(library).select("uuid", "name", "kind", "parent")


@query("live_documents", "v_library", sql="SELECT uuid, name FROM v_library WHERE parent <> 'trash' AND NOT deleted AND kind = 'document'")
def live_documents(library: DataFrame) -> DataFrame:
    return live(library).where("kind = 'document'").select("uuid", "name")


@query("live_folders", "v_library", sql="SELECT uuid, name FROM v_library WHERE parent <> 'trash' AND NOT deleted AND kind = 'folder'")
def live_folders(library: DataFrame) -> DataFrame:
    return live(library).where("kind = 'folder'").select("uuid", "name")


@query("valid_uuid", "v_library", sql="SELECT uuid, regexp_matches(CASE WHEN kind = 'document' THEN concat('00000000-0000-4000-8000-', lpad(substring(uuid, 2), 12, '0')) ELSE uuid END, '^[0-9a-fA-F-]{36}$') AS ok FROM v_library")
def valid_uuid(library: DataFrame) -> DataFrame:
    shaped = F.when(F.col("kind") == "document", F.concat(F.lit("00000000-0000-4000-8000-"), F.lpad(F.substring("uuid", 2, 36), 12, "0"))).otherwise(F.col("uuid"))
    return library.select("uuid", E.valid_uuid(shaped).alias("ok"))


@query(
    "doc_folder",
    "v_library",
    sql="SELECT d.uuid, d.name, coalesce(f.name, '') AS folder FROM v_library d LEFT JOIN (SELECT * FROM v_library WHERE kind = 'folder') f ON d.parent = f.uuid WHERE d.kind = 'document' AND d.parent <> 'trash' AND NOT d.deleted",
)
def doc_folder(library: DataFrame) -> DataFrame:
    folders = library.where("kind = 'folder'").select(F.col("uuid").alias("parent"), F.col("name").alias("folder"))
    docs = live(library).where("kind = 'document'")
    return docs.join(folders, "parent", "left").select("uuid", "name", F.coalesce("folder", F.lit("")).alias("folder"))


def folder_paths(library: DataFrame, depth: int = MAX_DEPTH) -> DataFrame:
    """(uuid, path as an array from the root) of the live folders that reach the root; circles and deeper ones are left out.

    One join a level, until a level is empty; each folder is reached once, so a circle is never entered. Levels are written,
    so that a level doesn't plan those before it again.
    """
    folders = live(library).where("kind = 'folder'").select("uuid", "name", "parent")
    level = folders.where("parent = ''").select("uuid", F.array("name").alias("path"))
    found = level
    for _ in range(depth - 1):
        level = cut(folders.join(level.select(F.col("uuid").alias("parent"), "path"), "parent").select("uuid", F.concat("path", F.array("name")).alias("path")), "level")
        if level.isEmpty():
            break
        found = found.unionByName(level)
    return found


PATHS_SQL = """WITH RECURSIVE p(uuid, path, depth) AS (SELECT uuid, name, 1 FROM v_library WHERE kind = 'folder' AND parent = '' AND NOT deleted
 UNION ALL SELECT l.uuid, concat(p.path, '/', l.name), p.depth + 1 FROM v_library l JOIN p ON l.parent = p.uuid WHERE l.kind = 'folder' AND NOT l.deleted AND p.depth < 64)"""


@query("folder_paths", "v_library", sql=f"{PATHS_SQL} SELECT uuid, path FROM p")
def folder_path_texts(library: DataFrame) -> DataFrame:
    return folder_paths(library).select("uuid", F.array_join("path", "/").alias("path"))


@query("folder_by_path", "v_library", sql=f"{PATHS_SQL} SELECT path, min(uuid) AS uuid FROM p GROUP BY path")
def folder_by_path(library: DataFrame) -> DataFrame:
    """Each path's folder; of folders with one path, the least."""
    return folder_paths(library).groupBy(F.array_join("path", "/").alias("path")).agg(F.min("uuid").alias("uuid"))


@query("same_name", "v_library", sql="SELECT uuid, name, CAST(count(*) OVER (PARTITION BY name) AS BIGINT) AS n FROM v_library WHERE kind = 'document' AND parent <> 'trash' AND NOT deleted")
def same_name(library: DataFrame) -> DataFrame:
    """How many live documents have the name. Names are counted first, and a frequent one is dealt out in the join."""
    docs = live(library).where("kind = 'document'").select("uuid", "name")
    counts = docs.groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    return spread_join(docs, counts, "name", "uuid", rows=10_000, sizes=counts).select("uuid", "name", "n")


@query(
    "cleanup_view",
    "v_library",
    sql="""SELECT uuid, name, folder, n FROM (SELECT d.uuid, d.name, coalesce(f.name, '') AS folder, CAST(count(*) OVER (PARTITION BY d.name) AS BIGINT) AS n FROM v_library d
 LEFT JOIN (SELECT * FROM v_library WHERE kind = 'folder') f ON d.parent = f.uuid WHERE d.kind = 'document' AND d.parent <> 'trash' AND NOT d.deleted) WHERE n > 1 AND (contains(lower(name), 'an') OR contains(lower(folder), 'an'))""",
)
def cleanup_view(library: DataFrame, keyword: str = "an") -> DataFrame:
    low = keyword.lower()
    return doc_folder(library).join(same_name(library).select("uuid", "n"), "uuid").where((F.col("n") > 1) & (F.lower("name").contains(low) | F.lower("folder").contains(low))).select("uuid", "name", "folder", "n")


@query("library_list", "v_library", sql="SELECT uuid, name FROM v_library WHERE kind = 'document' AND parent <> 'trash' AND NOT deleted ORDER BY name, uuid")
def library_list(library: DataFrame) -> DataFrame:
    return live_documents(library).orderBy("name", "uuid")


@query(
    "delete_request_check",
    "v_library",
    sql="""SELECT uuid, verdict FROM (SELECT uuid, CASE WHEN uuid LIKE 'r%' THEN 'bad uuid' WHEN deleted OR parent = 'trash' THEN 'already gone' WHEN wanted <> lower(trim(name)) THEN 'name mismatch' ELSE 'accepted' END AS verdict
 FROM (SELECT *, CASE WHEN uuid LIKE '%7' THEN 'other' ELSE lower(trim(name)) END AS wanted FROM v_library))
 UNION ALL SELECT concat('x', CAST(n_nationkey AS VARCHAR(9))), 'not found' FROM nation""",
)
def delete_requests(library: DataFrame) -> DataFrame:
    """Requests made from the library itself: its rows, some by another name, and some that aren't there."""
    asked = library.select("uuid", F.when(F.col("uuid").endswith("7"), "other").otherwise(F.upper("name")).alias("asked"))
    gone = library.where("uuid LIKE 'n%'").select(F.regexp_replace("uuid", "^n", "x").alias("uuid"), F.lit("any").alias("asked"))
    return delete_request_check(asked.unionByName(gone), library, "^[ncx][0-9]+$")


def delete_request_check(requests: DataFrame, library: DataFrame, shape: str = "^[0-9a-fA-F-]{36}$") -> DataFrame:
    """accepted, or why not; accepted requests are those of distinct documents."""
    found = requests.dropDuplicates(["uuid"]).join(library, "uuid", "left")
    same = F.lower(T.trim_all(F.col("asked"))) == F.lower(T.trim_all(F.col("name")))
    verdict = (
        F.when(~F.col("uuid").rlike(shape), "bad uuid").when(F.col("name").isNull(), "not found").when(F.col("deleted") | (F.col("parent") == "trash"), "already gone").when(~same, "name mismatch").otherwise("accepted")
    )
    return found.select("uuid", verdict.alias("verdict"))


@query(
    "same_content_docs",
    "documents",
    sql="""SELECT a.doc_id AS a, b.doc_id AS b FROM (SELECT source, text, min(doc_id) AS doc_id FROM documents GROUP BY source, text) a JOIN documents b ON a.source = b.source AND a.text = b.text AND a.doc_id < b.doc_id""",
)
def same_content(docs: DataFrame) -> DataFrame:
    """Every copy with the first document of its folder that has the same bytes.

    The size is compared first: only documents whose size occurs twice in a folder are hashed, and the copies of one
    content are paired with its first document and not with each other.
    """
    sized = docs.select("doc_id", F.col("source").alias("folder"), F.octet_length("text").alias("size"), "text")
    twice = sized.groupBy("folder", "size").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("folder", "size")
    hashed = sized.join(twice, ["folder", "size"], "left_semi").select("doc_id", "folder", "size", F.sha2("text", 256).alias("hash"))
    first = hashed.groupBy("folder", "size", "hash").agg(F.min("doc_id").alias("a"))
    return hashed.join(first, ["folder", "size", "hash"]).where("a < doc_id").select("a", F.col("doc_id").alias("b"))


@query("shelf_filter", "v_shelf", sql="SELECT doc_id, name FROM v_shelf WHERE contains(lower(name), 'an') AND format = 'epub' AND NOT (NOT busy AND deliver_status <> 'failed' AND coalesce(native_at, 0) <> 0)")
def shelf_filter(shelf: DataFrame, keyword: str = "an", format: str = "epub", state: str = "todo") -> DataFrame:
    done = E.shelf_done(F.col("busy"), F.col("deliver_status"), F.col("native_at"))
    held = {"all": F.lit(True), "todo": ~done, "finished": done}[state]
    return shelf.where(F.lower("name").contains(keyword.lower()) & (F.col("format") == format) & held).select("doc_id", "name")


@query("shelf_done", "v_shelf", sql="SELECT doc_id, NOT busy AND deliver_status <> 'failed' AND coalesce(native_at, 0) <> 0 AS done FROM v_shelf")
def shelf_done(shelf: DataFrame) -> DataFrame:
    return shelf.select("doc_id", E.shelf_done(F.col("busy"), F.col("deliver_status"), F.col("native_at")).alias("done"))


@query("shelf_stale", "v_shelf", sql="SELECT doc_id, coalesce(native_at < mtime, false) AS stale FROM v_shelf")
def shelf_stale(shelf: DataFrame) -> DataFrame:
    return shelf.select("doc_id", E.shelf_stale(F.col("native_at"), F.col("mtime")).alias("stale"))


@query("low_space", "v_shelf", sql="SELECT doc_id, coalesce(CASE WHEN doc_id % 9 <> 0 THEN bytes * 100000 END < 314572800, false) AS low FROM v_shelf")
def low_space(shelf: DataFrame) -> DataFrame:
    return shelf.select("doc_id", E.low_space(F.when(F.col("doc_id") % 9 != 0, F.col("bytes") * 100000)).alias("low"))


@query("delivery_route", "v_shelf", sql="SELECT doc_id, CASE WHEN format NOT IN ('epub','pdf') THEN 'reject_format' WHEN bytes * 50000 <= 90000000 THEN 'direct' WHEN bytes * 50000 <= 1073741824 THEN 'large' ELSE 'reject_size' END AS route FROM v_shelf")
def delivery_route(shelf: DataFrame) -> DataFrame:
    return shelf.select("doc_id", E.delivery_route(F.col("format"), F.col("bytes") * 50000).alias("route"))


@query("shelf_counts", "v_shelf", sql="SELECT CAST(count(*) AS BIGINT) AS every, CAST(count(*) FILTER (NOT done) AS BIGINT) AS todo, CAST(count(*) FILTER (done) AS BIGINT) AS finished FROM (SELECT NOT busy AND deliver_status <> 'failed' AND coalesce(native_at, 0) <> 0 AS done FROM v_shelf)")
def shelf_counts(shelf: DataFrame) -> DataFrame:
    return shelf_done(shelf).agg(F.count(F.lit(1)).alias("every"), F.count_if(~F.col("done")).alias("todo"), F.count_if("done").alias("finished"))


@query("shelf_list", "v_shelf", sql="SELECT doc_id, name, mtime FROM v_shelf ORDER BY mtime DESC, name")
def shelf_list(shelf: DataFrame) -> DataFrame:
    return shelf.select("doc_id", "name", "mtime").orderBy(F.desc("mtime"), "name")


@query("shelf_page", "v_shelf", sql="SELECT doc_id, name, mtime FROM v_shelf ORDER BY mtime DESC, name LIMIT 25 OFFSET 50")
def shelf_page(shelf: DataFrame, page: int = 3, size: int = 25) -> DataFrame:
    return shelf_list(shelf).offset((page - 1) * size).limit(size)


@query("series_counts", "v_book_files", sql="SELECT series, CAST(count(*) AS BIGINT) AS volumes FROM (SELECT trim(split_part(trim(split_part(regexp_replace(name, '\\.[^.]+$', ''), ' -- ', 1)), '-', 1)) AS series FROM v_book_files) GROUP BY series")
def series_counts(files: DataFrame) -> DataFrame:
    return files.groupBy(T.series_of(T.list_title(F.col("name"))).alias("series")).agg(F.count(F.lit(1)).alias("volumes"))


@query("batch_validate", "v_book_files", "v_shelf", sql="SELECT f.doc_id, f.name FROM v_book_files f WHERE f.doc_id % 3 = 0 AND f.name IN (SELECT name FROM v_shelf WHERE format IN ('epub','pdf'))")
def batch_validate(files: DataFrame, shelf: DataFrame) -> DataFrame:
    """Queued names that are still on the shelf in a format that can be sent."""
    return files.where("doc_id % 3 = 0").join(shelf.where(F.col("format").isin("epub", "pdf")).select("name"), "name", "left_semi").select("doc_id", "name")


@query(
    "batch_enqueue",
    "v_shelf",
    sql="SELECT doc_id, name, CASE WHEN format NOT IN ('epub','pdf') THEN 'ineligible' WHEN doc_id % 7 = 0 THEN 'duplicate' ELSE 'queued' END AS fate FROM v_shelf WHERE doc_id % 2 = 0",
)
def batch_enqueue(shelf: DataFrame) -> DataFrame:
    """Requests for every second item while every seventh is queued already."""
    queued = shelf.where("doc_id % 7 = 0").select("name", F.lit(True).alias("queued"))
    asked = shelf.where("doc_id % 2 = 0").join(queued, "name", "left")
    return asked.select("doc_id", "name", F.when(~F.col("format").isin("epub", "pdf"), "ineligible").when(F.col("queued"), "duplicate").otherwise("queued").alias("fate"))


@query(
    "batch_status",
    "v_shelf",
    sql="""SELECT format, CAST(count(*) AS BIGINT) AS total, CAST(count(*) FILTER (deliver_status = 'ok') AS BIGINT) AS done, CAST(count(*) FILTER (deliver_status = 'failed') AS BIGINT) AS failed, min(doc_id) FILTER (busy) AS current,
 (SELECT string_agg(CAST(q.doc_id AS VARCHAR), ',' ORDER BY q.doc_id) FROM (SELECT doc_id, format, row_number() OVER (PARTITION BY format ORDER BY doc_id) AS n FROM v_shelf WHERE deliver_status = 'pending') q WHERE q.format = s.format AND n <= 200) AS queued FROM v_shelf s GROUP BY format""",
)
def batch_status(shelf: DataFrame, shown: int = 200) -> DataFrame:
    """Per batch: counts, the current item, and the first ``shown`` of the queue (picked before they are gathered)."""
    s = F.col("deliver_status")
    counts = shelf.groupBy("format").agg(F.count(F.lit(1)).alias("total"), F.count_if(s == "ok").alias("done"), F.count_if(s == "failed").alias("failed"), F.min(F.when(F.col("busy"), F.col("doc_id"))).alias("current"))
    first = shelf.where(s == "pending").withColumn("n", F.row_number().over(W.partitionBy("format").orderBy("doc_id"))).where(F.col("n") <= shown)
    names = first.groupBy("format").agg(F.array_join(F.transform(F.array_sort(F.collect_list("doc_id")), lambda x: x.cast("string")), ",").alias("queued"))
    return counts.join(names, "format", "left")


@query("delivery_outcome", "v_shelf", sql="SELECT doc_id, CASE WHEN native_at IS NULL THEN 'failed: missing' WHEN deliver_status = 'ok' THEN 'ok' WHEN deliver_status = 'failed' THEN 'failed: reported' WHEN deliver_status = 'pending' THEN 'failed: pending' ELSE 'failed: unknown' END AS outcome FROM v_shelf")
def delivery_outcome(shelf: DataFrame) -> DataFrame:
    """Only a reported success is one: what is pending, missing or not recognised failed."""
    s = F.col("deliver_status")
    return shelf.select("doc_id", F.when(F.col("native_at").isNull(), "failed: missing").when(s == "ok", "ok").when(s == "failed", "failed: reported").when(s == "pending", "failed: pending").otherwise("failed: unknown").alias("outcome"))


@query("render_promote", "v_shelf", "documents", sql="SELECT s.doc_id, CASE WHEN s.deliver_status <> 'pending' THEN s.deliver_status WHEN d.n_chars % 7 <> s.bytes % 5 AND (d.n_chars % 7 <> 0 OR s.busy) THEN 'ok' ELSE 'onopen' END AS render FROM v_shelf s LEFT JOIN documents d USING (doc_id)")
def render_promote(shelf: DataFrame, docs: DataFrame) -> DataFrame:
    """A render that waits for its book to be opened is done when the page count changed; 0 pages need other evidence. In
    the view, sizes stand for page counts, ``pending`` for the waiting state and ``busy`` for the evidence."""
    pages, recorded = F.col("n_chars") % 7, F.col("bytes") % 5
    found = shelf.join(docs.select("doc_id", "n_chars"), "doc_id", "left")
    return found.select("doc_id", F.when(F.col("deliver_status") != "pending", F.col("deliver_status")).when((pages != recorded) & ((pages != 0) | F.col("busy")), "ok").otherwise("onopen").alias("render"))


@query("interrupted_recovery", "v_shelf", sql="SELECT doc_id, CASE WHEN deliver_status = 'pending' AND mtime < 1704070000 THEN 'failed' ELSE deliver_status END AS deliver, CASE WHEN busy AND mtime < 1704070000 THEN 'timeout' WHEN busy THEN 'pending' ELSE 'ok' END AS render FROM v_shelf")
def interrupted_recovery(shelf: DataFrame, boot: int = 1704070000) -> DataFrame:
    """What was under way before the start failed (delivery) or timed out (render)."""
    before = F.col("mtime") < boot
    return shelf.select("doc_id", F.when((F.col("deliver_status") == "pending") & before, "failed").otherwise(F.col("deliver_status")).alias("deliver"), F.when(F.col("busy") & before, "timeout").when(F.col("busy"), "pending").otherwise("ok").alias("render"))


@query("orphan_sidecars", "v_shelf", "v_kept_files", sql="SELECT doc_id FROM v_shelf WHERE doc_id NOT IN (SELECT doc_id FROM v_kept_files)")
def orphan_sidecars(sidecars: DataFrame, books: DataFrame) -> DataFrame:
    return sidecars.join(books.select("doc_id"), "doc_id", "left_anti").select("doc_id")


@query("prune_done", "v_library", sql="SELECT uuid, parent, name FROM v_library q WHERE kind = 'document' AND NOT EXISTS (SELECT 1 FROM v_library l WHERE l.kind = 'document' AND l.deleted AND l.parent = q.parent AND l.name = q.name)")
def prune_done(library: DataFrame) -> DataFrame:
    """Queue items whose (folder, name) hasn't happened; in the view, deleted documents stand for what happened."""
    queue = library.where("kind = 'document'")
    return queue.join(queue.where("deleted").select("parent", "name"), ["parent", "name"], "left_anti").select("uuid", "parent", "name")


@query("apply_once", "v_shelf", "v_book_files", sql="SELECT doc_id % 50 AS uuid, min(mtime) AS registered FROM v_shelf WHERE doc_id % 50 NOT IN (SELECT doc_id % 50 FROM v_shelf WHERE doc_id % 50 < 10) AND doc_id % 50 IN (SELECT doc_id FROM v_book_files) GROUP BY 1")
def apply_once(registered: DataFrame, library: DataFrame) -> DataFrame:
    """The first registration of each document that still exists and wasn't applied yet."""
    keyed = registered.select((F.col("doc_id") % 50).alias("uuid"), "mtime")
    applied = keyed.where("uuid < 10").select("uuid")
    first = keyed.groupBy("uuid").agg(F.min("mtime").alias("registered"))
    return first.join(applied, "uuid", "left_anti").join(library.select(F.col("doc_id").alias("uuid")), "uuid", "left_semi")


@query("deploy_drift", "v_deploy_files", sql="SELECT device, path, CASE WHEN pending_hash IS NOT NULL AND current_hash IS NULL THEN 'pending' WHEN current_hash IS NULL THEN 'missing' WHEN current_hash = recorded THEN 'ok' ELSE 'changed' END AS state FROM v_deploy_files")
def deploy_drift(files: DataFrame) -> DataFrame:
    state = F.when(F.col("current_hash").isNull() & F.col("pending_hash").isNotNull(), "pending").when(F.col("current_hash").isNull(), "missing").when(F.col("current_hash") == F.col("recorded"), "ok").otherwise("changed")
    return files.select("device", "path", state.alias("state"))


@query("missing_units", "v_deploy_files", sql="SELECT device, path FROM v_deploy_files WHERE current_hash IS NULL")
def missing_units(files: DataFrame) -> DataFrame:
    """Expected and not present."""
    return files.select("device", "path").join(files.where("current_hash IS NOT NULL").select("device", "path"), ["device", "path"], "left_anti")


@query(
    "posture_decision",
    "v_deploy_files",
    sql="""SELECT device, missing > 0 OR NOT known AS needs_reinstall, concat_ws(',', CASE WHEN missing > 0 THEN 'missing units' END, CASE WHEN changed > 0 THEN 'changed files' END, CASE WHEN NOT known THEN 'unknown hash' END) AS reasons
 FROM (SELECT device, count(*) FILTER (current_hash IS NULL) AS missing, count(*) FILTER (current_hash IS NOT NULL AND current_hash <> recorded) AS changed, device % 4 <> 0 AS known FROM v_deploy_files GROUP BY device)""",
)
def posture_decision(files: DataFrame) -> DataFrame:
    """Whether a device needs a reinstall, and why; in the view, a device that 4 divides has an unknown hash."""
    c = F.col("current_hash")
    seen = files.groupBy("device").agg(F.count_if(c.isNull()).alias("missing"), F.count_if(c.isNotNull() & (c != F.col("recorded"))).alias("changed")).withColumn("known", F.col("device") % 4 != 0)
    reasons = F.concat_ws(",", F.when(F.col("missing") > 0, "missing units"), F.when(F.col("changed") > 0, "changed files"), F.when(~F.col("known"), "unknown hash"))
    return seen.select("device", ((F.col("missing") > 0) | ~F.col("known")).alias("needs_reinstall"), reasons.alias("reasons"))


@query(
    "tag_events",
    "events",
    sql="SELECT event_id, event_type, CASE event_type WHEN 'click' THEN 'ink' WHEN 'view' THEN 'book' WHEN 'purchase' THEN 'note' ELSE 'other' END AS svc, CASE event_type WHEN 'click' THEN 'notes' WHEN 'view' THEN 'transfer' WHEN 'purchase' THEN 'notes' ELSE '' END AS tab FROM events",
)
def tag_events(events: DataFrame) -> DataFrame:
    """Events with the service and tab of their kind; the same function serves streams."""
    table = {"click": ("ink", "notes"), "view": ("book", "transfer"), "purchase": ("note", "notes")}
    svc, tab = (F.create_map(*[F.lit(x) for k, v in table.items() for x in (k, v[i])]) for i in (0, 1))
    return events.select("event_id", "event_type", F.coalesce(svc[F.col("event_type")], F.lit("other")).alias("svc"), F.coalesce(tab[F.col("event_type")], F.lit("")).alias("tab"))


@query("keep_latest_n", "v_deploy_files", sql="SELECT device, path FROM (SELECT device, path, row_number() OVER (PARTITION BY device ORDER BY path DESC) AS n FROM v_deploy_files) WHERE n <= 20")
def keep_latest_n(rows: DataFrame, n: int = 20) -> DataFrame:
    return rows.withColumn("n", F.row_number().over(W.partitionBy("device").orderBy(F.desc("path")))).where(F.col("n") <= n).select("device", "path")
