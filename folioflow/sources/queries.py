"""The sources and sinks as queries: files are made from the given tables, damaged ones among them, and read as a user's would be."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import text as T
from ..operators import publishing
from ..plans.registry import ORACLES, QUERIES
from ..plans.views import view, with_views
from ..store import put_files, scratch
from . import library as L


def source_query(name: str, sql: str):
    """Register a function of (spark, folder of tables)."""

    def register(f):
        QUERIES[name], ORACLES[name] = f, with_views(sql)
        return f

    return register


def files_of(spark: SparkSession, sf_dir: str, name: str) -> str:
    """A folder with the files (name, value) of a view."""
    path = scratch(spark, "files")
    put_files(view(spark, sf_dir, name), path)
    return path


_LIBRARY = "SELECT uuid, visible_name, CASE type_name WHEN 'DocumentType' THEN 'document' WHEN 'CollectionType' THEN 'folder' ELSE 'other' END AS kind, parent, deleted, CAST(created_ms AS BIGINT) AS created_ms, CAST(last_page AS BIGINT) AS last_opened_page FROM v_metadata WHERE state = 'whole'"


@source_query("scan_library", _LIBRARY)
def scan_library(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.scan_library(spark, files_of(spark, sf_dir, "v_metadata_files"))


@source_query("scan_library_since", f"SELECT * FROM ({_LIBRARY}) WHERE created_ms >= 1706659200000")
def scan_library_since(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.scan_library_since(spark, files_of(spark, sf_dir, "v_metadata_files"), 1_706_659_200_000)


def _shown(entries: DataFrame) -> DataFrame:
    """Entries with their nested fields as text."""
    joined = lambda c, kind: F.array_join(F.transform(c, lambda x: x.cast(kind).cast("string")), ",")
    return entries.select(
        "book", F.col("seq").cast("long").alias("seq"), "id", F.col("page_index").cast("long").alias("page_index"), F.col("chapter").cast("long").alias("chapter"), "text", "style", "status", "destination", "source", "ask_ai", F.col("quote.text").alias("quote"), F.col("quote.id").alias("quote_id"),
        F.array_join(F.transform("quote.rects", lambda r: joined(r, "int")), ";").alias("rects"), F.array_join("ink.strokes", ",").alias("strokes"), F.get("ink.bbox", 2).alias("right_edge"), F.col("ink.crop").alias("crop"), F.get("drafts", 0)["at"].alias("draft_at"), F.size("drafts").cast("long").alias("drafts"),
        F.col("review.interval_days").cast("long").alias("interval_days"), F.col("review.last").alias("last_review"), F.col("created"), F.col("updated"),
    )


def _stored_sql(text: str) -> str:
    return f"""SELECT book, CAST(0 AS BIGINT) AS seq, concat(book, '-0') AS id, CAST(n % 300 AS BIGINT) AS page_index, CAST(chapter AS BIGINT) AS chapter, {text} AS text, style, status, 'both' AS destination, 'xochitl' AS source, false AS ask_ai, concat('said ', text) AS quote, '' AS quote_id, '1,2,3,4' AS rects,
 concat('1:', CAST(n AS VARCHAR), ',1:2') AS strokes, CAST(9.5 AS DOUBLE) AS right_edge, '' AS crop, CAST(n AS BIGINT) AS draft_at, CAST(1 AS BIGINT) AS drafts, CAST(3 AS BIGINT) AS interval_days, CAST(NULL AS BIGINT) AS last_review, CAST(1 AS BIGINT) AS created, CAST(2 AS BIGINT) AS updated FROM v_stored WHERE state = 'whole'
 UNION ALL SELECT book, 1, concat(book, '-1'), 1, NULL, NULL, 'body', 'archived', 'both', 'xochitl', false, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 0, NULL, NULL, 3, 4 FROM v_stored WHERE state = 'whole'"""


@source_query("read_entries", _stored_sql("text"))
def read_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of which some are cut off, have a word that isn't known, or lack a field."""
    return _shown(L.read_entries(spark, files_of(spark, sf_dir, "v_stored_files"))[0])


@source_query("read_entries_quarantine", "SELECT book, state FROM v_stored WHERE state <> 'whole'")
def read_entries_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that can't be read, with what is wrong with them by their own text."""
    found = L.read_entries(spark, files_of(spark, sf_dir, "v_stored_files"))[1]
    state = F.when(F.col("text").contains("unheard of"), "word").when(F.col("text").rlike("[}]\\s*$"), "lacks").otherwise("cut")
    return found.select("book", state.alias("state"))


@source_query("write_entries", _stored_sql("CASE WHEN n % 4 = 1 THEN concat('new ', text) ELSE text END"))
def write_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviewed entries get a new text, their books are written, and all are read again."""
    path = files_of(spark, sf_dir, "v_stored_files")
    old, bad = L.read_entries(spark, path)
    new = old.withColumn("text", F.when(F.col("status") == "reviewed", F.concat(F.lit("new "), F.col("text"))).otherwise(F.col("text")))
    L.write_entries(new, old, bad, L.read_books(spark, path), path)
    return _shown(L.read_entries(spark, path)[0])


@source_query("read_deploy_log", "SELECT device, CAST(at_s AS BIGINT) AS at, label, failed, dirty FROM v_deploys WHERE NOT damaged QUALIFY row_number() OVER (PARTITION BY device ORDER BY at_s DESC) <= 20")
def read_deploy_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.read_deploy_log(spark, files_of(spark, sf_dir, "v_deploy_lines")).select("device", "at", "label", "failed", "dirty")


@source_query("read_allowlist", "SELECT lower(substring(trim(value), 1, 64)) AS sha256, trim(substring(trim(value), 65)) AS label FROM v_allow_lines WHERE line % 6 NOT IN (0, 2)")
def read_allowlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.read_allowlist(spark, files_of(spark, sf_dir, "v_allow_lines"))


@source_query("sink_vault", f"SELECT concat(replace(b.title, '/', '_'), '/', '第', CAST(m.chapter + 1 AS VARCHAR), '章 Chapter ', CAST(m.chapter AS VARCHAR), '.md') AS file, m.md FROM ({publishing.EXPORT_SQL}) m JOIN v_books b ON m.book = b.uuid")
def sink_vault(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chapters' files as they lie in the vault after two runs, of which the second has nothing to write."""
    entries, books = view(spark, sf_dir, "v_entries"), view(spark, sf_dir, "v_books")
    path = scratch(spark, "vault")
    pieces, prints = publishing.chapter_files(entries, books), publishing.fingerprints(entries, "obsidian")
    recorded = spark.createDataFrame([], "book string, chapter long, recorded string")
    for _ in range(2):
        recorded = L.sink_vault(pieces, prints, recorded, path)
    files = spark.read.text(path, wholetext=True, pathGlobFilter="*.md", recursiveFileLookup=True)
    name = F.regexp_extract(T.percent_decode(F.col("_metadata.file_path")), r"([^/]+/[^/]+)$", 1)
    return files.select(name.alias("file"), F.col("value").alias("md"))
