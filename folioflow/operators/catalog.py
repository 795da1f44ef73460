"""Names, claims and choices in the library; positions; ingestion of a scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions import entries as E, text as T
from ..plans.registry import query
from ..store import Steps, made
from . import lifecycle, mining, structure


def unique_names(requests: DataFrame, taken: DataFrame) -> DataFrame:
    """Names for requests (folder, name, seq): the name itself, or with the first number from 2 on that is free.

    ``taken`` has the names (folder, name) in use. Requests for one name get the free numbers in their order.
    """
    number = r"^(.*) ([1-9][0-9]{0,8})$"
    plain = taken.select("folder", "name", F.lit(1).alias("number"))
    counted = taken.where(F.col("name").rlike(number)).select("folder", F.regexp_extract("name", number, 1).alias("name"), F.regexp_extract("name", number, 2).cast("int").alias("number"))
    used = plain.unionByName(counted).distinct()
    # The n-th free number is n plus how many used numbers have fewer than n free ones below them: a running count over both.
    below = F.col("number") - F.row_number().over(W.partitionBy("folder", "name").orderBy("number"))
    marks = used.select("folder", "name", below.alias("at"), F.lit(1).alias("mark"), F.lit(None).cast(requests.schema["seq"].dataType).alias("seq"))
    asked = requests.select("folder", "name", (F.row_number().over(W.partitionBy("folder", "name").orderBy("seq")) - 1).alias("at"), F.lit(0).alias("mark"), "seq")
    before = F.sum("mark").over(W.partitionBy("folder", "name").orderBy("at", F.desc("mark")).rowsBetween(W.unboundedPreceding, 0))
    given = asked.unionByName(marks).withColumn("number", F.col("at") + 1 + before).where("mark = 0")
    return given.select("folder", "name", "seq", F.when(F.col("number") == 1, F.col("name")).otherwise(F.concat_ws(" ", "name", F.col("number").cast("string"))).alias("given"))


@query(
    "unique_names",
    "v_library",
    sql="""SELECT uuid, CASE WHEN n = 1 AND NOT taken THEN name ELSE concat(name, ' ', CAST(n + CASE WHEN taken THEN 1 ELSE 0 END AS VARCHAR)) END AS given FROM (SELECT uuid, name, row_number() OVER (PARTITION BY parent, name ORDER BY uuid) AS n, parent LIKE '%1' AS taken FROM v_library WHERE kind = 'document')""",
)
def names_for_all(library: DataFrame) -> DataFrame:
    """Every document of the view asks for its name; in folders whose id ends with 1 all of these names are in use."""
    docs = library.where("kind = 'document'").select(F.col("parent").alias("folder"), "name", F.col("uuid").alias("seq"))
    taken = docs.where(F.col("folder").endswith("1")).select("folder", "name").distinct()
    return unique_names(docs, taken).select(F.col("seq").alias("uuid"), "given")


def claim_new_docs(uploads: DataFrame, before: DataFrame, after: DataFrame, by: str = "hash", margin_ms: int = 2000) -> DataFrame:
    """(upload, uuid) of uploads (upload, at_ms, name, size, hash) among the documents after (uuid, created_ms, name, size,
    hash) that weren't there before. ``by`` is hash, name or size. No match or several give null: the newest is never
    taken for want of a better."""
    new = after.join(before.select("uuid"), "uuid", "left_anti")
    keys = {"hash": ["size", "hash"], "name": ["name"], "size": ["size"]}[by]
    # "exactly one, and late enough" needs only the two newest documents of a key, so copies make no pairs
    pair = F.struct("created_ms", "uuid")
    newest = new.groupBy(*keys).agg(F.max(pair).alias("first"), F.count(F.lit(1)).alias("n"))
    second = new.join(newest.where("n > 1").select(*keys, "first"), keys).where(pair != F.col("first")).groupBy(*keys).agg(F.max("created_ms").alias("second_ms"))
    found = uploads.join(newest.join(second, keys, "left"), keys)
    late = F.col("at_ms") - margin_ms
    only = found.where((F.col("first.created_ms") >= late) & (F.coalesce(F.col("second_ms"), late - 1) < late)).select("upload", F.col("first.uuid").alias("uuid"))
    # a document that two uploads would claim is claimed by neither
    sole = only.join(only.groupBy("uuid").agg(F.count(F.lit(1)).alias("n")).where("n = 1").select("uuid"), "uuid", "left_semi")
    return uploads.select("upload").join(sole, "upload", "left")


@query("claim_new_docs", "documents", sql="SELECT doc_id AS upload, CASE WHEN doc_id % 3 <> 0 AND count(*) FILTER (doc_id % 3 <> 0) OVER (PARTITION BY text) = 1 AND count(*) OVER (PARTITION BY text) = 1 THEN doc_id END AS uuid FROM documents")
def claims_by_content(docs: DataFrame) -> DataFrame:
    """Uploads of all texts, two thirds of which arrived; equal contents can't be told apart."""
    all_ = docs.select("doc_id", F.lit(1000).alias("at_ms"), F.lit("").alias("name"), F.octet_length("text").alias("size"), F.sha2("text", 256).alias("hash"))
    after = all_.where("doc_id % 3 <> 0").select(F.col("doc_id").alias("uuid"), F.lit(1500).alias("created_ms"), "name", "size", "hash")
    return claim_new_docs(all_.withColumnRenamed("doc_id", "upload"), after.limit(0), after)


def toc_source_choice(files: DataFrame) -> DataFrame:
    """(book, nav, ncx) from (book, path, pos, declared_nav, declared_ncx): what is declared and there, or a guess by name.

    ``nav.xhtml`` itself goes before other names with nav in them, and of several the last; of the others the first.
    """
    low = F.lower("path")
    exact = F.element_at(F.split(low, "/"), -1) == "nav.xhtml"
    ranked = lambda rank, pos: F.struct(F.lit(rank).alias("rank"), pos.cast("int").alias("pos"), F.col("path").alias("path"))
    here = F.lit(0)
    nav = F.when(F.col("path") == F.col("declared_nav"), ranked(0, here)).when(exact, ranked(1, -F.col("pos"))).when(low.contains("nav") & low.endswith(".xhtml"), ranked(2, F.col("pos")))
    ncx = F.when(F.col("path") == F.col("declared_ncx"), ranked(0, here)).when(low.endswith(".ncx"), ranked(1, F.col("pos")))
    return files.groupBy("book").agg(F.min(nav)["path"].alias("nav"), F.min(ncx)["path"].alias("ncx"))


@query(
    "toc_source_choice",
    "v_package_files",
    sql="""SELECT book, max(path) FILTER (nav_rank = best_nav) AS nav, max(path) FILTER (ncx_rank = best_ncx) AS ncx FROM (SELECT *, min(nav_rank) OVER (PARTITION BY book) AS best_nav, min(ncx_rank) OVER (PARTITION BY book) AS best_ncx FROM
 (SELECT book, path, CASE WHEN path = declared_nav THEN 0 WHEN path LIKE '%/nav.xhtml' THEN 1 WHEN contains(path, 'nav') AND path LIKE '%.xhtml' THEN 2 END AS nav_rank, CASE WHEN path = declared_ncx THEN 0 WHEN path LIKE '%.ncx' THEN 1 END AS ncx_rank FROM
 (SELECT book // 5 AS book, path, max(declared_nav) OVER (PARTITION BY book // 5) AS declared_nav, max(declared_ncx) OVER (PARTITION BY book // 5) AS declared_ncx FROM v_package_files))) GROUP BY book""",
)
def toc_sources(files: DataFrame) -> DataFrame:
    """Five neighbouring pages stand for the files of a book; what any of them declares counts."""
    book = F.floor(F.col("book") / 5)
    declared = files.groupBy(book.alias("book")).agg(F.max("declared_nav").alias("declared_nav"), F.max("declared_ncx").alias("declared_ncx"))
    return toc_source_choice(files.select(book.alias("book"), "path", "pos").join(declared, "book"))


def cover_choice(items: DataFrame, images: DataFrame, pages: int = 12) -> DataFrame:
    """(book, cover): the declared image, or the one with the cover property, or the first image in the first spine pages.

    items: book, pos, path, is_image, declared, cover_property; images: book, spine_pos, is_nav, pos, path.
    """
    named = items.where("is_image AND (declared OR cover_property)").select("book", F.struct(F.when(F.col("declared"), 0).otherwise(1).alias("rank"), F.lit(0).alias("page"), F.col("pos").alias("pos"), F.col("path").alias("path")).alias("c"))
    spine = images.where("NOT is_nav").withColumn("page", F.dense_rank().over(W.partitionBy("book").orderBy("spine_pos"))).where((F.col("page") <= pages) & F.col("path").isNotNull())
    seen = spine.select("book", F.struct(F.lit(2).alias("rank"), F.col("page"), F.col("pos"), F.col("path")).alias("c"))
    return named.unionByName(seen).groupBy("book").agg(F.min("c")["path"].alias("cover"))


@query(
    "cover_choice",
    "v_package_files",
    sql="""SELECT book, coalesce(max(path) FILTER (book % 6 = 0), max(path) FILTER (book % 6 = 1), max(path) FILTER (book % 6 NOT IN (0, 1) AND img <> '')) AS cover FROM (SELECT book, CASE WHEN book % 6 IN (0, 1) THEN path ELSE regexp_extract(html, '<img[^>]*src="([^"]*)"', 1) END AS path, regexp_extract(html, '<img[^>]*src="([^"]*)"', 1) AS img FROM v_package_files)
 WHERE book % 6 IN (0, 1) OR img <> '' GROUP BY book""",
)
def covers(files: DataFrame) -> DataFrame:
    """Books that declare an image, books whose image has the property, and books with an image in their first page."""
    rest = F.col("book") % 6
    items = files.where(rest < 2).select("book", "pos", "path", F.lit(True).alias("is_image"), (rest == 0).alias("declared"), (rest == 1).alias("cover_property"))
    src = F.regexp_extract("html", '<img[^>]*src="([^"]*)"', 1)
    images = files.where(rest >= 2).select("book", F.lit(0).alias("spine_pos"), F.lit(False).alias("is_nav"), F.lit(0).alias("pos"), F.when(src != "", src).alias("path"))
    return cover_choice(items, images)


def snapshot_policy(requests: DataFrame, previous: DataFrame, layouts: DataFrame) -> DataFrame:
    """(uuid, outcome) for requests (uuid, last_page, has_index): saved, kept (the snapshot before still waits for its new
    layout), or skipped (not read, or no index). previous: uuid, at_ms; layouts: uuid, laid_out_ms."""
    found = requests.join(previous.select("uuid", "at_ms"), "uuid", "left").join(layouts.select("uuid", "laid_out_ms"), "uuid", "left")
    waits = F.col("at_ms").isNotNull() & (F.coalesce("laid_out_ms", F.lit(-1)) < F.col("at_ms"))
    return found.select("uuid", F.when(waits, "kept").when((F.coalesce("last_page", F.lit(0)) > 0) & F.col("has_index"), "saved").otherwise("skipped").alias("outcome"))


@query("snapshot_policy", "v_shelf", sql="SELECT doc_id AS uuid, CASE WHEN doc_id % 2 = 0 AND coalesce(native_at, -1) < mtime THEN 'kept' WHEN bytes % 3 > 0 AND format = 'epub' THEN 'saved' ELSE 'skipped' END AS outcome FROM v_shelf")
def snapshots_of_shelf(shelf: DataFrame) -> DataFrame:
    """Requests for every item; every second one has a snapshot from before, and its delivery time is the new layout's."""
    asked = shelf.select(F.col("doc_id").alias("uuid"), (F.col("bytes") % 3).alias("last_page"), (F.col("format") == "epub").alias("has_index"))
    before = shelf.where("doc_id % 2 = 0").select(F.col("doc_id").alias("uuid"), F.col("mtime").alias("at_ms"))
    return snapshot_policy(asked, before, shelf.select(F.col("doc_id").alias("uuid"), F.col("native_at").alias("laid_out_ms")))


@query("await_render", "v_shelf", sql="SELECT doc_id AS uuid, CASE WHEN native_at >= mtime AND native_at <= mtime + 600 THEN 'ok' ELSE 'timeout' END AS render FROM v_shelf")
def await_render(shelf: DataFrame, seconds: int = 600) -> DataFrame:
    """Deliveries with the render that followed in time, else a timeout: the batch form of the stream."""
    renders = shelf.where("native_at IS NOT NULL").select(F.col("doc_id").alias("uuid"), F.col("native_at").alias("rendered_at"))
    both = shelf.select(F.col("doc_id").alias("uuid"), F.col("mtime").alias("delivered_at")).join(renders, "uuid", "left")
    near = (F.col("rendered_at") >= F.col("delivered_at")) & (F.col("rendered_at") <= F.col("delivered_at") + seconds)
    return both.select("uuid", F.when(near, "ok").otherwise("timeout").alias("render"))


@query("snapshot_expiry", "v_shelf", "v_kept_files", sql="SELECT s.doc_id, s.mtime FROM v_shelf s WHERE s.mtime >= 1704100000 AND s.doc_id IN (SELECT doc_id FROM v_kept_files)")
def snapshot_expiry(shelf: DataFrame, files: DataFrame, oldest: int = 1704100000) -> DataFrame:
    """Snapshots that are young enough and whose book is still there."""
    return shelf.where(F.col("mtime") >= oldest).join(files.select("doc_id"), "doc_id", "left_semi").select("doc_id", "mtime")


@query("provider_of_url", "pages", sql="SELECT page_id, CASE rtrim(concat(regexp_replace(regexp_extract(url, '^https?://[^/]+', 0), '//.*[.]', '//'), CASE WHEN page_id % 2 = 0 THEN '//' ELSE '' END), '/') WHEN 'https://com' THEN 'first' WHEN 'https://net' THEN 'second' WHEN 'http://com' THEN 'third' END AS provider FROM pages")
def provider_of_urls(pages: DataFrame) -> DataFrame:
    """Providers by the scheme and the last part of the sites of pages, with and without slashes at their end."""
    table = {"https://com/": "first", "https://net": "second", "http://com//": "third"}
    site = F.regexp_replace(F.regexp_extract("url", "^https?://[^/]+", 0), "//.*[.]", "//")
    return pages.select("page_id", T.provider_of_url(F.concat(site, F.when(F.col("page_id") % 2 == 0, "//").otherwise("")), table).alias("provider"))


def scan_drafts(strokes: DataFrame, highlights: DataFrame, changed: DataFrame) -> DataFrame:
    """The drafts (book, page, pos, ink_hash, strokes, quote_id) that a scan finds on the changed pages (book, page). Hashes are
    made when they are asked for, and aren't written with the clusters."""
    own = strokes.join(changed.select("page"), "page", "left_semi")
    inked = made(lambda: lifecycle.inked_drafts(own).drop("ink_hash"), "inked")
    paired = mining.nearest_highlight(inked.select("page", "cluster", "x0", "y0", "x1", "y1"), highlights).select("page", "cluster", "hl_no")
    drafts = inked.join(paired, ["page", "cluster"], "left").join(changed, "page")
    drafts = drafts.select("book", "page", F.col("cluster").alias("pos"), lifecycle.ink_hash(F.col("strokes")).alias("ink_hash"), "strokes", F.col("hl_no").cast("string").alias("quote_id"))
    left = highlights.join(changed, "page").join(paired.where("hl_no IS NOT NULL").select("page", "hl_no"), ["page", "hl_no"], "left_anti")
    bare = left.select("book", "page", (F.lit(1 << 60) + F.col("hl_no")).alias("pos"), F.lit(None).cast("string").alias("ink_hash"), F.lit(None).cast("array<string>").alias("strokes"), F.col("hl_no").cast("string").alias("quote_id"))
    return drafts.unionByName(bare)


def scan_to_claims(strokes: DataFrame, highlights: DataFrame, stored: DataFrame, pages: DataFrame, state: DataFrame) -> DataFrame:
    """Changed pages of a scan, mined and held against the stored entries.

    strokes and highlights carry ``page``; pages (page_key, book, page) are the scanned ones and state what was recorded.
    """
    changed = structure.changed_pages(pages, state).select("book", "page").distinct()
    return lifecycle.merge_claim(scan_drafts(strokes, highlights, changed), stored)


def ingest(strokes: DataFrame, highlights: DataFrame, stored: DataFrame, changed: DataFrame, steps: Steps) -> DataFrame:
    """The entries (book, page, id, seq, status, ink_hash, strokes, quote_id) that a scan of the changed pages adds or changes."""
    drafts = steps.made(lambda: scan_drafts(strokes, highlights, changed).drop("ink_hash"), "drafts")
    return lifecycle.merge_entries(drafts, stored)


def active(entries: DataFrame) -> DataFrame:
    return entries.where(~E.is_terminal(F.col("status")))
