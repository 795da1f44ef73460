"""Sources: files of a library of books as tables. Bad files and bad fields are rows with defaults, or no rows; never errors."""

from __future__ import annotations

import uuid
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from ..functions.text import safe_filename
from ..store import cut, delete, put_files, replace_all

#: Seconds by which a file's time may be earlier than asked for: clocks of file systems are coarse.
SLACK_S = 5


def whole_files(spark: SparkSession, path: str, glob: str, **options: str) -> DataFrame:
    """(uuid, modified, text) of every file of the folder: the name without its extension, and the whole content."""
    files = spark.read.options(**options).text(path, wholetext=True, pathGlobFilter=glob)
    name = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.[^./]+$", 1)
    return files.select(name.alias("uuid"), F.col("_metadata.file_modification_time").alias("modified"), F.col("value").alias("text"))


def field(doc: Column, path: str, kind: str) -> Column:
    """A field of a variant; null if it isn't there or is of another kind."""
    return F.try_variant_get(doc, path, kind)


def number(doc: Column, path: str) -> Column:
    """A whole number, written as a number or as text."""
    return F.coalesce(field(doc, path, "bigint"), F.when(F.trim(field(doc, path, "string")).rlike("^-?[0-9]+$"), F.trim(field(doc, path, "string")).try_cast("bigint")))


def scan_library(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """One row for each readable ``<uuid>.metadata``: visible_name, kind, parent, deleted, created_ms, last_opened_page."""
    doc = F.try_parse_json("text")
    files = whole_files(spark, path, "*.metadata", **options).withColumn("doc", doc)
    files = files.where(F.col("doc").isNotNull() & (F.schema_of_variant("doc").startswith("OBJECT")))
    d = F.col("doc")
    kind = field(d, "$.type", "string")
    return files.select(
        "uuid",
        F.coalesce(field(d, "$.visibleName", "string"), F.lit("")).alias("visible_name"),
        F.when(kind == "DocumentType", "document").when(kind == "CollectionType", "folder").otherwise("other").alias("kind"),
        F.coalesce(field(d, "$.parent", "string"), F.lit("")).alias("parent"),
        F.coalesce(field(d, "$.deleted", "boolean"), F.lit(False)).alias("deleted"),
        F.coalesce(number(d, "$.createdTime"), F.lit(0)).alias("created_ms"),
        number(d, "$.lastOpenedPage").alias("last_opened_page"),
    )


def scan_library_since(spark: SparkSession, path: str, since_ms: int) -> DataFrame:
    """What was created since then, newest first; older files aren't opened."""
    from datetime import datetime, timezone

    after = datetime.fromtimestamp(max(0, since_ms / 1000 - SLACK_S), timezone.utc).strftime("%Y-%m-%dT%H:%M:%S")
    return scan_library(spark, path, modifiedAfter=after, timeZone="UTC").where(F.col("created_ms") >= since_ms).orderBy(F.desc("created_ms"))


def scan_page_table(spark: SparkSession, path: str) -> DataFrame:
    """(book, ordinal, page_id, pdf_page, version) from every ``<uuid>.content``, of both layouts.

    Layout 1 lists ids and PDF pages; layout 2 has objects with a fractional index, of which the deleted ones are dropped.
    """
    files = whole_files(spark, path, "*.content").withColumn("doc", F.try_parse_json("text")).where("doc IS NOT NULL")
    d = F.col("doc")
    ids, redirected = field(d, "$.pages", "array<variant>"), field(d, "$.redirectionPageMap", "array<variant>")
    first = files.select(F.col("uuid").alias("book"), F.posexplode(F.arrays_zip(F.coalesce(ids, F.array().cast("array<variant>")).alias("id"), F.coalesce(redirected, F.array().cast("array<variant>")).alias("redir"))).alias("ordinal", "x"))
    # `array<variant>` gives each element its own kind, so a wrong one is null by itself
    one = first.select("book", "ordinal", field(F.col("x.id"), "$", "string").alias("page_id"), field(F.col("x.redir"), "$", "int").alias("pdf_page"), F.lit(1).alias("version"))
    pages = files.select(F.col("uuid").alias("book"), F.posexplode(field(d, "$.cPages.pages", "array<variant>")).alias("at", "p"))
    p = F.col("p")
    live = pages.where(F.coalesce(field(p, "$.deleted.value", "int"), F.lit(0)) == 0).withColumn("idx", F.coalesce(field(p, "$.idx.value", "string"), F.lit("")))
    ordinal = F.row_number().over(W.partitionBy("book").orderBy("idx", "at")) - 1
    page_id = field(p, "$.id", "string")
    two = live.select("book", ordinal.alias("ordinal"), F.when(page_id != "", page_id).alias("page_id"), field(p, "$.redir.value", "int").alias("pdf_page"), F.lit(2).alias("version"))
    pdf = F.when(F.col("pdf_page") >= 0, F.col("pdf_page"))
    return one.unionByName(two).withColumn("pdf_page", pdf)


def page_id_lookup(table: DataFrame) -> DataFrame:
    """(book, page_id, ordinal): layout 1 where it has ids, else layout 2, counted without its nameless pages."""
    named = table.where("page_id IS NOT NULL")
    has_first = named.where("version = 1").select("book").distinct()
    second = named.where("version = 2").join(has_first, "book", "left_anti")
    kept = named.where("version = 1").unionByName(second)
    return kept.select("book", "page_id", (F.row_number().over(W.partitionBy("book").orderBy("ordinal")) - 1).alias("ordinal"))


def pdf_pages(table: DataFrame) -> DataFrame:
    """(book, ordinal, pdf_page): layout 2 where there is one, else layout 1. A book whose table names no PDF page has
    none here: its pages are their own."""
    second = table.where("version = 2").select("book").distinct()
    kept = table.where("version = 2").unionByName(table.where("version = 1").join(second, "book", "left_anti"))
    mapped = kept.where("pdf_page IS NOT NULL").select("book").distinct()
    return kept.join(mapped, "book", "left_semi").select("book", "ordinal", "pdf_page")


def pdf_of(pages: DataFrame, table: DataFrame) -> DataFrame:
    """PDF page of document pages (book, page); the page itself where the table says nothing."""
    found = pages.join(pdf_pages(table).withColumnRenamed("ordinal", "page"), ["book", "page"], "left")
    return found.select("book", "page", F.coalesce("pdf_page", "page").alias("pdf_page"))


def doc_of(pages: DataFrame, table: DataFrame) -> DataFrame:
    """The first document page of PDF pages (book, pdf_page)."""
    first = pdf_pages(table).where("pdf_page IS NOT NULL").groupBy("book", "pdf_page").agg(F.min("ordinal").alias("page"))
    return pages.join(first, ["book", "pdf_page"], "left").select("book", "pdf_page", F.coalesce("page", "pdf_page").alias("page"))


def pdf_total(table: DataFrame) -> DataFrame:
    return pdf_pages(table).groupBy("book").agg((F.max("pdf_page") + 1).alias("pages"))


DEPLOY = "device string, at bigint, label string, only string, failed string, commit string, dirty boolean, via string, host string, files map<string,string>"


def read_deploy_log(spark: SparkSession, path: str, last: int = 20) -> DataFrame:
    """The newest stamps of every device; bad lines are skipped, missing fields take defaults."""
    rows = spark.read.schema(DEPLOY + ", _bad string").option("columnNameOfCorruptRecord", "_bad").option("mode", "PERMISSIVE").json(path)
    rows = rows.where("_bad IS NULL").drop("_bad").fillna("").fillna(0).fillna(False)
    newest = F.row_number().over(W.partitionBy("device").orderBy(F.desc("at")))
    return rows.withColumn("n", newest).where(F.col("n") <= last).drop("n")


def read_allowlist(spark: SparkSession, path: str) -> DataFrame:
    """(sha256, label) of lines that begin with 64 hexadecimal digits; comments and other lines are skipped."""
    line = F.regexp_replace("value", r"(?U)^\s+|\s+$", "")
    pattern = r"(?U)^([0-9a-fA-F]{64})(?:\s+(.*))?$"
    return spark.read.text(path).select(F.lower(F.regexp_extract(line, pattern, 1)).alias("sha256"), F.regexp_extract(line, pattern, 2).alias("label")).where("sha256 <> ''")


#: The fields of an entry document in their order, what an optional one is when it is missing, and the words that some may be.
QUOTE = "struct<id:string,text:string,color:string,rects:array<array<double>>>"
INK = "struct<strokes:array<string>,bbox:array<double>,hash:string,crop:string>"
DRAFT = "struct<text:string,backend:string,at:bigint,hash:string>"
ANSWER = "struct<text:string,backend:string,at:bigint,brief:string>"
REVIEW = "struct<due:bigint,interval_days:int,streak:int,last:bigint>"
ENTRY_FIELDS = {
    "id": "string", "page": "string", "page_index": "int", "chapter": "int", "chapter_title": "string", "subhead": "string", "quote": QUOTE, "ink": INK, "drafts": f"array<{DRAFT}>", "text": "string",
    "style": "string", "ask_ai": "boolean", "question": "string", "answer": ANSWER, "status": "string", "destination": "string", "source": "string", "review": REVIEW, "created": "bigint", "updated": "bigint",
}
ENTRY_DEFAULTS = {"chapter_title": "", "style": "body", "ask_ai": False, "status": "mined", "destination": "both", "source": "xochitl"}
ENTRY_WORDS = {
    "style": ("body", "bullet", "numbered", "checkbox", "heading1", "heading2"),
    "status": ("mined", "pending", "draft", "reviewed", "skipped", "revoked", "archived"),
    "destination": ("notebook", "obsidian", "both"),
    "source": ("xochitl", "koreader_highlight", "koreader_vocab"),
}
REQUIRED = {"": ("id", "page", "page_index", "created", "updated"), "quote": ("text", "color", "rects"), "ink": ("strokes", "bbox", "hash"), "answer": ("text", "backend", "at", "brief"), "review": ("due", "interval_days", "streak")}
ENTRY = f"struct<{','.join(f'{n}:{k}' for n, k in ENTRY_FIELDS.items())}>"
BOOK = f"uuid string, title string, author string, chapters array<string>, entries array<{ENTRY}>, page_mtimes map<string,bigint>"


def _broken(e: Column) -> Column:
    """Whether an entry lacks a field that it must have, or has a word that isn't known. Its document can't be read then."""
    bad = e.isNull()
    for part, fields in REQUIRED.items():
        missing = F.lit(False)
        for f in fields:
            missing = missing | (e[part][f] if part else e[f]).isNull()
        bad = bad | (missing if not part else e[part].isNotNull() & missing)
    bad = bad | F.coalesce(F.exists(e["drafts"], lambda d: d["text"].isNull() | d["backend"].isNull() | d["at"].isNull() | d["hash"].isNull()), F.lit(False))
    for name, words in ENTRY_WORDS.items():
        bad = bad | (e[name].isNotNull() & ~e[name].isin(*words))
    return bad


def _filled(e: Column) -> list[Column]:
    """An entry's fields with their defaults."""
    out = []
    for name in ENTRY_FIELDS:
        c = F.coalesce(e[name], F.lit(ENTRY_DEFAULTS[name])) if name in ENTRY_DEFAULTS else e[name]
        if name == "drafts":
            c = F.coalesce(c, F.array().cast(f"array<{DRAFT}>"))
        if name == "quote":
            c = F.when(c.isNotNull(), c.withField("id", F.coalesce(c["id"], F.lit(""))))
        if name == "ink":
            c = F.when(c.isNotNull(), c.withField("crop", F.coalesce(c["crop"], F.lit(""))))
        out.append(c.alias(name))
    return out


def _documents(spark: SparkSession, path: str) -> DataFrame:
    files = whole_files(spark, path, "*.json")
    parsed = files.withColumn("book", F.from_json("text", BOOK + ", _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    b = F.col("book")
    bad = b.isNull() | b["_bad"].isNotNull() | b["uuid"].isNull() | b["title"].isNull() | F.coalesce(F.exists(b["entries"], _broken), F.lit(False))
    return parsed.withColumn("bad", bad)


def read_books(spark: SparkSession, path: str) -> DataFrame:
    """(book, title, author, chapters, page_mtimes) of the documents that can be read."""
    b = F.col("book")
    return _documents(spark, path).where(~F.col("bad")).select(b["uuid"].alias("book"), b["title"].alias("title"), F.coalesce(b["author"], F.lit("")).alias("author"), F.coalesce(b["chapters"], F.array().cast("array<string>")).alias("chapters"), F.coalesce(b["page_mtimes"], F.create_map().cast("map<string,bigint>")).alias("page_mtimes"))


def read_entries(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(entries, quarantine): one JSON document a file, its entries with their places ``seq`` and all their fields. A document that can't be
    read is never an empty book: its name and text go to the quarantine, and ``write_entries`` leaves its book alone."""
    docs = _documents(spark, path)
    good = docs.where(~F.col("bad")).select(F.col("book.uuid").alias("book"), F.posexplode("book.entries").alias("seq", "e"))
    return good.select("book", "seq", *_filled(F.col("e"))), docs.where("bad").select(F.col("uuid").alias("book"), "text")


def changed_books(new: DataFrame, old: DataFrame, quarantined: DataFrame) -> DataFrame:
    """The books whose entries differ, without the quarantined ones: compared by sums of two digests of every row, in no order,
    so that no book is gathered."""

    def digest(entries: DataFrame, name: str) -> DataFrame:
        columns = sorted(entries.columns)
        total = lambda c: F.sum(c.cast("decimal(20,0)"))
        return entries.groupBy("book").agg(F.struct(F.count(F.lit(1)), total(F.xxhash64(*columns)), total(F.xxhash64(F.lit(1), *columns))).alias(name))

    both = digest(new, "new").join(digest(old, "old"), "book", "full")
    return both.where(~F.col("new").eqNullSafe(F.col("old"))).select("book").join(quarantined.select("book"), "book", "left_anti")


def write_entries(new: DataFrame, old: DataFrame, quarantined: DataFrame, books: DataFrame, path: str) -> None:
    """Write the documents of the changed books only, ``<path>/<book>.json``, each in one step; the others' files stay as they are. A book
    of which no entry is left keeps its document, without entries. A document is gathered, as it is one file."""
    changed = cut(changed_books(new, old, quarantined), "changed")
    entry = F.struct(*ENTRY_FIELDS)
    listed = new.join(changed, "book", "left_semi").groupBy("book").agg(F.array_sort(F.collect_list(F.struct("seq", entry.alias("entry")))).alias("listed"))
    whole = books.join(changed, "book", "left_semi").join(listed, "book", "left")
    none = F.array().cast(f"array<{ENTRY}>")
    doc = F.struct(F.col("book").alias("uuid"), "title", "author", "chapters", F.coalesce(F.transform("listed", lambda x: x["entry"]), none).alias("entries"), "page_mtimes")
    put_files(whole.select(F.concat("book", F.lit(".json")).alias("name"), F.to_json(doc).alias("value")), path)


def sink_vault(pieces: DataFrame, prints: DataFrame, recorded: DataFrame, path: str) -> DataFrame:
    """Write the chapters' Markdown files, ``<path>/<book's title>/<file>.md``, and return the new records (book, chapter, recorded).

    pieces: book, title, chapter, file, page_index, id, piece, as ``publishing.chapter_files`` gives them; prints: book, chapter,
    fingerprint; recorded: book, chapter, recorded, from the last time. A chapter whose fingerprint is on record isn't written.
    Each file is written aside by one task, which reads its pieces in order, and then moved to its place in one step.
    """
    spark = pieces.sparkSession
    changed = prints.join(recorded.select("book", "chapter", F.col("recorded").alias("fingerprint")), ["book", "chapter", "fingerprint"], "left_anti")
    changed = cut(changed, "changed")
    todo = pieces.join(changed.select("book", "chapter"), ["book", "chapter"], "left_semi")
    own = todo.select(safe_filename(F.col("title")).alias("folder"), "file", "page_index", "id", F.col("piece").alias("value"))
    aside = f"{path.rstrip('/')}/_aside-{uuid.uuid4().hex}"
    own.repartition("folder", "file").sortWithinPartitions("folder", "file", "page_index", "id").select("folder", "file", "value").write.option("maxRecordsPerFile", 0).partitionBy("folder", "file").text(aside)
    if not changed.isEmpty():
        written = spark.read.text(aside).select(F.col("folder").cast("string").alias("folder"), F.col("file").cast("string").alias("file"), F.col("_metadata.file_path").alias("source")).distinct()
        replace_all(spark, ((r.source, f"{path.rstrip('/')}/{r.folder}/{r.file}.md") for r in written.toLocalIterator()))
    delete(spark, aside)
    kept = recorded.select("book", "chapter", "recorded").join(changed.select("book", "chapter"), ["book", "chapter"], "left_anti")
    return kept.unionByName(changed.select("book", "chapter", F.col("fingerprint").alias("recorded")))


PACKAGE = "titles array<string>, creators array<string>, ids array<string>, hrefs array<string>, direction string, spine array<string>"


def _package(xml: pd.Series) -> pd.DataFrame:
    """What is asked of package documents, each parsed once; nulls for none."""
    rows = []
    for x in xml:
        if not x:
            rows.append((None,) * 6)
            continue
        root = ElementTree.fromstring(x)
        within = lambda part, child: [e for p in root.iter(part) for e in p.findall(child)]
        words = lambda child: [t for e in within("metadata", child) for t in (e.text, *(c.tail for c in e)) if t]
        values = lambda found, name: [e.get(name) for e in found if e.get(name) is not None]
        items, name = within("manifest", "item"), "page-progression-direction"
        rows.append((words("title"), words("creator"), values(items, "id"), values(items, "href"), next(iter(values(root.iter("spine"), name)), ""), values(within("spine", "itemref"), "idref")))
    return pd.DataFrame(rows, columns=["titles", "creators", "ids", "hrefs", "direction", "spine"])


def extract_opf(files: DataFrame, key: str = "uuid", text: str = "text") -> DataFrame:
    """(key, title, creator, rtl, manifest, spine) of package documents; the spine as the items' places. A document is parsed once for
    all of them."""
    bare = F.regexp_replace(F.regexp_replace(text, "(?s)<!--.*?-->|<\\?xml.*?\\?>|<!DOCTYPE[^>]*>", ""), r"\sxmlns(:\w+)?=\"[^\"]*\"|(?<=[<\s/])(?:dc|opf):", "")
    parsed = F.pandas_udf(_package, PACKAGE)
    found = files.withColumn("_x", parsed(F.regexp_replace(bare, r"(</?)(?:dc|opf):", "$1")))
    x = F.col("_x")
    first = lambda c: F.get(F.filter(F.transform(c, lambda s: F.trim(s)), lambda s: s != ""), 0)
    return found.select(
        key,
        first(x["titles"]).alias("title"),
        first(x["creators"]).alias("creator"),
        (F.lower(F.trim(x["direction"])) == "rtl").alias("rtl"),
        F.arrays_zip(x["ids"].alias("id"), x["hrefs"].alias("href")).alias("manifest"),
        x["spine"].alias("spine"),
    )


def book_direction(files: DataFrame, key: str = "uuid", text: str = "text") -> DataFrame:
    """(key, rtl) of package documents: whether the spine runs from right to left; not where it doesn't say so."""
    return extract_opf(files, key, text).select(key, "rtl")
