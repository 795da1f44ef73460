"""Structure of books: sections, pages to chapters, positions.

The as-of joins are unions of both sides with a running last value over one sort, not inequality joins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions import text as T
from ..plans.registry import query

@query("scan_sections", "v_sections", sql="SELECT book, file, min(start_page) AS start_page FROM v_sections GROUP BY book, file")
def scan_sections(sections: DataFrame) -> DataFrame:
    """One row for each file of a book: the one that begins first."""
    first = F.row_number().over(W.partitionBy("book", "file").orderBy("start_page"))
    return sections.withColumn("n", first).where("n = 1").select("book", "file", "start_page")


#: Pages of a book that one sort takes together.
BUCKET = 64


def as_of(pages: DataFrame, marks: DataFrame, value: str, bucket: int = BUCKET) -> DataFrame:
    """Every page with the value of the last mark at or before it: pages (book, page, ...), marks (book, start_page, value).

    Of marks at one place the last by value counts. A book is sorted in buckets of pages; each bucket begins with the last
    mark of those before it, which a window over the buckets (one row for each of a book's) carries on.
    """
    kind = marks.schema[value].dataType
    own = lambda page: F.floor(page / bucket).alias("_bucket")
    at = marks.select("book", own(F.col("start_page")), F.col("start_page").alias("page"), F.col(value).alias("_mark"), F.lit(0).alias("_kind"))
    placed = pages.select("*", own(F.col("page")), F.lit(None).cast(kind).alias("_mark"), F.lit(1).alias("_kind"))
    last = at.groupBy("book", "_bucket").agg(F.max(F.struct("page", "_mark"))["_mark"].alias("_mark"))
    ends = last.unionByName(placed.select("book", "_bucket", "_mark")).groupBy("book", "_bucket").agg(F.max("_mark").alias("_mark"))
    carried = F.last("_mark", ignorenulls=True).over(W.partitionBy("book").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1))
    before = ends.withColumn("_mark", carried).where("_mark IS NOT NULL").select("book", "_bucket", (F.col("_bucket") * bucket).alias("page"), "_mark", F.lit(-1).alias("_kind"))
    both = placed.unionByName(at, allowMissingColumns=True).unionByName(before, allowMissingColumns=True)
    found = F.last("_mark", ignorenulls=True).over(W.partitionBy("book", "_bucket").orderBy("page", "_kind", "_mark").rowsBetween(W.unboundedPreceding, 0))
    return both.withColumn(value, found).where("_kind = 1").drop("_mark", "_kind", "_bucket")


@query(
    "page_section",
    "v_pages",
    "v_sections",
    sql="SELECT page_key, p.book, page, (SELECT max_by(file, (start_page, file)) FROM v_sections s WHERE s.book = p.book AND s.start_page <= p.page) AS file FROM v_pages p",
)
def page_section(pages: DataFrame, sections: DataFrame) -> DataFrame:
    return as_of(pages, sections, "file").select("page_key", "book", "page", "file")


@query(
    "page_chapter",
    "v_pages",
    "v_sections",
    sql="SELECT page_key, p.book, page, (SELECT max_by(file, (start_page, file)) FROM v_sections s WHERE s.book = p.book AND s.start_page <= p.page AND s.start_page % 3 <> 0) AS chapter FROM v_pages p",
)
def page_chapter(pages: DataFrame, sections: DataFrame) -> DataFrame:
    """The nearest section at or before the page whose file is in the table of contents; in the view, those whose start 3
    doesn't divide are. A page before all of them has none."""
    listed = sections.where("start_page % 3 <> 0")
    return as_of(pages, listed.withColumnRenamed("file", "chapter"), "chapter").select("page_key", "book", "page", "chapter")


@query(
    "section_spans",
    "v_sections",
    sql="SELECT book, file, start_page, greatest(coalesce(lead(start_page) OVER (PARTITION BY book ORDER BY start_page, file), 500) - start_page, 1) AS pages FROM v_sections",
)
def section_spans(sections: DataFrame, total: int = 500) -> DataFrame:
    """Pages of each section: up to the next one, or to the end; one at least."""
    after = F.lead("start_page").over(W.partitionBy("book").orderBy("start_page", "file"))
    return sections.select("book", "file", "start_page", F.greatest(F.coalesce(after, F.lit(total)) - F.col("start_page"), F.lit(1)).alias("pages"))


@query(
    "remap_position",
    "v_pages",
    "v_sections",
    sql="""WITH s AS (SELECT book, file, start_page, greatest(coalesce(lead(start_page) OVER (PARTITION BY book ORDER BY start_page, file), 500) - start_page, 1) AS pages FROM v_sections),
old AS (SELECT page_key, p.book, page, (SELECT max_by(file, (start_page, file)) FROM v_sections s WHERE s.book = p.book AND s.start_page <= p.page) AS file FROM v_pages p)
SELECT o.page_key, CAST(CASE WHEN s.file IS NOT NULL THEN s.start_page + least(CAST(round((o.page_key % 101) / 101.0::DOUBLE * s.pages) AS BIGINT), s.pages - 1) ELSE round(o.page / 499.0::DOUBLE * 499) END AS BIGINT) AS new_page FROM old o LEFT JOIN s ON o.book = s.book AND o.file = s.file""",
)
def remap_position(pages: DataFrame, sections: DataFrame) -> DataFrame:
    """Where the places of an old layout are in a new one; in the view, both layouts have the same sections."""
    old = page_section(pages, sections).select("page_key", "book", "file", ((F.col("page_key") % 101) / F.lit(101.0)).alias("file_ratio"), (F.col("page") / F.lit(499.0)).alias("book_ratio"))
    return remap(old, section_spans(sections), 500)


def remap(positions: DataFrame, spans: DataFrame, total: int) -> DataFrame:
    """By the ratio within the same file, or else within the book (page_key, new_page)."""
    found = positions.join(spans, ["book", "file"], "left")
    inside = F.col("start_page") + F.least(F.round(F.col("file_ratio") * F.col("pages")).cast("long"), F.col("pages") - 1)
    return found.select("page_key", F.coalesce(inside, F.round(F.col("book_ratio") * (total - 1)).cast("long")).cast("long").alias("new_page"))


@query("changed_pages", "v_pages", "v_page_state", sql="SELECT p.page_key, p.book, p.page FROM v_pages p LEFT JOIN v_page_state s ON p.book = s.book AND p.page = s.page WHERE s.mtime IS NULL OR p.page_key > s.mtime")
def changed_pages(pages: DataFrame, state: DataFrame) -> DataFrame:
    """Pages that changed since they were recorded, or never were; in the view, the key is the time."""
    return pages.join(state, ["book", "page"], "left").where("mtime IS NULL OR page_key > mtime").select("page_key", "book", "page")


def recorded_times(pages: DataFrame, now: int) -> DataFrame:
    """What to record: a page touched in the current second is recorded a second earlier, so that it is scanned again."""
    return pages.withColumn("mtime", F.when(F.col("mtime") >= now, F.col("mtime") - 1).otherwise(F.col("mtime")))


@query("catchup_set", "v_pages", "v_page_state", sql="SELECT book, page FROM v_pages WHERE page_key % 2 = 0 UNION SELECT book, page FROM v_page_state")
def catchup_set(pages: DataFrame, known: DataFrame) -> DataFrame:
    return pages.where("page_key % 2 = 0").select("book", "page").union(known.select("book", "page")).distinct()


@query("unmapped_pages", "v_entries", sql="SELECT DISTINCT book, page_index FROM v_entries WHERE status NOT IN ('skipped','revoked','archived') AND chapter IS NULL")
def unmapped_pages(entries: DataFrame) -> DataFrame:
    """Pages of active entries without a chapter, to be scanned again."""
    return entries.where("status NOT IN ('skipped','revoked','archived') AND chapter IS NULL").select("book", "page_index").distinct()


@query("stale_books", "v_entries", "v_books", sql="SELECT id, book, CASE WHEN status IN ('skipped','revoked','archived') THEN status ELSE 'revoked' END AS status FROM v_entries WHERE book NOT IN (SELECT uuid FROM v_books WHERE author <> '')")
def stale_books(entries: DataFrame, books: DataFrame) -> DataFrame:
    """Entries of books that are gone, after their revocation; in the view, books with an author are live."""
    gone = entries.join(books.where("author <> ''").select(F.col("uuid").alias("book")), "book", "left_anti")
    return gone.select("id", "book", F.when(F.col("status").isin("skipped", "revoked", "archived"), F.col("status")).otherwise("revoked").alias("status"))


@query("mineable_docs", "v_library", "v_pages", sql="SELECT uuid, name FROM v_library WHERE kind = 'document' AND parent <> 'trash' AND NOT deleted AND CAST(substring(uuid, 2) AS BIGINT) IN (SELECT page FROM v_pages)")
def mineable_docs(library: DataFrame, pages: DataFrame) -> DataFrame:
    """Live documents with annotated pages; in the view, a page number stands for a document."""
    live = library.where("kind = 'document' AND parent <> 'trash' AND NOT deleted")
    annotated = pages.select(F.concat(F.lit("c"), F.col("page").cast("string")).alias("uuid")).distinct()
    return live.join(annotated, "uuid", "left_semi").select("uuid", "name")


@query("plain_text", "pages", sql=r"""SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&apos;', ''''), '&amp;', '&'), '[ \t\r\n]+', ' ', 'g')) AS plain FROM pages""")
def plain_text(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", T.plain_text(F.col("html")).alias("plain"))
