"""Tables of contents: nested lists of links (EPUB 3 ``nav``) and navigation points (EPUB 2 ``ncx``) as rows.

The rule is a machine with a stack: the last entry of every open level. An opening tag goes a level deeper, a closing tag
forgets the levels below, a new item forgets the last entry of its own level, and a link's parent is the last entry of the level
above it. Here a window does what the stack does. A level is only read or written while it is open, and between its closing
and its next use it must be opened again; so it is enough that opening a level forgets that level. Then every tag writes one
slot at most, that of its level, and a parent is the last thing written to the slot above, whatever the depth.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import text as T
from ..plans.registry import query

#: The tags that count, in lists of links and in navigation points.
NAV_TAGS = r"""(?is)<ol\b|</ol\s*>|<li\b|<a\b[^>]*\bhref\s*=\s*["'][^"']+["'][^>]*>.*?</a>"""
NCX_TAGS = r"""(?is)<navpoint\b|</navpoint\s*>|<text\b[^>]*>.*?</text>|<content\b[^>]*\bsrc\s*=\s*["'][^"']+["']"""
NAV_LINK = r"""(?is)^<a\b[^>]*\bhref\s*=\s*["']([^"']+)["'][^>]*>(.*?)</a>$"""
NCX_TITLE = r"""(?is)^<text\b[^>]*>(.*?)</text>$"""
NCX_LINK = r"""(?is)^<content\b[^>]*\bsrc\s*=\s*["']([^"']+)["']$"""


def link_file(href: Column) -> Column:
    """The file that a link as it is written leads to: without folders and without the place inside the file."""
    path = T.percent_decode(F.substring_index(T.xml_unescape(href), "#", 1))
    return F.substring_index(path, "/", -1)


def link_title(raw: Column) -> Column:
    """A title without the tags inside, white space folded."""
    return T.xml_unescape(T.trim_all(F.regexp_replace(F.regexp_replace(raw, "(?s)<[^>]*>", ""), r"(?U:\s)+", " ")))


def toc(books: DataFrame, key: str = "page_id", kind: str = "kind", text: str = "contents") -> DataFrame:
    """(``key``, pos, file, title, level, first_pos, parent) of every link of a book's table of contents (``kind``: nav or ncx), in document
    order. ``first_pos`` is the first link of the same file, which alone is an entry and gets the others' children; ``parent``
    is the place of the entry above, null for a chapter."""
    ncx = F.col(kind) == "ncx"
    tags = books.select(F.col(key).alias("_key"), ncx.alias("_ncx"), F.posexplode(F.when(ncx, F.regexp_extract_all(text, F.lit(NCX_TAGS), F.lit(0))).otherwise(F.regexp_extract_all(text, F.lit(NAV_TAGS), F.lit(0)))).alias("pos", "tag"))
    begins = lambda names: F.col("tag").rlike(f"(?i)^<(?:{names})")
    tags = tags.select("_key", "_ncx", "tag", (F.col("pos") + 1).cast("long").alias("pos"), begins("ol|navpoint").alias("opens"), begins("/").alias("closes"), begins("li|navpoint").alias("item"), begins("a|content").alias("link"), begins("text").alias("titled"))
    so_far = W.partitionBy("_key").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    title = F.last(F.when(F.col("titled"), F.regexp_extract("tag", NCX_TITLE, 1)), ignorenulls=True).over(so_far)
    run = tags.withColumns({"sum": F.sum(F.when(F.col("opens"), 1).when(F.col("closes"), -1).otherwise(0)).over(so_far), "ncx_title": F.coalesce(title, F.lit(""))})
    # a closing tag with nothing open is passed over: the depth is the sum less the lowest sum so far
    run = run.withColumn("depth", F.col("sum") - F.least(F.min("sum").over(so_far), F.lit(0)))
    href = F.when(F.col("_ncx"), F.regexp_extract("tag", NCX_LINK, 1)).otherwise(F.regexp_extract("tag", NAV_LINK, 1))
    raw = F.when(F.col("_ncx"), F.col("ncx_title")).otherwise(F.regexp_extract("tag", NAV_LINK, 2))
    run = run.withColumns({"file": F.when(F.col("link"), link_file(href)), "title": F.when(F.col("link"), link_title(raw))})
    run = run.withColumn("link", F.col("link") & (F.col("file") != "") & (F.col("title") != "")).where("opens OR item OR link")
    run = run.withColumn("level", F.greatest("depth", F.lit(1)).cast("long"))
    run = run.withColumn("first_pos", F.when(F.col("link"), F.min(F.when(F.col("link"), F.col("pos"))).over(W.partitionBy("_key", "file"))))
    forgets = (F.col("item") & (F.col("depth") >= 1)) | (F.col("opens") & (F.col("depth") >= 2))
    put = F.struct(F.col("level").alias("slot"), F.lit(True).alias("put"))
    read = F.struct((F.col("level") - 1).alias("slot"), F.lit(False).alias("put"))
    uses = F.when(F.col("link"), F.array(read, put)).when(forgets, F.array(put))
    slots = run.select("_key", "pos", "file", "title", "level", "first_pos", F.explode(uses).alias("use")).select("*", "use.slot", "use.put")
    written = F.last(F.when(F.col("put"), F.struct("first_pos")), ignorenulls=True).over(W.partitionBy("_key", "slot").orderBy("pos").rowsBetween(W.unboundedPreceding, -1))
    found = slots.withColumn("parent", F.when(F.col("slot") > 0, written["first_pos"])).where("NOT put")
    return found.select(F.col("_key").alias(key), "pos", "file", "title", "level", "first_pos", "parent")


def entries(links: DataFrame) -> DataFrame:
    """The links that are entries: the first of each file."""
    return links.where(F.col("pos") == F.col("first_pos"))


#: The machine with its stack, tag by tag: DuckDB SQL for all queries below.
TOC_SQL = rf"""tags AS (SELECT page_id, ncx, i AS pos, t[i] AS tag, lower(t[i]) AS low FROM (SELECT *, unnest(range(1, len(t) + 1)) AS i FROM (SELECT page_id, kind = 'ncx' AS ncx,
 CASE WHEN kind = 'ncx' THEN regexp_extract_all(contents, '{NCX_TAGS.replace("'", "''")}') ELSE regexp_extract_all(contents, '{NAV_TAGS.replace("'", "''")}') END AS t FROM v_contents))),
what AS (SELECT *, starts_with(low, '<ol') OR starts_with(low, '<navpoint') AS opens, starts_with(low, '</') AS closes, starts_with(low, '<li') OR starts_with(low, '<navpoint') AS item,
 CASE WHEN starts_with(low, '<a') THEN regexp_extract(tag, '{NAV_LINK.replace("'", "''")}', 1) WHEN starts_with(low, '<content') THEN regexp_extract(tag, '{NCX_LINK.replace("'", "''")}', 1) END AS href,
 CASE WHEN starts_with(low, '<a') THEN regexp_extract(tag, '{NAV_LINK.replace("'", "''")}', 2) WHEN starts_with(low, '<content') THEN coalesce(last_value(CASE WHEN starts_with(low, '<text') THEN regexp_extract(tag, '{NCX_TITLE.replace("'", "''")}', 1) END IGNORE NULLS) OVER (PARTITION BY page_id ORDER BY pos), '') END AS raw FROM tags),
named AS (SELECT *, string_split(coalesce(url_decode(string_split(replace(replace(replace(replace(replace(href, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&apos;', chr(39)), '&amp;', '&'), '#')[1])), '/')[-1] AS file,
 replace(replace(replace(replace(replace(trim(regexp_replace(regexp_replace(raw, '(?s)<[^>]*>', '', 'g'), '\s+', ' ', 'g')), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&apos;', chr(39)), '&amp;', '&') AS title FROM what),
steps AS (SELECT page_id, pos, opens, closes, item, coalesce(href IS NOT NULL AND file <> '' AND title <> '', false) AS link, file, title, row_number() OVER (PARTITION BY page_id ORDER BY pos) AS n,
 min(CASE WHEN href IS NOT NULL AND file <> '' AND title <> '' THEN pos END) OVER (PARTITION BY page_id, file) AS first_pos FROM named),
machine AS (SELECT page_id, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS depth, []::BIGINT[] AS stack, CAST(NULL AS BIGINT) AS level, CAST(NULL AS BIGINT) AS parent FROM (SELECT DISTINCT page_id FROM steps)
 UNION ALL SELECT page_id, n, depth, CASE WHEN link THEN list_concat(list_resize(held, level - 1), [first_pos], list_slice(held, level + 1, len(held))) ELSE held END, CASE WHEN link THEN level END, CASE WHEN link AND level >= 2 THEN held[level - 1] END FROM
 (SELECT *, greatest(depth, 1) AS level, CASE WHEN closes THEN list_slice(stack, 1, greatest(depth, 1)) WHEN item AND depth >= 1 AND len(stack) >= depth THEN list_concat(list_slice(stack, 1, depth - 1), [NULL], list_slice(stack, depth + 1, len(stack))) ELSE stack END AS held FROM
 (SELECT s.page_id, s.n, s.closes, s.item, s.link, s.first_pos, m.stack, CASE WHEN s.opens THEN m.depth + 1 WHEN s.closes THEN greatest(m.depth - 1, 0) ELSE m.depth END AS depth FROM machine m JOIN steps s ON s.page_id = m.page_id AND s.n = m.n + 1))),
links AS (SELECT s.page_id, s.pos, s.file, s.title, m.level, s.first_pos, m.parent FROM steps s JOIN machine m ON m.page_id = s.page_id AND m.n = s.n WHERE s.link),
items AS (SELECT * FROM links WHERE pos = first_pos)"""


@query("extract_toc", "v_contents", sql=f"WITH RECURSIVE {TOC_SQL} SELECT page_id, pos, file, title FROM items")
def extract_toc(books: DataFrame) -> DataFrame:
    return entries(toc(books)).select("page_id", "pos", "file", "title")


@query("toc_levels", "v_contents", sql=f"WITH RECURSIVE {TOC_SQL} SELECT page_id, pos, level FROM items")
def toc_levels(books: DataFrame) -> DataFrame:
    return entries(toc(books)).select("page_id", "pos", "level")


@query("toc_dedupe", "v_contents", sql=f"WITH RECURSIVE {TOC_SQL} SELECT page_id, pos, file, first_pos FROM links")
def toc_dedupe(books: DataFrame) -> DataFrame:
    """The first entry of each file stands for all of them."""
    return toc(books).select("page_id", "pos", "file", "first_pos")


@query("toc_parent", "v_contents", sql=f"WITH RECURSIVE {TOC_SQL} SELECT page_id, pos, parent FROM items")
def toc_parent(books: DataFrame) -> DataFrame:
    return entries(toc(books)).select("page_id", "pos", "parent")


@query("toc_rows", "v_contents", sql=f"WITH RECURSIVE {TOC_SQL} SELECT page_id, pos, file, title, level, parent FROM items")
def toc_rows(books: DataFrame) -> DataFrame:
    """Whole rows of the tables of contents."""
    return entries(toc(books)).drop("first_pos")


@query("chapter_numbers", "v_contents", sql=f"WITH RECURSIVE {TOC_SQL} SELECT page_id, pos, CAST(sum(CASE WHEN parent IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY pos) - 1 AS BIGINT) AS chapter FROM items")
def chapter_numbers(books: DataFrame) -> DataFrame:
    """The number of entries without a parent up to this one, from 0."""
    top = F.sum(F.when(F.col("parent").isNull(), 1).otherwise(0)).over(W.partitionBy("page_id").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)) - 1
    return entries(toc(books)).select("page_id", "pos", top.alias("chapter"))
