"""Publishing: chapters as paragraphs and Markdown, fingerprints, plans of what to write."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import entries as E, text as T
from ..plans.registry import query

#: What stands for a text that isn't there yet; headings and marks of the outputs below are fixed as well.
PLACEHOLDER = "（待转写）"
#: What each style of an entry becomes: the paragraph's style on the device; in Markdown the mark before the text, whether
#: an anchor comes after it (one on a heading would be shown), and how far quote and answer below are indented.
FORMS = {
    "body": ("plain", "", True, ""),
    "bullet": ("bullet", "- ", True, "  "),
    "numbered": ("numbered", "1. ", True, "  "),
    "checkbox": ("checkbox", "- [ ] ", True, "  "),
    "heading1": ("subheading1", "## ", False, ""),
    "heading2": ("bold", "### ", False, ""),
}
REVIEW_HINT = "看完到网页「笔记 → 回顾」里逐条标记「记住了 / 再看看」。"


def form(style: Column, part: int) -> Column:
    """A part of an entry's form by its style; an unknown style is that of the body."""
    table = F.create_map(*[F.lit(x) for name, f in FORMS.items() for x in (name, f[part])])
    return F.coalesce(F.try_element_at(table, style), F.lit(FORMS["body"][part]))


def _form_sql(part: int) -> str:
    shown = lambda x: str(x).lower() if isinstance(x, bool) else f"'{x}'"
    return f"CASE style {' '.join(f"WHEN '{n}' THEN {shown(f[part])}" for n, f in FORMS.items())} ELSE {shown(FORMS['body'][part])} END"


def targeted(entries: DataFrame, target: str) -> DataFrame:
    """Live entries of chapters that go to ``notebook`` or ``obsidian``, with the text to show."""
    wants = {"notebook": E.wants_notebook, "obsidian": E.wants_obsidian}[target]
    live = entries.where(F.col("chapter").isNotNull() & E.is_live(F.col("status")) & wants(F.col("destination")))
    return live.withColumn("shown", E.display_text(F.col("text"), F.col("draft0")))


def in_page_order(*columns: str | Column) -> Column:
    """The structs of a chapter in page order, ties by id."""
    return F.array_sort(F.collect_list(F.struct("page_index", "id", *columns)))


def fingerprints(entries: DataFrame, target: str) -> DataFrame:
    """(book, chapter, fingerprint): a digest of the chapter's title and of all that is shown of its entries: id, place, style,
    section, text, quote and answer. Entries are digested one by one and their digests are summed, so that a chapter is
    never gathered; as each has its id and place, the sum tells their order, too."""
    empty = lambda c: F.coalesce(c, F.lit(""))
    line = F.concat_ws("|", F.col("page_index").cast("string"), F.col("id").cast("string"), F.initcap("style"), empty(T.trim_all(F.col("subhead"))), empty(F.col("shown")), empty(F.col("quote")), empty(F.col("answer")))
    part = lambda at: F.sum(F.conv(F.substring("digest", at, 15), 16, 10).cast("decimal(20,0)")).cast("string")
    found = targeted(entries, target).select("book", "chapter", F.sha2(line, 256).alias("digest")).groupBy("book", "chapter").agg(F.count(F.lit(1)).cast("string").alias("n"), part(1).alias("a"), part(16).alias("b"))
    title = F.concat(F.lit("Chapter "), F.col("chapter").cast("string"))
    return found.select("book", "chapter", F.sha2(F.concat_ws("\u0002", title, "n", "a", "b"), 256).alias("fingerprint"))


def _fp_sql(target: str) -> str:
    part = "CAST(sum(CAST('0x' || substring(digest, {at}, 15) AS HUGEINT)) AS VARCHAR)"
    return f"""(SELECT book, chapter, sha256(concat_ws(chr(2), 'Chapter ' || CAST(chapter AS VARCHAR), CAST(count(*) AS VARCHAR), {part.format(at=1)}, {part.format(at=16)})) AS fingerprint FROM
 (SELECT book, chapter, sha256(concat_ws('|', CAST(page_index AS VARCHAR), CAST(id AS VARCHAR), upper(style[1]) || style[2:], coalesce(trim(subhead), ''), coalesce(text, draft0, ''), coalesce(quote, ''), coalesce(answer, ''))) AS digest
 FROM v_entries WHERE chapter IS NOT NULL AND status IN ('pending','draft','reviewed') AND destination IN ('{target}','both')) GROUP BY book, chapter)"""


@query("chapter_fingerprint", "v_entries", sql=f"SELECT * FROM {_fp_sql('notebook')}")
def chapter_fingerprint(entries: DataFrame) -> DataFrame:
    return fingerprints(entries, "notebook")


@query("chapter_fingerprint_obsidian", "v_entries", sql=f"SELECT * FROM {_fp_sql('obsidian')}")
def chapter_fingerprint_obsidian(entries: DataFrame) -> DataFrame:
    return fingerprints(entries, "obsidian")


@query(
    "chapter_header",
    "v_entries",
    sql="""SELECT book, chapter, CASE WHEN min(page_index) = max(page_index) THEN CAST(min(page_index) + 1 AS VARCHAR) ELSE concat(CAST(min(page_index) + 1 AS VARCHAR), '–', CAST(max(page_index) + 1 AS VARCHAR)) END AS pages,
 CASE WHEN bool_and(status = 'reviewed') THEN 'reviewed' ELSE 'draft' END AS status FROM v_entries WHERE chapter IS NOT NULL AND status IN ('pending','draft','reviewed') AND destination IN ('obsidian','both') GROUP BY book, chapter""",
)
def chapter_header(entries: DataFrame) -> DataFrame:
    """The range of pages (from 1), and whether all is reviewed."""
    low, high = (f("page_index") + 1 for f in (F.min, F.max))
    pages = F.when(low == high, low.cast("string")).otherwise(F.concat_ws("–", low.cast("string"), high.cast("string")))
    return targeted(entries, "obsidian").groupBy("book", "chapter").agg(pages.alias("pages"), F.when(F.bool_and(F.col("status") == "reviewed"), "reviewed").otherwise("draft").alias("status"))


def published_of(prints: DataFrame) -> DataFrame:
    """Records made from fingerprints: even chapters are current, those one more than a multiple of 4 are stale."""
    return prints.where("chapter % 2 = 0 OR chapter % 4 = 1").select("book", "chapter", F.when(F.col("chapter") % 2 == 0, F.col("fingerprint")).otherwise("stale").alias("recorded"), (F.col("chapter") + 1704067200).alias("at"))


_PUBLISHED = "(SELECT book, chapter, CASE WHEN chapter % 2 = 0 THEN fingerprint ELSE 'stale' END AS recorded, chapter + 1704067200 AS made FROM fp WHERE chapter % 2 = 0 OR chapter % 4 = 1)"


def sync(prints: DataFrame, published: DataFrame) -> DataFrame:
    """Per chapter: whether there is something to publish, whether the last publication is current, and when it was."""
    both = prints.join(published, ["book", "chapter"], "full")
    return both.select("book", "chapter", F.col("fingerprint").isNotNull().alias("needed"), F.col("fingerprint").eqNullSafe(F.col("recorded")).alias("synced"), F.col("at").alias("made"))


@query("sync_status", "v_entries", sql=f"WITH fp AS {_fp_sql('notebook')} SELECT f.book, f.chapter, true AS needed, coalesce(f.fingerprint = p.recorded, false) AS synced, p.made FROM fp f LEFT JOIN {_PUBLISHED} p ON f.book = p.book AND f.chapter = p.chapter")
def sync_status(entries: DataFrame) -> DataFrame:
    prints = fingerprints(entries, "notebook")
    return sync(prints, published_of(prints))


def plan(prints: DataFrame, published: DataFrame, entries: DataFrame) -> DataFrame:
    """What to do with each chapter: generate, leave, or clear the record, which only happens when no live entry is left in
    the chapter at all, whatever its destination."""
    alive = entries.where(E.is_live(F.col("status")) & F.col("chapter").isNotNull()).select("book", "chapter").distinct().withColumn("alive", F.lit(True))
    found = prints.join(published, ["book", "chapter"], "full").join(alive, ["book", "chapter"], "left")
    action = F.when(F.col("fingerprint").isNotNull() & F.col("fingerprint").eqNullSafe(F.col("recorded")), "unchanged").when(F.col("fingerprint").isNotNull(), "generate").when(F.col("alive"), "empty").otherwise("clear")
    return found.select("book", "chapter", action.alias("action"))


@query(
    "publish_plan",
    "v_entries",
    sql=f"""WITH fp AS {_fp_sql('notebook')}, ob AS {_fp_sql('obsidian')}, pub AS (SELECT book, chapter, recorded FROM {_PUBLISHED} UNION ALL SELECT book, chapter, 'old' FROM ob WHERE (book, chapter) NOT IN (SELECT (book, chapter) FROM fp) UNION ALL SELECT book, 99, 'old' FROM (SELECT DISTINCT book FROM fp)),
alive AS (SELECT DISTINCT book, chapter FROM v_entries WHERE status IN ('pending','draft','reviewed') AND chapter IS NOT NULL)
SELECT coalesce(f.book, p.book) AS book, coalesce(f.chapter, p.chapter) AS chapter, CASE WHEN f.fingerprint IS NOT NULL AND f.fingerprint = p.recorded THEN 'unchanged' WHEN f.fingerprint IS NOT NULL THEN 'generate' WHEN a.book IS NOT NULL THEN 'empty' ELSE 'clear' END AS action
 FROM fp f FULL JOIN pub p ON f.book = p.book AND f.chapter = p.chapter LEFT JOIN alive a ON a.book = coalesce(f.book, p.book) AND a.chapter = coalesce(f.chapter, p.chapter)""",
)
def publish_plan(entries: DataFrame) -> DataFrame:
    """In the view there are also records of chapters that moved to the other target, and of a chapter that is gone."""
    prints, other = fingerprints(entries, "notebook"), fingerprints(entries, "obsidian")
    moved = other.join(prints, ["book", "chapter"], "left_anti").select("book", "chapter", F.lit("old").alias("recorded"))
    gone = prints.select("book", F.lit(99).cast("long").alias("chapter"), F.lit("old").alias("recorded")).distinct()
    return plan(prints, published_of(prints).drop("at").unionByName(moved).unionByName(gone), entries)


@query(
    "chapter_tabs",
    "v_entries",
    sql=f"""WITH fp AS {_fp_sql('notebook')} SELECT e.book, e.chapter, e.entries, p.recorded IS NOT NULL AS exported FROM (SELECT book, coalesce(chapter, -1) AS chapter, CAST(count(*) AS BIGINT) AS entries FROM v_entries WHERE status IN ('pending','draft','reviewed') GROUP BY 1, 2) e LEFT JOIN {_PUBLISHED} p ON e.book = p.book AND e.chapter = p.chapter ORDER BY e.book, e.chapter""",
)
def chapter_tabs(entries: DataFrame) -> DataFrame:
    """Chapters with live entries (none: -1), and whether they were ever exported."""
    tabs = entries.where(E.is_live(F.col("status"))).groupBy("book", F.coalesce("chapter", F.lit(-1)).alias("chapter")).agg(F.count(F.lit(1)).alias("entries"))
    made = published_of(fingerprints(entries, "notebook")).select("book", "chapter", F.lit(True).alias("made"))
    return tabs.join(made, ["book", "chapter"], "left").select("book", "chapter", "entries", F.col("made").isNotNull().alias("exported")).orderBy("book", "chapter")


def subheads(entries: DataFrame) -> DataFrame:
    """Entries of chapters with ``new_subhead``: the section's name where it differs from the last one of the chapter that wasn't
    empty. Names are compared within a page; what the pages before end with is carried on by a window over the pages."""
    page = ["book", "chapter", "page_index"]
    named = entries.withColumn("_name", F.when(T.trim_all(F.col("subhead")) != "", T.trim_all(F.col("subhead"))))
    last = lambda by, *order: F.last("_name", ignorenulls=True).over(W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, -1))
    ends = named.groupBy(*page).agg(F.max(F.when(F.col("_name").isNotNull(), F.struct("id", "_name")))["_name"].alias("_name"))
    carried = ends.select(*page, last(page[:2], "page_index").alias("_carried"))
    before = F.coalesce(last(page, "id"), F.col("_carried"))
    found = named.join(carried, page).withColumn("new_subhead", F.when(F.col("_name").isNotNull() & ~F.col("_name").eqNullSafe(before), F.col("_name")))
    return found.drop("_name", "_carried")


@query(
    "subhead_breaks",
    "v_entries",
    sql=f"""SELECT id, book, chapter, CASE WHEN s IS NOT NULL AND s IS DISTINCT FROM prev THEN s END AS new_subhead FROM (SELECT *, last_value(s IGNORE NULLS) OVER (PARTITION BY book, chapter ORDER BY page_index, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev
 FROM (SELECT *, subhead AS s FROM v_entries WHERE chapter IS NOT NULL))""",
)
def subhead_breaks(entries: DataFrame) -> DataFrame:
    return subheads(entries.where("chapter IS NOT NULL")).select("id", "book", "chapter", "new_subhead")


_TARGETED = f"(SELECT *, subhead AS s, coalesce(text, draft0) AS shown FROM v_entries WHERE chapter IS NOT NULL AND status IN ('pending','draft','reviewed') AND destination IN ('{{target}}','both'))"
_BROKEN = "(SELECT *, CASE WHEN s IS NOT NULL AND s IS DISTINCT FROM prev THEN s END AS new_subhead FROM (SELECT *, last_value(s IGNORE NULLS) OVER (PARTITION BY book, chapter ORDER BY page_index, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM {of}))"


@query(
    "project_chapter",
    "v_entries",
    sql=f"""WITH e AS {_BROKEN.format(of=_TARGETED.format(target="notebook"))}, rows_ AS (SELECT DISTINCT book, chapter, -1 AS page_index, -1 AS id, 0 AS rank, 'heading' AS style, concat('Chapter ', CAST(chapter AS VARCHAR)) AS text FROM e
 UNION ALL SELECT book, chapter, page_index, id, 1, 'subheading1', new_subhead FROM e WHERE new_subhead IS NOT NULL UNION ALL SELECT book, chapter, page_index, id, 2, {_form_sql(0)}, coalesce(shown, '{PLACEHOLDER}') FROM e
 UNION ALL SELECT book, chapter, page_index, id, 3, 'plain', concat('〔原文〕', quote) FROM e WHERE trim(quote) <> '' UNION ALL SELECT book, chapter, page_index, id, 4, 'plain', concat('〔AI〕', answer) FROM e WHERE trim(answer) <> '')
SELECT book, chapter, CAST(row_number() OVER (PARTITION BY book, chapter ORDER BY page_index, id, rank) AS BIGINT) AS seq, style, text FROM rows_""",
)
def project_chapter(entries: DataFrame) -> DataFrame:
    return paragraphs(entries)


def paragraphs(entries: DataFrame) -> DataFrame:
    """Rows of styled text: the chapter's title, then for each entry its section if that changed, its text in its style,
    its quote and the answer to its question."""
    live = subheads(targeted(entries, "notebook"))
    none = F.lit(None).cast("struct<rank:int,style:string,text:string>")
    row = lambda rank, style, text: F.struct(F.lit(rank).alias("rank"), F.lit(style).alias("style"), text.alias("text"))
    parts = F.array_compact(
        F.array(
            F.when(F.col("new_subhead").isNotNull(), row(1, "subheading1", F.col("new_subhead"))).otherwise(none),
            F.struct(F.lit(2).alias("rank"), form(F.col("style"), 0).alias("style"), F.coalesce("shown", F.lit(PLACEHOLDER)).alias("text")),
            F.when(T.trim_all(F.col("quote")) != "", row(3, "plain", F.concat(F.lit("〔原文〕"), F.col("quote")))).otherwise(none),
            F.when(T.trim_all(F.col("answer")) != "", row(4, "plain", F.concat(F.lit("〔AI〕"), F.col("answer")))).otherwise(none),
        )
    )
    body = live.select("book", "chapter", "page_index", "id", F.explode(parts).alias("p")).select("book", "chapter", "page_index", "id", "p.*")
    heads = live.select("book", "chapter").distinct().select("book", "chapter", F.lit(-1).cast("long").alias("page_index"), F.lit(-1).cast("long").alias("id"), F.lit(0).alias("rank"), F.lit("heading").alias("style"), F.concat(F.lit("Chapter "), F.col("chapter").cast("string")).alias("text"))
    seq = F.row_number().over(W.partitionBy("book", "chapter").orderBy("page_index", "id", "rank")).cast("long")
    return heads.unionByName(body).select("book", "chapter", seq.alias("seq"), "style", "text")


#: The Markdown of chapters: DuckDB SQL over v_entries and v_books.
EXPORT_SQL = f"""WITH e AS {_BROKEN.format(of=_TARGETED.format(target="obsidian"))}, m AS (SELECT book, chapter, min(page_index) + 1 AS lo, max(page_index) + 1 AS hi, bool_and(status = 'reviewed') AS done,
 string_agg(concat(CASE WHEN new_subhead IS NOT NULL THEN concat('## ', new_subhead, chr(10), chr(10)) ELSE '' END, {_form_sql(1)}, coalesce(shown, '{PLACEHOLDER}'), CASE WHEN {_form_sql(2)} THEN concat(' ^', CAST(id AS VARCHAR)) ELSE '' END, chr(10), CASE WHEN trim(quote) <> '' THEN concat({_form_sql(3)}, '> 「', quote, '」', chr(10)) ELSE '' END, CASE WHEN trim(answer) <> '' THEN concat({_form_sql(3)}, '> **AI**：', answer, chr(10)) ELSE '' END, chr(10)), '' ORDER BY page_index, id) AS body FROM e GROUP BY book, chapter)
SELECT m.book, m.chapter, concat('---', chr(10), 'book: "', replace(replace(b.title, chr(92), chr(92) || chr(92)), '"', chr(92) || '"'), '"', chr(10), CASE WHEN b.author <> '' THEN concat('author: "', replace(replace(b.author, chr(92), chr(92) || chr(92)), '"', chr(92) || '"'), '"', chr(10)) ELSE '' END,
 'chapter: "Chapter ', CAST(chapter AS VARCHAR), '"', chr(10), 'pages: "', CASE WHEN lo = hi THEN CAST(lo AS VARCHAR) ELSE concat(CAST(lo AS VARCHAR), '–', CAST(hi AS VARCHAR)) END, '"', chr(10), 'status: ', CASE WHEN done THEN 'reviewed' ELSE 'draft' END, chr(10), 'tags: [reading-notes]', chr(10), '---', chr(10), chr(10), '[[', b.title, ']]', chr(10), chr(10), body) AS md FROM m JOIN v_books b ON m.book = b.uuid"""


@query("export_chapter_md", "v_entries", "v_books", sql=EXPORT_SQL)
def export_chapter_md(entries: DataFrame, books: DataFrame) -> DataFrame:
    """A Markdown text for each chapter with something to export. A text is as large as the file that it becomes; ``chapter_files``
    has the same in pieces, for the sink."""
    pieces = chapter_files(entries, books).groupBy("book", "chapter").agg(in_page_order("piece").alias("pieces"))
    return pieces.select("book", "chapter", F.array_join(F.transform("pieces", lambda x: F.concat(x["piece"], F.lit("\n"))), "").alias("md"))


def chapter_files(entries: DataFrame, books: DataFrame) -> DataFrame:
    """(book, title, chapter, file, page_index, id, piece) of the chapters' files: front matter and link to the book (at -1),
    then entries with anchors, in the order of page and id; pieces are joined by line ends."""
    nl, style = F.lit("\n"), F.col("style")
    live = subheads(targeted(entries, "obsidian"))
    piece = F.concat(
        F.when(F.col("new_subhead").isNotNull(), F.concat(F.lit("## "), F.col("new_subhead"), F.lit("\n\n"))).otherwise(""),
        form(style, 1), F.coalesce("shown", F.lit(PLACEHOLDER)), F.when(form(style, 2), F.concat(F.lit(" ^"), F.col("id").cast("string"))).otherwise(""), nl,
        F.when(T.trim_all(F.col("quote")) != "", F.concat(form(style, 3), F.lit("> 「"), F.col("quote"), F.lit("」\n"))).otherwise(""),
        F.when(T.trim_all(F.col("answer")) != "", F.concat(form(style, 3), F.lit("> **AI**："), F.col("answer"), nl)).otherwise(""),
    )
    own = books.withColumnRenamed("uuid", "book")
    named = F.concat(F.lit("Chapter "), F.col("chapter").cast("string"))
    front = F.concat(
        F.lit("---\nbook: "), T.yaml_quote(F.col("title")), nl,
        F.when(F.col("author") != "", F.concat(F.lit("author: "), T.yaml_quote(F.col("author")), nl)).otherwise(""),
        F.lit("chapter: "), T.yaml_quote(named), F.lit("\npages: "), T.yaml_quote(F.col("pages")),
        F.lit("\nstatus: "), F.col("status"), F.lit("\ntags: [reading-notes]\n---\n\n[["), F.col("title"), F.lit("]]\n"),
    )
    before = F.lit(-1).cast("long")
    heads = chapter_header(entries).join(own, "book").select("book", "title", "chapter", before.alias("page_index"), before.alias("id"), front.alias("piece"))
    body = live.join(own.select("book", "title"), "book").select("book", "title", "chapter", "page_index", "id", piece.alias("piece"))
    return heads.unionByName(body).withColumn("file", T.safe_filename(T.chapter_stem(F.col("chapter"), named)))


@query(
    "export_index_md",
    "v_entries",
    "v_books",
    sql="""WITH c AS (SELECT DISTINCT book, chapter FROM v_entries WHERE chapter IS NOT NULL AND status IN ('pending','draft','reviewed') AND destination IN ('obsidian','both'))
SELECT b.uuid AS book, concat('---', chr(10), 'book: "', b.title, '"', chr(10), CASE WHEN b.author <> '' THEN concat('author: "', b.author, '"', chr(10)) ELSE '' END, 'tags: [reading-notes]', chr(10), '---', chr(10), chr(10), '# ', b.title, chr(10), chr(10),
 (SELECT string_agg(concat('- [[第', CAST(chapter + 1 AS VARCHAR), '章 Chapter ', CAST(chapter AS VARCHAR), ']]', chr(10)), '' ORDER BY chapter) FROM c WHERE c.book = b.uuid)) AS md FROM v_books b WHERE b.uuid IN (SELECT book FROM c)""",
)
def export_index_md(entries: DataFrame, books: DataFrame) -> DataFrame:
    """A list of the chapters with content for each book that has any."""
    stem = T.chapter_stem(F.col("chapter"), F.concat(F.lit("Chapter "), F.col("chapter").cast("string")))
    listed = targeted(entries, "obsidian").select("book", "chapter").distinct().groupBy("book").agg(F.array_sort(F.collect_list(F.struct("chapter", F.concat(F.lit("- [["), stem, F.lit("]]\n")).alias("line")))).alias("lines"))
    whole = listed.join(books.withColumnRenamed("uuid", "book"), "book")
    author = F.when(F.col("author") != "", F.concat(F.lit("author: "), T.yaml_quote(F.col("author")), F.lit("\n"))).otherwise("")
    md = F.concat(F.lit("---\nbook: "), T.yaml_quote(F.col("title")), F.lit("\n"), author, F.lit("tags: [reading-notes]\n---\n\n# "), F.col("title"), F.lit("\n\n"), F.array_join(F.transform("lines", lambda x: x["line"]), ""))
    return whole.select("book", md.alias("md"))


@query(
    "review_page",
    "v_entries",
    "v_books",
    sql=f"""WITH d AS (SELECT *, row_number() OVER (ORDER BY due, title, page_index, id) AS n FROM (SELECT e.*, b.title, e.updated + 86400 AS due FROM v_entries e JOIN v_books b ON e.book = b.uuid WHERE e.status = 'reviewed' AND trim(e.text) <> '' AND e.updated + 86400 <= 1708000000) QUALIFY n <= 5)
SELECT CAST(row_number() OVER (ORDER BY n, rank) AS BIGINT) AS seq, style, text FROM (SELECT 0 AS n, 0 AS rank, 'subheading1' AS style, '今日回顾' AS text UNION ALL SELECT n, 1, 'bold', title FROM d UNION ALL SELECT n, 2, {_form_sql(0)}, text FROM d UNION ALL SELECT n, 3, 'plain', concat('〔原文〕', quote) FROM d WHERE trim(quote) <> '' UNION ALL SELECT 99, 0, 'plain', '{REVIEW_HINT}')""",
)
def review_page(entries: DataFrame, books: DataFrame) -> DataFrame:
    """The page of today's reviews: a heading, then place, text in its style and quote of each due
    entry, and a hint. It has a few rows by design."""
    from .entries import due_reviews

    due = due_reviews(entries, books).join(entries.select("id", "text", "quote", F.col("style").alias("of_style")), "id")
    n = F.row_number().over(W.orderBy("due", "title", "page_index", "id"))
    row = lambda rank, style, text: F.struct(F.lit(rank).alias("rank"), F.lit(style).alias("style"), text.alias("text"))
    parts = F.filter(F.array(row(1, "bold", F.col("title")), F.struct(F.lit(2).alias("rank"), form(F.col("of_style"), 0).alias("style"), F.col("text").alias("text")), row(3, "plain", F.concat(F.lit("〔原文〕"), F.col("quote")))), lambda p: F.coalesce(T.trim_all(p["text"]) != "", F.lit(False)) & (p["text"] != "〔原文〕"))
    body = due.withColumn("n", n).select("n", F.explode(parts).alias("p")).select("n", "p.*")
    head = entries.sparkSession.createDataFrame([(0, 0, "subheading1", "今日回顾"), (99, 0, "plain", REVIEW_HINT)], "n int, rank int, style string, text string")
    return head.unionByName(body).select(F.row_number().over(W.orderBy("n", "rank")).cast("long").alias("seq"), "style", "text")
