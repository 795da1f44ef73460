"""Reads over entries: predicates, summaries, search, due reviews, triage views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import entries as E, text as T
from ..plans.registry import query

LIVE_SQL = "status IN ('pending','draft','reviewed')"
TERMINAL_SQL = "status IN ('skipped','revoked','archived')"


@query("display_text", "v_entries", sql="SELECT id, coalesce(text, draft0) AS display_text FROM v_entries")
def display_text(entries: DataFrame) -> DataFrame:
    return entries.select("id", E.display_text(F.col("text"), F.col("draft0")).alias("display_text"))


@query("is_live", "v_entries", sql=f"SELECT id, status FROM v_entries WHERE {LIVE_SQL}")
def live_entries(entries: DataFrame) -> DataFrame:
    return entries.where(E.is_live(F.col("status"))).select("id", "status")


@query("is_terminal", "v_entries", sql=f"SELECT id, status FROM v_entries WHERE {TERMINAL_SQL}")
def terminal_entries(entries: DataFrame) -> DataFrame:
    return entries.where(E.is_terminal(F.col("status"))).select("id", "status")


@query("needs_transcribe", "v_entries", sql="SELECT id FROM v_entries WHERE quote IS NOT NULL AND status NOT IN ('revoked','mined','skipped','archived') AND (draft0 IS NULL OR draft0 <> quote)")
def needs_transcribe(entries: DataFrame) -> DataFrame:
    """Entries whose ink no draft was made from; in the view, the quote stands for the ink and the draft for its hash."""
    hashes = F.when(F.col("draft0").isNotNull(), F.array("draft0")).otherwise(F.array().cast("array<string>"))
    return entries.where(E.needs_transcribe(F.col("status"), F.col("quote"), hashes)).select("id")


@query("reviewable", "v_entries", sql="SELECT id, book FROM v_entries WHERE status = 'reviewed' AND trim(text) <> ''")
def reviewable(entries: DataFrame) -> DataFrame:
    return entries.where(E.reviewable(F.col("status"), F.col("text"))).select("id", "book")


@query("wants_notebook", "v_entries", sql="SELECT id, destination FROM v_entries WHERE destination IN ('notebook','both')")
def for_notebook(entries: DataFrame) -> DataFrame:
    return entries.where(E.wants_notebook(F.col("destination"))).select("id", "destination")


@query("wants_obsidian", "v_entries", sql="SELECT id, destination FROM v_entries WHERE destination IN ('obsidian','both')")
def for_obsidian(entries: DataFrame) -> DataFrame:
    return entries.where(E.wants_obsidian(F.col("destination"))).select("id", "destination")


@query("entry_view", "v_entries", sql=f"SELECT id, book, status, destination, {LIVE_SQL} AS live FROM v_entries")
def entry_view(entries: DataFrame) -> DataFrame:
    return entries.select("id", "book", "status", "destination", E.is_live(F.col("status")).alias("live"))


@query("active_books", "v_books", "v_entries", sql="SELECT uuid, title FROM v_books WHERE uuid IN (SELECT book FROM v_entries WHERE status <> 'revoked')")
def active_books(books: DataFrame, entries: DataFrame) -> DataFrame:
    return books.join(entries.where("status <> 'revoked'").select(F.col("book").alias("uuid")), "uuid", "left_semi").select("uuid", "title")


@query("trash_view", "v_entries", sql=f"SELECT id, book, status, updated, coalesce(text, draft0, quote, '') AS shown FROM v_entries WHERE {TERMINAL_SQL} ORDER BY updated DESC, id")
def trash_view(entries: DataFrame) -> DataFrame:
    return entries.where(E.is_terminal(F.col("status"))).select("id", "book", "status", "updated", F.coalesce("text", "draft0", "quote", F.lit("")).alias("shown")).orderBy(F.desc("updated"), "id")


@query(
    "askable",
    "v_entries",
    sql=f"""SELECT id, CASE WHEN {TERMINAL_SQL} THEN 'terminal' WHEN destination <> 'both' THEN 'not asked' WHEN quote IS NULL OR trim(quote) = '' THEN 'no question' END AS reject_reason FROM v_entries""",
)
def askable(entries: DataFrame) -> DataFrame:
    """Why an entry can't be sent to the text model (null: it can); in the view, a quote stands for the question and the
    destination ``both`` for the wish to ask."""
    reason = F.when(E.is_terminal(F.col("status")), "terminal").when(F.col("destination") != "both", "not asked").when(F.coalesce(T.trim_all(F.col("quote")), F.lit("")) == "", "no question")
    return entries.select("id", reason.alias("reject_reason"))


@query(
    "book_briefs",
    "v_entries",
    sql=f"""SELECT book, CAST(count(DISTINCT chapter) AS BIGINT) AS chapters, CAST(sum(CASE WHEN status <> 'revoked' THEN 1 ELSE 0 END) AS BIGINT) AS entries,
 CAST(sum(CASE WHEN status = 'pending' THEN 1 ELSE 0 END) AS BIGINT) AS pending FROM v_entries GROUP BY book""",
)
def book_briefs(entries: DataFrame) -> DataFrame:
    return entries.groupBy("book").agg(F.count_distinct("chapter").alias("chapters"), F.count_if(F.col("status") != "revoked").alias("entries"), F.count_if(F.col("status") == "pending").alias("pending"))


@query(
    "status_summary",
    "v_entries",
    sql="SELECT book, " + ", ".join(f"CAST(count(*) FILTER (status = '{s}') AS BIGINT) AS {s}" for s in ("mined", "pending", "draft", "reviewed")) + " FROM v_entries GROUP BY book",
)
def status_summary(entries: DataFrame) -> DataFrame:
    states = ["mined", "pending", "draft", "reviewed"]
    return entries.groupBy("book").pivot("status", states).count().na.fill(0, states)


@query(
    "page_recency",
    "v_entries",
    sql="""SELECT id, book, page_index, page_updated, CAST(row_number() OVER (PARTITION BY book ORDER BY page_updated DESC, page_index, id) AS BIGINT) AS place FROM
 (SELECT id, book, page_index, max(updated) OVER (PARTITION BY book, page_index) AS page_updated FROM v_entries WHERE status = 'mined')""",
)
def page_recency(entries: DataFrame) -> DataFrame:
    """Mined entries by page, pages by their last change."""
    mined = entries.where("status = 'mined'")
    pages = mined.groupBy("book", "page_index").agg(F.max("updated").alias("page_updated"), F.count(F.lit(1)).alias("n"))
    return placed(mined, pages, ["book"], [F.desc("page_updated"), F.col("page_index")]).select("id", "book", "page_index", "page_updated", "place")


def placed(rows: DataFrame, pages: DataFrame, group: list[str], order: list[Column]) -> DataFrame:
    """``rows`` with their page's columns and ``place``: their number in the group, by the order of pages and then by id. Rows are
    ranked within their page; what comes before a page is a running sum over the group's pages (``n`` rows each), which are few."""
    before = F.coalesce(F.sum("n").over(W.partitionBy(*group).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    within = F.row_number().over(W.partitionBy(*group, "page_index").orderBy("id"))
    return rows.join(pages.withColumn("_before", before), [*group, "page_index"]).withColumn("place", (F.col("_before") + within).cast("long"))


@query(
    "due_reviews",
    "v_entries",
    "v_books",
    sql="""SELECT id, title, page_index, due, total FROM (SELECT e.id, b.title, e.page_index, e.updated + 86400 AS due, CAST(count(*) OVER () AS BIGINT) AS total
 FROM v_entries e JOIN v_books b ON e.book = b.uuid WHERE e.status = 'reviewed' AND trim(e.text) <> '' AND e.updated + 86400 <= 1708000000) ORDER BY due, title, page_index, id LIMIT 5""",
)
def due_reviews(entries: DataFrame, books: DataFrame, now: int = 1708000000, k: int = 5) -> DataFrame:
    """The first ``k`` due entries, and how many are due. The total is a scalar subquery, so the top k stays partial."""
    due = entries.where(E.reviewable(F.col("status"), F.col("text"))).withColumn("due", E.review_due(F.lit(None).cast("long"), F.col("updated"))).where(F.col("due") <= now)
    due = due.join(books.select(F.col("uuid").alias("book"), "title"), "book")
    top = due.orderBy("due", "title", "page_index", "id").limit(k)
    return top.select("id", "title", "page_index", "due", due.agg(F.count(F.lit(1))).scalar().alias("total"))


@query("review_due", "v_entries", sql="SELECT id, coalesce(CASE WHEN page_index % 2 = 0 THEN updated + page_index END, updated + 86400) AS due FROM v_entries")
def review_due(entries: DataFrame) -> DataFrame:
    return entries.select("id", E.review_due(F.when(F.col("page_index") % 2 == 0, F.col("updated") + F.col("page_index")), F.col("updated")).alias("due"))


@query(
    "review_advance",
    "v_entries",
    sql="""SELECT id, streak, interval_days, updated + interval_days * 86400 AS due FROM (SELECT id, updated, streak, CASE least(streak, 5) WHEN 0 THEN 1 WHEN 1 THEN 3 WHEN 2 THEN 7 WHEN 3 THEN 16 WHEN 4 THEN 35 ELSE 90 END AS interval_days
 FROM (SELECT id, updated, CAST(CASE WHEN id % 3 <> 0 THEN page_index % 8 + 1 ELSE 0 END AS BIGINT) AS streak FROM v_entries))""",
)
def review_advance(entries: DataFrame) -> DataFrame:
    """One review of each entry, remembered or not."""
    after = E.review_advance(F.col("page_index") % 8, F.col("id") % 3 != 0, F.col("updated"))
    return entries.select("id", after.alias("r")).select("id", "r.streak", "r.interval_days", "r.due")


#: The order in which a run takes entries; in the view, a run is a day, and a call fails for every fifth id and for all of every seventh day.
_RUN_SQL = """WITH todo AS (SELECT *, updated // 86400 AS run, attempts >= 3 AS exhausted FROM v_entries WHERE status IN ('pending','draft')),
placed AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY book, page_index, id) AS place, sum(CASE WHEN exhausted THEN 0 ELSE 1 END) OVER (PARTITION BY run ORDER BY book, page_index, id ROWS UNBOUNDED PRECEDING) AS n, id % 5 = 0 OR run % 7 = 0 AS fails FROM todo),
stops AS (SELECT run, max(place) AS stop FROM placed WHERE NOT exhausted AND n <= 3 GROUP BY run HAVING count(*) = 3 AND bool_and(fails)),
seen AS (SELECT p.*, CASE WHEN exhausted THEN 'skipped' WHEN n <= 20 THEN 'picked' ELSE 'left' END AS fate FROM placed p LEFT JOIN stops s ON p.run = s.run WHERE s.stop IS NULL OR p.place <= s.stop)"""


def runs(entries: DataFrame, limit: int = 20, most: int = 3) -> DataFrame:
    """What each run does with its entries (run, book, page_index, id, attempts, fails): in the order of books and pages, those that
    were tried ``most`` times are ``skipped``, ``limit`` are ``picked`` and the rest is ``left``. A run whose first three
    calls fail stops there; what comes after isn't seen.

    Only the first entries of a run are ranked in full (a top-k), the others are compared with the last one picked.
    """
    todo = entries.withColumns({"exhausted": F.col("attempts") >= most, "at": F.struct("book", "page_index", "id")})
    place = F.row_number().over(W.partitionBy("run").orderBy("at"))
    first = todo.where("NOT exhausted").withColumn("n", place).where(F.col("n") <= limit)
    early = F.col("n") <= 3
    ends = first.groupBy("run").agg(F.max("at").alias("last"), F.max(F.when(early, F.col("at"))).alias("third"), (F.count_if(early & F.col("fails")) == 3).alias("stops"))
    fate = F.when(F.col("exhausted"), "skipped").when(F.col("at") <= F.col("last"), "picked").otherwise("left")
    return todo.join(ends, "run", "left").where(~F.coalesce("stops", F.lit(False)) | (F.col("at") <= F.col("third"))).withColumn("fate", fate)


def runs_of_days(entries: DataFrame) -> DataFrame:
    run = F.floor(F.col("updated") / 86400)
    return runs(entries.where(F.col("status").isin("pending", "draft")).withColumns({"run": run, "fails": (F.col("id") % 5 == 0) | (run % 7 == 0)}))


@query("transcribe_batch", "v_entries", sql=f"{_RUN_SQL} SELECT run, id, book, fate FROM seen")
def transcribe_batch(entries: DataFrame) -> DataFrame:
    """What becomes of every entry that a run sees."""
    return runs_of_days(entries).select("run", "id", "book", "fate")


@query(
    "run_report",
    "v_entries",
    sql=f"""{_RUN_SQL} SELECT run, CAST(count(*) AS BIGINT) AS scanned, CAST(count(*) FILTER (fate = 'picked' AND NOT fails) AS BIGINT) AS done, CAST(count(*) FILTER (fate = 'picked' AND fails) AS BIGINT) AS failed, CAST(count(*) FILTER (fate = 'skipped') AS BIGINT) AS skipped,
 CAST(count(*) FILTER (fate = 'left') AS BIGINT) AS waiting, CAST(coalesce(sum(length(quote)) FILTER (fate = 'picked' AND NOT fails), 0) AS BIGINT) AS tokens FROM seen GROUP BY run""",
)
def run_report(entries: DataFrame) -> DataFrame:
    """One row a run; in the view, a quote's characters stand for the tokens of a call."""
    done = (F.col("fate") == "picked") & ~F.col("fails")
    count = lambda c, name: F.count_if(c).alias(name)
    return runs_of_days(entries).groupBy("run").agg(
        F.count(F.lit(1)).alias("scanned"), count(done, "done"), count((F.col("fate") == "picked") & F.col("fails"), "failed"), count(F.col("fate") == "skipped", "skipped"), count(F.col("fate") == "left", "waiting"), F.coalesce(F.sum(F.when(done, F.length("quote"))), F.lit(0)).cast("long").alias("tokens")
    )


@query(
    "report_changed",
    "v_entries",
    sql="""SELECT book, day, entries, pending FROM (SELECT *, lag(entries) OVER w AS e0, lag(pending) OVER w AS p0 FROM
 (SELECT book, updated // 86400 AS day, CAST(count(*) AS BIGINT) AS entries, CAST(count(*) FILTER (status = 'pending') AS BIGINT) AS pending FROM v_entries GROUP BY ALL) WINDOW w AS (PARTITION BY book ORDER BY day))
 WHERE pending > 0 OR entries IS DISTINCT FROM e0 OR pending IS DISTINCT FROM p0""",
)
def report_changed(entries: DataFrame) -> DataFrame:
    """Daily reports in which something happened, or that differ from the one before apart from the time."""
    daily = entries.groupBy("book", F.floor(F.col("updated") / 86400).alias("day")).agg(F.count(F.lit(1)).alias("entries"), F.count_if(F.col("status") == "pending").alias("pending"))
    now = F.struct("entries", "pending")
    before = F.lag(now).over(W.partitionBy("book").orderBy("day"))
    return daily.withColumn("before", before).where((F.col("pending") > 0) | ~F.col("before").eqNullSafe(now)).drop("before")


@query("failure_list", "v_usage_calls", sql="SELECT called, model, err FROM v_usage_calls WHERE NOT ok ORDER BY called DESC")
def failure_list(calls: DataFrame) -> DataFrame:
    return calls.where("NOT ok").select("called", "model", "err").orderBy(F.desc("called"))


@query("chapter_entries", "v_entries", sql="SELECT id, book, chapter, CAST(row_number() OVER (PARTITION BY book, chapter ORDER BY page_index, id) AS BIGINT) AS place FROM v_entries")
def chapter_entries(entries: DataFrame) -> DataFrame:
    """Entries without a chapter are a group of their own."""
    own = entries.withColumn("_chapter", F.coalesce("chapter", F.lit(-1)))
    pages = own.groupBy("book", "_chapter", "page_index").agg(F.count(F.lit(1)).alias("n"))
    return placed(own, pages, ["book", "_chapter"], [F.col("page_index")]).select("id", "book", "chapter", "place")


FIELDS = ("quote", "text", "draft", "question", "answer")


def _search_sql(q: str, limit: int = 50) -> str:
    each = " UNION ALL ".join(f"SELECT id, book, page_index, {n} AS ord, '{f}' AS field, {'CASE WHEN text IS NULL THEN draft0 END' if f == 'draft' else f} AS body FROM v_entries WHERE status <> 'revoked'" for n, f in enumerate(FIELDS))
    cut = f"concat(CASE WHEN pos > 31 THEN '…' ELSE '' END, replace(substring(body, greatest(pos - 30, 1), least(pos + {len(q) + 29}, length(body)) - greatest(pos - 30, 1) + 1), chr(10), ' '), CASE WHEN pos + {len(q) + 29} < length(body) THEN '…' ELSE '' END)"
    return f"""WITH f AS ({each}), h AS (SELECT *, instr(lower(body), '{q}') AS pos FROM f WHERE contains(lower(body), '{q}')),
one AS (SELECT h.*, title FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ord) AS rn FROM h) h JOIN v_books b ON h.book = b.uuid WHERE rn = 1),
titled AS (SELECT e.id, e.book, e.page_index, 'title' AS field, b.title AS body, instr(lower(b.title), '{q}') AS pos, b.title FROM (SELECT *, row_number() OVER (PARTITION BY book ORDER BY id) AS rn FROM v_entries WHERE status <> 'revoked') e JOIN v_books b ON e.book = b.uuid
 WHERE rn = 1 AND contains(lower(b.title), '{q}') AND e.book NOT IN (SELECT book FROM one))
SELECT id, title, page_index, field, {cut} AS snippet FROM (SELECT id, book, page_index, field, body, pos, title FROM one UNION ALL SELECT * FROM titled) ORDER BY title, book, id LIMIT {limit}"""


def found_entries(entries: DataFrame, books: DataFrame, q: str, limit: int = 50) -> DataFrame:
    """The first field of each entry that holds ``q`` in any case (quote, text, newest draft of an entry without text, question,
    answer), with what stands around it; a book's title hit on its first entry only if the book has no other. In the order of
    titles, ``limit`` at most (a feature). A blank ``q`` finds nothing."""
    q = q.strip().lower()
    live = entries.where("status <> 'revoked'").select("id", "book", "page_index", "quote", "text", F.when(F.col("text").isNull(), F.col("draft0")).alias("draft"), "question", "answer")
    at = {f: F.locate(q, F.lower(F.col(f))) for f in FIELDS}
    hit = F.coalesce(*[F.when(at[f] > 0, F.struct(F.lit(f).alias("field"), T.snippet(F.col(f), at[f], F.lit(len(q))).alias("snippet"))) for f in FIELDS])
    found = live.withColumn("hit", hit if q else F.lit(None).cast("struct<field:string,snippet:string>"))
    titled = found.join(books.select(F.col("uuid").alias("book"), "title"), "book")
    by_text = titled.where("hit IS NOT NULL").select("id", "book", "title", "page_index", "hit.field", "hit.snippet")
    in_title = F.locate(q, F.lower(F.col("title"))) if q else F.lit(0)
    matching = books.where(in_title > 0).select(F.col("uuid").alias("book"), "title")
    first = live.groupBy("book").agg(F.min(F.struct("id", "page_index")).alias("first")).join(matching, "book").join(by_text.select("book"), "book", "left_anti")
    by_title = first.select("first.id", "book", "title", "first.page_index", F.lit("title").alias("field"), T.snippet(F.col("title"), in_title, F.lit(len(q))).alias("snippet"))
    return by_text.unionByName(by_title).orderBy("title", "book", "id").limit(limit).drop("book")


@query("search_entries", "v_entries", "v_books", sql=_search_sql("tion"))
def search_entries(entries: DataFrame, books: DataFrame) -> DataFrame:
    return found_entries(entries, books, " Tion ")


@query("search_titles", "v_entries", "v_books", sql=_search_sql("src1"))
def search_titles(entries: DataFrame, books: DataFrame) -> DataFrame:
    """A search that only titles answer."""
    return found_entries(entries, books, "SRC1")


@query(
    "search_snippet",
    "documents",
    sql="""SELECT doc_id, concat(CASE WHEN pos > 31 THEN '…' ELSE '' END, replace(substring(text, greatest(pos - 30, 1), least(pos + 32, length(text)) - greatest(pos - 30, 1) + 1), chr(10), ' '), CASE WHEN pos + 32 < length(text) THEN '…' ELSE '' END) AS snippet
 FROM (SELECT doc_id, text, instr(lower(text), 'the') AS pos FROM documents) WHERE pos > 0""",
)
def search_snippet(docs: DataFrame, q: str = "the") -> DataFrame:
    """Every document that holds ``q``, with its first place."""
    at = F.locate(q, F.lower("text"))
    return docs.where(at > 0).select("doc_id", T.snippet(F.col("text"), at, F.lit(len(q))).alias("snippet"))
