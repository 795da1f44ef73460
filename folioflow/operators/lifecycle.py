"""The entry lifecycle: an ordered log of commands folded over each entry, and the merge of a new scan into stored entries."""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import entries as E, text as T
from ..plans.registry import query
from . import mining
from .texts import fnv_sql

MAX_DRAFTS = 10
STATE = "struct<status:string,text:string,style:string,drafts:array<struct<text:string,at:bigint>>,answer:string,question:string,destination:string,has_ink:boolean,quote:string,streak:int,due:bigint,updated:bigint,rejected:int>"


def _set(state: Column, **fields: Column) -> Column:
    for name, value in fields.items():
        state = state.withField(name, value)
    return state


def step(s: Column, c: Column) -> Column:
    """The state after one command (cmd, arg, at). A command that the state refuses only counts as rejected."""
    cmd, arg, at = c["cmd"], c["arg"], c["at"]
    terminal, drafts = E.is_terminal(s["status"]), F.size(s["drafts"]) > 0
    text, rejected = s["text"], _set(s, rejected=s["rejected"] + 1)
    target = F.when(cmd == "request", "pending").when(cmd == "skip", "skipped").otherwise("archived")
    takes_quote = (cmd == "request") & text.isNull() & ~s["has_ink"] & s["quote"].isNotNull()
    landed = F.when((cmd == "request") & (text.isNotNull() | takes_quote), "reviewed").when((cmd == "request") & s["has_ink"] & drafts, "draft").otherwise(target)
    triaged = _set(s, text=F.when(takes_quote, s["quote"]).otherwise(text), updated=F.when(s["status"] != landed, at).otherwise(s["updated"]), status=landed)
    marked = T.leading_marker(F.coalesce(arg, F.lit("")))
    style = F.coalesce(marked["style"], s["style"])
    drafted = _set(
        s,
        style=F.when(text.isNull(), style).otherwise(s["style"]),
        status=F.when(text.isNull(), "draft").otherwise(s["status"]),
        drafts=F.slice(F.concat(F.array(F.struct(marked["text"].alias("text"), at.alias("at"))), s["drafts"]), 1, MAX_DRAFTS),
        updated=at,
    )
    clean = T.trim_all(marked["text"])
    edited = _set(s, style=style, text=F.when(clean != "", clean), status=F.when(clean != "", "reviewed").when(drafts, "draft").otherwise("pending"), updated=at)
    settled = F.when(text.isNotNull(), "reviewed").when(drafts, "draft")
    restored = _set(s, status=F.when(s["status"] == "skipped", "mined").otherwise(F.coalesce(settled, F.when(s["has_ink"], "pending").otherwise("mined"))), updated=at)
    revived = _set(s, status=F.coalesce(settled, F.lit("mined")), updated=at)
    after = E.review_advance(s["streak"], cmd == "remembered", at)
    reviewed = _set(s, streak=after["streak"].cast("int"), due=after["due"])
    return (
        F.when(cmd.isin("request", "skip", "archive"), F.when(terminal, F.when(s["status"] == target, s).otherwise(rejected)).otherwise(triaged))
        .when(cmd == "restore", F.when(terminal, restored).otherwise(rejected))
        .when(cmd == "revoke", F.when(terminal, s).otherwise(_set(s, status=F.lit("revoked"), updated=at)))
        .when(cmd == "revive", F.when(s["status"] == "revoked", revived).otherwise(s))
        .when(terminal, rejected)
        .when(cmd == "draft", drafted)
        .when(cmd == "edit", edited)
        .when(cmd == "answer", _set(s, answer=arg, updated=at))
        .when(cmd == "ask", _set(s, question=F.when(T.trim_all(F.coalesce(arg, F.lit(""))) != "", arg), updated=at))
        .when(cmd == "destination", _set(s, destination=arg, updated=at))
        .when(cmd.isin("remembered", "again"), F.when(E.reviewable(s["status"], text), reviewed).otherwise(rejected))
        .otherwise(rejected)
    )


def apply_commands(entries: DataFrame, commands: DataFrame) -> DataFrame:
    """Entries (id, and a column ``state``) after their commands (id, seq, cmd, arg, at), in the order of ``seq``.

    The fold is one expression. Commands of an entry meet in one row: what a user does to one note, not a corpus.
    """
    listed = commands.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("seq", "cmd", "arg", "at"))).alias("commands"))
    held = entries.join(listed, "id", "left").withColumn("commands", F.coalesce("commands", F.array().cast("array<struct<seq:bigint,cmd:string,arg:string,at:bigint>>")))
    return held.withColumn("state", F.aggregate("commands", F.col("state").cast(STATE), lambda s, c: step(s, c).cast(STATE))).drop("commands")


def state_of(entries: DataFrame) -> DataFrame:
    """(id, state) of the view of entries; every second one has ink."""
    none = lambda kind: F.lit(None).cast(kind)
    drafts = F.when(F.col("draft0").isNotNull(), F.array(F.struct(F.col("draft0").alias("text"), F.col("updated").alias("at")))).otherwise(F.array().cast("array<struct<text:string,at:bigint>>"))
    state = F.struct(
        F.col("status"), F.col("text"), F.lit("body").alias("style"), drafts.alias("drafts"), none("string").alias("answer"), none("string").alias("question"), F.col("destination"), (F.col("id") % 2 == 0).alias("has_ink"),
        F.col("quote"), F.lit(0).alias("streak"), none("bigint").alias("due"), F.col("updated"), F.lit(0).alias("rejected"),
    )
    return entries.select("id", state.cast(STATE).alias("state"))


#: The fold command by command: DuckDB SQL over v_commands.
COMMANDS_SQL = """WITH RECURSIVE c AS (SELECT entry, cmd, seq, row_number() OVER (PARTITION BY entry ORDER BY seq) AS n FROM v_commands),
r AS (SELECT id, CAST(0 AS BIGINT) AS n, status, text, CAST(CASE WHEN draft0 IS NULL THEN 0 ELSE 1 END AS BIGINT) AS drafts, quote, updated, CAST(0 AS BIGINT) AS rejected FROM v_entries
 UNION ALL SELECT r.id, r.n + 1, CASE WHEN c.cmd IN ('request','skip','archive') THEN CASE WHEN r.status IN ('skipped','revoked','archived') THEN r.status WHEN c.cmd = 'skip' THEN 'skipped' WHEN c.cmd = 'archive' THEN 'archived'
  WHEN r.text IS NOT NULL OR (r.id % 2 = 1 AND r.quote IS NOT NULL) THEN 'reviewed' WHEN r.id % 2 = 0 AND r.drafts > 0 THEN 'draft' ELSE 'pending' END
  WHEN c.cmd = 'restore' THEN CASE WHEN r.status NOT IN ('skipped','revoked','archived') THEN r.status WHEN r.status = 'skipped' THEN 'mined' WHEN r.text IS NOT NULL THEN 'reviewed' WHEN r.drafts > 0 THEN 'draft' WHEN r.id % 2 = 0 THEN 'pending' ELSE 'mined' END
  ELSE CASE WHEN r.status IN ('skipped','revoked','archived') OR r.text IS NOT NULL THEN r.status ELSE 'draft' END END,
 CASE WHEN c.cmd = 'request' AND r.status NOT IN ('skipped','revoked','archived') AND r.text IS NULL AND r.id % 2 = 1 THEN r.quote ELSE r.text END,
 CASE WHEN c.cmd = 'draft' AND r.status NOT IN ('skipped','revoked','archived') THEN least(r.drafts + 1, 10) ELSE r.drafts END, r.quote,
 CASE WHEN c.cmd = 'restore' THEN CASE WHEN r.status IN ('skipped','revoked','archived') THEN 1704067200 + c.seq ELSE r.updated END WHEN r.status IN ('skipped','revoked','archived') THEN r.updated WHEN c.cmd = 'draft' THEN 1704067200 + c.seq
  WHEN r.status <> CASE WHEN c.cmd = 'skip' THEN 'skipped' WHEN c.cmd = 'archive' THEN 'archived' WHEN r.text IS NOT NULL OR (r.id % 2 = 1 AND r.quote IS NOT NULL) THEN 'reviewed' WHEN r.id % 2 = 0 AND r.drafts > 0 THEN 'draft' ELSE 'pending' END THEN 1704067200 + c.seq ELSE r.updated END,
 r.rejected + CASE WHEN c.cmd = 'restore' THEN CASE WHEN r.status IN ('skipped','revoked','archived') THEN 0 ELSE 1 END WHEN r.status IN ('skipped','revoked','archived') AND r.status <> CASE c.cmd WHEN 'skip' THEN 'skipped' WHEN 'archive' THEN 'archived' ELSE '' END THEN 1 ELSE 0 END
 FROM r JOIN c ON c.entry = r.id AND c.n = r.n + 1)
SELECT id, status, text, drafts, updated, rejected FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY n DESC) AS last FROM r) WHERE last = 1"""


@query("apply_commands", "v_entries", "v_commands", sql=COMMANDS_SQL)
def commands_applied(entries: DataFrame, commands: DataFrame) -> DataFrame:
    log = commands.select(F.col("entry").alias("id"), "seq", "cmd", F.concat(F.lit("draft "), F.col("seq").cast("string")).alias("arg"), (F.col("seq") + 1704067200).alias("at"))
    s = F.col("state")
    return apply_commands(state_of(entries), log).select("id", s["status"].alias("status"), s["text"].alias("text"), F.size(s["drafts"]).cast("long").alias("drafts"), s["updated"].alias("updated"), s["rejected"].cast("long").alias("rejected"))


def purge(entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What stays, and how many of each book are deleted for good."""
    terminal = E.is_terminal(F.col("status"))
    return entries.where(~terminal), entries.where(terminal).groupBy("book").agg(F.count(F.lit(1)).alias("purged"))


@query("purge", "v_entries", sql="SELECT book, CAST(count(*) AS BIGINT) AS purged FROM v_entries WHERE status IN ('skipped','revoked','archived') GROUP BY book")
def purged(entries: DataFrame) -> DataFrame:
    return purge(entries)[1]


@query("refresh_context", "v_entries", sql="SELECT id, CASE WHEN id % 3 = 0 THEN chapter ELSE coalesce(page_index % 12, chapter) END AS chapter FROM v_entries")
def refreshed(entries: DataFrame) -> DataFrame:
    """Chapters from a new table of contents, which every third entry's page isn't in."""
    found = entries.select("id", F.when(F.col("id") % 3 != 0, F.col("page_index") % 12).alias("new_chapter"))
    return refresh_context(entries, found).select("id", "chapter")


def refresh_context(entries: DataFrame, found: DataFrame) -> DataFrame:
    """Entries with the chapters that were found (id, new_chapter); one that wasn't found never clears what is there."""
    return entries.join(found, "id", "left").withColumn("chapter", F.coalesce("new_chapter", "chapter")).drop("new_chapter")


def _missing(x) -> bool:
    return x is None or x != x


class PageClaims:
    """The claims of one page. Drafts choose in their order, each by the best rule that finds an entry no draft before took:
    the same ink, ink that shares a stroke, the same quote that gained or lost its ink, and last the same two among revoked
    entries. An entry that nothing claims is revoked unless it is settled.

    Entries are added in their order and wait in a queue for each thing that a rule asks for, so a draft sees the heads of its
    queues and not the whole page."""

    def __init__(self):
        self.stored: list[tuple] = []  # (id, ink_hash, whether it is revoked if nothing claims it)
        self.free: list[bool] = []
        self.queues: dict[tuple, deque[int]] = {}

    def add(self, id, status, ink_hash, strokes, quote_id) -> None:
        revoked, bare, quoted = status == "revoked", _missing(ink_hash), not _missing(quote_id)
        wanted = []
        if not bare:
            wanted += [(revoked, "ink", ink_hash), *((revoked, "stroke", s) for s in (set() if strokes is None else set(strokes)))]
        elif quoted:
            wanted.append((revoked, "quote", quote_id))
        if quoted and status not in E.TERMINAL:
            wanted.append((bare, "turned", quote_id))
        for w in wanted:
            self.queues.setdefault(w, deque()).append(len(self.stored))
        self.stored.append((id, ink_hash, status not in E.TERMINAL and (quoted or not bare)))
        self.free.append(True)

    def _first(self, wanted) -> int | None:
        """The first entry that is free of those that wait for any of the things."""
        found = None
        for w in wanted:
            queue = self.queues.get(w)
            while queue and not self.free[queue[0]]:
                queue.popleft()
            if queue and (found is None or queue[0] < found):
                found = queue[0]
        return found

    def choose(self, ink_hash, strokes, quote_id) -> tuple[int | None, str]:
        """The place of the entry that the next draft takes, and the outcome."""
        if not self.stored:
            return None, "added"
        inked, quoted, strokes = not _missing(ink_hash), not _missing(quote_id), () if strokes is None else strokes
        for revoked in (False, True):
            n = self._first([(revoked, "ink", ink_hash)]) if inked else self._first([(revoked, "quote", quote_id)]) if quoted else None
            if n is None and inked:
                n = self._first((revoked, "stroke", s) for s in strokes)
            if n is None and not revoked and quoted:
                n = self._first([(inked, "turned", quote_id)])
            if n is not None:
                self.free[n] = False
                had = self.stored[n][1]
                same = had == ink_hash or (not inked and _missing(had))
                return n, "revived" if revoked else "unchanged" if same else "changed"
        return None, "added"

    def claim(self, ink_hash, strokes, quote_id) -> tuple:
        """(id, outcome) of the next draft."""
        n, outcome = self.choose(ink_hash, strokes, quote_id)
        return None if n is None else self.stored[n][0], outcome

    def lost(self) -> list[int]:
        """The places of the entries that are revoked once all drafts of the page have chosen."""
        return [n for n, (free, (_, _, unsettled)) in enumerate(zip(self.free, self.stored)) if free and unsettled]

    def left(self) -> list:
        """Their ids."""
        return [self.stored[n][0] for n in self.lost()]


def claim_page(drafts: pd.DataFrame, entries: pd.DataFrame) -> pd.DataFrame:
    """The claims of one page from tables in memory."""
    claims, rows = PageClaims(), []
    for e in entries.sort_values("seq").itertuples():
        claims.add(e.id, e.status, e.ink_hash, e.strokes, e.quote_id)
    for d in drafts.sort_values("pos").itertuples():
        rows.append((d.book, d.page, d.pos, *claims.claim(d.ink_hash, d.strokes, d.quote_id)))
    rows += [(entries["book"].iloc[0], entries["page"].iloc[0], None, id, "revoked") for id in claims.left()]
    return pd.DataFrame(rows, columns=["book", "page", "pos", "id", "outcome"]).astype({"pos": "Int64"})


def _values(column: pa.Array) -> list:
    """A column as Python values. Texts go by numpy, and those of lists all at once, as one by one takes most of a merge's time."""
    if pa.types.is_list(column.type):
        ends = pc.cumulative_sum(column.value_lengths().fill_null(0)).to_pylist()
        inner = _values(column.flatten())
        lists = [inner[a:b] for a, b in zip([0, *ends], ends)]
        return [x if there else None for x, there in zip(lists, column.is_valid().to_pylist())] if column.null_count else lists
    return column.to_numpy(zero_copy_only=False).tolist() if pa.types.is_string(column.type) else column.to_pylist()


def claim_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The claims of pages that come one after another, the entries of each before its drafts. A page without drafts wasn't scanned."""
    claims, key, asked, schema = PageClaims(), None, False, None
    ended = lambda: [(*key, None, id, "revoked") for id in claims.left()] if asked else []
    table = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
    for batch in batches:
        kinds = {f.name: f.type for f in batch.schema}
        schema = pa.schema([("book", kinds["book"]), ("page", kinds["page"]), ("pos", pa.int64()), ("id", kinds["id"]), ("outcome", pa.string())])
        rows = []
        for book, page, draft, at, id, status, ink_hash, strokes, quote_id in zip(*map(_values, batch.columns)):
            if key != (book, page):
                rows += ended()
                claims, key, asked = PageClaims(), (book, page), False
            if draft:
                asked = True
                rows.append((book, page, at, *claims.claim(ink_hash, strokes, quote_id)))
            else:
                claims.add(id, status, ink_hash, strokes, quote_id)
        if rows:
            yield table(rows)
    if rows := ended():
        yield table(rows)


def fnv64_of(texts: list[str]) -> list[str]:
    """``fnv64`` of the texts that a task has in memory: byte by byte, for all at once that are long enough."""
    data = [t.encode() for t in texts]
    sizes = np.fromiter(map(len, data), np.int64, len(data))
    longest = np.argsort(-sizes, kind="stable")
    whole, starts, sizes = np.frombuffer(b"".join(data) or b"\0", np.uint8), (np.cumsum(sizes) - sizes)[longest], sizes[longest]
    state = np.full(len(data), 0xCBF29CE484222325, np.uint64)
    for i in range(sizes[0] if data else 0):
        n = np.searchsorted(-sizes, -i)  # so many have more than i bytes
        state[:n] = (state[:n] ^ whole[starts[:n] + i]) * np.uint64(0x100000001B3)
    out = np.empty_like(state)
    out[longest] = state
    return [f"{x:016x}" for x in out.tolist()]


MERGED = ("book", "page", "id", "seq", "status", "ink_hash", "strokes", "quote_id")


def merged_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The entries that the drafts of their pages add or change, from rows as ``claim_rows`` has them and the text of their place.

    An added one has an id as ``new_ids`` makes it."""
    claims, entries, seeds, key, asked, schema = PageClaims(), [], {}, None, False, None
    revoked = lambda: [(*key, e[0], e[1], "revoked", *e[3:]) for e in map(entries.__getitem__, claims.lost())] if asked else []
    table = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
    joined = lambda by, *parts: by.join(x for x in parts if x is not None)
    for batch in batches:
        kinds = {f.name: f.type for f in batch.schema} | {"seq": pa.int64()}
        schema = pa.schema([(c, kinds[c]) for c in MERGED])
        rows, added, texts = [], [], []
        for book, page, draft, at, id, status, ink_hash, strokes, quote_id, place in zip(*map(_values, batch.columns)):
            if key != (book, page):
                rows += revoked()
                claims, entries, seeds, key, asked = PageClaims(), [], {}, (book, page), False
            if not draft:
                claims.add(id, status, ink_hash, strokes, quote_id)
                entries.append((id, at, status, ink_hash, strokes, quote_id))
                continue
            asked = True
            n, outcome = claims.choose(ink_hash, strokes, quote_id)
            if n is None:
                seed = quote_id if ink_hash is None else ink_hash
                again = seeds[seed] = seeds.get(seed, -1) + 1
                added.append(len(rows))
                texts.append(joined("/", place, joined("#", seed, str(again)) if again else seed))
                rows.append((book, page, None, at, "mined", ink_hash, strokes, quote_id))
            elif outcome != "unchanged":
                id, seq, status = entries[n][:3]
                rows.append((book, page, id, seq, "mined" if outcome == "revived" else status, ink_hash, strokes, quote_id))
        for i, id in zip(added, fnv64_of(texts)):
            rows[i] = (*rows[i][:2], id, *rows[i][3:])
        if rows:
            yield table(rows)
    if rows := revoked():
        yield table(rows)


def ink_hash(strokes: Column) -> Column:
    return F.sha2(F.array_join(strokes, ";"), 256)


def by_page(drafts: DataFrame, entries: DataFrame) -> DataFrame:
    """Both tables as the rows of ``claim_rows``: in one shuffle to their pages, and in order there. Drafts that lack their
    ``ink_hash`` get it where they landed, as hashes take most of the room of a shuffle, and of entries that have a ``_version``
    the latest of each id is chosen there."""
    kinds = {f.name: f.dataType.simpleString() for f in entries.schema.fields}
    none = lambda c: F.lit(None).cast(kinds[c]).alias(c)
    own = [F.col(c).cast(kinds[c]).alias(c) if c in drafts.columns else none(c) for c in ("ink_hash", "strokes", "quote_id")]
    place = [F.col(c).cast(kinds[c]).alias(c) for c in ("book", "page")]
    versions = [c for c in entries.columns if c == "_version"]
    asked = drafts.select(*place, F.lit(True).alias("draft"), F.col("pos").cast("long").alias("at"), none("id"), none("status"), *own, *map(none, versions))
    held = entries.select("book", "page", F.lit(False).alias("draft"), F.col("seq").cast("long").alias("at"), "id", "status", "ink_hash", "strokes", "quote_id", *versions)
    rows = held.union(asked).where("book IS NOT NULL AND page IS NOT NULL").repartition("book", "page")
    if versions:
        newer = F.row_number().over(W.partitionBy("book", "page", "draft", "id").orderBy(F.desc("_version")))
        rows = rows.withColumn("_newer", newer).where("draft OR _newer = 1").drop("_newer", "_version")
    if "ink_hash" not in drafts.columns:
        rows = rows.withColumn("ink_hash", F.when(F.col("draft"), ink_hash(F.col("strokes"))).otherwise(F.col("ink_hash")))
    return rows.sortWithinPartitions("book", "page", "draft", F.asc_nulls_last("at"), "id", "ink_hash")


def merge_claim(drafts: DataFrame, entries: DataFrame) -> DataFrame:
    """(book, page, pos, id, outcome) for drafts (book, page, pos, ink_hash, strokes, quote_id) of scanned pages against the
    stored entries (book, page, seq, id, status, ink_hash, strokes, quote_id).

    The rule is sequential within a page; pages are small and many. Both tables go to their pages in one shuffle and stream by
    in order, so a task holds the entries of one page, and its time is that of its rows.
    """
    kinds = {f.name: f.dataType.simpleString() for f in entries.schema.fields}
    schema = f"book {kinds['book']}, page {kinds['page']}, pos bigint, id {kinds['id']}, outcome string"
    return by_page(drafts, entries).mapInArrow(claim_rows, schema)


def merge_entries(drafts: DataFrame, entries: DataFrame) -> DataFrame:
    """The entries (``MERGED``) that a scan adds or changes: what ``merge_claim`` decides, in the same pass. Added and changed
    ones take the draft's ink and quote, revived ones are mined again, and revoked ones keep what they had. Unchanged entries
    aren't among them."""
    kinds = {f.name: f.dataType.simpleString() for f in entries.schema.fields} | {"seq": "bigint"}
    rows = by_page(drafts, entries).withColumn("place", F.concat_ws("/", F.col("book").cast("string"), F.col("page").cast("string")))
    return rows.mapInArrow(merged_rows, ", ".join(f"{c} {kinds[c]}" for c in MERGED))


def new_ids(claims: DataFrame, seeds: DataFrame) -> DataFrame:
    """Ids for added drafts (book, page, pos, seed): a hash of book, page and seed; further ones of a book that come to the
    same id are numbered."""
    added = claims.where("outcome = 'added'").join(seeds, ["book", "page", "pos"])
    n = F.row_number().over(W.partitionBy("book", "page", "seed").orderBy("pos")) - 1
    seed = F.when(F.col("n") > 0, F.concat_ws("#", "seed", F.col("n").cast("string"))).otherwise(F.col("seed"))
    return added.withColumn("n", n).select("book", "page", "pos", T.fnv64(F.concat_ws("/", F.col("book").cast("string"), F.col("page").cast("string"), seed)).alias("id"))


@query(
    "entry_id",
    "v_entries",
    sql=f"""SELECT book, page, pos, {fnv_sql("concat_ws('/', book, CAST(page AS VARCHAR), CASE WHEN n > 0 THEN concat(seed, '#', CAST(n AS VARCHAR)) ELSE seed END)")} AS id FROM (SELECT *, row_number() OVER (PARTITION BY book, page, seed ORDER BY pos) - 1 AS n FROM (SELECT book, page_index % 5 AS page, id AS pos, CAST(id % 3 AS VARCHAR) AS seed FROM v_entries))""",
)
def entry_ids(entries: DataFrame) -> DataFrame:
    """Every entry of the view as a new draft; many have a seed in common with others of their page."""
    drafts = entries.select("book", (F.col("page_index") % 5).alias("page"), F.col("id").alias("pos"), (F.col("id") % 3).cast("string").alias("seed"))
    return new_ids(drafts.drop("seed").withColumn("outcome", F.lit("added")), drafts)


def inked_drafts(strokes: DataFrame) -> DataFrame:
    """(page, cluster, ink_hash, strokes) of each cluster, and its box."""
    box = [f(c).alias(c) for f, c in ((F.min, "x0"), (F.min, "y0"), (F.max, "x1"), (F.max, "y1"))]
    found = mining.labelled(strokes).groupBy("page", "cluster").agg(F.array_sort(F.collect_list("stroke_no")).cast("array<string>").alias("strokes"), *box)
    return found.select("page", "cluster", ink_hash(F.col("strokes")).alias("ink_hash"), "strokes", "x0", "y0", "x1", "y1")


#: The clusters of all strokes, and again those of an earlier scan without every fifth stroke. Each of these lies in one of those,
#: so a draft's claim is a choice among its own parts: not revoked before revoked, the same strokes before fewer, then the order.
_EARLIER = re.sub(r"\b(ink|edges|both_ways|reach|label|clusters)\b", r"\1_", mining.REACH_SQL.split("WITH RECURSIVE ", 1)[1]).replace("FROM v_strokes WHERE", "FROM v_strokes WHERE stroke_no % 5 <> 0 AND")
_CLAIM_SQL = f"""{mining.REACH_SQL}, {_EARLIER},
parts AS (SELECT DISTINCT i.page, l.cluster AS draft, e.cluster AS stored FROM ink i JOIN label l USING (stroke_no) JOIN label_ e USING (stroke_no)),
ranked AS (SELECT p.*, s.strokes = d.strokes AS same, stored % 4 AS state, row_number() OVER (PARTITION BY draft ORDER BY stored % 4 = 3, s.strokes <> d.strokes, stored) AS n FROM parts p JOIN clusters d ON p.draft = d.cluster JOIN clusters_ s ON p.stored = s.cluster),
claims AS (SELECT c.page, c.cluster AS pos, CAST(r.stored AS VARCHAR) AS id, CASE WHEN r.stored IS NULL THEN 'added' WHEN state = 3 THEN 'revived' WHEN same THEN 'unchanged' ELSE 'changed' END AS outcome FROM clusters c LEFT JOIN ranked r ON c.cluster = r.draft AND r.n = 1
 UNION ALL SELECT page, NULL, CAST(stored AS VARCHAR), 'revoked' FROM ranked WHERE n > 1 AND state IN (0, 1))"""


@query("merge_claim", "v_strokes", sql=f"{_CLAIM_SQL} SELECT 'b' AS book, page, pos, id, outcome FROM claims")
def merge_scan(strokes: DataFrame) -> DataFrame:
    """A scan of all strokes merged into entries from an earlier one that lacked every fifth."""
    book, none = F.lit("b").alias("book"), F.lit(None).cast("string").alias("quote_id")
    state = F.element_at(F.array(*map(F.lit, ("mined", "reviewed", "skipped", "revoked"))), (F.col("cluster") % 4 + 1).cast("int"))
    drafts = inked_drafts(strokes).select(book, "page", F.col("cluster").alias("pos"), "ink_hash", "strokes", none)
    stored = inked_drafts(strokes.where("stroke_no % 5 <> 0")).select(book, "page", F.col("cluster").alias("seq"), F.col("cluster").cast("string").alias("id"), state.alias("status"), "ink_hash", "strokes", none)
    return merge_claim(drafts, stored)


OUTCOMES = ("added", "changed", "unchanged", "revoked", "revived")


def merge_counts(claims: DataFrame) -> DataFrame:
    """How many drafts and entries of each page came to each outcome."""
    return claims.groupBy("book", "page").agg(*(F.count_if(F.col("outcome") == o).alias(o) for o in OUTCOMES))


_COUNT_SQL = ", ".join(f"CAST(count(*) FILTER (outcome = '{o}') AS BIGINT) AS {o}" for o in OUTCOMES)


@query("merge_stats", "v_strokes", sql=f"{_CLAIM_SQL} SELECT 'b' AS book, page, {_COUNT_SQL} FROM claims GROUP BY page")
def merge_stats(strokes: DataFrame) -> DataFrame:
    return merge_counts(merge_scan(strokes))


TERMINAL_SQL = "status IN ('skipped','revoked','archived')"


def one_command(entries: DataFrame, cmd: str, arg: Column) -> DataFrame:
    """(id, state) of every entry after one command."""
    log = entries.select("id", F.lit(1).cast("long").alias("seq"), F.lit(cmd).alias("cmd"), arg.cast("string").alias("arg"), F.lit(1800000000).cast("long").alias("at"))
    return apply_commands(state_of(entries), log).select("id", "state.*")


@query("draft", "v_entries", sql=f"SELECT id, CASE WHEN {TERMINAL_SQL} OR text IS NOT NULL THEN status ELSE 'draft' END AS status, CASE WHEN {TERMINAL_SQL} OR text IS NOT NULL THEN 'body' ELSE 'bullet' END AS style, CASE WHEN {TERMINAL_SQL} THEN draft0 ELSE 'new words' END AS newest FROM v_entries")
def draft(entries: DataFrame) -> DataFrame:
    """A transcription that begins with a bullet comes in for every entry."""
    return one_command(entries, "draft", F.lit("- new words")).select("id", "status", "style", F.get("drafts", 0)["text"].alias("newest"))


@query("answer", "v_entries", sql=f"SELECT id, status, CASE WHEN {TERMINAL_SQL} THEN NULL ELSE 'because' END AS answer FROM v_entries")
def answer(entries: DataFrame) -> DataFrame:
    return one_command(entries, "answer", F.lit("because")).select("id", "status", "answer")


@query("patch", "v_entries", sql=f"SELECT id, CASE WHEN NOT {TERMINAL_SQL} AND id % 2 = 0 THEN 'why' END AS question, CASE WHEN {TERMINAL_SQL} THEN updated ELSE 1800000000 END AS updated FROM v_entries")
def patch(entries: DataFrame) -> DataFrame:
    """A question for every second entry, and a blank one, which clears it, for the others."""
    return one_command(entries, "ask", F.when(F.col("id") % 2 == 0, "why").otherwise("  ")).select("id", "question", "updated")


@query("edit_text", "v_entries", sql=f"SELECT id, CASE WHEN {TERMINAL_SQL} THEN status WHEN id % 2 = 0 THEN 'reviewed' WHEN draft0 IS NOT NULL THEN 'draft' ELSE 'pending' END AS status, CASE WHEN {TERMINAL_SQL} THEN text WHEN id % 2 = 0 THEN 'fixed' END AS text FROM v_entries")
def edit_text(entries: DataFrame) -> DataFrame:
    """A correction of every second entry; the others are cleared."""
    return one_command(entries, "edit", F.when(F.col("id") % 2 == 0, "1. fixed ").otherwise(" ")).select("id", "status", "text")


@query("restore", "v_entries", sql=f"SELECT id, CASE WHEN NOT {TERMINAL_SQL} THEN status WHEN status = 'skipped' THEN 'mined' WHEN text IS NOT NULL THEN 'reviewed' WHEN draft0 IS NOT NULL THEN 'draft' WHEN id % 2 = 0 THEN 'pending' ELSE 'mined' END AS status FROM v_entries")
def restore(entries: DataFrame) -> DataFrame:
    return one_command(entries, "restore", F.lit(None)).select("id", "status")


@query("revoke", "v_entries", sql=f"SELECT id, CASE WHEN {TERMINAL_SQL} THEN status ELSE 'revoked' END AS status FROM v_entries")
def revoke(entries: DataFrame) -> DataFrame:
    return one_command(entries, "revoke", F.lit(None)).select("id", "status")


@query("revive", "v_entries", sql="SELECT id, CASE WHEN status <> 'revoked' THEN status WHEN text IS NOT NULL THEN 'reviewed' WHEN draft0 IS NOT NULL THEN 'draft' ELSE 'mined' END AS status FROM v_entries")
def revive(entries: DataFrame) -> DataFrame:
    return one_command(entries, "revive", F.lit(None)).select("id", "status")


@query("triage", "v_entries", sql=f"SELECT id, CASE WHEN {TERMINAL_SQL} THEN status WHEN text IS NOT NULL OR (id % 2 = 1 AND quote IS NOT NULL) THEN 'reviewed' WHEN id % 2 = 0 AND draft0 IS NOT NULL THEN 'draft' ELSE 'pending' END AS status FROM v_entries")
def triage(entries: DataFrame) -> DataFrame:
    """Every entry is asked for as a note."""
    return one_command(entries, "request", F.lit(None)).select("id", "status")


@query("review", "v_entries", sql="SELECT id, CASE WHEN status = 'reviewed' AND trim(text) <> '' THEN 1800000000 + 3 * 86400 END AS due FROM v_entries")
def review(entries: DataFrame) -> DataFrame:
    """Every entry is remembered once, which only a reviewed one can be."""
    return one_command(entries, "remembered", F.lit(None)).select("id", "due")
