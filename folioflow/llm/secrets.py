"""Secret scan by corpus-wide ownership frequency (operator 8), with DataFrame functions only.

Patterns find candidates in every text. The hash of each candidate's value is counted over the whole corpus by distinct
repositories and distinct owners: a value that many owners have is a copied example, one that a single owner (or few) has
and that looks random is live-looking. Findings of the three base kinds are always reported; those of the further kinds
only if they aren't widely copied. Counting is by two pre-aggregated steps, so a value in a third of all rows meets no
single task, and when the counts come back to the findings such a value is dealt out.

``documents`` has no column of repositories: the registered query takes a document for a repository and its source for the
owner; ``scan`` has both as parameters.

Edge cases: a null or empty text has no spans; an empty table has no rows; very long texts are taken whole; spans that tie in
their start are in the order of their kinds; a null owner is an owner of its own; rows are kept apart by a row number, so
repeated rows and null keys give one row each; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..operators.skew import spread_join
from ..store import cut

#: The base patterns, in the order in which their kinds are listed.
ASSIGN = r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
#: Kinds that the method adds, told apart by how they begin.
FURTHER = r"(?:gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk_(?:live|test)_[A-Za-z0-9]{16,}|AIza[A-Za-z0-9_-]{35}|eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}|-----BEGIN [A-Z ]*PRIVATE KEY-----)"
KINDS = ("assign", "access", "hex", "github", "slack", "stripe", "google", "jwt", "pem")
#: A value that so many owners have is a copied example.
COPIED_OWNERS = 3
#: A live-looking value has so many different characters.
LIVE_CHARACTERS = 8


#: Places that are gathered before they are put to the others: appending to an array copies it.
CHUNK = 256


def starts(text: Column, pattern: str, matches: Column) -> Column:
    """Where each of the leftmost, non-overlapping matches begins (from 1), given their strings in order: between them stand the
    parts that the pattern splits the text into, so lengths are added up, in time linear in the text and the matches."""
    none = F.array().cast("array<int>")
    steps = F.zip_with(F.transform(F.split(text, pattern, -1), F.length), F.transform(matches, F.length), lambda part, match: F.struct(part.alias("part"), match.alias("match")))
    start = F.struct(F.lit(0).alias("end"), none.alias("at"), F.array().cast("array<array<int>>").alias("done"))

    def step(s: Column, x: Column) -> Column:
        full = F.size(s["at"]) >= CHUNK
        place = F.array(s["end"] + x["part"] + 1)
        return F.struct((s["end"] + x["part"] + F.coalesce(x["match"], F.lit(0))).alias("end"), F.when(full, place).otherwise(F.concat(s["at"], place)).alias("at"), F.when(full, F.concat(s["done"], F.array(s["at"]))).otherwise(s["done"]).alias("done"))

    found = F.aggregate(steps, start, step, lambda s: F.flatten(F.concat(s["done"], F.array(s["at"]))))
    return F.when(F.size(matches) > 0, F.slice(found, 1, F.size(matches))).otherwise(none)


def _spans(kind: Column | None, matches: str, begins: str, value: Column | None = None) -> Column:
    """Structs (start, rank, kind, end, value) of matches. What is zipped is evaluated once, what a lambda names for each match."""
    placed = F.zip_with(matches, begins, lambda m, at: F.struct(m.alias("m"), at.alias("at")))
    both = F.zip_with(placed, matches if value is None else value, lambda p, v: F.struct(p["m"].alias("m"), p["at"].alias("at"), v.alias("v")))

    def one(x: Column) -> Column:
        m = x["m"]
        own = kind if kind is not None else F.when(m.startswith("gh"), "github").when(m.startswith("xox"), "slack").when(m.startswith("sk_"), "stripe").when(m.startswith("AIza"), "google").when(m.startswith("eyJ"), "jwt").otherwise("pem")
        return F.struct((x["at"] - 1).alias("start"), F.lit(0).alias("rank"), own.alias("kind"), (x["at"] - 1 + F.length(m)).alias("end"), x["v"].alias("value"))

    return F.transform(both, one)


def _ranked(spans: Column) -> Column:
    """Spans in the order of their start, then their kind as listed; the rank is the kind's place."""
    ranks = F.create_map(*[x for i, k in enumerate(KINDS) for x in (F.lit(k), F.lit(i))])
    return F.array_sort(F.transform(spans, lambda s: s.withField("rank", F.element_at(ranks, s["kind"]))))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def candidates(docs: DataFrame, key: str, text: str, owner: str, repository: str) -> DataFrame:
    """Per row: a row number, its owner and repository, and the candidates in order."""
    rows = docs.select(F.col(key).alias("key"), F.col(owner).cast("string").alias("owner"), F.col(repository).cast("string").alias("repository"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.monotonically_increasing_id().alias("row"))
    take = lambda p, g: F.regexp_extract_all("text", F.lit(p), F.lit(g))
    rows = rows.withColumns({"m_assign": take(ASSIGN, 1), "m_access": take(ACCESS, 0), "m_hex": take(HEX, 0), "m_further": take(FURTHER, 0)})
    rows = rows.withColumns({"v_assign": F.when(F.size("m_assign") > 0, take(ASSIGN, 2)).otherwise(F.array().cast("array<string>")), **{f"b_{k}": starts(F.col("text"), p, F.col(f"m_{k}")) for k, p in (("assign", ASSIGN), ("access", ACCESS), ("hex", HEX), ("further", FURTHER))}})
    assign = F.filter(_spans(F.lit("assign"), "m_assign", "b_assign", F.col("v_assign")), lambda s: F.length(s["value"]) >= 12)
    spans = F.concat(assign, _spans(F.lit("access"), "m_access", "b_access"), _spans(F.lit("hex"), "m_hex", "b_hex"), _spans(None, "m_further", "b_further"))
    some = F.size("m_assign") + F.size("m_access") + F.size("m_hex") + F.size("m_further") > 0
    none = F.array().cast("array<struct<start:int,rank:int,kind:string,end:int,value:string>>")
    return rows.select("row", "key", "owner", "repository", F.when(some, _ranked(spans)).otherwise(none).alias("spans"))


def ownership(found: DataFrame) -> DataFrame:
    """For each value's hash: in how many repositories it is, of how many owners, and how often (``n``)."""
    each = found.groupBy("hash", "owner", "repository").agg(F.count(F.lit(1)).alias("uses"))
    owners = each.groupBy("hash", "owner").agg(F.count(F.lit(1)).alias("repositories"), F.sum("uses").alias("uses"))
    return owners.groupBy("hash").agg(F.sum("repositories").alias("repositories"), F.count(F.lit(1)).alias("owners"), F.sum("uses").alias("n"))


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", owner: str = "source", repository: str = "doc_id", copied_owners: int = COPIED_OWNERS) -> DataFrame:
    """Per row of ``docs``: counts and digest of the base kinds, all spans, and how many candidates look live or copied."""
    rows = cut(candidates(docs, key, text, owner, repository), "secrets")
    found = rows.where(F.size("spans") > 0).select("row", "owner", "repository", F.explode("spans").alias("s")).select("row", "owner", "repository", "s", F.xxhash64(F.col("s.value")).alias("hash"))
    owned = cut(ownership(found), "owned")
    counted = spread_join(found.select("row", "s", "hash"), owned.drop("n"), "hash", "row", sizes=owned)
    base = F.col("s.rank") < 3
    copied = F.col("owners") >= copied_owners
    live = ~copied & (F.size(F.array_distinct(F.split(F.col("s.value"), ""))) >= LIVE_CHARACTERS)
    verdicts = counted.groupBy("row").agg(
        F.array_sort(F.collect_list(F.when(base | ~copied, F.struct("s.start", "s.rank", "s.kind", "s.end")))).alias("shown"),
        F.sum(F.when(live, 1).otherwise(0)).cast("long").alias("n_live"),
        F.sum(F.when(copied, 1).otherwise(0)).cast("long").alias("n_copied"),
        F.max("repositories").alias("most_repositories"),
    )
    is_base = F.filter("spans", lambda s: s["rank"] < 3)
    count = lambda i: F.size(F.filter("spans", lambda s: s["rank"] == i)).cast("long")
    return (
        rows.select("row", F.col("key").alias(key), count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(_joined(is_base), 256).alias("base_sha256"))
        .join(verdicts, "row", "left")
        .select(key, "n_assign", "n_access", "n_hex", "base_sha256", F.coalesce(_joined(F.col("shown")), F.lit("")).alias("spans"), F.coalesce("n_live", F.lit(0)).cast("long").alias("n_live"), F.coalesce("n_copied", F.lit(0)).cast("long").alias("n_copied"), F.coalesce("most_repositories", F.lit(0)).cast("long").alias("most_repositories"))
    )


def oracle() -> str:
    """DuckDB SQL for the rows of ``scan`` on ``documents``. Between the matches of a pattern stand the parts that it splits
    the text into, so their lengths give the matches' places."""
    quoted = lambda p: "'" + p.replace("'", "''") + "'"
    parts = [("assign", 0, ASSIGN, 1, 2), ("access", 1, ACCESS, 0, 0), ("hex", 2, HEX, 0, 0), ("further", 3, FURTHER, 0, 0)]
    each = " UNION ALL ".join(f"SELECT r, '{k}' AS kind, {n} AS pattern, string_split_regex(t, {quoted(p)}) AS g, regexp_extract_all(t, {quoted(p)}, {a}) AS m, regexp_extract_all(t, {quoted(p)}, {b}) AS v FROM d" for k, n, p, a, b in parts)
    ranks = " ".join(f"WHEN '{k}' THEN {i}" for i, k in enumerate(KINDS))
    return rf"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, source AS owner, coalesce(text, '') AS t FROM documents),
k AS ({each}),
x AS (SELECT r, kind, pattern, i, g[i] AS g, m[i] AS m, v[i] AS v FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM k WHERE len(m) > 0)),
y AS (SELECT r, CASE WHEN kind <> 'further' THEN kind WHEN m LIKE 'gh%' THEN 'github' WHEN m LIKE 'xox%' THEN 'slack' WHEN m LIKE 'sk_%' THEN 'stripe' WHEN m LIKE 'AIza%' THEN 'google' WHEN m LIKE 'eyJ%' THEN 'jwt' ELSE 'pem' END AS kind, v,
 sum(length(g) + length(m)) OVER w - length(m) AS s, sum(length(g) + length(m)) OVER w AS e FROM x WINDOW w AS (PARTITION BY r, pattern ORDER BY i)),
z AS (SELECT r, kind, CASE kind {ranks} END AS rank, s, e, v FROM y WHERE kind <> 'assign' OR length(v) >= 12),
o AS (SELECT v, count(*) AS owners, sum(n) AS repositories FROM (SELECT v, owner, count(DISTINCT coalesce(CAST(d.doc_id AS VARCHAR), '-')) AS n FROM z JOIN d USING (r) GROUP BY v, owner) GROUP BY v),
f AS (SELECT z.*, owners >= {COPIED_OWNERS} AS copied, len(list_distinct(string_split(z.v, ''))) >= {LIVE_CHARACTERS} AS varied, repositories FROM z JOIN o USING (v))
SELECT d.doc_id, CAST(count(*) FILTER (kind = 'assign') AS BIGINT) AS n_assign, CAST(count(*) FILTER (kind = 'access') AS BIGINT) AS n_access, CAST(count(*) FILTER (kind = 'hex') AS BIGINT) AS n_hex,
 sha256(coalesce(string_agg(concat(kind, ':', CAST(s AS BIGINT), ':', CAST(e AS BIGINT)), ',' ORDER BY s, rank) FILTER (rank < 3), '')) AS base_sha256,
 coalesce(string_agg(concat(kind, ':', CAST(s AS BIGINT), ':', CAST(e AS BIGINT)), ',' ORDER BY s, rank) FILTER (rank < 3 OR NOT copied), '') AS spans,
 CAST(count(*) FILTER (NOT copied AND varied) AS BIGINT) AS n_live, CAST(count(*) FILTER (copied) AS BIGINT) AS n_copied, CAST(coalesce(max(repositories), 0) AS BIGINT) AS most_repositories FROM d LEFT JOIN f USING (r) GROUP BY d.r, d.doc_id
"""
