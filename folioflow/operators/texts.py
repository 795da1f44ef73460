"""Text functions applied to whole tables: markers, Markdown, names, escapes."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import text as T
from ..plans.registry import query


@query(
    "leading_marker",
    "v_lines",
    sql=r"""WITH l AS (SELECT id, raw, t, regexp_extract(t, '^[^\n]*', 0) AS f FROM (SELECT id, raw, regexp_replace(raw, '^\s+', '') AS t FROM v_lines)), k AS (SELECT *, substring(t, length(f) + 1) AS rest,
 CASE WHEN regexp_matches(f, '^##') AND trim(regexp_replace(f, '^#+', '')) <> '' THEN CASE WHEN regexp_matches(f, '^###') THEN 'heading2' ELSE 'heading1' END
 WHEN regexp_matches(f, '^[-*]?\s*[\[［][ xX　]?[\]］]($|[ 　])') OR regexp_matches(f, '^([□☐]|口($|[ 　]))') THEN 'checkbox' WHEN regexp_matches(f, '^(- |• |· |\* |—|－)') THEN 'bullet' WHEN regexp_matches(f, '^[0-9]{1,3}[.、)）．]($|[^0-9])') THEN 'numbered' END AS style FROM l)
SELECT id, style, CASE style WHEN 'heading1' THEN concat(ltrim(regexp_replace(f, '^#+', '')), rest) WHEN 'heading2' THEN concat(ltrim(regexp_replace(f, '^#+', '')), rest) WHEN 'checkbox' THEN concat(ltrim(regexp_replace(f, '^([-*]?\s*[\[［][ xX　]?[\]］]|[□☐口])', '')), rest)
 WHEN 'bullet' THEN concat(ltrim(regexp_replace(f, '^(- |• |· |\* |—|－)', '')), rest) WHEN 'numbered' THEN concat(ltrim(regexp_replace(f, '^[0-9]{1,3}[.、)）．]', '')), rest) ELSE raw END AS text FROM k""",
)
def leading_marker(lines: DataFrame) -> DataFrame:
    return lines.select("id", T.leading_marker(F.col("raw")).alias("m")).select("id", "m.style", "m.text")


def md_rows(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, pos, style, text) of every line of Markdown that leaves something."""
    lines = texts.select(key, F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    return lines.select(key, "pos", T.md_line(F.col("line")).alias("p")).select(key, "pos", "p.style", "p.text").where(F.col("text") != "")


@query(
    "md_paragraphs",
    "v_lines",
    sql=r"""WITH l AS (SELECT id, CAST(i - 1 AS INTEGER) AS pos, regexp_replace(string_split(raw, chr(10))[i], '^\s+', '') AS s FROM (SELECT id, raw, unnest(range(1, len(string_split(raw, chr(10))) + 1)) AS i FROM v_lines)),
k AS (SELECT id, pos, CASE WHEN regexp_matches(s, '^# ') THEN 'title' WHEN regexp_matches(s, '^## ') THEN 'heading1' WHEN regexp_matches(s, '^#{3,6} ') THEN 'heading2' WHEN regexp_matches(s, '^[-*] \[[ xX]\] ') THEN 'checkbox' WHEN regexp_matches(s, '^[-*+] ') THEN 'bullet' WHEN regexp_matches(s, '^[0-9]+[.)] ') THEN 'numbered' ELSE 'plain' END AS style,
 trim(CASE WHEN regexp_matches(s, '^#{1,6} ') THEN regexp_replace(s, '^#+ ', '') WHEN regexp_matches(s, '^[-*] \[[ xX]\] ') THEN regexp_replace(s, '^[-*] \[[ xX]\] ', '') WHEN regexp_matches(s, '^[-*+] ') THEN regexp_replace(s, '^[-*+] ', '') WHEN regexp_matches(s, '^[0-9]+[.)] ') THEN regexp_replace(s, '^[0-9]+[.)] ', '') ELSE s END) AS body FROM l)
SELECT id, pos, style, text FROM (SELECT id, pos, style, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(body, '(?s)\*\*(.*?)\*\*', '\1', 'g'), '(?s)__(.*?)__', '\1', 'g'), '(?s)`(.*?)`', '\1', 'g'), '(?s)\*(.*?)\*', '\1', 'g'), '(?s)_(.*?)_', '\1', 'g') AS text FROM k) WHERE text <> ''""",
)
def md_paragraphs(lines: DataFrame) -> DataFrame:
    return md_rows(lines, "id", "raw")


@query("strip_inline", "documents", sql=r"SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '(?s)\*\*(.*?)\*\*', '\1', 'g'), '(?s)__(.*?)__', '\1', 'g'), '(?s)`(.*?)`', '\1', 'g'), '(?s)\*(.*?)\*', '\1', 'g'), '(?s)_(.*?)_', '\1', 'g') AS plain FROM documents")
def strip_inline(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", T.strip_inline(F.col("text")).alias("plain"))


@query(
    "canonical_name",
    "v_book_files",
    sql=r"""SELECT doc_id, concat(regexp_extract(name, '^(Annals|Book) [a-z0-9]+ [a-z]+', 0), ' - ', CASE doc_id % 4 WHEN 1 THEN concat(n, '部') WHEN 2 THEN concat('第', n, '话') ELSE concat(n, '卷') END, regexp_extract(name, '[.][^.]+$', 0)) AS name FROM (SELECT doc_id, name, CAST(doc_id % 30 AS VARCHAR) AS n FROM v_book_files)""",
)
def canonical_names(files: DataFrame) -> DataFrame:
    """File names whose volumes are written in several forms."""
    return files.select("doc_id", T.canonical_file_name(F.col("name")).alias("name"))


@query("list_title", "v_book_files", sql=r"SELECT doc_id, trim(split_part(regexp_replace(name, '\.[^.]+$', ''), ' -- ', 1)) AS title, trim(split_part(trim(split_part(regexp_replace(name, '\.[^.]+$', ''), ' -- ', 1)), '-', 1)) AS series FROM v_book_files")
def list_titles(files: DataFrame) -> DataFrame:
    title = T.list_title(F.col("name"))
    return files.select("doc_id", title.alias("title"), T.series_of(title).alias("series"))


@query("file_ext", "v_book_files", sql=r"""SELECT doc_id, ext, regexp_replace(name, '\.[^.]*$', '') AS stem, CASE ext WHEN 'epub' THEN 'application/epub+zip' WHEN 'pdf' THEN 'application/pdf' WHEN 'txt' THEN 'text/plain; charset=utf-8' END AS mime, ext IN ('epub','pdf') AS eligible FROM (SELECT doc_id, name, lower(regexp_extract(name, '^.+\.([^.]*)$', 1)) AS ext FROM v_book_files)""")
def file_parts(files: DataFrame) -> DataFrame:
    name = F.col("name")
    return files.select("doc_id", T.file_ext(name).alias("ext"), T.file_stem(name).alias("stem"), T.file_mime(name).alias("mime"), T.file_ext(name).isin("epub", "pdf").alias("eligible"))


@query("sniff_format", "v_lines", sql="SELECT id, CASE WHEN starts_with(c, '%PDF') THEN 'pdf' WHEN starts_with(c, 'GIF8') THEN 'gif' WHEN starts_with(c, 'OTTO') THEN 'otf' WHEN starts_with(c, 'true') THEN 'ttf' END AS format FROM (SELECT id, concat(CASE id % 4 WHEN 0 THEN '%PDF-1.7' WHEN 1 THEN 'GIF89a' WHEN 2 THEN 'OTTO' ELSE '' END, raw) AS c FROM v_lines)")
def sniff_formats(lines: DataFrame) -> DataFrame:
    """Formats of contents that are the texts with various beginnings, and of the bare texts."""
    head = F.element_at(F.array(F.lit("%PDF-1.7"), F.lit("GIF89a"), F.lit("OTTO"), F.lit("")), (F.col("id") % 4 + 1).cast("int"))
    return lines.select("id", T.sniff_format(F.encode(F.concat(head, F.col("raw")), "UTF-8")).alias("format"))


@query("folder_segments", "pages", sql="SELECT page_id, array_to_string(list_filter(list_transform(string_split(url, '/'), lambda x: trim(x)), lambda x: x <> ''), '|') AS segments FROM pages")
def folder_segments(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", F.array_join(T.folder_segments(F.col("url")), "|").alias("segments"))


@query(
    "path_normalise",
    "pages",
    sql="""WITH RECURSIVE p AS (SELECT page_id, string_split(CASE page_id % 4 WHEN 0 THEN '/' || url ELSE 'a//b/' || CASE page_id % 4 WHEN 1 THEN '../../../' || url WHEN 2 THEN './' || url || '/../z' ELSE url || '//./..' END END, '/') AS parts FROM pages),
r AS (SELECT page_id, parts, 1 AS i, []::VARCHAR[] AS done FROM p UNION ALL SELECT page_id, parts, i + 1, CASE WHEN parts[i] IN ('', '.') THEN done WHEN parts[i] = '..' THEN list_slice(done, 1, len(done) - 1) ELSE list_append(done, parts[i]) END FROM r WHERE i <= len(parts))
SELECT page_id, array_to_string(done, '/') AS path FROM r WHERE i = len(parts) + 1""",
)
def path_normalise(pages: DataFrame) -> DataFrame:
    """Paths that go up, stay and come back, from a base."""
    url = F.col("url")
    paths = F.array(F.concat(F.lit("/"), url), F.concat(F.lit("../../../"), url), F.concat(F.lit("./"), url, F.lit("/../z")), F.concat(url, F.lit("//./..")))
    return pages.select("page_id", T.path_normalise(F.lit("a//b"), F.element_at(paths, (F.col("page_id") % 4 + 1).cast("int"))).alias("path"))


@query("xml_unescape", "pages", sql="""SELECT page_id, replace(replace(replace(replace(replace(html, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&apos;', ''''), '&amp;', '&') AS text FROM pages""")
def xml_unescape(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", T.xml_unescape(F.col("html")).alias("text"))


@query("percent_decode", "documents", sql="SELECT doc_id, url_decode(url_encode(text)) AS decoded FROM documents")
def percent_decode(docs: DataFrame) -> DataFrame:
    """Texts escaped and resolved again: an exact round trip."""
    return docs.select("doc_id", T.percent_decode(F.replace(F.url_encode("text"), F.lit("+"), F.lit("%20"))).alias("decoded"))


@query("yaml_quote", "documents", sql="""SELECT doc_id, concat('"', replace(replace(text, chr(92), chr(92) || chr(92)), '"', chr(92) || '"'), '"') AS quoted FROM documents""")
def yaml_quote(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", T.yaml_quote(F.col("text")).alias("quoted"))


@query("safe_filename", "pages", sql=r"SELECT page_id, CASE WHEN regexp_replace(url, '[/\\]', '_', 'g') IN ('', '.', '..') THEN '_' ELSE regexp_replace(url, '[/\\]', '_', 'g') END AS name FROM pages")
def safe_filename(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", T.safe_filename(F.col("url")).alias("name"))


@query("chapter_stem", "v_entries", sql="SELECT id, concat('第', CAST(chapter + 1 AS VARCHAR), '章 ', book) AS stem FROM v_entries WHERE chapter IS NOT NULL")
def chapter_stem(entries: DataFrame) -> DataFrame:
    return entries.where("chapter IS NOT NULL").select("id", T.chapter_stem(F.col("chapter"), F.col("book")).alias("stem"))


@query("truncate_chars", "documents", sql="SELECT doc_id, CASE WHEN length(text) > 100 THEN concat(substring(text, 1, 100), '…') ELSE text END AS short FROM documents")
def truncate_chars(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", T.truncate_chars(F.col("text"), 100).alias("short"))


@query("mask_key", "documents", sql="SELECT doc_id, CASE WHEN length(source) <= 4 THEN repeat('*', length(source)) ELSE concat('...', right(source, 4)) END AS masked FROM documents")
def mask_key(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", T.mask_key(F.col("source")).alias("masked"))


def _cut(c: str) -> str:
    return f"CASE WHEN length({c}) > 500 THEN concat(substring({c}, 1, 500), '…') ELSE {c} END"


@query(
    "build_prompt",
    "v_entries",
    sql=f"""SELECT id, concat('Answer.', chr(10), chr(10), '书名：', book, chr(10), CASE WHEN quote <> '' THEN concat('勾画原文：「', {_cut('quote')}, '」', chr(10)) ELSE '' END,
 CASE WHEN text <> '' THEN concat('旁边的批注：', {_cut('text')}, chr(10)) ELSE '' END, chr(10), '问题：', {_cut('question')}) AS prompt FROM (SELECT id, book, trim(quote, chr(10) || ' ') AS quote, trim(text, chr(10) || ' ') AS text, coalesce(trim(question, chr(10) || ' '), '') AS question FROM v_entries)""",
)
def build_prompt(entries: DataFrame) -> DataFrame:
    return entries.select("id", T.build_prompt(F.lit("Answer."), F.col("book"), F.lit(""), F.col("quote"), F.col("text"), F.coalesce("question", F.lit(""))).alias("prompt"))


@query(
    "sidecar_name",
    "v_book_files",
    sql="""SELECT doc_id, CASE WHEN strlen(name) + 11 <= 255 THEN concat('.', name, '.delivered') ELSE concat('.', substring(name, 1, list_max(list_filter(range(0, length(name) + 1), lambda n: strlen(substring(name, 1, n)) <= 200))), '.', substring(sha256(name), 1, 16), '.delivered') END AS sidecar FROM v_book_files""",
)
def sidecar_name(files: DataFrame) -> DataFrame:
    return files.select("doc_id", T.sidecar_name(F.col("name")).alias("sidecar"))


@query("is_cjk", "v_lines", sql="SELECT id, regexp_matches(substring(raw, 1, 1), '[一-鿿㐀-䶿豈-﫿　-〿]') AS cjk FROM v_lines")
def is_cjk(lines: DataFrame) -> DataFrame:
    return lines.select("id", T.is_cjk(F.col("raw")).alias("cjk"))


@query("tool_name", "events", sql="SELECT event_id, CASE user_id % 4 WHEN 0 THEN 'brush' WHEN 1 THEN 'pencil' WHEN 2 THEN 'ballpoint' ELSE 'marker' END AS tool, CASE WHEN event_id % 3 = 0 THEN '#0a0b0c' WHEN event_id % 3 = 1 THEN 'grey' ELSE 'unknown:99' END AS colour FROM events")
def tool_names(events: DataFrame) -> DataFrame:
    """Names of tools and colours by code, known and unknown."""
    third = F.col("event_id") % 3
    code = F.when(third == 1, 1).otherwise(99)
    part = lambda n: F.when(third == 0, F.lit(n))
    return events.select("event_id", T.named(F.col("user_id") % 4, T.TOOLS).alias("tool"), T.colour_name(code, part(10), part(11), part(12)).alias("colour"))


def fnv_sql(c: str) -> str:
    """SQL for FNV-1a of a text of ASCII characters."""
    return f"format('{{:016x}}', CAST(list_reduce(list_transform(string_split({c}, ''), lambda x: CAST(unicode(x) AS HUGEINT)), lambda h, b: (xor(h, b) * 1099511628211) % 18446744073709551616, CAST(14695981039346656037 AS HUGEINT)) AS UBIGINT))"


@query("fnv64", "customer", sql=f"SELECT c_custkey, {fnv_sql('c_name')} AS fnv FROM customer")
def fnv64(customers: DataFrame) -> DataFrame:
    return customers.select("c_custkey", T.fnv64(F.col("c_name")).alias("fnv"))


@query("style_code", "v_entries", sql="SELECT id, CASE style WHEN 'body' THEN 1 WHEN 'bullet' THEN 4 WHEN 'numbered' THEN 10 WHEN 'checkbox' THEN 6 WHEN 'heading1' THEN 3 WHEN 'heading2' THEN 3 END AS code FROM v_entries")
def style_codes(entries: DataFrame) -> DataFrame:
    return entries.select("id", F.create_map(*[F.lit(x) for kv in T.STYLES.items() for x in kv])[F.col("style")].alias("code"))


@query("pen_color", "events", sql="SELECT event_id, CASE user_id % 10 WHEN 0 THEN 'black' WHEN 1 THEN 'grey' WHEN 2 THEN 'white' WHEN 3 THEN 'yellow' WHEN 4 THEN 'green' WHEN 5 THEN 'pink' WHEN 6 THEN 'blue' WHEN 7 THEN 'red' WHEN 8 THEN 'grey_overlap' ELSE 'unknown:9' END AS colour FROM events")
def pen_colours(events: DataFrame) -> DataFrame:
    return events.select("event_id", T.named(F.col("user_id") % 10, T.COLOURS).alias("colour"))


@query("cjk_first", "v_lines", sql="SELECT id, CASE WHEN regexp_matches(substring(raw, 1, 1), '[一-鿿㐀-䶿豈-﫿　-〿]') THEN 'exact' ELSE 'expand' END AS span FROM v_lines")
def cjk_first(lines: DataFrame) -> DataFrame:
    """A span that begins with an ideograph is kept as it is; others may grow to whole words."""
    return lines.select("id", F.when(T.is_cjk(F.col("raw")), "exact").otherwise("expand").alias("span"))


@query("eligible_format", "v_shelf", sql="SELECT doc_id FROM v_shelf WHERE format IN ('epub','pdf')")
def eligible_format(shelf: DataFrame) -> DataFrame:
    return shelf.where(F.col("format").isin("epub", "pdf")).select("doc_id")
