"""Column expressions over text: markers, inline marks, names, escapes, paths. None of them leaves the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

BLANKS = r"(?U)^\s+"
BLANK_ENDS = r"(?U)^\s+|\s+$"


def trim_all(c: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(c, BLANK_ENDS, "")


def trim_start(c: Column) -> Column:
    return F.regexp_replace(c, BLANKS, "")


#: How the first line of a note says its style. In this order; (style, pattern that must match, what is cut).
MARKERS = (
    ("checkbox", r"^[-*]?(?U:\s)*[\[［][ xX　]?[\]］](?:$|[ 　])", r"^[-*]?(?U:\s)*[\[［][ xX　]?[\]］]"),
    ("checkbox", r"^(?:[□☐]|口(?:$|[ 　]))", r"^[□☐口]"),
    ("bullet", r"^(?:- |• |· |\* |—|－)", r"^(?:- |• |· |\* |—|－)"),
    ("numbered", r"^[0-9]{1,3}[.、)）．](?:$|[^0-9])", r"^[0-9]{1,3}[.、)）．]"),
)


def leading_marker(raw: Column) -> Column:
    """struct<style, text>: the style that the first line's marker stands for (null: none), and the text without it."""
    text = trim_start(raw)
    first = F.regexp_extract(text, r"^[^\n]*", 0)
    rest = F.substring(text, F.length(first) + 1, F.length(text))

    def found(style: str, cut: str) -> Column:
        return F.struct(F.lit(style).alias("style"), F.concat(trim_start(F.regexp_replace(first, cut, "")), rest).alias("text"))

    heading = first.rlike("^##") & (trim_all(F.regexp_replace(first, "^#+", "")) != "")
    out = F.when(heading & ~first.rlike("^###"), found("heading1", "^#+")).when(heading, found("heading2", "^#+"))
    for style, pattern, cut in MARKERS:
        out = out.when(first.rlike(pattern), found(style, cut))
    return out.otherwise(F.struct(F.lit(None).cast("string").alias("style"), raw.alias("text")))


def strip_inline(c: Column) -> Column:
    """Without paired marks of bold, code and italics; single ones stay. Two-character marks go first."""
    for mark in (r"\*\*", "__", "`", r"\*", "_"):
        c = F.regexp_replace(c, f"(?s){mark}(.*?){mark}", "$1")
    return c


def md_line(line: Column) -> Column:
    """struct<style, text> of one line of Markdown."""
    s = trim_start(line)
    body = lambda pattern: F.regexp_replace(s, pattern, "")
    style = (
        F.when(s.rlike("^# "), "title")
        .when(s.rlike("^## "), "heading1")
        .when(s.rlike("^#{3,6} "), "heading2")
        .when(s.rlike(r"^[-*] \[[ xX]\] "), "checkbox")
        .when(s.rlike(r"^[-*+] "), "bullet")
        .when(s.rlike(r"^[0-9]+[.)] "), "numbered")
        .otherwise("plain")
    )
    text = (
        F.when(s.rlike("^#{1,6} "), body("^#+ "))
        .when(s.rlike(r"^[-*] \[[ xX]\] "), body(r"^[-*] \[[ xX]\] "))
        .when(s.rlike(r"^[-*+] "), body(r"^[-*+] "))
        .when(s.rlike(r"^[0-9]+[.)] "), body(r"^[0-9]+[.)] "))
        .otherwise(s)
    )
    return F.struct(style.alias("style"), strip_inline(trim_all(text)).alias("text"))


#: How file names count volumes, say that a series is complete, and part a title from what follows.
NUMERALS = "0123456789０１２３４５６７８９一二三四五六七八九十百零〇两"
VOLUME_UNITS, CHAPTER_UNITS, PARTS, PART_UNITS = "卷部册集", "话回季篇", "上中下", "册部卷篇"
COMPLETE = ("完结版", "完结", "完", "全", "终")
SEPARATORS = "-–—_·:："

_N = f"[{NUMERALS}]+"
#: The forms of a volume without blanks, what each becomes, and whether it may follow the title without a separator.
FORMS = (
    (f"第({_N})([{VOLUME_UNITS}])", "$1$2", True),
    (f"([{VOLUME_UNITS}])({_N})", "$2$1", True),
    ("[Vv][Oo][Ll][.]?([0-9]+)", "$1卷", True),
    (f"({_N}[{VOLUME_UNITS}])", "$1", False),
    (f"(第{_N}[{CHAPTER_UNITS}])", "$1", False),
    (f"([{PARTS}][{PART_UNITS}]?)", "$1", False),
)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once: keeps long expressions from being written out again and again."""
    return F.transform(F.array(value), body)[0]


def volume(tail: Column) -> Column:
    """What a tail of a name becomes if it is a volume in one of the forms (``卷02`` and ``第02卷`` are ``02卷``), else null."""

    def formed(flat: Column) -> Column:
        return F.coalesce(*(F.when(flat.rlike(f"^{form}$"), F.regexp_replace(flat, f"^{form}$", to)) for form, to, _ in FORMS))

    return let(F.regexp_replace(tail, r"(?U)\s+", ""), formed)


def canonical_name(stem: Column) -> Column:
    """A book's name without the tail of its file name, and with its volume in one form; the same when applied again.

    The name is cut before its last bracket, after its last separator, or where a volume begins that needs none; the first
    of these cuts whose tail is a volume counts.
    """

    def bracketed(name: Column, opening: str, closing: str) -> tuple[Column, Column]:
        whole = rf"(?U)^(.*)[{opening}]([^{opening}]*)[{closing}]$"
        return F.regexp_extract(name, whole, 1), F.regexp_extract(name, whole, 2)

    def complete_dropped(name: Column) -> Column:
        before, inside = bracketed(name, r"\[（(【", r"\]）)】")
        return F.when(trim_all(inside).isin(*COMPLETE), trim_all(before)).otherwise(name)

    def joined(name: Column) -> Column:
        """Blanks within a volume at the end go, so that a separator before it is the last one."""
        for pattern in (rf"(第|[{VOLUME_UNITS}]|[Vv][Oo][Ll][.]?)\s+({_N}\s*[{VOLUME_UNITS}{CHAPTER_UNITS}]?)$", rf"({_N})\s+([{VOLUME_UNITS}{CHAPTER_UNITS}])$"):
            name = F.regexp_replace(name, "(?U)" + pattern, "$1$2")
        return name

    def named(name: Column) -> Column:
        apart = rf"(?U)^(.*)[{SEPARATORS}\s]([^{SEPARATORS}\s]+)$"
        glued = "(?:" + "|".join(form for form, _, alone in FORMS if alone) + ")$"
        last = joined(name)
        cuts = [bracketed(name, "（(", "）)"), (F.regexp_extract(last, apart, 1), F.regexp_extract(last, apart, 2)), (F.regexp_replace(last, glued, ""), F.regexp_extract(last, glued, 0))]
        tidy = lambda title: trim_all(F.regexp_replace(trim_all(title), f"[{SEPARATORS}]+$", ""))
        out = [let(F.struct(tidy(title).alias("title"), volume(tail).alias("volume")), lambda x: F.when((x["title"] != "") & x["volume"].isNotNull(), F.concat(x["title"], F.lit(" - "), x["volume"]))) for title, tail in cuts]
        return F.coalesce(*out, name)

    def whole(stem: Column) -> Column:
        first = trim_all(F.split(stem, " -- ", 2)[0])
        return let(first, lambda x: F.when(x == "", stem).otherwise(let(complete_dropped(x), named)))

    return let(trim_all(stem), whole)


def canonical_file_name(name: Column) -> Column:
    """The same for a file name, whose extension (up to five bytes) stays."""
    ext = F.regexp_extract(name, r"\.([^.]+)$", 1)
    has = (ext != "") & (F.octet_length(ext) <= 5)
    return F.when(has, F.concat(canonical_name(F.regexp_replace(name, r"\.[^.]+$", "")), F.lit("."), ext)).otherwise(canonical_name(name))


def list_title(name: Column) -> Column:
    """A file name without extension and tail."""
    return F.trim(F.split(F.regexp_replace(name, r"\.[^.]+$", ""), " -- ", 2)[0])


def series_of(title: Column) -> Column:
    """What stands before the first hyphen."""
    return F.trim(F.substring_index(title, "-", 1))


def file_ext(name: Column) -> Column:
    """Lower-case extension; a name that only begins with a dot has none."""
    return F.lower(F.regexp_extract(name, r"^.+\.([^.]*)$", 1))


def file_stem(name: Column) -> Column:
    return F.when(name.rlike(r"^.+\.[^.]*$"), F.regexp_replace(name, r"\.[^.]*$", "")).otherwise(name)


#: Media types by extension.
MIME = {
    "epub": "application/epub+zip", "pdf": "application/pdf", "zip": "application/zip", "rmdoc": "application/zip", "png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "webp": "image/webp", "svg": "image/svg+xml",
    "ttf": "font/ttf", "otf": "font/otf", "ttc": "font/collection", "json": "application/json", "md": "text/markdown; charset=utf-8", "txt": "text/plain; charset=utf-8", "html": "text/html; charset=utf-8", "htm": "text/html; charset=utf-8",
}


def file_mime(name: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in MIME.items() for x in kv])
    return F.coalesce(table[file_ext(name)], F.lit("application/octet-stream"))


def folder_segments(path: Column) -> Column:
    return F.filter(F.transform(F.split(path, "/"), trim_all), lambda s: s != "")


def path_normalise(base: Column, path: Column) -> Column:
    """``path`` seen from the folder ``base``, without empty and ``.`` parts, each ``..`` taking one away."""
    parts = F.split(F.when(path.startswith("/"), path).otherwise(F.concat_ws("/", base, path)), "/")
    step = lambda done, p: F.when(p.isin("", "."), done).when(p == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(p)))
    return F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")


def xml_unescape(c: Column) -> Column:
    """One layer of the five named entities; the ampersand last, so that nothing is unescaped twice."""
    for name, sign in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "'"), ("amp", "&")):
        c = F.replace(c, F.lit(f"&{name};"), F.lit(sign))
    return c


def plain_text(html: Column) -> Column:
    """Without comments and tags, entities resolved, white space folded."""
    bare = F.regexp_replace(F.regexp_replace(html, "(?s)<!--.*?-->", " "), "(?s)<[^>]*>", " ")
    return F.trim(F.regexp_replace(xml_unescape(bare), "[ \t\r\n]+", " "))


def yaml_quote(c: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))


def safe_filename(c: Column) -> Column:
    out = F.regexp_replace(c, r"[/\\]", "_")
    return F.when(out.isin("", ".", ".."), "_").otherwise(out)


def chapter_stem(chapter: Column, title: Column) -> Column:
    return F.concat(F.lit("第"), (chapter + 1).cast("string"), F.lit("章 "), title)


def truncate_chars(c: Column, n: int) -> Column:
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("…"))).otherwise(c)


def mask_key(c: Column) -> Column:
    """Only the last four characters are shown; a short key isn't shown at all."""
    return F.when(F.length(c) <= 4, F.repeat(F.lit("*"), F.length(c))).otherwise(F.concat(F.lit("..."), F.substring(c, -4, 4)))


def is_cjk(c: Column) -> Column:
    """Whether the first character is an ideograph (also Extension A and compatibility) or CJK punctuation."""
    return F.substring(c, 1, 1).rlike("[\\u4E00-\\u9FFF\\u3400-\\u4DBF\\uF900-\\uFAFF\\u3000-\\u303F]")


def snippet(text: Column, at: Column, length: Column, around: int = 30) -> Column:
    """The hit at ``at`` (from 1) with ``around`` characters on both sides, on one line, cut sides marked."""
    low = F.greatest(at - around, F.lit(1))
    high = F.least(at + length + around - 1, F.length(text))
    middle = F.replace(F.substring(text, low, high - low + 1), F.lit("\n"), F.lit(" "))
    return F.concat(F.when(low > 1, "…").otherwise(""), middle, F.when(high < F.length(text), "…").otherwise(""))


def fnv64(c: Column) -> Column:
    """FNV-1a of the UTF-8 bytes, 16 hexadecimal digits: a fold whose product wraps by halves of 32 bits.

    The prime is 2^40 + 435. Products of a half stay below 2^41 and their sum below 2^43; what is shifted out at the top is what wraps.
    """
    half = F.lit(0xFFFFFFFF)

    def step(state: Column, byte: Column) -> Column:
        mixed = state.bitwiseXOR(byte)
        low, high = mixed.bitwiseAND(half), F.shiftrightunsigned(mixed, 32)
        upper = high * 435 + F.shiftright(low * 435, 32) + F.shiftleft(low, 8)
        return F.shiftleft(upper, 32).bitwiseOR((low * 435).bitwiseAND(half))

    latin = F.decode(F.encode(c, "UTF-8"), "ISO-8859-1")  # a character for each byte
    data = F.when(latin != "", F.transform(F.split(latin, ""), lambda x: F.ascii(x).cast("long"))).otherwise(F.array().cast("array<bigint>"))
    out = F.aggregate(data, F.lit(0xCBF29CE484222325 - (1 << 64)), step)
    return F.lower(F.lpad(F.hex(out), 16, "0"))


#: How files of a kind begin, in hexadecimal.
MAGIC = {"89504E47": "png", "FFD8FF": "jpg", "25504446": "pdf", "504B0304": "zip", "47494638": "gif", "00010000": "ttf", "74727565": "ttf", "4F54544F": "otf", "74746366": "ttc"}


def sniff_format(content: Column) -> Column:
    """The format by a file's first bytes, whatever its name; null if unknown."""
    head = F.hex(F.substring(content, 1, 12))
    out = F.when(head.rlike("^52494646.{8}57454250"), "webp")
    for start, kind in MAGIC.items():
        out = out.when(head.startswith(start), kind)
    return out


def percent_decode(c: Column) -> Column:
    """URL escapes resolved; a plus stays a plus, and a text with a broken escape stays as it is."""
    return F.coalesce(F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B"))), c)


def sidecar_name(name: Column, most: int = 255, kept: int = 200) -> Column:
    """``.name.delivered``, or a cut name and a digest if that is too long for a file name (in bytes)."""
    plain = F.concat(F.lit("."), name, F.lit(".delivered"))
    places = F.sequence(F.lit(0), F.least(F.length(name), F.lit(kept)))
    cut = F.element_at(F.filter(F.transform(places, lambda n: F.substring(name, F.lit(1), n)), lambda s: F.octet_length(s) <= kept), -1)
    return F.when(F.octet_length(plain) <= most, plain).otherwise(F.concat(F.lit("."), cut, F.lit("."), F.substring(F.sha2(name, 256), 1, 16), F.lit(".delivered")))


def build_prompt(intro: Column, book: Column, chapter: Column, quote: Column, note: Column, question: Column) -> Column:
    """Lines of context that aren't empty, each cut to its limit, and the question."""

    def line(head: str, c: Column, limit: int, tail: str = "") -> Column:
        return F.when(F.coalesce(trim_all(c), F.lit("")) != "", F.concat(F.lit(head), truncate_chars(trim_all(c), limit), F.lit(tail + "\n"))).otherwise("")

    context = (line("书名：", book, 100), line("章节：", chapter, 100), line("勾画原文：「", quote, 500, "」"), line("旁边的批注：", note, 500))
    return F.concat(intro, F.lit("\n\n"), *context, F.lit("\n问题："), truncate_chars(trim_all(question), 500))


#: Codes of tools and colours.
TOOLS = {0: "brush", 12: "brush", 1: "pencil", 14: "pencil", 2: "ballpoint", 15: "ballpoint", 3: "marker", 16: "marker", 4: "fineliner", 17: "fineliner", 5: "highlighter", 18: "highlighter", 6: "eraser", 7: "mechanical_pencil", 13: "mechanical_pencil", 8: "eraser_area", 9: "erase_all", 10: "selection_brush", 11: "selection_brush", 21: "calligraphy"}
COLOURS = {0: "black", 1: "grey", 2: "white", 3: "yellow", 4: "green", 5: "pink", 6: "blue", 7: "red", 8: "grey_overlap"}
#: Codes of paragraph styles.
STYLES = {"body": 1, "bullet": 4, "numbered": 10, "checkbox": 6, "heading1": 3, "heading2": 3}


def named(code: Column, table: dict[int, str]) -> Column:
    """The name of a code; an unknown code is kept."""
    names = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(names[code.cast("int")], F.concat(F.lit("unknown:"), code.cast("string")))


def colour_name(code: Column, red: Column, green: Column, blue: Column) -> Column:
    """The same for colours; an unknown one with its parts is ``#rrggbb``."""
    return F.when(~code.isin(*COLOURS) & red.isNotNull(), F.format_string("#%02x%02x%02x", red, green, blue)).otherwise(named(code, COLOURS))


def provider_of_url(url: Column, providers: dict[str, str]) -> Column:
    """The provider whose address this is, whatever slashes end either; null if it is none of them."""
    table = F.create_map(*[F.lit(x) for k, v in providers.items() for x in (k.rstrip("/"), v)])
    return table[F.regexp_replace(url, "/+$", "")]
