"""Page tables, package files and enriched rows of the views: the sources' functions as queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..plans.registry import query
from ..sources import library as L
from . import structure
from .enrich import enrich_rows


@query("scan_page_table", "v_page_table", sql="SELECT book, ordinal, page_id, pdf_page FROM v_page_table")
def page_table(table: DataFrame) -> DataFrame:
    return table.select("book", "ordinal", "page_id", "pdf_page")


@query("page_id_lookup", "v_page_table", sql="SELECT book, page_id, CAST(row_number() OVER (PARTITION BY book ORDER BY ordinal) - 1 AS INTEGER) AS ordinal FROM v_page_table WHERE page_id IS NOT NULL")
def page_ids(table: DataFrame) -> DataFrame:
    return L.page_id_lookup(table)


@query("pdf_of", "v_pages", "v_page_table", sql="SELECT p.book, p.page, coalesce(t.pdf_page, p.page) AS pdf_page FROM v_pages p LEFT JOIN v_page_table t ON p.book = t.book AND p.page = t.ordinal")
def pdf_of(pages: DataFrame, table: DataFrame) -> DataFrame:
    return L.pdf_of(pages.select("book", "page"), table)


@query("doc_of", "v_pages", "v_page_table", sql="SELECT p.book, p.page AS pdf_page, coalesce((SELECT min(t.ordinal) FROM v_page_table t WHERE t.book = p.book AND t.pdf_page = p.page), p.page) AS page FROM v_pages p")
def doc_of(pages: DataFrame, table: DataFrame) -> DataFrame:
    return L.doc_of(pages.select("book", F.col("page").alias("pdf_page")), table)


@query("pdf_total", "v_page_table", sql="SELECT book, max(pdf_page) + 1 AS pages FROM v_page_table GROUP BY book HAVING max(pdf_page) IS NOT NULL")
def pdf_total(table: DataFrame) -> DataFrame:
    return L.pdf_total(table)


_OPF_SQL = r"""SELECT uuid, regexp_extract(text, '<dc:title>([^<]*)</dc:title>', 1) AS title, regexp_extract(text, '<dc:creator>([^<]*)</dc:creator>', 1) AS creator, array_to_string(regexp_extract_all(text, 'href="([^"]*)"', 1), '|') AS hrefs,
 array_to_string(regexp_extract_all(text, 'idref="([^"]*)"', 1), '|') AS spine, lower(trim(regexp_extract(text, 'direction="([^"]*)"', 1))) = 'rtl' AS rtl FROM v_packages"""


@query("extract_opf", "v_packages", sql=f"SELECT uuid, title, creator, hrefs, spine FROM ({_OPF_SQL})")
def extract_opf(packages: DataFrame) -> DataFrame:
    return L.extract_opf(packages).select("uuid", "title", "creator", F.array_join(F.transform("manifest", lambda x: x["href"]), "|").alias("hrefs"), F.array_join("spine", "|").alias("spine"))


@query("book_direction", "v_packages", sql=f"SELECT uuid, rtl FROM ({_OPF_SQL})")
def book_direction(packages: DataFrame) -> DataFrame:
    return L.book_direction(packages)


def count_lines(text: str) -> tuple[str, int, int]:
    """A stand-in for a model: (lines, characters read, characters written)."""
    lines = str(text.count("\n") + 1)
    return lines, len(text), len(lines)


@query("enrich_rows", "documents", sql="SELECT doc_id, lines AS result, true AS ok, CAST(length(text) AS BIGINT) AS prompt_tokens, CAST(length(lines) AS BIGINT) AS completion_tokens, CAST(NULL AS VARCHAR) AS error FROM (SELECT doc_id, text, CAST(len(string_split(text, chr(10))) AS VARCHAR) AS lines FROM documents)")
def enriched(docs: DataFrame) -> DataFrame:
    return enrich_rows(docs, "doc_id", "text", count_lines)
