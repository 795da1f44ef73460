"""Views over the given tables that feed the operators: the same SQL text for Spark and for DuckDB."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

_NEST = "".join(f'<ol><li><a href="../text/s{n}%20.xhtml#p{n}">S&amp;{n}</a>' for n in range(12))
_POINTS = "".join(f'<navPoint id="n{n}"><navLabel><text>Part {n} &lt;b&gt;</text></navLabel><content src="text/s{n}.xhtml#p"/>' for n in range(12))

VIEWS = {
    # the lists of a page with attributes, labels without link, the same file again, twelve levels and closing tags too many; or navigation points
    "v_contents": f"""SELECT page_id, CASE WHEN page_id%3=2 THEN 'ncx' ELSE 'nav' END AS kind, CASE WHEN page_id%3=2 THEN concat('<navMap></navPoint>', '{_POINTS}', repeat('</navPoint>', CAST(page_id%12 AS INT)), '<navPoint><content src="first.xhtml"/><navLabel><text xml:lang="zh">After <i>all</i> ', CAST(page_id AS VARCHAR(18)), '</text></navLabel>',
 '<navPoint><navLabel><text>Below</text></navLabel><content src="b.xhtml"/></navPoint></navPoint>', repeat('</navPoint>', 14), '<NAVPOINT><navLabel><text>Last</text></navLabel><content src="s', CAST(page_id%12 AS VARCHAR(18)), '.xhtml"/><navPoint><navLabel><text>Again</text></navLabel><content src="z.xhtml"/></navPoint></NAVPOINT></navMap>')
 ELSE concat('</ol>', replace(replace(html, '<ul>', CASE WHEN page_id%2=0 THEN '<OL class="x">' ELSE '<ol>' END), '</ul>', '</ol >'), '<ol><li><a class="x" href="pre', CAST(page_id%4 AS VARCHAR(18)), '.xhtml">Pre <b>face</b></a></li><li><span>Group</span>', '{_NEST}', repeat('</li></ol>', CAST(page_id%12 AS INT)),
 '<li><a href="s', CAST(page_id%13 AS VARCHAR(18)), '%20.xhtml#again">Again</a><ol><li><a href="below.xhtml">Below</a></li></ol></li>', repeat('</li></ol>', 14), '<ol><ol><li><a href="loose.xhtml">Loose</a></li></ol></ol><a href="out.xhtml">Out</a><a href="#only">nothing</a><a href="t.xhtml"><img/></a>') END AS contents FROM pages""",
    "v_strokes": """SELECT CAST(floor(l_orderkey/8.0) AS BIGINT) AS page, l_orderkey*100+l_linenumber AS stroke_no,
 CASE WHEN min(l_returnflag)='A' THEN 'highlighter' ELSE 'ballpoint' END AS tool,
 CAST(min(l_quantity) AS BIGINT) AS n_points,
 CAST(min(l_partkey)%960 AS DOUBLE) AS x0, CAST((min(l_suppkey)*13)%1280 AS DOUBLE) AS y0,
 CAST(min(l_partkey)%960 AS DOUBLE)+min(l_quantity) AS x1, CAST((min(l_suppkey)*13)%1280 AS DOUBLE)+min(l_quantity)/2 AS y1
 FROM lineitem GROUP BY l_orderkey,l_linenumber""",
    "v_highlights": """SELECT CAST(floor(o_orderkey/8.0) AS BIGINT) AS page, o_orderkey AS hl_no, o_orderpriority AS text,
 CAST(o_custkey%760 AS DOUBLE) AS x0, CAST((o_orderkey*37)%1240 AS DOUBLE) AS y0, CAST(o_custkey%760+200 AS DOUBLE) AS x1, CAST((o_orderkey*37)%1240+30 AS DOUBLE) AS y1
 FROM orders WHERE o_orderstatus='F'""",
    "v_entries": """SELECT doc_id AS id, source AS book, doc_id%300 AS page_index, CASE WHEN doc_id%11=0 THEN NULL ELSE doc_id%9 END AS chapter,
 CASE doc_id%7 WHEN 0 THEN 'mined' WHEN 1 THEN 'pending' WHEN 2 THEN 'draft' WHEN 3 THEN 'reviewed' WHEN 4 THEN 'skipped' WHEN 5 THEN 'revoked' ELSE 'archived' END AS status,
 CASE doc_id%3 WHEN 0 THEN 'notebook' WHEN 1 THEN 'obsidian' ELSE 'both' END AS destination,
 CASE doc_id%13 WHEN 0 THEN 'bullet' WHEN 1 THEN 'numbered' WHEN 2 THEN 'checkbox' WHEN 3 THEN 'heading1' WHEN 4 THEN 'heading2' ELSE 'body' END AS style,
 CASE WHEN doc_id%4<>0 THEN concat('Part ',CAST(CAST(floor((doc_id%300)/60.0) AS BIGINT) AS VARCHAR(9))) END AS subhead,
 CASE WHEN doc_id%7=3 THEN text END AS text, CASE WHEN doc_id%7 IN (2,3) THEN (CASE WHEN doc_id%4=0 THEN 'quoted ' ELSE 'written ' END) || text END AS draft0,
 CASE WHEN doc_id%5<>0 THEN 'quoted ' || text END AS quote, CASE WHEN doc_id%6=0 THEN 'why ' || text END AS question, CASE WHEN doc_id%12=0 THEN 'because ' || text END AS answer,
 CASE WHEN doc_id%10=0 THEN 3 ELSE doc_id%3 END AS attempts, 1704067200+(doc_id*3600)%7776000 AS updated FROM documents""",
    "v_tried": "SELECT id, book, updated, 3 AS attempts FROM v_entries WHERE id%4=0 AND updated%7200=0",
    "v_books": "SELECT source AS uuid, concat('Book ',source) AS title, CASE WHEN min(doc_id)%2=0 THEN concat('Author ',min(lang)) ELSE '' END AS author FROM documents GROUP BY source",
    "v_usage_calls": "SELECT event_id AS called, concat('m',CAST(user_id%5 AS VARCHAR(9))) AS model, event_type<>'error' AS ok, CAST(floor(value*10) AS BIGINT) AS prompt_tokens, CAST(floor(value*3) AS BIGINT) AS completion_tokens, props AS err FROM events",
    "v_prices": "SELECT 'm0' AS model, CAST(0.5 AS DOUBLE) AS input_per1k, CAST(1.0 AS DOUBLE) AS output_per1k UNION ALL SELECT 'm1', CAST(0.0 AS DOUBLE), CAST(2.0 AS DOUBLE) UNION ALL SELECT 'm9', CAST(1.0 AS DOUBLE), CAST(1.0 AS DOUBLE)",
    "v_auth_failures": "SELECT user_id%20 AS ip, ts FROM events WHERE event_type='error'",
    "v_library": """SELECT concat('r',CAST(r_regionkey AS VARCHAR(9))) AS uuid, r_name AS name, 'folder' AS kind, '' AS parent, false AS deleted FROM region
 UNION ALL SELECT concat('n',CAST(n_nationkey AS VARCHAR(9))), n_name, 'folder', CASE WHEN n_nationkey%9=0 THEN 'trash' ELSE concat('r',CAST(n_regionkey AS VARCHAR(9))) END, false FROM nation
 UNION ALL SELECT concat('c',CAST(c_custkey AS VARCHAR(9))), c_mktsegment, 'document', CASE WHEN c_custkey%17=0 THEN 'trash' ELSE concat('n',CAST(c_nationkey AS VARCHAR(9))) END, c_custkey%19=0 FROM customer""",
    "v_sections": "SELECT s_nationkey AS book, s_name AS file, (s_suppkey*7)%500 AS start_page FROM supplier",
    "v_pages": "SELECT o_orderkey AS page_key, o_custkey%25 AS book, o_orderkey%500 AS page FROM orders",
    "v_page_state": "SELECT book, page, max(page_key) AS mtime FROM v_pages WHERE page_key%3=0 GROUP BY book, page",
    "v_book_files": """SELECT doc_id, concat(CASE WHEN doc_id%3=0 THEN 'Annals ' ELSE 'Book ' END, source, ' ', lang, CASE doc_id%4 WHEN 0 THEN ' - 卷' WHEN 1 THEN '(第' WHEN 2 THEN ' 第' ELSE 'Vol.' END, CAST(doc_id%30 AS VARCHAR(9)), CASE doc_id%4 WHEN 1 THEN '部)' WHEN 2 THEN '话' ELSE '' END,
 ' -- ', lang, ' -- ', concat(CASE WHEN doc_id%50=0 THEN repeat('著者',50) ELSE 'h' END, CAST(doc_id AS VARCHAR(18))), CASE doc_id%10 WHEN 0 THEN '.pdf' WHEN 1 THEN '.TXT' ELSE '.epub' END) AS name, n_chars AS bytes FROM documents""",
    "v_kept_files": "SELECT * FROM v_book_files WHERE doc_id%5<>0",
    "v_shelf": """SELECT doc_id, name, bytes, 1704067200+doc_id*60 AS mtime, CASE WHEN doc_id%10=0 THEN 'pdf' WHEN doc_id%10=1 THEN 'other' ELSE 'epub' END AS format,
 CASE WHEN doc_id%4=0 THEN NULL ELSE 1704067200+doc_id*60+CASE WHEN doc_id%5=0 THEN -30 ELSE 30 END END AS native_at,
 CASE doc_id%6 WHEN 0 THEN 'failed' WHEN 1 THEN 'pending' WHEN 2 THEN 'cancelled' ELSE 'ok' END AS deliver_status, doc_id%13=0 AS busy FROM v_book_files""",
    "v_lines": """SELECT doc_id AS id, concat(CASE doc_id%12 WHEN 0 THEN '- ' WHEN 1 THEN '1. ' WHEN 2 THEN '- [ ] ' WHEN 3 THEN '## ' WHEN 4 THEN '### ' WHEN 5 THEN '口 ' WHEN 6 THEN '3.14 ' WHEN 7 THEN '□ ' WHEN 8 THEN '12、' WHEN 9 THEN '# ' WHEN 10 THEN '-3 ' ELSE '' END, text) AS raw FROM documents""",
    "v_page_table": """SELECT o_custkey%25 AS book, CAST(row_number() OVER (PARTITION BY o_custkey%25 ORDER BY o_orderkey)-1 AS INT) AS ordinal, CASE WHEN o_orderkey%7<>0 THEN concat('p',CAST(o_orderkey AS VARCHAR(18))) END AS page_id,
 CASE WHEN o_custkey%25%4<>0 AND o_orderkey%5<>0 THEN CAST(o_orderkey%300 AS INT) END AS pdf_page, CAST(o_custkey%25%3%2+1 AS INT) AS version FROM orders""",
    "v_package_files": """SELECT page_id AS book, CAST(page_id%5 AS INT) AS pos, concat('text/', CASE page_id%5 WHEN 0 THEN 'nav.xhtml' WHEN 1 THEN 'toc.ncx' WHEN 2 THEN 'my-nav.xhtml' ELSE concat('c', CAST(page_id AS VARCHAR(18)), '.xhtml') END) AS path,
 CASE WHEN page_id%3=0 THEN concat('text/c', CAST(page_id AS VARCHAR(18)), '.xhtml') END AS declared_nav, CASE WHEN page_id%4=0 THEN 'text/toc.ncx' END AS declared_ncx, html FROM pages""",
    "v_packages": """SELECT p_partkey AS uuid, concat('<?xml version="1.0"?><package xmlns="http://www.idpf.org/2007/opf"><!-- <item id="no"/> --><metadata xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:title>', p_name, '</dc:title><dc:creator>', p_brand, '</dc:creator></metadata><manifest><item id="a" href="a', CAST(p_partkey AS VARCHAR(18)),
 '.html"/><item id="b" href="', p_type, '"/></manifest><spine', CASE p_partkey%3 WHEN 0 THEN ' page-progression-direction=" RTL "' WHEN 1 THEN ' page-progression-direction="ltr"' ELSE '' END, '><itemref idref="b"/><itemref idref="a"/></spine></package>') AS text FROM part""",
    # what the files of a library say: damaged ones, numbers as text, missing fields
    "v_metadata": """SELECT concat('u', CAST(s_suppkey AS VARCHAR(18))) AS uuid, s_name AS visible_name, CASE WHEN s_suppkey%5=0 THEN 'CollectionType' WHEN s_suppkey%13=0 THEN 'OddType' ELSE 'DocumentType' END AS type_name, CASE WHEN s_suppkey%4=0 THEN '' ELSE concat('n', CAST(s_nationkey AS VARCHAR(18))) END AS parent,
 s_suppkey%17=0 AS deleted, 1704067200000+s_suppkey*86400000 AS created_ms, CASE WHEN s_suppkey%3=0 THEN s_suppkey%300 END AS last_page, CASE s_suppkey%11 WHEN 7 THEN 'cut' WHEN 9 THEN 'list' ELSE 'whole' END AS state FROM supplier""",
    "v_metadata_files": """SELECT concat(uuid, '.metadata') AS name, CASE state WHEN 'cut' THEN concat('{"visibleName": "', visible_name) WHEN 'list' THEN '[1, 2]' ELSE concat('{"visibleName": "', visible_name, '", "type": "', type_name, '", "parent": "', parent, '"', CASE WHEN deleted THEN ', "deleted": true' ELSE '' END,
 CASE WHEN last_page%2=0 THEN concat(', "createdTime": ', CAST(created_ms AS VARCHAR(18))) ELSE concat(', "createdTime": "', CAST(created_ms AS VARCHAR(18)), '"') END, CASE WHEN last_page IS NOT NULL THEN concat(', "lastOpenedPage": ', CAST(last_page AS VARCHAR(18))) ELSE '' END, ', "more": {"a": [1]}}') END AS value FROM v_metadata""",
    "v_stored": """SELECT s_suppkey AS n, concat('b', CAST(s_suppkey AS VARCHAR(18))) AS book, s_name AS title, CASE WHEN s_suppkey%3=0 THEN concat('Writer ', CAST(s_nationkey AS VARCHAR(18))) ELSE '' END AS author, concat('Text of ', s_name) AS text, CASE s_suppkey%4 WHEN 0 THEN 'draft' WHEN 1 THEN 'reviewed' WHEN 2 THEN 'mined' ELSE 'pending' END AS status,
 CASE WHEN s_suppkey%3=1 THEN 'checkbox' ELSE 'body' END AS style, CASE WHEN s_suppkey%2=0 THEN s_nationkey END AS chapter, CASE s_suppkey%10 WHEN 3 THEN 'cut' WHEN 7 THEN 'word' WHEN 9 THEN 'lacks' ELSE 'whole' END AS state FROM supplier""",
    "v_stored_files": """SELECT concat(book, '.json') AS name, concat('{"uuid": "', book, '", "title": "', title, '"', CASE WHEN author <> '' THEN concat(', "author": "', author, '"') ELSE '' END, ', "entries": [{"id": "', book, '-0", "page": "p', CAST(n AS VARCHAR(18)), '", "page_index": ', CAST(n%300 AS VARCHAR(18)),
 CASE WHEN chapter IS NOT NULL THEN concat(', "chapter": ', CAST(chapter AS VARCHAR(18))) ELSE ', "chapter": null' END, ', "text": "', text, '", "status": "', status, '"', CASE WHEN style <> 'body' THEN concat(', "style": "', style, '"') ELSE '' END,
 ', "quote": {"text": "said ', text, '", "color": "y", "rects": [[1, 2.5, 3, 4]]}, "ink": {"strokes": ["1:', CAST(n AS VARCHAR(18)), '", "1:2"], "bbox": [0, 0, 9.5, 9], "hash": "h', CAST(n AS VARCHAR(18)), '"}, "drafts": [{"text": "d", "backend": "m", "at": ', CAST(n AS VARCHAR(18)), ', "hash": "h"}], "review": {"due": 9, "interval_days": 3, "streak": 1}, ',
 CASE WHEN state = 'lacks' THEN '' ELSE '"created": 1, ' END, '"updated": 2}, {"id": "', book, '-1", "page": "q", "page_index": 1, "status": "', CASE WHEN state = 'word' THEN 'unheard of' ELSE 'archived' END, '", "created": 3, "updated": 4}]', CASE WHEN state = 'cut' THEN '' ELSE '}' END) AS value FROM v_stored""",
    "v_deploys": """SELECT p_partkey AS n, concat('d', CAST(p_partkey%7 AS VARCHAR(18))) AS device, 1704067200+p_partkey*60 AS at_s, p_brand AS label, CASE WHEN p_partkey%5=0 THEN p_type ELSE '' END AS failed, p_partkey%4=0 AS dirty, p_partkey%9=4 AS damaged FROM part""",
    "v_deploy_lines": """SELECT n AS line, concat('log', CAST(n%3 AS VARCHAR(18)), '.jsonl') AS name, CASE WHEN damaged THEN concat('{"device": "', device, '", "at": ') ELSE concat('{"device": "', device, '", "at": ', CAST(at_s AS VARCHAR(18)), ', "label": "', label, '"', CASE WHEN failed <> '' THEN concat(', "failed": "', failed, '"') ELSE '' END, CASE WHEN dirty THEN ', "dirty": true' ELSE '' END, ', "files": {"a": "1"}}') END AS value FROM v_deploys""",
    "v_allow_lines": """SELECT s_suppkey AS line, concat('allow', CAST(s_suppkey%2 AS VARCHAR(18)), '.txt') AS name, CASE s_suppkey%6 WHEN 0 THEN concat('# ', s_name) WHEN 1 THEN concat('  ', repeat('AB', 28), lpad(CAST(s_suppkey AS VARCHAR(18)), 8, '0')) WHEN 2 THEN concat(repeat('c', 55), lpad(CAST(s_suppkey AS VARCHAR(18)), 8, '0'), ' short')
 ELSE concat(repeat('0f', 28), lpad(CAST(s_suppkey AS VARCHAR(18)), 8, '0'), '   ', s_name) END AS value FROM supplier""",
    "v_commands": "SELECT event_id AS seq, user_id AS entry, CASE event_type WHEN 'click' THEN 'request' WHEN 'view' THEN 'skip' WHEN 'signup' THEN 'draft' WHEN 'purchase' THEN 'restore' ELSE 'archive' END AS cmd, ts FROM events",
    "v_deploy_files": """SELECT p_partkey%20 AS device, concat('f',CAST(p_partkey AS VARCHAR(9))) AS path, concat(p_brand,'/',CAST(p_partkey AS VARCHAR(9))) AS recorded,
 CASE WHEN p_partkey%7=0 THEN NULL WHEN p_partkey%5=0 THEN 'x' ELSE concat(p_brand,'/',CAST(p_partkey AS VARCHAR(9))) END AS current_hash,
 CASE WHEN p_partkey%35=0 THEN concat(p_brand,'/',CAST(p_partkey AS VARCHAR(9))) END AS pending_hash FROM part""",
}


def needed(sql: str) -> list[str]:
    """The views that a text names, those that they need first."""
    found: list[str] = []
    for name in re.findall(r"\bv_\w+", sql):
        for x in [*needed(VIEWS[name]), name]:
            if x not in found:
                found.append(x)
    return found


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table, or a view over given tables."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    sql = VIEWS[name]
    used = {t for t in re.findall(r"\b(?:FROM|JOIN)\s+(\w+)", sql)}
    plain = sql.replace("{", "{{").replace("}", "}}")
    return spark.sql(re.sub(r"\b(FROM|JOIN)\s+(\w+)", r"\1 {\2}", plain), **{t: view(spark, sf_dir, t) for t in used})


def with_views(sql: str) -> str:
    """DuckDB SQL that defines the views it names."""
    names = needed(sql)
    if not names:
        return sql
    given = ", ".join(f"{n} AS ({VIEWS[n]})" for n in names)
    body = sql.strip()
    if body.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {given}, {body[14:]}"
    return f"WITH {given}, {body[4:]}" if body.upper().startswith("WITH") else f"WITH {given} {body}"
