"""Queries of whole documents: reports, office nodes, web pages, streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from papyra import fixed
from papyra.functions import tokens as tk
from papyra.operators import nodes as nd
from papyra.operators import report as rp
from papyra.plans.registry import Catalog
from papyra.sources import html as ht
from papyra.streaming import streams as st

catalog = Catalog()
WS = fixed.WS

_S = f"""(SELECT coalesce(nullif(translate(lower(trim(source)), '_ ', '--'), ''), 'none') AS source, doc_id, coalesce(length(regexp_replace(text, '{WS}', '', 'g')), 0) AS c, lang, coalesce(CAST(ceil(length(text) / 3.5::DOUBLE) AS BIGINT), 0) AS tokens FROM documents)"""


_REPORT = f"""
    WITH u AS (SELECT *, CASE WHEN c >= 20 THEN 'text-only' ELSE 'empty' END AS kind, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i FROM {_S}),
    k AS (SELECT *, kind || '|' || coalesce(lang, '') AS k FROM u), p AS (SELECT *, lag(k) OVER (PARTITION BY source ORDER BY i) AS pk FROM k),
    l AS (SELECT source, arg_max(lang, (n, -first)) FILTER (lang IS NOT NULL) AS lang FROM (SELECT source, nullif(lang, 'und') AS lang, count(*) AS n, min(i) AS first FROM u GROUP BY 1, 2) GROUP BY source),
    g AS (SELECT source, count(*) AS unit_count, count(*) FILTER (pk IS NULL OR k <> pk) AS run_count, sum(c) AS characters, sum(tokens) AS tokens FROM p GROUP BY source),
    s AS (SELECT *, CAST(least(100, floor(2.0 * unit_count + characters / 1000.0::DOUBLE + 0.5)) AS INT) AS score FROM g)
    SELECT s.source, unit_count, run_count, characters, tokens, score, CASE WHEN score < 20 THEN 'low' WHEN score < 50 THEN 'medium' WHEN score < 80 THEN 'high' ELSE 'very_high' END AS level, coalesce(l.lang, 'und') AS dominant_language,
        round(tokens / 1e6::DOUBLE * 1.0 + tokens / 1e6::DOUBLE * 4.0, 6) AS cost FROM s JOIN l ON s.source = l.source"""


@catalog.add("doc_report", _REPORT)
def doc_report(t):
    return rp.source_report(t.documents)


@catalog.add("source_report", _REPORT)
def source_report(t):
    """The flagship under its other name."""
    return rp.source_report(t.documents)


@catalog.add("estimate_doc_cost", "SELECT doc_id, count(*) AS pages, sum(CAST(ceil(char_count / 3.5::DOUBLE) AS BIGINT)) AS tokens, round(sum(CAST(ceil(char_count / 3.5::DOUBLE) AS BIGINT)) / 1e6::DOUBLE * 5.0, 9) AS cost FROM (SELECT DISTINCT ON (doc_id, page_index) doc_id, page_index, coalesce(char_count, 0) AS char_count FROM pdf_pages) GROUP BY doc_id")
def estimate_doc_cost(t):
    p = t.pdf_pages
    n = tk.ceil_long(F.coalesce("char_count", F.lit(0)) / F.lit(3.5))
    return p.groupBy("doc_id").agg(F.count("*").alias("pages"), F.sum(n).alias("tokens")).withColumn("cost", F.round(F.col("tokens") / F.lit(1e6) * 5.0, 9))


@catalog.add("page_attributes", f"SELECT doc_id, page_index, coalesce(length(regexp_replace(text_sample, '{WS}', '', 'g')), 0) AS sample_chars, width_pt >= height_pt AS landscape, least(1.0, greatest(0.0, total_image_coverage)) AS coverage, large_image_count FROM pdf_pages")
def page_attributes(t):
    from papyra.functions.geometry import clamp01
    from papyra.functions.text import char_count

    return t.pdf_pages.select("doc_id", "page_index", char_count(F.col("text_sample")).alias("sample_chars"), (F.col("width_pt") >= F.col("height_pt")).alias("landscape"), clamp01(F.col("total_image_coverage")).alias("coverage"), "large_image_count")


# --- office nodes ------------------------------------------------------------------------------

_NODES = """(SELECT doc_id, unit_index, CAST(i AS INT) AS preorder, n.type AS type, n.text AS text FROM (SELECT doc_id, unit_index, unnest(nodes) AS n, unnest(range(len(nodes))) AS i FROM (
    SELECT doc_id, section_index AS unit_index, list_concat([{'type': 'section', 'text': CAST(NULL AS VARCHAR)}], CASE WHEN length(heading) > 0 THEN [{'type': 'heading', 'text': heading}] ELSE [] END,
        list_transform(coalesce(lines, []), lambda x: {'type': CASE WHEN starts_with(x, '[Image') THEN 'image' WHEN starts_with(x, '[Speaker') THEN 'note' ELSE 'paragraph' END, 'text': x})) AS nodes
    FROM (SELECT DISTINCT ON (doc_id, section_index) * FROM sections))))"""
_TRIM = f"regexp_replace(text, '^{WS}+|{WS}+$', '', 'g')"


@catalog.add("walk_nodes", f"SELECT doc_id, unit_index, preorder, type, text, CASE WHEN preorder > 0 THEN 0 END AS parent_id, CASE WHEN preorder > 0 THEN 1 ELSE 0 END AS depth FROM {_NODES}")
def walk_nodes(t):
    return nd.section_nodes(t.sections).drop("node_id")


@catalog.add("find_nodes", f"SELECT doc_id, unit_index, preorder, text FROM {_NODES} WHERE type = 'heading'")
def find_nodes(t):
    return nd.find_nodes(nd.section_nodes(t.sections), "heading").select("doc_id", "unit_index", "preorder", "text")


@catalog.add("nodes_text", f"SELECT doc_id, unit_index, coalesce(string_agg(t, chr(10) ORDER BY preorder) FILTER (length(t) > 0), '') AS text FROM (SELECT *, {_TRIM} AS t FROM {_NODES} WHERE type NOT IN ('text', 'note')) GROUP BY 1, 2")
def nodes_text(t):
    return nd.nodes_text(nd.section_nodes(t.sections))


@catalog.add("slide_notes", f"SELECT doc_id, unit_index, coalesce(string_agg(t, chr(10) ORDER BY preorder) FILTER (length(t) > 0), '') AS text FROM (SELECT *, {_TRIM} AS t FROM {_NODES} WHERE type = 'note') GROUP BY 1, 2")
def slide_notes(t):
    return nd.nodes_text(nd.section_nodes(t.sections), notes=True)


@catalog.add("count_images", f"SELECT doc_id, count(*) FILTER (type = 'image') AS images FROM {_NODES} GROUP BY doc_id")
def count_images(t):
    return nd.section_nodes(t.sections).groupBy("doc_id").agg(F.count_if(F.col("type") == "image").alias("images"))


@catalog.add("content_units", f"SELECT doc_id, section_id, count(*) AS nodes FROM (SELECT *, CAST(sum(CASE WHEN type = 'heading' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY unit_index, preorder) AS INT) AS section_id FROM {_NODES}) GROUP BY 1, 2")
def content_units(t):
    return nd.split_at_headings(nd.section_nodes(t.sections)).groupBy("doc_id", "section_id").agg(F.count("*").alias("nodes"))


@catalog.add("analyze_office", f"""SELECT *, CASE WHEN char_count = 0 AND image_count = 0 THEN 'empty' WHEN image_count > 0 AND char_count < 50 THEN 'image-only' WHEN char_count >= 20 AND image_count > 0 THEN 'mixed' WHEN char_count >= 20 THEN 'text-only' ELSE 'empty' END AS kind FROM (
    SELECT doc_id, unit_index, sum(CASE WHEN type NOT IN ('text', 'note', 'image') THEN coalesce(length(regexp_replace(text, '{WS}', '', 'g')), 0) ELSE 0 END) AS char_count, count(*) FILTER (type = 'image') AS image_count, bool_or(type = 'note') AS has_notes, arg_min(text, preorder) FILTER (type = 'heading') AS heading FROM {_NODES} GROUP BY 1, 2)""")
def analyze_office(t):
    return nd.analyze_units(nd.section_nodes(t.sections))


@catalog.add("extract_office", f"SELECT doc_id, string_agg(text, chr(10) || chr(10) ORDER BY unit_index) AS text FROM (SELECT doc_id, unit_index, string_agg(t, chr(10) ORDER BY preorder) AS text FROM (SELECT *, {_TRIM} AS t FROM {_NODES} WHERE type NOT IN ('text', 'note')) WHERE length(t) > 0 GROUP BY 1, 2) GROUP BY doc_id")
def extract_office(t):
    u = nd.nodes_text(nd.section_nodes(t.sections)).where("text <> ''")
    return u.groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("unit_index", "text"))), lambda x: x["text"]), "\n\n").alias("text"))


@catalog.add("office_slide_sheet_filter", "SELECT doc_id, section_index, heading FROM sections WHERE section_index IN (0, 2, 4)")
def office_slide_sheet_filter(t):
    wanted = t.spark.createDataFrame([(0,), (2,), (4,)], "section_index int")
    return t.sections.join(wanted, "section_index", "left_semi").select("doc_id", "section_index", "heading")


@catalog.add("embedded_images", f"SELECT doc_id, unit_index, list('unit-' || unit_index || '-' || r) AS ids FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, unit_index ORDER BY preorder) - 1 AS r FROM {_NODES} WHERE type = 'image') GROUP BY 1, 2")
def embedded_images(t):
    images = nd.find_nodes(nd.section_nodes(t.sections), "image").groupBy("doc_id", "unit_index").agg(F.sort_array(F.collect_list("preorder")).alias("p"))
    return images.select("doc_id", "unit_index", F.transform("p", lambda _, i: F.concat(F.lit("unit-"), F.col("unit_index").cast("string"), F.lit("-"), i.cast("string"))).alias("ids"))


# --- web pages made of documents ---------------------------------------------------------------

_HTML = "('<!DOCTYPE html><html lang=\"' || coalesce(lang, 'und') || '-XX\"><head><title> ' || coalesce(file_key, '') || ' </title></head><body><nav>menu</nav><article><p>' || replace(replace(replace(coalesce(text, ''), '&', '&amp;'), '<', '&lt;'), chr(10), '<br>') || '</p><img src=\"x.png\"><table><tr><td>1</td></tr></table></article></body></html>')"


def _pages(t):
    html = F.concat(F.lit('<!DOCTYPE html><html lang="'), F.coalesce("lang", F.lit("und")), F.lit('-XX"><head><title> '), F.coalesce("file_key", F.lit("")), F.lit(" </title></head><body><nav>menu</nav><article><p>"), F.replace(F.replace(F.replace(F.coalesce("text", F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit("\n"), F.lit("<br>")), F.lit('</p><img src="x.png"><table><tr><td>1</td></tr></table></article></body></html>'))
    return t.documents.select("doc_id", html.alias("html"))


@catalog.add("parse_html", f"SELECT doc_id, trim(regexp_extract(h, '(?is)<title[^>]*>(.*?)</title>', 1)) AS title, coalesce(nullif(lower(split_part(regexp_extract(h, '(?is)<html[^>]*\\blang\\s*=\\s*[\"'']?([A-Za-z0-9-]+)', 1), '-', 1)), ''), 'und') AS language, len(regexp_extract_all(h, '(?i)<img[\\s/>]')) AS images, len(regexp_extract_all(h, '(?i)<table[\\s/>]')) AS tables FROM (SELECT doc_id, {_HTML} AS h FROM documents)")
def parse_html(t):
    h = F.col("html")
    return _pages(t).select("doc_id", ht.title_of(h).alias("title"), ht.language_of(h).alias("language"), ht.count_elements(h, "img").alias("images"), ht.count_elements(h, "table").alias("tables"))


@catalog.add("html_lang", f"SELECT doc_id, coalesce(nullif(lower(split_part(regexp_extract(h, '(?is)<html[^>]*\\blang\\s*=\\s*[\"'']?([A-Za-z0-9-]+)', 1), '-', 1)), ''), 'und') AS language FROM (SELECT doc_id, {_HTML} AS h FROM documents)")
def html_lang(t):
    return _pages(t).select("doc_id", ht.language_of(F.col("html")).alias("language"))


# what a page's article must become: lines with their white space folded, an image, a table
_LINES = f"array_to_string(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_replace(x, '{WS}+', ' ', 'g')), chr(10))"
_TIDY = f"regexp_replace(regexp_replace({_LINES} || chr(10) || chr(10) || '![](x.png)' || chr(10) || chr(10) || '| 1 |' || chr(10) || '| --- |', '[ \\t]+\\n', chr(10), 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g')"


@catalog.add("html_to_markdown", f"SELECT doc_id, regexp_replace({_TIDY}, '^{WS}+', '') AS markdown FROM documents")
def html_to_markdown(t):
    return _pages(t).select("doc_id", ht.markdown("html").alias("markdown"))


# --- streams -----------------------------------------------------------------------------------


def echo_tail(context: str, text: str) -> str:
    """Stand-in for a model: the text, marked where it continues another."""
    return ("… " if context else "") + text


@catalog.add("stream_usage", "SELECT experiment, count(*) AS calls, sum(tokens.input) AS input, sum(tokens.output) AS output FROM journal GROUP BY experiment")
def stream_usage(t):
    stream = st.usage(st.read_table_stream(t.spark, t.directory, "journal"))
    return st.latest(st.run_available(stream, "update", "usage"), ["experiment"])


# what goes before a page is the end of the output before it, which is empty only until the first page with text
_ECHO = """WITH p AS (SELECT doc_id, page_index, coalesce(text, '') AS text, coalesce(sum(CASE WHEN length(text) > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY page_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) > 0 AS has FROM ocr_pages),
    o AS (SELECT doc_id, page_index, CASE WHEN has THEN '… ' ELSE '' END || text AS output FROM p)
    SELECT doc_id, page_index, coalesce(right(lag(output) OVER (PARTITION BY doc_id ORDER BY page_index), 200), '') AS context, output FROM o"""


@catalog.add("stateful_continuity", _ECHO)
def stateful_continuity(t):
    return st.continuity_batch(t.ocr_pages, echo_tail)


@catalog.add("stream_continuity", _ECHO)
def stream_continuity(t):
    return st.run_available(st.continuity(st.read_table_stream(t.spark, t.directory, "ocr_pages"), echo_tail), "append", "continuity").drop("batch")


@catalog.add("page_stream", """WITH f AS (SELECT *, min(CASE WHEN text IS NULL THEN page_index END) OVER (PARTITION BY doc_id) AS failed FROM ocr_pages), p AS (SELECT * FROM f WHERE failed IS NULL OR page_index <= failed)
    SELECT doc_id, page_index, 0 AS step, 'unit-start' AS event_type, NULL AS chars FROM p UNION ALL SELECT doc_id, page_index, 1, CASE WHEN text IS NULL THEN 'error' ELSE 'content' END, length(text) FROM p UNION ALL SELECT doc_id, page_index, 2, 'unit-done', NULL FROM p WHERE text IS NOT NULL""")
def page_stream(t):
    return st.page_events(t.ocr_pages)


@catalog.add("vision_stream", """SELECT doc_id, page_index, 0 AS step, 'unit-start' AS event_type, NULL AS chars FROM ocr_pages UNION ALL SELECT doc_id, page_index, 1, CASE WHEN text IS NULL THEN 'error' ELSE 'content' END, length(text) FROM ocr_pages UNION ALL SELECT doc_id, page_index, 2, 'unit-done', NULL FROM ocr_pages WHERE text IS NOT NULL""")
def vision_stream(t):
    """The same events where a failed unit doesn't stop its document."""
    return st.page_events(t.ocr_pages, abort=False)
