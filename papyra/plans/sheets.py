"""Queries that treat relational tables as sheets: cell types and text forms; office units."""

from __future__ import annotations

from pyspark.sql import functions as F

from papyra import fixed
from papyra.functions import cells as ce
from papyra.plans.registry import Catalog

catalog = Catalog()
_WS = fixed.WS


def _sheet(t):
    """A sheet for each order, of its few lines: rows of part, price, status, with odd cells."""
    c = t.lineitem
    odd = F.col("l_partkey") % 7 == 0
    row = F.array(F.concat(F.lit("part "), F.col("l_partkey").cast("string")), F.round("l_extendedprice", 2).cast("decimal(18,2)").cast("string"), F.concat(F.col("l_linestatus"), F.when(odd, ', "x|y"\n').otherwise("")), F.when(F.col("l_partkey") % 5 == 0, F.lit(None).cast("string")).otherwise(F.col("l_partkey").cast("string")))
    g = c.groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_extendedprice", "l_linestatus", row.alias("r")))), lambda x: x["r"]).alias("rows"))
    return g.select("l_orderkey", F.concat(F.array(F.array(F.lit("name"), F.lit("balance"), F.lit("segment"), F.lit(None).cast("string"))), "rows").alias("rows"))


_SHEET = """(SELECT l_orderkey, list_concat([['name', 'balance', 'segment', NULL]], list(['part ' || l_partkey, CAST(CAST(round(l_extendedprice, 2) AS DECIMAL(18,2)) AS VARCHAR), l_linestatus || CASE WHEN l_partkey % 7 = 0 THEN ', "x|y"' || chr(10) ELSE '' END, CASE WHEN l_partkey % 5 <> 0 THEN CAST(l_partkey AS VARCHAR) END] ORDER BY l_linenumber, l_partkey, l_extendedprice, l_linestatus)) AS rows FROM lineitem GROUP BY l_orderkey)"""
_CSV = """CASE WHEN contains(coalesce({c}, ''), ',') OR regexp_matches(coalesce({c}, ''), '["\\n\\r]') THEN '"' || replace(coalesce({c}, ''), '"', '""') || '"' ELSE coalesce({c}, '') END"""
_TSV = "regexp_replace(replace(coalesce({c}, ''), chr(9), ' '), '\\r\\n|\\n|\\r', '\\\\n', 'g')"
_MD = "regexp_replace(replace(replace(coalesce({c}, ''), '|', '\\|'), chr(10), ' '), '^" + _WS + "+|" + _WS + "+$', '', 'g')"


@catalog.add("sheet_csv", f"SELECT l_orderkey, array_to_string(list_transform(rows, lambda r: array_to_string(list_transform(r, lambda c: {_CSV.format(c='c')}), ',')), chr(10)) AS csv FROM {_SHEET}")
def sheet_csv(t):
    return _sheet(t).select("l_orderkey", ce.sheet_csv(F.col("rows")).alias("csv"))


@catalog.add("sheet_tsv", f"SELECT l_orderkey, array_to_string(list_transform(rows, lambda r: array_to_string(list_transform(r, lambda c: {_TSV.format(c='c')}), chr(9))), chr(10)) AS tsv FROM {_SHEET}")
def sheet_tsv(t):
    return _sheet(t).select("l_orderkey", ce.sheet_tsv(F.col("rows")).alias("tsv"))


@catalog.add("sheet_md", f"SELECT l_orderkey, array_to_string(list_concat(['| ' || array_to_string(list_transform(rows[1], lambda c: {_MD.replace('{c}', 'c')}), ' | ') || ' |', '| :--- | :--- | :--- | :--- |'], list_transform(rows[2:], lambda r: '| ' || array_to_string(list_transform(r, lambda c: {_MD.replace('{c}', 'c')}), ' | ') || ' |')), chr(10)) AS markdown FROM {_SHEET}")
def sheet_md(t):
    return _sheet(t).select("l_orderkey", ce.sheet_markdown(F.col("rows")).alias("markdown"))


@catalog.add("sheet_text", f"SELECT l_orderkey, array_to_string(list_transform(rows, lambda r: array_to_string(list_transform(r, lambda c: coalesce(c, '')), ' ')), chr(10)) AS text FROM {_SHEET}")
def sheet_text(t):
    return _sheet(t).select("l_orderkey", ce.sheet_text(F.col("rows")).alias("text"))


@catalog.add("render_headers_json", f"SELECT l_orderkey, CAST(to_json(list_transform(rows[2:], lambda r: {{'name': r[1], 'balance': r[2], 'segment': r[3], 'column_3': r[4]}})) AS VARCHAR) AS json FROM {_SHEET}")
def render_headers_json(t):
    return _sheet(t).select("l_orderkey", ce.sheet_objects(F.col("rows")).alias("json"))


@catalog.add("infer_cell", f"SELECT o_orderkey, CASE WHEN regexp_replace(x, '{_WS}', '', 'g') = '' THEN 'null' WHEN regexp_matches(x, '{ce.NUMBER}') THEN 'number' WHEN x IN ('true', 'false') THEN 'boolean' ELSE 'string' END AS type FROM (SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN CAST(o_custkey AS VARCHAR) WHEN 1 THEN '0' || o_custkey WHEN 2 THEN o_custkey || '.5' WHEN 3 THEN o_custkey || '.0' WHEN 4 THEN 'true' ELSE ' ' END AS x FROM orders)")
def infer_cell(t):
    k, c = F.col("o_orderkey") % 6, F.col("o_custkey").cast("string")
    x = F.when(k == 0, c).when(k == 1, F.concat(F.lit("0"), c)).when(k == 2, F.concat(c, F.lit(".5"))).when(k == 3, F.concat(c, F.lit(".0"))).when(k == 4, "true").otherwise(" ")
    return t.orders.select("o_orderkey", ce.cell_type(x).alias("type"))


@catalog.add("table_data", "SELECT l_orderkey, l_linenumber, [CAST(l_partkey AS VARCHAR), CAST(CAST(l_quantity AS BIGINT) AS VARCHAR), l_returnflag, nullif(l_linestatus, 'O')] AS cells FROM lineitem")
def table_data(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", F.array(F.col("l_partkey").cast("string"), F.col("l_quantity").cast("bigint").cast("string"), "l_returnflag", F.nullif("l_linestatus", F.lit("O"))).alias("cells"))


@catalog.add("text_csv", f"SELECT doc_id, array_to_string(CASE WHEN format = 'xlsx' THEN list_transform(string_split_regex(text, '\\r?\\n'), lambda x: array_to_string(list_transform(string_split(x, chr(9)), lambda c: {_CSV.format(c='c')}), ',')) ELSE list_transform(string_split_regex(text, '\\r?\\n'), lambda x: {_CSV.format(c='x')}) END, chr(10)) AS csv FROM documents")
def text_csv(t):
    return t.documents.select("doc_id", ce.text_csv(F.col("text"), F.coalesce(F.col("format") == "xlsx", F.lit(False))).alias("csv"))


@catalog.add("text_tsv", f"SELECT doc_id, CASE WHEN format = 'xlsx' THEN text ELSE array_to_string(list_transform(string_split_regex(text, '\\r?\\n'), lambda x: {_TSV.format(c='x')}), chr(10)) END AS tsv FROM documents")
def text_tsv(t):
    return t.documents.select("doc_id", ce.text_tsv(F.col("text"), F.coalesce(F.col("format") == "xlsx", F.lit(False))).alias("tsv"))


@catalog.add("doc_md", "SELECT doc_id, concat_ws(chr(10), '# ' || file_key || chr(10), nullif(concat_ws(' | ', '**Author:** ' || source, '**Created:** ' || strftime(fetched_at, '%Y-%m-%d')), '') || chr(10) || chr(10) || '---' || chr(10), text, CASE WHEN unit_count > 2 THEN chr(10) || '---' || chr(10) || chr(10) || '> **Note:** ' || unit_count || ' error(s) occurred during extraction.' END) AS markdown FROM documents")
def doc_md(t):
    return t.documents.select("doc_id", ce.doc_markdown(F.col("file_key"), F.col("source"), F.col("fetched_at"), F.col("text"), F.when(F.col("unit_count") > 2, F.col("unit_count")).otherwise(0)).alias("markdown"))


@catalog.add("sink_json", "SELECT doc_id, CAST(to_json({'doc_id': doc_id, 'text': text, 'source': source, 'unit_count': unit_count}) AS VARCHAR) AS json FROM documents")
def sink_json(t):
    return t.documents.select("doc_id", F.to_json(F.struct("doc_id", "text", "source", "unit_count"), {"ignoreNullFields": "false"}).alias("json"))


@catalog.add("sink_text", "SELECT doc_id, CASE WHEN ends_with(text, chr(10)) THEN text ELSE text || chr(10) END AS text FROM documents")
def sink_text(t):
    return t.documents.select("doc_id", F.when(F.endswith("text", F.lit("\n")), F.col("text")).otherwise(F.concat("text", F.lit("\n"))).alias("text"))


@catalog.add("sink_vision", "SELECT doc_id, string_agg(text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY page_index) AS text FROM (SELECT DISTINCT ON (doc_id, page_index) doc_id, page_index, text FROM ocr_pages WHERE text IS NOT NULL) GROUP BY doc_id")
def sink_vision(t):
    p = t.ocr_pages.where("text is not null").dropDuplicates(["doc_id", "page_index"])
    return p.groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("page_index", "text"))), lambda x: x["text"]), "\n\n---\n\n").alias("text"))


_RANGE = "(SELECT doc_id, section_index, CASE section_index % 4 WHEN 0 THEN '1-5,7' WHEN 1 THEN '5-3' WHEN 2 THEN 'x,2' ELSE '3abc, 1-2,9-99' END AS x, 6 AS n FROM sections)"


@catalog.add("parse_slide_range", f"""SELECT doc_id, section_index, coalesce(list_sort(list_distinct(flatten(list_transform(list_filter(string_split(x, ','), lambda p: regexp_matches(split_part(p, '-', 1), '^\\s*\\d') AND regexp_matches(CASE WHEN contains(p, '-') THEN split_part(p, '-', 2) ELSE p END, '^\\s*\\d')), lambda p: list_transform(range(greatest(1, CAST(nullif(regexp_extract(split_part(p, '-', 1), '^\\s*(\\d+)', 1), '') AS INT)),
    1 + least(n, CAST(nullif(regexp_extract(CASE WHEN contains(p, '-') THEN split_part(p, '-', 2) ELSE p END, '^\\s*(\\d+)', 1), '') AS INT))), lambda i: CAST(i - 1 AS INT)))))), []) AS slides FROM {_RANGE}""")
def parse_slide_range(t):
    k = F.col("section_index") % 4
    x = F.when(k == 0, "1-5,7").when(k == 1, "5-3").when(k == 2, "x,2").otherwise("3abc, 1-2,9-99")
    return t.sections.select("doc_id", "section_index", ce.slide_range(x, F.lit(6)).alias("slides"))


@catalog.add("filter_sheets", "SELECT doc_id, section_index, list_contains(list_transform(string_split(' DOCX, pptx ', ','), lambda x: lower(trim(x))), lower(trim(format))) AS wanted FROM sections")
def filter_sheets(t):
    return t.sections.select("doc_id", "section_index", ce.sheet_wanted(F.col("format"), F.lit(" DOCX, pptx ")).alias("wanted"))
