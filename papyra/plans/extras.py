"""Queries of sources, sinks, sorting and model calls that have no table family of their own."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from papyra.functions import language as la
from papyra.functions.errors import error_class, pairs_of, redacted
from papyra.operators import calls as ca
from papyra.operators import runs as op
from papyra.plans.journal import _CATEGORY
from papyra.plans.registry import Catalog
from papyra.plans.runs import _UNITS, _units
from papyra.sources import images as im
from papyra.sources import pdf
from papyra.streaming import streams as st

catalog = Catalog()

_SCORES = {code: f"len(list_filter(w, lambda x: x IN ({', '.join(repr(x) for x in own)})))" for code, own in la.FUNCTION_WORDS.items()}
_SCRIPTS = " ".join(f"WHEN (length(text) - length(regexp_replace(text, '{s}', '', 'g')))::DOUBLE / length(text) > 0.2 THEN '{c}'" for c, s in la.SCRIPTS)


@catalog.add("detect_language", f"""SELECT doc_id, CASE WHEN coalesce(length(text), 0) < {la.LEAST_CHARS} THEN 'und' {_SCRIPTS} WHEN greatest({', '.join(_SCORES)}) = 0 THEN 'und' {' '.join(f'WHEN {c} = greatest({", ".join(_SCORES)}) THEN {c!r}' for c in _SCORES)} END AS language
    FROM (SELECT doc_id, text, {', '.join(f'{s} AS {c}' for c, s in _SCORES.items())} FROM (SELECT doc_id, text, string_split_regex(lower(text), '[^\\p{{L}}]+') AS w FROM documents))""")
def detect_language(t):
    return t.documents.select("doc_id", la.detect_language(F.col("text")).alias("language"))


@catalog.add("src_bytes", "SELECT doc_id, octet_length(encode(text)) AS bytes FROM documents")
def src_bytes(t):
    return t.documents.select("doc_id", F.octet_length(F.col("text").cast("binary")).alias("bytes"))


@catalog.add("parse_image", "SELECT doc_id, page_index, 'svg' AS format, CAST(floor(width_pt) AS INT) AS width, CAST(floor(height_pt) AS INT) AS height FROM pdf_pages")
def parse_image(t):
    svg = F.concat(F.lit('<svg xmlns="x" viewBox="0 0 '), F.floor("width_pt").cast("string"), F.lit(" "), F.floor("height_pt").cast("string"), F.lit('"></svg>')).cast("binary")
    return im.with_size(t.pdf_pages.select("doc_id", "page_index", svg.alias("content"))).drop("content")


@catalog.add("parse_pdf", "SELECT CAST(doc_id AS VARCHAR) || '/' || page_index AS path, 0 AS page_index, width_pt, height_pt, 'Page ' || page_index || ' of file ' || doc_id AS text FROM pdf_pages")
def parse_pdf(t):
    """A file of one page for each page, written as plain PDF and read back."""
    text = F.concat(F.lit("Page "), F.col("page_index").cast("string"), F.lit(" of file "), F.col("doc_id").cast("string"))
    body = F.concat(F.lit("%PDF-1.4\n1 0 obj << /Type /Page /MediaBox [0 0 "), F.col("width_pt").cast("string"), F.lit(" "), F.col("height_pt").cast("string"), F.lit("] /Contents 2 0 R >> endobj\n2 0 obj << >> stream\nBT ("), text, F.lit(") Tj ET\nendstream endobj\n"))
    files = t.pdf_pages.select(F.concat_ws("/", F.col("doc_id").cast("string"), F.col("page_index").cast("string")).alias("path"), body.cast("binary").alias("content"))
    return pdf.parse_files(files).select("path", "page_index", "width_pt", "height_pt", "text")


@catalog.add("free_tier", "SELECT provider, id FROM models WHERE pricing.input = 0 AND pricing.output = 0")
def free_tier(t):
    return t.models.where("pricing.input = 0 and pricing.output = 0").select("provider", "id")


@catalog.add("complexity_attrs", f"SELECT doc_id, list_sort(list_filter(['pages=' || count(*), 'errors=' || nullif(count(error), 0), 'language=' || min(language)], lambda e: e IS NOT NULL)) AS attrs FROM {_UNITS} GROUP BY doc_id")
def complexity_attrs(t):
    g = _units(t).groupBy("doc_id").agg(F.count("*").cast("string").alias("p"), F.nullif(F.count("error"), F.lit(0)).cast("string").alias("e"), F.min("language").alias("l"))
    return g.select("doc_id", pairs_of(F.create_map(F.lit("pages"), "p", F.lit("errors"), "e", F.lit("language"), "l")).alias("attrs"))


@catalog.add("counter", f"SELECT provider, coalesce(category, 'success') AS category, count(*) AS n FROM (SELECT lower(trim(provider)) AS provider, CASE WHEN error IS NOT NULL THEN {_CATEGORY} END AS category FROM journal) GROUP BY 1, 2")
def counter(t):
    """Calls by provider and outcome: success, or the category of the error."""
    outcome = F.when(F.col("error").isNotNull(), error_class(F.col("error"))["category"])
    return t.journal.groupBy(F.lower(F.trim("provider")).alias("provider"), F.coalesce(outcome, F.lit("success")).alias("category")).agg(F.count("*").alias("n"))


@catalog.add("sort_units", f"SELECT doc_id, list(unit_index ORDER BY unit_index) AS units FROM {_UNITS} GROUP BY doc_id")
def sort_units(t):
    return _units(t).groupBy("doc_id").agg(F.sort_array(F.collect_list("unit_index")).alias("units"))


@catalog.add("section_id", "SELECT doc_id, section_index, CAST(sum(CASE WHEN level = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY section_index) AS INT) AS section_id FROM (SELECT DISTINCT ON (doc_id, section_index) * FROM sections)")
def section_id(t):
    w = Window.partitionBy("doc_id").orderBy("section_index").rowsBetween(Window.unboundedPreceding, 0)
    return t.sections.select("doc_id", "section_index", F.sum(F.when(F.col("level") == 1, 1).otherwise(0)).over(w).cast("int").alias("section_id"))


@catalog.add("office_document", "SELECT doc_id, count(*) AS units, min(format) AS format, sum(len(coalesce(lines, []))) AS lines, count(*) FILTER (heading IS NOT NULL AND heading <> '') AS headings FROM (SELECT DISTINCT ON (doc_id, section_index) * FROM sections) GROUP BY doc_id")
def office_document(t):
    s = t.sections
    return s.groupBy("doc_id").agg(F.count("*").alias("units"), F.min("format").alias("format"), F.sum(F.size(F.coalesce("lines", F.array().cast("array<string>")))).alias("lines"), F.count_if(F.length("heading") > 0).alias("headings"))


@catalog.add("extract_by_run", "SELECT r.doc_id, r.run_index, count(p.page_index) AS pages, sum(length(p.text_sample)) AS characters FROM (SELECT DISTINCT ON (doc_id, run_index) * FROM runs) r JOIN (SELECT DISTINCT ON (doc_id, page_index) * FROM pdf_pages) p ON r.doc_id = p.doc_id AND list_contains(r.page_indices, p.page_index) GROUP BY 1, 2")
def extract_by_run(t):
    runs = t.runs.select("doc_id", "run_index", F.explode("page_indices").alias("page_index"))
    pages = t.pdf_pages.select("doc_id", "page_index", "text_sample")
    return runs.join(pages, ["doc_id", "page_index"]).groupBy("doc_id", "run_index").agg(F.count("*").alias("pages"), F.sum(F.length("text_sample")).alias("characters"))


@catalog.add("redact", "SELECT id, list_sort(list_filter(['id=' || id, 'model=' || model, 'request.model=' || model, 'input.lines=3'], lambda e: e IS NOT NULL)) AS attrs FROM journal")
def redact(t):
    """A log record of each call with everything that may hold a secret or a person removed."""
    hidden = ("password", "apiKey", "user.email", "req.headers.authorization", "input.content", "request.accessToken", "recipient")
    pairs = [F.lit("id"), F.col("id"), F.lit("model"), F.col("model"), F.lit("request.model"), F.col("model"), F.lit("input.lines"), F.lit("3")]
    attrs = F.create_map(*pairs, *[x for k in hidden for x in (F.lit(k), F.col("provider"))])
    return t.journal.select("id", pairs_of(redacted(attrs)).alias("attrs"))


@catalog.add("progress_events", f"SELECT doc_id, unit_index, CASE WHEN error IS NULL THEN 'unit-done' ELSE 'unit-error' END AS event_type FROM {_UNITS}")
def progress_events(t):
    return _units(t).select("doc_id", "unit_index", F.when(F.col("error").isNull(), "unit-done").otherwise("unit-error").alias("event_type"))


@catalog.add("journal_jsonl", "SELECT id, experiment, tokens.output AS output_tokens FROM journal")
def journal_jsonl(t):
    """The journal appended to a folder of JSON lines, and read back."""
    folder = st.shared_folder(t.spark, "journal")
    t.journal.select("id", "experiment", F.col("tokens.output").alias("output_tokens")).write.mode("append").json(folder)
    return t.spark.read.schema("id string, experiment string, output_tokens long").json(folder)


def flaky(context: str, text: str) -> str:
    """Stand-in for a model that fails on some pages."""
    if len(text) % 11 == 0:
        raise RuntimeError("429 rate limit")
    if len(text) % 13 == 0:
        raise RuntimeError("400 bad request")
    return f"<{text}>"


# a client that fails by the length of a page: pages of a multiple of 11 ask to come again and fail again, of 13 fail at once
_FLAKY = """SELECT doc_id, page_index, CASE WHEN n % 11 <> 0 AND n % 13 <> 0 THEN '<' || text || '>' END AS output, CASE WHEN n % 11 = 0 THEN 2 ELSE 1 END AS attempts,
    CASE WHEN n % 11 = 0 THEN 'RuntimeError: 429 rate limit' WHEN n % 13 = 0 THEN 'RuntimeError: 400 bad request' END AS error, n % 11 = 0 AS retryable FROM (SELECT doc_id, page_index, coalesce(text, '') AS text, coalesce(length(text), 0) AS n FROM ocr_pages)"""


@catalog.add("llm_format", _FLAKY)
def llm_format(t):
    return ca.format_pages(t.ocr_pages, flaky, retries=1, wait=False)


@catalog.add("audit_log", "SELECT id, 'model.call' AS event, CASE WHEN error IS NULL THEN 'success' ELSE 'failure' END AS outcome, ts FROM journal")
def audit_log(t):
    return t.journal.select("id", F.lit("model.call").alias("event"), F.when(F.col("error").isNull(), "success").otherwise("failure").alias("outcome"), "ts")


@catalog.add("error_counts", f"SELECT category, count(*) AS n FROM (SELECT {_CATEGORY} AS category FROM journal WHERE error IS NOT NULL) GROUP BY category")
def error_counts(t):
    return t.journal.where("error is not null").groupBy(error_class(F.col("error"))["category"].alias("category")).agg(F.count("*").alias("n"))
