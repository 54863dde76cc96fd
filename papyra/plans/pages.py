"""Queries over pages and texts: statistics, geometry, classification."""

from __future__ import annotations

from pyspark.sql import functions as F

from papyra import fixed
from papyra.functions import classify as cl
from papyra.functions import geometry as geo
from papyra.functions import text as tx
from papyra.functions import tokens as tk
from papyra.plans.registry import Catalog, sql_case

catalog = Catalog()
WS, CJK = fixed.WS, fixed.CJK


def _trim(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


@catalog.add("char_count", f"SELECT doc_id, coalesce(length(regexp_replace(text, '{WS}', '', 'g')), 0) AS char_count FROM documents")
def char_count(t):
    return t.documents.select("doc_id", tx.char_count(F.col("text")).alias("char_count"))


@catalog.add("text_sample", "SELECT doc_id, substring(text, 1, 400) AS text_sample FROM documents")
def text_sample(t):
    return t.documents.select("doc_id", tx.text_sample(F.col("text")).alias("text_sample"))


@catalog.add("normalize_ws", f"SELECT doc_id, {_trim(f"regexp_replace(text, '{WS}+', ' ', 'g')")} AS text FROM documents")
def normalize_ws(t):
    return t.documents.select("doc_id", tx.normalize_ws(F.col("text")).alias("text"))


@catalog.add("markdown_tidy", f"SELECT doc_id, {_trim(r"regexp_replace(text, '\n{3,}', chr(10) || chr(10), 'g')")} AS text FROM documents")
def markdown_tidy(t):
    return t.documents.select("doc_id", tx.markdown_tidy(F.col("text")).alias("text"))


@catalog.add("prepend_title", "SELECT doc_id, CASE WHEN source IS NULL OR source = '' OR starts_with(text, '# ' || source) THEN text ELSE '# ' || source || chr(10) || chr(10) || text END AS text FROM documents")
def prepend_title(t):
    return t.documents.select("doc_id", tx.prepend_title(F.col("text"), F.col("source")).alias("text"))


@catalog.add("has_cjk", f"SELECT doc_id, page_index, coalesce(regexp_matches(text_sample, '{CJK}'), false) AS has_cjk FROM pdf_pages")
def has_cjk(t):
    return t.pdf_pages.select("doc_id", "page_index", tx.has_cjk(F.col("text_sample")).alias("has_cjk"))


_CJK_N = f"(length(text) - length(regexp_replace(text, '{CJK}', '', 'g')))"


@catalog.add("is_cjk_heavy", f"SELECT doc_id, length(text) > 0 AND {_CJK_N}::DOUBLE / nullif(length(text), 0) > 0.3 AS cjk_heavy FROM documents")
def is_cjk_heavy(t):
    return t.documents.select("doc_id", tx.is_cjk_heavy(F.col("text")).alias("cjk_heavy"))


_SENT = r"'[.!?][ \t\n\r\f\x0B]'"


@catalog.add("previous_tail", rf"""
    WITH x AS (SELECT doc_id, text, right(text, 200) AS t FROM documents),
    y AS (SELECT *, strpos(t, chr(10) || chr(10)) AS p, CASE WHEN regexp_matches(t, {_SENT}) THEN length(regexp_extract(t, '(?s)^(.*?)[.!?][ \t\n\r\f\x0B]', 1)) END AS s,
        CASE WHEN strpos(substr(t, 11), ' ') > 0 THEN strpos(substr(t, 11), ' ') + 10 ELSE 0 END AS w FROM x)
    SELECT doc_id, CASE WHEN length(text) <= 200 THEN text ELSE {_trim("CASE WHEN p > 0 AND p - 1 < 100 THEN substr(t, p + 2) WHEN s < 60 THEN substr(t, s + 3) WHEN w > 0 AND w - 1 < 40 THEN substr(t, w + 1) ELSE t END")} END AS tail FROM y""")
def previous_tail(t):
    return t.documents.select("doc_id", tx.previous_tail(F.col("text")).alias("tail"))


@catalog.add("experiment_slug", "SELECT DISTINCT experiment, substring(regexp_replace(regexp_replace(regexp_replace(lower(experiment), '[^a-z0-9_-]', '-', 'g'), '-+', '-', 'g'), '^-|-$', '', 'g'), 1, 100) AS slug FROM journal")
def experiment_slug(t):
    return t.journal.select("experiment", tx.experiment_slug(F.col("experiment")).alias("slug")).distinct()


@catalog.add("safe_label", "SELECT doc_id, page_index, substring(regexp_replace(label, '[\\r\\n]+', ' ', 'g'), 1, 100) AS label FROM pdf_pages")
def safe_label(t):
    return t.pdf_pages.select("doc_id", "page_index", tx.safe_label(F.col("label")).alias("label"))


@catalog.add("unit_label", "SELECT doc_id, section_index, CASE WHEN format = 'pptx' THEN 'Slide ' || (section_index + 1) WHEN heading IS NOT NULL AND heading <> '' THEN substring(heading, 1, 50) ELSE 'Section ' || (section_index + 1) END AS analysis_label, CASE WHEN format = 'pptx' THEN 'Slide ' ELSE 'Section ' END || (section_index + 1) AS pipeline_label FROM sections")
def unit_label(t):
    n = (F.col("section_index") + 1).cast("string")
    slide, section = F.concat(F.lit("Slide "), n), F.concat(F.lit("Section "), n)
    analysis = F.when(F.col("format") == "pptx", slide).when(F.length("heading") > 0, F.substring("heading", 1, 50)).otherwise(section)
    return t.sections.select("doc_id", "section_index", analysis.alias("analysis_label"), F.when(F.col("format") == "pptx", slide).otherwise(section).alias("pipeline_label"))


@catalog.add("image_placeholder", "SELECT doc_id, page_index, '[Image: ' || label || ' (' || CAST(round(width_pt) AS BIGINT) || 'x' || CAST(round(height_pt) AS BIGINT) || ' PNG)]' AS text, 0 AS char_count FROM pdf_pages WHERE large_image_count > 0")
def image_placeholder(t):
    text = F.concat(F.lit("[Image: "), F.col("label"), F.lit(" ("), F.round("width_pt").cast("bigint").cast("string"), F.lit("x"), F.round("height_pt").cast("bigint").cast("string"), F.lit(" PNG)]"))
    return t.pdf_pages.where("large_image_count > 0").select("doc_id", "page_index", text.alias("text"), F.lit(0).alias("char_count"))


@catalog.add("strip_text_placeholder", r"SELECT DISTINCT experiment, regexp_replace('Prompt for ' || experiment || chr(10) || 'Text:' || chr(10) || '{text}', '\s*([A-Za-z ]+:\s*)?\{text\}\s*$', '') AS prompt FROM journal")
def strip_text_placeholder(t):
    prompt = F.concat(F.lit("Prompt for "), F.col("experiment"), F.lit("\nText:\n{text}"))
    return t.journal.select("experiment", F.regexp_replace(prompt, r"\s*([A-Za-z ]+:\s*)?\{text\}\s*$", "").alias("prompt")).distinct()


_PT = "regexp_replace(CAST(CAST(round({}, 1) AS DECIMAL(18,1)) AS VARCHAR), '\\.0$', '')"


@catalog.add("paper_key", f"SELECT doc_id, page_index, {_PT.format('least(width_pt, height_pt)')} || 'x' || {_PT.format('greatest(width_pt, height_pt)')} AS paper_key FROM pdf_pages")
def paper_key(t):
    return t.pdf_pages.select("doc_id", "page_index", geo.paper_key(F.col("width_pt"), F.col("height_pt")).alias("paper_key"))


@catalog.add("orientation", "SELECT doc_id, page_index, CASE WHEN width_pt >= height_pt THEN 'landscape' ELSE 'portrait' END AS orientation FROM pdf_pages")
def orientation(t):
    return t.pdf_pages.select("doc_id", "page_index", geo.orientation(F.col("width_pt"), F.col("height_pt")).alias("orientation"))


_M = "[width_pt, 0.0, total_image_coverage, height_pt, 10.0, 20.0]"
_N = "[0.5, 0.1, 0.0, 2.0, 3.0, max_image_coverage]"


def _matrices():
    m = F.array(F.col("width_pt"), F.lit(0.0), F.col("total_image_coverage"), F.col("height_pt"), F.lit(10.0), F.lit(20.0))
    n = F.array(F.lit(0.5), F.lit(0.1), F.lit(0.0), F.lit(2.0), F.lit(3.0), F.col("max_image_coverage"))
    return m, n


@catalog.add("matrix_multiply", f"SELECT doc_id, page_index, [round(m[1]*n[1]+m[3]*n[2], 3), round(m[2]*n[1]+m[4]*n[2], 3), round(m[1]*n[3]+m[3]*n[4], 3), round(m[2]*n[3]+m[4]*n[4], 3), round(m[1]*n[5]+m[3]*n[6]+m[5], 3), round(m[2]*n[5]+m[4]*n[6]+m[6], 3)] AS product FROM (SELECT doc_id, page_index, {_M} AS m, {_N} AS n FROM pdf_pages)")
def matrix_multiply(t):
    m, n = _matrices()
    return t.pdf_pages.select("doc_id", "page_index", F.transform(geo.matrix_multiply(m, n), lambda x: F.round(x, 3)).alias("product"))


@catalog.add("parallelogram_area", "SELECT doc_id, page_index, round(abs(width_pt * height_pt - 0.0 * total_image_coverage), 4) AS area FROM pdf_pages")
def parallelogram_area(t):
    return t.pdf_pages.select("doc_id", "page_index", F.round(geo.parallelogram_area(_matrices()[0]), 4).alias("area"))


@catalog.add("bbox", "SELECT doc_id, page_index, 10.0::DOUBLE AS min_x, 20.0::DOUBLE AS min_y, round(10 + width_pt + greatest(total_image_coverage, 0), 4) AS max_x, round(20 + height_pt, 4) AS max_y FROM pdf_pages")
def bbox(t):
    b = geo.bbox(_matrices()[0])
    return t.pdf_pages.select("doc_id", "page_index", b["min_x"].alias("min_x"), b["min_y"].alias("min_y"), F.round(b["max_x"], 4).alias("max_x"), F.round(b["max_y"], 4).alias("max_y"))


@catalog.add("clamp01", "SELECT doc_id, page_index, greatest(0.0, least(1.0, total_image_coverage * 2 - 0.5)) AS x FROM pdf_pages")
def clamp01(t):
    return t.pdf_pages.select("doc_id", "page_index", geo.clamp01(F.col("total_image_coverage") * 2 - 0.5).alias("x"))


# two images, the second drawn within the first one's coordinates at half its width and height, a third after restoring
_DRAWN = "(SELECT doc_id, page_index, width_pt * height_pt AS area, width_pt * height_pt * coalesce(max_image_coverage, 0) AS a1, width_pt * height_pt * coalesce(max_image_coverage, 0) / 4 AS a2, width_pt * 10.0 AS a3 FROM pdf_pages)"


@catalog.add("image_coverage", f"""SELECT doc_id, page_index, round(greatest(least(a1 / area, 1.0), least(a2 / area, 1.0), least(a3 / area, 1.0)), 6) AS max_coverage,
    round(least(1.0, (CASE WHEN a1 / area >= {fixed.COUNTED_COVERAGE} THEN a1 ELSE 0 END + CASE WHEN a2 / area >= {fixed.COUNTED_COVERAGE} THEN a2 ELSE 0 END + CASE WHEN a3 / area >= {fixed.COUNTED_COVERAGE} THEN a3 ELSE 0 END) / area), 6) AS total_coverage,
    CAST((a1 / area >= {fixed.COUNTED_COVERAGE})::INT + (a2 / area >= {fixed.COUNTED_COVERAGE})::INT + (a3 / area >= {fixed.COUNTED_COVERAGE})::INT AS INT) AS large_images FROM {_DRAWN}""")
def image_coverage(t):
    """Drawing operations of each page with nested coordinates, folded to the page's statistics."""

    def matrix(x, y):
        return F.array(x, F.lit(0.0), F.lit(0.0), y, F.lit(3.0), F.lit(5.0))

    def op(name, m=None):
        return F.struct(F.lit(name).alias("op"), (m if m is not None else F.lit(None).cast("array<double>")).alias("matrix"))

    side = F.sqrt(F.coalesce("max_image_coverage", F.lit(0.0)))
    w, h = F.col("width_pt") * side, F.col("height_pt") * side
    ops = F.array(op("save"), op("transform", matrix(w, h)), op("paint"), op("transform", matrix(F.lit(0.5), F.lit(0.5))), op("paint"), op("restore"), op("transform", matrix(F.col("width_pt"), F.lit(10.0))), op("paint"))
    c = geo.image_coverage(ops, F.col("width_pt") * F.col("height_pt"))
    return t.pdf_pages.select("doc_id", "page_index", c.alias("c")).select("doc_id", "page_index", F.round("c.max_coverage", 6).alias("max_coverage"), F.round("c.total_coverage", 6).alias("total_coverage"), "c.large_images")


_EDGE = sql_case("kind", {k: str(v) for k, v in fixed.LONG_EDGE.items()}, "'1024'")
_CONTENT = sql_case("kind", fixed.PAGE_KIND, "'unknown'")


@catalog.add("adaptive_scale", f"SELECT doc_id, page_index, round(least(CAST({_EDGE} AS DOUBLE) / greatest(width_pt, height_pt), 3.0), 6) AS scale FROM (SELECT doc_id, page_index, width_pt, height_pt, {_CONTENT} AS kind FROM pdf_pages)")
def adaptive_scale(t):
    return t.pdf_pages.select("doc_id", "page_index", F.round(geo.adaptive_scale(cl.content_kind(F.col("kind")), F.col("width_pt"), F.col("height_pt")), 6).alias("scale"))


@catalog.add("resize_dims", "SELECT doc_id, page_index, CAST(floor(width_pt * s + 0.5) AS INT) AS width, CAST(floor(height_pt * s + 0.5) AS INT) AS height FROM (SELECT *, least(1.0, 600.0::DOUBLE / greatest(width_pt, height_pt)) AS s FROM pdf_pages)")
def resize_dims(t):
    d = geo.resize_dims(F.col("width_pt"), F.col("height_pt"), 600)
    return t.pdf_pages.select("doc_id", "page_index", d["width"].alias("width"), d["height"].alias("height"))


_PDF_KIND = "CASE WHEN c < 20 AND l = 0 THEN 'empty' WHEN c < 20 AND m >= 0.6 THEN 'scanned-image' WHEN c >= 20 AND m >= 0.1 THEN 'mixed' WHEN c >= 20 THEN 'born-digital' WHEN l > 0 THEN 'scanned-image' ELSE 'unknown' END"


@catalog.add("classify_pdf", f"SELECT doc_id, page_index, {_PDF_KIND} AS kind FROM (SELECT doc_id, page_index, coalesce(char_count, 0) AS c, coalesce(max_image_coverage, 0) AS m, coalesce(large_image_count, 0) AS l FROM pdf_pages)")
def classify_pdf(t):
    return t.pdf_pages.select("doc_id", "page_index", cl.classify_pdf(F.col("char_count"), F.col("max_image_coverage"), F.col("large_image_count")).alias("kind"))


@catalog.add("classify_office", "SELECT doc_id, page_index, CASE WHEN char_count = 0 AND image_op_count = 0 THEN 'empty' WHEN image_op_count > 0 AND char_count < 50 THEN 'image-only' WHEN char_count >= 20 AND image_op_count > 0 THEN 'mixed' WHEN char_count >= 20 THEN 'text-only' ELSE 'empty' END AS kind FROM pdf_pages")
def classify_office(t):
    return t.pdf_pages.select("doc_id", "page_index", cl.classify_office(F.col("char_count"), F.col("image_op_count")).alias("kind"))


@catalog.add("classify_coverage", "SELECT doc_id, page_index, CASE WHEN char_count < 20 AND max_image_coverage >= 0.6 THEN 'image-only' WHEN char_count >= 20 AND max_image_coverage >= 0.1 THEN 'mixed' WHEN char_count >= 20 THEN 'text-only' ELSE 'empty' END AS kind FROM pdf_pages")
def classify_coverage(t):
    return t.pdf_pages.select("doc_id", "page_index", cl.classify_coverage(F.col("char_count"), F.col("max_image_coverage")).alias("kind"))


@catalog.add("classify_html", "SELECT doc_id, page_index, CASE WHEN char_count = 0 AND image_op_count = 0 THEN 'empty' WHEN large_image_count > 0 AND char_count > 0 THEN 'tabular' WHEN char_count = 0 AND image_op_count > 0 THEN 'image-only' WHEN char_count > 0 AND image_op_count > 0 THEN 'mixed' ELSE 'text-only' END AS kind FROM pdf_pages")
def classify_html(t):
    return t.pdf_pages.select("doc_id", "page_index", cl.classify_html(F.col("char_count"), F.col("image_op_count"), F.col("large_image_count")).alias("kind"))


@catalog.add("classify_image", "SELECT doc_id, page_index, 'image-only' AS kind FROM ocr_pages")
def classify_image(t):
    return t.ocr_pages.select("doc_id", "page_index", F.lit("image-only").alias("kind"))


@catalog.add("kind_map", f"SELECT DISTINCT kind, {_CONTENT} AS content_kind, {sql_case(_CONTENT, fixed.CONTENT_KIND, "'unknown'")} AS page_kind FROM pdf_pages")
def kind_map(t):
    c = cl.content_kind(F.col("kind"))
    return t.pdf_pages.select("kind", c.alias("content_kind"), cl.page_kind(c).alias("page_kind")).distinct()


@catalog.add("describe_kind", f"SELECT doc_id, page_index, {sql_case('k', fixed.KIND_LABEL, "'Unknown content'")} AS label, k = 'image-only' AS requires_ocr, k IN ('image-only', 'mixed') AS may_benefit FROM (SELECT doc_id, page_index, {_CONTENT} AS k FROM pdf_pages)")
def describe_kind(t):
    k = cl.content_kind(F.col("kind"))
    return t.pdf_pages.select("doc_id", "page_index", cl.describe_kind(k).alias("label"), cl.requires_ocr(k).alias("requires_ocr"), cl.may_benefit_from_ocr(k).alias("may_benefit"))


@catalog.add("ocr_reliability", "SELECT doc_id, page_index, CASE WHEN confidence >= 0.95 THEN 'high' WHEN confidence >= 0.8 THEN 'medium' ELSE 'low' END AS reliability FROM ocr_pages")
def ocr_reliability(t):
    return t.ocr_pages.select("doc_id", "page_index", cl.ocr_reliability(F.col("confidence")).alias("reliability"))


@catalog.add("text_reliability", "SELECT doc_id, CASE WHEN n_chars = 0 THEN 'none' WHEN method IS NULL OR method = 'digital' THEN 'digital' WHEN method = 'vision' THEN 'none' ELSE 'ocr-medium' END AS reliability FROM documents")
def text_reliability(t):
    return t.documents.select("doc_id", cl.text_reliability(F.col("method"), F.lit(None).cast("double"), F.col("n_chars") > 0).alias("reliability"))


@catalog.add("mixed_fallback", "SELECT doc_id, page_index, CASE WHEN kind = 'scanned-image' THEN 'ocr' WHEN kind = 'mixed' AND char_count < 50 THEN 'hybrid' ELSE 'digital' END AS route FROM pdf_pages")
def mixed_fallback(t):
    return t.pdf_pages.select("doc_id", "page_index", cl.extraction_route(F.col("kind"), F.col("char_count")).alias("route"))


@catalog.add("render_route", f"SELECT doc_id, page_index, CASE WHEN coalesce(regexp_matches(text_sample, '{CJK}'), false) THEN 'browser' ELSE 'canvas' END AS route FROM pdf_pages")
def render_route(t):
    return t.pdf_pages.select("doc_id", "page_index", cl.render_route(F.col("text_sample")).alias("route"))


@catalog.add("drop_blank", f"SELECT doc_id, page_index, length({_trim('text')}) AS trimmed FROM ocr_pages WHERE length({_trim('text')}) > 0")
def drop_blank(t):
    n = F.length(tx.trim_ws(F.col("text")))
    return t.ocr_pages.where(n > 0).select("doc_id", "page_index", n.alias("trimmed"))


# --- tokens ------------------------------------------------------------------------------------

_TT = "coalesce(CAST(ceil(length(text) / 3.5::DOUBLE) AS BIGINT), 0)"


@catalog.add("text_tokens", f"SELECT doc_id, {_TT} AS tokens FROM documents")
def text_tokens(t):
    return t.documents.select("doc_id", tk.text_tokens(F.col("text")).alias("tokens"))


def _estimate(latin: float, cjk: float) -> str:
    return f"CASE WHEN length(text) > 0 THEN CAST(ceil((length(text) - {_CJK_N}) / {latin}::DOUBLE + {_CJK_N} / {cjk}::DOUBLE) AS BIGINT) + 1 ELSE 0 END"


@catalog.add("estimate_tokens", f"SELECT doc_id, {_estimate(3.4, 1.5)} AS claude, {_estimate(3.8, 1.5)} AS gemini FROM documents")
def estimate_tokens(t):
    return t.documents.select("doc_id", tk.estimate_tokens(F.col("text"), "claude").alias("claude"), tk.estimate_tokens(F.col("text"), "gemini").alias("gemini"))


@catalog.add("count_tokens", f"SELECT doc_id, CASE WHEN format = 'pdf' THEN {_estimate(3.4, 1.5)} WHEN format = 'docx' THEN {_estimate(3.8, 1.5)} ELSE {_TT} END AS tokens, len(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')) AS words FROM documents")
def count_tokens(t):
    encoding = F.when(F.col("format") == "pdf", "claude").when(F.col("format") == "docx", "gemini")
    return t.documents.select("doc_id", tk.count_tokens(F.col("text"), encoding).alias("tokens"), tk.word_tokens(F.col("text")).alias("words"))


@catalog.add("image_tokens", "SELECT doc_id, page_index, CASE WHEN width_pt <= 0 OR height_pt <= 0 OR greatest(width_pt, height_pt) IS NULL THEN 0 WHEN greatest(width_pt, height_pt) <= 512 THEN 85 WHEN greatest(width_pt, height_pt) <= 768 THEN 170 ELSE 680 END AS tokens FROM pdf_pages")
def image_tokens(t):
    return t.pdf_pages.select("doc_id", "page_index", tk.image_tokens(F.col("width_pt"), F.col("height_pt")).alias("tokens"))


@catalog.add("max_output_tokens", f"SELECT doc_id, greatest(8192, least(CAST(ceil({_TT} * CASE WHEN length(text) > 0 AND {_CJK_N}::DOUBLE / nullif(length(text), 0) > 0.3 THEN 3.0 ELSE 1.5 END) AS BIGINT), 16000)) AS tokens FROM documents")
def max_output_tokens(t):
    return t.documents.select("doc_id", tk.max_output_tokens(tk.text_tokens(F.col("text")), F.col("text"), F.lit(16000).cast("bigint")).alias("tokens"))


@catalog.add("complexity_level", "SELECT doc_id, CASE WHEN n_chars % 101 < 20 THEN 'low' WHEN n_chars % 101 < 50 THEN 'medium' WHEN n_chars % 101 < 80 THEN 'high' ELSE 'very_high' END AS level FROM documents")
def complexity_level(t):
    return t.documents.select("doc_id", tk.complexity_level(F.col("n_chars") % 101).alias("level"))


@catalog.add("condense_target", f"SELECT doc_id, coalesce(CASE WHEN format = 'html' THEN CAST(ceil(n_chars / 3.0) AS BIGINT) END, CASE WHEN format = 'pdf' THEN unit_count END, CAST(ceil({_TT} * 0.25::DOUBLE) AS BIGINT)) AS target FROM documents")
def condense_target(t):
    f = F.col("format")
    return t.documents.select("doc_id", tk.condense_target(F.when(f == "html", F.col("n_chars")), F.when(f == "pdf", F.col("unit_count")), F.lit(0.25), tk.text_tokens(F.col("text"))).alias("target"))


@catalog.add("chunk_budget", "SELECT provider, id, greatest(CAST(floor(context_window * 0.5::DOUBLE - 500) AS BIGINT), max_output_tokens) AS automatic, CASE WHEN 20000 < context_window THEN 20000 END AS override FROM models")
def chunk_budget(t):
    w, o = F.col("context_window"), F.col("max_output_tokens")
    return t.models.select("provider", "id", tk.chunk_budget(w, o).alias("automatic"), tk.chunk_budget(w, o, F.lit(20000).cast("bigint")).alias("override"))


@catalog.add("prompt_level", f"SELECT doc_id, CASE WHEN 100::DOUBLE / nullif({_TT}, 0) < 0.1 THEN 'high' WHEN 100::DOUBLE / nullif({_TT}, 0) < 0.5 THEN 'medium' ELSE 'low' END AS level FROM documents")
def prompt_level(t):
    return t.documents.select("doc_id", tk.prompt_level(F.lit(100.0), F.nullif(tk.text_tokens(F.col("text")), F.lit(0))).alias("level"))
