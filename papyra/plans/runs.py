"""Queries over units and runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from papyra import fixed
from papyra.functions import classify as cl
from papyra.operators import runs as op
from papyra.plans.registry import Catalog, sql_case

catalog = Catalog()

_UNITS = f"""(SELECT doc_id, page_index AS unit_index, {sql_case('kind', fixed.PAGE_KIND, "'unknown'")} AS kind, char_count, language, paper_key, orientation, error, text_sample
    FROM (SELECT DISTINCT ON (doc_id, page_index) * FROM pdf_pages))"""


def _units(t):
    p = t.pdf_pages
    return p.select("doc_id", F.col("page_index").alias("unit_index"), cl.content_kind(F.col("kind")).alias("kind"), "char_count", "language", "paper_key", "orientation", "error", "text_sample")


def _runs_sql(key: str, extra: str = "") -> str:
    return f"""SELECT doc_id, CAST(run AS INT) - 1 AS run_index, coalesce(min(k), 'unit-' || min(unit_index)) AS run_key, list_sort(list(unit_index)) AS unit_indices{extra}
        FROM (SELECT *, sum(CASE WHEN k IS NOT NULL AND k = pk THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY unit_index) AS run
            FROM (SELECT *, lag(k) OVER (PARTITION BY doc_id ORDER BY unit_index) AS pk FROM (SELECT *, {key} AS k FROM {_UNITS}))) GROUP BY doc_id, run"""


_PDF_KEY = "kind || '|' || coalesce(paper_key, '') || '|' || coalesce(orientation, '') || '|' || coalesce(language, '')"


@catalog.add("build_runs", _runs_sql("CASE WHEN language IS NOT NULL THEN kind || '|' || language END"))
def build_runs(t):
    return op.build_runs(_units(t), F.when(F.col("language").isNotNull(), op.run_key(F.col("kind"), F.col("language"))))


@catalog.add("run_key_pdf", f"SELECT doc_id, unit_index, {_PDF_KEY} AS run_key FROM {_UNITS}")
def run_key_pdf(t):
    return _units(t).select("doc_id", "unit_index", op.run_key(F.col("kind"), F.col("paper_key"), F.col("orientation"), F.col("language")).alias("run_key"))


@catalog.add("run_key_office", f"SELECT doc_id, unit_index, kind || '|' || coalesce(language, '') AS run_key, kind || '::' || coalesce(language, '') AS legacy_key FROM {_UNITS}")
def run_key_office(t):
    k, x = F.col("kind"), F.col("language")
    return _units(t).select("doc_id", "unit_index", op.run_key(k, x).alias("run_key"), op.run_key(k, x, separator="::").alias("legacy_key"))


_META = ", any_value(kind) AS kind, min_by(language, unit_index) AS language, sum(char_count) AS char_count, count(error) AS error_count"


@catalog.add("run_metadata", _runs_sql(_PDF_KEY, _META))
def run_metadata(t):
    carry = {"kind": F.min("kind"), "language": F.min_by("language", "unit_index"), "char_count": F.sum("char_count"), "error_count": F.count("error")}
    return op.build_runs(_units(t), op.run_key(F.col("kind"), F.col("paper_key"), F.col("orientation"), F.col("language")), carry=carry)


@catalog.add("run_boundary", f"SELECT doc_id, unit_index, coalesce(kind <> lag(kind) OVER (PARTITION BY doc_id ORDER BY unit_index), true) AS is_new FROM {_UNITS}")
def run_boundary(t):
    from pyspark.sql import Window

    w = Window.partitionBy("doc_id").orderBy("unit_index")
    return _units(t).select("doc_id", "unit_index", F.coalesce(F.col("kind") != F.lag("kind").over(w), F.lit(True)).alias("is_new"))


@catalog.add("run_index", f"SELECT doc_id, unit_index, CAST(sum(CASE WHEN kind = pk THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY unit_index) AS INT) - 1 AS run_index FROM (SELECT *, lag(kind) OVER (PARTITION BY doc_id ORDER BY unit_index) AS pk FROM {_UNITS})")
def run_index(t):
    return op.build_runs(_units(t), F.col("kind")).select("doc_id", F.explode("unit_indices").alias("unit_index"), "run_index")


_RUNS = f"(SELECT doc_id, run_index, {sql_case('kind', fixed.PAGE_KIND, "'unknown'")} AS kind, language, page_indices AS unit_indices, char_count FROM (SELECT DISTINCT ON (doc_id, run_index) * FROM runs))"


def _runs(t):
    r = t.runs
    return r.select("doc_id", "run_index", cl.content_kind(F.col("kind")).alias("kind"), "language", F.col("page_indices").alias("unit_indices"), "char_count")


@catalog.add("merge_runs_by_kind", f"""SELECT doc_id, kind, unit_indices, language, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY first_run) - 1 AS INT) AS position
    FROM (SELECT doc_id, kind, min(run_index) AS first_run, list_sort(flatten(list(unit_indices))) AS unit_indices, arg_min_null(language, run_index) AS language FROM {_RUNS} GROUP BY doc_id, kind)""")
def merge_runs_by_kind(t):
    return op.merge_runs_by_kind(_runs(t))


_STATS = ", ".join(f"count(*) FILTER (kind = '{k}') AS {k.replace('-', '_')}_runs, coalesce(sum(len(unit_indices)) FILTER (kind = '{k}'), 0) AS {k.replace('-', '_')}_units" for k in fixed.KINDS)


@catalog.add("run_stats", f"SELECT doc_id, count(*) AS runs, sum(len(unit_indices)) AS units, {_STATS} FROM {_RUNS} GROUP BY doc_id")
def run_stats(t):
    return op.run_stats(_runs(t))


_DOMINANT = f"""SELECT doc_id, coalesce(arg_max(lang, (n, -first)) FILTER (lang IS NOT NULL), 'und') AS dominant_language
    FROM (SELECT doc_id, nullif(language, 'und') AS lang, count(*) AS n, min(unit_index) AS first FROM {_UNITS} GROUP BY 1, 2) GROUP BY doc_id"""


@catalog.add("dominant_language", _DOMINANT)
def dominant_language(t):
    return op.dominant_language(_units(t))


@catalog.add("unit_indices", f"SELECT doc_id, unnest(unit_indices) AS unit_index FROM {_RUNS}")
def unit_indices(t):
    return _runs(t).select("doc_id", F.explode("unit_indices").alias("unit_index"))


@catalog.add("filter_runs", f"SELECT doc_id, run_index, kind, kind IN ('text-only', 'mixed', 'tabular') AS extractable, kind = 'image-only' AS ocr_required FROM {_RUNS} WHERE kind IN ('text-only', 'mixed', 'image-only')")
def filter_runs(t):
    k = F.col("kind")
    return _runs(t).where(k.isin("text-only", "mixed", "image-only")).select("doc_id", "run_index", "kind", k.isin("text-only", "mixed", "tabular").alias("extractable"), (k == "image-only").alias("ocr_required"))


@catalog.add("sort_runs", f"SELECT doc_id, run_index, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY unit_indices[1], run_index) - 1 AS INT) AS position FROM {_RUNS}")
def sort_runs(t):
    from pyspark.sql import Window

    w = Window.partitionBy("doc_id").orderBy(F.try_element_at("unit_indices", F.lit(1)), "run_index")
    return _runs(t).select("doc_id", "run_index", (F.row_number().over(w) - 1).cast("int").alias("position"))


@catalog.add("analysis_summary", f"""SELECT doc_id, count(*) AS units, count(*) FILTER (kind = 'text-only') AS text_only, count(*) FILTER (kind = 'image-only') AS image_only, count(*) FILTER (kind = 'mixed') AS mixed,
    count(*) FILTER (kind = 'empty') AS empty, count(*) FILTER (kind = 'unknown') AS unknown, count(error) AS errors, list_sort(list(DISTINCT language) FILTER (language IS NOT NULL AND language <> 'und')) AS languages FROM {_UNITS} GROUP BY doc_id""".replace("list_sort(list", "coalesce(list_sort(list").replace("'und')) AS", "'und')), []) AS"))
def analysis_summary(t):
    k = F.col("kind")
    named = F.when(F.col("language") != "und", F.col("language"))
    return _units(t).groupBy("doc_id").agg(F.count("*").alias("units"), *[F.count_if(k == x).alias(x.replace("-", "_")) for x in ("text-only", "image-only", "mixed", "empty", "unknown")], F.count("error").alias("errors"), F.sort_array(F.collect_set(named)).alias("languages"))


@catalog.add("kind_distribution", f"SELECT doc_id, kind, count(*) AS units FROM {_UNITS} GROUP BY doc_id, kind")
def kind_distribution(t):
    return _units(t).groupBy("doc_id", "kind").agg(F.count("*").alias("units"))


_POINTS = "2.0 * pages + characters / 1000.0::DOUBLE + 5.0 * images + CASE WHEN has_ocr THEN 20 ELSE 0 END + CASE WHEN has_mixed THEN 10 ELSE 0 END + CASE WHEN has_tabular THEN 5 ELSE 0 END"


@catalog.add("complexity", f"""SELECT *, CASE WHEN score < 20 THEN 'low' WHEN score < 50 THEN 'medium' WHEN score < 80 THEN 'high' ELSE 'very_high' END AS level FROM (SELECT *, CAST(least(100, floor({_POINTS} + 0.5)) AS INT) AS score FROM (
    SELECT doc_id, count(*) AS pages, sum(char_count) AS characters, count(*) FILTER (kind IN ('image-only', 'mixed')) AS images,
        bool_or(coalesce(kind = 'image-only' OR (kind = 'unknown' AND char_count < 50) OR (kind = 'mixed' AND char_count < 100), false)) AS has_ocr, bool_or(kind = 'mixed') AS has_mixed, bool_or(kind = 'tabular') AS has_tabular
    FROM {_UNITS} GROUP BY doc_id))""")
def complexity(t):
    return op.complexity(_units(t))


@catalog.add("concat_units", f"""SELECT doc_id, coalesce(string_agg(text, chr(10) || chr(10) ORDER BY page_index) FILTER (length(regexp_replace(text, '{fixed.WS}', '', 'g')) > 0), '') AS text, count(*) AS unit_count
    FROM (SELECT DISTINCT ON (doc_id, page_index) doc_id, page_index, text FROM ocr_pages) GROUP BY doc_id""")
def concat_units(t):
    pages = t.ocr_pages.select("doc_id", F.col("page_index").alias("unit_index"), "text")
    return op.concat_units(pages)


@catalog.add("result_counts", f"""SELECT doc_id, count(*) AS unit_count, CAST(max(run) AS BIGINT) AS run_count, count(error) AS errors
    FROM (SELECT *, sum(CASE WHEN k = pk THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY unit_index) AS run FROM (SELECT *, lag(k) OVER (PARTITION BY doc_id ORDER BY unit_index) AS pk FROM (SELECT *, {_PDF_KEY} AS k FROM {_UNITS}))) GROUP BY doc_id""")
def result_counts(t):
    runs = op.build_runs(_units(t), op.run_key(F.col("kind"), F.col("paper_key"), F.col("orientation"), F.col("language")), carry={"n": F.count("*"), "e": F.count("error")})
    return runs.groupBy("doc_id").agg(F.sum("n").alias("unit_count"), F.count("*").alias("run_count"), F.sum("e").alias("errors"))


@catalog.add("reindex", f"SELECT doc_id, unit_index, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY unit_index) - 1 AS INT) AS position FROM {_UNITS} WHERE kind <> 'empty'")
def reindex(t):
    from pyspark.sql import Window

    w = Window.partitionBy("doc_id").orderBy("unit_index")
    return _units(t).where("kind <> 'empty'").select("doc_id", "unit_index", (F.row_number().over(w) - 1).cast("int").alias("position"))


@catalog.add("distinct_languages", f"SELECT DISTINCT doc_id, language FROM {_UNITS} WHERE language IS NOT NULL")
def distinct_languages(t):
    return _units(t).where("language is not null").select("doc_id", "language").distinct()


@catalog.add("union_errors", "SELECT doc_id, error.unit_index AS unit_index, error.phase AS phase, error.message AS message FROM (SELECT DISTINCT ON (doc_id, page_index) doc_id, error FROM pdf_pages) WHERE error IS NOT NULL UNION ALL SELECT doc_id, e.unit_index, e.phase, e.message FROM (SELECT doc_id, unnest(errors) AS e FROM (SELECT DISTINCT ON (doc_id) doc_id, errors FROM ocr_docs))")
def union_errors(t):
    a = t.pdf_pages.where("error is not null").select("doc_id", "error.*")
    b = t.ocr_docs.select("doc_id", F.explode("errors").alias("e")).select("doc_id", "e.*")
    return a.unionByName(b)


@catalog.add("wrap_phase", f"SELECT doc_id, unit_index, {sql_case('phase', fixed.PHASE_ERROR, "'PipelineError'")} AS error_class, regexp_matches(lower(message), 'abort|cancel') AS aborted, phase IN ('analyze', 'extract', 'render') AS recoverable FROM (SELECT doc_id, error.unit_index AS unit_index, error.phase AS phase, error.message AS message FROM pdf_pages WHERE error IS NOT NULL)")
def wrap_phase(t):
    from papyra.functions.errors import wrap_phase as wrap

    return t.pdf_pages.where("error is not null").select("doc_id", "error.*").select("doc_id", "unit_index", wrap(F.col("phase"), F.col("message")).alias("e")).select("doc_id", "unit_index", "e.*")


_CODE3 = {k: k for k in fixed.OCR_LANGUAGE} | fixed.LANGUAGE_NAME
_PLAIN = "split_part(translate(lower(trim(language)), '_', '-'), '-', 1)"


@catalog.add("pdf_document", f"""WITH r AS (SELECT doc_id, run_index, run_key, kind, language, coalesce({sql_case(_PLAIN, {k: fixed.OCR_LANGUAGE[v] for k, v in _CODE3.items()})}, 'eng') AS ocr_code, page_indices FROM runs),
    u AS (SELECT doc_id, run_index, kind, unnest(page_indices) AS page_index FROM r),
    x AS (SELECT u.doc_id, u.run_index, u.page_index, CASE u.kind WHEN 'scanned-image' THEN o.text WHEN 'mixed' THEN coalesce(nullif(p.text_sample, ''), o.text) ELSE p.text_sample END AS t, p.error IS NOT NULL AS failed
        FROM u LEFT JOIN pdf_pages p ON u.doc_id = p.doc_id AND u.page_index = p.page_index LEFT JOIN ocr_pages o ON u.doc_id = o.doc_id AND u.page_index = o.page_index),
    g AS (SELECT doc_id, run_index, string_agg(t, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY page_index) FILTER (length(t) > 0) AS text, list(page_index ORDER BY page_index) FILTER (failed) AS error_pages FROM x GROUP BY 1, 2)
    SELECT r.doc_id, r.run_index, run_key, language, ocr_code, text, coalesce(error_pages, []) AS error_pages FROM r LEFT JOIN g ON r.doc_id = g.doc_id AND r.run_index = g.run_index""")
def pdf_document(t):
    """Text of every run with the OCR engine's code of its language and the document's pages that failed.

    Scanned runs have the text read by OCR, mixed ones that only where the page has none of its own. Labels of
    any usual notation name their language; others fall back to English.
    """
    from papyra.functions.lookup import look_up

    plain = F.substring_index(F.translate(F.lower(F.trim("language")), "_", "-"), "-", 1)
    code = F.coalesce(look_up({k: fixed.OCR_LANGUAGE[v] for k, v in _CODE3.items()}, plain), F.lit("eng"))
    runs = t.runs.select("doc_id", "run_index", "run_key", "kind", "language", code.alias("ocr_code"), "page_indices")
    pages = t.pdf_pages.select("doc_id", "page_index", "text_sample", F.col("error").isNotNull().alias("failed"))
    lines = runs.select("doc_id", "run_index", "kind", F.explode("page_indices").alias("page_index")).join(pages, ["doc_id", "page_index"], "left").join(t.ocr_pages.select("doc_id", "page_index", "text"), ["doc_id", "page_index"], "left")
    text = F.when(F.col("kind") == "scanned-image", F.col("text")).when(F.col("kind") == "mixed", F.coalesce(F.nullif("text_sample", F.lit("")), "text")).otherwise(F.col("text_sample"))
    kept = F.filter(F.sort_array(F.collect_list(F.struct("page_index", text.alias("t"), "failed"))), lambda x: F.length(x["t"]) > 0)
    failed = F.sort_array(F.collect_list(F.when(F.col("failed"), F.col("page_index"))))
    g = lines.groupBy("doc_id", "run_index").agg(kept.alias("kept"), failed.alias("error_pages"))
    joined = F.when(F.size("kept") > 0, F.array_join(F.transform("kept", lambda x: x["t"]), "\n\n---\n\n"))
    return runs.join(g, ["doc_id", "run_index"], "left").select("doc_id", "run_index", "run_key", "language", "ocr_code", joined.alias("text"), F.coalesce("error_pages", F.array().cast("array<int>")).alias("error_pages"))
