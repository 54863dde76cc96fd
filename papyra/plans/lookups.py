"""Queries of format detection and lookups, over inputs, pages and models."""

from __future__ import annotations

from pyspark.sql import functions as F

from papyra import fixed
from papyra.functions import lookup as fn
from papyra.plans.registry import Catalog, sql_case

catalog = Catalog()

_EXT = r"nullif(lower(regexp_extract(regexp_replace(CASE WHEN regexp_matches(lower(path), '^https?://') THEN regexp_replace(path, '^[A-Za-z]+://[^/?#]*', '') ELSE path END, '[?#].*', ''), '(\.[^./\\]+)$', 1)), '')"
_NAMED = r"lower(regexp_replace(trim(explicit), '^\.', ''))"
_MIME = "lower(trim(split_part(mime, ';', 1)))"
_GIVEN = f"CASE WHEN {_NAMED} IN ({', '.join(repr(f) for f in fixed.FORMATS)}) THEN {_NAMED} ELSE {sql_case("'.' || " + _NAMED, fixed.EXTENSION_FORMAT)} END"
_DOCTYPE = fixed.DOCUMENT_TYPE


@catalog.add("get_extension", f"SELECT doc_id, path, {_EXT} AS extension FROM inputs")
def get_extension(t):
    return t.inputs.select("doc_id", "path", fn.get_extension(F.col("path")).alias("extension"))


@catalog.add("ext_to_format", f"SELECT doc_id, {sql_case(_EXT, fixed.EXTENSION_FORMAT)} AS format FROM inputs")
def ext_to_format(t):
    return t.inputs.select("doc_id", fn.format_of_extension(fn.get_extension(F.col("path"))).alias("format"))


@catalog.add("mime_to_format", f"SELECT doc_id, mime, {sql_case(_MIME, fixed.MIME_FORMAT)} AS format FROM inputs")
def mime_to_format(t):
    return t.inputs.select("doc_id", "mime", fn.format_of_mime(F.col("mime")).alias("format"))


@catalog.add("detect_format", f"SELECT doc_id, coalesce({_GIVEN}, {sql_case(_EXT, fixed.EXTENSION_FORMAT)}, {sql_case(_MIME, fixed.MIME_FORMAT)}) AS format FROM inputs")
def detect_format(t):
    return t.inputs.select("doc_id", fn.detect_format(F.col("explicit"), F.col("path"), F.col("mime")).alias("format"))


@catalog.add("magic_bytes", "SELECT doc_id, CASE WHEN length(coalesce(text, '')) < 4 THEN NULL WHEN starts_with(text, '%PDF') THEN 'pdf' WHEN regexp_matches(lower(text[1:100]), '^\\s*(<!doctype html|<html)') THEN 'html' END AS format FROM documents")
def magic_bytes(t):
    return t.documents.select("doc_id", fn.format_of_bytes(F.col("text").cast("binary")).alias("format"))


@catalog.add("image_magic", "SELECT doc_id, CASE WHEN contains(lower(text[1:100]), '<svg') OR contains(lower(text[1:100]), '<?xml') THEN 'svg' END AS format FROM documents")
def image_magic(t):
    return t.documents.select("doc_id", fn.format_of_image(F.col("text").cast("binary")).alias("format"))


@catalog.add("office_detect", f"SELECT doc_id, CASE WHEN f IN ({', '.join(repr(f) for f in fixed.OFFICE)}) THEN f END AS format FROM (SELECT doc_id, coalesce({sql_case(_MIME, fixed.MIME_FORMAT)}, {sql_case(_EXT, fixed.EXTENSION_FORMAT)}) AS f FROM inputs)")
def office_detect(t):
    f = F.coalesce(fn.format_of_mime(F.col("mime")), fn.format_of_extension(fn.get_extension(F.col("path"))))
    return t.inputs.select("doc_id", F.when(f.isin(*fixed.OFFICE), f).alias("format"))


@catalog.add("detect_input_type", "SELECT doc_id, CASE WHEN path IS NULL THEN 'bytes' WHEN regexp_matches(lower(path), '^https?://') THEN 'url' ELSE 'file' END AS input_type FROM inputs")
def detect_input_type(t):
    return t.inputs.select("doc_id", fn.detect_input_type(F.col("path")).alias("input_type"))


@catalog.add("describe_source", r"""
    SELECT doc_id, CASE WHEN path IS NULL THEN 'buffer (' || coalesce(CAST(unit_count AS VARCHAR), '0') || ' bytes)'
        WHEN regexp_matches(lower(path), '^https?://') THEN 'URL ' || regexp_replace(regexp_replace(path, '(?i)^https?://', ''), '[?#].*', '')
        WHEN path = '-' THEN 'stdin' ELSE regexp_extract(path, '([^/\\]*)$', 1) END AS description FROM inputs""")
def describe_source(t):
    return t.inputs.select("doc_id", fn.describe_source(F.col("path"), F.col("unit_count")).alias("description"))


@catalog.add("doctype", f"SELECT doc_id, {sql_case(_EXT, _DOCTYPE, "'pdf'")} AS doctype FROM inputs")
def doctype(t):
    return t.inputs.select("doc_id", fn.document_type(fn.get_extension(F.col("path"))).alias("doctype"))


@catalog.add("ocr_lang", f"SELECT doc_id, page_index, language, {sql_case('language', fixed.OCR_LANGUAGE, "'eng'")} AS ocr_code FROM pdf_pages")
def ocr_lang(t):
    return t.pdf_pages.select("doc_id", "page_index", "language", fn.ocr_language(F.col("language")).alias("ocr_code"))


@catalog.add("tessdata_probe", "SELECT doc_id, page_index, len(list_filter(string_split(ocr_lang, '+'), lambda x: x NOT IN ('eng', 'deu', 'fra', 'jpn'))) = 0 AS offline FROM ocr_pages WHERE ocr_lang IS NOT NULL")
def tessdata_probe(t):
    return t.ocr_pages.where("ocr_lang is not null").select("doc_id", "page_index", fn.model_files_present(F.col("ocr_lang"), ["eng", "deu", "fra", "jpn"]).alias("offline"))


@catalog.add("supported_formats", f"SELECT format, count(*) AS inputs FROM (SELECT {sql_case(_EXT, fixed.EXTENSION_FORMAT)} AS format FROM inputs) WHERE format IS NOT NULL GROUP BY format")
def supported_formats(t):
    f = fn.format_of_extension(fn.get_extension(F.col("path")))
    return t.inputs.select(f.alias("format")).where("format is not null").groupBy("format").agg(F.count("*").alias("inputs"))


@catalog.add("capability_checks", "SELECT provider, id, coalesce(capabilities.vision, false) AS vision, coalesce(capabilities.pdf_input, false) AS pdf_input, capabilities.reasoning IS NOT NULL AS reasoning FROM models")
def capability_checks(t):
    return t.models.select("provider", "id", F.coalesce("capabilities.vision", F.lit(False)).alias("vision"), F.coalesce("capabilities.pdf_input", F.lit(False)).alias("pdf_input"), F.col("capabilities.reasoning").isNotNull().alias("reasoning"))
