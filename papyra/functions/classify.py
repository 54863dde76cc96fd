"""Kinds of pages and units by ordered rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from papyra import fixed
from papyra.functions.lookup import look_up


def classify_pdf(chars: Column, max_coverage: Column, large_images: Column) -> Column:
    """Kind of a page: born-digital, scanned-image, mixed, empty or unknown. Nulls count as 0."""
    chars, cover, large = (F.coalesce(x, F.lit(0)) for x in (chars, max_coverage, large_images))
    text = chars >= fixed.TEXT_CHARS
    return (
        F.when(~text & (large == 0), "empty")
        .when(~text & (cover >= fixed.LARGE_COVERAGE), "scanned-image")
        .when(text & (cover >= fixed.MIXED_COVERAGE), "mixed")
        .when(text, "born-digital")
        .when(large > 0, "scanned-image")
        .otherwise("unknown")
    )


def classify_office(chars: Column, images: Column) -> Column:
    return (
        F.when((chars == 0) & (images == 0), "empty")
        .when((images > 0) & (chars < fixed.HYBRID_CHARS), "image-only")
        .when((chars >= fixed.TEXT_CHARS) & (images > 0), "mixed")
        .when(chars >= fixed.TEXT_CHARS, "text-only")
        .otherwise("empty")
    )


def classify_coverage(chars: Column, max_coverage: Column) -> Column:
    text = chars >= fixed.TEXT_CHARS
    return (
        F.when(~text & (max_coverage >= fixed.LARGE_COVERAGE), "image-only")
        .when(text & (max_coverage >= fixed.MIXED_COVERAGE), "mixed")
        .when(text, "text-only")
        .otherwise("empty")
    )


def classify_html(chars: Column, images: Column, tables: Column) -> Column:
    return (
        F.when((chars == 0) & (images == 0), "empty")
        .when((tables > 0) & (chars > 0), "tabular")
        .when((chars == 0) & (images > 0), "image-only")
        .when((chars > 0) & (images > 0), "mixed")
        .otherwise("text-only")
    )


def content_kind(page_kind: Column) -> Column:
    return F.coalesce(look_up(fixed.PAGE_KIND, page_kind), F.lit("unknown"))


def page_kind(kind: Column) -> Column:
    return F.coalesce(look_up(fixed.CONTENT_KIND, kind), F.lit("unknown"))


def requires_ocr(kind: Column) -> Column:
    return kind == "image-only"


def may_benefit_from_ocr(kind: Column) -> Column:
    return kind.isin("image-only", "mixed")


def describe_kind(kind: Column) -> Column:
    return F.coalesce(look_up(fixed.KIND_LABEL, kind), F.lit(fixed.KIND_LABEL["unknown"]))


def ocr_reliability(confidence: Column) -> Column:
    return F.when(confidence >= 0.95, "high").when(confidence >= 0.8, "medium").otherwise("low")


def text_reliability(method: Column, confidence: Column, has_text: Column) -> Column:
    return (
        F.when(~F.coalesce(has_text, F.lit(False)), "none")
        .when(method.isNull() | (method == "digital"), "digital")
        .when(method == "vision", "none")
        .when(confidence.isNull(), "ocr-medium")
        .when(confidence >= 0.95, "ocr-high")
        .when(confidence >= 0.8, "ocr-medium")
        .otherwise("ocr-low")
    )


def extraction_route(kind: Column, chars: Column) -> Column:
    """digital, ocr or hybrid: a mixed page with little digital text is read by OCR as well."""
    return F.when(kind == "scanned-image", "ocr").when((kind == "mixed") & (chars < fixed.HYBRID_CHARS), "hybrid").otherwise("digital")


def render_route(text: Column, always: bool = False) -> Column:
    from papyra.functions.text import has_cjk

    return F.when(F.lit(always) | has_cjk(text), "browser").otherwise("canvas")
