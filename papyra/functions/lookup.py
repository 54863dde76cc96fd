"""Format detection and other lookups: maps of literals, so that no join is needed."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from papyra import fixed


def look_up(table: dict[str, str], key: Column) -> Column:
    """The table's value for a key, null where it has none."""
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def get_extension(path: Column) -> Column:
    """Lower-case extension with its dot, of the path without query and fragment; null where there is none."""
    is_url = F.lower(path).rlike("^https?://")
    rest = F.when(is_url, F.regexp_replace(path, "^[A-Za-z]+://[^/?#]*", "")).otherwise(path)
    return F.nullif(F.lower(F.regexp_extract(F.regexp_replace(rest, "[?#].*", ""), r"(\.[^./\\]+)$", 1)), F.lit(""))


def format_of_extension(extension: Column) -> Column:
    return look_up(fixed.EXTENSION_FORMAT, F.lower(extension))


def format_of_mime(mime: Column) -> Column:
    return look_up(fixed.MIME_FORMAT, F.lower(F.trim(F.substring_index(mime, ";", 1))))


def format_of_bytes(content: Column) -> Column:
    """Format by first bytes; fewer than four bytes have none."""
    head = F.hex(F.substring(content, 1, 12))
    text = F.lower(F.decode(F.substring(content, 1, 100), "ISO-8859-1"))
    out = F.when(F.length(content) < 4, F.lit(None))
    for start, name in fixed.MAGIC:
        out = out.when(F.startswith(head, F.lit(start)), name)
    out = out.when(F.startswith(head, F.lit("52494646")) & (F.substring(head, 17, 8) == "57454250"), "image")
    return out.when(text.rlike("^\\s*(<!doctype html|<html)"), "html")


def format_of_image(content: Column) -> Column:
    """png, jpg, gif or webp by first bytes, else svg where markup begins the content."""
    head = F.hex(F.substring(content, 1, 12))
    text = F.lower(F.decode(F.substring(content, 1, 100), "ISO-8859-1"))
    return (
        F.when(F.startswith(head, F.lit("89504E47")), "png")
        .when(F.startswith(head, F.lit("FFD8FF")), "jpg")
        .when(F.startswith(head, F.lit("47494638")), "gif")
        .when(F.startswith(head, F.lit("52494646")) & (F.substring(head, 17, 8) == "57454250"), "webp")
        .when(F.contains(text, F.lit("<svg")) | F.contains(text, F.lit("<?xml")), "svg")
    )


def detect_format(explicit: Column, path: Column, mime: Column, content: Column | None = None) -> Column:
    """Explicit name, else extension, else MIME type, else first bytes."""
    named = F.lower(F.regexp_replace(F.trim(explicit), "^\\.", ""))
    given = F.when(named.isin(*fixed.FORMATS), named).otherwise(look_up(fixed.EXTENSION_FORMAT, F.concat(F.lit("."), named)))
    found = [given, format_of_extension(get_extension(path)), format_of_mime(mime)]
    return F.coalesce(*found, *([format_of_bytes(content)] if content is not None else []))


def detect_input_type(path: Column) -> Column:
    return F.when(path.isNull(), "bytes").when(path.rlike("(?i)^https?://"), "url").otherwise("file")


def describe_source(path: Column, size: Column) -> Column:
    """How a source is named in messages."""
    url = F.regexp_replace(F.regexp_replace(path, "(?i)^https?://", ""), "[?#].*", "")
    return (
        F.when(path.isNull(), F.concat(F.lit("buffer ("), F.coalesce(size.cast("string"), F.lit("0")), F.lit(" bytes)")))
        .when(path.rlike("(?i)^https?://"), F.concat(F.lit("URL "), url))
        .when(path == "-", "stdin")
        .otherwise(F.regexp_extract(path, r"([^/\\]*)$", 1))
    )


def document_type(extension: Column) -> Column:
    table = fixed.DOCUMENT_TYPE
    return F.coalesce(look_up(table, F.lower(extension)), F.lit("pdf"))


def ocr_language(language: Column, fallback: str = "eng") -> Column:
    return F.coalesce(look_up(fixed.OCR_LANGUAGE, language), F.lit(fallback))


def model_files_present(languages: Column, present: list[str]) -> Column:
    """Whether all languages joined by '+' are among the local model files."""
    return F.forall(F.split(languages, r"\+"), lambda x: x.isin(*present))
