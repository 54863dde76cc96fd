"""Text statistics and strings as column expressions: all of them stay within generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from papyra import fixed


def trim_ws(text: Column) -> Column:
    return F.regexp_replace(text, f"^{fixed.WS}+|{fixed.WS}+$", "")


def char_count(text: Column) -> Column:
    """Characters besides white space; null text counts 0."""
    return F.coalesce(F.length(F.regexp_replace(text, fixed.WS, "")), F.lit(0)).cast("bigint")


def text_sample(text: Column, size: int = fixed.SAMPLE_CHARS) -> Column:
    return F.substring(text, 1, size)


def normalize_ws(text: Column) -> Column:
    return trim_ws(F.regexp_replace(text, f"{fixed.WS}+", " "))


def markdown_tidy(text: Column) -> Column:
    return trim_ws(F.regexp_replace(text, "\n{3,}", "\n\n"))


def prepend_title(text: Column, title: Column) -> Column:
    """The text under a first-level heading, unless it begins with it or there is no title."""
    head = F.concat(F.lit("# "), title)
    return F.when(title.isNull() | (F.length(title) == 0) | F.startswith(text, head), text).otherwise(F.concat(head, F.lit("\n\n"), text))


def has_cjk(text: Column) -> Column:
    return F.coalesce(text.rlike(fixed.CJK), F.lit(False))


def cjk_count(text: Column) -> Column:
    return F.coalesce(F.length(text) - F.length(F.regexp_replace(text, fixed.CJK, "")), F.lit(0))


def is_cjk_heavy(text: Column, share: float = 0.3) -> Column:
    """More than the share of the characters; an empty text is not."""
    return (F.length(text) > 0) & (cjk_count(text) / F.length(text) > F.lit(share))


def experiment_slug(name: Column) -> Column:
    """Safe file name of an experiment, at most 100 characters."""
    x = F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9_-]", "-"), "-+", "-")
    return F.substring(F.regexp_replace(x, "^-|-$", ""), 1, 100)


def safe_label(label: Column) -> Column:
    return F.substring(F.regexp_replace(label, "[\r\n]+", " "), 1, 100)


def previous_tail(text: Column, size: int = 200) -> Column:
    """The end of a text as context for the next unit: cut forward to a natural break.

    Within the last characters: after a paragraph break in the first half, else after a sentence
    in the first 30 %, else after a space from the eleventh character on in the first 20 %.
    """
    tail = F.substring(text, -size, size)
    paragraph = F.locate("\n\n", tail)
    before = F.length(F.regexp_extract(tail, r"(?s)^(.*?)[.!?][ \t\n\r\f\x0B]", 1))
    sentence = F.when(tail.rlike(r"[.!?][ \t\n\r\f\x0B]"), before)
    space = F.locate(" ", tail, 11)
    cut = (
        F.when((paragraph > 0) & (paragraph - 1 < size * 0.5), F.substr(tail, paragraph + 2))
        .when(sentence < size * 0.3, F.substr(tail, sentence + 3))
        .when((space > 0) & (space - 1 < size * 0.2), F.substr(tail, space + 1))
        .otherwise(tail)
    )
    return F.when(F.length(text) <= size, text).otherwise(trim_ws(cut))
