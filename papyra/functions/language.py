"""Language of a text by script and frequent function words, as a column: cheap, for whole pages only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LEAST_CHARS = 80
#: Frequent function words that few other languages share.
FUNCTION_WORDS = {
    "deu": ("der", "die", "das", "und", "ist", "nicht", "auch", "wird", "für", "auf"),
    "eng": ("the", "of", "and", "was", "that", "with", "it", "as", "by", "this"),
    "fra": ("le", "les", "est", "du", "été", "dans", "sera", "que", "une", "au"),
    "ita": ("il", "che", "di", "è", "della", "sono", "non", "nel", "più", "gli"),
    "nld": ("het", "van", "een", "niet", "wordt", "zijn", "ook", "dat", "werd", "voor"),
    "pol": ("się", "jest", "nie", "czy", "roku", "zależy", "że", "ma", "oraz", "od"),
    "por": ("os", "não", "uma", "foi", "são", "em", "seja", "ao", "mas", "também"),
    "spa": ("el", "los", "una", "se", "con", "también", "más", "aunque", "sirve", "según"),
}
#: Scripts that name a language by themselves.
SCRIPTS = (("kor", r"[\x{AC00}-\x{D7AF}]"), ("jpn", r"[\x{3040}-\x{30FF}]"), ("zho", r"[\x{4E00}-\x{9FFF}]"), ("rus", r"[\x{0400}-\x{04FF}]"))


def detect_language(text: Column) -> Column:
    """ISO 639-3 code, or und for short texts and those without evidence; the earlier code wins a tie."""
    words = F.split(F.lower(text), r"[^\p{L}]+")
    scores = [F.size(F.filter(words, lambda w: w.isin(*own))) for own in FUNCTION_WORDS.values()]
    best = F.greatest(*scores)
    out = F.when(F.coalesce(F.length(text), F.lit(0)) < LEAST_CHARS, "und")
    for code, script in SCRIPTS:
        out = out.when((F.length(text) - F.length(F.regexp_replace(text, script, ""))) / F.length(text) > 0.2, code)
    out = out.when(best == 0, "und")
    for (code, _), score in zip(FUNCTION_WORDS.items(), scores):
        out = out.when(score == best, code)
    return out
