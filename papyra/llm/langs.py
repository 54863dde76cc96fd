"""Language labels: every usual notation to one of twelve ISO 639-3 codes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Code, two-letter code, other codes, names in English and in the language itself.
LANGUAGES = {
    "eng": ("en", [], ["english"]),
    "deu": ("de", ["ger"], ["german", "deutsch"]),
    "fra": ("fr", ["fre"], ["french", "français", "francais"]),
    "spa": ("es", [], ["spanish", "castilian", "español", "espanol", "castellano"]),
    "por": ("pt", [], ["portuguese", "português", "portugues"]),
    "ita": ("it", [], ["italian", "italiano"]),
    "nld": ("nl", ["dut"], ["dutch", "nederlands", "flemish", "vlaams"]),
    "pol": ("pl", [], ["polish", "polski", "język polski", "jezyk polski"]),
    "rus": ("ru", [], ["russian", "русский", "русский язык"]),
    "jpn": ("ja", ["jp"], ["japanese", "日本語"]),
    "zho": ("zh", ["chi", "cmn", "chi_sim", "chi_tra", "zh_hans", "zh_hant"], ["chinese", "mandarin", "中文", "汉语", "漢語", "普通话"]),
    "kor": ("ko", [], ["korean", "한국어", "조선말"]),
}

NOTATION = {v: code for code, (two, others, names) in LANGUAGES.items() for v in (code, two, *others, *names)}
CODES = tuple(LANGUAGES)


def normal(label: str | None) -> str | None:
    """The code a label names, or None where it names no language of the twelve."""
    if label is None:
        return None
    x = label.strip().lower().replace("-", "_")
    return NOTATION.get(x) or (NOTATION.get(x.split("_")[0]) if "_" in x else None)


def normal_column(label: Column) -> Column:
    """The same as a column expression."""
    table = F.create_map(*[F.lit(v) for kv in NOTATION.items() for v in kv])
    x = F.translate(F.lower(F.trim(label)), "-", "_")
    return F.coalesce(F.try_element_at(table, x), F.try_element_at(table, F.substring_index(x, "_", 1)))
