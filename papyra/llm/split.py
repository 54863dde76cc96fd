"""Problem 1: cut oversized items at natural boundaries, by recursive bisection."""

from __future__ import annotations

import bisect
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A cut is looked for in this middle part of a span; outside it halves become too uneven.
WINDOW = 0.5

PIECES = "array<struct<piece_index:int,start:int,core_start:int,end:int,boundary:string,text:string>>"

_FENCE = re.compile(r"^[ \t]*(```|~~~)", re.M)
_HEADING = re.compile(r"(?<=\n)(?=#{1,6}[ \t])")
_BLANK = re.compile(r"\n[ \t]*\n\s*")
_LINE = re.compile(r"\n")
_SENTENCE = re.compile(r"[.!?…][\"'”’»)\]]*\s+|[。！？][」』”’]*")
_CLAUSE = re.compile(r"[,;:，；：、]\s*")
_SPACE = re.compile(r"\s+")
NAMES = ("heading", "paragraph", "line", "sentence", "clause", "word", "character")


def _fenced(text: str) -> list[tuple[int, int]]:
    """Spans of fenced blocks, the fences' lines included; an unclosed one runs to the end."""
    spans, start = [], -1
    for m in _FENCE.finditer(text):
        if start < 0:
            start = m.start()
        else:
            end = text.find("\n", m.end())
            spans.append((start, len(text) if end < 0 else end))
            start = -1
    if start >= 0:
        spans.append((start, len(text)))
    return spans


def _boundaries(text: str) -> list[list[int]]:
    """Cut positions by strength, strongest first. Inside a fence only lines and weaker count."""
    fences = _fenced(text)
    starts = [a for a, _ in fences]

    def free(p: int) -> bool:
        i = bisect.bisect_right(starts, p) - 1
        return i < 0 or not fences[i][0] < p < fences[i][1]

    headings = [m.start() for m in _HEADING.finditer(text) if free(m.start())]
    blanks = [m.end() for m in _BLANK.finditer(text) if free(m.end())]
    edges = sorted({p for a, b in fences for p in (a, b + 1) if 0 < p < len(text)})
    return [
        headings,
        sorted({*blanks, *edges}),
        [m.end() for m in _LINE.finditer(text)],
        [m.end() for m in _SENTENCE.finditer(text)],
        [m.end() for m in _CLAUSE.finditer(text)],
        [m.end() for m in _SPACE.finditer(text)],
    ]


def _joined(text: str, p: int) -> bool:
    """Whether a cut at p parts a character from its combining marks or joiners."""
    a, b = text[p - 1], text[p]
    return unicodedata.combining(b) != 0 or b in "‍️︎" or a == "‍" or "\U0001f3fb" <= b <= "\U0001f3ff"


def bisect_text(text: str, limit: int, overlap: int) -> list[tuple[int, int, int, int, str, str]]:
    """(piece_index, start, core_start, end, boundary, text) of each piece, in order.

    Cores [core_start, end) partition the text; start < core_start where the piece repeats the
    end of the one before. No piece exceeds limit. A text within the limit is one piece. An
    overlap that leaves no room is lowered to limit - 1; a limit below 1 is taken as 1.
    """
    limit = max(1, limit)
    if len(text) <= limit:
        return [(0, 0, 0, len(text), "end", text)]
    overlap = min(max(0, overlap), limit - 1)
    room = limit - overlap
    levels = _boundaries(text)
    cores: list[tuple[int, int, str]] = []
    todo = [(0, len(text), "end")]
    while todo:
        a, b, why = todo.pop()
        # the first piece repeats nothing, so it may use the whole limit
        if b - a <= (limit if a == 0 else room):
            cores.append((a, b, why))
            continue
        mid, reach = (a + b) / 2, max(1.0, (b - a) * WINDOW / 2)
        cut, name = -1, NAMES[-1]
        for level, positions in enumerate(levels):
            i = bisect.bisect_left(positions, mid)
            near = [p for p in positions[max(0, i - 1) : i + 1] if a < p < b and abs(p - mid) <= reach]
            if near:
                cut, name = min(near, key=lambda p: abs(p - mid)), NAMES[level]
                break
        if cut < 0:
            cut = min(b - 1, max(a + 1, round(mid)))
            while cut > a + 1 and _joined(text, cut):
                cut -= 1
            if _joined(text, cut):
                cut = min(b - 1, max(a + 1, round(mid)))
        todo.append((cut, b, why))
        todo.append((a, cut, name))
    # Neighbours that fit together again are one piece: halving leaves more pieces than needed.
    merged: list[tuple[int, int, str]] = []
    for a, b, why in cores:
        if merged and b - merged[-1][0] <= (limit if merged[-1][0] == 0 else room) and merged[-1][2] not in NAMES[:2]:
            merged[-1] = (merged[-1][0], b, why)
        else:
            merged.append((a, b, why))
    out = []
    for k, (a, b, why) in enumerate(merged):
        start = a
        if k and overlap:
            low = max(merged[k - 1][0], a - overlap)
            start = low
            for positions in levels[3:]:  # begin the overlap at a sentence, else a clause, else a word
                i = bisect.bisect_left(positions, low)
                if i < len(positions) and positions[i] <= a - max(1, overlap // 2):
                    start = positions[i]
                    break
            while start < a and start > 0 and _joined(text, start):
                start += 1
        out.append((k, start, a, b, why, text[start:b]))
    return out


def split_oversized(df: DataFrame, text: str, limit: Column, overlap: Column, keys: list[str], once: bool = False) -> DataFrame:
    """One row per piece of each text in df: keys, piece_index, start, core_start, end, boundary, piece.

    Texts within their limit never reach Python: they come out as one piece with boundary 'end'.
    Null text or null limit: one piece, unchanged (nothing to cut by). Empty text: one empty
    piece. Ties between boundaries go to the one before the middle. Repeated rows are cut alike.
    Columns of df other than keys are not carried, so clashing names do no harm. No shuffle, unless
    once is set: then rows of equal keys count once, the long texts and the others each among themselves,
    so that whoever asks only for what was cut shuffles no other text.
    """
    base = df.select(*keys, F.col(text).alias("__text"), limit.cast("int").alias("__limit"), overlap.cast("int").alias("__overlap"))
    long = F.col("__limit").isNotNull() & (F.length("__text") > F.col("__limit"))

    short, large = base.where(~F.coalesce(long, F.lit(False))), base.where(long)
    if once:
        short, large = short.dropDuplicates(keys), large.dropDuplicates(keys)

    @F.pandas_udf(PIECES)
    def cut(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        names = ("piece_index", "start", "core_start", "end", "boundary", "text")
        for t, n, o in batches:
            yield pd.Series([[dict(zip(names, p)) for p in bisect_text(x, int(a), 0 if pd.isna(b) else int(b))] for x, a, b in zip(t, n, o)])

    small = short.select(
        *keys,
        F.lit(0).alias("piece_index"), F.lit(0).alias("start"), F.lit(0).alias("core_start"), F.length("__text").alias("end"), F.lit("end").alias("boundary"), F.col("__text").alias("piece"),
    )
    big = large.select(*keys, F.explode(cut("__text", "__limit", "__overlap")).alias("p")).select(
        *keys, "p.piece_index", "p.start", "p.core_start", "p.end", "p.boundary", F.col("p.text").alias("piece")
    )
    return small.unionByName(big)


def section_texts(sections: DataFrame) -> DataFrame:
    """doc_id, section_index, format, text: heading unless null or empty, and the lines, joined by newlines.

    Null lines within the array count as empty lines; a null array adds nothing.
    """
    head = F.when(F.length("heading") > 0, F.array("heading")).otherwise(F.array().cast("array<string>"))
    body = F.coalesce("lines", F.array().cast("array<string>"))
    return sections.select("doc_id", "section_index", F.lower(F.trim("format")).alias("format"), F.array_join(F.concat(head, body), "\n", "").alias("text"))


def split_sections(sections: DataFrame, budgets: DataFrame) -> DataFrame:
    """Pieces of every section under the limits of its format (budgets: format, max_chars, overlap_chars).

    A format without a budget is not cut. Redelivered sections are cut once. The budgets are joined
    without a hint: Spark broadcasts them only while their measured size is under its threshold.
    """
    b = budgets.select(F.lower(F.trim("format")).alias("format"), "max_chars", "overlap_chars").dropDuplicates(["format"])
    t = section_texts(sections).join(b, "format", "left")
    return split_oversized(t, "text", F.col("max_chars"), F.col("overlap_chars"), ["doc_id", "section_index", "format"], once=True)
