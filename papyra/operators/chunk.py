"""Token-budgeted chunking of Markdown: by headings, paragraphs, sentences or words, with overlap.

Packing is sequential within one text, so each text is packed in one Arrow-batched Python call of linear
time; across texts it is one narrow stage. The token counter is a parameter: words by default, as a real
tokenizer's vocabulary may not be at hand.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Counter = Callable[[str], int]
CHUNKS = "array<struct<text:string,token_count:int,heading_context:array<string>>>"
#: A section's own text of so many tokens stands alone; a shorter one stays with what follows.
OWN_TEXT = 2000

_HEADING = re.compile(r"^(#{1,6})\s+(.+)$")
_FENCE = re.compile(r"^\s*(`{3,}|~{3,})")
_PARAGRAPHS = re.compile(r"\n\n+")
_SENTENCES = re.compile(r"(?<=[.!?])\s+")


def count_words(text: str) -> int:
    return len(text.split())


def count_estimate(text: str) -> int:
    return math.ceil(len(text) / 3.5)


@dataclass
class Section:
    level: int
    heading: str
    lines: list[str] = field(default_factory=list)
    children: list[Section] = field(default_factory=list)

    def own(self) -> str:
        head = [f"{'#' * self.level} {self.heading}"] if self.heading else []
        return "\n".join(head + self.lines)

    def full(self) -> str:
        out, todo = [], [self]
        while todo:
            s = todo.pop()
            out.append(s.own())
            todo.extend(reversed(s.children))
        return "\n".join(out)


def scan_headings(lines: list[str]) -> list[tuple[int, int, str]]:
    """(line, level, heading) of each heading outside fences; a fence ends at a line of its own sign, at least as long."""
    found, fence = [], ""
    for i, line in enumerate(lines):
        if m := _FENCE.match(line):
            sign = m.group(1)
            if not fence:
                fence = sign
            elif sign[0] == fence[0] and len(sign) >= len(fence):
                fence = ""
        elif not fence and (m := _HEADING.match(line)):
            found.append((i, len(m.group(1)), m.group(2).strip()))
    return found


def headings(texts: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, line_index, heading_index, level, heading of every heading; null texts have none."""

    @F.pandas_udf("array<struct<line_index:int,level:int,heading:string>>")
    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield pd.Series([[{"line_index": i, "level": k, "heading": h} for i, k, h in scan_headings(x.split("\n"))] if isinstance(x, str) else [] for x in b])

    return texts.select(key, F.posexplode(scan(text)).alias("heading_index", "x")).select(key, "x.line_index", "heading_index", "x.level", "x.heading")


def parse_sections(text: str) -> list[Section]:
    """Tree of sections: each owns the lines from its heading to the next; text before any heading is a section of level 0."""
    lines = text.split("\n")
    marks = scan_headings(lines)
    ends = [i for i, _, _ in marks[1:]] + [len(lines)]
    top: list[Section] = []
    if not marks or marks[0][0] > 0:
        top.append(Section(0, "", lines[: marks[0][0] if marks else len(lines)]))
    above: list[Section] = []
    for (start, level, heading), end in zip(marks, ends):
        section = Section(level, heading, lines[start + 1 : end])
        above = [x for x in above if x.level < level]
        (above[-1].children if above else top).append(section)
        above.append(section)
    return top


def pack(parts: list[str], budget: int, count: Counter, glue: str, oversized: Callable[[str], list[tuple[str, int]]] | None = None) -> list[tuple[str, int]]:
    """(text, tokens) of greedy packs: parts are joined while the sum of their tokens stays within the budget.

    Glue isn't counted. A part above the budget goes through oversized, or stands alone.
    """
    out: list[tuple[str, int]] = []
    held: list[str] = []
    total = 0

    def flush() -> None:
        text = glue.join(x for i, x in enumerate(held) if x or any(held[:i]))
        if text:
            out.append((text, total))

    for part in parts:
        n = count(part)
        if total + n <= budget:
            held.append(part)
            total += n
            continue
        flush()
        if n > budget and oversized is not None:
            out += oversized(part)
            held, total = [], 0
        else:
            held, total = [part], n
    flush()
    return out


def by_sentence(text: str, budget: int, count: Counter) -> list[tuple[str, int]]:
    return pack(_SENTENCES.split(text), budget, count, " ")


def by_paragraph(text: str, budget: int, count: Counter, sentences: bool = False) -> list[tuple[str, int]]:
    return pack(_PARAGRAPHS.split(text), budget, count, "\n\n", (lambda p: by_sentence(p, budget, count)) if sentences else None)


def by_words(text: str, budget: int, count: Counter) -> list[tuple[str, int]]:
    """Words joined while the whole candidate stays within the budget, as a tokenizer sees it."""
    out, held, n = [], "", 0
    for word in text.split():
        candidate = f"{held} {word}" if held else word
        m = count(candidate)
        if m <= budget:
            held, n = candidate, m
        else:
            if held:
                out.append((held, n))
            held, n = word, count(word)
    if held:
        out.append((held, n))
    return out


def by_heading(text: str, budget: int, count: Counter) -> list[tuple[str, int, list[str]]]:
    """Subtrees that fit are chunks; larger ones give up their own text and are entered.

    A short text under a heading with subsections stays before its first subsection, in order.
    """
    out: list[tuple[str, int, list[str]]] = []
    todo: list[tuple[Section, list[str], str]] = [(s, [], "") for s in reversed(parse_sections(text))]
    while todo:
        section, above, lead = todo.pop()
        context = [*above, section.heading] if section.heading else above
        full = f"{lead}\n{section.full()}" if lead else section.full()
        n = count(full)
        if n <= budget:
            if full.strip():
                out.append((full, n, context))
            continue
        own = f"{lead}\n{section.own()}" if lead else section.own()
        carry = ""
        if not section.children or count(own) >= OWN_TEXT:
            out += [(t, k, context) for t, k in by_paragraph(own, budget, count, sentences=True)]
        elif own.strip():
            carry = own
        todo += [(c, context, carry if i == 0 else "") for i, c in reversed(list(enumerate(section.children)))]
    return out


def tail_words(text: str, budget: int, count: Counter) -> str:
    """The last words of a text within a budget."""
    words = text.split()
    lo, hi = 0, len(words)
    # tokens grow with words: the longest tail that fits is found by halving
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if count(" ".join(words[-mid:])) <= budget:
            lo = mid
        else:
            hi = mid - 1
    return " ".join(words[len(words) - lo :]) if lo else ""


def with_overlap(chunks: list[tuple[str, int, list[str]]], overlap: int, count: Counter) -> list[tuple[str, int, list[str]]]:
    """Each chunk after the first begins with the end of the one before as it was without overlap."""
    if overlap <= 0:
        return chunks
    out = chunks[:1]
    for (before, _, _), (text, n, context) in zip(chunks, chunks[1:]):
        tail = tail_words(before, overlap, count)
        text = f"{tail}\n\n{text}" if tail else text
        out.append((text, count(text) if tail else n, context))
    return out


def chunk_text(text: str | None, budget: int, strategy: str, overlap: int = 0, count: Counter = count_words) -> list[tuple[str, int, list[str]]]:
    """(text, tokens, headings above) of each chunk; none for null or blank text. The budget is at least 1."""
    if not text or not text.strip():
        return []
    budget = max(1, budget)
    if strategy == "heading":
        chunks = by_heading(text, budget, count)
    else:
        plain = {"paragraph": by_paragraph, "sentence": by_sentence, "tokens": by_words, "paragraph_sentence": lambda t, b, c: by_paragraph(t, b, c, True)}[strategy]
        chunks = [(t, n, []) for t, n in plain(text, budget, count)]
    return with_overlap(chunks, overlap, count)


def chunks_column(text: Column | str, budget: int, strategy: str, overlap: int = 0, count: Counter = count_words) -> Column:
    @F.pandas_udf(CHUNKS)
    def cut(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield pd.Series([[{"text": t, "token_count": n, "heading_context": c} for t, n, c in chunk_text(x if isinstance(x, str) else None, budget, strategy, overlap, count)] for x in b])

    return cut(text)


def chunk(texts: DataFrame, budget: int, strategy: str, overlap: int = 0, text: str = "text", key: str = "doc_id", count: Counter = count_words) -> DataFrame:
    """key, chunk_index, text, token_count, heading_context; blank texts have no chunk."""
    cut = texts.select(key, F.posexplode(chunks_column(text, budget, strategy, overlap, count)).alias("chunk_index", "c"))
    return cut.select(key, "chunk_index", "c.text", "c.token_count", "c.heading_context")


def chunk_stats(chunks: DataFrame, key: str = "doc_id") -> DataFrame:
    return chunks.groupBy(key).agg(F.count("*").alias("chunks"), F.min("token_count").alias("least"), F.max("token_count").alias("most"), F.floor(F.avg("token_count") + 0.5).cast("int").alias("mean"))
