"""Word-first language scoring with backoff to shorter character n-grams.

The model is a classifier fitted on a bounded sample of labelled rows (ROWS_PER_LANGUAGE rows of
each language, chosen by a hash of the row's key), in two passes: the first counts under the given
labels, the second under the labels the first model gives to each sentence, which removes most of
the wrong labels. Its tables are bounded by TYPES entries of each language and n-gram length, so
it can be broadcast at any size of the corpus.
"""

from __future__ import annotations

import collections
import math
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyra.llm.langs import CODES, normal_column

ROWS_PER_LANGUAGE = 6000
TYPES = 12000
LONGEST = 5
#: A row counts a word so many times at most, so that one long text with a wrong label teaches nothing.
ROW_CAP = 2
#: So many unseen words are remembered with their scores.
MEMORY = 100_000

#: Letters in runs; a run of one script among Han, Kana and Hangul counts as one word.
WORD = re.compile(r"[぀-ヿー]+|[㐀-鿿豈-﫿々]+|[가-힯ᄀ-ᇿ]+|(?:(?![぀-ヿ㐀-鿿豈-﫿가-힯])[^\W\d_])+")
SEGMENT = re.compile(r"(?:[.!?…]+[\"'”’»)\]]*(?=\s)|[。！？]+[」』”’]*|\n+|\s/\s)\s*")


_SCRIPTS = re.compile(r"[぀-ヿ㐀-鿿豈-﫿가-힯ᄀ-ᇿ]")
_PLAIN = re.compile(r"[^\W\d_]+")


def words(text: str) -> list[str]:
    return (WORD if _SCRIPTS.search(text) else _PLAIN).findall(text.lower())


def segments(text: str) -> list[tuple[int, int]]:
    """Spans of sentences and lines that partition text."""
    out, a = [], 0
    for m in SEGMENT.finditer(text):
        if m.end() > a:
            out.append((a, m.end()))
            a = m.end()
    if a < len(text):
        out.append((a, len(text)))
    return out


def grams(word: str, n: int) -> list[str]:
    w = f" {word} " if n > 1 else word
    return [w[i : i + n] for i in range(len(w) - n + 1)]


class LanguageModel:
    """Log frequencies of words and n-grams; score() gives one number per language."""

    #: What one switch of language between neighbouring segments costs, in nats.
    SWITCH = 4.5

    def __init__(self, word_counts: dict[str, dict[str, int]], gram_counts: list[dict[str, dict[str, int]]]):
        self.words = self._table(word_counts, 0.3)
        self.grams = [self._table(c, 0.5) for c in gram_counts]

    @staticmethod
    def _table(counts: dict[str, dict[str, int]], smooth: float) -> dict[str, np.ndarray]:
        total = np.full(len(CODES), 1.0)
        at = {c: i for i, c in enumerate(CODES)}
        for c in counts.values():
            for lang, n in c.items():
                total[at[lang]] += n
        floor = np.log(smooth / (total + smooth * (len(counts) + 1)))
        # A language without any data must not look likelier than one with much.
        floor = np.full(len(CODES), floor.min())
        out = {}
        for key, c in counts.items():
            v = floor.copy()
            for lang, n in c.items():
                v[at[lang]] = math.log((n + smooth) / (total[at[lang]] + smooth * (len(counts) + 1)))
            out[key] = v.astype(np.float32)
        return out

    def known(self, word: str) -> bool:
        return word in self.words

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("_row", "_matrix", "_used")}

    def _remember(self) -> None:
        """Rows of known words in one matrix; scores of unseen words are added to it, and forgotten from time to time."""
        if not hasattr(self, "_row") or self._used > len(self.words) + MEMORY:
            self._row = {w: i for i, w in enumerate(self.words)}
            self._used = len(self.words)
            self._matrix = np.zeros((self._used + 1024, len(CODES)), dtype=np.float32)
            if self.words:
                self._matrix[: self._used] = list(self.words.values())

    def _unseen(self, word: str) -> int:
        if self._used == len(self._matrix):
            self._matrix = np.concatenate([self._matrix, np.zeros_like(self._matrix)])
        self._matrix[self._used] = self._backoff(word)
        if len(word) <= 40:
            self._row[word] = self._used
        self._used += 1
        return self._used - 1

    def vectors(self, tokens: list[str]) -> np.ndarray:
        """A row of scores for each word: by its log frequencies, or by backoff where it is unseen."""
        self._remember()
        at = list(map(self._row.get, tokens))
        if None in at:
            for k, i in enumerate(at):
                if i is None:
                    at[k] = self._row.get(tokens[k]) or self._unseen(tokens[k])
        return self._matrix[at]

    def totals(self, text: str) -> np.ndarray:
        """Scores of the whole text."""
        found = words(text)
        return self.vectors(found).sum(axis=0, dtype=np.float64) if found else np.zeros(len(CODES))

    def _backoff(self, word: str) -> np.ndarray:
        """An unseen word: each position by the longest known n-gram that begins there, averaged by length."""
        padded, total, i, steps = f" {word} ", np.zeros(len(CODES)), 0, 0
        while i < len(padded):
            for n in range(min(LONGEST, len(padded) - i), 0, -1):
                v = self.grams[n - 1].get(padded[i : i + n])
                if v is not None:
                    total += v
                    steps += 1
                    i += max(1, n - 1)
                    break
            else:
                i += 1
        # A run of Han, Kana or Hangul holds several words; of other scripts one, whose n-grams overlap.
        return total / max(1, steps) * (steps if word and word[0] >= "\u3040" else min(steps, 2))

    def spans(self, text: str) -> list[tuple[int, int, str, float]]:
        """(start, end, language, confidence) of the maximal parts of one language, by the best path."""
        return [x[:4] for x in self.parts(text)]

    def parts(self, text: str) -> list[tuple[int, int, str, float, list[str]]]:
        """The same with the words of each part."""
        parts = [(a, b, t) for a, b in segments(text) if (t := words(text[a:b]))]
        if not parts:
            return []
        sizes = np.array([len(t) for _, _, t in parts])
        s = np.add.reduceat(self.vectors([w for _, _, t in parts for w in t]), np.cumsum(sizes) - sizes, axis=0, dtype=np.float64)
        first = s.argmax(axis=1)
        if (first == first[0]).all():  # no path is better than the one that is best everywhere
            k = int(first[0])
            return [(0, len(text), CODES[k], self._confidence(s.sum(axis=0), int(sizes.sum()), k), [w for _, _, t in parts for w in t])]
        best, back = s[0].copy(), []
        for row in s[1:]:
            jump = best.max() - self.SWITCH
            stay = best >= jump
            back.append(np.where(stay, np.arange(len(CODES)), int(best.argmax())))
            best = np.where(stay, best, jump) + row
        path = [int(best.argmax())]
        for b in reversed(back):
            path.append(int(b[path[-1]]))
        path.reverse()
        out: list[list] = []
        for (a, b, t), k, row in zip(parts, path, s):
            if out and out[-1][2] == k:
                out[-1][1] = b
                out[-1][3] += row
                out[-1][4] += t
            else:
                out.append([a, b, k, row.copy(), list(t)])
        for prev, nxt in zip(out, out[1:]):
            prev[1] = nxt[0]
        if out:
            out[0][0], out[-1][1] = 0, len(text)
        return [(a, b, CODES[k], self._confidence(v, len(t), k), t) for a, b, k, v, t in out]

    @staticmethod
    def _confidence(v: np.ndarray, n: int, k: int) -> float:
        """Posterior of language k under a tempered likelihood (words of one text are not independent)."""
        z = v / max(1.0, n**0.5)
        z = np.exp(z - z.max())
        return round(float(z[k] / z.sum()), 4)

    def shares(self, text: str, spans: list[tuple[int, int, str, float]] | None = None) -> list[tuple[str, float, float]]:
        """(language, share of the non-white-space characters, confidence), largest first. spans: the text's, where at hand."""
        size: dict[str, int] = defaultdict(int)
        sure: dict[str, float] = defaultdict(float)
        for a, b, lang, conf in self.spans(text) if spans is None else spans:
            n = len("".join(text[a:b].split()))
            size[lang] += n
            sure[lang] += n * conf
        total = sum(size.values())
        return sorted(((k, n / total, round(sure[k] / n, 4)) for k, n in size.items() if n), key=lambda x: (-x[1], x[0]))


def _build(word_rows: dict[tuple[str, str], int], backoff: bool = True) -> LanguageModel:
    by_word: dict[str, dict[str, int]] = defaultdict(dict)
    by_gram: list[dict[str, dict[str, int]]] = [defaultdict(lambda: defaultdict(int)) for _ in range(LONGEST)]
    for (lang, w), n in word_rows.items():
        by_word[w][lang] = n
        for k in range(1, LONGEST + 1 if backoff else 1):
            for g in grams(w, k):
                by_gram[k - 1][g][lang] += n
    kept = [{g: dict(c) for g, c in t.items() if sum(c.values()) > 2} for t in by_gram]
    return LanguageModel({w: c for w, c in by_word.items() if sum(c.values()) > 1}, kept)


def _top_words(tokens: DataFrame) -> dict[tuple[str, str], int]:
    """Counts of the TYPES most frequent words of each language: a bounded result."""
    from pyspark.sql import Window

    counts = tokens.groupBy("lang", "w").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "w"))
    rows = counts.withColumn("r", rank).where(F.col("r") <= TYPES).select("lang", "w", "n")
    return {(r.lang, r.w): r.n for r in rows.toLocalIterator()}


def fit(df: DataFrame, text: str, label: str, keys: list[str], rows_per_language: int = ROWS_PER_LANGUAGE, refine: bool = True, backoff: bool = True) -> LanguageModel:
    """Fit on a bounded sample of df's labelled rows. Rows without text or language are left out.

    With no labelled row at all the model is empty and gives every language the same score.
    refine=False leaves out the second pass: enough to tell the language of whole documents.
    backoff=False keeps known words only.
    """
    rows = df.select(*keys, F.col(text).alias("t"), normal_column(F.col(label)).alias("lang")).where("lang is not null and length(t) > 0")
    per = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not per:
        return _build({}, backoff)
    share = F.create_map(*[x for k, n in per.items() for x in (F.lit(k), F.lit(min(1.0, rows_per_language / n)))])
    draw = F.pmod(F.xxhash64(*keys), F.lit(1_000_003)) / F.lit(1_000_003.0)
    sample = rows.where(draw < F.try_element_at(share, F.col("lang"))).select("t", "lang")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            c: dict[tuple[str, str], int] = defaultdict(int)
            for t, lang in zip(b["t"], b["lang"]):
                for w, n in collections.Counter(words(t)).items():
                    c[lang, w] += min(n, ROW_CAP)
            yield pd.DataFrame([(k, w, n) for (k, w), n in c.items()], columns=["lang", "w", "n"])

    first = _build(_top_words(sample.mapInPandas(count, "lang string, w string, n long")), backoff)
    if not refine:
        return first
    shared = df.sparkSession.sparkContext.broadcast(first)

    def recount(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for b in batches:
            c: dict[tuple[str, str], int] = defaultdict(int)
            for t in b["t"]:
                of: dict[str, collections.Counter[str]] = defaultdict(collections.Counter)
                for _, _, lang, conf, found in m.parts(t):
                    if conf > 0.8:
                        of[lang].update(found)
                for lang, found in of.items():
                    for w, n in found.items():
                        c[lang, w] += min(n, ROW_CAP)
            yield pd.DataFrame([(k, w, n) for (k, w), n in c.items()], columns=["lang", "w", "n"])

    return _build(_top_words(sample.mapInPandas(recount, "lang string, w string, n long")))
