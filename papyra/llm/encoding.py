"""Problem 5: find text decoded with the wrong character encoding and give back the original.

Characters are mapped back to the bytes of a legacy encoding, an automaton over those bytes (a
compiled regular expression in the characters that stand for them) finds the maximal well-formed
multibyte spans, and only those spans are decoded. Two kinds of damage have no multibyte
structure and are found by the same mapping with a lexicon as the judge: one single-byte encoding
read as another, and letters replaced by '?' or U+FFFD.
"""

from __future__ import annotations

import codecs
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyra.llm.langs import NOTATION
from papyra.session import cut_lineage

#: Single-byte encodings a text may have been read as.
READ_AS = ("cp1252", "cp1250", "cp1251", "cp1253", "cp1254", "mac_roman", "cp437", "cp850", "koi8_r", "cp866", "iso8859_2", "iso8859_15")
#: Double-byte encodings, as the true one or as the one a text was read as.
DOUBLE = ("gb18030", "shift_jis", "euc_jp", "cp949", "big5")
#: (true, read as) among single-byte encodings.
_SINGLE = {
    "cp1252": ("mac_roman", "cp437", "cp850", "cp1251", "cp1253", "cp1250", "koi8_r", "cp866"),
    "cp1250": ("cp1252", "mac_roman", "cp437"),
    "iso8859_2": ("cp1252", "mac_roman"),
    "cp1251": ("cp1252", "koi8_r", "cp866", "mac_roman", "cp437"),
    "koi8_r": ("cp1251", "cp1252", "cp866"),
    "cp866": ("cp1251", "cp1252", "cp437"),
    "mac_roman": ("cp1252",),
    "cp850": ("cp1252",),
    "cp437": ("cp1252",),
}
SINGLE = tuple((t, w) for t, wrong in _SINGLE.items() for w in wrong)
#: The lexicon that is broadcast holds at most so many tokens, the most frequent ones (about 20 MB as a table of words).
LEXICON = 200_000
LEAST = 3
#: Longer tokens are runs of a script without spaces; they are looked at, but vouch for nothing.
LONGEST_TOKEN = 60
#: What is remembered of tokens and runs seen before.
MEMORY = 200_000
#: How much more usual than the token as it stands its repair must be.
RATIO = 20

RESULT = "struct<garbled:boolean,lost:boolean,fixed:string,route:string>"

#: An original character is one of those: letters of the twelve languages and common signs.
_SIGNS = set("’‘“”„«»‹›–—…·•¿¡°±×÷§©®€£¥§№º²³½¼ªµØ‚¨ \xa0、。，．・「」『』（）：；？！【】《》〈〉〜～ー々％＆＋／")
_ASCII_EDGE = " \t\n\r!\"#$%&'()*+,-./0123456789:;<=>?@[\\]^_`{|}~"


@lru_cache(None)
def _byte_of(codec: str) -> dict[str, int]:
    """Character to byte, for bytes from 0x80; undefined bytes are read as C1 controls."""
    out: dict[str, int] = {}
    for b in range(0x80, 0x100):
        try:
            out[bytes([b]).decode(codec)] = b
        except UnicodeDecodeError:
            out[chr(b)] = b
    if codec in ("cp1252", "iso8859_15"):  # the same text as read by ISO 8859-1
        for b in range(0x80, 0xA0):
            out.setdefault(chr(b), b)
    return out


@lru_cache(None)
def _automaton(codec: str) -> re.Pattern[str]:
    """Well-formed UTF-8 sequences, written in the characters that codec shows for their bytes."""
    by = _byte_of(codec)

    def cls(lo: int, hi: int) -> str:
        return "[" + "".join(re.escape(c) for c, b in by.items() if lo <= b <= hi) + "]"

    t = cls(0x80, 0xBF)
    return re.compile(f"(?:{cls(0xC2, 0xDF)}{t}|{cls(0xE0, 0xEF)}{t}{t}|{cls(0xF0, 0xF4)}{t}{t}{t})+")


@lru_cache(None)
def _leads(codec: str) -> tuple[frozenset[str], frozenset[str]]:
    """Characters that codec shows for bytes that begin and that continue a UTF-8 sequence: a span needs one of each."""
    by = _byte_of(codec)
    return frozenset(c for c, b in by.items() if 0xC2 <= b <= 0xF4), frozenset(c for c, b in by.items() if b <= 0xBF)


def _automata_for(text: str) -> list[str]:
    """The codecs whose automaton can find anything in text."""
    here = set(text)
    return [c for c in READ_AS for lead, follow in (_leads(c),) if not lead.isdisjoint(here) and not follow.isdisjoint(here)]


codecs.register_error("papyra-ff", lambda e: (b"\xff" * (e.end - e.start), e.end))

_UTF8 = re.compile(rb"(?:[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3})+")
_HIGH = re.compile(r"[^\x00-\x7f]+")
_HIGH_MIXED = re.compile(r"[^\x00-\x7f](?:[!-~]?[^\x00-\x7f])*[@-~]?")
_TOKEN = re.compile(r"\S*[^\x00-\x7f\s]\S*")
_QUESTION = re.compile(r"[^\s?]*\?[^\s]*")
_MANY = re.compile(r"\?{4,}|(?:\?{2,}[^\w\s]?){2,}")


class Judge:
    """The bounded lexicon: tokens with a character beyond ASCII, and the usual characters."""

    def __init__(self, tokens: dict[str, int], chars: dict[str, int], names: tuple[str, ...] = ()):
        self.tokens = {**{n: 10**9 for n in names}, **tokens}
        self.names = frozenset(names)
        self.chars = chars
        for t, n in tokens.items():  # a garbled token must not vouch for another
            for codec in _automata_for(t):
                fixed = _automaton(codec).sub(lambda m: _decode(m.group(), codec) or m.group(), t)  # noqa: B023
                if fixed != t and tokens.get(fixed.lower(), 0) >= n and fixed.lower() != t:
                    self.tokens.pop(t, None)
        self.turns: dict[str, list[tuple[tuple[str, str], str]]] = {}
        self.doubles: dict[tuple[str, bool, str], list[tuple[str, float, str]]] = {}
        self.total = max(1, sum(chars.values()))
        self.usual = {c for c, n in chars.items() if n >= 3 and n * 2e5 >= self.total}
        self.fine = self.usual | _SIGNS
        self.masked = defaultdict(int)
        for t, n in tokens.items():
            if n >= LEAST:
                self.masked[re.sub(r"[^\x00-\x7f]", "?", t)] += n
        for t in names:
            self.masked[re.sub(r"[^\x00-\x7f]", "?", t)] += 10**9

    def count(self, token: str) -> int:
        return self.tokens.get(token, 0)

    def share(self, text: str) -> float:
        """Share of the characters beyond ASCII that are usual in the corpus."""
        high = [c for c in text if c > "\x7f"]
        return sum(map(self.fine.__contains__, high)) / len(high) if high else 1.0


def tokens_of(text: str) -> list[str]:
    """White-space tokens without ASCII signs at their edges that hold a character beyond ASCII."""
    return [x for t in _TOKEN.findall(text.lower()) if len(x := t.strip(_ASCII_EDGE)) <= LONGEST_TOKEN]


def _decode(span: str, codec: str) -> str | None:
    by = _byte_of(codec)
    try:
        return bytes(by[c] for c in span).decode("utf-8")
    except (UnicodeDecodeError, KeyError):
        return None


def _plausible(s: str, judge: Judge) -> bool:
    high = [c for c in s if c > "\x7f"]
    return sum(c in judge.usual or c in _SIGNS or (c.isalpha() and ord(c) < 0x250) for c in high) >= 0.85 * len(high)


def _spans_single(text: str, judge: Judge) -> tuple[float, str, str] | None:
    """UTF-8 read as a single-byte encoding: the codec whose automaton takes most characters."""
    best: tuple[int, str, str] | None = None
    for codec in _automata_for(text):
        used = 0

        def put(m: re.Match[str], codec: str = codec) -> str:
            nonlocal used
            s = _decode(m.group(), codec)
            if s is None or not _plausible(s, judge):
                return m.group()
            # one pair may be a chance; it must make the token around it more usual
            if len(m.group()) < 4 and _word_gain(text, m, s, judge) <= 0:
                return m.group()
            used += len(m.group())
            return s

        fixed = _automaton(codec).sub(put, text)
        if used and (best is None or used > best[0]):
            best = (used, codec, fixed)
    return (best[0], best[2], f"utf-8 as {best[1]}") if best else None


def _word_gain(text: str, m: re.Match[str], s: str, judge: Judge) -> int:
    a, b = m.start(), m.end()
    while a > 0 and not text[a - 1].isspace() and m.start() - a < 30:
        a -= 1
    while b < len(text) and not text[b].isspace() and b - m.end() < 30:
        b += 1
    old = text[a:b].lower().strip(_ASCII_EDGE)
    new = (text[a : m.start()] + s + text[m.end() : b]).lower().strip(_ASCII_EDGE)
    gain = judge.count(new) - 3 * judge.count(old)
    if judge.count(new) == 0 and judge.count(old) == 0:  # the rest of the token may be garbled too
        gain = 1 if all(c in judge.fine for c in s if c > "\x7f") and not all(c in judge.usual for c in m.group()) else 0
    return gain


def _spans_double(text: str, judge: Judge) -> tuple[str, str] | None:
    """UTF-8 read as a double-byte encoding (Han or Hangul in the place of other text)."""
    # a run whose characters are usual can't gain what a repair has to
    odd = {run: x for run in set(_HIGH.findall(text)) if not judge.fine.issuperset(run) and (x := judge.share(run.replace("�", ""))) <= 0.8}
    best: tuple[int, str, str] | None = None
    for codec in ("gb18030", "cp932", "cp949", "big5") if odd else ():
        used = 0

        def put(m: re.Match[str], codec: str = codec) -> str:
            nonlocal used
            if m.group() not in odd:
                return m.group()
            raw = m.group().encode(codec, "papyra-ff")
            if sum(map(len, _UTF8.findall(raw))) < 0.6 * len(raw.replace(b"\xff", b"")):
                return m.group()
            out, last, taken = [], 0, 0
            for u in _UTF8.finditer(raw):
                try:
                    s = u.group().decode("utf-8")
                except UnicodeDecodeError:
                    continue
                out.append(raw[last : u.start()].decode(codec, "replace") + s)
                last = u.end()
                taken += len(u.group())
            if not taken or taken < 0.6 * len(raw.replace(b"\xff", b"")):
                return m.group()
            fixed = "".join(out) + raw[last:].decode(codec, "replace")
            if judge.share(fixed.replace("�", "")) < odd[m.group()] + 0.2:
                return m.group()
            used += taken
            return fixed

        fixed = _HIGH.sub(put, text)
        if used and (best is None or used > best[0]):
            best = (used, codec, fixed)
    return (best[2], f"utf-8 as {best[1]}") if best else None


def _as_double(span: str, wrong: str, pure: bool, judge: Judge) -> list[tuple[str, float, str]]:
    """(true encoding, bytes it explains, text) for every double-byte encoding that a span read as wrong may be of."""
    known = judge.doubles.get((wrong, pure, span))
    if known is not None:
        return known
    by, out = _byte_of(wrong), []
    if sum(c > "\x7f" for c in span) >= 3 and all(c in by or c <= "\x7f" for c in span):
        raw = bytes(by.get(c, ord(c) & 0x7F) for c in span)
        for true in ("euc_jp",) if pure else ("gb18030", "shift_jis", "cp949", "big5"):
            s = raw.decode(true, "ignore")
            if not s or len(s.encode(true, "ignore")) < 0.8 * len(raw):
                continue
            good = sum(map(judge.fine.__contains__, s)) / len(s)
            named = s.lower() in judge.names
            if (good >= 0.9 or named) and sum(c >= "　" for c in s) >= 0.6 * len(s):
                out.append((true, len(raw) * (good + named), s))
    if len(judge.doubles) < MEMORY and len(span) <= LONGEST_TOKEN:
        judge.doubles[wrong, pure, span] = out
    return out


def _double_as_single(text: str, judge: Judge) -> tuple[float, str, str] | None:
    """A double-byte encoding read as a single-byte one: maximal spans of well-formed pairs."""
    spans = [(pure, [x for x in pattern.findall(text) if len(x) >= 3]) for pure, pattern in ((True, _HIGH), (False, _HIGH_MIXED))]
    if not spans[1][1]:
        return None
    best: tuple[float, str, str] | None = None
    for wrong in ("cp1252", "cp1251", "mac_roman", "cp437"):
        if _byte_of(wrong).keys().isdisjoint(text):
            continue
        used: dict[str, float] = defaultdict(float)
        for pure, found in spans:
            for x in found:
                for true, n, _ in _as_double(x, wrong, pure, judge):
                    used[true] += n
        for true in DOUBLE:
            if used.get(true) and (best is None or used[true] > best[0]):
                turn = {}
                for x in spans[0 if true == "euc_jp" else 1][1]:
                    turn.update({x: s for t, _, s in _as_double(x, wrong, true == "euc_jp", judge) if t == true})
                fixed = (_HIGH if true == "euc_jp" else _HIGH_MIXED).sub(lambda m: turn.get(m.group(), m.group()), text)  # noqa: B023
                best = (used[true], f"{true} as {wrong}", fixed)
    return (best[0], best[2], best[1]) if best else None


def _turns(token: str, judge: Judge) -> list[tuple[tuple[str, str], str]]:
    """What a token may have been, by pair of encodings: only far more usual tokens count."""
    if token in judge.turns:
        return judge.turns[token]
    out = []
    n = judge.count(token.lower())
    for true, wrong in SINGLE:
        by = _byte_of(wrong)
        if all(c in by or c <= "\x7f" for c in token):
            try:
                s = bytes(by.get(c, ord(c) & 0x7F) for c in token).decode(true)
            except UnicodeDecodeError:
                continue
            if s != token and judge.count(s.lower()) > RATIO * n + LEAST:
                out.append(((true, wrong), s))
    if len(judge.turns) < MEMORY:
        judge.turns[token] = out
    return out


def _single_as_single(text: str, judge: Judge) -> tuple[str, str] | None:
    """One single-byte encoding read as another: the pair that makes most tokens usual ones.

    A token of one character proves nothing by itself: it must stand there twice.
    """
    found: dict[tuple[str, str], dict[str, str]] = defaultdict(dict)
    counts = Counter([x for t in _TOKEN.findall(text) if len(x := t.strip(_ASCII_EDGE)) <= LONGEST_TOKEN])
    for t in counts:
        for pair, s in _turns(t, judge):
            found[pair][t] = s
    best: tuple[int, tuple[str, str]] | None = None
    for pair, turned in found.items():
        if all(len(t) == 1 and counts[t] < 2 for t in turned):
            continue
        n = sum(len(t) * counts[t] for t in turned)
        if best is None or n > best[0]:
            best = (n, pair)
    if best is None:
        return None
    turned = found[best[1]]
    by, true = _byte_of(best[1][1]), best[1][0]
    for t in counts:  # the same map turns what the lexicon doesn't know, where it makes odd characters usual
        if t not in turned and judge.count(t.lower()) < LEAST and all(c in by or c <= "\x7f" for c in t):
            try:
                s = bytes(by.get(c, ord(c) & 0x7F) for c in t).decode(true)
            except UnicodeDecodeError:
                continue
            if all(c in judge.fine for c in s if c > "\x7f"):
                turned[t] = s
    fixed = re.sub(r"\S+", lambda m: m.group().replace(t, turned[t]) if (t := m.group().strip(_ASCII_EDGE)) in turned else m.group(), text)
    return fixed, f"{best[1][0]} as {best[1][1]}"


def _lost(text: str, judge: Judge) -> bool:
    if "�" in text:
        return True
    if "?" not in text:
        return False
    if _MANY.search(text) or (len(text.strip()) > 1 and not text.strip().strip("?")):
        return True
    for m in _QUESTION.finditer(text):
        t = m.group().lower().strip(_ASCII_EDGE.replace("?", ""))
        if "://" in t or "www." in t:
            continue
        for x in (t, t.rstrip("?"), t.lstrip("?")):
            if "?" in x and not set(x) <= {"?"} and judge.masked.get(x, 0) >= LEAST:
                return True
    return False


def repair(text: str | None, judge: Judge) -> tuple[bool, bool, str | None, str | None]:
    """(garbled, lost, fixed, route). lost: something can't be given back. Null and empty: untouched."""
    if not text:
        return False, False, text, None
    if text.isascii():
        return (gone := _lost(text, judge)), gone, text, None
    fixed, routes = text, []
    if text.strip().lower() not in judge.names:
        for _ in range(4):
            # of the two with multibyte structure the one that explains more of the text
            structured = max((x for x in (_spans_single(fixed, judge), _double_as_single(fixed, judge)) if x), default=None)
            step = structured[1:] if structured else _spans_double(fixed, judge) or (None if routes else _single_as_single(fixed, judge))
            if step is None or step[0] == fixed:
                break
            fixed = step[0]
            routes.append(step[1])
    lost = _lost(text, judge) or _lost(fixed, judge)
    return bool(routes) or lost, lost, fixed, "; ".join(routes) or None


def fit_judge(df: DataFrame, text: str) -> Judge:
    """Count tokens and characters beyond ASCII over all rows; keep at most LEXICON of each.

    The counts cover the whole table; the bound only limits what is broadcast: the most frequent
    tokens, which are the ones that can vouch for a repair.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            c: dict[tuple[bool, str], int] = defaultdict(int)
            for t in b["t"]:
                if not t.isascii():
                    for w in tokens_of(t):
                        c[False, w] += 1
                    for ch in t:
                        if ch > "\x7f":
                            c[True, ch] += 1
            yield pd.DataFrame([(k, w, n) for (k, w), n in c.items()], columns=["single", "w", "n"])

    rows = df.select(F.col(text).alias("t")).where("t is not null and length(t) > 0")
    counts = rows.mapInPandas(count, "single boolean, w string, n long").groupBy("single", "w").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST)
    counts = cut_lineage(counts)

    def top(single: bool) -> dict[str, int]:
        return {r.w: r.n for r in counts.where(F.col("single") == single).orderBy(F.desc("n"), "w").limit(LEXICON).collect()}

    tokens, chars = top(False), top(True)
    return Judge(tokens, chars, tuple(NOTATION))


def repair_column(df: DataFrame, text: str, out: str, judge: Judge) -> DataFrame:
    """df with a struct column out (RESULT) for the column text. Narrow: no shuffle."""
    shared = df.sparkSession.sparkContext.broadcast(judge)

    @F.pandas_udf(RESULT)
    def fix(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([repair(x if isinstance(x, str) else None, shared.value) for x in b], columns=["garbled", "lost", "fixed", "route"])

    return df.withColumn(out, fix(F.col(text)))


def find_garbled(pages: DataFrame, runs: DataFrame) -> DataFrame:
    """rec_table, doc_id, rec_index, value, fixed, lost, route of every value that was decoded wrongly.

    Null and empty values are never garbled; redelivered rows give one row. The lexicon comes from
    the pages; values of runs.language are also held against the known names of languages.
    """
    judge = fit_judge(pages, "text_sample")
    a = pages.select(F.lit("pdf_pages").alias("rec_table"), "doc_id", F.col("page_index").alias("rec_index"), F.col("text_sample").alias("value"))
    b = runs.select(F.lit("runs").alias("rec_table"), "doc_id", F.col("run_index").alias("rec_index"), F.col("language").alias("value"))
    some = F.col("value").rlike(r"[^\x00-\x7f]|\?")
    both = repair_column(a.where(some).unionByName(b.where(some)), "value", "r", judge)
    return both.where("r.garbled").select("rec_table", "doc_id", "rec_index", "value", F.col("r.fixed").alias("fixed"), F.col("r.lost").alias("lost"), F.col("r.route").alias("route")).dropDuplicates(["rec_table", "doc_id", "rec_index"])
