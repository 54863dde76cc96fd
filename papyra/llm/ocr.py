"""Problem 6: repair the text of scanned pages.

Evidence is gathered in Python once for each page (words, line-end hyphens, edge lines) and judged
in SQL over the whole corpus: rare words are joined with frequent ones whose anagram hash differs
by exactly what one or two known confusions change; broken words are judged by the counts of the
joined and of the hyphenated form; edge lines are running headers where they also stand on another
page of the file, and numbers are page numbers where they advance with the page index.
"""

from __future__ import annotations

import itertools
import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from papyra.session import cut_lineage

#: Fixed values: (true, as read), the usual confusions of character recognition.
CONFUSIONS = (
    ("e", "c"), ("a", "ɑ"), ("i", "í"), ("t", "†"), ("n", "ri"), ("o", "0"), ("d", "cl"), ("u", "ii"), ("l", "1"), ("g", "9"),
    ("m", "rn"), ("h", "li"), ("w", "vv"), ("é", "6"), ("fi", "ﬁ"), ("fl", "ﬂ"), ("ä", "à"), ("s", "5"), ("b", "8"), ("ü", "ii"),
    ("i", "1"), ("l", "|"), ("i", "|"), ("z", "2"), ("q", "9"), ("ll", "ii"), ("l", "i"), ("rn", "m"), ("cl", "d"), ("о", "0"), ("а", "ɑ"), ("з", "3"),
    ("б", "6"), ("ч", "4"), ("т", "†"), ("ó", "6"), ("ö", "6"),
)
#: What single characters fold to when a candidate is verified, position by position.
FOLD_FROM = "†ɑ0196éèêóòöäàáâüúíìl|c58оа3z2qh4б"
FOLD_TO = "taoigeeeeoooaaaauuiiiiesboaзззguчe"
SPECKS = "~^·¦"
HYPHENS = "-‐¬\xad~=—·^¦_"
#: Hyphens that no compound carries of its own.
SOFT = "¬\xad"
#: A variant is believed where the frequent word is so many times more frequent.
RATIO = 8
FREQUENT = 5
#: Lines looked at on either edge of a page; an inner one counts only under outer ones that are headers or numbers.
EDGE_LINES = 3
#: Words of more than this part of all words are held against the corrections one by one: they are fewer than its inverse.
HOT = 0.001
#: So many tokens are remembered with their words.
MEMORY = 200_000
PAGE_BREAK = re.compile(r"\n\s*\n---\n\s*\n|\n---\n")

_WORD = re.compile(r"[^\s]+")
_LINE_END = re.compile(rf"[{re.escape(HYPHENS)}][ \t]*\n\s*(?=\S)")
_CAPITAL = re.compile(r"(?<=[a-zà-ÿ])I+(?=[a-zà-ÿ]|$)")
_PUNCT = ".,;:!?()[]{}<>\"“”„«»‘’'¿¡…-–—/|。、，；：「」"
_CODE = re.compile(r"^[A-Z]{1,4}\d{0,2}-\d+$|^\d[\d.,/:%-]*$|://|@|^www\.")
_PART = re.compile(r"[-‐–’'/]")
_LETTER = r"[^\W\d_]"
_BROKEN = re.compile(rf"(\S*{_LETTER}[{SPECKS}]?|\S*{_LETTER}[\w†|]*)([{re.escape(HYPHENS)}])[ \t]*\n\s*(?=\S)([^\s]+)")
_ROMAN = re.compile(r"^m{0,3}(cm|cd|d?c{0,3})(xc|xl|l?x{0,3})(ix|iv|v?i{0,3})$")
_NUMBER = re.compile(r"^(?P<form>[-–—·•\[(|]*\s*(?:page|p\.|pag\.|pág\.|seite|s\.|стр\.|str\.|第)?\s*)(?P<n>\d{1,4}|[ivxlcdm]{1,8})(?P<of>\s*(?:of|/|von|de|sur|из|z)\s*\d{1,4})?\s*(?:頁|页|ページ|쪽)?\s*[-–—·•\])|]*$", re.I)
_PARTS = re.compile(r"\s{3,}|\t+|\s+[|·]\s+")


def _roman(s: str) -> int | None:
    s = s.lower()
    if not s or not _ROMAN.match(s):
        return None
    value = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100, "d": 500, "m": 1000}
    return sum(-value[c] if value[c] < value.get(n, 0) else value[c] for c, n in zip(s, s[1:] + " "))


def skeleton(text: str) -> str:
    """Text folded so that confusable characters and specks are equal."""
    s = text.lower().translate({ord(c): None for c in SPECKS.replace("·", "")})
    s = "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c))
    for a, b in (("ﬁ", "fi"), ("†", "t"), ("ɑ", "a"), ("rn", "m"), ("vv", "w"), ("cl", "d"), ("ri", "n"), ("li", "h"), ("ii", "u"), ("0", "o"), ("1", "l"), ("9", "g"), ("6", "e"), ("i", "l"), ("|", "l"), ("c", "e"), ("5", "s"), ("8", "b"), ("о", "o"), ("а", "a")):
        s = s.replace(a, b)
    return re.sub(r"\s+", " ", s).strip()


def _normal(token: str) -> tuple[str, bool]:
    """A token without punctuation at its edges, and whether a speck hung on it."""
    t = token.rstrip(_PUNCT)
    speck = len(t) > 1 and t[-1] in SPECKS
    return t.rstrip(SPECKS).strip(_PUNCT), speck


def _parts(token: str) -> list[str]:
    """Words of a token; a capital I within small letters stands for l."""
    out = []
    for p in _PART.split(token):
        if "I" in p:
            p = _CAPITAL.sub(lambda m: "1" * len(m.group()), p)
        if len(p) > 1 and re.search(_LETTER, p):
            out.append(p.lower())
    return out


def _broken(text: str) -> list[re.Match[str]]:
    """The words that may be broken over two lines, in order; a half belongs to one of them only."""
    out, end = [], 0
    for m in _LINE_END.finditer(text):
        start = m.start()
        if start < end:
            continue
        while start > end and not text[start - 1].isspace():
            start -= 1
        if x := _BROKEN.match(text, start):
            out.append(x)
            end = x.end()
    return out


def _replaced(text: str, found: list[re.Match[str]], f: Callable[[re.Match[str]], str]) -> str:
    out, last = [], 0
    for m in found:
        out += [text[last : m.start()], f(m)]
        last = m.end()
    return "".join([*out, text[last:]])


_DENSE = re.compile(r"[぀-ヿ㐀-鿿豈-﫿、。，．「」（）：；！？]")


def _halves(m: re.Match[str]) -> tuple[str, str]:
    """What stands before and after the hyphen of a broken word; scripts without spaces are no part of it."""
    a, b = _normal(m.group(1))[0], _normal(m.group(3))[0]
    return _DENSE.split(_PART.split(a)[-1])[-1], _DENSE.split(_PART.split(b)[0])[0]


_forms: dict[str, tuple[tuple[str, str, bool], ...]] = {}


def _words_of(token: str) -> tuple[tuple[str, str, bool], ...]:
    """(kind, word, speck) of a token, remembered."""
    known = _forms.get(token)
    if known is not None:
        return known
    t, speck = _normal(token)
    out: list[tuple[str, str, bool]] = []
    if t and not _CODE.search(t):
        parts = _parts(t)
        out = [("word", p, speck and k == len(parts) - 1) for k, p in enumerate(parts)]
        if "-" in t or "‐" in t:
            low = re.split(r"[-‐]", t.lower())
            out += [("pair", f"{x}-{y}", False) for x, y in zip(low, low[1:]) if x and y]
    if len(_forms) >= MEMORY:
        _forms.clear()
    _forms[token] = tuple(out)
    return _forms[token]


def page_words(text: str, broken: list[re.Match[str]] | None = None) -> list[tuple[str, str, int, bool]]:
    """(kind, word, count, speck): kind 'word', 'joined' (over a line end) or 'pair' (a-b within a line)."""
    c: Counter[tuple[str, str, bool]] = Counter()
    found = _broken(text) if broken is None else broken
    for m in found:
        a, b = _halves(m)
        if a and b:
            c["joined", (a + b).lower(), False] += 1
    for token, n in Counter(_replaced(text, found, lambda m: " ").split()).items():
        for form in _words_of(token):
            c[form] += n
    return [(k, w, n, s) for (k, w, s), n in c.items()]


def page_breaks(text: str, broken: list[re.Match[str]] | None = None) -> list[tuple[str, str, str, bool]]:
    """(first part, second part, hyphen, second begins small) of each word that may be broken over two lines."""
    out = []
    for m in _broken(text) if broken is None else broken:
        a, b = _halves(m)
        if a and b and re.match(r"[^\W\d_]|[†ɑ0-9ﬁ|]", b) and re.search(_LETTER, b):
            out.append((a.lower(), b.lower(), m.group(2), not b[0].isupper() or a.isupper()))
    return out


def _number(part: str) -> tuple[int | None, bool]:
    """The number a part of an edge line may print as the page's, and whether its form says so."""
    m = _NUMBER.match(part.strip())
    if not m:
        return None, False
    n = m.group("n")
    value = int(n) if n.isdigit() else _roman(n)
    return value, bool(m.group("form").strip() or m.group("of"))


def page_edges(text: str) -> list[tuple[int, int, str, list[tuple[int, bool, str]], bool, bool, bool]]:
    """(line number, lines of that edge before it, line, [(number, form says so, rest)], running text, at the top, perhaps text)."""
    lines = text.split("\n")
    filled = [i for i, x in enumerate(lines) if x.strip()]
    width = max((len(x) for x in lines), default=0)
    out, seen = [], set()
    for depth, (top, bottom) in enumerate(itertools.zip_longest(filled[:EDGE_LINES], filled[::-1][:EDGE_LINES])):
        for i, first in ((top, True), (bottom, False)):
            if i is None or i in seen:
                continue
            seen.add(i)
            line = lines[i].strip()
            nxt = lines[i + 1].strip() if i + 1 < len(lines) else ""
            numbers = []
            parts = _PARTS.split(line)
            for k, p in enumerate(parts):
                n, sure = _number(p)
                if n is not None:
                    numbers.append((n, sure and len(parts) <= 2, " ".join(x for j, x in enumerate(parts) if j != k)))
            # running text: it ends as a sentence does, or goes on in small letters, or fills a line of a script without spaces
            body = bool(re.search(r"[.。!?！？,;:”\"]$", line)) or (bool(nxt) and first and nxt[0].islower()) or (" " not in line and len(line) >= 0.9 * width > 20)
            if not body and not numbers and (m := re.match(r"^(.+?)\s+[·|]?\s*(\d{1,4})$", line)) and len(line) < 0.8 * width:
                numbers.append((int(m.group(2)), False, m.group(1)))
            # a long line right above text may be its first one: it must stand on more pages
            weak = first and bool(nxt) and len(line.split()) >= 6 and len(line) > 0.6 * width
            out.append((i, depth, line, numbers, body, first, weak))
    return out


# --- corpus statistics in SQL -------------------------------------------------------------------


def pages_of(ocr_pages: DataFrame, ocr_docs: DataFrame) -> DataFrame:
    """file_doc, doc_id, page_index, part, text: pages of both tables, once each, without null texts.

    Files of ocr_docs have page_index -1 and part counts their pages; in ocr_pages part is page_index.
    """
    a = ocr_pages.where("text is not null").select(F.lit(False).alias("file_doc"), "doc_id", "page_index", F.col("page_index").alias("part"), "text").dropDuplicates(["doc_id", "page_index"])
    b = ocr_docs.where("text is not null").dropDuplicates(["doc_id"]).select(F.lit(True).alias("file_doc"), "doc_id", F.lit(-1).alias("page_index"), F.posexplode(F.split("text", r"\n\s*\n---\n\s*\n|\n---\n")).alias("part", "text"))
    return a.unionByName(b)


_KEYS = ["file_doc", "doc_id", "page_index", "part"]
_NUMBERS = "array<struct<n:int,sure:boolean,rest:string,skel:string>>"
_EVIDENCE = (
    "words array<struct<kind:string,word:string,n:int,speck:boolean>>, breaks array<struct<a:string,b:string,hyphen:string,small:boolean>>, "
    f"edges array<struct<line_no:int,depth:int,top:boolean,weak:boolean,skel:string,body:boolean,numbers:{_NUMBERS}>>"
)
_NUMBER_TYPE = pa.list_(pa.struct([("n", pa.int32()), ("sure", pa.bool_()), ("rest", pa.string()), ("skel", pa.string())]))
_FIELDS = {
    "words": [("kind", pa.string()), ("word", pa.string()), ("n", pa.int32()), ("speck", pa.bool_())],
    "breaks": [("a", pa.string()), ("b", pa.string()), ("hyphen", pa.string()), ("small", pa.bool_())],
    "edges": [("line_no", pa.int32()), ("depth", pa.int32()), ("top", pa.bool_()), ("weak", pa.bool_()), ("skel", pa.string()), ("body", pa.bool_()), ("numbers", _NUMBER_TYPE)],
}


def _edge_rows(text: str) -> list[tuple]:
    return [(i, depth, top, weak, skeleton(line), body, [{"n": n, "sure": s, "rest": r.strip(), "skel": skeleton(r)} for n, s, r in numbers]) for i, depth, line, numbers, body, top, weak in page_edges(text)]


def evidence_of(pages: DataFrame) -> DataFrame:
    """Keys, words, breaks, edges: what each page's text says, gathered in one pass and written once."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                b = whole.slice(at, 1000)
                rows: dict[str, list[tuple]] = {k: [] for k in _FIELDS}
                ends: dict[str, list[int]] = {k: [0] for k in _FIELDS}
                for text in b.column("text").to_pylist():
                    broken = _broken(text)
                    for k, found in (("words", page_words(text, broken)), ("breaks", page_breaks(text, broken)), ("edges", _edge_rows(text))):
                        rows[k] += found
                        ends[k].append(len(rows[k]))
                columns = []
                for k, fields in _FIELDS.items():
                    flat = list(zip(*rows[k])) or [()] * len(fields)
                    struct = pa.StructArray.from_arrays([pa.array(x, type=kind) for x, (_, kind) in zip(flat, fields)], fields=[pa.field(n, kind) for n, kind in fields])
                    columns.append(pa.ListArray.from_arrays(pa.array(ends[k], type=pa.int32()), struct))
                yield pa.RecordBatch.from_arrays([*[b.column(k) for k in _KEYS], *columns], names=[*_KEYS, *_FIELDS])

    return cut_lineage(pages.select(*_KEYS, "text").mapInArrow(gather, f"file_doc boolean, doc_id long, page_index int, part int, {_EVIDENCE}"))


def _each(evidence: DataFrame, kind: str) -> DataFrame:
    """One row for each word, break or edge line of the pages."""
    return evidence.select(*_KEYS, F.explode(kind).alias("x")).select(*_KEYS, "x.*")


_HASH = (1 << 40) - 1


def _anagram(word: Column | str) -> Column:
    """Sum of one value for each character: independent of their order, and additive in differences."""
    return F.aggregate(F.split(word, ""), F.lit(0).cast("long"), lambda a, c: a + F.xxhash64(c).bitwiseAND(F.lit(_HASH)))


def anagram(word: str) -> int:
    """The same value for a word at hand."""
    return sum(xxhash.xxh64_intdigest(c, seed=42) & _HASH for c in word)


def _fold(word: Column, first: tuple[str, str] = ("ii", "u")) -> Column:
    """Column form of the folding that verifies a candidate: confusable characters become equal.

    Two letters that overlap with the next two fold differently by order; both orders are tried.
    """
    out = F.translate(F.replace(F.replace(word, F.lit("ﬁ"), F.lit("fi")), F.lit("ﬂ"), F.lit("fl")), FOLD_FROM, FOLD_TO)
    for a, b in (("rn", "m"), ("vv", "w"), first, ("ei", "d"), ("ri", "n"), ("ii", "u")):  # after single characters: l is i, c is e, h is u
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def _same_folded(a: Column, b: Column) -> Column:
    return (_fold(a) == _fold(b)) | (_fold(a, ("ei", "d")) == _fold(b, ("ei", "d"))) | (_fold(a, ("ri", "n")) == _fold(b, ("ri", "n")))


def corrections(words: DataFrame, confusions: tuple[tuple[str, str], ...] = CONFUSIONS) -> DataFrame:
    """variant, word, n_word: the most frequent word each rarer one can be a misreading of.

    words: (kind, word, n). A variant is joined with every frequent word whose anagram
    hash differs by what one or two of the confusions change, then held against it letter by
    letter (both folded must be equal), and ranked by fewer confusions, then by frequency.
    The join is on a hash: no pairs within a group. Words too frequent for any other word to be
    RATIO times more frequent are not tried.
    """
    counts = words.where("kind in ('word', 'joined') and length(word) > 1").groupBy("word").agg(F.sum(F.when(F.col("kind") == "word", F.col("n")).otherwise(0)).alias("n"))
    hashed = cut_lineage(counts.withColumn("h", _anagram("word")))
    frequent = hashed.where(F.col("n") >= FREQUENT).select(F.col("word").alias("right"), F.col("n").alias("n_right"), "h")
    most = hashed.agg(F.max("n")).first()[0] or 0
    # the difference that each confusion makes whose reading occurs in the word; then also all pairs of them
    one = F.array_distinct(F.filter(F.array(*[F.when(F.contains("word", F.lit(b)), F.lit(anagram(a) - anagram(b))) for a, b in confusions]), lambda x: x.isNotNull()))
    two = F.flatten(F.transform("one", lambda x, i: F.transform(F.slice("one", i + 1, F.size("one")), lambda y: x + y)))
    tries = hashed.where(F.col("n") * RATIO <= most).withColumn("one", one).where(F.size("one") > 0)
    tries = tries.select("word", "n", "h", "one", F.explode(F.array_distinct(F.concat("one", two))).alias("d")).select("word", "n", (F.col("h") + F.col("d")).alias("h"), F.when(F.array_contains("one", F.col("d")), 1).otherwise(2).alias("k"))
    close = tries.join(frequent, "h").where(
        (F.col("word") != F.col("right")) & (F.col("n_right") >= RATIO * F.col("n")) & (F.levenshtein("word", "right") <= 2 * F.col("k")) & _same_folded(F.col("word"), F.col("right"))
    )
    return close.groupBy("word").agg(F.min_by(F.struct("right", "n_right"), F.struct("k", -F.col("n_right"), "right")).alias("r")).select(F.col("word").alias("variant"), F.col("r.right").alias("word"), F.col("r.n_right").alias("n_word"))


def misread_words(words: DataFrame, fixes: DataFrame, hot: list[str]) -> DataFrame:
    """Keys, variant, word: each misread word of each page. Odd signs within a word count also where no frequent word is near.

    hot: the words that stand almost everywhere. They take no part in the join, so that no key of it holds
    more than HOT of all words; their corrections, if any, are a table of as many rows at most.
    """
    odd = F.col("variant").rlike("[†ɑﬁﬂ¦]|[^\\W\\d_][0-9]+[^\\W\\d_]{2}|^[0-9][^\\W\\d_]{3,}|[^\\W\\d_]{3,}[0-9]$") & ~F.col("variant").rlike("^[0-9]+(st|nd|rd|th|er|e|d|ers|le|km|mm|cm|kg|px|pt|年|月|日|件|ページ|页|項|항|년|월).*$") & ~F.col("variant").rlike("[぀-ヿ㐀-鿿가-힯]")
    w = words.where("kind in ('word', 'joined')").select(*_KEYS, F.col("word").alias("variant"), "speck")
    marked = w.where(F.col("speck") | odd).select(*_KEYS, "variant", F.lit(None).cast("string").alias("word"))
    fixed = w.where(~F.col("variant").isin(hot)).select(*_KEYS, "variant").join(fixes.select("variant", "word"), "variant").select(*_KEYS, "variant", "word")
    known = {r.variant: r.word for r in fixes.where(F.col("variant").isin(hot)).select("variant", "word").collect()} if hot else {}
    if known:
        fixed = fixed.unionByName(w.where(F.col("variant").isin(*known)).select(*_KEYS, "variant", F.element_at(F.create_map(*[F.lit(x) for kv in known.items() for x in kv]), F.col("variant")).alias("word")))
    return fixed.unionByName(marked)


def hot_words(counts: DataFrame) -> list[str]:
    """Words that are more than HOT of all words: fewer than 1 / HOT."""
    by = counts.where("kind in ('word', 'joined')").groupBy("word").agg(F.sum("n").alias("n"))
    total = by.agg(F.sum("n")).first()[0] or 0
    return [r.word for r in by.where(F.col("n") > max(HOT * total, FREQUENT)).select("word").collect()]


def broken_words(breaks: DataFrame, counts: DataFrame, fixes: DataFrame) -> DataFrame:
    """Keys, a, b, hyphen of every word that is broken over two lines; compounds parted at their own hyphen are left out."""
    # counts of forms: as they stand, or as corrected
    known = counts.where("kind in ('word', 'pair')").select("word", "n").groupBy("word").agg(F.sum("n").alias("n")).unionByName(fixes.select(F.col("variant").alias("word"), F.col("n_word").alias("n")))
    forms = {"joined": F.concat("a", "b"), "pair": F.concat("a", F.lit("-"), "b"), "a": F.col("a"), "b": F.col("b")}
    asked = breaks.select("a", "b").distinct().select("a", "b", F.explode(F.array(*[F.struct(F.lit(k).alias("role"), x.alias("word")) for k, x in forms.items()])).alias("x")).select("a", "b", "x.*")
    pairs = asked.join(known, "word", "left").groupBy("a", "b").agg(*[F.coalesce(F.max(F.when(F.col("role") == k, F.col("n"))), F.lit(0)).alias(f"n_{k}") for k in forms])
    soft = F.col("hyphen").isin(*SOFT)
    # Neither form known: a word, unless both halves are words of their own.
    whole = F.when(F.expr("n_joined > n_pair"), True).when(F.expr("n_pair > 0"), soft & F.expr("n_joined > 0")).otherwise(soft | (F.least("n_a", "n_b") < FREQUENT))
    firm = F.when(~F.col("hyphen").isin("-", "‐", "¬", "\xad"), F.expr("n_joined > 0") | (F.least("n_a", "n_b") < FREQUENT)).otherwise(F.lit(True))
    return breaks.join(pairs, ["a", "b"]).where(F.col("small") & whole & firm).select(*_KEYS, "a", "b", "hyphen")


def edge_noise(edges: DataFrame) -> DataFrame:
    """Keys, line_no, kind: each edge line that is a header (or footer) or holds the page number; one that is both comes twice.

    A number is the page's where the same distance to the page index occurs on another page of the
    file, or where its form says so. What remains of a line without it is a running header or
    footer where it stands, folded, on another page of the file too.
    """
    file = ["file_doc", "doc_id"]
    tried = edges.select("*", F.posexplode_outer("numbers").alias("pos", "x")).drop("numbers").withColumn("offset", F.col("x.n") - F.col("part"))
    steps = tried.where("x is not null").groupBy(*file, "offset").agg(F.min("part").alias("lo"), F.max("part").alias("hi"))
    own = F.col("x").isNotNull() & (F.coalesce(F.expr("lo < hi"), F.lit(False)) | F.col("x.sure") | ((F.col("x.rest") == "") & (F.col("depth") <= 1)))
    number = F.min(F.when(own, F.struct("pos", "x.rest", "x.skel", "x.sure")))
    lines = tried.join(steps, [*file, "offset"], "left").groupBy(*_KEYS, "line_no").agg(*[F.first(k).alias(k) for k in ("depth", "top", "weak", "body")], F.first("skel").alias("whole"), number.alias("number"))
    lines = lines.withColumn("skel", F.when(F.col("number").isNotNull() | ~F.col("body"), F.coalesce("number.skel", "whole"))).withColumn("skel", F.when(F.length("skel") >= 2, F.col("skel")))
    # third lines are compared with each other only: they are text more often than not
    lines = lines.withColumn("inner", F.col("depth") > 1)
    stands = lines.where("skel is not null").groupBy(*file, "skel", "inner").agg(F.min("part").alias("lo"), F.max("part").alias("hi"), F.count("*").alias("n_pages")).where("lo < hi").select(*file, "skel", "inner", "n_pages")
    lines = lines.join(stands, [*file, "skel", "inner"], "left")
    header = F.col("n_pages").isNotNull() & (~F.col("weak") | (F.col("n_pages") > 2))
    lines = lines.select(*_KEYS, "line_no", "depth", "top", header.alias("header"), F.col("number").isNotNull().alias("numbered"), F.coalesce(F.col("number.sure") & (F.col("number.rest") == ""), F.lit(False)).alias("sure"))
    # an inner line of an edge counts only under outer ones that do, unless its form says what it is
    outer = Window.partitionBy(*_KEYS, "top").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
    reached = F.coalesce(F.count_if(F.col("header") | F.col("numbered")).over(outer), F.lit(0)) == F.col("depth")
    lines = lines.withColumn("reached", reached)
    kinds = F.filter(F.array(F.when(F.expr("header and reached"), F.lit("header")), F.when(F.expr("numbered and (reached or sure)"), F.lit("page_number"))), lambda x: x.isNotNull())
    return lines.select(*_KEYS, "line_no", F.explode(kinds).alias("kind"))


def noise(evidence: DataFrame) -> DataFrame:
    """Keys, kind (hyphen, misread, header, page_number), line_no, a, b: everything found on each page.

    a, b are the halves of a broken word or a misread word and its correction (null where none is known).
    """
    words = _each(evidence, "words")
    counts = cut_lineage(words.groupBy("kind", "word").agg(F.sum("n").alias("n")))
    fixes = cut_lineage(corrections(counts))
    none = F.lit(None)
    hyphens = broken_words(_each(evidence, "breaks"), counts, fixes).select(*_KEYS, F.lit("hyphen").alias("kind"), none.cast("int").alias("line_no"), "a", "b")
    misread = misread_words(words, fixes, hot_words(counts)).select(*_KEYS, F.lit("misread").alias("kind"), none.cast("int").alias("line_no"), F.col("variant").alias("a"), F.col("word").alias("b"))
    edges = edge_noise(_each(evidence, "edges")).select(*_KEYS, "kind", "line_no", none.cast("string").alias("a"), none.cast("string").alias("b"))
    return hyphens.unionByName(misread).unionByName(edges)


def find_noise(ocr_pages: DataFrame, ocr_docs: DataFrame) -> DataFrame:
    """doc_id, page_index, noise_kind: hyphen, misread, header, page_number; one row per page and kind.

    Null and empty texts have no noise. A file of ocr_docs has page_index -1.
    """
    return noise(evidence_of(pages_of(ocr_pages, ocr_docs))).select("doc_id", "page_index", F.col("kind").alias("noise_kind")).distinct()


def repair_pages(ocr_pages: DataFrame, ocr_docs: DataFrame) -> DataFrame:
    """file_doc, doc_id, page_index, part, repaired: each page as continuous paragraphs.

    Header, footer and page-number lines are dropped, broken words joined, misread words replaced
    by the best-ranked correction, specks dropped, and the lines of a paragraph joined. What is
    gathered for a page is bounded by the page's own words.
    """
    pages = pages_of(ocr_pages, ocr_docs)
    found = noise(evidence_of(pages)).groupBy(*_KEYS).agg(
        F.collect_set("line_no").alias("drop"),
        F.collect_set(F.when(F.col("kind") == "hyphen", F.concat_ws("\t", "a", "b"))).alias("broken"),
        F.map_from_entries(F.collect_set(F.when(F.expr("kind = 'misread' and b is not null"), F.struct("a", "b")))).alias("fixes"),
    )

    @F.pandas_udf("string")
    def mend(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for text, d, j, f in batches:
            yield pd.Series([mend_page(t, set() if a is None else set(a), set() if b is None else set(b), {} if c is None else dict(c)) for t, a, b, c in zip(text, d, j, f)])

    return pages.join(found, _KEYS, "left").select(*_KEYS, mend("text", "drop", "broken", "fixes").alias("repaired"))


def mend_page(text: str, drop: set[int], broken: set[str], fixes: dict[str, str]) -> str:
    """One page, repaired with what the corpus says about it."""
    text = "\n".join("" if i in drop else x for i, x in enumerate(text.split("\n")))

    def unite(m: re.Match[str]) -> str:
        if "\t".join(_halves(m)).lower() in broken:
            return m.group(1).rstrip(SPECKS) + m.group(3)
        return m.group(1) + (m.group(2) if m.group(2) in "-‐" else "-") + m.group(3)

    def right(m: re.Match[str]) -> str:
        t, _ = _normal(m.group())
        if not t or _CODE.search(t):
            return m.group()
        at = m.group().find(t)
        head, tail = m.group()[:at], m.group()[at + len(t) :].lstrip(SPECKS)
        out = []
        for p in re.split(r"([-‐–’'/])", t):
            key = _CAPITAL.sub(lambda k: "1" * len(k.group()), p).lower()
            s = fixes.get(key)
            out.append(p if s is None else s.upper() if p.isupper() and len(p) > 1 else s[:1].upper() + s[1:] if p[:1].isupper() else s)
        return head + "".join(out) + tail

    text = _WORD.sub(right, _replaced(text, _broken(text), unite))
    paragraphs = [re.sub(r"\s*\n\s*", lambda m: "" if _dense(m) else " ", p.strip("\n")) for p in re.split(r"\n\s*\n+", text)]
    return "\n\n".join(p.strip() for p in paragraphs if p.strip())


def _dense(m: re.Match[str]) -> bool:
    """Whether a line end stands between characters of scripts that use no spaces."""
    s, a, b = m.string, m.start() - 1, m.end()
    return a >= 0 and b < len(s) and ("　" <= s[a] <= "鿿") and ("　" <= s[b] <= "鿿" or s[b].isdigit())
