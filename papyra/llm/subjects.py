"""Problem 9: the subjects each document treats.

Documents are embedded by term weighting and a truncated singular value decomposition (randomised
subspace iteration, one pass over all documents for each step); hand-given labels seed one centroid
for each subject and language; sentences are assigned by cosine, and centroids and term weights are
refined over all documents in rounds. A subject counts where at least SHARE of the sentences have it.

Texts are read once and written as blocks of numbered terms (some hundred documents in a row), on which
every later pass works with a few matrix products for each language. Whatever reaches the driver is
bounded by TERMS, RANK and the number of subjects and languages.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from papyra.llm import langmodel
from papyra.llm.langs import CODES
from papyra.session import cut_lineage

#: The vocabulary holds so many terms of each language, the most frequent ones.
TERMS = 4000
RANK = 128
POWER_STEPS = 2
ROUNDS = 4
#: Refinement ends early once the cosine between old and new centroids, by their sentences, is within this of 1.
SETTLED = 0.001
#: Terms of less weight are left out of a sentence's vector.
NEGLIGIBLE = 0.02
#: Labelled rows of each language that tell the languages of documents apart; they are counted as labelled.
LANGUAGE_ROWS = 1500
#: Documents that seed the centroids: a bounded sample of labelled rows.
SEED_DOCUMENTS = 20000
SHARE = 0.25
#: Cosine from which a sentence belongs to a subject, the lead over the next subject that makes it certain,
#: the cosine that is enough where the rest of the document leans the same way, and the weight of its terms as a
#: part of that of a telling term.
COSINE = 0.7
LEAD = 0.08
LEANING = 0.5
MASS = 0.35
#: Matrices are summed over the cluster in so many slices.
SLICES = 32
#: A block holds at most so many documents, and texts are cut into terms in parts of so many characters.
BLOCK_DOCUMENTS = 1000
PART_CHARS = 1 << 20
#: Rows times columns of a dense matrix; more rows are multiplied in several steps.
DENSE = 1 << 23

_BRACKETS = re.compile(r"\[[^\[\]\n]*\]")
_SENTENCE_END = re.compile(r"[.!?][\"”’»)\]*_]*(?:\s+|['」』]*$)|[。！？][」』”’\"')）\]*_]*\s*")
_SKIP = re.compile(r"\s*(?:#{1,6}\s|\||[-=_*~]{3,}\s*$|>\s*\[)")
_ITEM = re.compile(r"\s*(?:[-*+•]|\d{1,3}[.)])\s+")
#: Lines that may be skipped or begin with the sign of an item; all others need no closer look.
_ODD = re.compile(r"^[ \t　\xa0]*[#|\-=_*~>+•\d]|\t", re.M)
STOP, BREAK = "\x01", "\x02"
_MARKS = {ord(STOP): " ", ord(BREAK): " "}


def marked(text: str) -> str:
    """Sentences of running text, each closed by STOP: no headings, table rows, bracketed notes, nor lines without an end mark."""
    if STOP in text or BREAK in text:
        text = text.translate(_MARKS)
    out = []
    for paragraph in (_BRACKETS.sub(" ", text) if "[" in text else text).split("\n\n"):
        if _ODD.search(paragraph):
            lines = [_ITEM.sub("", x, count=1) if _ITEM.match(x) else x for x in paragraph.split("\n") if "\t" not in x and not _SKIP.match(x)]
            paragraph = "\n".join(lines)
        # what follows the last end mark, such as a greeting or a signature, is no sentence
        found = _SENTENCE_END.sub(STOP, paragraph.strip())
        out.append(found[: found.rfind(STOP) + 1])
    return "".join(out)


def sentences(text: str) -> list[str]:
    """The sentences, without the marks they end on."""
    return [s for x in marked(text).split(STOP)[:-1] if re.search(r"\w", s := x.strip().replace("\n", " "))]


# --- terms as numbers ---------------------------------------------------------------------------

#: Classes of characters.
_LETTER, _KANA, _HAN, _DIGIT, _STOP, _BREAK = 1, 2, 3, 4, 5, 6
_BASE, _MIX = 0x9E3779B97F4A7C15 | 1, 0xD6E8FEB86659FD93
_WORD = (1 << 64) - 1


@lru_cache(1)
def _classes() -> np.ndarray:
    """Class by code point, for the planes that hold letters."""
    out = np.zeros(0x30000, dtype=np.uint8)
    for c in range(len(out)):
        s = chr(c)
        if s.isalnum():
            out[c] = _DIGIT if s.isdecimal() else _LETTER
    for a, b in ((0x3041, 0x30FF),):
        out[a : b + 1][out[a : b + 1] == _LETTER] = _KANA
    for a, b in ((0x3400, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x2FFFF)):
        out[a : b + 1][out[a : b + 1] == _LETTER] = _HAN
    out[0x30FC], out[0x3005] = _KANA, _HAN
    out[ord(STOP)], out[ord(BREAK)] = _STOP, _BREAK
    return out


@lru_cache(1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base of the hash, and of its inverse, modulo 2^64."""
    n = PART_CHARS + 1

    def powers(base: int) -> np.ndarray:
        x = np.full(n, base, dtype=np.uint64)
        x[0] = 1
        return np.cumprod(x, dtype=np.uint64)

    return powers(_BASE), powers(pow(_BASE, -1, 1 << 64))


def _hashed_part(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(64-bit hashes of the terms in order, with 0 for STOP and 1 for BREAK; counts at each BREAK of Kana and of Han, and of all characters)."""
    chars = np.frombuffer(text.encode("utf-32-le", "replace"), dtype=np.uint32)
    table = _classes()
    cls = table[np.minimum(chars, len(table) - 1)]
    n = len(cls)
    left, right = np.empty_like(cls), np.empty_like(cls)
    left[0], left[1:], right[-1], right[:-1] = 0, cls[:-1], 0, cls[1:]
    size = np.zeros(n, dtype=np.int64)
    word = (cls == _LETTER) | (cls == _KANA)
    first = np.flatnonzero(word & (left != cls))
    size[first] = np.flatnonzero(word & (right != cls)) + 1 - first
    han = cls == _HAN
    size[han & (right == _HAN)] = 2  # pairs of neighbours; a single character only where it stands alone
    size[han & (left != _HAN) & (right != _HAN)] = 1
    # a STOP counts where a letter or digit stands since the mark before it
    marks = np.flatnonzero(cls >= _STOP)
    filled = np.cumsum((cls > 0) & (cls < _STOP), dtype=np.int64)[marks]
    size[marks[(cls[marks] == _BREAK) | (np.diff(filled, prepend=0) > 0)]] = 1
    at = np.flatnonzero(size)
    power, inverse = _powers()
    if n >= len(power):  # one sentence without a blank
        power, inverse = (np.cumprod(np.r_[np.uint64(1), np.full(n, x[1], dtype=np.uint64)], dtype=np.uint64) for x in (power, inverse))
    mixed = (chars.astype(np.uint64) + np.uint64(1)) * np.uint64(_MIX)
    mixed ^= mixed >> np.uint64(32)
    mixed *= power[:n]
    sums = np.empty(n + 1, dtype=np.uint64)
    sums[0] = 0
    np.cumsum(mixed, out=sums[1:])
    h = (sums[at + size[at]] - sums[at]) * inverse[at]
    h ^= h >> np.uint64(29)
    h |= np.uint64(2)  # 0 and 1 are the marks
    kind = cls[at]
    h[kind == _STOP], h[kind == _BREAK] = 0, 1
    ends = marks[cls[marks] == _BREAK]
    seen = np.stack([np.cumsum(cls == _KANA)[ends], np.cumsum(han)[ends], ends], axis=1) if len(ends) else np.zeros((0, 3), dtype=np.int64)
    return h, seen, np.array([(cls == _KANA).sum(), han.sum(), n])


def hashed(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all terms, BREAK after each text; for each text its numbers of Kana, of Han and of characters)."""
    whole = "".join([x for t in texts for x in (t, BREAK)]).lower()
    hashes, seen, before, a = [], [], np.zeros(3, dtype=np.int64), 0
    while a < len(whole):
        b = len(whole)
        if b - a > PART_CHARS:
            b = max(whole.rfind(STOP, a, a + PART_CHARS), whole.rfind(BREAK, a, a + PART_CHARS)) + 1 or whole.rfind(" ", a, a + PART_CHARS) + 1 or whole.find(STOP, a) + 1 or len(whole)
        h, s, total = _hashed_part(whole[a:b])
        hashes.append(h)
        seen.append(s + before)
        before = before + total
        a = b
    at = np.concatenate(seen) if seen else np.zeros((0, 3), dtype=np.int64)
    return np.concatenate(hashes) if hashes else np.zeros(0, dtype=np.uint64), np.diff(at, axis=0, prepend=0)


def term_hashes(words: list[str]) -> np.ndarray:
    """Hashes of words that are one term each."""
    h, _ = hashed([w + STOP for w in words])
    ends = np.flatnonzero(h == 1)
    starts = np.r_[0, ends[:-1] + 1] if len(ends) else ends
    return np.where(ends - starts == 2, h[np.minimum(starts, max(0, len(h) - 1))], 0)


@dataclass
class Block:
    """Documents in a row: their ids, language, number of codes, the hashes of their terms (sorted), and the terms' numbers.

    The number one past the last term closes a sentence.
    """

    ids: np.ndarray
    langs: np.ndarray
    sizes: np.ndarray
    words: np.ndarray
    codes: np.ndarray

    DDL = "ids binary, langs binary, sizes binary, words binary, codes binary"

    def row(self) -> list[bytes]:
        narrow = np.uint16 if len(self.words) < 65535 else np.int32
        return [self.ids.astype(np.int64).tobytes(), self.langs.astype(np.int8).tobytes(), self.sizes.astype(np.int32).tobytes(), self.words.tobytes(), self.codes.astype(narrow).tobytes()]

    @classmethod
    def of_row(cls, ids: bytes, langs: bytes, sizes: bytes, words: bytes, codes: bytes) -> Block:
        u = np.frombuffer(words, dtype=np.uint64)
        return cls(np.frombuffer(ids, dtype=np.int64), np.frombuffer(langs, dtype=np.int8), np.frombuffer(sizes, dtype=np.int32), u, np.frombuffer(codes, dtype=np.uint16 if len(u) < 65535 else np.int32).astype(np.int64))

    @property
    def document(self) -> np.ndarray:
        """Number of the document of each code."""
        return np.repeat(np.arange(len(self.ids)), self.sizes)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    for b in batches:
        for row in zip(*(b.column(k).to_pylist() for k in ("ids", "langs", "sizes", "words", "codes"))):
            yield Block.of_row(*row)


def _bytes_batch(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), type=k) for c, k in zip(zip(*rows) if rows else [[]] * len(names), kinds)], names=names)


def read_block(ids: np.ndarray, texts: list[str], known: np.ndarray, scores: np.ndarray) -> tuple[Block, np.ndarray]:
    """(block of some documents; columns language, term, number of documents that hold it, as rows of three).

    known: sorted hashes of the words of a language model, scores: their scores by language.
    """
    h, seen = hashed([marked(t) for t in texts])
    breaks = np.flatnonzero(h == 1)
    sizes = np.diff(breaks, prepend=-1) - 1
    h = h[h != 1]
    codes, words = pd.factorize(h)
    order = np.argsort(words)
    words = words[order]
    rank = np.empty(len(order), dtype=np.int64)
    rank[order] = np.arange(len(order))
    codes = rank[codes] if len(codes) else codes
    if len(words) and words[0] == 0:  # STOP becomes the last number
        words, codes = words[1:], np.where(codes == 0, len(words) - 1, codes - 1)
    document = np.repeat(np.arange(len(ids)), sizes)
    langs = np.zeros(len(ids), dtype=np.int64)
    if len(words) and len(known):
        i = np.minimum(np.searchsorted(known, words), len(known) - 1)
        table = np.zeros((len(words) + 1, scores.shape[1]), dtype=np.float32)
        hit = known[i] == words
        table[:-1][hit] = scores[i[hit]]
        full = np.flatnonzero(sizes > 0)
        if len(full):
            starts = (np.cumsum(sizes) - sizes)[full]
            langs[full] = np.add.reduceat(table[codes], starts, axis=0).argmax(axis=1)
    # scripts of their own need no words
    dense = seen[:, 0] + seen[:, 1] > 0.2 * seen[:, 2]
    langs[dense] = np.where(seen[dense, 0] > 0.1 * seen[dense, 1], CODES.index("jpn"), CODES.index("zho"))
    pairs = np.unique(document * (len(words) + 1) + codes)
    pairs = pairs[pairs % (len(words) + 1) < len(words)]
    by, n = np.unique(langs[pairs // (len(words) + 1)] * (len(words) + 1) + pairs % (len(words) + 1), return_counts=True)
    counts = np.stack([by // (len(words) + 1), words[by % (len(words) + 1)].view(np.int64), n], axis=1) if len(by) else np.zeros((0, 3), dtype=np.int64)
    return Block(np.asarray(ids), langs, sizes, words, codes), counts


def tokenise(documents: DataFrame, model: langmodel.LanguageModel) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """(blocks of documents; hashes of the vocabulary, sorted; their base weight).

    Document frequencies are counted over all documents, by language; the vocabulary holds the TERMS
    most frequent terms of each language that are not common in it. Null texts and documents without
    id are left out.
    """
    sc = documents.sparkSession.sparkContext
    listed = list(model.words)
    h = term_hashes(listed)
    order = np.argsort(h)
    order = order[h[order] != 0]
    table = np.array([model.words[w] for w in listed], dtype=np.float32).reshape(-1, len(CODES))
    shared = sc.broadcast((h[order], table[order]))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, scores = shared.value
        for b in batches:
            ids, texts = b.column("doc_id").to_numpy(zero_copy_only=False), b.column("text").to_pylist()
            for a in range(0, len(texts), BLOCK_DOCUMENTS):
                block, counts = read_block(ids[a : a + BLOCK_DOCUMENTS], texts[a : a + BLOCK_DOCUMENTS], known, scores)
                yield _bytes_batch([(*block.row(), counts.tobytes())], ["ids", "langs", "sizes", "words", "codes", "counts"], [pa.binary()] * 6)

    texts = documents.where("length(text) > 0 and doc_id is not null").select("doc_id", "text")
    raw = cut_lineage(texts.mapInArrow(read, f"{Block.DDL}, counts binary"))

    def unfold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [np.frombuffer(x, dtype=np.int64).reshape(-1, 3) for x in b.column("counts").to_pylist()]
            sizes = [np.frombuffer(x, dtype=np.int8).astype(np.int64) for x in b.column("langs").to_pylist()]
            # term 0 stands for the number of documents
            whole, n = np.unique(np.concatenate(sizes), return_counts=True) if sizes else (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64))
            rows = np.concatenate([*found, np.stack([whole, np.zeros_like(whole), n], axis=1)])
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(rows[:, k])) for k in range(3)], names=["lang", "term", "n"])

    counts = cut_lineage(raw.select("langs", "counts").mapInArrow(unfold, "lang long, term long, n long").groupBy("lang", "term").agg(F.sum("n").alias("n")))
    totals = {r.lang: r.n for r in counts.where("term = 0").collect()} or {0: 1}
    size = F.try_element_at(F.create_map(*[F.lit(x) for kv in totals.items() for x in kv]), F.col("lang"))
    # idf in the term's own language, so that the words every text of a language uses weigh nothing
    own = F.max_by(F.struct("n", size.alias("size"), "lang"), F.struct(F.col("n") / size, "lang"))
    scored = counts.where("term <> 0 and n >= 3").groupBy("term").agg(own.alias("x"), F.sum("n").alias("df")).select("term", "df", "x.lang", F.log(F.col("x.size") / F.col("x.n")).alias("idf")).where("idf > 0.9")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("df"), "term"))
    top = scored.withColumn("r", rank).where(F.col("r") <= TERMS).select("term", "idf").toPandas()
    index = top["term"].to_numpy(dtype=np.int64).view(np.uint64)
    order = np.argsort(index)
    return raw.drop("counts"), index[order], (top["idf"].to_numpy(dtype=np.float32) - 0.5)[order]


class Placed:
    """A block's terms by their number in the vocabulary: term and sentence of each kept one, document of each sentence."""

    def __init__(self, block: Block, index: np.ndarray):
        at = np.full(len(block.words) + 1, -1, dtype=np.int64)
        if len(index) and len(block.words):
            i = np.minimum(np.searchsorted(index, block.words), len(index) - 1)
            at[:-1] = np.where(index[i] == block.words, i, -1)
        ends = block.codes == len(block.words)
        document = block.document
        term = at[block.codes]
        keep = term >= 0
        self.block, self.term, self.sentence, self.of = block, term[keep], (np.cumsum(ends) - ends)[keep], document[keep]
        self.document = document[ends]
        self.sentences, self.documents = int(ends.sum()), len(block.ids)
        self.lang = block.langs[self.document]  # of each sentence


def _gathered(rows: np.ndarray, terms: np.ndarray, values: np.ndarray, n: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, the terms that occur, dense rows over those terms) for consecutive parts of n sorted rows."""
    a = 0
    occurring = len(np.unique(terms)) or 1
    step = max(1, DENSE // occurring)
    while a < n:
        b = min(n, a + step)
        lo, hi = np.searchsorted(rows, (a, b))
        used, place = np.unique(terms[lo:hi], return_inverse=True)
        x = np.zeros((b - a) * len(used), dtype=np.float32)
        np.add.at(x, (rows[lo:hi] - a) * len(used) + place, values[lo:hi].astype(np.float32))
        yield a, used, x.reshape(b - a, len(used))
        a = b


@dataclass
class Space:
    """Vocabulary, weights, term vectors, and what refinement adds."""

    index: np.ndarray  # hashes of the terms, sorted
    weight: np.ndarray
    vectors: np.ndarray
    subjects: list[str]
    centroids: np.ndarray  # subject, language, RANK; zero where a language has no seed

    def least_mass(self) -> float:
        """Weight of terms from which a sentence can have a subject."""
        return MASS * float(np.percentile(self.weight, 90)) if len(self.weight) else 0.0


def _tasks(blocks: DataFrame) -> DataFrame:
    """The blocks in few, long tasks: each gives one sum of matrices, so their number is bounded by the cores."""
    cores, parts = blocks.sparkSession.sparkContext.defaultParallelism, blocks.rdd.getNumPartitions()
    return blocks.coalesce(max(1, min(parts, max(2 * cores, min(8 * cores, parts // 16)))))


def _summed(blocks: DataFrame, start: Callable[[], dict[str, np.ndarray]], add: Callable[[dict[str, np.ndarray], Block], None]) -> dict[str, np.ndarray]:
    """Sums over all blocks of the matrices that start gives and add adds to; empty without blocks.

    Each task sends its sums in slices of float32, and only those that are not zero; a slice is summed
    in one or, from 64 tasks on, in two steps.
    """

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total = start()
        for block in _blocks(batches):
            add(total, block)
        part, rows = TaskContext.get().partitionId(), []
        for name, x in total.items():
            edges = np.linspace(0, len(x), SLICES + 1).astype(int)
            rows += [(name, k, part, x[a:z].astype(np.float32).tobytes()) for k, (a, z) in enumerate(zip(edges, edges[1:])) if x[a:z].any()]
        if rows:
            yield _bytes_batch(rows, ["name", "slice", "part", "data"], [pa.string(), pa.int32(), pa.int32(), pa.binary()])

    def merge(b: pd.DataFrame) -> pd.DataFrame:
        out = np.zeros(len(b["data"].iloc[0]) // 4)
        for x in b["data"]:
            out += np.frombuffer(x, dtype=np.float32)
        return pd.DataFrame([(b["name"].iloc[0], b["slice"].iloc[0], 0, out.astype(np.float32).tobytes())], columns=["name", "slice", "part", "data"])

    ddl = "name string, slice int, part int, data binary"
    tasks = _tasks(blocks)
    n = tasks.rdd.getNumPartitions()
    df = tasks.mapInArrow(partial, ddl)
    if n > 64:
        df = df.groupBy("name", "slice", F.pmod("part", F.lit(round(n**0.5))).alias("g")).applyInPandas(merge, ddl)
    out = {k: x.astype(np.float64) for k, x in start().items()}
    for r in df.groupBy("name", "slice").applyInPandas(merge, ddl).toLocalIterator():
        x = out[r.name]
        edges = np.linspace(0, len(x), SLICES + 1).astype(int)
        a, z = edges[r.slice], edges[r.slice + 1]
        x[a:z] += np.frombuffer(r.data, dtype=np.float32).reshape(x[a:z].shape)
    return out


def _document_rows(p: Placed, weight: np.ndarray, langs: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(terms, unit rows of weighted term counts) of documents, by language."""
    for j in np.unique(langs):
        docs = np.flatnonzero(langs == j)
        number = np.full(len(langs), -1)
        number[docs] = np.arange(len(docs))
        mine = number[p.of] >= 0
        rows, terms = number[p.of[mine]], p.term[mine]
        for _, used, x in _gathered(rows, terms, np.ones(len(rows)), len(docs)):
            if len(used):
                x[x > 0] = 1 + np.log(x[x > 0])
                x *= weight[used]
                yield used, x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def decompose(blocks: DataFrame, index: np.ndarray, weight: np.ndarray, rank: int = RANK, steps: int = POWER_STEPS) -> np.ndarray:
    """Vectors of the terms: leading right singular vectors of the weighted document-term matrix, scaled."""
    n = len(weight)
    rank = max(1, min(rank, max(2, n // 4), n))  # a space as wide as the vocabulary would keep every term apart
    q = np.linalg.qr(np.random.default_rng(7).standard_normal((max(n, 1), rank)))[0].astype(np.float32)
    values = np.ones(rank)
    for _ in range(steps):
        basis = blocks.sparkSession.sparkContext.broadcast((q, weight, index))

        def multiply(total: dict[str, np.ndarray], block: Block, basis=basis) -> None:
            b_q, b_w, b_index = basis.value
            for used, x in _document_rows(Placed(block, b_index), b_w, block.langs):
                total["y"][used] += x.T @ (x @ b_q[used])

        y = _summed(blocks, lambda: {"y": np.zeros((n, rank))}, multiply)["y"]
        q, r = np.linalg.qr(y)
        u, values, _ = np.linalg.svd(r)
        q = (q @ u).astype(np.float32)
        basis.unpersist()
    return (q * np.sqrt(np.maximum(values, 1e-9) / max(values.max(), 1e-9))).astype(np.float32)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-9)


def assign(p: Placed, space: Space, least: float, each: Callable[[int, np.ndarray, np.ndarray], None] | None = None) -> np.ndarray:
    """Subject number of each sentence, or -1. A doubtful sentence follows the rest of its document.

    each gets (language, numbers of sentences, their unit vectors) before the decision, for use after it.
    """
    k = len(space.subjects)
    if not p.sentences or not k:
        return np.full(p.sentences, -1)
    cos = np.zeros((p.sentences, k), dtype=np.float32)
    telling = space.weight[p.term] > NEGLIGIBLE
    term, sentence = p.term[telling], p.sentence[telling]
    # a sentence of little weight has no subject, whatever its direction
    heavy = np.bincount(sentence, weights=space.weight[term], minlength=p.sentences) >= max(least, 1e-6)
    for j in np.unique(p.lang):
        mine = np.flatnonzero((p.lang == j) & heavy)
        number = np.full(p.sentences, -1)
        number[mine] = np.arange(len(mine))
        own = number[sentence] >= 0
        rows, terms = number[sentence[own]], term[own]
        for a, used, x in _gathered(rows, terms, space.weight[terms], len(mine)):
            v = _unit(x @ space.vectors[used])
            at = mine[a : a + len(x)]
            cos[at] = v @ space.centroids[:, j].T.astype(np.float32)
            if each is not None:
                each(int(j), at, v)
    best = cos.argmax(axis=1)
    top = np.partition(cos, k - 2, axis=1)[:, -2:] if k > 1 else np.c_[np.zeros(len(cos)), cos[:, 0]]
    sure = (top[:, 1] >= COSINE) & (top[:, 1] - top[:, 0] >= LEAD)
    share = np.bincount(p.document[sure] * k + best[sure], minlength=p.documents * k).reshape(-1, k).astype(np.float64)
    share = (share / np.maximum(share.sum(axis=1, keepdims=True), 1))[p.document]
    leaning = (cos + 0.25 * share).argmax(axis=1)
    rows = np.arange(p.sentences)
    enough = (cos[rows, leaning] >= COSINE) | (cos[rows, leaning] >= LEANING) & (share[rows, leaning] > 0)
    return np.where(sure, best, np.where(enough, leaning, -1))


def _round(blocks: DataFrame, space: Space) -> tuple[np.ndarray, np.ndarray]:
    """(sum of sentence vectors by subject and language, counts of terms by subject) over all documents."""
    shared = blocks.sparkSession.sparkContext.broadcast(space)
    n, k, width = len(space.weight), len(space.subjects), space.vectors.shape[1]

    def add(total: dict[str, np.ndarray], block: Block) -> None:
        s = shared.value
        p = Placed(block, s.index)
        kept: list[tuple[int, np.ndarray, np.ndarray]] = []
        subject = assign(p, s, s.least_mass(), lambda *x: kept.append(x))
        for j, at, v in kept:
            chosen = np.zeros((len(at), k), dtype=np.float32)
            has = subject[at] >= 0
            chosen[has, subject[at][has]] = 1
            total["centre"].reshape(k, len(CODES), width)[:, j] += chosen.T @ v
        # a term counts for the subjects of the document's other sentences, so that what any
        # text says cannot vouch for itself
        own = np.flatnonzero(subject >= 0)
        others = np.bincount(p.document[own] * k + subject[own], minlength=p.documents * k).reshape(-1, k)[p.document].astype(np.float32)
        others[own, subject[own]] -= 1
        others /= np.maximum(others.sum(axis=1, keepdims=True), 1)
        used, place = np.unique(p.term, return_inverse=True)
        for j in range(k):
            total["counts"][used, j] += np.bincount(place, weights=others[:, j][p.sentence], minlength=len(used))

    out = _summed(blocks, lambda: {"centre": np.zeros((k * len(CODES), width)), "counts": np.zeros((n, k))}, add)
    shared.unpersist()
    return out["centre"].reshape(k, len(CODES), width), out["counts"]


def _seeds(documents: DataFrame, labels: DataFrame, names: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(ids, subject numbers) of at most SEED_DOCUMENTS documents with one label, sorted by id."""
    single = labels.where("subject is not null and doc_id is not null").groupBy("doc_id").agg(F.collect_set("subject").alias("s")).where("size(s) = 1").select("doc_id", F.col("s")[0].alias("subject"))
    single = single.where(F.col("subject").isin(*names)).join(documents.select("doc_id"), "doc_id", "left_semi")
    got = single.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SEED_DOCUMENTS).toPandas().sort_values("doc_id")
    return got["doc_id"].to_numpy(dtype=np.int64), np.array([names.index(s) for s in got["subject"]], dtype=np.int64)


def fit(documents: DataFrame, labels: DataFrame, subjects: DataFrame) -> tuple[DataFrame, Space]:
    """(blocks of documents, space). labels: doc_id, subject, given by hand and partly wrong; doubled rows count once."""
    model = langmodel.fit(documents, "text", "lang", ["doc_id"], LANGUAGE_ROWS, refine=False, backoff=False)
    blocks, index, weight = tokenise(documents, model)
    names = sorted(r.subject for r in subjects.select("subject").where("subject is not null").distinct().collect())
    k = len(names)
    space = Space(index, weight, decompose(blocks, index, weight) if len(index) else np.zeros((0, 1), np.float32), names, np.zeros((k, len(CODES), RANK)))
    width = space.vectors.shape[1]
    space.centroids = np.zeros((k, len(CODES), width))
    if not names or not len(index):
        return blocks, space
    seeds = blocks.sparkSession.sparkContext.broadcast((*_seeds(documents, labels, names), space))

    def embed(total: dict[str, np.ndarray], block: Block) -> None:
        ids, number, s = seeds.value
        if not len(ids):
            return
        i = np.minimum(np.searchsorted(ids, block.ids), len(ids) - 1)
        labelled = np.flatnonzero(ids[i] == block.ids)
        p = Placed(block, s.index)
        for d in labelled:
            t = p.term[p.of == d]
            t = t[s.weight[t] > NEGLIGIBLE]
            total["centre"][number[i[d]] * len(CODES) + block.langs[d]] += _unit((s.vectors[t] * s.weight[t, None]).sum(axis=0))

    centre = _summed(blocks, lambda: {"centre": np.zeros((k * len(CODES), width))}, embed)["centre"].reshape(k, len(CODES), width)
    space.centroids = _unit(centre)
    for _ in range(ROUNDS):
        sums, counts = _round(blocks, space)
        before, size = space.centroids, np.linalg.norm(sums, axis=-1)
        # the seed keeps a part of each centroid, so that a subject cannot drift away
        space.centroids = _unit(0.3 * _unit(centre) + _unit(sums))
        share = (counts + 0.5) / (counts.sum(axis=1, keepdims=True) + 0.5 * k)
        entropy = -(share * np.log(share)).sum(axis=1) / np.log(max(2, k))
        space.weight = (weight * np.clip(1.0 - entropy, 0.0, 1.0) ** 1.5).astype(np.float32)
        if (size * (1 - (space.centroids * before).sum(axis=-1))).sum() < SETTLED * max(size.sum(), 1e-9):
            break
    return blocks, space


def document_subjects(documents: DataFrame, labels: DataFrame, subjects: DataFrame, least: float = SHARE) -> DataFrame:
    """doc_id, subject, share, sentences: every subject that at least this share of a document's sentences treat.

    Documents without sentences or id have no subject. Repeated documents are judged alike. Without
    labels no document has a subject.
    """
    blocks, space = fit(documents, labels, subjects)
    shared = blocks.sparkSession.sparkContext.broadcast(space)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = shared.value
        mass, k = s.least_mass(), max(1, len(s.subjects))
        for block in _blocks(batches):
            p = Placed(block, s.index)
            subject = assign(p, s, mass)
            has = subject >= 0
            counts = np.bincount(p.document[has] * k + subject[has], minlength=p.documents * k).reshape(-1, k)
            n = np.bincount(p.document, minlength=p.documents)
            i, j = np.nonzero((counts > 0) & (counts >= least * n[:, None]))
            if len(i):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(block.ids[i]), pa.array([s.subjects[x] for x in j], type=pa.string()), pa.array(counts[i, j] / n[i]), pa.array(n[i].astype(np.int32))], names=["doc_id", "subject", "share", "sentences"]
                )

    return blocks.mapInArrow(judge, "doc_id long, subject string, share double, sentences int").dropDuplicates(["doc_id", "subject"])
