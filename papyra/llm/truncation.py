"""Problem 2: answers that break off inside a word, a sentence or an opened structure.

The corpus gives a vocabulary trie, kept as a relation (one row for each prefix of a known word, with
what lies below it), and the frames of sentences (their first two words with the words they end on). An
answer's structure and its own prompt decide most cases. Of the rest, whose last sentence has no end
mark, those at a model's length limit are cut; the others are held against trie and frames.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from papyra.session import cut_lineage

#: So many sentences must share a frame before it can say what they end on.
FRAME = 15
#: A last line is whole where so many answers (copies count once) end on it and make up at least this share of those that begin with it.
COMMON_LINE = 4
LINE_SHARE = 0.5
#: Lines of no more words than a frame's start (labels such as "no") begin unrelated sentences too: their share says nothing.
FRAME_WORDS = 2
#: Keys of more than this part of all look-ups are joined apart, as a table of fewer rows than its inverse.
HOT = 0.001

INVISIBLE = "​‌‍⁠﻿­"
_BLANK = re.compile(rf"[\s{INVISIBLE}]+")
_EMPTY = re.compile(rf"(?:[\s{INVISIBLE}\"'“”„«»`*_]|```\w*|<[^>]*>|&nbsp;|null\b|none\b|\{{\s*\}}|\[\s*\])*", re.I)
_DONE = re.compile(r"(?:[.!?。！？]|(?<=\d) ?%)[\"'”’»)\]*_`」』]*$")
_HANGING = re.compile(r"[,;:(\[{“„«‘¿¡–—/&+=、，；：「『-][\"'”’»*_]*$")
_SENTENCE = re.compile(r"(?<=[.!?])[\"'”’»)\]*_]*\s+|(?<=[。！？])[」』”’]*\s*|\n+")
_ITEM = re.compile(r"^\s*(?:[-*+•]|[0-9]{1,3}[.)])\s+")
_ITEM_SIGNS = frozenset("-*+•0123456789")
_HEAD = re.compile(r"^\s*(?:#{1,6}\s+|>\s*)+")
_WORDS = re.compile(r"[^\W\d_]+(?:[’'-][^\W\d_]+)*")
_DENSE = re.compile(r"[぀-ヿ㐀-鿿]")
_DIGITS = re.compile(r"\d+")


def visible(text: str | None) -> bool:
    """Whether anything is left besides white space, invisible characters and empty markup."""
    return bool(text) and not _EMPTY.fullmatch(text)


def _json_open(s: str) -> bool:
    depth, inside, escaped = 0, False, False
    for c in s:
        if inside:
            if escaped:
                escaped = False
            elif c == "\\":
                escaped = True
            elif c == '"':
                inside = False
        elif c == '"':
            inside = True
        elif c in "{[":
            depth += 1
        elif c in "}]":
            depth -= 1
    return inside or depth > 0


def keys_of(sentence: str) -> tuple[str, str, int]:
    """(first words, last word, number of words) of a sentence; of characters where a script has no spaces."""
    s = _DIGITS.sub("0", sentence.strip().lower()).strip(" .!?。！？\"'“”„«»()[]*_`")
    if not s.isascii() and _DENSE.search(s):
        return s[:2], s[-2:], len(s)
    w = s.split()
    if not w:
        return "", "", 0
    return " ".join(w[:2]), w[-1].strip(",;:\"'“”„«»()[]*_`"), len(w)


def hash64(text: str) -> int:
    """64-bit hash, the one of Spark's xxhash64."""
    h = xxhash.xxh64_intdigest(text.encode("utf-8", "replace"), seed=42)
    return h - (1 << 64) if h >> 63 else h


def tail(output: str | None, prompt: str | None) -> tuple[str, str, str, str, str, int, str]:
    """(status, why, last token, frame start, frame end, words, last line): status cut, whole, open or empty."""
    if not visible(output):
        return "empty", "", "", "", "", 0, ""
    t = output.rstrip().rstrip(INVISIBLE + " \n\t\r")
    if t.endswith("�"):
        return "cut", "character", "", "", "", 0, ""
    if t.endswith(("…", "...")):
        return "cut", "ellipsis", "", "", "", 0, ""
    lines = t.split("\n")
    last = lines[-1]
    fences = [x for x in lines if x.lstrip().startswith(("```", "~~~"))]
    body = t
    if fences and lines[0].lstrip().startswith("```"):
        body = "\n".join(lines[1:-1] if last.strip() == "```" else lines[1:])
    start = body.lstrip()[:1]
    if start in ("{", "["):
        if _json_open(body):
            return "cut", "json", "", "", "", 0, ""
        if body.lstrip()[:2] != "[]" and body.rstrip()[-1:] in "}]":
            return ("cut", "fence", "", "", "", 0, "") if len(fences) % 2 else ("whole", "json", "", "", "", 0, "")
    if len(fences) % 2 or (last.strip() in ("`", "``") and fences):
        return "cut", "fence", "", "", "", 0, ""
    if last.strip() == "```":
        return "whole", "fence", "", "", "", 0, ""
    if last.lstrip().startswith("|"):
        block = []
        for x in reversed(lines):
            if not x.lstrip().startswith("|"):
                break
            block.append(x.strip())
        head = block[-1].count("|")
        whole = last.rstrip().endswith("|") and last.count("|") == head and len(block) > 2
        return ("whole" if whole else "cut"), "table", "", "", "", 0, ""
    if _DONE.search(last) and not last.endswith((",”", ',"')):
        return "whole", "mark", "", "", "", 0, ""
    if _HANGING.search(last) or last.endswith((",”", ',"')):
        return "cut", "sentence", "", "", "", 0, ""
    item = _ITEM.match(last)
    plain = (_ITEM if item else _HEAD).sub("", last).strip()
    if re.search(r"https?://\S+$", plain):
        return "whole", "address", "", "", "", 0, ""
    if prompt and not item and len(plain) >= 12:
        near = plain[-60:]
        at = prompt.rfind(near)
        if at >= 0:
            rest = prompt[at + len(near) :].split("\n", 1)[0]
            if not re.search(r"\w", rest):
                return "whole", "prompt", "", "", "", 0, ""
            return "cut", "word" if rest[0].isalnum() else "sentence", "", "", "", 0, ""
    piece = plain if item else (_SENTENCE.split(plain)[-1] or plain)
    a, z, n = keys_of(piece)
    found = _WORDS.findall(plain.lower())
    token = "" if not plain[-1:].isalpha() or not found or _DENSE.match(found[-1]) or _DENSE.match(plain[-1]) else found[-1]
    return "open", "", token, "•" if item else a, z, n, _DIGITS.sub("0", plain.lower())


def line_hashes(line: str) -> list[int]:
    """Hashes of a line's beginnings, word by word, also without the comma or colon they end on; the last is of the whole line."""
    raw, out, at = line.encode("utf-8", "replace"), [], -1
    # a short line's beginnings are hashed one by one, a long one's on from each other
    h, done = (xxhash.xxh64(seed=42), 0) if len(raw) > 1000 else (None, 0)
    while at < len(raw):
        at = raw.find(b" ", at + 1)
        at = len(raw) if at < 0 else at
        bare = len(raw[done:at].rstrip(b",;:")) + done
        for end in (bare, at) if bare != at else (at,):
            if h is None:
                out.append(xxhash.xxh64_intdigest(raw[:end], seed=42))
            else:
                h.update(raw[done:end])
                done = end
                out.append(h.intdigest())
    return [x - (1 << 64) if x >> 63 else x for x in out]


#: One pass over the texts gives rows of several kinds: tails (t), words (w), frames (f), last lines (l) and numbers of answers by length (n).
RAW = {
    "kind": "string", "id": "string", "experiment": "string", "provider": "string", "model": "string", "limited": "boolean", "n_tokens": "long", "h": "long",
    "status": "string", "why": "string", "token": "string", "a": "string", "z": "string", "n_words": "int", "line": "long", "digit": "boolean",
    "n": "long", "least": "int", "digest": "long", "starts": "array<long>", "defect": "string",
}
LOOKED = ["id", "experiment", "provider", "model", "limited", "n_tokens", "h", "status", "why", "token", "a", "z", "n_words", "line", "digit", "defect"]


_TYPES = {"string": pa.string(), "boolean": pa.bool_(), "long": pa.int64(), "int": pa.int32(), "array<long>": pa.list_(pa.int64())}


def _rows(kind: str, columns: list[str], rows: list[tuple]) -> pa.RecordBatch:
    """Rows of one kind; the columns of the others are null."""
    given = dict(zip(columns, zip(*rows))) if rows else {}
    given["kind"] = [kind] * len(rows)
    return pa.RecordBatch.from_arrays([pa.array(given[k], type=_TYPES[t]) if k in given else pa.nulls(len(rows), type=_TYPES[t]) for k, t in RAW.items()], names=list(RAW))


Batch = dict[str, list]


def counts(batch: Batch) -> Iterator[pa.RecordBatch]:
    """Words, frames and lengths, summed over a batch before they leave Python, and each answer's last line with a digest of prompt and answer."""
    # no word holds white space: what stands between it is counted first, and its words are looked up once for each
    tokens: Counter[str] = Counter()
    last_words: Counter[str] = Counter()
    frames: dict[tuple[str, str], list[int]] = {}
    lines: list[tuple] = []
    for model, n_tokens, limited, prompt, output in zip(batch["model"], batch["n_tokens"], batch["limited"], batch["prompt"], batch["output"]):
        if prompt:
            tokens.update(prompt.lower().split())
        if not output:
            continue
        found = output.lower().split()
        tokens.update(found)
        # the last word of an answer may be cut: it counts for nothing
        last_words.update(next((w[-1:] for t in reversed(found) if (w := _WORDS.findall(t))), []))
        parts = _SENTENCE.split(output)
        for k, s in enumerate(parts):
            s = s.strip()
            if len(s) < 4 or s[0] in "{|`":
                continue
            item = s[0] in _ITEM_SIGNS and _ITEM.match(s)
            done = s[-1] in ".!?。！？" or _DONE.search(s)
            if not done and (not item or k == len(parts) - 1):
                continue
            a, z, n = keys_of(_ITEM.sub("", s) if item else s)
            f = frames.setdefault(("•" if item else a, z), [0, n])
            f[0] += 1
            f[1] = min(f[1], n)
        last = _DIGITS.sub("0", (output.rstrip().rsplit("\n", 1)[-1]).lower())
        last = (_ITEM if _ITEM.match(last) else _HEAD).sub("", last).strip()
        if last and last[0] not in "{|`":
            starts = line_hashes(last)
            lines.append((model, n_tokens, limited, last.count(" ") + 1, starts[-1], hash64(f"{prompt}\0{output.rstrip()}"), starts))
    words: Counter[str] = Counter()
    for t, n in tokens.items():
        for w in _WORDS.findall(t):
            words[w] += n
    words.subtract(last_words)
    # a word of a script without spaces is no token that a tail may end on
    yield _rows("w", ["a", "n"], [(w, n) for w, n in words.items() if n > 0 and not _DENSE.match(w)])
    yield _rows("f", ["a", "z", "n", "least"], [(a, z, n, m) for (a, z), (n, m) in frames.items()])
    yield _rows("l", ["model", "n_tokens", "limited", "n_words", "line", "digest", "starts"], lines)
    by = Counter((m, t) for m, t in zip(batch["model"], batch["n_tokens"]) if t is not None)
    yield _rows("n", ["model", "n_tokens", "n"], [(m, t, n) for (m, t), n in by.items()])


def look(batch: Batch, keep_whole: bool = True, defects: list[str | None] | None = None) -> pa.RecordBatch:
    """The tails of a batch of entries. keep_whole=False leaves out entries that are whole or empty and have no defect."""
    kept = zip(*(batch[k] for k in ("id", "experiment", "provider", "model", "limited", "n_tokens", "h")))
    found = zip(kept, (tail(o, p) for o, p in zip(batch["output"], batch["prompt"])), defects or [None] * len(batch["id"]))
    return _rows("t", LOOKED, [(*k, *x[:6], hash64(x[6]), x[6].endswith("0"), d) for k, x, d in found if keep_whole or d or x[0] in ("cut", "open")])


def read_texts(entries: DataFrame, keep_whole: bool = True, judge: Callable[[Batch], list[str | None]] | None = None) -> DataFrame:
    """Rows of RAW from one pass over the texts of all entries, written once. judge gives other defects of a batch's entries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            batch = b.to_pydict()
            yield look(batch, keep_whole, judge(batch) if judge else None)
            yield from counts(batch)

    return cut_lineage(to_look(entries).mapInArrow(run, ", ".join(f"{k} {v}" for k, v in RAW.items())))


def common_lines(lines: DataFrame, spikes: DataFrame) -> DataFrame:
    """line (its hash): last lines that are whole, as most of the answers that begin with them end there.

    lines: rows of kind l. Copies of an answer count once (the same label given to different prompts doesn't), and
    those with length evidence (limited, or at one of the spikes) only among the ones that begin with a line.
    """
    free = lines.where("not limited").join(spikes, ["model", "n_tokens"], "left_anti")
    ends = cut_lineage(free.groupBy("line").agg(F.countDistinct("digest").alias("n_line"), F.min("n_words").alias("n_words")).where(F.col("n_line") >= COMMON_LINE))
    answers = lines.select("line", "digest", "starts").dropDuplicates(["line", "digest"]).groupBy("line").agg(F.count("*").alias("n"), F.first("starts").alias("starts"))
    begun = answers.select(F.explode(F.array_distinct("starts")).alias("line"), "n").join(ends.select("line"), "line", "left_semi").groupBy("line").agg(F.sum("n").alias("n_begun"))
    return ends.join(begun, "line").where((F.col("n_words") <= FRAME_WORDS) | (F.col("n_line") >= LINE_SHARE * F.col("n_begun"))).select("line")


def trie(words: DataFrame, lengths: list[int]) -> DataFrame:
    """node, below, n_below: each proper prefix of a known word with the number of words, and of their occurrences, under it.

    Only levels of the trie that are looked at (lengths) are kept, so that a long word costs no more than a short one.
    """
    levels = F.array(*[F.lit(k) for k in sorted(set(lengths))]).cast("array<int>")
    known = words.where("n >= 2").select("a", "n", F.explode(F.filter(levels, lambda k: k < F.length("a"))).alias("k"))
    return known.groupBy(F.expr("substring(a, 1, k)").alias("node")).agg(F.count("*").alias("below"), F.sum("n").alias("n_below"))


def entries_of(journal: DataFrame) -> DataFrame:
    """The journal's entries, once each (a redelivered entry has the same content), with what the operators need."""
    return journal.select("id", "experiment", F.lower(F.trim("provider")).alias("provider"), "model", "prompt", "output", F.lower("finish_reason").alias("finish_reason"), F.col("tokens.output").alias("n_tokens"), "error").where("id is not null").dropDuplicates(["id"])


def length_spikes(lengths: DataFrame) -> DataFrame:
    """model, n_tokens where far more answers of a model end than at the lengths around it: its limits. lengths: model, n_tokens, n."""
    counts = lengths.groupBy("model", "n_tokens").agg(F.sum("n").alias("n"))
    around = Window.partitionBy("model").orderBy("n_tokens").rowsBetween(-4, 4)
    return counts.withColumn("usual", F.percentile_approx("n", 0.5).over(around)).where("n >= 8 and n >= 6 * usual and n_tokens >= 64").select("model", "n_tokens")


def _limited() -> Column:
    return F.coalesce(F.col("finish_reason").isin("length", "max_tokens"), F.lit(False))


def to_look(entries: DataFrame) -> DataFrame:
    """The columns that one pass over the texts needs; h is the hash of the answer without white space at its end."""
    more = [c for c in ("declined",) if c in entries.columns]
    return entries.select("id", "experiment", "provider", "model", "output", "prompt", _limited().alias("limited"), "n_tokens", F.xxhash64(F.rtrim("output")).alias("h"), *more)


def looked_up(asks: DataFrame, facts: DataFrame, total: int) -> DataFrame:
    """asks (id, role, key) with what facts (key, v1, v2, v3, one row each) say; keys without a fact are left out.

    Keys that hold more than HOT of the total asks are fewer than its inverse: they are joined as a
    broadcast table of so many rows, so that no task of the shuffled join gets more than its share.
    """
    hot = [r.key for r in asks.groupBy("key").count().where(F.col("count") > max(HOT * total, 1 / HOT)).select("key").collect()]
    cold = asks.join(facts, "key") if not hot else asks.where(~F.col("key").isin(hot)).join(facts.where(~F.col("key").isin(hot)), "key")
    return cold if not hot else cold.unionByName(asks.where(F.col("key").isin(hot)).join(F.broadcast(facts.where(F.col("key").isin(hot))), "key"))


def judge_tails(entries: DataFrame, continued: DataFrame | None = None, keep_whole: bool = True, raw: DataFrame | None = None) -> DataFrame:
    """id, experiment, provider, model, truncated, why of every entry, once each.

    Null and empty outputs are not truncated. continued: hashes h of answers that another answer goes on
    from within a sentence. An open tail of such an answer, or of one at a model's length limit, is cut;
    the others are held against trie, frames and last lines. Ties need no rule: every count is compared with a bound.
    keep_whole=False leaves out entries whose structure already shows a whole answer. raw: what
    read_texts gave for the entries, where it is at hand.
    """
    if raw is None:
        raw = read_texts(entries, keep_whole)
    looked = raw.where("kind = 't'").select(*LOOKED)
    words = cut_lineage(raw.where("kind = 'w'").groupBy("a").agg(F.sum("n").alias("n")))
    frames = cut_lineage(raw.where("kind = 'f'").groupBy("a", F.col("z").alias("b")).agg(F.sum("n").alias("n"), F.min("least").alias("least")))
    spikes = cut_lineage(length_spikes(raw.where("kind = 'n'").select("model", "n_tokens", "n")))
    last = raw.where("kind = 'l'").select("model", "n_tokens", "limited", "n_words", "line", "digest", "starts")
    opened = looked.where("status = 'open'")
    # every look-up of every open tail is one row, so that one join answers all of them
    about = {
        "word": F.when(F.col("token") != "", F.xxhash64(F.lit("word"), "token")),
        "node": F.when(F.col("token") != "", F.xxhash64(F.lit("node"), "token")),
        "frame": F.xxhash64(F.lit("frame"), "a", "z"),
        "start": F.xxhash64(F.lit("start"), "a"),
        "end": F.xxhash64(F.lit("end"), "z"),
        "line": F.xxhash64(F.lit("line"), "line"),
        "spike": F.when(F.col("n_tokens").isNotNull(), F.xxhash64(F.lit("spike"), "model", "n_tokens")),
        "more": F.xxhash64(F.lit("more"), "h"),
    }
    asks = opened.select("id", F.explode(F.array(*[F.struct(F.lit(k).alias("role"), x.alias("key")) for k, x in about.items()])).alias("x")).select("id", "x.role", "x.key").where("key is not null")
    lengths = [r.k for r in opened.where("token <> ''").select(F.length("token").alias("k")).distinct().collect()]
    none = F.lit(0).cast("long")

    def fact(df: DataFrame, role: str, key: list[str], *values: Column) -> DataFrame:
        v = [x.cast("long") for x in values] + [none] * (3 - len(values))
        return df.select(F.xxhash64(F.lit(role), *key).alias("key"), *[x.alias(f"v{i + 1}") for i, x in enumerate(v)])

    starts = frames.groupBy("a").agg(F.sum("n").alias("n"), F.count("*").alias("ends"), F.min("least").alias("least"))
    tables = [
        fact(words, "word", ["a"], F.col("n")),
        fact(frames, "frame", ["a", "b"], F.col("n"), F.col("least")),
        fact(starts, "start", ["a"], F.col("n"), F.col("ends"), F.col("least")),
        fact(frames.groupBy("b").agg(F.sum("n").alias("n")), "end", ["b"], F.col("n")),
        fact(common_lines(last, spikes), "line", ["line"], F.lit(1)),
        fact(spikes, "spike", ["model", "n_tokens"], F.lit(1)),
    ]
    if lengths:
        tables.append(fact(trie(words, lengths), "node", ["node"], F.col("below"), F.col("n_below")))
    if continued is not None:
        tables.append(fact(continued.select("h").distinct(), "more", ["h"], F.lit(1)))
    facts = tables[0]
    for t in tables[1:]:
        facts = facts.unionByName(t)
    got = looked_up(asks, facts, opened.count() * len(about))

    def said(role: str, v: int, name: str) -> Column:
        return F.coalesce(F.max(F.when(F.col("role") == role, F.col(f"v{v}"))), F.lit(0)).alias(name)

    known = (("word", 1, "n_word"), ("node", 1, "below"), ("node", 2, "n_below"), ("frame", 1, "n_frame"), ("start", 1, "n_start"), ("start", 2, "ends"), ("start", 3, "least_start"), ("end", 1, "n_end"), ("line", 1, "common"), ("spike", 1, "spike"), ("more", 1, "more"))
    opened = opened.join(got.groupBy("id").agg(*[said(*k) for k in known]), "id", "left")
    n = {k: F.coalesce(F.col(k), F.lit(0)) for _, _, k in known}
    common = n["common"] > 0
    prefix = (F.col("token") != "") & (n["below"] > 0) & ((n["n_word"] == 0) | (n["n_below"] > 200 * n["n_word"]) & (n["n_frame"] == 0))
    # items of lists are no frame: what ends any sentence may end an item
    closed = (F.col("a") != "•") & (n["n_start"] >= FRAME) & (n["ends"] <= 0.6 * n["n_start"])
    why = (
        F.when(n["more"] > 0, F.lit("continued"))
        .when((n["spike"] > 0) & (F.col("a") != "•"), F.lit("length"))
        .when(common & ~prefix & ((n["n_frame"] > 0) | ~closed), F.lit(None))
        .when(prefix, F.lit("word"))
        .when(closed & (n["n_frame"] == 0), F.lit("sentence"))
        .when(closed & (F.col("n_words") < n["least_start"]), F.lit("sentence"))
        .when(n["n_frame"] > 0, F.when(F.col("limited") & F.col("digit") & (F.col("a") != "•") & (F.col("n_words") > 3), F.lit("sentence")))
        .when((n["n_end"] == 0) & ((F.col("n_words") > 3) | (n["n_word"] >= FRAME)), F.lit("sentence"))
        .when((n["n_end"] < 0.01 * n["n_word"]), F.lit("sentence"))
        .when(F.col("limited") & ~common & (F.col("a") != "•"), F.lit("length"))
    )
    out = ["id", "experiment", "provider", "model"]
    judged = opened.select(*out, why.isNotNull().alias("truncated"), why.alias("why"))
    sure = looked.where("status <> 'open'").select(*out, (F.col("status") == "cut").alias("truncated"), F.when(F.col("status") == "cut", F.col("why")).alias("why"))
    return sure.unionByName(judged)


def canonical_model(df: DataFrame, models: DataFrame) -> DataFrame:
    """df with model replaced by the id its alias stands for (models: provider, id, aliases), else as it is."""
    names = models.select(F.lower("provider").alias("provider"), F.explode(F.array_distinct(F.concat(F.array("id"), F.coalesce("aliases", F.array().cast("array<string>"))))).alias("model"), "id", "ordinal")
    names = names.groupBy("provider", "model").agg(F.min_by("id", "ordinal").alias("__model"))
    return df.join(names, ["provider", "model"], "left").withColumn("model", F.coalesce("__model", "model")).drop("__model")


def truncation_rates(journal: DataFrame, models: DataFrame) -> DataFrame:
    """provider, model, experiment, entries, truncated, rate: one row for each combination."""
    judged = canonical_model(judge_tails(entries_of(journal)), models)
    g = judged.groupBy("provider", "model", "experiment").agg(F.count("*").alias("entries"), F.count_if("truncated").alias("truncated"))
    return g.withColumn("rate", F.round(F.col("truncated") / F.col("entries"), 6))
