"""Queries of chunking and condensation over documents."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from papyra.operators import chunk as ch
from papyra.operators import condense as co
from papyra.plans.registry import Catalog

catalog = Catalog()

_WC = "len(list_filter(string_split_regex({x}, '\\s+'), lambda w: w <> ''))"
_BUDGET = 60


def _fold(parts: str, glue: str, budget: int = _BUDGET) -> str:
    """Greedy packing of the parts of each document, in SQL."""
    return f"""WITH p AS (SELECT doc_id, list_transform({parts}, lambda x: {{'done': CAST([] AS STRUCT(t VARCHAR, n BIGINT)[]), 'b': x, 'n': CAST({_WC.format(x='x')} AS BIGINT)}}) AS q FROM documents WHERE length(regexp_replace(text, '\\s', '', 'g')) > 0),
    f AS (SELECT doc_id, list_reduce(q, lambda a, x: CASE WHEN a.n + x.n <= {budget} THEN {{'done': a.done, 'b': CASE WHEN a.b = '' THEN x.b ELSE a.b || {glue} || x.b END, 'n': a.n + x.n}}
        ELSE {{'done': CASE WHEN a.b <> '' THEN list_append(a.done, {{'t': a.b, 'n': a.n}}) ELSE a.done END, 'b': x.b, 'n': x.n}} END) AS a FROM p),
    c AS (SELECT doc_id, CASE WHEN a.b <> '' THEN list_append(a.done, {{'t': a.b, 'n': a.n}}) ELSE a.done END AS chunks FROM f),
    u AS (SELECT doc_id, unnest(range(len(chunks))) AS i, chunks FROM c)
    SELECT doc_id, CAST(i AS INT) AS chunk_index, chunks[i + 1].t AS text, CAST(chunks[i + 1].n AS INT) AS token_count FROM u"""


_PARAGRAPH = _fold("string_split_regex(text, '\\n\\n+')", "chr(10) || chr(10)")
_MARKED = "string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1))"
_SENTENCE = _fold(_MARKED, "' '")


@catalog.add("chunk_paragraph", _PARAGRAPH)
def chunk_paragraph(t):
    return ch.chunk(t.documents, _BUDGET, "paragraph").drop("heading_context")


@catalog.add("split_sentences", _SENTENCE)
def split_sentences(t):
    return ch.chunk(t.documents, _BUDGET, "sentence").drop("heading_context")


@catalog.add("chunk_tokens", f"""WITH w AS (SELECT doc_id, list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '') AS w FROM documents),
    u AS (SELECT doc_id, w, unnest(range(CAST(ceil(len(w) / {_BUDGET}.0::DOUBLE) AS BIGINT))) AS i FROM w WHERE len(w) > 0)
    SELECT doc_id, CAST(i AS INT) AS chunk_index, array_to_string(w[i * {_BUDGET} + 1 : (i + 1) * {_BUDGET}], ' ') AS text, CAST(least({_BUDGET}, len(w) - i * {_BUDGET}) AS INT) AS token_count FROM u""")
def chunk_tokens(t):
    return ch.chunk(t.documents, _BUDGET, "tokens").drop("heading_context")


@catalog.add("overlap", f"""WITH c AS ({_PARAGRAPH}), x AS (SELECT *, lag(text) OVER (PARTITION BY doc_id ORDER BY chunk_index) AS before FROM c),
    y AS (SELECT *, array_to_string(list_filter(string_split_regex(before, '\\s+'), lambda w: w <> '')[-8:], ' ') AS tail FROM x)
    SELECT doc_id, chunk_index, CASE WHEN tail <> '' THEN tail || chr(10) || chr(10) || text ELSE text END AS text, CAST(CASE WHEN tail <> '' THEN {_WC.format(x="tail || ' ' || text")} ELSE token_count END AS INT) AS token_count FROM y""")
def overlap(t):
    return ch.chunk(t.documents, _BUDGET, "paragraph", overlap=8).drop("heading_context")


@catalog.add("overlap_window", f"WITH c AS ({_PARAGRAPH}) SELECT doc_id, chunk_index, lag(text) OVER (PARTITION BY doc_id ORDER BY chunk_index) AS before FROM c")
def overlap_window(t):
    c = ch.chunk(t.documents, _BUDGET, "paragraph")
    return c.select("doc_id", "chunk_index", F.lag("text").over(Window.partitionBy("doc_id").orderBy("chunk_index")).alias("before"))


@catalog.add("chunk_stats", f"SELECT doc_id, count(*) AS chunks, min(token_count) AS least, max(token_count) AS most, CAST(floor(avg(token_count) + 0.5) AS INT) AS mean FROM ({_PARAGRAPH}) GROUP BY doc_id")
def chunk_stats(t):
    return ch.chunk_stats(ch.chunk(t.documents, _BUDGET, "paragraph"))


_EMPTY = "{'done': CAST([] AS STRUCT(t VARCHAR, n BIGINT)[]), 'b': '', 'n': CAST(0 AS BIGINT)}"
_FLUSHED = "CASE WHEN a.b <> '' THEN list_append(a.done, {'t': a.b, 'n': a.n}) ELSE a.done END"


def _held(budget: int, glue: str, x: str, else_: str) -> str:
    """One step of greedy packing: x joins what is held while both stay within the budget."""
    return f"CASE WHEN a.n + {x}.n <= {budget} THEN {{'done': a.done, 'b': CASE WHEN a.b = '' THEN {x}.b ELSE a.b || {glue} || {x}.b END, 'n': a.n + {x}.n}} {else_} ELSE {{'done': {_FLUSHED}, 'b': {x}.b, 'n': {x}.n}} END"


def _parts_of(split: str) -> str:
    return f"list_transform({split}, lambda y: {{'done': CAST([] AS STRUCT(t VARCHAR, n BIGINT)[]), 'b': y, 'n': CAST({_WC.format(x='y')} AS BIGINT)}})"


_BY_SENTENCE = f"list_transform([list_reduce({_parts_of(_MARKED.replace('text', 'x.b'))}, lambda a, s: {_held(_BUDGET, chr(39) + ' ' + chr(39), 's', '')}, {_EMPTY})], lambda a: {_FLUSHED})[1]"
_STEP = _held(_BUDGET, "chr(10) || chr(10)", "x", f"WHEN x.n > {_BUDGET} THEN {{'done': list_concat({_FLUSHED}, {_BY_SENTENCE}), 'b': '', 'n': CAST(0 AS BIGINT)}}")
_SPLIT = "string_split_regex(text, '\\n\\n+')"


@catalog.add("split_paragraphs", f"""WITH f AS (SELECT doc_id, list_reduce({_parts_of(_SPLIT)}, lambda a, x: {_STEP}, {_EMPTY}) AS a FROM documents WHERE length(regexp_replace(text, '\\s', '', 'g')) > 0),
    c AS (SELECT doc_id, {_FLUSHED} AS chunks FROM f), u AS (SELECT doc_id, unnest(range(len(chunks))) AS i, chunks FROM c)
    SELECT doc_id, CAST(i AS INT) AS chunk_index, chunks[i + 1].t AS text, CAST(chunks[i + 1].n AS INT) AS token_count FROM u""")
def split_paragraphs(t):
    return ch.chunk(t.documents, _BUDGET, "paragraph_sentence").drop("heading_context")


@catalog.add("chunk_heading")
def chunk_heading(t):
    return ch.chunk(t.documents, 120, "heading")


# fences as a fold over the lines: one ends only at a line of its own sign, at least as long
_FENCE = "regexp_extract(x.line, '^\\s*(`{3,}|~{3,})', 1)"
_HEADINGS = f"""WITH l AS (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda x, i: {{'line': x, 'i': i, 'fence': '', 'found': CAST([] AS STRUCT(i BIGINT, line VARCHAR)[])}}) AS q FROM documents WHERE text IS NOT NULL),
    f AS (SELECT doc_id, list_reduce(q, lambda a, x: {{'line': x.line, 'i': x.i, 'fence': CASE WHEN {_FENCE} = '' THEN a.fence WHEN a.fence = '' THEN {_FENCE} WHEN {_FENCE}[1] = a.fence[1] AND length({_FENCE}) >= length(a.fence) THEN '' ELSE a.fence END,
        'found': CASE WHEN a.fence = '' AND {_FENCE} = '' AND regexp_matches(x.line, '^#{{1,6}}\\s+.+$') THEN list_append(a.found, {{'i': CAST(x.i AS BIGINT), 'line': x.line}}) ELSE a.found END}},
        {{'line': '', 'i': CAST(0 AS BIGINT), 'fence': '', 'found': CAST([] AS STRUCT(i BIGINT, line VARCHAR)[])}}) AS a FROM l),
    h AS (SELECT doc_id, unnest(a.found) AS x FROM f)
    SELECT doc_id, CAST(x.i - 1 AS INT) AS line_index, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY x.i) - 1 AS INT) AS heading_index, length(regexp_extract(x.line, '^(#{{1,6}})\\s', 1)) AS level, trim(regexp_extract(x.line, '^#{{1,6}}\\s+(.+)$', 1)) AS heading FROM h"""


@catalog.add("parse_sections", _HEADINGS)
def parse_sections(t):
    """The headings that the chunker sees, with their lines."""
    return ch.headings(t.documents)


@catalog.add("fit_check", f"SELECT doc_id, {_WC.format(x='text')} <= 100 AS fits FROM documents WHERE text IS NOT NULL")
def fit_check(t):
    from papyra.functions.tokens import word_tokens

    return t.documents.where("text is not null").select("doc_id", (word_tokens(F.col("text")) <= 100).alias("fits"))


_HALF = "array_to_string(w[1 : CAST(ceil(len(w) / 2.0::DOUBLE) AS INT)], ' ')"


@catalog.add("map_phase", f"SELECT doc_id, chunk_index, {_HALF} AS summary FROM (SELECT doc_id, chunk_index, list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '') AS w FROM ({_PARAGRAPH}))")
def map_phase(t):
    c = ch.chunk(t.documents, _BUDGET, "paragraph")
    return c.select("doc_id", "chunk_index", co._call(co.half_the_words, co.MAP_PROMPT)("text", F.lit(100)).alias("summary"))


def _condensed(t):
    return co.condense(t.documents.select("doc_id", "text"), F.lit(80), budget=200, strategy="paragraph")


@catalog.add("condense")
def condense(t):
    return _condensed(t)


# a text that fits passes through unchanged; of the others SQL can say what it was and that nothing grew
_FITS = f"SELECT doc_id, coalesce(length(text), 0) AS chars_in, {_WC.format(x="coalesce(text, '')")} <= 80 AS passthrough, true AS consistent FROM documents"


@catalog.add("condense_result", _FITS)
def condense_result(t):
    """What condensation reports of each text, held against its own output: sizes, ratio, and that a text which fits is unchanged."""
    c = _condensed(t)
    ratio = F.when(F.col("chars_in") == 0, F.lit(1.0)).otherwise(F.round(F.length("text") / F.col("chars_in"), 6))
    right = (F.col("chars_out") == F.length("text")) & (F.col("ratio") == ratio) & F.when(F.col("passthrough"), F.col("chars_out") == F.col("chars_in")).otherwise((F.col("calls") > 0) & (F.col("chars_out") < F.col("chars_in")))
    return c.select("doc_id", "chars_in", "passthrough", right.alias("consistent"))
