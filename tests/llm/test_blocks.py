"""Blocks of numbered terms against plain loops; prechecks of encodings against the automata themselves."""

import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as hs

from papyra.llm import encoding, ocr, subjects
from papyra.llm.langs import NOTATION

LETTERS = "abé ßд漢字かなカー한 .!?。、\n\n12\t-#"


def slowly(text: str) -> list[list[str]]:
    """Terms of each sentence by a plain loop."""
    out = []
    for s in subjects.marked(text).split(subjects.STOP)[:-1]:
        if not re.search(r"\w", s):
            continue
        terms = []
        for run in re.findall(r"[぀-ヿー]+|[㐀-鿿々]+|[^\W\d_぀-ヿ㐀-鿿々]+", s.lower()):
            terms += [run[i : i + 2] for i in range(len(run) - 1)] if "㐀" <= run[0] <= "鿿" and len(run) > 1 else [run]
        out.append(terms)
    return out


def coded(texts: list[str]) -> list[list[int]]:
    """Hashes by sentence, of all texts in a row."""
    h, _ = subjects.hashed([subjects.marked(t) for t in texts])
    out, row = [], []
    for x in h.tolist():
        if x == 0:
            out.append(row)
            row = []
        elif x > 1:
            row.append(x)
    assert not row
    return out


@settings(max_examples=200, deadline=None)
@given(texts=hs.lists(hs.text(alphabet=LETTERS, max_size=60), max_size=5))
def test_terms_like_a_plain_loop(texts):
    want = [s for t in texts for s in slowly(t)]
    got = coded(texts)
    assert [len(x) for x in got] == [len(x) for x in want]
    # equal terms have equal hashes, others others
    both = {}
    for a, b in zip(want, got):
        for x, y in zip(a, b):
            assert both.setdefault(x, y) == y
    assert len(set(both.values())) == len(both)


def test_long_texts_are_read_in_parts(monkeypatch):
    text = "One fence was red. The gate stayed shut! " * 300
    whole = coded([text, "", "Next."])
    monkeypatch.setattr(subjects, "PART_CHARS", 500)
    subjects._powers.cache_clear()
    try:
        assert coded([text, "", "Next."]) == whole
        assert coded(["x" * 3000 + "."]) == [[coded(["x" * 3000 + "."])[0][0]]]
    finally:
        subjects._powers.cache_clear()


def test_block_survives_a_round_trip():
    block, counts = subjects.read_block(np.array([7, 8, 9]), ["A hen. A cock and a hen.", "No end mark", "漢字です。"], np.zeros(0, dtype=np.uint64), np.zeros((0, 12)))
    again = subjects.Block.of_row(*block.row())
    for k in ("ids", "langs", "sizes", "words", "codes"):
        assert (getattr(again, k) == getattr(block, k)).all()
    assert again.sizes.tolist() == [9, 0, 3] and again.langs[2] == 9
    hen = subjects.term_hashes(["hen"])[0]
    assert [r[2] for r in counts.tolist() if np.int64(r[1]).view(np.uint64) == hen] == [1]


@settings(max_examples=150, deadline=None)
@given(text=hs.text(alphabet=hs.sampled_from("aé“ñд漢üß €œ"), max_size=20), codec=hs.sampled_from(encoding.READ_AS))
def test_no_automaton_is_left_out(text, codec):
    garbled = "".join(c if (c := bytes([b]).decode(codec, "ignore")) else chr(b) for b in text.encode("utf-8"))
    for other in encoding.READ_AS:
        if encoding._automaton(other).search(garbled):
            assert other in encoding._automata_for(garbled)


def test_the_same_with_and_without_memory(monkeypatch):
    tokens = {"größe": 50, "müller": 40, "договор": 90, "été": 30}
    chars = {c: 100 for t in tokens for c in t if c > "\x7f"}
    texts = ["GrÃ¶ÃŸe und MÃ¼ller", "„Größe“ – Müller", "Ј®¤г", "договор", "Ã©tÃ©", None, "", "?????"]
    judge = encoding.Judge(tokens, chars, tuple(NOTATION))
    once = [encoding.repair(t, judge) for t in texts]
    assert once == [encoding.repair(t, judge) for t in texts]
    monkeypatch.setattr(encoding, "MEMORY", 0)
    assert once == [encoding.repair(t, encoding.Judge(tokens, chars, tuple(NOTATION))) for t in texts]
    assert once[0][2] == "Größe und Müller" and once[3] == (False, False, "договор", None)


def test_words_that_stand_everywhere_take_no_part_in_the_join(spark):
    rows = [(False, 1, i, i, "word", w, 1, False) for i in range(50) for w in ("the", "thc")] + [(False, 1, 0, 0, "word", "fencc", 1, False)]
    words = spark.createDataFrame(rows, "file_doc boolean, doc_id long, page_index int, part int, kind string, word string, n int, speck boolean")
    fixes = spark.createDataFrame([("thc", "the", 900), ("fencc", "fence", 90)], "variant string, word string, n_word long")
    assert set(ocr.hot_words(words.groupBy("kind", "word").agg({"n": "sum"}).withColumnRenamed("sum(n)", "n"))) == {"the", "thc"}
    plain = sorted(map(tuple, ocr.misread_words(words, fixes, []).collect()))
    assert len(plain) == 51 and sorted(map(tuple, ocr.misread_words(words, fixes, ["the", "thc"]).collect())) == plain


@pytest.mark.parametrize("text", ["", "one two-", "foo-\nbar-\nbaz qux", "a-\n\n b", "well-\nknown ~\nx", "漢字-\n字", "x" * 70 + "-\n" + "y" * 50])
def test_broken_words_like_the_pattern(text):
    assert [m.span() for m in ocr._broken(text)] == [m.span() for m in ocr._BROKEN.finditer(text)]


def test_small_and_odd_tables(spark):
    """Too few documents for a vocabulary, one subject, null ids and texts, clashing columns: no row is lost or invented."""
    docs = spark.createDataFrame([(1, "The hen sat. The cock ran.", "eng", 1, "x"), (2, None, None, 2, "y"), (None, "A hen sat.", "eng", 3, "z"), (3, "", "eng", 4, "x")], "doc_id long, text string, lang string, share int, subject string")
    labels = spark.createDataFrame([(1, "farm"), (1, "farm"), (None, "farm"), (2, None)], "doc_id long, subject string")
    subs = spark.createDataFrame([("farm",), (None,)], "subject string")
    assert subjects.document_subjects(docs, labels, subs).count() == 0
    many = spark.range(60).selectExpr("id as doc_id", "concat('Word', id % 3, ' hens and cocks. The barn ', id % 5, ' holds hay', id % 2, '.') as text", "'eng' as lang", "1 as share")
    got = subjects.document_subjects(many, spark.createDataFrame([(i, "farm") for i in range(10)], "doc_id long, subject string"), subs)
    assert got.columns == ["doc_id", "subject", "share", "sentences"] and {r.subject for r in got.collect()} <= {"farm"}
    assert got.count() == got.select("doc_id").distinct().count()
