"""Problem 1: pieces stay within the limit and give the text back."""

from hypothesis import given, settings
from hypothesis import strategies as hs
from pyspark.sql import functions as F

from papyra.llm import split


@settings(max_examples=200, deadline=None)
@given(text=hs.text(alphabet="ab .\n#`é‍́。", max_size=300), limit=hs.integers(1, 60), overlap=hs.integers(0, 70))
def test_round_trip(text, limit, overlap):
    pieces = split.bisect_text(text, limit, overlap)
    assert all(len(p[5]) <= limit for p in pieces)
    assert "".join(text[c:e] for _, _, c, e, _, _ in pieces) == text
    assert all(p[5] == text[p[1] : p[3]] for p in pieces)
    assert [p[0] for p in pieces] == list(range(len(pieces)))
    for before, p in zip(pieces, pieces[1:]):
        assert before[2] <= p[1] <= p[2] == before[3]


def test_natural_boundaries():
    text = "First paragraph here.\n\nSecond paragraph here.\n\n```\ncode a\n\ncode b\n```\n\nLast one."
    pieces = split.bisect_text(text, 45, 0)
    assert all(p[4] in ("paragraph", "end") for p in pieces)
    assert any("code a\n\ncode b" in p[5] for p in pieces)


def test_very_long_line_is_linear():
    text = "x" * 2_000_000
    assert sum(e - c for _, _, c, e, _, _ in split.bisect_text(text, 1000, 100)) == len(text)


def test_sections(spark):
    s = spark.createDataFrame(
        [(1, 0, "docx", "H", ["a" * 30, None, "b"], "x"), (1, 0, "docx", "H", ["a" * 30, None, "b"], "x"), (1, 1, None, None, None, "x"), (2, 0, "docx", "", [], "x"), (2, 1, "odt", None, ["y" * 500], "x")],
        "doc_id long, section_index int, format string, heading string, lines array<string>, text string",
    )
    b = spark.createDataFrame([("DOCX", 20, 4), ("docx", 20, 4)], "format string, max_chars int, overlap_chars int")
    got = split.split_sections(s, b).collect()
    assert {(r.doc_id, r.section_index) for r in got if r.piece_index > 0} == {(1, 0)}
    assert "".join(r.piece[r.core_start - r.start :] for r in sorted(got, key=lambda r: r.piece_index) if (r.doc_id, r.section_index) == (1, 0)) == "H\n" + "a" * 30 + "\n\nb"
    assert len([r for r in got if r.doc_id == 2]) == 2 and split.split_sections(s.limit(0), b.limit(0)).count() == 0


def test_clashing_columns_and_nulls(spark):
    df = spark.createDataFrame([(1, "abcdef", "p"), (2, None, "p"), (3, "", "p")], "k long, t string, piece string")
    got = {(r.k, r.piece_index): r.piece for r in split.split_oversized(df, "t", F.lit(4), F.lit(9), ["k"]).collect()}
    assert got[2, 0] is None and got[3, 0] == "" and "".join(v[-1:] for (k, i), v in sorted(got.items()) if k == 1 and i) == "ef"
    assert split.split_oversized(df, "t", F.lit(None).cast("int"), F.lit(1), ["k"]).count() == 3
