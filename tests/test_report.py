"""Reports of sources that span several parts."""

from papyra.operators import report as rp

SCHEMA = "doc_id long, source string, lang string, text string"
LONG = "x" * 30


def test_one_row_for_each_source(spark):
    # a: one run over three parts, then a change of language at the edge of the fourth; b: a tie, the earlier language wins
    rows = [(i, "a", "eng", LONG) for i in (1, 998, 999, 1000, 1001, 2000)] + [(3000, "a", "deu", LONG), (3001, "a", "eng", "")]
    rows += [(5, "b", "fra", LONG), (1005, "b", "deu", LONG), (2005, "b", "deu", LONG), (2006, "b", "fra", LONG), (7, None, "und", None), (4007, None, None, LONG)]
    got = {r.source: r for r in rp.source_report(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert {k: (r.unit_count, r.run_count, r.characters, r.dominant_language, r.score) for k, r in got.items()} == {"a": (8, 3, 210, "eng", 16), "b": (4, 3, 120, "fra", 8), "none": (2, 2, 30, "und", 4)}


def test_parts_do_not_show(spark, monkeypatch):
    rows = [(i, "ab"[i % 7 == 0], ("eng", "deu", None, "und")[i * i // 50 % 4], LONG if i // 30 % 3 else "") for i in range(400)]
    df = spark.createDataFrame(rows, SCHEMA)
    reports = []
    for part in (3, 100, 10_000):
        monkeypatch.setattr(rp, "PART", part)
        reports.append(sorted(map(tuple, rp.source_report(df).collect())))
    assert reports[0] == reports[1] == reports[2] and len(reports[0]) == 2
