"""Rows delivered again, running sums over hot groups, documents that end at an error."""

from pyspark.sql import functions as F

from papyra.operators import chunk as ch
from papyra.plans import registry
from papyra.plans.journal import usage_accumulator
from papyra.streaming import streams as st


def test_once_in_sql():
    assert registry.once_in_sql("SELECT * FROM journal j JOIN models m") == "SELECT * FROM (SELECT DISTINCT ON (id) * FROM journal) j JOIN models m"
    assert registry.once_in_sql("SELECT runs FROM documents") == "SELECT runs FROM documents"


def test_running_sums_never_restart(spark):
    class T:
        journal = spark.range(4000).select(F.format_string("%05d", "id").alias("id"), F.lit("one").alias("experiment"), F.expr("timestamp'2024-01-01' + make_interval(0, 0, 0, 0, 0, int(id) * 7)").alias("ts"), F.struct(F.when(F.col("id") % 3 > 0, F.lit(2)).alias("output")).alias("tokens"))

    got = {r.id: r.running for r in usage_accumulator(T).collect()}
    total = 0
    for i in range(4000):
        total += 2 if i % 3 else 0
        assert got[f"{i:05d}"] == total


def test_an_error_ends_the_document(spark):
    pages = spark.createDataFrame([(1, 0, "a"), (1, 1, None), (1, 2, "c"), (2, 0, "d")], "doc_id long, page_index int, text string")
    got = sorted((r.doc_id, r.page_index, r.event_type) for r in st.page_events(pages).collect())
    assert got == [(1, 0, "content"), (1, 0, "unit-done"), (1, 0, "unit-start"), (1, 1, "error"), (1, 1, "unit-start"), (2, 0, "content"), (2, 0, "unit-done"), (2, 0, "unit-start")]
    assert st.page_events(pages, abort=False).count() == 11


def test_fences_end_by_their_own_sign():
    text = "intro\n# A\n```\n# no\n~~~\n# no\n```\n## B\n````\n```\n# no\n````\n# C"
    assert [(k, h) for _, k, h in ch.scan_headings(text.split("\n"))] == [(1, "A"), (2, "B"), (1, "C")]
    tree = ch.parse_sections(text)
    assert [(s.level, s.heading) for s in tree] == [(0, ""), (1, "A"), (1, "C")] and tree[1].children[0].heading == "B"
    assert "\n".join(s.full() for s in tree) == text


def test_substitution_is_one_pass(spark):
    from papyra.functions import prompts as pr

    df = spark.createDataFrame([("{b}", "x{c}{", None)], "a string, b string, c string")
    got = df.select(pr.substitute(F.lit("{a}-{b}-{c}-{d}-{a}{"), {k: F.col(k) for k in "abc"}, exclude=()).alias("x"), pr.substitute(F.lit("{a}{b}"), {k: F.col(k) for k in "ab"}, exclude=("a",)).alias("y")).first()
    assert got.x == "{b}-x{c}{--{d}-{b}{" and got.y == "{a}x{c}{"


def test_redaction(spark):
    from papyra.functions.errors import redacted

    keys = ["id", "password", "a.token", "a.b.token", "to", "x.to", "req.headers.cookie", "req.headers.host", "input.content"]
    m = F.create_map(*[F.lit(x) for k in keys for x in (k, "v")])
    assert set(spark.range(1).select(redacted(m).alias("m")).first().m) == {"id", "a.b.token", "req.headers.host"}
