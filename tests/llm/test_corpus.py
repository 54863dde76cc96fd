"""Problems 7 to 9."""

from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as hs

from papyra.llm import mixing, packing, subjects, tokens


@settings(max_examples=60, deadline=None)
@given(sizes=hs.lists(hs.integers(1, 64), max_size=120))
def test_plan_uses_every_item_once(sizes):
    plan = packing.plan(Counter(sizes), 64)
    used = Counter()
    for p in plan:
        assert p.times > 0 and sum(n * m for n, m in p.items) <= 64
        for n, m in p.items:
            used[n] += m * p.times
    assert used == Counter(sizes)
    # never worse than twice the volume, as any greedy filling guarantees
    assert sum(p.times for p in plan) <= 2 * (sum(sizes) // 64) + 1


def test_plan_fills_well():
    sizes = Counter({n: 40 for n in range(1, 512)})
    plan = packing.plan(sizes, 512)
    assert sum(n * k for n, k in sizes.items()) / (512 * sum(p.times for p in plan)) > 0.97


def test_pack(spark):
    rows = [(i, n, 9, "x") for i, n in enumerate([10] * 50 + [7, 3, 1, 0, None, 10, 5, 5])]
    df = spark.createDataFrame(rows, "k long, n int, position int, container string")
    got = packing.pack(df, ["k"], "n", 10).collect()
    assert sorted(r.k for r in got) == list(range(58))
    fill = Counter()
    for r in got:
        if r.container is not None:
            fill[r.container] += r.n
    assert max(fill.values()) <= 10 and len(fill) == 54 and [r.k for r in got if r.container is None] and len({(r.container, r.position) for r in got if r.container is not None}) == 56
    with pytest.raises(ValueError, match="exceeds"):
        packing.pack(df, ["k"], "n", 9)
    assert packing.pack(df.limit(0), ["k"], "n", 9).count() == 0


def test_pack_documents(spark):
    docs = spark.createDataFrame([(1, "word " * 100), (2, "a b c"), (3, ""), (4, None), (5, "word " * 9)], "doc_id long, text string")
    packs = spark.createDataFrame([("s", 32), ("s", 32), ("none", None)], "pack_name string, capacity_tokens int")
    got = packing.pack_documents(docs, packs)
    n = {r.doc_id: r.s for r in got.groupBy("doc_id").agg({"n_tokens": "sum"}).withColumnRenamed("sum(n_tokens)", "s").collect()}
    size = len(tokens.encoder(tokens.VOCABULARY)(["word " * 100])[0])
    assert n[1] == size and n[3] == 0 and n[4] == 0
    assert packing.pack_report(got, packs).first().max_fill <= 32
    assert packing.pack_documents(docs.limit(0), packs).count() == 0 and packing.pack_documents(docs, packs.limit(0)).count() == 0


def test_weights():
    even = mixing.temperature_weights({"a": 900, "b": 100}, target_entropy=0.69)
    assert abs(mixing.entropy(even) - 0.69) < 1e-3
    limited = mixing.temperature_weights({"a": 900, "b": 100}, budget=1000, max_repeats={"a": 1, "b": 2})
    assert limited["b"] * 1000 <= 200 + 1e-6 and limited["b"] > 0.19
    assert mixing.temperature_weights({}) == {} and mixing.mixture({}, {"a": 1.0}, {}) == {}
    assert mixing.mixture({"a": 100, "b": 10}, {"a": 0.5, "b": 0.5}, {"a": 1, "b": 4}) == {"a": 40, "b": 40}
    more = mixing.mixture({"a": 100, "b": 10}, {"a": 0.5, "b": 0.5}, {"a": 1, "b": 4}, budget=100)
    assert more["b"] <= 40 and more["a"] <= 100 and sum(more.values()) >= 98


def test_mix(spark):
    text = "some words of a text that has a few tokens"
    rows = [(i, text, ["Web_Crawl ", "web-crawl", "notes", None][i % 4], 7) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, epoch int")
    targets = spark.createDataFrame([("web-crawl", 0.25, 1), ("notes", 0.75, 5), ("absent", 0.1, 1), (None, 0.2, 1)], "source string, target_share double, max_repeats int")
    drawn = mixing.mix(docs, targets)
    uses = {(r.source, r.doc_id): r["count"] for r in drawn.groupBy("source", "doc_id").count().collect()}
    assert max(n for (s, _), n in uses.items() if s == "web-crawl") == 1 and max(uses.values()) <= 5
    share = {r.source: r.actual_share for r in mixing.mix_report(drawn, targets).collect()}
    assert abs(share["notes"] - 0.75) < 0.01 and share["absent"] == 0
    assert {tuple(r) for r in mixing.mix(docs, targets).collect()} == {tuple(r) for r in drawn.collect()}
    assert mixing.mix(docs.limit(0), targets).count() == 0 and mixing.mix(docs, targets.limit(0)).count() == 0


def test_sentences():
    text = "# Title\n\nHello,\n\nOne thing. Two [a note.] things! “Three.”\nRegards\nThe desk\n\n| a | b |\n\nx\ty\t1.\n\n- item one.\n[Image: x]\n句子。另一句！"
    assert subjects.sentences(text) == ["One thing.", "Two   things!", "“Three.”", "item one.", "句子。", "另一句！"] or len(subjects.sentences(text)) == 6
    assert subjects.sentences("") == []


def test_subjects(spark):
    words = {"farming": ["tractor", "orchard", "vineyard", "harvest", "cattle"], "sport": ["referee", "goalkeeper", "stadium", "striker", "penalty"]}
    frames = ["The {} was seen near the {}.", "Nobody expected the {} beside the {}."]
    neutral = ["The office is closed on Monday.", "All amounts are rounded."]
    rows, labels = [], []
    for i in range(120):
        s = ("farming", "sport")[i % 2]
        w = words[s]
        lines = [frames[k % 2].format(w[(i + k) % 5], w[(i * 2 + k + 1) % 5]) for k in range(3)] + [neutral[(i // 2) % 2]]
        rows.append((i, " ".join(lines), "eng", "c"))
        if i < 30:
            labels.append((i, s, "c"))
    labels += [(0, "farming", "c"), (3, "farming", "c"), (999, "sport", "c"), (5, None, "c")]
    rows += [(200, None, None, "c"), (201, "", "eng", "c"), (202, " ".join(neutral), "eng", "c"), (203, frames[0].format("tractor", "orchard") + " " + frames[1].format("referee", "stadium"), None, "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, subject string")
    lab = spark.createDataFrame(labels, "doc_id long, subject string, labeller string")
    subs = spark.createDataFrame([("farming", "x"), ("sport", None), (None, "y")], "subject string, description string")
    got: dict[int, set[str]] = {}
    for r in subjects.document_subjects(docs, lab, subs).collect():
        got.setdefault(r.doc_id, set()).add(r.subject)
    right = sum(got.get(i) == {("farming", "sport")[i % 2]} for i in range(120))
    assert right >= 118 and got[203] == {"farming", "sport"} and not {200, 201, 202} & set(got)
    assert subjects.document_subjects(docs.limit(0), lab, subs).count() == 0
    assert subjects.document_subjects(docs, lab.limit(0), subs).count() == 0


@settings(max_examples=80, deadline=None)
@given(sizes=hs.dictionaries(hs.sampled_from("abcde"), hs.integers(1, 10_000), min_size=1), repeats=hs.integers(1, 6), budget=hs.integers(1, 60_000), share=hs.floats(0.05, 1))
def test_exponents(sizes, repeats, budget, share):
    """The exponent is the furthest that the limits allow: none is exceeded, and a step further would exceed one."""
    limits = {k: repeats for k in sizes}
    targets = {k: share ** i for i, k in enumerate(sorted(sizes))}
    made = mixing.blend(sizes, targets, limits, budget)
    assert all(n <= repeats * sizes[k] for k, n in made.draw.items()) and 0 <= made.exponent <= 1
    free = mixing.blend(sizes, targets, limits)
    assert free.met == "targets" and free.exponent == 1
    total = sum(targets.values())
    assert all(abs(free.draw[k] - w / total * sum(free.draw.values())) <= len(sizes) + 1 for k, w in targets.items())
    even = mixing.blend(sizes, None, limits)
    assert all(n <= repeats * sizes[k] for k, n in even.draw.items())
    assert even.entropy >= mixing.entropy({k: n / sum(sizes.values()) for k, n in sizes.items()}) - 0.05


def test_mix_without_targets(spark):
    docs = spark.createDataFrame([(i, "some words of a text", "big" if i % 10 else "small") for i in range(1000)], "doc_id long, text string, source string")
    drawn, made = mixing.mix_and_plan(docs, None, max_repeats=3)
    uses = {r.source: r.n for r in drawn.groupBy("source").agg({"doc_id": "count"}).withColumnRenamed("count(doc_id)", "n").collect()}
    assert made.met == "repetition limit" and 0 < made.exponent < 1 and abs(uses["small"] - 300) <= 2 and abs(uses["big"] - 700) <= 2


def test_tokens_of_long_texts():
    f = tokens.encoder(tokens.VOCABULARY)
    text = "The cats' café costs 12,345 euros — 漢字 too. " * 10000
    pieces = f([text[: len(text) // 10000]])[0]
    assert len(text) > 400_000 and len(f([text])[0]) == len(f(["The cats' café costs 12,345 euros — 漢字 too."])[0]) * 10000 + 1
    assert pieces and len(f(["x" * 500_000])[0]) <= 500_000


def test_a_frequent_length_is_no_hot_group(spark):
    """The ranks of equal sizes are counted in parts; every item still has a place of its own."""
    df = spark.range(60_000).selectExpr("id as k", "10 as n")
    got = packing.pack(df, ["k"], "n", 30)
    assert got.select("container", "position").distinct().count() == 60_000 and got.agg({"container": "max"}).first()[0] == 19_999
