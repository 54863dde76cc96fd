"""Problems 2 to 6 on small literal corpora."""

import pytest

from papyra.llm import encoding, langmodel, languages, ocr, pairs, truncation

SENTENCES = {
    "eng": ["The office is closed on Monday and nobody answers.", "The appendix lists all entries sorted by date.", "It’s the third draft of the plan."],
    "deu": ["Das Büro bleibt am Montag geschlossen und niemand antwortet.", "Die Übersicht im Anhang umfasst alle Einträge.", "Für Rückfragen steht das Sekretariat zur Verfügung."],
    "fra": ["Le bureau sera fermé lundi matin et personne ne répond.", "Le tableau en annexe compte toutes les lignes.", "D’autres précisions figurent au verso."],
    "rus": ["В понедельник контора закрыта и никто не отвечает.", "В приложении указано много строк.", "Секретарь ответит на все вопросы."],
    "jpn": ["月曜日は窓口を閉めます。", "付録の一覧には件が載っています。", "ご質問は事務室までお寄せください。"],
    "zho": ["办公室星期一不开放。", "附录的清单共有很多项。", "如有疑问，请与秘书处联系。"],
}
SCHEMA = "doc_id long, page_index int, text_sample string, language string, lang string"


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(i * 100 + k, 0, " ".join([s[(j + k) % 3] for j in range(3)]), label, "clash") for i, (label, s) in enumerate(SENTENCES.items()) for k in range(12)]
    return spark.createDataFrame(rows, SCHEMA)


def test_language_labels(spark, pages):
    extra = [
        (9001, 0, " ".join(SENTENCES["deu"]), "eng", "c"), (9002, 0, " ".join(SENTENCES["fra"]), None, "c"), (9003, 0, " ".join(SENTENCES["eng"] + SENTENCES["deu"]), "eng", "c"),
        (9004, 0, " ".join(SENTENCES["fra"]), "French", "c"), (9005, 0, "short", "xx", "c"), (9006, 0, None, None, "c"), (9007, 0, "", "", "c"), (9008, 0, "1234 5678 " * 20, None, "c"),
        (9009, 0, " ".join(SENTENCES["deu"]).encode().decode("cp1252"), "fra", "c"), (9002, 0, " ".join(SENTENCES["fra"]), None, "c"), (9010, 0, " ".join(SENTENCES["eng"] * 4000), "deu", "c"),
    ]
    both = pages.unionByName(spark.createDataFrame(extra, SCHEMA))
    got = {(r.doc_id, r.lang) for r in languages.find_mislabelled(both).collect()}
    assert got == {(9001, "deu"), (9002, "fra"), (9003, "eng"), (9003, "deu"), (9009, "deu"), (9010, "eng")}
    found = {r.doc_id: r for r in languages.page_languages(both).select("doc_id", "language_found.*").collect()}
    assert found[9006].lang is None and found[9007].segments == [] and found[9003].segments[0].start == 0
    assert 0 <= found[9001].confidence <= 1


def test_languages_of_nothing(spark):
    assert languages.find_mislabelled(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize(
    ("true", "wrong", "lang"),
    [("utf-8", "cp1252", "deu"), ("utf-8", "cp1251", "fra"), ("utf-8", "cp437", "deu"), ("utf-8", "mac_roman", "fra"), ("utf-8", "cp1253", "deu"), ("cp1252", "cp437", "deu"), ("cp1252", "mac_roman", "fra"), ("koi8_r", "cp1251", "rus"), ("cp866", "cp1251", "rus"), ("cp1251", "cp1252", "rus"), ("euc_jp", "cp1252", "jpn"), ("gb18030", "cp1252", "zho")],
)
def test_encoding_round_trip(judge, true, wrong, lang):
    text = SENTENCES[lang][0] + " " + SENTENCES[lang][2] if lang not in ("jpn", "zho") else "".join(SENTENCES[lang])
    try:
        broken = text.encode(true).decode(wrong)
    except UnicodeError:
        broken = "".join(bytes([b]).decode(wrong, "ignore") or chr(b) for b in text.encode(true, "ignore"))
    garbled, lost, fixed, route = encoding.repair(broken, judge)
    assert garbled and route and (fixed == text or fixed.replace("’", "") == text.replace("’", "") or sum(a == b for a, b in zip(fixed, text)) > 0.9 * len(text))


@pytest.fixture(scope="module")
def judge(pages):
    return encoding.fit_judge(pages, "text_sample")


def test_sound_text_stays(judge):
    for text in [*(s for x in SENTENCES.values() for s in x), "Ø 4 mm ± 0.2 – © Velmora", "«hasta luego»", "Why? Because.", "https://x.org/?a=b", "", None, "really??"]:
        assert encoding.repair(text, judge)[:3] == (False, False, text)
    assert encoding.repair("Das B�ro", judge)[:2] == (True, True)
    assert encoding.repair("F?r R?ckfragen steht das Sekretariat", judge)[1]
    twice = SENTENCES["deu"][2].encode().decode("cp1252").encode().decode("cp1252")
    assert encoding.repair(twice, judge)[2] == SENTENCES["deu"][2]


def test_garbled_records(spark, pages):
    runs = spark.createDataFrame([(1, 0, "espaÃ±ol"), (1, 0, "espaÃ±ol"), (1, 1, "español"), (1, 2, None), (1, 3, ""), (1, 4, "ÖÐÎÄ"), (1, 5, "en")], "doc_id long, run_index int, language string")
    got = encoding.find_garbled(pages, runs).collect()
    assert {(r.rec_table, r.rec_index, r.fixed) for r in got} == {("runs", 0, "español"), ("runs", 4, "中文")}
    assert encoding.find_garbled(pages.limit(0), runs.limit(0)).count() == 0


# --- truncation and pairs ----------------------------------------------------------------------

JOURNAL = "id string, experiment string, provider string, model string, prompt string, output string, finish_reason string, tokens struct<output:long>, error string, text string, ts string"


@pytest.mark.parametrize(
    ("output", "status"),
    [
        (None, "empty"), (" \n​", "empty"), ("```\n```", "empty"), ('{"a": [1, 2', "cut"), ('{"a": "x}"}', "whole"), ("```json\n{}\n```", "empty"), ('```json\n{"a": 1}\n', "cut"), ("| a | b |\n| --- | --- |\n| 1 | 2", "cut"),
        ("| a | b |\n| --- | --- |\n| 1 | 2 |", "whole"), ("Ends well.", "whole"), ("Ends with a comma,", "cut"), ("cut�", "cut"), ("see https://x.org/a", "whole"), ("no mark", "open"), ("“All is said,”", "cut"),
    ],
)
def test_tail(output, status):
    assert truncation.tail(output, None)[0] == status


def test_prompt_decides():
    page = "Copy.\n\nThe irrigation ditch was fenced off from the tractor after the first frost"
    assert truncation.tail("The irrigation ditch was fenced off from the trac", page)[:2] == ("cut", "word")
    assert truncation.tail("The irrigation ditch was fenced off from", page)[:2] == ("cut", "sentence")
    assert truncation.tail("The irrigation ditch was fenced off from the tractor after the first frost", page)[0] == "whole"


@pytest.fixture(scope="module")
def journal(spark):
    frame = ["According to the file, the {} was changed with the {}.", "Neither the {} nor the {} appears in the list."]
    names = ["tractor", "vineyard", "orchard", "beekeeper", "greenhouse", "harvester", "ploughing", "seedling"]
    rows = []
    for i in range(160):
        a, b = names[i % 8], names[(i * 3 + 1) % 8]
        rows.append((f"g{i}", "e", "P", "m", "Summarise the page in a few sentences.\n\n" + frame[i % 2].format(a, b), frame[(i + 1) % 2].format(b, a) + " " + frame[i % 2].format(a, b), "stop", (40,), None, "c", "c"))
    bad = {
        "cutword": "According to the file, the tractor was changed with the vine", "cutsentence": "According to the file, the tractor was", "nomark": "According to the file, the tractor was changed with the vineyard",
        "refused": "I'm sorry, but I can't help with that.", "reported": "I'm sorry to hear about the delay, the sender writes, and offers a date.", "copied": "Summarise the page in a few sentences.", "void": '""',
        "german": "Das Büro bleibt am Montag geschlossen und niemand antwortet. Die Übersicht im Anhang umfasst alle Einträge.", "label": "form",
    }
    rows += [(k, "e", "p", "m", "Summarise the page in a few sentences.\n\nNothing else was said about the greenhouse here.", v, None, None, None, "c", "c") for k, v in bad.items()]
    rows += [("policy", "e", "p", "m", "x", None, None, (0,), "request refused (policy category: privacy)", "c", "c"), ("late", "e", None, None, None, None, None, None, "timeout", "c", "c"), ("void", "e", "p", "m", "x", '""', None, None, None, "c", "c")]
    return spark.createDataFrame(rows, JOURNAL)


def test_truncated(spark, journal):
    judged = truncation.judge_tails(truncation.entries_of(journal))
    assert {r.id for r in judged.where("truncated").collect()} == {"cutword", "cutsentence"}
    assert judged.count() == judged.select("id").distinct().count() == journal.select("id").distinct().count()
    models = spark.createDataFrame([(0, "p", "model-1", ["m"])], "ordinal int, provider string, id string, aliases array<string>")
    rates = truncation.truncation_rates(journal, models).collect()
    assert sum(r.truncated for r in rates) == 2 and {r.model for r in rates} == {"model-1", None}


def test_defects(journal, pages):
    got = {(r.id, r.defect) for r in pairs.find_defects(journal, pages).collect()}
    assert got == {("cutword", "truncated"), ("cutsentence", "truncated"), ("refused", "refusal"), ("copied", "copy"), ("void", "empty"), ("policy", "refusal"), ("late", "empty"), ("german", "wrong_language")}


def test_empty_journal(spark, journal, pages):
    none = journal.limit(0)
    assert truncation.judge_tails(truncation.entries_of(none)).count() == 0 and pairs.find_defects(none, pages.limit(0)).count() == 0


def test_shortened_against_brute_force(spark):
    texts = ["a" * 30, "a" * 31, "b" * 30, "b" * 29 + "c", "c" * 40, "c" * 40, None, "short", "c" * 39]
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "id string, output string")
    want = {str(i) for i, t in enumerate(texts) if t and len(t) >= 24 and any(u and u != t and u.startswith(t) for u in texts)}
    assert {r.id for r in pairs.shortened(df).collect()} == want


# --- scanned pages -----------------------------------------------------------------------------


def test_ocr(spark):
    clean = ["The tractor was fenced off from the orchard after the first frost.", "Nobody revised the command-line plan in the reading-room today.", "All amounts are rounded, so differences remain."]
    body = [(i, p, f"THE HEADER\n\n{clean[(i + p) % 3]}\nGoing on with {clean[(i + p + 1) % 3]}\n- {p + 4} -") for i in range(1, 13) for p in range(3)]
    noisy = [
        (50, 0, "The tr4ctor stayed.\n\nNobody revised thc cornmand-line plan."), (51, 0, "All amounts are roun-\nded, so differences remain."), (52, 0, "The command-\nline plan was fenced off."), (53, 0, "The tractor was fencecl~ off."),
        (54, 0, None), (55, 0, ""), (56, 0, "Sum    1193\nTotal    44"), (57, 0, "plain text of one line."),
    ]
    schema = "doc_id long, page_index int, text string"
    pages = spark.createDataFrame(body + noisy + noisy[:2], schema).selectExpr("*", "'c' as noise_kind", "1 as part")
    docs = spark.createDataFrame([(90, "Draft copy\nThe tractor stayed.\n1/2\n\n---\n\nDraft copy\nThe orchard was fencecl off.\n2/2"), (91, None), (92, "")], "doc_id long, text string")
    got = {(r.doc_id, r.page_index, r.noise_kind) for r in ocr.find_noise(pages, docs).collect()}
    assert {(i, p, k) for i in range(1, 13) for p in range(3) for k in ("header", "page_number")} <= got
    rest = {x for x in got if x[0] >= 50}
    assert rest == {(50, 0, "misread"), (51, 0, "hyphen"), (53, 0, "misread"), (90, -1, "header"), (90, -1, "page_number"), (90, -1, "misread")}
    fixed = {(r.doc_id, r.part): r.repaired for r in ocr.repair_pages(pages, docs).collect()}
    assert fixed[51, 0] == "All amounts are rounded, so differences remain." and fixed[53, 0] == "The tractor was fenced off." and "command-line" in fixed[52, 0]
    assert fixed[90, 1] == "The orchard was fenced off." and fixed[1, 0].startswith("Nobody") and fixed[55, 0] == ""
    assert ocr.find_noise(pages.limit(0), docs.limit(0)).count() == 0


def test_language_model_without_data():
    m = langmodel._build({})
    assert m.spans("some text here.") and m.shares("") == [] and m.known("x") == 0


def test_neighbours_decide(spark):
    """An answer that another one goes on from within its sentence is cut, though nothing else says so."""
    page = "Sum it up.\n\nThe keeper counted goats. "
    plain = [("t%d" % i, "Nobody asked about the gate on day %d." % i) for i in range(20)]
    pair = [("short", "The keeper looked after the gate and the goats"), ("long", "The keeper looked after the gate and the goats of the whole valley.")]
    marked = [("done", "The keeper looked after the hens and fed them."), ("more", "The keeper looked after the hens and fed them. Then it rained.")]
    rows = [(k, "e", "p", "m", page, o, None, None, None, "c", "c") for k, o in plain + pair + marked]
    entries = truncation.entries_of(spark.createDataFrame(rows, JOURNAL))
    assert {r.id for r in pairs.shortened(entries).collect()} == {"short"}
    judged = {r.id: r.why for r in truncation.judge_tails(entries, pairs.continued_answers(entries)).where("truncated").collect()}
    assert judged == {"short": "continued"}


def test_length_limit_decides(spark):
    """Answers without an end mark are cut where a model's answers pile up, and only there."""
    rows = [(f"s{i}", "e", "p", "m", "x", f"Row {'abcdefghij'[i]} of the yard holds hens and ducks", None, (128,), None, "c", "c") for i in range(10)]
    rows += [(f"o{n}", "e", "p", "m", "x", f"Done with {n} things.", None, (n,), None, "c", "c") for n in range(100, 156)]
    judged = {r.id: r.why for r in truncation.judge_tails(truncation.entries_of(spark.createDataFrame(rows, JOURNAL))).where("truncated").collect()}
    assert judged == {f"s{i}": "length" for i in range(10)}


def test_hot_look_ups(spark):
    """A key that holds most look-ups is joined apart and gives the same rows."""
    from pyspark.sql import functions as F

    asks = spark.range(5000).select(F.col("id").cast("string").alias("id"), F.lit("word").alias("role"), F.when(F.col("id") < 3000, 7).otherwise(F.col("id")).alias("key"))
    facts = spark.range(4000).select(F.col("id").alias("key"), (F.col("id") * 2).alias("v1"), F.lit(0).alias("v2"), F.lit(0).alias("v3"))
    got = truncation.looked_up(asks, facts, 5000)
    assert got.count() == 4000 and {r.v1 for r in got.where("key = 7").collect()} == {14} and got.where("key = 7").count() == 3000


def test_long_keys(spark):
    """Words and lines of any length take part: nothing is cut before it is compared."""
    long_word = "x" * 60 + "ylophone"
    page = f"Sum it up.\n\nThe {long_word} stood there. The {long_word} was sold. "
    rows = [(f"g{i}", "e", "p", "m", page, f"Nothing new came up in week {i}.", "stop", None, None, "c", "c") for i in range(5)]
    rows += [("cut", "e", "p", "m", "Other.", "They sold the " + "x" * 60 + "ylo", None, None, None, "c", "c")]
    judged = {r.id: r.why for r in truncation.judge_tails(truncation.entries_of(spark.createDataFrame(rows, JOURNAL))).where("truncated").collect()}
    assert judged == {"cut": "word"}
    assert len(truncation.line_hashes("a, b")) == 3 and truncation.line_hashes("a, b")[-1] == truncation.hash64("a, b")


def test_hashes_are_sparks(spark):
    words = ["e", "ﬁ", "漢字", "misread"]
    df = spark.createDataFrame([(w,) for w in words], "w string").selectExpr("w", "xxhash64(w) as h").withColumn("a", ocr._anagram("w"))
    for r in df.collect():
        assert r.h == truncation.hash64(r.w) and r.a == ocr.anagram(r.w)
