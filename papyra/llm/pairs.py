"""Problem 3: prompt and response pairs that are useless as examples, and what is wrong with each.

Responses are sorted by text, so that a shortened version of another response stands right before it;
lengths at which a model's answers pile up are its limits. Either flags an answer that ends without a
mark as cut, before anything else is asked; the truncation judge decides the rest. Copies, refusals
and wrong languages are found by rules on each pair.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from papyra.llm import langmodel, truncation
from papyra.llm.langs import CODES, LANGUAGES
from papyra.session import cut_lineage

#: Responses shorter than this prove nothing by being the beginning of another.
LEAST_PREFIX = 24
#: How far, in nats, another language must lead the expected one.
MARGIN = 8.0

#: First-person refusals. English ones are patterns, others the usual openings.
REFUSALS = re.compile(
    "|".join((
        r"\bI(?:['’]m| am)? (?:\w+ ){0,3}?(?:cannot|can['’]?t|can not|won['’]t|unable to|not able to|decline|must decline|have to decline|refuse|not permitted|not allowed|not comfortable|decided not to|have decided not)\b",
        r"\bI(?:['’]d| would) rather not\b", r"\bI do not (?:work|deal|engage) with\b", r"\bI (?:am|['’]m) permitted to\b",
        r"\bthe assistant (?:is not|cannot|can['’]t|won['’]t|is unable|declines|refuses)\b",
        r"\binstructions I follow do not allow\b", r"\bagainst (?:my|our) (?:guidelines|polic|principles|rules)", r"^\W*request (?:denied|declined|refused)\b", r"\bas an AI\b",
        r"tut mir (?:sehr )?leid", r"(?:kann|darf|möchte|werde) ich (?:\w+ ){0,4}?nicht\b", r"ich (?:kann|darf|möchte|werde) (?:\w+ ){0,5}?nicht\b",
        r"je (?:ne )?(?:peux|suis en mesure|souhaite)\b.{0,20}\bpas\b", r"je suis (?:vraiment )?désolée?", r"il m[’']est impossible", r"je refuse\b",
        r"lo siento", r"no (?:puedo|me es posible|estoy en condiciones)\b", r"desculpe|lamento,? mas", r"não (?:posso|me é possível|consigo)\b",
        r"mi dispiace", r"non (?:posso|mi è possibile|sono in grado)\b", r"het spijt me", r"(?:kan|mag|wil) ik (?:\w+ ){0,4}?niet\b", r"ik (?:kan|mag|wil) (?:\w+ ){0,4}?niet\b",
        r"przykro mi|przepraszam", r"nie (?:mogę|jestem w stanie)\b", r"извините|к сожалению", r"(?:я )?не (?:могу|имею права|буду)\b",
        r"申し訳(?:ありません|ございません)|対応できません|お手伝いできません|お断り", r"抱歉|对不起|我(?:无法|不能|不会)|恕", r"죄송|도와드릴 수 없|처리할 수 없|응할 수 없",
    )),
    re.I,
)
#: Every pattern above holds one of these, which are quicker to look for.
_CORES = (
    "not ", "cannot", "can not", "cant", "is not", "n't", "n’t", "unable", "declin", "refus", "denied", "allow", "permitted", "against", "as an ai", "rather", "decided", "leid", "nicht", "pas", "désol", "impossible", "siento", "no puedo", "no me",
    "no estoy", "desculp", "não", "lamento", "dispiace", "non ", "spijt", "niet", "przykro", "przepraszam", "nie ", "извин", "сожал", "не ", "申し", "できません", "断り", "抱歉", "对不起", "无法", "不能", "不会", "恕", "죄송", "수 없",
)
#: A sentence that only reports what somebody else says.
REPORTED = re.compile(r"\b(?:sender|letter|author|writer|customer|office|council|company|note|memo|mail|message|committee|speaker)\b[^.]{0,60}\b(?:writes?|says?|said|wrote|reads?|states?|apologi[sz]es?)\b|\b(?:writes|says)\b", re.I)
#: Errors that say the provider declined on policy grounds.
POLICY_ERROR = r"(?i)policy|moderation|safety|declined|refused \(|content.?filter|guideline|blocked:"

_INSTRUCTION_END = re.compile(r"\n\s*(?:\n|---|<\w+>|```|===)")
_DENSE = re.compile("[぀-\U0010ffff]")
_FIRST = re.compile(r"(?<=[.!?。！？])\s+|\n+")
_ASKED = {
    **{name: code for code, (_, _, names) in LANGUAGES.items() for name in names},
    "auf englisch": "eng", "auf deutsch": "deu", "en anglais": "eng", "en inglés": "eng", "em inglês": "eng", "in inglese": "eng", "in het engels": "eng",
    "po angielsku": "eng", "на английском": "eng", "по-английски": "eng", "英語": "eng", "英文": "eng", "영어": "eng",
}
_ASKED_RE = re.compile(r"\b(" + "|".join(sorted(map(re.escape, _ASKED), key=len, reverse=True)) + r")\b", re.I)
_MARKUP = re.compile(r"^\s*(?:#{1,6}\s.*\n+|```\w*\n|>\s*)")


def instruction_of(prompt: str) -> tuple[str, str]:
    """(instruction, page): the prompt up to the first separator, and what comes after it."""
    m = _INSTRUCTION_END.search(prompt)
    return (prompt[: m.start()].strip(), prompt[m.end() :].strip()) if m else (prompt.strip(), "")


def _plain(s: str) -> str:
    return re.sub(r"[\W_]+", " ", s.lower()).strip()


def refused(output: str, prompt: str | None) -> bool:
    """Whether the first sentences decline the task in the model's own voice, not in words of the page."""
    body = _MARKUP.sub("", output).strip()
    at = seen = 0
    while seen < 2:
        m = _FIRST.search(body, at)
        s = body[at : m.start() if m else len(body)].strip()
        low = s.lower()
        seen += bool(s)
        if s and any(k in low for k in _CORES) and REFUSALS.search(s) and not REPORTED.search(s) and not (prompt and s[:60] in prompt):
            return True
        if m is None:
            break
        at = m.end()
    return False


def copied(output: str, prompt: str | None) -> bool:
    """Whether the output gives the instruction back (wherever it stands among the page's words)."""
    if not prompt:
        return False
    instruction = _plain(instruction_of(prompt)[0])
    # its first word alone rules most outputs out
    return len(instruction) >= 8 and instruction.split(" ", 1)[0] in output.lower() and instruction in _plain(output)


def asked_language(instruction: str) -> str | None:
    m = _ASKED_RE.search(instruction)
    return _ASKED[m.group(1).lower()] if m else None


def _prose(output: str) -> str | None:
    """The output as running text, or None for short labels, JSON and tables."""
    body = re.sub(r"^\s*```\w*\n|\n```\s*$", "", output).strip()
    if body[:1] in ("{", "[", "|") or "\n|" in body and body.count("|") > 6:
        return None
    dense = 0 if body.isascii() else len(_DENSE.findall(body))
    return body if dense >= 10 or len(body) - dense > 28 and len(body.split()) > 4 else None


def wrong_language(output: str, prompt: str | None, model: langmodel.LanguageModel) -> bool:
    """Whether a text is not in the language asked for or, where none is asked for, in one of the page's."""
    if not prompt:
        return False
    body = _prose(output)
    if body is None:
        return False
    instruction, page = instruction_of(prompt)
    asked = asked_language(instruction)
    if asked is None:
        if not page:
            return False
        if len(body) > 150 and sum(body[k : k + 40] in page for k in (20, len(body) // 2, len(body) - 60)) > 1:
            return False
        out_words = set(langmodel.words(body))
        if out_words and len(out_words & set(langmodel.words(page))) >= 0.6 * len(out_words):
            return False  # it is made of the page's own words
    v = model.totals(body)
    best = int(np.argmax(v))
    if asked is None:
        expected = [int(np.argmax(model.totals(page)))]
        if best not in expected:
            expected = [CODES.index(k) for k, share, _ in model.shares(page) if share >= 0.2] or expected
    else:
        expected = [CODES.index(asked)]
    return best not in expected and v[best] - max(v[k] for k in expected) > MARGIN


def shortened(entries: DataFrame, least: int = LEAST_PREFIX) -> DataFrame:
    """id of every entry whose answer is a shortened version of another one (continued_answers)."""
    return entries.select("id", F.xxhash64(F.rtrim("output")).alias("h")).join(continued_answers(entries, least), "h", "left_semi").select("id")


def continued_answers(entries: DataFrame, least: int = LEAST_PREFIX) -> DataFrame:
    """h of every answer that another answer goes on from in the same line, where it ends without an end mark.

    h is the xxhash64 of the answer without white space at its end. Answers are range-partitioned and
    sorted by their text; one that others continue is continued by its successor. Copies are told apart by
    a salt, so that a frequent answer may span partitions: the last of its copies has the successor. Each
    partition also gives up its first and last text, so that pairs across borders are compared too; those
    are two rows for each partition.
    """
    texts = entries.where(F.length("output") >= least).select(F.rtrim("output").alias("t"), F.xxhash64("id").alias("salt")).withColumn("h", F.xxhash64("t"))
    ordered = texts.repartitionByRange("t", "salt").sortWithinPartitions("t").select("t", "h", F.spark_partition_id().alias("p"))

    def neighbours(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, first, p = None, None, -1
        for b in batches:
            found = []
            for t, h in zip(b["t"], b["h"]):
                if last is not None and h != last[1] and t.startswith(last[0]) and goes_on(last[0], t):
                    found.append(last)
                last = (t, h)
                first = last if first is None else first
            p = int(b["p"].iloc[0]) if len(b) else p
            yield pd.DataFrame([(None, h, p, "continued") for _, h in found], columns=["t", "h", "p", "role"])
        if last is not None:
            yield pd.DataFrame([(*first, p, "first"), (*last, p, "last")], columns=["t", "h", "p", "role"])

    marked = cut_lineage(ordered.mapInPandas(neighbours, "t string, h long, p int, role string"))
    # The next partition's first text continues a partition's last text, or no text does. One window
    # over two rows for each partition.
    after = Window.orderBy("p", F.col("role") == "last")
    within = F.expr("startswith(next, t) and length(next) > length(t)") & ~F.col("t").rlike(_ENDED) & ~F.expr("startswith(substring(next, length(t) + 1), '\n')")
    border = marked.where("role <> 'continued'").withColumn("next", F.lead("t").over(after)).where("role = 'last'").where(within).select("h")
    return marked.where("role = 'continued'").select("h").unionByName(border).distinct()


#: An answer that ends so is whole, whatever others say after it.
_ENDED = "[.!?。！？:][\\p{Punct}\"”’»）」』]*$"
_ENDED_RE = re.compile(r"[.!?。！？:][!-/:-@\[-`{-~”’»）」』]*$")


def goes_on(shorter: str, longer: str) -> bool:
    """Whether longer, which begins with shorter, goes on within the sentence that shorter leaves open."""
    return len(longer) > len(shorter) and longer[len(shorter)] != "\n" and not _ENDED_RE.search(shorter)


def find_defects(journal: DataFrame, labelled: DataFrame, text: str = "text_sample", label: str = "language", keys: tuple[str, ...] = ("doc_id", "page_index")) -> DataFrame:
    """id, defect: one row for each entry and defect (empty, truncated, refusal, copy, wrong_language).

    labelled fits the language model. Rows without id are left out; a redelivered entry is one
    case. A null prompt is no defect and allows neither copy nor wrong_language; an empty output is
    refusal instead of empty where the error says that the provider declined on policy grounds.
    Empty, refused and copied outputs have no further defect.
    """
    entries = truncation.entries_of(journal)
    shared = journal.sparkSession.sparkContext.broadcast(langmodel.fit(labelled, text, label, list(keys)))
    declined = F.coalesce(F.col("error").rlike(POLICY_ERROR), F.lit(False))

    def defect(prompt: str | None, output: str | None, no: bool, model: langmodel.LanguageModel) -> str | None:
        if not truncation.visible(output):
            return "refusal" if no else "empty"
        if refused(output, prompt):
            return "refusal"
        if copied(output, prompt):
            return "copy"
        return "wrong_language" if wrong_language(output, prompt, model) else None

    def rules(b: truncation.Batch) -> list[str | None]:
        return [defect(p, o, no, shared.value) for p, o, no in zip(b["prompt"], b["output"], b["declined"])]

    # one pass over the texts gives the rules' findings, the tails and the counts that the judge needs
    raw = truncation.read_texts(entries.withColumn("declined", declined), False, rules)
    flagged = raw.where("kind = 't' and defect is not null").select("id", "defect")
    cut = truncation.judge_tails(entries, continued_answers(journal), raw=raw).where("truncated").select("id")
    useless = flagged.where("defect <> 'wrong_language'").select("id")
    return flagged.unionByName(cut.join(useless, "id", "left_anti").select("id", F.lit("truncated").alias("defect")))
