"""Last lines vouch for an answer only as different, unlimited answers that mostly end there."""

import pytest
from test_text import JOURNAL

from papyra.llm import truncation

LINE = "Everyone agreed upon the zebra"
KNOWN = "The keeper saw a zebra. He liked the zebra very much. "


def journal(spark, answers):
    prompt = "Sum it up.\n\n" + KNOWN * 9
    rows = [(f"g{i}", "e", "p", "m", prompt, f"Nothing new came up in week {i}.", "stop", (20,), None, "c", "c") for i in range(20)]
    rows += [(k, "e", "p", "m", prompt, o, f, (20,), None, "c", "c") for k, o, f in answers]
    return spark.createDataFrame(rows, JOURNAL)


@pytest.mark.parametrize(
    ("answers", "cut"),
    [
        ([(f"c{i}", LINE, "stop") for i in range(4)], {"c0", "c1", "c2", "c3"}),
        ([("c0", LINE, "stop")] * 5, {"c0"}),
        ([(f"c{i}", f"Week {'abcd'[i]}.\n{LINE}", "length") for i in range(4)], {"c0", "c1", "c2", "c3"}),
        ([(f"c{i}", f"Week {'abcd'[i]}.\n{LINE}", "stop") for i in range(4)], set()),
        ([(f"c{i}", f"Week {'abcd'[i]}.\n{LINE}", "stop") for i in range(4)] + [(f"w{i}", f"Week {'efghi'[i]}.\n{LINE} plan, and went on.", "stop") for i in range(5)], {"c0", "c1", "c2", "c3"}),
    ],
    ids=["copies", "redelivered", "limited", "whole", "mostly longer"],
)
def test_last_lines(spark, answers, cut):
    judged = truncation.judge_tails(truncation.entries_of(journal(spark, answers)))
    assert {r.id for r in judged.where("truncated").collect()} == cut
    assert judged.count() == judged.select("id").distinct().count()
