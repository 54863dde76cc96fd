"""The pre-filter of refusals lets every pattern's matches through."""

import re
from re import _constants as sc
from re import _parser

import pytest

from papyra.llm import pairs


def spelt(pattern) -> list[str]:
    """Texts that a parsed pattern matches: every alternative and optional part, repeated parts as rarely as they may be."""
    texts = [""]
    for op, arg in pattern:
        if op is sc.LITERAL:
            own = [chr(arg)]
        elif op is sc.IN:
            own = [chr(v) for k, v in arg if k is sc.LITERAL] or ["x"]
        elif op is sc.BRANCH:
            own = [t for p in arg[1] for t in spelt(p)]
        elif op is sc.SUBPATTERN:
            own = spelt(arg[3])
        elif op in (sc.MAX_REPEAT, sc.MIN_REPEAT):
            least, most, p = arg
            own = ([""] if least == 0 else []) + (spelt(p) if most == 1 else [])
        else:
            assert op is sc.AT, op
            own = [""]
        texts = [t + x for t in texts for x in own]
    return texts


EVERY = sorted(set(spelt(_parser.parse(pairs.REFUSALS.pattern, re.I))))


@pytest.mark.parametrize("after", [".", ", sorry", " do it"])
def test_every_pattern_passes(after):
    texts = [t + after for t in EVERY if pairs.REFUSALS.search(t + after)]
    assert len(texts) > 90
    assert [t for t in texts if not pairs.refused(t, None)] == []


@pytest.mark.parametrize("output", ["I'm sorry, but I cannot.", "I cannot, as things stand.", "I cant help with that.", "I can not.", "Hello\n \nI can't do this.", "Hello.\n \n \nI cannot."])
def test_refused(output):
    assert pairs.refused(output, None)
