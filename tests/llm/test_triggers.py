"""The search for residue leaves no phrase out before it is tried."""

import itertools
import re
from re import _constants as K
from re import _parser

import pytest

from seriesloom.llm import residue

MOST = 3000


def _of(items):
    """Texts of a set of characters: one of them."""
    if items[0][0] is K.NEGATE:
        return [" "]
    for op, x in items:
        if op is K.LITERAL:
            return [chr(x)]
        if op is K.RANGE:
            return [chr(x[0])]
        return ["1" if x is K.CATEGORY_DIGIT else "k" if x is K.CATEGORY_WORD else ":" if x is K.CATEGORY_NOT_WORD else " "]
    return ["k"]


def texts(p):
    """Texts that a parsed pattern may match: each alternative, with repeats at their fewest and once more."""
    parts = []
    for op, x in p:
        if op is K.LITERAL:
            one = [chr(x)]
        elif op in (K.NOT_LITERAL, K.ANY):
            one = [" "]
        elif op is K.IN:
            one = list(dict.fromkeys(y for i in (range(len(x)) if all(o is K.LITERAL for o, _ in x) else [0]) for y in _of(x[i:])))
        elif op is K.BRANCH:
            one = [t for b in x[1] for t in texts(b)]
        elif op is K.SUBPATTERN:
            one = texts(x[3])
        elif op in (K.MAX_REPEAT, K.MIN_REPEAT):
            few, many, inner = x
            one = [t * n for n in range(few, min(many, few + 1) + 1) for t in (texts(inner) if n else [""])]
        else:
            one = [""]
        parts.append(list(dict.fromkeys(one)))
    return ["".join(t) for t in itertools.islice(itertools.product(*parts), MOST)]


@pytest.mark.parametrize("rule", [*residue.ERRORS, residue.ALONE, *residue.SCRIPTS, *residue.FILLERS])
def test_every_alternative_passes_the_prefilter(rule):
    found = [t for t in texts(_parser.parse(rule, re.I)) if re.search(rule, t, re.I)]
    assert found
    assert not [t for t in found if not residue.triggered([w for _, _, w in residue.tokens(t)])]


@pytest.mark.parametrize("text", ["Method Not Allowed (405)", "405 Method Not Allowed", "501 Not Implemented", "Your speech goes here", "Your speech here", "The speech you requested could not be displayed."])
def test_notices_without_a_common_word_are_seen(text):
    assert residue.spans(text)


def test_every_field_word_passes_the_prefilter():
    for t in texts(_parser.parse(residue.FIELD, re.I)):
        assert residue.triggered([w for _, _, w in residue.tokens(t)]), t
