"""Words found whatever white space is between them, against a regular expression."""

import re

from hypothesis import given, settings
from hypothesis import strategies as st

from causerie.sources.native import Spaced, find_words

TEXT = st.text(alphabet="ab \n\t\u00a0", max_size=30)


@settings(deadline=None, max_examples=400)
@given(TEXT, st.lists(st.text(alphabet="ab \n", max_size=5).filter(str.split), max_size=4))
def test_as_a_pattern(text, needles):
    spaced, at = Spaced(text), 0
    for needle in needles:
        want = re.compile(r"\s+".join(map(re.escape, needle.split()))).search(text, at)
        got = spaced.find(needle)
        assert got == (want and want.span())
        at = want.end() if want else at
        assert find_words(text, needle, at) == ((m := re.compile(r"\s+".join(map(re.escape, needle.split()))).search(text, at)) and m.span())
