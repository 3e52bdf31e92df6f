import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm.words import Runs, windows, word_hashes

TEXTS = st.lists(st.text(alphabet="ab \t\n\x0b\x0c\r\x1cé ", max_size=30), max_size=6)


@settings(max_examples=200, deadline=None)
@given(TEXTS, st.integers(1, 4))
def test_equal_runs_have_equal_hashes_and_others_do_not(texts, size):
    words = [re.findall(rb"[^\x20\x09-\x0D]+", t.encode()) for t in texts]
    hashes, first, spans = word_hashes([t.encode() for t in texts])
    assert np.diff(first).tolist() == [len(w) for w in words] or not texts
    starts = windows(first, size)
    flat = [w for ws in words for w in ws]
    assert [w for a, b in spans.T for w in [(b" ".join(t.encode() for t in texts) + b" ")[a:b]]] == flat
    expected = [tuple(ws[k : k + size]) for ws in words for k in range(len(ws) - size + 1)]
    got = Runs(hashes).of(starts, starts + size).tolist()
    assert len(got) == len(expected)
    assert len(set(zip(got, expected))) == len(set(got)) == len(set(expected))
