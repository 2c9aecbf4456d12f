import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from nearfield.llm import words

TEXT = st.text(st.sampled_from("aAbB1 \t\n  .,_-éÉ日\x1c"), max_size=60)


def slow(text):
    """(word, token number) by string operations."""
    out = [(re.sub(r"[\W_]+", "", t.lower()), k) for k, t in enumerate((text or "").split())]
    return [(w, k) for w, k in out if w]


@settings(max_examples=300, deadline=None)
@given(TEXT, TEXT)
def test_ids_name_words(a, b):
    seen = {}
    for text in (a, b):
        ids, at = words.WordIds().of(text)
        want = slow(text)
        assert len(ids) == len(want)
        assert [k for _, k in want] == (list(range(len(ids))) if at is None else at.tolist())
        for (w, _), i in zip(want, ids.tolist()):
            assert seen.setdefault(w, i) == i
    assert len(set(seen.values())) == len(seen)
    assert [text[s:e] for text in (a,) for s, e in words.token_spans(text)] == a.split()


def test_long_texts_are_cut_between_words(monkeypatch):
    text = "one two, ... thrée " * 300
    whole, at = words.WordIds().of(text)
    monkeypatch.setattr(words, "_CUT", 50)
    cut, cut_at = words.WordIds().of(text)
    assert np.array_equal(whole, cut) and np.array_equal(at, cut_at)


def test_grams_are_of_runs():
    ids = np.array([1, 2, 3, 1, 2, 3], np.uint64)
    g = words.grams(ids, 3)
    assert len(g) == 4 and g[0] == g[3] and len(set(g.tolist())) == 3
    assert len(words.grams(ids, 7)) == 0 and len(words.grams(ids[:0], 2)) == 0
