import random
import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings, strategies as st

from ledgerloom.llm import _text as X

LETTERS = st.text(alphabet="aB1 .\n\t\x0b\x00é\xa0 𝄞", max_size=40)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), LETTERS), max_size=8), st.integers(1, 60))
def test_words_are_the_patterns(texts, size):
    column = pa.array(texts, pa.string())
    for separators, lower, pattern in ((X.SPACES, False, r"[^\x20\x09-\x0D]+"), (X.NOT_ALNUM, True, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")):
        got = []
        for _, _, raw, offsets in X.pieces(column, size):
            words = X.split(raw, offsets, separators, lower)
            first = words.first
            got += [[words.word(i).decode() for i in range(first[k], first[k + 1])] for k in range(len(words.counts))]
        fold = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t) if lower else t
        assert got == [re.findall(pattern, fold(t or "")) for t in texts]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=60), st.integers(1, 20))
def test_windows_and_minima(values, width):
    h = X.mix(np.array(values, np.uint64))
    got = X.windows(h, width)
    runs = [tuple(values[i : i + width]) for i in range(len(values) - width + 1)]
    assert len(got) == len(runs)
    assert len(set(got.tolist())) == len(set(runs))
    assert X.least_in_window(h, width).tolist() == [i + min(range(width), key=lambda j: (int(h[i + j]), j)) for i in range(len(runs))]


def test_hashes_do_not_depend_on_place():
    rng = random.Random(0)
    words = ["".join(rng.choices("abc", k=rng.randint(1, 30))) for _ in range(500)]
    text = " ".join(words).encode()
    one = X.split(np.frombuffer(text, np.uint8), np.array([0, len(text)])).hashes
    by_word = {}
    for w, h in zip(words, one.tolist(), strict=True):
        assert by_word.setdefault(w, h) == h
    assert len(set(by_word.values())) == len(by_word)
