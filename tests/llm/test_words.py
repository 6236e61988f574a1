import hashlib
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from quillmark.llm import words as X

WORD = re.compile(r"[^\x20\x09-\x0D]+")
texts = st.text(alphabet=st.sampled_from("ab AB\n\t\r\x0b\x0c é ß.,"), max_size=200)


@given(texts)
@settings(max_examples=200, deadline=None)
def test_words_are_the_pattern_s(t):
    raw = t.encode()
    h, s, e = X.word_hashes(np.frombuffer(raw, np.uint8))
    found = [raw[a:b].decode() for a, b in zip(s, e, strict=True)]
    assert found == WORD.findall(t)
    for i in range(len(found)):
        for j in range(i):
            assert (found[i] == found[j]) == (h[i] == h[j])


def test_windows_equal_only_for_equal_words(monkeypatch):
    monkeypatch.setattr(X, "_CHUNK", 64)
    rng = np.random.default_rng(0)
    raw = b" ".join(rng.choice([b"a", b"bb", b"ccc"], 700))
    h, _, _ = X.word_hashes(np.frombuffer(raw, np.uint8))
    w = raw.split()
    for k in (5, 8, 50):
        g = X.windows(h, k)
        seen = {}
        for i, x in enumerate(g.tolist()):
            key = tuple(w[i : i + k])
            assert seen.setdefault(x, key) == key
        assert len(set(g.tolist())) == len({tuple(w[i : i + k]) for i in range(len(w) - k + 1)})


def test_long_words_and_case(monkeypatch):
    monkeypatch.setattr(X, "_CHUNK", 100)
    raw = b"x" * 500 + b" Ab aB " + b"x" * 500
    h, _, _ = X.word_hashes(np.frombuffer(raw, np.uint8), lower=True)
    assert h[0] == h[3] and h[1] == h[2]
    assert hashlib.sha256(raw).hexdigest()
    assert len(X.shingles(h)) == 1 and not len(X.shingles(h[:0]))


def test_sliding_argmin_and_covered():
    x = np.array([3, 1, 1, 2, 0, 5], X.U64)
    assert X.sliding_argmin(x, 3).tolist() == [1, 1, 4, 4]
    assert X.covered(np.array([0, 1, 5]), 2, 6).tolist() == [True, True, True, False, False, True]
