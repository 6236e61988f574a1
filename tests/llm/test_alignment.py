"""Two tokenizers aligned: words, chunks and the fragment monoid against whole texts, and the operator against brute force."""

import collections
import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillmark.llm import alignment as al
from quillmark.llm.queries import tokenizer_path

PATHS = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")
SIGNS = [*"abcXYZ  \n\t\r.,'\"0129éßñ漢字かなÀ ​　᠎́😀", "the ", "And ", "'s", "'ll", "\r\n", "  ", " <|endoftext|> ", "</s>", "<0x41>"]


@pytest.fixture(scope="module")
def tok():
    return al.loaded(*PATHS)


def _tokens(tok, text):
    return tok.a.encode(" " + text, add_special_tokens=False).ids, tok.b.encode(text)


def brute(rows, tok):
    """rows: (doc_id, text). The contract's rows, from whole texts."""
    out, counts, links = [], collections.Counter(), []
    for doc_id, text in rows:
        here, z = [], (doc_id, 0, 0, 0, 0, "")
        if text:
            a, b = _tokens(tok, text)
            ta, tb = [tok.a_bytes[i] for i in a], [tok.b_bytes[i] for i in b]
            if b"".join(ta) == (" " + text).encode() == b"".join(tb):
                ends, told, i, j = {int(e): k for k, e in enumerate(np.cumsum([len(x) for x in ta]))}, [], 0, 0
                for k, e in enumerate(np.cumsum([len(x) for x in tb]).tolist()):
                    if e in ends:
                        told.append(",".join(map(str, a[i : ends[e] + 1])) + "|" + ",".join(map(str, b[j : k + 1])))
                        here.append((a[ends[e]], b[k]))
                        i, j = ends[e] + 1, k + 1
                z = (doc_id, len(a), len(b), len(told), len(here), hashlib.sha256(";".join(told).encode()).hexdigest())
        out.append(z)
        links.append(here)
        counts.update(here)
    best = collections.Counter()
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    return [(*z[:5], sum(counts[p] == best[p[1]] for p in here), sum(counts[p] for p in here), z[5]) for z, here in zip(out, links, strict=True)]


def bag(rows):
    return sorted(tuple(r) for r in rows) if all(r[0] is not None for r in rows) else sorted(map(repr, map(tuple, rows)))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(SIGNS), max_size=40).map("".join))
def test_words_and_chunks_give_the_tokens_of_the_whole_text(text):
    tok = al.loaded(*PATHS)
    a, b = _tokens(tok, text)
    if text:
        ws = al.words(text)
        assert "".join(ws) == " " + text
        tok.look_up([ws])
        counts = sum(tok.words[w][0] for w in ws)
        assert (counts & 0xFFFFFFFF, counts >> 32) == (len(a), len(b))
    for chunk in (2, 5, 13):
        runs = [al.chunk_run(tok, *row) for row in al.chunks(text, tok, chunk)]
        assert all(same for _, same in runs)
        if text:
            assert [i for r, _ in runs for i in r.a.tolist()] == a and [i for r, _ in runs for i in r.b.tolist()] == b


def _stream(rng, n):
    ends = lambda: np.sort(rng.choice(np.arange(1, n), min(n - 1, rng.integers(1, n)), replace=False))
    a, b = np.append(ends(), n), np.append(ends(), n)
    return al.Run(rng.integers(0, 9, len(a)), a, rng.integers(0, 9, len(b)), b)


def _told(fragments):
    """Fragment and closed groups of fragments that are joined from left to right."""
    whole, out = al.Fragment(al.EMPTY), []
    for f, closed in fragments:
        whole, seam = al.compose(whole, f)
        out += [x for x in (seam.text, closed) if x]
    return whole, b";".join(out)


def test_fragments_are_a_monoid_however_the_streams_are_cut():
    rng = np.random.default_rng(1)
    for _ in range(300):
        run = _stream(rng, int(rng.integers(2, 60)))
        want, closed = al.fragment(run)
        i, j = np.sort(rng.integers(0, len(run.a) + 1, 3)), np.sort(rng.integers(0, len(run.b) + 1, 3))
        bounds = list(zip([0, *i], [*i, len(run.a)], [0, *j], [*j, len(run.b)], strict=True))
        parts = [al.fragment(al.Run(run.a[p:q], run.a_ends[p:q], run.b[r:s], run.b_ends[r:s])) for p, q, r, s in bounds]
        got, told = _told([(f, c.text) for f, c in parts])
        first = al.first_group(got).text
        assert first == al.first_group(want).text and got.head.a.tolist() == want.head.a.tolist() and not len(got.tail.a)
        assert told == closed.text
        (x, cx), (y, cy), (z, cz), (w, cw) = parts
        left, l1 = al.compose(x, y)
        right, r1 = al.compose(z, w)
        tree, seam = al.compose(left, right)
        assert b";".join(t for t in (cx.text, l1.text, cy.text, seam.text, cz.text, r1.text, cw.text) if t).count(b"|") == told.count(b"|")
        for one, other in zip((tree.head, tree.tail), (got.head, got.tail), strict=True):
            assert all(np.array_equal(p, q) for p, q in zip(one.parts(), other.parts(), strict=True))
        assert al.compose(x, al.Fragment(al.EMPTY))[0].head.a.tolist() == x.head.a.tolist()


def _rows():
    rng = random.Random(3)
    text = lambda n: " ".join("".join(rng.choice(["th", "er", "qu", "é", "9", "-", "漢", "ing"]) for _ in range(rng.randint(1, 5))) + rng.choice(["", ",", ".", "'s", "\n", "  "]) for _ in range(n))
    rows = [(i, text(rng.randint(1, 60))) for i in range(40)] + [(1, "same"), (1, "same"), (None, "same"), (90, None), (91, ""), (92, "a▁b"), (93, "   "), (94, "\n"), (95, "<|endoftext|> </s>")]
    long = "漢字," * 500 + "x" * 3000 + " end \r\n " + text(300)
    return [*rows, (100, long), (100, long), (None, long), (101, "é" * 2500 + "▁"), (102, text(900))]


@pytest.mark.parametrize(("chunk", "most"), [(al.CHUNK, 1 << 20), (700, 1 << 20), (300, 0)])
def test_equals_brute_force(spark, tok, chunk, most):
    rows = _rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS pair", "2 AS n", "'x' AS doc_key", "3 AS seq", "4 AS row", "5 AS copies")
    assert bag(al.align_tokenizers(docs, *PATHS, chunk=chunk, broadcast_bytes=most).collect()) == bag(brute(rows, tok))


def test_very_long_documents_and_empty_tables(spark, tok):
    rows = [(1, "word " * 30_000 + "end"), (2, "nospaceatall" * 9_000), (3, "short")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert bag(al.align_tokenizers(docs, *PATHS).collect()) == bag(brute(rows, tok))
    assert al.align_tokenizers(docs.limit(0), *PATHS).count() == 0
