"""Fingerprints against brute force: every column, on hundreds of rows."""

import hashlib
import random
import re
import unicodedata

from quillmark.llm import fingerprints


def _canon(t):
    if not t.isascii():
        t = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", t).casefold())
    return re.sub(r"[\s\x85]+", " ", t.lower() if t.isascii() else t).strip()


def _brute(rows):
    """Rows of (doc_id, text) with distinct ids: doc_id -> n_chars, edited text, next id."""
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    out = {}
    for (i, t), (j, u) in zip(order, order[1:] + order[:1], strict=True):
        t, u = t or "", u or ""
        half = len(t) // 2
        out[i] = (len(t), t[: len(t) - half] + u[:half], j)
    return out


def _check(spark, rows):
    frame = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS key", "1 AS did", "2 AS wide", "3 AS n_chars", "'c' AS canon")
    got = {r.doc_id: r for r in fingerprints.document_fingerprints(frame).collect()}
    want, text = _brute(rows), {i: t or "" for i, t in rows}
    assert len(got) == len(rows)
    prints = {}
    for i, (n, edited, j) in want.items():
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (n, hashlib.sha256(edited.encode()).hexdigest())
        for canon, fp in ((_canon(text[i]), r.fingerprint), (_canon(edited), r.edited_fingerprint)):
            assert prints.setdefault(canon, fp) == fp
        assert r.near_edited == float(_canon(text[i]) == _canon(edited)) and r.near_next == float(_canon(text[i]) == _canon(text[j]))
    assert len(set(prints.values())) == len(prints)


def test_every_column_on_many_rows(spark):
    rng = random.Random(4)
    sign = ["a", "B", "é", "É", " ", "  ", "\n", "\t", "ﬁ", "ß", "汉", "\U0001f600", "é", "x", "Y"]
    texts = ["".join(rng.choice(sign) for _ in range(rng.choice([0, 1, 2, 3, 7, 60]))) for _ in range(220)]
    ids = rng.sample(range(-500, 5000), 300)
    rows = [(i, rng.choice(texts)) for i in ids] + [(9000, None), (9001, ""), (9002, "long " * 200_000), (9003, "LONG " * 200_000), (None, "no id")]
    _check(spark, rows)


def test_small_tables(spark):
    _check(spark, [(5, "Alone here")])
    _check(spark, [(5, "ab"), (9, "AB")])
    assert fingerprints.document_fingerprints(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_different_texts_in_one_bucket_are_told_apart(spark):
    digests = spark.createDataFrame([("w", "s1", "v", "s3", True, "a"), ("w", "s1", "v", "s3", True, "b"), ("u", "s5", "u", "s5", False, None)], "wide string, sha string, ewide string, esha string, shared boolean, canon string")
    assert {r.wide for r in fingerprints._in_unlike(digests).collect()} == {"w"}
