"""Source divergences against plain Python, with many sources, shards and awkward rows."""

import collections
import random
import re

import numpy as np
import pytest

from quillmark.llm import divergence as dv

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def brute(rows, least=3, top=200):
    """rows: (lang, source, text)."""
    rows = [tuple(x or "" for x in r) for r in rows]
    docs, count = collections.defaultdict(collections.Counter), collections.defaultdict(collections.Counter)
    for lang, source, text in rows:
        found = TERM.findall(lower(text))
        docs[lang].update(set(found))
        count[lang, source].update(found)
    out = []
    for lang in {r[0] for r in rows}:
        kept = sorted(t for t, n in docs[lang].items() if n >= least)
        groups = {s: {t: c[t] for t in kept} for (la, s), c in count.items() if la == lang}
        share = lambda c, n: 1 + 10**9 * (c + 1) // (n + len(kept))
        p = {s: {t: share(c[t], sum(c.values())) for t in kept} for s, c in groups.items()}
        whole = {t: sum(c[t] for c in groups.values()) for t in kept}
        q = {t: share(whole[t], sum(whole.values())) for t in kept}
        f = lambda x, y: (x - y) ** 2 // y
        for s in groups:
            pairs = [("pair", o, sum(f(p[s][t], p[o][t]) for t in kept)) for o in groups if o != s]
            terms = [("term", t, f(p[s][t], q[t])) for t in kept if groups[s][t] and p[s][t] > q[t]]
            for found, most in ((pairs, len(pairs)), (terms, top)):
                found.sort(key=lambda r: (-r[2], r[1].encode()))
                out += [(lang, s, *r, k + 1) for k, r in enumerate(found[:most])]
    return out


def bag(df):
    return sorted(tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect())


@pytest.mark.parametrize(("shard_rows", "top", "sources"), [(400_000, 200, 5), (40, 3, 5), (25, 7, 40)])
def test_equals_brute_force(spark, shard_rows, top, sources):
    rng = random.Random(sources + shard_rows)
    words = [f"{a}{b}" for a in ("ab", "Ç", "漢", "x'y", "é-", "Q") for b in ("", "a", "B", "zz", "ñ")]
    rows = [(rng.choice(["en", "de", None, ""]), f"s{int(rng.paretovariate(0.7)) % sources}", " ".join(rng.choice(words[: 3 + i % 28]) for _ in range(rng.randint(0, 25)))) for i in range(400)]
    rows += [("xx", "alone", "one one one"), ("yy", "a", None), ("yy", "b", ""), ("yy", None, "\x00@[`{\x7f"), ("zz", "a", "once"), ("zz", "b", "twice twice")]
    docs = spark.createDataFrame(rows, "lang string, source string, text string").repartition(3)
    docs = docs.selectExpr("*", "1 AS n", "'t' AS term", "2 AS v", "3 AS shard", "4 AS value", "5 AS rank", "6 AS docs")
    assert bag(dv.source_divergences(docs, top=top, shard_rows=shard_rows)) == sorted(brute(rows, top=top))


def test_shares_of_huge_counts_do_not_overflow():
    counts, totals = np.array([0, 7, 10**13, 10**15]), np.array([3, 11, 10**13 + 9, 9 * 10**15])
    assert dv.share(counts, totals).tolist() == [1 + 10**9 * (int(c) + 1) // int(t) for c, t in zip(counts, totals, strict=True)]


def test_small_cells_change_nothing(monkeypatch):
    rng = np.random.default_rng(4)
    s, t = 9, 30
    at = np.flatnonzero(rng.random(s * t) < 0.4)
    term, who = np.divmod(at, s)
    n, total = rng.integers(1, 50, len(at)), rng.integers(900, 2000, s)
    counts = np.zeros((s, t), np.int64)
    counts[who, term] = n
    p = dv.share(counts, total[:, None])
    want = np.array([[int(((p[a] - p[b]) ** 2 // p[b]).sum()) for b in range(s)] for a in range(s)])
    for cells in (1 << 21, 20):
        monkeypatch.setattr(dv, "_CELLS", cells)
        got = np.vstack([block for _, block in dv.pair_sums(who, term, n, total, t)])
        assert np.array_equal(got, want)


def test_long_text_repeats_and_empty_tables(spark):
    text = "alpha Beta " * 60_000
    rows = [("en", "a", text), ("en", "a", text), ("en", "b", text + "gamma"), ("en", "b", "gamma gamma"), ("en", "b", "gamma")]
    docs = spark.createDataFrame(rows, "lang string, source string, text string")
    assert bag(dv.source_divergences(docs)) == sorted(brute(rows))
    assert dv.source_divergences(docs.limit(0)).count() == 0
