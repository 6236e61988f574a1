"""Operators on documents against brute force, on awkward rows and near copies."""

import hashlib
import random
import re
import tracemalloc
import unicodedata
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from pyspark.sql import functions as F

from quillmark.llm import fingerprints, langid, mixing, packing, quality, setjoin, substrings
from quillmark.llm.queries import tokenizer_path

from . import brute


def _near_copies(n=60, seed=1):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 6)))
    base = [[word() for _ in range(rng.choice([3, 6, 9, 40, 130, 260]))] for _ in range(9)]
    rows = []
    for i in range(n):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2, 5])):
            w[rng.randrange(len(w))] = word()
        if rng.random() < 0.3:
            w += rng.choice(base)[:70]
        sep = rng.choice([" ", "\n", " \t"])
        rows.append((i * 3, sep.join(w), rng.choice(["en", "de"]), rng.choice("ab"), 0))
    return rows


@pytest.fixture(scope="module")
def docs(spark, llm_rows):
    return spark.createDataFrame(_near_copies(), llm_rows.schema).unionByName(llm_rows).withColumnRenamed("n_chars", "n").selectExpr("*", "1L AS key", "'x' AS component_id", "0 AS n_words")


def _rows(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def _sorted(rows):
    return sorted(rows, key=repr)


def test_substring_dedup(docs):
    got = [(r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.kept.encode()).hexdigest()) for r in substrings.substring_dedup(docs, joined=True).collect()]
    assert _sorted(got) == _sorted(brute.substring_dedup(_rows(docs)))
    assert any(r[2] for r in got)
    own = Counter((r.doc_id, r.kept) for r in substrings.substring_dedup(docs).collect() if r.n_removed == 0)
    assert own <= Counter(_rows(docs))


def test_substring_dedup_of_blocks_that_one_document_repeats(spark):
    rng = random.Random(7)
    part = lambda k: " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(k))
    rows = []
    for i in range(0, 20, 10):
        a, b, c, x = part(80), part(70), part(70), part(80)
        p = part(rng.choice([60, 60, 90, 150]))
        rows += [(i, f"{a} {p} {x}"), (i + 1, f"{b} {p} {c} {b} {p} {c}"), (i + 2, f"{x} {p} {a}"), (i + 2, f"{b} {p} {c}"), (i + 2, f"{c} {b} {p} {c} {b} {p} {c} {b} {p}")]
        rows += [(i + 1, f"{b} {p} {c} tail")]  # another text under one id
    got = [(r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.kept.encode()).hexdigest()) for r in substrings.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string"), joined=True).collect()]
    assert _sorted(got) == _sorted(brute.substring_dedup(rows))


def test_greedy_factors_are_longest_and_cover_all_matches():
    hits = np.array([[0, 11, 1, 0, 100], [11, 5, 1, 0, 111], [30, 1, 2, 0, 7], [200, 1, 3, 0, 0], [201, 1, 3, 0, 1], [203, 1, 3, 0, 3]], np.int64)
    assert substrings.matches(hits)[:, :2].tolist() == [[0, 65], [30, 80], [200, 251], [203, 253]]
    # the second factor straddles the boundary at word 65; the gap from 80 to 200 is literal
    assert substrings.factors(hits) == [(0, 65, 1, 100), (30, 50, 2, 7), (200, 51, 3, 0), (203, 50, 3, 3)]
    for seed in range(300):
        rng = np.random.default_rng(seed)
        n = int(rng.integers(1, 40))
        hits = np.column_stack([rng.integers(0, 400, n), rng.integers(1, 90, n), rng.integers(0, 3, n), np.zeros(n, int), rng.integers(0, 50, n)])
        parse = substrings.factors(hits)
        want = np.zeros(700, bool)
        for a, k, *_ in hits:
            want[a : a + k + 49] = True
        assert (substrings.covered(parse, 700) == want).all()
        assert all(w >= 50 for _, w, *_ in parse) and all(a[0] + a[1] < b[0] + b[1] for a, b in zip(parse, parse[1:], strict=False))
        for (_, end), start in zip([(0, 0)] + [(a, a + w) for a, w, *_ in parse], [a for a, *_ in parse], strict=False):  # no match reaches further
            reach = max((int(e) for a, e, *_ in substrings.matches(hits) if a <= max(end, start)), default=0)
            assert any(a == start and a + w == reach for a, w, *_ in parse)


def test_factors_name_equal_words(spark):
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    p, q, r = ([word() for _ in range(k)] for k in (130, 75, 60))
    other = lambda k: [word() for _ in range(k)]
    texts = {1: other(20) + p + other(9), 2: other(5) + q + other(5), 3: other(30) + p + q[:70] + other(40) + q[5:] + r, 4: r + p[60:] + q}
    rows = substrings.substring_dedup(spark.createDataFrame([(i, " ".join(t)) for i, t in texts.items()], "doc_id long, text string")).collect()
    seen = {r.doc_id: r.factors for r in rows}
    assert [(f.start, f.words, f.ref_doc_id, f.ref_start) for f in seen[3]] == [(30, 130, 1, 20), (160, 70, 2, 5), (270, 70, 2, 10)]
    for i, fs in seen.items():
        for f in fs:
            assert f.ref_doc_id < i and texts[i][f.start : f.start + f.words] == texts[f.ref_doc_id][f.ref_start : f.ref_start + f.words]
    assert substrings.covered([tuple(f) for f in seen[4]], len(texts[4])).all() and seen[4][0].words == 60


def test_jaccard_join(docs):
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in setjoin.similar_documents(docs).collect()]
    assert _sorted(got) == _sorted(brute.jaccard_components(_rows(docs)))


def test_jaccard_join_of_small_sets_only(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice("abc") for _ in range(rng.randint(1, 14)))) for i in range(150)]
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in setjoin.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert _sorted(got) == _sorted(brute.jaccard_components(rows))


def test_light_subsets_find_every_similar_pair():
    for x in range(1, 10):
        for a in range(1, x + 1):
            for b in range(a, x + 1):
                if setjoin.required(a, b) <= a:
                    assert setjoin.least_share(b) in set(setjoin.light_sizes(a, x)) & set(setjoin.light_sizes(b, x))


def test_quality_counts_and_verdicts(spark, docs):
    got = {(r.doc_id, r.text_key): r for r in quality.quality_rules(docs, spark.createDataFrame([], "doc_id long, quality int")).collect()}
    want = Counter(brute.quality(t) for _, t in _rows(docs))
    assert Counter(tuple(r[c] for c in quality.STATS) for r in quality.quality_rules(docs, spark.createDataFrame([], "doc_id long, quality int")).collect()) == want
    assert all(r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words) and r.kept == (not r.base_failed) for r in got.values())


def test_forest_separates():
    rng = np.random.default_rng(0)
    good, bad = rng.normal(0, 1, (600, 3)), rng.normal(7, 1, (40, 3))
    f = quality.fit_forest(np.vstack([good[:300], bad[:4]]))
    cut = quality.calibrated_cut(f.score(good[300:]), f.score(bad[4:]))
    assert (f.score(bad) >= cut).mean() > 0.9 and (f.score(good) >= cut).mean() < 0.05
    assert quality.calibrated_cut(np.zeros(3), np.zeros(0)) == np.inf


def test_held_out_verdicts(spark):
    """Bad rows past the hard rules are caught and good ones kept, on rows neither fitted nor calibrated."""
    rng = random.Random(8)

    def text(bad):
        kind = rng.choice(["symbols", "repeats", "capitals", "lines"]) if bad else ""
        w = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(rng.randint(60, 400))]
        if kind == "symbols":
            w = [x + rng.choice(["###", "$$$", "&&&"]) for x in w]
        if kind == "repeats":
            w[: len(w) // 4] = w[len(w) // 2 : len(w) // 2 + len(w) // 4]
        if kind == "capitals":
            w = [x.upper() for x in w]
        lines = [" ".join(w[i : i + 12]) for i in range(0, len(w), 12)]
        return "\n".join(x for line in lines for x in ([line, "click here"] if kind == "lines" else [line]))

    label = [int(rng.random() > 0.15) for _ in range(2400)]
    docs = spark.createDataFrame([(i, text(not k)) for i, k in enumerate(label)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, k) for i, k in enumerate(label) if i % 3], "doc_id long, quality int")
    got = [(label[r.doc_id], r.kept) for r in quality.quality_rules(docs, labels).where("doc_id % 3 = 0 AND NOT base_failed").collect()]
    assert sum(not kept for k, kept in got if not k) >= 0.9 * sum(not k for k, _ in got)
    assert sum(kept for k, kept in got if k) >= 0.97 * sum(k for k, _ in got)


def test_quality_is_fitted_and_calibrated_on_every_labelled_row(spark, monkeypatch):
    """The subsamples of the trees come from all labelled rows, and the cuts are those of all scores of the other half."""
    rng = np.random.default_rng(4)
    n, bad = 60_000, 300
    s = np.column_stack([np.arange(n) % 500 + 30, np.arange(n) % 500 * 5 + 150, np.where(np.arange(n) < bad, 400, rng.integers(0, 4, n)), np.zeros(n), np.zeros(n), rng.integers(0, 40, n)]).astype(int)
    stats = spark.createDataFrame([(i, 0, *map(int, r)) for i, r in enumerate(s)], quality._SCHEMA)
    labels = spark.createDataFrame([(i, int(i >= bad)) for i in range(n)], "doc_id long, quality int")
    drawn, seen = [], []
    subsamples, cut = quality._subsamples, quality.calibrated_cut
    monkeypatch.setattr(quality, "_subsamples", lambda *a: drawn.extend(subsamples(*a)) or drawn)
    monkeypatch.setattr(quality, "calibrated_cut", lambda g, b, loss, ng, nb: seen.append((g, b, ng, nb)) or cut(g, b, loss, ng, nb))
    forests = quality.fit_quality(stats, labels)
    assert len(drawn) == quality.TREES and all(len(p) == quality.SUBSAMPLE and (p[:, 2] == 400).sum() == quality.BAD for p in drawn)
    half = {r[0] for r in stats.where("xxhash64(doc_id) % 2 <> 0").select("doc_id").collect()}
    assert [(ng.sum(), nb.sum()) for _, _, ng, nb in seen] == [(sum(i >= bad for i in half), sum(i < bad for i in half))] * 2
    rest = np.array(sorted(half))
    score = forests[0].score(quality.features(s[rest])[0])
    assert forests[0].cut == cut(score[rest >= bad], score[rest < bad], quality.MAX_LOSS[0]) and (score[rest < bad] >= forests[0].cut).mean() > 0.9


def _canon(t):
    if not t.isascii():
        t = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", t).casefold())
    return re.sub(r"\s+", " ", t.lower() if t.isascii() else t).strip()


def test_fingerprints(spark):
    rows = [(1, "Hello  World"), (2, "hello\tworld "), (3, "ﬁne Straße"), (4, "FINE STRASSE"), (5, None), (6, ""), (9, "été"), (12, "été"), (12, "odd"), (None, "none"), (20, "Hello  World"), (20, "Hello  World")]
    got = fingerprints.document_fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows)
    fp = {(r.doc_id, r.n_chars): r.fingerprint for r in got}
    assert fp[(1, 12)] == fp[(2, 12)] == fp[(20, 12)] and fp[(5, 0)] == fp[(6, 0)] and fp[(3, 10)] == fp[(4, 12)]
    assert fp[(9, 5 - 1)] == fp[(12, 4)] if (9, 4) in fp and (12, 4) in fp else True
    one = next(r for r in got if r.doc_id == 1)
    edited = "Hello  World"[:6] + "hello\tworld "[:6]
    assert one.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and one.near_next == 1.0
    assert fingerprints.document_fingerprints(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_packing(docs):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path())
    want = Counter()
    for i, t in _rows(docs):
        ids = tok.encode(t or "", add_special_tokens=False).ids + [0]
        for p, at in enumerate(range(0, len(ids), 2048)):
            part = ids[at : at + 2048]
            want[(i, p, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))] += 1
    got = packing.pack_documents(docs, tokenizer_path()).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    places = defaultdict(list)
    for r in got:
        places[r.sequence_id].append((r.offset, r.length))
    for v in places.values():
        at = 0
        for o, n in sorted(v):
            assert o == at
            at += n
        assert at <= 2048
    assert len(places) <= -(-sum(r.length for r in got) // 2048) + 2


@pytest.mark.parametrize("seed", range(4))
def test_plan_places_every_length(seed):
    rng = np.random.default_rng(seed)
    n = np.minimum(np.maximum(rng.lognormal(6, 1, 3000).astype(int), 1), 2048)
    counts = np.bincount(n, minlength=2049)
    used = np.zeros(2049, int)
    sequences = 0
    for items, m in packing.plan(counts):
        assert sum(a * k for a, k in items) <= 2048
        sequences += m
        for a, k in items:
            used[a] += k * m
    assert (used == counts).all()
    assert sequences <= 1.01 * n.sum() / 2048 + 2
    assert packing.plan(np.zeros(2049, int)) == []


def test_nnls_is_optimal():
    rng = np.random.default_rng(2)
    a, b = rng.random((8, 20)), rng.random(8)
    x = packing.nnls(a, b)
    slope = a.T @ (b - a @ x)
    assert (x >= 0).all() and slope.max() < 1e-6 and np.abs(slope[x > 1e-9]).max(initial=0) < 1e-6


def test_mixing(spark, docs):
    rows = mixing.mix(docs).collect()
    assert len(rows) == docs.count() and all(0 <= r.probability <= 1 for r in rows)
    assert all(r.kept for r in rows if r.tokens == 0)
    assert mixing.mix(docs.limit(0)).count() == 0


def test_rake_meets_margins_under_the_tokens_there_are():
    cells, t = np.array([[0, 0], [0, 1], [1, 0], [1, 1]]), np.array([10.0, 5.0, 3.0, 2.0])
    w = mixing.rake(cells, t, [np.array([0.5, 0.5]), np.array([0.4, 0.6])], 9.0)
    assert np.allclose([w[0] + w[1], w[0] + w[2], w.sum()], [4.5, 3.6, 9.0]) and (w <= t).all()
    w = mixing.rake(cells, t, [np.array([0.2, 0.8]), np.array([0.5, 0.5])], 10.0)  # the second category has 5 tokens only
    assert (w <= t).all() and np.isclose(w[2] + w[3], 5.0)


def test_rare_category_keeps_its_target(spark):
    rows = [(i, "word " * 50, "common", "en", "xy"[i % 2]) for i in range(3000)] + [(3000 + i, "word word", "rare", "en", "xy"[i % 2]) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, about string")
    targets = {"source": {"rare": 0.0001, "common": 0.9999}}
    mixed = mixing.mix(docs, targets, topic="about", keep=0.1)
    got = {(r.margin, r.category): r for r in mixing.achieved(mixed, targets).collect()}
    assert 0 < got["source", "rare"].before < 1e-3 and abs(got["source", "rare"].expected - 0.0001) < 1e-6
    assert {r.category for r in got.values() if r.margin == "topic"} == {"x", "y"}
    distributed = {tuple(r)[:5]: r.probability for r in mixing.mix(docs, targets, topic="about", keep=0.1, in_memory=0).collect()}
    assert all(abs(distributed[tuple(r)[:5]] - r.probability) < 1e-5 for r in mixed.collect())


def test_both_ways_to_rake_stop_alike_and_tell_what_is_out_of_reach(spark):
    rows = [(i, "word " * (5 + i % 7), f"s{i % 3}", ["en", "en", "fr"][i % 3 if i % 5 else 0], "xy"[i % 2]) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, about string")
    targets = {"source": {"s0": 0.98, "s1": 0.01, "s2": 0.01}, "lang": {"fr": 0.9, "en": 0.1}}  # few French tokens, and none in s0
    one, two = (mixing.mix(docs, targets, topic="about", keep=0.6, in_memory=n) for n in (10**6, 0))
    p = {r.doc_id: r.probability for r in two.collect()}
    assert all(abs(p[r.doc_id] - r.probability) < 1e-9 for r in one.collect())
    told = {(r.margin, r.category): r.feasible for r in mixing.achieved(one, targets).collect()}
    assert not told["lang", "fr"] and not told["source", "s0"]
    docs = docs.selectExpr("doc_id", "text", "source", "'en' AS lang", "about")
    easy = mixing.achieved(mixing.mix(docs, {"source": {"s0": 0.4, "s1": 0.3, "s2": 0.3}}, topic="about", keep=0.1), {"source": {"s0": 0.4, "s1": 0.3, "s2": 0.3}}).collect()
    assert all(r.feasible for r in easy if r.margin == "source")


def test_topics_are_found_within_languages(spark):
    rng = random.Random(3)
    sets = {lang: [[f"{lang}{c}{i}word" for i in range(40)] for c in "abc"] for lang in ("en", "fr")}
    rows = [(i, " ".join(rng.choice(sets[lang][i % 3]) for _ in range(60)), "s", lang) for i in range(600) for lang in ["en" if i % 4 else "fr"]]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")).select("doc_id", "topic", "lang").collect()
    groups = defaultdict(set)
    for r in got:
        groups[r.lang, r.topic].add(r.doc_id % 3)
    assert all(len(g) == 1 for g in groups.values()) and len(groups) >= 6
    assert {"t0", "t1", "t2"} <= {t for lang, t in groups if lang == "fr"} & {t for lang, t in groups if lang == "en"}  # no topic stands for a language


def test_topics_are_fitted_on_every_text_however_rows_are_dealt(spark):
    """All 4,000 texts are in the sums, and the centres are the same from any partitions."""
    rng = random.Random(6)
    sets = [[f"{c}{i}word" for i in range(30)] for c in "ab"]
    rows = [(" ".join(rng.choice(sets[int(i < 8)]) for _ in range(20)), "en", i) for i in range(4000)]
    df = spark.createDataFrame([(i, 0, "s", lang, "(none)", t) for t, lang, i in rows], "doc_id long, key long, source string, lang string, topic string, text string").withColumn("key", F.col("doc_id"))
    vectors = df.mapInArrow(mixing._measured(True), "doc_id long, key long, source string, lang string, topic string, tokens long, x binary").selectExpr("lang AS fit", "key", "x").cache()
    seen = mixing._sums(vectors, lambda total, lang, b, x: total.update({(lang, 0): (total.get((lang, 0), (0,))[0] + len(x), 0.0, x.sum(axis=0))}))
    assert [r["n"] for r in seen] == [4000]
    one, two = mixing.fit_topics(vectors.repartition(1)), mixing.fit_topics(vectors.repartition(7, "key"))
    assert np.array_equal(one["en"].at, two["en"].at) and np.array_equal(one["en"].mean, two["en"].mean) and len(one["en"].at) == mixing.TOPICS


def test_vectors_are_worked_on_without_their_zeros():
    """Sums of rows, products and distances equal those of dense rows; a pass holds a few values for each word, not ``DIM`` for each row."""
    rng = np.random.default_rng(4)
    dense = np.zeros((600, mixing.DIM))
    for i in range(600):
        if i % 50 != 7:  # some rows are empty
            dense[i, rng.choice(mixing.DIM, rng.integers(1, 30), replace=False)] = rng.integers(1, mixing.GRID, 1)
    x = pa.array([np.stack([np.flatnonzero(r), r[r > 0]]).astype("<u2").tobytes() for r in dense], pa.binary())
    batch = pa.RecordBatch.from_arrays([pa.array(["en", "fr", "fr"] * 200), pa.array(range(600), pa.int64()), x], ["fit", "key", "x"])
    list(mixing._chunks([batch.slice(0, 2)]))
    tracemalloc.start()
    got = list(mixing._chunks([batch]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 2e6
    assert sorted(k for _, b, _ in got for k in b.column("key").to_pylist()) == list(range(600))
    of = mixing.Centres(rng.integers(0, 99, mixing.DIM).astype(float), rng.integers(-999, 999, (5, mixing.DIM)).astype(float))
    for lang, b, v in got:
        want = dense[b.column("key").to_numpy()]
        assert len(v) == len(want) and set(b.column("fit").to_pylist()) == {lang} and np.array_equal(v.sum(axis=0), want.sum(axis=0))
        assert np.array_equal(of.likeness(v), (want - of.mean) @ of.at.T)
        assert np.array_equal(of.distance(v), np.maximum(np.round(np.sqrt(((want - of.mean) ** 2).sum(axis=1))), 1))
        group, weight = np.arange(len(v)) % 3, np.arange(len(v)) + 1.0
        assert np.array_equal(v.sums(group, weight, 3), [(want * weight[:, None])[group == j].sum(axis=0) for j in range(3)])


def test_pieces_keep_every_row_however_long_it_is(monkeypatch):
    monkeypatch.setattr(mixing, "VALUES", 10)
    sizes = [3, 0, 25, 10, 0, 0, 4, 4, 4, 1, 11, 0]
    x = pa.array([np.stack([np.arange(n), np.full(n, i + 1)]).astype("<u2").tobytes() for i, n in enumerate(sizes)], pa.binary())
    for column in (x, x.cast(pa.large_binary()), pa.concat_arrays([x, x]).slice(len(sizes))):
        got = list(mixing._pieces(column))
        assert [i for i, _ in got] == list(np.cumsum([0] + [len(v) for _, v in got]))[:-1]
        assert [n for _, v in got for n in v.size] == sizes and all(v.size.sum() <= 10 or len(v) == 1 for _, v in got)
        assert [float(y) for _, v in got for y in v.value] == [float(i + 1) for i, n in enumerate(sizes) for _ in range(n)]


def test_first_centres_are_drawn_from_all_texts_without_a_pass_for_each(spark, monkeypatch):
    """The early rows give the draws that going through all rows gives, also where they have none and all are gone through."""
    rng = random.Random(8)
    words = [f"{c}{i}word" for c in "abcdefgh" for i in range(25)]
    rows = [(i, i * 7919, "s", "en" if i % 5 else "fr", "(none)", " ".join(rng.choice(words[25 * (i % 8) :][:30]) for _ in range(15))) for i in range(3000)]
    rows += [(i, i * 7919, "s", "de", "(none)", "gleicher text hier") for i in range(3000, 3050)]  # one vector: all draws but the first find nothing
    measured = spark.createDataFrame(rows, "doc_id long, key long, source string, lang string, topic string, text string").mapInArrow(mixing._measured(True), "doc_id long, key long, source string, lang string, topic string, tokens long, x binary")
    vectors = measured.selectExpr("lang AS fit", "key", "x").cache()
    some = vectors.where("fit <> 'de'")
    passes, through = [], type(vectors).mapInArrow
    monkeypatch.setattr(type(vectors), "mapInArrow", lambda self, *a, **b: passes.append(1) or through(self, *a, **b))
    fast = mixing.fit_topics(some)
    few = len(passes)
    monkeypatch.setattr(mixing, "EARLY", 1e-9)
    slow = mixing.fit_topics(some)
    assert len(passes) - few == few + mixing.TOPICS  # one for each draw
    all_rows = mixing.fit_topics(vectors)
    monkeypatch.setattr(mixing, "EARLY", 1e9)  # all rows are early
    early = mixing.fit_topics(vectors)
    for lang in ("en", "fr"):
        assert all(np.array_equal(fast[lang].at, c[lang].at) for c in (slow, all_rows, early)) and len(fast[lang].at) == mixing.TOPICS
    assert np.array_equal(all_rows["de"].at, early["de"].at)


def test_topics_follow_the_vocabulary(spark):
    rng = random.Random(2)
    sets = [[f"{c}{i}word" for i in range(40)] for c in "abc"]
    rows = [(i, " ".join(rng.choice(sets[i % 3]) for _ in range(60)), "s", "en") for i in range(300)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")).select("doc_id", "topic").collect()
    groups = defaultdict(set)
    for r in got:
        groups[r.topic].add(r.doc_id % 3)
    assert len(groups) >= 3 and all(len(g) == 1 for g in groups.values())


def test_language_id(spark):
    rng = random.Random(0)
    alphabets = {"aa": "abcde", "bb": "fghij", "cc": "aßéfö"}
    rows = [(i, " ".join("".join(rng.choice(alphabets[k]) for _ in range(5)) for _ in range(20)), k, None) for i in range(150) for k in [rng.choice("aa bb cc".split())]]
    rows += [(900, None, "aa", None), (901, "12 34 !", "bb", None), (902, "", None, None), (None, "abcde abcde", "aa", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = langid.identify(docs, langid.fit_languages(docs)).collect()
    for r, (i, t, k, _) in zip(sorted(got, key=repr), sorted(rows, key=repr), strict=False):
        assert 0 <= r.score <= 1
    by = {r.doc_id: r for r in got}
    assert all(by[i].lang_pred == k for i, _, k, _ in rows[:150])
    assert {by[i].lang_pred for i in (900, 901, 902)} == {"und"}
    assert all(by[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, *_ in rows[:150])
    none = docs.limit(0)
    assert langid.identify(docs, langid.fit_languages(none)).where("lang_pred <> 'und'").count() == 0


@pytest.mark.parametrize("k", [2, 3, 5, 9, 30])
def test_codewords_differ(k):
    c = langid.codewords(k)
    assert len({tuple(r) for r in c}) == k
    apart = min((c[i] != c[j]).sum() for i in range(k) for j in range(i))
    assert apart >= max(1, c.shape[1] // 4)


def test_shared_rows_across_batches():
    import pyarrow as pa

    for seed in range(200):
        rng = random.Random(seed)
        rows = sorted((rng.randint(0, 12) << 12 | rng.choice([0, 0, 1, 2]), rng.randint(0, 3), rng.randint(0, 6)) for _ in range(rng.randint(0, 60)))
        t, s = (np.array([r[k] for r in rows], np.int64) for k in (0, 2))
        batches, i = [], 0
        while i < len(rows):
            j = i + rng.randint(1, 7)
            batches.append(pa.RecordBatch.from_arrays([pa.array(t[i:j]), pa.array(s[i:j]), pa.array((s[i:j] + 10 << 32) | s[i:j])], ["token", "s", "at"]))
            i = j
        got = sorted(tuple(r.values()) for b in setjoin._shared(iter(batches)) for r in b.to_pylist())
        want = []
        for token in sorted(set(t.tolist())):
            has = s[t == token].tolist()
            part = token & 4095 > 0
            others = [x for x, before in zip(has[1:], has, strict=False) if x not in (has[0], before)]
            want += [(token, x, x + 10, x, has[0], has[0] + 10, has[0], len(others) == 1 and not part) for x in others + [has[0]] * part]
        assert got == sorted(want)


def test_mean_list_from_a_small_sketch():
    rng = np.random.default_rng(0)
    lengths = np.minimum(rng.zipf(1.7, 60_000), 3000)
    counts = np.bincount(rng.integers(0, 1 << 12, len(lengths)), weights=lengths, minlength=1 << 12)
    want = (lengths.astype(float) ** 2).sum() / lengths.sum()
    assert abs(setjoin.mean_list(counts) / want - 1) < 0.1
    assert setjoin.mean_list(np.zeros(16)) == 1.0


def test_jaccard_join_with_salted_and_blocked_lists(spark):
    rng = random.Random(9)
    base = [f"w{i}" for i in range(90)]
    rows = []
    for i in range(160):
        w = list(base)
        for _ in range(rng.choice([0, 1, 2, 4, 9, 14])):
            w[rng.randrange(len(w))] = f"v{rng.randint(0, 400)}"
        rows.append((i, " ".join(w[: rng.choice([90, 90, 80, 60, 12, 9])])))
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in setjoin.similar_documents(spark.createDataFrame(rows, "doc_id long, text string"), list_part=5, list_block=4).collect()]
    assert _sorted(got) == _sorted(brute.jaccard_components(rows))
    assert len({r[2] for r in got}) > 5


def test_encoder_equals_the_tokenizer():
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path())
    rng = random.Random(1)
    signs = "abcdefghijABC éÉßüÑñ'st.!?,*#123 \x1cİΣσ汉字<|>-́ \n"
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 80))) for _ in range(3000)]
    texts += ["<|endoftext|> x<|startoftext|>", "a <|EndOfText|> b", "c<|endoftext|>", "<|endoftext|", "Word <|startoftext|><|endoftext|> é", "it's they're 'S 'T", "ẞǅ ﬁne", "x" * 500, ""]
    enc = packing.Encoder(tokenizer_path())
    enc.KEEP = 2000  # words are forgotten on the way
    got = [x for i in range(0, len(texts), 100) for x in enc.encode([t.encode() for t in texts[i : i + 100]])]
    assert got == [np.array(e.ids, "<u4").tobytes() for e in tok.encode_batch_fast(texts, add_special_tokens=False)]
