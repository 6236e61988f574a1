"""The pipeline's stages against brute force, on awkward documents, and run() as a whole."""

import random
from collections import Counter, defaultdict

import pytest

import corpus_pipeline as P
from quillmark.llm import mixing, packing
from quillmark.llm.queries import tokenizer_path

from . import brute

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def _documents():
    rng = random.Random(21)
    word = lambda: "".join(rng.choice("abcdefghijkl") for _ in range(rng.randint(3, 8)))
    say = lambda k: [word() for _ in range(k)]
    shared, rows = say(70), []
    for i in range(60):
        w = say(rng.randint(80, 200))
        if i % 5 == 0:
            w[30:30] = shared
        rows.append((i * 2, " ".join(w), rng.choice(["en", "fr"]), rng.choice("abc"), None))
    for i in range(10):  # near and exact copies
        w = rows[i][1].split(" ")
        if i % 2:
            w[7] = "changed"
        rows.append((500 + i, " ".join(w), "en", "a", None))
    rows += [(800, "too short", "en", "a", 9), (801, " ".join(["again and again"] * 40), "en", "a", 1), (802, None, None, None, None), (803, "", "en", "b", 0), (None, " ".join(say(90)), None, "c", 3)]
    rows += [rows[3], rows[3], (900, " ".join(say(4000)), "fr", "b", 1)]
    return [(i, t, lang, s, len(t or "") if n is None else n) for i, t, lang, s, n in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(_documents(), COLUMNS).selectExpr("*", "1 AS key", "'x' AS kept", "2 AS component_id", "3L AS tokens", "'y' AS _quill")


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(_documents(), COLUMNS).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i * 2, 1, 0) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d


def _bag(df):
    return Counter(tuple(r) for r in df.select("doc_id", "text", "lang", "source").collect())


def test_quality_stage(spark, docs, sf_dir):
    got = P.quality_rules(spark, docs, sf_dir)
    assert got.columns == docs.columns
    want = Counter()
    for r in docs.collect():
        n_words, _, _, _, n_repeat = brute.quality(r.text)
        if not (n_words < 20 or 100 * n_repeat > 30 * n_words):  # no bad labels: nothing but the hard rules rejects
            want[(r.doc_id, r.text, r.lang, r.source)] += 1
    assert _bag(got) == want


def test_join_stage(spark, docs, sf_dir):
    got = P.ngram_jaccard_join(spark, docs, sf_dir)
    assert got.columns == docs.columns
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    groups = defaultdict(set)
    for (i, t), (_, n, c) in zip(rows, brute.jaccard_components(rows), strict=True):
        if n:
            groups[c].add((i, t))
    assert {i for i, t, *_ in _bag(got) if (t or "").split()} == {min(g, key=lambda x: (x[0] is None, x[0] or 0))[0] for g in groups.values()}
    assert {r.doc_id for r in got.where("text IS NULL OR trim(text) = ''").collect()} == {802, 803}
    assert max(_bag(got).values()) == 1


def test_substring_stage(spark, docs, sf_dir):
    unique = docs.dropDuplicates(["doc_id", "text"])
    got = P.substring_dedup(spark, unique, sf_dir)
    assert got.columns == docs.columns and got.count() == unique.count()
    removed = {i: (n, k) for i, n, k, _ in brute.substring_dedup([(r.doc_id, r.text) for r in unique.collect()])}
    for r in got.collect():
        n, k = removed[r.doc_id]
        assert len((r.text or "").split()) == n - k and (k == 0 or r.n_chars == len(r.text))


def test_mixing_stage(spark, docs, sf_dir):
    got, mixed = P.mixing_sources(spark, docs, sf_dir), mixing.mix(docs)
    assert got.columns == docs.columns
    assert Counter(r.doc_id for r in got.collect()) == Counter(r.doc_id for r in mixed.where("kept").collect())
    for r in mixing.achieved(mixed).collect():
        assert abs(r.goal - r.expected) < 0.2 and 0 <= r.kept <= 1


def test_packing_stage(spark, docs, sf_dir):
    rows = P.best_fit_packing(spark, docs, sf_dir).collect()
    length = Counter()
    for r in rows:
        length[r.doc_id] += r.length
    enc = packing.Encoder(tokenizer_path())
    want = Counter()
    for d in docs.collect():
        want[d.doc_id] += len(next(enc.encode([(d.text or "").encode()]))) // 4 + 1
    assert length == want


@pytest.mark.parametrize("k", range(5))
def test_stages_of_an_empty_table(spark, docs, sf_dir, k):
    name, stage = P.STAGES[k]
    got = stage(spark, docs.limit(0), sf_dir)
    assert got.count() == 0 and (k == 4 or got.columns == docs.columns), name


def test_run(spark, sf_dir):
    rows = P.run(spark, sf_dir).collect()
    kept = {r.doc_id for r in rows}
    assert kept and not kept & {800, 801, 802, 803} and len(kept & {0, 500}) <= 1
    places = defaultdict(list)
    for r in rows:
        places[r.sequence_id].append((r.offset, r.length))
    for v in places.values():
        at = 0
        for o, n in sorted(v):
            assert o == at
            at += n
        assert at <= 2048
