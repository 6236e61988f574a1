"""Quality scores: the sums, the kernel, the calibration, held-out accuracy and awkward rows."""

import zlib

import numpy as np
import pytest

from quillmark.llm import queries, scores
from quillmark.llm.common import table

SF = "/root/testdata/sf0.1"


def test_held_out_accuracy_and_folds(spark):
    rows = queries.op12_quality_classifier(spark, SF).join(table(spark, SF, "labels").select("doc_id", "quality"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and r.predicted == (r.score >= 0.5) and 0 <= r.score <= 1 for r in rows)
    held = [(r.score, r.quality) for r in rows if r.held_out]
    good, bad = ([s for s, q in held if q == k] for k in (1, 0))
    auc = np.mean([(g > b) + 0.5 * (g == b) for b in bad for g in good])
    print("MEASURED", len(held), auc, np.mean([s < 0.5 for s in bad]), np.mean([s < 0.5 for s in good]))
    assert len(bad) > 100 and auc > 0.99 and np.mean([s < 0.5 for s in bad]) > 0.95 and np.mean([s < 0.5 for s in good]) < 0.02
    # calibrated: of what is scored about p, about a share of p is good
    some = [(s, q) for s, q in held if 0.05 < s < 0.95]
    assert len(some) < 60 or abs(np.mean([s for s, _ in some]) - np.mean([q for _, q in some])) < 0.2


def test_features_approach_the_kernel():
    rng = np.random.default_rng(2)
    x = rng.standard_normal((30, len(scores.NAMES)))
    z = scores.fourier(x, np.zeros(x.shape[1]), np.ones(x.shape[1]), 3.0, features=20_000)[:, :-1]
    want = np.exp(-((x[:, None] - x[None]) ** 2).sum(2) / 18)
    assert np.abs(2 * z @ z.T / 20_000 - want).max() < 0.05


def test_sums_do_not_depend_on_the_order_of_rows(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.standard_normal(len(scores.NAMES)).astype("<f8").tobytes(), 1, int(rng.integers(0, 2))) for i in range(400)]
    zero, one = np.zeros(len(scores.NAMES)), np.ones(len(scores.NAMES))
    of = lambda x, y: ((z := scores.fourier(x, zero, one, 2.0)) * y[:, :1]).T @ z
    df = spark.createDataFrame(rows, "doc_id long, x binary, n long, ones long")
    got = [scores.summed(d, of) for d in (df, df.repartition(7), df.orderBy("x").coalesce(1))]
    assert np.array_equal(got[0], got[1]) and np.array_equal(got[0], got[2])
    assert scores.summed(df.limit(0), of) is None


def test_isotonic():
    n, ones = np.array([0, 4, 2, 0, 2, 4]), np.array([0, 0, 2, 0, 0, 4])
    first, share = scores.isotonic(n, ones)
    assert first.tolist() == [1, 2, 5] and share.tolist() == [0, 0.5, 1]


def test_awkward_rows(spark, llm_rows):
    docs = llm_rows.selectExpr("*", "1 AS x", "2 AS n", "'y' AS ones", "0 AS quality", "4 AS score")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in (1, 2, 2, 3, 4, 5, 6, 7)] + [(None, 1, 0), (9999, 0, 1), (1, None, 0), (2, 7, 0)], "doc_id long, quality int, toxic int")
    got = scores.score_documents(docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    assert [r.held_out for r in got if r.doc_id is None] == [True]
    two = [r for r in got if r.doc_id == 2]
    assert two[0] == two[1] and two[0].score == next(r.score for r in got if r.doc_id == 1)  # equal texts
    assert len({r.score for r in got if r.doc_id in (3, 4)}) == 1  # null and empty
    assert scores.score_documents(docs.limit(0), labels).count() == 0
    assert {r.score for r in scores.score_documents(docs, labels.limit(0)).collect()} == {0.5}
    assert {r.score for r in scores.score_documents(docs, labels.where("quality = 1")).collect()} == {1.0}


@pytest.mark.parametrize("text", [b"", b" \n ", b"x", b"one two\none two\n" * 50, "é漢 ".encode() * 9])
def test_statistics_are_finite(text):
    got = scores.statistics(np.frombuffer(text, np.uint8))
    assert len(got) == len(scores.NAMES) and np.isfinite(got).all()
