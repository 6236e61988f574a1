"""Operator 5, quality rules: isolation forests on rule statistics.

Each document gets the statistics of the usual quality rules (word count, word
length, symbols, repeated lines, repeated 8-word windows, capitals). Hard rules
reject first. For the rest isolation forests (Liu, Ting and Zhou 2008) measure how
short the path to a document is over random splits. One forest sees what the words
are made of and repeat, the other repeated lines and the word count: in one forest
the wide spread of the latter among good documents hides the former. They are
fitted on good labelled rows and a few bad ones (a feature that never varies among
the good would otherwise never be split); each cut is calibrated on other labelled
rows, and a document goes if either forest puts it past its cut.

All labelled rows count: half of them fit, where each tree draws its own subsample
from all of them, as the method says, and the cuts come from the counts of the scores
of all rows of the other half. Every document is scored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as X
from .common import drop, materialize, text_key

TREES, SUBSAMPLE = 128, 256
#: Scores are multiples of one over this, so that their counts stay few.
GRID = 1 << 16
#: Share of the good labelled rows that the cuts of the two forests may reject at most.
MAX_LOSS = (0.01, 0.002)
#: Bad rows of a tree's subsample.
BAD = SUBSAMPLE // 64

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True

STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
_ALL = [*STATS, "n_upper"]
_SCHEMA = "doc_id long, text_key long, " + ", ".join(f"{c} long" for c in _ALL)


def statistics(buf: np.ndarray) -> tuple[int, ...]:
    """The counts of one text, given as UTF-8 bytes."""
    h, starts, _ = X.word_hashes(buf)
    n = len(h)
    if not n:
        return (0,) * len(_ALL)
    chars = (buf & 0xC0) != 0x80
    word_chars = int(np.count_nonzero(chars & ~X.SPACE[buf]))
    lines = [x for x in buf.tobytes().split(b"\n") if x.strip()]
    repeat = 0
    if n >= 9:
        g = X.windows(h, 8)
        _, back, count = np.unique(g, return_inverse=True, return_counts=True)
        again = np.flatnonzero(count[back] > 1)
        if len(again):
            repeat = int(np.count_nonzero(X.covered(again, 8, n)))
    count = lambda t: int(np.count_nonzero(t[buf]))
    return n, word_chars, count(_SYMBOL), len(lines) - len(set(lines)), repeat, count(_UPPER)


def features(s: np.ndarray) -> list[np.ndarray]:
    """Ratios of the counts, a row each: what each forest splits on."""
    s = s.astype(np.float64)
    n, w = np.maximum(s[:, 0], 1), np.maximum(s[:, 1], 1)
    return [np.column_stack([s[:, 1] / n, np.log1p(100 * s[:, 2] / n), s[:, 4] / n, np.log1p(100 * s[:, 5] / w)]), np.column_stack([np.log1p(100 * s[:, 3] / n), np.log(n)])]


@dataclass
class Forest:
    """Trees as arrays: split feature (-1 in a leaf), split value, left child (right is the next), path length."""

    feature: np.ndarray
    value: np.ndarray
    left: np.ndarray
    path: np.ndarray
    norm: float
    cut: float = np.inf

    def score(self, x: np.ndarray) -> np.ndarray:
        """2 ** (-mean path length / expected length): near 1 for anomalies."""
        out = np.empty(len(x))
        trees = np.arange(len(self.feature))
        for i in range(0, len(x), 2048):
            part = x[i : i + 2048]
            at = np.zeros((len(part), len(trees)), np.int64)
            while True:
                f = self.feature[trees, at]
                inner = f >= 0
                if not inner.any():
                    break
                v = np.take_along_axis(part, np.maximum(f, 0), 1)
                at = np.where(inner, self.left[trees, at] + (v >= self.value[trees, at]), at)
            out[i : i + 2048] = 2.0 ** (-self.path[trees, at].mean(1) / self.norm)
        return np.round(out * GRID) / GRID


def _expected(n: int) -> float:
    return 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n if n > 2 else float(n == 2)


def fit_forest(x: np.ndarray, trees: int = TREES, subsample: int = SUBSAMPLE, seed: int = 5) -> Forest:
    """A forest over rows at hand."""
    rng = np.random.default_rng(seed)
    m = min(subsample, len(x))
    return grow([x[rng.choice(len(x), m, replace=False)] for _ in range(trees)], seed)


def grow(parts: list[np.ndarray], seed: int = 5) -> Forest:
    """A forest with a tree for each subsample."""
    rng = np.random.default_rng(seed)
    m, trees = max(map(len, parts)), len(parts)
    depth = int(np.ceil(np.log2(max(m, 2))))
    size = 2 ** (depth + 1)
    f, v, left, path = np.full((trees, size), -1), np.zeros((trees, size)), np.zeros((trees, size), np.int64), np.zeros((trees, size))
    for t, x in enumerate(parts):
        todo, free = [(0, x, 0)], 1
        while todo:
            at, part, d = todo.pop()
            can = np.flatnonzero(part.max(0) > part.min(0)) if len(part) > 1 and d < depth else []
            if not len(can):
                path[t, at] = d + _expected(len(part))
                continue
            k = rng.choice(can)
            cut = rng.uniform(part[:, k].min(), part[:, k].max())
            right = part[:, k] >= cut
            f[t, at], v[t, at], left[t, at] = k, cut, free
            todo += [(free, part[~right], d + 1), (free + 1, part[right], d + 1)]
            free += 2
    return Forest(f, v, left, path, _expected(m) or 1.0)


def calibrated_cut(good: np.ndarray, bad: np.ndarray, max_loss: float = MAX_LOSS[0], n_good: np.ndarray | None = None, n_bad: np.ndarray | None = None) -> float:
    """The cut that rejects most bad rows net of good ones, and at most max_loss of the good; no cut without bad rows. n_good, n_bad: how many rows have each score, 1 if not given."""
    if not len(good) or not len(bad):
        return np.inf
    cuts = np.unique(np.concatenate([bad, good]))
    cuts = np.append((cuts[1:] + cuts[:-1]) / 2, np.inf)

    def past(x: np.ndarray, n: np.ndarray | None) -> np.ndarray:
        by = np.argsort(x)
        below = np.concatenate([[0], np.cumsum(np.ones(len(x)) if n is None else n[by])])
        return 1 - below[np.searchsorted(x[by], cuts)] / below[-1]

    loss, gain = past(good, n_good), past(bad, n_bad)
    ok = loss <= max_loss
    return float(cuts[ok][np.argmax((gain - loss)[ok])])


def base_failed(s: np.ndarray) -> np.ndarray:
    return (s[:, 0] < 20) | (100 * s[:, 4] > 30 * s[:, 0])


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        buf, off, _ = X.slices(b.column("text"))
        rows = np.array([statistics(buf[off[i] : off[i + 1]]) for i in range(len(b))], np.int64).reshape(len(b), len(_ALL))
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_key"), *(pa.array(rows[:, i]) for i in range(len(_ALL)))], ["doc_id", "text_key", *_ALL])


def rule_statistics(docs: DataFrame) -> DataFrame:
    """The counts of every document; null and empty texts have zeros."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("text_key"), "text").mapInArrow(_measure, _SCHEMA)


def verdicts(forests: list[Forest], s: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of counts: whether the hard rules fail, the greater anomaly of the forests, and whether the document is kept."""
    failed = base_failed(s)
    anomaly, kept = np.zeros(len(s)), ~failed
    if len(s):
        for forest, x in zip(forests, features(s), strict=False):
            score = forest.score(x)
            anomaly, kept = np.maximum(anomaly, score), kept & ~(score >= forest.cut)
    return failed, anomaly, kept


def _draws(chance: dict[bool, float]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For each row (h, good, counts) the trees that may have it: those whose hash with the row's is below the chance of its kind."""
    salts = X.mix(np.arange(1, TREES + 1, dtype=X.U64))

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, len(whole), 2048):
                b = whole.slice(i, 2048)
                r = X.mix(b.column("h").to_numpy().view(X.U64)[:, None] ^ salts) >> X.U64(11)
                good = b.column("good").to_numpy(zero_copy_only=False)
                row, tree = np.nonzero(r < (np.where(good, chance[True], chance[False]) * 2.0**53)[:, None])
                yield pa.RecordBatch.from_arrays([pa.array(tree), pa.array(r[row, tree].astype(np.int64)), *(b.column(c).take(pa.array(row)) for c in ("good", *_ALL))], ["tree", "r", "good", *_ALL])

    return draw


def _subsamples(rows: DataFrame, n_good: int, n_bad: int) -> list[np.ndarray]:
    """Counts of the rows that each tree grows on: of all rows (h, good, counts) those with the smallest hashes for that tree, ``BAD`` of them bad."""
    want = {False: min(n_bad, BAD)}
    want[True] = min(n_good, SUBSAMPLE - want[False])
    # a little more than is wanted, so that no task gathers the smallest
    chance = {k: min(1.0, (want[k] + 7 * want[k] ** 0.5 + 14) / max(n, 1)) if want[k] else 0.0 for k, n in ((True, n_good), (False, n_bad))}
    got = rows.mapInArrow(_draws(chance), "tree long, r long, good boolean, " + ", ".join(f"{c} long" for c in _ALL)).toPandas()
    got = got.sort_values(["tree", "good", "r", *_ALL])
    got = got[got.groupby(["tree", "good"]).cumcount() < got["good"].map(want)]
    return [part[_ALL].to_numpy(np.int64) for _, part in got.groupby("tree")]


def _score_counts(forests: list[Forest]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            good = b.column("good").to_numpy(zero_copy_only=False)
            for k, x in enumerate(features(np.column_stack([b.column(c).to_numpy() for c in _ALL]))):
                score = np.round(forests[k].score(x) * GRID).astype(np.int64)
                at, n = np.unique(score * 2 + good, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k)), pa.array(at % 2 == 1), pa.array(at // 2), pa.array(n)], ["forest", "good", "score", "n"])

    return count


def fit_quality(stats: DataFrame, labels: DataFrame) -> list[Forest]:
    """Forests fitted and calibrated on all labelled rows of ``rule_statistics`` past the hard rules; none without good rows to fit."""
    picked = labels.where("doc_id IS NOT NULL AND quality IN (0, 1)").select(F.col("doc_id").cast("long").alias("_id"), (F.col("quality") == 1).alias("good"))
    rows = stats.join(picked, F.col("doc_id") == F.col("_id")).where("n_words >= 20 AND 100 * n_repeat_words <= 30 * n_words")
    rows = materialize(rows.select(F.xxhash64("doc_id").alias("h"), "good", *_ALL))
    fit, rest = rows.where("h % 2 = 0"), rows.where("h % 2 <> 0")
    n = {r["good"]: r["count"] for r in fit.groupBy("good").count().collect()}
    if not n.get(True):
        return []
    parts = [features(s) for s in _subsamples(fit, n[True], n.get(False, 0))]
    forests = [grow(list(x)) for x in zip(*parts, strict=True)]
    counts = rest.mapInArrow(_score_counts(forests), "forest long, good boolean, score long, n long")
    counts = counts.groupBy("forest", "good", "score").agg(F.sum("n").alias("n")).toPandas()  # at most GRID scores of each kind
    drop(rows)
    for k, forest in enumerate(forests):
        good, bad = (counts[(counts["forest"] == k) & (counts["good"] == kind)] for kind in (True, False))
        forest.cut = calibrated_cut(good["score"].to_numpy() / GRID, bad["score"].to_numpy() / GRID, MAX_LOSS[k], good["n"].to_numpy(), bad["n"].to_numpy())
    return forests


def quality_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): counts, base_failed, anomaly (0 to 1) and kept.

    Null and empty texts have no words and fail. Null ids stay null. Repeated rows
    get equal verdicts. Without good labelled rows nothing but the hard rules
    rejects (anomaly 0); without bad ones there is no cut. No documents give no
    rows. Other columns are ignored, whatever their names.
    """
    stats = materialize(rule_statistics(docs))
    forests = fit_quality(stats, labels)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = verdicts(forests, np.column_stack([b.column(c).to_numpy() for c in _ALL]))
            yield pa.RecordBatch.from_arrays([*b.columns, *map(pa.array, found)], [*b.schema.names, "base_failed", "anomaly", "kept"])

    return stats.mapInArrow(judge, _SCHEMA + ", base_failed boolean, anomaly double, kept boolean")
