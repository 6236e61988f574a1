"""Operator 12, quality scores: random Fourier features and ridge regression.

Each document gets statistics of its text. Random cosines of their standard scores
(Rahimi and Recht 2007) approximate a Gaussian kernel, and a ridge regression on them
is solved from the normal equations. Every task adds up its rows' part of the
equations, and further tasks add up those sums, so the fit takes all labelled rows
and the driver sees a few matrices. Features are rounded to multiples of 2**-12, so the
sums are exact and do not depend on the order of the rows (up to 10**8 rows).

The kernel's width and the ridge are chosen on a quarter of the learning rows, on which
isotonic regression also turns the regression's values into probabilities.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import words as X
from .common import materialize

#: Random features, and the kernel widths and ridges (for each learning row) to choose from.
FEATURES = 320
WIDTHS, RIDGES = (2.0, 3.5, 6.0), (1e-5, 1e-4, 1e-3)
#: Steps of the features' values, and bins of the regression's values over [-1, 2].
_GRID, BINS = 4096.0, 3000


def _table(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_SYMBOL, _UPPER, _DIGIT = _table(b"#*$%&|<>"), _table(bytes(range(65, 91))), _table(b"0123456789")
_ASCII_LETTER = _table(bytes([*range(65, 91), *range(97, 123)]))
_STOP, _MARK = _table(b".!?"), _table(b",;:-()\"'/_=+@[]{}~^`\\")
_BANG = _table(b"!")

NAMES = ["words", "word_length", "word_spread", "symbols", "upper", "digits", "stops", "bangs", "marks", "beyond_ascii", "line_words", "repeat_lines", "repeat_windows", "distinct", "commonest", "bare_stops", "line_ends"]


def statistics(buf: np.ndarray) -> np.ndarray:
    """The statistics of one text, given as UTF-8 bytes; zeros without words."""
    h, starts, ends = X.word_hashes(buf)
    n = len(h)
    if not n:
        return np.zeros(len(NAMES))
    chars = (buf & 0xC0) != 0x80
    upto = np.concatenate([[0], np.cumsum(chars, dtype=np.int64)])
    long = upto[ends] - upto[starts]
    total = max(1, int(long.sum()))
    count = lambda t: int(np.count_nonzero(t[buf]))
    lines = [x for x in buf.tobytes().split(b"\n") if x.strip()]
    repeat = 0
    if n >= 9:
        _, back, times = np.unique(X.windows(h, 8), return_inverse=True, return_counts=True)
        again = np.flatnonzero(times[back] > 1)
        repeat = int(np.count_nonzero(X.covered(again, 8, n))) if len(again) else 0
    _, times = np.unique(h, return_counts=True)
    stop = _STOP[buf[ends - 1]]
    return np.array([
        np.log1p(n), long.mean(), np.log1p(long.std()), np.log1p(100 * count(_SYMBOL) / n), count(_UPPER) / total, count(_DIGIT) / total, np.count_nonzero(stop) / n,
        np.log1p(100 * count(_BANG) / n), count(_MARK) / total, np.count_nonzero(chars & (buf > 127)) / total, np.log(n / max(1, len(lines))), 1 - len(set(lines)) / max(1, len(lines)), repeat / n,
        # a text of n words has about n ** 0.8 different ones, whatever its length
        np.log(len(times)) / np.log(n + 1), times.max() / n, np.count_nonzero(long == 1) / n, np.mean([x.rstrip()[-1:] in (b".", b"!", b"?") for x in lines]),
    ])


def held_out(doc_id: str) -> Column:
    """Whether crc32 of the id as text leaves 1 when divided by 3; null ids are held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(True))


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        buf, off, _ = X.slices(b.column("text"))
        rows = [statistics(buf[off[i] : off[i + 1]]).astype("<f8").tobytes() for i in range(len(b))]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(rows, pa.binary())], ["doc_id", "held_out", "x"])


def text_statistics(docs: DataFrame) -> DataFrame:
    """doc_id, held_out and the statistics (little-endian doubles) of every document."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out("doc_id").alias("held_out"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(_measure, "doc_id long, held_out boolean, x binary")


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<f8").reshape(-1, len(NAMES))


@dataclass
class ScoreModel:
    """Scale of the statistics, random directions, weights of the features, and the calibration's points."""

    mean: np.ndarray
    scale: np.ndarray
    width: float = WIDTHS[0]
    weights: np.ndarray | None = None
    at: np.ndarray | None = None
    share: np.ndarray | None = None

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(x), float(self.share[0]))
        raw = fourier(x, self.mean, self.scale, self.width) @ self.weights
        # a thousandth of the value itself keeps the order within the calibration's steps
        return np.clip(0.999 * np.interp(raw, self.at, self.share) + 0.001 * np.clip((raw + 1) / 3, 0, 1), 0, 1)


def fourier(x: np.ndarray, mean: np.ndarray, scale: np.ndarray, width: float, features: int = FEATURES) -> np.ndarray:
    """Cosines along random directions, and a one: products of two rows approach exp(-|x - y|**2 / (2 width**2))."""
    rng = np.random.default_rng(12)
    z = np.clip((x - mean) / scale, -6, 6)
    w, phase = rng.standard_normal((x.shape[1], features)), rng.uniform(0, 2 * np.pi, features)
    # summed along fixed columns, so that a row's features don't depend on its neighbours
    inner = np.zeros((len(x), features))
    for k in range(x.shape[1]):
        inner += z[:, k, None] * w[k]
    return np.column_stack([np.round(np.cos(inner / width + phase) * _GRID) / _GRID, np.ones(len(x))])


def isotonic(n: np.ndarray, ones: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pooled adjacent violators: the first bin of each step, and the steps' shares of ones."""
    steps: list[list[float]] = []
    for i in np.flatnonzero(n):
        steps.append([i, n[i], ones[i]])
        while len(steps) > 1 and steps[-2][2] * steps[-1][1] >= steps[-1][2] * steps[-2][1]:
            _, m, k = steps.pop()
            steps[-1][1] += m
            steps[-1][2] += k
    return np.array([s[0] for s in steps]), np.array([s[2] / s[1] for s in steps])


def _sums(batches: Iterator[pa.RecordBatch], of: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> Iterator[pa.RecordBatch]:
    """One row with the sum of what ``of`` gives for the statistics and the (n, ones) of rows."""
    total = None
    for b in batches:
        for i in range(0, len(b), 2048):
            part = b.slice(i, 2048)
            got = of(_matrix(part.column("x")), np.column_stack([part.column(c).to_numpy().astype(float) for c in ("n", "ones")]))
            total = got if total is None else total + got
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([total.astype("<f8").tobytes()], pa.binary())], ["sums"])


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for b in batches:
        for raw in b.column("sums"):
            x = np.frombuffer(raw.as_buffer(), "<f8")
            total = x.copy() if total is None else total + x
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])


def summed(rows: DataFrame, of: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray | None:
    """The sum of ``of`` over rows (x, n, ones): partitions add up their rows, then fewer and fewer tasks the sums."""
    part = rows.select("x", "n", "ones").mapInArrow(lambda batches: _sums(batches, of), "sums binary")
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    while tasks > 8:
        tasks = -(-tasks // 16)
        part = part.repartition(tasks).mapInArrow(_add, "sums binary")
    got = [np.frombuffer(r["sums"], "<f8") for r in part.collect()]  # at most 16 arrays of a size that FEATURES fixes
    return np.sum(got, axis=0) if got else None


def fit_scores(stats: DataFrame, labels: DataFrame) -> ScoreModel:
    """Fit on the rows of ``text_statistics`` that are not held out and have a label of quality."""
    k, d = len(NAMES), FEATURES + 1
    marked = labels.where("doc_id IS NOT NULL AND quality IN (0, 1)").where(~held_out("doc_id"))
    marked = marked.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.count("*").alias("n"), F.sum(F.col("quality").cast("long")).alias("ones"))
    rows = materialize(stats.where(~F.col("held_out")).select("doc_id", "x").join(marked, "doc_id"))
    moments = summed(rows, lambda x, y: np.concatenate([y.sum(0), y[:, 0] @ x, y[:, 0] @ (x * x)]))
    if moments is None:
        return ScoreModel(np.zeros(k), np.ones(k), share=np.array([0.5]))
    n, ones = moments[:2]
    mean = moments[2 : 2 + k] / n
    spread = np.sqrt(np.maximum(moments[2 + k :] / n - mean**2, 0))
    mean, scale = np.round(mean, 6), np.round(np.where(spread > 1e-6, spread, 1), 6)
    learn = F.pmod(F.xxhash64("doc_id"), F.lit(4)) != 0

    def equations(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        out = []
        for width in WIDTHS:
            z = fourier(x, mean, scale, width)
            out.append(np.column_stack([(z * y[:, :1]).T @ z, z.T @ y[:, 1]]).ravel())
        return np.concatenate([*out, y.sum(0)])

    got = summed(rows.where(learn), equations)
    if got is None or not 0 < ones < n:  # too few rows, or labels of one kind
        return ScoreModel(mean, scale, share=np.array([ones / n]))
    models = []
    for width, part in zip(WIDTHS, got[:-2].reshape(len(WIDTHS), d, d + 1), strict=True):
        for ridge in RIDGES:
            penalty = np.full(d, ridge * got[-2])
            penalty[-1] = 0
            models.append((width, np.linalg.solve(part[:, :d] + np.diag(penalty + 1e-9), part[:, d])))

    def values(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Of each model: the squared error, and how many rows and ones each bin of its values has."""
        z, out = {w: fourier(x, mean, scale, w) for w in WIDTHS}, []
        for width, weights in models:
            raw = z[width] @ weights
            error = (y[:, 1] * (1 - raw) ** 2 + (y[:, 0] - y[:, 1]) * raw**2).sum()
            at = _bin(raw)
            out.append(np.concatenate([[round(error * 4096)], *(np.bincount(at, y[:, c], BINS) for c in (0, 1))]))
        return np.concatenate(out)

    held = summed(rows.where(~learn), values)
    if held is None:
        return ScoreModel(mean, scale, share=np.array([ones / n]))
    held = held.reshape(len(models), -1)
    best = int(np.argmin(held[:, 0]))
    low, share = isotonic(held[best, 1 : 1 + BINS], held[best, 1 + BINS :])
    high = np.append(low[1:], BINS)  # a step reaches to where the next one begins; between their middles the share is drawn straight
    middle = (low + high) / 2
    middle[0], middle[-1] = high[0], low[-1]
    return ScoreModel(mean, scale, models[best][0], models[best][1], middle * 3 / BINS - 1, share)


def _bin(raw: np.ndarray) -> np.ndarray:
    return np.clip((raw + 1) * (BINS / 3), 0, BINS - 1).astype(np.int64)


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): doc_id, held_out, score (0 to 1, higher where quality 1 is likelier) and predicted.

    ``labels`` (doc_id, quality): a document with several labels counts each; other
    qualities than 0 and 1 are no labels. Null and empty texts have zero statistics and
    are scored like any. Null ids stay null and count as held out. Equal texts get equal
    scores. Without labels every score is 0.5, with labels of one kind their share of
    ones. No documents give no rows. Other columns are ignored, whatever their names.
    """
    stats = materialize(text_statistics(docs))
    model = fit_scores(stats, labels)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            score = np.concatenate([np.zeros(0), *(model.score(_matrix(b.column("x").slice(i, 2048))) for i in range(0, len(b), 2048))])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return stats.mapInArrow(judge, "doc_id long, held_out boolean, score double, predicted int")
