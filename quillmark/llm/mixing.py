"""Operator 6, mixing sources to target weights by iterative proportional fitting.

Tokens are counted in cells of source, language and topic. The cell weights are
raked until their sums over each of the three match the targets, where no cell may
get more than the tokens it has. A document is then sampled with its cell's
calibrated probability, by a hash of its id.

Every category is raked, however rare. Up to ``CELLS`` cells are raked in memory,
more of them by the same steps as grouped sums and joins, under the same stopping rule.

A topic is a column that the caller names, else the nearest of ``TOPICS`` centres of the
document's language, as vectors of hashed words (spherical k-means). Centres are fitted
within each language, since words tell languages apart before they tell topics, and
are numbered from a language's commonest on. Every text counts in the fit, copies once:
each pass over the vectors is a Spark job whose tasks give sums of integers, so the
centres don't depend on how rows are dealt. Languages with under ``LEAST`` texts or a
fiftieth of all share their centres.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as X
from .common import BROADCAST_BYTES, drop, materialize, text_key

TOPICS, DIM, LEAST, SHARE = 8, 1 << 12, 40, 0.02
#: Passes of the k-means at most; it ends when one adds less than this share to the sum of cosines of every language.
PASSES, GAIN = 25, 1e-3
#: Values of vectors and centres are multiples of one over this, so that sums are exact in any order.
GRID = 1 << 12
#: Texts of a language, as expected, that are looked at first for each of its first centres, and a bound of their distances.
EARLY, FARTHEST = 32, 3 * GRID
#: Values of vectors that are worked on at once.
VALUES = 1 << 17
#: Shortest words, in bytes, that speak of a topic.
LETTERS = 4
#: Share of all tokens to keep.
KEEP = 0.5
#: Default targets are the shares of tokens to this power, made to sum to 1.
TEMPER = 0.5
SEED = 11
MARGINS = ("source", "lang", "topic")
#: So many cells, a few numbers each, are raked in memory.
CELLS = 1_000_000
#: Raking stops when no sum is off by more than this share, when rounds no longer bring it down, or after so many.
TOLERANCE, PATIENCE, ROUNDS = 1e-6, 12, 400


def settled(worst: list[float]) -> bool:
    """The stopping rule of both ways to rake. worst: the largest share that a sum was off by, for each round so far."""
    if not worst or worst[-1] < TOLERANCE or len(worst) >= ROUNDS:
        return bool(worst)
    return len(worst) > PATIENCE and worst[-1] > 0.999 * worst[-1 - PATIENCE]


def _counts(h: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    return np.bincount((h[e - s >= LETTERS] >> X.U64(52)).astype(np.int64), minlength=DIM)


def topic_vector(counts: np.ndarray) -> np.ndarray:
    """Places of the words that occur and, in steps of the grid, the square roots of their counts at length 1."""
    at = np.flatnonzero(counts)
    v = np.sqrt(counts[at].astype(np.float64))
    return np.stack([at, np.round(v / max(float(np.linalg.norm(v)), 1e-12) * GRID)]).astype("<u2")


@dataclass
class Vectors:
    """Rows of whole numbers: how many of each are not 0, their places and values. A text has a few hundred words of ``DIM`` places."""

    size: np.ndarray
    place: np.ndarray
    value: np.ndarray

    def __len__(self) -> int:
        return len(self.size)

    def _by_row(self, x: np.ndarray) -> np.ndarray:
        out, some = np.zeros(len(self)), self.size > 0
        if len(x):
            out[some] = np.add.reduceat(x, (np.cumsum(self.size) - self.size)[some])
        return out

    def dot(self, v: np.ndarray) -> np.ndarray:
        return self._by_row(self.value * v.take(self.place))

    def square(self) -> np.ndarray:
        return self._by_row(self.value * self.value)

    def sum(self, axis: int = 0) -> np.ndarray:
        """Over the rows, as axis 0 tells."""
        return np.bincount(self.place, self.value, DIM)

    def sums(self, group: np.ndarray, weight: np.ndarray, k: int) -> np.ndarray:
        """Weighted sums of the rows of each of k groups."""
        return np.bincount(np.repeat(group * DIM, self.size) + self.place, np.repeat(weight, self.size) * self.value, k * DIM).reshape(k, DIM)


def _vectors(column: pa.Array) -> Vectors:
    buf, off, _ = X.slices(column)
    both, off = buf[off[0] : off[-1]].view("<u2"), (off - off[0]).astype(np.int64) // 2
    size = np.diff(off) // 2
    at = np.arange(len(both) // 2) + np.repeat(off[:-1] // 2, size)  # a row's places come before its values
    return Vectors(size, both[at].astype(np.int64), both[at + np.repeat(size, size)].astype(np.float64))


def _pieces(column: pa.Array) -> Iterator[tuple[int, Vectors]]:
    """The vectors by runs of rows with about ``VALUES`` values, with the first row of each."""
    off = X.slices(column)[1].astype(np.int64)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(off, off[i] + 4 * VALUES, "right")) - 1)
        yield i, _vectors(column.slice(i, j - i))
        i = j


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, pa.RecordBatch, Vectors]]:
    """For each language of a batch its rows and their vectors, some at a time."""
    for b in batches:
        codes = b.column("fit").dictionary_encode()
        at = codes.indices.to_numpy()
        for k, lang in sorted(enumerate(codes.dictionary.to_pylist()), key=lambda x: x[1]):
            of = b if len(codes.dictionary) == 1 else b.take(pa.array(np.flatnonzero(at == k)))
            for i, x in _pieces(of.column("x")):
                yield lang, of.slice(i, len(x)), x


@dataclass
class Centres:
    """Of one language: the mean of its vectors, and centres of length 1, in steps of the grid."""

    mean: np.ndarray
    at: np.ndarray

    def likeness(self, x: Vectors) -> np.ndarray:
        """Cosines with the centres, times a row's distance from the mean: whole numbers, exact in any order."""
        return np.stack([x.dot(c) for c in self.at], axis=1) - self.mean @ self.at.T

    def distance(self, x: Vectors) -> np.ndarray:
        """From the mean, in whole steps of the grid, 1 at least."""
        square = x.square() - 2 * x.dot(self.mean) + self.mean @ self.mean
        return np.maximum(np.round(np.sqrt(np.maximum(square, 0))), 1)


def _unit(v: np.ndarray) -> np.ndarray:
    return np.round(v / max(float(np.linalg.norm(v)), 1e-12) * GRID)


def _sums(rows: DataFrame, of: Callable, every: int = 16) -> list[dict]:
    """Sums over the tasks of what ``of`` adds up: for each language and centre n, cosine and a vector. Summed in two steps, so that no task reads the parts of all."""
    kind = "fit string, k long, part long, n long, cosine double, sums binary"

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict = {}
        for lang, b, x in _chunks(batches):
            of(total, lang, b, x)
        if total:
            keys = list(total)
            part = TaskContext.get().partitionId() // every
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int64()), pa.array([part] * len(keys), pa.int64()), pa.array([int(total[k][0]) for k in keys]), pa.array([float(total[k][1]) for k in keys]), pa.array([total[k][2].astype("<f8").tobytes() for k in keys], pa.binary())], ["fit", "k", "part", "n", "cosine", "sums"])

    def together(t: pa.Table) -> pa.Table:
        sums = np.sum([np.frombuffer(x, "<f8") for x in t.column("sums").to_pylist()], axis=0)
        first = t.slice(0, 1)
        return pa.table({"fit": first.column("fit"), "k": first.column("k"), "part": first.column("part"), "n": [sum(t.column("n").to_pylist())], "cosine": [float(sum(t.column("cosine").to_pylist()))], "sums": pa.array([sums.tobytes()], pa.binary())})

    some = rows.mapInArrow(tasks, kind).groupBy("fit", "k", "part").applyInArrow(together, kind)
    got = some.groupBy("fit", "k").applyInArrow(together, kind).collect()
    return [{"fit": r["fit"], "k": r["k"], "n": r["n"], "cosine": r["cosine"], "sums": np.frombuffer(r["sums"], "<f8")} for r in got]


def _exponential(b: pa.RecordBatch, step: int) -> np.ndarray:
    """A waiting time for each row's draw as a first centre, from its key."""
    u = ((X.mix(b.column("key").to_numpy().view(X.U64) ^ X.mix(np.array([step + 1], X.U64))) >> X.U64(11)).astype(float) + 1) / 2.0**53
    return -np.log(u)


def _early(rows: DataFrame, many: dict[str, int], k: int) -> list[pa.RecordBatch]:
    """The rows whose waiting time for one of k draws is under ``EARLY`` over the texts of their language: about k * EARLY of each, however many there are."""

    def early(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            until = EARLY / np.array([many[lang] for lang in b.column("fit").to_pylist()], float)
            yield b.filter(pa.array(np.any([_exponential(b, step) < until for step in range(k)], axis=0)))

    return rows.select("fit", "key", "x").mapInArrow(early, "fit string, key long, x binary").toArrow().to_batches()


def _farthest(rows: DataFrame, early: list[pa.RecordBatch], many: dict[str, int], centres: dict[str, Centres], step: int) -> dict[str, np.ndarray]:
    """The next first centre of each language: a vector drawn from all, more likely the farther it is from the centres so far, by the smallest of exponential times.

    A row's time is that of ``_exponential`` over its distance, which is under ``FARTHEST``
    (at most 2 * GRID before values are rounded). So a time among the early rows that no
    other row can go below is the smallest of all. Where the early rows have none, all
    rows of the language are gone through.
    """

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict = {}
        for lang, b, x in _chunks(batches):
            of = centres[lang]
            distance = of.distance(x)
            far = GRID * distance
            if len(of.at):
                far = np.maximum(far - of.likeness(x).max(axis=1), 0)
            far = np.floor(far / distance)
            when = np.where(far > 0, _exponential(b, step) / np.maximum(far, 1), np.inf)
            i = int(when.argmin())
            if np.isfinite(when[i]):
                best[lang] = min(best.get(lang, (np.inf, 0, b"")), (float(when[i]), b.column("key")[i].as_py(), b.column("x")[i].as_py()))
        if best:
            yield pa.RecordBatch.from_arrays([pa.array(list(best), pa.string()), pa.array([v[0] for v in best.values()]), pa.array([v[1] for v in best.values()]), pa.array([v[2] for v in best.values()], pa.binary())], ["fit", "when", "key", "x"])

    found = {r["fit"]: r["x"] for b in draw(iter(early)) for r in b.to_pylist() if r["when"] < EARLY / many[r["fit"]] / FARTHEST}
    if rest := sorted(set(many) - set(found)):
        got = rows.where(F.col("fit").isin(rest)).mapInArrow(draw, "fit string, when double, key long, x binary").groupBy("fit").agg(F.min_by("x", F.struct("when", "key")).alias("x")).collect()
        found |= {r["fit"]: bytes(r["x"]) for r in got}
    return {lang: _vectors(pa.array([x], pa.binary())).sum() for lang, x in found.items()}


def fit_topics(rows: DataFrame, k: int = TOPICS) -> dict[str, Centres]:
    """Centres by language of a spherical k-means over all rows (fit, key, x), after the language's mean is taken off."""

    def mean(total: dict, lang: str, b: pa.RecordBatch, x: Vectors) -> None:
        n, _, sums = total.get((lang, 0), (0, 0.0, 0.0))
        total[lang, 0] = n + len(x), 0.0, sums + x.sum(axis=0)

    means = _sums(rows, mean)
    centres, texts = {r["fit"]: Centres(np.round(r["sums"] / r["n"]), np.zeros((0, DIM))) for r in means}, {r["fit"]: r["n"] for r in means}
    early = _early(rows, texts, k)
    for step in range(k):
        for lang, x in _farthest(rows, early, texts, centres, step).items():
            of = centres[lang]
            of.at = np.vstack([of.at, _unit(x - of.mean)])
    for of in centres.values():
        if not len(of.at):  # all texts are alike
            of.at = np.zeros((1, DIM))

    def near(total: dict, lang: str, b: pa.RecordBatch, x: Vectors) -> None:
        of = centres[lang]
        likeness, distance = of.likeness(x), of.distance(x)
        best = likeness.argmax(axis=1)
        weight = np.floor(GRID / distance * 16)
        many = np.bincount(best, minlength=len(of.at))
        gain = np.bincount(best, np.floor(likeness[np.arange(len(x)), best] / distance), len(of.at))
        more = x.sums(best, weight, len(of.at)) - np.bincount(best, weight, len(of.at))[:, None] * of.mean
        for j in np.flatnonzero(many):
            n, cosine, sums = total.get((lang, int(j)), (0, 0.0, 0.0))
            total[lang, int(j)] = n + int(many[j]), cosine + float(gain[j]), sums + more[j]

    before: dict[str, float] = {}
    for _ in range(PASSES):
        found = _sums(rows, near)
        now, many = {lang: 0.0 for lang in centres}, {lang: np.zeros(len(of.at), np.int64) for lang, of in centres.items()}
        for r in found:
            now[r["fit"]] += r["cosine"]
            many[r["fit"]][r["k"]] = r["n"]
        if before and all(now[c] - before[c] <= GAIN * abs(now[c]) for c in centres):
            break
        before = now
        for r in found:
            centres[r["fit"]].at[r["k"]] = _unit(r["sums"])
    for lang, of in centres.items():
        of.at = of.at[np.argsort(-many[lang], kind="stable")]
    return centres


def _fitted(rows: DataFrame) -> tuple[set[str], dict[str, Centres]]:
    """The languages with centres of their own, and all centres ('' for the others), from all texts with longer words; copies count once."""
    texts = materialize(rows.where("length(x) > 0").dropDuplicates(["lang", "key"]).select("lang", "key", "x"))
    n = texts.count()
    large = texts.groupBy("lang").count().where(F.col("count") >= max(LEAST, SHARE * n))  # a fiftieth of the texts each, so 50 at most
    own = {r["lang"] for r in large.collect()}
    fit = texts.withColumn("fit", F.when(F.col("lang").isin(sorted(own)), F.col("lang")).otherwise(F.lit("")) if own else F.lit(""))
    centres = fit_topics(fit) if n else {}
    drop(texts)
    return own, centres


def _measured(vectors: bool) -> Callable:
    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            buf, off, _ = X.slices(b.column("text"))
            tokens, found = [], []
            for i in range(len(b)):
                h, s, e = X.word_hashes(buf[off[i] : off[i + 1]], lower=True)
                tokens.append(len(h))
                counts = _counts(h, s, e) if vectors else np.zeros(0)
                found.append(topic_vector(counts).tobytes() if counts.any() else b"")
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "key", *MARGINS)), pa.array(tokens, pa.int64()), pa.array(found, pa.binary())], ["doc_id", "key", *MARGINS, "tokens", "x"])

    return measure


def _named(own: set[str], centres: dict[str, Centres]) -> Callable:
    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            topics = np.full(len(b), "(none)", object)
            langs, xs = b.column("lang").to_pylist(), b.column("x")
            some = np.diff(X.slices(xs)[1]) > 0
            fit = np.array([("" if lang not in own else lang) if has else None for lang, has in zip(langs, some, strict=True)], object)
            for lang in {f for f in fit if f is not None}:
                rows = np.flatnonzero(fit == lang)
                for i, x in _pieces(xs.take(pa.array(rows))):
                    topics[rows[i : i + len(x)]] = [f"t{j}" for j in centres[lang].likeness(x).argmax(axis=1)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "key", "source", "lang")), pa.array(topics, pa.string()), b.column("tokens")], ["doc_id", "key", *MARGINS, "tokens"])

    return name


def rake(cells: np.ndarray, tokens: np.ndarray, targets: list[np.ndarray], kept: float) -> np.ndarray:
    """Tokens to keep of each cell: at most what it has, with sums over each margin that match targets * kept if the cells allow.

    ``cells`` has a category number for each margin. Weights are scaled in turn, as in
    iterative proportional fitting, by what their capped sums lack.
    """
    u, off = tokens / tokens.sum() * kept, []
    while not settled(off):
        worst = 0.0
        for k, t in enumerate(targets):
            now = np.bincount(cells[:, k], weights=np.minimum(u, tokens), minlength=len(t))
            scale = np.divide(t * kept, now, out=np.ones(len(t)), where=now > 0)
            worst = max(worst, float(np.abs(scale - 1).max(initial=0)))
            u = np.minimum(u * scale[cells[:, k]], tokens * 1e6)
        off.append(worst)
    return np.minimum(u, tokens)


def rake_frame(cells: DataFrame, goals: dict[str, DataFrame], kept: float) -> DataFrame:
    """``rake`` over a frame of cells (the margins, tokens), as grouped sums and joins. goals: margin -> (category, goal)."""
    total = cells.agg(F.sum("tokens")).first()[0]
    now, off = materialize(cells.withColumn("u", F.col("tokens") / F.lit(float(total)) * kept)), []
    while not settled(off):
        before, worst = now, 0.0
        for m in MARGINS:
            have = now.groupBy(m).agg(F.sum(F.least("u", F.col("tokens").cast("double"))).alias("_have")).join(goals[m], m)
            scale = materialize(have.select(m, F.when(F.col("_have") > 0, F.col("goal") * kept / F.col("_have")).otherwise(1.0).alias("_scale")))
            worst = max(worst, scale.agg(F.max(F.abs(F.col("_scale") - 1))).first()[0])
            now = now.join(scale, m).withColumn("u", F.least(F.col("u") * F.col("_scale"), F.col("tokens") * 1e6)).drop("_scale")
        now = materialize(now)
        drop(before)
        off.append(worst)
    return now.select(*MARGINS, "tokens", F.least("u", F.col("tokens").cast("double")).alias("kept"))


def _goals(cells: DataFrame, targets: dict[str, dict[str, float]], power: float = TEMPER) -> dict[str, DataFrame]:
    """A goal for each category of each margin, with sum 1: the caller's, or the tempered token shares."""
    goals = {}
    for m in MARGINS:
        share = cells.groupBy(m).agg(F.sum("tokens").cast("double").alias("t"))
        if targets.get(m):
            named = cells.sparkSession.createDataFrame([(str(k), float(v)) for k, v in targets[m].items()], f"{m} string, raw double")
            share = share.join(named, m, "left").select(m, F.coalesce("raw", F.lit(0.0)).alias("raw"))
        else:
            share = share.select(m, F.pow("t", power).alias("raw"))
        total, n = share.agg(F.sum("raw"), F.count("*")).first()
        goals[m] = share.select(m, (F.col("raw") / total if total else F.lit(1 / max(n, 1))).alias("goal"))
    return goals


def calibrate(cells: DataFrame, targets: dict[str, dict[str, float]], keep: float, in_memory: int = CELLS) -> DataFrame:
    """Cells (margins, tokens > 0) with their inclusion probability."""
    goals = _goals(cells, targets)
    total = cells.agg(F.sum("tokens"), F.count("*")).first()
    if total[1] > in_memory:
        raked = rake_frame(cells, {m: materialize(g) for m, g in goals.items()}, keep * total[0])
        return raked.select(*MARGINS, (F.col("kept") / F.col("tokens")).alias("probability"))
    if not total[1]:
        return cells.select(*MARGINS, F.lit(0.0).alias("probability"))
    found = sorted(tuple(r) for r in cells.select(*MARGINS, "tokens").collect())  # at most in_memory rows of four values
    t = np.array([r[3] for r in found], np.float64)
    columns, want = [], []
    for i, m in enumerate(MARGINS):
        goal = {r[m]: r["goal"] for r in goals[m].collect()}
        place = {k: j for j, k in enumerate(sorted(goal))}
        columns.append(np.array([place[r[i]] for r in found]))
        want.append(np.array([goal[k] for k in sorted(goal)]))
    p = rake(np.column_stack(columns), t, want, keep * t.sum()) / t
    return cells.sparkSession.createDataFrame([(*r[:3], float(x)) for r, x in zip(found, p, strict=True)], ", ".join(f"{m} string" for m in MARGINS) + ", probability double")


def mix(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, keep: float = KEEP, seed: int = SEED, topic: str | None = None, in_memory: int = CELLS) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text, source, lang): labels, tokens, probability and kept.

    ``targets`` gives weights by margin (source, lang, topic) and category; a margin
    without any gets its tempered token shares. Categories of the data that a target
    leaves out get none; those the data lacks are left out. Targets that the tokens
    of a category can't fill are met as far as they go (``achieved`` tells). ``topic``
    names a column of ``docs``. Null labels are ``(none)``, as is the topic of a text
    without longer words. Documents without words have no weight and are kept.
    Repeated rows share their fate. No documents give no rows.
    """
    targets = targets or {}
    label = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("(none)"))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("key"), label("source").alias("source"), label("lang").alias("lang"), (label(topic) if topic else F.lit("(none)")).alias("topic"), F.coalesce("text", F.lit("")).alias("text")
    )
    kind = "doc_id long, key long, source string, lang string, topic string, tokens long"
    measured = materialize(rows.mapInArrow(_measured(topic is None), kind + ", x binary"))
    rows = measured.drop("x")
    if topic is None:
        rows = materialize(measured.mapInArrow(_named(*_fitted(measured)), kind))
        drop(measured)
    cells = materialize(rows.groupBy(*MARGINS).agg(F.sum("tokens").alias("tokens")).where("tokens > 0"))
    table = materialize(calibrate(cells, targets, keep, in_memory))
    if table.count() * 200 <= BROADCAST_BYTES:
        table = F.broadcast(table)
    u = F.pmod(F.xxhash64("doc_id", "key", F.lit(seed)), F.lit(1 << 52)) / F.lit(float(1 << 52))
    out = rows.join(table, list(MARGINS), "left").withColumn("probability", F.when(F.col("tokens") == 0, F.lit(1.0)).otherwise(F.coalesce("probability", F.lit(0.0))))
    return out.select("doc_id", "key", *MARGINS, "tokens", "probability", (u < F.col("probability")).alias("kept"))


def achieved(mixed: DataFrame, targets: dict[str, dict[str, float]] | None = None) -> DataFrame:
    """For each margin and category of what ``mix`` gave: goal, the shares before, expected and kept, and whether the goal was in reach.

    ``feasible`` is false where the tokens at hand leave the expected share more than a
    hundredth of the goal away from it: its own cells, or those that others need, ran out.
    """
    cells = mixed.where("tokens > 0").groupBy(*MARGINS).agg(F.sum("tokens").alias("tokens"), F.sum(F.col("tokens") * F.col("probability")).alias("e"), F.sum(F.when(F.col("kept"), F.col("tokens")).otherwise(0)).alias("k"))
    goals = _goals(cells, targets or {})
    total = [float(x or 1) for x in cells.agg(F.sum("tokens"), F.sum("e"), F.sum("k")).first()]
    parts = []
    for m in MARGINS:
        got = cells.groupBy(m).agg(F.sum("tokens").alias("t"), F.sum("e").alias("e"), F.sum("k").alias("k")).join(goals[m], m)
        parts.append(got.select(F.lit(m).alias("margin"), F.col(m).alias("category"), "goal", (F.col("t") / total[0]).alias("before"), (F.col("e") / total[1]).alias("expected"), (F.col("k") / total[2]).alias("kept")).withColumn("feasible", F.abs(F.col("expected") - F.col("goal")) <= 0.01 * F.col("goal") + 1e-9))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
