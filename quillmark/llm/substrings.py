"""Operator 1, substring dedup by relative Lempel-Ziv parsing.

The reference of a document is all documents with a smaller id, indexed in blocks.
A block is a run of 50-word phrases that share an anchor: the smallest hash among
the 12-word grams of a phrase (winnowing), so equal phrases of any two documents
always lie in blocks of the same anchor. A document's blocks are looked up among
all indexed blocks of their anchors: whole, or phrase by phrase where contents
differ. Each hit names the place in the earliest document that has the words.

The parse is then greedy, from left to right. Hits that go on in one document at one
distance join into matches. The next factor is the match that reaches furthest from
the word reached so far; at the factor's end, where no match may start, those that
straddle the boundary are checked, as each block also carries the 49 words after its
last phrase. Words in no match are literals. Factors come from matches of 50 words
and more, which are the duplicate spans; they cover exactly the words of all such
matches, however documents are split.

Blocks and phrases are told apart by 128 bits of hashes. Only anchors that occur in
two documents go on, as rows of a few numbers. The first place of a block or phrase
is an aggregate with map-side combining, and the joins back are plain equi-joins,
which the adaptive planner can split; no step gathers the members of a group of
copies. Documents shuffle once, by their key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as X
from .common import drop, materialize

PHRASE = 50
GRAM = 12
_SEGMENT = 1 << 17


def anchors(h: np.ndarray, phrase: int = PHRASE, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Blocks of one document: anchor hash, first phrase, number of phrases."""
    out = []
    for i in range(0, len(h) - phrase + 1, _SEGMENT):
        g = X.windows(h[i : i + _SEGMENT + phrase - 1], gram)
        at = X.sliding_argmin(g, phrase - gram + 1)
        first = np.flatnonzero(np.diff(at, prepend=-1))
        out.append((g[at[first]], first + i, np.diff(first, append=len(at))))
    if not out:
        e = np.zeros(0, np.int64)
        return e.astype(X.U64), e, e
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def span_hashes(h: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """A hash for the words of each span; spans ascend and are shorter than a chunk."""
    out = np.empty(len(start), X.U64)
    for i in range(0, len(start), 1024):
        a, n = start[i : i + 1024], length[i : i + 1024]
        j = 0
        while j < len(a):
            m = max(j + 1, int(np.searchsorted(a + n, a[j] + X._CHUNK, "right")))
            seg = h[a[j] : (a[j:m] + n[j:m]).max()]
            total = np.zeros(len(seg) + 1, X.U64)
            np.cumsum(seg * X._POW[: len(seg)], out=total[1:])
            s = a[j:m] - a[j]
            out[i + j : i + m] = X.mix((total[s + n[j:m]] - total[s]) * X._INV[s] + n[j:m].astype(X.U64))
            j = m
    return out


def second(h: np.ndarray) -> np.ndarray:
    """Other hashes of the words, for the second half of 128-bit keys."""
    return X.mix(h ^ X.U64(0xD6E8FEB86659FD93))


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _emit_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        buf, off, _ = X.slices(b.column("text"))
        found = [np.unique(anchors(X.word_hashes(buf[off[i] : off[i + 1]])[0])[0]) for i in range(len(b))]
        n = np.array([len(x) for x in found], np.int64)
        ids = np.repeat(b.column("doc_id").to_numpy(zero_copy_only=False), n)
        yield pa.RecordBatch.from_arrays([_signed(np.concatenate([*found, np.zeros(0, X.U64)])), pa.array(ids, pa.int64())], ["anchor", "doc_id"])


def _emit_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        buf, off, _ = X.slices(b.column("text"))
        cols: list[list[np.ndarray]] = [[], [], [], [], []]
        for i in range(len(b)):
            h = X.word_hashes(buf[off[i] : off[i + 1]])[0]
            a, s, n = anchors(h)
            for c, x in zip(cols, (a, span_hashes(h, s, n + PHRASE - 1), span_hashes(second(h), s, n + PHRASE - 1), s, n), strict=True):
                c.append(x)
        many = np.array([len(x) for x in cols[0]], np.int64)
        a, k, k2, s, n = (np.concatenate([*c, c[0][:0]]) if c else np.zeros(0, np.int64) for c in cols)
        ids, keys = (np.repeat(b.column(c).to_numpy(zero_copy_only=False), many) for c in ("doc_id", "key"))
        yield pa.RecordBatch.from_arrays(
            [*(_signed(x.astype(X.U64)) for x in (a, k, k2)), pa.array(ids, pa.int64()), pa.array(keys, pa.int32()), pa.array(s, pa.int32()), pa.array(n, pa.int32())],
            ["anchor", "block", "block2", "doc_id", "key", "start", "n"],
        )


def _spans(cell: list[dict]) -> tuple[np.ndarray, np.ndarray]:
    return np.array([x["start"] for x in cell], np.int64), np.array([x["n"] for x in cell], np.int64)


def _emit_phrases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        buf, off, _ = X.slices(b.column("text"))
        at, ids, keys = [], b.column("doc_id").to_numpy(), b.column("key").to_numpy()
        got, got2, who = [], [], []
        for i, cell in enumerate(b.column("spans").to_pylist()):
            h = X.word_hashes(buf[off[i] : off[i + 1]])[0]
            s, n = _spans(cell)
            p = np.unique(np.concatenate([np.arange(a, a + m) for a, m in zip(s, n, strict=True)]))
            got.append(X.windows(h, PHRASE)[p])
            got2.append(X.windows(second(h), PHRASE)[p])
            at.append(p)
            who.append(np.full(len(p), i))
        w = np.concatenate(who) if who else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays(
            [*(_signed(np.concatenate([*x, np.zeros(0, X.U64)])) for x in (got, got2)), pa.array(ids[w], pa.int64()), pa.array(keys[w], pa.int32()), pa.array(np.concatenate([*at, np.zeros(0, np.int64)]), pa.int32())],
            ["phrase", "phrase2", "doc_id", "key", "start"],
        )


def matches(hits: np.ndarray) -> np.ndarray:
    """Hits (start, phrases, reference document, its key, place there) joined where they go on at one distance; ends in words."""
    if not len(hits):
        return np.zeros((0, 5), np.int64)
    h = np.column_stack([hits[:, 0], hits[:, 0] + hits[:, 1] + PHRASE - 1, hits[:, 2:]])
    away = h[:, 4] - h[:, 0]
    order = np.lexsort((h[:, 0], away, h[:, 3], h[:, 2]))
    h, away = h[order], away[order]
    new = np.append(True, (np.diff(h[:, 2]) != 0) | (np.diff(h[:, 3]) != 0) | (np.diff(away) != 0) | (h[1:, 0] > h[:-1, 1] - PHRASE + 1))
    first = np.flatnonzero(new)
    out = h[first]
    out[:, 1] = np.maximum.reduceat(h[:, 1], first)
    return out


def factors(hits: np.ndarray) -> list[tuple[int, int, int, int]]:
    """The greedy parse: factors (start, words, reference document, place there) in order; what lies between are literals.

    A factor begins at the word reached, or before it if its match straddles that boundary.
    """
    m = matches(hits)
    m = m[np.lexsort((m[:, 2], -m[:, 1], m[:, 0]))]
    out: list[tuple[int, int, int, int]] = []
    at, i, best = 0, 0, None
    while True:
        while i < len(m) and m[i, 0] <= at:
            if best is None or m[i, 1] > best[1]:
                best = m[i]
            i += 1
        if best is not None and best[1] > at:
            start = min(at, int(best[1]) - PHRASE)  # the last phrase may straddle the boundary
            start = max(start, int(best[0]))
            out.append((start, int(best[1]) - start, int(best[2]), int(best[4]) + start - int(best[0])))
            at = int(best[1])
        elif i < len(m):
            at, best = int(m[i, 0]), None
        else:
            return out


def covered(parse: list[tuple[int, int, int, int]], n_words: int) -> np.ndarray:
    """Which words lie in factors."""
    step = np.zeros(n_words + 1, np.int64)
    for start, n, *_ in parse:
        step[start] += 1
        step[min(start + n, n_words)] -= 1
    return np.cumsum(step[:-1]) > 0


def cut(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, gone: np.ndarray, joined: bool) -> bytes:
    """The text without the gone words. joined: words joined by one space, else with their own white space."""
    data = raw.tobytes()
    if joined:
        return b" ".join([data[s:e] for s, e in zip(starts[~gone], ends[~gone], strict=True)])
    if not gone.any():
        return data
    edge = np.diff(gone.astype(np.int8), prepend=0, append=0)
    out, at = [], 0
    for a, z in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True):
        out.append(data[at : starts[a]])
        at = starts[z] if z < len(starts) else len(data)
    return b"".join([*out, data[at:]])


_FACTORS = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "words", "ref_doc_id", "ref_start")]))


def _parser(joined: bool):
    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            buf, off, valid = X.slices(b.column("text"))
            total, lost, texts, parses = [], [], [], []
            for i, cell in enumerate(b.column("spans").to_pylist()):
                raw = buf[off[i] : off[i + 1]]
                starts, ends = X.bounds(raw)
                parse_ = factors(np.array([tuple(x.values()) for x in cell or []], np.int64).reshape(-1, 5))
                gone = covered(parse_, len(starts))
                parses.append([dict(zip(("start", "words", "ref_doc_id", "ref_start"), f, strict=True)) for f in parse_])
                total.append(len(starts))
                lost.append(int(gone.sum()))
                texts.append(cut(raw, starts, ends, gone, joined) if valid[i] or joined else None)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("key"), pa.array(total, pa.int64()), pa.array(lost, pa.int64()), pa.array(texts, pa.binary()).cast(pa.string()), pa.array(parses, _FACTORS)],
                ["doc_id", "key", "n_words", "n_removed", "kept", "factors"],
            )

    return parse


def duplicate_spans(docs: DataFrame) -> DataFrame:
    """Hits (doc_id, key, start, n, d0, k0, s0): n phrases from word start on are those from word s0 on of the earlier document (d0, k0).

    ``docs`` has doc_id, key and text. Hits of one document may overlap.
    """
    known = docs.where("doc_id IS NOT NULL AND text IS NOT NULL")
    shared = known.mapInArrow(_emit_anchors, "anchor long, doc_id long").groupBy("anchor").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("z")).where("a < z").select("anchor")
    shared = materialize(shared)  # so that both sides of the join are exchanged for it, and a hot anchor can be split
    blocks = known.mapInArrow(_emit_blocks, "anchor long, block long, block2 long, doc_id long, key int, start int, n int")
    blocks = materialize(blocks.join(shared, "anchor"))
    place = F.min(F.struct("doc_id", "key", "start")).alias("r")
    at = (F.col("r.doc_id").alias("d0"), F.col("r.key").alias("k0"), F.col("r.start").alias("s0"))
    first = materialize(blocks.groupBy("anchor", "block", "block2").agg(place).select("anchor", "block", "block2", *at))
    tied = materialize(blocks.join(first, ["anchor", "block", "block2"]).select("anchor", "doc_id", "key", "start", "n", "d0", "k0", "s0", (F.col("doc_id") > F.col("d0")).alias("again")))
    whole = tied.where("again").select("doc_id", "key", "start", "n", "d0", "k0", "s0")
    mixed = materialize(first.groupBy("anchor").agg(F.count("*").alias("c")).where("c > 1").select("anchor"))
    drop(shared, blocks, first)
    # every occurrence in the block's first document: a phrase of each may be in an earlier block of other content
    finer = tied.where("NOT again").join(mixed, "anchor").groupBy("doc_id", "key").agg(F.collect_list(F.struct("start", "n")).alias("spans"))
    phrases = materialize(docs.join(finer, ["doc_id", "key"]).mapInArrow(_emit_phrases, "phrase long, phrase2 long, doc_id long, key int, start int"))
    again = phrases.groupBy("phrase", "phrase2").agg(place, F.max("doc_id").alias("d1")).where("r.doc_id < d1").select("phrase", "phrase2", *at)
    again = materialize(again)
    parts = phrases.join(again, ["phrase", "phrase2"]).where("doc_id > d0").select("doc_id", "key", "start", F.lit(1).alias("n"), "d0", "k0", "s0")
    return whole.unionByName(parts)


def substring_dedup(docs: DataFrame, joined: bool = False) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): doc_id, key, n_words, n_removed, kept, factors.

    ``kept`` is the text without the words of duplicate spans, with its own white
    space, or with joined=True its words joined by one space. ``factors`` is the
    parse: first word and number of words of each factor, and where its words are in
    an earlier document. A null text has no words; its ``kept`` is null ("" if
    joined). A null id is neither reference nor duplicate. Rows with one id are no
    reference for each other. ``key`` tells apart different texts under one id. No
    documents give no rows. Other columns are ignored, whatever their names.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.hash(F.coalesce("text", F.lit(""))).alias("key"), "text")
    spans = duplicate_spans(docs).groupBy("doc_id", "key").agg(F.collect_set(F.struct("start", "n", "d0", "k0", "s0")).alias("spans"))
    rows = docs.join(spans, ["doc_id", "key"], "left")
    return rows.mapInArrow(_parser(joined), "doc_id long, key int, n_words long, n_removed long, kept string, factors array<struct<start:long,words:long,ref_doc_id:long,ref_start:long>>")
