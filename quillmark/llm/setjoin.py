"""Operator 9, n-gram Jaccard join by a size-aware heavy-light split (after Deng, Tao and Li 2018).

Documents become sets of five-word shingles; equal sets are one class. Sets of at
most ``x`` shingles are light: they enumerate their subsets of each size that two
similar sets must share. Larger sets are heavy: they scan inverted lists of their
prefixes, rarest shingles first. ``x`` is the boundary of the least cost, from the
sizes of all sets and the mean length of the lists.

The shingle order comes from a count-min sketch of fixed size over all documents;
it decides only which lists are scanned, never which links are found.

Links are found whole, but copies are never multiplied out:

1. In each list every set is tried against one centre, the set with the most
   common shingles. Positions in the prefixes bound the overlap from above and a
   parity bitmap bounds the symmetric difference from below, so most false pairs
   end there; the best pair of a set is verified on the sets. A list that the
   sketch expects to be long is dealt into salted parts with a centre each; the
   centres are tried against that of one part.
2. The other pairs with centres, and lists whose other sets lie in several
   components, go through the same bounds, across components only. Long lists are
   compared in blocks of bounded size; blocks of the list's largest component meet
   the others' blocks only, not each other. What passes is verified.

Sets in one component after step 1 need no further links between them. All
members of a list within one component cost nothing.

Shingles are 64-bit hashes and equal sets are known by one 64-bit hash of all of
theirs: among 10**9 different sets one pair in forty runs would be taken as equal.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as X
from .common import BROADCAST_BYTES, drop, materialize
from .components import components

SHINGLE = 5
#: Counters of the sketch, in blocks of 2**14.
_COUNTERS, _BLOCK = 1 << 20, 1 << 14
_BITS = 1024
#: Sets of more shingles are never light: their subsets are too many.
_MAX_LIGHT = 12
#: Sets in one block of a list.
_LIST_BLOCK = 512
#: Lists that the sketch expects to be longer are salted into parts of about so many sets.
_LIST_PART = 2048
#: The low bits of a list's name tell its parts apart, 0 for a whole list.
_PART_BITS = (1 << 12) - 1


def required(a: np.ndarray | int, b: np.ndarray | int):
    """The least overlap of sets of a and b items whose Jaccard similarity is 0.75."""
    return -(-3 * (a + b) // 7)


def least_share(n):
    """The least overlap of a set of n items with any similar one."""
    return -(-3 * n // 4)


def light_sizes(n: int, x: int) -> list[int]:
    """Sizes of the subsets that a light set of n items enumerates, given the boundary x."""
    return sorted({least_share(m) for m in range(n, min(x, 4 * n // 3) + 1)})


def boundary(sizes: dict[int, int], list_length: float) -> int:
    """The size up to which enumerating subsets costs less than scanning lists, over all sets."""

    def cost(x: int) -> float:
        total = 0.0
        for n, count in sizes.items():
            if n <= x:
                total += count * sum(comb(n, c) for c in light_sizes(n, x))
            if 4 * n >= 3 * (x + 1):
                total += count * (n - least_share(n) + 1) * (1 + list_length)
        return total

    return min(range(_MAX_LIGHT + 1), key=lambda x: (cost(x), x))


def _set_hash(s: np.ndarray) -> int:
    total = (int(s.sum(dtype=X.U64)) + len(s) * 0x9E3779B97F4A7C15) & (1 << 64) - 1
    return int(X.mix(np.array([total], X.U64)).view(np.int64)[0])


def _bitmap(s: np.ndarray) -> bytes:
    return np.packbits((np.bincount((s >> X.U64(54)).astype(np.int64), minlength=_BITS) & 1).astype(bool)).tobytes()


def _texts(b: pa.RecordBatch) -> Iterator[np.ndarray]:
    buf, off, _ = X.slices(b.column("text"))
    for i in range(len(b)):
        yield X.shingles(X.word_hashes(buf[off[i] : off[i + 1]], lower=True)[0], SHINGLE)


class _Seen:
    """Sets that this task has had lately; forgetting one only costs work."""

    def __init__(self) -> None:
        self.got: set[int] = set()

    def new(self, k: int) -> bool:
        if k in self.got:
            return False
        if len(self.got) > 500_000:
            self.got.clear()
        self.got.add(k)
        return True


_DESCRIBED = "doc_id long, key int, set_hash long, n long, bits binary"


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each document; at the end one for each block of this task's sketch (n = -1)."""
    names = ["doc_id", "key", "set_hash", "n", "bits"]
    sketch, seen = np.zeros(_COUNTERS, np.int64), _Seen()
    for b in batches:
        hashes, sizes, bits = [], [], []
        for s in _texts(b):
            k = _set_hash(s)
            hashes.append(k)
            sizes.append(len(s))
            if len(s) and seen.new(k):
                np.add.at(sketch, (s & X.U64(_COUNTERS - 1)).astype(np.int64), 1)
                bits.append(_bitmap(s))
            else:
                bits.append(None)
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("key"), pa.array(hashes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(bits, pa.binary())], names)
    used = [i for i in range(_COUNTERS // _BLOCK) if sketch[i * _BLOCK : (i + 1) * _BLOCK].any()]
    packed = [zlib.compress(sketch[i * _BLOCK : (i + 1) * _BLOCK].tobytes(), 1) for i in used]
    none = [None] * len(used)
    yield pa.RecordBatch.from_arrays([pa.array(none, pa.int64()), pa.array(none, pa.int32()), pa.array(used, pa.int64()), pa.array([-1] * len(used), pa.int64()), pa.array(packed, pa.binary())], names)


def _sum_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for b in batches:
        for k, x in zip(b.column("set_hash").to_pylist(), b.column("bits").to_pylist(), strict=True):
            total[k] = total.get(k, 0) + np.frombuffer(zlib.decompress(x), np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array([zlib.compress(x.tobytes(), 1) for x in total.values()], pa.binary())], ["set_hash", "bits"])


def _levels(described: DataFrame) -> tuple[np.ndarray, float]:
    """The sketch as one byte for each counter (a logarithm), and the mean length of a shingle's list."""
    rows = described.where("n < 0").select("set_hash", "bits").repartition(16, "set_hash").mapInArrow(_sum_blocks, "set_hash long, bits binary").collect()
    counts = np.zeros(_COUNTERS, np.int64)
    for k, x in rows:
        counts[k * _BLOCK : (k + 1) * _BLOCK] = np.frombuffer(zlib.decompress(x), np.int64)
    return np.minimum(4 * np.log2(1 + counts.astype(np.float64)), 255).astype(np.uint8), mean_list(counts)


def mean_list(counts: np.ndarray) -> float:
    """The mean length of the list that a shingle of a set is in, from the sketch: squares of lengths over lengths.

    Shingles that share a counter add products of their lengths to its square; on
    average these are what even counters would hold, which is taken off.
    """
    f = counts.astype(np.float64)
    total = f.sum()
    squares = ((f * f).sum() - total * total / len(f)) / (1 - 1 / len(f))
    return float(max(squares, total) / total) if total else 1.0


def _poster(levels: np.ndarray, x: int, part: int = _LIST_PART):
    """Rows (token, s, rank, at) of each set: its lists, or its parts of them."""
    part_count = np.minimum(np.ceil(np.maximum(np.exp2(np.arange(256) / 4) - 1, 1) / part), _PART_BITS).astype(X.U64)

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = _Seen()
        for b in batches:
            tokens, owners, places = [], [], []
            for s in _texts(b):
                n = len(s)
                if not n or not seen.new(k := _set_hash(s)):
                    continue
                level = levels[(s & X.U64(_COUNTERS - 1)).astype(np.int64)]
                got, pos, parts = [], [], []
                if 4 * n >= 3 * (x + 1):
                    p = n - least_share(n) + 1
                    order = np.lexsort((s, level))[:p]
                    got.append(s[order])
                    pos.append(np.arange(p))
                    parts.append(level[order])
                if n <= x:
                    for c in light_sizes(n, x):
                        which = np.array(list(combinations(range(n), c)), np.int64)
                        sub = s[which]
                        parts.append(level[which].min(axis=1))  # a subset is no more frequent than its rarest shingle
                        got.append(X.mix(sub.sum(axis=1, dtype=X.U64) + X.U64(c * 0x632BE59BD9B4E019 & (1 << 64) - 1)))
                        pos.append(np.zeros(len(sub), np.int64))
                t = np.concatenate(got)
                n_parts = part_count[np.concatenate(parts)]
                mine = X.mix(np.full(1, k, np.int64).view(X.U64)) % n_parts + X.U64(1)
                tokens.append(t & ~X.U64(_PART_BITS) | np.where(n_parts > 1, mine, X.U64(0)))
                places.append(np.concatenate(pos))
                owners.append((k, n, -int(1000 * level.mean()), len(t)))
            o = np.array(owners, np.int64).reshape(-1, 4)
            s, n, rank = (np.repeat(o[:, i], o[:, 3]) for i in range(3))
            at = n << 32 | np.concatenate([*places, np.zeros(0, np.int64)])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([*tokens, np.zeros(0, X.U64)]).view(np.int64)), pa.array(s), pa.array(rank), pa.array(at)], ["token", "s", "rank", "at"])

    return post


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by token and rank: those of lists with two sets or more, but the first (the centre), each with the centre.

    Of a salted part the centre comes as well. ``alone`` marks the only other set of
    a whole list. Between batches only the centre, the last set and a row not yet
    known to be alone are kept.
    """
    names = ["token", "s", "n", "pos", "c", "cn", "cpos", "alone"]
    centre, last_s, wait, sent = None, None, None, 0  # of the open list: first row, last s, the row held back, rows sent

    def batch(rows: np.ndarray, c: np.ndarray, alone: np.ndarray) -> pa.RecordBatch:
        part = lambda x: (x >> 32, x & 0xFFFFFFFF)
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (rows[0], rows[1], *part(rows[2]), c[1], *part(c[2]), alone & (rows[0] & _PART_BITS == 0))], names)

    for b in batches:
        if not len(b):
            continue
        rows = np.stack([b.column(k).to_numpy() for k in ("token", "s", "at")])
        prev = np.append(rows[1][0] if centre is None else last_s, rows[1][:-1])
        if centre is not None:
            rows, prev = np.column_stack([centre, rows]), np.append(centre[1], prev)
        t, s = rows[0], rows[1]
        starts = np.append(True, t[1:] != t[:-1])
        first = np.flatnonzero(starts)
        which = np.cumsum(starts) - 1  # the list of each row
        starts[0] &= centre is None  # sent already
        send = np.flatnonzero((s != s[first[which]]) & np.append(False, t[1:] == t[:-1]) & (s != prev) | starts & (t & _PART_BITS != 0))
        got, c, group = rows[:, send], rows[:, first[which[send]]], which[send]
        if wait is not None:
            got, c, group = np.column_stack([wait, got]), np.column_stack([rows[:, 0], c]), np.append(0, group)
        many = np.bincount(group, minlength=len(first))
        if centre is not None:
            many[0] += sent
        open_ = len(first) - 1
        sent = (sent if open_ == 0 and centre is not None else 0) + int(np.count_nonzero(group == open_))
        hold = (group == open_) & (many[open_] == 1)
        wait = got[:, hold] if hold.any() else None
        sent -= int(hold.sum())
        centre, last_s = rows[:, first[-1]], s[-1] if len(t) > 1 or last_s is None else last_s
        yield batch(got[:, ~hold], c[:, ~hold], many[group[~hold]] == 1)
    if wait is not None:
        yield batch(wait, centre.reshape(-1, 1), np.ones(1, bool))


def _near(a_bits: list[bytes], b_bits: list[bytes], a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether pairs can be similar, by their bitmaps; and the distance of the bitmaps."""
    as_words = lambda x: np.frombuffer(b"".join(x), X.U64).reshape(-1, _BITS // 64)
    d = np.bitwise_count(as_words(a_bits) ^ as_words(b_bits)).sum(axis=1, dtype=np.int64)
    return d <= a + b - 2 * required(a, b), d


def _sieve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        s, c, n, cn = (b.column(k).to_numpy() for k in ("s", "c", "n", "cn"))
        ok, d = _near(b.column("bits").to_pylist(), b.column("cbits").to_pylist(), n, cn)
        yield pa.RecordBatch.from_arrays([pa.array(x[ok]) for x in (s, c, d)], ["s", "c", "d"])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (token, i, j): pairs across components that can be similar, in one block pair at a time."""
    rest = None
    for b in _closed(batches):
        whole = pa.Table.from_batches([b] if rest is None else [rest, b]).combine_chunks()
        t, i, j = (whole.column(c).to_numpy() for c in ("token", "i", "j"))
        cut = np.flatnonzero((np.diff(t) != 0) | (np.diff(i) != 0) | (np.diff(j) != 0)) + 1 if len(t) else np.zeros(0, np.int64)
        edges = np.concatenate([[0], cut, [len(t)]]) if not len(b) else np.concatenate([[0], cut])
        done = int(edges[-1])
        batches_left = whole.slice(done).combine_chunks().to_batches()
        rest = batches_left[0] if batches_left else None
        if not done:
            continue
        s, n, pos, comp, block = (whole.column(c).to_numpy() for c in ("s", "n", "pos", "comp", "block"))
        bits = np.frombuffer(b"".join(whole.column("bits").slice(0, done).to_pylist()), X.U64).reshape(-1, _BITS // 64)
        left, right = [], []
        for a, z in zip(edges[:-1], edges[1:], strict=True):
            for r in range(a, z):
                q = slice(r + 1, z)
                ok = comp[q] != comp[r]
                if i[r] != j[r]:
                    ok &= block[q] != block[r]
                if not ok.any():
                    continue
                k = np.flatnonzero(ok) + r + 1
                most = 3 * (n[k] + n[r])
                k = k[(7 * (n[k] - pos[k]) >= most) & (7 * (n[r] - pos[r]) >= most)]
                d = np.bitwise_count(bits[k] ^ bits[r]).sum(axis=1, dtype=np.int64)
                k = k[d <= n[k] + n[r] - 2 * required(n[k], n[r])]
                left.append(np.full(len(k), s[r]))
                right.append(s[k])
        none = np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([*left, none])), pa.array(np.concatenate([*right, none]))], ["s", "c"])


def _closed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches that have rows, then an empty one that ends the last group."""
    b = None
    for b in batches:
        if len(b):
            yield b
    if b is not None:
        yield b.slice(0, 0)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The set of each document with the pair that it is for; a document's pairs come one after another."""
    last, packed = None, b""
    for b in batches:
        buf, off, _ = X.slices(b.column("text"))
        sets = []
        for i, k in enumerate(b.column("_k").to_pylist()):
            if k != last:
                last, packed = k, X.shingles(X.word_hashes(buf[off[i] : off[i + 1]], lower=True)[0], SHINGLE).astype("<u8").tobytes()
            sets.append(packed)
        yield pa.RecordBatch.from_arrays([b.column("s"), b.column("c"), pa.array(sets, pa.binary())], ["s", "c", "set"])


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ok = []
        for x, y in zip(b.column("set"), b.column("cset"), strict=True):
            p, q = np.frombuffer(x.as_py(), "<u8"), np.frombuffer(y.as_py(), "<u8")
            both = np.sort(np.concatenate([p, q]))
            ok.append(np.count_nonzero(both[1:] == both[:-1]) >= required(len(p), len(q)))
        yield pa.RecordBatch.from_arrays([b.column("s"), b.column("c")], ["a", "b"]).filter(pa.array(ok, pa.bool_()))


def _verified(pairs: DataFrame, docs: DataFrame, classes: DataFrame) -> DataFrame:
    """Links (a, b) among the pairs (s, c) of classes, by the shingles of one document of each class.

    The pairs find their documents first, so that a set goes straight to where it is
    compared: those of s and, once, that of each c are exchanged by c.
    """
    pairs = materialize(pairs.select("s", "c"))
    both = pairs.unionByName(pairs.select(F.col("c").alias("s"), "c").distinct())
    need = materialize(both.join(classes.select("s", F.xxhash64("doc_id", "key").alias("_k")), "s"))
    side = F.broadcast(need) if need.count() * 64 <= BROADCAST_BYTES else need
    sets = materialize(docs.withColumn("_k", F.xxhash64("doc_id", "key")).join(side, "_k").select("_k", "s", "c", "text").mapInArrow(_pack, "s long, c long, set binary"))
    centre = sets.where("s = c").select("c", F.col("set").alias("cset"))
    links = materialize(sets.where("s <> c").join(centre, "c").mapInArrow(_verify, "a long, b long"))
    drop(pairs, need, sets)
    return links


def _cells(placed: DataFrame, block: int) -> DataFrame:
    """Rows (token, s, n, pos, comp) of lists with several components, dealt into cells (token, i, j) to be compared in.

    A list of up to ``block`` sets is one cell. Of a longer one the sets outside its
    largest component are dealt into blocks 0 to nb - 1 by hash, those inside it into
    blocks from nb on. Each pair of the former is a cell, a block with itself too, and
    each pair of one of the former with one of the latter.
    """
    lists = materialize(placed.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("many")).where("lo <> hi").select("token", "many"))
    rows = placed.join(lists, "token")
    zero = F.lit(0).cast("long")
    short = rows.where(F.col("many") <= block).select("token", zero.alias("i"), zero.alias("j"), "s", "n", "pos", "comp", zero.alias("block"))
    long_ = rows.where(F.col("many") > block)
    parts = long_.groupBy("token", "comp").count().groupBy("token").agg(F.max(F.struct("count", "comp")).alias("top"), F.sum("count").alias("all"))
    parts = materialize(parts.select("token", F.col("top.comp").alias("main"), F.ceil((F.col("all") - F.col("top.count")) / block).alias("nb"), F.ceil(F.col("top.count") / block).alias("nm")))
    inside = F.col("comp") == F.col("main")
    own = F.when(inside, F.col("nb") + F.pmod(F.xxhash64("s"), "nm")).otherwise(F.pmod(F.xxhash64("s"), "nb"))
    dealt = long_.join(parts, "token").withColumn("block", own).withColumn("o", F.explode(F.sequence(zero, F.when(inside, F.col("nb")).otherwise(F.col("nb") + F.col("nm")) - 1)))
    return short.unionByName(dealt.select("token", F.least("block", "o").alias("i"), F.greatest("block", "o").alias("j"), "s", "n", "pos", "comp", "block"))


def similar_documents(docs: DataFrame, list_part: int = _LIST_PART, list_block: int = _LIST_BLOCK) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): doc_id, key, n_shingles, component_id.

    ``component_id`` is the smallest doc_id that links lead to, itself included.
    Documents without words (null, empty or blank) have no shingles and no links;
    their component is their own id. Null ids stay null; such a row gets the
    component of its class or links, null if that has no id. Repeated rows are
    members of one class. ``key`` tells apart texts under one id. No documents give
    no rows. Other columns are ignored, whatever their names.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.hash(F.coalesce("text", F.lit(""))).alias("key"), "text")
    described = materialize(docs.mapInArrow(_describe, _DESCRIBED))
    members = described.where("n >= 0")
    full = members.where("n > 0").withColumnRenamed("set_hash", "s")
    classes = materialize(full.groupBy("s").agg(F.min(F.struct("doc_id", "key")).alias("r"), F.min("doc_id").alias("least"), F.first("n").alias("n"), F.max("bits").alias("bits")).select("s", "r.*", "least", "n", "bits"))
    levels, list_length = _levels(described)
    sizes = {r["n"]: r["count"] for r in classes.where(F.col("n") <= 4 * _MAX_LIGHT).groupBy("n").count().collect()}
    x = boundary(sizes, list_length)
    posted = docs.mapInArrow(_poster(levels, x, list_part), "token long, s long, rank long, at long")
    lists = materialize(posted.repartition("token").sortWithinPartitions("token", "rank", "s").mapInArrow(_shared, "token long, s long, n long, pos long, c long, cn long, cpos long, alone boolean"))

    # The first item that two similar sets share stands early in both: no later than the overlap they need allows.
    bits = classes.select("s", "bits")
    of = F.col("token").bitwiseAND(~_PART_BITS)
    centres = lists.where((F.col("token") != of) & (F.col("s") == F.col("c"))).withColumn("of", of)
    lead = materialize(centres.groupBy("of").agg(F.min(F.struct("token", "s", "n", "pos")).alias("r")).select("of", F.col("r.s").alias("c"), F.col("r.n").alias("cn"), F.col("r.pos").alias("cpos")))
    tried = lists.select("s", "n", "pos", "c", "cn", "cpos").unionByName(centres.select("of", "s", "n", "pos").join(lead, "of").drop("of"))
    tried = tried.where("s <> c AND 7 * (n - pos) >= 3 * (n + cn) AND 7 * (cn - cpos) >= 3 * (n + cn)").select("s", "n", "c", "cn").distinct()
    near = materialize(tried.join(bits, "s").join(bits.select(F.col("s").alias("c"), F.col("bits").alias("cbits")), "c").mapInArrow(_sieve, "s long, c long, d long"))
    best = materialize(near.groupBy("s").agg(F.min(F.struct("d", "c")).alias("r")).select("s", "r.c"))
    links = _verified(best, docs, classes)
    first = materialize(components(links))

    at = first.withColumnRenamed("node", "s")
    rest = near.join(best, ["s", "c"], "left_anti").join(at, "s", "left").withColumn("comp", F.coalesce("component", "s")).select("s", "c", "comp")
    rest = rest.join(at.select(F.col("s").alias("c"), F.col("component").alias("ccomp")), "c", "left").where(F.col("comp") != F.coalesce("ccomp", "c")).select("s", "c")
    # Each set was tried against its list's centre; what is left are the others of a list among themselves.
    placed = materialize(lists.where("NOT alone").join(at, "s", "left").select(of.alias("token"), "s", "n", "pos", F.coalesce("component", "s").alias("comp")))
    drop(lists, lead, links)
    cells = _cells(placed, list_block).join(bits, "s")
    more = cells.repartition("token", "i", "j").sortWithinPartitions("token", "i", "j", "s").mapInArrow(_blocks, "s long, c long")
    more = materialize(more.unionByName(rest).select(F.least("s", "c").alias("s"), F.greatest("s", "c").alias("c")).distinct())
    drop(near, best, placed)
    links = _verified(more, docs, classes).unionByName(first.select(F.col("node").alias("a"), F.col("component").alias("b")))

    found = materialize(components(links).withColumnRenamed("node", "s"))
    ids = materialize(found.join(classes.select("s", "least"), "s").groupBy("component").agg(F.min("least").alias("component_id")))
    led = found.join(ids, "component").select("s", "component_id", F.lit(True).alias("led"))
    named = classes.select("s", "least").join(led, "s", "left").select("s", F.when(F.col("led"), F.col("component_id")).otherwise(F.col("least")).alias("component_id"))
    named = materialize(named)  # so that both sides of the next join are exchanged for it, and a hot class can be split
    drop(classes, first, found, ids, more)
    out = members.withColumnRenamed("set_hash", "s").join(named, "s", "left")
    return out.select("doc_id", "key", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
