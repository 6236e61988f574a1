"""Operator 2, best-fit packing by length patterns and non-negative least squares (after Krell et al. 2021).

Tokenised documents become pieces of at most 2048 tokens. The driver sees only
the histogram of piece lengths (at most 2048 numbers). It enumerates patterns of
up to three length classes that fill a sequence, fits their repeat counts to the
histogram by non-negative least squares, rounds them down, spells the classes out
in exact lengths that fill a sequence to the last token, and packs the residual
lengths best-fit. The result is a table of slots, whose size depends on 2048 alone.

Pieces then get a rank among those of their length (counted within salted buckets,
so that one hot length is spread) and look their slot up by that rank. No task
holds the pieces of a sequence or of a length.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import materialize, text_key

CAPACITY = 2048
#: Lengths of one class in the fit round to the same multiple of this.
CLASS = 16
#: Rows of one rank bucket, about.
BUCKET_ROWS = 20_000

Entry = tuple[tuple[tuple[int, int], ...], int]  # ((length, copies), ...) of a sequence, and how many such sequences


def patterns(classes: np.ndarray, top: int) -> np.ndarray:
    """Sorted class triples (0 for none) that sum to top, from the classes that occur."""
    has = np.zeros(top + 1, bool)
    has[classes] = True
    a, b = np.meshgrid(np.arange(top + 1), np.arange(top + 1), indexing="ij")
    c = top - a - b
    ok = (a <= b) & (b <= c) & (c > 0)
    ok &= (has[a] | (a == 0)) & (has[b] | (b == 0)) & has[np.clip(c, 0, top)]
    return np.column_stack([a[ok], b[ok], c[ok]])


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 600) -> np.ndarray:
    """min |ax - b| over x >= 0, by the active set method of Lawson and Hanson."""
    x, used = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    for _ in range(rounds):
        slope = a.T @ (b - a @ x)
        slope[used] = -np.inf
        k = int(np.argmax(slope))
        if slope[k] <= 1e-9 * max(1.0, float(np.abs(b).max(initial=0))):
            break
        used[k] = True
        while True:
            cols = np.flatnonzero(used)
            p = a[:, cols]
            y = np.linalg.solve(p.T @ p + 1e-9 * np.eye(len(cols)), p.T @ b)
            if (y > 0).all():
                break
            low = y <= 0
            step = (x[cols][low] / np.maximum(x[cols][low] - y[low], 1e-300)).min()
            x[cols] += step * (y - x[cols])
            used[cols[x[cols] <= 1e-12]] = False
            x[~used] = 0
        x[:] = 0
        x[cols] = y
    return x


def _spell(klasses: list[int], many: int, left: np.ndarray, capacity: int) -> Iterator[tuple[list[int], int]]:
    """Exact lengths, one of each class, that fill a sequence to the last token; takes them from left."""
    span = lambda k: range(min(k * CLASS + CLASS // 2 - 1, len(left) - 1), max(0, k * CLASS - CLASS // 2 - 1), -1)
    *heads, tail = klasses
    for head in product(*map(span, heads)):
        last = capacity - sum(head)
        if last not in span(tail):
            continue
        items = [*head, last]
        k = min(many, *(int(left[n]) // items.count(n) for n in items))
        if k > 0:
            for n in items:
                left[n] -= k
            many -= k
            yield items, k
            if not many:
                return


def plan(counts: np.ndarray, capacity: int = CAPACITY) -> list[Entry]:
    """How to pack counts[n] pieces of each length n: patterns of exact lengths and their repeats."""
    lengths, top = counts.astype(np.int64).copy(), capacity // CLASS
    coarse = np.bincount((np.arange(len(counts)) + CLASS // 2) // CLASS, weights=counts, minlength=top + 1)[: top + 1]
    gaps: dict[int, list[list]] = defaultdict(list)  # gap -> [lengths, repeats]
    open_: list[int] = []

    def put(items: tuple[tuple[int, int], ...], gap: int, many: int) -> None:
        if not gaps[gap]:
            insort(open_, gap)
        gaps[gap].append([items, many])

    pats = patterns(np.flatnonzero(coarse[1:]) + 1, top)
    if len(pats):
        a = np.zeros((top, len(pats)))
        for col in range(3):
            some = np.flatnonzero(pats[:, col])
            np.add.at(a, (pats[some, col] - 1, some), 1)
        weight = np.sqrt(np.arange(1, top + 1) / top)  # long pieces are the hardest to place later
        x = nnls(a * weight[:, None], coarse[1:] * weight)
        for k in np.argsort(-x, kind="stable"):
            many = int(np.floor(x[k] + 1e-6))
            if many < 1:
                break
            for items, m in _spell([int(c) for c in pats[k] if c], many, lengths, capacity):
                put(tuple((n, 1) for n in items), capacity - sum(items), m)
    for n in range(min(capacity, len(counts) - 1), 0, -1):
        left = int(lengths[n])
        while left:
            i = bisect_left(open_, n)
            if i == len(open_):
                each = capacity // n
                for copies, m in ((each, left // each), (left % each, int(left % each > 0))):
                    if m:
                        put(((n, copies),), capacity - copies * n, m)
                break
            gap = open_[i]
            items, m = gaps[gap].pop()
            if not gaps[gap]:
                open_.pop(i)
            fit = gap // n
            if left >= fit:
                k = min(m, left // fit)
                put((*items, (n, fit)), gap - fit * n, k)
                left -= k * fit
            else:
                k = 1
                put((*items, (n, left)), gap - left * n, 1)
                left = 0
            if m > k:
                put(items, gap, m - k)
    return [(tuple(items), m) for stack in gaps.values() for items, m in stack]


def slots(entries: list[Entry]) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, first rank, end rank, copies, first sequence, offset)."""
    rank: dict[int, int] = defaultdict(int)
    sequence, out = 0, []
    for items, many in entries:
        offset = 0
        for n, copies in items:
            out.append((n, rank[n], rank[n] + many * copies, copies, sequence, offset))
            rank[n] += many * copies
            offset += n * copies
        sequence += many
    return out


# Printable ASCII words, split as the tokenizer's own pattern splits them.
_ASCII_WORD = re.compile(rb"[!-~]+\Z")
_ASCII_PARTS = re.compile(rb"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+")
_TAIL = re.compile(rb"[!-&(-/:-@\[-`{-~]+\Z")


def _parts(word: bytes) -> list[bytes]:
    """Parts of a word that the tokenizer encodes independently of each other."""
    if _ASCII_WORD.match(word):
        return _ASCII_PARTS.findall(word)
    if (m := _TAIL.search(word)) and m.start() and (stem := word[: m.start()].decode()).isalpha() and "\u0130" not in stem:
        return [word[: m.start()], m[0]]  # in lower case that one letter ends in a mark
    return [word]


class Merges:
    """The merge rules of a byte-level BPE with word ends, applied to many short words at once.

    A step finds the pair of the least rank in each word, the first of equal ones,
    joins it, and looks up the two pairs that are new. It yields what the tokenizer's
    own loop yields (tests hold it against the library), at a fraction of its time.
    """

    LONGEST = 32
    _NONE = np.int32(1 << 30)
    _SLOTS = 1 << 20

    def __init__(self, tokenizer: dict) -> None:
        vocab, merges = tokenizer["model"]["vocab"], tokenizer["model"]["merges"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        left, right = (np.array([vocab[p[i]] for p in pairs], np.uint32) for i in (0, 1))
        self.joined = np.array([vocab[p[0] + p[1]] for p in pairs], np.int32)
        key = left << np.uint32(16) | right
        self.keys, self.ranks = np.zeros(self._SLOTS, np.uint32), np.full(self._SLOTS, self._NONE, np.int32)
        used, self.probes = np.zeros(self._SLOTS, bool), 1
        for rank, (k, slot) in enumerate(zip(key.tolist(), self._slot(key).tolist(), strict=True)):
            n = 1
            while used[slot]:
                slot, n = (slot + 1) % self._SLOTS, n + 1
            used[slot], self.keys[slot], self.ranks[slot] = True, k, rank
            self.probes = max(self.probes, n)
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves; the others follow from 256 on
        sign = {c: chr(c) for c in plain} | {c: chr(256 + i) for i, c in enumerate(c for c in range(256) if c not in set(plain))}
        self.inner = np.array([vocab[sign[c]] for c in range(256)], np.int32)
        self.last = np.array([vocab[sign[c] + "</w>"] for c in range(256)], np.int32)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return (key * np.uint32(0x9E3779B1)) >> np.uint32(12)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a.astype(np.uint32) << np.uint32(16) | b.astype(np.uint32)
        slot = self._slot(key)
        out = np.where(self.keys[slot] == key, self.ranks[slot], self._NONE)
        for i in range(1, self.probes):
            at = slot + np.uint32(i) & np.uint32(self._SLOTS - 1)
            out = np.where((out == self._NONE) & (self.keys[at] == key), self.ranks[at], out)
        return out

    def apply(self, words: list[bytes]) -> list[bytes]:
        """Ids of the words (1 to LONGEST bytes) as little-endian 32-bit bytes."""
        out: list[bytes] = [b""] * len(words)
        sizes = np.array([len(w) for w in words], np.int64)
        for low, high in ((0, 6), (6, 12), (12, 20), (20, self.LONGEST)):
            for part in np.array_split(rows := np.flatnonzero((sizes > low) & (sizes <= high)), max(1, len(rows) // 20_000)):
                if len(part):
                    self._apply(words, part, sizes[part], high, out)
        return out

    def _apply(self, words: list[bytes], rows: np.ndarray, n: np.ndarray, width: int, out: list[bytes]) -> None:
        raw = np.frombuffer(b"".join([words[i].ljust(width, b"\0") for i in rows]), np.uint8).reshape(-1, width)
        col = np.arange(width)
        ids = np.where(col == n[:, None] - 1, self.last[raw], self.inner[raw])
        rank = np.full(ids.shape, self._NONE, np.int32)
        rank[:, :-1] = np.where(col[:-1] < n[:, None] - 1, self.rank(ids[:, :-1], ids[:, 1:]), self._NONE)
        while True:
            at = rank.argmin(axis=1)
            best = rank[np.arange(len(rank)), at]
            done = best == self._NONE
            if done.any():
                for i, x, m in zip(rows[done].tolist(), ids[done].astype("<u4"), n[done].tolist(), strict=True):
                    out[i] = x[:m].tobytes()
                live = ~done
                if not live.any():
                    return
                rows, n, ids, rank, at, best = rows[live], n[live] , ids[live], rank[live], at[live], best[live]
            each = np.arange(len(ids))
            ids[each, at] = self.joined[best]
            n = n - 1
            move = np.minimum(col + (col > at[:, None]), width - 1)
            ids = np.take_along_axis(ids, move, 1)
            rank = np.take_along_axis(rank, np.minimum(col + (col >= at[:, None]), width - 1), 1)
            rank[:, -1] = self._NONE
            for k in (at - 1, at):
                ok = (k >= 0) & (k < n - 1)
                e, k = each[ok], k[ok]
                rank[e, k] = self.rank(ids[e, k], ids[e, k + 1])
            e = at >= n - 1
            rank[each[e], at[e]] = self._NONE


class Encoder:
    """Ids of texts as little-endian 32-bit bytes. Words are encoded once and kept, up to a bound.

    Plain parts of words go through ``Merges``; the tokenizer itself encodes the
    others (long ones, control characters, scripts whose case or form may change),
    and as a whole every text that spells one of its special tokens.
    """

    KEEP = 1_000_000

    def __init__(self, path: str) -> None:
        import json

        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.special = [t.content.lower().encode() for t in self.tok.get_added_tokens_decoder().values()]
        self.merges = Merges(json.loads(self.tok.to_str()))
        self.words: dict[bytes, bytes] = {}

    def _part_ids(self, parts: list[bytes]) -> Iterator[tuple[bytes, bytes]]:
        plain, other = [], []
        for p in parts:
            if p.isascii():
                ok = len(p) <= Merges.LONGEST and _ASCII_WORD.match(p)
                (plain if ok else other).append((p, p))
            else:
                s = p.decode()
                low = s.lower().encode() if s.isalpha() and max(s) < "\u0250" and "\u0130" not in s else b""
                (plain if 0 < len(low) <= Merges.LONGEST else other).append((p, low))
        yield from zip([p for p, _ in plain], self.merges.apply([x for _, x in plain]), strict=True)
        for (p, _), e in zip(other, self.tok.encode_batch_fast([p.decode() for p, _ in other], add_special_tokens=False), strict=True):
            yield p, np.array(e.ids, "<u4").tobytes()

    def _learn(self, words: set[bytes]) -> dict[bytes, bytes]:
        split = {w: _parts(w) for w in words if not w.isalpha()}
        need = words.difference(split)  # plain ASCII letters are one part
        need.update(p for ps in split.values() for p in ps if p not in self.words)
        got = dict(self._part_ids(list(need)))
        for w, ps in split.items():
            if len(ps) > 1 or w not in got:
                got[w] = b"".join([got[p] if p in got else self.words[p] for p in ps])
        if len(self.words) + len(got) > self.KEEP:
            self.words.clear()
        self.words.update(got)
        return got

    def encode(self, texts: list[bytes]) -> Iterator[bytes]:
        whole = [any(x in t.lower() for x in self.special) for t in texts]
        split = [[] if w else t.lower().split() for t, w in zip(texts, whole, strict=True)]
        found = [list(map(self.words.get, ws)) for ws in split]
        new = self._learn({w for ws, g in zip(split, found, strict=True) if None in g for w, x in zip(ws, g, strict=True) if x is None})
        for t, w, ws, g in zip(texts, whole, split, found, strict=True):
            if w:
                yield np.array(self.tok.encode(t.decode(), add_special_tokens=False).ids, "<u4").tobytes()
            else:
                yield b"".join([new[w] if x is None else x for w, x in zip(ws, g, strict=True)] if None in g else g)


def _piecer(path: str) -> Callable:
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        enc = Encoder(path)
        for b in batches:
            texts = b.column("text")
            i = 0
            while i < len(b):
                j, size, part = i, 0, []
                while j < len(b) and (j == i or size < 2_000_000):
                    part.append((texts[j].as_py() or "").encode())
                    size += len(part[-1])
                    j += 1
                rows: list[list[int]] = [[], [], [], [], []]
                for k, ids in enumerate(enc.encode(part)):
                    ids += b"\0\0\0\0"
                    for piece, at in enumerate(range(0, len(ids), 4 * CAPACITY)):
                        x = ids[at : at + 4 * CAPACITY]
                        for col, v in zip(rows, (i + k, piece, at // 4, len(x) // 4, zlib.crc32(x)), strict=True):
                            col.append(v)
                who = pa.array(rows[0], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").take(who), b.column("key").take(who), pa.array(rows[1], pa.int32()), *(pa.array(r, pa.int64()) for r in rows[2:])],
                    ["doc_id", "key", "piece", "start", "length", "ids_crc32"],
                )
                i = j

    return cut


def token_pieces(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Pieces of at most 2048 tokens: doc_id, key, piece, start, length, ids_crc32."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("key"), "text")
    return docs.mapInArrow(_piecer(tokenizer), "doc_id long, key long, piece int, start long, length long, ids_crc32 long")


def pack(pieces: DataFrame) -> DataFrame:
    """Add sequence_id and offset to pieces (length 1 to 2048): as few sequences as the plan finds.

    Equal rows take different places. No pieces give no rows. ``pieces`` may hold
    any other columns; it is written to the shared folder once.
    """
    spark = pieces.sparkSession
    pieces = materialize(pieces)
    found = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most 2048 rows
    counts = np.zeros(CAPACITY + 1, np.int64)
    for n, c in found.items():
        counts[n] = c
    rows = slots(plan(counts))
    table = spark.createDataFrame(rows, "length long, _first long, _end long, _copies long, _seq long, _off long")
    salted = pieces.withColumn("_bucket", F.pmod(F.xxhash64(*pieces.columns), F.lit(max(1, int(counts.sum()) // BUCKET_ROWS))))
    before = salted.groupBy("length", "_bucket").count().withColumn("_before", F.sum("count").over(W.partitionBy("length").orderBy("_bucket")) - F.col("count")).drop("count")
    ranked = salted.withColumn("_i", F.row_number().over(W.partitionBy("length", "_bucket").orderBy(*pieces.columns)) - 1)
    ranked = ranked.join(before, ["length", "_bucket"]).withColumn("_rank", F.col("_i") + F.col("_before"))
    slot = F.broadcast(table.withColumnRenamed("length", "_n"))  # a few thousand rows, from the 2048 lengths alone
    placed = ranked.join(slot, (F.col("length") == F.col("_n")) & (F.col("_rank") >= F.col("_first")) & (F.col("_rank") < F.col("_end")))
    i = F.col("_rank") - F.col("_first")
    placed = placed.withColumn("sequence_id", F.col("_seq") + F.floor(i / F.col("_copies"))).withColumn("offset", F.col("_off") + (i % F.col("_copies")) * F.col("length"))
    return placed.select(*pieces.columns, "sequence_id", "offset")


def pack_documents(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Tokenise and pack every row of ``docs`` (doc_id, text): one row for each piece.

    A document is the ids of its text and id 0; null and empty texts are id 0
    alone. Only documents longer than 2048 are cut. Null ids and repeated rows are
    packed like any other. Other columns are ignored.
    """
    return pack(token_pieces(docs, tokenizer))
