"""Operator 11, alignment of two tokenizers over the same bytes.

Tokenizer A (byte-level BPE) and B (pieces with byte fallback) both cover the bytes
of space + text. Where an A token and a B token end at the same byte, a group ends.

A fragment stands for any stretch of the two token streams: an open prefix (up to
and with the first common end), closed groups, and an open suffix (after the last
one). ``compose`` joins two neighbours and is associative, so stretches may be cut
anywhere and joined in any tree. A document of more than ``CHUNK`` bytes is cut at
every CHUNK bytes, for each tokenizer at its own next place that no token can span;
Spark encodes the chunks in different tasks and joins their fragments level by
level. Closed groups stay where they were found: only open ends travel up the tree.
"""

from __future__ import annotations

import functools
import hashlib
import os
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from .common import BROADCAST_BYTES, materialize

#: Longer documents (in bytes of space + text) are encoded by several tasks.
CHUNK = 1 << 16
#: Fragments that one step of the tree joins.
FAN = 16
#: Texts of about so many bytes are handled at a time within a task.
_STEP = 1 << 22
#: Words that a worker remembers, and the longest of them.
_REMEMBER, _LONGEST = 400_000, 64
#: Words of about so many characters are encoded as one text.
_BLOCK = 1 << 14
#: Before this character the classes of letters and digits are the same in all versions of Unicode in use.
_SETTLED = "\u0220"

# A word: its white space, then other characters. It begins at a space or line feed
# after a character that is no white space, where neither tokenizer has a token across.
_WORD = re.compile(r"[\s᠎]*[^\s᠎]+(?:(?![ \n])[\s᠎]+[^\s᠎]*)*|[\s᠎]+")
_ODD = re.compile("[^\\S \n]|᠎")


def words(text: str) -> list[str]:
    """The words of space + text."""
    if text[:1].isspace() or text[-1:].isspace() or any(x in text for x in ("  ", "\n\n", " \n", "\n ")) or _ODD.search(text):
        return _WORD.findall(" " + text)
    out: list[str] = []
    for i, line in enumerate(text.split("\n")):
        first, *rest = line.split(" ")
        out.append(("\n" if i else " ") + first)
        out += [" " + w for w in rest]
    return out


@dataclass
class Run:
    """Two token streams over the same stretch: ids and the bytes where tokens end."""

    a: np.ndarray
    a_ends: np.ndarray
    b: np.ndarray
    b_ends: np.ndarray

    def __add__(self, other: Run) -> Run:
        return Run(*(np.concatenate([x, y]) for x, y in zip(self.parts(), other.parts(), strict=True)))

    def parts(self) -> tuple[np.ndarray, ...]:
        return self.a, self.a_ends, self.b, self.b_ends

    def cut(self, common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many A and B tokens there are up to each common end."""
        return np.searchsorted(self.a_ends, common) + 1, np.searchsorted(self.b_ends, common) + 1

    def pack(self) -> bytes:
        return np.array([len(self.a), len(self.b)], "<i8").tobytes() + b"".join(x.astype("<i8").tobytes() for x in self.parts())

    @staticmethod
    def unpack(raw: bytes) -> Run:
        x = np.frombuffer(raw, "<i8")
        n, m = int(x[0]), int(x[1])
        return Run(*np.split(x[2:], [n, 2 * n, 2 * n + m]))


_NONE = np.zeros(0, np.int64)
EMPTY = Run(_NONE, _NONE, _NONE, _NONE)


@dataclass
class Groups:
    """Closed groups in order, as text with a ``;`` between, and the linked (B, A) ids as b << 16 | a."""

    text: bytes
    links: np.ndarray


NO_GROUPS = Groups(b"", _NONE)


@dataclass
class Fragment:
    """head: tokens up to and with the first common end, or all. tail: those after the last common end; None without any."""

    head: Run
    tail: Run | None = None


@functools.cache
def _digits() -> list[str]:
    return [str(i) for i in range(1 << 16)]


def _spell(a: list[int], b: list[int], na: list[int], nb: list[int]) -> list[str]:
    """Each group's ids; na and nb: tokens up to its end."""
    sa, sb = list(map(_digits().__getitem__, a)), list(map(_digits().__getitem__, b))
    out, i, j = [], 0, 0
    for p, q in zip(na, nb, strict=True):
        out.append((sa[i] if p == i + 1 else ",".join(sa[i:p])) + "|" + (sb[j] if q == j + 1 else ",".join(sb[j:q])))
        i, j = p, q
    return out


def groups(run: Run, na: np.ndarray, nb: np.ndarray) -> Groups:
    """The groups of a run that starts at a common end; na and nb: tokens up to each further common end."""
    if not len(na):
        return NO_GROUPS
    told = _spell(run.a.tolist(), run.b.tolist(), na.tolist(), nb.tolist())
    return Groups(";".join(told).encode(), run.b[nb - 1] << 16 | run.a[na - 1])


def _split(run: Run, started: bool) -> tuple[Run, Groups, Run | None]:
    """Head, closed groups and tail. started: the run begins at a common end, so nothing is left open before it."""
    na, nb = run.cut(np.intersect1d(run.a_ends, run.b_ends, assume_unique=True))
    if not len(na):
        return (EMPTY, NO_GROUPS, run) if started else (run, NO_GROUPS, None)
    first = (0, 0) if started else (int(na[0]), int(nb[0]))
    part = lambda i, j, k, m: Run(run.a[i:k], run.a_ends[i:k], run.b[j:m], run.b_ends[j:m])
    skip = 0 if started else 1
    closed = groups(part(*first, int(na[-1]), int(nb[-1])), na[skip:] - first[0], nb[skip:] - first[1])
    return part(0, 0, *first), closed, part(int(na[-1]), int(nb[-1]), len(run.a), len(run.b))


def fragment(run: Run) -> tuple[Fragment, Groups]:
    head, closed, tail = _split(run, False)
    return Fragment(head, tail), closed


def compose(x: Fragment, y: Fragment) -> tuple[Fragment, Groups]:
    """The fragment of two neighbours, and the groups that close at their seam."""
    if x.tail is None:
        whole, closed = fragment(x.head + y.head)
        return (Fragment(whole.head, y.tail) if y.tail is not None else whole), closed
    _, closed, rest = _split(x.tail + y.head, True)
    return Fragment(x.head, rest if y.tail is None else y.tail), closed


def first_group(whole: Fragment) -> Groups:
    """The group in the head of a whole document, whose start is a common end too."""
    return groups(whole.head, np.array([len(whole.head.a)]), np.array([len(whole.head.b)]))


def _quick(path: str):
    """A's vocabulary for a faster library, if its merges are in the order of their ids and it splits texts in the same way; else None."""
    import json

    import public_tokenizers
    import tiktoken

    with open(path) as f:
        told = json.load(f)
    vocab, merges, before = told["model"]["vocab"], told["model"]["merges"], told["pre_tokenizer"] or {}
    pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in merges]
    first = vocab.get("".join(pairs[0])) if pairs else None
    in_order = first is not None and all(vocab["".join(p)] == first + i for i, p in enumerate(pairs))
    if not in_order or told["normalizer"] or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True):
        return None
    byte = _byte_signs()
    ranks = {bytes(byte[c] for c in piece): i for piece, i in vocab.items() if all(c in byte for c in piece) and i < first + len(pairs)}
    return tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def _byte_signs() -> dict[str, int]:
    """The character that stands for each byte: itself where it can be seen, those from U+0100 on for the others."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {chr(c): c for c in plain} | {chr(256 + i): c for i, c in enumerate(c for c in range(256) if c not in set(plain))}


class Tokenizers:
    """Both tokenizers, their tokens' bytes, and words that were encoded before."""

    def __init__(self, a_path: str, b_path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        import tokenizers

        self.a = tokenizers.Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.quick = _quick(a_path)
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        byte = _byte_signs()
        self.a_bytes = {i: bytes(byte[c] for c in piece) for piece, i in self.a.get_vocab(with_added_tokens=False).items() if all(c in byte for c in piece)}
        ids = range(self.b.get_piece_size())
        piece = {i: self.b.id_to_piece(i) for i in ids if not self.b.is_control(i) and not self.b.is_unknown(i)}
        self.b_bytes = {i: bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in piece.items()}
        self.a_sizes, self.b_sizes = (np.array([len(of.get(i, b"")) for i in range(max(of) + 1)], np.int64) for of in (self.a_bytes, self.b_bytes))
        texts = [p.replace("▁", " ") for i, p in piece.items() if not self.b.is_byte(i)]
        #: Pairs of neighbouring characters inside pieces: no piece spans another pair.
        self.pairs = {p[i : i + 2] for p in texts for i in range(len(p) - 1)}
        if any(p[1] in " \n" and not p[0].isspace() for p in self.pairs):
            raise ValueError("pieces with a space or line feed after another character: words can't be encoded one by one")
        self.words: dict[str, tuple] = {}
        self.long: list[str] = []

    def encode_a(self, texts: list[str]) -> list[list[int]]:
        if self.quick is not None and all(t.isascii() or max(t) < _SETTLED for t in texts):
            return [self.quick.encode_ordinary(t) for t in texts]
        return [e.ids for e in self.a.encode_batch(texts, add_special_tokens=False)]

    def encode_b(self, texts: list[str], before: str = "x") -> list[list[int]]:
        """Ids of texts that follow the character ``before``, where no piece spans both: it and the space that B adds are dropped."""
        many, out = 1 + len(before.encode()), []
        for ids in self.b.encode([before + t for t in texts], num_threads=1):
            n = i = 0
            while n < many:
                n += len(self.b_bytes[ids[i]])
                i += 1
            out.append(ids[i:])
        return out

    def look_up(self, texts: list[list[str]]) -> None:
        """Encode the words that are not known yet: many as one text, since no token spans two of them."""
        wanted = set().union(*texts)
        fresh = list(wanted - self.words.keys())
        if len(self.words) + len(fresh) > _REMEMBER:
            self.words = {w: self.words[w] for w in wanted & self.words.keys()}
        self.long += [w for w in fresh if len(w) > _LONGEST]
        plain = [w for w in fresh if w.isascii() or max(w) < _SETTLED]
        other = [w for w in fresh if not (w.isascii() or max(w) < _SETTLED)] if len(plain) < len(fresh) else []
        for kind in (plain, other):
            block, size = [], 0
            for word in kind:
                if word[-1].isspace():  # its white space would run into the next word's
                    self._encode([word])
                    continue
                block.append(word)
                size += len(word)
                if size > _BLOCK:
                    self._encode(block)
                    block, size = [], 0
            if block:
                self._encode(block)

    def _encode(self, block: list[str]) -> None:
        """Remember of each word: A tokens + (B tokens << 32), its groups as text (None if the bytes differ), its links."""
        text = "".join(block)
        a, b = self.encode_a([text])[0], self.encode_b([text])[0]
        if b"".join(map(self.b_bytes.__getitem__, b)) != text.encode():
            if len(block) == 1:
                self.words[text] = (0, None, b"")
            else:
                for word in block:
                    self._encode([word])
            return
        run = Run(np.array(a, np.int64), np.cumsum(self.a_sizes[a]), np.array(b, np.int64), np.cumsum(self.b_sizes[b]))
        common = np.intersect1d(run.a_ends, run.b_ends, assume_unique=True)
        na, nb = run.cut(common)
        links = (run.b[nb - 1] << 16 | run.a[na - 1]).astype("<i8").tobytes()
        told = _spell(a, b, na.tolist(), nb.tolist())
        ends = np.searchsorted(common, np.cumsum([len(w.encode()) for w in block]), "right")
        counts = np.diff(na[ends - 1], prepend=0) + (np.diff(nb[ends - 1], prepend=0) << 32)
        low = 0
        for word, high, n in zip(block, ends.tolist(), counts.tolist(), strict=True):
            self.words[word] = (n, ";".join(told[low:high]), links[8 * low : 8 * high])
            low = high

    def forget_long(self) -> None:
        for word in self.long:
            self.words.pop(word, None)
        self.long = []

    def stream(self, text: str, start: int, before: str | None) -> tuple[np.ndarray, np.ndarray, bool]:
        """Ids and ends of one tokenizer over a stretch that begins at byte ``start``: A if before is None, else B, after that character."""
        if not text:
            return _NONE, _NONE, True
        ids, token, sizes = (self.encode_a([text])[0], self.a_bytes, self.a_sizes) if before is None else (self.encode_b([text], before)[0], self.b_bytes, self.b_sizes)
        return np.array(ids, np.int64), start + np.cumsum(sizes[ids]), b"".join(map(token.__getitem__, ids)) == text.encode()


@functools.cache
def loaded(a_path: str, b_path: str) -> Tokenizers:
    return Tokenizers(a_path, b_path)


@functools.cache
def _kind(c: str) -> str:
    """L, N or O for characters whose class has been settled for long, white space S, else ?."""
    old, new = unicodedata.ucd_3_2_0.category(c)[0], unicodedata.category(c)[0]
    if c in " \n":
        return "S"
    if old != new or c.isspace() or old in "CZ":
        return "?"
    return old if old in "LN" else "O"


def a_breaks(before: str, after: str) -> bool:
    """Whether A never has a token over both: a space after none, or a letter or digit before another class."""
    x, y = _kind(before), _kind(after)
    return (y == "S" and x in "LNO") or (x in "LN" and y in "LNO" and x != y)


def _next_cut(data: bytes, at: int, breaks) -> tuple[int, str]:
    """The first place from byte ``at`` on that breaks, and the character before it; the end if there is none."""
    while at < len(data) and data[at] & 0xC0 == 0x80:
        at += 1
    if at >= len(data):
        return len(data), ""
    low = at - 1
    while low > 0 and data[low] & 0xC0 == 0x80:
        low -= 1
    while at < len(data):
        high = min(len(data), at + 4096)
        while high < len(data) and data[high] & 0xC0 == 0x80:
            high += 1
        part = data[low:high].decode()
        for c, d in zip(part, part[1:], strict=False):
            if breaks(c, d):
                return at, c
            at += len(d.encode())
        low = at - len(part[-1].encode())
    return len(data), ""


def chunks(text: str, tok: Tokenizers, chunk: int = CHUNK) -> Iterator[tuple[int, bytes, int, int, int, int]]:
    """Rows (start, bytes, A from, A to, B from, B to) of space + text: the byte range that a chunk encodes for each tokenizer."""
    data = b" " + text.encode()
    b_breaks = lambda c, d: c + d not in tok.pairs
    a_lo = b_lo = 0
    before = ""
    for k in range(chunk, len(data) + chunk, chunk):
        a_hi = a_lo if a_lo >= k else _next_cut(data, k, a_breaks)[0]
        b_hi, after = (b_lo, before) if b_lo >= k else _next_cut(data, k, b_breaks)
        if a_hi > a_lo or b_hi > b_lo:
            low = min(a_lo, b_lo - len(before.encode()))
            yield low, data[low : max(a_hi, b_hi)], a_lo, a_hi, b_lo, b_hi
        a_lo, b_lo, before = a_hi, b_hi, after


def chunk_run(tok: Tokenizers, start: int, data: bytes, a_lo: int, a_hi: int, b_lo: int, b_hi: int) -> tuple[Run, bool]:
    """The token streams of a chunk, and whether their bytes are those of the text."""
    a, a_ends, same_a = tok.stream(data[a_lo - start : a_hi - start].decode(), a_lo, None)
    b, b_ends, same_b = tok.stream(data[b_lo - start : b_hi - start].decode(), b_lo, data[: b_lo - start].decode()[-1:] or "x")
    return Run(a, a_ends, b, b_ends), same_a and same_b


def tally(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and how often each occurs."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    counts = np.ones(len(keys), np.int64) if counts is None else counts[order]
    return keys[first], np.add.reduceat(counts, first) if len(first) else np.zeros(0, np.int64)


# Pairs are kept as differences of the sorted keys: small numbers, which compress well.
def _pack_pairs(keys: np.ndarray, counts: np.ndarray) -> tuple[bytes, bytes]:
    return np.diff(keys, prepend=0).astype("<u4").tobytes(), counts.astype("<u4").tobytes()


def _unpack_pairs(keys: bytes, counts: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.cumsum(np.frombuffer(keys, "<u4").astype(np.int64)), np.frombuffer(counts, "<u4").astype(np.int64)


_ROW = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, times binary"
_CHUNKS = "doc_key string, seq long, start long, data binary, a_lo long, a_hi long, b_lo long, b_hi long"
_CLOSED = "array<struct<seq:long,groups:binary,links:binary>>"
_FRAGMENT = f"doc_key string, seq long, head binary, tail binary, n_a long, n_b long, same boolean, seams {_CLOSED}"


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _arrow(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(T._parse_datatype_string(ddl))


def _parts(b: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose column has about _STEP bytes each."""
    size = np.array([len(x.as_buffer()) if x.is_valid else 0 for x in b.column(column)], np.int64)
    at = 0
    while at < len(b):
        many = max(1, int(np.searchsorted(np.cumsum(size[at:]), _STEP)))
        yield b.slice(at, many)
        at += many


def _align_whole(a_path: str, b_path: str, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = loaded(a_path, b_path)
        for b in batches:
            for part in _parts(b, "text"):
                texts = [words(t) if t else [] for t in part.column("text").to_pylist()]
                tok.look_up(texts)
                rows = []
                for doc_id, found in zip(part.column("doc_id").to_pylist(), texts, strict=True):
                    known = list(map(tok.words.__getitem__, found))
                    text = [k[1] for k in known]
                    if not found or None in text:
                        rows.append((doc_id, 0, 0, 0, 0, "", b"", b""))
                        continue
                    links = np.frombuffer(b"".join([k[2] for k in known]), "<i8")
                    counts = sum([k[0] for k in known])
                    rows.append((doc_id, counts & 0xFFFFFFFF, counts >> 32, len(links), len(links), hashlib.sha256(";".join(text).encode()).hexdigest(), *_pack_pairs(*tally(links))))
                tok.forget_long()
                yield _batch(rows, schema)

    return run


def _cut(a_path: str, b_path: str, chunk: int, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = loaded(a_path, b_path)
        for b in batches:
            for key, text in zip(b.column("doc_key").to_pylist(), b.column("text"), strict=True):
                for seq, row in enumerate(chunks(text.as_py(), tok, chunk)):
                    yield _batch([(key, seq, *row)], schema)

    return run


def _encode(a_path: str, b_path: str, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = loaded(a_path, b_path)
        for b in batches:
            for r in b.to_pylist():
                stretch, same = chunk_run(tok, *(r[c] for c in ("start", "data", "a_lo", "a_hi", "b_lo", "b_hi")))
                got, closed = fragment(stretch)
                tail = None if got.tail is None else got.tail.pack()
                seam = {"seq": 2 * r["seq"] + 1, "groups": closed.text, "links": closed.links.astype("<i8").tobytes()}
                yield _batch([(r["doc_key"], r["seq"], got.head.pack(), tail, len(stretch.a), len(stretch.b), same, [seam])], schema)

    return run


def _join_fragments(schema: pa.Schema):
    def run(part: pa.Table) -> pa.Table:
        whole, seams, n_a, n_b, same = Fragment(EMPTY), [], 0, 0, True
        rows = sorted(part.to_pylist(), key=lambda r: r["first"])
        for r in rows:
            whole, closed = compose(whole, Fragment(Run.unpack(r["head"]), None if r["tail"] is None else Run.unpack(r["tail"])))
            if closed.text:
                seams.append({"seq": 2 * r["first"], "groups": closed.text, "links": closed.links.astype("<i8").tobytes()})
            seams += r["seams"]
            n_a, n_b, same = n_a + r["n_a"], n_b + r["n_b"], same and r["same"]
        tail = None if whole.tail is None else whole.tail.pack()
        return pa.Table.from_batches([_batch([(rows[0]["doc_key"], rows[0]["first"], whole.head.pack(), tail, n_a, n_b, same, seams)], schema)])

    return run


def _digest(schema: pa.Schema):
    """Streams the closed groups of each document, in order, into its digest and its links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sha, some, keys, times, held = None, hashlib.sha256(), False, _NONE, _NONE, []

        def fold() -> None:
            nonlocal keys, times, held
            fresh, many = tally(np.concatenate(held)) if held else (_NONE, _NONE)
            keys, times = tally(np.concatenate([keys, fresh]), np.concatenate([times, many]))
            held = []

        def done() -> pa.RecordBatch:
            fold()
            return _batch([(key, int(times.sum()), sha.hexdigest(), *_pack_pairs(keys, times))], schema)

        for b in batches:
            for k, g, links in zip(b.column("doc_key").to_pylist(), b.column("groups").to_pylist(), b.column("links").to_pylist(), strict=True):
                if k != key:
                    if key is not None:
                        yield done()
                    key, sha, some, keys, times, held = k, hashlib.sha256(), False, _NONE, _NONE, []
                if g:
                    sha.update(b";" + g if some else g)
                    some = True
                    held.append(np.frombuffer(links, "<i8"))
                    if sum(map(len, held)) > 1 << 20:
                        fold()
        if key is not None:
            yield done()

    return run


def _first_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for key, head in zip(b.column("doc_key").to_pylist(), b.column("head").to_pylist(), strict=True):
            got = first_group(Fragment(Run.unpack(head)))
            rows.append((key, -1, got.text, got.links.astype("<i8").tobytes()))
        yield _batch(rows, pa.schema([("doc_key", pa.string()), ("seq", pa.int64()), ("groups", pa.binary()), ("links", pa.binary())]))


def _align_long(docs: DataFrame, a_path: str, b_path: str, chunk: int) -> DataFrame:
    """Documents of several chunks: encoded apart, joined by a tree over their fragments."""
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    key = F.sha2(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), "text"), 256)
    each = materialize(docs.groupBy("doc_id", "text").agg(F.count("*").alias("copies")).withColumn("doc_key", key))
    cut = each.select("doc_key", "text").mapInArrow(_cut(a_path, b_path, chunk, _arrow(_CHUNKS)), _CHUNKS)
    pieces = materialize(cut.repartition(n, "doc_key", "seq").mapInArrow(_encode(a_path, b_path, _arrow(_FRAGMENT)), _FRAGMENT))
    # only the open ends go up the tree; what is closed within a chunk stays in the table
    level = pieces.withColumn("seams", F.lit(None).cast(_CLOSED)).withColumn("seams", F.coalesce("seams", F.array().cast(_CLOSED)))
    width = (pieces.agg(F.max("seq")).first()[0] or 0) + 1
    joined, span = level, 1
    while span == 1 or span < width:
        span *= FAN
        joined = joined.withColumnRenamed("seq", "first").withColumn("_node", F.floor(F.col("first") / span)).groupBy("doc_key", "_node").applyInArrow(_join_fragments(_arrow(_FRAGMENT)), _FRAGMENT)
    joined = materialize(joined)
    closed = lambda df: df.select("doc_key", F.explode("seams").alias("s")).select("doc_key", "s.seq", "s.groups", "s.links")
    starts = joined.mapInArrow(_first_groups, "doc_key string, seq long, groups binary, links binary")
    ordered = closed(pieces).unionByName(closed(joined)).unionByName(starts).repartition(n, "doc_key").sortWithinPartitions("doc_key", "seq")
    out = "doc_key string, n_groups long, groups_sha256 string, pairs binary, times binary"
    told = ordered.mapInArrow(_digest(_arrow(out)), out)
    rows = each.select("doc_key", "doc_id", "copies").join(joined.select("doc_key", "n_a", "n_b", "same"), "doc_key").join(told, "doc_key")
    zero = lambda c: F.when(F.col("same"), F.col(c)).otherwise(F.lit(0)).cast("long").alias(c)
    none = lambda c: F.when(F.col("same"), F.col(c)).otherwise(F.lit(b"")).alias(c)
    rows = rows.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).withColumn("n_links", F.col("n_groups"))
    return rows.select("doc_id", zero("n_a"), zero("n_b"), zero("n_groups"), zero("n_links"), F.when(F.col("same"), F.col("groups_sha256")).otherwise("").alias("groups_sha256"), none("pairs"), none("times"))


def align(docs: DataFrame, a_path: str, b_path: str, chunk: int = CHUNK) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): counts of tokens, groups and links, the digest of the groups, and the linked pairs.

    ``pairs`` and ``times``: the distinct (B, A) id pairs of the links, as differences of sorted b << 16 | a, and how often each is linked.
    No token of either tokenizer is empty, so a group has one link: its last tokens.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    long = F.coalesce(F.octet_length("text") >= chunk, F.lit(False))
    short = rows.where(~long).mapInArrow(_align_whole(a_path, b_path, _arrow(_ROW)), _ROW)
    return short.unionByName(_align_long(rows.where(long), a_path, b_path, chunk))


def _partial_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    keys, times, held, size = _NONE, _NONE, [], 0

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(times)], ["pair", "n"])

    for b in batches:
        for k, t in zip(b.column("pairs").to_pylist(), b.column("times").to_pylist(), strict=True):
            held.append(_unpack_pairs(k, t))
            size += len(held[-1][0])
            if size > 1 << 20:
                keys, times = tally(np.concatenate([keys, *(x for x, _ in held)]), np.concatenate([times, *(x for _, x in held)]))
                held, size = [], 0
                if len(keys) > 1 << 21:
                    yield out()
                    keys, times = _NONE, _NONE
    if held:
        keys, times = tally(np.concatenate([keys, *(x for x, _ in held)]), np.concatenate([times, *(x for _, x in held)]))
    yield out()


def link_counts(aligned: DataFrame) -> DataFrame:
    """Rows (pair, n, best) over the corpus: how many links hold the pair, and whether no pair with its B id has more."""
    total = aligned.select("pairs", "times").mapInArrow(_partial_counts, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    # at most one row for each A id in a window
    return total.withColumn("best", F.col("n") == F.max("n").over(W.partitionBy(F.shiftright("pair", 16))))


_KEPT = ["doc_id", "n_a", "n_b", "n_groups", "n_links"]


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for row, k, t in zip(b.column("row").to_pylist(), b.column("pairs").to_pylist(), b.column("times").to_pylist(), strict=True):
            keys, times = _unpack_pairs(k, t)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), row, np.int64)), pa.array(keys), pa.array(times)], ["row", "pair", "times"])


def align_tokenizers(docs: DataFrame, a_path: str, b_path: str, chunk: int = CHUNK, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    Texts that are null, empty or not given back by B's bytes (they hold U+2581) have
    zeros and an empty digest. Null ids stay null; repeated rows each count and get
    equal rows. No documents give no rows. Other columns are ignored, whatever their
    names. Special tokens inside texts are plain text.

    The table of pair counts grows with the vocabularies, not the corpus, but it is
    measured all the same: beyond ``broadcast_bytes`` it is joined by a shuffle.
    """
    spark = docs.sparkSession
    rows = materialize(align(docs, a_path, b_path, chunk).withColumn("row", F.monotonically_increasing_id()))
    counts = materialize(link_counts(rows))
    if counts.count() * 17 > broadcast_bytes:
        each = rows.select("row", "pairs", "times").mapInArrow(_spread, "row long, pair long, times long").join(counts, "pair")
        summed = each.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
        found = rows.join(summed, "row", "left").select(*_KEPT, *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("n_best", "count_sum")), "groups_sha256")
        return found
    got = counts.toArrow().sort_by("pair")
    shared = spark.sparkContext.broadcast(tuple(got.column(c).to_numpy() for c in ("pair", "n", "best")))
    schema = _arrow("doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, n, best = shared.value
        for b in batches:
            sums = []
            for k, t in zip(b.column("pairs").to_pylist(), b.column("times").to_pylist(), strict=True):
                keys, times = _unpack_pairs(k, t)
                at = np.searchsorted(pair, keys)
                sums.append((int(times[best[at]].sum()), int((times * n[at]).sum())))
            ends = [pa.array([s[i] for s in sums], pa.int64()) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in _KEPT), *ends, b.column("groups_sha256")], schema=schema)

    return rows.select(*_KEPT, "groups_sha256", "pairs", "times").mapInArrow(look_up, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
