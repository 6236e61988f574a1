"""Operator 13, an audit of how sources differ within a language.

Texts go through Arrow's compute functions: lower-casing, splitting into terms,
dictionary encoding and hashed group-bys, inside ``mapInArrow``. A task gives counts of
(lang, source, term), and Spark merges them. The merged counts are dealt into shards of
a language's terms, as many as its counts need, and each shard is a block of columns
from which numpy takes every source's share of the divergences. All arithmetic is in
whole numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import BROADCAST_BYTES, materialize

#: What parts terms: all of ASCII that is no letter.
_BETWEEN = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
#: A term needs so many documents of its language.
LEAST_DOCS = 3
#: Ranks of part ``term`` that are returned.
TOP = 200
#: Counts (source, term) in a shard, about.
SHARD_ROWS = 100_000
#: Texts of about so many bytes are split at a time, and a task holds about so many counts before it passes them on.
_STEP, _HELD = 1 << 20, 1 << 18
#: Cells of the widest array that a shard makes.
_CELLS = 1 << 19

_COUNTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])


def _counted(part: pa.RecordBatch) -> pa.Table:
    """Counts of a slice: occurrences and documents of each (lang, source, term), and a row without term for each (lang, source)."""
    groups = pa.table({c: part.column(c) for c in ("lang", "source")})
    terms = pc.split_pattern_regex(pc.ascii_lower(part.column("text")), pattern=_BETWEEN)
    code = pc.dictionary_encode(pc.list_flatten(terms))
    flat = pa.table({"doc": pc.list_parent_indices(terms), "code": code.indices})
    flat = flat.filter(pc.not_equal(flat["code"], code.dictionary.index("").as_py()))  # what is before the first and after the last term
    each = flat.group_by(["doc", "code"]).aggregate([([], "count_all")])
    of = pa.table({"lang": groups["lang"].take(each["doc"]), "source": groups["source"].take(each["doc"]), "code": each["code"], "n": each["count_all"]})
    of = of.group_by(["lang", "source", "code"]).aggregate([("n", "sum"), ("n", "count")])
    named = pa.table([of["lang"], of["source"], code.dictionary.take(of["code"].combine_chunks()), of["n_sum"], of["n_count"]], schema=_COUNTS)
    seen = groups.group_by(["lang", "source"]).aggregate([])
    none = pa.array(np.zeros(len(seen), np.int64))
    return pa.concat_tables([named, pa.table([seen["lang"], seen["source"], pa.nulls(len(seen), pa.string()), none, none], schema=_COUNTS)])


def _merged(tables: list[pa.Table]) -> pa.Table:
    got = pa.concat_tables(tables).group_by(["lang", "source", "term"]).aggregate([("n", "sum"), ("docs", "sum")])
    return pa.table([got[c] for c in ("lang", "source", "term", "n_sum", "docs_sum")], schema=_COUNTS)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.Table] = []
    rows = 0
    for b in batches:
        size = np.cumsum(pc.binary_length(b.column("text")).to_numpy(zero_copy_only=False))
        at = 0
        while at < len(b):
            many = max(1, int(np.searchsorted(size, (size[at - 1] if at else 0) + _STEP)) - at)
            held.append(_counted(b.slice(at, many)))
            rows, at = rows + len(held[-1]), at + many
            if rows > _HELD:
                held = [_merged(held)]
                rows = len(held[0])
                if rows > _HELD // 2:  # merging no longer helps
                    yield from held[0].to_batches()
                    held, rows = [], 0
    if held:
        yield from _merged(held).to_batches()


def source_counts(docs: DataFrame) -> DataFrame:
    """Rows (lang, source, term, n, docs): how often each term occurs, in how many documents. Each (lang, source) also has a row without term."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    part = docs.select(text("lang"), text("source"), text("text")).mapInArrow(_count, "lang string, source string, term string, n long, docs long")
    return part.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(10**9 * (count + 1) / total), by long division in three steps, so that large counts don't overflow."""
    rest, out = count + 1, np.ones(np.broadcast(count, total).shape, np.int64)
    for weight in (1_000_000, 1_000, 1):
        digit, rest = np.divmod(rest * 1000, total)
        out += digit * weight
    return out


def _f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    d = p - q
    return d * d // q


def pair_sums(who: np.ndarray, term: np.ndarray, n: np.ndarray, total: np.ndarray, terms: int) -> Iterator[tuple[int, np.ndarray]]:
    """For blocks of sources (first, block x all): the sums of f over a shard of ``terms`` terms.

    who, term, n: the shard's counts, sorted by term; total: N + V of each source. Most
    terms are not in most sources: a pair without either source gives the same f every
    time, one with one of them depends on its count alone, and only the terms that both
    have are taken one by one.
    """
    s = len(total)
    p, p0 = share(n, total[who]), share(np.zeros(s, np.int64), total)
    order = np.lexsort((p, who))
    w, x = who[order], p[order]
    first = np.flatnonzero(np.append(True, (w[1:] != w[:-1]) | (x[1:] != x[:-1]))) if len(w) else np.zeros(0, np.int64)
    many = np.diff(np.append(first, len(w)))
    w, x = w[first], x[first]  # distinct shares of each source
    size = np.bincount(term) if len(term) else np.zeros(0, np.int64)
    ends = np.cumsum(size)
    step = max(1, _CELLS // s)
    for low in range(0, s, step):
        high = min(s, low + step)
        block = terms * _f(p0[low:high, None], p0[None, :])
        for i in range(0, len(w), max(1, _CELLS // max(s, 1))):
            j = slice(i, i + max(1, _CELLS // max(s, 1)))
            mine = np.flatnonzero((w[j] >= low) & (w[j] < high)) + i
            if len(mine):  # terms of the row's source
                gain = (_f(x[mine, None], p0[None, :]) - _f(p0[w[mine], None], p0[None, :])) * many[mine, None]
                np.add.at(block, w[mine] - low, gain)
            gain = (_f(p0[low:high, None], x[None, j]) - _f(p0[low:high, None], p0[None, w[j]])) * many[None, j]
            np.add.at(block.T, w[j], gain.T)  # terms of the column's source
        for i, many_pairs in _pair_blocks(who, ends, size, low, high):
            row, col = many_pairs
            g, h = who[row], who[col]
            both = _f(p[row], p[col]) - _f(p[row], p0[h]) - _f(p0[g], p[col]) + _f(p0[g], p0[h])
            np.add.at(block, (g - low, h), both)
        yield low, block


def _pair_blocks(who: np.ndarray, ends: np.ndarray, size: np.ndarray, low: int, high: int) -> Iterator[tuple[int, tuple[np.ndarray, np.ndarray]]]:
    """Pairs of rows of one term whose first source lies in [low, high), in blocks."""
    rows = np.flatnonzero((who >= low) & (who < high))
    if not len(rows):
        return
    term = np.searchsorted(ends, rows, "right")
    cost = np.cumsum(size[term])
    at = 0
    while at < len(rows):
        to = max(at + 1, int(np.searchsorted(cost, (cost[at - 1] if at else 0) + _CELLS, "right")))
        k = size[term[at:to]]
        row = np.repeat(rows[at:to], k)
        inside = np.arange(len(row)) - np.repeat(np.cumsum(k) - k, k)
        yield at, (row, np.repeat(ends[term[at:to]] - k, k) + inside)
        at = to


_OUT = "lang string, source string, part string, item string, value long"
_ARROW_OUT = pa.schema([("lang", pa.string()), ("source", pa.string()), ("part", pa.string()), ("item", pa.string()), ("value", pa.int64())])


def _shard(top: int):
    def run(rows: pa.Table, totals: pa.Table) -> pa.Table:
        """A shard of a language's counts with the totals of all its sources."""
        if not len(totals):
            return _ARROW_OUT.empty_table()
        totals = totals.sort_by("source")
        names, lang = totals["source"].combine_chunks(), totals["lang"][0]
        v = totals["v"][0].as_py()
        total, whole = totals["n"].to_numpy() + v, totals["n_lang"][0].as_py() + v
        rows = rows.sort_by([("term", "ascending"), ("source", "ascending")])
        coded = pc.dictionary_encode(rows["term"].combine_chunks())
        term, n = coded.indices.to_numpy().astype(np.int64), rows["n"].to_numpy()
        who = pc.index_in(rows["source"].combine_chunks(), names).to_numpy(zero_copy_only=False).astype(np.int64)
        out = []

        def put(source: np.ndarray, part: str, item: pa.Array, value: np.ndarray) -> None:
            m = len(value)
            out.append(pa.table([pa.repeat(lang, m), names.take(pa.array(source)), pa.repeat(pa.scalar(part), m), item, pa.array(value)], schema=_ARROW_OUT))

        s = len(names)
        if v:
            for low, block in pair_sums(who, term, n, total, len(coded.dictionary)):
                a, b = np.divmod(np.arange(block.size), s)
                keep = a + low != b
                put((a + low)[keep], "pair", names.take(pa.array(b[keep])), block.ravel()[keep])
            of_lang = np.zeros(len(coded.dictionary), np.int64)
            np.add.at(of_lang, term, n)
            p, q = share(n, total[who]), share(of_lang[term], np.int64(whole))
            f = _f(p, q)
            some = np.flatnonzero(p > q)
            some = some[np.lexsort((term[some], -f[some], who[some]))]  # terms are coded in their own order
            start = np.searchsorted(who[some], who[some])
            some = some[np.arange(len(some)) - start < top]
            put(who[some], "term", coded.dictionary.take(pa.array(term[some])), f[some])
        return pa.concat_tables(out) if out else _ARROW_OUT.empty_table()

    return run


def source_divergences(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Rows (lang, source, part, item, value, rank) for each (lang, source) of ``docs`` (text, lang, source).

    ``pair``: the divergence from each other source of the language; ``term``: the terms
    that the source has more of than its language, to ``top`` ranks. Null text, lang and
    source are ''. Repeated rows count each; doc_id is not read. Ties go by the bytes of
    the item. A language of one source has no pairs; without kept terms pairs are 0 and
    there are no terms. No documents give no rows. Other columns are ignored, whatever their names.
    """
    counts = materialize(source_counts(docs))
    terms = counts.where("term IS NOT NULL")
    kept = terms.groupBy("lang", "term").agg(F.sum("docs").alias("_docs")).where(F.col("_docs") >= least_docs).select("lang", "term")
    kept = materialize(terms.select("lang", "source", "term", "n").join(kept, ["lang", "term"]))
    each = kept.groupBy("lang", "source").agg(F.sum("n").alias("n"), F.count("*").alias("rows"))
    v = kept.select("lang", "term").distinct().groupBy("lang").agg(F.count("*").alias("v"))
    langs = each.groupBy("lang").agg(F.sum("n").alias("n_lang"), F.sum("rows").alias("rows")).join(v, "lang")
    langs = materialize(langs.select("lang", "n_lang", "v", F.ceil(F.col("rows") / shard_rows).alias("shards")))
    if langs.count() * 64 <= BROADCAST_BYTES:  # one row for each language: a language's counts need not meet in one task
        langs = F.broadcast(langs)
    present = counts.where("term IS NULL").select("lang", "source")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    totals = present.join(each, ["lang", "source"], "left").join(langs, "lang", "left").select("lang", "source", zero("n"), zero("n_lang"), zero("v"), F.coalesce("shards", F.lit(0).cast("long")).alias("shards"))
    totals = materialize(totals)
    dealt = kept.join(langs.select("lang", "shards"), "lang").withColumn("shard", F.pmod(F.xxhash64("term"), F.col("shards"))).drop("shards")
    # each shard meets all sources of its language, as many rows as one source has pairs
    meets = totals.where("shards > 0").withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shards") - 1))).drop("shards")
    run = _shard(top)
    parts = dealt.groupBy("lang", "shard").cogroup(meets.groupBy("lang", "shard")).applyInArrow(lambda key, a, b: run(a, b), _OUT)
    parts = materialize(parts)
    a, b = totals.where("v = 0").select("lang", "source"), totals.where("v = 0").select("lang", F.col("source").alias("item"))
    none = a.join(b, "lang").where("source <> item").select("lang", "source", F.lit("pair").alias("part"), "item", F.lit(0).cast("long").alias("value"))
    pairs = parts.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value")).unionByName(none)
    order = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")

    def ranked(df: DataFrame) -> DataFrame:
        return df.withColumn("rank", F.row_number().over(order))

    # ranks beyond `top` are dropped before the exchange too (a limit within the window's groups)
    return ranked(pairs).unionByName(ranked(parts.where("part = 'term'")).where(F.col("rank") <= top))
