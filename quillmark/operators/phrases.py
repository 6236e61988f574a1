"""Thousands of phrases found in one pass over each text (D18, G19-G21, H9), by an automaton of Aho and Corasick.

The automaton is built once in a worker from the list of phrases; a text is read once,
whatever their number. Lists of more than ``MOST_CHARS`` characters are dealt over
several automata, each with a pass of its own, so what a task holds stays bounded.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Characters of the phrases that one automaton holds.
MOST_CHARS = 4_000_000
_FOUND = pa.schema([("page_id", pa.int64()), ("phrase_no", pa.int64()), ("number", pa.int32()), ("total", pa.int32()), ("at", pa.int32()), ("matched", pa.string()), ("context", pa.string())])
_DDL = "page_id long, phrase_no long, number int, total int, at int, matched string, context string"


def folded(text: str) -> str:
    """The text in lower case, with the same number of characters."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c if len(c.lower()) != 1 else c.lower() for c in text)


@functools.lru_cache(maxsize=8)
def automaton(phrases: tuple[str, ...]) -> ahocorasick.Automaton:
    """Of the distinct folded phrases; the value is (number of the first such phrase, length)."""
    a = ahocorasick.Automaton()
    for i, p in enumerate(phrases):
        if (low := folded(p)) and low not in a:
            a.add_word(low, (i, len(low)))
    if len(a):
        a.make_automaton()
    return a


def _is_word(c: str) -> bool:
    return c.isalnum() or c == "_"


def find(phrases: tuple[str, ...], text: str, whole: bool) -> Iterator[tuple[int, int, int]]:
    """(phrase, start, end) of the occurrences, those of one phrase not overlapping, by their ends."""
    a = automaton(phrases)
    if not len(a) or not text:
        return
    low, free = folded(text), {}
    for last, (i, n) in a.iter(low):
        start, end = last - n + 1, last + 1
        if whole and (start and _is_word(low[start - 1]) or end < len(low) and _is_word(low[end])):
            continue
        if free.get(i, 0) <= start:
            free[i] = end
            yield i, start, end


def _shares(phrases: list[str]) -> list[tuple[int, tuple[str, ...]]]:
    """Parts of the list (number of the first phrase, phrases) of at most MOST_CHARS each."""
    out, size = [], MOST_CHARS
    for i, p in enumerate(phrases):
        if size + len(p) > MOST_CHARS:
            out.append((i, []))
            size = 0
        out[-1][1].append(p)
        size += len(p)
    return [(i, tuple(ps)) for i, ps in out]


def occurrences(pages: DataFrame, phrases: list[str], whole: bool = True, around: int = 60, each: int | None = None) -> DataFrame:
    """Every occurrence of the phrases in pages (page_id, text), any case: page_id, phrase_no (in the list), number, total, at (from 0), matched and context.

    ``whole``: only as whole words. ``number`` counts a phrase's occurrences in a page,
    ``total`` tells how many there are, of which the first ``each`` are given. A phrase
    that is listed twice is found as the first. Null texts have none.
    """
    out = None
    for first, share in _shares(phrases):

        def run(batches: Iterator[pa.RecordBatch], first: int = first, share: tuple[str, ...] = share) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for page, text in zip(b.column("page_id").to_pylist(), b.column("text"), strict=True):
                    by: dict[int, list[tuple[int, int]]] = {}
                    t = text.as_py() or ""
                    for i, start, end in find(share, t, whole):
                        by.setdefault(i, []).append((start, end))
                    rows = [(page, first + i, k + 1, len(spans), s, t[s:e], t[max(0, s - around) : e + around]) for i, spans in by.items() for k, (s, e) in enumerate(spans[:each])]
                    for at in range(0, len(rows), 4096):
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows[at : at + 4096], strict=True), _FOUND, strict=True)], schema=_FOUND)

        part = pages.select(F.col("page_id").cast("long").alias("page_id"), "text").mapInArrow(run, _DDL)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else pages.sparkSession.createDataFrame([], _DDL)


def named(rows: DataFrame, phrases: list[str]) -> DataFrame:
    """Add the phrase of each occurrence, from a join with the list."""
    names = rows.sparkSession.createDataFrame(pa.table({"phrase_no": pa.array(range(len(phrases)), pa.int64()), "phrase": pa.array(phrases, pa.string())}))
    return rows.join(names, "phrase_no")


def site_keywords(pages: DataFrame, rules: DataFrame, patterns: list[str], around: int = 40, excerpts: int = 5) -> DataFrame:
    """G19 with rules by site: pages (page_id, site_id, text), rules (site_id, rule, pattern), patterns: all that any rule names.

    Each text is read once for the patterns of all sites; a join keeps those of its own.
    Gives page_id, rule, occurrences, patterns (those that occur) and the first excerpts.
    """
    found = named(occurrences(pages, patterns, whole=False, around=around), patterns).join(pages.select("page_id", "site_id"), "page_id")
    found = found.withColumn("_p", F.lower("phrase")).join(rules.select("site_id", "rule", F.lower("pattern").alias("_p")).distinct(), ["site_id", "_p"])
    return keyword_findings(found, excerpts)


def keyword_findings(found: DataFrame, excerpts: int = 5) -> DataFrame:
    """Per page and rule of found occurrences (page_id, rule, phrase, at, number, context): how many, of which patterns, and an excerpt for each of the first patterns."""
    first = F.when(F.col("number") == 1, F.struct("at", "context"))
    return found.groupBy("page_id", "rule").agg(
        F.count("*").alias("occurrences"), F.array_sort(F.collect_set("phrase")).alias("patterns"), F.min_by("context", "at").alias("excerpt"),
        F.transform(F.slice(F.array_sort(F.collect_list(first)), 1, excerpts), lambda x: x["context"]).alias("excerpts"),
    )


def sensitive_keywords(elements: DataFrame, texts: DataFrame, phrases: list[str], around: int = 80) -> DataFrame:
    """One row for each occurrence of the phrases on a page (page_id, phrase, pos, context, number, total).

    Searched are the page's text (``texts``: page_id, text) and the alternative texts and
    titles of its elements, where a phrase counts once for an element. ``number`` goes
    by phrase, elements first; ``total`` is the page's.
    """
    told = elements.select("page_id", "pos", F.explode(F.array_distinct(F.array_compact(F.array("alt", "title")))).alias("text")).where("trim(text) <> ''")
    # an element's texts are found under a number of their own, which is joined back
    key = F.xxhash64("page_id", "pos", "text")
    held = told.withColumn("_key", key)
    hits = occurrences(held.select(F.col("_key").alias("page_id"), "text"), phrases, each=1).select(F.col("page_id").alias("_key"), "phrase_no")
    of = held.join(hits, "_key").groupBy("page_id", "pos", "phrase_no").agg(F.min("text").alias("context")).select("page_id", "phrase_no", "pos", F.lit(0).alias("at"), "context")
    body = occurrences(texts, phrases, around=around).select("page_id", "phrase_no", F.lit(None).cast("long").alias("pos"), "at", F.trim("context").alias("context"))
    rows = named(of.unionByName(body), phrases)
    page = W.partitionBy("page_id")
    order = page.orderBy("phrase_no", F.col("pos").asc_nulls_last(), "at")
    return rows.select("page_id", "phrase", "pos", "context", F.row_number().over(order).alias("number"), F.count("*").over(page).alias("total"))


def claimed(tiers: list[list[str]]) -> Callable[[str | None], list[tuple[int, int, int]]]:
    """A function that gives the places (tier, start, end) of a text which the phrases claim.

    Earlier tiers, and earlier phrases of a tier, claim their places first; what overlaps
    a claimed place does not count. ``[field]`` at the end of a phrase is any word.
    """
    flat = [(tier, p) for tier, ps in enumerate(tiers, 1) for p in ps]
    stems = tuple(p.removesuffix("[field]") for _, p in flat)
    word = re.compile(r"[^\s,.;]+", re.ASCII)

    def places(text: str | None) -> list[tuple[int, int, int]]:
        taken, free = [], {}
        for i, start, end in sorted(find(stems, text or "", False)):
            tier, phrase = flat[i]
            if start < free.get(i, 0):  # within the word of the occurrence before
                continue
            if phrase.endswith("[field]"):
                if not (m := word.match(text, end)):
                    continue
                end = free[i] = m.end()
            if not any(start < z and a < end for _, a, z in taken):
                taken.append((tier, start, end))
        return taken

    return places


def tier_matches(pages: DataFrame, tiers: list[list[str]], around: int = 75) -> DataFrame:
    """H9: the phrases of pages (page_id, text) by tier, as ``claimed`` finds them: page_id, tier, at, matched and context."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.schema([("page_id", pa.int64()), ("tier", pa.int32()), ("at", pa.int32()), ("matched", pa.string()), ("context", pa.string())])
        places = claimed(tiers)
        for b in batches:
            rows = []
            for page, text in zip(b.column("page_id").to_pylist(), b.column("text"), strict=True):
                t = text.as_py() or ""
                rows += [(page, tier, start, t[start:end], t[max(0, start - around) : end + around]) for tier, start, end in places(t)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), kinds, strict=True)], schema=kinds)

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "text").mapInArrow(run, "page_id long, tier int, at int, matched string, context string")


def tier_counts(pages: DataFrame, tiers: list[list[str]]) -> DataFrame:
    """How many places the phrases of each tier claim in pages (page_id, text): page_id, tier1, tier2 and so on; pages without any have no row. Texts that repeat among some thousand rows are read once."""
    names = [f"tier{i + 1}" for i in range(len(tiers))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = claimed(tiers)
        for b in batches:
            texts = b.column("text").dictionary_encode()
            counts = np.zeros((len(texts.dictionary) + 1, len(tiers)), np.int32)  # the last is that of null
            for k, text in enumerate(texts.dictionary):
                for tier, *_ in places(text.as_py()):
                    counts[k, tier - 1] += 1
            of = counts[texts.indices.fill_null(len(texts.dictionary)).to_numpy(zero_copy_only=False)]
            some = np.flatnonzero(of.any(axis=1))
            if len(some):
                yield pa.RecordBatch.from_arrays([b.column("page_id").take(pa.array(some)), *(pa.array(of[some, k]) for k in range(len(tiers)))], names=["page_id", *names])

    kind = dict(pages.dtypes)["page_id"]
    return pages.select("page_id", "text").mapInArrow(run, ", ".join([f"page_id {kind}", *(f"{n} int" for n in names)]))
