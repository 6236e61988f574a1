"""Spelling and language on page texts (D7-D11): tokens, dictionary joins, caps.

Words are classified once each, however often they occur; verdicts join back to
the occurrences. Corrections meet their dictionary words on deletion keys (words
one deletion apart share a key), so no word is compared with the whole dictionary.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quillmark.operators.phrases import find

_TOKEN = r"(?<=[^A-Za-z0-9_./:@])(?>[A-Za-z][A-Za-z'\-]{2,}[A-Za-z])(?=[^0-9_./:@])"
_EDGES = r"(?<![A-Za-z0-9_./:@])(?>[A-Za-z][A-Za-z'\-]{2,}[A-Za-z])(?![0-9_./:@])"


def spelling_tokens(pages: DataFrame, keep_edges: bool = False) -> DataFrame:
    """Tokens of four letters and more of each page (page_id, text; a row for each), the first of each lower-case word, its place among the tokens and how many there are. A page's words are counted where its text is read, so nothing is shuffled."""
    found = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(_EDGES if keep_edges else _TOKEN), F.lit(0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, rows = [], []
            for k, found in enumerate(b.column("found")):
                firsts: dict[str, list] = {}
                for pos, token in enumerate(found.as_py()):
                    f = firsts.setdefault(token.lower(), [pos, token, 0])
                    f[2] += 1
                rows += [(word, *f) for word, f in firsts.items()]
                at += [k] * len(firsts)
                if len(rows) > 50_000:
                    yield _token_rows(b, at, rows)
                    at, rows = [], []
            if rows:
                yield _token_rows(b, at, rows)

    return pages.select("page_id", found.alias("found")).mapInArrow(run, f"page_id {dict(pages.dtypes)['page_id']}, word string, pos int, token string, occurrences long")


def _token_rows(b: pa.RecordBatch, at: list[int], rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int32(), pa.string(), pa.int64())
    return pa.RecordBatch.from_arrays([b.column("page_id").take(pa.array(at)), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True))], names=["page_id", "word", "pos", "token", "occurrences"])


def _deletions(word: Column) -> Column:
    """The word and all forms with one letter less."""
    cut = F.transform(F.sequence(F.lit(1), F.length(word)), lambda i: F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, F.length(word))))
    return F.array_distinct(F.concat(F.array(word), cut))


#: Endings that make an inflection of a known word.
ENDINGS = ["s", "es", "ed", "ing", "ly", "er", "ers", "'s"]
#: Capitalised words below this length are taken for names rather than typing errors.
LONG_NAME = 10
#: Kinds of words that are findings; the others are right.
FAULTS = ["correction", "potential", "language"]
#: Right words that are sent to all tasks to spare their tokens a shuffle; the others are joined.
MOST_COMMON = 50_000


def _stems(word: Column) -> Column:
    """What may be left of a word without its ending: the stem, with an e, and without a doubled letter; y for ies."""
    cut = [F.when(word.endswith(e) & (F.length(word) >= len(e) + 3), F.substring(word, F.lit(1), F.length(word) - len(e))) for e in ENDINGS]
    forms = [F.array(c, F.concat(c, F.lit("e")), F.substring(c, F.lit(1), F.length(c) - 1)) for c in cut]
    ies = F.when(word.endswith("ies"), F.concat(F.substring(word, F.lit(1), F.length(word) - 3), F.lit("y")))
    return F.array_distinct(F.array_compact(F.concat(*forms, F.array(ies))))


def classify_words(words: DataFrame, dictionary: DataFrame, custom: DataFrame | None = None, languages: DataFrame | None = None) -> DataFrame:
    """Each distinct word with its kind, the first that fits.

    Right: short, custom, capitals, clipped (gov't), compound (its parts are known),
    known, hyphenated (known without the hyphen), inflection, name. Faults: potential
    (a name's shape, or nothing near), language (a word of another one), correction
    (with the nearest known word). ``words`` has word and token; ``dictionary`` word
    and frequency; ``languages`` word and lang. Each list is met by an equi-join.
    """
    known = dictionary.select(F.col("word").alias("form")).distinct()
    forms = words.groupBy("word").agg(F.bool_and(F.upper("token") == F.col("token")).alias("capitals"), F.bool_and(F.substring("token", 1, 1).rlike("[A-Z]")).alias("titled"), F.min("token").alias("token"))
    forms = forms.withColumn("bare", F.regexp_replace("word", "^['-]+|['-]+$", ""))
    w = forms.select("word", "bare", "capitals", "titled", F.regexp_replace("token", "^['-]+", "").substr(2, 1_000).rlike("[A-Z0-9]").alias("shaped"))

    def met(candidates: Column, name: str) -> DataFrame:
        """Words of which some candidate is known."""
        return w.select("word", F.explode(candidates).alias("form")).join(known, "form", "left_semi").select("word").distinct().withColumn(name, F.lit(True))

    hyphen = F.col("bare").contains("-")
    parts = w.where(hyphen).select("word", F.explode(F.filter(F.split("bare", "-"), lambda x: F.length(x) >= 3)).alias("form"))
    broken = parts.join(known, "form", "left_anti").select("word").distinct().withColumn("broken", F.lit(True))
    rows = w.join(met(F.array("bare"), "is_known"), "word", "left").join(met(_stems(F.col("bare")), "is_stem"), "word", "left").join(broken, "word", "left")
    rows = rows.join(met(F.when(hyphen, F.array(F.replace("bare", F.lit("-"), F.lit("")))), "is_joined"), "word", "left")
    own = custom.select(F.col("word").alias("bare")).distinct().withColumn("is_custom", F.lit(True)) if custom is not None else None
    rows = rows.join(own, "bare", "left") if own is not None else rows.withColumn("is_custom", F.lit(None).cast("boolean"))
    other = languages.select(F.col("word").alias("bare"), "lang").groupBy("bare").agg(F.min("lang").alias("lang")) if languages is not None else None
    rows = rows.join(other, "bare", "left") if other is not None else rows.withColumn("lang", F.lit(None).cast("string"))
    right = (
        F.when(F.length("bare") < 4, "short").when(F.col("is_custom"), "custom").when(F.col("capitals"), "capitals").when(F.col("bare").rlike("^[a-z]{2,}'[a-z]{1,2}$"), "clipped")
        .when(hyphen & F.col("broken").isNull(), "compound").when(F.col("is_known"), "known").when(F.col("is_joined"), "hyphenated").when(F.col("is_stem"), "inflection")
    )
    rows = rows.withColumn("kind", F.when(right.isNotNull(), right).when(F.col("shaped"), "potential").when(~F.col("titled") & F.col("lang").isNotNull(), "language"))
    unknown = rows.where("kind IS NULL").select("word", "bare", F.explode(_deletions(F.col("bare"))).alias("key"))
    near = unknown.join(dictionary.select(F.col("word").alias("near"), "frequency", F.explode(_deletions(F.col("word"))).alias("key")), "key").where(F.levenshtein("bare", "near", 1) == 1)
    best = near.groupBy("word").agg(F.max(F.struct("frequency", "near")).alias("b")).select("word", F.col("b.near").alias("suggestion"))
    rows = rows.join(best, "word", "left")
    found = F.col("suggestion").isNotNull()
    last = F.when(F.col("titled") & ~found, "name").when(F.col("titled") & (F.length("bare") < LONG_NAME), "potential").when(found, "correction").otherwise("potential")
    kind = F.coalesce("kind", last)
    return rows.select("word", kind.alias("kind"), F.when(kind == "correction", F.col("suggestion")).alias("suggestion"), F.when(kind == "language", F.col("lang")).alias("lang"))


def spelling_findings(tokens: DataFrame, verdicts: DataFrame, words: int = 60, frequencies: DataFrame | None = None) -> DataFrame:
    """Misspelt words of each page, the first ``words`` by position.

    With ``frequencies`` (word, frequency) the tokens of the commonest right words, which
    are most of all tokens, leave before the join.
    """
    bad = verdicts.where(F.col("kind").isin(FAULTS))
    if frequencies is not None:
        common = frequencies.orderBy(F.desc("frequency"), "word").limit(MOST_COMMON).select("word")
        right = common.join(verdicts.where(~F.col("kind").isin(FAULTS)).select("word"), "word", "left_semi")
        tokens = tokens.join(F.broadcast(right), "word", "left_anti")  # at most MOST_COMMON words
    w = W.partitionBy("page_id").orderBy("pos")
    return tokens.join(bad, "word").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= words).select("page_id", "rank", "word", "occurrences", "kind", "suggestion")


_PLACES = "page_id long, rank int, word string, kind string, suggestion string, lang string, place int, at int, matched string, context string"


def spelling_occurrences(pages: DataFrame, flagged: DataFrame, places: int = 5, around: int = 60) -> DataFrame:
    """Where the flagged words (page_id, rank, word, kind, suggestion, lang) stand in the texts (page_id, text): the first ``places`` of each as whole words, in any case, with their surroundings.

    A word that the text does not show has one row without a place. A page's flagged
    words, which are few, go to its text; a task reads a text once for all of them.
    """
    kinds = pa.schema([(n, {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}[k]) for n, k in (c.split(" ") for c in _PLACES.split(", "))])
    each = F.struct(F.col("rank").cast("int").alias("rank"), "word", "kind", "suggestion", "lang")
    lists = flagged.groupBy("page_id").agg(F.array_sort(F.collect_list(each)).alias("flags"))
    rows = lists.join(pages.select("page_id", "text"), "page_id", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for page, flags, text in zip(b.column("page_id").to_pylist(), b.column("flags").to_pylist(), b.column("text").to_pylist(), strict=True):
                text, where = text or "", {}
                for i, start, end in find(tuple(f["word"] for f in flags), text, True):
                    where.setdefault(flags[i]["word"].lower(), []).append((start, end))
                for f in flags:
                    head = (page, f["rank"], f["word"], f["kind"], f["suggestion"], f["lang"])
                    spans = where.get(f["word"].lower(), [])[:places]
                    out += [(*head, k + 1, s, text[s:e], text[max(0, s - around) : e + around]) for k, (s, e) in enumerate(spans)] or [(*head, None, None, f["word"], "")]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], schema=kinds)

    return rows.select(F.col("page_id").cast("long").alias("page_id"), "flags", "text").mapInArrow(run, _PLACES)


def spelling_rows(occurrences: DataFrame) -> DataFrame:
    """The occurrences as findings: page_id, rule_id, impact and a payload in JSON."""
    payload = F.to_json(F.struct("word", F.col("kind").alias("category"), "suggestion", F.col("lang").alias("language"), "context", F.col("matched").alias("matched_text")))
    return occurrences.select("page_id", F.lit("spelling").alias("rule_id"), F.lit("minor").alias("impact"), "rank", "place", payload.alias("payload"))


def spelling_simple(pages: DataFrame, dictionary: DataFrame, most: int = 40) -> DataFrame:
    """Distinct lower-case words of each page that the dictionary lacks, the first ``most`` by name."""
    rows = pages.select("page_id", F.explode(F.array_distinct(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"\b[a-z]{4,}\b"), F.lit(0)))).alias("word"))
    w = W.partitionBy("page_id").orderBy("word")
    return rows.join(dictionary.select("word"), "word", "left_anti").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most).select("page_id", "rank", "word")


def corpus_dictionary(docs: DataFrame, least: int) -> DataFrame:
    """Words in ``least`` documents or more, with the number of documents."""
    rows = docs.select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(r"\b[a-z]{4,}\b"), F.lit(0)))).alias("word"))
    return rows.groupBy("word").agg(F.count("*").alias("frequency")).where(F.col("frequency") >= least)


def detect_language(texts: DataFrame, stop_words: DataFrame, default: str = "en-US") -> DataFrame:
    """The language with most stop words (lang, word; a fixed list) in the whole of each text (id, text)."""
    words = texts.select("id", F.explode(F.split(F.lower(F.coalesce("text", F.lit(""))), r"[^\p{L}]+")).alias("word"))
    hits = words.join(F.broadcast(stop_words), "word").groupBy("id", "lang").agg(F.count("*").alias("n"))
    best = hits.groupBy("id").agg(F.max_by("lang", F.struct("n", "lang")).alias("lang"))
    return texts.select("id").join(best, "id", "left").select("id", F.coalesce("lang", F.lit(default)).alias("lang"))
