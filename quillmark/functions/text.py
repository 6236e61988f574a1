"""Text measures as column expressions (D)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"(?U)\s+"), lambda x: x != "")


def word_count(text: Column) -> Column:
    """Runs without white space."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"(?U)\S+"))


def sentences(text: Column) -> Column:
    """Each line with text, split after . ! ? and white space."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.trim(x) != "")
    return F.filter(F.flatten(F.transform(lines, lambda x: F.split(F.trim(x), r"(?<=[.!?])\s+"))), lambda s: F.trim(s) != "")


def sentence_count(text: Column) -> Column:
    return F.size(sentences(text))


def syllables(text: Column) -> Column:
    """Groups of vowels in ASCII words, one at least for each word."""
    words = F.regexp_count(text, F.lit("[A-Za-z]+"))
    return F.greatest(F.regexp_count(F.lower(text), F.lit("[aeiouy]+")), words)


def flesch_kincaid_grade(text: Column) -> Column:
    w, s = F.regexp_count(text, F.lit("[A-Za-z]+")), F.greatest(sentence_count(text), F.lit(1))
    return F.when(w > 0, 0.39 * w / s + 11.8 * syllables(text) / w - 15.59)


def reading_age(text: Column) -> Column:
    """D3: grade between 0 and 20, plus 5, to one place; null without words."""
    g = flesch_kincaid_grade(text)
    return F.when(g.isNotNull(), F.round(F.least(F.greatest(g, F.lit(0.0)), F.lit(20.0)).cast("decimal(28,9)") + 5, 1).cast("double"))


def flesch_reading_ease(text: Column) -> Column:
    w, s = F.regexp_count(text, F.lit("[A-Za-z]+")), F.greatest(sentence_count(text), F.lit(1))
    return F.when(w > 0, 206.835 - 1.015 * w / s - 84.6 * syllables(text) / w)


def readability_weight(text: Column) -> Column:
    """Texts of 120 words and more: under 30 weighs 1, under 50 a half, else nothing."""
    ease = flesch_reading_ease(text)
    return F.when(word_count(text) >= 120, F.when(ease < 30, 1.0).when(ease < 50, 0.5))


def content_hash(text: Column) -> Column:
    """Sha-256 of the text trimmed, collapsed and in lower case."""
    return F.sha2(F.lower(F.regexp_replace(F.trim(F.coalesce(text, F.lit(""))), r"[ \t\n\r\f\u000B]+", " ")), 256)


def cap_words(text: Column, n: int = 3000) -> Column:
    """The first n words with the white space between them."""
    return F.regexp_extract(F.coalesce(text, F.lit("")), rf"^((?:\s*\S+){{0,{n}}})", 1)


def excerpt(text: Column, at: Column, length: Column, around: int = 55) -> Column:
    """The match (at from 1) with context either side."""
    start = F.greatest(at - around, F.lit(1))
    return F.concat(F.when(start > 1, "...").otherwise(""), F.substring(text, start, at - start + length + around), F.when(at + length + around <= F.length(text), "...").otherwise(""))


def emails(text: Column) -> Column:
    """Distinct addresses in lower case."""
    return F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"), F.lit(0)), F.lower))


def repeated_words(text: Column) -> Column:
    """Words followed by themselves."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"(?i)\b([A-Za-z]+)\s+\1\b"))


def double_punctuation(text: Column) -> Column:
    """A comma or full stop twice."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r",,|(?<!\.)\.\.(?!\.)"))


#: Pattern rules without memory: name and what a hit looks like.
GRAMMAR_RULES = [
    ("sentence_space", r"[a-z][.!?][A-Z]"),
    ("space_before_comma", r"[A-Za-z] +,"),
    ("space_inside_parentheses", r"\( | \)"),
    ("lower_sentence_start", r"[.!?] +[a-z]"),
    ("a_before_vowel", r"(?:^|[ \n])[Aa] +[aeioAEIO][a-z]"),
    ("an_before_consonant", r"(?:^|[ \n])[Aa]n +[bcdfgjklmnpqrstvwxyzBCDFGJKLMNPQRSTVWXYZ][a-z]"),
]


def two_word_repeats(text: Column) -> Column:
    """Two words followed by themselves."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"(?i)\b([A-Za-z]+\s+[A-Za-z]+)\s+\1\b"))


def grammar_rule_hits(text: Column) -> Column:
    """An array of (rule, hits) for the rules that hit."""
    cells = F.array(*[F.struct(F.lit(name).alias("rule"), F.regexp_count(F.coalesce(text, F.lit("")), F.lit(pattern)).alias("hits")) for name, pattern in GRAMMAR_RULES])
    return F.filter(cells, lambda x: x["hits"] > 0)
