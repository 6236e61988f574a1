"""Compliance and freshness checks on page signals (H1-H12). Findings: page_id, rule_id, impact, manual_review, detail.

All of it is column expressions, words of a text being an array, but for the phrases by
tier: those are found by the automaton of ``phrases``.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.functions.text import emails
from quillmark.operators.phrases import tier_counts

#: Phrases by tier, in the order in which they claim spans.
PHRASE_TIERS = [
    ["diversity, equity and inclusion office", "DEI office", "office of diversity", "diversity officer", "chief diversity officer", "DEI initiative", "DEI program", "DEI training required", "DEI certification", "DEI committee"],
    ["diversity and inclusion", "equity and inclusion", "DEI", "diversity initiative", "inclusion program", "affirmative action program", "EEO program"],
    ["study of diversity", "research on diversity", "diversity in [field]", "historical diversity"],
]
#: Words of academic records, and of directory information.
GRADE_TERMS = ["GPA", "grade point", "transcript", "academic record", "passed", "failed", "incomplete"]
DIRECTORY_TERMS = ["major", "degree", "GPA", "graduation", "enrollment", "honor roll", "scholarship"]

#: Parts of paths that list people, and the seasons that date a page.
LISTINGS = ["directory", "student", "students", "honor", "scholarship", "staff", "faculty", "people"]
STAFF = ["staff", "faculty", "directory", "people"]
SEASONS = ["spring", "fall", "summer", "winter"]


def _segments(url: Column) -> Column:
    """The parts of a URL's path in lower case; a last part counts only without a query or fragment, as it must end there."""
    return F.split(F.lower(F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/]*", "")), "/")


def _terms(text: Column, terms: list[str]) -> Column:
    return F.array_compact(F.array(*[F.when(text.rlike(rf"(?i)\b{re.escape(t)}\b"), F.lit(t)) for t in terms]))


def student_ids(text: Column) -> Column:
    """H6: words that are R and eight digits, or nine digits; words of addresses, scripts and code do not count."""
    shown = F.regexp_replace(text, r"(?is)<(?:script|code)\b.*?</(?:script|code)>", " ")
    chunks = F.transform(F.split(shown, r"\s+"), lambda w: F.regexp_replace(w, r"(?:https?://|www\.).*", ""))
    words = F.flatten(F.transform(chunks, lambda w: F.split(w, r"\W+")))
    return F.filter(words, lambda w: w.rlike(r"^(?:R\d{8}|\d{9})$"))


def outdated_years(text: Column, url: Column, year: int) -> Column:
    """A season of a year before the last, or a range that starts before the one before that; not in history or archive."""
    dated = F.regexp_extract_all(text, F.lit(rf"(?i)\b(?:{'|'.join(SEASONS)})\s+20\d\d\b"), F.lit(0))
    ranges = F.regexp_extract_all(text, F.lit(r"\b20\d\d[-\u2013]\d\d\b"), F.lit(0))
    old = F.concat(F.filter(dated, lambda x: F.substring(x, -4, 4).cast("int") < year - 1), F.filter(ranges, lambda x: F.substring(x, 1, 4).cast("int") < year - 2))
    past = F.lower(url).contains("/history/") | F.lower(url).contains("/archive/")
    return F.when(past, F.array().cast("array<string>")).otherwise(old)


def phrase_tiers(pages: DataFrame) -> DataFrame:
    """For each page (page_id, text) with a phrase its counts by tier and the action. Phrases claim their places as in ``phrases.claimed``."""
    n = [F.col(f"tier{k}") for k in (1, 2, 3)]
    action = F.when(n[0] > 0, "Legal review required").when(n[1] > 0, "Review recommended").otherwise("Monitor")
    impact = F.when(n[0] > 0, "error").when(n[1] > 0, "warning").otherwise("info")
    return tier_counts(pages, PHRASE_TIERS).select("page_id", *n, action.alias("action"), impact.alias("impact"))


def oldest_change(stale: DataFrame) -> DataFrame:
    """Pages among the stale ones, and the longest time without a change."""
    return stale.agg(F.count("*").alias("pages"), F.max("days").alias("days"))


def stale_content(pages: DataFrame, now: Column) -> DataFrame:
    """Pages (page_id, url, last_changed_at) unchanged for more than 365 full days."""
    days = F.floor((F.unix_timestamp(now) - F.unix_timestamp("last_changed_at")) / 86_400)
    return pages.withColumn("days", days).where((F.col("days") > 365) & ~F.col("url").rlike("(?i)/privacy|/accessibility")).select("page_id", "url", "days")


def compliance_findings(signals: DataFrame, year: int, police: str = r"\b555-0199\b") -> DataFrame:
    """H1-H8, H10, H11 in one pass over the signals; ``police`` is the institution's own number as a pattern."""
    text, url = F.coalesce("text", F.lit("")), F.coalesce("url", F.lit(""))
    link = lambda rule: F.exists("links", rule)
    statement = link(lambda x: x["href"].rlike("(?i)accessibility|ada|disability") | x["text"].rlike("(?i)accessibility|ada|accessible"))
    emergency = link(lambda x: F.concat_ws(" ", x["href"], x["text"]).rlike("(?i)emergency|safety|alert"))
    documents = link(lambda x: x["href"].rlike(r"(?i)\.pdf$|download"))
    process = text.rlike("(?i)alternative format|request format|accessible format|disability services|accommodation")
    ids, grades, listing = student_ids(text), _terms(text, GRADE_TERMS), _terms(text, DIRECTORY_TERMS)
    identity = (F.size(F.filter(ids, lambda w: w.startswith("R"))) > 0) | text.rlike(r"\b[A-Z][a-z]+\s+[A-Z][a-z]+\b")
    contact = (F.size(emails(text)) > 0) | text.rlike(r"\(?\d{3}\)?[ .-]\d{3}[ .-]\d{4}")
    at = _segments(url)
    login = F.exists("forms", lambda f: F.lower(f["action"]).contains("login"))
    years = outdated_years(text, url, year)
    rules = [
        ("accessibility_statement_present", ~statement, "serious", False, F.lit("")),
        ("accessibility_statement_contact", url.rlike("(?i)/accessibility|/ada|/disability") & ~contact, "warning", True, url),
        ("alternative_format_process", documents & ~process, "warning", True, F.lit("")),
        ("emergency_info_linked", ~emergency, "warning", False, F.lit("")),
        ("emergency_contact_present", ~(text.rlike(police) | text.rlike(r"\b911\b") | emergency), "warning", False, F.lit("")),
        ("ferpa_student_id_exposure", F.size(ids) > 0, "error", True, F.array_join(ids, ",")),
        ("ferpa_grade_exposure", ~login & (F.size(grades) > 0) & identity, "error", True, F.array_join(grades, ",")),
        ("ferpa_directory_information", (F.size(listing) >= 2) & F.arrays_overlap(at, F.array(*[F.lit(x) for x in LISTINGS])), "warning", True, F.array_join(listing, ",")),
        ("outdated_year_reference", F.size(years) > 0, "info", True, F.array_join(years, ",")),
        ("former_staff_reference", F.arrays_overlap(at, F.array(*[F.lit(x) for x in STAFF])), "info", True, url),
    ]
    found = F.array_compact(F.array(*[F.when(c, F.struct(F.lit(r).alias("rule_id"), F.lit(i).alias("impact"), F.lit(m).alias("manual_review"), d.alias("detail"))) for r, c, i, m, d in rules]))
    return signals.select("page_id", F.explode(found).alias("f")).select("page_id", "f.*")
