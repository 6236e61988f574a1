"""Findings as one schema, their scope, names and texts (I, F32, F33), text findings (D5, D12, D15, D18, E21), keywords (G20-G22), page scores."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quillmark.functions import text as T
from quillmark.functions.dims import entries
from quillmark.operators import scoring
from quillmark.operators.phrases import named, occurrences

#: The uniform record of a finding.
FINDING = {
    "page_id": "long", "rule_id": "string", "category": "string", "subcategory": "string", "impact": "string", "weight": "double", "criterion_id": "string", "wcag_level": "string", "wcag_version": "string",
    "is_best_practice": "boolean", "manual_review": "boolean", "selector": "string", "snippet": "string", "description": "string",
}
_DEFAULTS = {"impact": "moderate", "weight": 1.0, "is_best_practice": False, "manual_review": False}

#: Success criteria with the level and the version that brought them.
CRITERIA = {
    "2.0 A": "1.1.1 1.2.1 1.2.2 1.2.3 1.3.1 1.3.2 1.3.3 1.4.1 1.4.2 2.1.1 2.1.2 2.2.1 2.2.2 2.3.1 2.4.1 2.4.2 2.4.3 2.4.4 3.1.1 3.2.1 3.2.2 3.3.1 3.3.2 4.1.1 4.1.2",
    "2.0 AA": "1.2.4 1.2.5 1.4.3 1.4.4 1.4.5 2.4.5 2.4.6 2.4.7 3.1.2",
    "2.0 AAA": "1.4.6",
    "2.1 A": "2.1.4 2.5.1 2.5.2 2.5.3 2.5.4",
    "2.1 AA": "1.3.4 1.3.5 1.4.10 1.4.11 1.4.12 1.4.13",
    "2.2 A": "3.2.6 3.3.7",
    "2.2 AA": "2.4.11 2.5.7 2.5.8 3.3.8",
    "2.2 AAA": "2.4.13",
}
#: Accessibility rules that stay, each with the rules whose evidence it takes, and its criterion.
SCOPE = {
    "keyboard_functionality": ("2.1.1", "aria-hidden-focus frame-focusable-content nested-interactive focus-visible"),
    "lists_markup": ("1.3.1", "definition-list dlitem list listitem"),
    "page_title_accessibility": ("2.4.2", "document-title"),
    "broken_anchor_links": (None, ""),
    "consistent_help": ("3.2.6", ""),
    "meaningful_sequence": ("1.3.2", ""),
    "alt_text_appropriate": ("1.1.1", "area-alt image-alt image-redundant-alt input-image-alt object-alt"),
    "redundant_entry": ("3.3.7", ""),
    "drag_alternative": ("2.5.7", ""),
    "inactivity_data_loss": ("2.2.6", "meta-refresh meta-refresh-no-exceptions"),
    "pause_animated_content": ("2.2.2", "blink marquee no-autoplay-audio"),
    "unusual_words_definitions": ("3.1.3", ""),
    "decorative_images_accessibility": ("1.1.1", ""),
    "text_should_be_heading": ("1.3.1", "p-as-heading"),
    "new_tab_accessibility": ("3.2.1", ""),
    "visual_presentation_text": ("1.4.8", ""),
    "interruptions_suppressible": ("2.2.4", ""),
    "large_interactive_controls": ("2.5.5", "target-size"),
    "very_high_contrast": ("1.4.6", "color-contrast-enhanced"),
    "consistent_navigation": ("3.2.3", ""),
    "abbreviations_meaning": ("3.1.4", ""),
    "descriptive_headings_labels": ("2.4.6", ""),
    "images_of_text": ("1.4.9", ""),
    "timing_not_essential": ("2.2.3", ""),
    "custom_tab_order": ("2.4.3", "accesskeys focus-order-semantics"),
    "three_flashes_a": ("2.3.1", ""),
    "flashing_content_aaa": ("2.3.2", ""),
    "consistent_identification": ("3.2.4", "identical-links-same-purpose"),
    "text_conveys_information_accessibility": ("1.3.3", ""),
    "multiple_ways": ("2.4.5", ""),
}
#: Groups of people by the criteria that serve them most.
GROUPS = {
    "Visual": "1.1.1 1.3.1 1.3.2 1.3.3 1.3.4 1.3.5 1.3.6 1.4.1 1.4.3 1.4.4 1.4.5 1.4.6 1.4.8 1.4.9 1.4.10 1.4.11 1.4.12 1.4.13 2.4.1 2.4.2 2.4.3 2.4.4 2.4.5 2.4.6 2.4.7 2.4.9 2.4.10 2.4.11 3.1.1 3.1.2 3.2.1 3.2.2 3.3.1 3.3.2 4.1.2 4.1.3",
    "Auditory": "1.2.1 1.2.2 1.2.3 1.2.4 1.2.5 1.2.6 1.2.7 1.2.8 1.2.9 1.4.2 1.4.7",
    "Motor": "2.1.1 2.1.2 2.1.3 2.1.4 2.2.1 2.2.2 2.2.3 2.2.4 2.2.5 2.2.6 2.4.1 2.4.3 2.4.7 2.4.11 2.4.12 2.4.13 2.5.1 2.5.2 2.5.3 2.5.4 2.5.5 2.5.6 2.5.7 2.5.8 3.2.1 3.2.2 3.3.2",
    "Cognitive": "1.3.1 1.4.8 1.4.12 2.2.1 2.2.2 2.2.6 2.4.2 2.4.5 2.4.6 3.1.1 3.1.2 3.1.3 3.1.4 3.1.5 3.1.6 3.2.1 3.2.2 3.2.3 3.2.4 3.2.6 3.3.1 3.3.2 3.3.3 3.3.4 3.3.7 3.3.8",
}
#: Grammar rules that are dropped, by name or by their start, and the labels of the others.
GRAMMAR_SKIP = ["UNPAIRED_BRACKETS", "EN_QUOTES", "MULTIPLICATION_SIGN", "ARROWS", "WORD_CONTAINS_UNDERSCORE", "DASH_RULE", "WHITESPACE_RULE", "CONSECUTIVE_SPACES"]
GRAMMAR_SKIP_STARTS = ["MORFOLOGIK_RULE", "HUNSPELL_RULE", "SPELLER_RULE"]
GRAMMAR_LABELS = [
    ("ENGLISH_WORD_REPEAT_RULE", "Word repetition (e.g. 'will will')", "error"),
    ("WORD_REPEAT_RULE", "Word repetition (e.g. 'will will')", "error"),
    ("PHRASE_REPETITION", "Repetition of two words ('at the at the')", "error"),
    ("ENGLISH_WORD_REPEAT_BEGINNING_RULE", "Repeated sentence opening", "error"),
    ("DOUBLE_PUNCTUATION", "Repeated punctuation", "error"),
    ("EN_A_VS_AN", "Use of 'a' vs. 'an'", "warning"),
    ("SENTENCE_WHITESPACE", "Missing space between sentences", "warning"),
    ("COMMA_PARENTHESIS_WHITESPACE", "Use of whitespace before comma and before/after parentheses", "warning"),
    ("UPPERCASE_SENTENCE_START", "Checks that a sentence starts with an uppercase letter", "warning"),
    ("PLURAL_VERB_AFTER_THIS", "Possible agreement error: plural noun + singular verb", "warning"),
    ("SINGULAR_NOUN_VERB_AGREEMENT", "Possible agreement error: plural noun + singular verb", "warning"),
    ("NUMEROUS_NOUN_AGREEMENT", "Possible agreement error: numeral + singular countable noun", "warning"),
]


def criteria(spark: SparkSession) -> DataFrame:
    """The catalogue of criteria as a frame, a few dozen rows."""
    rows = [(c, *key.split(" ")) for key, ids in CRITERIA.items() for c in ids.split()]
    return spark.createDataFrame(rows, "criterion_id string, cat_version string, cat_level string")


def scope(spark: SparkSession) -> DataFrame:
    rows = [(rule, to, criterion) for to, (criterion, sources) in SCOPE.items() for rule in (to, *sources.split())]
    return spark.createDataFrame(rows, "rule_id string, scoped_rule string, scoped_criterion string")


def groups(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(g, c) for g, ids in GROUPS.items() for c in ids.split()], "group string, criterion_id string")


def to_finding(rows: DataFrame, **constants) -> DataFrame:
    """Rows as uniform findings: constants and defaults fill what they lack; snippets end at 2000 characters."""

    def value(c: str, kind: str) -> Column:
        if c in constants:
            return F.lit(constants[c])
        fallback = F.lit(_DEFAULTS.get(c))
        return F.coalesce(F.col(c).cast(kind), fallback) if c in rows.columns else fallback

    out = rows.select(*[value(c, kind).cast(kind).alias(c) for c, kind in FINDING.items()])
    return out.withColumn("snippet", F.substring("snippet", 1, 2000))


def union_findings(*frames: DataFrame) -> DataFrame:
    """The findings of several checks, missing columns null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def override_levels(findings: DataFrame) -> DataFrame:
    """F32: level and version from the catalogue of criteria where it knows the criterion, else as the tags said."""
    found = findings.join(F.broadcast(criteria(findings.sparkSession)), "criterion_id", "left")  # the catalogue is fixed
    return found.withColumn("wcag_level", F.coalesce("cat_level", "wcag_level")).withColumn("wcag_version", F.coalesce("cat_version", "wcag_version")).select(*findings.columns)


def scope_accessibility(findings: DataFrame) -> DataFrame:
    """I4: accessibility findings under the rules they are consolidated into, others of that category dropped; other categories pass."""
    found = findings.join(F.broadcast(scope(findings.sparkSession)), "rule_id", "left").where((F.col("category") != "accessibility") | F.col("scoped_rule").isNotNull())
    is_acc = F.col("category") == "accessibility"
    changed = {"rule_id": F.when(is_acc, F.col("scoped_rule")).otherwise(F.col("rule_id")), "criterion_id": F.when(is_acc, F.col("scoped_criterion")).otherwise(F.col("criterion_id"))}
    return found.select(*[changed[c].alias(c) if c in changed else F.col(c) for c in findings.columns])


def attach_capture(findings: DataFrame, captures: DataFrame) -> DataFrame:
    """capture_width and capture_height of findings, from their page and viewport (captures) where they have none."""
    c = captures.select("page_id", "viewport", F.col("width").alias("_w"), F.col("height").alias("_h"))
    out = findings.join(c, ["page_id", "viewport"], "left")
    return out.withColumn("capture_width", F.coalesce("capture_width", "_w")).withColumn("capture_height", F.coalesce("capture_height", "_h")).select(*findings.columns)


def page_finding_counts(findings: DataFrame) -> DataFrame:
    """Scored and assisted findings of each page."""
    return findings.groupBy("scan_id", "page_id").agg(F.count_if(~F.col("manual_review")).alias("issue_count"), F.count_if("manual_review").alias("manual_review_count"))


def attach_display(findings: DataFrame, catalog: DataFrame) -> DataFrame:
    """I8: a readable name for each rule: the catalogue's (rule_id, display), else the rule id in words."""
    words = F.initcap(F.translate("rule_id", "_-", "  "))
    return findings.join(F.broadcast(catalog), "rule_id", "left").withColumn("display", F.coalesce("display", words))  # one row for each rule


def remediation(findings: DataFrame, catalog: DataFrame) -> DataFrame:
    """what to do: the catalogue's text (criterion_id, name, text), else one with the criterion's name, else a general one."""
    named = F.concat(F.lit("Mend what was flagged for "), "criterion_id", F.lit(" "), "name", F.lit("."))
    return findings.join(F.broadcast(catalog), "criterion_id", "left").withColumn("remediation", F.coalesce("text", named, F.lit("Review the flagged elements."))).drop("name", "text")


def affected_groups(checks: DataFrame) -> DataFrame:
    """Failing accessibility checks of each run by group of people; groups without any have 0."""
    g = F.broadcast(groups(checks.sparkSession))  # the grouping is fixed
    failing = checks.where("category = 'accessibility' AND check_score < 100").select("scan_id", "criterion_id").join(g, "criterion_id").groupBy("scan_id", "group").agg(F.count("*").alias("n"))
    grid = checks.select("scan_id").distinct().select("scan_id", F.explode(F.array(*[F.lit(x) for x in GROUPS])).alias("group"))
    return grid.join(failing, ["scan_id", "group"], "left").select("scan_id", "group", F.coalesce("n", F.lit(0)).alias("failing"))


# Texts
def text_findings(pages: DataFrame) -> DataFrame:
    """Readability and reading-level findings of pages (page_id, text)."""
    words = T.word_count(F.col("text"))
    weight = T.readability_weight(F.col("text"))
    none = F.array().cast("array<struct<rule_id string, weight double>>")
    one = lambda rule, w: F.array(F.struct(F.lit(rule).alias("rule_id"), w.cast("double").alias("weight")))
    hard = F.when((words >= 120) & (T.flesch_kincaid_grade(F.col("text")) > 9.0), one("reading_level_aaa", F.lit(1.0))).otherwise(none)
    found = F.concat(F.when(weight > 0, one("readability", weight)).otherwise(none), hard)
    return pages.select("page_id", F.explode(found).alias("f")).select("page_id", "f.*")


def grammar_sources(pages: DataFrame) -> DataFrame:
    """The texts of a page to check, one row each: visible, title, alt_text, navigation; blank ones are left out."""
    names = ["visible", "title", "alt_text", "navigation"]
    return pages.unpivot(["page_id"], names, "source", "text").where("trim(text) <> ''")


def grammar_labels(matches: DataFrame) -> DataFrame:
    """Matches (rule_id, message) that count, each with its label and severity."""
    rule = F.coalesce("rule_id", F.lit(""))
    skip = rule.isin(GRAMMAR_SKIP) | reduce(lambda a, b: a | b, [rule.startswith(s) for s in GRAMMAR_SKIP_STARTS])
    dim = F.broadcast(matches.sparkSession.createDataFrame(GRAMMAR_LABELS, "rule_id string, _label string, _severity string"))
    rows = matches.where(~skip).join(dim, "rule_id", "left")
    message = F.substring(F.rtrim(F.trim(F.coalesce("message", F.lit(""))), F.lit(".")), 1, 120)
    repeat, agree = rule.contains("WORD_REPEAT") | rule.contains("PHRASE_REPEAT"), rule.contains("AGREEMENT") | rule.contains("SUBJECT_VERB")
    label = F.coalesce("_label", F.when(repeat, "Word repetition (e.g. 'will will')").when(agree, "Possible agreement error").when(message != "", message).otherwise("Grammar issue"))
    severity = F.coalesce("_severity", F.when(repeat, "error").otherwise("warning"))
    return rows.select(*matches.columns, label.alias("label"), severity.alias("severity"))


def locate_phrases(pages: DataFrame, phrases: list[str], around: int = 60, each: int = 8, overall: int = 400) -> DataFrame:
    """Whole-word occurrences of the phrases in pages (page_id, text), any case, with their surroundings.

    ``number`` counts the occurrences of a phrase in a page, ``total`` tells how many
    there are; the first ``each`` of a phrase and ``overall`` of a page are kept.
    """
    rows = named(occurrences(pages, phrases, around=around, each=each), phrases)
    rows = rows.withColumn("rank", F.row_number().over(W.partitionBy("page_id").orderBy("at", "phrase"))).where(F.col("rank") <= overall)
    return rows.select("page_id", "phrase", "number", "total", "at", "context")


def terms_present(pages: DataFrame, terms: list[str], most: int = 30) -> DataFrame:
    """Which of the terms (the first ``most``, up to 80 characters, case-blind distinct) occur as whole words in pages (page_id, text)."""
    kept, seen = [], set()
    for t in terms[:most]:
        if t.strip() and len(t.strip()) <= 80 and t.strip().lower() not in seen:
            seen.add(t.strip().lower())
            kept.append(t.strip())
    found = named(occurrences(pages, kept, each=1), kept)
    return found.select("page_id", F.col("phrase").alias("term"))


def effective_policy_rules(sites: DataFrame, own: DataFrame, defaults: DataFrame) -> DataFrame:
    """The rules of each site: its own (site_id, rule, pattern), cleaned, else the defaults (rule, pattern; a handful)."""
    clean = own.where("trim(rule) <> '' AND trim(pattern) <> ''").select("site_id", "rule", F.trim("pattern").alias("pattern"))
    without = sites.select("site_id").join(clean.select("site_id").distinct(), "site_id", "left_anti")
    return clean.unionByName(without.select("site_id", F.explode(entries(defaults, ["rule", "pattern"])).alias("d")).select("site_id", "d.rule", "d.pattern"))


# Scores
def page_category_scores(pages: DataFrame, issues: DataFrame, labels: dict[str, str], active: list[str]) -> DataFrame:
    """A score for each page and label of a category; null where the category is not active. Reviewed findings do not count."""
    scores = scoring.page_scores(pages, issues.where("NOT reviewed"))
    cell = lambda c: F.col("cat_" + c.lower().replace(" ", "_")) if c in active else F.lit(None).cast("int")
    return scores.select("scan_id", "page_id", F.explode(F.array(*[F.struct(F.lit(label).alias("label"), cell(c).cast("int").alias("score")) for c, label in labels.items()])).alias("s")).select("scan_id", "page_id", "s.*")


def rescore_run(pages: DataFrame, issues: DataFrame, extra: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Check, site and page scores from stored rows, with further findings if any; the caller replaces the run's rows."""
    rows = issues if extra is None else issues.unionByName(extra, allowMissingColumns=True)
    checks = scoring.check_scores(pages, rows)
    return checks, scoring.site_scores(pages, checks), scoring.page_scores(pages, rows)


def predicted_scores(counts: DataFrame, knobs: DataFrame) -> DataFrame:
    """A score for each page from its counts (page, check_id, count) and the knobs (check_id, worst, most): what each check takes off, up to its most."""
    taken = F.col("most") * F.least(F.col("count") / F.greatest(F.coalesce("worst", F.lit(4.0)), F.lit(1e-6)), F.lit(1.0))
    lost = counts.join(F.broadcast(knobs), "check_id", "left").groupBy("page").agg(F.sum(F.when((F.col("count") > 0) & F.col("most").isNotNull(), taken).otherwise(0.0)).alias("lost"))
    return lost.select("page", F.greatest(F.lit(0.0), 100.0 - F.col("lost")).alias("predicted"))


def squared_error(predicted: DataFrame, scores: DataFrame) -> DataFrame:
    """The sum of squared errors against external scores (page, score); pages without counts are predicted 100."""
    both = scores.join(predicted, "page", "left").select((F.coalesce("predicted", F.lit(100.0)) - F.col("score")).alias("e"))
    return both.agg(F.sum(F.col("e") * F.col("e")).alias("sse"), F.count("*").alias("pages"))
