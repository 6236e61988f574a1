"""Findings from captured results: engine JSON, headers, boxes, colours, PDF facts (F27-F35, G, H13).

Inputs are JSON strings or structs with declared schemas; what does not parse is
null and makes no finding.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quillmark.functions import text as T
from quillmark.functions.dims import entries
from quillmark.operators import scratch
from quillmark.operators.phrases import keyword_findings, named, occurrences

_NODE = "array<struct<target array<string>, html string, impact string>>"
_ITEM = f"array<struct<id string, impact string, description string, help string, helpUrl string, tags array<string>, nodes {_NODE}>>"
AXE = f"violations {_ITEM}, incomplete {_ITEM}, passes {_ITEM}"
LIGHTHOUSE = "audits map<string, struct<score double, numericValue double, title string, displayValue string>>"

#: Version tags, newest first.
VERSION_TAGS = [(f"wcag{v}{a}", f"2.{v[1]}" if len(v) > 1 else "2.0", a.upper()) for v in ("22", "21", "2") for a in ("aaa", "aa", "a")]

#: Audit, rule, severity. They fire below SCORE_FAIL.
SCORE_FAIL = 0.9
SCORE_AUDITS = [
    ("render-blocking-resources", "render_blocking_resources", "warning"),
    ("unused-javascript", "unused_javascript", "warning"),
    ("unused-css-rules", "unused_css", "warning"),
    ("legacy-javascript", "legacy_javascript", "warning"),
    ("third-party-summary", "third_party_impact", "warning"),
    ("long-tasks", "long_main_thread_tasks", "warning"),
    ("uses-long-cache-ttl", "cache_ttl", "warning"),
    ("font-display", "font_display", "warning"),
    ("unminified-css", "unminified_css", "warning"),
    ("unminified-javascript", "unminified_javascript", "warning"),
    ("uses-rel-preconnect", "preconnect_missing", "warning"),
    ("network-rtt", "high_rtt", "warning"),
    ("bootup-time", "js_execution_time", "warning"),
    ("offscreen-images", "defer_offscreen_images", "error"),
    ("modern-image-formats", "image_modern_format", "warning"),
    ("uses-responsive-images", "image_resolution", "warning"),
    ("uses-optimized-images", "image_optimization", "warning"),
    ("uses-passive-event-listeners", "passive_event_listeners", "info"),
]
#: Audit, rule, severity, threshold. They fire above it.
VALUE_AUDITS = [
    ("dom-size", "excessive_dom_size", "warning", 1500.0),
    ("total-byte-weight", "total_page_weight", "warning", 1_600_000.0),
    ("interactive", "time_to_interactive", "info", 5000.0),
]


def classify_tags(tags: Column) -> Column:
    """F32: struct of version, level, criterion_id and is_best_practice; the newest version tag wins."""
    version, level = F.lit(None).cast("string"), F.lit(None).cast("string")
    for tag, v, a in reversed(VERSION_TAGS):
        has = F.array_contains(tags, tag)
        version, level = F.when(has, v).otherwise(version), F.when(has, a).otherwise(level)
    code = F.get(F.filter(tags, lambda t: t.rlike(r"^wcag\d\d\d+$")), 0)
    criterion = F.concat_ws(".", F.substring(code, 5, 1), F.substring(code, 6, 1), F.substring(code, 7, 9).cast("int").cast("string"))
    best = F.coalesce(F.array_contains(tags, "best-practice"), F.lit(False)) & version.isNull()
    return F.struct(version.alias("version"), level.alias("level"), F.when(code.isNotNull(), criterion).alias("criterion_id"), best.alias("is_best_practice"))


def axe_issues(results: DataFrame) -> DataFrame:
    """one row for each node of violations (scored) and incomplete items (for review). results: page_id, body."""
    parsed = results.select("page_id", F.from_json("body", AXE).alias("r"))
    both = F.array(*[F.struct(F.lit(review).alias("manual_review"), F.coalesce(f"r.{name}", F.array().cast(_ITEM)).alias("items")) for name, review in (("violations", False), ("incomplete", True))])
    items = parsed.select("page_id", F.explode(both).alias("b")).select("page_id", "b.manual_review", F.explode("b.items").alias("i"))
    nodes = items.select("page_id", "manual_review", "i", F.explode("i.nodes").alias("n")).withColumn("w", classify_tags(F.coalesce("i.tags", F.array().cast("array<string>"))))
    return nodes.select(
        "page_id", "manual_review", F.col("i.id").alias("rule_id"), F.coalesce("n.impact", "i.impact").alias("impact"), F.col("i.description").alias("description"), F.array_join("n.target", " > ").alias("selector"),
        F.element_at("n.target", -1).alias("leaf_selector"), F.substring("n.html", 1, 2000).alias("snippet"), F.col("w.version").alias("wcag_version"), F.col("w.level").alias("wcag_level"), F.col("w.criterion_id").alias("criterion_id"), F.col("w.is_best_practice").alias("is_best_practice"),
    )


def axe_pass_summary(results: DataFrame) -> DataFrame:
    """nodes of each passed rule."""
    return results.select("page_id", F.explode(F.from_json("body", AXE)["passes"]).alias("i")).select("page_id", F.col("i.id").alias("rule_id"), F.size("i.nodes").alias("nodes"))


def lighthouse_findings(results: DataFrame) -> DataFrame:
    """Audits below the score, or values above their threshold. results: page_id, body."""
    dim = results.sparkSession.createDataFrame([(a, r, s, None) for a, r, s in SCORE_AUDITS] + VALUE_AUDITS, "audit string, rule_id string, severity string, threshold double")
    audits = results.select("page_id", F.explode(F.from_json("body", LIGHTHOUSE)["audits"]).alias("audit", "a"))
    rows = audits.join(F.broadcast(dim), "audit")  # the audits are fixed
    fires = F.when(F.col("threshold").isNull(), F.col("a.score") < SCORE_FAIL).otherwise(F.col("a.numericValue") > F.col("threshold"))
    return rows.where(fires).select("page_id", "rule_id", "severity", F.col("a.score").alias("score"), F.col("a.numericValue").alias("value"))


def header_findings(responses: DataFrame) -> DataFrame:
    """Responses with page_id, is_https, headers (lower-case names), cookies, ttfb_ms."""
    lacks = lambda h: ~F.map_contains_key("headers", F.lit(h))
    rules = [
        ("hsts", lacks("strict-transport-security"), "serious"),
        ("csp_missing", lacks("content-security-policy"), "moderate"),
        ("privacy_enhanced", lacks("x-frame-options") | lacks("x-content-type-options"), "moderate"),
        ("cookie_ssl", F.col("is_https") & F.exists("cookies", lambda c: ~c["secure"]), "serious"),
        ("server_response_time", F.col("ttfb_ms") > 600, "minor"),
    ]
    found = F.array_compact(F.array(*[F.when(cond, F.struct(F.lit(r).alias("rule_id"), F.lit(i).alias("impact"))) for r, cond, i in rules]))
    return responses.select("page_id", F.explode(found).alias("f")).select("page_id", "f.rule_id", "f.impact")


def target_size(boxes: DataFrame, least: float = 24.0, native: tuple[str, ...] = ("INPUT", "SELECT", "TEXTAREA"), inline_parents: tuple[str, ...] = ("P", "LI", "TD", "SPAN", "DD")) -> DataFrame:
    """boxes (page_id, target_id, x, y, width, height, tag, display, parent_tag) under the least size with a close neighbour.

    A range join on cells four times the least distance wide: all centres go to their
    own cell, and those of small boxes to each that holds a point within the least
    distance of them too, two or three on average. The boxes are computed once.
    """
    inline = (F.col("tag") == "A") & F.col("display").startswith("inline") & F.col("parent_tag").isin(*inline_parents)
    small = ((F.col("width") < least) | (F.col("height") < least)) & ~inline
    b = boxes.select("page_id", "target_id", (F.col("x") + F.col("width") / 2).alias("cx"), (F.col("y") + F.col("height") / 2).alias("cy"), F.coalesce(small, F.lit(False)).alias("small"), F.col("tag").isin(*native).alias("manual_review"))
    b = scratch.written(b)
    cell = lambda c: F.floor(c / (4 * least))
    over = lambda c: F.explode(F.sequence(cell(F.col(c) - least), cell(F.col(c) + least)))
    placed = b.where("cx IS NOT NULL AND cy IS NOT NULL")
    cells = placed.where("small").drop("small").withColumn("gx", over("cx")).withColumn("gy", over("cy"))
    other = placed.select("page_id", F.col("target_id").alias("other"), cell(F.col("cx")).alias("gx"), cell(F.col("cy")).alias("gy"), F.col("cx").alias("ox"), F.col("cy").alias("oy"))
    near = cells.join(other, ["page_id", "gx", "gy"]).where("target_id <> other")
    near = near.withColumn("dist", F.hypot(F.col("cx") - F.col("ox"), F.col("cy") - F.col("oy"))).where(F.col("dist") < least)
    return near.groupBy("page_id", "target_id").agg(F.min("dist").alias("distance"), F.first("manual_review").alias("manual_review"))


def nearest_color(colors: DataFrame, approved: DataFrame, most: float = 20.0) -> DataFrame:
    """Colours (page_id, r, g, b) farther than ``most`` from every approved one (name, r, g, b; a handful), with the nearest, on a tie the first by name."""
    square = lambda a, c: (F.col(c) - a[c]) * (F.col(c) - a[c])
    away = F.array_min(F.transform(entries(approved, ["name", "r", "g", "b"]), lambda a: F.struct(F.sqrt(square(a, "r") + square(a, "g") + square(a, "b")).alias("distance"), a["name"].alias("name"))))
    best = colors.distinct().select("page_id", "r", "g", "b", away.alias("m")).select("page_id", "r", "g", "b", F.col("m.name").alias("nearest"), "m.distance")
    return best.where(F.col("distance") > most)


def pdf_checks(info: DataFrame) -> DataFrame:
    """checks on PDF facts; documents with an error are skipped."""
    blank = lambda c: F.coalesce(F.trim(F.col(c)), F.lit("")) == ""
    rules = [
        ("pdf_not_tagged", ~F.col("marked")),
        ("pdf_no_title", blank("title")),
        ("pdf_no_language", blank("lang")),
        ("pdf_no_bookmarks", (F.col("pages") > 10) & ~F.col("has_bookmarks")),
        ("pdf_headings", F.col("font_size_spread") < 2.0),
        ("pdf_headings_review", F.col("font_size_spread") >= 2.0),
        ("pdf_garbled_text", ~F.col("has_text") | (F.col("garbled_ratio") > 0.30)),
        ("pdf_contrast", F.lit(True)),
    ]
    found = F.array_compact(F.array(*[F.when(c, F.lit(r)) for r, c in rules]))
    return info.where("error IS NULL").select("url", F.explode(found).alias("rule_id"))


def pdf_contacts(info: DataFrame) -> DataFrame:
    """phone numbers and addresses that documents (url, text, error) print, each once whatever its case."""
    phones = F.array_distinct(F.regexp_extract_all("text", F.lit(r"\+?1?[ .-]?\(?[2-9]\d{2}\)?[ .-]\d{3}[ .-]\d{4}"), F.lit(0)))
    each = lambda rule, values: F.transform(values, lambda x: F.struct(F.lit(rule).alias("rule_id"), F.trim(x).alias("value")))
    found = F.concat(each("phone_numbers_exposed", phones), each("email_addresses_exposed", T.emails(F.col("text"))))
    return info.where("error IS NULL").select("url", F.explode(found).alias("f")).select("url", "f.*")


def pdf_scores(info: DataFrame, findings: DataFrame, checks: int = 8) -> DataFrame:
    """Share of checks not failed, half even; null where the document was never parsed."""
    failed = findings.groupBy("url").agg(F.countDistinct("rule_id").alias("f"))
    score = F.bround(100.0 * (checks - F.coalesce("f", F.lit(0))) / checks, 0).cast("int")
    return info.join(failed, "url", "left").select("url", F.when(F.col("error").isNull(), score).alias("score"))


def policy_keywords(pages: DataFrame, rules: DataFrame, around: int = 40) -> DataFrame:
    """For each page (page_id, text) and rule (rule, pattern; the caller's list) the occurrences, the patterns that occur, the first excerpt, and those of the first five patterns."""
    named_rules = [(r["rule"], r["pattern"]) for r in rules.where("pattern <> ''").distinct().collect()]  # a caller's list of rules
    patterns = sorted({p for _, p in named_rules}, key=lambda p: (p.lower(), p))
    found = named(occurrences(pages, patterns, whole=False, around=around), patterns)
    of = pages.sparkSession.createDataFrame(sorted({(r, p.lower()) for r, p in named_rules}) or [], "rule string, _p string")
    return keyword_findings(found.withColumn("_p", F.lower("phrase")).join(of, "_p"))


def suppress_grammar(findings: DataFrame, approved: DataFrame, ignored: DataFrame) -> DataFrame:
    """Without approved texts (site_id, error_text) and ignored rules (site_id, rule_id) of the same site."""
    return findings.join(approved, ["site_id", "error_text"], "left_anti").join(ignored, ["site_id", "rule_id"], "left_anti")


def add_aliases(findings: DataFrame, aliases: DataFrame) -> DataFrame:
    """Findings and copies of them under the alias rules (rule_id, alias_id, alias_category; a fixed list)."""
    copies = findings.join(F.broadcast(aliases), "rule_id").withColumn("rule_id", F.col("alias_id")).withColumn("category", F.col("alias_category"))
    return findings.unionByName(copies.select(*findings.columns))


def redundant_entry(fields: DataFrame) -> DataFrame:
    """later fields of a form (page_id, form, pos, key) that ask for the same thing again."""
    w = W.partitionBy("page_id", "form", "key").orderBy("pos")
    return fields.where("key <> ''").withColumn("rank", F.row_number().over(w)).withColumn("first_pos", F.first("pos").over(w)).where("rank > 1")
