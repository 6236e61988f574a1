"""Listings behind report screens: grammar, exposed values, forms, words, vitals, tables.

Payloads are JSON strings, read with declared schemas. Values are counted before
their pages are listed, and a list of pages holds the first so many by rank, so
nothing gathers the pages of a value that is on every page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quillmark.functions.dims import entries
from quillmark.operators.crosspage import link_confidence
from quillmark.operators.reports import OPEN, SCORED_OPEN, impact_rank

GRAMMAR = "rule_id string, error_text string, group string, severity string, lang_code string, excerpt string"
WORD = "word string, category string, suggestion string"
VITALS = "score double, lcp double, cls double, tbt double"


def check_issue_page(issues: DataFrame, pages: DataFrame, n: int = 100) -> DataFrame:
    """Of each run and rule the first n findings with their page's URL."""
    w = W.partitionBy("scan_id", "rule_id").orderBy("issue_id")
    top = issues.select("scan_id", "page_id", "rule_id", "issue_id", "impact").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
    return top.join(pages.select("scan_id", "page_id", "url"), ["scan_id", "page_id"])


def lookup_issues(ids: DataFrame, issues: DataFrame, pages: DataFrame, site_id: int) -> DataFrame:
    """Page, URL and run of the findings with the ids (issue_id) that belong to the site."""
    found = issues.where(F.col("site_id") == site_id).join(ids.select("issue_id").distinct(), "issue_id", "left_semi")
    return found.select("issue_id", "scan_id", "page_id").join(pages.select("scan_id", "page_id", "url"), ["scan_id", "page_id"])


def grammar_groups(findings: DataFrame) -> DataFrame:
    """Findings (scan_id, issue_id, payload, is_approved, is_ignored) by rule and text: quantity, label, severity; the rank puts errors first."""
    rows = findings.where("NOT is_approved AND NOT is_ignored").where(F.get_json_object("payload", "$").isNotNull()).select("scan_id", "issue_id", F.from_json("payload", GRAMMAR).alias("p"))
    first = F.min_by(F.struct("p.group", "p.severity", "p.excerpt"), "issue_id")
    per = rows.groupBy("scan_id", F.coalesce("p.rule_id", F.lit("")).alias("rule_id"), F.coalesce("p.error_text", F.lit("")).alias("error_text")).agg(F.count("*").alias("quantity"), first.alias("f"))
    out = per.select("scan_id", "rule_id", "error_text", "quantity", F.col("f.group").alias("group"), F.col("f.severity").alias("severity"))
    severity = F.when(F.col("severity") == "error", 0).when(F.col("severity") == "warning", 1).otherwise(2)
    return out.withColumn("severity_rank", severity)


def grammar_languages(findings: DataFrame) -> DataFrame:
    """Languages that a run's grammar findings are in."""
    lang = F.get_json_object("payload", "$.lang_code")
    return findings.where("NOT is_approved AND NOT is_ignored").select("scan_id", lang.alias("lang")).where("lang <> ''").distinct()


def flag_grammar(findings: DataFrame, field: str, value: str, flag: str) -> DataFrame:
    """Findings with ``flag`` (is_approved or is_ignored) and reviewed set where the payload's field equals the value; the caller overwrites their partition."""
    hit = F.coalesce(F.get_json_object("payload", f"$.{field}") == value, F.lit(False))
    return findings.withColumn(flag, F.col(flag) | hit).withColumn("reviewed", F.col("reviewed") | hit)


def exposed_values(findings: DataFrame, field: str, key: Column | None = None, n: int = 50) -> DataFrame:
    """Values in the payload's array, grouped by key, once for a finding: a form of it, the quantity, the first n pages.

    findings: scan_id, issue_id, page_id, payload. ``key`` is an expression on ``value``.
    """
    values = F.from_json(F.get_json_object("payload", f"$.{field}"), "array<string>")
    rows = findings.where(OPEN).select("scan_id", "issue_id", "page_id", F.explode(values).alias("value")).withColumn("key", F.col("value") if key is None else key).where("key <> ''")
    once = rows.groupBy("scan_id", "key", "issue_id", "page_id").agg(F.min("value").alias("value"))
    ranked = once.withColumn("rank", F.row_number().over(W.partitionBy("scan_id", "key").orderBy("issue_id")))
    listed = F.array_sort(F.collect_list(F.when(F.col("rank") <= n, F.struct("rank", "page_id"))))
    per = ranked.groupBy("scan_id", "key").agg(F.min("value").alias("value"), F.count("*").alias("quantity"), listed.alias("l"))
    return per.select("scan_id", "key", "value", "quantity", F.array_join(F.transform("l", lambda x: x["page_id"].cast("string")), ",").alias("pages"))


def phone_key(raw: Column) -> Column:
    """A number of the North American plan in international form, else its digits, else as it is."""
    digits = F.regexp_replace(raw, r"\D", "")
    return F.when(digits.rlike(r"^1?\d{10}$"), F.concat(F.lit("+1"), F.substring(digits, -10, 10))).when(digits != "", digits).otherwise(raw)


def phone_valid(raw: Column) -> Column:
    """Whether area and exchange can be dialled: neither starts with 0 or 1, nor is the area N11."""
    ten = F.substring(phone_key(raw), 3, 10)
    return phone_key(raw).startswith("+1") & ten.rlike(r"^[2-9](?!11)\d\d[2-9]\d{6}$")


def phone_format(raw: Column) -> Column:
    """The international way of writing a number."""
    k = phone_key(raw)
    return F.when(k.startswith("+1"), F.concat(F.lit("+1 "), F.substring(k, 3, 3), F.lit("-"), F.substring(k, 6, 3), F.lit("-"), F.substring(k, 9, 4))).otherwise(raw)


def phone_numbers(findings: DataFrame) -> DataFrame:
    """Exposed numbers that can be dialled, with their form and area code."""
    rows = exposed_values(findings, "phone_numbers", phone_key(F.col("value"))).where(phone_valid(F.col("value")))
    return rows.select("scan_id", "key", "quantity", phone_format(F.col("value")).alias("formatted"), F.substring("key", 3, 3).alias("area"))


def email_hosts(findings: DataFrame) -> DataFrame:
    """Exposed addresses with the host that receives them."""
    rows = exposed_values(findings, "email_addresses", F.lower("value"))
    return rows.select("scan_id", F.col("key").alias("email"), "quantity", F.substring_index("key", "@", -1).alias("host"))


_FORM = "array<struct<action string, method string, fields array<struct<label string, required boolean, type string>>>>"


def distinct_forms(findings: DataFrame) -> DataFrame:
    """Forms of the payloads: the same action and fields are the same form; quantity and the least page."""
    forms = findings.where(OPEN).select("scan_id", "page_id", F.explode(F.from_json(F.get_json_object("payload", "$.forms"), _FORM)).alias("f"))
    fields = F.transform("f.fields", lambda x: F.struct(F.coalesce(x["label"], F.lit("")).alias("label"), F.coalesce(x["required"], F.lit(False)).alias("required"), F.coalesce(x["type"], F.lit("")).alias("type")))
    signature = F.sha2(F.to_json(F.struct(F.coalesce("f.action", F.lit("")).alias("action"), fields.alias("fields"))), 256)
    return forms.groupBy("scan_id", signature.alias("signature")).agg(F.min("f.action").alias("action"), F.first(F.size("f.fields")).alias("fields"), F.count("*").alias("quantity"), F.min("page_id").alias("least_page"))


def web_vitals_history(vitals: DataFrame, runs: DataFrame) -> DataFrame:
    """For each done run the worst score (times 100) of its results (scan_id, body), that result's metrics, and the change since the run before."""
    rows = vitals.select("scan_id", F.from_json("body", VITALS).alias("v")).where("v.score IS NOT NULL")
    worst = rows.groupBy("scan_id").agg(F.min(F.struct(F.col("v.score").alias("score"), F.col("v.lcp").alias("lcp"), F.col("v.cls").alias("cls"), F.col("v.tbt").alias("tbt"))).alias("w"))
    score = F.round((F.col("w.score") * 100).cast("decimal(18,6)"), 0).cast("int")
    rows = worst.join(runs.where("status = 'done'").select("scan_id", "site_id", "created_at"), "scan_id").select("site_id", "scan_id", "created_at", score.alias("score"), "w.lcp", "w.cls", "w.tbt")
    return rows.withColumn("delta", F.col("score") - F.lag("score").over(W.partitionBy("site_id").orderBy("created_at"))).drop("created_at")


def word_groups(findings: DataFrame) -> DataFrame:
    """Spelling findings by word: quantity, pages, and the last category and suggestion that are given."""
    rows = findings.where(OPEN).select("scan_id", "issue_id", "page_id", F.from_json("payload", WORD).alias("p")).where("p.word <> ''")
    last = lambda c: F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("issue_id")))
    per = rows.groupBy("scan_id", F.col("p.word").alias("word"), "page_id").agg(F.count("*").alias("n"), F.max(F.when(F.col("p.category").isNotNull(), F.struct("issue_id", "p.category"))).alias("c"), F.max(F.when(F.col("p.suggestion").isNotNull(), F.struct("issue_id", "p.suggestion"))).alias("s"))
    return per.groupBy("scan_id", "word").agg(F.sum("n").alias("quantity"), F.count("*").alias("pages"), F.max("c")["category"].alias("category"), F.max("s")["suggestion"].alias("suggestion"))


def link_groups_full(broken: DataFrame, n: int = 50) -> DataFrame:
    """Broken links by URL with the first n of their pages, in order."""
    ranked = broken.withColumn("rank", F.row_number().over(W.partitionBy("url").orderBy("page_id")))
    listed = F.array_sort(F.collect_list(F.when(F.col("rank") <= n, F.struct("rank", "page_id", "text"))))
    per = ranked.groupBy("url").agg(F.max("status_code").alias("status_code"), F.count("*").alias("pages"), listed.alias("l"))
    return per.select("url", "status_code", "pages", link_confidence(F.col("status_code")).alias("confidence"), F.array_join(F.transform("l", lambda x: F.concat_ws(":", x["page_id"].cast("string"), x["text"])), ",").alias("places"))


def run_report(pages: DataFrame, deltas: DataFrame) -> DataFrame:
    """Pages of a run in the order of depth and URL, with their change since the run before."""
    w = W.partitionBy("scan_id").orderBy("depth", "url", "page_id")
    return pages.select("scan_id", "page_id", "url", "depth").join(deltas.where("status <> 'removed'").select("scan_id", "url", "status", "delta"), ["scan_id", "url"], "left").withColumn("place", F.row_number().over(w))


def page_issue_order(findings: DataFrame) -> DataFrame:
    """A page's findings: those of a keyword by their occurrence number, the others after, then by id."""
    number = F.get_json_object("payload", "$.occurrence").cast("int")
    w = W.partitionBy("scan_id", "page_id").orderBy(F.coalesce(number, F.lit(1_000_000_000)), "issue_id")
    return findings.select("scan_id", "page_id", "issue_id", F.row_number().over(w).alias("place"))


def issue_types(issues: DataFrame) -> DataFrame:
    """Open findings of each rule by criterion, else by snippet: worst impact, pages, instances."""
    kind = F.coalesce("criterion_id", "snippet")
    per = issues.where(OPEN).groupBy("scan_id", "rule_id", kind.alias("kind"), "page_id").agg(F.count("*").alias("n"), F.min(impact_rank(F.col("impact"))).alias("w"))
    return per.groupBy("scan_id", "rule_id", "kind").agg(F.min("w").alias("worst_rank"), F.count("*").alias("pages"), F.sum("n").alias("instances"))


def distinct_colors(violations: DataFrame) -> DataFrame:
    """Colours of the violations in the payloads, each once for a run."""
    colors = F.from_json(F.get_json_object("payload", "$.violations"), "array<struct<detected_color string>>")
    return violations.select("scan_id", F.explode(colors).alias("v")).select("scan_id", F.upper("v.detected_color").alias("color")).distinct()


def pages_table(pages: DataFrame, by: str, search: str = "") -> DataFrame:
    """Pages of each run whose URL or title holds the text, in descending order of a column, nulls last."""
    hit = F.contains(F.lower(F.concat_ws(" ", "url", "title")), F.lit(search.lower()))
    w = W.partitionBy("scan_id").orderBy(F.col(by).desc_nulls_last(), "url", "page_id")
    return pages.where(hit).select("scan_id", "page_id", "url", by, F.row_number().over(w).alias("place"))


def sites_table(cards: DataFrame, by: str = "overall", search: str = "") -> DataFrame:
    """Site cards whose name holds the text, by name or by another column downwards, nulls last (sites are few)."""
    order = F.lower("name").asc() if by == "name" else F.col(by).desc_nulls_last()
    return cards.where(F.contains(F.lower("name"), F.lit(search.lower()))).select("site_id", "name", by, F.row_number().over(W.orderBy(order, "site_id")).alias("place"))


def checks_table(checks: DataFrame) -> DataFrame:
    """The checks of each run: scored ones with findings first, then by severity, findings, score and name."""
    first = F.when(F.col("check_score").isNotNull() & (F.col("open_issues") > 0), 0).otherwise(1)
    w = W.partitionBy("scan_id").orderBy(first, "worst_rank", F.desc("open_issues"), F.col("check_score").asc_nulls_last(), "rule_id", "category")
    return checks.select("scan_id", "category", "rule_id", F.row_number().over(w).alias("place"))


def page_check_groups(issues: DataFrame, rules: DataFrame, category: str) -> DataFrame:
    """Findings of each page by rule: instances and worst impact; checks of the category without findings are added."""
    per = issues.where(OPEN).where(F.col("category") == category).groupBy("scan_id", "page_id", "rule_id").agg(F.count("*").alias("instances"), F.min(impact_rank(F.col("impact"))).alias("worst_rank"))
    of = entries(rules.where(F.col("category") == category), ["rule_id"])  # the catalogue is fixed
    grid = per.select("scan_id", "page_id").distinct().select("scan_id", "page_id", F.explode(of).alias("r")).select("scan_id", "page_id", "r.rule_id")
    return grid.join(per, ["scan_id", "page_id", "rule_id"], "left").select("scan_id", "page_id", "rule_id", F.coalesce("instances", F.lit(0)).alias("instances"), F.coalesce("worst_rank", F.lit(9)).alias("worst_rank"))


def expand_payload(findings: DataFrame, field: str = "violations") -> DataFrame:
    """A payload whose array holds several objects becomes one row for each; others stay one row."""
    entries = F.from_json(F.get_json_object("payload", f"$.{field}"), "array<map<string,string>>")
    many = F.when(F.size(entries) > 1, entries)
    return findings.select("scan_id", "issue_id", F.posexplode_outer(many).alias("n", "entry")).select("scan_id", "issue_id", F.coalesce("n", F.lit(0)).alias("n"), F.map_entries("entry").isNotNull().alias("expanded"))


def latest_ok_page(pages: DataFrame) -> DataFrame:
    """The newest page of each run that was rendered (by scanned_at, then id)."""
    return pages.where("render_status = 'ok'").groupBy("scan_id").agg(F.max(F.struct("scanned_at", "page_id")).alias("p")).select("scan_id", "p.page_id")


def scan_pages(pages: DataFrame) -> DataFrame:
    """The pages of each run by depth and URL."""
    return pages.select("scan_id", "page_id", "url", F.row_number().over(W.partitionBy("scan_id").orderBy("depth", "url", "page_id")).alias("place"))


def scan_checks(checks: DataFrame) -> DataFrame:
    """The checks of each run by what they take off."""
    return checks.select("scan_id", "category", "rule_id", "penalty", F.row_number().over(W.partitionBy("scan_id").orderBy(F.desc("penalty"), "rule_id", "category")).alias("place"))


def failure_reasons(pages: DataFrame) -> DataFrame:
    """L2: failed pages of each run by the first 120 characters of the error."""
    return pages.where("render_status <> 'ok'").groupBy("scan_id", F.substring(F.coalesce("error", F.lit("unknown")), 1, 120).alias("reason")).agg(F.count("*").alias("pages"))


def site_concerns(issues: DataFrame, n: int = 3) -> DataFrame:
    """M3: the n rules of each run with most scored-open findings."""
    per = issues.where(SCORED_OPEN).groupBy("scan_id", "rule_id").agg(F.count("*").alias("n"))
    return per.withColumn("rank", F.row_number().over(W.partitionBy("scan_id").orderBy(F.desc("n"), "rule_id"))).where(F.col("rank") <= n)
