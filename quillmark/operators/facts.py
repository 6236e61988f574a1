"""Site cards from facts that are stored once.

``page_rule_facts`` reads pages and findings once each: a row for each run, page and
rule has all that scores, severities and concerns add up. It is written once, grouped
by run as the pages are, so the roll-ups read small rows and not the findings again.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quillmark.functions.dims import BUCKETS
from quillmark.operators import scoring
from quillmark.operators.reports import SCORED_OPEN
from quillmark.operators.scratch import written
from quillmark.operators.scoring import CFG, ScoringConfig, case, impact_weight

#: States of a run that is under way.
ACTIVE = ["pending", "crawling", "scoring"]


@dataclass
class Facts:
    """pages: one row a page; rules: one row for each run, page, category and rule with findings."""

    pages: DataFrame
    rules: DataFrame


def page_rule_facts(pages: DataFrame, issues: DataFrame, cfg: ScoringConfig = CFG) -> Facts:
    changed = F.col("last_changed_at") if "last_changed_at" in pages.columns else F.lit(None).cast("long")
    kept = written(pages.select("scan_id", "page_id", "url", "is_document", "render_status", changed.alias("last_changed_at")))
    rows = issues if "weight" in issues.columns else issues.withColumn("weight", F.lit(1.0))
    scored, open_ = ~F.col("manual_review"), F.expr(SCORED_OPEN)
    bucket = case(F.col("impact"), BUCKETS, "info")
    meta = F.struct("issue_id", "subcategory", "criterion_id", "wcag_level", "wcag_version", "is_best_practice")
    total = F.sum(F.when(scored, (impact_weight(F.col("impact"), cfg) * F.coalesce("weight", F.lit(1.0))).cast("decimal(18,6)")))
    per = rows.groupBy("scan_id", "page_id", "category", "rule_id").agg(
        total.alias("wtotal"), F.min(F.when(scored, meta)).alias("m"), *[F.count_if(open_ & (bucket == b)).alias(n) for b, n in (("error", "errors"), ("warning", "warnings"), ("info", "infos"))]
    )
    return Facts(kept, written(per))


def stored_check_scores(facts: Facts, cfg: ScoringConfig = CFG) -> DataFrame:
    """K3 from the facts: what ``check_scores`` gives from pages and findings."""
    audited = scoring.audited_pages(facts.pages)
    count = audited.groupBy("scan_id").agg(F.count("*").alias("pages"))
    rows = facts.rules.where("wtotal IS NOT NULL").join(audited.select("scan_id", "page_id", "url"), ["scan_id", "page_id"])
    per = rows.groupBy("scan_id", "category", "rule_id").agg(F.sum("wtotal").alias("wtotal"), F.countDistinct("url").alias("pages_affected"), F.min(F.struct("url", "m")).alias("first"))
    return scoring._scored(per.withColumn("m", F.col("first.m")).drop("first").join(count, "scan_id"), F.col("pages"), cfg)


def stored_site_scores(facts: Facts, cfg: ScoringConfig = CFG) -> DataFrame:
    """K10 from the facts."""
    return scoring.site_scores(facts.pages, stored_check_scores(facts, cfg), cfg)


def site_cards(sites: DataFrame, runs: DataFrame, facts: Facts, assignments: DataFrame, history: int = 12, concerns: int = 3) -> DataFrame:
    """M3: a card for each site (site_id, name, max_pages).

    Of its latest done run: score, band, pages, documents, open findings by severity, the
    rules of most concern, the last change of a page, and whether the crawl reached the
    site's limit; of all its done runs the last scores, newest first; the run under way,
    if any; and how many users it has.
    """
    done = runs.where("status = 'done'")
    scores = written(stored_site_scores(facts).select("scan_id", "overall", "band"))
    latest = done.groupBy("site_id").agg(F.max(F.struct("created_at", "scan_id")).alias("r")).select("site_id", "r.scan_id")
    active = runs.where(F.col("status").isin(ACTIVE)).groupBy("site_id").agg(F.max(F.struct("created_at", "scan_id", "status")).alias("r")).select("site_id", F.col("r.scan_id").alias("active_scan"), F.col("r.status").alias("active_status"))
    document = F.col("is_document")
    ok = (F.col("render_status") == "ok") & ~document
    pages = facts.pages.groupBy("scan_id").agg(F.count_if(~document).alias("crawled"), F.count_if(ok).alias("pages"), F.count_if(document).alias("documents"), F.max("last_changed_at").alias("last_change"))
    severity = facts.rules.groupBy("scan_id").agg(*[F.sum(c).alias(c) for c in ("errors", "warnings", "infos")])
    rule = facts.rules.groupBy("scan_id", "rule_id").agg(F.sum(F.col("errors") + F.col("warnings") + F.col("infos")).alias("n")).where("n > 0")
    first = W.partitionBy("scan_id").orderBy(F.desc("n"), "rule_id")
    worst = rule.withColumn("k", F.row_number().over(first)).where(F.col("k") <= concerns).groupBy("scan_id").agg(F.array_join(F.array_sort(F.collect_list(F.struct("k", "rule_id")))["rule_id"], ",").alias("concerns"))
    newest = W.partitionBy("site_id").orderBy(F.desc("created_at"), F.desc("scan_id"))
    past = done.join(scores.where("overall IS NOT NULL"), "scan_id").withColumn("k", F.row_number().over(newest)).where(F.col("k") <= history)
    past = past.groupBy("site_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "overall"))), lambda x: x["overall"].cast("string")), ",").alias("history"))
    users = assignments.groupBy("site_id").agg(F.count("*").alias("users"))
    out = sites.join(latest, "site_id", "left")
    for part, key in ((scores, "scan_id"), (pages, "scan_id"), (severity, "scan_id"), (worst, "scan_id"), (past, "site_id"), (active, "site_id"), (users, "site_id")):
        out = out.join(part, key, "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    none = lambda c: F.coalesce(c, F.lit("")).alias(c)
    reached = F.coalesce(F.col("crawled") >= F.col("max_pages"), F.lit(False))
    return out.select(
        "site_id", "name", "scan_id", "overall", "band", *map(zero, ("pages", "documents", "errors", "warnings", "infos")), none("concerns"), "last_change", reached.alias("limit_reached"), none("history"), "active_scan", "active_status", zero("users")
    )
