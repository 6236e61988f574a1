"""Roll-ups behind report tables (M).

Open: not reviewed. Scored-open: also not for manual review. Top-k lists rank
after the counts are aggregated; nothing collects the findings of a hot rule.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quillmark.functions.dims import BUCKETS, IMPACT_RANK, entries
from quillmark.operators.scoring import case

OPEN = "NOT reviewed"
SCORED_OPEN = "NOT reviewed AND NOT manual_review"


def impact_rank(impact: Column) -> Column:
    return case(impact, IMPACT_RANK, 9)


def severity_counts(issues: DataFrame) -> DataFrame:
    """M1: scored-open findings of each run by bucket."""
    bucket = case(F.col("impact"), BUCKETS, "info")
    n = lambda b: F.count_if(bucket == b)
    return issues.where(SCORED_OPEN).groupBy("scan_id").agg(n("error").alias("errors"), n("warning").alias("warnings"), n("info").alias("infos"))


def score_history(runs: DataFrame, scores: DataFrame, n: int = 12) -> DataFrame:
    """M2: the last n scores of done runs of each site, newest is rank 1."""
    rows = runs.where("status = 'done'").join(scores.select("scan_id", "overall"), "scan_id").where("overall IS NOT NULL")
    w = W.partitionBy("site_id").orderBy(F.desc("created_at"))
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n).select("site_id", "rank", "scan_id", "overall")


def site_totals(cards: DataFrame) -> DataFrame:
    """M4: sums over the visible cards."""
    return cards.agg(F.count("*").alias("sites"), F.sum("errors").alias("errors"), F.sum("warnings").alias("warnings"))


def visible_sites(sites: DataFrame, assignments: DataFrame, user_id: int, admin: bool = False) -> DataFrame:
    """M5: all sites for an admin, else those assigned to the user."""
    return sites if admin else sites.join(assignments.where(F.col("user_id") == user_id), "site_id", "left_semi")


def users_with_sites(assignments: DataFrame) -> DataFrame:
    """M6: the number of sites of each user and the first of them (the sites of one user are few)."""
    return assignments.groupBy("user_id").agg(F.count("*").alias("n_sites"), F.concat_ws(",", F.array_sort(F.collect_set("site_id"))).alias("site_ids"))


def representative_page(pages: DataFrame, root: Column) -> DataFrame:
    """M7: the page at the root, else that of the least depth, then the least URL."""
    strip = lambda c: F.regexp_replace(c, "/+$", "")
    key = F.struct(F.when(strip(F.col("url")) == strip(root), 0).otherwise(1).alias("o"), "depth", "url", "page_id")
    return pages.groupBy("scan_id").agg(F.min(key).alias("k")).select("scan_id", "k.page_id", "k.url")


def checks_list(checks: DataFrame, issues: DataFrame, aliases: list[str] | None = None) -> DataFrame:
    """Checks of each run with scored-open findings and worst impact; alias rules are not shown."""
    checks = checks.where(~F.col("rule_id").isin(aliases)) if aliases else checks
    o = issues.where(SCORED_OPEN).groupBy("scan_id", "category", "rule_id").agg(F.count("*").alias("open_issues"), F.min(impact_rank(F.col("impact"))).alias("worst_rank"))
    out = checks.select("scan_id", "category", "rule_id", "check_score", "pages_affected").join(o, ["scan_id", "category", "rule_id"], "left")
    return out.select("scan_id", "category", "rule_id", "check_score", "pages_affected", F.coalesce("open_issues", F.lit(0)).alias("open_issues"), F.coalesce("worst_rank", F.lit(9)).alias("worst_rank"))


def checks_full(rules: DataFrame, runs: DataFrame, checks: DataFrame, issues: DataFrame) -> DataFrame:
    """M9: the whole catalogue for each done run; a check without findings scores 100, one that only has findings for review is not scored (null)."""
    grid = runs.where("status = 'done'").select("scan_id", F.explode(entries(rules, ["rule_id", "category"])).alias("r")).select("scan_id", "r.*")  # the catalogue is fixed
    out = grid.join(checks.select("scan_id", "category", "rule_id", "check_score"), ["scan_id", "category", "rule_id"], "left")
    any_ = issues.groupBy("scan_id", "category", "rule_id").agg(F.count("*").alias("n"))
    out = out.join(any_, ["scan_id", "category", "rule_id"], "left")
    return out.select("scan_id", "category", "rule_id", F.when(F.col("check_score").isNotNull(), F.col("check_score")).when(F.col("n").isNull(), 100).alias("check_score"))


def check_pages_top(issues: DataFrame, pages: DataFrame, n: int = 50) -> DataFrame:
    """For each run and rule the n pages with most open findings."""
    per = issues.where(OPEN).groupBy("scan_id", "rule_id", "page_id").agg(F.count("*").alias("instances"))
    w = W.partitionBy("scan_id", "rule_id").orderBy(F.desc("instances"), "page_id")
    top = per.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
    return top.join(pages.select("scan_id", "page_id", "url"), ["scan_id", "page_id"]).select("scan_id", "rule_id", "rank", "url", "instances")


def check_totals(issues: DataFrame) -> DataFrame:
    """Pages and instances of each rule over a whole run, in two steps."""
    per = issues.groupBy("scan_id", "rule_id", "page_id").agg(F.count("*").alias("n"))
    return per.groupBy("scan_id", "rule_id").agg(F.count("*").alias("pages"), F.sum("n").alias("instances"))


def check_trend(runs: DataFrame, checks: DataFrame, issues: DataFrame, n: int = 24) -> DataFrame:
    """For each site and rule, its last n runs: score, pages affected, scored-open findings."""
    o = issues.where(SCORED_OPEN).groupBy("scan_id", "rule_id").agg(F.count("*").alias("open_issues"))
    rows = checks.join(runs.where("status = 'done'").select("scan_id", "site_id", "created_at"), "scan_id").join(o, ["scan_id", "rule_id"], "left")
    w = W.partitionBy("site_id", "category", "rule_id").orderBy(F.desc("created_at"))
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n).select("site_id", "rule_id", "rank", "check_score", "pages_affected", F.coalesce("open_issues", F.lit(0)).alias("open_issues"))


def check_history(runs: DataFrame, checks: DataFrame, issues: DataFrame) -> DataFrame:
    """For each done run and rule all findings, and the score."""
    n = issues.groupBy("scan_id", "rule_id").agg(F.count("*").alias("issues"))
    return runs.where("status = 'done'").select("scan_id", "site_id").join(n, "scan_id").join(checks.select("scan_id", "rule_id", "check_score"), ["scan_id", "rule_id"], "left")


def module_history(runs: DataFrame, checks: DataFrame) -> DataFrame:
    """Mean check score of each module (category and subcategory) for each run."""
    mean = F.round(F.avg(F.col("check_score").cast("decimal(18,6)")), 1).cast("double")
    return checks.join(runs.where("status = 'done'").select("scan_id", "site_id"), "scan_id").groupBy("site_id", "scan_id", "category", "subcategory").agg(mean.alias("score"), F.count("*").alias("checks"))


def group_overview(history: DataFrame, runs: DataFrame) -> DataFrame:
    """Each module's score with its change since the last earlier run that has one."""
    w = W.partitionBy("site_id", "category", "subcategory").orderBy("created_at").rowsBetween(W.unboundedPreceding, -1)
    rows = history.join(runs.select("scan_id", "created_at"), "scan_id")
    return rows.withColumn("delta", F.round((F.col("score") - F.last("score", ignorenulls=True).over(w)).cast("decimal(18,6)"), 1).cast("double")).select("site_id", "scan_id", "category", "subcategory", "score", "delta")


#: The module groups of the overviews: category and the subcategories of each.
MODULE_GROUPS = [
    ("privacy", "consent", ["Consent", "Disclosure"]),
    ("privacy", "audit", ["Tracking"]),
    ("privacy", "security", ["Security", "Transport"]),
    ("marketing", "content", ["Content optimization"]),
    ("marketing", "technical", ["Technical optimization"]),
]


def group_history(runs: DataFrame, checks: DataFrame, groups: list[tuple[str, str, list[str]]] = MODULE_GROUPS) -> DataFrame:
    """Mean check score of each group for each done run, with the change since the last earlier run that has one."""
    dim = checks.sparkSession.createDataFrame([(c, g, x) for c, g, xs in groups for x in xs], "category string, group string, subcategory string")
    mean = F.round(F.avg(F.col("check_score").cast("decimal(18,6)")), 1).cast("double")
    rows = checks.join(F.broadcast(dim), ["category", "subcategory"]).join(runs.where("status = 'done'").select("scan_id", "site_id", "created_at"), "scan_id")
    per = rows.groupBy("site_id", "scan_id", "created_at", "category", "group").agg(mean.alias("score"))
    w = W.partitionBy("site_id", "category", "group").orderBy("created_at").rowsBetween(W.unboundedPreceding, -1)
    return per.withColumn("delta", F.round((F.col("score") - F.last("score", ignorenulls=True).over(w)).cast("decimal(18,6)"), 1).cast("double")).drop("created_at")


def accessibility_levels(runs: DataFrame, scores: DataFrame) -> DataFrame:
    """Level scores of each done run and the change to the last earlier one that has them."""
    w = W.partitionBy("site_id").orderBy("created_at").rowsBetween(W.unboundedPreceding, -1)
    rows = runs.where("status = 'done'").join(scores, "scan_id", "left")
    return rows.select("site_id", "scan_id", *[x for c in ("score_a", "score_aa", "score_aaa") for x in (F.col(c), (F.col(c) - F.last(c, ignorenulls=True).over(w)).alias(c + "_delta"))])


def common_issues(issues: DataFrame, n: int = 4) -> DataFrame:
    """The n rules with most open findings of each run, and the rest as Other."""
    per = issues.where(OPEN).groupBy("scan_id", "rule_id").agg(F.count("*").alias("c"))
    w = W.partitionBy("scan_id").orderBy(F.desc("c"), "rule_id")
    named = per.withColumn("r", F.row_number().over(w)).withColumn("rule", F.when(F.col("r") <= n, F.col("rule_id")).otherwise("Other"))
    return named.groupBy("scan_id", "rule").agg(F.sum("c").alias("issues"))


def issues_per_page_by_depth(pages: DataFrame, issues: DataFrame) -> DataFrame:
    """Pages and findings a page for each depth, and in total (depth null)."""
    per = issues.where(OPEN).groupBy("scan_id", "page_id").agg(F.count("*").alias("c"))
    rows = pages.where("render_status = 'ok'").select("scan_id", "page_id", "depth").join(per, ["scan_id", "page_id"], "left")
    mean = F.round((F.coalesce(F.sum("c"), F.lit(0)) / F.count("*")).cast("decimal(28,9)"), 1).cast("double")
    return rows.groupingSets([("scan_id", "depth"), ("scan_id",)], "scan_id", "depth").agg(F.count("*").alias("pages"), mean.alias("issues_per_page"))


def pages_list(pages: DataFrame, issues: DataFrame, scores: DataFrame, category: str) -> DataFrame:
    """Pages with their open findings of a category and their score."""
    per = issues.where(OPEN).where(F.col("category") == category).groupBy("scan_id", "page_id").agg(F.count("*").alias("issues"))
    out = pages.join(per, ["scan_id", "page_id"], "left").join(scores.select("scan_id", "page_id", "score"), ["scan_id", "page_id"], "left")
    return out.select("scan_id", "page_id", "url", "depth", F.coalesce("issues", F.lit(0)).alias("issues"), "score")


def issues_list(issues: DataFrame, pages: DataFrame, category: str, subcategory: str | None = None) -> DataFrame:
    """Open findings of a category with their page's URL."""
    rows = issues.where(OPEN).where(F.col("category") == category)
    rows = rows if subcategory is None else rows.where(F.col("subcategory") == subcategory)
    return rows.select("scan_id", "page_id", "issue_id", "rule_id", "impact").join(pages.select("scan_id", "page_id", "url"), ["scan_id", "page_id"])


def flag_issues(issues: DataFrame, ids: DataFrame) -> DataFrame:
    """Findings with those of ``ids`` (issue_id) reviewed; the caller overwrites their partitions."""
    marked = issues.join(ids.select("issue_id", F.lit(True).alias("_m")).distinct(), "issue_id", "left")
    return marked.select(*[F.when(F.col("_m"), True).otherwise(F.col(c)).alias(c) if c == "reviewed" else F.col(c) for c in issues.columns])


def amount_of_content(pages: DataFrame) -> DataFrame:
    """Words, sentences and words for each measured page of each run."""
    ok = pages.where("render_status = 'ok'")
    per = F.round((F.sum("word_count") / F.count_if(F.col("word_count") > 0)).cast("decimal(28,9)"), 1).cast("double")
    return ok.groupBy("scan_id").agg(F.sum("word_count").alias("words"), F.sum("sentence_count").alias("sentences"), per.alias("words_per_page"))


def issue_groups(issues: DataFrame) -> DataFrame:
    """Open findings of each rule: pages, instances, worst impact."""
    per = issues.where(OPEN).groupBy("scan_id", "rule_id", "manual_review", "page_id").agg(F.count("*").alias("n"), F.min(impact_rank(F.col("impact"))).alias("w"))
    return per.groupBy("scan_id", "rule_id", "manual_review").agg(F.count("*").alias("pages"), F.sum("n").alias("instances"), F.min("w").alias("worst_rank"))


def issue_examples(issues: DataFrame, n: int = 25) -> DataFrame:
    """Of each rule of a run the first n open findings."""
    w = W.partitionBy("scan_id", "rule_id").orderBy("issue_id")
    return issues.where(OPEN).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n).select("scan_id", "rule_id", "rank", "issue_id", "page_id", "selector")


def recent_runs(runs: DataFrame, n: int = 50) -> DataFrame:
    """The newest n runs."""
    return runs.orderBy(F.desc("created_at"), F.desc("scan_id")).limit(n).select("scan_id", "site_id", "status", "created_at")


def affected_pages(issues: DataFrame, pages: DataFrame) -> DataFrame:
    """Pages with open findings and their counts."""
    per = issues.where(OPEN).groupBy("scan_id", "page_id").agg(F.count("*").alias("issues"), F.countDistinct("rule_id").alias("rules"))
    return per.join(pages.select("scan_id", "page_id", "url"), ["scan_id", "page_id"])


def wcag_filter(issues: DataFrame, version: str, level: str) -> DataFrame:
    """Accessibility findings at or below a version and level; other categories pass."""
    order = case(F.col("wcag_level"), {"A": 1, "AA": 2, "AAA": 3}, 9)
    most = {"A": 1, "AA": 2, "AAA": 3}[level]
    ok = (F.col("category") != "accessibility") | ((F.col("wcag_version") <= version) & (order <= most))
    return issues.where(ok)


def search_issues(issues: DataFrame, text: str) -> DataFrame:
    """Findings whose fields hold the text, whatever the case."""
    return issues.where(F.contains(F.lower(F.concat_ws(" ", "rule_id", "category", "subcategory", "selector", "snippet")), F.lit(text.lower())))


def readability_summary(pages: DataFrame) -> DataFrame:
    """Pages with a reading age: their number, mean and greatest."""
    return pages.where("reading_age IS NOT NULL AND render_status = 'ok'").groupBy("scan_id").agg(
        F.count("*").alias("pages"), F.round(F.avg(F.col("reading_age").cast("decimal(18,6)")), 1).cast("double").alias("mean_age"), F.max("reading_age").alias("greatest_age")
    )


def compliance_status(issues: DataFrame, runs: DataFrame, areas: list[str]) -> DataFrame:
    """Each area of a run: no finding means compliant, only findings for review needs attention, else non-compliant."""
    grid = runs.select("scan_id", F.explode(F.array(*[F.lit(a) for a in areas])).alias("category"))  # a few areas
    found = issues.where(F.col("category").isin(areas)).groupBy("scan_id", "category").agg(F.bool_and("manual_review").alias("only"))
    status = F.when(F.col("only").isNull(), "compliant").when(F.col("only"), "needs attention").otherwise("non-compliant")
    return grid.join(found, ["scan_id", "category"], "left").select("scan_id", "category", status.alias("status"))


def module_summary(checks: DataFrame, issues: DataFrame) -> DataFrame:
    """Each category of a run: mean score half up, open findings, checks with findings."""
    o = issues.where(SCORED_OPEN).groupBy("scan_id", "category").agg(F.count("*").alias("open_issues"))
    mean = F.floor(F.sum("check_score") / F.count("*") + 0.5)
    m = checks.groupBy("scan_id", "category").agg(mean.cast("long").alias("score"), F.count("*").alias("checks"))
    return m.join(o, ["scan_id", "category"], "left").select("scan_id", "category", "score", "checks", F.coalesce("open_issues", F.lit(0)).alias("open_issues"))


def category_pages(pages: DataFrame, scores: DataFrame, category: str) -> DataFrame:
    """Pages of each run by their score in a category (else their own), the lowest first, unscored last."""
    score = F.coalesce("cat_" + category.lower().replace(" ", "_"), "score")
    rows = pages.select("scan_id", "page_id", "url").join(scores.select("scan_id", "page_id", score.alias("score")), ["scan_id", "page_id"], "left")
    return rows.withColumn("place", F.row_number().over(W.partitionBy("scan_id").orderBy(F.col("score").asc_nulls_last(), "url", "page_id")))


def top_category_pages(issues: DataFrame, pages: DataFrame, category: str, n: int = 10) -> DataFrame:
    """For each run the n pages with most findings of a category."""
    per = issues.where(F.col("category") == category).groupBy("scan_id", "page_id").agg(F.count("*").alias("issues"))
    w = W.partitionBy("scan_id").orderBy(F.desc("issues"), "page_id")
    return per.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n).join(pages.select("scan_id", "page_id", "url"), ["scan_id", "page_id"]).select("scan_id", "rank", "url", "issues")
