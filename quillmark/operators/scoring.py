"""Scores of checks, categories, levels, runs and pages.

One pass over the findings: they are reduced to one row for each page and rule
first (map-side combining takes the bulk), so a template rule that fires on every
page of a run is spread over its pages, and distinct pages need no expansion.
Everything after that is a few hundred rows a run.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.functions.dims import BEST_PRACTICE, BLEND_PCT, BLEND_SEVERITY, DEFAULT_MAX, DEFAULT_WORST, ERROR_PAGE_MAX, UNKNOWN_IMPACT, ScoringConfig, knobs

CFG = ScoringConfig()


def case(c: Column, table: dict, default: object) -> Column:
    """The table's value for c, the default for others and nulls."""
    return reduce(lambda w, kv: w.when(c == F.lit(kv[0]), F.lit(kv[1])), table.items(), F.when(F.lit(False), F.lit(default))).otherwise(F.lit(default))


def round3(x: Column) -> Column:
    """Half-up to three places, on the decimal value, so that every engine agrees."""
    return F.round(x.cast("decimal(28,9)"), 3).cast("double")


def impact_weight(impact: Column, cfg: ScoringConfig = CFG) -> Column:
    """K2: a missing impact is moderate, an unknown one weighs 0.5."""
    return case(F.coalesce(impact, F.lit("moderate")), cfg.impact_weights, UNKNOWN_IMPACT)


def level_weight(level: Column, cfg: ScoringConfig = CFG) -> Column:
    """K5: levels without a weight count as best practice."""
    return case(level, cfg.level_weights, BEST_PRACTICE)


def round_score(x: Column) -> Column:
    """K6: clamped to 0..100, half up; over 99 shows 99 unless it is 100."""
    x = F.least(F.greatest(x, F.lit(0.0)), F.lit(100.0))
    return F.when(x >= 100, 100).when(x > 99, 99).otherwise(F.round(x.cast("decimal(28,9)"), 0).cast("int"))


def band_for(score: Column, cfg: ScoringConfig = CFG) -> Column:
    """The first band whose upper end holds the score."""
    return reduce(lambda w, b: w.when(score <= b[0], b[1]), cfg.bands, F.when(F.lit(False), "")).otherwise(cfg.bands[-1][1])


def audited_pages(pages: DataFrame) -> DataFrame:
    """K1: ok pages that are no documents."""
    return pages.where((F.col("render_status") == "ok") & ~F.col("is_document"))


def page_checks(pages: DataFrame, issues: DataFrame, cfg: ScoringConfig = CFG) -> DataFrame:
    """One row for each run, page and check of audited pages: weighted total and metadata of the first finding."""
    scored = issues.where(~F.col("manual_review"))
    if "weight" not in issues.columns:
        scored = scored.withColumn("weight", F.lit(1.0))
    meta = F.struct("issue_id", "subcategory", "criterion_id", "wcag_level", "wcag_version", "is_best_practice")
    total = F.sum((impact_weight(F.col("impact"), cfg) * F.coalesce("weight", F.lit(1.0))).cast("decimal(18,6)")).alias("wtotal")
    by_page = scored.groupBy("scan_id", "page_id", "category", "rule_id").agg(total, F.min(meta).alias("m"))
    return by_page.join(audited_pages(pages).select("scan_id", "page_id", "url"), ["scan_id", "page_id"])


def _scored(checks: DataFrame, pages: Column, cfg: ScoringConfig) -> DataFrame:
    k = F.broadcast(knobs(checks.sparkSession, cfg))  # one row for each configured rule
    rows = checks.join(k, "rule_id", "left").withColumn("worst_value", F.coalesce("worst_value", F.lit(DEFAULT_WORST))).withColumn("max_impact", F.coalesce("max_impact", F.lit(DEFAULT_MAX)))
    one = lambda x: F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))
    avg, pct = F.col("wtotal").cast("double") / pages, F.col("pages_affected") / pages
    severity = F.when(F.col("worst_value") > 0, one(avg / F.col("worst_value"))).otherwise(0.0)
    deficit = one(BLEND_PCT * one(pct) + BLEND_SEVERITY * severity)
    weight = F.when(F.col("category") == "accessibility", level_weight(F.col("m.wcag_level"), cfg)).otherwise(1.0)
    return rows.withColumn("deficit", deficit).select(
        *[c for c in checks.columns if c not in ("wtotal", "m", "pages")],
        "m.subcategory", "m.criterion_id", "m.wcag_level", "m.wcag_version", "m.is_best_practice",
        round3(avg).alias("avg_issues"), round3(pct).alias("pct_affected"), round_score(100.0 * (1.0 - F.col("deficit"))).alias("check_score"),
        round3(F.col("deficit") * F.col("max_impact") * weight).alias("penalty"), round3(F.col("deficit") * F.col("max_impact")).alias("raw_penalty"),
    )


def check_scores(pages: DataFrame, issues: DataFrame, cfg: ScoringConfig = CFG) -> DataFrame:
    """K3: one row for each run, category and rule with findings."""
    count = audited_pages(pages).groupBy("scan_id").agg(F.count("*").alias("pages"))
    per = page_checks(pages, issues, cfg).groupBy("scan_id", "category", "rule_id").agg(
        F.sum("wtotal").alias("wtotal"), F.countDistinct("url").alias("pages_affected"), F.min(F.struct("url", "m")).alias("first")
    )
    per = per.withColumn("m", F.col("first.m")).drop("first").join(count, "scan_id")
    return _scored(per, F.col("pages"), cfg)


def page_check_scores(pages: DataFrame, issues: DataFrame, cfg: ScoringConfig = CFG) -> DataFrame:
    """The same for each page alone (K12's checks)."""
    rows = page_checks(pages, issues, cfg).drop("url").withColumn("pages_affected", F.lit(1).cast("long"))
    return _scored(rows, F.lit(1), cfg)


def _points(x: Column) -> Column:
    return F.sum(x.cast("decimal(18,3)"))


def roll_up(checks: DataFrame, units: DataFrame, keys: list[str], cfg: ScoringConfig = CFG) -> DataFrame:
    """K7-K10 for each of ``units`` (rows of the keys): categories, overall, levels, versions, band."""
    category = F.col("category")
    when = lambda cond, v: F.coalesce(_points(F.when(cond, F.col(v))), F.lit(0).cast("decimal(18,3)"))
    access = category == "accessibility"
    sums = [when(category == c, "penalty").alias(f"_c{i}") for i, c in enumerate(cfg.active)]
    sums += [when(access & (F.col("wcag_level") == v), "raw_penalty").alias(f"_l{v}") for v in ("A", "AA", "AAA")]
    sums += [when(access & (F.col("wcag_version") == v), "raw_penalty").alias(f"_v{v[0]}{v[2]}") for v in ("2.0", "2.1", "2.2")]
    rows = units.select(*keys).join(checks.groupBy(*keys).agg(*sums), keys, "left")
    got = lambda c: F.coalesce(c, F.lit(0)).cast("double")
    score = lambda *cols: round_score(100.0 - reduce(lambda a, b: a + b, [got(F.col(c)) for c in cols]))
    cats = [score(f"_c{i}") for i in range(len(cfg.active))]
    overall = round_score(reduce(lambda a, b: a + b, cats) / F.lit(float(len(cats))))
    out = rows.select(
        *keys, overall.alias("overall"), *[c.alias("cat_" + n.lower().replace(" ", "_")) for c, n in zip(cats, cfg.active, strict=True)],
        score("_lA").alias("score_a"), score("_lA", "_lAA").alias("score_aa"), score("_lA", "_lAA", "_lAAA").alias("score_aaa"),
        score("_v20").alias("v20"), score("_v20", "_v21").alias("v21"), score("_v20", "_v21", "_v22").alias("v22"),
    )
    return out.withColumn("band", band_for(F.col("overall"), cfg))


def site_scores(pages: DataFrame, checks: DataFrame, cfg: ScoringConfig = CFG) -> DataFrame:
    """The scores of every run that has audited pages."""
    return roll_up(checks, audited_pages(pages).select("scan_id").distinct(), ["scan_id"], cfg)


def page_scores(pages: DataFrame, issues: DataFrame, cfg: ScoringConfig = CFG) -> DataFrame:
    """The scores of every audited page; error pages score 5 at most."""
    units = audited_pages(pages).select("scan_id", "page_id", "is_error_page")
    rows = roll_up(page_check_scores(pages, issues, cfg), units, ["scan_id", "page_id"], cfg).join(units, ["scan_id", "page_id"])
    cap = lambda c: F.when(F.col("is_error_page"), F.least(F.col(c), F.lit(ERROR_PAGE_MAX))).otherwise(F.col(c))
    return rows.select("scan_id", "page_id", cap("overall").alias("score"), *[cap(c).alias(c) for c in ("score_a", "score_aa", "score_aaa")], *[c for c in rows.columns if c.startswith("cat_")])


def score_tree(checks: DataFrame) -> DataFrame:
    """Nodes of version, level and criterion; a version's score from all its penalties."""
    version = F.coalesce("wcag_version", F.lit("best practice"))
    nodes = checks.groupBy("scan_id", version.alias("version"), F.coalesce("wcag_level", F.lit("")).alias("level"), F.coalesce("criterion_id", F.lit("")).alias("criterion")).agg(
        F.count("*").alias("n_checks"), _points(F.col("penalty")).alias("p")
    )
    total = nodes.groupBy("scan_id", "version").agg(F.sum("p").alias("vp"))
    return nodes.join(total, ["scan_id", "version"]).select("scan_id", "version", "level", "criterion", "n_checks", F.col("p").cast("double").alias("penalty"), F.greatest(F.lit(0), F.bround(100 - F.col("vp"), 0).cast("int")).alias("version_score"))
