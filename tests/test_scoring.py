"""Worked goldens of the score, by hand."""

import pytest
from pyspark.sql import functions as F

from quillmark.operators import scoring

PAGES = "scan_id long, page_id long, url string, render_status string, is_document boolean, is_error_page boolean"
ISSUES = "scan_id long, page_id long, issue_id long, rule_id string, category string, subcategory string, criterion_id string, wcag_level string, wcag_version string, is_best_practice boolean, impact string, manual_review boolean"


def _scores(spark, pages, issues):
    p = spark.createDataFrame([(1, i, f"u{i}", "ok", False, e) for i, e in pages], PAGES)
    i = spark.createDataFrame([(1, page, k, rule, cat, "", None, level, "2.0" if level else None, bp, impact, manual) for k, (page, rule, cat, level, bp, impact, manual) in enumerate(issues)], ISSUES)
    checks = scoring.check_scores(p, i)
    return checks.collect(), scoring.site_scores(p, checks).first(), {r.page_id: r for r in scoring.page_scores(p, i).collect()}


def test_one_serious_contrast_finding(spark):
    checks, site, page = _scores(spark, [(1, False)], [(1, "color-contrast", "accessibility", "AA", False, "serious", False)])
    assert (checks[0].check_score, checks[0].penalty) == (56, 6.55)
    assert (site.cat_accessibility, site.overall, site.band, site.score_a, site.score_aa, site.score_aaa) == (93, 99, "Excellent", 100, 93, 93)
    assert page[1].score == 99


def test_error_pages_are_capped(spark):
    *_, page = _scores(spark, [(1, True)], [(1, "color-contrast", "accessibility", "AA", False, "serious", False)])
    assert (page[1].score, page[1].score_a, page[1].score_aa, page[1].score_aaa) == (5, 5, 5, 5)


def test_half_the_pages_without_title(spark):
    checks, site, _ = _scores(spark, [(i, False) for i in range(4)], [(i, "page-title", "content", None, False, "moderate", False) for i in (0, 1)])
    assert (checks[0].check_score, checks[0].penalty, checks[0].avg_issues, checks[0].pct_affected) == (66, 5.063, 0.25, 0.5)
    assert (site.cat_content, site.overall) == (95, 99)


def test_no_findings_and_assisted_ones(spark):
    _, site, _ = _scores(spark, [(1, False)], [(1, "hsts", "privacy", None, False, "critical", True)])
    assert (site.overall, site.band) == (100, "Excellent")


def test_best_practice(spark):
    checks, site, _ = _scores(spark, [(1, False)], [(1, "region", "accessibility", None, True, "minor", False)])
    assert (checks[0].raw_penalty, checks[0].penalty) == (4.59, 0.459)
    assert (site.cat_accessibility, site.score_a, site.score_aaa) == (99, 100, 100)


@pytest.mark.parametrize(("x", "want"), [(-3.0, 0), (0.5, 1), (98.99, 99), (99.2, 99), (99.999, 99), (100.0, 100), (120.0, 100), (62.5, 63)])
def test_round_score(spark, x, want):
    assert spark.range(1).select(scoring.round_score(F.lit(x)).alias("s")).first().s == want


@pytest.mark.parametrize(("score", "band"), [(0, "Very poor"), (29, "Very poor"), (30, "Poor"), (59, "Fair"), (79, "Good"), (80, "Great"), (100, "Excellent")])
def test_bands(spark, score, band):
    assert spark.range(1).select(scoring.band_for(F.lit(score)).alias("b")).first().b == band
