"""Site cards from stored facts: the same scores as from pages and findings, and no second scan of them."""

from quillmark.operators import facts, scoring
from quillmark.sources.views import view

SF = "/root/testdata/sf0.001"




def test_scores_from_facts_are_the_scores(spark):
    pages, issues = view(spark, SF, "pages"), view(spark, SF, "issues")
    kept = facts.page_rule_facts(pages, issues)
    bag = lambda df: sorted(map(repr, df.select(sorted(df.columns)).collect()))
    assert bag(facts.stored_check_scores(kept)) == bag(scoring.check_scores(pages, issues))
    assert bag(facts.stored_site_scores(kept)) == bag(scoring.site_scores(pages, scoring.check_scores(pages, issues)))


def test_cards_read_the_facts_alone(spark):
    from quillmark.plans.queries import QUERIES

    for name in ("site_cards", "site_overview", "site_scores"):
        files = QUERIES[name](spark, SF).inputFiles()
        assert not any(f"{t}.parquet" in f for f in files for t in ("lineitem", "orders", "customer"))


def test_a_card_of_a_site_without_runs(spark):
    kind = "scan_id long, page_id long, url string, is_document boolean, render_status string, last_changed_at long"
    pages = spark.createDataFrame([(1, 1, "a", False, "ok", 5), (1, 2, "b", True, "ok", None), (1, 3, "c", False, "error", 9)], kind)
    issues = spark.createDataFrame([], "issue_id long, scan_id long, page_id long, category string, rule_id string, subcategory string, criterion_id string, wcag_level string, wcag_version string, is_best_practice boolean, impact string, manual_review boolean, reviewed boolean")
    runs = spark.createDataFrame([(1, 7, 1, "done"), (2, 7, 2, "crawling"), (3, 8, 1, "failed")], "scan_id long, site_id long, created_at long, status string")
    sites = spark.createDataFrame([(7, "seven", 2), (8, "eight", 2)], "site_id long, name string, max_pages long")
    users = spark.createDataFrame([(7, 1), (7, 2)], "site_id long, user_id long")
    got = {r.site_id: r for r in facts.site_cards(sites, runs, facts.page_rule_facts(pages, issues), users).collect()}
    assert (got[7].overall, got[7].pages, got[7].documents, got[7].last_change, got[7].limit_reached, got[7].active_scan, got[7].users, got[7].history) == (100, 1, 1, 9, True, 2, 2, "100")
    assert (got[8].scan_id, got[8].overall, got[8].pages, got[8].limit_reached, got[8].history, got[8].users) == (None, None, 0, False, "", 0)
