import json

from pyspark.sql import functions as F

from quillmark.operators import captured as C


def test_axe(spark):
    node = lambda *t, **k: {"target": list(t), "html": "<a>", **k}
    body = {
        "violations": [{"id": "color-contrast", "impact": "serious", "description": "d", "tags": ["wcag2aa", "wcag143"], "nodes": [node("a", "b"), node("c", impact="minor")]}],
        "incomplete": [{"id": "region", "impact": "moderate", "tags": ["best-practice"], "nodes": [node("d")]}],
        "passes": [{"id": "image-alt", "nodes": [node("e"), node("f")]}],
    }
    df = spark.createDataFrame([(1, json.dumps(body)), (2, "{broken"), (3, None)], "page_id long, body string")
    rows = {(r.rule_id, r.selector): r for r in C.axe_issues(df).collect()}
    assert set(rows) == {("color-contrast", "a > b"), ("color-contrast", "c"), ("region", "d")}
    assert rows[("color-contrast", "c")].impact == "minor" and rows[("color-contrast", "a > b")].impact == "serious"
    r = rows[("color-contrast", "a > b")]
    assert (r.wcag_version, r.wcag_level, r.criterion_id, r.manual_review, r.leaf_selector) == ("2.0", "AA", "1.4.3", False, "b")
    assert rows[("region", "d")].is_best_practice and rows[("region", "d")].manual_review
    assert [(r.rule_id, r.nodes) for r in C.axe_pass_summary(df).collect()] == [("image-alt", 2)]


def test_tags_prefer_the_newest_version(spark):
    got = spark.createDataFrame([(["wcag2a", "wcag22aa", "wcag2411"],)], "t array<string>").select(C.classify_tags(F.col("t")).alias("w")).first().w
    assert tuple(got) == ("2.2", "AA", "2.4.11", False)


def test_lighthouse(spark):
    body = {"audits": {"unused-css-rules": {"score": 0.89}, "font-display": {"score": 0.9}, "dom-size": {"score": 1, "numericValue": 1501}, "interactive": {"numericValue": 5000}, "long-tasks": {"score": None}}}
    got = {r.rule_id for r in C.lighthouse_findings(spark.createDataFrame([(1, json.dumps(body)), (2, "x")], "page_id long, body string")).collect()}
    assert got == {"unused_css", "excessive_dom_size"}


def test_headers(spark):
    schema = "page_id long, is_https boolean, headers map<string,string>, cookies array<struct<name string, secure boolean>>, ttfb_ms int"
    full = dict.fromkeys(("strict-transport-security", "content-security-policy", "x-frame-options", "x-content-type-options"), "x")
    df = spark.createDataFrame([(1, True, {}, [("a", False)], 601), (2, True, full, [("a", True)], 600)], schema)
    got = {(r.page_id, r.rule_id) for r in C.header_findings(df).collect()}
    assert got == {(1, r) for r in ("hsts", "csp_missing", "privacy_enhanced", "cookie_ssl", "server_response_time")}


def test_target_spacing(spark):
    box = lambda i, x, tag="BUTTON", size=10.0, display="block": (1, i, x - size / 2, 0.0, size, size, tag, display, "P")
    schema = "page_id long, target_id long, x double, y double, width double, height double, tag string, display string, parent_tag string"
    far = C.target_size(spark.createDataFrame([box(1, 0.0), box(2, 24.0)], schema))
    near = C.target_size(spark.createDataFrame([box(1, 0.0), box(2, 23.5, "INPUT"), box(3, 500.0), box(4, 510.0, "A", display="inline")], schema))
    assert far.count() == 0
    assert {(r.target_id, r.distance, r.manual_review) for r in near.collect()} == {(1, 23.5, False), (2, 23.5, True), (3, 10.0, False)}


def test_target_spacing_equals_all_pairs(spark):
    import math
    import random

    rng = random.Random(4)
    rows = [(p, i, rng.uniform(-200, 200), rng.choice([-96.0, -24.0, 0.0, 95.9]) + rng.random(), rng.choice([8.0, 30.0]), rng.choice([8.0, 30.0]), rng.choice(["A", "INPUT", "DIV"]), "inline", rng.choice(["P", "DIV"])) for p in range(3) for i in range(120)]
    rows.append((0, 999, None, 0.0, 8.0, 8.0, "DIV", "block", "P"))
    at = {(r[0], r[1]): (r[2] + r[4] / 2, r[3] + r[5] / 2) for r in rows if r[2] is not None}
    want = {}
    for p, i, *_, w, h, tag, _, up in rows:
        if (p, i) in at and min(w, h) < 24 and not (tag == "A" and up == "P"):
            d = min((math.dist(at[p, i], at[q]) for q in at if q[0] == p and q != (p, i)), default=99.0)
            if d < 24:
                want[p, i] = (round(d, 6), tag == "INPUT")
    found = C.target_size(spark.createDataFrame(rows, "page_id long, target_id long, x double, y double, width double, height double, tag string, display string, parent_tag string"))
    assert {(r.page_id, r.target_id): (round(r.distance, 6), r.manual_review) for r in found.collect()} == want and len(want) > 50
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "parent_tag" not in plan and "[-1" not in plan  # the boxes were computed before, and no box goes to nine cells


def test_pdf_score(spark):
    schema = "url string, pages int, title string, lang string, marked boolean, has_bookmarks boolean, has_text boolean, font_size_spread double, garbled_ratio double, error string"
    info = spark.createDataFrame([("a", 1, "", "en", False, False, True, None, 0.0, None), ("b", 1, "t", "en", True, True, True, 3.0, 0.0, "bad")], schema)
    found = C.pdf_checks(info)
    assert {r.rule_id for r in found.collect()} == {"pdf_not_tagged", "pdf_no_title", "pdf_contrast"}
    assert {r.url: r.score for r in C.pdf_scores(info, found).collect()} == {"a": 62, "b": None}


def test_keywords_colors_aliases(spark):
    pages = spark.createDataFrame([(1, "Buy now, buy NOW and wait"), (2, "nothing")], "page_id long, text string")
    got = C.policy_keywords(pages, spark.createDataFrame([("r", "buy now"), ("r", "wait"), ("q", "zzz")], "rule string, pattern string")).collect()
    assert [(r.page_id, r.rule, r.occurrences, sorted(r.patterns)) for r in got] == [(1, "r", 3, ["buy now", "wait"])]
    colors = spark.createDataFrame([(1, 255, 0, 0), (1, 10, 0, 0)], "page_id long, r int, g int, b int")
    far = C.nearest_color(colors, spark.createDataFrame([("black", 0, 0, 0), ("white", 255, 255, 255)], "name string, r int, g int, b int")).collect()
    assert [(r.r, r.nearest) for r in far] == [(255, "black")]
    f = spark.createDataFrame([("a", "content", 1), ("b", "ux", 2)], "rule_id string, category string, page_id long")
    alias = spark.createDataFrame([("a", "a2", "accessibility")], "rule_id string, alias_id string, alias_category string")
    assert {tuple(r) for r in C.add_aliases(f, alias).collect()} == {("a", "content", 1), ("b", "ux", 2), ("a2", "accessibility", 1)}
    g = spark.createDataFrame([(1, "x", "t1"), (1, "y", "t2"), (2, "x", "t1")], "site_id long, rule_id string, error_text string")
    left = C.suppress_grammar(g, spark.createDataFrame([(1, "t1")], "site_id long, error_text string"), spark.createDataFrame([(1, "y")], "site_id long, rule_id string"))
    assert [tuple(r) for r in left.select("site_id", "rule_id").collect()] == [(2, "x")]
