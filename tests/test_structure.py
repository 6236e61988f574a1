"""The structure of hand-written pages: intervals, paths, main text, labels of fields, consent, contacts."""

import pytest

from quillmark.operators import elements as E
from quillmark.operators import structure as S

PAGE = """<html lang=en><head><title>t</title></head><body><header>Top <b>bar</b></header><nav>Home <a href=/x>X</a></nav>
<main id=m><h1>Head</h1><p>One <i>two</i>  three.<br>Line</p><div hidden>secret <video src=v></video></div><aside>side</aside><p>Last<p>open</main>
<footer>foot</footer><div class="x cookie-notice">we eat biscuits</div></body></html>"""
FORM = """<body><nav>n</nav><form action="/go" method="POST"><label for=a>For  a</label><input id=a name=na type=EMAIL required><label>Wrap <input type=password></label>
<input aria-label=Aria placeholder=no><input placeholder=Hold name=h><select name=sel><option>o</select><textarea id=only></textarea><label for=e> </label><input id=e type=tel aria-required=true><input type=hidden></form>
<form></form><input name=outside></body>"""


@pytest.fixture(scope="module")
def rows(spark):
    pages = spark.createDataFrame([(1, PAGE), (2, FORM), (3, None), (4, "")], "page_id long, html string")
    return E.parse_elements(pages).cache(), E.parse_texts(pages).cache()


def test_intervals_nest(rows):
    got = {(r.page_id, r.pos): r for r in rows[0].collect()}
    by = {r.tag: r for r in got.values() if r.page_id == 1}
    assert by["main"].last >= by["aside"].pos > by["main"].pos and by["footer"].pos > by["main"].last and by["html"].last == max(r.pos for r in got.values() if r.page_id == 1)
    for r in got.values():
        if r.parent is not None:
            up = got[r.page_id, r.parent]
            assert up.pos < r.pos <= r.last <= up.last and r.depth == up.depth + 1


def test_paths_start_at_an_id(rows):
    at = {(r.page_id, r.pos): r.tag for r in rows[0].collect()}
    got = {(at[r.page_id, r.pos], r.selector) for r in S.selectors(rows[0]).collect() if r.page_id == 1}
    assert ("h1", "#m > h1") in got and ("p", "#m > p:nth-of-type(1)") in got and ("footer", "html > body > footer") in got and ("main", "#m") in got


def test_main_text_leaves_out_what_is_around(rows):
    got = {r.page_id: r.text for r in S.main_text(*rows).collect()}
    assert got[1] == "Head\n\nOne two three.\nLine\n\nLast\n\nopen" or got[1] == "Head\n\nOne two three.\nLine\n\nLastopen"
    assert 3 not in got and 4 not in got
    assert {r.page_id: (r.nav_text, r.alt_text) for r in S.navigation_text(rows[0]).collect()} == {1: ("Home X", ""), 2: ("n", "")}


def test_query_of_main_text_reads_references_as_its_sql_does(spark, tmp_path):
    from quillmark.plans import queries, realpages  # noqa: F401

    spark.createDataFrame([(1, "http://h/", "<body><article><h1>cut &amp;&am</h1><p>cut &amp</p></article></body>")], "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    assert [r.text for r in queries.QUERIES["page_main_text"](spark, str(tmp_path)).collect()] == ["cut &&am\n\ncut &amp"]


def test_labels_fall_back_in_order(rows):
    got = [tuple(r) for r in S.form_fields(rows[0]).orderBy("pos").select("field", "label", "required", "type").collect()]
    assert got == [(1, "For a", True, "email"), (2, "Wrap", False, "password"), (3, "Aria", False, "input"), (4, "Hold", False, "input"), (5, "sel", False, "select"), (6, "only", False, "textarea"), (7, "e", True, "tel"), (8, "", False, "hidden")]
    forms = S.page_forms(rows[0]).orderBy("pos").collect()
    assert [(f.action, f.method, f.n_fields, f.sensitive, f.names) for f in forms] == [("/go", "post", 8, ["email", "password", "tel"], ["na", "h", "sel"]), ("", "get", 0, None, None)]
    assert {(r.rule_id, r.forms, r.sensitive) for r in S.form_findings(S.page_forms(rows[0])).collect()} == {("form_data_review", 2, "email,password,tel"), ("forms_inventory", 2, "email,password,tel")}


def test_forms_go_by_page_once(spark):
    rows = E.parse_elements(spark.createDataFrame([(1, FORM), (2, FORM + FORM)], "page_id long, html string"), tags=S.FORM_TAGS, columns=S.FORM_COLUMNS)
    for df, n in ((S.form_fields(rows), 24), (S.page_forms(rows), 6), (S.form_findings(S.page_forms(rows)), 4)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1 and plan.count("MapInArrow") == 1 and df.count() == n


def test_fields_without_a_label_of_their_own(spark):
    html = "<form><label for=b>one</label><label for=b>two</label><label>  <input id=b name=n><input name=k></label><label for=>x</label><input id=></form><form><label for=z></label><label>in <textarea id=z></textarea></label></form><label for=b>late</label><select id=b></select>"
    rows = E.parse_elements(spark.createDataFrame([(1, html), (2, html)], "page_id long, html string"))
    assert [(r.page_id, r.field, r.label) for r in S.form_fields(rows).orderBy("page_id", "pos").collect()] == [(p, n, x) for p in (1, 2) for n, x in ((1, "one"), (2, "k"), (3, ""), (1, "in"))]


def test_media_counts_in_the_main_part_only(spark):
    words = "word " * 20
    pages = [(1, f"<body><main>{words}</main><video></video></body>"), (2, f"<body><main>{words}<iframe></iframe></main></body>"), (3, f"<body>{words}<canvas></canvas></body>"), (4, "<body>" + "".join(f"<h1>h{i}</h1>" for i in range(7)) + "</body>")]
    got = [(r.page_id, r.rule_id, r.detail) for r in E.page_level(E.parse_elements(spark.createDataFrame(pages, "page_id long, html string"))).collect()]
    assert {p for p, r, _ in got if r == "thin_pages"} == {1, 4} and (4, "multiple_h1", "7: h0 | h1 | h2 | h3 | h4") in got


def test_consent_and_privacy(spark):
    pages = [(1, PAGE), (2, "<body><div>Cookies! Do you agree?</div><a href=/gdpr>x</a></body>"), (3, "<body><div>cookie recipes</div><a>privacy</a></body>"), (4, "<body><div>cookie accept " + "x " * 1500 + "</div><a href=/a>Privacy notes</a></body>")]
    got = {r.page_id: (r.has_privacy_link, r.has_consent) for r in S.consent_signals(E.parse_elements(spark.createDataFrame(pages, "page_id long, html string"))).collect()}
    assert got == {1: (False, True), 2: (True, True), 3: (False, False), 4: (True, False)}


def test_contacts_of_texts_and_links(spark):
    html = "<body>Call (212) 555-0199 or 212.555.0199, write A@b.org <a href='tel:+1%20212%20555%200100?x=1'>c</a><a href='tel:office'>o</a><a href='mailto:a@B.org'>m</a><a href='mailto:Create a Case'>k</a><a href='mailto:z%40b.org?subject=q'>z</a></body>"
    rows = E.parse_elements(spark.createDataFrame([(1, html), (2, "<body></body>")], "page_id long, html string"))
    got = sorted((r.rule_id, r["rank"], r.value) for r in S.exposed_contacts(rows).collect())
    assert got == [("email_addresses_exposed", 1, "A@b.org"), ("email_addresses_exposed", 2, "z@b.org"), ("phone_numbers_exposed", 1, "(212) 555-0199"), ("phone_numbers_exposed", 2, "212.555.0199"), ("phone_numbers_exposed", 3, "+1 212 555 0100")]
    assert {(r.rule_id, r["count"]) for r in S.contact_findings(S.exposed_contacts(rows)).collect()} == {("email_addresses_exposed", 2), ("phone_numbers_exposed", 3)}


def test_hidden_text_conveys_nothing(spark):
    pages = [(1, "<body><div hidden><p>see the red button</p></div><p>see the red button</p></body>")]
    got = [r for r in E.element_findings(E.parse_elements(spark.createDataFrame(pages, "page_id long, html string"))).collect() if r.rule_id == "text_conveys_information"]
    assert len(got) == 1
