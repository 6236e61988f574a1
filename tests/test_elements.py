"""Element checks on hand-written pages: each rule fires on one element and not on its good twin."""

import random

import pytest

from quillmark.operators import elements as E

PAGE = """<html><head><title>Home</title><link rel="shortcut icon" href="/f.ico"><style>.a{}</style></head><body>
<nav>menu</nav><marquee>x</marquee><video autoplay src=v.mp4></video><img src="a.gif" alt="three words here"><img src=b.png><img src=c.png alt=""><img src=d.png alt="photo.jpg">
<div onclick="go()">click</div><div onclick="go()" role=button tabindex=0>click</div><p style="font-size: 9px !important">small</p><span data-term>jargon</span><span data-term title="meaning">jargon</span>
<abbr>HTML</abbr><abbr title="x">CSS</abbr><div role=alert>now</div><i tabindex=3>t</i><b draggable="true">d</b><p>see the red button</p><p>Your session expires soon</p>
<fieldset><legend> </legend><input name=a required></fieldset><fieldset><legend>ok</legend></fieldset>
<form><label for=zz>l1</label><label for=d1>l2</label><label for=i1>l3</label><label>bare</label><label>in <input></label><input id=i1 type=email><input name=q pattern=x placeholder=hint></form>
<form>ask for help<a href=/contact>c</a></form><div id=d1>d</div><table><tr><td>1</table><table summary=s></table>
<a href="#">p</a><a href="/x" target=_blank>go there</a><a href="/y" target=_blank>opens in a new tab</a><a href="/z">Read more...</a><a href="/w"></a><a href="/v"><img src=e.png alt=ok></a><a href="#gone">g</a><a href="#d1">g</a>
<a href="/same">one</a><a href="/same">two</a><h2>Details</h2><h4>deep</h4><h2>twice</h2><h2>Twice</h2><canvas></canvas></body></html>"""


@pytest.fixture(scope="module")
def rows(spark):
    return E.parse_elements(spark.createDataFrame([(1, PAGE), (2, None), (3, "")], "page_id long, html string")).cache()


def _tags(rows, found):
    at = {(r.page_id, r.pos): r for r in rows.collect()}
    return [(r.rule_id, at[r.page_id, r.pos].tag) for r in found.collect()]


def test_rules_fire_on_their_element_only(rows):
    got = sorted(x for x in _tags(rows, E.element_findings(rows)) if x[0] not in ("headings_review",))
    assert got == sorted([
        ("consistent_navigation", "nav"), ("pause_animated_content", "marquee"), ("pause_animated_content", "video"), ("three_flashes_a", "video"), ("flashing_content_aaa", "video"), ("three_flashes_a", "img"), ("flashing_content_aaa", "img"),
        ("three_flashes_a", "canvas"), ("flashing_content_aaa", "canvas"), ("images_of_text", "img"), ("image-alt-content", "img"), ("image-alt-content", "img"), ("decorative_images_review", "img"), ("keyboard_functionality", "div"),
        ("visual_presentation_text", "p"), ("unusual_words_definitions", "span"), ("abbreviations_meaning", "abbr"), ("interruptions_suppressible", "div"), ("custom_tab_order", "i"), ("drag_alternative", "b"), ("text_conveys_information", "p"),
        ("text_conveys_information", "canvas"), ("field_instructions", "input"), ("consistent_help", "a"), ("placeholder_links", "a"), ("new_tab_disclosure", "a"), ("link_purpose_unclear", "a"), ("favicon_review", "link"),
    ])


def test_checks_that_join_elements(rows, spark):
    assert [(r.tables, r.without) for r in E.table_summary(rows).collect()] == [(2, 1)]
    assert E.fieldset_legend(rows).count() == 1
    assert sorted(x for x, _ in _tags(rows, E.label_findings(rows))) == ["label_misuse", "label_misuse", "label_orphan_for"]
    assert [r.fields for r in E.context_sensitive_help(rows).collect()] == [3]
    assert {r.page_id for r in E.page_titles(rows, spark.range(1, 4).withColumnRenamed("id", "page_id")).collect()} == {1, 2, 3}
    assert sorted(x for x, _ in _tags(rows, E.time_limits(rows))) == ["inactivity_data_loss", "timing_not_essential"]
    assert [(r.first_name, r.name) for r in E.consistent_identification(rows).collect()] == [("one", "two")]
    assert sorted((r.tag, r.reason) for r in E.headings_labels_descriptive(rows).collect()) == [("h2", "duplicated"), ("h2", "duplicated"), ("h2", "vague"), ("legend", "empty")]
    assert E.link_no_text(rows).count() == 1 and [r.mark for r in E.broken_anchor_links(rows).collect()] == ["gone"]
    assert sorted(r.pos is None for r in E.heading_order(rows).collect()) == [False, True]
    assert {r.rule_id for r in E.page_level(rows).collect()} == {"page-title"}


def test_captured_styles(spark):
    cols = "page_id long, pos long, b_outline_width double, b_outline_style string, b_box_shadow string, b_decoration string, b_r int, b_g int, b_b int, a_outline_width double, a_outline_style string, a_box_shadow string, a_decoration string, a_r int, a_g int, a_b int"
    plain = (0.0, "none", "none", "none", 255, 255, 255)
    after = [plain, (2.0, "solid", "none", "none", 255, 255, 255), (0.0, "none", "none", "none", 250, 250, 250), (0.0, "none", "none", "none", 0, 0, 0), (0.0, "none", "none", "underline", 255, 255, 255)]
    got = E.focus_findings(spark.createDataFrame([(1, i, *plain, *a) for i, a in enumerate(after)], cols)).collect()
    assert sorted((r.pos, r.rule_id, r.manual_review) for r in got) == [(0, "focus-visible", False), (2, "focus-visible", True), (2, "focus_appearance", True)]
    boxes = [(1, 0, None, "div", False, 0.0, 400.0, 9.0), (1, 1, 0, "p", False, 0.0, 390.0, 9.0), (1, 2, None, "table", False, 0.0, 900.0, 9.0), (2, 0, None, "pre", False, 0.0, 500.0, 9.0), (3, 0, None, "p", False, 0.0, 322.0, 9.0), (4, 0, None, "p", True, 0.0, 500.0, 9.0)]
    got = E.reflow(spark.createDataFrame(boxes, "page_id long, pos long, parent long, tag string, exempt_within boolean, x double, width double, height double")).collect()
    assert sorted((r.page_id, r.pos, r.manual_review) for r in got if r.pos is not None) == [(1, 0, False)] and {r.page_id for r in got if r.manual_review} == {2, 4}


def test_page_findings_read_references_as_their_sql_does(spark, tmp_path):
    from quillmark.plans import queries, realpages  # noqa: F401

    html = "<html><head><title>cut &amp;&amp</title></head><body><h1>cut &amp;&amp</h1><a href='/x'>more</a><a href='/x'>more&amp</a></body></html>"
    spark.createDataFrame([(1, "http://h/", html)], "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = {(r.rule_id, r.detail) for r in queries.QUERIES["page_findings"](spark, str(tmp_path)).collect()}
    assert {("headings_review", "cut &&amp"), ("page-title", "cut &&amp"), ("consistent_identification", "more&amp")} <= got


def test_plain_pages_need_no_parser_and_read_alike():
    rng = random.Random(2)
    bits = ["<p>", "</p>", '<P class="a&amp;b">', "<b x>", "<b x='1'>", "<form>", "</form>", '<label for="q">', "</label>", '<input name="a>b" required>', "<br>", "<br/>", "a < b", "&amp;", "&amp", "text", " \n ", "<script>x<b>&amp;</script>"]
    bits += ["<style>a", "</ p>", "</p x>", "<!-- c -->", '<img src="">', '<a b="c"d="e">', '<a  b="c">', "</div>", "<div hidden >", "<x:y>", "<", ">", "<noscript>", "</noscript>", '<i tabindex="3" aria-hidden="TRUE">', '<a b="1" b="2">']
    plain = 0
    for _ in range(4000):
        html = "".join(rng.choice(bits) for _ in range(rng.randint(0, 9)))
        quick, slow = E._Rows(texts=True), E._Rows(texts=True)
        quick.take(html)
        slow.feed(html)
        slow.close()
        assert (quick.rows, quick.texts, quick.said) == (slow.rows, slow.texts, slow.said), html
        plain += quick.get_starttag_text() is None and bool(quick.rows)
        some = [{k: r[k] for k in ("pos", "tag", "text")} for r in E.page_elements(html) if r["tag"] in ("p", "label")]
        assert some == [{k: r[k] for k in ("pos", "tag", "text")} for r in E.page_elements(html, tags=("p", "label"), columns=("pos", "tag", "text"))]
    assert plain > 300
