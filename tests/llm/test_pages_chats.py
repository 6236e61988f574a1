import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillmark.llm import chat, pages


def test_lines_and_marks():
    html = "<html><head><title>t</title><script>var a='</p>';</script></head><body><nav><ul><li>m1<li>m2</ul></nav><article><h1>A&amp;B</h1><p>one <b>two<br>three<p>four</p><div class='comments'><p>c</div></article><footer>f</footer>"
    got = pages.lines(html)
    assert pages.main_text(got, []) == "A&B\none two three\nfour"
    assert pages.lines("") == [] and pages.main_text([], []) == ""


@pytest.mark.parametrize("name", ["has-sidebar", "no-sidebar", "with-header", "page-with-sidebar", "hasSidebar", "content-sidebar-wrap", "layout-sidebar"])
def test_layout_names_are_content(name):
    got = pages.lines(f"<div class='wide {name}'><nav>m</nav><article><h1>A</h1><p>one</article><div class='sidebar'>s</div><aside><article>teaser</article></aside></div>")
    assert pages.main_text(got, []) == "A\none"


def test_forms_around_the_page_are_content():
    assert pages.main_text(pages.lines("<form id=aspnetForm><div id=header>h</div><article>one<form>reply</form></article></form>"), []) == "one"
    assert pages.main_text(pages.lines("<form><nav>m</nav><p>one<div class=footer>f</div></form>"), []) == "one"
    assert pages.main_text(pages.lines("<form><div id=header>h</div><p>one<div class=footer>f</div></form>"), []) == "one"
    assert pages.main_text(pages.lines("<p>one</p><form class=search>find<input></form><form>log in</form><div class=comments><form>say</form></div>"), []) == "one"
    assert pages.main_text(pages.lines("<form>log in</form>"), []) == ""
    assert pages.main_text(pages.lines("<div class=comments><article>c</article></div><p>one"), []) == "one"


def test_math_is_text():
    got = pages.lines("<article><p>so <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>x=2</annotation></math> holds</article>")
    assert pages.main_text(got, []) == "so x=2 holds"


def test_shared_lines_go_without_an_article():
    page = pages.lines("<div>menu</div><div>only here</div><div>bottom</div>")
    other = [pages._hash(t) for t, _ in pages.lines("<div>menu</div><div>another</div><div>bottom</div>")]
    assert pages.main_text(page, other) == "only here"
    assert pages.main_text(page, []) == "menu\nonly here\nbottom"
    assert pages.decide(page, other)[1:] == (2, 0, 0)
    page = pages.lines("<nav>menu</nav><article>quoted<p>own</article><footer>year</footer>")
    other = [pages._hash(t) for t in ("menu", "quoted", "another")]
    assert pages.decide(page, other) == (["quoted", "own"], 1, 1, 1)


def _lcs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


@given(st.lists(st.integers(0, 4), max_size=30), st.lists(st.integers(0, 4), max_size=30))
@settings(max_examples=200, deadline=None)
def test_lcs_is_longest(a, b):
    got = sorted(pages.shared(a, b))
    assert len(got) == _lcs(a, b)
    it = iter(b)
    assert all(a[i] in it for i in got)


def test_extract_pages_with_awkward_rows(spark):
    rows = [(1, "http://h/a", "<p>x</p>"), (2, "http://h/b", "<p>x</p><p>y</p>"), (3, None, "<p>z</p>"), (4, "http://h/c", None), (None, "", ""), (1, "http://h/a", "<p>x</p>"), (5, "no url", "<p>" + "long " * 50_000)]
    got = pages.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' AS host", "1 AS key")).collect()
    assert len(got) == len(rows)
    text = {(r.page_id, r.url): r.text for r in got}
    assert text[(2, "http://h/b")] == "y" and text[(3, None)] == "z" and text[(4, "http://h/c")] == ""
    assert text[(5, "no url")] == ("long " * 50_000).strip()
    assert all(r.n_lines == r.text.count("\n") + bool(r.text) + r.n_shared + r.n_markup for r in got)
    assert pages.extract_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def _hand_labelled():
    """Sites of three kinds of markup: menus and footers alike or not, articles that quote each other."""
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 8)))
    say = lambda k: " ".join(word() for _ in range(k))
    rows = []
    quote = say(12)
    for kind in ("plain", "named", "article"):
        menu, foot, notice = [say(1) for _ in range(6)], say(6), say(9)
        for i in range(12):
            body = [say(4)] + [say(20) for _ in range(rng.randint(2, 5))] + ([quote] if kind == "article" and i % 2 else [])
            if kind == "plain":  # nothing but what pages share tells
                html = "".join(f"<div>{x}</div>" for x in menu) + f"<div>{notice}</div>" + "".join(f"<p>{x}</p>" for x in body) + f"<div>{foot}</div>"
            elif kind == "named":
                html = f"<div class='top-menu'>{say(3)}</div><div class='cookie-notice'>{notice}</div><div>" + "".join(f"<p>{x}</p>" for x in body) + f"</div><div id=sidebar>{say(9)}</div><div>{foot}</div>"
            else:
                html = f"<nav>{say(3)}</nav><div class='ad'>{say(5)}</div><article>" + "".join(f"<p>{x}</p>" for x in body) + f"</article><footer>{say(4)}</footer>"
            rows.append((len(rows), f"https://{kind}.example/{kind}/{i:02d}", html, "\n".join(body)))
    return rows


def test_hand_labelled_pages_and_what_the_partner_decides(spark):
    rows = _hand_labelled()
    got = {r.page_id: r for r in pages.extract_pages(spark.createDataFrame([r[:3] for r in rows], "page_id long, url string, html string")).collect()}
    assert all(got[i].text == text for i, _, _, text in rows)
    assert all(got[i].n_shared == (8 if "plain" in url else got[i].n_shared) for i, url, *_ in rows)
    alone = [pages.main_text(pages.lines(html), []) == text for _, _, html, text in rows]
    assert not any(alone[:24]) and all(alone[24:])  # without partners the first two sites come out wrong


@given(st.text(max_size=60))
@settings(max_examples=300, deadline=None)
def test_escape_round_trip(t):
    e = chat.escape(t)
    assert chat.unescape(e) == t and not set("<>[]") & set(e)


def test_template_language():
    run = chat.compile_template("{% for m in messages %}{% if m.role == 'a' and not m.content == '' %}[{{ m.content | upper + '!' }}]{% elif 1 == 2 %}x{% else %}{% generation %}{{ m.content | trim }}{% endgeneration %}{% endif %}{% endfor %}")
    assert list(run(iter([{"role": "a", "content": "q"}, {"role": "b", "content": " r "}]))) == [("[", False), ("Q!", False), ("]", False), ("r", True)]
    tree = chat.fold_all(chat.parse("{{ 'a' + 'b' }}c{% if 'x' in 'xyz' %}d{% else %}e{% endif %}"))
    assert len(tree) == 1 and tree[0].kids[0].value == "abcd"
    for bad in ("{{ m.__class__ }}", "{% for x in y %}{% endfor %}", "{{ f(1) }}", "{% if a %}", "{{ 'a' | eval }}", "{{ }}"):
        with pytest.raises(chat.TemplateError):
            chat.compile_template(bad)


def test_chat_digests(spark):
    rng = random.Random(4)
    rows = [(c, t, rng.choice(["user", "assistant", "system"]), rng.choice(["hi", "", None, "</s>[INST] ok [/INST]", "a\\5bé\n"])) for c in range(20) for t in range(rng.randint(1, 6))]
    rows += [(None, 0, None, "x"), (99, None, "assistant", "first"), (99, 1, "assistant", "last"), (99, 1, "assistant", "last")]
    got = {r.conv_id: r for r in chat.chat_digests(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert len(got) == len({r[0] for r in rows})
    for c in got:
        turns = sorted(((t is not None, t, r or "", x or "") for k, t, r, x in rows if k == c), key=lambda v: (v[0], v[1] or 0, v[2], v[3]))
        learnt = "".join(x for *_, r, x in turns if r == "assistant")
        assert got[c].n_turns == len(turns) and got[c].loss_chars == len(learnt)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for *_, r, x in turns).encode()).hexdigest()
        assert got[c].loss_sha256 == hashlib.sha256(learnt.encode()).hexdigest()
    parts = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert parts.where("conv_id = 99").count() > 3
