"""The phrase automaton against regular expressions, and what is built on it."""

import random
import re

import pytest

from quillmark.operators import captured, compliance, findings, phrases
from quillmark.operators import elements as E
from quillmark.operators import structure as S


def _texts():
    rng = random.Random(1)
    parts = ["the", "The", "then", "this work", "THIS  WORK", "er", "über", "İstanbul", "a.b", "a_b", "x-the", "the-the", "\n", "naïve", "漢字", ".", "DEI", "dei office", "diversity in art", "diversity officer"]
    return [(i, " ".join(rng.choice(parts) for _ in range(rng.randint(0, 40)))) for i in range(60)] + [(100, None), (101, ""), (102, "the " * 20_000)]


PHRASES = ["the", "this work", "er", "über", "a.b", "THE", "naïve", "漢", "dei", "dei office", "zz", ""]


@pytest.mark.parametrize("whole", [True, False])
def test_occurrences_equal_regular_expressions(spark, whole, monkeypatch):
    rows = _texts()
    want = []
    for page, text in rows:
        for i, p in enumerate(PHRASES):
            if p and p.lower() not in [q.lower() for q in PHRASES[:i]]:
                low = phrases.folded(text or "")
                found = list(re.finditer(rf"(?<!\w){re.escape(p.lower())}(?!\w)" if whole else re.escape(p.lower()), low))
                want += [(page, i, k + 1, len(found), m.start(), text[m.start() : m.end()], text[max(0, m.start() - 60) : m.end() + 60]) for k, m in enumerate(found)]
    df = spark.createDataFrame(rows, "page_id long, text string")
    for most in (phrases.MOST_CHARS, 12):
        monkeypatch.setattr(phrases, "MOST_CHARS", most)
        if most == 12 and not whole:
            continue
        got = [tuple(r) for r in phrases.occurrences(df, PHRASES, whole).collect()]
        # a phrase listed twice in different parts is found in each
        assert sorted(g for g in got if g[1] != 5) == sorted(want)


def test_thousands_of_phrases(spark):
    many = [f"word{i}" for i in range(20_000)] + ["word7 word8"]
    df = spark.createDataFrame([(1, "Word7 word8, word19999 word20000 xword1")], "page_id long, text string")
    got = {(r.phrase, r.at) for r in phrases.named(phrases.occurrences(df, many), many).collect()}
    assert got == {("word7", 0), ("word8", 6), ("word7 word8", 0), ("word19999", 13)}


def test_caps_and_rules(spark):
    df = spark.createDataFrame(_texts(), "page_id long, text string")
    got = findings.locate_phrases(df, ["the", "er"], each=3, overall=4).collect()
    assert max(r.number for r in got) == 3 and max(r.total for r in got) == 20_000
    assert {(r.page_id, r.term) for r in findings.terms_present(df, ["THE", "the", "zz"]).collect() if r.page_id == 102} == {(102, "THE")}
    rules = spark.createDataFrame([("r", "the"), ("r", "This Work"), ("q", "the"), ("q", "nowhere"), ("q", "")], "rule string, pattern string")
    one = spark.createDataFrame([(1, "The end of the work; this work ends then.")], "page_id long, text string")
    rows = {r.rule: r for r in captured.policy_keywords(one, rules, around=4).collect()}
    assert rows["r"].occurrences == 4 and rows["q"].occurrences == 3 and rows["r"].excerpts == ["The end", "rk; this work end"] and rows["q"].excerpt == "The end"
    sites = spark.createDataFrame([(1, 7, "the cat"), (2, 8, "the cat")], "page_id long, site_id long, text string")
    own = spark.createDataFrame([(7, "a", "cat"), (8, "b", "THE"), (8, "b", "dog")], "site_id long, rule string, pattern string")
    assert {(r.page_id, r.rule, r.occurrences) for r in phrases.site_keywords(sites, own, ["cat", "the", "dog"]).collect()} == {(1, "a", 1), (2, "b", 1)}


def test_keywords_in_titles_and_alternative_texts(spark):
    html = "<body><img alt='a bad dog, bad' title='a bad dog, bad'><img alt='badly' title='Bad idea'><p>Bad things. <b title=good>not bad</b></p></body>"
    rows = E.parse_elements(spark.createDataFrame([(1, html)], "page_id long, html string")).cache()
    got = [(r.phrase, r.pos, r.number, r.total) for r in phrases.sensitive_keywords(rows, S.visible_text(rows), ["bad", "good"]).orderBy("number").collect()]
    assert got == [("bad", 1, 1, 5), ("bad", 2, 2, 5), ("bad", None, 3, 5), ("bad", None, 4, 5), ("good", 4, 5, 5)]


def test_query_reads_references_as_its_sql_does(spark, tmp_path):
    from quillmark.plans import queries, realpages  # noqa: F401

    html = "<html><head><script>a&amp b&copy</script></head><body><h1>rest&amp</h1><p>and the&copy;de &amp;amp &notit; &#38;les<b title='x&amp'>que</b> &amp</p></body></html>"
    pages = spark.createDataFrame([(1, "http://h/", html)], "page_id long, url string, html string")
    pages.write.parquet(str(tmp_path / "pages.parquet"))
    got = sorted((r.phrase, r.number, r.total) for r in queries.QUERIES["sensitive_keywords"](spark, str(tmp_path)).collect())
    assert got == [("de", 2, 2), ("the", 1, 2)]  # "ampand" is no "and"
    own = {r["tag"]: (r["own"], r["title"]) for r in E.page_elements(html, closed=True)}
    assert own["script"][0] == "a&amp b&copy" and own["h1"][0] == "rest&amp" and own["b"][1] == "x&amp" and own["p"][0] == "and the©de &amp &notit; &les &amp"
    assert {r["tag"]: r["own"] for r in E.page_elements(html)}["h1"] == "rest&"


def test_tiers_claim_places_as_the_counts_do(spark):
    df = spark.createDataFrame(_texts() + [(200, "the chief diversity officer of the DEI office; study of diversity in art, diversity in .")], "page_id long, text string")
    rows = phrases.tier_matches(df, compliance.PHRASE_TIERS).collect()
    counts = {}
    for r in rows:
        counts.setdefault(r.page_id, [0, 0, 0])[r.tier - 1] += 1
        assert r.matched in r.context
    want = {r.page_id: [r.tier1, r.tier2, r.tier3] for r in compliance.phrase_tiers(df).collect()}
    assert counts == want and [r.matched for r in rows if r.page_id == 200] == ["DEI office", "diversity officer", "study of diversity"]


def test_counts_by_tier_take_one_pass(spark):
    rows = [(i, t) for i, t in enumerate(["the DEI office", None, "", "roads", "diversity in diversity in art", "research on diversity in diversity in art", "diversity in \u00a0", "diversity in ,", "DEI " * 3] * 700)]
    got = {r.page_id % 9: (r.tier1, r.tier2, r.tier3) for r in compliance.phrase_tiers(spark.createDataFrame(rows, "page_id long, text string")).collect()}
    assert got == {0: (1, 0, 0), 4: (0, 0, 1), 5: (0, 0, 1), 6: (0, 0, 1), 8: (0, 3, 0)}
    plan = compliance.phrase_tiers(spark.createDataFrame(rows, "page_id long, text string"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "regexp_extract_all" not in plan


def test_counts_by_tier_equal_regular_expressions(spark):
    rng = random.Random(3)
    parts = ["DEI", "dei office", "dei program", "chief", "diversity", "officer", "office of", "and", "inclusion", "equity", "diversity in", "study of", "research on", "art", ",", ".", "\u00a0", "\u212a", "\n", "İ"]
    rows = [(i, " ".join(rng.choice(parts) for _ in range(rng.randint(0, 30)))) for i in range(400)]
    want = {}
    for page, text in rows:
        taken, n = [], [0, 0, 0]
        for tier, listed in enumerate(compliance.PHRASE_TIERS):
            for p in listed:
                for m in re.finditer(r"[^\s,.;]+".join(re.escape(x) for x in p.split("[field]")), text, re.I | re.A):
                    if not any(m.start() < z and a < m.end() for a, z in taken):
                        taken.append(m.span())
                        n[tier] += 1
        if any(n):
            want[page] = tuple(n)
    assert {r.page_id: (r.tier1, r.tier2, r.tier3) for r in compliance.phrase_tiers(spark.createDataFrame(rows, "page_id long, text string")).collect()} == want
