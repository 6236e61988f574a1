from pyspark.sql import functions as F

from quillmark.operators import spelling as S


def test_tokens(spark):
    df = spark.createDataFrame([(1, " see https://site.com/page and Word word x2word word. ")], "page_id long, text string")
    got = {r.word: (r.token, r.occurrences) for r in S.spelling_tokens(df).collect()}
    assert "https" not in got and "page" not in got and got["word"] == ("Word", 2)
    assert S.spelling_tokens(spark.createDataFrame([(1, "edge")], "page_id long, text string")).count() == 0
    assert S.spelling_tokens(spark.createDataFrame([(1, "edge")], "page_id long, text string"), keep_edges=True).count() == 1


def test_tokens_are_counted_where_they_are_read(spark):
    rows = [(i, f" Word word {'ab' * (i % 3 + 2)} -x WORD don't {i} " + "long " * (i % 5)) for i in range(300)] + [(900, None), (901, "")]
    df = S.spelling_tokens(spark.createDataFrame(rows, "page_id int, text string"))
    assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString() and dict(df.dtypes)["page_id"] == "int"
    got = {(r.page_id, r.word): (r.pos, r.token, r.occurrences) for r in df.collect()}
    assert got[4, "word"] == (0, "Word", 3) and got[4, "ababab"] == (2, "ababab", 1) and got[4, "don't"] == (4, "don't", 1) and got[4, "long"] == (5, "long", 4) and not any(p >= 900 for p, _ in got)


def test_findings_are_the_same_without_common_words(spark, monkeypatch):
    verdicts = spark.createDataFrame([("word", "known", None), ("wrd", "correction", "word"), ("other", "known", None), ("zzzz", "potential", None)], "word string, kind string, suggestion string")
    tokens = spark.createDataFrame([(p, w, i, w, 1) for p in range(9) for i, w in enumerate(["word", "wrd", "other", "zzzz"])], "page_id long, word string, pos int, token string, occurrences long")
    frequencies = spark.createDataFrame([("word", 9), ("wrd", 8), ("other", 7)], "word string, frequency long")
    want = sorted(map(tuple, S.spelling_findings(tokens, verdicts).collect()), key=str)
    assert len(want) == 18
    for most in (1, 2, 50):
        monkeypatch.setattr(S, "MOST_COMMON", most)
        assert sorted(map(tuple, S.spelling_findings(tokens, verdicts, frequencies=frequencies).collect()), key=str) == want


def test_cascade(spark):
    words = spark.createDataFrame([("house", "house"), ("houses", "houses"), ("hous", "hous"), ("nato", "NATO"), ("zzzzz", "zzzzz"), ("acme", "acme")], "word string, token string")
    dictionary = spark.createDataFrame([("house", 9), ("mouse", 3)], "word string, frequency long")
    got = {r.word: (r.kind, r.suggestion) for r in S.classify_words(words, dictionary, spark.createDataFrame([("acme",)], "word string")).collect()}
    assert got["house"][0] == "known" and got["houses"][0] == "inflection" and got["nato"][0] == "capitals" and got["acme"][0] == "custom"
    assert got["hous"] == ("correction", "house") and got["zzzzz"] == ("potential", None)
    tokens = spark.createDataFrame([(1, "hous", 5, "hous", 1), (1, "zzzzz", 2, "zzzzz", 3)], "page_id long, word string, pos int, token string, occurrences long")
    out = S.spelling_findings(tokens, S.classify_words(words, dictionary), 1).collect()
    assert [(r.word, r.kind) for r in out] == [("zzzzz", "potential")]


def test_every_step_of_the_cascade(spark):
    cases = {
        "it's": "short", "gov't": "clipped", "well-known": "compound", "attach-ments": "hyphenated", "wellx-known": "potential", "biomes": "inflection", "cities": "inflection", "running": "inflection", "maison": "language",
        "connected": "potential", "Housf": "potential", "Culberson": "name", "Houzeholds": "correction", "NATOO": "capitals", "known": "known",
    }
    tokens = {"connected": "connecteD", "it's": "'it-"}
    words = spark.createDataFrame([(tokens.get(w, w).lower() if w == "it's" else w.lower(), tokens.get(w, w)) for w in cases], "word string, token string")
    dictionary = spark.createDataFrame([(w, i) for i, w in enumerate("well known attachments biome city run house households".split())], "word string, frequency long")
    languages = spark.createDataFrame([("maison", "fr")], "word string, lang string")
    got = {r.word: r for r in S.classify_words(words, dictionary, languages=languages).collect()}
    assert {w: got[tokens.get(w, w).lower() if w == "it's" else w.lower()].kind for w in cases} == cases
    assert got["houzeholds"].suggestion == "households" and got["maison"].lang == "fr" and got["housf"].suggestion is None


def test_language(spark):
    stop = spark.createDataFrame([("en", "the"), ("en", "and"), ("fr", "le"), ("fr", "la")], "lang string, word string")
    got = {r.id: r.lang for r in S.detect_language(spark.createDataFrame([(1, "the cat and la"), (2, "le la the"), (3, None)], "id long, text string"), stop).collect()}
    assert got == {1: "en", 2: "fr", 3: "en-US"}
    assert S.corpus_dictionary(spark.createDataFrame([(1, "abcd abcd efgh"), (2, "abcd")], "doc_id long, text string"), 2).select("word").first()[0] == "abcd"
    assert F.lit(1) is not None
