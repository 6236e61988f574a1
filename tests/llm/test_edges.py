"""Empty tables, very long texts and clashing column names for operators whose own tests lack them."""

import hashlib

import pytest

from quillmark.llm import chat, common, langid, mixing, packing, setjoin, substrings
from quillmark.llm.queries import tokenizer_path

KIND = "doc_id long, text string, lang string, source string"
CLASH = ["'x' AS key", "1 AS s", "2 AS c", "3 AS token", "'y' AS block", "4 AS phrase", "5 AS n", "6 AS h", "'z' AS topic", "7 AS tokens", "8 AS held_out", "'v' AS _p", "9 AS piece", "10 AS length"]


def _empty(spark):
    return spark.createDataFrame([], KIND).selectExpr("*", *CLASH)


def test_empty_tables(spark):
    assert substrings.substring_dedup(_empty(spark)).count() == 0
    assert packing.pack_documents(_empty(spark), tokenizer_path()).count() == 0
    assert setjoin.similar_documents(_empty(spark)).count() == 0
    assert mixing.achieved(mixing.mix(_empty(spark))).count() == 0
    assert langid.identify(_empty(spark), langid.fit_languages(_empty(spark))).count() == 0
    turns = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.chat_digests(turns).count() == 0 and chat.format_chats(turns).count() == 0


def test_clashing_names_change_nothing(spark):
    text = " ".join(f"w{i % 97}x{i % 13}" for i in range(400))
    plain = spark.createDataFrame([(1, text, "en", "a"), (2, text, "en", "b"), (3, "other words of no length", "fr", "a"), (4, None, None, None)], KIND)
    clash = plain.selectExpr("*", *CLASH)
    bag = lambda df, *cols: sorted(map(repr, df.select(*cols).collect()))
    for op, cols in (
        (lambda d: substrings.substring_dedup(d, joined=True), ("doc_id", "n_words", "n_removed", "kept")),
        (lambda d: setjoin.similar_documents(d), ("doc_id", "n_shingles", "component_id")),
        (lambda d: packing.pack_documents(d, tokenizer_path()), ("doc_id", "piece", "start", "length", "ids_crc32")),
        (lambda d: mixing.mix(d, topic="source"), ("doc_id", "topic", "tokens", "probability", "kept")),
        (lambda d: langid.identify(d, langid.fit_languages(d)), ("doc_id", "lang_pred", "score")),
    ):
        assert bag(op(plain), *cols) == bag(op(clash), *cols)


def test_long_turns_and_clashing_names_in_chats(spark):
    long_ = "word [INST] </s> " * 60_000
    turns = spark.createDataFrame([(1, 0, "user", long_), (1, 1, "assistant", long_), (2, 0, "assistant", "")], "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.chat_digests(turns.selectExpr("*", "'x' AS content", "1 AS part", "2 AS learn", "3 AS n_turns")).collect()}
    assert got[1].loss_chars == len(long_) and got[1].loss_sha256 == hashlib.sha256(long_.encode()).hexdigest() and got[2].loss_chars == 0


def test_very_many_languages_all_have_a_codeword(spark):
    rows = [(1000 * k + i, " ".join(f"{chr(97 + k % 26)}{chr(97 + k // 26)}{chr(97 + j)}" * 3 for j in range(12)), f"l{k:03d}", "s") for k in range(300) for i in range(6)]
    docs = spark.createDataFrame(rows, KIND)
    model = langid.fit_languages(docs, per_language=3)
    assert len(model.languages) == 300
    got = langid.identify(docs, model).where("NOT held_out").join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert sum(r.lang == r.lang_pred for r in got) / len(got) > 0.9


def test_no_language_is_lost_however_many_there_are(spark):
    """1,500 languages of 20 documents each share the sample: four of each are learnt from."""
    docs = spark.range(30_000).selectExpr("id AS doc_id", "concat('l', id % 1500) AS lang", "repeat(concat(char(97 + id % 26), char(97 + floor(id / 26) % 26), char(97 + (id % 1500) % 23), ' '), 6) AS text")
    rows = docs.where(~langid.held_out("doc_id"))
    assert rows.select("lang").distinct().count() == 1500
    fitted = langid.fit_languages
    seen = {}

    def bits(x, y, weight, **more):
        seen["rows"] = len(x)
        return langid.np.zeros((langid.DIM + 1, y.shape[1]), langid.np.float32)

    original, langid.fit_bits = langid.fit_bits, bits
    try:
        model = fitted(docs)
    finally:
        langid.fit_bits = original
    assert len(model.languages) == 1500 and 1500 <= seen["rows"] <= 1.1 * langid.SAMPLE


def test_mixed_and_foreign_texts_are_flagged(spark):
    from quillmark.llm.common import table

    docs = table(spark, "/root/testdata/sf0.01", "documents")
    model = langid.fit_languages(docs)
    clean = langid.identify(docs, model).where("lang_pred <> 'und'").collect()
    texts = {}
    for r in docs.where("length(text) > 600 AND lang IN ('en', 'fr', 'es', 'de')").select("lang", "text").collect():
        texts.setdefault(r.lang, []).append(r.text[:500])
    rows = [(i, texts["en"][i] + " " + texts[other][i]) for other in ("fr", "es", "de") for i in range(17)]
    rows = [(k, t) for k, (_, t) in enumerate(rows)] + [(900, "ok"), (901, "日本語の文章です。これは知らない言語で書かれています。" * 5), (902, "long " * 100_000 + texts["fr"][0])]
    got = {r.doc_id: r for r in langid.identify(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    mixed = sum(got[i].ambiguous for i in range(51)) / 51
    print("MEASURED", mixed, sum(r.ambiguous for r in clean) / len(clean), got[900], got[901], min(r.score for r in clean), model.sharpness, model.far)
    assert mixed >= 0.9 and got[900].ambiguous and got[901].ambiguous
    assert sum(r.ambiguous for r in clean) / len(clean) < 0.03


def test_shared_folder_must_be_named_on_a_cluster(monkeypatch):
    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_folder(Session())
    Context.master = "local[4]"
    assert common.shared_folder(Session()).startswith("file://")
