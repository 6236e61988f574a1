from quillmark.sources import io


def test_tables_and_run_replacement(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "scan_id int, v string")
    io.write_tables({"t": df, "d": df.select("v")}, str(tmp_path))
    io.replace_run(spark.createDataFrame([(2, "c")], "scan_id int, v string"), f"{tmp_path}/t")
    got = io.read_tables(spark, str(tmp_path), ["t", "d"])
    assert {(r.scan_id, r.v) for r in got["t"].collect()} == {(1, "a"), (2, "c")} and got["d"].count() == 2


def test_files(spark, tmp_path):
    for name, body in {"h/7/3/dom.html": "<p>x</p>", "r/5.json": "{}", "s/site/robots.txt": "User-agent: *"}.items():
        p = tmp_path / name
        p.parent.mkdir(parents=True)
        p.write_text(body)
    assert tuple(io.read_html_corpus(spark, f"{tmp_path}/h").first()) == ("7", "3", "<p>x</p>")
    assert tuple(io.read_results(spark, f"{tmp_path}/r").first()) == ("5", "{}")
    assert tuple(io.read_bodies(spark, f"{tmp_path}/s").first()) == ("site", "robots.txt", "User-agent: *")
    (tmp_path / "p.json").write_text('[{"id": "a", "label": "A", "patterns": ["x", " "]}]')
    assert [tuple(r) for r in io.read_policy_rules(spark, f"{tmp_path}/p.json").collect()] == [("a", "A", "x")]
    (tmp_path / "c.csv").write_text("page,score\np,1.5\n")
    assert tuple(io.read_calibration_csv(spark, f"{tmp_path}/c.csv", "page string, score double").first()) == ("p", 1.5)


def test_upsert(spark):
    pages = spark.createDataFrame([(1, 10, "u"), (1, 11, "v")], "scan_id int, page_id int, url string")
    issues = spark.createDataFrame([(1, 10, "a"), (1, 11, "b")], "scan_id int, page_id int, rule_id string")
    p, i = io.upsert_page(pages, issues, spark.createDataFrame([(1, 12, "u")], pages.schema), spark.createDataFrame([(1, 12, "c")], issues.schema))
    assert {r.page_id for r in p.collect()} == {11, 12} and {r.rule_id for r in i.collect()} == {"b", "c"}
