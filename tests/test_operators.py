import datetime as dt

import pytest
from pyspark.sql import functions as F

from quillmark.functions import text, urls
from quillmark.operators import crawl, crosspage, elements, extract, quota, runs, structure


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("url", "want"),
    [
        ("HTTPS://EXAMPLE.COM:443/About/?utm_source=x&b=2&a=1#top", "https://example.com/About?a=1&b=2"),
        ("http://e.com", "http://e.com/"),
        ("http://e.com:80/a//", "http://e.com/a"),
        ("http://e.com/?a&b=~*", "http://e.com/?a=&b=~%2A"),
        ("http://e.com/?gclid=1&FBCLID=2", "http://e.com/"),
    ],
)
def test_normalize_url(spark, url, want):
    assert one(spark, urls.normalize_url(F.col("u")), u=url) == want


def test_sitemap_url_keeps_order_and_port(spark):
    got = one(spark, urls.normalize_sitemap_url(F.col("u")), u="HTTPS://EXAMPLE.COM:443/About/?utm_source=x&b=2&a=1#top")
    assert got == "https://example.com:443/About?b=2&a=1"


@pytest.mark.parametrize(
    ("url", "root", "want"),
    [
        ("https://www.h.edu/k12/a", "https://h.edu/k12/", True),
        ("https://h.edu/k12", "https://h.edu/k12/", True),
        ("https://h.edu/k12extra", "https://h.edu/k12", False),
        ("https://other.h.edu/k12", "https://h.edu/k12", False),
        ("https://h.edu/anything", "https://h.edu/", True),
    ],
)
def test_scope(spark, url, root, want):
    assert one(spark, urls.is_in_scope(F.col("u"), F.col("r")), u=url, r=root) is want


def test_url_predicates(spark):
    assert one(spark, urls.document_extension(F.col("u")), u="http://h/a.PDF?x=1") == ".pdf"
    assert one(spark, urls.document_extension(F.col("u")), u="http://h/a.html") is None
    assert one(spark, urls.is_renderable(F.col("u")), u="http://h/a.png") is False
    assert one(spark, urls.matches_ignore(F.col("u"), ["[", "LOGIN"]), u="http://h/login") is True


def test_texts(spark):
    t = "One two. Three!\n\nno stop\n"
    assert one(spark, text.word_count(F.col("t")), t=t) == 5
    assert one(spark, text.sentences(F.col("t")), t=t) == ["One two.", "Three!", "no stop"]
    assert one(spark, text.reading_age(F.col("t")), t="") is None
    assert one(spark, text.repeated_words(F.col("t")), t="the the cat sat Sat") == 2
    assert one(spark, text.excerpt(F.col("t"), F.lit(70), F.lit(1)), t="a" * 200).startswith("...")
    assert one(spark, text.cap_words(F.col("t"), 2), t="a  b c") == "a  b"


def test_diff_counts(spark):
    prints = spark.createDataFrame([(1, x) for x in "abc"] + [(2, x) for x in "bcde"] + [(2, "b")], "scan_id long, fp string")
    pairs = spark.createDataFrame([(2, 1), (1, None)], "scan_id long, previous_id long")
    r = runs.diff_counts(pairs, prints).first()
    assert (r.new, r.resolved, r.unchanged) == (2, 1, 2)


def test_stalled_and_durations(spark):
    now = dt.datetime(2024, 1, 1, 12)
    rows = [(1, "running", now - dt.timedelta(hours=2), None, None), (2, "running", now - dt.timedelta(hours=2), None, now - dt.timedelta(minutes=5)), (3, "done", now - dt.timedelta(days=2), None, None)]
    df = spark.createDataFrame(rows, "scan_id long, status string, created_at timestamp, started_at timestamp, last_progress_at timestamp")
    assert [r.scan_id for r in runs.stalled_runs(df, F.lit(now)).collect()] == [1]
    jobs = spark.createDataFrame([(now, now + dt.timedelta(seconds=30), None)], "queued timestamp, started timestamp, finished timestamp")
    assert [(r.step, r.n, r.mean) for r in runs.state_durations(jobs, ["queued", "started", "finished"]).collect()] == [("queued->started", 1, 30.0)]


def test_quota():
    assert [a for a, _ in quota.accept(iter([0, 10, 20, 65, 71]), 2, 60)] == [True, True, False, True, True]


def test_quota_batch_and_stream_agree(spark, tmp_path):
    from quillmark.streaming.live import live_quota

    t0 = dt.datetime(2024, 1, 1)
    rows = [(k, t0 + dt.timedelta(seconds=s), i) for i, (k, s) in enumerate([("a", 0), ("a", 10), ("b", 15), ("a", 20), ("a", 65), ("a", 71)])]
    df = spark.createDataFrame(rows, "key string, at timestamp, event_id long")
    batch = {(r.event_id, r.accepted) for r in quota.sliding_quota(df, 2, 60).collect()}
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    q = live_quota(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), 2, 60).writeStream.format("memory").queryName("live_q").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert {(r.event_id, r.accepted) for r in spark.sql("SELECT * FROM live_q").collect()} == batch


def test_stream_dedupe_and_progress(spark, tmp_path):
    from quillmark.streaming.live import live_dedupe_links, live_progress

    t0 = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([("http://H.com/a/", t0), ("http://h.com/a", t0), ("http://h.com/b", t0)], "url string, at timestamp")
    df.write.parquet(str(tmp_path / "l"))
    q = live_dedupe_links(spark.readStream.schema(df.schema).parquet(str(tmp_path / "l"))).writeStream.format("memory").queryName("live_l").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r.url for r in spark.sql("SELECT url FROM live_l").collect()) == ["http://h.com/a", "http://h.com/b"]
    ev = spark.createDataFrame([(1, "error"), (1, "view"), (2, "view")], "scan_id long, kind string")
    ev.write.parquet(str(tmp_path / "e"))
    q = live_progress(spark.readStream.schema(ev.schema).parquet(str(tmp_path / "e"))).writeStream.format("memory").queryName("live_p").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert {tuple(r) for r in spark.sql("SELECT scan_id, errored, crawled FROM live_p").collect()} == {(1, 1, 1), (2, 0, 1)}


def test_links(spark):
    links = spark.createDataFrame([(1, 0, "http://x/a", "first"), (1, 1, "http://x/a", "again"), (1, 2, "http://x/b", "b"), (2, 0, "mailto:q", "m")], "page_id long, pos int, url string, text string")
    status = spark.createDataFrame([("http://x/a", 403), ("http://x/b", 401)], "url string, status_code int")
    got = crosspage.broken_links(links, status).collect()
    assert [(r.page_id, r.text, r.occurrences, r.reason) for r in got] == [(1, "first", 2, "HTTP 403")]
    assert crosspage.distinct_links(links).count() == 2


def test_crawl(spark):
    links = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("a", "c"), ("d", "a")], "src string, dst string")
    got = crawl.crawl_depth(links, spark.createDataFrame([("a",)], "url string"), 2)
    assert {tuple(r) for r in got.collect()} == {("a", 0), ("b", 1), ("c", 1), ("d", 2)}
    now = F.lit(dt.datetime(2024, 2, 1))
    sites = spark.createDataFrame([(1, False, None, 7), (2, False, dt.datetime(2024, 1, 30), 7), (3, True, dt.datetime(2024, 1, 30), 7), (4, False, dt.datetime(2024, 1, 1), 0)], "site_id long, force_rescan boolean, last_scanned_at timestamp, recrawl_interval_days int")
    active = spark.createDataFrame([(4,)], "site_id long")
    assert {r.site_id for r in crawl.sites_due(sites, active, now).collect()} == {1, 3}
    bodies = spark.createDataFrame([("s", "i", "<sitemapindex><sitemap><loc>m</loc></sitemap></sitemapindex>"), ("s", "m", "<urlset><url><loc>u</loc></url></urlset>"), ("s", "bad", "<x")], "site string, url string, body string")
    assert [r.url for r in crawl.sitemap_urls(bodies, spark.createDataFrame([("s", "i")], "site string, url string")).collect()] == ["u"]
    assert {r.kind for r in crawl.sitemap_rows(bodies).collect()} == {"sitemap", "url", "malformed"}


def test_sitemaps_of_a_large_site_are_read_whole(spark, tmp_path):
    from quillmark.plans import queries

    spark.range(15_010).selectExpr("id AS page_id", "concat('https://www.h.example/', id) AS url").write.parquet(str(tmp_path / "pages.parquet"))
    assert queries.QUERIES["sitemap_urls"](spark, str(tmp_path)).count() == 5003


FIRES = "<html><head><title>Home</title></head><body><h2>a</h2><h4>b</h4><h1>x</h1><h1>y</h1><img src=i.png><a href='#'>p</a><a href='/q'>here</a><a href='/r'></a><a href='/s' target=_blank>s</a><a href='#no'>n</a><form><input></form>call (212) 555-0199</body></html>"
CLEARS = (
    "<html lang=en><head><title>A fitting title</title><meta name=description content='" + "d" * 70 + "'><script type='application/ld+json'>{}</script></head><body><nav><input type=search></nav>"
    "<h1>a</h1><h2>b</h2><img src=i.png alt=ok><a href='/privacy'>Privacy</a><a id=top href='#top'>to the top</a>" + "word " * 300 + "</body></html>"
)


def test_findings_fire_and_clear(spark):
    pages = spark.createDataFrame([(1, "http://h/a_b.html", FIRES), (2, "http://h/c", CLEARS), (3, None, None)], "page_id long, url string, html string")
    got = structure.page_findings(elements.parse_elements(pages), pages).collect()
    fired = {r.rule_id for r in got if r.page_id == 1}
    assert fired >= {
        "page-title", "meta_description_too_short", "heading-order-content", "multiple_h1", "thin_pages", "structured_data_missing", "url_file_extension", "url_underscores", "html-has-lang", "multiple_ways",
        "privacy-policy-link", "forms_inventory", "image-alt-content", "placeholder_links", "link_purpose_unclear", "link_no_text", "new_tab_disclosure", "broken_anchor_links", "phone_numbers_exposed",
    }
    assert {r.rule_id for r in got if r.page_id == 2} == {"headings_review", "consistent_navigation"}  # both only ask for a look
    assert {r.rule_id for r in got if r.page_id == 3} >= {"html-has-lang", "structured_data_missing"}
