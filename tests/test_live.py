"""Streams: URLs once, pages scored as their findings arrive, runs that stall; restarts and replays."""

import datetime as dt

from pyspark.sql import functions as F

from quillmark.streaming import live


def _run(spark, writer, tmp_path):
    query = writer.option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    return query


def test_page_scores_of_a_stream(spark, tmp_path):
    kind = "issue_id long, scan_id long, page_id long, category string, rule_id string, subcategory string, criterion_id string, wcag_level string, wcag_version string, is_best_practice boolean, impact string, manual_review boolean, reviewed boolean"
    rows = [(7, 1, 10, "content", "page-title", "x", None, None, None, False, "serious", False, False), (8, 1, 11, "privacy", "hsts", "x", None, None, None, False, "minor", True, False)]
    spark.createDataFrame(rows, kind).write.parquet(str(tmp_path / "in"))
    pages = spark.createDataFrame([(1, 10, "u", "ok", False, False), (1, 11, "v", "ok", False, False), (1, 12, "w", "ok", False, False)], "scan_id long, page_id long, url string, render_status string, is_document boolean, is_error_page boolean")
    out = str(tmp_path / "out")
    stream = spark.readStream.schema(kind).parquet(str(tmp_path / "in"))
    _run(spark, live.live_page_scores(stream, pages, lambda df: df.write.mode("append").parquet(out)), tmp_path)
    got = {r.page_id: r.score for r in spark.read.parquet(out).collect()}
    assert set(got) == {10, 11} and got[11] == 100 and got[10] < 100


def test_urls_once(spark, tmp_path):
    spark.createDataFrame([("http://H/a/",), ("http://h/a",), ("http://h/b#x",)], "url string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("url string").parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    _run(spark, live.live_dedupe_links(stream).writeStream.outputMode("append").format("parquet").option("path", out), tmp_path)
    assert sorted(r.url for r in spark.read.parquet(out).select(F.col("url")).collect()) == ["http://h/a", "http://h/b"]


def _beats(spark, tmp_path, name, rows):
    at = dt.datetime(2024, 1, 1)
    spark.createDataFrame([(k, at + dt.timedelta(minutes=m), s) for k, m, s in rows], "scan_id long, at timestamp, status string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))


def test_stalled_runs_across_restarts(spark, tmp_path):
    kind, out = "scan_id long, at timestamp, status string", str(tmp_path / "out")

    def go():
        stream = spark.readStream.schema(kind).parquet(str(tmp_path / "in"))
        _run(spark, live.live_stalled(stream).writeStream.outputMode("append").format("parquet").option("path", out), tmp_path)
        rows = spark.read.schema("scan_id long, beats long, failed_at timestamp").parquet(out).collect()
        return sorted((r.scan_id, r.beats, int((r.failed_at - dt.datetime(2024, 1, 1)).total_seconds() // 60)) for r in rows)

    # 1 goes silent, 2 ends well, 3 goes on, 4 ends in the same minute as its last sign
    _beats(spark, tmp_path, "a", [(1, 0, "running"), (1, 5, "running"), (2, 0, "running"), (2, 8, "done"), (3, 0, "queued"), (4, 0, "running"), (4, 3, "done"), (4, 3, "running")])
    assert go() == []
    _beats(spark, tmp_path, "b", [(3, 30, "running"), (9, 50, "running")])
    assert go() == [(1, 2, 40)]  # the state outlived the restart
    _beats(spark, tmp_path, "c", [(1, 60, "running"), (3, 60, "running"), (9, 60, "done")])
    assert go() == [(1, 2, 40)]
    _beats(spark, tmp_path, "d", [(3, 90, "done"), (10, 200, "running")])
    assert go() == [(1, 2, 40), (1, 3, 95)]  # armed anew, and silent again
    _beats(spark, tmp_path, "e", [(11, 20_000, "running")])
    assert go() == [(1, 2, 40), (1, 3, 95), (10, 1, 235)] and not {2, 3, 4, 9} & {r[0] for r in go()}


KIND = "issue_id long, scan_id long, page_id long, category string, rule_id string, subcategory string, criterion_id string, wcag_level string, wcag_version string, is_best_practice boolean, impact string, manual_review boolean, reviewed boolean"


def test_scores_of_replayed_and_spread_batches(spark, tmp_path):
    """A page whose findings come in two batches, and a batch that is written twice, give the table of one batch."""
    row = lambda i, page, rule: (i, 1, page, "content", rule, "x", None, None, None, False, "serious", False, False)
    first, second = [row(1, 10, "page-title"), row(2, 11, "page-title")], [row(3, 10, "thin_pages"), row(4, 10, "placeholder_links")]
    pages = spark.createDataFrame([(1, p, f"u{p}", "ok", False, False) for p in (10, 11, 12)], "scan_id long, page_id long, url string, render_status string, is_document boolean, is_error_page boolean")

    def table(name, batches, replay=False):
        folder = tmp_path / name
        for rows in batches:
            spark.createDataFrame(rows, KIND).coalesce(1).write.mode("append").parquet(str(folder / "in"))
            stream = spark.readStream.schema(KIND).parquet(str(folder / "in"))
            _run(spark, live.live_scores_table(stream, pages, str(folder)), folder)
            if replay:  # as after a failure between the write and the commit
                commits = sorted(int(p.name) for p in (folder / "state" / "commits").iterdir() if p.name.isdigit())
                (folder / "state" / "commits" / str(commits[-1])).unlink()
                (folder / "state" / "commits" / f".{commits[-1]}.crc").unlink(missing_ok=True)
                _run(spark, live.live_scores_table(stream, pages, str(folder)), folder)
        return sorted(map(tuple, live.current_scores(spark.read.parquet(str(folder / "scores"))).select("scan_id", "page_id", "score").collect()))

    once = table("once", [first + second])
    assert len(once) == 2 and once[0][2] < once[1][2]
    assert table("spread", [first, second]) == once and table("replayed", [first, second], replay=True) == once
