"""Percentiles from merged sketches against exact ones, and where misspelt words stand."""

import datetime as dt
import random

import numpy as np

from quillmark.operators import runs, spelling


def test_percentiles_of_merged_sketches_stay_within_the_error(spark):
    rng = random.Random(1)
    start = dt.datetime(2024, 1, 1)
    rows = [(i % 30, start, start + dt.timedelta(seconds=int(rng.lognormvariate(5, 1.3))), None) for i in range(30_000)]
    jobs = spark.createDataFrame(rows, "day int, queued timestamp, begun timestamp, ended timestamp")
    sketches = runs.duration_sketches(jobs, ["queued", "begun", "ended"], ["day"])
    days = runs.duration_percentiles(sketches).collect()
    assert len(days) == 30 and {r.step for r in days} == {"queued->begun"} and {r.n for r in days} == {1000}
    month = runs.duration_percentiles(runs.merged_sketches(sketches, [])).collect()
    exact = np.sort([(r[2] - r[1]).total_seconds() for r in rows])
    assert len(month) == 1 and month[0].n == len(exact)
    for share in (0.5, 0.9, 0.99):
        at = np.searchsorted(exact, month[0][f"p{round(share * 100)}"]) / len(exact)
        assert abs(at - share) < 0.015
    assert runs.duration_percentiles(runs.duration_sketches(jobs.limit(0), ["queued", "begun"], ["day"])).count() == 0


def test_occurrences_of_flagged_words(spark):
    text = "Teh cat saw teh dog; tehran, teh-teh. " + "TEH " * 9
    pages = spark.createDataFrame([(1, text), (2, None), (3, "fine")], "page_id long, text string")
    flagged = spark.createDataFrame([(1, 1, "teh", "correction", "the", None), (1, 2, "gone", "potential", None, None), (2, 1, "lost", "language", None, "fr"), (4, 1, "page", "potential", None, None)], "page_id long, rank int, word string, kind string, suggestion string, lang string")
    got = spelling.spelling_occurrences(pages, flagged, places=5, around=4).orderBy("page_id", "rank", "place").collect()
    teh = [r for r in got if r.word == "teh"]
    assert [(r.place, r.at, r.matched) for r in teh] == [(1, 0, "Teh"), (2, 12, "teh"), (3, 29, "teh"), (4, 33, "teh"), (5, 38, "TEH")]
    assert all(text[r.at : r.at + 3] == r.matched and r.matched in r.context for r in teh)
    assert [(r.page_id, r.word, r.place, r.matched, r.context) for r in got if r.place is None] == [(1, "gone", None, "gone", ""), (2, "lost", None, "lost", ""), (4, "page", None, "page", "")]
    rows = spelling.spelling_rows(spelling.spelling_occurrences(pages, flagged)).collect()
    assert len(rows) == 8 and '"suggestion":"the"' in rows[0].payload and {r.rule_id for r in rows} == {"spelling"}
