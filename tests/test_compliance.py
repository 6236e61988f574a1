import datetime as dt

from pyspark.sql import functions as F

from quillmark.operators import compliance as C
from quillmark.operators.extract import extract_signals


def test_findings_fire_and_clear(spark):
    pages = [
        (1, "http://h/students/x", "<p>Jane Roe, GPA 3.9, degree, R12345678, seen in Fall 2019</p><a href='a.pdf'>p</a>"),
        (2, "http://h/c", "<p>in Fall 2023 accommodation</p><a href='/accessibility'>a</a><a href='/x'>Emergency</a>"),
        (3, "http://h/archive/2010", "Fall 2010 <a href='/ada'>x</a> call 911"),
        (4, None, None),
    ]
    rows = C.compliance_findings(extract_signals(spark.createDataFrame(pages, "page_id long, url string, html string")), 2024).collect()
    got = {k: {r.rule_id for r in rows if r.page_id == k} for k in (1, 2, 3)}
    assert got[1] == {"accessibility_statement_present", "alternative_format_process", "emergency_info_linked", "emergency_contact_present", "ferpa_student_id_exposure", "ferpa_grade_exposure", "ferpa_directory_information", "outdated_year_reference"}
    assert got[2] == set()
    assert got[3] == {"emergency_info_linked"}


def test_phrase_tiers_do_not_overlap(spark):
    df = spark.createDataFrame([(1, "The DEI office and DEI, and diversity in physics."), (2, "plain"), (3, "research on diversity"), (4, None)], "page_id long, text string")
    got = {r.page_id: (r.tier1, r.tier2, r.tier3, r.action) for r in C.phrase_tiers(df).collect()}
    assert got == {1: (1, 1, 1, "Legal review required"), 3: (0, 0, 1, "Monitor")}


def test_staleness(spark):
    now = dt.datetime(2024, 6, 1)
    rows = [(1, "http://h/a", now - dt.timedelta(days=400)), (2, "http://h/a", now - dt.timedelta(days=365)), (3, "http://h/privacy", now - dt.timedelta(days=900)), (4, "http://h/a", None)]
    got = C.stale_content(spark.createDataFrame(rows, "page_id long, url string, last_changed_at timestamp"), F.lit(now)).collect()
    assert [(r.page_id, r.days) for r in got] == [(1, 400)]
