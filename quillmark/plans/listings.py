"""The registered queries on findings, texts, scores and listings. Each has its SQL, but for the readability formulas' twin."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.functions import dims, text, urls
from quillmark.operators import crosspage, findings, listings, reports, runs
from quillmark.plans import queries as Q
from quillmark.plans.queries import _add, _of, _with

_values = dims.values_sql
_PAGE = "(SELECT scan_id, page_id, url FROM v_pages)"


def _payload(t, sql: str, flags: bool = False) -> DataFrame:
    more = ["issue_id % 13 = 0 AS is_approved", "issue_id % 17 = 0 AS is_ignored"] if flags else []
    return t.issues.selectExpr("*", f"{sql} AS payload", *more)


def _p(sql: str, flags: bool = False) -> str:
    more = ", issue_id % 13 = 0 AS is_approved, issue_id % 17 = 0 AS is_ignored" if flags else ""
    return f"p AS (SELECT *, {sql} AS payload{more} FROM v_issues)"


# Findings
_SCOPE = _values([(r, to, c) for to, (c, s) in findings.SCOPE.items() for r in (to, *s.split())], "rule_id, scoped_rule, scoped_criterion")
_add(
    "scope_accessibility", _of(lambda t: findings.scope_accessibility(t.issues).groupBy("scan_id", "category", "rule_id", "criterion_id").agg(F.count("*").alias("n"))),
    _with(views=("issues",)) + f"""SELECT scan_id, category, CASE WHEN category = 'accessibility' THEN scoped_rule ELSE rule_id END AS rule_id, CASE WHEN category = 'accessibility' THEN scoped_criterion ELSE criterion_id END AS criterion_id, count(*) AS n
      FROM v_issues LEFT JOIN ({_SCOPE}) USING (rule_id) WHERE category <> 'accessibility' OR scoped_rule IS NOT NULL GROUP BY ALL""",
)
_CRITERIA = _values([(c, *k.split(" ")) for k, ids in findings.CRITERIA.items() for c in ids.split()], "criterion_id, v, l")
_add(
    "override_levels", _of(lambda t: findings.override_levels(t.issues.withColumn("wcag_level", F.lit("A"))).groupBy("criterion_id", "wcag_level", "wcag_version").agg(F.count("*").alias("n"))),
    _with(views=("issues",)) + f"SELECT criterion_id, coalesce(l, 'A') AS wcag_level, coalesce(v, wcag_version) AS wcag_version, count(*) AS n FROM v_issues LEFT JOIN ({_CRITERIA}) USING (criterion_id) GROUP BY ALL",
)
_add("page_finding_counts", _of(lambda t: findings.page_finding_counts(t.issues)), _with(views=("issues",)) + "SELECT scan_id, page_id, count(*) FILTER (NOT manual_review) AS issue_count, count(*) FILTER (manual_review) AS manual_review_count FROM v_issues GROUP BY ALL")
_NAMES = [(r[0], r[0].upper()) for r in dims.RULES[::3]]
_add(
    "attach_display", _of(lambda t: findings.attach_display(t.issues, t.spark.createDataFrame(_NAMES, "rule_id string, display string")).select("issue_id", "display")),
    _with(views=("issues",)) + f"SELECT issue_id, coalesce(display, array_to_string(list_transform(string_split(translate(rule_id, '_-', '  '), ' '), lambda x: upper(x[1]) || lower(x[2:])), ' ')) AS display FROM v_issues LEFT JOIN ({_values(_NAMES, 'rule_id, display')}) USING (rule_id)",
)
_TEXTS = [("1.4.3", "Contrast (Minimum)", "Raise the contrast."), ("1.1.1", "Non-text Content", None)]
_add(
    "remediation", _of(lambda t: findings.remediation(t.issues, t.spark.createDataFrame(_TEXTS, "criterion_id string, name string, text string")).groupBy("rule_id", "remediation").agg(F.count("*").alias("n"))),
    _with(views=("issues",)) + "SELECT rule_id, CASE criterion_id WHEN '1.4.3' THEN 'Raise the contrast.' WHEN '1.1.1' THEN 'Mend what was flagged for 1.1.1 Non-text Content.' ELSE 'Review the flagged elements.' END AS remediation, count(*) AS n FROM v_issues GROUP BY ALL",
)
_add(
    "union_findings", _of(lambda t: findings.union_findings(findings.to_finding(t.issues.withColumn("snippet", F.repeat("snippet", 300))), findings.to_finding(t.pages.where("title LIKE '%7'").select("page_id"), rule_id="page-title", category="content")).groupBy("rule_id", "category", "impact", "manual_review").agg(F.count("*").alias("n"), F.max(F.length("snippet")).alias("longest"), F.sum("weight").alias("weight"))),
    _with() + "SELECT rule_id, category, impact, manual_review, count(*) AS n, max(longest) AS longest, CAST(count(*) AS DOUBLE) AS weight FROM (SELECT rule_id, category, impact, manual_review, least(2000, length(snippet) * 300) AS longest FROM v_issues UNION ALL SELECT 'page-title', 'content', 'moderate', false, NULL FROM v_pages WHERE title LIKE '%7') GROUP BY ALL",
)
_add(
    "attach_capture", _of(lambda t: findings.attach_capture(t.issues.selectExpr("issue_id", "page_id", "CASE WHEN issue_id % 2 = 0 THEN 'desktop' ELSE 'mobile' END AS viewport", "CASE WHEN issue_id % 3 = 0 THEN 1 END AS capture_width", "CAST(NULL AS INT) AS capture_height"), t.pages.selectExpr("page_id", "'desktop' AS viewport", "1280 AS width", "CAST(page_id % 900 AS INT) AS height"))),
    _with() + "SELECT issue_id, page_id, viewport, CASE WHEN issue_id % 3 = 0 THEN 1 WHEN viewport = 'desktop' THEN 1280 END AS capture_width, CASE WHEN viewport = 'desktop' THEN CAST(page_id % 900 AS INT) END AS capture_height FROM (SELECT issue_id, page_id, CASE WHEN issue_id % 2 = 0 THEN 'desktop' ELSE 'mobile' END AS viewport FROM v_issues)",
)
_GROUPS = _values([(g, c) for g, ids in findings.GROUPS.items() for c in ids.split()], '"group", criterion_id')
_add(
    "affected_groups", _of(lambda t: findings.affected_groups(t.checks)),
    _with(*Q._TO_CHECKS) + f"""SELECT scan_id, "group", coalesce(n, 0) AS failing FROM (SELECT DISTINCT scan_id FROM v_checks) CROSS JOIN (SELECT DISTINCT "group" FROM ({_GROUPS}))
      LEFT JOIN (SELECT scan_id, "group", count(*) AS n FROM v_checks JOIN ({_GROUPS}) USING (criterion_id) WHERE category = 'accessibility' AND check_score < 100 GROUP BY ALL) USING (scan_id, "group")""",
)

# Texts
_COUNT = r"""t AS (SELECT doc_id, text, len(regexp_extract_all(text, '[A-Za-z]+')) AS w, len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) AS words, greatest(len(regexp_extract_all(lower(text), '[aeiouy]+')), len(regexp_extract_all(text, '[A-Za-z]+'))) AS syl,
  len(list_filter(string_split(array_to_string(list_transform(list_filter(string_split(text, chr(10)), lambda x: trim(x, ' ') <> ''), lambda x: regexp_replace(trim(x, ' '), '([.!?])[ \t\n\v\f\r]+', '\1' || chr(1), 'g')), chr(1)), chr(1)), lambda x: trim(x, ' ') <> '')) AS s
  FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)),
g AS (SELECT *, 0.39::DOUBLE * w / greatest(s, 1) + 11.8::DOUBLE * syl / w - 15.59::DOUBLE AS grade, 206.835::DOUBLE - 1.015::DOUBLE * w / greatest(s, 1) - 84.6::DOUBLE * syl / w AS ease FROM t WHERE w > 0)"""
_add(
    "text_findings", _of(lambda t: findings.text_findings(t.raw("documents").select(F.col("doc_id").alias("page_id"), "text"))),
    f"WITH {_COUNT} SELECT doc_id AS page_id, 'readability' AS rule_id, CASE WHEN ease < 30 THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END AS weight FROM g WHERE words >= 120 AND ease < 50 UNION ALL SELECT doc_id, 'reading_level_aaa', 1.0::DOUBLE FROM g WHERE words >= 120 AND grade > 9",
)
Q.ORACLE_SQL["readability"] = f"""WITH {_COUNT} SELECT doc_id, CAST(s AS INT) AS sentences, CASE WHEN w > 0 THEN CAST(round(CAST(least(greatest(grade, 0), 20) AS DECIMAL(28,9)) + 5, 1) AS DOUBLE) END AS reading_age, CASE WHEN words >= 120 AND ease < 30 THEN 1.0::DOUBLE WHEN words >= 120 AND ease < 50 THEN 0.5::DOUBLE END AS weight FROM t LEFT JOIN g USING (doc_id, text, w, words, syl, s)"""
_add(
    "grammar_sources", _of(lambda t: findings.grammar_sources(t.raw("documents").select(F.col("doc_id").alias("page_id"), F.col("text").alias("visible"), F.col("source").alias("title"), F.lit(" ").alias("alt_text"), F.col("lang").alias("navigation"))).select("page_id", "source", F.sha2("text", 256).alias("sha"))),
    "SELECT page_id, source, sha256(x) AS sha FROM (SELECT doc_id AS page_id, unnest(['visible', 'title', 'navigation']) AS source, unnest([text, source, lang]) AS x FROM documents) WHERE trim(x) <> ''",
)
_MATCH = "CASE l_partkey % 9 WHEN 0 THEN 'EN_A_VS_AN' WHEN 1 THEN 'WHITESPACE_RULE' WHEN 2 THEN 'MORFOLOGIK_RULE_EN_US' WHEN 3 THEN 'X_WORD_REPEAT_X' WHEN 4 THEN 'SUBJECT_VERB_AGREEMENT' WHEN 5 THEN 'OTHER' WHEN 6 THEN 'NONE' WHEN 7 THEN 'DOUBLE_PUNCTUATION' END"
_MESSAGE = "CASE WHEN l_partkey % 9 = 5 THEN concat(' Message ', l_suppkey % 5, '. ') END"
_add(
    "grammar_labels", _of(lambda t: findings.grammar_labels(t.raw("lineitem").selectExpr(f"{_MATCH} AS rule_id", f"{_MESSAGE} AS message")).groupBy("rule_id", "label", "severity").agg(F.count("*").alias("n"))),
    f"""SELECT rule_id, CASE rule_id WHEN 'EN_A_VS_AN' THEN 'Use of ''a'' vs. ''an''' WHEN 'DOUBLE_PUNCTUATION' THEN 'Repeated punctuation' WHEN 'X_WORD_REPEAT_X' THEN 'Word repetition (e.g. ''will will'')' WHEN 'SUBJECT_VERB_AGREEMENT' THEN 'Possible agreement error' WHEN 'OTHER' THEN rtrim(trim(message), '.') ELSE 'Grammar issue' END AS label,
      CASE WHEN rule_id IN ('DOUBLE_PUNCTUATION', 'X_WORD_REPEAT_X') THEN 'error' ELSE 'warning' END AS severity, count(*) AS n FROM (SELECT {_MATCH} AS rule_id, {_MESSAGE} AS message FROM lineitem) WHERE rule_id IS NULL OR rule_id NOT IN ('WHITESPACE_RULE', 'MORFOLOGIK_RULE_EN_US') GROUP BY ALL""",
)
_PHRASES = ["the", "this work", "er"]
_add(
    "locate_phrases", _of(lambda t: findings.locate_phrases(t.raw("documents").select(F.col("doc_id").alias("page_id"), "text"), _PHRASES).where("number = 1").select("page_id", "phrase", "total", F.lower(F.substring("context", F.least(F.col("at"), F.lit(60)) + 1, F.length("phrase"))).alias("found"))),
    # separators are doubled, so that two neighbours each have one; letters of any script are letters
    rf"""WITH d AS (SELECT doc_id, ' ' || regexp_replace(lower(text), '([^\p{{L}}\p{{N}}_])', '\1\1', 'g') || ' ' AS t FROM documents)
    SELECT page_id, phrase, CAST(n AS INTEGER) AS total, phrase AS found FROM ("""
    + " UNION ALL ".join(rf"SELECT doc_id AS page_id, '{p}' AS phrase, len(regexp_extract_all(t, '[^\p{{L}}\p{{N}}_]{p.replace(' ', '  ')}[^\p{{L}}\p{{N}}_]')) AS n FROM d" for p in _PHRASES)
    + ") WHERE n > 0",
)
_add(
    "terms_present", _of(lambda t: findings.terms_present(t.raw("documents").select(F.col("doc_id").alias("page_id"), "text"), ["The", "license", " the ", "", "x" * 90, "rights"])),
    " UNION ALL ".join(rf"SELECT doc_id AS page_id, '{p}' AS term FROM documents WHERE regexp_matches(text, '(?i)\b{p}\b')" for p in ("The", "license", "rights")),
)
_add(
    "effective_policy_rules", _of(lambda t: findings.effective_policy_rules(t.sites, t.sites.where("site_id % 3 = 0").selectExpr("site_id", "CASE WHEN site_id % 2 = 0 THEN 'own' ELSE ' ' END AS rule", "concat(' p', site_id) AS pattern"), t.spark.createDataFrame([("a", "x"), ("b", "y")], "rule string, pattern string"))),
    _with(views=("sites",)) + "SELECT site_id, 'own' AS rule, concat('p', site_id) AS pattern FROM v_sites WHERE site_id % 6 = 0 UNION ALL SELECT site_id, unnest(['a', 'b']), unnest(['x', 'y']) FROM v_sites WHERE site_id % 6 <> 0",
)

# Scores
_LABELS = {"accessibility": "Accessibility", "content": "Content", "policies": "Policies"}
_UNREVIEWED = Q._JOINED.replace("NOT manual_review", "NOT manual_review AND NOT reviewed")
_add(
    "page_category_scores", _of(lambda t: findings.page_category_scores(t.pages, t.issues, _LABELS, dims.ACTIVE_CATEGORIES)),
    _with(Q._AUDIT, _UNREVIEWED, Q._PCHECKS, Q._PSCORES) + "SELECT scan_id, page_id, unnest(['Accessibility', 'Content', 'Policies']) AS label, unnest([cat_accessibility, cat_content, NULL]) AS score FROM v_pscores",
)
_MORE = Q._JOINED.replace("FROM v_issues i", "FROM (SELECT * FROM v_issues UNION ALL SELECT * FROM v_issues WHERE rule_id = 'page-title') i")
_add("rescore_after", _of(lambda t: findings.rescore_run(t.pages, t.issues, t.issues.where("rule_id = 'page-title'"))[2]), _with(Q._AUDIT, _MORE, Q._PCHECKS, Q._PSCORES) + "SELECT * FROM v_pscores")
_add("rescore_run", _of(lambda t: findings.rescore_run(t.pages, t.issues)[1]), _with(*Q._TO_CHECKS, Q._SCORES) + "SELECT * FROM v_scores")
_KNOBS = [(k, w, m) for k, (w, m) in dims.KNOBS.items()]


def _predicted(t) -> DataFrame:
    counts = t.issues.groupBy(F.col("scan_id").alias("page"), F.col("rule_id").alias("check_id")).agg(F.count("*").cast("double").alias("count"))
    return findings.predicted_scores(counts, t.spark.createDataFrame(_KNOBS, "check_id string, worst double, most double"))


_PREDICTED = f"""pr AS (SELECT page, greatest(0.0::DOUBLE, 100.0::DOUBLE - sum(lost)) AS predicted FROM (SELECT scan_id AS page, rule_id, coalesce(CAST(most AS DOUBLE) * least(count(*) / greatest(CAST(worst AS DOUBLE), 1e-6), 1), 0) AS lost FROM v_issues LEFT JOIN ({_values(_KNOBS, 'rule_id, worst, most')}) USING (rule_id) GROUP BY scan_id, rule_id, worst, most) GROUP BY page)"""
_R = lambda c: F.round(F.col(c).cast("decimal(28,9)"), 4).cast("double")
_add("predicted_scores", _of(lambda t: _predicted(t).select("page", _R("predicted").alias("predicted"))), _with(_PREDICTED, views=("issues",)) + "SELECT page, CAST(round(CAST(predicted AS DECIMAL(28,9)), 4) AS DOUBLE) AS predicted FROM pr")
_add(
    "squared_error", _of(lambda t: findings.squared_error(_predicted(t), t.scores.select(F.col("scan_id").alias("page"), F.col("overall").cast("double").alias("score"))).select("pages", F.round(F.col("sse").cast("decimal(28,6)"), 3).cast("double").alias("sse"))),
    _with(*Q._TO_CHECKS, Q._SCORES, _PREDICTED) + "SELECT count(*) AS pages, CAST(round(CAST(sum((coalesce(predicted, 100) - overall) * (coalesce(predicted, 100) - overall)) AS DECIMAL(28,6)), 3) AS DOUBLE) AS sse FROM v_scores LEFT JOIN pr ON page = scan_id",
)

# Listings
_add("check_issue_page", _of(lambda t: listings.check_issue_page(t.issues, t.pages)), _with() + f"SELECT scan_id, page_id, rule_id, issue_id, impact, rank, url FROM (SELECT *, row_number() OVER (PARTITION BY scan_id, rule_id ORDER BY issue_id) AS rank FROM v_issues) JOIN {_PAGE} USING (scan_id, page_id) WHERE rank <= 100")
_add("lookup_issues", _of(lambda t: listings.lookup_issues(t.issues.where("issue_id % 5 = 0"), t.issues, t.pages, 3)), _with() + f"SELECT issue_id, scan_id, page_id, url FROM v_issues JOIN {_PAGE} USING (scan_id, page_id) WHERE site_id = 3 AND issue_id % 5 = 0")
_GRAMMAR = """CASE WHEN issue_id % 29 = 0 THEN 'no json' ELSE concat('{"rule_id":"R', issue_id % 7, '","error_text":"t', issue_id % 11, '","group":"G', issue_id % 7 % 3, '","severity":"', CASE issue_id % 7 % 3 WHEN 0 THEN 'error' WHEN 1 THEN 'warning' ELSE 'info' END, '","lang_code":"', CASE WHEN issue_id % 5 = 0 THEN 'fr' ELSE 'en' END, '"}') END"""
_J = "CASE WHEN json_valid(payload) THEN json_extract_string(payload, '$.{0}') END".format
_add(
    "grammar_groups", _of(lambda t: listings.grammar_groups(_payload(t, _GRAMMAR, True))),
    _with(_p(_GRAMMAR, True), views=("issues",)) + """SELECT scan_id, rule_id, error_text, count(*) AS quantity, min(g) AS "group", min(s) AS severity, CASE min(s) WHEN 'error' THEN 0 WHEN 'warning' THEN 1 ELSE 2 END AS severity_rank FROM (
      SELECT scan_id, concat('R', issue_id % 7) AS rule_id, concat('t', issue_id % 11) AS error_text, concat('G', issue_id % 7 % 3) AS g, CASE issue_id % 7 % 3 WHEN 0 THEN 'error' WHEN 1 THEN 'warning' ELSE 'info' END AS s FROM p WHERE NOT is_approved AND NOT is_ignored AND issue_id % 29 <> 0) GROUP BY scan_id, rule_id, error_text""",
)
_add("grammar_languages", _of(lambda t: listings.grammar_languages(_payload(t, _GRAMMAR, True))), _with(_p(_GRAMMAR, True), views=("issues",)) + f"SELECT DISTINCT scan_id, {_J('lang_code')} AS lang FROM p WHERE NOT is_approved AND NOT is_ignored AND json_valid(payload)")
_add(
    "flag_grammar", _of(lambda t: listings.flag_grammar(_payload(t, _GRAMMAR, True), "error_text", "t3", "is_approved").groupBy("scan_id").agg(F.count_if("is_approved").alias("approved"), F.count_if("reviewed").alias("reviewed"))),
    _with(_p(_GRAMMAR, True), views=("issues",)) + "SELECT scan_id, count(*) FILTER (is_approved OR hit) AS approved, count(*) FILTER (reviewed OR hit) AS reviewed FROM (SELECT *, issue_id % 29 <> 0 AND issue_id % 11 = 3 AS hit FROM p) GROUP BY scan_id",
)
_PHONE = """concat('{"phone_numbers":["(80', issue_id % 10, ') 742-20', 10 + issue_id % 80, '","+1 80', issue_id % 10, '.742.20', 10 + issue_id % 80, '","000.692.6877"],"email_addresses":["Box', issue_id % 9, '@Mail', issue_id % 4, '.example"]}')"""
_add(
    "phone_numbers", _of(lambda t: listings.phone_numbers(_payload(t, _PHONE))),
    _with(views=("issues",)) + "SELECT scan_id, concat('+1', n) AS key, count(*) AS quantity, concat('+1 ', n[1:3], '-', n[4:6], '-', n[7:10]) AS formatted, n[1:3] AS area FROM (SELECT scan_id, concat('80', issue_id % 10, '74220', 10 + issue_id % 80) AS n FROM v_issues WHERE NOT reviewed) GROUP BY ALL",
)
_add(
    "email_hosts", _of(lambda t: listings.email_hosts(_payload(t, _PHONE))),
    _with(views=("issues",)) + "SELECT scan_id, concat('box', issue_id % 9, '@mail', issue_id % 4, '.example') AS email, count(*) AS quantity, concat('mail', issue_id % 4, '.example') AS host FROM v_issues WHERE NOT reviewed GROUP BY ALL",
)
_add(
    "exposed_values", _of(lambda t: listings.exposed_values(_payload(t, _PHONE), "email_addresses", F.lower("value"), 3).select("scan_id", "key", "quantity", "pages")),
    _with(views=("issues",)) + "SELECT scan_id, key, count(*) AS quantity, string_agg(CASE WHEN rank <= 3 THEN page_id END, ',' ORDER BY rank) AS pages FROM (SELECT scan_id, page_id, key, row_number() OVER (PARTITION BY scan_id, key ORDER BY issue_id) AS rank FROM (SELECT *, concat('box', issue_id % 9, '@mail', issue_id % 4, '.example') AS key FROM v_issues WHERE NOT reviewed)) GROUP BY scan_id, key",
)
_FORMS = """concat('{"forms":[{"action":"/f', issue_id % 4, '","method":"post","fields":[{"label":"Name","required":true,"type":"text"},{"label":"L', issue_id % 3, '","type":"email"}]}]}')"""
_add(
    "distinct_forms", _of(lambda t: listings.distinct_forms(_payload(t, _FORMS)).drop("signature")),
    _with(views=("issues",)) + "SELECT scan_id, concat('/f', a) AS action, 2 AS fields, count(*) AS quantity, min(page_id) AS least_page FROM (SELECT scan_id, page_id, issue_id % 4 AS a, issue_id % 3 AS l FROM v_issues WHERE NOT reviewed) GROUP BY scan_id, a, l",
)
_VITALS = "CASE WHEN issue_id % 23 = 0 THEN 'broken' ELSE concat('{\"score\":0.', 10 + issue_id % 90, ',\"lcp\":', issue_id % 4000, ',\"cls\":0.', issue_id % 9, ',\"tbt\":', issue_id % 700, '}') END"
_add(
    "web_vitals_history", _of(lambda t: listings.web_vitals_history(_payload(t, _VITALS).select("scan_id", F.col("payload").alias("body")), t.runs)),
    _with(views=("runs", "issues")) + """SELECT site_id, scan_id, score, lcp, cls, tbt, score - lag(score) OVER (PARTITION BY site_id ORDER BY created_at) AS delta FROM (
      SELECT scan_id, CAST(least[1] AS INT) AS score, CAST(least[2] AS DOUBLE) AS lcp, CAST(least[3] AS DOUBLE) / 10 AS cls, CAST(least[4] AS DOUBLE) AS tbt FROM (SELECT scan_id, min([10 + issue_id % 90, issue_id % 4000, issue_id % 9, issue_id % 700]) AS least FROM v_issues WHERE issue_id % 23 <> 0 GROUP BY scan_id)) JOIN v_runs USING (scan_id) WHERE status = 'done'""",
)
_WORD = "concat('{\"word\":\"w', issue_id % 19, '\"', CASE WHEN issue_id % 3 = 0 THEN concat(',\"category\":\"c', issue_id % 5, '\"') ELSE '' END, CASE WHEN issue_id % 4 = 0 THEN concat(',\"suggestion\":\"s', issue_id % 6, '\"') ELSE '' END, '}')"
_add(
    "word_groups", _of(lambda t: listings.word_groups(_payload(t, _WORD))),
    _with(views=("issues",)) + "SELECT scan_id, concat('w', issue_id % 19) AS word, count(*) AS quantity, count(DISTINCT page_id) AS pages, arg_max(concat('c', issue_id % 5), issue_id) FILTER (issue_id % 3 = 0) AS category, arg_max(concat('s', issue_id % 6), issue_id) FILTER (issue_id % 4 = 0) AS suggestion FROM v_issues WHERE NOT reviewed GROUP BY scan_id, issue_id % 19",
)
_add(
    "link_groups_full", _of(lambda t: listings.link_groups_full(crosspage.broken_links(Q._links(t), Q._status(Q._links(t))), 4)),
    "WITH " + Q._LINKS + ", r AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY page_id) AS rank FROM b) SELECT url, max(status_code) AS status_code, count(*) AS pages, CASE WHEN max(status_code) IN (404, 410, 400) THEN 'likely' ELSE 'potential' END AS confidence, string_agg(CASE WHEN rank <= 4 THEN concat(page_id, ':', text) END, ',' ORDER BY rank) AS places FROM r GROUP BY url",
)
_K = "k AS (SELECT scan_id, url, score, content_hash FROM v_pages JOIN v_pscores USING (scan_id, page_id))"
_add(
    "run_report", _of(lambda t: listings.run_report(t.pages, runs.page_deltas(runs.previous_done(t.runs), t.pages, t.page_scores))),
    _with(*Q._TO_PAGES, Q._PREV, _K, views=Q._RUNS) + """SELECT p.scan_id, page_id, p.url, depth, status, delta, row_number() OVER (PARTITION BY p.scan_id ORDER BY depth, p.url, page_id) AS place FROM v_pages p LEFT JOIN (
      SELECT a.scan_id, a.url, CASE WHEN b.score IS NULL THEN 'new' ELSE 'kept' END AS status, coalesce(a.score, 0) - coalesce(b.score, 0) AS delta FROM (SELECT k.* FROM k JOIN v_prev USING (scan_id) WHERE previous_id IS NOT NULL) a
      LEFT JOIN (SELECT q.scan_id, url, score FROM k JOIN v_prev q ON k.scan_id = q.previous_id) b ON a.scan_id = b.scan_id AND a.url = b.url WHERE a.score IS NOT NULL) d ON d.scan_id = p.scan_id AND d.url = p.url""",
)
_OCCURRENCE = "CASE WHEN issue_id % 3 = 0 THEN concat('{\"occurrence\":', issue_id % 50, '}') ELSE '{}' END"
_add(
    "page_issue_order", _of(lambda t: listings.page_issue_order(_payload(t, _OCCURRENCE))),
    _with(views=("issues",)) + "SELECT scan_id, page_id, issue_id, row_number() OVER (PARTITION BY scan_id, page_id ORDER BY CASE WHEN issue_id % 3 = 0 THEN issue_id % 50 ELSE 1000000000 END, issue_id) AS place FROM v_issues",
)
_add("issue_types", _of(lambda t: listings.issue_types(t.issues)), _with(views=("issues",)) + f"SELECT scan_id, rule_id, coalesce(criterion_id, snippet) AS kind, min({Q._RANK}) AS worst_rank, count(DISTINCT page_id) AS pages, count(*) AS instances FROM v_issues WHERE NOT reviewed GROUP BY ALL")
_COLORS = "concat('{\"violations\":[{\"detected_color\":\"#aa000', issue_id % 7, '\"}', CASE WHEN issue_id % 2 = 0 THEN concat(',{\"detected_color\":\"#BB000', issue_id % 3, '\"}') ELSE '' END, ']}')"
_add(
    "distinct_colors", _of(lambda t: listings.distinct_colors(_payload(t, _COLORS))),
    _with(views=("issues",)) + "SELECT scan_id, concat('#AA000', issue_id % 7) AS color FROM v_issues UNION SELECT scan_id, concat('#BB000', issue_id % 3) FROM v_issues WHERE issue_id % 2 = 0",
)
_add(
    "expand_payload", _of(lambda t: listings.expand_payload(_payload(t, _COLORS))),
    _with(views=("issues",)) + "SELECT scan_id, issue_id, unnest(CASE WHEN issue_id % 2 = 0 THEN [0, 1] ELSE [0] END) AS n, issue_id % 2 = 0 AS expanded FROM v_issues",
)
_add("pages_table", _of(lambda t: listings.pages_table(t.pages, "reading_age", "/P/1")), _with(views=("pages",)) + "SELECT scan_id, page_id, url, reading_age, row_number() OVER (PARTITION BY scan_id ORDER BY reading_age DESC NULLS LAST, url, page_id) AS place FROM v_pages WHERE contains(lower(concat_ws(' ', url, title)), '/p/1')")
_add("sites_table", _of(lambda t: listings.sites_table(Q._cards(t), "overall", "A")), _with(*Q._TO_CHECKS, Q._SCORES, Q._LATEST, Q._CARDS, views=Q._ALL) + "SELECT site_id, name, overall, row_number() OVER (ORDER BY overall DESC NULLS LAST, site_id) AS place FROM v_cards WHERE contains(lower(name), 'a')")
_LISTED = f"cl AS (SELECT scan_id, category, rule_id, check_score, coalesce(n, 0) AS open_issues, coalesce(w, 9) AS worst_rank FROM v_checks LEFT JOIN (SELECT scan_id, category, rule_id, count(*) AS n, min({Q._RANK}) AS w FROM v_issues WHERE {Q._SOPEN} GROUP BY ALL) USING (scan_id, category, rule_id))"
_add(
    "checks_table", _of(lambda t: listings.checks_table(reports.checks_list(t.checks, t.issues))),
    _with(*Q._TO_CHECKS, _LISTED) + "SELECT scan_id, category, rule_id, row_number() OVER (PARTITION BY scan_id ORDER BY CASE WHEN check_score IS NOT NULL AND open_issues > 0 THEN 0 ELSE 1 END, worst_rank, open_issues DESC, check_score NULLS LAST, rule_id, category) AS place FROM cl",
)
_add(
    "page_check_groups", _of(lambda t: listings.page_check_groups(t.issues, dims.rules(t.spark), "privacy")),
    _with(views=("issues",)) + f"""SELECT scan_id, page_id, rule_id, coalesce(n, 0) AS instances, coalesce(w, 9) AS worst_rank FROM (SELECT DISTINCT scan_id, page_id FROM v_issues WHERE NOT reviewed AND category = 'privacy') CROSS JOIN ({_values([(r[0],) for r in dims.RULES if r[1] == 'privacy'], 'rule_id')})
      LEFT JOIN (SELECT scan_id, page_id, rule_id, count(*) AS n, min({Q._RANK}) AS w FROM v_issues WHERE NOT reviewed AND category = 'privacy' GROUP BY ALL) USING (scan_id, page_id, rule_id)""",
)
_add("latest_ok_page", _of(lambda t: listings.latest_ok_page(t.pages.withColumn("scanned_at", F.col("page_id") % 97))), _with(views=("pages",)) + "SELECT scan_id, page_id FROM (SELECT *, row_number() OVER (PARTITION BY scan_id ORDER BY page_id % 97 DESC, page_id DESC) AS r FROM v_pages WHERE render_status = 'ok') WHERE r = 1")
_add("scan_pages", _of(lambda t: listings.scan_pages(t.pages)), _with(views=("pages",)) + "SELECT scan_id, page_id, url, row_number() OVER (PARTITION BY scan_id ORDER BY depth, url, page_id) AS place FROM v_pages")
_add("scan_checks", _of(lambda t: listings.scan_checks(t.checks)), _with(*Q._TO_CHECKS) + "SELECT scan_id, category, rule_id, penalty, row_number() OVER (PARTITION BY scan_id ORDER BY penalty DESC, rule_id, category) AS place FROM v_checks")
_add(
    "failure_reasons", _of(lambda t: listings.failure_reasons(t.pages.withColumn("error", F.when(F.col("page_id") % 3 > 0, F.concat(F.repeat(F.lit("x"), 118), F.col("page_id") % 100))))),
    _with(views=("pages",)) + "SELECT scan_id, CASE WHEN page_id % 3 > 0 THEN substr(concat(repeat('x', 118), page_id % 100), 1, 120) ELSE 'unknown' END AS reason, count(*) AS pages FROM v_pages WHERE render_status <> 'ok' GROUP BY ALL",
)
_add("site_concerns", _of(lambda t: listings.site_concerns(t.issues)), _with(views=("issues",)) + f"SELECT scan_id, rule_id, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY scan_id ORDER BY n DESC, rule_id) AS rank FROM (SELECT scan_id, rule_id, count(*) AS n FROM v_issues WHERE {Q._SOPEN} GROUP BY ALL)) WHERE rank <= 3")
_add("issue_examples", _of(lambda t: reports.issue_examples(t.issues, 5)), _with(views=("issues",)) + "SELECT scan_id, rule_id, rank, issue_id, page_id, selector FROM (SELECT *, row_number() OVER (PARTITION BY scan_id, rule_id ORDER BY issue_id) AS rank FROM v_issues WHERE NOT reviewed) WHERE rank <= 5")
_HIDDEN = ["label", "region", "hsts"]
_add("checks_without_aliases", _of(lambda t: reports.checks_list(t.checks, t.issues, _HIDDEN)), _with(*Q._TO_CHECKS, _LISTED) + "SELECT l.scan_id, l.category, l.rule_id, l.check_score, pages_affected, open_issues, worst_rank FROM cl l JOIN v_checks USING (scan_id, category, rule_id) WHERE l.rule_id NOT IN ('label', 'region', 'hsts')")
_add(
    "list_runs_with_diffs", _of(lambda t: runs.list_runs(t.runs, t.pages, runs.diff_counts(runs.previous_done(t.runs), Q._prints(t)))),
    _with(Q._PRINTS, Q._PREV, views=Q._RUNS) + f"""SELECT r.scan_id, site_id, status, created_at, n_pages, "new", resolved, unchanged FROM (SELECT r.scan_id, r.site_id, status, created_at, count(page_id) AS n_pages FROM v_runs r LEFT JOIN v_pages p ON r.scan_id = p.scan_id GROUP BY ALL) r LEFT JOIN ({Q.ORACLE_SQL["diff_counts"][Q.ORACLE_SQL["diff_counts"].rindex("SELECT scan_id, count(*) FILTER (n AND NOT o)"):]}) d ON d.scan_id = r.scan_id""",
)


def _side(t, year: int) -> DataFrame:
    return t.issues.where(F.col("run_year") == year).select(F.concat_ws("|", "rule_id", "selector").alias("fp"), "issue_id")


_add(
    "compare_issues", _of(lambda t: runs.compare_issues(_side(t, 1996), _side(t, 1995))),
    _with("f AS (SELECT concat(rule_id, '|', selector) AS fp, issue_id, run_year FROM v_issues WHERE run_year IN (1995, 1996))", views=("issues",))
    + "SELECT kind, rank, issue_id, total FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY issue_id, fp) AS rank, count(*) OVER (PARTITION BY kind) AS total FROM (SELECT fp, min(issue_id) AS issue_id, CASE WHEN min(run_year) = 1996 THEN 'new' WHEN max(run_year) = 1995 THEN 'resolved' END AS kind FROM f GROUP BY fp) WHERE kind IS NOT NULL) WHERE rank <= 50",
)
_add(
    "grammar_rules", _of(lambda t: t.raw("documents").select("doc_id", F.explode(text.grammar_rule_hits(F.col("text"))).alias("r")).select("doc_id", "r.rule", "r.hits")),
    " UNION ALL ".join(f"SELECT doc_id, '{n}' AS rule, len(regexp_extract_all(text, '{p}')) AS hits FROM documents WHERE regexp_matches(text, '{p}')" for n, p in text.GRAMMAR_RULES),
)
_HREF = "CASE l_partkey % 9 WHEN 0 THEN 'x.html' WHEN 1 THEN '../y?q=1#f' WHEN 2 THEN '/z/./a/../b' WHEN 3 THEN '?k=2' WHEN 4 THEN '#top' WHEN 5 THEN '//other.example/p' WHEN 6 THEN 'mailto:a@b' WHEN 7 THEN '../../../up/' ELSE 'HTTP://Abs.example/Q' END"
_BASE = "concat('https://h', l_suppkey % 3, '.example/d/e', l_suppkey % 2, '/f.html?old=1')"
_add(
    "resolve_url", _of(lambda t: t.raw("lineitem").selectExpr(f"{_HREF} AS href", f"{_BASE} AS base").select("href", "base", urls.resolve_url(F.col("href"), F.col("base")).alias("url")).groupBy("href", "base", "url").agg(F.count("*").alias("n"))),
    f"""SELECT href, base, CASE href WHEN 'x.html' THEN concat(h, '/d/', e, '/x.html') WHEN '../y?q=1#f' THEN concat(h, '/d/y?q=1') WHEN '/z/./a/../b' THEN concat(h, '/z/b') WHEN '?k=2' THEN concat(h, '/d/', e, '/f.html?k=2') WHEN '#top' THEN base WHEN '//other.example/p' THEN 'https://other.example/p' WHEN '../../../up/' THEN concat(h, '/up/') ELSE href END AS url, count(*) AS n
    FROM (SELECT {_HREF} AS href, {_BASE} AS base, concat('https://h', l_suppkey % 3, '.example') AS h, concat('e', l_suppkey % 2) AS e FROM lineitem) GROUP BY ALL""",
)
