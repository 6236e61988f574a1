"""Website tables over a star schema: sites, runs, pages, issues and assignments.

Each view is one SQL text with ``{table}`` places. Spark fills them with frames and
an oracle with names, so both sides start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillmark.functions import dims

_RULES = dims.values_sql([(i, *r, r[1] == "accessibility" and r[4] is None) for i, r in enumerate(dims.RULES)], "rule_no, rule_id, category, subcategory, criterion_id, wcag_level, wcag_version, is_best_practice")

SITES = "SELECT n_nationkey AS site_id, concat('https://site', n_nationkey, '.example.com/') AS root_url, n_name AS name FROM {nation}"

RUNS = """
SELECT k * 10000 + y AS scan_id, k AS site_id, y AS run_year, concat('https://site', k, '.example.com/') AS root_url,
  CASE WHEN (k + y) % 11 = 0 THEN 'failed' ELSE 'done' END AS status, y * 10000 + 101 AS created_at
FROM (SELECT DISTINCT c_nationkey AS k, year(o_orderdate) AS y FROM {orders} JOIN {customer} ON o_custkey = c_custkey)
"""

PAGES = """
SELECT c_custkey * 10000 + y AS page_id, c_nationkey * 10000 + y AS scan_id, c_nationkey AS site_id, y AS run_year,
  concat('https://site', c_nationkey, '.example.com/p/', c_custkey) AS url, c_custkey % 5 AS depth,
  CASE WHEN c_custkey % 23 = 0 THEN 'error' ELSE 'ok' END AS render_status, c_custkey % 17 = 0 AS is_document, c_custkey % 29 = 0 AS is_error_page,
  concat('Segment ', c_mktsegment, ' ', c_custkey % 50) AS title, SHA256(CAST(n AS VARCHAR(20))) AS content_hash,
  100 * n AS word_count, 6 * n AS sentence_count, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE 5 + c_custkey % 16 END AS reading_age
FROM (
  SELECT c_custkey, c_nationkey, c_mktsegment, year(o_orderdate) AS y, count(*) AS n
  FROM {orders} JOIN {customer} ON o_custkey = c_custkey GROUP BY c_custkey, c_nationkey, c_mktsegment, year(o_orderdate)
)
"""

ISSUES = (
    """
SELECT l_orderkey * 1000000 + rn AS issue_id, page_id, scan_id, site_id, run_year, rule_id, category, subcategory, criterion_id, wcag_level, wcag_version, is_best_practice,
  impact, manual_review, reviewed, selector, snippet
FROM (
  SELECT l_orderkey, c_custkey * 10000 + year(o_orderdate) AS page_id, c_nationkey * 10000 + year(o_orderdate) AS scan_id, c_nationkey AS site_id, year(o_orderdate) AS run_year,
    CAST(l_partkey % 40 AS INT) AS no, CASE l_linenumber % 4 WHEN 0 THEN 'critical' WHEN 1 THEN 'serious' WHEN 2 THEN 'moderate' ELSE 'minor' END AS impact,
    l_returnflag = 'R' AS manual_review, l_linestatus = 'O' AND l_quantity < 10 AS reviewed, concat('#n', l_suppkey) AS selector, concat('<p>', l_partkey % 400, '</p>') AS snippet,
    row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS rn
  FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey JOIN {customer} ON o_custkey = c_custkey
) JOIN ("""
    + _RULES
    + ") ON no = rule_no"
)

ASSIGNMENTS = "SELECT DISTINCT s_nationkey AS site_id, s_suppkey % 10 AS user_id FROM {supplier}"

_LINE = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate"


def _pick(of: str, values: list[str | None], other: str = "NULL") -> str:
    """A CASE over the numbers of the values; texts in quotes, others as they are."""
    return f"CASE {of} " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values) if v is not None) + f" ELSE {other} END"


#: Elements of a page: the lines of eight orders in a row.
ELEMENTS = f"""
SELECT page_id, pos, pos + d % 5 AS last, CASE WHEN pos > 0 AND c % 3 > 0 THEN pos - 1 END AS parent, CASE WHEN c % 4 = 0 THEN pos - pos % 5 END AS in_form, CASE WHEN d % 3 = 0 AND pos > 0 THEN pos - 1 END AS in_label, tag,
  CASE WHEN c % 5 < 2 THEN concat('i', CAST(d % 9 AS VARCHAR(9))) END AS id, CASE WHEN c % 2 = 0 THEN concat('n', CAST(d % 6 AS VARCHAR(9))) END AS name, {_pick("c % 6", ["'email'", "'hidden'", "'tel'", "'checkbox'"], "'text'")} AS type,
  {_pick("c % 4", ["'icon'", "'stylesheet'", "'shortcut icon'"])} AS rel, {_pick("d % 8", ["'button'", "'alert'", "'presentation'", "'navigation'", "'textbox'"])} AS role,
  {_pick("c % 8", ["'#'", "'/contact'", "'mailto:a@b.example'", "'/p/1'", "'#i4'", "'javascript:;'"])} AS href, {_pick("c % 3", ["'/a.gif'", "'/b.png'"])} AS src,
  {_pick("d % 6", ["''", "'a dog'", "'the words of a sign'", "'logo.PNG'", "'Photo'"])} AS alt, CASE WHEN c % 7 = 0 THEN 'Help' END AS title, CASE WHEN d % 7 = 1 THEN 'Support chat' END AS label, CASE WHEN c % 9 = 0 THEN 'i1' END AS described,
  CASE WHEN tag = 'label' AND d % 4 > 0 THEN concat('i', CAST(c % 9 AS VARCHAR(9))) END AS target_for, {_pick("d % 5", ["'email'", "'Name'", "''"])} AS autocomplete, {_pick("c % 10", ["0", "3", "-1"])} AS tabindex,
  {_pick("d % 9", ["'font-size: 10px !important'", "'Animation: spin 2s'", "'color: red'"])} AS style, {_pick("c % 11", ["'glossary-term'", "'x jargon'", "'jargons'"])} AS classes,
  concat(' ', {_pick("c % 13", ["'required'", "'onclick'", "'draggable=true'", "'autoplay'", "'open'", "'aria-live=assertive'", "'data-term'", "'summary'", "'aria-label'", "'aria-hidden=true'", "'maxlength'", "'target=_blank'"], "'hidden'")}, ' ',
    {_pick("d % 6", ["'title'", "'tabindex'", "'role'"], "'class'")}, ' ') AS attrs,
  concat(' ', {_pick("d % 7", ["'title'", "'summary'", "'placeholder'", "'aria-describedby'"], "'class'")}, ' ') AS filled, text AS own, text
FROM (
  SELECT *, {_pick("k", [f"'{t}'" for t in "a a img label input input form fieldset legend table h1 h2 h3 button svg canvas video abbr nav dialog marquee select textarea link title body span p".split()], "'h5'")} AS tag,
    {_pick("t", ["''", "'read more'", "'Section 4'", "'shown in red'", "'the session expires'", "'Help and support'", "'untitled'", "'abc'", "'the round button'", "'questions'"], "concat('text ', CAST(d % 4 AS VARCHAR(9)))")} AS text
  FROM (
    SELECT CAST(floor(l_orderkey / 8.0) AS BIGINT) AS page_id, CAST(row_number() OVER (PARTITION BY floor(l_orderkey / 8.0) ORDER BY {_LINE}) - 1 AS BIGINT) AS pos,
      CAST(l_partkey % 31 AS INT) AS k, CAST(l_suppkey AS INT) AS c, CAST(l_partkey + l_linenumber AS INT) AS d, CAST((l_suppkey + l_linenumber) % 14 AS INT) AS t
    FROM {{lineitem}}
  )
)
"""

#: What was captured of each element: box, order, borders, and styles before and after focus.
STYLES = f"""
SELECT page_id, pos, CASE WHEN pos > 0 AND c % 3 > 0 THEN pos - 1 END AS parent, c % 3 = 0 AS no_border, d % 2 = 0 AS same_background, c % 2 = 0 AS no_outline, CASE WHEN d % 9 = 0 THEN 1 ELSE 0 END AS css_order,
  CAST(c * 13 % 90 AS DOUBLE) AS width, CAST(d % 60 AS DOUBLE) AS height, CAST(c * 37 % 330 AS DOUBLE) AS x, CAST(d % 11 * 30 AS DOUBLE) AS y, d % 5 = 0 AS exempt_within,
  CAST(0 AS DOUBLE) AS b_outline_width, 'none' AS b_outline_style, CASE WHEN c % 5 = 0 THEN '1px' ELSE 'none' END AS b_box_shadow, 'none' AS b_decoration, 200 AS b_r, 100 + c % 9 AS b_g, 30 AS b_b,
  CAST(CASE WHEN d % 6 = 0 THEN 2 ELSE 0 END AS DOUBLE) AS a_outline_width, CASE WHEN c % 2 = 0 THEN 'solid' ELSE 'none' END AS a_outline_style, CASE WHEN d % 5 = 1 THEN '2px' WHEN c % 5 = 0 THEN '1px' ELSE 'none' END AS a_box_shadow,
  CASE WHEN d % 11 = 0 THEN 'underline' ELSE 'none' END AS a_decoration, CASE WHEN c % 4 = 0 THEN 200 ELSE (c * 7) % 256 END AS a_r, 100 + c % 9 AS a_g, 30 AS a_b
FROM (
  SELECT CAST(floor(l_orderkey / 8.0) AS BIGINT) AS page_id, CAST(row_number() OVER (PARTITION BY floor(l_orderkey / 8.0) ORDER BY {_LINE}) - 1 AS BIGINT) AS pos, CAST(l_suppkey AS INT) AS c, CAST(l_partkey + l_linenumber AS INT) AS d
  FROM {{lineitem}}
)
"""

#: Requests, scripts, cookies and console messages of a page, one row each: the lines of four orders in a row.
TRAFFIC = f"""
SELECT page_id, pos, {_pick("c % 4", ["'script'", "'image'", "'stylesheet'"], "'xhr'")} AS kind, {_pick("c % 5", ["'cdn.example.net'", "'www.googletagmanager.com'", "'static.hotjar.com'", "'img.example.org'"], "'site.example.com'")} AS domain,
  concat('https://', {_pick("c % 5", ["'cdn.example.net'", "'www.googletagmanager.com'", "'static.hotjar.com'", "'img.example.org'"], "'site.example.com'")}, {_pick("d % 6", ["'/jquery.js'", "'/Bootstrap.min.js'", "'/gtag/js'", "'/matomo.js'"], "'/x'")}, CAST(d % 3 AS VARCHAR(9))) AS url,
  {_pick("d % 7", ["404", "500", "301", "NULL"], "200")} AS status, c % 5 <= 3 AS is_external, concat('c', CAST(d % 40 AS VARCHAR(9))) AS cookie, {_pick("c % 6", ["'error'", "'warning'", "'log'", "'info'", "'page'"], "'debug'")} AS level, concat('message ', CAST(d % 5 AS VARCHAR(9))) AS message
FROM (
  SELECT CAST(floor(l_orderkey / 4.0) AS BIGINT) AS page_id, CAST(row_number() OVER (PARTITION BY floor(l_orderkey / 4.0) ORDER BY {_LINE}) - 1 AS BIGINT) AS pos, CAST(l_suppkey AS INT) AS c, CAST(l_partkey + l_linenumber AS INT) AS d
  FROM {{lineitem}}
)
"""

_VIEWS = {"elements": ELEMENTS.replace("{{", "{").replace("}}", "}"), "styles": STYLES, "traffic": TRAFFIC, "sites": SITES, "runs": RUNS, "pages": PAGES, "issues": ISSUES, "assignments": ASSIGNMENTS}
_TABLES = ("nation", "customer", "supplier", "orders", "lineitem")


def oracle(*names: str) -> str:
    """WITH clause of the views, over tables registered under their own names."""
    text = ",\n".join(f"v_{n} AS ({_VIEWS[n]})" for n in names)
    for t in _TABLES:
        text = text.replace("{" + t + "}", t)
    return f"WITH {text}\n"


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text = _VIEWS[name].replace("SHA256(CAST(n AS VARCHAR(20)))", "sha2(CAST(n AS STRING), 256)").replace("CAST(NULL AS VARCHAR(99))", "CAST(NULL AS STRING)")
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in _TABLES if "{" + t + "}" in text}
    return spark.sql(text, **used)
