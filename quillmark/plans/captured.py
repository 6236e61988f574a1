"""The registered queries on captured results, URLs, crawl states and texts. Each has its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.functions import dims, text, urls
from quillmark.operators import captured, compliance, crawl, crosspage, runs, scratch, spelling
from quillmark.plans import queries as Q
from quillmark.plans.queries import _add, _of, _with
from quillmark.sources import io

_values = dims.values_sql

# Engine results as JSON, one for each line of an order
_L = "SELECT CAST(l_orderkey * 10000 + l_partkey % 10000 AS BIGINT) AS page_id, CAST(l_partkey AS INT) AS a, CAST(l_suppkey AS INT) AS b, CAST(l_linenumber AS INT) AS c FROM {lineitem}"
_AXE = """concat('{"violations":[{"id":"r', a % 5, '","impact":"serious","description":"d","tags":["', CASE b % 4 WHEN 0 THEN 'wcag2aa' WHEN 1 THEN 'wcag21a' WHEN 2 THEN 'best-practice' ELSE 'cat.x' END, '","', CASE WHEN b % 3 = 0 THEN 'wcag1410' ELSE 'wcag143' END, '"],"nodes":[{"target":["#a', c, '","b"],"html":"<p>","impact":null},{"target":["i"],"html":"<i>","impact":"minor"}]}],"incomplete":',
  CASE WHEN a % 3 = 0 THEN '[{"id":"q","impact":"minor","description":"e","tags":[],"nodes":[{"target":["x"],"html":"y","impact":null}]}]' ELSE '[]' END, ',"passes":[{"id":"p', a % 4, '","nodes":[{"html":"1"},{"html":"2"}]}]}')"""


def _lines(t) -> DataFrame:
    return t.spark.sql(_L, lineitem=t.raw("lineitem"))


def _bodies(t, sql: str) -> DataFrame:
    return _lines(t).selectExpr("page_id", f"{sql} AS body")


_W = "WITH l AS (" + _L.replace("{lineitem}", "lineitem") + ") "
_VERSION = "CASE b % 4 WHEN 0 THEN '2.0' WHEN 1 THEN '2.1' END"
_LEVELS = "CASE b % 4 WHEN 0 THEN 'AA' WHEN 1 THEN 'A' END"
_add(
    "axe_issues", _of(lambda t: captured.axe_issues(_bodies(t, _AXE)).groupBy("manual_review", "rule_id", "impact", "selector", "leaf_selector", "snippet", "wcag_version", "wcag_level", "criterion_id", "is_best_practice").agg(F.count("*").alias("n"))),
    _W + f"""SELECT manual_review, rule_id, impact, selector, leaf_selector, snippet, wcag_version, wcag_level, criterion_id, is_best_practice, count(*) AS n FROM (
      SELECT false AS manual_review, concat('r', a % 5) AS rule_id, unnest(['serious', 'minor']) AS impact, unnest([concat('#a', c, ' > b'), 'i']) AS selector, unnest(['b', 'i']) AS leaf_selector, unnest(['<p>', '<i>']) AS snippet,
        {_VERSION} AS wcag_version, {_LEVELS} AS wcag_level, CASE WHEN b % 3 = 0 THEN '1.4.10' ELSE '1.4.3' END AS criterion_id, b % 4 = 2 AS is_best_practice FROM l
      UNION ALL SELECT true, 'q', 'minor', 'x', 'x', 'y', NULL, NULL, NULL, false FROM l WHERE a % 3 = 0) GROUP BY ALL""",
)
_add("axe_pass_summary", _of(lambda t: captured.axe_pass_summary(_bodies(t, _AXE))), _W + "SELECT page_id, concat('p', a % 4) AS rule_id, 2 AS nodes FROM l")
_TAGS = "CASE b % 5 WHEN 0 THEN 'wcag2a' WHEN 1 THEN 'wcag21aaa' WHEN 2 THEN 'wcag22aa' WHEN 3 THEN 'best-practice' ELSE 'x' END"
_add(
    "classify_tags", _of(lambda t: _lines(t).select("page_id", captured.classify_tags(F.array(F.lit("cat.color"), F.expr(_TAGS), F.expr("CASE WHEN c % 2 = 0 THEN 'wcag2411' ELSE 'wcag111' END"))).alias("w")).groupBy("w.version", "w.level", "w.criterion_id", "w.is_best_practice").agg(F.count("*").alias("n"))),
    _W + "SELECT CASE b % 5 WHEN 0 THEN '2.0' WHEN 1 THEN '2.1' WHEN 2 THEN '2.2' END AS version, CASE b % 5 WHEN 0 THEN 'A' WHEN 1 THEN 'AAA' WHEN 2 THEN 'AA' END AS level, CASE WHEN c % 2 = 0 THEN '2.4.11' ELSE '1.1.1' END AS criterion_id, b % 5 = 3 AS is_best_practice, count(*) AS n FROM l GROUP BY ALL",
)
_LIGHT = "concat('{\"audits\":{\"dom-size\":{\"score\":0.5,\"numericValue\":', a, '},\"font-display\":{\"score\":0.', b % 10, '},\"long-tasks\":{\"score\":null},\"interactive\":{\"numericValue\":', a * 10, '}}}')"
_add(
    "lighthouse_findings", _of(lambda t: captured.lighthouse_findings(_bodies(t, _LIGHT))),
    _W + """SELECT page_id, 'excessive_dom_size' AS rule_id, 'warning' AS severity, 0.5::DOUBLE AS score, CAST(a AS DOUBLE) AS value FROM l WHERE a > 1500 UNION ALL SELECT page_id, 'time_to_interactive', 'info', NULL, a * 10.0 FROM l WHERE a * 10 > 5000
      UNION ALL SELECT page_id, 'font_display', 'warning', CAST(concat('0.', b % 10) AS DOUBLE), NULL FROM l WHERE b % 10 < 9""",
)
_HEADERS = "filter(array(if(a % 2 = 0, 'strict-transport-security', null), if(a % 3 = 0, 'content-security-policy', null), if(b % 2 = 0, 'x-frame-options', null), if(b % 5 > 0, 'x-content-type-options', null)), x -> x IS NOT NULL)"
_add(
    "header_findings", _of(lambda t: captured.header_findings(_lines(t).selectExpr("page_id", "c % 2 = 0 AS is_https", f"map_from_arrays({_HEADERS}, transform({_HEADERS}, x -> 'v')) AS headers", "array(named_struct('secure', true), named_struct('secure', b % 3 > 0)) AS cookies", "a % 1200 AS ttfb_ms"))),
    _W + """SELECT page_id, 'hsts' AS rule_id, 'serious' AS impact FROM l WHERE a % 2 > 0 UNION ALL SELECT page_id, 'csp_missing', 'moderate' FROM l WHERE a % 3 > 0 UNION ALL SELECT page_id, 'privacy_enhanced', 'moderate' FROM l WHERE b % 2 > 0 OR b % 5 = 0
      UNION ALL SELECT page_id, 'cookie_ssl', 'serious' FROM l WHERE c % 2 = 0 AND b % 3 = 0 UNION ALL SELECT page_id, 'server_response_time', 'minor' FROM l WHERE a % 1200 > 600""",
)


def _boxes(t) -> DataFrame:
    """Elements with their boxes; the two sides are written one after the other, so that the shuffle files of one go before those of the other come."""
    tags = scratch.written(t.elements.select("page_id", "pos", F.upper("tag").alias("tag")))
    sides = scratch.written(t.styles.select("page_id", "pos", "x", "y", "width", "height"))
    return tags.join(sides, ["page_id", "pos"]).withColumnRenamed("pos", "target_id").withColumns({"display": F.lit("inline"), "parent_tag": F.when(F.col("target_id") % 2 == 0, "P").otherwise("DIV")})


_add(
    "target_size", _of(lambda t: captured.target_size(_boxes(t)).withColumn("distance", F.round("distance", 6))),
    _with("b AS (SELECT page_id, pos, upper(tag) AS tag, x + width / 2 AS cx, y + height / 2 AS cy, least(width, height) AS least FROM v_elements JOIN (SELECT page_id, pos, x, y, width, height FROM v_styles) USING (page_id, pos))", views=("elements", "styles"))
    + "SELECT s.page_id, s.pos AS target_id, round(min(sqrt(pow(s.cx - o.cx, 2) + pow(s.cy - o.cy, 2))), 6) AS distance, s.tag IN ('INPUT', 'SELECT', 'TEXTAREA') AS manual_review FROM b s JOIN b o ON s.page_id = o.page_id AND s.pos <> o.pos WHERE s.least < 24 AND NOT (s.tag = 'A' AND s.pos % 2 = 0) AND sqrt(pow(s.cx - o.cx, 2) + pow(s.cy - o.cy, 2)) < 24 GROUP BY s.page_id, s.pos, s.tag",
)
_PALETTE = [("red", 204, 0, 0), ("wine", 142, 0, 28), ("black", 0, 0, 0), ("white", 255, 255, 255), ("rose", 255, 107, 107)]
_add(
    "nearest_color", _of(lambda t: captured.nearest_color(_lines(t).selectExpr("page_id", "a * 7 % 256 AS r", "b * 3 % 256 AS g", "c * 31 AS b"), t.spark.createDataFrame(_PALETTE, "name string, r int, g int, b int")).withColumn("distance", F.round("distance", 6))),
    _W + f"""SELECT page_id, r, g, b, min({{'d': d, 'n': name}}).n AS nearest, round(sqrt(min(d)), 6) AS distance FROM (SELECT page_id, x.r, x.g, x.b, name, (x.r - p.r) * (x.r - p.r) + (x.g - p.g) * (x.g - p.g) + (x.b - p.b) * (x.b - p.b) AS d
      FROM (SELECT DISTINCT page_id, a * 7 % 256 AS r, b * 3 % 256 AS g, c * 31 AS b FROM l) x CROSS JOIN ({_values(_PALETTE, 'name, r, g, b')}) p) GROUP BY page_id, r, g, b HAVING min(d) > 400""",
)
_PDF = "concat('d', page_id, '_', c) AS url, a % 30 AS pages, CASE WHEN b % 2 = 0 THEN 'T' ELSE ' ' END AS title, CASE WHEN b % 3 = 0 THEN 'en' END AS lang, a % 4 = 0 AS marked, a % 5 = 0 AS has_bookmarks, a % 6 > 0 AS has_text, CAST(b % 5 AS DOUBLE) AS font_size_spread, CAST(a % 10 AS DOUBLE) / 10 AS garbled_ratio, CASE WHEN b % 7 = 0 THEN 'bad' END AS error"
_PDF_RULES = [("pdf_not_tagged", "NOT marked"), ("pdf_no_title", "trim(title) = ''"), ("pdf_no_language", "lang IS NULL"), ("pdf_no_bookmarks", "pages > 10 AND NOT has_bookmarks"), ("pdf_headings", "font_size_spread < 2"), ("pdf_headings_review", "font_size_spread >= 2"), ("pdf_garbled_text", "NOT has_text OR garbled_ratio > 0.3"), ("pdf_contrast", "true")]
_PDF_SQL = _W.rstrip() + f", i AS (SELECT {_PDF} FROM l), f AS (" + " UNION ALL ".join(f"SELECT url, '{r}' AS rule_id FROM i WHERE error IS NULL AND ({c})" for r, c in _PDF_RULES) + ") "


def _split(columns: str) -> list[str]:
    """Cut a list of expressions at the commas outside brackets."""
    out, depth, cur = [], 0, ""
    for ch in columns:
        depth += (ch == "(") - (ch == ")")
        if ch == "," and not depth:
            out.append(cur)
            cur = ""
        else:
            cur += ch
    return [*out, cur]


def _pdf(t) -> DataFrame:
    return _lines(t).selectExpr(*_split(_PDF))


_add("pdf_checks", _of(lambda t: captured.pdf_checks(_pdf(t))), _PDF_SQL + "SELECT * FROM f")
_add("pdf_scores", _of(lambda t: captured.pdf_scores(_pdf(t), captured.pdf_checks(_pdf(t)))), _PDF_SQL + "SELECT url, CASE WHEN error IS NULL THEN CAST(round_even(100.0 * (8 - coalesce(n, 0)) / 8, 0) AS INT) END AS score FROM i LEFT JOIN (SELECT url, count(DISTINCT rule_id) AS n FROM f GROUP BY url) USING (url)")
_CONTACT = "concat('call 806-742-20', 10 + a % 80, ' or mail A', b % 9, '@x.example and a', b % 9, '@X.example')"
_add(
    "pdf_contacts", _of(lambda t: captured.pdf_contacts(_lines(t).selectExpr("concat('d', page_id, '_', c) AS url", f"{_CONTACT} AS text", "CASE WHEN b % 7 = 0 THEN 'bad' END AS error"))),
    _W + "SELECT url, unnest(['phone_numbers_exposed', 'email_addresses_exposed']) AS rule_id, unnest([p, e]) AS value FROM (SELECT concat('d', page_id, '_', c) AS url, concat('806-742-20', 10 + a % 80) AS p, concat('a', b % 9, '@x.example') AS e FROM l WHERE b % 7 <> 0)",
)
_RULES = [("r1", "the"), ("r1", "License"), ("r2", "er ")]
_add(
    "policy_keywords", _of(lambda t: captured.policy_keywords(t.raw("documents").select(F.col("doc_id").alias("page_id"), "text"), t.spark.createDataFrame(_RULES, "rule string, pattern string")).select("page_id", "rule", "occurrences")),
    f"SELECT page_id, rule, CAST(sum(n) AS BIGINT) AS occurrences FROM (SELECT doc_id AS page_id, rule, (length(lower(text)) - length(replace(lower(text), lower(pattern), ''))) // length(pattern) AS n FROM documents CROSS JOIN ({_values(_RULES, 'rule, pattern')})) WHERE n > 0 GROUP BY ALL",
)
_add(
    "suppress_grammar", _of(lambda t: captured.suppress_grammar(t.issues.withColumn("error_text", F.concat(F.lit("t"), F.col("issue_id") % 11)), t.sites.selectExpr("site_id", "concat('t', site_id % 11) AS error_text"), t.sites.where("site_id % 2 = 0").selectExpr("site_id", "'hsts' AS rule_id")).select("issue_id")),
    _with(views=("issues",)) + "SELECT issue_id FROM v_issues WHERE issue_id % 11 <> site_id % 11 AND NOT (rule_id = 'hsts' AND site_id % 2 = 0)",
)
_ALIASES = [("hsts", "hsts_alias", "policies"), ("label", "label_alias", "content"), ("label", "label_more", "content")]
_add(
    "add_aliases", _of(lambda t: captured.add_aliases(t.issues, t.spark.createDataFrame(_ALIASES, "rule_id string, alias_id string, alias_category string")).groupBy("rule_id", "category").agg(F.count("*").alias("n"))),
    _with(views=("issues",)) + f"SELECT rule_id, category, count(*) AS n FROM (SELECT rule_id, category FROM v_issues UNION ALL SELECT alias_id, alias_category FROM v_issues JOIN ({_values(_ALIASES, 'rule_id, alias_id, alias_category')}) USING (rule_id)) GROUP BY ALL",
)
_KEY = "lower(trim(coalesce(nullif(autocomplete, ''), name, '')))"
_add(
    "redundant_entry", _of(lambda t: captured.redundant_entry(t.elements.where("in_form IS NOT NULL AND (tag IN ('select', 'textarea') OR tag = 'input' AND type NOT IN ('hidden', 'radio', 'checkbox'))").selectExpr("page_id", "in_form AS form", "pos", f"{_KEY} AS key"))),
    _with(views=("elements",)) + f"""SELECT page_id, form, pos, key, rank, first_pos FROM (SELECT *, row_number() OVER w AS rank, first_value(pos) OVER w AS first_pos FROM (SELECT page_id, in_form AS form, pos, {_KEY} AS key FROM v_elements
      WHERE in_form IS NOT NULL AND (tag IN ('select', 'textarea') OR tag = 'input' AND type NOT IN ('hidden', 'radio', 'checkbox'))) WHERE key <> '' WINDOW w AS (PARTITION BY page_id, form, key ORDER BY pos)) WHERE rank > 1""",
)

# Compliance
_TEXT = "concat('Our ', CASE a % 6 WHEN 0 THEN 'DEI office' WHEN 1 THEN 'diversity and inclusion' WHEN 2 THEN 'research on diversity' WHEN 3 THEN 'DEI' WHEN 4 THEN 'chief diversity officer' ELSE 'roads' END, ' and ', CASE b % 3 WHEN 0 THEN 'diversity in physics' WHEN 1 THEN 'dei program' ELSE 'bridges' END)"
_T1 = "CASE a % 6 WHEN 0 THEN 1 WHEN 4 THEN 1 ELSE 0 END + CASE WHEN b % 3 = 1 THEN 1 ELSE 0 END"
_T2 = "CASE WHEN a % 6 IN (1, 3) THEN 1 ELSE 0 END"
_T3 = "CASE WHEN a % 6 = 2 THEN 1 ELSE 0 END + CASE WHEN b % 3 = 0 THEN 1 ELSE 0 END"
_add(
    "phrase_tiers", _of(lambda t: compliance.phrase_tiers(_lines(t).selectExpr("page_id", f"{_TEXT} AS text"))),
    _W + f"""SELECT page_id, t1 AS tier1, t2 AS tier2, t3 AS tier3, CASE WHEN t1 > 0 THEN 'Legal review required' WHEN t2 > 0 THEN 'Review recommended' ELSE 'Monitor' END AS action, CASE WHEN t1 > 0 THEN 'error' WHEN t2 > 0 THEN 'warning' ELSE 'info' END AS impact
      FROM (SELECT page_id, {_T1} AS t1, {_T2} AS t2, {_T3} AS t3 FROM l) WHERE t1 + t2 + t3 > 0""",
)
_NOW = "TIMESTAMP '1999-06-01 00:00:00'"
_STALE = "SELECT c_custkey * 100 + o_orderkey % 100 AS page_id, CASE WHEN o_orderkey % 9 = 0 THEN 'http://h/Privacy/x' ELSE 'http://h/y' END AS url, CAST(o_orderdate AS TIMESTAMP) AS last_changed_at FROM {orders} JOIN {customer} ON o_custkey = c_custkey"


def _stale(t) -> DataFrame:
    return compliance.stale_content(t.spark.sql(_STALE, orders=t.raw("orders"), customer=t.raw("customer")), F.expr(_NOW))


_STALE_SQL = f"WITH s AS (SELECT page_id, url, CAST(floor((epoch({_NOW}) - epoch(last_changed_at)) / 86400) AS BIGINT) AS days FROM ({_STALE.replace('{', '').replace('}', '')})), st AS (SELECT * FROM s WHERE days > 365 AND NOT regexp_matches(url, '(?i)/privacy|/accessibility')) "
_add("stale_content", _of(_stale), _STALE_SQL + "SELECT * FROM st")
_add("oldest_change", _of(lambda t: compliance.oldest_change(_stale(t))), _STALE_SQL + "SELECT count(*) AS pages, max(days) AS days FROM st")

# Runs, sites, crawl
_STATE = "scan_id, CASE run_year % 3 WHEN 0 THEN 'running' WHEN 1 THEN 'queued' ELSE 'done' END AS status, TIMESTAMP '2024-01-01 00:00:00' AS created_at, CASE WHEN site_id % 2 = 0 THEN TIMESTAMP '2024-01-01 00:20:00' END AS started_at, CASE WHEN site_id % 3 = 0 THEN TIMESTAMP '2024-01-01 00:40:00' END AS last_progress_at"
_add(
    "stalled_runs", _of(lambda t: runs.stalled_runs(t.runs.selectExpr(*_split(_STATE)), F.expr("TIMESTAMP '2024-01-01 01:00:00'")).select("scan_id")),
    _with(views=("runs",)) + f"SELECT scan_id FROM (SELECT {_STATE} FROM v_runs) WHERE status IN ('running', 'queued') AND coalesce(last_progress_at, started_at, created_at) < TIMESTAMP '2024-01-01 00:25:00'",
)
_DUE = "site_id, site_id % 7 = 0 AS force_rescan, CASE WHEN site_id % 5 > 0 THEN TIMESTAMP '2024-01-10 00:00:00' END AS last_scanned_at, CAST(site_id % 4 AS INT) AS recrawl_interval_days"
_add(
    "sites_due", _of(lambda t: crawl.sites_due(t.sites.selectExpr(*_split(_DUE)), t.sites.where("site_id % 11 = 0"), F.expr("TIMESTAMP '2024-01-12 00:00:00'")).select("site_id")),
    _with(views=("sites",)) + "SELECT site_id FROM v_sites WHERE (site_id % 7 = 0 OR site_id % 5 = 0 OR site_id % 4 <= 2) AND site_id % 11 <> 0",
)
_STEPS = "UNION ALL SELECT '{0}->{1}' AS step, epoch({1}) - epoch({0}) AS seconds FROM x".format
_add(
    "state_durations", _of(lambda t: runs.state_durations(t.runs.selectExpr(*_split(_STATE)), ["created_at", "started_at", "last_progress_at"])),
    _with(f"x AS (SELECT {_STATE} FROM v_runs)", views=("runs",)) + "SELECT step, count(*) AS n, CAST(min(seconds) AS BIGINT) AS least, CAST(max(seconds) AS BIGINT) AS most, CAST(round(CAST(avg(seconds) AS DECIMAL(18,6)), 1) AS DOUBLE) AS mean FROM (SELECT '' AS step, 0.0 AS seconds FROM x WHERE false " + _STEPS("created_at", "started_at") + " " + _STEPS("started_at", "last_progress_at") + ") WHERE seconds IS NOT NULL GROUP BY step",
)
# a sketch of up to some hundred durations holds them all, so these are exact
_JOBS = "l_suppkey * 8 + l_linenumber AS team, l_partkey % 30 AS day, TIMESTAMP '2024-01-01 00:00:00' AS queued, TIMESTAMP '2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, 0, l_partkey % 997) AS begun, CASE WHEN l_orderkey % 5 > 0 THEN TIMESTAMP '2024-01-01 01:00:00' + make_interval(0, 0, 0, 0, 0, 0, l_orderkey % 89) END AS ended"
_add(
    "state_percentiles", _of(lambda t: runs.duration_percentiles(runs.merged_sketches(runs.duration_sketches(t.raw("lineitem").selectExpr(*_split(_JOBS)), ["queued", "begun", "ended"], ["team", "day"]), ["team"]))),
    """SELECT team, step, count(*) AS n, quantile_disc(seconds, 0.5) AS p50, quantile_disc(seconds, 0.9) AS p90, quantile_disc(seconds, 0.99) AS p99 FROM (
      SELECT l_suppkey * 8 + l_linenumber AS team, unnest(['queued->begun', 'begun->ended']) AS step, unnest([l_partkey % 997, CASE WHEN l_orderkey % 5 > 0 THEN 3600 + l_orderkey % 89 - l_partkey % 997 END]) AS seconds FROM lineitem) WHERE seconds IS NOT NULL GROUP BY ALL""",
)
_ROOT = "CASE page_id % 3 WHEN 0 THEN 'https://HOST/en' WHEN 1 THEN 'http://www.HOST/' ELSE 'https://HOST/e' END"
_add(
    "in_scope", _of(lambda t: t.raw("pages").select("page_id", urls.is_in_scope(F.col("url"), F.replace(F.expr(_ROOT), F.lit("HOST"), urls.part(F.col("url"), 2))).alias("inside"))),
    r"SELECT page_id, CASE page_id % 3 WHEN 0 THEN p = '/en' OR starts_with(p, '/en/') WHEN 1 THEN NOT starts_with(h, 'www.') ELSE p = '/e' OR starts_with(p, '/e/') END AS inside FROM (SELECT page_id, lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)) AS h, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS p FROM pages)",
)
_FILES = "concat('HTTPS://Site', b % 5, '.Example.co.uk/', CASE a % 7 WHEN 0 THEN 'x.PDF' WHEN 1 THEN 'y.docx?z=1' WHEN 2 THEN 'img.png' WHEN 3 THEN 'p.zip' ELSE 'page' END)"
_add(
    "document_urls", _of(lambda t: _lines(t).select("page_id", "c", F.expr(_FILES).alias("u")).select("page_id", "c", urls.document_extension(F.col("u")).alias("document"), urls.is_renderable(F.col("u")).alias("renderable"))),
    _W + "SELECT page_id, c, CASE a % 7 WHEN 0 THEN '.pdf' WHEN 1 THEN '.docx' END AS document, a % 7 >= 4 AS renderable FROM l",
)
_SUFFIXES = [("uk",), ("co.uk",), ("com",), ("example.com",)]
_HOSTS = "concat(CASE a % 4 WHEN 0 THEN 'www.' WHEN 1 THEN 'a.b.' ELSE '' END, 'site', b % 9, CASE c % 4 WHEN 0 THEN '.co.uk' WHEN 1 THEN '.com' WHEN 2 THEN '.example.com' ELSE '.zz' END)"


def _domains(t) -> DataFrame:
    return crawl.registrable_domains(_lines(t).selectExpr(f"{_HOSTS} AS host"), t.spark.createDataFrame(_SUFFIXES, "suffix string"))


_DOMAIN = f"WITH l AS ({_L.replace('{lineitem}', 'lineitem')}), h AS (SELECT DISTINCT {_HOSTS} AS host, CASE WHEN c % 4 = 3 THEN {_HOSTS} ELSE concat('site', b % 9, CASE c % 4 WHEN 0 THEN '.co.uk' WHEN 1 THEN '.com' ELSE '.example.com' END) END AS domain FROM l) "
_add("registrable_domains", _of(_domains), _DOMAIN + "SELECT host, domain FROM h")
_add(
    "same_site", _of(lambda t: crawl.same_site(_lines(t).selectExpr(f"{_HOSTS} AS a", "concat('site', b % 9, '.com') AS b").distinct(), _domains(t).unionByName(_lines(t).selectExpr("concat('site', b % 9, '.com') AS host").distinct().selectExpr("host", "host AS domain")).dropDuplicates(["host"]))),
    _DOMAIN + f"SELECT DISTINCT {_HOSTS} AS a, concat('site', b % 9, '.com') AS b, c % 4 = 1 AS same FROM l",
)
_add(
    "declared_sitemaps", _of(lambda t: crawl.declared_sitemaps(t.sites.where("site_id % 2 = 0").selectExpr("site_id AS site", "concat('User-agent: *\\nSITEMAP: https://s', site_id, '/a.xml\\nDisallow: /\\n sitemap : https://s', site_id, '/b.xml') AS body"), t.sites.selectExpr("site_id AS site", "root_url"))),
    _with(views=("sites",)) + "SELECT site_id AS site, unnest(CASE WHEN site_id % 2 = 0 THEN [concat('https://s', site_id, '/a.xml'), concat('https://s', site_id, '/b.xml')] ELSE [concat(root_url, 'sitemap.xml')] END) AS url FROM v_sites",
)
_add(
    "collect_documents", _of(lambda t: crawl.collect_documents(_lines(t).selectExpr("b % 5 AS site", f"{_FILES} AS url", "CASE WHEN c % 2 = 0 THEN 'example.co.uk' ELSE 'other' END AS domain"), _lines(t).selectExpr("b % 5 AS site", "'example.co.uk' AS domain").distinct(), 1)),
    _W + "SELECT site, min(url) AS url, 1 AS rank FROM (SELECT b % 5 AS site, concat('https://site', b % 5, '.example.co.uk/', CASE a % 7 WHEN 0 THEN 'x.PDF' ELSE 'y.docx?z=1' END) AS url FROM l WHERE a % 7 < 2 AND c % 2 = 0) GROUP BY site",
)
_add(
    "external_links", _of(lambda t: crosspage.split_external_links(_lines(t).selectExpr("page_id", f"lower({_FILES}) AS url"), F.lit("https://site1.example.co.uk/"))),
    _W + f"SELECT DISTINCT lower({_FILES}) AS url FROM l WHERE b % 5 <> 1",
)
_FETCH = "SELECT site_id AS site, k AS place, concat('s', site_id, '/', k) AS url, CASE WHEN (site_id + k) % 3 = 0 THEN 200 WHEN (site_id + k) % 3 = 1 THEN 404 END AS status, CASE WHEN k < 2 THEN 'root' ELSE 'child' END AS kind, (site_id * k) % 2 = 0 AS parsed FROM {s} CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3)"
_add(
    "sitemap_findings", _of(lambda t: crosspage.sitemap_findings(t.spark.sql(_FETCH, s=t.sites))),
    _with(f"f AS ({_FETCH.replace('{s}', 'v_sites')})", "r AS (SELECT site, min(CASE WHEN status = 200 THEN place END) AS place FROM f WHERE kind = 'root' GROUP BY site)", "g AS (SELECT f.* FROM f JOIN r USING (site, place))", views=("sites",))
    + "SELECT site, 'sitemap_missing' AS rule_id, NULL AS url FROM r WHERE place IS NULL UNION ALL SELECT site, 'sitemap_malformed', url FROM g WHERE NOT parsed UNION ALL SELECT site, 'sitemap_malformed', url FROM f WHERE kind = 'child' AND (status IS DISTINCT FROM 200 OR NOT parsed) AND site IN (SELECT site FROM g WHERE parsed)",
)
_add(
    "upsert_page", _of(lambda t: _upserted(t)),
    _with() + "SELECT (SELECT count(*) FROM v_pages) AS pages, (SELECT count(*) FROM v_issues WHERE page_id % 10 <> 3) + 1 AS issues",
)


def _upserted(t) -> DataFrame:
    new = t.pages.where("page_id % 10 = 3")
    pages, issues = io.upsert_page(t.pages, t.issues, new, t.issues.limit(0).unionByName(t.issues.orderBy("issue_id").limit(1)))
    both = pages.select(F.lit(1).alias("p"), F.lit(0).alias("i")).unionByName(issues.select(F.lit(0).alias("p"), F.lit(1).alias("i")))
    return both.agg(F.sum("p").alias("pages"), F.sum("i").alias("issues"))


# Texts
_add("cap_words", _of(lambda t: t.raw("documents").select("doc_id", F.sha2(F.regexp_replace(F.trim(text.cap_words(F.col("text"), 50)), r"\s+", " "), 256).alias("sha"))), r"SELECT doc_id, sha256(array_to_string(list_filter(regexp_split_to_array(coalesce(text, ''), '\s+'), lambda x: x <> '')[1:50], ' ')) AS sha FROM documents")
_add(
    "excerpts", _of(lambda t: t.raw("documents").where("instr(text, 'the') > 0").select("doc_id", text.excerpt(F.col("text"), F.instr("text", F.lit("the")), F.lit(3)).alias("excerpt"))),
    "SELECT doc_id, concat(CASE WHEN s > 1 THEN '...' ELSE '' END, substr(text, s, i - s + 3 + 55), CASE WHEN i + 58 <= length(text) THEN '...' ELSE '' END) AS excerpt FROM (SELECT doc_id, text, instr(text, 'the') AS i, greatest(instr(text, 'the') - 55, 1) AS s FROM documents) WHERE i > 0",
)
def _flagged(t) -> DataFrame:
    few = spelling.spelling_simple(Q._as_pages(t), spelling.corpus_dictionary(t.raw("documents"), 3), 10)
    none = t.raw("documents").where("doc_id < 40").selectExpr("doc_id AS page_id", "11 AS rank", "'absentword' AS word")
    return few.unionByName(none).withColumns({"kind": F.lit("potential"), "suggestion": F.lit(None).cast("string"), "lang": F.lit(None).cast("string")})


_add(
    "spelling_occurrences", _of(lambda t: spelling.spelling_occurrences(Q._as_pages(t), _flagged(t)).select("page_id", "rank", "word", "place", "at", "matched", F.length("context").alias("around"))),
    r"""WITH w AS (SELECT doc_id, unnest(list_distinct(list_filter(regexp_split_to_array(coalesce(text, ''), '[^\p{L}\p{N}_]+'), lambda x: regexp_full_match(x, '[a-z]{4,}')))) AS word FROM documents), k AS (SELECT word FROM (SELECT doc_id, unnest(list_distinct(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}_]+'), lambda x: regexp_full_match(x, '[a-z]{4,}')))) AS word FROM documents) GROUP BY word HAVING count(*) >= 3),
    f AS (SELECT page_id, rank, word FROM (SELECT doc_id AS page_id, word, row_number() OVER (PARTITION BY doc_id ORDER BY word) AS rank FROM w WHERE word NOT IN (SELECT word FROM k)) WHERE rank <= 10 UNION ALL SELECT doc_id, 11, 'absentword' FROM documents WHERE doc_id < 40),
    tok AS (SELECT doc_id AS page_id, i, ts[i] AS t, length(text) AS n FROM (SELECT doc_id, text, ts, unnest(range(1, len(ts) + 1)) AS i FROM (SELECT doc_id, text, regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_]+') AS ts FROM documents))),
    p AS (SELECT page_id, lower(t) AS word, t AS matched, CAST(coalesce(sum(length(t)) OVER (PARTITION BY page_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS a, n FROM tok),
    o AS (SELECT f.page_id, f.rank, f.word, p.a, p.matched, p.n, CASE WHEN p.a IS NOT NULL THEN CAST(row_number() OVER (PARTITION BY f.page_id, f.word ORDER BY p.a) AS INTEGER) END AS place FROM f LEFT JOIN p ON p.page_id = f.page_id AND p.word = f.word)
    SELECT page_id, CAST(rank AS INTEGER) AS rank, word, place, a AS "at", coalesce(matched, word) AS matched, CAST(CASE WHEN a IS NULL THEN 0 ELSE least(a + length(word) + 60, n) - greatest(a - 60, 0) END AS INTEGER) AS around FROM o WHERE place IS NULL OR place <= 5""",
)
_add(
    "spelling_simple", _of(lambda t: spelling.spelling_simple(Q._as_pages(t), spelling.corpus_dictionary(t.raw("documents"), 3), 10)),
    r"""WITH w AS (SELECT doc_id, unnest(list_distinct(list_filter(regexp_split_to_array(coalesce(text, ''), '[^\p{L}\p{N}_]+'), lambda x: regexp_full_match(x, '[a-z]{4,}')))) AS word FROM documents), k AS (SELECT word FROM (SELECT doc_id, unnest(list_distinct(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}_]+'), lambda x: regexp_full_match(x, '[a-z]{4,}')))) AS word FROM documents) GROUP BY word HAVING count(*) >= 3)
    SELECT page_id, rank, word FROM (SELECT doc_id AS page_id, word, row_number() OVER (PARTITION BY doc_id ORDER BY word) AS rank FROM w WHERE word NOT IN (SELECT word FROM k)) WHERE rank <= 10""",
)
