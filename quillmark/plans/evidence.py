"""The registered queries on captured evidence: elements, styles, traffic. Each has its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.functions import dims
from quillmark.operators import elements, traffic
from quillmark.plans.queries import _add, _of, _with

_E = ("elements",)
_SQL = elements.duckdb_sql


def _elements(parts: str, *ctes: str, views: tuple[str, ...] = _E) -> str:
    return _with(*ctes, views=views) + parts


_HITS = " UNION ALL ".join(f"SELECT page_id, pos, '{r}' AS rule_id, '{i}' AS impact, {str(m).lower()} AS manual_review, {cap} AS cap, text FROM v_elements WHERE {_SQL(p)}" for r, p, i, m, cap in elements.RULES)
_add(
    "element_findings", _of(lambda t: elements.element_findings(t.elements)),
    _elements(f"SELECT page_id, pos, regexp_replace(rule_id, '_visual$|_quality$', '') AS rule_id, impact, manual_review, coalesce(text, '') AS detail FROM (SELECT *, row_number() OVER (PARTITION BY page_id, rule_id ORDER BY pos) AS rank FROM (SELECT * FROM ({_HITS}) h WHERE rule_id <> 'text_conveys_information' OR (page_id, pos) NOT IN (SELECT page_id, unnest(range(pos, last + 1)) FROM v_elements WHERE attrs LIKE '% hidden %'))) WHERE rank <= cap"),
)
_add(
    "table_summary", _of(lambda t: elements.table_summary(t.elements)),
    _elements("SELECT page_id, tables, without FROM (SELECT page_id, count(*) AS tables, sum(CASE WHEN regexp_matches(filled, ' (summary|aria-describedby) ') THEN 0 ELSE 1 END)::BIGINT AS without FROM v_elements WHERE tag = 'table' GROUP BY page_id) WHERE without > 0"),
)
_add("fieldset_legend", _of(lambda t: elements.fieldset_legend(t.elements)), _elements("SELECT f.page_id, f.pos FROM v_elements f LEFT JOIN (SELECT DISTINCT page_id, parent FROM v_elements WHERE tag = 'legend' AND text <> '') l ON l.page_id = f.page_id AND l.parent = f.pos WHERE tag = 'fieldset' AND l.parent IS NULL"))
_LABELABLE = elements._in(elements.LABELABLE)
_add(
    "label_findings", _of(lambda t: elements.label_findings(t.elements)),
    _elements(f"""SELECT page_id, pos, CASE WHEN n IS NULL THEN 'label_orphan_for' ELSE 'label_misuse' END AS rule_id FROM (
      SELECT l.page_id, l.pos, n, t.tag, t.role FROM v_elements l LEFT JOIN (SELECT page_id, id, tag, role, row_number() OVER (PARTITION BY page_id, id ORDER BY pos) AS n FROM v_elements WHERE id <> '') t ON t.n = 1 AND t.page_id = l.page_id AND t.id = l.target_for
      WHERE l.tag = 'label' AND l.target_for IS NOT NULL) WHERE n IS NULL OR (tag NOT IN {_LABELABLE} AND coalesce(role, '') <> 'textbox')
    UNION ALL SELECT page_id, pos, 'label_misuse' FROM v_elements l WHERE tag = 'label' AND target_for IS NULL AND text <> '' AND NOT EXISTS (SELECT 1 FROM v_elements i WHERE i.page_id = l.page_id AND i.in_label = l.pos AND i.tag IN {_LABELABLE})"""),
)
_add(
    "context_sensitive_help", _of(lambda t: elements.context_sensitive_help(t.elements)),
    _elements(r"""SELECT page_id, pos, (SELECT count(*) FROM v_elements c WHERE c.page_id = f.page_id AND c.in_form = f.pos AND c.tag IN ('input', 'select', 'textarea')) AS fields FROM v_elements f
      WHERE tag = 'form' AND NOT regexp_matches(lower(text), '\b(help|contact us|questions|support)\b') AND NOT EXISTS (SELECT 1 FROM v_elements a WHERE a.tag = 'a' AND a.page_id = f.page_id AND a.in_form = f.pos AND regexp_matches(a.href, 'help|contact|support|faq'))"""),
)
_add(
    "page_titles", _of(lambda t: elements.page_titles(t.elements, t.elements.select("page_id").distinct())),
    _elements(f"SELECT page_id, coalesce(title, '') AS title FROM (SELECT page_id, arg_min(text, pos) FILTER (tag = 'title') AS title FROM v_elements GROUP BY page_id) WHERE length(coalesce(title, '')) < 4 OR lower(title) IN {elements._in(elements.GENERIC_TITLES)}"),
)
_add(
    "time_limits", _of(lambda t: elements.time_limits(t.elements)),
    _elements(f"SELECT page_id, pos, unnest(['inactivity_data_loss', 'timing_not_essential']) AS rule_id FROM (SELECT page_id, min(pos) AS pos FROM v_elements WHERE tag NOT IN ('html', 'head', 'body', 'title', 'script', 'style') AND regexp_matches(text, '{elements.TIME_LIMIT}') GROUP BY page_id)"),
)
_add(
    "consistent_identification", _of(lambda t: elements.consistent_identification(t.elements)),
    _elements("""SELECT page_id, href, pos, name, first_name FROM (SELECT *, first_value(name) OVER (PARTITION BY page_id, href ORDER BY pos) AS first_name FROM (
      SELECT page_id, pos, href, trim(CASE WHEN trim(coalesce(text, '')) <> '' THEN text ELSE coalesce(label, '') END) AS name FROM v_elements WHERE tag = 'a' AND href <> '') WHERE name <> '') WHERE name <> first_name"""),
)
_add(
    "headings_labels_descriptive", _of(lambda t: elements.headings_labels_descriptive(t.elements)),
    _elements(f"""SELECT page_id, pos, tag, reason FROM (SELECT *, CASE WHEN x = '' THEN 'empty' WHEN x IN {elements._in(elements.VAGUE_HEADINGS)} OR regexp_full_match(x, '(section|item|heading|content)\\s*\\d*') THEN 'vague' WHEN tag LIKE 'h%' AND many > 1 THEN 'duplicated' END AS reason FROM (
      SELECT page_id, pos, tag, x, row_number() OVER (PARTITION BY page_id ORDER BY pos) AS rank, count(*) OVER (PARTITION BY page_id, x) AS many FROM (SELECT *, lower(coalesce(text, '')) AS x FROM v_elements WHERE tag IN ('h1', 'h2', 'h3', 'h4', 'h5', 'h6', 'label', 'legend'))) WHERE rank <= 200) WHERE reason IS NOT NULL"""),
)
_H = "tag IN ('h1', 'h2', 'h3', 'h4', 'h5', 'h6')"
_add(
    "heading_order", _of(lambda t: elements.heading_order(t.elements)),
    _elements(f"SELECT page_id, pos FROM (SELECT page_id, pos, CAST(tag[2] AS INT) AS v, lag(CAST(tag[2] AS INT)) OVER (PARTITION BY page_id ORDER BY pos) AS b FROM v_elements WHERE {_H}) WHERE v > b + 1 UNION ALL SELECT page_id, NULL FROM v_elements WHERE {_H} GROUP BY page_id HAVING count(*) FILTER (tag = 'h1') = 0"),
)
_add(
    "page_level_findings", _of(lambda t: elements.page_level(t.elements)),
    _elements(f"""SELECT page_id, unnest(r) AS rule_id, unnest(d) AS detail FROM (SELECT page_id, list_filter([CASE WHEN bad THEN 'page-title' END, CASE WHEN long THEN 'title_too_long' END, CASE WHEN thin THEN 'thin_pages' END, CASE WHEN h > 1 THEN 'multiple_h1' END], lambda x: x IS NOT NULL) AS r,
      list_filter([CASE WHEN bad THEN title END, CASE WHEN long THEN title END, CASE WHEN thin THEN CAST(words AS VARCHAR) END, CASE WHEN h > 1 THEN concat(h, ': ', first) END], lambda x: x IS NOT NULL) AS d FROM (
      SELECT page_id, title, length(title) < 10 OR lower(title) IN {elements._in(elements.GENERIC_CONTENT_TITLES)} AS bad, length(title) > 60 AS long, words < 300 AND media = 0 AS thin, words, h, first FROM (
      SELECT page_id, coalesce(arg_min(text, pos) FILTER (tag = 'title'), '') AS title, coalesce(max(len(regexp_extract_all(text, '\\S+'))) FILTER (tag = 'body'), 0) AS words, count(*) FILTER (tag IN ('video', 'iframe', 'canvas') AND pos BETWEEN low AND high) AS media, count(*) FILTER (tag = 'h1') AS h, array_to_string(list(left(text, 80) ORDER BY pos) FILTER (tag = 'h1')[1:5], ' | ') AS first
      FROM v_elements LEFT JOIN (SELECT page_id, min(pos) AS low, arg_min(last, pos) AS high FROM v_elements WHERE tag = 'body' GROUP BY page_id) USING (page_id) GROUP BY page_id)))"""),
)
_add("link_no_text", _of(lambda t: elements.link_no_text(t.elements)), _elements("SELECT page_id, pos FROM v_elements a WHERE tag = 'a' AND href <> '' AND text = '' AND coalesce(label, '') = '' AND coalesce(title, '') = '' AND NOT EXISTS (SELECT 1 FROM v_elements i WHERE i.tag = 'img' AND trim(i.alt) <> '' AND i.page_id = a.page_id AND i.parent = a.pos)"))
_add("broken_anchor_links", _of(lambda t: elements.broken_anchor_links(t.elements)), _elements("SELECT page_id, substr(href, 2) AS mark, pos FROM v_elements a WHERE tag = 'a' AND href LIKE '#_%' AND NOT EXISTS (SELECT 1 FROM v_elements i WHERE i.page_id = a.page_id AND substr(a.href, 2) IN (i.id, i.name))"))
_ES = ("elements", "styles")
_NATIVE = elements._NATIVE
_add(
    "style_findings", _of(lambda t: elements.style_findings(t.elements, t.styles.drop("parent"))),
    _elements(f"""SELECT page_id, pos, rule_id FROM (SELECT *, row_number() OVER (PARTITION BY page_id, rule_id ORDER BY pos) AS rank FROM (
      SELECT page_id, pos, unnest([CASE WHEN tag IN ('input', 'select', 'textarea') AND type NOT IN ('hidden', 'submit', 'button', 'image', 'reset', 'checkbox', 'radio', 'range', 'color', 'file') AND no_border AND same_background AND no_outline THEN 'control_contrast' END,
        CASE WHEN css_order <> 0 THEN 'meaningful_sequence' END, CASE WHEN ({_NATIVE} OR role IN ('button', 'link') OR tabindex IS NOT NULL) AND width > 0 AND height > 0 AND least(width, height) < 44 THEN 'large_interactive_controls' END]) AS rule_id
      FROM v_elements JOIN (SELECT * EXCLUDE (parent) FROM v_styles) USING (page_id, pos)) WHERE rule_id IS NOT NULL) WHERE rank <= CASE WHEN rule_id = 'control_contrast' THEN 50 ELSE 100 END""", views=_ES),
)
_LIN = "(CASE WHEN {0} / 255.0::DOUBLE <= 0.03928 THEN {0} / 255.0::DOUBLE / 12.92 ELSE pow(({0} / 255.0::DOUBLE + 0.055) / 1.055, 2.4) END)".format
_LUM = lambda p: f"0.2126 * {_LIN(p + 'r')} + 0.7152 * {_LIN(p + 'g')} + 0.0722 * {_LIN(p + 'b')}"
_add(
    "focus_findings", _of(lambda t: elements.focus_findings(t.styles)),
    _elements(f"""SELECT page_id, pos, unnest(CASE WHEN changed THEN ['focus-visible', 'focus_appearance'] ELSE ['focus-visible'] END) AS rule_id, changed AS manual_review FROM (
      SELECT *, (a_outline_width, a_outline_style, a_box_shadow, a_r, a_g, a_b) IS DISTINCT FROM (b_outline_width, b_outline_style, b_box_shadow, b_r, b_g, b_b) AS changed FROM (SELECT *, {_LUM("b_")} AS lb, {_LUM("a_")} AS la FROM v_styles)
      WHERE NOT ((a_outline_width > 0 AND a_outline_style <> 'none' AND NOT (b_outline_width > 0 AND b_outline_style <> 'none')) OR (a_box_shadow <> 'none' AND a_box_shadow <> b_box_shadow) OR a_decoration <> b_decoration OR abs(la - lb) >= 0.1 OR (greatest(la, lb) + 0.05) / (least(la, lb) + 0.05) >= 3))""", views=("styles",)),
)
_add(
    "reflow", _of(lambda t: elements.reflow(t.elements.select("page_id", "pos", "tag").join(t.styles, ["page_id", "pos"]))),
    _elements(f"""SELECT page_id, pos, false AS manual_review FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY pos) AS rank FROM o WHERE NOT exempt AND NOT EXISTS (SELECT 1 FROM o a WHERE NOT a.exempt AND a.page_id = o.page_id AND a.pos = o.parent)) WHERE rank <= 25
    UNION ALL SELECT page_id, NULL, true FROM o GROUP BY page_id HAVING bool_and(exempt)""", f"o AS (SELECT s.page_id, s.pos, s.parent, tag IN {elements._in(elements.MAY_SCROLL)} OR exempt_within AS exempt FROM v_styles s JOIN v_elements e ON s.page_id = e.page_id AND s.pos = e.pos WHERE width > 0 AND height > 0 AND x + width > 322)", views=_ES),
)

# Traffic: requests, scripts, cookies and messages of a page
_T = ("traffic",)
_FLAGS = "flags AS (SELECT page_id, page_id % 3 = 0 AS has_privacy_link, page_id % 4 = 1 AS has_consent FROM (SELECT DISTINCT page_id FROM v_traffic))"


def _flags(t) -> DataFrame:
    return t.traffic.select("page_id").distinct().select("page_id", (F.col("page_id") % 3 == 0).alias("has_privacy_link"), (F.col("page_id") % 4 == 1).alias("has_consent"))


_add(
    "consent_findings", _of(lambda t: traffic.consent_findings(_flags(t))),
    _with(_FLAGS, views=_T) + "SELECT page_id, unnest(['privacy-policy-link', 'policy-privacy']) AS rule_id, unnest([false, true]) AS manual_review FROM flags WHERE NOT has_privacy_link UNION ALL SELECT page_id, unnest(['cookie-consent', 'policy-cookie']), unnest([false, true]) FROM flags WHERE NOT has_consent",
)
_values = dims.values_sql
_add(
    "trackers", _of(lambda t: traffic.trackers(t.traffic.where("kind = 'script'"))),
    _with(views=_T) + f"SELECT page_id, product, arg_max(url, pos) AS url FROM v_traffic JOIN ({_values(list(traffic.TRACKERS.items()), 'part, product')}) ON contains(lower(url), part) WHERE kind = 'script' GROUP BY page_id, product",
)
_add(
    "technologies", _of(lambda t: traffic.technologies(t.traffic.where("kind = 'script'"), t.traffic.where("pos = 0 AND page_id % 5 = 0").select("page_id", F.lit("WordPress 6.1").alias("generator")))),
    _with(views=_T) + f"""SELECT page_id, name, arg_min(category, o) AS category FROM (
      SELECT page_id, name, category, pos * 100 + i AS o FROM v_traffic JOIN ({_values([(i, *x) for i, x in enumerate(traffic.TECHNOLOGIES)], 'i, part, name, category')}) ON contains(lower(url), part) WHERE kind = 'script'
      UNION ALL SELECT page_id, 'WordPress', 'CMS / generator', -1 FROM v_traffic WHERE pos = 0 AND page_id % 5 = 0) GROUP BY page_id, name""",
)
_add(
    "cookies_review", _of(lambda t: traffic.cookies_review(t.traffic.where("kind = 'xhr'"), _flags(t))),
    _with(_FLAGS, views=_T) + "SELECT page_id, count(*) AS cookies, string_agg(CASE WHEN rank <= 30 THEN cookie END, ',' ORDER BY rank) AS names FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY pos) AS rank FROM v_traffic WHERE kind = 'xhr') JOIN flags USING (page_id) WHERE NOT has_privacy_link GROUP BY page_id",
)
_add(
    "cookie_inventory", _of(lambda t: traffic.cookie_inventory(t.traffic.select("page_id", "pos", "cookie"), 5)),
    _with(views=_T) + "SELECT page_id, pos, cookie, unnest(['privacy_cookies_review', 'cookies_information']) AS rule_id FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY pos) AS rank FROM v_traffic) WHERE rank <= 5",
)
_add(
    "javascript_errors", _of(lambda t: traffic.javascript_errors(t.traffic, 3)),
    _with(views=_T) + "SELECT page_id, rank, message, total FROM (SELECT page_id, message, row_number() OVER (PARTITION BY page_id ORDER BY pos) AS rank, count(*) OVER (PARTITION BY page_id) AS total FROM v_traffic WHERE level IN ('error', 'page')) WHERE rank <= 3",
)
_add("javascript_logs", _of(lambda t: traffic.javascript_logs(t.traffic)), _with(views=_T) + "SELECT page_id, level, count(*) AS messages FROM v_traffic WHERE level NOT IN ('error', 'page') GROUP BY page_id, level")
_add("missing_images", _of(lambda t: traffic.missing_images(t.traffic)), _with(views=_T) + "SELECT page_id, url, count(*) AS times, max(status) AS status FROM v_traffic WHERE kind = 'image' AND coalesce(status, 999) >= 400 GROUP BY page_id, url")
_add(
    "network_requests", _of(lambda t: traffic.network_requests(t.traffic, 2)),
    _with(views=_T) + """SELECT page_id, rank, domain, url, requests, total FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY first) AS rank, CAST(sum(requests) OVER (PARTITION BY page_id) AS BIGINT) AS total FROM (
      SELECT page_id, domain, min(pos) AS first, arg_min(url, pos) AS url, count(*) AS requests FROM v_traffic WHERE is_external GROUP BY page_id, domain)) WHERE rank <= 2""",
)

# Brand
_FONT = "CASE tag WHEN 'h1' THEN '\"Arial\", serif' WHEN 'p' THEN 'Comic Sans' WHEN 'a' THEN '''Palatino'', x' ELSE 'Helvetica Neue' END"
_add("unapproved_fonts", _of(lambda t: traffic.unapproved_fonts(t.elements.select("page_id", "pos", F.expr(_FONT.replace("'''Palatino'', x'", '"\'Palatino\', x"')).alias("font")))), _with(views=_E) + "SELECT page_id, pos, 'comic sans' AS font FROM v_elements WHERE tag = 'p'")
_add(
    "logo_missing", _of(lambda t: traffic.logo_missing(t.elements.where("tag = 'img'").select("page_id", F.when(F.col("pos") % 3 == 0, "/x/TTU-Logo.svg").otherwise(F.col("src")).alias("src"), "alt", F.when(F.col("pos") % 7 == 0, "Texas Tech").alias("title")), t.elements.select("page_id").distinct())),
    _with(views=_E) + "SELECT page_id, count(*) FILTER (tag = 'img') AS images FROM v_elements GROUP BY page_id HAVING count(*) FILTER (tag = 'img' AND (pos % 3 = 0 OR pos % 7 = 0)) = 0",
)
_BUTTON = ("CASE pos % 4 WHEN 0 THEN 'rgb(204, 0, 0)' WHEN 1 THEN 'transparent' WHEN 2 THEN 'rgb(255, 255, 255)' END", "CASE WHEN page_id % 2 = 0 THEN 'rgb(255, 255, 255)' END", "CASE WHEN page_id % 3 > 0 THEN '1px solid rgb(0, 0, 0)' END")
_add(
    "button_consistency", _of(lambda t: traffic.button_consistency(t.elements.where("tag = 'button'").select("page_id", *[F.expr(x).alias(n) for x, n in zip(_BUTTON, ("background", "color", "border"), strict=True)]))),
    _with(views=_E) + """SELECT page_id, count(*) FILTER (style = 1) AS "primary", count(*) FILTER (style = 2) AS secondary, count(*) FILTER (style = 3) AS unknown FROM (
      SELECT page_id, CASE WHEN pos % 4 = 0 AND page_id % 2 = 0 THEN 1 WHEN pos % 4 IN (1, 2) AND page_id % 3 > 0 THEN 2 ELSE 3 END AS style FROM v_elements WHERE tag = 'button') GROUP BY page_id HAVING unknown > 0""",
)
_add(
    "content_system", _of(lambda t: traffic.content_system(t.traffic.groupBy("page_id").agg(F.min("message").alias("generator"), F.concat_ws(" ", F.min(F.when(F.col("pos") % 4 == 3, "/wp-content/a.js")), F.min(F.when(F.col("pos") == 5, "/Drupal.js"))).alias("scripts")))),
    _with(views=_T) + "SELECT page_id, CASE WHEN max(CASE WHEN pos % 4 = 3 THEN 1 END) = 1 THEN 'WordPress' ELSE 'Drupal' END AS cms FROM v_traffic GROUP BY page_id HAVING max(CASE WHEN pos % 4 = 3 OR pos = 5 THEN 1 END) = 1",
)
