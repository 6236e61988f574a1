"""Constant dimensions: knobs, weights, bands, categories and the rule catalogue.

Fixed values, stated as they must be for equal scores. Each becomes a tiny frame;
joins with them broadcast, as their size never depends on the data.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

IMPACT_WEIGHTS = {"critical": 1.0, "serious": 0.8, "moderate": 0.5, "minor": 0.3}
UNKNOWN_IMPACT = 0.5
IMPACT_RANK = {"critical": 0, "serious": 1, "moderate": 2, "minor": 3}
BUCKETS = {"critical": "error", "serious": "error", "moderate": "warning", "minor": "info"}
LEVEL_WEIGHTS = {"A": 1.0, "AA": 1.0, "AAA": 0.05}
BEST_PRACTICE = 0.1
BLEND_PCT, BLEND_SEVERITY = 0.35, 0.65
DEFAULT_WORST, DEFAULT_MAX = 6.0, 12.0
ERROR_PAGE_MAX = 5
BANDS = [(29, "Very poor"), (49, "Poor"), (59, "Fair"), (79, "Good"), (89, "Great"), (100, "Excellent")]
ACTIVE_CATEGORIES = ["accessibility", "content", "marketing", "ux", "privacy", "Brand Standards"]

#: rule, worst value, most points
KNOBS = {
    "color-contrast": (6.0, 15.0),
    "image-alt": (6.0, 15.0),
    "link-name": (5.0, 12.0),
    "reflow": (3.0, 14.0),
    "focus-visible": (6.0, 14.0),
    "target-size": (8.0, 12.0),
    "broken-links": (12.0, 12.0),
    "spelling": (15.0, 12.0),
    "grammar": (80.0, 10.0),
    "readability": (1.0, 10.0),
    "page-title": (1.0, 15.0),
    "placeholder_links": (10.0, 5.0),
    "new_tab_disclosure": (10.0, 5.0),
    "heading-order-content": (3.0, 12.0),
    "image-alt-content": (5.0, 15.0),
    "csp_missing": (100.0, 10.0),
    "cookie_ssl": (100.0, 10.0),
    "privacy_enhanced": (100.0, 10.0),
    "hsts": (1.0, 10.0),
    "privacy-policy-link": (1.0, 10.0),
    "cookie-consent": (100.0, 10.0),
    "trackers": (3.0, 5.0),
    "sitemap_missing": (1.0, 10.0),
    "sitemap_malformed": (1.0, 5.0),
    "page_missing_from_sitemap": (1.0, 0.0),
    "url_file_extension": (50.0, 5.0),
    "thin_pages": (10.0, 6.0),
    "title_too_long": (50.0, 5.0),
    "meta_description_too_short": (1.0, 10.0),
    "missing_images": (20.0, 8.0),
    "javascript_errors": (50.0, 8.0),
    "cookies_review": (100.0, 10.0),
    "policy-privacy": (1.0, 10.0),
    "policy-cookie": (1.0, 10.0),
    "accessibility_statement_present": (100.0, 20.0),
    "emergency_info_linked": (100.0, 10.0),
    "emergency_contact_present": (100.0, 5.0),
    "brand_logo_present": (100.0, 15.0),
    "server_response_time": (30.0, 2.5),
    "technology": (1.0, 0.0),
}

#: rule, category, subcategory, criterion, level, version
RULES = [
    ("color-contrast", "accessibility", "Perceivable", "1.4.3", "AA", "2.0"),
    ("image-alt", "accessibility", "Perceivable", "1.1.1", "A", "2.0"),
    ("link-name", "accessibility", "Operable", "2.4.4", "A", "2.0"),
    ("reflow", "accessibility", "Perceivable", "1.4.10", "AA", "2.1"),
    ("focus-visible", "accessibility", "Operable", "2.4.7", "AA", "2.0"),
    ("target-size", "accessibility", "Operable", "2.5.8", "AA", "2.2"),
    ("focus_appearance", "accessibility", "Operable", "2.4.13", "AAA", "2.2"),
    ("button-name", "accessibility", "Robust", "4.1.2", "A", "2.0"),
    ("html-has-lang", "accessibility", "Understandable", "3.1.1", "A", "2.0"),
    ("label", "accessibility", "Robust", "4.1.2", "A", "2.0"),
    ("fieldset_legend", "accessibility", "Perceivable", "1.3.1", "A", "2.0"),
    ("label_orphan_for", "accessibility", "Perceivable", "1.3.1", "A", "2.0"),
    ("label_misuse", "accessibility", "Perceivable", "1.3.1", "A", "2.0"),
    ("keyboard_functionality", "accessibility", "Operable", "2.1.1", "A", "2.0"),
    ("reading_level_aaa", "accessibility", "Understandable", "3.1.5", "AAA", "2.0"),
    ("region", "accessibility", "Structure", None, None, None),
    ("broken-links", "content", "Links", None, None, None),
    ("spelling", "content", "Writing", None, None, None),
    ("grammar", "content", "Grammar", None, None, None),
    ("readability", "content", "Writing", None, None, None),
    ("page-title", "content", "Page information", None, None, None),
    ("placeholder_links", "content", "Broken links", None, None, None),
    ("new_tab_disclosure", "content", "Links", None, None, None),
    ("image-alt-content", "content", "Images", None, None, None),
    ("meta_description_too_short", "content", "Page information", None, None, None),
    ("url_file_extension", "marketing", "Technical optimization", None, None, None),
    ("title_too_long", "marketing", "Content optimization", None, None, None),
    ("duplicate_title", "marketing", "Content optimization", None, None, None),
    ("heading-order-content", "ux", "Structure", None, None, None),
    ("server_response_time", "ux", "Web Vitals", None, None, None),
    ("javascript_errors", "ux", "Functionality", None, None, None),
    ("missing_images", "ux", "Functionality", None, None, None),
    ("hsts", "privacy", "Transport", None, None, None),
    ("csp_missing", "privacy", "Security", None, None, None),
    ("cookie_ssl", "privacy", "Security", None, None, None),
    ("privacy-policy-link", "privacy", "Disclosure", None, None, None),
    ("cookie-consent", "privacy", "Consent", None, None, None),
    ("trackers", "privacy", "Tracking", None, None, None),
    ("policy-privacy", "policies", "Legal", None, None, None),
    ("brand_logo_present", "Brand Standards", "Logo Usage", None, None, None),
]


@dataclass
class ScoringConfig:
    """The knobs of the score; users change a copy."""

    impact_weights: dict[str, float] = field(default_factory=lambda: dict(IMPACT_WEIGHTS))
    level_weights: dict[str, float] = field(default_factory=lambda: dict(LEVEL_WEIGHTS))
    knobs: dict[str, tuple[float, float]] = field(default_factory=lambda: dict(KNOBS))
    bands: list[tuple[int, str]] = field(default_factory=lambda: list(BANDS))
    active: list[str] = field(default_factory=lambda: list(ACTIVE_CATEGORIES))


def knobs(spark: SparkSession, cfg: ScoringConfig) -> DataFrame:
    return spark.createDataFrame([(k, *v) for k, v in cfg.knobs.items()], "rule_id string, worst_value double, max_impact double")


def rules(spark: SparkSession) -> DataFrame:
    rows = [(i, *r, r[1] == "accessibility" and r[4] is None) for i, r in enumerate(RULES)]
    return spark.createDataFrame(rows, "rule_no int, rule_id string, category string, subcategory string, criterion_id string, wcag_level string, wcag_version string, is_best_practice boolean")


def entries(rows: DataFrame, columns: list[str]) -> Column:
    """A handful of fixed rows as an array of structs, to be exploded next to each row of another frame."""
    kinds = dict(rows.dtypes)
    cells = [F.struct(*[F.lit(r[c]).cast(kinds[c]).alias(c) for c in columns]) for r in rows.select(*columns).collect()]
    return F.array(*cells) if cells else F.array().cast("array<struct<" + ", ".join(f"`{c}`: {kinds[c]}" for c in columns) + ">>")


def values_sql(rows: list[tuple], columns: str) -> str:
    """The rows as a SQL table expression, for DuckDB and Spark alike."""
    cell = lambda v: "CAST(NULL AS VARCHAR(99))" if v is None else f"'{v}'" if isinstance(v, str) else str(v).lower() if isinstance(v, bool) else repr(v)
    names = columns.split(",")
    return " UNION ALL ".join("SELECT " + ", ".join(f"{cell(v)} AS {n.strip()}" for v, n in zip(r, names, strict=True)) for r in rows)
