"""What pages are made of (C2, C3, C4, C9-C11, G15), from elements that carry their intervals, and the checks of a page in one table.

``parse_elements`` and ``parse_texts`` give the rows; the rest is joins: an ancestor is
an element whose interval holds the other, the main text is the text inside the main
part and outside navigation, and a field's label is the first of six that exists.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quillmark.operators import elements as el

#: Parts of a page that are no content of its own.
AROUND = "tag IN ('nav', 'header', 'footer', 'aside', 'script', 'style', 'noscript') OR coalesce(role, '') IN ('navigation', 'banner', 'contentinfo') OR contains(attrs, ' hidden ')"
#: Types of fields that ask for personal data.
SENSITIVE = ["password", "email", "tel", "number", "date", "file"]
#: Where a link to privacy information or a consent banner is known by.
PRIVACY_TEXT, PRIVACY_HREF = "privacy|data protection|gdpr|ccpa", "privacy|gdpr|data-protection"
BANNER_NAMES = ["cookie-banner", "cookie-consent"]
BANNER_CLASSES = [*BANNER_NAMES, "cookie-notice", "cookiebar"]
BANNER_IDS = ["onetrust-banner-sdk", "cookieConsent"]
BANNER_TAGS = ["div", "section", "aside", "footer"]


def ancestors(elements: DataFrame) -> DataFrame:
    """Rows (page_id, pos, up): each element with itself and each element that holds it."""
    up = elements.select(F.col("page_id").alias("_page"), F.col("pos").alias("up"), F.col("last").alias("_to"))
    return elements.select("page_id", "pos").join(up, (F.col("page_id") == F.col("_page")) & F.col("pos").between(F.col("up"), F.col("_to"))).select("page_id", "pos", "up")


def selectors(elements: DataFrame) -> DataFrame:
    """A CSS path (page_id, pos, selector) for each element, from its nearest ancestor with an id on."""
    place = W.partitionBy("page_id", "parent", "tag")
    nth = F.when(F.count("*").over(place) > 1, F.concat(F.lit(":nth-of-type("), F.row_number().over(place.orderBy("pos")), F.lit(")"))).otherwise(F.lit(""))
    named = F.when(F.col("id") != "", F.concat(F.lit("#"), "id"))
    part = elements.select("page_id", F.col("pos").alias("up"), F.coalesce(named, F.concat("tag", nth)).alias("part"), named.isNotNull().alias("named"))
    rows = ancestors(elements).join(part, ["page_id", "up"]).groupBy("page_id", "pos")
    rows = rows.agg(F.max(F.when(F.col("named"), F.col("up"))).alias("start"), F.array_sort(F.collect_list(F.struct("up", "part"))).alias("path"))
    path = F.filter("path", lambda p: p["up"] >= F.coalesce(F.col("start"), F.lit(-1)))
    return rows.select("page_id", "pos", F.array_join(F.transform(path, lambda p: p["part"]), " > ").alias("selector"))


def _blocks(texts: DataFrame, by: list[str]) -> DataFrame:
    """Texts of a page joined: in order within a block, an empty line between blocks, runs of spaces as one."""
    block = texts.groupBy(*by, "block").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "text"))), lambda t: t["text"]), "").alias("t"))
    lines = F.transform(F.split("t", "\n"), lambda x: F.trim(F.regexp_replace(x, r"[ \t\r\f ]+", " ")))
    block = block.withColumn("t", F.array_join(F.filter(lines, lambda x: x != ""), "\n")).where("t <> ''")
    return block.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "t"))), lambda b: b["t"]), "\n\n").alias("text"))


def main_text(elements: DataFrame, texts: DataFrame) -> DataFrame:
    """The text (page_id, text) of each page's main part without navigation, headers, footers, sidebars and hidden parts; pages without any have none."""
    around = elements.where(AROUND).unionByName(el.inside(elements.where("tag IN ('title', 'desc')"), elements.where("tag = 'svg'")))
    kept = el.inside(el.inside(texts, el.main_element(elements), "parent"), around, "parent", "left_anti")
    return _blocks(kept, ["page_id"])


def navigation_text(elements: DataFrame) -> DataFrame:
    """The texts of navigation, and the alternative texts of images, each joined by ". " (page_id, nav_text, alt_text)."""
    nav = F.when((F.col("tag") == "nav") | (F.coalesce("role", F.lit("")) == "navigation"), F.col("text"))
    alt = F.when(F.col("tag") == "img", F.trim("alt"))
    told = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(c != "", F.struct("pos", c.alias("t"))))), lambda x: x["t"]), ". ")
    return elements.groupBy("page_id").agg(told(nav).alias("nav_text"), told(alt).alias("alt_text")).where("nav_text <> '' OR alt_text <> ''")


#: What the forms of a page are read from: tags and columns of elements.
FORM_TAGS = ("form", "label", "input", "select", "textarea")
FORM_COLUMNS = ("page_id", "pos", "in_form", "in_label", "tag", "id", "name", "type", "label", "target_for", "placeholder", "action", "method", "attrs", "text")
_IS_FIELD = "tag IN ('input', 'select', 'textarea')"


def _labelled(elements: DataFrame) -> DataFrame:
    """Forms and their fields (page_id, form, pos, tag, name, required, type, label, field, action, method): field counts the fields of a form and is null for the form.

    The elements go by page once; all that follows is within a page.
    """
    rows = elements.where(f"tag IN ('form', 'label') OR {_IS_FIELD} AND in_form IS NOT NULL").select(*FORM_COLUMNS).repartition("page_id")
    is_label, is_field = F.col("tag") == "label", F.expr(_IS_FIELD)
    # a label meets its fields under the id that it names, and those inside it under its place
    aim = F.when(is_label, F.when(F.col("target_for") != "", F.col("target_for"))).otherwise(F.when(is_field & (F.col("id") != ""), F.col("id")))
    around = F.when(is_label, F.col("pos")).otherwise(F.when(is_field, F.col("in_label")))
    rows = rows.withColumns({"_aim": aim, "_in": around})
    rows = rows.withColumn("_aimed", F.min(F.when(is_label & F.col("_aim").isNotNull(), F.struct("pos", "text"))).over(W.partitionBy("page_id", "_aim"))["text"])
    rows = rows.withColumn("_around", F.max(F.when(is_label, F.col("text"))).over(W.partitionBy("page_id", "_in"))).where(~is_label)
    found = F.coalesce(*[F.when(F.trim(c) != "", F.col(c)) for c in ("_aimed", "_around", "label", "placeholder", "name", "id")], F.lit(""))
    before = W.partitionBy("page_id", "form").orderBy("pos").rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = rows.withColumns({
        "label": F.substring(F.trim(F.regexp_replace(found, r"\s+", " ")), 1, 120), "required": F.expr("contains(attrs, ' required ') OR contains(attrs, ' aria-required=true ')"),
        "type": F.coalesce(F.when(F.col("type") != "", F.col("type")), "tag"), "form": F.when(is_field, F.col("in_form")).otherwise(F.col("pos")),
    })
    return rows.withColumn("field", F.when(is_field, F.count_if(is_field).over(before).cast("int"))).select("page_id", "form", "pos", "tag", "name", "required", "type", "label", "field", "action", "method")


def form_fields(elements: DataFrame) -> DataFrame:
    """C4: the fields of forms (page_id, form, pos, name, required, type, label, field).

    The label is the first that is not empty of: a label for the field's id, a label
    around it, aria-label, placeholder, name, id.
    """
    return _labelled(elements).where("field IS NOT NULL").select("page_id", "form", "pos", "name", "required", "type", "label", "field")


def page_forms(elements: DataFrame, most_names: int = 50, most_fields: int = 30) -> DataFrame:
    """C4: each form of a page: action, method, n_fields, sensitive (types, in order of their names), names (the first 50) and fields (the first 30 with label, required and type)."""
    is_field, form = F.col("field").isNotNull(), F.struct("action", "method")
    per = _labelled(elements).groupBy("page_id", F.col("form").alias("pos")).agg(
        F.count_if(is_field).alias("n_fields"), F.max(F.when(~is_field, form)).alias("f"),
        F.array_sort(F.collect_set(F.when(is_field & F.col("type").isin(SENSITIVE), F.col("type")))).alias("sensitive"),
        F.slice(F.array_sort(F.collect_list(F.when(is_field & (F.col("name") != ""), F.struct("field", "name")))), 1, most_names)["name"].alias("names"),
        F.array_sort(F.collect_list(F.when(F.col("field") <= most_fields, F.struct("field", "label", "required", "type")))).alias("fields"),
    ).where("f IS NOT NULL")
    some = lambda c: F.when(F.col("n_fields") > 0, F.col(c)).alias(c)
    action, method = F.substring(F.coalesce("f.action", F.lit("")), 1, 300), F.lower(F.coalesce(F.when(F.col("f.method") != "", F.col("f.method")), F.lit("get")))
    return per.select("page_id", "pos", action.alias("action"), method.alias("method"), "n_fields", some("sensitive"), some("names"), some("fields"))


def form_findings(forms: DataFrame) -> DataFrame:
    """A finding of each kind for every page with forms (page_id, rule_id, impact, manual_review, forms, sensitive)."""
    types = F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce("sensitive", F.array().cast("array<string>"))))))
    per = forms.groupBy("page_id").agg(F.count("*").alias("forms"), F.array_join(types, ",").alias("sensitive"))
    kinds = F.array(*[F.struct(F.lit(r).alias("rule_id"), F.lit(i).alias("impact")) for r, i in (("form_data_review", "serious"), ("forms_inventory", "minor"))])
    return per.select("page_id", F.explode(kinds).alias("k"), "forms", "sensitive").select("page_id", "k.*", F.lit(True).alias("manual_review"), "forms", "sensitive")


def consent_signals(elements: DataFrame, longest: int = 2000) -> DataFrame:
    """C11: of each page whether it links to privacy information, and whether it has a consent banner: by the names that vendors use, else by an element that speaks of cookies and consent."""
    e = elements.withColumns({"_t": F.lower(F.coalesce("text", F.lit(""))), "_c": F.coalesce("classes", F.lit("")), "_i": F.coalesce("id", F.lit("")), "_l": F.lower(F.coalesce("label", F.lit(""))), "_r": F.coalesce("role", F.lit(""))})
    has = lambda c, words: F.col(c).rlike("|".join(words))
    privacy = (F.col("tag") == "a") & F.col("href").isNotNull() & (F.col("_t").rlike(PRIVACY_TEXT) | F.lower("href").rlike(PRIVACY_HREF))
    vendor = F.col("_i").isin(BANNER_IDS) | has("_c", BANNER_CLASSES) | has("_i", BANNER_NAMES) | F.col("_l").contains("cookie")
    said = F.col("_t").contains("cookie") & F.col("_t").rlike("accept|consent|agree") & (F.length("_t") < longest)
    words = (F.col("tag").isin(BANNER_TAGS) | F.col("_r").isin("dialog", "alertdialog")) & said
    return e.groupBy("page_id").agg(F.bool_or(F.coalesce(privacy, F.lit(False))).alias("has_privacy_link"), F.bool_or(vendor | words).alias("has_consent"))


def visible_text(elements: DataFrame) -> DataFrame:
    return elements.where("tag = 'body'").groupBy("page_id").agg(F.min_by("text", "pos").alias("text"))


#: How telephone numbers and addresses are written.
PHONE = r"(?:\+?1[-.\s]?)?(?:\(\d{3}\)\s?|\d{3}[-.\s])\d{3}[-.\s]?\d{4}"
EMAIL = r"[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}"
_KINDS = {"phone_numbers_exposed": (PHONE, "tel:", r"\d"), "email_addresses_exposed": (EMAIL, "mailto:", rf"^(?:{EMAIL})$")}


def exposed_contacts(elements: DataFrame) -> DataFrame:
    """The numbers and addresses (page_id, rule_id, value, rank) that a page's text shows or its links lead to, each once whatever its case, texts first."""
    text = visible_text(elements)
    links = elements.where("tag = 'a' AND href IS NOT NULL").select("page_id", "pos", F.trim("href").alias("href"))
    rows = None
    for rule, (pattern, scheme, valid) in _KINDS.items():
        shown = text.select("page_id", F.posexplode(F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).alias("at", "value")).select("page_id", F.lit(0).alias("source"), F.col("at").cast("long").alias("at"), "value")
        # a plus stands for itself in these links
        led = F.split(F.expr(f"try_url_decode(replace(substring(href, {len(scheme) + 1}), '+', '%2B'))"), r"\?")[0]
        led = links.where(F.lower("href").startswith(scheme)).select("page_id", F.lit(1).alias("source"), F.col("pos").alias("at"), F.trim(led).alias("value")).where(F.col("value").rlike(valid))
        both = shown.unionByName(led).withColumn("rule_id", F.lit(rule))
        rows = both if rows is None else rows.unionByName(both)
    place = F.struct("source", "at")
    once = rows.withColumn("value", F.trim("value")).groupBy("page_id", "rule_id", F.lower("value").alias("_k")).agg(F.min_by("value", place).alias("value"), F.min(place).alias("_p"))
    return once.select("page_id", "rule_id", "value", F.row_number().over(W.partitionBy("page_id", "rule_id").orderBy("_p")).alias("rank"))


def contact_findings(contacts: DataFrame, most: int = 200) -> DataFrame:
    """One finding for each page and kind: how many values, and the first of them."""
    values = F.transform(F.array_sort(F.collect_list(F.when(F.col("rank") <= most, F.struct("rank", "value")))), lambda v: v["value"])
    return contacts.groupBy("page_id", "rule_id").agg(F.count("*").alias("count"), F.array_join(values, ", ").alias("detail"))


def _once(rule: str, impact: str, detail: Column) -> list[Column]:
    return [F.lit(None).cast("long").alias("pos"), F.lit(rule).alias("rule_id"), F.lit(impact).alias("impact"), F.lit(False).alias("manual_review"), detail.alias("detail")]


def page_findings(elements: DataFrame, pages: DataFrame) -> DataFrame:
    """E1-E20, F1-F4, F6-F10, F13-F18, F20-F26, G2, G15-G17 of each page (page_id, url): page_id, pos, rule_id, impact, manual_review, detail. One version of each rule: that of ``elements``."""
    none = F.lit("")
    rows = el.element_findings(elements)

    def add(df: DataFrame, rule: Column | str, impact: str, review: bool = False, detail: Column = none) -> None:
        nonlocal rows
        pos = F.col("pos") if "pos" in df.columns else F.lit(None).cast("long").alias("pos")
        rows = rows.unionByName(df.select("page_id", pos, (F.lit(rule) if isinstance(rule, str) else rule).alias("rule_id"), F.lit(impact).alias("impact"), F.lit(review).alias("manual_review"), detail.alias("detail")))

    add(el.heading_order(elements), "heading-order-content", "moderate")
    add(el.page_level(elements), F.col("rule_id"), "moderate", detail=F.col("detail"))
    add(el.headings_labels_descriptive(elements), "headings_labels_descriptive", "moderate", detail=F.col("reason"))
    add(el.link_no_text(elements), "link_no_text", "serious")
    add(el.broken_anchor_links(elements), "broken_anchor_links", "minor", detail=F.col("mark"))
    add(el.table_summary(elements), "table_summary", "minor", detail=F.col("without").cast("string"))
    add(el.fieldset_legend(elements), "fieldset_legend", "serious")
    add(el.label_findings(elements), F.col("rule_id"), "serious")
    add(el.context_sensitive_help(elements), "context_sensitive_help", "minor", True)
    add(el.page_titles(elements, pages), "page_title_accessibility", "serious", detail=F.col("title"))
    add(el.time_limits(elements), F.col("rule_id"), "minor", True)
    add(el.consistent_identification(elements), "consistent_identification", "minor", True, F.col("name"))
    add(contact_findings(exposed_contacts(elements)), F.col("rule_id"), "minor", True, F.col("detail"))
    add(elements.where("tag = 'form'").groupBy("page_id").agg(F.count("*").alias("n")), "forms_inventory", "minor", True, F.col("n").cast("string"))
    add(pages.select("page_id").join(consent_signals(elements).where("has_privacy_link"), "page_id", "left_anti"), "privacy-policy-link", "serious")
    has = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    whole = elements.groupBy("page_id").agg(
        F.min(F.when((F.col("tag") == "meta") & (F.lower("name") == "description"), F.struct("pos", F.coalesce("content", none).alias("content")))).alias("meta"),
        F.min(F.when(F.col("tag") == "html", F.struct("pos", F.expr("contains(filled, ' lang ')").alias("lang")))).alias("html"),
        has(F.expr("contains(attrs, ' itemscope ') OR tag = 'script' AND type = 'application/ld+json'")).alias("structured"),
        (has(F.expr("type = 'search' OR role = 'search'")).cast("int") + has(F.expr("tag = 'nav' OR role = 'navigation'")).cast("int") + has((F.col("tag") == "a") & F.lower(F.concat_ws(" ", "text", "href")).rlike("sitemap|site map")).cast("int")).alias("ways"),
    )
    path = F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    p = pages.select("page_id", path.alias("path")).join(whole, "page_id", "left")
    short = F.col("meta.content").isNull() | (F.length(F.trim("meta.content")) < 60)
    rules = [
        ("meta_description_too_short", short, "moderate", F.coalesce("meta.content", none)), ("structured_data_missing", ~F.coalesce("structured", F.lit(False)), "minor", none), ("html-has-lang", ~F.coalesce("html.lang", F.lit(False)), "serious", none),
        ("url_file_extension", F.col("path").rlike(r"(?i)\.(html?|php|aspx?|cfm|jsp)$"), "minor", F.col("path")), ("url_underscores", F.col("path").contains("_"), "minor", F.col("path")), ("multiple_ways", F.coalesce("ways", F.lit(0)) < 2, "moderate", F.coalesce("ways", F.lit(0)).cast("string")),
    ]
    found = F.array_compact(F.array(*[F.when(when, F.struct(*_once(r, i, d))) for r, when, i, d in rules]))
    return rows.unionByName(p.select("page_id", F.explode(found).alias("f")).select("page_id", "f.*"))
