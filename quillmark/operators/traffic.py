"""Checks on what a page sends and loads (G3-G5, G10-G14, G18) and on brand evidence.

Requests, scripts, cookies and console messages are rows (page_id, pos, ...), not
arrays of a page, so a busy page is no large row and every check is a filter, a
join with a fixed list, or an aggregate with map-side combining.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Parts of script addresses and the products they tell of.
TRACKERS = {
    "google-analytics.com": "Google Analytics",
    "googletagmanager.com": "Google Tag Manager",
    "doubleclick.net": "Google Ads",
    "facebook.net": "Meta Pixel",
    "connect.facebook": "Meta Pixel",
    "hotjar.com": "Hotjar",
    "segment.com": "Segment",
    "mixpanel.com": "Mixpanel",
    "clarity.ms": "Microsoft Clarity",
    "amplitude.com": "Amplitude",
    "fullstory.com": "FullStory",
    "matomo": "Matomo",
}
#: Parts of script addresses, technology and its category.
TECHNOLOGIES = [
    ("jquery", "jQuery", "JavaScript library"),
    ("bootstrap", "Bootstrap", "UI framework"),
    ("cloudflare", "Cloudflare", "CDN"),
    ("jsdelivr", "jsDelivr", "CDN"),
    ("unpkg.com", "unpkg", "CDN"),
    ("gtag/js", "Google Analytics", "Analytics"),
    ("googletagmanager", "Google Tag Manager", "Tag manager"),
    ("hotjar", "Hotjar", "Analytics"),
    ("wp-content", "WordPress", "CMS"),
    ("wp-includes", "WordPress", "CMS"),
    ("shopify", "Shopify", "E-commerce"),
    ("hubspot", "HubSpot", "Marketing"),
    ("stripe.com", "Stripe", "Payments"),
]
#: Content systems by what their pages carry, the first that matches.
SYSTEMS = [("Cascade CMS", "cascade"), ("WordPress", "wordpress|wp-content|wp-includes"), ("Drupal", "drupal")]
APPROVED_FONTS = ["knockout", "palatino linotype", "palatino", "book antiqua", "arial", "helvetica", "helvetica neue", "sans-serif", "serif"]
LOGO_FILES = ["ttu-logo", "double-t", "texas-tech-logo", "ttu_logo"]
LOGO_NAMES = ["texas tech", "ttu", "double t"]


def consent_findings(pages: DataFrame) -> DataFrame:
    """Pages (page_id, has_privacy_link, has_consent) that lack either, as two findings each."""
    pair = lambda scored, review: F.array(*[F.struct(F.lit(r).alias("rule_id"), F.lit(m).alias("manual_review")) for r, m in ((scored, False), (review, True))])
    none = F.array().cast("array<struct<rule_id string, manual_review boolean>>")
    found = F.concat(F.when(~F.col("has_privacy_link"), pair("privacy-policy-link", "policy-privacy")).otherwise(none), F.when(~F.col("has_consent"), pair("cookie-consent", "policy-cookie")).otherwise(none))
    return pages.select("page_id", F.explode(found).alias("f")).select("page_id", "f.*")


def trackers(scripts: DataFrame) -> DataFrame:
    """Products of tracker scripts (page_id, pos, url): each once for a page, with its last address."""
    low = F.lower("url")
    names = F.array_distinct(F.array_compact(F.array(*[F.when(F.contains(low, F.lit(part)), F.lit(name)) for part, name in TRACKERS.items()])))
    rows = scripts.select("page_id", "pos", "url", F.explode(names).alias("product"))
    return rows.groupBy("page_id", "product").agg(F.max_by("url", "pos").alias("url"))


def technologies(scripts: DataFrame, generators: DataFrame | None = None) -> DataFrame:
    """Technologies of a page with one category each; a generator (page_id, generator) comes before scripts, in their order."""
    low = F.lower("url")
    hits = F.array_compact(F.array(*[F.when(F.contains(low, F.lit(part)), F.struct(F.lit(i).alias("i"), F.lit(n).alias("name"), F.lit(c).alias("category"))) for i, (part, n, c) in enumerate(TECHNOLOGIES)]))
    rows = scripts.select("page_id", "pos", F.explode(hits).alias("h")).select("page_id", F.struct("pos", "h.i").alias("at"), "h.name", "h.category")
    if generators is not None:
        first = generators.where("generator <> ''").select("page_id", F.struct(F.lit(-1).cast("long").alias("pos"), F.lit(0).alias("i")).alias("at"), F.split("generator", r"\s+")[0].alias("name"), F.lit("CMS / generator").alias("category"))
        rows = first.unionByName(rows)
    return rows.groupBy("page_id", "name").agg(F.min_by("category", "at").alias("category"))


def cookies_review(cookies: DataFrame, pages: DataFrame, most: int = 30) -> DataFrame:
    """Pages without a privacy link (page_id, has_privacy_link) that set cookies (page_id, pos, cookie): how many, and the first names."""
    ranked = cookies.withColumn("rank", F.row_number().over(W.partitionBy("page_id").orderBy("pos")))
    found = ranked.groupBy("page_id").agg(F.count("*").alias("cookies"), F.array_sort(F.collect_list(F.when(F.col("rank") <= most, F.struct("rank", "cookie")))).alias("first"))
    return found.join(pages.where("NOT has_privacy_link").select("page_id"), "page_id").select("page_id", "cookies", F.array_join(F.transform("first", lambda x: x["cookie"]), ",").alias("names"))


def cookie_inventory(cookies: DataFrame, most: int = 100) -> DataFrame:
    """The first cookies of each page under both rules that list them."""
    ranked = cookies.withColumn("rank", F.row_number().over(W.partitionBy("page_id").orderBy("pos"))).where(F.col("rank") <= most)
    return ranked.select("page_id", "pos", "cookie", F.explode(F.array(F.lit("privacy_cookies_review"), F.lit("cookies_information"))).alias("rule_id"))


def javascript_errors(messages: DataFrame, most: int = 50) -> DataFrame:
    """Page errors and console errors (page_id, pos, level, message): all counted, the first kept."""
    rows = messages.where("level IN ('error', 'page')")
    ranked = rows.withColumn("rank", F.row_number().over(W.partitionBy("page_id").orderBy("pos"))).withColumn("total", F.count("*").over(W.partitionBy("page_id")))
    return ranked.where(F.col("rank") <= most).select("page_id", "rank", "message", "total")


def javascript_logs(messages: DataFrame) -> DataFrame:
    """Console messages of each page and level that are no errors."""
    return messages.where("level IN ('warning', 'log', 'info', 'debug')").groupBy("page_id", "level").agg(F.count("*").alias("messages"))


def missing_images(requests: DataFrame) -> DataFrame:
    """Image requests (page_id, url, kind, status) that failed or got no answer."""
    return requests.where("kind = 'image' AND (status IS NULL OR status >= 400)").groupBy("page_id", "url").agg(F.count("*").alias("times"), F.max("status").alias("status"))


def network_requests(requests: DataFrame, most: int = 50) -> DataFrame:
    """External domains of each page: first request, number of requests; the first domains, and how many requests go out in all."""
    per = requests.where("is_external").groupBy("page_id", "domain").agg(F.min("pos").alias("pos"), F.min_by("url", "pos").alias("url"), F.count("*").alias("requests"))
    w = W.partitionBy("page_id")
    ranked = per.withColumn("rank", F.row_number().over(w.orderBy("pos"))).withColumn("total", F.sum("requests").over(w))
    return ranked.where(F.col("rank") <= most).select("page_id", "rank", "domain", "url", "requests", "total")


def unapproved_fonts(texts: DataFrame, approved: list[str] = APPROVED_FONTS) -> DataFrame:
    """Elements (page_id, pos, font) whose first font family is none of the approved."""
    first = F.lower(F.trim(F.translate(F.split("font", ",")[0], "\"'", "")))
    return texts.select("page_id", "pos", first.alias("font")).where(~F.col("font").isin(approved))


def logo_missing(images: DataFrame, pages: DataFrame) -> DataFrame:
    """Pages (page_id) none of whose images (page_id, src, alt, title) is the institution's logo, and how many they have."""
    has = lambda c, words: F.lower(F.coalesce(c, F.lit(""))).rlike("|".join(words))
    logo = has("src", LOGO_FILES) | has("alt", LOGO_NAMES) | has("title", LOGO_NAMES[:1])
    found = images.groupBy("page_id").agg(F.count("*").alias("images"), F.bool_or(logo).alias("logo"))
    return pages.select("page_id").join(found, "page_id", "left").where("NOT coalesce(logo, false)").select("page_id", F.coalesce("images", F.lit(0)).alias("images"))


def button_consistency(buttons: DataFrame) -> DataFrame:
    """Pages with a button (page_id, background, color, border) in neither style, and their buttons by style."""
    squeeze = lambda c: F.replace(F.coalesce(c, F.lit("")), F.lit(" "), F.lit(""))
    bg, fg, border = squeeze("background"), squeeze("color"), squeeze("border")
    primary = F.contains(bg, F.lit("204,0,0")) & F.contains(fg, F.lit("255,255,255"))
    secondary = (F.contains(bg, F.lit("transparent")) | F.contains(bg, F.lit("255,255,255"))) & F.contains(border, F.lit("0,0,0"))
    n = lambda c: F.count_if(c)
    per = buttons.groupBy("page_id").agg(n(primary).alias("primary"), n(~primary & secondary).alias("secondary"), n(~primary & ~secondary).alias("unknown"))
    return per.where("unknown > 0")


def content_system(pages: DataFrame) -> DataFrame:
    """The content system that the generator or scripts (page_id, generator, scripts) tell of."""
    text = F.lower(F.concat_ws(" ", "generator", "scripts"))
    name = F.when(F.lit(False), F.lit(""))
    for system, pattern in SYSTEMS:
        name = name.when(text.rlike(pattern), system)
    return pages.select("page_id", name.alias("cms")).where("cms IS NOT NULL")
