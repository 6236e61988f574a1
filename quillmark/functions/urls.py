"""URL functions as column expressions (B)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Tracking parameters that are dropped.
TRACKING = ["gclid", "fbclid", "dclid", "gclsrc", "gbraid", "wbraid", "msclkid", "mc_cid", "mc_eid", "igshid", "yclid", "_hsenc", "_hsmi", "vero_id", "oly_anon_id", "oly_enc_id"]
#: Extensions of documents.
DOCUMENTS = ["pdf", "doc", "docx", "rtf", "odt", "xls", "xlsx", "ods", "csv", "ppt", "pptx", "odp"]
#: Extensions that are never rendered.
SKIPPED = (
    "pdf jpg jpeg png gif svg webp ico avif zip rar 7z gz tar dmg exe pkg doc docx xls xlsx ppt pptx csv mp3 mp4 avi mov wav webm ogg m4a css js mjs json rss atom woff woff2 ttf eot otf".split()
)

_PARTS = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?"


def part(url: Column, i: int) -> Column:
    """1 scheme, 2 authority, 3 path, 4 query."""
    return F.regexp_extract(url, _PARTS, i)


def is_tracking_param(key: Column) -> Column:
    """B2: one of the tracking names or utm_ in front, whatever the case."""
    k = F.lower(key)
    return k.isin(TRACKING) | k.startswith("utm_")


def _pairs(query: Column) -> Column:
    cut = lambda x: F.struct(F.substring_index(x, "=", 1).alias("k"), F.when(F.contains(x, F.lit("=")), F.substring(x, F.locate("=", x) + 1, F.length(x))).otherwise("").alias("v"))
    decode = lambda c: F.coalesce(F.try_url_decode(c), c)
    raw = F.transform(F.filter(F.split(query, "&"), lambda x: x != ""), cut)
    return F.transform(raw, lambda p: F.struct(decode(p["k"]).alias("k"), decode(p["v"]).alias("v")))


def _encode(c: Column) -> Column:
    return F.replace(F.replace(F.url_encode(c), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def normalize_url(url: Column) -> Column:
    """B1 without a base: no fragment, lower scheme and host, no default port, no slash at the end, sorted query without tracking."""
    scheme, host = F.lower(part(url, 1)), F.lower(part(url, 2))
    host = F.when(scheme == "http", F.regexp_replace(host, ":80$", "")).when(scheme == "https", F.regexp_replace(host, ":443$", "")).otherwise(host)
    path = part(url, 3)
    path = F.when(path == "", "/").when(F.length(path) > 1, F.regexp_replace(path, "/+$", "")).otherwise(path)
    kept = F.array_sort(F.filter(_pairs(part(url, 4)), lambda p: ~is_tracking_param(p["k"])))
    query = F.array_join(F.transform(kept, lambda p: F.concat(_encode(p["k"]), F.lit("="), _encode(p["v"]))), "&")
    full = F.concat(scheme, F.lit("://"), host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))
    return F.when(F.regexp_like(url, F.lit(_PARTS)), full).otherwise(url)


def resolve_url(href: Column, base: Column) -> Column:
    """B1 with a base: a link as an absolute URL, with . and .. taken out of its path; then to be normalised."""
    href = F.trim(href)
    plain = F.regexp_replace(href, "#.*$", "")
    root = F.concat(part(base, 1), F.lit("://"), part(base, 2))
    path, query = F.regexp_replace(plain, r"\?.*$", ""), F.regexp_extract(plain, r"(\?.*)$", 1)
    folder = F.regexp_replace(part(base, 3), "[^/]*$", "")
    full = F.when(path == "", part(base, 3)).when(path.startswith("/"), path).otherwise(F.concat(F.when(folder == "", "/").otherwise(folder), path))
    last_dot = F.regexp_like(full, F.lit(r"/\.{1,2}$"))
    step = lambda done, x: F.when(x == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).when(x == ".", done).otherwise(F.concat(done, F.array(x)))
    clean = F.aggregate(F.slice(F.split(full, "/"), 2, 1_000_000), F.array().cast("array<string>"), step)
    joined = F.concat(F.lit("/"), F.array_join(clean, "/"), F.when(last_dot & (F.size(clean) > 0), "/").otherwise(""))
    kept = F.when((path == "") & (query == ""), F.regexp_extract(base, r"(\?[^#]*)", 1)).otherwise(query)
    return F.when(F.regexp_like(href, F.lit("^[A-Za-z][A-Za-z0-9+.-]*:")), href).when(href.startswith("//"), F.concat(part(base, 1), F.lit(":"), href)).otherwise(F.concat(root, joined, kept))


def normalize_sitemap_url(url: Column) -> Column:
    """Keeps the order of parameters and the port; drops utm_*, fbclid, gclid and path parameters."""
    path = F.regexp_replace(part(url, 3), ";.*$", "")
    path = F.when(path == "", "/").when(F.length(path) > 1, F.regexp_replace(path, "/+$", "")).otherwise(path)
    kept = F.filter(_pairs(part(url, 4)), lambda p: ~(F.lower(p["k"]).startswith("utm_") | F.lower(p["k"]).isin("fbclid", "gclid")))
    query = F.array_join(F.transform(kept, lambda p: F.concat(_encode(p["k"]), F.lit("="), _encode(p["v"]))), "&")
    return F.concat(F.lower(part(url, 1)), F.lit("://"), F.lower(part(url, 2)), path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))


def host_key(url: Column) -> Column:
    """The host without credentials, port and one leading www."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(part(url, 2)), "^.*@", ""), ":.*$", ""), r"^www\.", "")


def is_in_scope(url: Column, root: Column) -> Column:
    """On the root's host, at its path or below it."""
    u, r = normalize_url(url), normalize_url(root)
    base, path = part(r, 3), part(u, 3)
    below = (base == "/") | (path == base) | F.startswith(path, F.concat(base, F.lit("/")))
    return (host_key(u) == host_key(r)) & below


def document_extension(url: Column) -> Column:
    """The document extension that ends the path, else null."""
    found = F.regexp_extract(F.lower(url), r"^[^?#]*\.(" + "|".join(sorted(DOCUMENTS, key=len, reverse=True)) + r")(?:[?#]|$)", 1)
    return F.when(found != "", F.concat(F.lit("."), found))


def is_renderable(url: Column) -> Column:
    """http(s) without a skipped extension."""
    return F.rlike(F.lower(url), F.lit("^https?://")) & ~F.rlike(F.lower(part(url, 3)), F.lit(r"\.(" + "|".join(SKIPPED) + ")$"))


def matches_ignore(url: Column, patterns: list[str]) -> Column:
    """Any of the patterns occurs in the URL, whatever the case; patterns that do not compile are skipped."""
    import re

    good = []
    for p in patterns:
        try:
            re.compile(p)
            good.append(f"(?:{p})")
        except re.error:
            continue
    return F.rlike(url, F.lit("(?i)" + "|".join(good))) if good else F.lit(False)
