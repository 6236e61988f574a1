"""Crawl planning: depth over the link graph, admission, due sites, spacing, robots and sitemaps."""

from __future__ import annotations

from collections.abc import Iterator
from urllib.robotparser import RobotFileParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quillmark.functions.urls import document_extension, is_in_scope, is_renderable, matches_ignore, normalize_url
from quillmark.operators.scratch import written


def crawl_depth(links: DataFrame, roots: DataFrame, max_depth: int, max_pages: int | None = None) -> DataFrame:
    """Least number of links from a root to each URL, level by level.

    ``links`` has src and dst, ``roots`` url. Each level joins only the newest URLs
    with the links and drops those seen; the loop is bounded by ``max_depth``.
    """
    edges = links.select("src", "dst").where("src <> dst")
    seen = front = written(roots.select("url").distinct().withColumn("depth", F.lit(0)))
    for depth in range(1, max_depth + 1):
        # targets go by the same exchange to their copies and to what was seen of them
        new = front.join(edges, front["url"] == edges["src"]).select(F.col("dst").alias("url")).distinct().join(seen.select("url"), "url", "left_anti")
        front = written(new.withColumn("depth", F.lit(depth)))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    if max_pages is not None:
        seen = seen.orderBy("depth", "url").limit(max_pages)
    return seen


def admit_links(candidates: DataFrame, seen: DataFrame, max_depth: int, budget: int, roots: DataFrame | None = None, ignore: list[str] | None = None, allowed: DataFrame | None = None) -> DataFrame:
    """Links (site, url, depth) that a crawl takes up: the first ``budget`` new ones of each site by depth and URL.

    URLs are normalised; those must stay that are within depth, renderable and no
    document, in the scope of their site's root (``roots``: site, root_url), match no
    ``ignore`` pattern, are allowed by robots (``allowed``: url, allowed) and not seen.
    """
    url = F.col("url")
    rows = candidates.where(F.col("depth") <= max_depth).withColumn("url", normalize_url(url))
    rows = rows.where(is_renderable(url) & document_extension(url).isNull())
    rows = rows.where(~matches_ignore(url, ignore)) if ignore else rows
    if roots is not None:
        rows = rows.join(roots.select("site", "root_url"), "site").where(is_in_scope(url, F.col("root_url")))
    if allowed is not None:
        rows = rows.join(allowed.where("NOT allowed").select("url").distinct(), "url", "left_anti")
    new = rows.groupBy("site", "url").agg(F.min("depth").alias("depth")).join(seen.select("site", normalize_url(url).alias("url")), ["site", "url"], "left_anti")
    w = W.partitionBy("site").orderBy("depth", "url")
    return new.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= budget)


def collect_documents(links: DataFrame, domains: DataFrame, budget: int) -> DataFrame:
    """Linked documents (site, url, domain) on their site's registrable domain (site, domain), the first ``budget`` of each site."""
    docs = links.where(document_extension(F.col("url")).isNotNull()).join(domains.select("site", "domain"), ["site", "domain"]).select("site", normalize_url(F.col("url")).alias("url")).distinct()
    return docs.withColumn("rank", F.row_number().over(W.partitionBy("site").orderBy("url"))).where(F.col("rank") <= budget)


def registrable_domains(hosts: DataFrame, suffixes: DataFrame) -> DataFrame:
    """The registrable domain of each host (host): its longest public suffix (suffix) and one label more; the host itself without one.

    Each host is spread over its tails, at most one for each label, which meet the
    suffixes in an equi-join.
    """
    labels = F.split("host", r"\.")
    tails = hosts.select("host").distinct().select("host", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))), lambda i: F.struct(F.array_join(F.slice(labels, i + 1, F.size(labels)), ".").alias("suffix"), F.array_join(F.slice(labels, i, F.size(labels)), ".").alias("domain")))).alias("t"))
    best = tails.select("host", "t.*").join(suffixes.select("suffix").distinct(), "suffix").groupBy("host").agg(F.max_by("domain", F.length("suffix")).alias("domain"))
    return hosts.select("host").distinct().join(best, "host", "left").select("host", F.coalesce("domain", "host").alias("domain"))


def same_site(pairs: DataFrame, domains: DataFrame) -> DataFrame:
    """Pairs of hosts (a, b) with whether their registrable domains (host, domain) are equal."""
    of = lambda c: domains.select(F.col("host").alias(c), F.col("domain").alias("_" + c))
    return pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", (F.col("_a") == F.col("_b")).alias("same"))


def declared_sitemaps(robots: DataFrame, sites: DataFrame) -> DataFrame:
    """Sitemaps that a site's robots file (site, body) names, else /sitemap.xml under its root (site, root_url)."""
    lines = F.regexp_extract_all("body", F.lit(r"(?im)^[ \t]*sitemap[ \t]*:[ \t]*(\S+)"), F.lit(1))
    named = robots.select("site", F.explode(lines).alias("url")).distinct()
    rest = sites.join(named.select("site").distinct(), "site", "left_anti").select("site", F.concat(F.regexp_replace("root_url", "/+$", ""), F.lit("/sitemap.xml")).alias("url"))
    return named.unionByName(rest)


def match_site(runs: DataFrame, sites: DataFrame) -> DataFrame:
    """The first site whose root equals the run's but for case, spaces and slashes at the end."""
    key = lambda c: F.lower(F.regexp_replace(F.trim(c), "/+$", ""))
    first = sites.groupBy(key(F.col("root_url")).alias("k")).agg(F.min("site_id").alias("matched_site"))
    return runs.withColumn("k", key(F.col("root_url"))).join(first, "k", "left").drop("k")


def sites_due(sites: DataFrame, active: DataFrame, now: Column) -> DataFrame:
    """Forced, never scanned or scanned an interval (a day at least) ago, and no run is active."""
    due = F.col("force_rescan") | F.col("last_scanned_at").isNull() | (F.col("last_scanned_at") + F.make_dt_interval(F.greatest(F.col("recrawl_interval_days"), F.lit(1))) <= now)
    return sites.where(due).join(active.select("site_id").distinct(), "site_id", "left_anti")


def fetch_plan(requests: DataFrame, delay: float) -> DataFrame:
    """The start of each request (host, at in seconds, id), at least ``delay`` apart on a host.

    start(n) = n * delay + max over k <= n of (at(k) - k * delay): a running maximum instead of a loop.
    """
    w = W.partitionBy("host").orderBy("at", "id")
    n = F.row_number().over(w) - 1
    rows = requests.withColumn("_n", n).withColumn("_slack", F.col("at") - F.col("_n") * delay)
    start = F.max("_slack").over(w.rowsBetween(W.unboundedPreceding, W.currentRow)) + F.col("_n") * delay
    return rows.withColumn("start", start).drop("_n", "_slack")


def robots_allowed(urls: DataFrame, robots: DataFrame, agent: str = "*") -> DataFrame:
    """Whether each URL (host, url) may be fetched under its host's rules (host, body); no rules allow all."""

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, rules = None, None
        for pdf in batches:
            ok = []
            for url, body in zip(pdf["url"], pdf["body"], strict=True):
                if not isinstance(body, str):
                    ok.append(True)
                    continue
                if body != known:
                    known, rules = body, RobotFileParser()
                    rules.parse(body.splitlines())
                ok.append(rules.can_fetch(agent, url or ""))
            yield pd.DataFrame({"host": pdf["host"], "url": pdf["url"], "allowed": ok})

    return urls.select("host", "url").join(robots.select("host", "body"), "host", "left").mapInPandas(judge, "host string, url string, allowed boolean")


def sitemap_rows(bodies: DataFrame) -> DataFrame:
    """The locations of each sitemap (site, url, body); kind is url, sitemap or malformed."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for site, url, body in pdf.itertuples(index=False):
                try:
                    top = ElementTree.fromstring((body or "").strip())
                except ElementTree.ParseError:
                    rows.append((site, url, "malformed", None))
                    continue
                kind = "sitemap" if top.tag.endswith("sitemapindex") else "url"
                rows += [(site, url, kind, x.text.strip()) for x in top.iter() if x.tag.endswith("loc") and x.text]
            yield pd.DataFrame(rows, columns=["site", "url", "kind", "loc"])

    return bodies.select("site", "url", "body").mapInPandas(read, "site string, url string, kind string, loc string")


def sitemap_urls(bodies: DataFrame, seeds: DataFrame, levels: int = 3, most: int | None = 5000) -> DataFrame:
    """URLs reachable from the seed sitemaps (site, url) through at most ``levels`` indexes, the first ``most`` of a site or (None) all."""
    rows = sitemap_rows(bodies)
    now, found = seeds.select("site", "url"), None
    for _ in range(levels + 1):
        got = rows.join(now, ["site", "url"])
        part = got.where("kind = 'url'").select("site", F.col("loc").alias("url"))
        found = part if found is None else found.unionByName(part)
        now = got.where("kind = 'sitemap'").select("site", F.col("loc").alias("url")).distinct()
    if most is None:
        return found.distinct()
    w = W.partitionBy("site").orderBy("url")
    return found.distinct().withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most).select("site", "url")
