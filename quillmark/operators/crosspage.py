"""Checks across the pages of a run: duplicate titles, broken links, sitemaps (J)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quillmark.functions.urls import is_in_scope


def duplicate_titles(pages: DataFrame) -> DataFrame:
    """Pages whose non-blank title occurs more than once in their run.

    Titles are counted first and joined back; blank ones never form a group.
    """
    titled = pages.where("trim(coalesce(title, '')) <> ''")
    often = titled.groupBy("scan_id", "title").agg(F.count("*").alias("pages_with_title")).where("pages_with_title > 1")
    return titled.select("scan_id", "page_id", "title").join(often, ["scan_id", "title"])


def distinct_links(links: DataFrame) -> DataFrame:
    """Each http(s) URL once."""
    return links.where(F.col("url").rlike("^https?://")).select("url").distinct()


def link_verdict(status: Column) -> Column:
    """401 is fine (restricted), other codes from 400 and missing ones are broken."""
    return F.when(status.isNull(), "no answer").when(status == 401, "restricted").when(status >= 400, F.concat(F.lit("HTTP "), status.cast("string"))).otherwise("ok")


def is_broken(status: Column) -> Column:
    return status.isNull() | ((status >= 400) & (status != 401))


def link_confidence(status: Column) -> Column:
    """404, 410 and 400 are likely broken, the rest potentially."""
    return F.when(status.isin(404, 410, 400), "likely").otherwise("potential")


def broken_links(links: DataFrame, status: DataFrame) -> DataFrame:
    """For each page and broken URL its first text and the number of its occurrences; where links have selectors, the first one and their number.

    Only bad statuses are joined; links are counted by page and URL before.
    """
    bad = status.where(is_broken(F.col("status_code"))).select("url", "status_code")
    places = [F.min(F.when(F.col("selector").isNotNull(), F.struct("pos", "selector"))).alias("s"), F.count("selector").alias("selectors")] if "selector" in links.columns else []
    per = links.groupBy("page_id", "url").agg(F.min(F.struct("pos", "text")).alias("f"), F.count("*").alias("occurrences"), *places)
    more = [F.col("s.selector").alias("selector"), "selectors"] if places else []
    return per.join(bad, "url").select("page_id", "url", F.col("f.text").alias("text"), "occurrences", "status_code", link_verdict(F.col("status_code")).alias("reason"), *more)


def link_groups(broken: DataFrame) -> DataFrame:
    """Broken links by URL: pages, occurrences, confidence."""
    return broken.groupBy("url", "status_code").agg(F.count("*").alias("pages"), F.sum("occurrences").alias("occurrences")).withColumn("confidence", link_confidence(F.col("status_code")))


def missing_from_sitemap(crawled: DataFrame, sitemap: DataFrame, n: int = 500) -> DataFrame:
    """Crawled URLs absent from their site's sitemap, the first n of each site. Both have site and url."""
    gone = crawled.select("site", "url").distinct().join(sitemap.select("site", "url").distinct(), ["site", "url"], "left_anti")
    w = W.partitionBy("site").orderBy("url")
    return gone.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def split_external_links(links: DataFrame, root: Column) -> DataFrame:
    """http(s) links (page_id, url) out of the scope of the root, each once."""
    return links.where(F.col("url").rlike("^https?://") & ~is_in_scope(F.col("url"), root)).select("url").distinct()


def sitemap_findings(fetches: DataFrame) -> DataFrame:
    """Sites (site, url, status, kind, parsed) without a sitemap that answered, and sitemaps that did not parse.

    ``kind`` is root for the usual places and child for what an index lists; of the
    former the first that answered 200 counts, in the order of ``place``.
    """
    roots = fetches.where("kind = 'root'").groupBy("site").agg(F.min(F.when(F.col("status") == 200, F.struct("place", "url", "parsed"))).alias("r"))
    missing = roots.where("r IS NULL").select("site", F.lit("sitemap_missing").alias("rule_id"), F.lit(None).cast("string").alias("url"))
    broken = roots.where("r IS NOT NULL AND NOT r.parsed").select("site", F.lit("sitemap_malformed").alias("rule_id"), "r.url")
    good = roots.where("r.parsed").select("site")
    children = fetches.where("kind = 'child' AND (status IS NULL OR status <> 200 OR NOT parsed)").join(good, "site", "left_semi").select("site", F.lit("sitemap_malformed").alias("rule_id"), "url")
    return missing.unionByName(broken).unionByName(children)


def home_page(pages: DataFrame, root: Column) -> DataFrame:
    """The page equal to the root but for slashes at the end, else the first."""
    strip = lambda c: F.regexp_replace(c, "/+$", "")
    key = F.struct(F.when(strip(F.col("url")) == strip(root), 0).otherwise(1).alias("o"), "page_id")
    return pages.groupBy("scan_id").agg(F.min(key).alias("k")).select("scan_id", "k.page_id")
