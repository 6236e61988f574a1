"""Page extraction: one tolerant parse of each page's HTML into typed signals.

The parse runs in ``mapInPandas`` over partitions; everything after it is column
expressions. Signals keep arrays of structs, so checks explode only what they need.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import unquote, urljoin

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIGNALS = (
    "page_id long, url string, title string, meta_description string, lang string, text string, "
    "headings array<struct<level int, text string>>, images array<struct<src string, alt string, decorative boolean>>, "
    "links array<struct<pos int, href string, url string, text string, target string, named boolean>>, ids array<string>, "
    "forms array<struct<action string, method string, n_fields int>>, tel array<string>, mailto array<string>, scripts array<string>, "
    "n_tables int, n_media int, structured boolean, has_nav boolean, has_search boolean"
)
_HIDDEN = {"script", "style", "noscript", "template", "head", "title"}
_BLOCKS = {"p", "div", "section", "article", "main", "li", "ul", "ol", "h1", "h2", "h3", "h4", "h5", "h6", "table", "tr", "br", "header", "footer", "nav", "aside", "form", "blockquote", "pre"}


class _Parser(HTMLParser):
    def __init__(self, url: str) -> None:
        super().__init__(convert_charrefs=True)
        self.url = url
        self.text: list[str] = []
        self.hidden: list[str] = []
        self.title: list[str] | None = None
        self.meta = self.lang = None
        self.headings: list[dict] = []
        self.images: list[dict] = []
        self.links: list[dict] = []
        self.ids: list[str] = []
        self.forms: list[dict] = []
        self.tel: list[str] = []
        self.mailto: list[str] = []
        self.scripts: list[str] = []
        self.n_tables = self.n_media = 0
        self.structured = self.has_nav = self.has_search = False
        self.heading: list[str] | None = None
        self.link: list[str] | None = None
        self.in_title = False

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        a = {k: v or "" for k, v in attrs}
        if "id" in a:
            self.ids.append(a["id"])
        elif tag == "a" and "name" in a:
            self.ids.append(a["name"])
        if tag in _HIDDEN:
            self.hidden.append(tag)
        if tag in _BLOCKS:
            self.text.append("\n")
        if "itemscope" in a or a.get("type") == "application/ld+json":
            self.structured = True
        if tag == "html":
            self.lang = a.get("lang")
        elif tag == "title" and self.title is None:
            self.title, self.in_title = [], True
        elif tag == "meta" and a.get("name", "").lower() == "description":
            self.meta = a.get("content", "")
        elif len(tag) == 2 and tag[0] == "h" and tag[1] in "123456":
            self.heading = []
            self.headings.append({"level": int(tag[1]), "text": self.heading})
        elif tag == "img":
            empty = a.get("alt") == "" or a.get("role") in ("presentation", "none") or a.get("aria-hidden") == "true"
            self.images.append({"src": a.get("src", ""), "alt": a.get("alt"), "decorative": empty})
            if self.link is not None:
                self.link.append(a.get("alt", ""))
        elif tag == "a" and "href" in a:
            href = a["href"].strip()
            self.link = [a.get("aria-label", "") or a.get("title", "")]
            try:
                full = urljoin(self.url, href)
            except ValueError:
                full = href
            self.links.append({"pos": len(self.links), "href": href, "url": full, "text": self.link, "target": a.get("target", ""), "named": bool(self.link[0])})
            for scheme, into in (("tel:", self.tel), ("mailto:", self.mailto)):
                if href.lower().startswith(scheme):
                    into.append(unquote(href[len(scheme) :].split("?")[0]))
        elif tag == "form":
            self.forms.append({"action": a.get("action", ""), "method": a.get("method", "get").lower(), "n_fields": 0})
        elif tag in ("input", "select", "textarea"):
            if self.forms:
                self.forms[-1]["n_fields"] += 1
            self.has_search |= a.get("type") == "search"
        elif tag == "script" and "src" in a:
            self.scripts.append(a["src"])
        elif tag == "table":
            self.n_tables += 1
        elif tag in ("video", "iframe", "canvas", "audio"):
            self.n_media += 1
        elif tag == "nav":
            self.has_nav = True

    def handle_endtag(self, tag: str) -> None:
        if tag in self.hidden:
            while self.hidden.pop() != tag:
                pass
        if tag in _BLOCKS:
            self.text.append("\n")
        if tag == "title":
            self.in_title = False
        elif tag == "a":
            self.link = None
        elif len(tag) == 2 and tag[0] == "h":
            self.heading = None

    def handle_data(self, data: str) -> None:
        if self.in_title and self.title is not None:
            self.title.append(data)
        if self.hidden:
            return
        self.text.append(data)
        for into in (self.heading, self.link):
            if into is not None:
                into.append(data)


def _squash(parts: list[str] | None) -> str:
    return " ".join("".join(parts or []).split())


def parse(page_id: int | None, url: str | None, html: str | None) -> dict:
    p = _Parser(url or "")
    p.feed(html or "")
    p.close()
    lines = [" ".join(x.split()) for x in "".join(p.text).split("\n")]
    return {
        "page_id": page_id, "url": url, "title": _squash(p.title), "meta_description": p.meta, "lang": p.lang, "text": "\n".join(x for x in lines if x),
        "headings": [{**h, "text": _squash(h["text"])} for h in p.headings], "images": p.images, "links": [{**x, "text": _squash(x["text"])[:100]} for x in p.links], "ids": p.ids,
        "forms": p.forms, "tel": p.tel, "mailto": p.mailto, "scripts": p.scripts, "n_tables": p.n_tables, "n_media": p.n_media, "structured": p.structured, "has_nav": p.has_nav, "has_search": p.has_search,
    }


def extract_signals(pages: DataFrame) -> DataFrame:
    """The signals of each page (page_id, url, html); null html gives empty signals."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), 256):
                part = pdf.iloc[at : at + 256].astype(object)
                part = part.where(part.notna(), None)
                yield pd.DataFrame([parse(*r) for r in part.itertuples(index=False)], columns=[c.split(" ")[0] for c in _columns()])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInPandas(run, SIGNALS)


def _columns() -> list[str]:
    out, depth, cur = [], 0, ""
    for ch in SIGNALS:
        depth += (ch == "<") - (ch == ">")
        if ch == "," and not depth:
            out.append(cur.strip())
            cur = ""
        else:
            cur += ch
    return [*out, cur.strip()]


def link_occurrences(signals: DataFrame) -> DataFrame:
    """One row for each anchor with an http(s) target."""
    return signals.select("page_id", F.explode("links").alias("l")).select("page_id", "l.pos", "l.url", "l.text").where(F.col("url").rlike("^https?://"))
