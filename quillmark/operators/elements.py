"""Pages as a table of elements, and the checks on it.

One tolerant parse gives a row for each element: page_id, pos, last, depth, parent,
in_form, in_label (positions), tag, id, name, type, rel, role, href, src, alt, title, label
(aria-label), described (aria-describedby), target_for, autocomplete, placeholder,
action, method, content, tabindex, style, classes, attrs and filled (attribute names
between spaces, filled ones with a value), own (direct text) and text. ``pos`` to
``last`` is the interval of an element and all it holds, so "inside" is a join on
intervals (``inside``). A check is a predicate on a row, or a join within the page;
layout facts (boxes, computed styles) come as tables of their own.

Predicates are SQL texts, so that they can be read, joined into one pass and put
into other SQL. ``MATCH(x, 'p')`` stands for a regular expression search.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Callable, Iterator, Sequence
from html import unescape
from html.entities import html5
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

_LONGS = ("page_id", "pos", "last", "depth", "parent", "in_form", "in_label", "tabindex")
_STRINGS = ("tag", "id", "name", "type", "rel", "role", "href", "src", "alt", "title", "label", "described", "target_for", "autocomplete", "placeholder", "action", "method", "content", "style", "classes", "attrs", "filled", "own", "text")
ELEMENTS = ", ".join([f"{c} long" for c in _LONGS] + [f"{c} string" for c in _STRINGS])
TEXTS = "page_id long, n long, parent long, block long, text string"
#: Elements whose text is set off from what follows.
BLOCKS = {"p", "div", "li", "tr", "td", "th", "h1", "h2", "h3", "h4", "h5", "h6", "section", "article", "blockquote", "figcaption", "dt", "dd", "pre", "ul", "ol", "table", "form", "label", "option"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_FROM = {"label": "aria-label", "described": "aria-describedby", "target_for": "for", "classes": "class"}
_REFERENCE = re.compile(r"&(#[0-9]+;|#[xX][0-9a-fA-F]+;|[a-zA-Z][a-zA-Z0-9]*;)?")
#: Texts and tags that any reader takes in the same way; a page of nothing else, without scripts and styles, needs no tolerant one.
_TOKEN = r'<(/?)([a-zA-Z][a-zA-Z0-9]*)((?: [a-zA-Z][a-zA-Z0-9_-]*(?:="[^"]*")?)*+)>|([^<]+)'
_PLAIN_PAGE = re.compile(rf"(?:{_TOKEN})*+")
_PLAIN_TOKEN = re.compile(_TOKEN)
_PLAIN_ATTRIBUTE = re.compile(r' ([a-zA-Z][a-zA-Z0-9_-]*)(?:="([^"]*)")?')
_RAW = re.compile(r"<(?:script|style)\b|</[a-zA-Z0-9]+ ", re.IGNORECASE)
_SILENT = ("script", "style", "noscript", "template")


class _Rows(HTMLParser):
    """Rows of the elements of these tags (None: all) with these columns, or the texts."""

    def __init__(self, mark: str = "", tags: tuple[str, ...] | None = None, columns: tuple[str, ...] = _LONGS + _STRINGS, texts: bool = False) -> None:
        super().__init__(convert_charrefs=True)
        self.rows: list[dict] = []
        self.open: list[tuple[str, int, int | None, int | None, dict | None]] = []
        self.texts: list[dict] | None = [] if texts else None
        self.said: list[str] = []
        self.block = self.count = 0
        self.mark, self.tags, self.columns = mark, tags, columns
        self.given = [(c, _FROM.get(c, c)) for c in columns if c in _STRINGS]

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        pos, row, columns = self.count, None, self.columns
        self.count += 1
        # the form and the label around it come with the element that is open
        _, parent, form, label, _ = self.open[-1] if self.open else (None, None, None, None, None)
        if self.tags is None or tag in self.tags:
            a = {k: v or "" for k, v in attrs}
            row = {c: a.get(x) for c, x in self.given}
            row |= {"pos": pos, "last": pos, "depth": len(self.open), "parent": parent, "in_form": form, "in_label": label, "tag": tag, "type": a.get("type", "").lower(), "own": [], "text": (0, 0)}
            if "tabindex" in columns:
                tab = a.get("tabindex", "")
                row["tabindex"] = int(tab) if re.fullmatch(r"-?\d{1,9}", tab) else None
            if "attrs" in columns:
                told = [*a, *(f"{k}={v.lower()}" for k, v in a.items() if k in ("draggable", "aria-live", "aria-hidden", "aria-required", "target"))]
                row["attrs"] = f" {' '.join(told)} "
            if "filled" in columns:
                row["filled"] = f" {' '.join(k for k, v in a.items() if v)} "
            self.rows.append(row)
        if tag == "br" and self.texts is not None:
            self.texts.append({"n": len(self.texts), "parent": parent, "block": self.block, "text": "\n"})
        if tag not in _VOID:
            if row is not None:
                row["text"] = (len(self.said), None)
            self.open.append((tag, pos, pos if tag == "form" else form, pos if tag == "label" else label, row))

    def handle_endtag(self, tag: str) -> None:
        at = next((i for i in range(len(self.open) - 1, -1, -1) if self.open[i][0] == tag), -1)
        if at >= 0:
            self.shut(at)

    def shut(self, at: int) -> None:
        """Close the open elements from ``at`` on."""
        for tag, _, _, _, row in self.open[at:]:
            if row is not None:
                row["last"] = self.count - 1
                row["text"] = (row["text"][0], len(self.said))
            self.block += tag in BLOCKS
        del self.open[at:]

    def close(self) -> None:
        super().close()
        self.shut(0)

    def handle_data(self, data: str) -> None:
        if self.mark:  # left where no reference is decoded: in scripts and styles
            data = data.replace(self.mark, "&")
        if self.open:
            tag, pos, _, _, row = self.open[-1]
            if self.texts is not None:
                self.texts.append({"n": len(self.texts), "parent": pos, "block": self.block, "text": data})
            if row is not None:
                row["own"].append(data)
            if tag not in _SILENT:
                self.said.append(data)

    def take(self, html: str) -> None:
        """Read a whole page; what is plain needs no parser."""
        if _RAW.search(html) or not _PLAIN_PAGE.fullmatch(html):
            self.feed(html)
            self.close()
            return
        for shuts, tag, attrs, data in _PLAIN_TOKEN.findall(html):
            if data:
                self.handle_data(unescape(data) if "&" in data else data)
            elif shuts:
                self.handle_endtag(tag.lower())
            else:
                self.handle_starttag(tag.lower(), [(k.lower(), unescape(v) if "&" in v else v) for k, v in _PLAIN_ATTRIBUTE.findall(attrs)] if attrs else [])
        self.shut(0)


def _marked(html: str) -> tuple[str, str]:
    """The page with each & that begins no closed reference as one, and how that one is written: as the page writes none."""
    mark = "&#38;"
    while mark in html:
        mark = mark.replace("#", "#0")
    return _REFERENCE.sub(lambda m: m[0] if m[1] and (m[1][0] == "#" or m[1] in html5) else mark + (m[1] or ""), html), mark


def _read(html: str | None, closed: bool, *wanted, texts: bool = False) -> _Rows:
    html, mark = _marked(html) if closed and html and "&" in html else (html or "", "")
    p = _Rows(mark, *wanted, texts=texts)
    p.take(html)
    return p


def page_elements(html: str | None, closed: bool = False, tags: tuple[str, ...] | None = None, columns: tuple[str, ...] = _LONGS + _STRINGS) -> list[dict]:
    p = _read(html, closed, tags, columns)
    squash = lambda x: " ".join("".join(x).split())
    for r in p.rows:
        r["text"] = squash(p.said[slice(*r["text"])]) if "text" in columns else ""
        r["own"] = squash(r["own"])
    return p.rows


def page_texts(html: str | None, closed: bool = False) -> list[dict]:
    return _read(html, closed, texts=True).texts


def _batches(batches: Iterator[pa.RecordBatch], rows_of: Callable[[str | None], list[dict]], kinds: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows of each page with its page_id, some thousands at a time."""
    held: list[dict] = []
    for b in batches:
        for page, html in zip(b.column("page_id").to_pylist(), b.column("html"), strict=True):
            for row in rows_of(html.as_py()):
                row["page_id"] = page
                held.append(row)
            if len(held) > 4096:
                yield _columns(held, kinds)
                held = []
    if held:
        yield _columns(held, kinds)


def _columns(rows: list[dict], kinds: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[f.name] for r in rows], f.type) for f in kinds], schema=kinds)


def parse_texts(pages: DataFrame, closed: bool = False) -> DataFrame:
    """The texts of each page (page_id, html) in order: the element that each is in, and the number of blocks that ended before it. A br is a line feed. ``closed`` as for ``parse_elements``."""
    kinds = pa.schema([("page_id", pa.int64()), ("n", pa.int64()), ("parent", pa.int64()), ("block", pa.int64()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _batches(batches, functools.partial(page_texts, closed=closed), kinds)

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "html").mapInArrow(run, TEXTS)


def inside(rows: DataFrame, holders: DataFrame, at: str = "pos", how: str = "left_semi") -> DataFrame:
    """Rows (page_id, ``at``) whose element lies within one of the holders (page_id, pos, last); ``left_anti``: those outside all of them."""
    h = holders.select(F.col("page_id").alias("_page"), F.col("pos").alias("_from"), F.col("last").alias("_to"))
    return rows.join(h, (F.col("page_id") == F.col("_page")) & (F.col(at) >= F.col("_from")) & (F.col(at) <= F.col("_to")), how)


def main_element(elements: DataFrame) -> DataFrame:
    """The main part of each page (page_id, pos, last): the first main, role main or article, else the body."""
    main = F.col("tag").isin("main", "article") | (F.coalesce("role", F.lit("")) == "main")
    best = F.min(F.struct((~main).alias("_body"), "pos", "last")).alias("m")
    return elements.where(main | (F.col("tag") == "body")).groupBy("page_id").agg(best).select("page_id", "m.pos", "m.last")


def parse_elements(pages: DataFrame, closed: bool = False, tags: Sequence[str] | None = None, columns: Sequence[str] | None = None) -> DataFrame:
    """The elements of each page (page_id, html) in document order; null html has none.

    ``closed``: character references count only with their semicolon, else as browsers
    take them. ``tags`` and ``columns`` (beside page_id) are those that are needed;
    without them all are given.
    """
    named = ["page_id", *(c for c in _LONGS + _STRINGS if c != "page_id" and (columns is None or c in columns))]
    kinds = pa.schema([(c, pa.int64() if c in _LONGS else pa.string()) for c in named])
    rows_of = functools.partial(page_elements, closed=closed, tags=tuple(tags) if tags is not None else None, columns=tuple(named))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _batches(batches, rows_of, kinds)

    ddl = ", ".join(f"{c} {'long' if c in _LONGS else 'string'}" for c in named)
    return pages.select(F.col("page_id").cast("long").alias("page_id"), "html").mapInArrow(run, ddl)


def spark_sql(text: str) -> str:
    return text.replace("MATCH(", "regexp_like(").replace("\\", "\\\\")


def duckdb_sql(text: str) -> str:
    return text.replace("MATCH(", "regexp_matches(")


_CONTROL = "tag IN ('input', 'select', 'textarea')"
_NATIVE = "(tag = 'a' AND href IS NOT NULL OR tag IN ('button', 'input', 'select', 'textarea', 'summary', 'details'))"
_HEADING = "tag IN ('h1', 'h2', 'h3', 'h4', 'h5', 'h6')"
#: Fixed value: words that tell of a time limit.
TIME_LIMIT = r"(?i)\b(?:time(?:d|out| limit)|session (?:expires?|timeout)|inactiv(?:e|ity)|countdown|seconds? remaining)\b"
#: Fixed value: instructions that need colour, place or shape to be seen.
SENSORY = (
    r"(?i)\b(?:shown|marked|highlighted|displayed|indicated)\s+in\s+(?:red|green|blue|yellow|orange|purple|gray|grey)"
    r"|\b(?:red|green|blue|yellow|orange|purple|gray|grey)\s+(?:text|button|box|area|section|items?)"
    r"|\b(?:above|below|to the left|to the right)\s+(?:button|box|image|icon|link|section)|\b(?:round|circular|square|triangle|star)\s+(?:button|icon|symbol)"
)
#: Headings and labels that say nothing.
VAGUE_HEADINGS = ["click here", "learn more", "more", "read more", "details", "information", "info", "go", "continue", "next", "previous", "here", "section", "content"]
#: Titles that say nothing.
GENERIC_TITLES = ["home", "homepage", "untitled", "new page", "document"]
#: Link names, alternative texts and titles that say nothing.
VAGUE_LINKS = [
    "click here", "click", "here", "read more", "more", "learn more", "find out more", "more info", "more information", "details", "view", "view more", "see more", "continue", "go", "link", "this page", "download",
    "this link",
]
GENERIC_ALTS = ["image", "photo", "picture", "graphic", "icon"]
GENERIC_CONTENT_TITLES = ["home", "homepage", "untitled", "welcome", "page", "document"]
LABELABLE = ["input", "select", "textarea", "button", "meter", "output", "progress"]


def _has(*names: str, column: str = "attrs") -> str:
    return "(" + " OR ".join(f"contains({column}, ' {n} ')" for n in names) + ")"


def _in(words: list[str]) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


_HELP = r"(?i)\b(help|support|contact|faq|frequently asked|assistance|chat)\b"
_DECORATIVE = "(alt = '' OR coalesce(role, '') IN ('presentation', 'none') OR contains(attrs, ' aria-hidden=true '))"
_LINK_NAME = r"trim(regexp_replace(lower(trim(coalesce(nullif(label, ''), text, ''))), '[.>…→–—:-]+$', ''))"
#: rule, predicate on an element, impact, assisted, most findings a page
RULES: list[tuple[str, str, str, bool, int]] = [
    ("field_instructions", f"{_CONTROL} AND in_form IS NOT NULL AND type NOT IN ('hidden', 'submit', 'button', 'image', 'reset') AND ({_has('required', 'pattern', 'minlength', 'maxlength')} OR type IN ('email', 'tel')) AND NOT {_has('aria-describedby', 'title', 'placeholder', column='filled')}", "warning", True, 50),
    ("keyboard_functionality", f"{_has('onclick')} AND NOT {_NATIVE} AND NOT {_has('tabindex', 'role')}", "error", False, 100),
    ("consistent_help", f"(tag = 'a' AND href IS NOT NULL OR tag = 'button') AND (MATCH(concat_ws(' ', text, label, title), '{_HELP}') OR MATCH(coalesce(href, ''), '{_HELP}') OR MATCH(coalesce(href, ''), '(?i)^(mailto|tel):'))", "info", True, 50),
    ("drag_alternative", _has("draggable=true", "ondragstart", "ondrop"), "info", True, 50),
    ("pause_animated_content", f"tag IN ('marquee', 'blink') OR tag IN ('video', 'audio') AND {_has('autoplay')} OR contains(lower(coalesce(style, '')), 'animation')", "warning", True, 50),
    ("unusual_words_definitions", f"({_has('data-term')} OR MATCH(coalesce(classes, ''), '(^|\\s)(glossary-term|jargon)(\\s|$)')) AND NOT {_has('title', 'aria-describedby', column='filled')}", "info", True, 50),
    ("visual_presentation_text", r"MATCH(coalesce(style, ''), '(?i)(font-size|line-height|letter-spacing|word-spacing)\s*:[^;]+!important')", "info", True, 50),
    ("interruptions_suppressible", f"coalesce(role, '') IN ('alert', 'alertdialog') OR tag = 'dialog' AND {_has('open')} OR {_has('aria-live=assertive')}", "info", True, 50),
    ("consistent_navigation", "tag = 'nav' OR coalesce(role, '') = 'navigation'", "info", True, 20),
    ("abbreviations_meaning", f"tag IN ('abbr', 'acronym') AND NOT {_has('title')}", "info", True, 100),
    ("images_of_text", r"tag = 'img' AND MATCH(coalesce(alt, ''), '\S+\s+\S+\s+\S')", "info", True, 100),
    ("custom_tab_order", "tabindex > 0", "info", True, 100),
    ("three_flashes_a", "tag IN ('video', 'canvas', 'object', 'embed') OR tag = 'img' AND MATCH(coalesce(src, ''), '(?i)[.]gif$')", "info", True, 50),
    ("flashing_content_aaa", "tag IN ('video', 'canvas', 'object', 'embed') OR tag = 'img' AND MATCH(coalesce(src, ''), '(?i)[.]gif$')", "info", True, 50),
    ("decorative_images_review", f"tag = 'img' AND (alt = '' OR coalesce(role, '') IN ('presentation', 'none') OR {_has('aria-hidden=true')})", "info", True, 100),
    ("text_conveys_information", f"tag NOT IN ('script', 'style', 'noscript', 'template') AND MATCH(coalesce(own, ''), '{SENSORY}')", "info", True, 50),
    ("text_conveys_information_visual", f"(tag = 'canvas' OR tag = 'svg' AND NOT {_has('aria-label', 'aria-labelledby')} AND coalesce(role, '') <> 'presentation' AND coalesce(text, '') = '') AND NOT {_has('aria-hidden=true')}", "info", True, 50),
    ("headings_review", _HEADING, "info", True, 100),
    ("image-alt-content", f"tag = 'img' AND alt IS NULL AND NOT coalesce({_DECORATIVE}, false)", "serious", False, 1_000_000),
    ("image-alt-content_quality", f"tag = 'img' AND (length(trim(coalesce(alt, ''))) > 150 OR MATCH(lower(trim(coalesce(alt, ''))), '[.](jpe?g|png|gif|webp|svg)$') OR lower(trim(coalesce(alt, ''))) IN {_in(GENERIC_ALTS)})", "moderate", False, 1_000_000),
    ("placeholder_links", f"tag = 'a' AND (coalesce(href, '-') IN ('#', 'javascript:void(0)', 'javascript:void(0);', 'javascript:;') OR href IS NULL AND (coalesce(role, '') = 'button' OR {_has('onclick')}))", "info", False, 100),
    ("new_tab_disclosure", f"tag = 'a' AND href <> '' AND {_has('target=_blank')} AND NOT MATCH(lower(concat_ws(' ', text, label, title)), 'new tab|new window|opens? in')", "info", False, 1_000_000),
    ("link_purpose_unclear", f"tag = 'a' AND href <> '' AND {_LINK_NAME} IN {_in(VAGUE_LINKS)}", "warning", False, 100),
    ("favicon_review", "tag = 'link' AND MATCH(coalesce(rel, ''), '(?i)(^|\\s)(icon|shortcut)(\\s|$)')", "warning", True, 10),
]


def element_findings(elements: DataFrame) -> DataFrame:
    """One pass over the elements, then the caps of each page and rule."""
    hits = F.array_compact(F.array(*[F.when(F.expr(spark_sql(p)), F.struct(F.lit(r).alias("rule_id"), F.lit(i).alias("impact"), F.lit(m).alias("manual_review"), F.lit(cap).alias("cap"))) for r, p, i, m, cap in RULES]))
    rows = elements.select("page_id", "pos", "tag", "text", F.explode(hits).alias("h")).select("page_id", "pos", "tag", "text", "h.*")
    hidden = elements.where("contains(attrs, ' hidden ')").select("page_id", "pos", "last", F.lit("text_conveys_information").alias("_rule"))
    rows = rows.join(hidden.withColumnsRenamed({"page_id": "_page", "pos": "_from"}), F.expr("page_id = _page AND rule_id = _rule AND pos BETWEEN _from AND last"), "left_anti")
    rank = F.row_number().over(W.partitionBy("page_id", "rule_id").orderBy("pos"))
    rows = rows.withColumn("rank", rank).where("rank <= cap")
    return rows.select("page_id", "pos", F.regexp_replace("rule_id", "_visual$|_quality$", "").alias("rule_id"), "impact", "manual_review", F.coalesce("text", F.lit("")).alias("detail"))


def table_summary(elements: DataFrame) -> DataFrame:
    """pages with tables that have neither a summary nor a description: how many of how many."""
    lacks = F.expr(f"NOT {_has('summary', 'aria-describedby', column='filled')}")
    return elements.where("tag = 'table'").groupBy("page_id").agg(F.count("*").alias("tables"), F.count_if(lacks).alias("without")).where("without > 0")


def fieldset_legend(elements: DataFrame) -> DataFrame:
    """fieldsets without a legend with text right inside."""
    legends = elements.where("tag = 'legend' AND text <> ''").select("page_id", F.col("parent").alias("pos"))
    return elements.where("tag = 'fieldset'").select("page_id", "pos").join(legends, ["page_id", "pos"], "left_anti")


def label_findings(elements: DataFrame) -> DataFrame:
    """labels for an id that the page lacks, for something that takes no label, or without any control."""
    labels = elements.where("tag = 'label'")
    ids = elements.where("id <> ''").groupBy("page_id", "id").agg(F.min(F.struct("pos", "tag", F.coalesce("role", F.lit("")).alias("role"))).alias("t"))
    aimed = labels.where("target_for IS NOT NULL").join(ids.withColumnRenamed("id", "target_for"), ["page_id", "target_for"], "left")
    rule = F.when(F.col("t").isNull(), "label_orphan_for").when(~F.col("t.tag").isin(LABELABLE) & (F.col("t.role") != "textbox"), "label_misuse")
    inside = elements.where(F.col("tag").isin(LABELABLE)).select("page_id", F.col("in_label").alias("pos"))
    loose = labels.where("target_for IS NULL AND text <> ''").join(inside, ["page_id", "pos"], "left_anti")
    both = aimed.select("page_id", "pos", rule.alias("rule_id")).where("rule_id IS NOT NULL").unionByName(loose.select("page_id", "pos", F.lit("label_misuse").alias("rule_id")))
    return both


def context_sensitive_help(elements: DataFrame) -> DataFrame:
    """forms with neither a link to help nor words of it, and the number of their fields."""
    links = elements.where(F.expr(spark_sql("tag = 'a' AND in_form IS NOT NULL AND MATCH(coalesce(href, ''), 'help|contact|support|faq')"))).select("page_id", F.col("in_form").alias("pos"))
    fields = elements.where(f"{_CONTROL} AND in_form IS NOT NULL").groupBy("page_id", F.col("in_form").alias("pos")).agg(F.count("*").alias("fields"))
    forms = elements.where(F.expr(spark_sql(r"tag = 'form' AND NOT MATCH(lower(coalesce(text, '')), '\b(help|contact us|questions|support)\b')"))).select("page_id", "pos")
    return forms.join(links, ["page_id", "pos"], "left_anti").join(fields, ["page_id", "pos"], "left").select("page_id", "pos", F.coalesce("fields", F.lit(0)).alias("fields"))


def page_titles(elements: DataFrame, pages: DataFrame) -> DataFrame:
    """pages (page_id) whose title is missing, under 4 characters or generic."""
    titles = elements.where("tag = 'title'").groupBy("page_id").agg(F.min_by("text", "pos").alias("title"))
    title = F.coalesce("title", F.lit(""))
    return pages.select("page_id").join(titles, "page_id", "left").select("page_id", title.alias("title")).where((F.length("title") < 4) | F.lower("title").isin(GENERIC_TITLES))


def time_limits(elements: DataFrame) -> DataFrame:
    """the first element of a page that speaks of a time limit, as two findings."""
    first = elements.where(F.expr(spark_sql(f"tag NOT IN ('html', 'head', 'body', 'title', 'script', 'style') AND MATCH(coalesce(text, ''), '{TIME_LIMIT}')"))).groupBy("page_id").agg(F.min("pos").alias("pos"))
    return first.select("page_id", "pos", F.explode(F.array(F.lit("inactivity_data_loss"), F.lit("timing_not_essential"))).alias("rule_id"))


def consistent_identification(elements: DataFrame) -> DataFrame:
    """links with another name than the first link of their page to the same place."""
    name = F.when(F.trim(F.coalesce("text", F.lit(""))) != "", F.trim("text")).otherwise(F.trim(F.coalesce("label", F.lit(""))))
    links = elements.where("tag = 'a' AND href <> ''").select("page_id", "pos", "href", name.alias("name")).where("name <> ''")
    first = links.groupBy("page_id", "href").agg(F.min_by("name", "pos").alias("first_name"))
    return links.join(first, ["page_id", "href"]).where("name <> first_name")


def headings_labels_descriptive(elements: DataFrame, most: int = 200) -> DataFrame:
    """Of a page's first headings and labels those that are empty, vague, or (headings) duplicated."""
    rows = elements.where(f"{_HEADING} OR tag IN ('label', 'legend')").select("page_id", "pos", "tag", F.lower(F.coalesce("text", F.lit(""))).alias("text"))
    many = rows.where("text <> ''").groupBy("page_id", "text").agg(F.count("*").alias("many"))
    ranked = rows.withColumn("rank", F.row_number().over(W.partitionBy("page_id").orderBy("pos"))).where(F.col("rank") <= most)
    vague = F.col("text").isin(VAGUE_HEADINGS) | F.col("text").rlike(r"^(?:section|item|heading|content)\s*\d*$")
    reason = F.when(F.col("text") == "", "empty").when(vague, "vague").when(F.col("tag").startswith("h") & (F.col("many") > 1), "duplicated")
    return ranked.join(many, ["page_id", "text"], "left").select("page_id", "pos", "tag", reason.alias("reason")).where("reason IS NOT NULL")


def heading_order(elements: DataFrame) -> DataFrame:
    """Pages with headings but no h1 (pos null), and headings more than one level below the one before."""
    rows = elements.where(_HEADING).select("page_id", "pos", F.substring("tag", 2, 1).cast("int").alias("level"))
    jumps = rows.withColumn("before", F.lag("level").over(W.partitionBy("page_id").orderBy("pos"))).where("level > before + 1").select("page_id", "pos")
    headless = rows.groupBy("page_id").agg(F.min("level").alias("least")).where("least > 1").select("page_id", F.lit(None).cast("long").alias("pos"))
    return jumps.unionByName(headless)


def page_level(elements: DataFrame) -> DataFrame:
    """Pages whose title is missing, short, generic or long, that are thin (few words and no media in the main part), or have several h1 (the first five texts of which are kept)."""
    media = inside(elements.where("tag IN ('video', 'iframe', 'canvas')").select("page_id", "pos"), main_element(elements)).groupBy("page_id").agg(F.lit(True).alias("media"))
    words = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"\S+"))
    h1 = F.when(F.col("tag") == "h1", F.struct("pos", F.substring(F.coalesce("text", F.lit("")), 1, 80).alias("text")))
    per = elements.groupBy("page_id").agg(
        F.min(F.when(F.col("tag") == "title", F.struct("pos", "text"))).alias("t"), F.max(F.when(F.col("tag") == "body", words)).alias("words"),
        F.count(h1).alias("n_h1"), F.slice(F.array_sort(F.collect_list(h1)), 1, 5).alias("first_h1"),
    ).join(media, "page_id", "left").withColumn("media", F.coalesce("media", F.lit(False)))
    title = F.trim(F.coalesce("t.text", F.lit("")))
    bad = (F.length(title) < 10) | F.lower(title).isin(GENERIC_CONTENT_TITLES)
    rules = [
        ("page-title", bad, title), ("title_too_long", F.length(title) > 60, title), ("thin_pages", (F.coalesce("words", F.lit(0)) < 300) & ~F.col("media"), F.coalesce("words", F.lit(0)).cast("string")),
        ("multiple_h1", F.col("n_h1") > 1, F.concat(F.col("n_h1").cast("string"), F.lit(": "), F.array_join("first_h1.text", " | "))),
    ]
    found = F.array_compact(F.array(*[F.when(c, F.struct(F.lit(r).alias("rule_id"), d.alias("detail"))) for r, c, d in rules]))
    return per.select("page_id", F.explode(found).alias("f")).select("page_id", "f.*")


def link_no_text(elements: DataFrame) -> DataFrame:
    """Links without text, label, title or an image inside that has alternative text."""
    images = elements.where("tag = 'img' AND trim(alt) <> ''").select("page_id", F.col("parent").alias("pos"))
    links = elements.where("tag = 'a' AND href <> '' AND coalesce(text, '') = '' AND coalesce(label, '') = '' AND coalesce(title, '') = ''").select("page_id", "pos")
    return links.join(images, ["page_id", "pos"], "left_anti")


def broken_anchor_links(elements: DataFrame) -> DataFrame:
    """Links to a place in their page that no id or name has."""
    marks = elements.select("page_id", F.explode(F.array_compact(F.array("id", "name"))).alias("mark")).distinct()
    links = elements.where(F.col("href").rlike("^#.+") & (F.col("tag") == "a")).select("page_id", "pos", F.expr("substring(href, 2)").alias("mark"))
    return links.join(marks, ["page_id", "mark"], "left_anti")


def style_findings(elements: DataFrame, styles: DataFrame) -> DataFrame:
    """elements with their captured styles (page_id, pos, no_border, same_background, no_outline, css_order, width, height)."""
    control = f"{_CONTROL} AND type NOT IN ('hidden', 'submit', 'button', 'image', 'reset', 'checkbox', 'radio', 'range', 'color', 'file') AND no_border AND same_background AND no_outline"
    small = f"({_NATIVE} OR coalesce(role, '') IN ('button', 'link') OR tabindex IS NOT NULL) AND width > 0 AND height > 0 AND (width < 44 OR height < 44)"
    rules = [("control_contrast", control), ("meaningful_sequence", "css_order <> 0"), ("large_interactive_controls", small)]
    hits = F.array_compact(F.array(*[F.when(F.expr(p), F.lit(r)) for r, p in rules]))
    rows = elements.join(styles, ["page_id", "pos"]).select("page_id", "pos", F.explode(hits).alias("rule_id"))
    return rows.withColumn("rank", F.row_number().over(W.partitionBy("page_id", "rule_id").orderBy("pos"))).where("rank <= CASE WHEN rule_id = 'control_contrast' THEN 50 ELSE 100 END").drop("rank")


def _luminance(r: str, g: str, b: str):
    lin = lambda c: F.when(F.col(c) / 255.0 <= 0.03928, F.col(c) / 255.0 / 12.92).otherwise(F.pow((F.col(c) / 255.0 + 0.055) / 1.055, 2.4))
    return 0.2126 * lin(r) + 0.7152 * lin(g) + 0.0722 * lin(b)


def focus_findings(styles: DataFrame, luminance: float = 0.10, contrast: float = 3.0) -> DataFrame:
    """focusable elements without a visible change on focus.

    styles: page_id, pos, and before (b_) and after (a_) focus: outline_width,
    outline_style, box_shadow, decoration, r, g, b. No change is a violation; a
    change below the thresholds needs review, and is one for focus appearance too.
    """
    shows = lambda p: (F.col(p + "outline_width") > 0) & (F.col(p + "outline_style") != "none")
    strong = (shows("a_") & ~shows("b_")) | ((F.col("a_box_shadow") != "none") & (F.col("a_box_shadow") != F.col("b_box_shadow")))
    lb, la = _luminance("b_r", "b_g", "b_b"), _luminance("a_r", "a_g", "a_b")
    ratio = (F.greatest(la, lb) + 0.05) / (F.least(la, lb) + 0.05)
    passes = strong | (F.col("a_decoration") != F.col("b_decoration")) | (F.abs(la - lb) >= luminance) | (ratio >= contrast)
    parts = ("outline_width", "outline_style", "box_shadow", "r", "g", "b")
    changed = F.lit(False)
    for c in parts:
        changed = changed | ~F.col("a_" + c).eqNullSafe(F.col("b_" + c))
    one = lambda rule, review: F.struct(F.lit(rule).alias("rule_id"), F.lit(review).alias("manual_review"))
    found = F.when(changed, F.array(one("focus-visible", True), one("focus_appearance", True))).otherwise(F.array(one("focus-visible", False)))
    return styles.where(~passes).select("page_id", "pos", F.explode(found).alias("f")).select("page_id", "pos", "f.*")


#: Content that may scroll in two directions.
MAY_SCROLL = ["table", "thead", "tbody", "tfoot", "tr", "td", "th", "pre", "code", "canvas", "video", "img", "svg", "iframe", "embed", "object", "map"]


def reflow(boxes: DataFrame, width: float = 320.0, tolerance: float = 2.0, most: int = 25) -> DataFrame:
    """boxes (page_id, pos, parent, tag, exempt_within, x, width, height) that stick out of a narrow page.

    The outermost ones that are not exempt are violations (pos, assisted false); a
    page where only exempt content sticks out needs review (pos null).
    """
    out = boxes.where((F.col("width") > 0) & (F.col("height") > 0) & (F.col("x") + F.col("width") > width + tolerance))
    out = out.select("page_id", "pos", "parent", (F.col("tag").isin(MAY_SCROLL) | F.col("exempt_within")).alias("exempt"))
    above = out.where("NOT exempt").select("page_id", F.col("pos").alias("parent"))
    found = out.where("NOT exempt").join(above, ["page_id", "parent"], "left_anti").select("page_id", "pos")
    found = found.withColumn("rank", F.row_number().over(W.partitionBy("page_id").orderBy("pos"))).where(F.col("rank") <= most)
    only = out.groupBy("page_id").agg(F.bool_and("exempt").alias("only")).where("only")
    return found.select("page_id", "pos", F.lit(False).alias("manual_review")).unionByName(only.select("page_id", F.lit(None).cast("long").alias("pos"), F.lit(True).alias("manual_review")))
