"""Operator 8, HTML extraction by differencing against the page of the nearest URL.

Pages are ordered by host and path; of the neighbours on the same host the one with
the smaller edit distance of paths is the partner. Both pages become text lines
(one for each block), the lines are aligned by a longest common subsequence, and
shared lines are deleted: what a site repeats is not the article.

Differencing alone is not right on pages whose menus, notices and footers are drawn
anew for each page: there it deletes few of them, and passages that two articles
quote go. So the markup has a say too. Lines in menus, headers, footers, sidebars, forms, notices, adverts and comments go even
if the partner lacks them (not those in a form around the whole page, nor in a layout
that is named after its sidebar or header); lines inside ``article`` or ``main`` stay even if the
partner quotes the same passage; a page that has such an element is that element.
The output counts the lines that went since the partner has them, those that only
the markup deleted, and the shared ones that an article kept.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import with_neighbours

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?>[^>\"']+|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)",
    re.S,
)
_ATTR = re.compile(r"(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_SPACE = re.compile(r"\s+")

_RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "xmp", "template", "annotation", "annotation-xml"}
_DROP = {"head", "svg", "select", "button", "object", "audio", "video", "canvas", "datalist"}
_BOILER = {"nav", "footer", "aside", "menu", "dialog"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_BLOCK = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup "
    "hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
#: Start tags that end an open element of these names.
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "menu", "menubar", "toolbar", "tablist"}
_NAMES = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|banner|breadcrumbs?|comments?|commentlist|consent|cookies?|disqus|footer|header|login|masthead|menu|modal|nav|navbar|navigation|"
    r"newsletter|notice|notification|overlay|pager|pagination|popup|promo\w*|related|replies|responses|share|sharing|sidebar|signup|skip|social|sponsor\w*|subscribe|toolbar|widget)(?:[\s_-]|$)",
    re.I,
)

_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
#: An article's own header holds its title.
_OWN_HEADER = re.compile(r"(?:article|entry|post|story|content|page)[_-]?header|^header$")

#: Names of layouts, which hold the article: what the page has beside it is not what they are.
_LAYOUT = re.compile(r"(?:^|[_-])(?:has|no|with|without)[_-](?!comment)|(?:^|[_-])layout(?:[_-]|$)|^content[_-]sidebar")
#: Elements that a form around the whole page holds, and a form to fill in does not.
_PARTS = {"nav", "aside", "main", "article"}

#: FORM: in a form, outside any article of its own; becomes BOILER unless the form holds the whole page.
ARTICLE, BOILER, FORM = 1, 2, 4


def _marks(name: str, attrs: str, inside: int) -> int | None:
    """ARTICLE and BOILER bits of an element, None to drop its content."""
    if name in _DROP:
        return None
    bits = ARTICLE if name in ("article", "main") else FORM if name == "form" else 0
    if name in _BOILER or name == "header" and not inside & ARTICLE:
        bits |= BOILER
    if attrs:
        for key, a, b, c in _ATTR.findall(attrs):
            key, v = key.lower(), _CAMEL.sub("-", a or b or c).lower()
            if key == "hidden" or key == "aria-hidden" and v == "true" or key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", v):
                return None
            if key == "role":
                bits |= ARTICLE if v in ("main", "article") else BOILER if v in _ROLES else 0
            elif key in ("class", "id") and name not in ("html", "body", "article", "main", "form") and _NAMES.search(v := " ".join(x for x in v.split() if not _LAYOUT.search(x))):
                bits |= 0 if inside & ARTICLE and _OWN_HEADER.search(v) else BOILER
            elif key in ("class", "id") and name == "article" and re.search(r"comment|repl(?:y|ies)", v):
                bits |= BOILER
    return bits


def lines(html: str) -> list[tuple[str, int]]:
    """The blocks of a page in order: text with single spaces, and its ARTICLE and BOILER bits."""
    out: list[tuple[str, int]] = []
    stack: list[tuple[str, int | None]] = []
    text: list[str] = []
    now: int | None = 0
    forms: list[int] = []  # the innermost form of each line, 0 for none
    open_forms: list[tuple[int, int]] = []  # depth in the stack and number
    n_forms, wide = 0, set()

    def end_block() -> None:
        if text:
            line = _SPACE.sub(" ", "".join(text)).strip()
            if line and now is not None:
                out.append((line, now))
                forms.append(open_forms[-1][1] if open_forms else 0)
            text.clear()

    def pop_to(depth: int) -> None:
        nonlocal now
        end_block()
        del stack[depth:]
        while open_forms and open_forms[-1][0] >= depth:
            open_forms.pop()
        now = stack[-1][1] if stack else 0

    at = 0
    while m := _TAG.search(html, at):
        if m.start() > at and now is not None:
            text.append(entities.unescape(html[at : m.start()]))
        at = m.end()
        close, name, attrs = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not name:
            continue
        name = name.lower()
        if close:
            if name in _BLOCK:
                end_block()
            depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name), -1)
            if depth >= 0:
                pop_to(depth) if name in _BLOCK or stack[depth][1] != now or now is None else stack.__delitem__(slice(depth, None))
            continue
        if name in _RAW:
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(html, at)
            at = end.end() if end else len(html)
            continue
        if name == "br":
            text.append(" ")
            continue
        if name in _BLOCK:
            end_block()
            low = max((i for i, (n, _) in enumerate(stack) if n not in _ENDS and n != "p" and n in _BLOCK), default=-1) + 1
            closes = {"p"} | _ENDS.get(name, set())
            depth = next((i for i in range(low, len(stack)) if stack[i][0] in closes), -1)
            if depth >= 0:
                pop_to(depth)
        if name in _VOID or attrs and attrs.rstrip().endswith("/") and name not in _BLOCK:
            continue
        bits = None if now is None else _marks(name, attrs, now)
        if name in _BLOCK or bits is None or bits:
            if name not in _BLOCK and bits is not None and bits & BOILER or bits is None:
                end_block()
            if name in _PARTS and open_forms:
                wide.add(open_forms[-1][1])
            if name == "form" and bits is not None:
                n_forms += 1
                open_forms.append((len(stack), n_forms))
            stack.append((name, None if bits is None else ((now or 0) & ~FORM if bits & ARTICLE else now or 0) | bits))
            now = stack[-1][1]
    if at < len(html) and now is not None:
        text.append(entities.unescape(html[at:]))
    end_block()
    if not any(not bits & BOILER and (not bits & FORM or f in wide) for (_, bits), f in zip(out, forms, strict=True)):  # nothing but forms
        wide |= {f for (_, bits), f in zip(out, forms, strict=True) if bits & BOILER}
    return [(t, bits & ~FORM | (BOILER if bits & FORM and f not in wide else 0)) for (t, bits), f in zip(out, forms, strict=True)]


def _rows_of_bits(a: list[int], b: list[int]) -> list[int]:
    """Bit-parallel LCS: after each item of b, zeros among the bits mark where the length over a's prefixes grows."""
    where: dict[int, int] = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    v, rows = full, []
    for y in b:
        u = v & where.get(y, 0)
        v = (v + u | v - u) & full
        rows.append(v)
    return rows


def shared(a: list[int], b: list[int]) -> set[int]:
    """Positions in a of a longest common subsequence with b."""
    return set(_shared(a, b, range(len(a))))


def _shared(a: list[int], b: list[int], at) -> list[int]:
    inside = set(b)
    keep = [i for i, x in enumerate(a) if x in inside]
    a, at = [a[i] for i in keep], [at[i] for i in keep]
    inside = set(a)
    b = [y for y in b if y in inside]
    if not a:
        return []
    if len(a) * len(b) > 1 << 28 and len(b) > 1:  # too large for a table of bits: split b where the halves add up to most
        mid = len(b) // 2
        zeros = lambda v, n: np.concatenate([[0], np.cumsum(1 - np.unpackbits(np.frombuffer(v.to_bytes(n // 8 + 1, "little"), np.uint8), bitorder="little")[:n].astype(np.int64))])
        head = zeros(_last_row(a, b[:mid]), len(a))
        tail = zeros(_last_row(a[::-1], b[mid:][::-1]), len(a))[::-1]
        i = int(np.argmax(head + tail))
        return _shared(a[:i], b[:mid], at[:i]) + _shared(a[i:], b[mid:], at[i:])
    rows = _rows_of_bits(a, b)
    out, i, j = [], len(a), len(b)
    while i and j:
        if rows[j - 1] >> (i - 1) & 1:
            i -= 1
        elif j > 1 and not rows[j - 2] >> (i - 1) & 1:
            j -= 1
        else:
            out.append(at[i - 1])
            i, j = i - 1, j - 1
    return out


def _last_row(a: list[int], b: list[int]) -> int:
    where: dict[int, int] = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for y in b:
        u = v & where.get(y, 0)
        v = (v + u | v - u) & full
    return v


def decide(page: list[tuple[str, int]], partner: list[int]) -> tuple[list[str], int, int, int]:
    """The lines that stay, and how many went as shared, went by markup alone, and stayed though shared. partner: hashes of the partner's lines."""
    marked = any(bits & ARTICLE and not bits & BOILER for _, bits in page)
    gone = shared([_hash(t) for t, _ in page], partner) if partner else set()
    stays = [not bits & BOILER and bool(bits & ARTICLE if marked else i not in gone) for i, (_, bits) in enumerate(page)]
    n_shared = sum(i in gone and not ok for i, ok in enumerate(stays))
    return [t for (t, _), ok in zip(page, stays, strict=True) if ok], n_shared, stays.count(False) - n_shared, len(gone) - n_shared


def main_text(page: list[tuple[str, int]], partner: list[int]) -> str:
    return "\n".join(decide(page, partner)[0])


def _hash(line: str) -> int:
    return xxhash.xxh64_intdigest(line.encode("utf-8", "surrogatepass"))


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        got = [np.array([_hash(t) for t, _ in lines(x.as_py() or "")], "<u8").tobytes() for x in b.column("html")]
        yield pa.RecordBatch.from_arrays([b.column("nid"), b.column("nkey"), pa.array(got, pa.binary())], ["nid", "nkey", "partner"])


_COUNTS = ("n_lines", "n_shared", "n_markup", "n_quoted")


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i in range(0, len(b), 256):
            part = b.slice(i, 256)
            texts, counts = [], []
            for x, p in zip(part.column("html"), part.column("partner"), strict=True):
                page = lines(x.as_py() or "")
                kept, *n = decide(page, np.frombuffer(p.as_py() or b"", "<u8").tolist())
                texts.append("\n".join(kept).encode("utf-8", "replace").decode())
                counts.append((len(page), *n))
            n = np.array(counts, np.int64).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), *(pa.array(n[:, j]) for j in range(4))], ["page_id", "url", "text", "n_chars", *_COUNTS])


def _host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]*)", 1))


def _path(url: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1), r"(?:\.html?|/)+$", "")


def extract_pages(pages: DataFrame) -> DataFrame:
    """One row for each row of ``pages`` (page_id, url, html): page_id, url, text, n_chars, n_lines, n_shared, n_markup, n_quoted.

    Null and empty html give an empty text. Null urls and urls without a host count
    as one host of their own with no path. A page without another page on its host
    has no partner; repeated rows are one page in the order of URLs. No pages give
    no rows. Other columns are ignored, whatever their names.
    """
    url = F.coalesce("url", F.lit(""))
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce(F.col("page_id").cast("long"), F.lit(-(1 << 63))).alias("id"), F.xxhash64(url, F.coalesce("html", F.lit(""))).alias("key"), "html"
    )
    light = rows.select("id", "key", _host(F.coalesce("url", F.lit(""))).alias("host"), _path(F.coalesce("url", F.lit(""))).alias("path")).distinct()
    near = with_neighbours(light, ["host", "path", "id", "key"], ["host", "path", "id", "key"])
    apart = lambda side: F.when(F.col(side + ".host") == F.col("host"), F.levenshtein(F.col(side + ".path"), F.col("path")))
    p, n = apart("_prev"), apart("_next")
    pick = F.when(p.isNotNull() & (n.isNull() | (p <= n)), F.col("_prev")).when(n.isNotNull(), F.col("_next"))
    pairs = near.withColumn("_o", pick).where("_o IS NOT NULL").select("id", "key", F.col("_o.id").alias("nid"), F.col("_o.key").alias("nkey"))
    hashes = rows.select(F.col("id").alias("nid"), F.col("key").alias("nkey"), "html").mapInArrow(_hashes, "nid long, nkey long, partner binary")
    partners = pairs.join(hashes, ["nid", "nkey"]).select("id", "key", "partner").dropDuplicates(["id", "key"])
    return rows.join(partners, ["id", "key"], "left").select("page_id", "url", "html", "partner").mapInArrow(_extract, "page_id long, url string, text string, n_chars long, " + ", ".join(f"{c} long" for c in _COUNTS))
