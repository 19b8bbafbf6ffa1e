"""Main text of web pages by nearest-URL page differencing.

Pages of a host that lie next to each other by URL path share their frame:
menus, headers, footers, notices.  Each page is cut into text lines (one a
block), paired with the nearest page of its host whose lines differ, the two
line sequences are aligned by their longest common subsequence, and shared
lines are deleted.  Two facts of pages bound this: neighbours may share parts
of their articles (copies, quoted passages), and adverts differ from page to
page.  So lines inside a page's marked-up article (``article``, ``main`` or
the like) are not deleted for being shared, and lines inside elements that
are marked up as something else (navigation, footers, forms, adverts,
comments, ...) are deleted though they differ.  Differencing decides for all
other lines, before, after and without such an article; inside one it decides
for elements whose class or id is an ambiguous frame word (header, related,
discussion, ...).

Pages are sorted by (host, path, page_id) over ranges cut from a sample of
these keys, so that a large host spreads over many tasks; a range's first
pages see the last page before them, and a host's only page in a range the first
page behind it, through a small side table (two pages for each range).

Defined results: null or empty html gives an empty text; a null URL is host
and path "" of its own; a host's only page, or one whose neighbours all have
the same lines, has nothing deleted by differencing; repeated rows each get
their text; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contingo.llm.cluster import small_batches

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
                   r"|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|[^<]+|<", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
RAW = {"script", "style", "template", "iframe", "textarea", "title", "svg", "select"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = {"address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir",
         "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6",
         "head", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "p", "pre", "section",
         "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul", "br"}
#: A new element of the key ends an open one of these.
ENDS = {"p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"},
        "td": {"td", "th", "p"}, "th": {"td", "th", "p"}}
#: Elements that a stray end tag or an implied end doesn't reach beyond.
WALLS = {"table", "ul", "ol", "dl", "article", "main", "nav", "footer", "header", "aside", "form", "body", "section", "div"}
FRAME = {"nav", "footer", "aside", "form", "menu", "button", "dialog", "head"}
FRAME_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alertdialog", "alert",
               "menu", "menubar", "toolbar"}
FRAME_WORDS = re.compile(
    r"(?:^|[\s_\-])(?:ads?|adverts?|advertisements?|advertising|adbox|adsense|sponsor(?:ed)?|promo(?:tion)?s?|banner|cookies?"
    r"|consent|gdpr|notices?|alerts?|popup|modal|overlay|newsletter|subscribe|subscription|signup|login|nav|navbar|navigation"
    r"|menu|breadcrumbs?|sidebar|side|rail|aside|widget|footer|foot|header|masthead|topbar|toolbar|share|sharing|social"
    r"|related|recommended|recommendations|comments?|commentlist|replies|reply|respond|disqus|discussion|pagination|pager"
    r"|search|skip|copyright|legal|disclaimer|tags|tagcloud|meta|byline)(?=$|[\s_\-\d])", re.I)
#: Inside an article only these are frame for certain; differencing decides for elements with other frame words.
CERTAIN_WORDS = re.compile(
    r"(?:^|[\s_\-])(?:ads?|adverts?|advertisements?|adbox|adsense|sponsored|comments?|commentlist|disqus|navbar|breadcrumbs?"
    r"|share[\s_\-]?(?:bar|buttons?|links?|icons?|tools)|(?:cookies?|consent|gdpr)[_\-](?:banner|notice|bar))(?=$|[\s_\-\d])", re.I)
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
DOUBTFUL, ARTICLE, LOOSE, FRAMED = 3, 2, 1, 0


def _attributes(text: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for m in ATTRIBUTE.finditer(text):
        out.setdefault(m[1].lower(), html.unescape(m[2] or m[3] or m[4] or ""))
    return out


def _place(tag: str, attributes: dict[str, str], inside: int, in_article: bool) -> int:
    """Whether an element's text is article, doubtful (in an article, under a frame word), loose or frame."""
    if inside == FRAMED:
        return FRAMED
    role = attributes.get("role", "").lower()
    if tag in FRAME or role in FRAME_ROLES or "hidden" in attributes or attributes.get("aria-hidden", "") == "true" \
            or HIDDEN.search(attributes.get("style", "")):
        return FRAMED
    if tag == "header" and not in_article:
        return FRAMED
    named = f"{attributes.get('class', '')} {attributes.get('id', '')}"
    if tag not in {"html", "body", "article", "main"} and FRAME_WORDS.search(named):
        return DOUBTFUL if in_article and not CERTAIN_WORDS.search(named) else FRAMED
    if inside == DOUBTFUL:
        return DOUBTFUL
    if tag in {"article", "main"} or role in {"main", "article"} or attributes.get("itemprop", "") == "articleBody":
        return ARTICLE
    return inside


def page_lines(source: str | None) -> list[tuple[str, int]]:
    """The page's text lines, one a block, each with its place. White space inside a line is one blank."""
    lines: list[tuple[str, int]] = []
    held: list[str] = []
    stack: list[tuple[str, int]] = [("", LOOSE)]
    raw = ""

    def end_line() -> None:
        text = " ".join(html.unescape("".join(held)).split())
        held.clear()
        if text:
            lines.append((text, stack[-1][1]))

    for m in TOKEN.finditer(source or ""):
        tag = m[2]
        if tag is None:
            part = m[0]
            if not raw and not part.startswith(("<!", "<?")):
                held.append(part)
            continue
        tag = tag.lower()
        if raw:
            if m[1] and tag == raw:
                raw = ""
            continue
        if m[1]:
            depth = next((i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == tag), 0)
            if depth and (tag in WALLS or not any(t in WALLS for t, _ in stack[depth + 1:])):
                if tag in BLOCK or stack[depth][1] != stack[depth - 1][1]:
                    end_line()
                del stack[depth:]
            elif tag in BLOCK:
                end_line()
            continue
        if tag in RAW:
            if not m[3].rstrip().endswith("/"):
                raw = tag
            continue
        if tag in BLOCK:
            end_line()
        if tag in ENDS:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] in ENDS[tag]:
                    del stack[i:]
                elif stack[i][0] in WALLS:
                    break
        if tag not in VOID:
            place = _place(tag, _attributes(m[3]) if m[3].strip() else {}, stack[-1][1], stack[-1][1] in (ARTICLE, DOUBTFUL))
            if place != stack[-1][1]:
                end_line()
            stack.append((tag, place))
    end_line()
    return lines


def common_lines(a: list[int], b: list[int]) -> set[int]:
    """Indices in a of a longest common subsequence of a and b (by descending matches and ascending tails)."""
    start = 0
    while start < min(len(a), len(b)) and a[start] == b[start]:
        start += 1
    stop = 0
    while stop < min(len(a), len(b)) - start and a[-1 - stop] == b[-1 - stop]:
        stop += 1
    found = set(range(start)) | set(range(len(a) - stop, len(a)))
    where: dict[int, list[int]] = {}
    for j in range(len(b) - stop - 1, start - 1, -1):
        where.setdefault(b[j], []).append(j)
    tails: list[int] = []
    links: list[tuple] = []
    for i in range(start, len(a) - stop):
        for j in where.get(a[i], ()):
            k = bisect_left(tails, j)
            link = (i, links[k - 1] if k else None)
            if k == len(tails):
                tails.append(j)
                links.append(link)
            else:
                tails[k], links[k] = j, link
    link = links[-1] if links else None
    while link:
        found.add(link[0])
        link = link[1]
    return found


def main_text(lines: list[tuple[str, int]], other: list[int] | None, own: list[int]) -> tuple[str, int]:
    """The text that stays, and how many lines are shared with the other page's."""
    shared = common_lines(own, other) if other is not None else set()
    kept = [t for i, (t, p) in enumerate(lines) if p == ARTICLE or p != FRAMED and i not in shared]
    return "\n".join(kept), len(shared)


URL = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)([^?#]*)"


def keys(pages: DataFrame) -> DataFrame:
    """Pages with host and path: the port and www. are cut off; scheme, query, fragment, a last slash and the file
    type don't count."""
    host = F.regexp_replace(F.lower(F.regexp_extract("url", URL, 1)), r"^www\.|:\d+$", "")
    path = F.regexp_replace(F.regexp_extract("url", URL, 2), r"(?:\.[A-Za-z]{2,5})?/?$", "")
    return pages.select("page_id", "url", "html", F.coalesce(host, F.lit("")).alias("host"),
                        F.coalesce(path, F.lit("")).alias("path"))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars, n_lines, n_shared: one row for each page."""
    spark = pages.sparkSession
    small_batches(spark)
    rows = keys(pages)
    n_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n = rows.count()
    order = ["host", "path", "page_id"]
    sample = sorted((tuple(r) for r in rows.select(*order).sample(fraction=min(1.0, 40 * n_parts / max(n, 1)), seed=5)
                     .limit(200 * n_parts).collect()), key=_sortable)
    cuts = [_sortable(sample[len(sample) * i // n_parts]) for i in range(1, n_parts)] if sample else []
    shared_cuts = spark.sparkContext.broadcast(cuts)

    def part_of(host: pa.Array, path: pa.Array, ids: pa.Array) -> list[int]:
        return [bisect_left(shared_cuts.value, _sortable(k))
                for k in zip(host.to_pylist(), path.to_pylist(), ids.to_pylist())]

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays(
                [pa.array(part_of(*b.columns), type=pa.int32()), *b.columns], ["part", *order])

    kind = rows.schema["page_id"].dataType.simpleString()
    lasts = rows.select(*order).mapInArrow(number, f"part int, host string, path string, page_id {kind}") \
        .groupBy("part").agg(F.max(F.struct(*order)).alias("last"), F.min(F.struct(*order)).alias("first")) \
        .select("part", F.explode(F.create_map(F.lit(True), "last", F.lit(False), "first")).alias("is_last", "k"))
    # the last page of each range, for the first pages of the next, and the first, for a host's only page of the range before
    ends = rows.join(F.broadcast(lasts.limit(4 * n_parts)), F.struct(*order).eqNullSafe(F.col("k"))) \
        .groupBy("part", "is_last").agg(F.first("host").alias("host"), F.first("html").alias("html")).collect()
    before, after = (spark.sparkContext.broadcast(
        {r.part: (r.host, [_line_hash(t) for t, _ in page_lines(r.html)]) for r in ends if r.is_last == e})
        for e in (True, False))

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lines = [page_lines(h) for h in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(part_of(b.column(3), b.column(4), b.column(0)), type=pa.int32()), *b.columns[:2],
                 *b.columns[3:5], pa.array([[t for t, _ in x] for x in lines], type=pa.list_(pa.string())),
                 pa.array([[p for _, p in x] for x in lines], type=pa.list_(pa.int8()))],
                ["part", "page_id", "url", "host", "path", "lines", "places"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, host, last, earlier = None, None, None, None
        waiting: list[tuple] = []
        out: list[tuple] = []

        def settle_rest() -> None:
            """Pages without another one of their host before the range's end look at the next range's first page."""
            later = [q for q in after.value if part is not None and q > part]
            following = after.value[min(later)] if later else (None, None)
            for w in waiting:
                settle(w, following[1] if following[0] == host and following[1] != w[3] else None)

        def settle(page: tuple, other: list[int] | None) -> None:
            text, shared = main_text(page[2], other, page[3])
            out.append((page[0], page[1], text, len(text), len(page[2]), shared))

        def batch() -> pa.RecordBatch:
            rows, out[:] = list(out), []
            types = (id_type[0], pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64())
            names = ["page_id", "url", "text", "n_chars", "n_lines", "n_shared"]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], type=t) for i, t in enumerate(types)], names)

        id_type: list = []
        for b in batches:
            id_type[:] = [b.column(1).type]
            for p, page_id, url, h, _, lines, places in zip(*(c.to_pylist() for c in b.columns)):
                own = [_line_hash(t) for t in lines]
                page = (page_id, url, list(zip(lines, places)), own)
                if p != part or h != host:
                    settle_rest()
                    waiting = []
                    earlier, last = None, None
                    if p != part:
                        known = [q for q in before.value if q < p]
                        if known and before.value[max(known)][0] == h:
                            last = before.value[max(known)][1]
                    part, host = p, h
                if last is not None and last != own:
                    earlier, last = last, own
                    for w in waiting:                       # the host's first pages look ahead
                        settle(w, own)
                    waiting = []
                    settle(page, earlier)
                elif earlier is not None:
                    settle(page, earlier)
                else:
                    waiting.append(page)
                    last = own
            if len(out) >= 500:
                yield batch()
        settle_rest()
        if out:
            yield batch()

    return rows.mapInArrow(parse, f"part int, page_id {kind}, url string, host string, path string, "
                                  "lines array<string>, places array<tinyint>") \
        .repartition(n_parts, "part").sortWithinPartitions("part", *order) \
        .mapInArrow(compare, f"page_id {kind}, url string, text string, n_chars long, n_lines long, n_shared long")


def _sortable(key: tuple) -> tuple:
    """Nulls first, as Spark sorts; strings by their bytes."""
    return tuple((x is not None, x.encode() if isinstance(x, str) else 0 if x is None else x) for x in key)


def _line_hash(line: str) -> int:
    from zlib import adler32, crc32
    data = line.encode()
    return crc32(data) << 32 | adler32(data)


def op1_html_extraction(spark, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", "url", "text", "n_chars")
