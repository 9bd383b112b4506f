"""Main-text extraction by nearest-URL page differencing.

A page is cut into text lines, one per block. Markup that is never main text
(scripts, forms, navigation, page headers and footers, sidebars; containers whose
role, class or id names them as notices, adverts or reader comments) goes at
once. Where the page names its article, other text goes too, and the article's
own paragraphs, headings and the like are held safe. All other lines must pass
the differencing: pages of a host stand in URL order, each is paired with the
nearest page around it, by the beginning that their URLs share, the lines of
both are aligned by a longest common subsequence, and shared lines are deleted
as template. A page that shares nearly all of its text is a copy and tells
nothing of the template, so the next nearest takes its place, among REACH pages
on either side. Where every one of them is a copy, the one that shares least is
taken, and where that shares all lines, nothing is deleted.

Pages are parsed once and travel once, compressed, to the part of the URL order
they belong to; the parts' bounds come from a bounded hash sample of the keys, so
a host with a third of all pages spreads over many parts, and reruns agree. The
REACH first and last pages of a part go to the neighbour parts too, so that each
page meets the same pages and the result does not depend on the number of parts.

Defined cases: null or empty html gives an empty text; null urls form one host;
pages and attribute values of any length are read whole; repeated rows come back
once each; equal URLs stand by page_id, then by content; an unclosed element ends
with its parent; an empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

import html as htmllib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Pages' bytes aimed at per part, parts at most, and sampled keys per part.
PART_BYTES = 16 << 20
MAX_PARTS = 32768
KEYS_PER_PART = 4
#: Pages looked at on either side, and the share of a page's characters that only a copy shares.
REACH = 4
COPY = 0.8

_TAG = re.compile(r"<!--.*?-->|<[!?][^>]*>|<(/?)([A-Za-z][^\s/>]*)", re.S)
_STOP = re.compile(r"[>\"']")
_ATTR = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")
_NAME = re.compile(r"[A-Za-z0-9]+")

RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "object", "svg", "math", "canvas", "audio", "video"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
SKIP = {"nav", "header", "footer", "aside", "form", "button", "select", "dialog", "menu", "fieldset"}
SKIP_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "alertdialog", "menu", "menubar", "form"}
#: Last (or only) part of a class or id of a container whose text is not the article's.
SKIP_NAMES = set(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion popup modal overlay "
    "nav navbar navigation menu menus breadcrumb breadcrumbs sidebar sidebars widget widgets footer masthead topbar toolbar "
    "cookie cookies consent gdpr notice notices notification newsletter subscribe subscription signup login "
    "share sharing social recommended recommendations comment comments commentlist replies respond disqus "
    "pagination pager copyright disclaimer".split()
)
#: First parts that say so too, as in ad-slot or comment-list.
SKIP_FIRST = set("ad ads advert advertisement nav navigation menu breadcrumb breadcrumbs sidebar footer cookie cookies newsletter share sharing comment comments sponsored promo popup pagination".split())
#: Elements that such names are looked for on: containers, not the blocks of a text.
NAMED = set("div section ul ol dl table details figure span center iframe article".split())
SAFE = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "pre", "blockquote", "li", "dt", "dd", "td", "th", "figcaption", "caption"}
CLOSES = {"p": SAFE | {"div", "ul", "ol", "dl", "table", "section", "article", "header", "footer", "nav", "aside", "form", "main", "hr", "figure", "address", "details"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "tr": {"tr"}, "option": {"option"}}


def _tag_end(page: str, at: int, last: int, dead: set[int]) -> int:
    """The place after the > that ends the tag whose attributes begin at a place; one must stand before `last`.

    Quoted values may hold >; where quotes do not close, the tag ends at the
    first >. `dead` gathers the places of quotes from which no tag ends, so that
    no stretch is searched twice.
    """
    seen, where = [], at
    while m := _STOP.search(page, where, last):
        if m[0] == ">":
            return m.end()
        if m.start() in dead:
            break
        seen.append(m.start())
        close = page.find(m[0], m.end(), last)
        if close < 0:
            break
        where = close + 1
    dead.update(seen)
    return page.index(">", at, last) + 1


def _attributes(attrs: str) -> list[tuple[str, str]]:
    """(name, value) in lower case."""
    return [(m[1].lower(), (m[2] or "").strip("\"'").lower()) for m in _ATTR.finditer(attrs)] if attrs else []


def _names_other(name: str) -> bool:
    parts = _NAME.findall(name)
    return bool(parts) and (parts[-1] in SKIP_NAMES or parts[0] in SKIP_FIRST)


def _skips(tag: str, attrs: list[tuple[str, str]], in_article: bool) -> bool:
    if tag in SKIP:
        return not (tag == "header" and in_article)
    for name, value in attrs:
        if name == "hidden" or name == "aria-hidden" and value == "true":
            return True
        if name == "style":
            if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
                return True
        elif name == "role":
            if value in SKIP_ROLES:
                return True
        elif name in ("class", "id") and tag in NAMED and any(_names_other(x) for x in value.split()):
            return True
    return False


def blocks_of(page: str) -> list[tuple[str, str]]:
    """(mark, line) of each block in page order: + safe, - to be differenced, . outside the named article."""
    found: list[tuple[bool, bool, str]] = []  # in article, safe, line
    stack: list[str] = []
    skip = article = -1  # depth of the element that began it
    buffer: list[str] = []
    safe_at = -1
    at, n = 0, len(page)
    if (open_comment := page.find("<!--", page.rfind("-->") + 1)) >= 0 and page.find("-->", open_comment) < 0:
        n = open_comment  # it hides the rest
    last = page.rfind(">", 0, n) + 1  # no tag ends later
    dead: set[int] = set()

    def flush() -> None:
        nonlocal buffer
        if buffer:
            if line := " ".join(htmllib.unescape("".join(buffer)).split()):
                found.append((article >= 0, article >= 0 and safe_at >= 0, line))
            buffer = []

    def close(depth: int) -> None:
        nonlocal skip, article, safe_at
        del stack[depth:]
        skip = -1 if skip >= depth else skip
        article = -1 if article >= depth else article
        safe_at = -1 if safe_at >= depth else safe_at

    while at < n:
        m = _TAG.search(page, at, last) if at < last else None
        text = page[at : m.start() if m else n]
        if text and skip < 0:
            buffer.append(text)
        if not m:
            break
        at = m.end()
        if not m[2]:
            continue
        at = _tag_end(page, at, last, dead)
        tag, attrs = m[2].lower(), page[m.end() : at - 1]
        if m[1]:
            if tag not in INLINE:
                flush()
            if tag in stack:
                close(len(stack) - 1 - stack[::-1].index(tag))
            continue
        if tag in RAW:
            if not attrs.endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(page, at)
                at = end.end() if end else n
            if tag not in INLINE and skip < 0:
                buffer.append(" ")
            continue
        if tag == "br":
            if skip < 0:
                buffer.append(" ")
            continue
        if tag not in INLINE:
            flush()
            for open_tag, by in CLOSES.items():
                if tag in by and open_tag in stack:
                    depth = len(stack) - 1 - stack[::-1].index(open_tag)
                    if not any(x in ("table", "ul", "ol", "dl", "div", "section", "article", "main", "blockquote") for x in stack[depth + 1 :]):
                        close(depth)
        if tag in VOID or attrs.endswith("/"):
            continue
        depth = len(stack)
        stack.append(tag)
        given = _attributes(attrs) if skip < 0 else []
        if skip < 0 and _skips(tag, given, article >= 0):
            skip = depth
        if skip < 0 and article < 0 and (tag in ("article", "main") or ("role", "main") in given):
            article = depth
        if safe_at < 0 and tag in SAFE:
            safe_at = depth
    flush()
    named = any(inside for inside, _, _ in found)
    return [("+" if safe else "-" if inside or not named else ".", line) for inside, safe, line in found]


def lines_of(page: str) -> list[tuple[bool, str]]:
    """(safe, line) of the blocks that may be main text."""
    return own_lines(blocks_of(page))


def own_lines(blocks: list[tuple[str, str]]) -> list[tuple[bool, str]]:
    return [(mark == "+", line) for mark, line in blocks if mark != "."]


def lcs(a: list, b: list) -> list[tuple[int, int]]:
    """Index pairs of one longest common subsequence (Hunt and Szymanski, ends trimmed)."""
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    places: dict = {}
    for j in range(head, len(b) - tail):
        places.setdefault(b[j], []).append(j)
    ends: list[int] = []
    links: list[tuple] = []
    for i in range(head, len(a) - tail):
        for j in reversed(places.get(a[i], ())):
            k = bisect_left(ends, j)
            link = (i, j, links[k - 1] if k else None)
            if k == len(ends):
                ends.append(j)
                links.append(link)
            else:
                ends[k], links[k] = j, link
    middle, link = [], links[-1] if links else None
    while link:
        middle.append(link[:2])
        link = link[2]
    return [*((i, i) for i in range(head)), *reversed(middle), *((len(a) - t, len(b) - t) for t in range(tail, 0, -1))]


def shared(own: list[tuple[bool, str]], other: list[tuple]) -> set[int]:
    """The own lines that stand in a longest common subsequence with the other page's."""
    return {i for i, _ in lcs([line for _, line in own], [line for _, line in other])}


def difference(own: list[tuple[bool, str]], others: list[list[tuple]]) -> list[str]:
    """The lines left after deleting unprotected ones that a page of other content shares; others: blocks of the nearest page first."""
    free = {i for i, (safe, _) in enumerate(own) if not safe}
    gone: set[int] = set()
    if free:
        size = sum(len(line) for _, line in own)
        least = size
        for other in others:
            same = shared(own, other)
            common = sum(len(own[i][1]) for i in same)
            if common < least:
                gone, least = same, common
            if common < COPY * size:
                break
    return [line for i, (_, line) in enumerate(own) if i not in gone & free]


def url_key(url: str | None) -> tuple[str, str]:
    """(host, path with query) of a URL."""
    try:
        parts = urlsplit(url or "")
        return (parts.hostname or "").lower(), parts.path + ("?" + parts.query if parts.query else "")
    except ValueError:
        return "", url or ""


def _shared_beginning(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        n += 1
    return n


def _placer(bounds: list[tuple]):
    """The part and the key of each page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [(*url_key(url), _order(page_id)) for page_id, url in zip(*(batch.column(i).to_pylist() for i in range(2)), strict=True)]
            yield _key_rows([(bisect_right(bounds, k), *k) for k in keys])

    return run


def _key_rows(rows: list[tuple]) -> pa.RecordBatch:
    part, host, path, order = ([r[i] for r in rows] for i in range(4))
    return pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(host, pa.string()), pa.array(path, pa.string()), pa.array(order, pa.int64())], names=["part", "host", "path", "order"])


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of keys by part and in order: the first and the last REACH of each part, as often as they occur."""
    part, first, last = None, [], []
    for batch in batches:
        for row in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            if row[0] != part and first:
                yield _key_rows(first + last)
                first, last = [], []
            part = row[0]
            if len(first) < REACH:
                first.append(row)
            else:
                last = [*last, row][-REACH:]
    if first:
        yield _key_rows(first + last)


def _visits(ends: list[tuple]) -> dict[tuple, set[int]]:
    """Of (part, host, path, order) rows: the other parts that a key's pages are shown to."""
    out: dict[tuple, set[int]] = {}
    ends = sorted(ends)
    for i, (part, *key) in enumerate(ends):
        for step in (-1, 1):
            # The parts of the REACH rows before (or after) it that stand elsewhere.
            near = ends[max(0, i - REACH) : i] if step < 0 else ends[i + 1 : i + 1 + REACH]
            for other, host, *_ in near:
                if other != part and host == key[0]:
                    out.setdefault(tuple(key), set()).add(other)
    return out


def _cutter(bounds: list[tuple], visits: dict[tuple, set[int]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                out = {k: [] for k in ("page_id", "url", "part", "guest", "host", "path", "lines")}
                for page_id, url, page in zip(*(part.column(i).to_pylist() for i in range(3)), strict=True):
                    host, path = url_key(url)
                    packed = pack.compress("\n".join(mark + line for mark, line in blocks_of(page or "")).encode("utf-8", "surrogatepass"))
                    key = (host, path, _order(page_id))
                    for i, place in enumerate([bisect_right(bounds, key), *sorted(visits.get(key, ()))]):
                        for name, value in zip(out, (page_id, url, place, i > 0, host, path, packed), strict=True):
                            out[name].append(value)
                kinds = {"page_id": pa.int64(), "url": pa.string(), "part": pa.int32(), "guest": pa.bool_(), "host": pa.string(), "path": pa.string(), "lines": pa.binary()}
                yield pa.RecordBatch.from_arrays([pa.array(v, kinds[k]) for k, v in out.items()], names=list(out))

    return run


def _order(page_id) -> int:
    return -(1 << 63) if page_id is None else int(page_id)


def _nearest(row: tuple, before: list[tuple], after: list[tuple]) -> list[tuple]:
    """The pages around it on its host, the nearest first: by the shared beginning of the URLs, then by distance."""
    around = [(d, x) for d, x in (*((-i, x) for i, x in enumerate(reversed(before), 1)), *enumerate(after, 1)) if x[2] == row[2]]
    around.sort(key=lambda x: (-_shared_beginning(x[1][3], row[3]), abs(x[0]), x[0]))
    return [x for _, x in around]


def _pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by part and in URL order; each looks at REACH before and after. Guests are looked at only."""
    unpack = zstandard.ZstdDecompressor()

    def rows() -> Iterator[tuple]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                for page_id, url, host, path, packed, place, guest in zip(*(part.column(part.schema.get_field_index(c)).to_pylist() for c in ("page_id", "url", "host", "path", "lines", "part", "guest")), strict=True):
                    body = unpack.decompress(packed).decode("utf-8", "surrogatepass")
                    yield page_id, url, host, path, [(x[0], x[1:]) for x in body.split("\n")] if body else [], place, guest

    def finish(held: list[tuple], at: int) -> tuple:
        row = held[at]
        before = [x for x in held[max(0, at - REACH) : at] if x[5] == row[5]]
        after = [x for x in held[at + 1 : at + 1 + REACH] if x[5] == row[5]]
        text = "\n".join(difference(own_lines(row[4]), [x[4] for x in _nearest(row, before, after)]))
        return row[0], row[1], text, len(text)

    def pack(out: list[tuple]) -> pa.RecordBatch:
        a, b, c, d = zip(*out, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.string()), pa.array(c, pa.string()), pa.array(d, pa.int64())], names=["page_id", "url", "text", "n_chars"])

    out: list[tuple] = []
    size = 0
    held: list[tuple] = []  # the rows around; the one at `at` is next
    at = 0
    for row in rows():
        held.append(row)
        if len(held) - at > REACH:
            if not held[at][6]:
                out.append(finish(held, at))
                size += out[-1][3]
                if size > 1 << 20:
                    yield pack(out)
                    out, size = [], 0
            at += 1
            if at > REACH:
                held.pop(0)
                at -= 1
    for i in range(at, len(held)):
        if not held[i][6]:
            out.append(finish(held, i))
    if out:
        yield pack(out)


def extract(spark: SparkSession, pages: DataFrame, part_bytes: int = PART_BYTES) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    df = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    size = df.agg(F.sum(F.octet_length("html"))).first()[0] or 0
    parts = min(MAX_PARTS, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // part_bytes)))
    h = F.xxhash64("url", "page_id")
    keys = df.groupBy(F.pmod(h, F.lit(parts * KEYS_PER_PART))).agg(F.min(F.struct(h.alias("h"), "url", "page_id")).alias("k")).select("k.url", "k.page_id").collect()
    sample = sorted((*url_key(r["url"]), _order(r["page_id"])) for r in keys)
    bounds = sorted({sample[len(sample) * i // parts] for i in range(1, parts)}) if sample else []
    # Which pages stand at the ends of the parts shows from the URLs alone.
    met = lambda rows: rows.repartitionById(parts, F.col("part"))
    placed = met(df.select("page_id", "url").mapInArrow(_placer(bounds), "part int, host string, path string, order bigint"))
    ends = placed.sortWithinPartitions("part", "host", "path", "order").mapInArrow(_ends, "part int, host string, path string, order bigint").collect()
    visits = _visits([tuple(r) for r in ends])
    cut = met(df.mapInArrow(_cutter(bounds, visits), "page_id bigint, url string, part int, guest boolean, host string, path string, lines binary"))
    return cut.sortWithinPartitions("part", "host", "path", "page_id", "url", "lines").mapInArrow(_pair, "page_id bigint, url string, text string, n_chars bigint")
