"""Main text of web pages by differencing pages of near urls.

A page becomes a list of lines (block elements), each marked as part of an article or not.
Pages are sorted by host and url path, so the nearest url of a host is the next or the previous
page; the lines of such a pair are aligned by their longest common subsequence, and lines that
both share are a template's, not the page's. The sort is a range partitioning, which cuts a host
of any size over tasks; a page at the edge of its range has its neighbour on one side only.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from calorix.llm.base import query, table
from calorix.llm.url_filter import url_parts

# Element names of HTML, and words that sites use in class and id.
RAW = frozenset("script style textarea title noscript template xmp iframe noembed noframes".split())
HIDDEN = RAW | frozenset(
    "head nav aside footer form button select svg canvas object menu dialog audio video".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
MAIN = frozenset(["article", "main"])
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 li blockquote pre td th dd dt figcaption".split())
BLOCKS = PROSE | MAIN | frozenset(
    "div section header ul ol dl table tbody thead tfoot tr figure address hr br body html details"
    " summary fieldset center".split()
)
NOISE = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|side-?bar|menu|nav\w*|breadcrumbs?"
    r"|footer|cookies?|consent|notice|popup|modal|newsletter|subscribe|signup|login|comments?"
    r"|disqus|replies|social|share|sharing|related|recommended|widget|toolbar|pagination)"
    r"(?:$|[\s_-])",
    re.I,
)
_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"'<]|\"[^\"<]*\"|'[^'<]*'|[\"'])*)(>|(?=<)|\Z)",
    re.S,
)
_MARKED = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_HIDES = re.compile(
    r"""\bhidden(?=[\s=/>]|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I
)


def page_lines(page: str) -> list[tuple[str, int]]:
    """Visible lines of a page with their kind: 2 prose inside an article or main element, 1 other
    lines inside, 0 outside. Elements that never hold main text, and those whose class, id or
    role says so, are left out with all they hold; an element that is not closed ends with its
    parent. Lines have their character references decoded and white space made single blanks."""
    lines: list[tuple[str, int]] = []
    words: list[str] = []
    # open elements: name, whether it hides its content, depth of article elements
    stack: list[tuple[str, bool, int]] = [("", False, 0)]
    prose, at, end = False, 0, len(page)

    def flush() -> None:
        text = " ".join(html.unescape("".join(words)).split())
        words.clear()
        if text:
            lines.append((text, 2 if prose and stack[-1][2] else 1 if stack[-1][2] else 0))

    while at < end:
        found = _TAG.search(page, at)
        if not stack[-1][1]:
            words.append(page[at : found.start() if found else end])
        if not found:
            break
        at = found.end()
        name = (found[2] or "").lower()
        if not name:
            continue
        if name in BLOCKS:
            flush()
            prose = name in PROSE if not found[1] else False
        if found[1]:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth][0] == name:
                    if not stack[-1][1] and name not in BLOCKS and stack[depth][2] != stack[depth - 1][2]:
                        flush()
                    del stack[depth:]
                    break
                # an inline or block end tag does not close the article around it
                if stack[depth][0] in MAIN and name not in MAIN and name not in ("body", "html"):
                    break
            continue
        if name in VOID or found[3].rstrip().endswith("/"):
            continue
        if name in RAW:
            close = re.compile(rf"</{re.escape(name)}\b[^>]*>?", re.I).search(page, at)
            at = close.end() if close else end
            continue
        if name in PROSE:
            # a new paragraph or item ends the one before it
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth][0] in MAIN or stack[depth][0] in ("div", "section", "ul", "ol", "table", "tr", "dl"):
                    break
                if stack[depth][0] == name or stack[depth][0] == "p":
                    del stack[depth:]
                    break
        _, hides, inside = stack[-1]
        marks = " ".join(next(filter(None, m), "") for m in _MARKED.findall(found[3]))
        if not hides:
            hides = name in HIDDEN or (
                name not in ("html", "body") and name not in MAIN and bool(NOISE.search(marks) or _HIDES.search(found[3]))
            )
            # a header inside an article holds its title; elsewhere it is the site's
            hides = hides or (name == "header" and not inside)
            if hides:
                flush()
        stack.append((name, hides, inside + (name in MAIN or marks.lower() == "main")))
    flush()
    return lines


def common_lines(a: list, b: list) -> list[int]:
    """Places in ``a`` of the longest common subsequence of two lists, by bit rows."""
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    found = list(range(head)) + list(range(len(a) - tail, len(a)))
    x = [(i, v) for i, v in enumerate(a[head : len(a) - tail], head)]
    y = b[head : len(b) - tail]
    shared = {v for _, v in x} & set(y)
    x, y = [(i, v) for i, v in x if v in shared], [v for v in y if v in shared]
    where: dict = {}
    for j, (_, v) in enumerate(x):
        where[v] = where.get(v, 0) | 1 << j
    # bit j of a row is 0 if the common length grows at x[j]
    full = (1 << len(x)) - 1
    row, rows = full, []
    for v in y:
        hit = row & where[v]
        row = ((row + hit) | (row - hit)) & full
        rows.append(row)
    i, j = len(y), len(x)
    while i and j:
        if rows[i - 1] >> (j - 1) & 1:
            j -= 1
            continue
        i -= 1
        if i and not rows[i - 1] >> (j - 1) & 1:
            continue
        j -= 1
        found.append(x[j][0])
    return sorted(found)


def shared_with(lines: list[tuple[str, int]], other: list[tuple[str, int]]) -> set[int]:
    """Places of the lines that ``other`` shares, none if the two pages are copies of each other
    (more than half of the text of either article, or of the page without one, is shared)."""
    places = common_lines([t for t, _ in lines], [t for t, _ in other])
    inside = any(kind for _, kind in lines)
    size = lambda some: sum(len(t) for t, kind in some if kind or not inside)
    if 2 * size([lines[i] for i in places]) > min(size(lines), size(other) or size(lines)):
        return set()
    return set(places)


def main_text(lines: list[tuple[str, int]], shared: set[int]) -> str:
    """The article's lines, or all lines of a page without one, less those shared with a near
    page. Paragraphs, headings, items and cells inside an article stay even if another page has
    them too: a site's template does not write those, authors who quote do."""
    inside = any(kind for _, kind in lines)
    return " ".join(
        text
        for i, (text, kind) in enumerate(lines)
        if kind == 2 or (i not in shared and (kind or not inside))
    )


def extract_pages(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html"
) -> DataFrame:
    """``page_id, url, text, n_chars`` for every page, repeated rows included.

    Null and empty html give an empty text; pages without a url are sorted as one host. Truncated
    pages and elements that are not closed are read as far as they go.
    """
    host, path = url_parts(F.col("url"))
    keys = ["_host", "_path", "page_id", "_tie"]
    near = (
        pages.select(
            F.col(id_col).alias("page_id"),
            F.col(url_col).alias("url"),
            F.col(html_col).alias("html"),
        )
        .withColumns({"_host": host, "_path": path, "_tie": F.xxhash64("html")})
        .repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .select("page_id", "url", "_host", "html")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = now = None  # (id in Arrow, url, host, lines)
        for batch in batches:
            out, ids = [], batch.column(0)
            rest = (batch.column(i).to_pylist() for i in (1, 2, 3))
            for k, (url, at, page) in enumerate(zip(*rest, strict=True)):
                then = (ids[k], url, at, page_lines(page or ""))
                if now:
                    out.append(_extracted(before, now, then))
                before, now = now, then
            yield _batch(out, ids.type)
        if now:
            yield _batch([_extracted(before, now, None)], now[0].type)

    schema = f"page_id {dict(pages.dtypes)[id_col]}, url string, text string, n_chars long"
    return near.mapInArrow(run, schema)


def _extracted(before, now, then) -> tuple:
    shared: set[int] = set()
    for other in (before, then):
        if other and other[2] == now[2]:
            shared |= shared_with(now[3], other[3])
    text = main_text(now[3], shared)
    return now[0], now[1], text, len(text)


def _batch(rows: list[tuple], id_type: pa.DataType) -> pa.RecordBatch:
    kinds = {"page_id": id_type, "url": pa.string(), "text": pa.string(), "n_chars": pa.int64()}
    columns = [pa.array([row[i] for row in rows], kind) for i, kind in enumerate(kinds.values())]
    return pa.RecordBatch.from_arrays(columns, names=list(kinds))


@query("op6_html_extraction")
def op6_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    """Main text of every page."""
    return extract_pages(table(spark, folder, "pages").select("page_id", "url", "html"))
