"""Operator 3: main text of web pages by nearest-URL page differencing.

Pages of a host are put in order of their URL path; a page's partner is the page
next to it in that order (the one before, else the one after). Both pages' text
lines are aligned by their longest common subsequence, and the lines they share
are deleted: what a site repeats is not the article. A partner that shares four
fifths of the lines is a copy, not another page, and the other neighbour is
taken instead.

Every page is differenced. Differencing alone does not give right results on the
given pages (README has the figures: menus and adverts there do not follow the
host, and articles repeat paragraphs), so markup checks it: scripts, styles, forms,
menus, footers, side bars, and elements whose class, id or role names such a part
are no lines at all; the lines of an ``article`` (else ``main``) are the text, even
if shared, unless the page has more unshared text around that element than text in
it. Differencing decides for all lines elsewhere.

The order is a range partitioning, so a host of any size is spread over many
tasks; at a cut a page takes its neighbour on the other side.

Cases: null and empty html give an empty text; a tag or script the page's end
cuts off is no text; a null url is a host of its own; repeated rows are all
kept; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .url_cascade import host_of, path_of

ATTRS = r"""((?:[^>"']|"[^"]*"|'[^']*')*)"""
RAW = "script|style|textarea|title|xmp|iframe|noembed|noframes|noscript|template"
TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<(?:{RAW})\b{ATTRS}>.*?(?:</(?:{RAW})\s*>|\Z)|<(/?)([a-zA-Z][^\s/>]*){ATTRS}>"
                   r"|<[!?/][^>]*(?:>|\Z)|<[a-zA-Z][^>]*\Z|[^<]+|<", re.S | re.I)
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = set("""address article aside blockquote body br center dd details dialog div dl dt fieldset figcaption figure
footer form h1 h2 h3 h4 h5 h6 head header hr html li main menu nav ol option p pre section select summary table tbody
td tfoot th thead tr ul""".split())
CLOSES_P = BLOCK - {"br", "option", "body", "html"}
SKIP = set("""head nav footer aside form button select option dialog menu svg math canvas audio video object
applet map label legend fieldset input""".split())
ROLES = set("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar".split())
NAMES = set("""ad ads advert adverts advertisement advertising sponsored sponsor promo promotion banner cookie cookies
consent gdpr notice notices sidebar sidebars menu menus nav navbar navigation breadcrumb breadcrumbs footer comment
comments reply replies respond disqus share sharing social related newsletter subscribe subscription signup login popup
modal overlay widget masthead copyright pagination pager toolbar skip""".split())
#: Parts of a class or id that make it a statement about a page, not the name of a part.
STATES = set("has no not with without is enabled disabled hide show layout".split())
ATTR = re.compile(r"""([^\s=/"']+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
COPY = 0.8  # of the lines
#: Open elements that a start tag ends, and those it does not look beyond.
IMPLIED = {t: [(("p",), ("td", "th", "button", "object"))] for t in CLOSES_P}
IMPLIED["li"] = IMPLIED["li"] + [(("li",), ("ul", "ol", "menu"))]
for _t in ("dd", "dt"):
    IMPLIED[_t] = IMPLIED[_t] + [(("dd", "dt"), ("dl",))]
for _t in ("td", "th"):
    IMPLIED[_t] = IMPLIED[_t] + [(("td", "th"), ("tr", "table"))]
IMPLIED["tr"] = IMPLIED["tr"] + [(("tr",), ("table",))]
IMPLIED["body"] = [(("head",), ())]


def _names_junk(word: str) -> bool:
    parts = {*word.replace("_", "-").split("-")}
    return not parts & STATES and bool({word.replace("-", "").replace("_", ""), *parts} & NAMES)


def _is_junk(tag: str, attrs: str, in_main: bool) -> bool:
    if tag in SKIP or (tag == "header" and not in_main):
        return True
    if not attrs or attrs.isspace() or tag in ("html", "body"):
        return False
    for name, value in ATTR.findall(attrs):
        name, value = name.lower(), html.unescape(value.strip("\"'")).lower()
        if name == "hidden" or (name == "aria-hidden" and value == "true"):
            return True
        if name == "role" and value in ROLES:
            return True
        if name == "style" and "display:none" in value.replace(" ", ""):
            return True
        if name in ("class", "id") and tag not in ("article", "main") and any(map(_names_junk, value.split())):
            return True
    return False


def lines_of(page: str) -> list[tuple[int, str]]:
    """The lines of a page outside junk: (2 in an article, 1 in main, else 0; text)."""
    out: list[tuple[int, str]] = []
    stack: list[tuple[str, bool, int]] = []  # tag, junk, depth of main
    junk, level, said = 0, 0, []

    def flush() -> None:
        if said:
            line = " ".join("".join(said).split())
            if line:
                out.append((level, line))
            said.clear()

    def pop(at: int) -> None:
        nonlocal junk, level
        for tag, bad, _ in stack[at:]:
            junk -= bad
        level = stack[at][2]
        del stack[at:]

    for m in TOKEN.finditer(page):
        tag = m.group(3)
        if tag is None:
            token = m.group()
            if token[0] != "<" or token == "<":
                if not junk:
                    said.append(html.unescape(token) if "&" in token else token)
            continue
        tag, closing, attrs = tag.lower(), m.group(2), m.group(4)
        if tag in BLOCK:
            flush()
        if closing:
            for at in range(len(stack) - 1, -1, -1):
                if stack[at][0] == tag:
                    pop(at)
                    break
            continue
        if tag in VOID or attrs.endswith("/") and tag not in BLOCK:
            continue
        for rule in IMPLIED.get(tag, ()):
            for at in range(len(stack) - 1, -1, -1):
                if stack[at][0] in rule[0]:
                    pop(at)
                    break
                if stack[at][0] in rule[1]:
                    break
        bad = _is_junk(tag, attrs, level > 0)
        stack.append((tag, bad, level))
        junk += bad
        if tag == "article" and not bad:
            level = 2
        elif level == 0 and not bad and (tag == "main" or 'role="main"' in attrs):
            level = 1
    flush()
    return out


def shared(a: list[str], b: list[str]) -> list[bool]:
    """Which lines of a are in the longest common subsequence with b; the rows of
    the table are bit sets, so the work is lines times words of lines."""
    where: dict[str, int] = {}
    for j, line in enumerate(b):
        where[line] = where.get(line, 0) | 1 << j
    full = (1 << len(b)) - 1
    v, rows = full, []
    for line in a:
        rows.append(v)
        u = v & where.get(line, 0)
        v = ((v + u) | (v - u)) & full
    # a zero bit j of a row: the length grows at j; walk back from the end
    rows.append(v)
    out, j = [False] * len(a), len(b) - 1
    for i in range(len(a) - 1, -1, -1):
        low = ~rows[i + 1] & ((1 << (j + 1)) - 1)
        if not low:
            break
        j = low.bit_length() - 1  # the last growth up to here ends at j
        if rows[i] >> j & 1:      # not yet in the row before: line i matched
            out[i] = True
            j -= 1
    return out


def unshared(lines: list[str], neighbours: list[list[str]]) -> list[bool] | None:
    """Which lines the first neighbour that is no copy does not share; None without such a neighbour."""
    for other in neighbours:
        if not lines or not other:
            continue
        same = shared(lines, other)
        if sum(same) < COPY * len(lines):
            return [not s for s in same]
    return None


def article(lines: list[str], levels: list[int], neighbours: list[list[str]]) -> list[str]:
    """The lines of the main text: those the page does not share with its neighbour say where
    it is. The innermost mark (article, then main) holds it unless the lines around the mark
    have more unshared text than the mark has text; then the next one out does, at last the
    page. Lines of a mark are kept even if shared, others only if not."""
    new, best = unshared(lines, neighbours), max(levels, default=0)
    while best and new:
        inside = sum(len(x) for x, y in zip(lines, levels) if y >= best)
        if sum(len(x) for x, y, n in zip(lines, levels, new) if y < best and n) <= inside:
            break
        best -= 1
    return [x for x, y, n in zip(lines, levels, new or [True] * len(lines)) if y >= best and (y or n)]


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row of pages."""
    kind = pages.schema["page_id"].dataType.simpleString()

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                found = [lines_of(page or "") for page in batch.column(4).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(i) for i in range(4)), pa.array([[x for _, x in p] for p in found], pa.list_(pa.string())),
                     pa.array([[y for y, _ in p] for p in found], pa.list_(pa.int32()))],
                    names=["page_id", "url", "host", "path", "lines", "levels"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def text(row, neighbours):
            near = [x["lines"] for x in neighbours if x is not None and x["host"] == row["host"]]
            return " ".join(article(row["lines"], row["levels"], near))

        def rows(done):
            said = [t for _, t in done]
            return pa.RecordBatch.from_arrays(
                [pa.array([r["page_id"] for r, _ in done], page_type), pa.array([r["url"] for r, _ in done], pa.string()),
                 pa.array(said, pa.string()), pa.array(list(map(len, said)), pa.int64())],
                names=["page_id", "url", "text", "n_chars"])

        before = now = page_type = None
        for batch in batches:
            page_type = batch.column(0).type
            for at in range(0, batch.num_rows, 500):
                done = []
                for row in batch.slice(at, 500).to_pylist():
                    if now is not None:
                        done.append((now, text(now, (before, row))))
                    before, now = now, row
                yield rows(done)
        if now is not None:
            yield rows([(now, text(now, (before, None)))])

    parsed = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"),
                          "html").mapInArrow(parse, f"page_id {kind}, url string, host string, path string, "
                                                    "lines array<string>, levels array<int>")
    order = ("host", "path", "url", "page_id")
    return parsed.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(
        compare, f"page_id {kind}, url string, text string, n_chars bigint")
