"""Main text of web pages by tag-path ratios.

A page is read once, in linear time, as a series of text nodes that know their
element.  Per root-to-leaf tag path the text length and the punctuation are
summed and divided by the path's nodes; the two ratios are smoothed over the
page's nodes in order and multiplied.  A path's score is the mean of that over
its nodes, times a prior: each element on the path that is by its name, class,
id or role a menu, header, footer, advert, comment part and so on counts as
PRIOR.  Paths whose score is at least the standard deviation of all nodes'
scores are content.  The lowest container of all content nodes, or the article
or main element around it, is the article.  Its blocks are kept in page order,
with the short ones that are no content path themselves (headings, captions),
unless they stand in a marked part below that container.  A mark on the
container or above it changes nothing, as it weighs on all paths alike.
Outside an article or main element, list items of nothing but links go, too,
if their path is no content.

Defined results: null and empty pages, and pages without content, give an
empty text; unclosed, stray and crossed tags are tolerated; a quoted attribute
that would run into another tag is taken as broken, and ends with its tag;
character references that are not known stay as they are; all other columns
stay.
"""

from __future__ import annotations

import html as entities
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import textcore as tc
from .common import extended, without

#: Comments, sections of plain text, declarations and tags; no part of it ever gives back what it took, so a page is read in linear time.
TOKEN = re.compile(
    r"<!--(?>.*?(?:-->|\Z))|<!\[CDATA\[(?>.*?(?:\]\]>|\Z))|<[!?][^>]*+(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/<>]*+)((?>[^<>=]++|=\s*+(?:\"(?:[^\"<]|<(?![a-zA-Z/!]))*+\"|'(?:[^'<]|<(?![a-zA-Z/!]))*+')|=|<(?![a-zA-Z/!]))*+)(?:>|(?=<)|\Z)",
    re.S,
)
ATTR = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
WORD = re.compile(r"[a-z0-9]+")
PUNCTUATION = re.compile(r"[.,;:!?…。、]")
#: Elements by their part in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
RAW = frozenset("script style noscript template iframe textarea title svg math object canvas".split())
NO_TEXT = frozenset("head button select".split())
APART = frozenset("nav header footer aside form menu dialog fieldset".split())
MARKED = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo banner nav navbar navigation menu sidebar breadcrumb breadcrumbs cookie cookies consent gdpr popup modal overlay "
    "comment comments disqus replies newsletter subscribe signup login footer header masthead widget toolbar pagination pager".split()
)
#: These mark an element only as a whole class or id.
MARKED_WHOLE = frozenset("notice notices alert alerts promotion reply discussion respond share sharing social related recommended".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
CLOSES_P = BLOCK - {"html", "body", "option", "legend", "summary", "caption", "tbody", "td", "tfoot", "th", "thead", "tr"}
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
CONTAINERS = ("ul", "ol", "dl", "table", "menu")
HOLDERS = frozenset("html body main article section div td center".split())
#: What a mark on an element makes of the score of the paths through it; reach of the smoothing, in nodes.
PRIOR, SMOOTH = 1e-3, 2


def _hidden(attributes: str) -> bool:
    return any(name.lower() == "hidden" or name.lower() == "aria-hidden" and (a or b or c).lower() == "true" for name, a, b, c in ATTR.findall(attributes))


def _marked(attributes: str) -> bool:
    for name, a, b, c in ATTR.findall(attributes):
        name, value = name.lower(), (a or b or c).lower()
        if name == "role" and value in ROLES:
            return True
        if name in ("class", "id") and not (MARKED.isdisjoint(WORD.findall(value)) and MARKED_WHOLE.isdisjoint(value.split())):
            return True
    return False


class Page:
    """Elements in page order, each after its parent, and the text nodes that can be seen.

    Per element: ``parent``, ``name``, ``path`` (number of its tag path), ``marks`` (marked elements on its path), ``links`` (whether it is in a link).
    Per text node: its element, block number and raw text.
    """

    def __init__(self, page: str):
        self.parent, self.name, self.path, self.marks, self.links = [-1], [""], [0], [0], [False]
        self.nodes: list[tuple[int, int, str]] = []
        paths: dict[tuple, int] = {}
        stack, unseen = [0], 0  # open elements; how many of the outermost of them are seen, 0: all
        places: dict[str, list[int]] = {}  # name -> places in the stack
        block = at = 0

        def last(names) -> int:
            return max((places[n][-1] for n in names if places.get(n)), default=-1)

        def close(names, stop=()):
            nonlocal block, unseen
            i = last(names)
            if i < 0 or i < last(stop):
                return
            while len(stack) > i:
                name = self.name[stack.pop()]
                places[name].pop()
                block += name in BLOCK
            if len(stack) <= unseen:
                unseen = 0

        def text(piece: str):
            if piece and not unseen:
                self.nodes.append((stack[-1], block, piece))

        end = len(page)
        while at < end:
            m = TOKEN.search(page, at)
            if not m:
                text(page[at:])
                break
            text(page[at : m.start()])
            at = m.end()
            name = m[2] and m[2].lower()
            if not name:
                if m[0].startswith("<![CDATA["):
                    text(m[0][9:].removesuffix("]]>").replace("&", "&amp;"))
                continue
            if m[1]:
                close((name,), () if name in BLOCK else ("article", "section", "main", "body"))
                continue
            if name in CLOSES_P:
                close(("p",), ("td", "th", "li", "button", "table", "article", "section", "div"))
            for x in SIBLINGS.get(name, ()):
                close((x,), CONTAINERS)
            if name == "body":
                close(("head",))
            block += name in BLOCK
            if name in VOID:
                if name == "br":
                    text(" ")
                continue
            if m[3].endswith("/") and name in ("svg", "math"):
                continue
            if name in RAW:
                stop = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I).search(page, at)
                at = stop.end() if stop else end
                continue
            up, root = stack[-1], name in ("html", "body")
            mark = not root and (name in APART or bool(m[3]) and _marked(m[3]))
            if not unseen and (name in NO_TEXT or not root and bool(m[3]) and _hidden(m[3])):
                unseen = len(stack)
            self.parent.append(up)
            self.name.append(name)
            self.path.append(paths.setdefault((self.path[up], name, mark), len(paths) + 1))
            self.marks.append(self.marks[up] + mark)
            self.links.append(self.links[up] or name == "a")
            places.setdefault(name, []).append(len(stack))
            stack.append(len(self.name) - 1)


def content(page: Page, sizes: np.ndarray, punctuation: np.ndarray) -> np.ndarray:
    """Which nodes are content: those whose path's score reaches the threshold."""
    real = np.flatnonzero(sizes > 0)
    chosen = np.zeros(len(sizes), bool)
    if not len(real):
        return chosen
    element = np.array([page.nodes[i][0] for i in real])
    _, path = np.unique(np.array(page.path)[element], return_inverse=True)
    n = np.bincount(path)
    window = np.exp(-0.5 * np.arange(-SMOOTH, SMOOTH + 1) ** 2)

    def smooth(x):
        return np.convolve(x, window)[SMOOTH : SMOOTH + len(x)]

    weight = smooth(np.ones(len(real)))
    length = (np.bincount(path, sizes[real]) / n)[path]
    marks = ((np.bincount(path, punctuation[real]) + 0.5) / n)[path]
    fused = smooth(length) / weight * (smooth(marks) / weight) * PRIOR ** np.minimum(np.array(page.marks)[element], 8)
    mean = np.bincount(path, fused) / n
    chosen[real] = mean[path] >= threshold(fused, mean)
    return chosen


def threshold(fused: np.ndarray, mean: np.ndarray) -> float:
    """The least score of a content path; the best path always is one."""
    return min(float(fused.std()), float(mean.max()))


def extract(page: str | None) -> str:
    """Main text of one page."""
    if not page:
        return ""
    read = Page(page)
    texts = [entities.unescape(t) for _, _, t in read.nodes]
    sizes = np.array([len("".join(t.split())) for t in texts], float)
    chosen = content(read, sizes, np.array([len(PUNCTUATION.findall(t)) for t in texts], float))
    if not chosen.any():
        return ""
    # content nodes inside each element; the lowest element with all of them, or the article around it
    held = np.bincount([e for (e, _, _), c in zip(read.nodes, chosen) if c], minlength=len(read.name))
    for k in range(len(held) - 1, 0, -1):
        held[read.parent[k]] += held[k]
    root = int(np.flatnonzero(held == held[0])[-1])
    while root and read.name[root] not in HOLDERS:
        root = read.parent[root]
    k = root
    while k and read.name[k] not in ("article", "main"):
        k = read.parent[k]
    root, article = k or root, bool(k)
    inside = np.zeros(len(read.name), bool)
    inside[root] = True
    blocks: dict[int, list[str]] = {}
    plain: dict[int, bool] = {}  # blocks with text of a content path or outside a link
    seen = root
    for (element, block, _), t, c in zip(read.nodes, texts, chosen):
        for seen in range(seen + 1, element + 1):
            inside[seen] = inside[read.parent[seen]]
        if inside[element] and (c or read.marks[element] == read.marks[root]):
            blocks.setdefault(block, []).append(t)
            plain[block] = plain.get(block, False) or bool(c) or bool(t.strip()) and not read.links[element]
    lines = (" ".join("".join(b).split()) for k, b in blocks.items() if article or plain[k])
    return "\n".join(x for x in lines if x)


def extract_pages(pages: DataFrame) -> DataFrame:
    """``pages`` with text and n_chars in place of html."""
    base = pages.select(*without(pages, "text", "n_chars"))
    schema = extended(base.drop("html").schema, "text string, n_chars long")

    def each(batches):
        for batch in batches:
            at = batch.schema.get_field_index("html")
            got = [extract(x) for x in batch.column(at).to_pylist()]
            rest = pa.RecordBatch.from_arrays([c for i, c in enumerate(batch.columns) if i != at], names=[n for i, n in enumerate(batch.schema.names) if i != at]) if batch.num_columns > 1 else None
            text, size = pa.array(got, pa.string()), pa.array([len(x) for x in got], pa.int64())
            if rest is None:
                yield pa.RecordBatch.from_arrays([text, size], names=["text", "n_chars"])
            else:
                yield tc.set_column(tc.set_column(rest, "text", text), "n_chars", size)

    return base.mapInArrow(each, schema)
