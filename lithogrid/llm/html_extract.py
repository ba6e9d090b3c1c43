"""Main text of web pages by tag-path ratios.

A page is read into blocks of text, each with the path of tags from the root to
its leaf. By path, the text length per node and the punctuation per node are
summed over the page; both ratios are smoothed over the page's sequence of
nodes with a Gaussian window, fused by their product, and the paths whose fused
ratio exceeds the threshold (mean less a share of the deviation, text by text) are content paths.
The content container is the deepest element that holds all of the content
paths' text; the article is every block in it, headings too, that is no
boilerplate and lies in no list of links: an element off the content paths, of
at least two links that are most of its text.

Scripts, styles, forms, menus, headers and footers of the page, sidebars,
dialogs, and elements whose class, id or role names a notice, advert, comment
section or the like are boilerplate whatever their ratio; of several containers
a ``main`` or ``article`` element goes first. Character references are
decoded, white space inside a block becomes one space, blocks are trimmed and
joined in page order by one space.

Null and empty pages, and pages without text, give an empty text. Unclosed and
crossing tags are closed as far as needed. Repeated rows have equal results;
pages of any length are read whole.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lithogrid.llm.common import table

#: Elements whose content is not page text.
SILENT = frozenset("script style noscript template svg math iframe object embed canvas audio video head title select "
                   "option datalist textarea map applet frameset noframes".split())
#: Elements that run to the end of the page if nothing closes them.
RAW = frozenset("script style title textarea iframe noframes noscript".split())
#: Elements that are never part of an article.
FURNITURE = frozenset("nav footer aside form button menu dialog fieldset label input".split())
#: Elements inside a block of text.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q ruby rb rp rt s samp small "
                   "span strike strong sub sup time tt u var wbr".split())
#: Elements without an end tag.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr keygen frame basefont".split())
#: What an opening tag closes.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
          "th": {"td", "th"}, "option": {"option"}, "tbody": {"thead", "tbody", "tr", "td", "th"},
          "tfoot": {"tbody", "tr", "td", "th"}}
#: Block elements, which close an open paragraph.
BLOCKS = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form "
                   "h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
#: Words in class, id or role that name boilerplate.
NAMED = frozenset("ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs byline captcha comment "
                  "comments commentlist consent cookie cookies copyright disclaimer disqus dropdown follow footer footnav "
                  "gdpr header login masthead menu modal nav navbar navigation newsletter notice notification pager "
                  "pagination popup privacy promo promoted promotion recommended related reply replies respond search share "
                  "sharing shoutbox sidebar sidebars signin signup social sponsor sponsored subscribe subscription syndication tags "
                  "toolbar tooltip widget widgets alert toast skip complementary contentinfo discussion discussions".split())
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|"
    r"<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"""(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""", re.I)
_NAME = re.compile(r"[a-z]+")
_WIDE = re.compile(r"([a-z])([A-Z])")
_PUNCTUATION = re.compile(r"[.,;:!?…。、，！？；：]")
_SPACE = re.compile(r"\s+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
#: Share of the paths' deviation below the mean at which a path still counts.
SLACK = 0.5
WINDOW = 2
#: Links that make a list of links.
LINKS = 2


class Element:
    """An open or closed element: tag, number of its parent, whether it is boilerplate, number of its path."""

    __slots__ = ("tag", "parent", "junk", "path", "depth", "in_article", "linked")

    def __init__(self, tag: str, parent: int, junk: bool, path: int, depth: int, in_article: bool, linked: bool):
        self.tag, self.parent, self.junk, self.path, self.depth = tag, parent, junk, path, depth
        self.in_article, self.linked = in_article, linked


class Block:
    """A block of text: number of its element, text, characters and number of its links."""

    __slots__ = ("element", "text", "linked", "links")

    def __init__(self, element: int, text: str, linked: int, links: int):
        self.element, self.text, self.linked, self.links = element, text, linked, links


def _named_junk(tag: str, attributes: str) -> bool:
    if not attributes or tag in ("html", "body", "main", "article"):
        return False
    for name, *values in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), next(filter(None, values), "")
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return True
        if name == "style":
            if _HIDDEN.search(value):
                return True
        elif NAMED & set(_NAME.findall(_WIDE.sub(r"\1 \2", value).lower())):
            return True
    return False


def blocks_of(page: str) -> tuple[list[Element], list[Block]]:
    """Elements and blocks of a page; paths are numbers, each known by the path above it and a tag."""
    elements = [Element("", -1, False, 0, 0, False, False)]
    stack, blocks, held = [0], [], []
    linked = links = 0
    paths: dict[tuple[int, str], int] = {}
    endless: set[str] = set()  # elements that nothing closes from here on

    def close_block() -> None:
        nonlocal linked, links
        if held:
            text = _SPACE.sub(" ", html.unescape("".join(held))).strip()
            held.clear()
            if text:
                at = stack[-1]
                while elements[at].tag in INLINE:
                    at = elements[at].parent
                blocks.append(Block(at, text, min(linked, len(text)), links))
        linked = links = 0

    def hold(text: str) -> None:
        nonlocal linked
        held.append(text)
        if elements[stack[-1]].linked:
            linked += len(_SPACE.sub(" ", html.unescape(text)))

    def pop_to(depth: int) -> None:
        if any(elements[x].tag not in INLINE for x in stack[depth:]):
            close_block()
        del stack[depth:]

    at, end = 0, len(page)
    while at < end:
        found = _TOKEN.search(page, at)
        if not found:
            hold(page[at:])
            break
        if found.start() > at:
            hold(page[at:found.start()])
        at = found.end()
        tag = (found[2] or "").lower()
        if not tag:
            if found[0].startswith("<![CDATA["):
                held.append(html.escape(found[0][9:].removesuffix("]]>")))
            continue
        if found[1]:
            for depth in range(len(stack) - 1, 0, -1):
                if elements[stack[depth]].tag == tag:
                    pop_to(depth)
                    break
                if elements[stack[depth]].tag in ("td", "th", "table") and tag in ("p", "div", "span", "b", "i"):
                    break
            else:
                if tag in BLOCKS:
                    close_block()
            continue
        if tag == "head":
            continue
        if tag in SILENT and tag not in VOID:
            close_block()
            if not found[3].rstrip().endswith("/"):
                close = None if tag in endless else re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
                if close is None:
                    endless.add(tag)
                at = close.end() if close else end if tag in RAW else at
            continue
        if tag in VOID:
            if tag in ("br", "hr"):
                held.append(" ")
            if tag == "hr":
                close_block()
            continue
        if tag in BLOCKS or tag in CLOSES:
            closing = CLOSES.get(tag, set()) | ({"p"} if tag in BLOCKS else set())
            for depth in range(len(stack) - 1, 0, -1):
                open_tag = elements[stack[depth]].tag
                if open_tag in closing:
                    pop_to(depth)
                    break
                if open_tag not in INLINE and open_tag not in CLOSES.get(tag, ()):
                    break
        if tag not in INLINE:
            close_block()
        parent = stack[-1]
        above = elements[parent]
        junk = above.junk or tag in FURNITURE or tag == "header" and not above.in_article or _named_junk(tag, found[3])
        path = above.path if tag in INLINE else paths.setdefault((above.path, tag), len(paths) + 1)
        elements.append(Element(tag, parent, junk, path, above.depth + 1, above.in_article or tag == "article",
                                above.linked or tag == "a"))
        links += tag == "a"
        stack.append(len(elements) - 1)
        if len(stack) > 2000:  # deeper than any page that is read: the innermost element stands for the rest
            stack.pop()
    close_block()
    return elements, blocks


def _smooth(values: np.ndarray) -> np.ndarray:
    spread = np.arange(-WINDOW, WINDOW + 1)
    weights = np.exp(-spread ** 2 / 2)
    padded = np.pad(values, WINDOW, mode="edge")
    return np.convolve(padded, weights / weights.sum(), "valid")


def content_nodes(paths: list[int], texts: list[str]) -> np.ndarray:
    """Which blocks lie on content paths, by their smoothed and fused ratios."""
    number = {p: n for n, p in enumerate(dict.fromkeys(paths))}
    at = np.array([number[p] for p in paths])
    length = np.array([len(t) for t in texts], float)
    marks = np.array([len(_PUNCTUATION.findall(t)) for t in texts], float)
    nodes = np.bincount(at)
    by_text = _smooth((np.bincount(at, length) / nodes)[at])
    by_mark = _smooth((np.bincount(at, marks) / nodes)[at])
    fused = np.bincount(at, by_text * (by_mark + .1)) / nodes
    each = fused[at]
    total = length.sum()
    mean = (each * length).sum() / total
    deviation = np.sqrt(((each - mean) ** 2 * length).sum() / total)
    return each >= mean - SLACK * deviation - 1e-9


def _link_lists(elements: list[Element], kept: list[Block], content: np.ndarray, inside: int) -> set[int]:
    """Outermost elements below ``inside`` without a block on a content path that are lists of links."""
    live = {inside}
    for block, chosen in zip(kept, content):
        e = block.element
        while chosen and e >= 0 and e not in live:
            live.add(e)
            e = elements[e].parent
    top: dict[int, int] = {}  # element: outermost element above it that has no content
    size: dict[int, list[int]] = {}
    for block in kept:
        e, way = block.element, []
        while e >= 0 and e not in live and e not in top:
            way.append(e)
            e = elements[e].parent
        found = top[e] if e in top else way[-1] if way else -1
        for each in way:
            top[each] = found
        if found >= 0:
            sums = size.setdefault(found, [0, 0, 0])
            for n, value in enumerate((len(block.text), block.linked, block.links)):
                sums[n] += value
    lists = {e for e, (length, linked, links) in size.items() if links >= LINKS and 2 * linked > length}
    return {e for e, above in top.items() if above in lists}


def main_text(page: str | None) -> str:
    elements, blocks = blocks_of(page or "")
    kept = [b for b in blocks if not elements[b.element].junk]
    if not kept:
        return ""
    content = content_nodes([elements[b.element].path for b in kept], [b.text for b in kept])
    weight: dict[int, int] = {}
    whole = 0
    for block, chosen in zip(kept, content):
        if chosen:
            whole += len(block.text)
            e = block.element
            while e >= 0:
                weight[e] = weight.get(e, 0) + len(block.text)
                e = elements[e].parent
    holds = [e for e, w in weight.items() if w == whole]
    marked = [e for e in holds if elements[e].tag in ("article", "main")]
    inside = max(marked or holds, key=lambda e: (elements[e].depth, -e))
    if elements[inside].tag == "p" or elements[inside].tag in INLINE:
        inside = max(elements[inside].parent, 0)

    def within(e: int) -> bool:
        while e >= 0:
            if e == inside:
                return True
            e = elements[e].parent
        return False

    known: dict[int, bool] = {}
    lists = _link_lists(elements, kept, content, inside)
    chosen = []
    for block in kept:
        e = block.element
        if e not in known:
            known[e] = e not in lists and within(e)
        if known[e]:
            chosen.append(block.text)
    return " ".join(chosen)


@F.pandas_udf(T.StringType())
def extract(pages: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for some in pages:
        yield pd.Series([main_text(p) for p in some], dtype=object)


def html_extract(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, url, text, n_chars."""
    return pages.select("page_id", "url", extract("html").alias("text")).withColumn(
        "n_chars", F.length("text").cast("bigint"))


def op8_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract(table(spark, sf_dir, "pages"))
