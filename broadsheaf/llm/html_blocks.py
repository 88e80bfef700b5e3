"""Main-text extraction: flat text blocks, classified by a decision tree on their own and their neighbours' features.

A page is cut into flat blocks at block-level tags. A block has its word count, its link density and a few flags
of the elements around it; the tree sees these for the block, the one before and the one after it. It is grown
(Gini, fixed depth) from the small labelled table below, once, on the driver.

The flags tell menus, notices and the article element apart; word counts and link densities tell link lists from text inside the
article too, and decide alone on pages without such an element.

Defined cases: null and empty html, and pages without a main block, give an empty string; comments, scripts, styles, titles and
text fields that do not end run to the end of the page; other elements end with the page, a head at the first element that cannot
stand in it; a quote that does not end makes all later quotes characters like others; after the last ">" all is text; repeated rows give repeated results; an empty table an empty
one; columns other than page id, url and html are not read.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tune

MAIN = "page_id long, url string, text string, n_chars long"

TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
#: A tag as it should be. A try ends at the next "<" at the latest, so all tries together follow the length of the page.
WHOLE_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^<>\"']*(?:\"[^\"<>]*\"[^<>\"']*|'[^'<>]*'[^<>\"']*)*)>")
STOP = re.compile(r"[>\"']")
#: Elements without markup inside; one that does not end runs to the end of the page.
RAW = frozenset("script style title textarea iframe noframes xmp".split())
#: Elements passed over as a whole; where one does not end, its tag alone is.
SKIPPED = frozenset("noscript template svg math object canvas select button".split())
ENDS = {name: re.compile(rf"</{name}(?![a-z0-9])", re.I) for name in RAW | SKIPPED}
#: What may stand in a head; any other element ends it.
IN_HEAD = RAW | SKIPPED | frozenset("head meta link base".split())
#: Elements that do not end a block.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr img data ruby rt rp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose text is not the article's.
APART = frozenset("head nav header footer aside form menu dialog".split())
#: Words in a class, id or role that tell the same.
APART_NAMES = re.compile(
    r"(?:^|[\s_-])(?:nav\w*|menu\w*|header|masthead|footer|foot|side-?bar|aside|ads?|advert\w*|sponsor\w*|promo\w*|banner|cookie\w*|consent|notice\w*|alert|popup|modal|overlay|newsletter|subscribe|subscription"
    r"|signup|login|share|sharing|social|related|recommend\w*|comments?|commentlist|disqus|replies|reply|discussion|breadcrumbs?|pagination|pager|widget|toolbar|copyright|legal|disclaimer|contentinfo|navigation|complementary|search)(?=$|[\s_-])",
    re.I,
)
MAIN_NAMES = re.compile(r"(?:^|[\s_-])(?:article|main|post|entry|story|content)(?=$|[\s_-])", re.I)
NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

FEATURES = ("words", "links", "before_words", "before_links", "after_words", "after_links", "apart", "main", "heading", "page_main")
#: The labelled table: the features above, then 1 for main text. Written by hand after common page layouts.
LABELLED = (
    # inside an article or main element: long, short, headed, linked
    (40, 0.0, 12, 0.0, 35, 0.0, 0, 1, 0, 1, 1), (1, 0.0, 80, 0.0, 60, 0.0, 0, 1, 0, 1, 1), (3, 0.0, 5, 0.0, 4, 0.0, 0, 1, 0, 1, 1),
    (9, 0.0, 6, 0.0, 45, 0.0, 0, 1, 1, 1, 1), (120, 0.1, 60, 0.0, 30, 0.0, 0, 1, 0, 1, 1), (25, 0.5, 40, 0.0, 50, 0.0, 0, 1, 0, 1, 1),
    (2, 1.0, 30, 0.0, 30, 0.0, 0, 1, 0, 1, 1), (15, 0.0, 0, 0.0, 0, 0.0, 0, 1, 0, 1, 1), (300, 0.0, 9, 0.0, 7, 0.0, 0, 1, 0, 1, 1), (6, 0.0, 1, 1.0, 5, 0.0, 0, 1, 1, 1, 1),
    # link lists inside the article: linked words next to linked words
    (3, 1.0, 3, 1.0, 3, 1.0, 0, 1, 0, 1, 0), (2, 1.0, 60, 0.0, 2, 1.0, 0, 1, 0, 1, 0), (5, 1.0, 4, 1.0, 40, 0.0, 0, 1, 0, 1, 0), (8, 0.9, 6, 1.0, 0, 0.0, 0, 1, 0, 1, 0), (4, 1.0, 1, 0.0, 5, 0.9, 0, 1, 0, 1, 0), (30, 1.0, 25, 1.0, 28, 1.0, 0, 1, 0, 1, 0),
    (12, 0.9, 40, 0.0, 50, 0.0, 0, 1, 0, 1, 1), (2, 0.5, 3, 0.5, 4, 0.5, 0, 1, 0, 1, 1), (60, 0.3, 50, 0.4, 70, 0.2, 0, 1, 0, 1, 1), (4, 0.0, 2, 1.0, 3, 1.0, 0, 1, 0, 1, 1), (6, 1.0, 40, 0.1, 60, 0.0, 0, 1, 1, 1, 1), (5, 0.0, 40, 0.0, 3, 1.0, 0, 1, 0, 1, 1), (50, 0.0, 3, 1.0, 4, 1.0, 0, 1, 0, 1, 1),
    # the same, but in a menu, notice, advert, form, footer or comment inside it
    (8, 0.0, 40, 0.0, 40, 0.0, 1, 1, 0, 1, 0), (60, 0.0, 40, 0.0, 0, 0.0, 1, 1, 0, 1, 0), (1, 1.0, 1, 1.0, 30, 0.0, 1, 1, 0, 1, 0), (4, 0.0, 60, 0.0, 30, 0.0, 1, 1, 1, 1, 0), (200, 0.0, 60, 0.0, 30, 0.0, 1, 1, 0, 1, 0),
    # outside the article element of a page that has one
    (1, 1.0, 0, 0.0, 1, 1.0, 1, 0, 0, 1, 0), (1, 1.0, 1, 1.0, 8, 0.0, 1, 0, 0, 1, 0), (9, 0.0, 1, 1.0, 10, 0.0, 1, 0, 0, 1, 0), (12, 0.0, 60, 0.0, 0, 0.0, 1, 0, 0, 1, 0),
    (45, 0.0, 30, 0.0, 10, 0.0, 1, 0, 0, 1, 0), (7, 0.0, 30, 0.0, 0, 0.0, 0, 0, 0, 1, 0), (50, 0.0, 30, 0.0, 40, 0.0, 0, 0, 0, 1, 0), (14, 0.4, 1, 1.0, 9, 0.0, 0, 0, 0, 1, 0), (3, 0.0, 9, 0.0, 30, 0.0, 0, 0, 1, 1, 0),
    # pages without such an element: long text, and short text beside it, against menus and lines between links
    (40, 0.0, 9, 0.0, 35, 0.0, 0, 0, 0, 0, 1), (90, 0.2, 30, 0.0, 35, 0.0, 0, 0, 0, 0, 1), (18, 0.0, 30, 0.0, 30, 0.0, 0, 0, 0, 0, 1), (5, 0.0, 35, 0.0, 60, 0.0, 0, 0, 0, 0, 1), (8, 0.0, 1, 1.0, 50, 0.0, 0, 0, 1, 0, 1),
    (3, 0.0, 50, 0.0, 30, 0.0, 0, 0, 0, 0, 1), (30, 0.0, 0, 0.0, 0, 0.0, 0, 0, 0, 0, 1), (22, 0.1, 3, 0.0, 2, 0.0, 0, 0, 0, 0, 1), (6, 0.0, 28, 0.0, 0, 0.0, 0, 0, 0, 0, 1),
    (1, 1.0, 1, 1.0, 1, 1.0, 0, 0, 0, 0, 0), (4, 0.9, 30, 0.0, 5, 0.8, 0, 0, 0, 0, 0), (30, 0.8, 5, 1.0, 5, 0.9, 0, 0, 0, 0, 0), (4, 0.0, 2, 1.0, 2, 1.0, 0, 0, 0, 0, 0), (6, 0.0, 3, 0.9, 0, 0.0, 0, 0, 0, 0, 0),
    (40, 0.0, 30, 0.0, 30, 0.0, 1, 0, 0, 0, 0), (7, 0.0, 30, 0.0, 0, 0.0, 1, 0, 0, 0, 0), (2, 1.0, 2, 1.0, 2, 1.0, 1, 0, 0, 0, 0), (12, 0.7, 40, 0.0, 3, 0.9, 0, 0, 0, 0, 0), (90, 0.0, 9, 0.0, 40, 0.0, 1, 0, 0, 0, 0),
    (1, 0.0, 22, 0.0, 3, 0.67, 0, 0, 0, 0, 1), (2, 0.0, 18, 0.0, 40, 0.0, 0, 0, 0, 0, 1), (10, 0.0, 20, 0.0, 15, 0.0, 0, 0, 0, 0, 1), (3, 0.67, 1, 0.0, 0, 0.0, 0, 0, 0, 0, 0), (3, 0.67, 40, 0.0, 0, 0.0, 0, 0, 0, 0, 0), (5, 0.6, 2, 0.0, 25, 0.0, 0, 0, 0, 0, 0), (8, 0.0, 3, 0.67, 3, 0.67, 0, 0, 0, 0, 0),
    (20, 0.0, 2, 1.0, 3, 0.67, 0, 0, 0, 0, 1), (25, 0.0, 1, 1.0, 2, 1.0, 0, 0, 0, 0, 1), (60, 0.05, 3, 1.0, 3, 1.0, 0, 0, 0, 0, 1),
)


def grow(x: np.ndarray, y: np.ndarray, depth: int = 9) -> tuple:
    """A decision tree as nested tuples: (share of main,) or (feature, cut, at most, above)."""
    share = float(y.mean())
    if depth == 0 or share in (0.0, 1.0):
        return (share,)
    best = (1e9, 0, 0.0)
    for f in range(x.shape[1]):
        v = np.unique(x[:, f])
        for cut in (v[1:] + v[:-1]) / 2:
            low = x[:, f] <= cut
            g = sum(len(s) * 2 * s.mean() * (1 - s.mean()) for s in (y[low], y[~low]))
            if g < best[0] - 1e-12:
                best = (g, f, float(cut))
    if best[0] >= len(y) * 2 * share * (1 - share):
        return (share,)
    _, f, cut = best
    low = x[:, f] <= cut
    return (f, cut, grow(x[low], y[low], depth - 1), grow(x[~low], y[~low], depth - 1))


def default_tree() -> tuple:
    rows = np.array(LABELLED, dtype=float)
    return grow(rows[:, :-1], rows[:, -1])


def is_main(tree: tuple, row: tuple) -> bool:
    while len(tree) > 1:
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree[0] >= 0.5


def markup(page: str) -> Iterator[tuple[int, int, str, bool, str]]:
    """Tags and what is passed over, in page order: begin, end, name ("" if passed over), closing, attributes.

    One forward scan. What was looked for in vain once (an end of an element, a quote, a ">") is not looked for again, so the
    time follows the length of the page however broken it is.
    """
    at, last = 0, page.rfind(">")
    missing: set[str] = set()
    quotes = True
    while (at := page.find("<", at)) >= 0:
        if page.startswith("<!--", at) or page.startswith("<![CDATA[", at):
            mark = "-->" if page[at + 2] == "-" else "]]>"
            end = page.find(mark, at + 4)
            end = len(page) if end < 0 else end + 3
            yield at, end, "", False, ""
            at = end
            continue
        if at > last:  # nothing closes: the rest is text
            return
        m = WHOLE_TAG.match(page, at)
        whole = m is not None
        m = m or TAG.match(page, at)
        if not m:
            if page[at + 1 : at + 2] in ("!", "?"):
                end = page.find(">", at) + 1
                yield at, end, "", False, ""
                at = end
            else:
                at += 1
            continue
        end = m.end()
        while quotes and not whole:
            stop = STOP.search(page, end)
            if stop and stop[0] == ">":
                end = stop.end()
                break
            shut = page.find(stop[0], stop.end()) if stop else -1
            if shut < 0:  # a quote without an end: from here on quotes are characters like others
                quotes = False
            end = shut + 1
        if not quotes and not whole:
            end = page.find(">", m.end()) + 1
        name, closing = m[2].lower(), bool(m[1])
        if not closing and name in RAW | SKIPPED and page[end - 2] != "/" and name not in missing:
            shut = ENDS[name].search(page, end)
            if shut:
                end = page.find(">", shut.end()) + 1 or len(page)
                yield at, end, "", False, ""
                at = end
                continue
            if name in RAW:
                yield at, len(page), "", False, ""
                return
            missing.add(name)
        yield at, end, name, closing, m[3] if whole else page[m.end() : end - 1]
        at = end


def blocks(page: str) -> list[tuple[str, int, float, int, int, int]]:
    """Flat blocks in page order: text, words, link density, apart, main, heading."""
    out: list[tuple[str, int, float, int, int, int]] = []
    stack: list[tuple[str, int, int]] = []
    open_: Counter[str] = Counter()
    parts: list[str] = []
    linked: list[str] = []
    apart = main = link = own = 0  # own: the paragraph or heading itself is apart
    heading = ""

    def end() -> None:
        nonlocal parts, linked
        if parts:
            text = "".join(parts)
            text = " ".join((html.unescape(text) if "&" in text else text).split())
            if text:
                words = text.count(" ") + 1
                inside = len(html.unescape(" ".join(linked)).split()) if linked else 0
                out.append((text, words, min(1.0, inside / words), int(apart + own > 0), int(main > 0), int(bool(heading))))
        parts, linked = [], []

    def close(tag: str) -> None:
        nonlocal apart, main
        while open_[tag]:
            name, a, m = stack.pop()
            open_[name] -= 1
            apart -= a
            main -= m
            if name == tag:
                return

    at = 0
    for begin, finish, tag, closing, attributes in markup(page):
        if begin > at:
            s = page[at:begin]
            parts.append(s)
            if link:
                linked.append(s)
        at = finish
        if not tag:
            parts.append(" ")
            continue
        if tag == "a":
            link = int(not closing)
            continue
        if open_["head"] and tag not in IN_HEAD:
            end()
            close("head")
        if tag in INLINE or tag in SKIPPED:
            continue
        end()
        if closing:
            own, heading = 0, ""
            close(tag)
            continue
        if tag in VOID:
            continue
        own, heading = 0, tag if tag in HEADINGS else ""
        if attributes.endswith("/"):
            continue
        names = " ".join(a or b or c for a, b, c in NAMED.findall(attributes)) if attributes else ""
        a = int(tag in APART or bool(names and APART_NAMES.search(names)))
        if tag == "p" or tag in HEADINGS:  # they end without a tag of their own
            own = a
            continue
        if tag == "li" and open_["li"]:  # so do list items, within their list
            for name, _, _ in reversed(stack):
                if name in ("ul", "ol", "menu"):
                    break
                if name == "li":
                    close("li")
                    break
        mm = int(tag in ("article", "main") or bool(names and MAIN_NAMES.search(names)) and not a)
        apart += a
        main += mm
        stack.append((tag, a, mm))
        open_[tag] += 1
    if at < len(page):
        parts.append(page[at:])
    end()
    return out


def main_text(page: str, tree: tuple) -> str:
    found = blocks(page)
    any_main = int(any(b[4] and not b[3] for b in found))
    none = ("", 0, 0.0, 0, 0, 0)
    kept = []
    for i, (text, words, links, apart, main, heading) in enumerate(found):
        b, a = found[i - 1] if i else none, found[i + 1] if i + 1 < len(found) else none
        if is_main(tree, (words, links, b[1], b[2], a[1], a[2], apart, main, heading, any_main)):
            kept.append(text)
    return " ".join(kept)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", tree: tuple | None = None) -> DataFrame:
    """One row per page: page_id, url, main text and its code points."""
    tree = tree or default_tree()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [main_text(h, tree) if h else "" for h in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(got, pa.string()), pa.array([len(x) for x in got], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    tune(pages.sparkSession)
    return pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html")).mapInArrow(run, MAIN)
