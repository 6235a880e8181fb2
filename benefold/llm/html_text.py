"""Main text of web pages: flat text blocks, classified by a decision tree.

A page is cut into flat blocks at block-level tags. Blocks in page furniture (elements and names of classes that say so, but not those of
``html`` and ``body`` nor of wrappers of most of the page) are left out; of each other block the tree sees its number of words and its link
density, those of the blocks before and after it, and whether it is a heading or lies in an article. The tree is grown on the small labelled table
below, down to pure leaves. A page is read once, in time that grows with its length.

Defined results: a null or empty page, or one without content blocks, has an empty text; scripts, styles, comments, forms and hidden
elements are no text; of these, one that is left open ends with what it lies in, or where a block starts that it can't hold (scripts and
styles: with the page), and a head has no text but that of a body it runs into; a link without end tag ends with its block; hidden is what has an attribute of this name or a style that displays
none; character references are decoded once; white space (no-break too) becomes one space; broken or unclosed
tags never raise; repeated rows stay; other columns are ignored.
"""

from __future__ import annotations

import functools
import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, functions as F

from .common import tidy

FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "article", "heading")
#: Neighbours in the labelled table: none, a short line, a text, a link; (words, link density) of some.
_BESIDE = {"N": ((0, 0.0),) * 3, "S": ((4, 0.0), (1, 0.0), (9, 0.1)), "T": ((60, 0.0), (16, 0.1), (200, 0.3)), "L": ((2, 1.0), (9, 0.8), (40, 1.0))}
_ALL = "NN NS NT NL SN SS ST SL TN TS TT TL LN LS LT LL"
#: The labelled table the tree is grown on: words, link density, article, heading; the neighbours with which it is content, and those with which it isn't.
LABELLED = (
    # text outside of marked elements, with few links or some
    (15, 0.0, 0, 0, _ALL, ""), (22, 0.1, 0, 0, _ALL, ""), (40, 0.0, 0, 0, _ALL, ""), (70, 0.3, 0, 0, _ALL, ""), (150, 0.05, 0, 0, _ALL, ""), (30, 0.4, 0, 0, _ALL, ""), (18, 0.0, 0, 1, _ALL, ""),
    # menus, lists of links, teasers, short or long
    (1, 1.0, 0, 0, "", _ALL), (2, 0.7, 0, 0, "", _ALL), (5, 0.5, 0, 0, "", _ALL), (6, 0.8, 0, 0, "", _ALL), (12, 1.0, 0, 0, "", _ALL), (14, 0.7, 0, 0, "", _ALL), (40, 0.9, 0, 0, "", _ALL), (200, 1.0, 0, 0, "", _ALL),
    (3, 1.0, 0, 1, "", _ALL), (9, 0.7, 0, 1, "", _ALL), (40, 0.6, 0, 0, "", _ALL),
    # short lines: with text beside them they belong to it, others are labels, dates, buttons; one that ends the page is its foot
    (1, 0.0, 0, 0, "NT ST TS TT TL LT", "NN NS NL SN SS SL TN LN LS LL"), (4, 0.0, 0, 0, "NT ST TS TT TL LT", "NN NS NL SN SS SL TN LN LS LL"),
    (8, 0.1, 0, 0, "NT ST TN TS TT TL LT", "NN NS NL SN SS SL LN LS LL"), (11, 0.0, 0, 0, "NT ST TN TS TT TL LT", "NN NS NL SN SS SL LN LS LL"),
    (3, 0.0, 0, 1, "NT ST TS TT TL LT", "NN NS NL SN SS SL TN LN LS LL"), (9, 0.0, 0, 1, "NT ST TN TS TT TL LT", "NN NS NL SN SS SL LN LS LL"),
    # in an article: all text, whatever lies beside it
    (1, 0.0, 1, 0, _ALL, ""), (4, 0.3, 1, 0, _ALL, ""), (12, 0.6, 1, 0, _ALL, ""), (60, 0.0, 1, 0, _ALL, ""), (150, 0.5, 1, 0, _ALL, ""), (6, 0.0, 1, 1, _ALL, ""),
    # in an article: headings that are links, a linked line in the text; but lists of links are menus
    (2, 1.0, 1, 1, _ALL, ""), (12, 1.0, 1, 1, _ALL, ""), (1, 1.0, 1, 0, "NN NS NT SN SS ST TN TS TT", "NL SL TL LN LS LT LL"), (5, 0.8, 1, 0, "NN NS NT SN SS ST TN TS TT", "NL SL TL LN LS LT LL"),
    (12, 1.0, 1, 0, "NN NS NT SN SS ST TN TS TT", "NL SL TL LN LS LT LL"), (60, 0.9, 1, 0, "NN NS NT SN SS ST TN TS TT", "NL SL TL LN LS LT LL"),
)


def labelled_table() -> list[tuple]:
    """Rows of ``FEATURES`` and 1 for content: the labelled blocks beside each of their neighbours."""
    rows = []
    for words, links, article, heading, *said in LABELLED:
        for content, pairs in zip((1, 0), said, strict=True):
            for before, after in pairs.split():
                rows += [(words, links, *_BESIDE[before][i], *_BESIDE[after][j], article, heading, content) for i in range(3) for j in range(3)]
    return rows


# Fixed names.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q s samp small span strike strong sub sup time tt u var wbr label".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NO_TEXT = frozenset("script style noscript template svg math title textarea select button iframe object canvas audio video".split())
#: Those that hold no blocks, and blocks.
FLAT = frozenset("svg math title textarea select button iframe".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section "
    "table tbody td tfoot th thead tr ul".split())
FURNITURE = frozenset("nav aside footer form dialog menu".split())
ARTICLE = frozenset("article main".split())
ONE = frozenset("p li dt dd tr td th option".split())
STICKY = frozenset("comment comments respond reply replies discussion disqus".split())
NAMES = STICKY | frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent notice notices alert sidebar side menu nav navbar navigation "
    "breadcrumb breadcrumbs footer header masthead topbar share sharing social related recommended newsletter subscribe signup login popup modal toolbar pagination pager widget".split())
#: Parts of class names that say something of what lies elsewhere: has-sidebar, no-footer.
_SAID_OF = frozenset("has have with without no not is hide show hidden toggle layout theme template".split())
#: Share of a page's words from which on an element is the page's wrapper, whatever its class.
WRAPPER = 0.7
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_MARK = re.compile(r"=\s*([\"'])|>")
_NAMED = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"?|'([^']*)'?|([^\s>]+)))?")
_HIDDEN, _NO_DISPLAY, _HREF = re.compile(r"hidden|display", re.I), re.compile(r"(?:^|;)\s*display\s*:\s*none\b", re.I), re.compile(r"(?:^|[\s\"'/])href\s*=", re.I)
_PART = re.compile(r"[^a-z0-9]+")
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
#: Elements whose content is no markup, up to their end tag; without one the first two end with the page.
RAW = ("script", "style", "title", "textarea", "iframe")
TEXT, START, END = 0, 1, 2


def grow(table: np.ndarray) -> tuple:
    """A decision tree by Gini impurity, down to leaves of one label: (share of content,) or (feature, limit, at most, above)."""
    y = table[:, -1]
    if y.min() == y.max():
        return (float(y.mean()),)
    best = None
    for f in range(table.shape[1] - 1):
        values = np.unique(table[:, f])
        for limit in (values[1:] + values[:-1]) / 2:
            low = table[:, f] <= limit
            cost = sum(len(part) * part.mean() * (1 - part.mean()) for part in (y[low], y[~low]))
            if best is None or cost < best[0] - 1e-12:
                best = cost, f, float(limit), low
    if best is None:
        return (float(y.mean()),)
    _, f, limit, low = best
    return f, limit, grow(table[low]), grow(table[~low])


@functools.cache
def tree() -> tuple:
    return grow(np.array(labelled_table(), float))


def is_content(features: tuple) -> bool:
    node = tree()
    while len(node) > 1:
        node = node[2] if features[node[0]] <= node[1] else node[3]
    return node[0] >= 0.5


def is_hidden(attributes: str) -> bool:
    if not _HIDDEN.search(attributes):
        return False
    return any((name := m[1].lower()) == "hidden" or (name == "style" and _NO_DISPLAY.search(m[2] or m[3] or m[4] or "")) for m in _ATTRIBUTE.finditer(attributes))


def _place(name: str, attributes: str, outer: tuple[int, int, int, int], named: list[tuple[int, int]]) -> tuple[int, int, int, int]:
    """(article, furniture, sticky, by) inside of an element, from those outside of it.

    by: the innermost element that is furniture by its class, id or role only, as a number in ``named``, which keeps what it lies in; 0: none.
    """
    article, _, sticky, by = outer
    parts = {p for m in _NAMED.finditer(attributes) for t in (m[1] or m[2] or m[3] or "").lower().split() if not _SAID_OF.intersection(x := _PART.split(t)) for p in x} if attributes else set()
    if name in ("html", "body"):
        return outer
    if name in ARTICLE and not parts & STICKY:
        return (1, 0, 0, 0) if not sticky else outer
    if name in FURNITURE or parts & STICKY:
        return 0, 1, 1, 0
    if name == "header" and not article:
        return 0, 1, sticky, 0
    names = parts & NAMES
    if names and not (article and names <= {"header", "side"}) and not sticky:
        named.append((by, article))
        return article, 1, sticky, len(named) - 1
    return outer


def tokens(page: str) -> list[tuple[int, str, str]]:
    """(kind, text or name, attributes) of a page's texts and tags, in one forward pass.

    A quote opens a value after an equals sign only; a tag whose value isn't closed ends at its first ``>``. Marks that led nowhere
    once are remembered, so no part of a page is read again for each tag before it.
    """
    out: list[tuple[int, str, str]] = []
    lead_nowhere: set[int] = set()
    lacking: set[str] = set()
    at, n, last = 0, len(page), page.rfind(">")

    def tag_end(at: int) -> int:
        start, path = at, []
        while (m := _MARK.search(page, at)) and m.start() not in lead_nowhere:
            if not m[1]:
                return m.start()
            path.append(m.start())
            close = page.find(m[1], m.end())
            if close < 0:
                break
            at = close + 1
        lead_nowhere.update(path)
        return page.find(">", start)

    while at < n:
        k = page.find("<", at)
        if k != at:
            out.append((TEXT, page[at: n if k < 0 else k], ""))
        if k < 0:
            break
        at = k
        if page.startswith("<!--", at):
            end = page.find("-->", at + 2)
            at = n if end < 0 else end + 3
            continue
        if at > last:
            out.append((TEXT, page[at:], ""))
            break
        m = _TAG.match(page, at)
        if m is None:
            if page[at + 1: at + 2] in ("!", "?", "/"):
                at = page.find(">", at) + 1
            else:
                out.append((TEXT, "<", ""))
                at += 1
            continue
        end, name = tag_end(m.end()), m[2].lower()
        out.append((END if m[1] else START, name, page[m.end():end]))
        at = end + 1
        if not m[1] and name in RAW and name not in lacking and page[end - 1] != "/":
            stop = re.compile(rf"</{name}(?=[\s/>])", re.I).search(page, at)
            if stop:
                at = stop.start()
            elif name in RAW[:2]:
                break
            else:
                lacking.add(name)
    return out


def end_tags(found: list[tuple[int, str, str]]) -> dict[int, int]:
    """Place of the end tag of each start tag that has one, elements of the same name nested."""
    of: dict[int, int] = {}
    left: dict[str, list[int]] = {}
    for k, (kind, name, attributes) in enumerate(found):
        if kind == START and not attributes.endswith("/"):
            left.setdefault(name, []).append(k)
        elif kind == END and left.get(name):
            of[left[name].pop()] = k
    return of


def blocks(page: str) -> list[tuple[str, int, int, int, int, int]]:
    """(text, words, words in links, article, furniture, heading) of each flat block with text, in page order.

    An element that is furniture by name only, and holds ``WRAPPER`` of the page's words or more, is the page's wrapper and no furniture.
    """
    out: list[tuple[str, int, int, tuple[int, int, int, int], int]] = []
    stack: list[tuple[str, tuple[int, int, int, int]]] = []
    open_names: Counter[str] = Counter()
    named: list[tuple[int, int]] = [(0, 0)]
    here, links, linked = (0, 0, 0, 0), 0, 0
    pieces: list[str] = []

    def close() -> None:
        nonlocal linked, links
        if pieces:
            words = "".join(pieces).split()
            if words:
                out.append((" ".join(words), len(words), min(linked, len(words)), here, int(any(x in HEADINGS for x, _ in stack[-2:]))))
            pieces.clear()
        linked = 0
        links = links if links == 2 else 0  # a link left open ends with its block

    found = tokens(page)
    ends = end_tags(found)
    at = 0
    while at < len(found):
        kind, name, attributes = found[at]
        at += 1
        if kind == TEXT:
            text = entities.unescape(name) if "&" in name else name
            pieces.append(text)
            if links:
                linked += len(text.split())
            continue
        if name == "br":
            pieces.append(" ")
            continue
        if name == "head":
            close()
            continue
        if kind == START and (name in NO_TEXT or (name not in VOID and attributes and is_hidden(attributes))):
            if name not in INLINE:
                close()
            if not attributes.endswith("/"):
                if at - 1 in ends:
                    at = ends[at - 1] + 1
                elif name in NO_TEXT:
                    at = _open_end(found, at, name, stack[-1][0] if stack else "")
            continue
        if name == "a":
            links = 0 if kind == END or not _HREF.search(attributes) else 2 if at - 1 in ends else 1
            continue
        if name in INLINE:
            continue
        close()
        if name in VOID:
            continue
        if kind == END:
            if open_names[name]:
                while True:
                    last, here = stack.pop()
                    open_names[last] -= 1
                    if last == name:
                        break
        else:
            if name in ONE and stack and stack[-1][0] == name:
                here = stack.pop()[1]  # these close one of their own kind
                open_names[name] -= 1
            stack.append((name, here))
            open_names[name] += 1
            here = _place(name, attributes, here, named)
    close()
    return _without_wrappers(out, named)


def _without_wrappers(found: list[tuple], named: list[tuple[int, int]]) -> list[tuple[str, int, int, int, int, int]]:
    words = [0] * len(named)
    for _, n, _, (_, _, _, by), _ in found:
        words[by] += n
    total = sum(words)
    for k in range(len(named) - 1, 0, -1):  # inner ones have larger numbers
        words[named[k][0]] += words[k] if named[k][0] else 0
    wrapper = [k > 0 and words[k] >= WRAPPER * total for k in range(len(named))]
    return [(text, n, links, article if not by or wrapper[by] else 0, furniture if not wrapper[by] else 0, heading) for text, n, links, (article, furniture, _, by), heading in found]


def _open_end(found: list[tuple[int, str, str]], at: int, name: str, parent: str) -> int:
    """Where an element whose content is no text ends if it has no end tag: with what it lies in, or before a block that it can't hold."""
    inside: list[str] = []
    names: Counter[str] = Counter()
    for k in range(at, len(found)):
        kind, tag, attributes = found[k]
        if kind == END:
            if not names[tag]:
                return k
            while True:
                last = inside.pop()
                names[last] -= 1
                if last == tag:
                    break
        elif kind == START:
            if name in FLAT and (tag in BLOCK or tag == name) or not inside and tag in ONE and tag == parent:
                return k
            if tag not in VOID and not attributes.endswith("/"):
                inside.append(tag)
                names[tag] += 1
    return len(found)


def main_text(page: str | None) -> str:
    found = [b for b in blocks(page or "") if not b[4]]  # furniture is no neighbour
    shape = [(0, 0.0), *((b[1], b[2] / b[1]) for b in found), (0, 0.0)]
    return " ".join(b[0] for i, b in enumerate(found, 1) if is_content((*shape[i], *shape[i - 1], *shape[i + 1], b[3], b[5])))


def _extract(batches: Iterator) -> Iterator:
    import pyarrow as pa

    for batch in batches:
        texts = pa.array([main_text(x) for x in batch.column("html").to_pylist()], pa.string())
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("url"), texts], names=["id", "url", "text"])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text) of every page."""
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return rows.mapInArrow(tidy(_extract), "id long, url string, text string")


def op9(spark, sf_dir: str) -> DataFrame:
    from .common import table

    out = extract(table(spark, sf_dir, "pages"))
    return out.select(F.col("id").alias("page_id"), "url", "text", F.length("text").cast("long").alias("n_chars"))
