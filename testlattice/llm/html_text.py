"""HTML extraction by line-block distribution.

Markup is stripped into lines: one for each block of the page, split at block elements and line breaks. A line counts with the length
of its text; lines of menus, headers, footers, sidebars, notices, adverts, forms and comments (by element, role, class or id) and lines that are mostly
links count with 0. Sums over windows of three lines form the distribution: text begins where a sum surges over the threshold,
ends where the sum dives to 0, and what lies between is kept. A page that marks its article (``article``, ``main``) has all other lines at 0. Of several marked articles
those stay whose own windows surge, all if none does; of the others only cards go: articles of links, such with a heading of third order or lower, and such with a
heading or a link whose pattern of blocks comes several times. Within what stays the threshold is one character, so that no short paragraph of the article is lost.

On a page that marks none, windows run over the lines that markup leaves, and the block container that holds a surge keeps all its other lines too, such as headings,
bylines, short paragraphs and paragraphs of links; headings of first order are kept wherever they count.

Classes and ids are matched as whole names: hints, alone or joined to each other and to words of place (``cookie-notice``, ``site-footer``), not ``has-sidebar``. They never
mark an article or an element that holds one; only names of comments do, and only on a page that has text in an article elsewhere. Inside an article a class alone takes no
element with more than half of the article's text, and words that an article may well use for its own parts (``menu``, ``social``, ``notice``) take only what is mostly links. A form counts as part of the
page if it holds an article, a heading of first order or a header, menu or footer, or if nothing else counts.

Defined results: null and text-free pages give ''; repeated pages give repeated rows, an empty table gives none; character references are decoded; any white space within a line becomes one blank;
lines are trimmed and joined by one newline; a page whose sums never reach the threshold keeps all lines that count.
"""

from __future__ import annotations

import functools
import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, utf8

LINES, SURGE, LINK_SHARE = 3, 80, 0.6

# Elements of HTML by their part in a page.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style title textarea noscript iframe noframes template xmp".split())
SKIPPED = frozenset("head nav footer aside form button select option dialog menu svg canvas audio video object map datalist fieldset".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
BLOCK = frozenset("address article aside blockquote body br center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody tfoot thead tr ul caption".split())
HINTS = frozenset(
    "ad ads adv advert adverts advertisement advertising adbox adslot adsense banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices notification alert popup modal overlay menu menus submenu nav navbar navigation breadcrumb breadcrumbs "
    "sidebar sidenav aside footer masthead topbar toolbar comment comments commentlist respond reply replies disqus share sharing social related recommended recommendations newsletter subscribe subscription signup login search pagination pager widget skip".split()
)
VAGUE = frozenset("menu menus notice notices notification alert promotion social share sharing related recommended recommendations search skip pager widget popup overlay".split())  # of the hints, those that an article's own parts may have
CONTAINERS = frozenset("div section td th table tbody tr center dd details blockquote form".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
TEASER = frozenset("h3 h4 h5 h6".split())
PLACES = frozenset("site page main top bottom primary secondary global mobile desktop list item items area box bar block container wrapper wrap inner section form button buttons link links icons posts articles slot unit title thread header".split())
THREAD = frozenset("comment comments commentlist respond reply replies disqus".split())
WRAPPED = frozenset("article main nav header footer h1".split())  # what a form that wraps a page holds
NO, WEAK, HINT, COMMENT, FORM, SURE = range(6)  # why an element is outside the article
NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
REST = re.compile(r"""(?:[^>=]+|=\s*(?:"[^"]*"|'[^']*')|=)*+>""")
ATTRIBUTE = re.compile(r"""([a-zA-Z_:][\w:.-]*)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")


def _attributes(text: str) -> dict[str, str]:
    return {k.lower(): v.strip("\"'").lower() for k, v in ATTRIBUTE.findall(text)} if text and not text.isspace() else {}


@functools.lru_cache(65536)
def _hint(name: str) -> int:
    """What a whole class name or id says: nothing, something other than the article, or comments."""
    parts = [x for x in re.split(r"[^a-z0-9]+", name) if x and not x.isdigit()]
    hints = HINTS.intersection(parts)
    if not hints or not all(x in HINTS or x in PLACES for x in parts):
        return NO
    return COMMENT if hints & THREAD else WEAK if hints <= VAGUE else HINT


def _header(name: str) -> bool:
    parts = [x for x in re.split(r"[^a-z0-9]+", name) if x]
    return "header" in parts and all(x == "header" or x in PLACES for x in parts)


def _outside(name: str, attributes: dict[str, str], in_article: bool) -> int:
    """Whether, and why, an element holds something other than the article."""
    if name == "form":
        weak = FORM
    elif name in SKIPPED or name == "header" and not in_article:
        return SURE
    else:
        weak = NO
    if not attributes or name in ("html", "body", "main"):
        return weak
    if "hidden" in attributes or attributes.get("aria-hidden") == "true" or "display:none" in attributes.get("style", "").replace(" ", "") or attributes.get("role") in ROLES:
        return SURE
    if weak:
        return weak
    names = f"{attributes.get('class', '')} {attributes.get('id', '')}".split()
    return max(map(_hint, names), default=NO) or (HINT if not in_article and any(map(_header, names)) else NO)


def tags_of(page: str) -> Iterator[tuple[str, str, bool, str]]:
    """(text before it, name, whether it closes, its attributes) of every tag; the last item has no name.

    A comment or raw element that never ends takes the rest of the page. A value in quotes may hold ``>``; a tag that would then never end stops at its first ``>``, and so do
    all after it. Nothing is read twice for each of many tags, so time grows with the length of the page.
    """
    at, start, last, quoted = 0, 0, page.rfind(">"), True
    text: list[str] = []
    while 0 <= (at := page.find("<", at)):
        if page.startswith(("<!", "<?"), at):
            text.append(page[start:at])
            comment = page.startswith("<!--", at)
            stop = page.find("-->" if comment else ">", at + (4 if comment else 2))
            at = start = stop + (3 if comment else 1) if stop >= 0 else len(page)
            continue
        if at > last:
            break
        head = NAME.match(page, at)
        if not head:
            at += 1
            continue
        rest = REST.match(page, head.end()) if quoted else None
        if quoted and not rest:
            quoted = False
        stop = rest.end() if rest else page.find(">", head.end()) + 1
        if not stop:
            break
        text.append(page[start:at])
        name = head[2].lower()
        yield "".join(text), name, bool(head[1]), page[head.end() : stop - 1]
        text.clear()
        if name in RAW and not head[1]:
            end = re.compile(rf"</{name}\b[^>]*>?", re.I).search(page, stop)
            stop = end.end() if end else len(page)
        at = start = stop
    text.append(page[start:])
    yield "".join(text), "", False, ""


def blocks_of(page: str) -> tuple[list[tuple[str, int, bool, bool]], list[int], list[int], list[str], list[int]]:
    """Lines, the element of each, and the parent, name and outermost article of every element; element 0 is the page.

    A line is (text, characters in links, outside the article by markup, inside a marked article).
    """
    out: list[tuple[str, int, int]] = []
    stack: list[tuple[str, int]] = []  # name, element
    names = [""]
    up, why, inside = [-1], [NO], [False]  # parent, reason to be outside and being in an article, of each element; 0 is the page
    holds = [False]  # whether an article begins at or in the element
    root = [0]  # the outermost article, other than the page's main part, around the element
    top = [0]  # the same, or the main part
    parts: list[str] = []
    linked = 0

    def line() -> None:
        nonlocal linked
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            out.append((text, linked, stack[-1][1] if stack else 0))
        parts.clear()
        linked = 0

    links = 0
    opened: dict[str, int] = {}  # open elements by name
    forms: list[int] = []  # open forms that are not known to wrap the page

    def close() -> str:
        nonlocal links
        name, k = stack.pop()
        opened[name] -= 1
        links -= name == "a"
        if forms and forms[-1] == k:
            forms.pop()
        return name

    for text, name, closing, rest in tags_of(page):
        if text:
            parts.append(text)
            if links:
                linked += len(text)
        if not name or name in RAW:
            continue
        if name in BLOCK:
            line()
        elif name in ("td", "th"):
            parts.append(" ")
        if name in VOID:
            continue
        if closing:
            if opened.get(name):
                while close() != name:
                    pass
            continue
        if name in BLOCK and opened.get("p"):  # a block ends an open paragraph
            while stack[-1][0] not in ("p", "article", "main", "section", "div", "td", "li", "nav", "footer", "header", "aside", "form"):
                close()
            if stack[-1][0] == "p":
                close()
        if rest.endswith("/") and name in ("svg", "path"):
            continue
        parent = stack[-1][1] if stack else 0
        attributes = _attributes(rest)
        starts = name in ("article", "main") or attributes.get("role") in ("main", "article")
        up.append(parent)
        names.append(name)
        why.append(_outside(name, attributes, inside[parent]))
        inside.append(inside[parent] or starts)
        holds.append(False)
        k = len(up) - 1
        top.append(top[parent] or k * starts)
        root.append(root[parent] or k * (starts and name != "main" and attributes.get("role") != "main"))
        if starts and why[k] != SURE:
            while k > 0 and why[k] != SURE and not holds[k]:
                holds[k] = True
                k = up[k]
        if starts or name in WRAPPED or attributes.get("role") in ("navigation", "banner", "contentinfo"):
            for k in forms:  # a form around it is the page
                why[k] = NO
            forms.clear()
        k = len(up) - 1
        stack.append((name, k))
        opened[name] = opened.get(name, 0) + 1
        links += name == "a"
        if why[k] == FORM:
            forms.append(k)
    line()

    whole, linking = [0] * len(up), [0] * len(up)  # characters, and those in links, of each element
    for text, n, k in out:
        whole[k] += len(text)
        linking[k] += n
    for k in range(len(up) - 1, 0, -1):
        whole[up[k]] += whole[k]
        linking[up[k]] += linking[k]

    def named(k: int) -> bool:
        """Whether a class or id is enough to take an element out."""
        if holds[k]:
            return False
        if not inside[up[k]] or linking[k] > LINK_SHARE * whole[k]:
            return True
        return why[k] == HINT and 2 * whole[k] <= whole[top[k]]

    def marked(comments: bool) -> list[bool]:
        outside = [False]
        for k in range(1, len(up)):
            own = why[k] in (FORM, SURE) or why[k] in (WEAK, HINT) and named(k) or why[k] == COMMENT and (comments or not holds[k])
            outside.append(outside[up[k]] or own)
        return outside

    outside = marked(True)
    if not any(inside[k] and not outside[k] for _, _, k in out):
        outside = marked(False)
    if all(outside[k] for _, _, k in out):  # nothing but forms
        why[:] = [NO if x == FORM else x for x in why]
        outside = marked(False)
    return [(text, n, outside[k], inside[k]) for text, n, k in out], [k for _, _, k in out], up, names, root


def lines_of(page: str) -> list[tuple[str, int, bool, bool]]:
    return blocks_of(page)[0]


def weights_of(lines: list[tuple[str, int, bool, bool]]) -> tuple[list[int], int]:
    """Length with which each line counts, and the surge threshold."""
    marked = any(article and not outside for _, _, outside, article in lines)
    if marked:
        return [len(text) if article and not outside else 0 for text, _, outside, article in lines], 1
    return [0 if outside or linked > LINK_SHARE * len(text) else len(text) for text, linked, outside, _ in lines], SURGE


def between(weights: list[int], surge: int) -> list[bool]:
    """Lines between a surge of the window sums to ``surge`` and the dive to 0."""
    n = len(weights)
    total = [0]
    for w in weights:
        total.append(total[-1] + w)
    sums = [total[min(n, i + LINES)] - total[i] for i in range(n)]
    keep, i = [False] * n, 0
    while i < n:
        if not sums[i]:
            i += 1
            continue
        stop = i
        while stop < n and sums[stop]:
            stop += 1
        if max(sums[i:stop]) >= surge:
            for k in range(i, min(n, stop)):
                keep[k] = weights[k] > 0
        i = stop
    return keep if any(keep) else [w > 0 for w in weights]


def held(weights: list[int], elements: list[int], up: list[int], names: list[str], keep: list[bool]) -> list[bool]:
    """``keep`` and the lines that belong to a block container that holds the surge, of a page without a marked article.

    A line's container is the innermost element of CONTAINERS around it with several lines. Containers whose own lines weigh SURGE keep all their lines; of the page itself, which
    holds menus too, those that count, headings, and all of its own between its first and last that count but lists of links. Between two such containers of one parent, lines that count are kept.
    """
    several = [0] * len(up)
    for k in elements:
        several[k] += 1
    for k in range(len(up) - 1, 0, -1):
        several[up[k]] += several[k]
    page = [True] * len(up)  # html, body and what holds no container of its own
    box = [0] * len(up)  # container of each element
    for k in range(1, len(up)):
        page[k] = page[up[k]] and names[k] in ("html", "body")
        box[k] = k if names[k] in CONTAINERS and several[k] > 1 and not page[k] else 0 if page[k] else box[up[k]]
    own = [0] * len(up)
    for w, k in zip(weights, elements, strict=True):
        own[box[k]] += w
    surges = [x >= SURGE for x in own]
    if not any(surges):
        return [k or bool(w) and names[e] == "h1" for k, w, e in zip(keep, weights, elements, strict=True)] if any(keep) else keep

    within = [False] * len(up)
    for k in range(1, len(up)):
        within[k] = within[up[k]] or box[k] == k and surges[k]
    heading, item = [False] * len(up), [False] * len(up)
    for k in range(1, len(up)):
        heading[k] = heading[up[k]] or names[k] in HEADINGS
        item[k] = item[up[k]] or names[k] == "li"
    keep = [a or within[k] or bool(w) and names[k] == "h1" for a, w, k in zip(keep, weights, elements, strict=True)]
    if surges[0]:
        mine = [i for i, k in enumerate(elements) if not box[k]]
        counted = [i for i in mine if weights[i]]
        for i in mine:
            keep[i] = keep[i] or weights[i] > 0 or heading[elements[i]] or counted[0] < i < counted[-1] and not item[elements[i]]
    spans: dict[int, list[int]] = {}  # parent: first and last line of its surging containers, and their number
    last = -1
    for i, k in enumerate(elements):
        at = box[k]
        while at and not surges[at]:
            at = box[up[at]]
        if at:
            span = spans.setdefault(box[up[at]], [i, i, 0])
            span[1] = i
            span[2] += at != last
            last = at
    for first, end, n in spans.values():
        if n > 1:
            for i in range(first, end):
                keep[i] = keep[i] or weights[i] > 0
    return keep


def surging(weights: list[int], articles: list[int], links: list[int], blocks: list[str]) -> list[int]:
    """Weights without the lines of cards and teasers: articles whose own windows never surge, beside one whose do, if they are mostly links, are headed by a lower heading, or have a heading or a link and a pattern of blocks that several of them have."""
    own: dict[int, list[int]] = {}
    for i, at in enumerate(articles):
        own.setdefault(at, []).append(i)
    top = {at: max(sum(weights[i] for i in lines[k : k + LINES]) for k in range(len(lines))) for at, lines in own.items()}
    if max((n for at, n in top.items() if at), default=0) < SURGE:
        return weights
    short = [at for at, n in top.items() if at and n < SURGE]
    pattern = {at: tuple(blocks[i] for i in own[at] if weights[i]) for at in short}
    often = Counter(pattern.values())
    cards = set()
    for at in short:
        linked, length = sum(links[i] for i in own[at]), sum(weights[i] for i in own[at])
        if linked > LINK_SHARE * length or TEASER.intersection(pattern[at]) or often[pattern[at]] > 1 and (linked or HEADINGS.intersection(pattern[at])):
            cards.add(at)
    return [0 if at in cards else w for at, w in zip(articles, weights, strict=True)]


def main_text(page: str) -> str:
    lines, elements, up, names, root = blocks_of(page)
    weights, surge = weights_of(lines)
    if surge == SURGE:  # no marked article: lines outside by markup don't part the others
        here = [i for i, x in enumerate(lines) if not x[2]]
        lines, elements, weights = ([x[i] for i in here] for x in (lines, elements, weights))
        keep = held(weights, elements, up, names, between(weights, surge))
    else:
        keep = between(surging(weights, [root[k] for k in elements], [x[1] for x in lines], [names[k] for k in elements]), surge)
    return "\n".join(text for (text, *_), k in zip(lines, keep, strict=True) if k)


def html_text(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """All columns of ``pages`` but the page itself, with ``text`` and ``n_chars``; columns of these names give way."""
    kept = [c for c in pages.columns if c not in (html_col, "text", "n_chars")]
    rows = pages.select(*kept, F.col(html_col).alias("_html"))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [main_text(x.decode("utf-8", "replace")) for x in utf8(batch, "_html")]
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], [*kept, "text", "n_chars"])

    schema = pages.select(*kept).withColumns({"text": F.lit(""), "n_chars": F.lit(0).cast("long")}).schema
    return map_batches(rows, work, schema)
