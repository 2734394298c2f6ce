"""Main text of web pages by tag-path ratios.

A page is read once, in time linear in its length, into text nodes, each with its root-to-leaf tag path. Elements that
never hold an article (menus, page headers, footers, asides, scripts) are left out with all they hold, and so is a form that
doesn't hold most of the page. Over the other nodes, text length and punctuation are summed per tag path; a node's ratio is
its path's mean text length times its mean punctuation, smoothed over neighbouring nodes, and nodes at or over the page's
threshold are content. A class, id or role that speaks against an element only lowers the ratios of what it holds, and not
where it is or holds an article or a large share of the page; its nodes have paths of their own and stay if they still
reach the threshold, but don't tell where the article is. All
of them are returned with the nodes between them, bounded only by an article or main element (or several together) that
holds all or nearly all their weight; without one, the smallest element with most of the weight stays whole besides. Its
other paths stay, unless they are runs of links without punctuation, and so does the heading before the first node.

Defined cases: null html is empty text; text outside any tag counts as the body's; unclosed elements end with their
parent; a tag whose quotes don't close ends at the next ">", and one that doesn't end is markup to the end of the page;
elements more than DEEPEST deep stand beside each other; nothing is cut from long pages; repeated rows and null ids give a
row each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kvstrata.llm.memo import slices
from kvstrata.sources.shipping import ship_package

#: Fixed values of HTML: elements by how they nest and break lines.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript template iframe noframes xmp svg math".split())
BLOCK = frozenset("address article aside blockquote body br center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
ENDS_P = BLOCK - frozenset("br body head html option td th tr tbody thead tfoot".split())
SAME = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "tbody": ("tbody", "thead", "tr", "td", "th"), "tfoot": ("tbody", "thead", "tr", "td", "th")}
SCOPE = frozenset("table ul ol dl select article section div body main".split())
#: Elements and class, id or role words that mark what isn't the article.
NEVER = frozenset("head nav header footer aside button select dialog menu audio video canvas object map".split())
HINT = re.compile(
    r"(?:ad|ads|adv|advert\w*|adbox|adsense|banner\w*|sponsor\w*|promo\w*|nav|navbar|navigation|menu\w*|breadcrumb\w*|sidebar\w*|side|widget\w*|footer\w*|header|masthead|topbar|cookie\w*|consent|gdpr|notice\w*|alert\w*|popup\w*|modal\w*|overlay|newsletter\w*|subscri\w+|signup|login|comment\w*|disqus\w*|repl(?:y|ies)|respond|discussion|share|sharing|social\w*|related\w*|recommend\w*|toolbar|pagination|pager|search\w*|form|complementary|contentinfo|skip|legal|copyright|disclaimer)",
    re.I,
)
#: Parts of names that leave a hint beside them what it is, and those that make it a state of something else.
PLAIN = re.compile(r"|\d+|area|bar|block|body|bottom|box|btn|buttons?|col|column|container|content|div|global|group|icons?|inner|items?|left|links?|list|main|outer|page|panel|posts?|articles?|primary|right|section|secondary|site|text|title|top|wrap|wrapper", re.I)
STATE = frozenset("with without has no not non is".split())
#: Whose header is the article's own.
OWN = frozenset("post article entry story".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
TAG = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
EDGE = re.compile(r">|=\s*([\"'])")
#: A tag with more quoted values ends at its first ">".
MOST_VALUES = 64
DEEPEST = 512
NAMED = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)
MAIN = re.compile(r"role\s*=\s*[\"']?main\b|itemprop\s*=\s*[\"']?articleBody\b", re.I)
PUNCTUATION = re.compile(r"[.,;:!?…。，、！？]")
NEAR_ALL = 0.8
NEARLY_ALL = 0.95
#: A hint multiplies ratios by LOWERED, unless its element holds LARGE of the page's ratio weight.
LOWERED = 0.2
LARGE = 0.5
#: The same share on a page that has an article or main element outside it.
LARGE_BESIDE = 0.9
#: A form stays only if it holds such a share and a text at least so long with punctuation.
PROSE = 40


class Element:
    __slots__ = ("tag", "parent", "out", "path", "depth", "weight", "main", "link", "hint", "form", "inside", "listed", "heading", "low", "within")

    def __init__(self, tag: str, parent: Element | None, out: bool, main: bool, path: int, hint: bool = False):
        self.tag, self.parent, self.weight = tag, parent, 0.0
        self.out = out or bool(parent and parent.out)
        self.main, self.path, self.depth = main, path, parent.depth + 1 if parent else 0
        self.link = tag == "a" or bool(parent and parent.link)
        self.hint, self.form, self.inside = hint, tag == "form", main or bool(parent and parent.inside)
        self.listed = bool(parent and (parent.listed or parent.tag == "li"))
        self.heading = tag if tag in HEADINGS else parent.heading if parent else ""
        self.low = self.within = False

    def up(self) -> Iterator[Element]:
        e: Element | None = self
        while e is not None:
            yield e
            e = e.parent


@lru_cache(4096)
def strength(name: str) -> int:
    """2 for a name whose parts all are hints or plain, 1 for one that has a hint among other parts, else 0."""
    parts = re.split("[-_]+", name)
    hints, plain = [bool(HINT.fullmatch(p)) for p in parts], {p.lower() for p in parts}
    if not any(hints) or not STATE.isdisjoint(plain) or "header" in plain and not OWN.isdisjoint(plain):
        return 0
    return 2 if all(h or PLAIN.fullmatch(p) for h, p in zip(hints, parts, strict=True)) else 1


def hinted(tag: str, named: list[tuple[str, str, str, str]], inside: bool) -> bool:
    """Whether class, id or role say so. Inside an article, sections and headings have ids of their subject, and compound names are of its matter."""
    return any(strength(name) > inside for key, *values in named if not (inside and key.lower() == "id" and (tag == "section" or tag in HEADINGS)) for name in "".join(values).split())


def tags(page: str) -> Iterator[tuple[int, int, str, str, str]]:
    """Begin, end, slash, name (empty for comments and declarations) and attributes of each piece of markup, in one pass."""
    at, unclosed = 0, set()
    while (k := page.find("<", at)) >= 0:
        if page.startswith(("<!", "<?"), k):
            close = "-->" if page.startswith("<!--", k) else ">"
            at = page.find(close, k + 2)
            at = len(page) if at < 0 else at + len(close)
            yield k, at, "", "", ""
        elif m := TAG.match(page, k + 1):
            at, values = m.end(), 0
            while (edge := EDGE.search(page, at)) and edge[1]:
                end = -1 if edge[1] in unclosed else page.find(edge[1], edge.end())
                if end < 0:
                    unclosed.add(edge[1])
                values += 1
                if end < 0 or values > MOST_VALUES:
                    edge = None
                    break
                at = end + 1
            at = edge.end() if edge else page.find(">", m.end()) + 1 or len(page)
            yield k, at, m[1], m[2].lower(), page[m.end() : at].removesuffix(">")
        else:
            at = k + 1


def read(page: str) -> tuple[list[Element], list[tuple[Element, str, int]]]:
    """Elements, parents first, and text nodes in page order: element, decoded text, and number of the block it stands in."""
    root = Element("html", None, False, False, 0)
    elements, stack, open_, nodes, paths, at, block = [root], [root], Counter(), [], {}, 0, 0

    def text(raw: str) -> None:
        if raw and not stack[-1].out:
            nodes.append((stack[-1], html.unescape(raw) if "&" in raw else raw, block))

    def cut(k: int) -> None:
        open_.subtract(e.tag for e in stack[k:])
        del stack[k:]

    def close(names: tuple[str, ...]) -> None:
        if any(open_[n] for n in names):
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in names:
                    return cut(k)
                if stack[k].tag in SCOPE:
                    return None

    for begin, end, slash, tag, attributes in tags(page):
        if begin < at:  # inside a raw element
            continue
        text(page[at:begin])
        at = end
        if not tag:
            continue
        if slash:
            if tag in BLOCK:
                block += 1
            if open_[tag]:
                cut(next(k for k in range(len(stack) - 1, 0, -1) if stack[k].tag == tag))
            continue
        if tag in RAW:
            if not attributes.endswith("/"):
                found = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
                at = found.end() if found else len(page)
            continue
        if tag in BLOCK:
            block += 1
        if tag in VOID or tag in ("html", "body"):
            continue
        if tag in ENDS_P:
            close(("p",))
        if tag in SAME:
            close(SAME[tag])
        if len(stack) >= DEEPEST:
            cut(len(stack) - 1)
        over = stack[-1]
        main = tag in ("article", "main") or bool(attributes and MAIN.search(attributes))
        out = tag in NEVER and not (tag == "header" and over.inside) or bool(attributes and HIDDEN.search(attributes))
        hint = bool(attributes) and hinted(tag, NAMED.findall(attributes), over.inside)
        e = Element(tag, over, out, main, paths.setdefault((over.path, tag), len(paths) + 1), hint and not main)
        elements.append(e)
        stack.append(e)
        open_[tag] += 1
        if main and not hint and not e.out:
            for over in stack:
                over.hint = False
    text(page[at:])
    return elements, nodes


def main_text(page: str | None) -> str:
    elements, nodes = read(page or "")
    sized = [(e, len("".join(t.split())), len(PUNCTUATION.findall(t))) for e, t, _ in nodes]
    keep_large(elements, [x for x in sized if x[1]])
    at = [k for k, x in enumerate(sized) if x[1] and not x[0].out]
    sized = [sized[k] for k in at]
    if not sized:
        return ""
    paths, hints = sums([x for x in sized if not x[0].low]), sums([x for x in sized if x[0].low])
    ratio = ratios(paths)
    full = [ratio[e.path] for e, *_ in sized if not e.low]
    smooth = [(r + sum(full[max(0, i - 1) : i + 2])) / (1 + len(full[max(0, i - 1) : i + 2])) for i, r in enumerate(full)]
    below = {k: LOWERED * r for k, r in ratios(hints).items()}
    threshold = sum(smooth or below.values()) / len(smooth or below) / 2
    plain = iter(smooth)
    passed = [(below[e.path] if e.low else next(plain)) >= threshold for e, *_ in sized]
    only = article(elements, sized, [yes and not e.low for (e, *_), yes in zip(sized, passed, strict=True)] if smooth else passed)
    lead = [k for k, (e, *_) in enumerate(sized) if (passed[k] and not only or e.within) and not (e.low and not passed[k] or e.link and menu(e, paths))]
    first, last = (lead[0], lead[-1]) if lead else (0, -1)
    first = heading(sized, first)
    content = {nodes[at[k]][2] for k in range(len(sized)) if passed[k]}
    parts, was = [], None
    for k in range(at[first], at[last] + 1) if lead else ():
        e, t, block = nodes[k]
        if e.out or e.link and menu(e, paths):
            continue
        if t.strip():
            i = bisect_left(at, k)
            if e.low and not passed[i] or not (e.within or i < lead[0]) and (only or e.link and block not in content):
                continue
        elif only and k > at[lead[0]] and not e.within:
            continue
        parts.append(t if block == was else " " + t)
        was = block
    return " ".join("".join(parts).split())


def article(elements: list[Element], sized: list[tuple[Element, int, int]], passed: list[bool]) -> bool:
    """Marks what lies within the elements that stay with all their paths; whether nothing outside them is content."""
    for (e, n, _), yes in zip(sized, passed, strict=True):
        e.weight += n if yes else 0
    for e in reversed(elements[1:]):
        e.parent.weight += e.weight
    total = elements[0].weight
    mains = [e for e in elements if e.main and e.weight]
    holds = [e for e in mains if e.weight == total] or [e for e in mains if e.weight >= NEARLY_ALL * total]
    outer = [e for e in mains if not e.parent.inside]
    if holds:
        tops = [max(holds, key=lambda e: e.depth)]
    elif outer and sum(e.weight for e in outer) >= NEARLY_ALL * total:
        tops = outer
    else:
        top = max((e for e in elements if e.weight >= NEAR_ALL * total and e.weight), key=lambda e: e.depth, default=elements[0])
        if not top.main:
            while top.parent is not None and top.tag not in BLOCK:
                top = top.parent
            if top.parent is not None and top.tag not in ("div", "section", "td"):
                top = top.parent
        tops = [top]
    for e in tops:
        e.within = True
    for e in elements[1:]:
        e.within = e.within or e.parent.within
    return bool(holds)


def heading(sized: list[tuple[Element, int, int]], first: int) -> int:
    """Where the heading before the first node begins, if no link stands between them; else `first`."""
    k = first - 1
    if sized[first][0].heading == "h1":
        return first
    while k >= 0 and not sized[k][0].heading and not sized[k][0].link and not sized[k][0].low:
        k -= 1
    if k < 0 or not sized[k][0].heading or sized[k][0].low:
        return first
    while k > 0 and sized[k - 1][0].heading and not sized[k - 1][0].low:
        k -= 1
    return k


def sums(sized: list[tuple[Element, int, int]]) -> dict[int, list[int]]:
    """Text length, punctuation and number of nodes of each path."""
    paths: dict[int, list[int]] = {}
    for e, n, p in sized:
        s = paths.setdefault(e.path, [0, 0, 0])
        s[0] += n
        s[1] += p
        s[2] += 1
    return paths


def ratios(paths: dict[int, list[int]]) -> dict[int, float]:
    return {k: n / c * (0.1 + p / c) for k, (n, p, c) in paths.items()}


def keep_large(elements: list[Element], sized: list[tuple[Element, int, int]]) -> None:
    """Takes the hint from elements that hold a large share of the page's ratio weight, and leaves out forms that don't."""

    def lower() -> None:
        for e in elements[1:]:
            e.low = e.hint or e.parent.low

    def held() -> tuple[dict[int, float], float]:
        """Ratio weight below each element that has a say, and of all."""
        ratio, found, total = ratios(sums(sized)), dict.fromkeys((id(e) for e in elements if e.hint or e.form), 0.0), 0.0
        for e, *_ in sized if found else ():
            total += ratio[e.path]
            for over in e.up():
                if over.hint or over.form:
                    found[id(over)] += ratio[e.path]
        return found, total

    found, total = held()
    prose = {id(over) for e, n, p in sized if n >= PROSE and p and total for over in e.up() if over.form}
    for e in elements[1:]:
        e.out = e.out or e.parent.out or e.form and not (id(e) in prose and found[id(e)] >= LARGE * total)
    sized[:] = [x for x in sized if not x[0].out]
    lower()
    found, total = held()
    ratio = ratios(sums(sized)) if found else {}
    mains = sum(ratio[e.path] for e, *_ in sized if e.inside and not e.low) if found else 0
    for e in elements:
        if e.hint:
            e.hint = found[id(e)] < (LARGE_BESIDE if mains and not e.inside else LARGE) * total
    lower()


def menu(e: Element, paths: dict[int, list[int]]) -> bool:
    """Whether the path is one of repeated links in a list, short and without punctuation."""
    n, p, c = paths.get(e.path, (0, 0, 0))
    return c >= 3 and e.listed and p == 0 and n / c < 25


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """page_id, url and the page's main text: white space is one space, blocks are joined by one space."""
    ship_package(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "html"):
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(map(main_text, part.column("html").to_pylist()), pa.string())], names=["page_id", "url", "text"])

    return pages.select(F.col(id_col).cast("bigint").alias("page_id"), "url", F.col(html_col).alias("html")).mapInArrow(run, "page_id bigint, url string, text string")
