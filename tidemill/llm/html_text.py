"""HTML extraction by tree scoring.

A page becomes a tree of elements. Each paragraph gives points for its length and its commas, less what of it is in links,
to its ancestors, the farther the less; a container's points are discounted by the share of its text that is in links. The
best container is kept, with those of its siblings that score or read like it, and its parents while they only gather
parts of one text. Elements that frame an article (menus, headers, footers, sidebars, notices, adverts, forms, comments of
readers), known by tag, role or class, are left out, unless the points say that they hold the page's text themselves.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import map_arrow

# Names of the HTML standard, and words that sites use for what is not the article.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
HEAD = frozenset("head title meta link base script style noscript template".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
SILENT = frozenset("script style noscript template svg iframe button select textarea input object embed canvas head title noembed noframes audio video annotation annotation-xml".split())
FRAMES = frozenset("nav footer aside menu dialog".split())
ENDS_P, P_FENCES = BLOCKS - {"html", "body"}, frozenset("button td th table object".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
FENCES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "option": {"select"}}
AWAY = r"(?:^|.*[_-])(?:{})(?:$|[_-].*)"
LAYOUT = re.compile(AWAY.format("footer|header|masthead|menus?|nav|navbar|navigation|sidebars?"), re.I)
BARS = re.compile(AWAY.format("share|sharing|social|toolbar") + r"|widgets?(?:$|[_-].*)", re.I)
STRANGE = re.compile(
    AWAY.format(
        "ads?|adverts?|advertisements?|adsense|adsbygoogle|banners?|breadcrumbs?|comments?|commentlist|consent|cookies?|disqus|disclaimer|gdpr|modal|newsletter|notices?|notification|paywall|popup|"
        "promos?|promotion|recommended|related|replies|respond|signup|skip-link|sponsor(?:ed|s)?|subscribe|subscription"
    ),
    re.I,
)
#: Words that are said of readers' comments and of parts of articles alike: what is in there decides.
DEBATE = re.compile(AWAY.format("responses?|discussions?|reactions?|opinions?|reviews?|feedback|threads?|conversations?|posts?|messages?|replies"), re.I)
BYLINE = re.compile(AWAY.format("authors?|by|byline|user|username|nick(?:name)?|name|date|time|timestamp|posted|avatar|permalink|meta|commenter"), re.I)
STATES = re.compile(r"(?:no|has|with|without|is|js|hide)[_-]|.*[_-](?:with|no|has)[_-]|(?:article|post|entry|content|story|page)[_-]*(?:header|title|heading)(?:$|[_-])", re.I)
ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog form menu menubar".split())

# Attributes by the states of the HTML standard: quotes count only where a value begins.
ATTRIBUTES = r"""(?:[\s/]++|=?[^\s/>=]++(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+)?)?|=)*+"""
TOKEN = re.compile(rf"<!---?>|<!--.*?(?:--!?>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)({ATTRIBUTES})(?:>|\Z)|<[!?/][^>]*+(?:>|\Z)|[^<]+|<", re.S)
ATTRIBUTE = re.compile(r"""(=?[^\s/>=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"'][^\s>]*))?)?""")
CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)

#: Why an element may be left out: never read; a frame by tag or role, or strange to an article by class; laid out like a
#: frame of the page by class; a bar or a form, which may be within an article.
NEVER, FRAME, LAID_OUT, BAR = 4, 3, 2, 1
#: A subtree that is laid out like a frame stays if it has so many times the points of the rest of the page.
CARRIES = 4
NONE = 1e-6
PARAGRAPHS = frozenset("p pre blockquote td li dd".split())
HOLDERS = frozenset("div section article main html body form center fieldset details figure table tr tbody".split())


class Node:
    """An element. ``cut``: why it may be left out, 0 if it stays; ``main``: it says it is the article; ``size``, ``linked``,
    ``commas`` and ``mass`` (points of the paragraphs below) are of its whole subtree; ``title``: that holds a main element or
    heading (2), or an article (1); ``debate``: its class or id may speak of comments; ``signed``: it is, or holds, a line that
    says who wrote something or when."""

    __slots__ = ("tag", "up", "kids", "cut", "main", "debate", "signed", "inside", "score", "size", "linked", "commas", "mass", "title", "order")

    def __init__(self, tag: str, up: Node | None, cut: int = 0, main: bool = False, debate: bool = False, signed: bool = False, inside: bool = False):
        self.tag, self.up, self.kids, self.cut, self.main, self.debate, self.signed, self.inside = tag, up, [], cut, main, debate, signed, inside
        self.score, self.size, self.linked, self.commas, self.mass, self.order = 0.0, 0, 0, 0, 0.0, 0
        self.title = 2 if main and tag != "article" or tag == "h1" else int(main)


def attributes(source: str) -> dict[str, str]:
    return {a.lower(): unescape(b or c or d) for a, b, c, d in reversed(ATTRIBUTE.findall(source))}


def kind(tag: str, source: str, inside: bool) -> tuple[int, bool, bool, bool]:
    """(cut, main, debate, signed) of an element; ``inside``: within an article, where a header may hold the headline and stays."""
    signed = tag in ("time", "cite")
    if tag in SILENT:
        return NEVER, False, False, False
    cut = FRAME if tag in FRAMES or tag == "header" and not inside else BAR if tag == "form" else 0
    main = tag in ("article", "main")
    if not source or tag in ("html", "body"):
        return cut, main, False, signed
    a = attributes(source)
    role = a.get("role", "").lower()
    if "hidden" in a or a.get("aria-hidden") == "true" or HIDDEN.search(a.get("style", "")):
        return NEVER, False, False, False
    main = main or role == "main" or a.get("itemprop", "").lower() == "articlebody"
    names = [CAMEL.sub("-", n) for n in f"{a.get('class', '')} {a.get('id', '')}".split()]
    names = [n for n in names if not STATES.match(n)]
    if role in ROLES or any(map(STRANGE.fullmatch, names)):
        cut = FRAME
    elif cut <= BAR and not (inside and tag in ("h1", "header")):
        cut = LAID_OUT if any(map(LAYOUT.fullmatch, names)) else BAR if any(map(BARS.fullmatch, names)) else cut
    return cut, main, any(map(DEBATE.fullmatch, names)), signed or any(map(BYLINE.fullmatch, names))


def tree(html: str) -> Node:
    """The tree of ``html``. Ends of p, li, td, head and the like may be missing; an end tag without a start is left out."""
    root = Node("html", None)
    at, stack, open_at, inside, pos, n = root, [root], defaultdict(list), 0, 0, len(html)

    def close_to(i: int) -> None:
        nonlocal at, inside
        while len(stack) > i:
            gone = stack.pop()
            open_at[gone.tag].pop()
            inside -= gone.main
        at = stack[-1]

    def close(tags: set[str] | frozenset, fences: set[str] | frozenset = frozenset()) -> None:
        """Closes the innermost open element of ``tags``, unless a fence stands between."""
        last = lambda names: max((open_at[t][-1] for t in names if open_at[t]), default=0)
        if (i := last(tags)) > last(fences):
            close_to(i)

    while pos < n:
        m = TOKEN.match(html, pos)
        pos = m.end()
        tag = m[2]
        if tag is None:
            text = m[0]
            if text[0] != "<" or text == "<":
                if at.tag == "head" and not text.isspace():
                    close({"head"})
                at.kids.append(text)
            continue
        tag = tag.lower()
        if m[1]:
            close({tag})
            continue
        if open_at["head"] and tag not in HEAD:
            close({"head"})
        if tag in ("html", "body") and (at is root or open_at["body"]):
            continue
        if tag in ENDS_P and open_at["p"]:
            close({"p"}, P_FENCES)
        if tag in CLOSES:
            close(CLOSES[tag], FENCES[tag])
        if tag == "br":
            at.kids.append(" ")
            continue
        node = Node(tag, at, *kind(tag, m[3], inside > 0), inside > 0)
        at.kids.append(node)
        if tag in VOID:
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}[\s/>]", re.I).search(html, pos)
            pos = n if end is None else html.find(">", end.start()) + 1 or n
            continue
        if not m[3].endswith("/") or tag not in ("svg", "path"):
            open_at[tag].append(len(stack))
            stack.append(node)
            inside += node.main
            at = node
    return root


def debates(root: Node) -> None:
    """Marks as frames what is made up as readers' comments are: elements outside of the article, or whose class or id may speak of
    comments, that hold little but two or more items of one tag, each with a line that says who wrote it or when."""
    order = [root]
    for x in order:
        order += [k for k in x.kids if not isinstance(k, str) and k.cut < FRAME]
    for x in reversed(order):
        x.signed = x.signed or any(not isinstance(k, str) and k.signed and not k.main for k in x.kids)
    for x in order[1:]:
        if x.cut >= FRAME or x.main or not (x.debate or not x.inside and x.tag in ("ol", "ul")):
            continue
        items = [k for k in x.kids if not isinstance(k, str) and k.tag in ("li", "div", "article", "section", "blockquote", "dl", "p") and k.cut < FRAME]
        signed = [k for k in items if k.signed]
        if len(signed) >= 2 and 2 * len(signed) > len(items) and len({k.tag for k in signed}) == 1:
            x.cut = FRAME


def own_text(x: Node) -> str:
    return "".join(k for k in x.kids if isinstance(k, str))


def points(x: Node) -> tuple[float, bool]:
    """What ``x`` gives as a paragraph, and whether to itself (text that stands in a container) or to its parent."""
    if x.tag in PARAGRAPHS:
        size, commas, linked, to_self = x.size, x.commas, x.linked / x.size if x.size else 0, False
    elif x.tag in HOLDERS and any(isinstance(k, str) and not k.isspace() for k in x.kids):
        text = own_text(x)
        size, commas, linked, to_self = len(text.strip()), text.count(","), 0, True
    else:
        return 0.0, False
    return (1 + commas + min(size / 100, 3)) * (1 - linked) * (0.25 if x.tag == "li" else 1) if size else 0.0, to_self


def measured(root: Node, least: int) -> list[Node]:
    """The elements below ``root`` that are no or a lesser cut than ``least``, in page order, with what ``Node`` tells of their
    subtrees and the scores that paragraphs give them."""
    order, todo = [], [root]
    while todo:
        x = todo.pop()
        x.order = len(order)
        order.append(x)
        x.size = x.linked = x.commas = 0
        x.mass = x.score = 0.0
        todo += [k for k in reversed(x.kids) if not isinstance(k, str) and k.cut < least]
    for x in reversed(order):
        for k in x.kids:
            if isinstance(k, str):
                x.size += len(k.strip())
                x.commas += k.count(",")
        if x.tag == "a":
            x.linked = x.size
        own, to_self = points(x)
        x.mass += own
        to, far = x if to_self else x.up, 1
        while own and to is not None and far <= 5:
            to.score += own / (1 if far == 1 else 2 if far == 2 else 3 * (far - 1))
            to, far = to.up, far + 1
        if (up := x.up) is not None:
            up.size, up.linked, up.commas, up.mass, up.title = up.size + x.size, up.linked + x.linked, up.commas + x.commas, up.mass + x.mass, max(up.title, x.title)
    for x in order:
        x.score *= 1 - x.linked / x.size if x.size else 0
    return order


def settle(root: Node) -> None:
    """Decides which elements that may be left out stay. One below ``FRAME`` does if it carries the text of the page: if
    it has over ``CARRIES`` times the points of all that is in no such element. A frame does only if nothing else has points
    and it holds the page's main element or main heading. Those with an article or heading come first, then the greatest; what
    stays has its own such elements decided, too."""

    def outermost(x: Node) -> tuple[float, list[tuple]]:
        """Points below ``x`` that are in no element that may be left out, and these elements, as they are to be decided."""
        free, found, todo = x.mass, [], [x]
        while todo:
            for k in todo.pop().kids:
                if not isinstance(k, str) and k.cut != NEVER:
                    if k.cut:
                        free -= k.mass
                        need = 1 + (k.cut == FRAME)
                        found.append((2 * (k.title < need) + need, -k.mass, k.order, k))
                    else:
                        todo.append(k)
        return free, found

    free, waiting = outermost(root)
    heapify(waiting)
    while waiting:
        x = heappop(waiting)[-1]
        carries = x.mass > CARRIES * free + NONE if x.cut < FRAME else free <= NONE < x.mass and x.title == 2
        if carries:
            x.cut = 0
            more, inner = outermost(x)
            free += more
            for k in inner:
                heappush(waiting, k)


def blocks(top: Node) -> list[str]:
    """The texts between block borders below ``top``, in page order, with single spaces."""
    out, now, todo = [], [], [top]
    edge = object()

    def close() -> None:
        text = " ".join("".join(now).split())
        now.clear()
        if text:
            out.append(text)

    while todo:
        x = todo.pop()
        if x is edge:
            close()
        elif isinstance(x, str):
            now.append(unescape(x))
        elif not x.cut:
            if x.tag in BLOCKS:
                close()
                todo.append(edge)
            todo.extend(reversed(x.kids))
    close()
    return out


def gathers(x: Node) -> bool:
    """Whether ``x`` may gather parts of one text: it is not the page, and holds no frames of it."""
    return x.tag not in ("html", "body") and not any(not isinstance(k, str) and (k.cut == LAID_OUT or k.cut and (k.tag in FRAMES or k.tag == "header")) for k in x.kids)


def extract(html: str) -> str:
    """The main text of a page, blocks joined by newlines; '' if it has none."""
    root = tree(html)
    debates(root)
    measured(root, NEVER)
    settle(root)
    order = measured(root, BAR)
    best = max((x for x in order if x.score > 0), key=lambda x: x.score + 25 * x.main, default=None)
    if best is None:
        whole = max((x for x in order if x.main and x.size), key=lambda x: x.size, default=root)
        return "\n".join(blocks(whole))
    x = best
    while x is not None:  # the outermost of the elements around it that say they are the article
        best, x = x if x.main else best, x.up
    kept, at = [best], best
    if best.main and best.up is not None:  # articles beside the best are parts of the page's text
        kept += [x for x in best.up.kids if not isinstance(x, str) and x is not best and x.main and not x.cut and x.size and x.linked < 0.5 * x.size and x.mass >= 0.2 * best.mass]
    while not at.main and at.up is not None:
        one_text = gathers(at.up)
        for x in at.up.kids:
            if isinstance(x, str) or x.cut or x is at or not x.size:
                continue
            density = x.linked / x.size
            prose = x.tag == "p" and (x.size > 80 and density < 0.25 or not density) or x.tag in ("h1", "h2") and density < 0.5
            if prose or density < 0.5 and (one_text or x.mass >= 0.2 * best.mass):
                kept.append(x)
        if not one_text:
            break
        at = at.up
    return "\n".join(text for x in sorted(kept, key=lambda x: x.order) for text in blocks(x))


def extract_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = [extract(x or "") for x in b.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])


def main_text(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(key, url, text, n_chars) of every page. Null or empty html, or a page without an article, gives an empty text; a
    page is parsed whole whatever its length; repeated rows, and null ids and urls, are each extracted; other columns, whatever
    their names, are not read. An empty table gives an empty one."""
    rows = pages.select(F.col(key).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"))
    return map_arrow(rows, __name__, "extract_batches", f"page_id {dict(pages.dtypes)[key]}, url string, text string, n_chars long").withColumnRenamed("page_id", key).withColumnRenamed("url", url)
