"""Main text of web pages by line-block distribution.

Markup is stripped in one pass that keeps, for every line (a block's text), its length, the
part of it inside links, and its element. Then text lengths are summed over sliding windows
of lines: around the window with the most text, the main text surges where the sums leave
zero and dives where they return to it, and what stands between is kept. No share of the peak is
compared, so one very long block hides no short one.

Tags only shape the distribution. Elements that hold no article by their name, role, class or
id are stripped with all they hold, and leave an empty line where they stood; text in links has no
length outside an article or main element; and an article or main element has a window of empty lines at either
border, so that text dives there. Without such an element, the range is widened to the outermost element that adds mostly unlinked
text to the innermost one around the range, as a list of links can stand between an article's
sections. Blocks that are links alone stay between others, and go at the ends.

Defined results. A null or empty page, and one without text, gives the empty string.
Character references are decoded, white space in a block becomes one space, blocks are
joined in page order by one space. A page of linked text alone gives all of it. Of windows with
equal sums the first counts. Broken markup is read as browsers do: an unclosed
element ends with its parent, an unknown end tag is ignored, a quote left open ends with its tag, a tag cut off by the page's
end is dropped. Repeated rows give equal results; other columns are passed through, and one named as the result is
replaced. Time and memory are in proportion to a page's length, however deep its elements stand.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from html import unescape
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Lines of a sliding window.
WINDOW = 3

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)",
    re.DOTALL,
)
_ATTR = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_WORD = re.compile(r"[a-z]+|[A-Z][a-z]*|[0-9]+")

# Element names by their part in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript template iframe xmp noembed noframes select svg math object canvas audio video".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr label".split())
DROPPED = frozenset("nav footer aside form button menu dialog head fieldset datalist".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar tablist".split())
#: Words in a class or id that mark what stands around an article.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promos promotion promotions banner banners sidebar sidebars sidenav menu menus navbar nav navigation "
    "topnav subnav breadcrumb breadcrumbs footer footers foot colophon masthead header topbar cookie cookies consent gdpr notice notices notification notifications popup popups modal overlay newsletter subscribe subscription "
    "signup signin login social share sharing sharebar related recommended recommendations comment comments commentlist disqus replies respond discussion pagination pager toolbar widget widgets search searchbox copyright "
    "disclaimer skip skiplink alert hidden paywall teaser outbrain taboola trending aside rail privacy reply responses feedback".split()
)
_COMMENTS = frozenset("comment comments commentlist disqus replies reply respond responses discussion feedback".split())
_ITEMS = frozenset("li dt dd option tr td th".split())
_NOWHERE = 1 << 30
#: Words that turn a mark into something else, as in has-sidebar; and, for a header, those that make it an article's own.
NOT_MARKS = frozenset("has no with without".split())
OWN_HEADER = frozenset("article post entry content main story title".split())
_NEVER = frozenset("html body main article".split())


def _marked(name: str, attrs: str, in_article: bool) -> bool:
    """Whether an element is stripped with all that it holds."""
    if name in DROPPED:
        return True
    if name == "header":
        return not in_article
    if not attrs or attrs.isspace():
        return False
    a = _attributes(attrs)
    if "hidden" in a or a.get("aria-hidden") == "true" or "display:none" in a.get("style", "").replace(" ", "").lower():
        return name not in ("html", "body")
    if a.get("role", "").lower() in ROLES:
        return True
    if name in _NEVER and not (name == "article" and {"comment", "comments"} & {*_words(a)}) or name in ("h1", "a"):
        return False
    for words in (set(_split(x)) for x in (a.get("class", "") + " " + a.get("id", "")).split()):
        found = words & MARKS
        if found == {"header"} and words & OWN_HEADER:
            continue
        if found and not words & NOT_MARKS:
            return True
    return False


def _attributes(attrs: str) -> dict[str, str]:
    return {k.lower(): d or s or u for k, d, s, u in _ATTR.findall(attrs)}


def _split(token: str) -> list[str]:
    return [x.lower() for x in _WORD.findall(token)]


def _words(a: dict[str, str]) -> list[str]:
    return _split(a.get("class", "") + " " + a.get("id", ""))


class Element:
    """An open or closed element; its lines are those numbered from first to last (exclusive)."""

    __slots__ = ("name", "parent", "block", "off", "first", "last")

    def __init__(self, name: str, parent: Element | None, off: int, first: int):
        self.name, self.parent, self.off, self.first, self.last = name, parent, off, first, -1
        #: The nearest element, itself included, that is a block.
        self.block: Element | None = self if name not in INLINE else parent


class Line:
    """A block's text, its length that counts, the empty lines before it, and its element."""

    __slots__ = ("text", "size", "gap", "element", "in_article")

    def __init__(self, text: str, size: int, gap: int, element: Element | None, in_article: bool):
        self.text, self.size, self.gap, self.element, self.in_article = text, size, gap, element, in_article


class _Open:
    """The open elements, and by name their places, so that none is searched for."""

    def __init__(self) -> None:
        self.stack: list[Element] = []
        self.places: dict[str, list[int]] = {}

    def find(self, name: str, stop: tuple[str, ...] = ()) -> int:
        """The place of the innermost open element of that name, or -1; -1 too if one of ``stop`` is open inside it."""
        own = self.places.get(name)
        if not own:
            return -1
        for s in stop:
            if (x := self.places.get(s)) and x[-1] > own[-1]:
                return -1
        return own[-1]

    def push(self, e: Element) -> None:
        self.places.setdefault(e.name, []).append(len(self.stack))
        self.stack.append(e)

    def pop(self) -> Element:
        e = self.stack.pop()
        self.places[e.name].pop()
        return e


def lines_of(html: str, recover: bool = False) -> list[Line]:
    """The page's lines outside stripped elements; recover takes an article or main element back, unless it stands among comments."""
    out: list[Line] = []
    opened = _Open()
    stack = opened.stack
    parts: list[str] = []
    linked = links = gap = 0
    dropped = 0
    inside = {"article": 0, "main": 0}
    among_comments = _NOWHERE  # the depth of the outermost element of comments

    def flush() -> None:
        nonlocal linked, gap
        if parts:
            text = " ".join(unescape("".join(parts)).split())
            parts.clear()
            if text:
                own = inside["article"] + inside["main"] > 0
                out.append(Line(text, len(text) if own else max(0, len(text) - linked), gap, stack[-1].block if stack else None, own))
                gap = 0
        linked = 0

    def border(name: str) -> bool:
        """Whether an element's tag is the border of an article, none being open outside it."""
        return not inside["article"] and (name == "article" or name == "main" and not inside["main"])

    def close(k: int) -> bool:
        """Closes all from place k on; whether a stripped element was among them."""
        nonlocal dropped, links, among_comments, gap
        stripped = False
        while len(stack) > k:
            e = opened.pop()
            e.last = len(out)
            stripped |= e.off != 0
            dropped -= e.off
            links -= e.name == "a"
            if e.name in inside:
                inside[e.name] -= 1
                if border(e.name):
                    gap += WINDOW
        if stripped and not dropped and not any(inside.values()):
            gap += 1
        if among_comments >= k:
            among_comments = _NOWHERE
        return stripped

    at, n = 0, len(html)
    while at < n:
        lt = html.find("<", at)
        if lt < 0:
            lt = n
        if lt > at and not dropped:
            parts.append(html[at:lt])
            linked += (lt - at) * (links > 0)
        if lt >= n:
            break
        m = _TOKEN.match(html, lt)
        if not m:
            if not dropped:
                parts.append("<")
            at = lt + 1
            continue
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        if name not in INLINE and not dropped:
            flush()
        if m[1] or m[4]:  # an end tag
            if (k := opened.find(name)) >= 0 and close(k):
                parts.clear()
                linked = 0
            continue
        if name in VOID:
            continue
        attrs = m[3] if m[2] else m[6]
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.IGNORECASE).search(html, at)
            at = end.end() if end else n
            continue
        if name not in INLINE and (k := opened.find("p", ("button", "td", "th", "table"))) >= 0:
            close(k)
        if name in _ITEMS and (k := opened.find(name, ("ul", "ol", "dl", "table", "menu"))) >= 0:
            close(k)
        off = int(not dropped and _marked(name, attrs, any(inside.values())))
        if recover:
            if among_comments == _NOWHERE and _COMMENTS & {*_words(_attributes(attrs))}:
                among_comments = len(stack)
            if dropped and name in inside and among_comments == _NOWHERE:
                off = -dropped
        e = Element(name, stack[-1].block if stack else None, off, len(out))
        opened.push(e)
        dropped += off
        links += name == "a"
        if name in inside:
            if border(name):
                gap += WINDOW
            inside[name] += 1
    if not dropped:
        flush()
    for e in stack:
        e.last = len(out)
    return out


def surge_and_dive(sizes: list[int], window: int = WINDOW) -> tuple[int, int]:
    """The range of lines (end exclusive) around the peak of the sliding sums, from where they surge from zero to where they dive to it."""
    before = [0, *accumulate(sizes)]
    n = len(sizes)
    sums = [before[min(k + window, n)] - before[k] for k in range(n)]
    peak = max(range(n), key=sums.__getitem__)
    a, b = peak, peak
    while a > 0 and sums[a - 1] > 0:
        a -= 1
    while b + 1 < n and sums[b + 1] > 0:
        b += 1
    return a, b + 1


def _range(lines: list[Line], window: int = WINDOW) -> tuple[int, int]:
    """The lines (end exclusive) between surge and dive, empty lines counted, without those of no length at either end."""
    sizes: list[int] = []
    place = []
    for x in lines:
        sizes += [0] * min(x.gap, window)
        place.append(len(sizes))
        sizes.append(x.size)
    a, b = surge_and_dive(sizes, window)
    return _trimmed(lines, bisect_left(place, a), bisect_left(place, b))


def _trimmed(lines: list[Line], a: int, b: int) -> tuple[int, int]:
    while a < b and not lines[a].size:
        a += 1
    while a < b and not lines[b - 1].size:
        b -= 1
    return a, b


def _widened(lines: list[Line], a: int, b: int) -> tuple[int, int]:
    """The lines of the outermost element that adds nothing, or mostly unlinked text, to the innermost element around lines a to b."""
    shared = lines[a].element
    while shared is not None and not (shared.first <= a and b <= shared.last):
        shared = shared.parent
    if b - a == 1 and shared is not None and shared.name not in ("div", "section", "td", "body"):
        shared = shared.parent  # a paragraph alone: its parent
    if shared is None:
        return 0, len(lines)
    size = [0, *accumulate(x.size for x in lines)]
    length = [0, *accumulate(len(x.text) for x in lines)]
    a, b = best = shared.first, shared.last
    around: list[tuple[int, int]] = [(0, len(lines))]
    chain = []
    while shared is not None:
        chain.append((shared.first, shared.last))
        shared = shared.parent
    for lo, hi in around + chain[::-1]:
        more = [x[hi] - x[lo] - x[b] + x[a] for x in (size, length)]
        if 2 * more[0] >= more[1]:
            return lo, hi
    return best


def main_text(html: str | None) -> str:
    """The text of the page's article."""
    if not html:
        return ""
    lines = lines_of(html)
    if not any(x.in_article for x in lines) and re.search(r"<(?:article|main)[\s>]", html, re.IGNORECASE):
        # an unclosed stripped element can swallow the article: it is taken back if it outweighs what is left
        again = lines_of(html, recover=True)
        if sum(x.size for x in again if x.in_article) > sum(x.size for x in lines):
            lines = again
    if not any(x.size for x in lines):
        return " ".join(x.text for x in lines)
    a, b = _range(lines)
    if not lines[a].in_article:
        a, b = _trimmed(lines, *_widened(lines, a, b))
    return " ".join(x.text for x in lines[a:b])


def extracted(pages: DataFrame, html: str = "html", text: str = "text") -> DataFrame:
    """pages with the main text of every whole page; a column of that name is replaced."""
    pages = pages.drop(text)
    schema = T.StructType([*pages.schema.fields, T.StructField(text, T.StringType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [main_text(x) for x in b.column(b.schema.get_field_index(html)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(got, pa.string())], names=[*b.schema.names, text])

    return pages.mapInArrow(run, schema)
