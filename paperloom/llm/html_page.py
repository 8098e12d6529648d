"""One web page: its elements, its style nodes, and its main text.

``parse`` reads a page once, in time proportional to its length, by HTML's own rules for tags: an attribute is a name and, after =, a quoted or bare value; a quote
elsewhere is part of a name; a tag without an end runs to the end of the page, where it is dropped; comments, scripts and other raw text without an end run to it too. A quote
without a partner is read as a bare value. Elements end with their parents, and where HTML implies their end.

``main_text`` weighs what an element is: tags such as nav or form, roles, and names. A name is a whole class or id that says what is not an article, alone, with words of place
(``sidebar-left``, ``site-footer``) or as its last word; ``has-sidebar`` and the like speak of something else, and ids of headings and sections are titles. This is evidence: a branch
that holds the article keeps its text whatever it is called (see ``_dropped``).
"""

from __future__ import annotations

import heapq
import html as entities
import re
from functools import lru_cache

import xxhash

#: Element names of HTML by their role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "html body article main section div p h1 h2 h3 h4 h5 h6 header footer nav aside ul ol li dl dt dd table thead tbody tfoot tr td th caption form fieldset legend"
    " blockquote pre figure figcaption address details summary hr center dialog menu template noscript title head hgroup search".split()
)
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
#: Elements without text of the page, and those that are seldom part of an article.
HARD = frozenset("head script style noscript template title button select option input textarea iframe object embed applet canvas svg math audio video map datalist noembed noframes xmp dialog".split())
SOFT = frozenset("nav footer aside form menu search fieldset".split())
FOREIGN = frozenset("svg math".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CLOSES_P = BLOCK - {"html", "body", "head", "title", "template", "noscript"}
SAME = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPES = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table",), "th": ("table",), "option": ("select",)}
P_SCOPES = ("table", "button", "td", "th", "div", "section", "article")
#: Elements that the end tag of what is outside them does not end.
CELLS = ("td", "th", "caption")
TOP = frozenset("html body article main".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar toolbar".split())

#: Words that name what is not the article, as the last word of a class or id, or with words of place.
STRONG = frozenset(
    "ad ads advert adverts advertisement advertisements advertising adsense sponsor sponsored promo promos promotion nav navbar navigation breadcrumb breadcrumbs sidebar sidebars"
    " footer bottombar masthead topbar toolbar cookie cookies consent gdpr newsletter subscribe signup login signin searchbox comments commentlist disqus share sharing related recommended"
    " recommendations trending widget widgets popup modal overlay pagination pager paging tagcloud teaser teasers outbrain taboola paywall menu menus searchform".split()
)
#: Words that do so alone or with words of place, but not at the end of any other name.
EXACT = frozenset("aside rail foot banner banners subscription register search form comment reply replies respond social skip hidden".split())
#: Words that do so too, but that in an article may label one of its parts.
WEAK = frozenset("header head notice notices alert alerts warning disclaimer discussion feedback reader readers review reviews follow popular copyright legal toc".split())
#: Words of place, form and number that may stand beside these.
PLACES = frozenset(
    "site page global main primary secondary top bottom left right upper lower inner outer mobile desktop sticky fixed floating area areas list links link item items container wrapper wrap box"
    " block section bar row col column panel group posts stories articles buttons button icons icon slot unit holder region zone home user users post blog entry article thread tree count first last one two nofollow"
    " jp wp media thumbnail small large customer customers visitor visitors guest guests".split()
)
#: Names of text that is not shown.
UNSEEN = frozenset("visually-hidden visuallyhidden sr-only screen-reader-text screen-reader-only a11y-hidden".split())
#: A header of these is the article's own.
OWN_HEADS = frozenset("article entry post story section content chapter block item row col column group first last".split())
#: Words at the start of a class that speak of a state or of something else on the page.
FLAGS = frozenset("has have with without no not is hide show js u are if".split())

_TAG = re.compile(r"(/?)([a-zA-Z][^\s/>]*+)")
_ATTRIBUTE = re.compile(r"[\s/]*+(?:(>)|([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]++))?)?)")
_COMMENT = re.compile(r"-->|--!>")
_READ = frozenset(("class", "id", "role", "hidden", "aria-hidden", "itemprop"))
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: Numbers in ids, and long ones in classes, tell pages apart and not kinds of elements.
_DIGITS = {"id": re.compile(r"\d+"), "class": re.compile(r"\d{3,}")}
_ENDS = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I) for tag in RAW}

NONE, SOME, SURE = 0, 1, 2


@lru_cache(maxsize=1 << 15)
def name_evidence(name: str) -> int:
    """What one class or id says: SURE that it is not the article, SOME, or NONE."""
    words = [w.lower() for w in _WORDS.findall(name)]
    if name.lower() in UNSEEN:
        return SURE
    if not words or words[0] in FLAGS and len(words) > 1:
        return NONE
    if not any(w in STRONG or w in EXACT or w in WEAK for w in words):
        return NONE
    if words[-1] in ("header", "head") and any(w in OWN_HEADS for w in words[:-1]):
        return NONE
    if all(w in STRONG or w in EXACT or w in WEAK or w in PLACES for w in words):
        return SURE if any(w in STRONG or w in EXACT for w in words) else SOME
    return SURE if words[-1] in STRONG else NONE


@lru_cache(maxsize=1 << 15)
def _label(tag: str, classes: str, ids: str) -> tuple[str, int]:
    """The style label of an element and what its names say."""
    label, says = tag, NONE
    for kind, value in (("class", classes), ("id", ids)):
        names = _DIGITS[kind].sub("", value).split()
        if names:
            label += (".#"[kind == "id"]) + ".".join(sorted(names))
        if tag in HEADINGS or tag in ("html", "body"):
            continue
        for name in names:
            said = name_evidence(name)
            if kind == "id" and tag == "section" and len(_WORDS.findall(name)) > 1:
                said = NONE
            says = max(says, said)
    return label, says


def child_node(label: str, parent: int) -> int:
    """The style node of an element: its label and the path to it."""
    return xxhash.xxh64_intdigest(label, parent) >> 1


class Page:
    """Elements in document order, and the text between block boundaries (events)."""

    def __init__(self, source: str):
        self.tags, self.labels, self.nodes, self.parents = [""], [""], [0], [-1]
        self.says, self.hard, self.article = [NONE], [False], [False]
        self.events: list[tuple[int, str]] = []  # (element, text), or (-1, "") where a block ends
        self._stack, self._blocks = [0], [0]  # open elements, and the places in the stack of those that are blocks
        self._places: dict[str, list[int]] = {}
        self._parse(source)

    def _open(self, tag: str, read: dict[str, str]) -> None:
        parent = self._stack[-1]
        label, says = _label(tag, read.get("class", ""), read.get("id", "")) if read else (tag, NONE)
        role = read.get("role", "").lower() if read else ""
        hidden = bool(read) and ("hidden" in read and read["hidden"].lower() != "until-found" or read.get("aria-hidden", "").lower() == "true" and tag not in TOP)
        self._places.setdefault(tag, []).append(len(self._stack))
        if tag in BLOCK:
            self._blocks.append(len(self._stack))
        self._stack.append(len(self.tags))
        self.tags.append(tag)
        self.labels.append(label)
        self.nodes.append(child_node(label, self.nodes[parent]))
        self.parents.append(parent)
        self.says.append(SURE if role in ROLES else says)
        self.hard.append(self.hard[parent] or tag in HARD or hidden)
        self.article.append(tag in ("article", "main") or role in ("main", "article") or bool(read) and "articlebody" in read.get("itemprop", "").lower())

    def _close(self, tags: tuple[str, ...], scopes: tuple[str, ...] = ()) -> None:
        """Ends the innermost open element of the tags and what is open in it, unless a scope is open further in."""
        at = max((self._places[t][-1] for t in tags if self._places.get(t)), default=0)
        if not at or any(self._places[t][-1] > at for t in scopes if self._places.get(t)):
            return
        while len(self._stack) > at:
            tag = self.tags[self._stack.pop()]
            self._places[tag].pop()
            if tag in BLOCK:
                self._blocks.pop()

    def _break(self) -> None:
        if self.events and self.events[-1][0] >= 0:
            self.events.append((-1, ""))

    def _end(self, tag: str) -> None:
        if tag in BLOCK:
            self._break()
            self._close((tag,), () if tag in CELLS or tag in ("tr", "table", "tbody", "thead", "tfoot", "body", "html") else CELLS)
        elif (self._places.get(tag) or [0])[-1] > self._blocks[-1]:  # an inline end tag ends nothing outside the block that it is in
            self._close((tag,))

    def _parse(self, source: str) -> None:
        at, n, put = 0, len(source), self.events.append
        while at < n:
            low = source.find("<", at)
            if low < 0:
                low = n
            if low > at:
                put((self._stack[-1], source[at:low]))
            if low == n:
                break
            m = _TAG.match(source, low + 1)
            if m is None:
                if source.startswith("<!--", low):
                    if source.startswith(("<!-->", "<!--->"), low):
                        at = source.index(">", low) + 1
                        continue
                    end = _COMMENT.search(source, low + 4)
                    at = end.end() if end else n
                elif source.startswith(("<!", "<?", "</"), low):
                    end = source.find(">", low)
                    at = end + 1 if end >= 0 else n
                else:
                    put((self._stack[-1], "<"))
                    at = low + 1
                continue
            tag, at, read, last = m[2].lower(), m.end(), None, ""
            while True:
                a = _ATTRIBUTE.match(source, at)
                if a is None:
                    at = -1
                    break
                at = a.end()
                if a[1]:
                    last = source[at - 2]
                    break
                name = a[2].lower()
                if name in _READ:
                    read = read or {}
                    read.setdefault(name, entities.unescape(a[3] or a[4] or a[5] or ""))
            if at < 0:
                break  # the page ends inside a tag
            if m[1]:
                self._end(tag)
                continue
            if tag == "br":
                put((self._stack[-1], " "))
                continue
            if tag in BLOCK:
                self._break()
                for foreign in FOREIGN:
                    if self._places.get(foreign):
                        self._close((foreign,))
                if tag in CLOSES_P:
                    self._close(("p",), P_SCOPES)
                if tag in SAME:
                    self._close(SAME[tag], SCOPES[tag])
            if tag in RAW:
                end = _ENDS[tag].search(source, at)
                if end is None:
                    break
                close = source.find(">", end.end())
                at = close + 1 if close >= 0 else n
                continue
            if tag in VOID or last == "/" and (tag in FOREIGN or any(self._places.get(f) for f in FOREIGN)):
                continue
            self._open(tag, read or {})
        self._break()


def style_rows(page: Page) -> dict[int, tuple[int, int]]:
    """For each style node of a page: hashes of its presentation (its children's labels in order, repeats once) and of its content (the text below it)."""
    n = len(page.tags)
    values, shapes, last = [0] * n, {}, {}
    for element, text in page.events:
        if element >= 0 and (text := text.strip()):
            values[element] = (values[element] * 31 + xxhash.xxh64_intdigest(text)) & 0xFFFFFFFFFFFFFFFF
    for e in range(1, n):
        parent = page.nodes[page.parents[e]]
        if last.get(parent) != page.labels[e]:
            shapes.setdefault(parent, []).append(page.labels[e])
            last[parent] = page.labels[e]
    contents: dict[int, int] = {}
    for e in range(n - 1, 0, -1):
        parent = page.parents[e]
        if values[e]:
            contents[page.nodes[e]] = (contents.get(page.nodes[e], 0) * 31 + values[e]) & 0xFFFFFFFFFFFFFFFF
            values[parent] = (values[parent] * 31 + values[e]) & 0xFFFFFFFFFFFFFFFF
        else:
            contents.setdefault(page.nodes[e], 0)
    return {node: (xxhash.xxh64_intdigest(" ".join(shapes.get(node, ()))) >> 1, value >> 1) for node, value in contents.items()}


def _dropped(page: Page) -> list[bool]:
    """Which elements are no part of the article, by what they are.

    Let R be the text, without that of links, outside all branches with evidence against them. The largest such branch is looked at first. It is kept, and what is in it is looked
    at in its turn, if an article or main element in it has more text than R and there is none outside; or if it has more than R and the page's h1; or, unless
    its own tag is the evidence or an h1 is outside, if it has more than nine times R.
    """
    n, tags, parents = len(page.tags), page.tags, page.parents
    plain, article, h1, inside = [0] * n, [0] * n, [False] * n, [0] * n
    linked = [False] * n
    in_article = [False] * n
    for e in range(1, n):
        linked[e] = linked[parents[e]] or tags[e] == "a"
        in_article[e] = in_article[parents[e]] or page.article[e]
    links = [0] * n
    for e, text in page.events:
        if e >= 0 and not page.hard[e]:
            (links if linked[e] else plain)[e] += len(text.strip())
    for e in range(n - 1, 0, -1):
        p = parents[e]
        plain[p] += plain[e]
        links[p] += links[e]
        if page.article[e] and page.says[e] != SURE:
            article[e] = max(article[e], plain[e])
        article[p] = max(article[p], article[e])
        h1[e] = h1[e] or tags[e] == "h1" and not page.hard[e]
        h1[p] = h1[p] or h1[e]
    any_article = article[0] > 0
    header = [False] * n
    for e in range(1, n):
        # a header outside articles is the site's, unless it alone has the title of a page that has no article
        header[e] = tags[e] == "header" and not in_article[e] and (any_article or not h1[e])
    for e in range(n - 1, 0, -1):
        if tags[e] in ("nav", "form", "menu", "search"):
            inside[parents[e]] = 1
        inside[parents[e]] = max(inside[parents[e]], inside[e])
    evidence = [NONE] * n
    for e in range(1, n):
        if page.hard[e] or tags[e] in ("html", "body"):
            continue
        said = page.says[e]
        if tags[e] in SOFT or header[e] or tags[e] == "header" and not in_article[e] and inside[e]:
            said = SURE
        elif said == SOME and in_article[e] and not inside[e] and links[e] <= plain[e]:
            said = NONE  # in an article a single common word labels one of its parts, if that is no list of links
        elif page.article[e] and said == SOME:
            said = NONE
        evidence[e] = said
    below = [0] * n  # text of the topmost branches with evidence that are strictly inside
    free = [False] * n  # whether there are articles outside these
    title = [False] * n  # whether there is an h1 outside these
    for e in range(n - 1, 0, -1):
        below[parents[e]] += plain[e] if evidence[e] else below[e]
        free[e] = free[e] or page.article[e] and plain[e] > 0
        free[parents[e]] = free[parents[e]] or free[e] and not evidence[e]
        title[e] = title[e] or tags[e] == "h1" and not page.hard[e]
        title[parents[e]] = title[parents[e]] or title[e] and not evidence[e]
    rest, outside, titled = plain[0] - below[0], free[0], title[0]
    out = list(page.hard)
    children: dict[int, list[int]] = {}  # topmost branches with evidence, by the one that they are in
    owner = [0] * n
    for e in range(1, n):
        p = parents[e]
        owner[e] = p if evidence[p] and p else owner[p]
        if evidence[e]:
            children.setdefault(owner[e], []).append(e)
    heap = [(-plain[e], e) for e in children.get(0, ())]
    heapq.heapify(heap)
    while heap:
        _, e = heapq.heappop(heap)
        by_tag = tags[e] in SOFT or tags[e] == "header"
        if article[e] > rest and not outside or h1[e] and plain[e] > rest and tags[e] != "header" or not by_tag and not titled and plain[e] > 9 * rest:
            rest, outside, titled = rest + plain[e] - below[e], outside or free[e], titled or title[e]
            for inner in children.get(e, ()):
                heapq.heappush(heap, (-plain[inner], inner))
        else:
            out[e] = True
    for e in range(1, n):
        out[e] = out[e] or out[parents[e]]
    return out


def _link_lists(page: Page, out: list[bool]) -> list[bool]:
    """Branches of at least three links and hardly any other text: menus without a name."""
    n = len(page.tags)
    links, linked_text, text_of = [0] * n, [0] * n, [0] * n
    linked = [False] * n
    for e in range(1, n):
        linked[e] = linked[page.parents[e]] or page.tags[e] == "a"
        links[e] = int(page.tags[e] == "a" and not out[e])
    for e, text in page.events:
        if e >= 0 and not out[e]:
            size = len(text.strip())
            text_of[e] += size
            linked_text[e] += size if linked[e] else 0
    for e in range(n - 1, 0, -1):
        p = page.parents[e]
        links[p] += links[e]
        linked_text[p] += linked_text[e]
        text_of[p] += text_of[e]
    found = [False] * n
    for e in range(1, n):
        found[e] = found[page.parents[e]] or page.tags[e] in BLOCK and page.tags[e] not in TOP and links[e] >= 3 and 5 * linked_text[e] > 4 * text_of[e]
    return found


def main_text(page: Page, low: frozenset[int] = frozenset()) -> str:
    """The page's article: blocks joined by line ends. low: style nodes of little importance; the blocks among them go (words inside a block stay whole), unless nothing else is left.

    If articles have more text than what is outside them, that does not count; else if main elements have; else all does, but for lists of links.
    """
    n = len(page.tags)
    out = _dropped(page)
    in_article, in_main, faint = [False] * n, [False] * n, [False] * n
    for e in range(1, n):
        p = page.parents[e]
        mine = page.article[e] and not out[e]
        in_main[e] = in_main[p] or mine and page.tags[e] == "main"
        in_article[e] = in_article[p] or mine and page.tags[e] != "main"
        faint[e] = faint[p] or page.nodes[e] in low and page.tags[e] in BLOCK and page.tags[e] not in TOP
    menus = _link_lists(page, out)

    def blocks(kept: list[bool]) -> list[str]:
        found, parts = [], []
        for e, text in page.events:
            if e < 0:
                if parts and (block := " ".join(entities.unescape("".join(parts)).split())):
                    found.append(block)
                parts = []
            elif kept[e]:
                parts.append(text)
        if parts and (block := " ".join(entities.unescape("".join(parts)).split())):
            found.append(block)
        return found

    for lows in (faint, [False] * n):
        sizes = [0, 0, 0]
        for e, text in page.events:
            if e >= 0 and not out[e] and not lows[e]:
                size = len(text.strip())
                sizes[0] += size
                if in_article[e]:
                    sizes[1] += size
                if in_main[e] or in_article[e]:
                    sizes[2] += size
                if menus[e] and not (in_main[e] or in_article[e]):
                    sizes[0] -= size
        place = in_article if 2 * sizes[1] > sizes[0] else [a or m for a, m in zip(in_article, in_main, strict=True)] if 2 * sizes[2] > sizes[0] else None
        kept = [not out[e] and not lows[e] and (place[e] if place else not menus[e]) for e in range(n)]
        if not any(kept):
            continue
        if found := blocks(kept):
            return "\n".join(found)
        if not any(faint):
            break
    return ""
