"""A tolerant scan of an HTML page into blocks of text and the tags around them."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass

_TAG = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[(.*?)(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>""",
    re.DOTALL,
)
_ATTRIBUTE = re.compile(r"""([a-zA-Z_:][-\w:.]*)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea iframe noscript noembed noframes xmp template svg math".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q s samp small span strike strong sub sup time tt u var wbr img ruby rb rt rp".split())
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl dd dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre search section summary table ul".split()
)
# An opened element ends an open sibling of these kinds, up to a limiting parent.
SIBLINGS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"thead", "tbody", "tr", "td", "th"}, {"table"}),
    "option": ({"option"}, {"select"}),
}

# What is no article text, by element, by role and by the words of class and id.
OUTSIDE = frozenset("nav aside footer form button select dialog menu head object canvas audio video fieldset".split())
OUTSIDE_ROLES = frozenset("navigation banner complementary contentinfo search dialog alert alertdialog form menu menubar toolbar".split())
OUTSIDE_WORDS = frozenset(
    """ad ads adsbygoogle adslot adbox advert adverts advertisement advertising adsense sponsor sponsored promo promotion comment comments commentlist disqus
    respond replies nav navbar navigation menu breadcrumb breadcrumbs footer cookie cookies consent gdpr notice notices
    alert newsletter subscribe subscription signup login share sharing social related recommended recommendations
    popup modal overlay pagination pager skip""".split()
)
# These give way to an article inside them: page layouts are named after them, too.
LAYOUT_WORDS = frozenset("sidebar header masthead banner widget toolbar topbar".split())
ARTICLE_OUTSIDE = frozenset("ad ads advert advertisement sponsored promo comment comments reply related teaser".split())
CONTENT_WORDS = frozenset("articlebody content article post entry story main".split())


@dataclass
class Block:
    """A run of text without a break: where it stands and whether it can be article text."""

    path: str
    text: str
    outside: bool
    root: int  # 3 in an article, 2 in main, 1 in a part named as content, else 0
    links: int = 0  # characters inside links


@dataclass
class _Open:
    """An open element. Its path tells it from others by what it begins with: the name
    of its first block inside, or # for text; an inline element is part of its block."""

    name: str
    path: str
    hard: bool
    layout: bool
    root: int
    block: _Open | None = None
    link: bool = False
    begun: bool = False

    def begins(self, what: str) -> None:
        held = self.block or self
        if not held.begun:
            held.begun = True
            held.path = f"{held.path}/{what}"

    @property
    def place(self) -> str:
        return self.block.path if self.block else self.path


def _part(here: _Open | None) -> tuple[bool, bool, int]:
    return (here.hard, here.layout, here.root) if here else (False, False, 0)


def _attributes(raw: str) -> dict[str, str]:
    return {name.lower(): html.unescape(value.strip("\"'")) for name, value in _ATTRIBUTE.findall(raw)} if "=" in raw or raw.strip() else {}


def _words(value: str) -> set[str]:
    return {part.lower() for part in _PART.findall(value)}


def _opened(name: str, raw: str, above: _Open | None) -> _Open:
    held = _attributes(raw)
    names = _words(f"{held.get('class', '')} {held.get('id', '')}") if held else set()
    root = above.root if above else 0
    hard, layout = (above.hard, above.layout) if above else (False, False)
    if name == "article" or held.get("itemprop", "").lower() == "articlebody":
        kind = 3
    elif name == "main" or held.get("role") == "main":
        kind = 2
    else:
        kind = 1 if names & CONTENT_WORDS else 0
    if name in ("html", "body"):
        kind = 0
    elif kind >= 2:
        layout = False
        hard = hard or bool(names & ARTICLE_OUTSIDE)
    else:
        hard = hard or name in OUTSIDE or held.get("role") in OUTSIDE_ROLES or bool(names & OUTSIDE_WORDS)
        hard = hard or "hidden" in held or held.get("aria-hidden") == "true" or "display:none" in held.get("style", "").replace(" ", "").lower()
        layout = layout or (name == "header" and root < 2) or bool(names & LAYOUT_WORDS)
    label = name + "".join(f".{c}" for c in sorted(held.get("class", "").split())[:3]) if held else name
    link = name == "a" or bool(above and above.link)
    if name in INLINE and above:
        return _Open(name, "", hard, layout, max(root, kind), above.block or above, link)
    if above:
        above.begins(name)
    path = f"{above.place}>{label}" if above else label
    return _Open(name, path, hard, layout, max(root, kind), None, link)


def scan(page: str) -> tuple[list[Block], list[str]]:
    """The blocks of a page in order, and the paths of its block tags in order."""
    blocks: list[Block] = []
    opened: list[_Open] = []
    linked = 0
    stack: list[_Open] = []
    pieces: list[str] = []
    where: _Open | None = None

    def flush() -> None:
        nonlocal where, linked
        text = " ".join("".join(pieces).split())
        if text:
            here = where
            blocks.append(Block(here.place if here else "", text, bool(here and (here.hard or here.layout)), here.root if here else 0, min(linked, len(text))))
        pieces.clear()
        where, linked = None, 0

    def add(raw: str) -> None:
        nonlocal where, linked
        if not raw:
            return
        top = stack[-1] if stack else None
        if pieces and where is not top and _part(where) != _part(top):
            flush()  # an inline part that is no article text
        if where is None and not raw.isspace():
            where = top
        if top and not raw.isspace():
            top.begins("#")
            if top.link:
                linked += len(raw.strip())
        pieces.append(html.unescape(raw) if "&" in raw else raw)

    def pop_to(depth: int) -> None:
        del stack[depth:]

    at, end = 0, len(page)
    while at < end:
        match = _TAG.search(page, at)
        if not match:
            add(page[at:])
            break
        add(page[at : match.start()])
        at = match.end()
        if match[1] is not None:
            add(match[1])
            continue
        closing, name, raw = (match[2], match[3], match[4]) if match[3] else (match[5], match[6], match[7])
        if not name:
            continue
        name = name.lower()
        if closing:
            if name not in INLINE:
                flush()
            depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i].name == name), None)
            if depth is not None:
                pop_to(depth)
            continue
        if name in RAW:
            if raw.endswith("/") and name in ("svg", "math"):
                continue
            close = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.IGNORECASE).search(page, at)
            at = close.end() if close else end
            continue
        if name not in INLINE:
            flush()
        if name in CLOSES_P:
            depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i].name == "p"), None)
            if depth is not None and not any(o.name in ("table", "button", "td", "th") for o in stack[depth:]):
                pop_to(depth)
        if name in SIBLINGS:
            kinds, limits = SIBLINGS[name]
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth].name in limits:
                    break
                if stack[depth].name in kinds:
                    pop_to(depth)
        if name in VOID:
            continue
        here = _opened(name, raw, stack[-1] if stack else None)
        if name not in INLINE:
            opened.append(here)
        stack.append(here)
    flush()
    return blocks, [here.path for here in opened]
