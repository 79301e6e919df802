"""Blocks of an HTML page: one forgiving pass over the tags, no tree.

A block is the text between two tags that end a line of text (paragraphs, headings, list items, table rows and the
like). Every block has a zone: shut (boilerplate by its markup), article, main (a main element without an article around
it), or open (the markup does not say).
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field
from html import unescape

ARTICLE, MAIN, OPEN, SHUT = 3, 2, 1, 0

# Element names of HTML.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span"
    " strike strong sub sup time tt u var wbr".split()
)
# Their text is no text of the page.
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes svg math object".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# What these hold is not the page's main text.
SHUT_NAMES = frozenset("nav aside footer form button select menu dialog head fieldset datalist".split())
# Words of class, id and role that say the same of any element but these.
SHUT_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent notice notices"
    " newsletter subscribe signup sidebar menu nav navbar navigation breadcrumb breadcrumbs footer comment comments disqus replies"
    " related recommended share sharing social popup modal overlay widget pagination complementary contentinfo search toolbar".split()
)
NEVER_SHUT = frozenset("html body main".split())
# Elements that end by themselves when their like or another block begins.
LINES = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd tr td th option".split())
# An article never begins inside these; one that does shows that they were left open.
LEFT_OPEN = frozenset("nav header form menu select button fieldset head".split())

_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^'">])*+)>""")
_PLAIN_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
_ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_WORD = re.compile(r"[a-z0-9]+")


# A class name says what an element has, not what it is, if it begins with one of these.
_HAS = frozenset("has no with without is hide show".split())
_RAW_ENDS = {n: re.compile(f"</{n}(?=[\\s/>])", re.I) for n in RAW}


@dataclass
class Page:
    """``texts[i]`` is block ``i``; its tokens (tags and words) are ``tokens[starts[i]:starts[i + 1]]``.

    ``linked[i]`` says that all of its text is in links.
    """

    texts: list[str] = field(default_factory=list)
    zones: list[int] = field(default_factory=list)
    linked: list[bool] = field(default_factory=list)
    starts: list[int] = field(default_factory=list)
    tokens: list[str] = field(default_factory=list)


def _hints(attributes: str) -> tuple[set[str], bool]:
    """First and last words of the names in class, id and role; whether the element is hidden."""
    words, hidden = set(), False
    for name, value in _ATTRIBUTE.findall(attributes) if attributes else ():
        name, value = name.lower(), value.strip("\"'").lower()
        if name in ("class", "id", "role"):
            for v in value.split():
                own = _WORD.findall(v)
                if own and own[0] not in _HAS:
                    words.update((own[0], own[-1]))
        else:
            hidden |= name == "hidden" or value == "true"
    return words, hidden


def parse(html: str | None) -> Page:
    """The blocks of a page in order; blocks without text are left out.

    Character references are decoded, white space inside a block becomes one space. A tag that never ends is
    text. Unclosed elements end with the element around them; an article ends menus and forms left open before it.
    """
    page = Page()
    html = html or ""
    # Open elements: (name, zone before), and how many of each name.
    stack: list[tuple[str, int]] = []
    opened: Counter = Counter()
    zone, links = OPEN, 0
    held: list[str] = []
    unlinked = False
    begun: list[str] = []
    at, end, quotes = 0, html.rfind(">"), True

    def add(text: str) -> None:
        nonlocal unlinked
        held.append(text)
        unlinked |= not links and not text.isspace() and text != ""

    def cut(k: int) -> int:
        """Closes the open elements from ``k`` on; the zone before them."""
        before = stack[k][1]
        opened.subtract(name for name, _ in stack[k:])
        del stack[k:]
        return before

    def close_block() -> None:
        nonlocal begun, unlinked
        words = unescape("".join(held)).split()
        held.clear()
        if words:
            page.texts.append(" ".join(words))
            page.zones.append(zone)
            page.linked.append(not unlinked)
            page.starts.append(len(page.tokens))
            page.tokens += begun
            page.tokens += words
            begun = []
        unlinked = False

    while True:
        lt = html.find("<", at)
        if lt < 0:
            add(html[at:])
            break
        if lt > at:
            add(html[at:lt])
        if html.startswith("<!--", lt):
            stop = html.find("-->", lt + 2)
            at = stop + 3 if stop >= 0 else len(html)
            continue
        if lt + 1 < len(html) and html[lt + 1] in "!?":
            stop = html.find(">", lt)
            at = stop + 1 if stop >= 0 else len(html)
            continue
        tag = None
        if lt < end:
            tag = _TAG.match(html, lt) if quotes else None
            if tag is None:
                tag = _PLAIN_TAG.match(html, lt)
                # A quote that never closes: from here on quotes mean nothing.
                quotes = quotes and tag is None
        if tag is None:
            add("<")
            at = lt + 1
            continue
        closing, name, attributes = tag[1], tag[2].lower(), tag[3]
        at = tag.end()
        if name in RAW and not closing:
            stop = None if attributes.endswith("/") else _RAW_ENDS[name].search(html, at)
            if stop:
                at = html.find(">", stop.end()) + 1 or len(html)
            elif name in ("script", "style"):
                at = len(html)
            continue
        if name == "br":
            held.append(" ")
            continue
        if name in INLINE:
            if name == "a":
                links = 0 if closing else 1
            continue
        close_block()
        begun.append(f"<{closing}{name}")
        if closing:
            if opened[name] > 0:
                k = len(stack) - 1
                while stack[k][0] != name:
                    k -= 1
                zone, links = cut(k), 0
            continue
        if stack and stack[-1][0] in LINES and (name == stack[-1][0] or stack[-1][0] == "p"):
            zone = cut(len(stack) - 1)
        if name in VOID or attributes.endswith("/"):
            continue
        words, hidden = _hints(attributes)
        if words:
            begun[-1] += "." + ".".join(sorted(words))
        shut = name in SHUT_NAMES or name not in NEVER_SHUT and (hidden or not words.isdisjoint(SHUT_WORDS))
        shut |= zone < MAIN and (name == "header" or name not in NEVER_SHUT and not words.isdisjoint(("header", "masthead")))
        opens = 0 if shut else ARTICLE if name == "article" else MAIN if name == "main" or "main" in words and name not in NEVER_SHUT else 0
        if opens and zone == SHUT:
            if any(opened[n] > 0 for n in LEFT_OPEN):
                zone = cut(next(k for k, (n, _) in enumerate(stack) if n in LEFT_OPEN))
        if shut or name not in LINES:
            stack.append((name, zone))
            opened[name] += 1
        if shut:
            zone = SHUT
        elif zone != SHUT:
            zone = max(zone, opens)
    close_block()
    return page
