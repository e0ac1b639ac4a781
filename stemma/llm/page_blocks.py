"""Blocks of a web page, with what the markup says about each.

One pass over the page, linear in its length. A block is the text between two
block-level tags. The markup declares it part of the article, declares it
something else, or leaves it open; ``html_extract`` decides the open ones.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from html import unescape

ARTICLE, OPEN, OUTSIDE = 0, 1, 2

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Content that is no text of the page, up to the closing tag.
_RAW = frozenset("script style template noscript iframe noembed noframes xmp svg math textarea title select".split())
_BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header "
    "hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
_HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
#: A tag that opens ends these, if one of them is innermost.
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}

#: Elements that are never the article. A form, a header or a footer that holds the article is a wrapper of the page.
_NEVER = frozenset("nav aside footer header form button menu dialog label fieldset search".split())
_WRAPPER = frozenset("form header fieldset label".split())
#: Words in class, id or role that name page furniture; of those in _LAYOUT an element that holds the article is only named after its layout.
_LAYOUT = frozenset("banner contentinfo footer header heading-bar masthead menu nav navbar navigation notice side sidebar sidebars toolbar topbar widget widgets".split())
_FURNITURE = _LAYOUT | frozenset(
    "ad adbox ads adsense advert advertisement advertising advertorial adverts alert announcement author-box breadcrumb breadcrumbs comment commentlist comments complementary consent cookie cookies copyright "
    "disclaimer discussion disqus form gdpr hidden legal login modal newsletter notices notification notifications overlay pager paginate pagination paywall popup promo promoted promotion "
    "recommended related replies reply respond share sharebar sharing signup skip social sponsor sponsored subscribe subscription teaser toc trackback".split()
)
#: Words that name the article itself or a mere wrapper: between them and a block nothing is in doubt.
_ARTICLE = frozenset("article articlebody body content copy entry hentry inner main page post prose story text wrap wrapper".split())

_WORD = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_ATTR = re.compile(r"""(class|id|role|itemprop|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?(?=[\s/>"']|$)""", re.I)
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_REST = re.compile(r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+>""")
#: Attributes longer than this end at the first ``>``.
_ATTRIBUTES = 1 << 16


@dataclass(eq=False)
class _Element:
    name: str
    outer: _Element | None  # the nearest element around it that the markup speaks of
    furniture: bool = False
    layout: bool = False
    article: bool = False
    main: bool = False
    named: bool = False
    closed: bool = False
    holds_article: bool = False
    holds_main: bool = False


@dataclass
class Block:
    """slot: the tags and class words around the block; state: ARTICLE, OPEN or OUTSIDE."""

    text: str
    slot: str
    state: int


def _attributes(rest: str) -> tuple[set[str], set[str], bool]:
    """Words of class, id and role; exact values of role and itemprop; whether the element is hidden."""
    words, roles, hidden = set(), set(), False
    for m in _ATTR.finditer(rest):
        key, value = m[1].lower(), next((v for v in m.groups()[1:] if v is not None), "")
        if key == "hidden" or (key == "aria-hidden" and value.lower() == "true"):
            hidden = True
        elif key in ("role", "itemprop"):
            roles.update(value.lower().split())
        if key in ("class", "id", "role"):
            words.update(_WORD.findall(_CAMEL.sub(" ", value).lower()))
    return words, roles, hidden


def _events(html: str):
    """(kind, name, value): text with its value, open with the attributes, close. Raw content, comments and declarations are skipped."""
    missing, at, start, size = set(), 0, 0, len(html)
    while (i := html.find("<", at)) >= 0:
        follow = html[i + 1 : i + 2]
        if html.startswith("<!--", i):
            end = html.find("-->", i + 4) if "-->" not in missing else -1
            if end < 0:
                missing.add("-->")
            end = end + 3 if end >= 0 else html.find(">", i) + 1 or size
            kind = None
        elif follow in ("!", "?"):
            end, kind = html.find(">", i) + 1 or size, None
        elif m := _NAME.match(html, i + 2 if follow == "/" else i + 1):
            kind = "close" if follow == "/" else "open"
            full = _REST.match(html, m.end(), m.end() + _ATTRIBUTES)
            end = full.end() if full else html.find(">", m.end()) + 1
            if not end:  # a tag that the page breaks off in
                end = size
        else:
            at = i + 1
            continue
        if i > start:
            yield "text", "", html[start:i]
        if kind:
            name = m[0].lower()
            yield kind, name, html[m.end() : end - 1]
            if kind == "open" and name in _RAW and not html.startswith("/>", end - 2) and name not in missing:
                close = re.compile(rf"</{name}(?=[\s/>])", re.I).search(html, end)
                if close:
                    end = close.start()
                else:
                    missing.add(name)
                    if name in ("script", "style"):
                        end = size
        start = at = end
    if size > start:
        yield "text", "", html[start:]


def _outside(e: _Element | None, known: dict) -> bool:
    """Whether an element around is furniture, wrappers of the article left out."""
    path = []
    while e is not None and e not in known:
        path.append(e)
        e = e.outer
    verdict = known[e] if e is not None else False
    for e in reversed(path):
        wraps = e.holds_main or (e.holds_article and (e.layout or not e.closed))
        verdict = verdict or (e.furniture and not wraps)
        known[e] = verdict
    return verdict


def page_blocks(html: str | None) -> list[Block]:
    """The blocks in page order, without empty ones. Character references are decoded, white space inside a block becomes one space, and a line break is white space."""
    stack: list[_Element] = []
    around: dict = {}
    found = []  # text, element around, in a heading, in article, in main, plain, slot
    parts: list[str] = []

    def flush() -> None:
        text = " ".join(unescape("".join(parts)).split())
        parts.clear()
        if text:
            found.append((text, *here))

    def place() -> tuple:
        """What is known of the text that follows; the tuple ends with its slot."""
        top = stack[-1] if stack else None
        if top not in around:
            heading = any(e.name in _HEADING for e in stack[-3:])
            home = max((n for n, e in enumerate(stack) if e.article), default=None)
            room = max((n for n, e in enumerate(stack) if e.main), default=None)
            base = home if home is not None else room
            plain = base is not None and not any(e.named for e in stack[base + 1 :])
            around[top] = (top, heading, stack[home] if home is not None else None, room is not None, plain, "/".join(e.name + "." * e.named for e in stack[-4:]))
        return around[top]

    def pop(upto: int, closed: bool) -> None:
        while len(stack) > upto:
            e = stack.pop()
            count[e.name] -= 1
            if len(stack) == upto:
                e.closed = closed

    count: dict = {}
    here = place()
    for kind, name, value in _events(html or ""):
        if kind == "text":
            parts.append(value)
            continue
        if name == "br":
            parts.append(" ")
            continue
        if name in _VOID:
            if name in _BLOCK:
                flush()
            continue
        block = name in _BLOCK
        if kind == "close":
            if block:
                flush()
            if count.get(name):
                at = len(stack) - 1
                while stack[at].name != name:
                    at -= 1
                if not block and any(e.name in _BLOCK for e in stack[at:]):
                    continue
                if not block:
                    flush_inline = stack[at].furniture
                    if flush_inline:
                        flush()
                pop(at, True)
                here = place()
            continue
        if block:
            flush()
            if count.get("p"):
                at = len(stack) - 1
                while at >= 0 and stack[at].name != "p" and stack[at].name not in _BLOCK:
                    at -= 1
                if at >= 0 and stack[at].name == "p":
                    pop(at, True)
            while stack and stack[-1].name in _ENDS.get(name, ()):
                pop(len(stack) - 1, True)
        if name in _RAW:
            continue
        words, roles, hidden = _attributes(value) if value else (set(), set(), False)
        e = _Element(name, stack[-1] if stack else None)
        if name not in ("html", "body"):
            bad = words & _FURNITURE
            e.layout = name in _WRAPPER or (bool(bad) and bad <= _LAYOUT)
            e.furniture = name in _NEVER or bool(bad) or hidden or name == "head"
            e.named = bool(words) and not words & _ARTICLE and not e.furniture
            e.article = name == "article" or "article" in roles or "articlebody" in roles
            e.main = name == "main" or "main" in roles
        if not block and not e.furniture:
            continue
        if e.furniture and not block:
            flush()
        if e.article or e.main:
            for up in reversed(stack):
                done = (up.holds_main or not e.main) and (up.holds_article or not e.article)
                up.holds_main, up.holds_article = up.holds_main or e.main, up.holds_article or e.article
                if done:
                    break
        stack.append(e)
        count[name] = count.get(name, 0) + 1
        here = place()
    flush()

    known: dict = {}
    proper = [a is not None and not _outside(a, known) for _, _, _, a, *_ in found]
    has_article, has_main = any(proper), False
    if not has_article:
        has_main = any(m and not _outside(top, known) for _, top, _, _, m, *_ in found)
    blocks = []
    for (text, top, heading, home, main, plain, slot), ours in zip(found, proper, strict=True):
        if _outside(top, known):
            state = ARTICLE if ours and heading and _heads(top, home) else OUTSIDE
        elif ours or (has_main and main):
            state = ARTICLE if plain else OPEN
        elif has_main or (has_article and not main):
            state = OUTSIDE
        else:
            state = OPEN
        blocks.append(Block(text, slot, state))
    return blocks


def _heads(e: _Element, home: _Element) -> bool:
    """Whether the heading lies in the article's own header: what is furniture between the two is a header alone."""
    while e is not home:
        if e.furniture and e.name != "header":
            return False
        e = e.outer
    return True
