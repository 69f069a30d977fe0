"""A small tolerant HTML reader: text blocks with the elements around them.

Works on one page at a time inside a task. Inline elements (links, bold, ...)
only split text when they carry a boilerplate role; ``p``, ``li`` and the like
end where the next one begins; a closing tag without its opening one is
ignored; script and style contents are skipped as raw text. Outside the article an
element's class or id marks it as a page part when a word of it names one; inside the article
only containers can be marked, and only by a whole token, so that no heading, paragraph or
phrase of the article goes by its name. Pages are scanned in one pass.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from typing import NamedTuple

# Element and attribute names with a known part on a page.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp "
                   "small span strike strong sub sup time tt u var wbr math semantics mrow mi mn mo ms mtext mspace mstyle "
                   "mfrac msqrt mroot msub msup msubsup munder mover munderover".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea noscript template iframe svg title xmp noembed noframes".split())
BOILER_TAGS = frozenset("nav footer aside form button select option menu dialog head object audio video canvas "
                        "datalist fieldset map".split()) | RAW
BOILER_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu "
                         "menubar toolbar tablist status".split())
BOILER_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion promoted "
    "menu nav navbar navigation breadcrumb breadcrumbs sidebar sidebars aside rail footer foot header masthead "
    "comment comments commentlist disqus reply replies respond cookie cookies consent gdpr notice notices "
    "notification notifications popup modal overlay newsletter subscribe subscription signup login register share "
    "sharing social related recommended recommendations widget widgets toolbar pagination pager search skip "
    "copyright disclaimer form hidden".split())
MAIN_TAGS = frozenset(("article", "main"))
CONTAINERS = frozenset("div section ul ol dl table figure details center".split())
# An element of these ends an open one of the same group.
_ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"),
         "th": ("td", "th"), "option": ("option",), "thead": (), "tbody": ("thead", "tr", "td", "th")}
_SCOPE = frozenset("ul ol dl table article main section body div".split())

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)
    |<(/?)([a-zA-Z][^\s/>]*+)([^>"']*+(?:"[^"]*+"[^>"']*+|'[^']*+'[^>"']*+)*+)>
    |<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>""", re.S | re.X)
_ATTR = re.compile(r"""\b(class|id|role|itemprop|style|hidden|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_NAME = re.compile(r"[A-Za-z]+")


class Element(NamedTuple):
    tag: str
    sign: str  # tag and class words: the presentation
    role: str  # "main", "boiler" or ""


class Block(NamedTuple):
    path: tuple[Element, ...]
    text: str


def element(tag: str, attrs: str, inside_main: bool) -> Element:
    """Tag, presentation and role of an opening tag."""
    words: list[str] = []
    role = "boiler" if tag in BOILER_TAGS or (tag == "header" and not inside_main) else ""
    main = tag in MAIN_TAGS
    if attrs and not attrs.isspace():
        for name, value in _ATTR.findall(attrs):
            name, value = name.lower(), value.strip("\"'")
            if name in ("class", "id"):
                found = [w.lower() for w in (*_WORD.findall(value), *_NAME.findall(value))]
                if name == "class":
                    words += found
                if inside_main:
                    named = value.lower().split() if tag in CONTAINERS else ()
                else:
                    named = found if tag not in ("body", "html") else ()
                if not main and not BOILER_WORDS.isdisjoint(named):
                    role = "boiler"
            elif name == "role" and value.lower() in BOILER_ROLES:
                role = "boiler"
            elif name == "role" and value.lower() in MAIN_TAGS or name == "itemprop" and value == "articleBody":
                main = True
            elif name == "hidden" or name == "aria-hidden" and value.lower() == "true" or (
                    name == "style" and re.search(r"display\s*:\s*none", value, re.I)):
                role, main = "boiler", False
    if main and role != "boiler":
        role = "main"
    return Element(tag, tag + "".join("." + w for w in sorted(set(words))), role)


def squeezed(text: str) -> str:
    """Character references decoded, white space runs as one space, trimmed."""
    if "&" in text:
        text = html.unescape(text)
    return " ".join(text.split())


def text_blocks(page: str) -> list[Block]:
    """The non-empty text blocks of a page, in page order, with their open
    elements (inline ones only if boilerplate)."""
    out: list[Block] = []
    stack: list[Element] = []
    open_: Counter[str] = Counter()  # tags and roles on the stack
    piece: list[str] = []
    at = 0

    def push(e: Element) -> None:
        stack.append(e)
        open_[e.tag] += 1
        open_["role " + e.role] += 1

    def pop() -> str:
        e = stack.pop()
        open_[e.tag] -= 1
        open_["role " + e.role] -= 1
        return e.tag

    def flush() -> None:
        if piece:
            text = squeezed("".join(piece))
            if text:
                out.append(Block(tuple(stack), text))
            piece.clear()

    end = page.rfind(">") + 1  # no tag ends behind it
    for m in _TAG.finditer(page, 0, end):
        if m.start() < at:
            continue  # inside raw text
        if m.start() > at:
            piece.append(page[at:m.start()])
        at = m.end()
        tag = m[2] or m[5]
        if tag is None:
            if m[0].startswith("<!--") and not m[0].endswith("-->"):
                at = len(page)
            continue
        tag = tag.lower()
        if m[1] or m[4]:
            if open_[tag]:
                flush()
                while pop() != tag:
                    pass
            elif tag not in INLINE:
                flush()
            continue
        attrs = m[3] if m[2] else m[6]
        if tag == "br":
            piece.append(" ")
            continue
        if tag in VOID:
            if tag not in INLINE:
                flush()
            continue
        e = element(tag, attrs, open_["role main"] > 0)
        if tag in RAW:
            flush()
            if not attrs.rstrip().endswith("/"):
                close = re.compile(rf"</{re.escape(tag)}\b", re.I).search(page, at)
                at = page.find(">", close.end()) + 1 if close and close.end() < end else len(page)
            continue
        if tag in INLINE:
            if e.role == "boiler":
                flush()
                push(e)
            continue
        flush()
        if open_["p"]:  # a block ends an open paragraph
            while pop() != "p":
                pass
        ends = _ENDS.get(tag, ())
        if ends:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k].tag in ends:
                    for _ in range(len(stack) - k):
                        pop()
                    break
                if stack[k].tag in _SCOPE:
                    break
        if not attrs.rstrip().endswith("/"):
            push(e)
    if at < len(page):  # no tag, but an unclosed comment may begin here
        piece.append(re.split("<[!?]", page[at:], maxsplit=1)[0])
    flush()
    return out
