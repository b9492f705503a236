"""HTML to leaf blocks: runs of text between block boundaries, with their ancestors and link share."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass

# HTML elements by how they break text or hide it, and which open elements a start tag ends.
INLINE = set("math maction menclose merror mfrac mi mmultiscripts mn mo mover mpadded mphantom mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover none mprescripts semantics a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = set("area base br col embed frame hr img input link meta param source track wbr".split())
#: What stands in these is no markup, and ends with the page if nothing else ends it.
RAW = set("script style textarea title iframe noframes xmp".split())
#: What stands in these isn't text of the page; where the end tag is missing, only the start tag goes.
ASIDE = set("noscript template svg select object canvas audio video annotation annotation-xml".split())
ENDS = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "thead": {"tr", "td", "th"}, "tbody": {"tr", "td", "th", "thead", "tbody"}, "tfoot": {"tr", "td", "th", "tbody"}, "option": {"option"}, "body": {"head"},
}
SCOPE = {"ul", "ol", "dl", "table", "td", "th", "div", "article", "section", "main", "aside", "nav", "header", "footer", "body", "form", "blockquote", "figure", "button"}
P_ENDS = set("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul li dt dd".split())

TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)""",
    re.S,
)
ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|style|aria-hidden|itemprop|rel)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""", re.I)
NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
SPACE = re.compile(r"\s+")


@dataclass(slots=True)
class Block:
    text: str
    path: tuple[str, ...]  # from the root: tag, and tag.name for each name of its class, id and role
    linked: int  # characters within links


def _names(tag: str, attributes: str) -> str:
    """The tag with the lower-case words of its class, id, role, and whether it is hidden."""
    if not attributes or "=" not in attributes and "hidden" not in attributes:
        return tag
    words = []
    for m in ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key in ("hidden", "aria-hidden", "style"):
            if key == "hidden" and not value or value.lower() in ("true", "hidden") or key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                words.append("hidden")
        else:
            words += [w.lower() for w in NAME.findall(value)]
    return ".".join([tag, *dict.fromkeys(words)])


def blocks(page: str | None) -> list[Block]:
    """The blocks of a page in order; references are decoded and white space is folded."""
    page = page or ""
    out: list[Block] = []
    stack: list[str] = []  # tags
    path: list[str] = []  # the same with names
    parts: list[str] = []
    linked, links, at, end, where = 0, 0, 0, len(page), ()
    open_ended: set[str] = set()  # tags whose end tag doesn't come any more

    def flush() -> None:
        nonlocal linked
        if parts:
            text = SPACE.sub(" ", html.unescape("".join(parts))).strip()
            if text:
                out.append(Block(text, where, linked))
            parts.clear()
        linked = 0

    def close(k: int) -> None:
        nonlocal links
        links -= stack[k:].count("a")
        del stack[k:], path[k:]

    while at < end:
        m = TOKEN.search(page, at)
        stop = m.start() if m else end
        if stop > at:
            if not parts:
                where = tuple(x for x in path if x.split(".", 1)[0] not in INLINE or "." in x)
            parts.append(page[at:stop])
            if links:
                linked += stop - at
        if not m:
            break
        at = m.end()
        tag = m[2] or m[5]
        if not tag:
            continue
        tag, closing, attributes = tag.lower(), m[1] if m[2] else m[4], m[3] if m[2] else m[6]
        if closing:
            if tag not in INLINE:
                flush() if tag != "br" else parts.append(" ")
            if tag in stack:
                k = len(stack) - 1 - stack[::-1].index(tag)
                if tag not in INLINE or not any(t not in INLINE for t in stack[k + 1 :]):
                    close(k)
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag not in INLINE:
            flush()
            if tag in P_ENDS and "p" in stack:
                k = len(stack) - 1 - stack[::-1].index("p")
                if not any(t in SCOPE for t in stack[k + 1 :]):
                    close(k)
            for t in ENDS.get(tag, ()):
                if t in stack:
                    k = len(stack) - 1 - stack[::-1].index(t)
                    if not any(x in SCOPE and x != t and x != "body" for x in stack[k + 1 :]):
                        close(k)
        if tag in RAW or tag in ASIDE:
            last = None
            if not attributes.endswith("/") and tag not in open_ended:
                last = re.compile(rf"</{re.escape(tag)}\s*>?", re.I).search(page, at)
                if not last:
                    open_ended.add(tag)
            if last:
                at = last.end()
                if at < end and page[at - 1] != ">":
                    at = (page.find(">", at) + 1) or end
            elif tag in RAW and not attributes.endswith("/"):
                at = end
            continue
        if tag in VOID or attributes.endswith("/") and tag not in ("p", "div", "a", "span", "li"):
            continue
        stack.append(tag)
        path.append(_names(tag, attributes))
        links += tag == "a"
    flush()
    return out
