"""Leaf blocks of an HTML page: their texts and tag paths, from a tolerant scanner.

Time grows in proportion to the page, however its tags are nested or left open: the scanner only moves
forward, a search that finds nothing is not made again, and an open element's path is its parent's with
its own names added.
"""

from __future__ import annotations

import functools
import html
import re
import zlib
from collections import Counter
from dataclasses import dataclass, field

#: Buckets that the names of a tag path are hashed to.
PATH_BITS = 96
# HTML element kinds.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: What these hold is text of no paragraph; where one is not closed, it goes on to the page's end.
RAW = frozenset("script style iframe textarea title".split())
#: These hold nothing to read either; where one is not closed, only its tag goes.
HIDDEN = frozenset("noscript template object svg select annotation annotation-xml head".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data dfn del em font i img ins kbd label mark q ruby s samp small span strike strong sub sup time tt u var wbr "
    "math maction menclose merror mfenced mfrac mi mmultiscripts mn mo mover mpadded mphantom mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover semantics".split()
)
CLOSES = {  # an element of the key's kind ends an open element of the value's kinds
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",),
}

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_EDGE = re.compile(r"[>\"']")
_NAME = re.compile(r"(?<![\w-])(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
_WORDS = re.compile(r"[a-z]+")
_SPACE = re.compile(r"\s+")


@dataclass
class Block:
    text: str
    path: int  # a bit for each bucket that a name of its tag path is hashed to
    depth: int  # names in its tag path
    linked: float  # share of its characters that stand in links


@dataclass
class _Open:
    """An open block-level element with the inline elements that are open in it."""

    tag: str
    path: int
    depth: int
    inline: list[str] = field(default_factory=list)
    counts: Counter = field(default_factory=Counter)


@functools.lru_cache(maxsize=1 << 16)
def bucket(word: str, size: int) -> int:
    return zlib.crc32(word.encode("utf-8", "surrogatepass")) % size


def _marks(attributes: str) -> list[str]:
    """Words of class, id and role."""
    return [w for m in _NAME.finditer(attributes) for w in _WORDS.findall((m[1] or m[2] or m[3] or "").lower())]


class _Scanner:
    def __init__(self, page: str):
        self.page = page
        self.never: set[str] = set()  # what does not occur from here on

    def find(self, what: str, at: int) -> int:
        """Where ``what`` stands next, or -1."""
        if what in self.never:
            return -1
        found = self.page.find(what, at)
        if found < 0:
            self.never.add(what)
        return found

    def tag_end(self, at: int) -> int:
        """The place of the mark that ends the tag whose attributes begin at ``at``, or the page's end.

        A quote opens a value after an equals sign, if it is closed later.
        """
        page = self.page
        while m := _EDGE.search(page, at):
            at = m.end()
            if m[0] == ">":
                return m.start()
            before = m.start() - 1
            while page[before].isspace():
                before -= 1
            if page[before] == "=" and (end := self.find(m[0], at)) >= 0:
                at = end + 1
        return len(page)

    def closed(self, tag: str, at: int) -> int:
        """The end of the next closing tag of ``tag``, or -1."""
        key = f"</{tag}"
        if key in self.never:
            return -1
        m = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(self.page, at)
        if m is None:
            self.never.add(key)
            return -1
        return m.end()


def blocks(page: str | None) -> list[Block]:
    """The blocks of a page in order; blank ones are left out.

    Text is what stands between the edges of block-level elements. Character references are decoded
    and white space is folded to single spaces. Scripts, styles, comments and the head have no text.
    """
    out: list[Block] = []
    page = page or ""
    scan = _Scanner(page)
    stack = [_Open("", 0, 0)]
    open_: Counter = Counter()
    links = 0  # open links
    parts: list[str] = []
    linked = 0

    def flush() -> None:
        nonlocal parts, linked
        if parts:
            text = _SPACE.sub(" ", html.unescape("".join(parts))).strip()
            if text:
                out.append(Block(text, stack[-1].path, stack[-1].depth, min(1.0, linked / len(text))))
        parts, linked = [], 0

    def end_inline(till: str | None = None) -> None:
        """Ends the inline elements of the innermost block, or those from the last ``till`` on."""
        nonlocal links
        top = stack[-1]
        while top.inline:
            tag = top.inline.pop()
            top.counts[tag] -= 1
            links -= tag == "a"
            if tag == till:
                break

    def end_block() -> None:
        end_inline()
        open_[stack.pop().tag] -= 1

    def text(piece: str) -> None:
        nonlocal linked
        if piece:
            parts.append(piece)
            if links:
                linked += len(piece.strip())

    at, n = 0, len(page)
    while at < n:
        mark = page.find("<", at)
        if mark < 0:
            text(page[at:])
            break
        text(page[at:mark])
        if page.startswith("<!--", mark):
            end = scan.find("-->", mark + 4)
            at = end + 3 if end >= 0 else n
            continue
        if page[mark + 1 : mark + 2] in ("!", "?") and mark + 1 < n:
            end = scan.find(">", mark)
            at = end + 1 if end >= 0 else n
            continue
        m = _TAG.match(page, mark)
        if m is None:
            text("<")
            at = mark + 1
            continue
        end = scan.tag_end(m.end())
        attributes, at, tag = page[m.end() : end], min(n, end + 1), m[2].lower()
        if m[1]:
            if tag in INLINE:
                if stack[-1].counts[tag]:
                    end_inline(tag)
            else:
                flush()
                if open_[tag]:
                    while stack[-1].tag != tag:
                        end_block()
                    end_block()
            continue
        alone = attributes.endswith("/")
        if (tag in RAW or tag in HIDDEN) and not alone:
            close = scan.closed(tag, at)
            if tag == "head" and close < 0:
                close = page.lower().find("<body", at) if "<body" not in scan.never else -1
                scan.never.add("<body")
            if close >= 0 or tag in RAW:
                at = close if close >= 0 else n
            parts.append(" ")
            continue
        if tag not in INLINE:
            flush()
            if tag == "br":
                continue
            end_inline()
            while stack[-1].tag == "p":  # a block ends an open paragraph
                end_block()
                end_inline()
            while stack[-1].tag in CLOSES.get(tag, ()):
                end_block()
            if tag not in VOID and not alone:
                names = [tag, *(f"{tag}.{w}" for w in _marks(attributes))]
                path = stack[-1].path
                for name in names:
                    path |= 1 << bucket(name, PATH_BITS)
                stack.append(_Open(tag, path, stack[-1].depth + len(names)))
                open_[tag] += 1
        elif tag not in VOID and not alone:
            stack[-1].inline.append(tag)
            stack[-1].counts[tag] += 1
            links += tag == "a"
    flush()
    return out
