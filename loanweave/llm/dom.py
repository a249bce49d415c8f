"""HTML as a flat list of block elements with their texts, parsed leniently in one pass."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

# Element names of the HTML standard, by role.
HIDDEN = frozenset(
    "script style head noscript template svg iframe object canvas audio video map annotation"
    " annotation-xml".split()
)
RAW = frozenset("script style noscript iframe title textarea".split())  # end at their end tag only
PAIRED = HIDDEN - RAW - {"head"}  # may hold elements, also of their own kind
SKIPPED_UNCLOSED = frozenset("template svg object annotation annotation-xml".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q ruby rt rp s samp"
    " small span strike strong sub sup time tt u var wbr img picture"
    " math maction menclose merror mfenced mfrac mi mmultiscripts mn mo mover mpadded mphantom"
    " mprescripts mroot mrow ms mspace msqrt mstyle msub msubsup msup mtext munder munderover none"
    " semantics".split()
)
CELLS = frozenset("mtable mtr mlabeledtr mtd".split())  # inline, but apart from what is around
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption"
    " figure footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre section summary"
    " table tbody td tfoot th thead tr ul".split()
)
# An element on the left is ended by the start of one on the right.
ENDED_BY = {
    "li": frozenset(["li"]),
    "dt": frozenset(["dt", "dd"]),
    "dd": frozenset(["dt", "dd"]),
    "tr": frozenset(["tr", "tbody", "tfoot"]),
    "td": frozenset(["td", "th", "tr", "tbody", "tfoot"]),
    "th": frozenset(["td", "th", "tr", "tbody", "tfoot"]),
    "option": frozenset(["option", "optgroup"]),
}
CLOSED_ONLY_INSIDE = frozenset("ul ol dl table select".split())  # what stops the search upwards

# Words by which class, id and role values name an advert.
ADVERT = ("advert", "sponsor", "promo", "banner")
ADVERT_WORDS = frozenset(["ad", "ads", "adv", "adbox"])
DESCRIBING = frozenset(["class", "id", "role", "itemprop", "aria-label"])

_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_GAP = re.compile(r"[\s/]*")
_ATTRIBUTE = re.compile(r"([^\s/>][^\s/>=]*)(\s*=\s*)?")
_UNQUOTED = re.compile(r"[^\s>]*")


class Scanner:
    """Tags of a page, in one forward pass: quotes count only after an equals sign, and one that is
    never closed is an ordinary character."""

    def __init__(self, source: str) -> None:
        self.source = source
        self.unclosed: set[str] = set()  # quotes that do not come again

    def next(self, at: int) -> tuple[int, int, bool, str | None, bool, list[tuple[str, str]]] | None:
        """(begin, end, closing, name, closes itself, attributes) of the next tag from ``at``; the
        name of a comment or declaration is none."""
        source = self.source
        while (begin := source.find("<", at)) >= 0:
            following = source[begin + 1 : begin + 2]
            if following == "!" or following == "?":
                return begin, self._comment_end(begin), False, None, False, []
            found = _NAME.match(source, begin)
            if found:
                end, slash, attributes = self._attributes(found.end())
                return begin, end, following == "/", found.group(1).lower(), slash, attributes
            if following == "/" and begin + 2 < len(source):  # what browsers read as a comment
                return begin, self._after(">", begin), False, None, False, []
            at = begin + 1
        return None

    def _after(self, what: str, at: int) -> int:
        found = self.source.find(what, at)
        return found + len(what) if found >= 0 else len(self.source)

    def _comment_end(self, begin: int) -> int:
        if not self.source.startswith("<!--", begin):
            return self._after(">", begin)
        for empty in ("<!-->", "<!--->"):
            if self.source.startswith(empty, begin):
                return begin + len(empty)
        return self._after("-->", begin + 4)

    def _attributes(self, at: int) -> tuple[int, bool, list[tuple[str, str]]]:
        source, end, found = self.source, len(self.source), []
        while True:
            gap = _GAP.match(source, at)
            at = gap.end()
            if at >= end:
                return end, False, found
            if source[at] == ">":
                return at + 1, source[at - 1] == "/", found
            name = _ATTRIBUTE.match(source, at)
            at, value = name.end(), ""
            if name.group(2):
                quote = source[at : at + 1]
                if quote in ("'", '"') and quote not in self.unclosed:
                    close = source.find(quote, at + 1)
                    if close >= 0:
                        value, at = source[at + 1 : close], close + 1
                    else:
                        self.unclosed.add(quote)
                if not value and at == name.end():
                    plain = _UNQUOTED.match(source, at)
                    value, at = plain.group(), plain.end()
            found.append((name.group(1).lower(), value))


def names_advert(names: str) -> bool:
    """Whether class, id and role values name an advert."""
    for token in names.split():
        if token in ADVERT_WORDS or token.startswith(("ad-", "ad_", "ads-")) or any(w in token for w in ADVERT):
            return True
    return False


@dataclass
class Page:
    """Block elements in page order. ``texts`` are (element, text, inside a link) in page order;
    an element of -1 there marks a block boundary."""

    tags: list[str] = field(default_factory=list)
    parents: list[int] = field(default_factory=list)
    names: list[str] = field(default_factory=list)  # class, id and role values, in lower case
    gold: list[str] = field(default_factory=list)
    texts: list[tuple[int, str, bool]] = field(default_factory=list)


def parse(source: str) -> Page:
    """The page's block elements; inline elements add their texts to the block they stand in.
    Scripts, styles, comments and what else is never shown give neither; formulas give their
    text, without annotations. Broken markup is read as far as it goes: unclosed elements end with
    their parent, unclosed hidden ones where a block starts or ends, stray end tags are skipped."""
    page = Page()
    tags, parents, texts = page.tags, page.parents, page.texts
    tags.append("#page")
    parents.append(-1)
    page.names.append("")
    page.gold.append("")
    stack: list[int] = [0]
    links, at, end = 0, 0, len(source)
    hidden: dict[int, int] | None = None
    nested: dict[int, int] = {}  # elements of its name inside each open inline advert
    find = Scanner(source).next
    while at < end:
        token = find(at)
        begin = token[0] if token else end
        if begin > at:
            text = source[at:begin]
            texts.append((stack[-1], html.unescape(text) if "&" in text else text, links > 0))
        if token is None:
            break
        _, at, closing, tag, slash, attributes = token
        if tag is None:
            continue
        if tag == "a":
            links = 0 if closing else 1
        if tag in INLINE:
            top = stack[-1]
            if closing:
                if top in nested and tags[top] == tag:
                    nested[top] -= 1
                    if nested[top] < 0:
                        stack.pop()
            elif tag not in VOID:
                names, gold = _names(attributes)
                if names and names_advert(names):  # an advert is an element of its own, in its line
                    tags.append(tag)
                    parents.append(top)
                    page.names.append(names)
                    page.gold.append(gold)
                    stack.append(len(tags) - 1)
                    nested[len(tags) - 1] = 0
                elif top in nested and tags[top] == tag:
                    nested[top] += 1
            continue
        if tag in CELLS:
            texts.append((-1, "", False))
            continue
        if tag in VOID:
            if tag == "br" or tag == "hr":
                texts.append((-1, "", False))
            continue
        if tag == "head":  # all that belongs in it is hidden by itself, so its ends do not matter
            texts.append((-1, "", False))
            continue
        if closing:
            for depth in range(len(stack) - 1, 0, -1):
                if tags[stack[depth]] == tag:
                    del stack[depth:]
                    break
            texts.append((-1, "", False))
            continue
        if tag in PAIRED:
            if hidden is None or at not in hidden:
                hidden = _hidden_ends(source, begin)
            at = hidden[at]
            continue
        if tag in RAW:
            close = _closing(tag).search(source, at)
            at = close.end() if close else end
            continue
        links = 0
        _end_implied(stack, tags, tag)
        stack_top = stack[-1]
        names, gold = _names(attributes)
        texts.append((-1, "", False))
        tags.append(tag)
        parents.append(stack_top)
        page.names.append(names)
        page.gold.append(gold)
        stack.append(len(tags) - 1)
    return page


def _names(attributes: list[tuple[str, str]]) -> tuple[str, str]:
    """(describing values in lower case, label of a training page)."""
    names, gold = "", ""
    for name, value in attributes:
        if name in DESCRIBING:
            names += " " + value.lower()
        elif name == "data-gold":
            gold = value
    return names, gold


def _closing(tag: str) -> re.Pattern:
    return re.compile(rf"</{re.escape(tag)}\s*>", re.I)


def _hidden_ends(source: str, at: int) -> dict[int, int]:
    """By the end of each start tag of ``PAIRED`` elements from ``at`` on: where the element ends.

    End tags close the last open element of their name. An svg also ends where a block starts or
    ends outside its foreign objects. ``SKIPPED_UNCLOSED`` elements without an end tag end at the
    next block's start or end, others with their start tag, as do those that close themselves."""
    ends: dict[int, int] = {}
    opened: dict[str, list[int]] = {tag: [] for tag in PAIRED}
    blocks: dict[int, int] = {}  # where the next block starts or ends
    waiting: list[int] = []  # start tags before which no block has come since
    closed_by_slash: set[int] = set()
    foreign, end = 0, len(source)
    find = Scanner(source).next
    while token := find(at):
        begin, at, closing, tag, slash, _ = token
        if tag is None:
            continue
        if tag in BLOCK:
            for start in waiting:
                blocks[start] = begin
            waiting.clear()
            if not foreign:
                for start in opened["svg"]:
                    ends[start] = begin
                opened["svg"].clear()
        elif tag == "foreignobject":
            if closing:
                foreign = max(0, foreign - 1)
            elif opened["svg"] and not slash:
                foreign += 1
        elif tag in PAIRED:
            if closing:
                if opened[tag]:
                    ends[opened[tag].pop()] = at
            elif tag == "svg" and slash:
                ends[at] = at
            else:
                opened[tag].append(at)
                waiting.append(at)
                if slash:
                    closed_by_slash.add(at)
            if not opened["svg"]:
                foreign = 0
        elif tag in RAW and not closing and not (opened["svg"] and (slash or tag == "title")):
            close = _closing(tag).search(source, at)
            at = close.end() if close else end
    for tag, starts in opened.items():
        for start in starts:
            skipped = tag in SKIPPED_UNCLOSED and start not in closed_by_slash
            ends[start] = blocks.get(start, end) if skipped else start
    return ends


def _end_implied(stack: list[int], tags: list[str], tag: str) -> None:
    """End what the start of a block ends: an open paragraph, and list or table parts of its kind."""
    for depth in range(len(stack) - 1, 0, -1):
        open_tag = tags[stack[depth]]
        if open_tag in INLINE:  # an advert in a line does not keep the line open
            continue
        if open_tag == "p" or tag in ENDED_BY.get(open_tag, ()):
            del stack[depth:]
            return
        if open_tag in CLOSED_ONLY_INSIDE or open_tag not in ENDED_BY:
            return
