"""Web pages as blocks of text, each with what the markup around it says."""

import html as references
import re
from dataclasses import dataclass, field

# Element names of HTML by what they do to text.
HIDDEN = frozenset((
    "audio button canvas datalist embed head iframe math noembed noframes noscript object option "
    "script select style svg template textarea title video"
).split())
RAW = frozenset("iframe noembed noframes script style textarea title xmp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset((
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset "
    "figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav "
    "ol p pre search section summary table tbody td tfoot th thead tr ul"
).split())
# A start tag ends the open element to the left unless one of those to the right is nearer.
ENDS = {
    "li": (("li",), ("ol", "ul", "menu", "dir")), "dd": (("dd", "dt"), ("dl",)), "dt": (("dd", "dt"), ("dl",)),
    "td": (("td", "th"), ("table",)), "th": (("td", "th"), ("table",)), "tr": (("tr",), ("table",)),
    "tbody": (("tbody", "thead", "tfoot"), ("table",)), "tfoot": (("tbody", "thead", "tfoot"), ("table",)),
    "option": (("option",), ("select",)),
}
# Parts of a page by element, ARIA role or words in class and id.
PARTS = {
    "nav": "nav navbar navigation menu breadcrumb breadcrumbs pagination pager toolbar tabs topnav",
    "header": "header masthead banner topbar logo branding",
    "footer": "footer contentinfo copyright legal colophon",
    "side": "aside sidebar complementary related recommended recommendations popular trending widget teaser",
    "notice": "alert alertdialog consent cookie cookies dialog gdpr modal newsletter notice notification paywall popup subscribe",
    "advert": "ad ads advert advertisement adverts adsense advertorial promo promotion sponsor sponsored sponsors",
    "share": "follow share sharing social",
    "comments": "comment comments commentlist disqus discussion replies reply respond responses",
    "form": "fieldset form login search searchbox signin signup",
    "main": "article articlebody body content entry main maincontent post prose story text",
}
_PART_OF = {word: part for part, words in PARTS.items() for word in words.split()}
_HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_ATTRIBUTE = re.compile(r"""[\s/]*([^\s/>=][^\s/>=]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']*)))?""")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


@dataclass
class Block:
    text: str
    parts: frozenset[str]  # keys of PARTS that hold around it
    tag: str  # innermost block element
    linked: int  # characters inside links
    holder: int  # number of its innermost container


@dataclass
class Page:
    blocks: list[Block] = field(default_factory=list)
    parents: list[int] = field(default_factory=lambda: [-1])  # container -> container around it


def _attributes(markup: str, at: int, end: int) -> dict[str, str]:
    found = {}
    while at < end and (m := _ATTRIBUTE.match(markup, at, end)) and m.end() > at:
        found.setdefault(m[1].lower(), references.unescape(m[2] or m[3] or m[4] or ""))
        at = m.end()
    return found


def _parts_named(name: str, attributes: dict[str, str]) -> set[str]:
    """Keys of PARTS that an element names by itself or by its role, class and id; "has-sidebar" and
    the like name none."""
    if name in ("html", "body"):
        return set()
    found = {_PART_OF[name]} if name in _PART_OF and name in BLOCKS else set()
    if name == "main":
        return found
    for key in ("role", "class", "id"):
        before = ""
        for word in map(str.lower, _WORD.findall(attributes.get(key, ""))):
            if word in _PART_OF and before not in ("has", "with", "no", "without"):
                found.add(_PART_OF[word])
            before = word
    return found


def _tag_end(markup: str, at: int) -> int:
    """Where the tag at ``at`` ends: the first > outside quotes; the end of the page if there is none."""
    while True:
        close = markup.find(">", at)
        if close < 0:
            return len(markup)
        # A quote opens a value only right behind an equals sign.
        m = _QUOTED.search(markup, at, close)
        if not m:
            return close
        end = markup.find(m[1], m.end())
        if end < 0:
            return close
        at = end + 1


# A tag with nothing before its end that could hide a ">".
_PLAIN = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?:[^<>"'=]|=\s*"[^"<>]*")*)>""")
_RAW_END = {name: re.compile(f"</{name}(?![a-zA-Z0-9])", re.IGNORECASE) for name in RAW}
_QUOTED = re.compile(r"""=\s*(["'])""")


class _Reader:
    """Reads markup from left to right; every element is opened and closed once."""

    def __init__(self) -> None:
        self.page = Page()
        # Open elements: (name, parts around, container, hidden, linked).
        self.open = [("", frozenset(), 0, False, False)]
        self.at: dict[str, list[int]] = {}  # name -> places in self.open
        self.pieces: list[str] = []
        self.linked = 0

    def flush(self) -> None:
        if not self.pieces:
            return
        text = " ".join("".join(self.pieces).split())
        if text:
            parts, holder, k = self.open[-1][1], self.open[-1][2], len(self.open) - 1
            while k and self.open[k][0] not in BLOCKS:
                k -= 1
            self.page.blocks.append(Block(text, parts, self.open[k][0], min(self.linked, len(text)), holder))
        self.pieces, self.linked = [], 0

    def text(self, text: str) -> None:
        name, _, _, hidden, linked = self.open[-1]
        if not hidden:
            self.pieces.append(text)
            if linked:
                self.linked += len(text.strip())

    def close(self, place: int) -> None:
        """Close the open element at a place and all inside it."""
        closed = self.open[place:]
        for element in closed:
            if element[0] in BLOCKS:
                self.flush()
                break
        for element in closed:
            self.at[element[0]].pop()
        del self.open[place:]

    def nearest(self, names) -> int:
        return max((self.at[n][-1] for n in names if self.at.get(n)), default=0)

    def start(self, name: str, attributes: dict[str, str]) -> None:
        if name in BLOCKS:
            self.flush()
            for left_open in ("p", "head"):
                if places := self.at.get(left_open):
                    self.close(places[-1])
        if name in ENDS:
            ends, bounds = ENDS[name]
            if (place := self.nearest(ends)) > self.nearest(bounds):
                self.close(place)
        elif name in _HEADINGS and (place := self.nearest(_HEADINGS)):
            self.close(place)
        if name in VOID:
            if name in ("br", "hr", "img"):
                self.text(" ")
            return
        _, parts, holder, hidden, linked = self.open[-1]
        if attributes or name in _PART_OF:
            own = _parts_named(name, attributes)
            if "header" in own and "main" in own | parts:
                own.discard("header")  # the heading of the article itself
            if own - {"main"} or name not in BLOCKS:
                own.discard("main")
            if own - parts:
                parts = parts | own
        if name in BLOCKS and name != "p":
            self.page.parents.append(holder)
            holder = len(self.page.parents) - 1
        hidden = hidden or name in HIDDEN
        self.at.setdefault(name, []).append(len(self.open))
        self.open.append((name, parts, holder, hidden, linked or name == "a"))

    def end(self, name: str) -> None:
        if places := self.at.get(name):
            self.close(places[-1])


def read_page(markup: str) -> Page:
    """The visible text of a page in blocks, in page order, character references decoded and white
    space turned into single spaces. Unclosed and misplaced tags are taken as browsers do in the
    common cases; nothing outside a tag, a comment or a hidden element is lost."""
    reader, at, n = _Reader(), 0, len(markup)

    def raw(name: str, at: int) -> int:
        """Past the content of an element that holds no markup."""
        m = _RAW_END[name].search(markup, at)
        close = m.start() if m else n
        if name not in HIDDEN:
            reader.text(markup[at:close])
        return close

    while at < n:
        tag = markup.find("<", at)
        if tag < 0:
            reader.text(references.unescape(markup[at:]))
            break
        if tag > at:
            reader.text(references.unescape(markup[at:tag]))
        if m := _PLAIN.match(markup, tag):  # most tags
            at = m.end()
            name = m[2].lower()
            if m[1]:
                reader.end(name)
                continue
            reader.start(name, _attributes(m[3], 0, len(m[3])) if m[3] else {})
            if name in RAW:
                at = raw(name, at)
            continue
        if markup.startswith("<!--", tag):
            end = markup.find("-->", tag + 2)
            if markup.startswith(("<!-->", "<!--->"), tag):
                at = markup.index(">", tag) + 1
            else:  # a comment without an end takes the rest, as in browsers
                at = n if end < 0 else end + 3
            continue
        if markup.startswith(("<!", "<?"), tag):
            close = markup.find(">", tag)
            at = n if close < 0 else close + 1
            continue
        closing = markup.startswith("</", tag)
        m = _NAME.match(markup, tag + 1 + closing)
        if not m:
            if closing:  # browsers take it as a comment
                close = markup.find(">", tag)
                at = n if close < 0 else close + 1
            else:
                reader.text("<")
                at = tag + 1
            continue
        name = m[0].lower()
        end = _tag_end(markup, m.end())
        at = min(end + 1, n)
        if closing:
            reader.end(name)
            continue
        reader.start(name, _attributes(markup, m.end(), end))
        if name in RAW:
            at = raw(name, at)
    reader.flush()
    return reader.page
