"""HTML as it is found: a reader that mends what is not closed or closed twice, and the text that a page shows.

One reader serves both the visible text of pages and the cards of result pages. It keeps the elements that are open; what
a document leaves out (ends of paragraphs, list items, cells and the head) is implied, and an end tag that nothing open has
is passed over.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Fixed values of HTML: elements without content, those that begin a line, and those that may stand in a head.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody tfoot thead tr ul".split())
HEAD = frozenset("base link meta noscript script style template title".split())
#: Fixed values of HTML: a start tag of the second ends an open element of the first; the last stops the search for it.
IMPLIED = (
    (frozenset(["p"]), BLOCKS - frozenset("body caption dd dt html legend li optgroup option summary tbody tfoot thead tr".split()), frozenset("button td th table caption".split())),
    (frozenset(["li"]), frozenset(["li"]), frozenset("ul ol menu dir table td th".split())),
    (frozenset(["dt", "dd"]), frozenset(["dt", "dd"]), frozenset("dl table td th".split())),
    (frozenset(["option"]), frozenset(["option", "optgroup"]), frozenset(["select"])),
    (frozenset(["td", "th"]), frozenset("td th tr tbody tfoot thead".split()), frozenset(["table"])),
    (frozenset(["tr"]), frozenset("tr tbody tfoot thead".split()), frozenset(["table"])),
    (frozenset("tbody tfoot thead".split()), frozenset("tbody tfoot thead".split()), frozenset(["table"])),
)
#: End tags of inline elements do not reach past these.
WALLS = frozenset("td th table caption button html".split())
#: Elements whose content is not shown.
UNSEEN = frozenset("audio canvas datalist head iframe noscript object script style svg template textarea title video".split())
_HIDING = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse))", re.IGNORECASE)


#: A tag that the end of the document cuts off.
_CUT_TAG = re.compile(r"<[A-Za-z/!][^<>]*\Z")


@dataclass(eq=False)
class Element:
    tag: str
    attrs: dict[str, str]
    kinds: frozenset[str] = field(default_factory=frozenset)


class Soup(HTMLParser):
    """Calls ``opened`` and ``closed`` for elements and ``shown`` for text, with ``self.open`` being the elements around."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[Element] = []

    def read(self, html: str | None):
        self.feed(_CUT_TAG.sub("", html or ""))
        self.close()
        while self.open:
            self.closed(self.open.pop())
        return self

    def opened(self, element: Element) -> None:
        pass

    def closed(self, element: Element) -> None:
        pass

    def shown(self, text: str) -> None:
        pass

    def handle_starttag(self, tag, attrs):
        if tag not in HEAD and tag not in ("html", "head"):
            self._end(self._place(["head"], frozenset()))
        for ended, by, walls in IMPLIED:
            if tag in by:
                self._end(self._place(ended, walls))
        known = {k: v or "" for k, v in reversed(attrs)}  # the first of equal attributes counts
        element = Element(tag, known, frozenset(known.get("class", "").split()))
        self.opened(element)
        if tag in VOID:
            self.closed(element)
        else:
            self.open.append(element)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if tag == "br":
            self.handle_starttag("br", [])
        elif tag in BLOCKS or tag in WALLS:
            self._end(self._place([tag], frozenset(["table"]) if tag != "table" else frozenset()))
        elif (at := self._place([tag], WALLS)) is not None:
            self.closed(self.open.pop(at))  # blocks begun within an inline element go on

    def handle_data(self, data):
        self.shown(data)

    def _place(self, tags, walls) -> int | None:
        """Where the innermost open element of these tags is."""
        for at in range(len(self.open) - 1, -1, -1):
            if self.open[at].tag in tags:
                return at
            if self.open[at].tag in walls:
                return None
        return None

    def _end(self, at: int | None) -> None:
        while at is not None and len(self.open) > at:
            self.closed(self.open.pop())


class VisibleText(Soup):
    """Lines as a browser shows them: blocks begin lines, paragraphs stand apart, cells are parted by tabs."""

    def __init__(self):
        super().__init__()
        self.done: list[str] = []
        self.line: list[str] = []
        self.gap, self.hidden, self.kept = 0, 0, 0

    def _hides(self, element: Element) -> bool:
        own = element.tag in UNSEEN or "hidden" in element.attrs or _HIDING.search(element.attrs.get("style", "")) is not None
        around = self.open[-1] if self.open else None
        folded = around is not None and around.tag == "details" and "open" not in around.attrs and element.tag != "summary"
        return own or folded or (element.tag == "dialog" and "open" not in element.attrs)

    def opened(self, element):
        element.hides = self._hides(element)
        self.hidden += element.hides
        if self.hidden:
            return
        if element.tag == "br":
            self._break(0, "\n")
        elif element.tag in ("td", "th"):
            if "".join(self.line).strip(" "):
                self.line.append("\t")
        elif element.tag in BLOCKS:
            self._break(2 if element.tag == "p" else 1)
        self.kept += element.tag == "pre"

    def closed(self, element):
        if not self.hidden and element.tag in BLOCKS:
            self._break(2 if element.tag == "p" else 1)
        self.kept -= element.tag == "pre" and not self.hidden
        self.hidden -= element.hides

    def shown(self, text):
        if self.hidden or (self.open and self.open[-1].tag == "details" and "open" not in self.open[-1].attrs):
            return
        if self.kept:
            first, *rest = text.split("\n")
            self._write(first)
            for line in rest:
                self._break(0, "\n")
                self._write(line)
            return
        text = re.sub(r"[ \t\n\r\f]+", " ", text)
        if text.startswith(" ") and (not self.line or self.line[-1].endswith((" ", "\t"))):
            text = text[1:]
        self._write(text)

    def _write(self, text: str) -> None:
        if text:
            self.line.append(text)

    def _break(self, apart: int, written: str = "") -> None:
        """Ends the line. ``apart``: how many line ends at least there are between what is before and after."""
        line = "".join(self.line)
        if not self.kept:
            line = line.rstrip(" ")
        self.line = []
        if line or written:
            if line and self.done and self.gap:
                self.done.append("\n" * self.gap)
            if line:
                self.gap = 0
            self.done.append(line + written)
        self.gap = max(self.gap, apart)

    def text(self) -> str:
        self._break(1)
        return "".join(self.done).strip("\n")


def visible_text(html: str | None) -> str:
    """The text that a page shows; empty for null."""
    return VisibleText().read(html).text()


class Cards(Soup):
    """The outermost elements that ``is_card`` picks, each as a list of the elements in it with their texts."""

    def __init__(self, is_card):
        super().__init__()
        self.is_card, self.cards, self.inside = is_card, [], 0

    def opened(self, element):
        element.text, element.card = [], not self.inside and self.is_card(element.tag, element.kinds)
        if element.card:
            self.cards.append([])
            self.inside = 1
        if self.inside:
            self.cards[-1].append(element)

    def closed(self, element):
        if element.card:
            self.inside = 0

    def shown(self, text):
        if self.inside:
            for element in self.open:
                element.text.append(text)


def cards(html: str | None, is_card) -> list[list[Element]]:
    return Cards(is_card).read(html).cards


@F.pandas_udf(StringType())
def visible_text_column(html: pd.Series) -> pd.Series:
    return html.map(visible_text)
