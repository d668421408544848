"""HTML as a stream of open elements, text and block borders, in time that grows with the page's length whatever its markup."""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

#: HTML's elements by what they do to the text around them.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("iframe noembed noframes script style textarea title xmp".split())
UNSEEN = frozenset("noscript template svg math object audio video canvas datalist".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var img br wbr".split())
#: Starts of these end an open paragraph; starts on the left end an open element on the right, up to one of the third.
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul li dt dd".split())
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
#: Elements that say what part of a page they hold, and the largest spans of a cell.
REGIONS = frozenset("nav header footer aside form article main".split())
MOST_COLUMNS, MOST_ROWS = 1000, 65534
_TAG = re.compile(r"<(/?)([A-Za-z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)>")
#: A tag of a plain table or paragraph, and the text behind it.
_PLAIN = re.compile(r"<(/?)(p|table|tr|td|th)((?: [a-z]+=(?:\"[^\"<>]*\"|[a-z0-9]+))*)>([^<]*)")
_SPAN = re.compile(r"(colspan|rowspan)\s*=\s*[\"']?\s*(\d{1,6})", re.IGNORECASE)


@lru_cache
def _raw_end(tag: str) -> re.Pattern:
    return re.compile(f"</{tag}", re.IGNORECASE)


class Markup:
    """Reads a page with feed(); subclasses say what opened(), closed(), text() and edge() do.

    Ends that HTML leaves out are supplied (of paragraphs, list items, cells, ...), ends of what isn't open are passed over,
    and text that a page doesn't show (scripts, styles, templates, ...) isn't given. opened() and closed() come in pairs for
    all but void elements; edge() comes where a block element starts or ends, before opened() or closed().
    """

    def __init__(self) -> None:
        self.open: list[str] = []
        self.tags: Counter = Counter()
        self.inline: list[Counter] = [Counter()]  # open inline elements, for each open block
        self.unseen = 0

    def opened(self, tag: str, attributes: str) -> None:
        pass

    def closed(self, tag: str) -> None:
        pass

    def text(self, plain: str) -> None:
        pass

    def edge(self) -> None:
        pass

    def feed(self, page: str | None) -> None:
        page = page or ""
        at, size = 0, len(page)
        while at < size:
            mark = page.find("<", at)
            if mark < 0:
                self._text(page[at:])
                break
            self._text(page[at:mark])
            sign = page[mark + 1 : mark + 2]
            if sign in ("!", "?") or (sign == "/" and not page[mark + 2 : mark + 3].isalpha()):
                comment = page.startswith("<!--", mark)
                stop = page.find("-->", mark + 2) if comment else page.find(">", mark)
                at = size if stop < 0 else stop + (3 if comment else 1)
            elif sign and sign.isascii() and (sign.isalpha() or sign == "/"):
                found = _TAG.match(page, mark)
                if not found:  # a tag that never ends
                    break
                at, tag = found.end(), found[2].lower()
                if found[1]:
                    self._end(tag)
                else:
                    self._start(tag, found[3])
                    if tag in RAW:
                        stop = _raw_end(tag).search(page, at)
                        at = stop.start() if stop else size
            else:
                self._text("<")
                at = mark + 1
        self.edge()

    def _text(self, raw: str) -> None:
        if raw and not self.unseen:
            self.text(html.unescape(raw))

    def _pop(self) -> None:
        tag = self.open.pop()
        self.tags[tag] -= 1
        self.unseen -= tag in UNSEEN
        if tag in INLINE:
            self.inline[-1][tag] -= 1
        else:
            self.inline.pop()
        self.closed(tag)

    def _close(self, tag: str) -> None:
        while self.open[-1] != tag:
            self._pop()
        self._pop()

    def _start(self, tag: str, attributes: str) -> None:
        if tag not in INLINE:
            self.edge()
            if tag in ENDS_P and self.tags["p"]:
                self._close("p")
            if tag in CLOSES:
                own, upto = CLOSES[tag]
                if any(self.tags[t] for t in own):
                    name = next((t for t in reversed(self.open) if t in own or t in upto), None)
                    if name in own:
                        self._close(name)
        elif tag == "br":
            self.text(" ")
        elif tag == "a" and self.inline[-1]["a"]:
            self._close("a")
        if tag in VOID:
            return
        self.open.append(tag)
        self.tags[tag] += 1
        self.unseen += tag in UNSEEN
        if tag in INLINE:
            self.inline[-1][tag] += 1
        else:
            self.inline.append(Counter())
        self.opened(tag, attributes)

    def _end(self, tag: str) -> None:
        if tag in INLINE:
            if self.inline[-1][tag] > 0:
                self._close(tag)
            elif tag == "br":
                self.text(" ")
            return
        self.edge()
        if self.tags[tag] > 0:
            self._close(tag)


class _Blocks(Markup):
    """Leaf blocks: the text between two block borders."""

    def __init__(self) -> None:
        super().__init__()
        self.said: list[str] = []
        self.blocks: list[str] = ["body"]
        self.regions: list[str] = [""]
        self.found: list[tuple[int, str, str, int, str]] = []

    def opened(self, tag: str, attributes: str) -> None:
        if tag not in INLINE:
            self.blocks.append(tag)
        if tag in REGIONS:
            self.regions.append(tag)

    def closed(self, tag: str) -> None:
        if tag not in INLINE:
            self.blocks.pop()
        if tag in REGIONS:
            self.regions.pop()

    def text(self, plain: str) -> None:
        self.said.append(plain)

    def edge(self) -> None:
        text = " ".join("".join(self.said).split())
        self.said = []
        if text:
            self.found.append((len(self.found) + 1, self.blocks[-1], self.regions[-1], len(self.blocks) - 1, text))


def blocks(page: str | None) -> list[tuple[int, str, str, int, str]]:
    """(pos from 1, tag, region, depth, text) of each leaf block: its element, the nearest element that names a part of the page, and its depth."""
    state = _Blocks()
    state.feed(page)
    return state.found


@dataclass
class _Cell:
    header: bool
    columns: int
    rows: int
    said: list[str] = field(default_factory=list)

    @property
    def value(self) -> str:
        return " ".join("".join(self.said).split())


@dataclass
class _Table:
    """A table under way: where the next cell goes, and the cells above that reach into the row."""

    number: int
    row: int = 0
    own: dict[int, _Cell] = field(default_factory=dict)
    above: dict[int, tuple[int, _Cell]] = field(default_factory=dict)
    cell: _Cell | None = None
    in_row: bool = False


class _Grids(Markup):
    """Tables as grids: a cell that spans rows or columns stands in each place it covers."""

    def __init__(self) -> None:
        super().__init__()
        self.stack: list[_Table] = []
        self.tables = 0
        self.found: list[tuple[int, int, int, str, bool, bool]] = []

    def opened(self, tag: str, attributes: str) -> None:
        if tag == "table":
            self.tables += 1
            self.stack.append(_Table(self.tables))
        elif self.stack and tag == "tr":
            self._end_row()
            self.stack[-1].in_row = True
        elif self.stack and tag in ("td", "th"):
            table = self.stack[-1]
            table.in_row = True
            table.cell = _Cell(tag == "th", *_spans(attributes))
            at = next(c for c in range(len(table.own) + len(table.above) + 1) if c not in table.own and c not in table.above)
            for c in range(at, at + table.cell.columns):
                if c not in table.own and c not in table.above:
                    table.own[c] = table.cell

    def closed(self, tag: str) -> None:
        if self.stack and tag in ("td", "th"):
            self.stack[-1].cell = None
        elif self.stack and tag == "tr":
            self._end_row()
        elif tag == "table" and self.stack:
            self._end_row()
            self.stack.pop()

    def text(self, plain: str) -> None:
        if self.stack and self.stack[-1].cell:
            self.stack[-1].cell.said.append(plain)

    def edge(self) -> None:
        self.text(" ")

    def _end_row(self) -> None:
        table = self.stack[-1]
        if not table.in_row:
            return
        table.row += 1
        places = {**{c: (cell, False) for c, (_, cell) in table.above.items()}, **{c: (cell, True) for c, cell in table.own.items()}}
        self.found += [(table.number, table.row, c + 1, cell.value, cell.header, own) for c, (cell, own) in sorted(places.items())]
        below = {c: (left - 1, cell) for c, (left, cell) in table.above.items() if left > 1}
        table.above = {**below, **{c: (cell.rows - 1, cell) for c, cell in table.own.items() if cell.rows > 1}}
        table.own, table.cell, table.in_row = {}, None, False


def _spans(attributes: str) -> tuple[int, int]:
    """The columns and rows that a cell covers."""
    spans = {k.lower(): int(v) for k, v in _SPAN.findall(attributes)}
    return min(max(spans.get("colspan", 1), 1), MOST_COLUMNS), min(spans.get("rowspan", 1), MOST_ROWS) or MOST_ROWS


def _plain_grids(page: str) -> list[tuple[int, int, int, str, bool, bool]] | None:
    """What _Grids finds in a page of paragraphs and tables of rows of cells that hold text only, in a pass over its tags; None for any other page."""
    tags = _PLAIN.findall(page)
    if len(tags) != page.count("<"):
        return None
    found: list[tuple[int, int, int, str, bool, bool]] = []
    number = row = free = 0
    inside = in_row = row_open = False
    cell = ""  # the open cell's tag
    own: dict[int, tuple[str, bool, int]] = {}
    above: dict[int, tuple[str, bool, int]] = {}  # with the rows that are left

    def end_row() -> None:
        nonlocal row, own, above, in_row, free
        if not in_row:
            return
        row += 1
        if above:
            found.extend((number, row, c + 1, x[0], x[1], c in own) for c, x in sorted({**above, **own}.items()))
        else:
            found.extend([(number, row, c + 1, x[0], x[1], True) for c, x in own.items()])
        above = {c: (x[0], x[1], x[2] - 1) for places in (above, own) for c, x in places.items() if x[2] > 1}
        own, in_row, free = {}, False, 0

    for end, tag, attributes, text in tags:
        if tag == "td" or tag == "th":
            if end:
                if cell and cell != tag:
                    return None
                cell = ""
            elif not inside:
                return None
            else:
                cell, in_row = tag, True
                columns, rows = _spans(attributes) if attributes else (1, 1)
                one = (" ".join((html.unescape(text) if "&" in text else text).split()), tag == "th", rows)
                while free in own or free in above:
                    free += 1
                for c in range(free, free + columns):
                    if c not in above:
                        own[c] = one
        elif tag == "tr":
            if not row_open and cell or not end and not inside:
                return None
            if row_open or not end:
                end_row()
                cell, in_row, row_open = "", not end, not end
        elif tag == "p":
            if inside:
                return None
        elif not end:
            if inside:
                return None
            number, row, free, inside, in_row, row_open, cell, own, above = number + 1, 0, 0, True, False, False, "", {}, {}
        elif inside:
            end_row()
            inside, row_open, cell = False, False, ""
    end_row()
    return found


def grids(page: str | None) -> list[tuple[int, int, int, str, bool, bool]]:
    """(table, row, column, text, header, own row) of each place of each table, from 1; a table inside a cell is a table of its own."""
    plain = _plain_grids(page or "")
    if plain is not None:
        return plain
    state = _Grids()
    state.feed(page)
    while state.stack:  # a page that ends inside a table
        state._end_row()
        state.stack.pop()
    return sorted(state.found)


BLOCKS = "pos long, tag string, region string, depth int, text string"
GRID = "tabela int, linha int, coluna int, texto string, cabecalho boolean, propria boolean"


class BlocksFromHtml:
    """blocks_from_html(html): BLOCKS of a page, one row for each leaf block."""

    def eval(self, page: str) -> Iterator[tuple]:
        yield from blocks(page)


class TablesFromHtml:
    """tables_from_html(html): GRID of a page, one row for each place of each table."""

    def eval(self, page: str) -> Iterator[tuple]:
        yield from grids(page)
