"""Block structure: lines against a stack of open containers, as the specification's appendix has it.

Definitions are collected on the way; inline text is parsed when all lines are read, because it may
refer to what is defined later.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import accumulate

from folio.kernel import lexer as lx
from folio.kernel.inline import QUIET, Inline, Parser, bare_destination, title_at


@dataclass(frozen=True)
class Options:
    """dialect: 'gfm' or 'commonmark'; the depths bound recursion, deeper markers are text."""

    dialect: str = "gfm"
    max_block_depth: int = 128
    max_inline_depth: int = 16


class Block:
    """A node: kind, children, inline content, and what a kind has besides."""

    __slots__ = ("attrs", "children", "inline", "kind")

    def __init__(self, kind: str, children: list[Block] | None = None, inline: list[Inline] | None = None, **attrs):
        self.kind, self.children, self.inline, self.attrs = kind, children or [], inline, attrs

    def add(self, block: Block) -> None:
        self.children.append(block)


@dataclass
class Definition:
    label: str
    url: str
    title: str | None
    scope: str


@dataclass(slots=True)
class Refs:
    """Link definitions by key, the first of a key counts; footnotes by key, the last definition counts."""

    links: dict[str, Definition] = field(default_factory=dict)
    notes: dict[str, dict] = field(default_factory=dict)
    numbered: int = 0

    def link(self, label: str) -> tuple[str, str | None] | None:
        if len(label.encode()) > 999 or not label.strip(lx.TRIM):
            return None
        d = self.links.get(lx.label_key(label))
        return (d.url, d.title) if d else None

    def footnote(self, text: str, at: int) -> tuple[Inline, int] | None:
        """A reference to a defined footnote; numbers it on its first use."""
        if not self.notes or not text.startswith("^", at + 1):
            return None
        m = _NOTE_REF.match(text, at)
        note = self.notes.get(lx.label_key(m[1])) if m else None
        if note is None:
            return None
        if not note["number"]:
            self.numbered += 1
            note["number"] = self.numbered
        note["references"] += 1
        return Inline("FootnoteRef", extra=(m[1], note["number"], note["references"])), m.end()


_NOTE_REF = re.compile(r"\[\^([^\] \t\r\n]+)\]")
_DEF_LABEL = re.compile(r"\[((?:[^\[\]\\]|\\.)+)\]:", re.S)
_ONE_BREAK = re.compile(r"[ \t]*\n?[ \t]*")
_REST = re.compile(r"[ \t\f\r]*(?:\n|\Z)")
_ANGLE = re.compile(r"<((?:[^<>\n\\]|\\.)*)>")


def scan_definition(text: str, at: int) -> tuple[str, str, str | None, int] | None:
    """(label, url, title, end of its last line) of the link definition at ``at``."""
    m = _DEF_LABEL.match(text, at)
    if not m or not m[1].strip(lx.TRIM) or len(m[1].encode()) > 999 or re.search(r"\n[ \t]*\n", m[1]):
        return None
    i = _ONE_BREAK.match(text, m.end()).end()
    if i >= len(text):
        return None
    if text[i] == "<":
        d = _ANGLE.match(text, i)
        if not d:
            return None
        url, i = d[1], d.end()
    else:
        stop = bare_destination(text, i)
        if stop is None or stop == i:
            return None
        url, i = text[i:stop], stop
    gap = _ONE_BREAK.match(text, i).end()
    if gap > i and (found := title_at(text, gap)) is not None and (end := _REST.match(text, found[1])) is not None:
        return m[1], url, found[0], end.end()
    end = _REST.match(text, i)
    return (m[1], url, None, end.end()) if end else None


# ------------------------------------------------------------------ tables
def split_row(row: str) -> list[str]:
    row = row.strip(lx.TRIM).removeprefix("|")
    row = row.removesuffix("|")
    if "\\" not in row:
        return row.split("|")
    cells, start, i = [], 0, 0
    while (i := row.find("|", i)) >= 0:
        slashes = len(row[:i]) - len(row[:i].rstrip("\\"))
        if slashes % 2 == 0:
            cells.append(row[start:i])
            start = i + 1
        i += 1
    return [*cells, row[start:]]


_DELIMITER = re.compile(r"(:?)-+(:?)\Z")


@lru_cache(maxsize=256)
def _alignments(row: str) -> tuple[str, ...] | None:
    out = []
    for cell in split_row(row):
        m = _DELIMITER.match(cell.strip(lx.TRIM))
        if not m:
            return None
        out.append({(True, True): "center", (True, False): "left", (False, True): "right"}.get((bool(m[1]), bool(m[2])), "none"))
    return tuple(out)


def alignments(row: str) -> tuple[str, ...] | None:
    """Alignments of a delimiter row. Most tables of a corpus share a few such rows: short ones are kept."""
    return _alignments(row) if len(row) <= 1000 else _alignments.__wrapped__(row)


#: A bullet at the margin, perhaps a task, and text that begins with a letter.
_PLAIN_ITEM = re.compile(r"([-+*]) (?:\[([ xX])\] )?(?=[A-Za-z])")

_TASKS = {None: None, " ": "unchecked", "x": "checked", "X": "checked"}

#: Rows of a table whose cells are words or numbers between single blanks.
_TIDY = re.compile(r"(?:(?:\| [0-9A-Za-z]++ )++\|(?:\n|\Z))++")

#: Columns whose alignment is kept.
ALIGNED_COLUMNS = 128


class Table(Block):
    """A table by its lines: rows and cells become blocks only where they are asked for as blocks.

    In a document with footnotes, which are numbered in the order of parsing, they are made at once.
    """

    __slots__ = ("aligns", "made", "parser", "rows")

    def __init__(self, rows: list[str], aligns: tuple[str, ...]):
        self.kind, self.inline, self.attrs = "Table", None, {"columns": len(aligns)}
        self.rows = rows  # the header first
        self.aligns = aligns if len(aligns) <= ALIGNED_COLUMNS else tuple(a if k < ALIGNED_COLUMNS else "none" for k, a in enumerate(aligns))
        self.parser: Parser | None = None  # of the cells, where their inline content is wanted
        self.made: list[Block] | None = None

    @property
    def size(self) -> int:
        """How many rows and cells there are."""
        return len(self.rows) * (1 + len(self.aligns))

    def cells(self, tidy: bool = False) -> Iterator[list[str]]:
        """The sources of each row's cells, short rows filled and long ones cut; ``tidy``: the table is known to be so."""
        n, trim = len(self.aligns), lx.TRIM
        for row in self.rows:
            cells = row[2:-2].split(" | ") if tidy else [c.strip(trim) for c in split_row(row)]
            yield cells if len(cells) == n else cells[:n] if len(cells) > n else cells + [""] * (n - len(cells))

    @property
    def tidy(self) -> bool:
        """Whether all cells are single ASCII words or numbers between single blanks: each is its own plain text."""
        return _TIDY.fullmatch("\n".join(self.rows)) is not None

    @property
    def children(self) -> list[Block]:
        if self.made is None:
            parser, self.made = self.parser, []
            for r, row in enumerate(self.cells()):
                cells = [Block("TableCell", None, parser.plain(c) if parser else None, align=a) for c, a in zip(row, self.aligns, strict=True)]
                self.made.append(Block("TableRow", cells, header=r == 0))
        return self.made


class PlainList(Block):
    """A bullet list by the sources of the plain items that it begins with: they become blocks only where they are asked for as blocks.

    Items behind them, and the last of them if anything may follow in it, are blocks: ``rest``.
    """

    __slots__ = ("made", "rest", "sources", "tasks")

    def __init__(self, tasks: list[str | None], sources: list[str]):
        self.kind, self.inline, self.attrs = "UnorderedList", None, {"tight": True}
        self.tasks, self.sources = tasks, sources
        self.rest: list[Block] = []
        self.made: list[Block] | None = None

    @property
    def size(self) -> int:
        """How many items and paragraphs are not made."""
        return 2 * len(self.tasks)

    def add(self, block: Block) -> None:
        (self.rest if self.made is None else self.made).append(block)

    def make(self, parser: Parser | None, marks: re.Pattern | None = None) -> list[Block]:
        """Make the items, with inline content if there is a parser (and only of sources with a mark, if marks are sought)."""
        if self.made is None:
            items = []
            for task, source in zip(self.tasks, self.sources, strict=True):
                seen = parser is not None and (marks is None or marks.search(source) is not None)
                items.append(Block("ListItem", [Block("Paragraph", None, parser.lines([source]) if seen else None)], task=task))
            self.made = items + self.rest
        return self.made

    @property
    def children(self) -> list[Block]:
        return self.make(None)


def is_quiet(text: str) -> bool:
    """Whether a cell's source is text throughout."""
    return text.isalnum() or QUIET.search(text) is None


# ------------------------------------------------------------------ the document
class Leaf:
    """The open block that takes text: its kind, the lines so far, and what a kind remembers."""

    __slots__ = ("block", "indent", "kind", "lines", "mark")

    def __init__(self, kind: str, block: Block | None = None, mark=None, indent: int = 0):
        self.kind, self.block, self.mark, self.indent = kind, block, mark, indent
        self.lines: list = []


class Container:
    """An open quote, list item or footnote (or the document): the block, and how a line shows that it belongs."""

    __slots__ = ("block", "fresh", "kind", "list", "outer", "quotes", "width")

    def __init__(self, kind: str, block: Block, width: int = 0, quotes: int = 0, outer: ListState | None = None):
        self.kind, self.block, self.width, self.quotes = kind, block, width, quotes
        self.outer = outer  # of an item, the list it is in
        self.list: ListState | None = None  # the list that a further item may join
        self.fresh = True  # nothing but its marker so far


class ListState:
    __slots__ = ("block", "marker")

    def __init__(self, block: Block, marker: lx.Marker):
        self.block, self.marker = block, marker


class Document:
    """The result of a parse: blocks, definitions in order, footnotes.

    Lines are read one by one against the stack of open containers: each container takes its own
    marker or indent off the line, or refuses the line; what is left may open further containers,
    start or continue a leaf, or continue the paragraph of a container that refused it. Inline text
    waits in document order until all definitions are known.
    """

    def __init__(self, text: str, options: Options, inline: frozenset[str] | None = None, marks: re.Pattern | None = None):
        self.options = options
        self.gfm = options.dialect == "gfm"
        self.text = text
        self.refs = Refs()
        self.blocks: list[Block] = []
        self._defined: dict[str, list[Definition]] = {"top": [], "container": []}
        self._waiting: list[tuple[Block, str, list[str] | str]] = []
        self._read()
        self.definitions = self._defined["top"] + self._defined["container"]
        for d in self.definitions:
            self.refs.links.setdefault(lx.label_key(d.label), d)
        self.inline = Parser(self.refs, options.dialect, options.max_inline_depth)
        skips = inline is not None and not self.refs.notes
        seeks = marks is not None and not self.refs.notes
        for block, how, source in self._waiting:
            if how == "table":
                block.parser = None if skips and "TableCell" not in inline else self.inline
                if self.refs.notes:
                    _ = block.children
                continue
            if how == "items":
                if not skips or "Paragraph" in inline:
                    block.make(self.inline, marks if seeks else None)
                continue
            if skips and block.kind not in inline:
                continue
            if seeks and (marks.search(source) is None if how == "plain" else not any(marks.search(x) for x in source)):
                continue
            if how == "lines":
                block.inline = self.inline.lines(source)
            elif how == "paragraph":
                block.inline = self.inline.paragraph("\n".join(source))
            else:
                block.inline = self.inline.plain(source)
        for b in self.blocks:
            if b.kind == "FootnoteDefinition":
                note = b.attrs.pop("note")
                b.attrs |= {"number": note["number"], "references": note["references"]}

    # -------------------------------------------------------------- lines
    def _read(self) -> None:
        text = self.text
        self.lines = text.split("\n")
        if self.lines[-1] == "":
            self.lines.pop()
        self.starts: list[int] | None = None
        root = Block("Document")
        root.children = self.blocks
        self.open: list[Container] = []
        self.root = Container("document", root)
        self.leaf: Leaf | None = None
        self.gap: int | None = None  # quotes around the blank line just before, if there was one
        self.at = 0
        lines, n = self.lines, len(self.lines)
        bar = "|" if self.gfm else "\n"
        shallow = self.options.max_block_depth > 1
        while self.at < n:
            line = lines[self.at]
            leaf = self.leaf
            top = not self.open and (leaf is None or leaf.kind == "paragraph")
            if top and line[:1].isalpha() and bar not in line and (leaf is None or leaf.lines):
                if leaf is None:
                    self._text(None, line, 0, True, 0)
                    self.gap = None
                else:
                    leaf.lines.append(line)  # nothing starts with a letter but a table
                self.at += 1
            elif top and not line:
                self.leaf, self.gap = None, 0
                self.at += 1
            elif top and shallow and line[0] == "#" and bar not in line and (head := lx.atx(line)) is not None:
                self._heading(*head)
                self.gap = None
                self.at += 1
            elif top and shallow and line[0] == bar and (after := self._table(line)) is not None:
                self.gap = None
                self.at = after
            elif (leaf is None or leaf.kind == "paragraph") and shallow and (m := _PLAIN_ITEM.match(line)) is not None and (self.gfm or m[2] is None):
                self.at = self._plain_item(m, line)
            else:
                self.at = self._line(line)
        self._end_leaf(True)

    def _heading(self, level: int, source: str) -> None:
        block = Block("Heading", level=level)
        self._place().block.children.append(block)
        self._waiting.append((block, "plain", source))

    def _plain_item(self, m: re.Match, line: str) -> int:
        """What ``_line`` does with a bullet at the margin, perhaps a task, and text that begins with a letter: no container takes the line, and it opens nothing else.

        If it begins a list, the items of this kind that follow are read with it. Returns the next line.
        """
        self.leaf = None
        self.open.clear()
        root = self.root
        state = root.list
        if state is not None and state.marker.sign == m[1] and state.marker.number is None:
            if self.gap == 0:
                state.block.attrs["tight"] = False
        else:
            self._place()
            found = PlainList([], [])
            root.block.children.append(found)
            self._waiting.append((found, "items", ""))
            m = self._plain_items(found, m)
            self.gap = None
            if m is None:
                return self.at
            line = m.string
            root.list = state = ListState(found, lx.marker(line))
        root.fresh = False
        para = Leaf("paragraph", Block("Paragraph"))
        item = Container("item", Block("ListItem", [para.block], task=_TASKS[m[2]]), 2, 0, state)
        item.fresh = False
        state.block.add(item.block)
        self.open.append(item)
        self.gap = None
        self.leaf = para
        para.lines.append(line[m.end() :].strip(lx.TRIM))
        self._waiting.append((para.block, "lines", para.lines))
        return self.at + 1

    def _plain_items(self, found: PlainList, m: re.Match | None) -> re.Match | None:
        """Read items from ``m`` on, up to the last one of a run, which is left open and returned; the end of the document leaves none."""
        lines, at, n = self.lines, self.at, len(self.lines)
        match, gfm, sign, trim = _PLAIN_ITEM.match, self.gfm, m[1], lx.TRIM
        tasks, sources = found.tasks, found.sources
        while m is not None:
            after = None
            if at + 1 < n and ((after := match(lines[at + 1])) is None or after[1] != sign or (after[2] is not None and not gfm)):
                break
            tasks.append(_TASKS[m[2]])
            sources.append(m.string[m.end() :].strip(trim))
            m = after
            at += 1
        self.at = at
        return m

    def _line(self, line: str) -> int:
        """Read a line (and what follows it, of blocks that take several lines at once); returns the next one."""
        pos, loose, matched = 0, 0, 0
        blank = lx.is_blank(line)
        for c in self.open:
            if c.kind == "quote":
                first, cols = _indent(line, pos)
                if blank or cols > 3 or line[first] != ">":
                    break
                line, pos, loose = _behind_quote(line, pos, cols)
                blank = lx.BLANK.match(line, pos) is not None
            elif blank:
                if c.fresh and c.kind == "item":
                    break  # an item begins with one blank line at most
                line, pos, loose = _consume(line, pos, c.width)
            else:
                if _indent(line, pos)[1] < c.width:
                    break
                line, pos, loose = _consume(line, pos, c.width)
            matched += 1
        whole = matched == len(self.open)
        leaf = self.leaf
        if leaf is not None and whole and leaf.kind in ("fence", "html", "code") and self._more(leaf, line, pos, loose, blank):
            return self.at + 1
        if blank:
            self._close_to(matched)
            self._end_leaf()
            self.gap = self.open[-1].quotes if self.open else 0
            return self.at + 1
        if leaf is not None and leaf.kind in ("fence", "html") and not whole:
            self._close_to(matched)
        after = self._starts(line, pos, loose, matched)
        self.gap = None
        return after

    def _more(self, leaf: Leaf, line: str, pos: int, loose: int, blank: bool) -> bool:
        """Give a line to code or HTML that is open; False if it ends there without the line."""
        if leaf.kind == "fence":
            first, cols = _indent(line, pos)
            if cols <= 3 and lx.closes(line[first:], leaf.mark):
                self._end_leaf()
            else:
                line, at, loose = _consume(line, pos, min(cols, leaf.indent)) if leaf.indent else (line, pos, loose)
                leaf.lines.append((loose, line[at + loose :]))
            return True
        if leaf.kind == "html":
            if leaf.mark > 5 and blank:
                self._end_leaf()
                self.gap = self.open[-1].quotes if self.open else 0
                return True
            leaf.lines.append((loose, line[pos + loose :]))
            if lx.html_ends(leaf.mark, line[pos:]):
                self._end_leaf()
            return True
        if blank or _indent(line, pos)[1] >= 4:
            self._code_line(leaf, line, pos, loose)
            return True
        return False

    def _code_line(self, leaf: Leaf, line: str, pos: int, loose: int) -> None:
        if leaf.block.kind == "IndentedCode":
            leaf.lines.append(line)
        else:
            line, pos, loose = _consume(line, pos, 4)
            leaf.lines.append((loose, line[pos + loose :]))

    # -------------------------------------------------------------- what a line starts
    def _starts(self, line: str, pos: int, loose: int, matched: int) -> int:
        """Open what the rest of a line opens, and give what is left to a paragraph."""
        while True:
            whole = matched == len(self.open)
            para = self.leaf if self.leaf is not None and self.leaf.kind == "paragraph" else None
            within = para is not None and bool(para.lines)
            if lx.BLANK.match(line, pos):  # nothing behind a marker
                self._close_to(matched)
                return self.at + 1
            first, cols = _indent(line, pos)
            if cols > 3:
                if within or (para is not None and not whole):
                    return self._continue(para, line, pos, whole)
                self._close_to(matched)
                where = self._place()
                self.leaf = Leaf("code", Block("CodeLines", info=None) if self.open else Block("IndentedCode"))
                where.block.children.append(self.leaf.block)
                self._code_line(self.leaf, line, pos, loose)
                return self.at + 1
            if matched >= self.options.max_block_depth:
                return self._text(para, line, pos, whole, matched)
            here = self.open[matched - 1] if matched else self.root
            if self.gfm and here.fresh and here.kind == "item" and not loose and (m := lx.TASK.match(line, pos)):
                here.block.attrs["task"] = "unchecked" if m[1] == " " else "checked"
                here.fresh = False
                pos = m.end()
                continue
            body = line[first:]
            c = body[0]
            if c in "`~" and (mark := lx.fence(body)):
                self._close_to(matched)
                self._leaf_block("fence", mark, cols, info=body[mark[1] :].strip(lx.WS) or None)
                return self.at + 1
            if c == "<" and (kind := lx.html_start(body, within)):
                self._close_to(matched)
                leaf = self._leaf_block("html", kind, 0)
                leaf.lines.append((loose, line[pos + loose :]))
                if lx.html_ends(kind, body):
                    self._end_leaf()
                return self.at + 1
            if c == "[":
                if not matched and self.gfm and not (within and whole) and (m := lx.FOOTNOTE_DEF.match(body)):
                    self._close_to(0)
                    note = {"number": 0, "references": 0}
                    self.refs.notes[lx.label_key(m[1])] = note  # the last definition of a label counts
                    self._enter("note", Block("FootnoteDefinition", label=m[1], note=note), 4)
                    line, pos, loose, matched = " " * (first + m.end()) + body[m.end() :], first + m.end(), 0, 1
                    continue
                if not within and (after := self._definition(body, first, matched)) is not None:
                    return after
            if within and whole and c in "=-" and (level := lx.setext(body)):
                return self._underline(para, level)
            if c in "-*_" and lx.is_rule(body):
                self._close_to(matched)
                self._place().block.children.append(Block("HorizontalRule"))
                return self.at + 1
            if (c in "-+*" or c.isdigit()) and (m := lx.marker(body)):
                # A paragraph at top level gives way only to items with content, and to the number one.
                if not within or self.open or (body[m.width :].strip(lx.WS) and m.number in (None, 1)):
                    self._close_to(matched)
                    line, pos, loose = self._item(m, line, pos, cols)
                    matched = len(self.open)
                    continue
            if not matched and self.gfm and "|" in body and (after := self._table(body)) is not None:
                return after
            if c == "#" and (head := lx.atx(body)):
                self._close_to(matched)
                self._heading(*head)
                return self.at + 1
            if c == ">":
                self._close_to(matched)
                line, pos, loose = _behind_quote(line, pos, cols)
                alert = lx.ALERT.match(line, pos) if self.gfm else None
                if alert:
                    self._enter("quote", Block("Alert", alert=alert[1].lower(), title=line[alert.end() :].strip(lx.TRIM) or None))
                    self.leaf = Leaf("paragraph")  # a line without marker still belongs to it
                    return self.at + 1
                self._enter("quote", Block("Blockquote"))
                matched = len(self.open)
                continue
            return self._text(para, line, pos, whole, matched)

    def _text(self, para: Leaf | None, line: str, pos: int, whole: bool, matched: int) -> int:
        if para is not None:
            return self._continue(para, line, pos, whole)
        self._close_to(matched)
        where = self._place()
        self.leaf = para = Leaf("paragraph", Block("Paragraph"))
        where.block.children.append(para.block)
        self._waiting.append((para.block, "lines" if self.open else "paragraph", para.lines))
        return self._continue(para, line, pos, True)

    def _continue(self, para: Leaf, line: str, pos: int, whole: bool) -> int:
        """Add a line to a paragraph, also to one in containers that refused the line."""
        if para.block is None:
            para.block = Block("Paragraph")
            self._place().block.children.append(para.block)
            self._waiting.append((para.block, "lines", para.lines))
            self.leaf = para
        para.lines.append(line[pos:].strip(lx.TRIM) if self.open else line)
        return self.at + 1

    def _underline(self, para: Leaf, level: int) -> int:
        para.block.kind = "Heading"
        para.block.attrs["level"] = level
        if not self.open:
            where = next(k for k in range(len(self._waiting) - 1, -1, -1) if self._waiting[k][0] is para.block)
            self._waiting[where] = (para.block, "plain", "\n".join(para.lines).strip(lx.TRIM))
        self.leaf = None
        return self.at + 1

    def _definition(self, body: str, first: int, matched: int) -> int | None:
        """Take a link definition: of several lines at top level, of one within containers."""
        if self.leaf is not None and self.leaf.kind == "paragraph" and matched < len(self.open):
            return None
        if matched:
            if (found := scan_definition(body, 0)) is None:
                return None
            self._close_to(matched)
            self._place()
            self._defined["container"].append(Definition(*found[:3], "container"))
            return self.at + 1
        if self.starts is None:
            self.starts = [0, *accumulate(len(x) + 1 for x in self.lines)]
        if (found := scan_definition(self.text, self.starts[self.at] + first)) is None:
            return None
        self._close_to(0)
        self._place()
        self._defined["top"].append(Definition(*found[:3], "top"))
        return bisect_left(self.starts, found[3], self.at + 1)

    def _item(self, m: lx.Marker, line: str, pos: int, cols: int) -> tuple[str, int, int]:
        """Open an item, in the list before it if the markers are alike; returns what is behind the marker."""
        parent = self.open[-1] if self.open else self.root
        line, pos, _ = _consume(line, pos, cols)
        behind = pos + m.width
        width = m.content_column(pos, line[behind:]) - behind
        state = parent.list
        if state is not None and state.marker.like(m):
            if self.gap == parent.quotes:
                state.block.attrs["tight"] = False
                if parent.kind == "item":
                    parent.outer.block.attrs["tight"] = False
        else:
            self._place()
            kind = {"tight": True} if m.number is None else {"tight": True, "start": m.number, "delim": m.sign}
            state = ListState(Block("UnorderedList" if m.number is None else "OrderedList", **kind), m)
            parent.block.children.append(state.block)
            parent.list = state
        item = Container("item", Block("ListItem", task=None), cols + m.width + width, parent.quotes, state)
        parent.fresh = False
        state.block.add(item.block)
        self.open.append(item)
        self.gap = None  # the blank line stood before the item, not within it
        return _consume(line, behind, width)

    def _table(self, head: str) -> int | None:
        """A header row whose next line is a delimiter row of as many cells, and the rows below."""
        lines, i = self.lines, self.at
        if i + 1 == len(lines) or not _has_pipe(head):
            return None
        n = lx.indent_of(lines[i + 1])
        align = alignments(lines[i + 1][n:]) if n is not None else None
        if align is None or len(align) != len(split_row(head)):
            return None
        rows, end = [head], i + 2
        while end < len(lines):
            row = lines[end]
            if row[:1] != "|" and (lx.is_blank(row) or (n := lx.indent_of(row)) is None or lx.begins_block(row[n:])):
                break
            rows.append(row)
            end += 1
        self._close_to(0)
        table = Table(rows, align)
        self._place().block.children.append(table)
        self._waiting.append((table, "table", ""))
        return end

    # -------------------------------------------------------------- opening and closing
    def _place(self) -> Container:
        """The innermost container, about to get a child that is no item: a blank line before it loosens its list."""
        self._end_leaf()
        c = self.open[-1] if self.open else self.root
        c.list = None
        if c.kind == "item" and not c.fresh and self.gap == c.quotes:
            c.outer.block.attrs["tight"] = False
        c.fresh = False
        return c

    def _enter(self, kind: str, block: Block, width: int = 0) -> None:
        where = self._place()
        where.block.children.append(block)
        self.open.append(Container(kind, block, width, where.quotes + (kind == "quote")))
        self.gap = None

    def _leaf_block(self, kind: str, mark, indent: int, **attrs) -> Leaf:
        where = self._place()
        if kind == "html":
            block = Block("HtmlLines" if self.open else "HtmlBlock")
        else:
            block = Block("CodeLines" if self.open or indent else "CodeBlock", **attrs)
        where.block.children.append(block)
        self.leaf = Leaf(kind, block, mark, indent)
        return self.leaf

    def _close_to(self, matched: int) -> None:
        """Close the containers that refused the line, and whatever leaf is open."""
        self._end_leaf()
        del self.open[matched:]

    def _end_leaf(self, at_end: bool = False) -> None:
        leaf, self.leaf = self.leaf, None
        if leaf is None or leaf.block is None or leaf.kind == "paragraph":
            return
        kind, attrs = leaf.block.kind, leaf.block.attrs
        if leaf.kind == "code":
            while leaf.lines and (lx.is_blank(leaf.lines[-1]) if kind == "IndentedCode" else leaf.lines[-1][1].strip(lx.WS) == ""):
                leaf.lines.pop()
        if kind in ("CodeLines", "HtmlLines"):
            attrs["lines"] = leaf.lines
        elif kind == "IndentedCode":
            attrs["literal"] = "\n".join(leaf.lines)
        else:
            attrs["literal"] = "\n".join(" " * pad + t for pad, t in leaf.lines)
            if kind == "CodeBlock" and at_end and leaf.lines and self.text.endswith("\n"):
                attrs["literal"] += "\n"  # of a fence that nothing closes, the last line break is content


def _indent(line: str, pos: int) -> tuple[int, int]:
    """(index behind the blanks at ``pos``, columns that they span); all before ``pos`` is one column a character."""
    i, col, n = pos, pos, len(line)
    while i < n:
        c = line[i]
        if c == " ":
            col += 1
        elif c == "\t":
            col += 4 - col % 4
        else:
            break
        i += 1
    return i, col - pos


def _consume(line: str, pos: int, width: int) -> tuple[str, int, int]:
    """(line, index, blanks left of a tab) ``width`` columns of blanks further; tabs on the way become blanks.

    A line with fewer blanks is taken to their end.
    """
    target, left = pos + width, 0
    while pos < target and pos < len(line):
        c = line[pos]
        if c == "\t":
            wide = 4 - pos % 4
            line = line[:pos] + " " * wide + line[pos + 1 :]
            left = max(0, pos + wide - target)
            pos = min(target, pos + wide)
        elif c == " ":
            pos += 1
        else:
            break
    return line, pos, left


def _behind_quote(line: str, pos: int, cols: int) -> tuple[str, int, int]:
    line, pos, _ = _consume(line, pos, cols)
    return _consume(line, pos + 1, 1)


def _has_pipe(row: str) -> bool:
    return "|" in row and ("\\" not in row or re.search(r"(?<!\\)(?:\\\\)*\|", row) is not None)


def parse(text: str, options: Options | None = None, inline: frozenset[str] | None = None, marks: re.Pattern | None = None) -> Document:
    """Parse a document whose lines end in \\n (see ``functions.native.normalize`` for others).

    ``inline``: kinds of blocks whose inline content is wanted, all by default. Others have None, but in
    a document with footnotes, whose numbers depend on all text before. ``marks``: a character that the
    source of wanted inline content has.
    """
    return Document(text, options or Options(), inline, marks)
