"""Trees to rows: nodes in document order, each with its parent and the size of its subtree."""

from __future__ import annotations

import re

from folio.kernel import lexer as lx
from folio.kernel.block import Block, Document, PlainList, is_quiet
from folio.kernel.inline import Inline, Parser


class Nodes:
    """The blocks of a document in pre-order. A table whose rows, or a list whose plain items, are not made is one entry: their ids are counted."""

    __slots__ = ("entries",)

    def __init__(self, doc: Document):
        self.entries: list[list] = []  # id, parent, ordinal, depth, size, block
        self._add(doc.blocks, None, 0, 0)

    def _add(self, blocks: list[Block], parent: int | None, depth: int, node: int, first: int = 0) -> int:
        """Add blocks, numbered from ``first``, and all that they hold, from the id ``node``; returns the next id."""
        add = self.entries.append
        for k, b in enumerate(blocks, first):
            entry = [node, parent, k, depth, 0, b]
            add(entry)
            after = node + 1
            if b.kind == "Table" and b.made is None:
                after += b.size
                entry[4] = after - node - 1
            elif is_raw_list(b):
                after += b.size
                if b.rest:
                    after = self._add(b.rest, node, depth + 1, after, len(b.tasks))
                entry[4] = after - node - 1
            elif b.children:
                after = self._add(b.children, node, depth + 1, after)
                entry[4] = after - node - 1
            node = after
        return node


def is_raw(b: Block) -> bool:
    """Whether a block is a table whose rows are not made."""
    return b.kind == "Table" and b.made is None


def is_raw_list(b: Block) -> bool:
    """Whether a block is a list whose plain items are not made."""
    return type(b) is PlainList and b.made is None


def cell_text(source: str, parser: Parser) -> str:
    """The plain text of a cell."""
    return source if source.isalnum() else lx.decode_entities(source) if is_quiet(source) else text_of(parser.plain(source))


#: Columns of a block that are attributes of the same, or another, name.
ATTRIBUTES = {
    "level": "level", "list_start": "start", "list_delim": "delim", "tight": "tight", "task": "task", "alert_kind": "alert", "alert_title": "title", "info": "info", "literal": "literal", "code_lines": "lines",
    "columns": "columns", "header": "header", "align": "align", "fn_label": "label", "fn_number": "number", "fn_references": "references",
}
_KEYS = tuple(ATTRIBUTES.values())


_BARE = (None,) * len(_KEYS)


def _tail(**attrs) -> tuple:
    return tuple(attrs.get(k) for k in _KEYS)


_HEADS, _ROWS = _tail(header=True), _tail(header=False)
_TASKS = {t: _tail(task=t) for t in (None, "unchecked", "checked")}
_CELLS = {a: _tail(align=a) for a in ("none", "left", "center", "right")}


def block_tuples(nodes: Nodes, only: frozenset[str] | None = None, more: bool = False) -> list[tuple]:
    """Rows without the document's id, in the order of ``operators.relations.BLOCKS``, with ``more`` also of MORE."""
    out = []
    above: dict[int, list[dict]] = {}
    kinds: dict[int, str] = {}
    for n, up, ordinal, depth, size, b in nodes.entries:
        kind = b.kind
        if more:
            kinds[n] = kind
            above[n] = [] if up is None else [*above[up], {"node_id": up, "kind": kinds[up]}]
        if only is None or kind in only:
            a = b.attrs
            if a:
                values = [a.get(k) for k in _KEYS]
                if values[9] is not None:
                    values[9] = [{"pad": p, "text": t} for p, t in values[9]]
            else:
                values = _BARE
            row = (n, up, ordinal, depth, size, kind, *values)
            out.append((*row, above[n], text_of(b.inline) if b.inline is not None else None) if more else row)
        if kind == "Table" and b.made is None and (only is None or "TableRow" in only or "TableCell" in only):
            out += _table_tuples(b, n, depth, only, above[n] if more else None)
        elif kind == "UnorderedList" and is_raw_list(b):
            out += _list_tuples(b, n, depth, only, above[n] if more else None)
    return out


def _list_tuples(found: PlainList, node: int, depth: int, only: frozenset[str] | None, above: list[dict] | None) -> list[tuple]:
    """The plain items of a list that are not made, as ``block_tuples`` gives them."""
    out = []
    with_items, with_paragraphs = only is None or "ListItem" in only, only is None or "Paragraph" in only
    if not with_items and not with_paragraphs:
        return out
    for k, task in enumerate(found.tasks):
        at = node + 1 + 2 * k
        if with_items:
            row = (at, node, k, depth + 1, 1, "ListItem", *_TASKS[task])
            out.append(row if above is None else (*row, [*above, {"node_id": node, "kind": "UnorderedList"}], None))
        if with_paragraphs:
            row = (at + 1, at, 0, depth + 2, 0, "Paragraph", *_BARE)
            out.append(row if above is None else (*row, [*above, {"node_id": node, "kind": "UnorderedList"}, {"node_id": at, "kind": "ListItem"}], None))
    return out


def _table_tuples(table, node: int, depth: int, only: frozenset[str] | None, above: list[dict] | None) -> list[tuple]:
    """The rows and cells of a table that is not made, as ``block_tuples`` gives them."""
    out = []
    width = len(table.aligns)
    with_rows, with_cells = only is None or "TableRow" in only, only is None or "TableCell" in only
    tails = [_CELLS[a] for a in table.aligns]
    texts = table.cells() if above is not None else None
    at = node + 1
    for r in range(len(table.rows)):
        if with_rows:
            row = (at, node, r, depth + 1, width, "TableRow", *(_ROWS if r else _HEADS))
            out.append(row if above is None else (*row, [*above, {"node_id": node, "kind": "Table"}], None))
        if with_cells and above is None:
            out += [(at + 1 + k, at, k, depth + 2, 0, "TableCell", *tail) for k, tail in enumerate(tails)]
        elif above is not None:
            up = [*above, {"node_id": node, "kind": "Table"}, {"node_id": at, "kind": "TableRow"}]
            cells = next(texts)
            if with_cells:
                out += [(at + 1 + k, at, k, depth + 2, 0, "TableCell", *tail, up, cell_text(cells[k], table.parser)) for k, tail in enumerate(tails)]
        at += 1 + width
    return out


def shape_of(nodes: Nodes) -> str:
    """The kinds and depths of all blocks in pre-order."""
    out = []
    for _, _, _, depth, _, b in nodes.entries:
        out.append(f"{b.kind}{depth}")
        if is_raw(b):
            out += [f"TableRow{depth + 1}", *[f"TableCell{depth + 2}"] * len(b.aligns)] * len(b.rows)
        elif is_raw_list(b):
            out += [f"ListItem{depth + 1}", f"Paragraph{depth + 2}"] * len(b.tasks)
    return ",".join(out)


def task_counts(doc: Document) -> tuple[int, int]:
    """How many task items a document has, and how many of them are ticked."""
    tasks = checked = 0
    stack = list(doc.blocks)
    while stack:
        b = stack.pop()
        if b.kind == "Table":
            continue
        if is_raw_list(b):
            tasks += len(b.tasks) - b.tasks.count(None)
            checked += b.tasks.count("checked")
            stack += b.rest
            continue
        if b.kind == "ListItem" and (task := b.attrs["task"]) is not None:
            tasks += 1
            checked += task == "checked"
        stack += b.children
    return tasks, checked


def item_tuples(nodes: Nodes, only: frozenset[str] | None = None) -> list[tuple]:
    """Rows of ``operators.relations.ITEMS``: list items, and the rows of tables with their cells' texts."""
    out = []
    items, heads, rows = (only is None or k in only for k in ("ListItem", "TableHead", "TableRow"))
    for n, _, _, _, _, b in nodes.entries:
        if b.kind == "ListItem" and items:
            out.append((n, "ListItem", b.attrs["task"], None, None, None, None))
        elif b.kind == "UnorderedList" and items and is_raw_list(b):
            out += [(n + 1 + 2 * k, "ListItem", task, None, None, None, None) for k, task in enumerate(b.tasks)]
        elif b.kind == "Table" and (heads or rows):
            aligns, width = list(b.aligns), 1 + len(b.aligns)
            if b.made is None:
                parser, tidy = b.parser, rows and b.tidy
                for r, cells in enumerate(b.cells(tidy)):
                    if rows if r else heads:
                        out.append((n + 1 + r * width, "TableRow" if r else "TableHead", None, n, r, cells if tidy else [cell_text(c, parser) for c in cells], aligns))
                    elif not rows:
                        break
            else:
                for r, row in enumerate(b.made):
                    if rows if r else heads:
                        out.append((n + 1 + r * width, "TableRow" if r else "TableHead", None, n, r, [text_of(c.inline) for c in row.children], aligns))
    return out


def block_rows(doc: Document) -> list[tuple[Block, dict]]:
    """(block, row by column) in pre-order."""
    nodes = Nodes(doc)
    names = ("node_id", "parent_id", "ordinal", "depth", "subtree_len", "kind", *ATTRIBUTES)
    for *_, b in nodes.entries:
        if is_raw(b) or is_raw_list(b):
            _ = b.children  # made: each row names its block
    nodes = Nodes(doc)
    return [(e[5], dict(zip(names, r, strict=True))) for e, r in zip(nodes.entries, block_tuples(nodes), strict=True)]


def text_of(inline: list[Inline]) -> str:
    """The plain text of inline content: texts, code and addresses; breaks as blanks."""
    out: list[str] = []
    stack = inline[::-1]
    while stack:
        x = stack.pop()
        kind = x.kind
        if kind == "Text":
            out.append(lx.decode_entities(x.text))
        elif kind in ("Code", "Autolink"):
            out.append(x.text)
        elif kind in ("SoftBreak", "HardBreak"):
            out.append(" ")
        elif x.children:
            stack.extend(x.children[::-1])
    return "".join(out)


def text_tuples(nodes: Nodes, only: frozenset[str] | None = None) -> list[tuple]:
    """Rows of ``operators.relations.TEXTS``: leaves with their text, list items, cells with their place."""
    out = []
    place: dict[int, tuple[int, int]] = {}  # of rows that are made: table and number
    cells = only is None or "TableCell" in only
    for n, up, ordinal, _, _, b in nodes.entries:
        kind = b.kind
        if kind == "TableRow":
            place[n] = (up, ordinal)
        elif kind == "Table" and b.made is None and cells:
            at = n + 1
            for r, row in enumerate(b.cells()):
                out += [(at + 1 + k, at, "TableCell", None, None, n, r, k, b.aligns[k], cell_text(c, b.parser)) for k, c in enumerate(row)]
                at += 1 + len(row)
        elif is_raw_list(b) and (only is None or "ListItem" in only):
            out += [(n + 1 + 2 * k, n, "ListItem", None, task, *(None,) * 5) for k, task in enumerate(b.tasks)]
        if (b.inline is None and kind != "ListItem") or (only is not None and kind not in only):
            continue
        table, row, col = (*place[up], ordinal) if kind == "TableCell" else (None, None, None)
        a = b.attrs
        out.append((n, up, kind, a.get("level"), a.get("task"), table, row, col, a.get("align"), text_of(b.inline) if b.inline else "" if b.inline is not None else None))
    return out


#: Columns of inline content, but for the document's id.
INLINE_COLUMNS = ("node_id", "inline_id", "parent_inline_id", "ordinal", "depth", "subtree_len", "kind", "text", "url", "title", "autolink_kind", "fn_label", "fn_number", "fn_occurrence", "content")


def inline_tuples(nodes: Nodes, only: frozenset[str] | None = None, under: frozenset[str] | None = None, marks: re.Pattern | None = None) -> list[tuple]:
    """Rows of a document's inline content in the order of INLINE_COLUMNS; ``under``: only what such a node directly holds.

    ``marks``: as in ``block.parse``; then of rows only kind and text count, and without footnotes nothing else is made.
    """
    out: list[tuple] = []
    if marks is not None:
        for *_, b in nodes.entries:
            if b.inline:
                _held(b.inline, only, under, out)
            elif is_raw(b) and any(marks.search(row) for row in b.rows):
                for row in b.cells():
                    for source in row:
                        if marks.search(source):
                            _held(b.parser.plain(source), only, under, out)
        return out
    n = 0
    texts = under is None and (only is None or "Text" in only)
    for node, _, _, _, _, b in nodes.entries:
        if b.inline:
            n += _inline_tuples(b.inline, node, n, only, under, out)
        elif is_raw(b):
            at = node + 1
            for row in b.cells():
                for k, source in enumerate(row):
                    if not source:
                        continue
                    if is_quiet(source):
                        if texts:
                            out.append((at + 1 + k, n, None, 0, 0, 0, "Text", lx.decode_entities(source), *(None,) * 7))
                        n += 1
                    else:
                        n += _inline_tuples(b.parser.plain(source), at + 1 + k, n, only, under, out)
                at += 1 + len(row)
    return out


def _held(nodes: list[Inline], only: frozenset[str] | None, under: frozenset[str], out: list[tuple]) -> None:
    """Add kind and text of what nodes of the kinds ``under`` directly hold, at any depth."""
    stack = [x for x in reversed(nodes) if x.children]
    while stack:
        x = stack.pop()
        if x.kind in under:
            for c in _joined(x.children):
                if only is None or c.kind in only:
                    out.append((*(None,) * 6, c.kind, c.text if c.kind in ("Text", "Code", "RawHtml", "Autolink") else None, *(None,) * 7))
        stack.extend(c for c in reversed(x.children) if c.children)


def _inline_tuples(nodes: list[Inline], node_id: int, first: int, only: frozenset[str] | None, under: frozenset[str] | None, out: list[tuple]) -> int:
    """Add the rows of a block's inline content in pre-order, and return how many there are with those left out; texts are decoded, then neighbours joined."""
    flat = True
    for x in nodes:
        if x.children:
            flat = False
            break
    if flat and under is not None:
        return len(nodes) if len(nodes) < 2 else len(_joined(nodes))
    rows: list[list] = []
    parents: list[str | None] = []
    # Entries: (node, parent, ordinal, depth, kind of the parent) to open, or an int: the row whose subtree ends.
    stack: list = [(x, None, k, 0, None) for k, x in reversed(list(enumerate(_joined(nodes))))]
    while stack:
        top = stack.pop()
        if isinstance(top, int):
            rows[top - first][5] = first + len(rows) - top - 1
            continue
        x, parent, ordinal, depth, holder = top
        at = first + len(rows)
        kind = x.kind
        note = x.extra if kind == "FootnoteRef" else (None, None, None)
        rows.append(
            [
                node_id, at, parent, ordinal, depth, 0, kind, x.text if kind in ("Text", "Code", "RawHtml", "Autolink") else None, x.url, x.title,
                x.extra if kind == "Autolink" else None, note[0], note[1], note[2], text_of(x.children or []) if kind in ("Link", "Image") else None,
            ]
        )
        parents.append(holder)
        if x.children:
            stack.append(at)
            stack.extend((c, at, k, depth + 1, kind) for k, c in reversed(list(enumerate(_joined(x.children)))))
    out += [tuple(r) for r, p in zip(rows, parents, strict=True) if (only is None or r[6] in only) and (under is None or p in under)]
    return len(rows)


def inline_rows(nodes: list[Inline], node_id: int, first: int = 0) -> list[dict]:
    """Rows of a block's inline content by column."""
    out: list[tuple] = []
    _inline_tuples(nodes, node_id, first, None, None, out)
    return [dict(zip(INLINE_COLUMNS, r, strict=True)) for r in out]


def _joined(nodes: list[Inline]) -> list[Inline]:
    out: list[Inline] = []
    for x in nodes:
        if x.kind != "Text":
            out.append(x)
            continue
        text = lx.decode_entities(x.text)
        if out and out[-1].kind == "Text":
            out[-1] = Inline("Text", out[-1].text + text)
        else:
            out.append(Inline("Text", text))
    return out


def definition_rows(doc: Document) -> list[dict]:
    return [{"def_order": k, "label": d.label, "label_norm": lx.label_key(d.label), "url": d.url, "title": d.title, "scope": d.scope} for k, d in enumerate(doc.definitions)]
