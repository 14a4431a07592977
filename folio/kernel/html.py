"""Rendering: a parsed document to HTML, and the escapes it uses."""

from __future__ import annotations

import re
from urllib.parse import quote

from folio.kernel import lexer as lx
from folio.kernel.block import Block, Document, Table, is_quiet
from folio.kernel.inline import QUIET, Inline

#: What a URL keeps unescaped beside letters and digits.
HREF_SAFE = "!#$%&'()*+,-./:;=?@_~"
NOTE_SAFE = "-_.+!*(),#@?=;:/$~"
SCHEMES = {"uri": "", "email": "mailto:", "www": "http://"}
_ENCLOSING = {"Bold": "strong", "Italic": "em", "Strikethrough": "del"}


_SPECIAL = re.compile(r'[&<>"]')


#: What keeps a row of a table from being text that needs no escape.
_MARKED = re.compile(QUIET.pattern + '|[&>"]')


def escape(text: str) -> str:
    if _SPECIAL.search(text) is None:
        return text
    return text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace('"', "&quot;")


def escape_text(text: str) -> str:
    return escape(lx.decode_entities(text))


def code_span(text: str) -> str:
    text = text.replace("\n", " ")
    if len(text) > 1 and text[0] == text[-1] == " " and text.strip(" "):
        text = text[1:-1]
    return escape(text)


def href(url: str) -> str:
    return link_target(lx.unescape(url))


def link_target(url: str) -> str:
    """Percent-encode what a URL may not hold; nothing is unescaped or decoded."""
    return quote(url, safe=HREF_SAFE, errors="surrogatepass").replace("&", "&amp;")


def title(text: str) -> str:
    return escape(lx.unescape(text))


def note_id(label: str) -> str:
    out, i = [], 0
    while i < len(label):
        c = label[i]
        if c == "%" and len(label) > i + 2 and all(x in "0123456789abcdefABCDEF" for x in label[i + 1 : i + 3]):
            out.append(label[i : i + 3])
            i += 3
            continue
        out.append("&amp;" if c == "&" else "&#x27;" if c == "'" else quote(c, safe=NOTE_SAFE))
        i += 1
    return "".join(out)


def filter_tags(html: str) -> str:
    return lx.FILTERED.sub("&lt;", html)


def strip_indent(line: str) -> str:
    return line[lx.at_column(line, 4)[0] :]


class Renderer:
    def __init__(self, doc: Document):
        self.doc, self.gfm = doc, doc.gfm
        self.out: list[str] = []

    def render(self) -> str:
        for b in self.doc.blocks:
            self.block(b)
        notes = sorted((b for b in self.doc.blocks if b.kind == "FootnoteDefinition" and b.attrs["number"]), key=lambda b: b.attrs["number"])
        if notes:
            self.out.append('<section class="footnotes" data-footnotes>\n<ol>\n')
            for b in notes:
                self.note(b)
            self.out.append("</ol>\n</section>\n")
        return "".join(self.out)

    def fresh_line(self) -> None:
        for last in reversed(self.out):
            if last:
                if last[-1] != "\n":
                    self.out.append("\n")
                return

    def block(self, b: Block) -> None:
        kind, put = b.kind, self.out.append
        if kind == "Paragraph":
            put("<p>")
            self.inlines(b.inline)
            put("</p>\n")
        elif kind == "Heading":
            put(f"<h{b.attrs['level']}>")
            self.inlines(b.inline)
            put(f"</h{b.attrs['level']}>\n")
        elif kind in ("UnorderedList", "OrderedList"):
            start = b.attrs.get("start", 1)
            put("<ul>\n" if kind == "UnorderedList" else "<ol>\n" if start == 1 else f'<ol start="{start}">\n')
            for item in b.children:
                self.item(item, b.attrs["tight"])
            put("</ul>\n" if kind == "UnorderedList" else "</ol>\n")
        elif kind == "Blockquote":
            put("<blockquote>\n")
            for x in b.children:
                self.block(x)
            put("</blockquote>\n")
        elif kind == "Alert":
            name = b.attrs["alert"]
            shown = title(b.attrs["title"]) if b.attrs["title"] else name.capitalize()
            put(f'<div class="markdown-alert markdown-alert-{name}">\n<p class="markdown-alert-title">{shown}</p>\n')
            for x in b.children:
                self.block(x)
            put("</div>\n")
        elif kind == "CodeBlock":
            code = b.attrs["literal"]
            put(self.code_tag(b.attrs["info"]) + escape(code) + ("\n" if code and not code.endswith("\n") else "") + "</code></pre>\n")
        elif kind == "CodeLines":
            put(self.code_tag(b.attrs["info"]) + "".join(" " * pad + escape(t) + "\n" for pad, t in b.attrs["lines"]) + "</code></pre>\n")
        elif kind == "IndentedCode":
            put("<pre><code>" + "\n".join(escape(strip_indent(x)) for x in b.attrs["literal"].split("\n")) + "\n</code></pre>\n")
        elif kind == "HtmlBlock":
            put((filter_tags(b.attrs["literal"]) if self.gfm else b.attrs["literal"]) + "\n")
        elif kind == "HtmlLines":
            put("\n".join(" " * pad + (filter_tags(t) if self.gfm else t) for pad, t in b.attrs["lines"]) + "\n")
        elif kind == "HorizontalRule":
            put("<hr />\n")
        elif kind == "Table":
            if b.made is None:
                self.table(b)
                return
            put("<table>\n<thead>\n")
            self.row(b.children[0])
            put("</thead>\n")
            if len(b.children) > 1:
                put("<tbody>\n")
                for r in b.children[1:]:
                    self.row(r)
                put("</tbody>\n")
            put("</table>\n")

    @staticmethod
    def code_tag(info: str | None) -> str:
        words = (info or "").split()
        return f'<pre><code class="language-{title(words[0])}">' if words else "<pre><code>"

    def row(self, r: Block) -> None:
        tag = "th" if r.attrs["header"] else "td"
        self.out.append("<tr>\n")
        for c in r.children:
            a = c.attrs["align"]
            self.out.append(f"<{tag}>" if a == "none" else f'<{tag} align="{a}">')
            self.inlines(c.inline, cell=True)
            self.out.append(f"</{tag}>\n")
        self.out.append("</tr>\n")

    def table(self, b: Table) -> None:
        """A table whose cells are not made: most are text."""
        put, parser = self.out.append, b.parser
        tags = [[f"<{tag}>" if a == "none" else f'<{tag} align="{a}">' for a in b.aligns] for tag in ("th", "td")]
        plain = "<tr>\n" + "".join(f"{t}%s</td>\n" for t in tags[1]) + "</tr>\n"
        put("<table>\n<thead>\n")
        for r, (line, cells) in enumerate(zip(b.rows, b.cells(), strict=True)):
            if r and _MARKED.search(line) is None:
                put(plain % tuple(cells))
                continue
            end = "</td>\n" if r else "</th>\n"
            put("<tr>\n")
            for open_tag, source in zip(tags[r > 0], cells, strict=True):
                put(open_tag)
                if is_quiet(source):
                    put(escape_text(source))
                else:
                    self.inlines(parser.plain(source), cell=True)
                put(end)
            put("</tr>\n" if r else "</tr>\n</thead>\n")
            if not r and len(b.rows) > 1:
                put("<tbody>\n")
        put("</tbody>\n</table>\n" if len(b.rows) > 1 else "</table>\n")

    def item(self, b: Block, tight: bool) -> None:
        self.out.append("<li>")
        if b.attrs["task"]:
            self.out.append('<input type="checkbox" ' + ('checked="" ' if b.attrs["task"] == "checked" else "") + 'disabled="" /> ')
        for x in b.children:
            if tight and x.kind == "Paragraph":
                self.inlines(x.inline)
            else:
                self.fresh_line()
                self.block(x)
        self.out.append("</li>\n")

    def note(self, b: Block) -> None:
        label, number, uses = b.attrs["label"], b.attrs["number"], b.attrs["references"]
        back = []
        for k in range(1, uses + 1):
            suffix = f"-{k}" if k > 1 else ""
            mark = f'<sup class="footnote-ref">{k}</sup>' if k > 1 else ""
            back.append(f'<a href="#fnref-{note_id(label)}{suffix}" class="footnote-backref" data-footnote-backref data-footnote-backref-idx="{number}{suffix}" aria-label="Back to reference {number}{suffix}">↩{mark}</a>')
        self.out.append(f'<li id="fn-{note_id(label)}">')
        for k, x in enumerate(b.children):
            self.fresh_line()
            if k + 1 == len(b.children) and x.kind == "Paragraph":
                self.out.append("<p>")
                self.inlines(x.inline)
                self.out.append(" " + " ".join(back) + "</p>\n")
                back = None
            else:
                self.block(x)
        if back is not None:
            self.fresh_line()
            self.out.append(" ".join(back) + "\n")
        self.out.append("</li>\n")

    def inlines(self, nodes: list[Inline], cell: bool = False) -> None:
        """Render nodes with a stack of their own: emphasis may nest deeper than Python's recursion."""
        put = self.out.append
        if len(nodes) == 1 and nodes[0].kind == "Text":
            put(escape_text(nodes[0].text))
            return
        stack: list = list(reversed(nodes))
        while stack:
            x = stack.pop()
            if isinstance(x, str):
                put(x)
                continue
            kind = x.kind
            if kind == "Text":
                put(escape_text(x.text))
            elif kind in _ENCLOSING:
                put(f"<{_ENCLOSING[kind]}>")
                stack.append(f"</{_ENCLOSING[kind]}>")
                stack.extend(reversed(x.children))
            elif kind == "SoftBreak":
                put("\n")
            elif kind == "HardBreak":
                put("<br />\n")
            elif kind == "Code":
                put(f"<code>{code_span(x.text.replace('\\|', '|') if cell else x.text)}</code>")
            elif kind == "RawHtml":
                html = x.text.replace("\\|", "|") if cell else x.text
                put("&lt;" + html[1:] if self.gfm and lx.FILTERED.match(html) else html)
            elif kind == "Autolink":
                put(f'<a href="{SCHEMES[x.extra]}{link_target(x.text)}">{escape(x.text)}</a>')
            elif kind == "FootnoteRef":
                label, number, use = x.extra
                suffix = f"-{use}" if use > 1 else ""
                put(f'<sup class="footnote-ref"><a href="#fn-{note_id(label)}" id="fnref-{note_id(label)}{suffix}" data-footnote-ref>{number}</a></sup>')
            elif kind == "Link":
                put(f'<a href="{href(x.url)}"' + (f' title="{title(x.title)}"' if x.title is not None else "") + ">")
                stack.append("</a>")
                stack.extend(reversed(x.children))
            else:
                put(f'<img src="{href(x.url)}" alt="{alt_text(x.children)}"' + (f' title="{title(x.title)}"' if x.title is not None else "") + " />")


def alt_text(nodes: list[Inline]) -> str:
    out, stack = [], list(reversed(nodes))
    while stack:
        x = stack.pop()
        if x.kind == "Text":
            out.append(escape_text(x.text))
        elif x.kind in ("Code", "Autolink", "RawHtml"):
            out.append(escape(x.text))
        elif x.kind in ("SoftBreak", "HardBreak"):
            out.append("\n")
        elif x.children:
            stack.extend(reversed(x.children))
    return "".join(out)


def to_html(doc: Document) -> str:
    return Renderer(doc).render()
