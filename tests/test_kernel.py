"""Structure of parsed documents, one construct at a time."""

import pytest

from folio.kernel import Options, parse
from folio.kernel import lexer as lx
from folio.kernel.flatten import block_rows, definition_rows, inline_rows
from folio.kernel.html import to_html


def tree(text, dialect="gfm", **limits):
    def show(b):
        return (b.kind, *(show(c) for c in b.children)) if b.children else b.kind

    return [show(b) for b in parse(text, Options(dialect, **limits)).blocks]


def inline(text, dialect="gfm"):
    doc = parse(text, Options(dialect))
    return [(r["kind"], r["text"] if r["text"] is not None else r["url"]) for r in inline_rows(doc.blocks[0].inline, 0)]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("", []),
        ("\n \n", []),
        ("a\n===\nb\n-\n", ["Heading", "Heading"]),
        ("# a\n***\n    code\n", ["Heading", "HorizontalRule", "IndentedCode"]),
        ("```x\ny\n", ["CodeBlock"]),
        ("  ```\n y\n  ```", ["CodeLines"]),
        ("> a\nb\n\n> c", [("Blockquote", "Paragraph"), ("Blockquote", "Paragraph")]),
        ("> [!note]\n> a", [("Alert", "Paragraph")]),
        ("- a\n- b", [("UnorderedList", ("ListItem", "Paragraph"), ("ListItem", "Paragraph"))]),
        ("- a\n\n  b\n  - c", [("UnorderedList", ("ListItem", "Paragraph", "Paragraph", ("UnorderedList", ("ListItem", "Paragraph"))))]),
        ("- a\n+ b\n1. c\n2) d", [("UnorderedList", ("ListItem", "Paragraph"))] * 2 + [("OrderedList", ("ListItem", "Paragraph"))] * 2),
        ("- \n\n  a", [("UnorderedList", "ListItem"), "Paragraph"]),
        ("a\n2. b", ["Paragraph"]),
        ("a\n1. b", ["Paragraph", ("OrderedList", ("ListItem", "Paragraph"))]),
        ("> a\n2. b", [("Blockquote", "Paragraph"), ("OrderedList", ("ListItem", "Paragraph"))]),
        ("> a\n> 2. b", [("Blockquote", "Paragraph", ("OrderedList", ("ListItem", "Paragraph")))]),
        ("<div>\na\n\nb", ["HtmlBlock", "Paragraph"]),
        ("> <!-- a\n> b -->\n> c", [("Blockquote", "HtmlLines", "Paragraph")]),
        ("| a |\n|---|\n| b |\n- c", [("Table", ("TableRow", "TableCell"), ("TableRow", "TableCell")), ("UnorderedList", ("ListItem", "Paragraph"))]),
        ("# a | b\n-|-\nc", [("Table", ("TableRow", "TableCell", "TableCell"), ("TableRow", "TableCell", "TableCell"))]),
        ("x\na | b\n-|-", ["Paragraph", ("Table", ("TableRow", "TableCell", "TableCell"))]),
        ("> a | b\n> -|-", [("Blockquote", "Paragraph")]),
        ("[^a]: x\n\n    y\nz", [("FootnoteDefinition", "Paragraph", "Paragraph"), ]),
        ("> [^a]: x", ["Blockquote"]),  # a link definition there
        ("[a]: /b\n[a]", ["Paragraph"]),
        ("- a\n<div>", [("UnorderedList", ("ListItem", "Paragraph")), "HtmlBlock"]),
        (">\t\t\tcode", [("Blockquote", "CodeLines")]),
        ("> ```\n> a\nb", [("Blockquote", "CodeLines"), "Paragraph"]),
        ("> - a\nlazy\n> - b", [("Blockquote", ("UnorderedList", ("ListItem", "Paragraph"), ("ListItem", "Paragraph")))]),
        (">     ", ["Blockquote"]),
        ("> [!tip]\n> a\nlazy\n>\n> > b", [("Alert", "Paragraph", ("Blockquote", "Paragraph"))]),
        ("> [!tip]\nlazy\n\nb", [("Alert", "Paragraph"), "Paragraph"]),
    ],
)
def test_blocks(text, want):
    assert tree(text) == want


@pytest.mark.parametrize(
    ("text", "tight"),
    [
        ("a\n\n- [x] b\n- c", [True]), ("- a\n\n- b", [False]), ("- a\n\n  b", [False]), ("- a\n  - b\n\n    c\n- d", [True, False]), ("- a\n  - b\n\n  - c", [False, False]), ("- a\n  > b\n  >\n- c", [True]),
        ("- a\n- ```\n  b\n\n\n  ```\n- c", [True]), ("- a\n\n  [b]: /c\n- d", [False]), ("- a\n- b\n\nc", [True]), ("> - a\n>\n> - b", [False]), ("- > a\n\n  b", [False]), ("-\n  a\n- b", [True]),
    ],
)
def test_tight_lists(text, tight):
    assert [r["tight"] for _, r in block_rows(parse(text)) if r["tight"] is not None] == tight


def test_strict_has_no_extensions():
    text = "| a |\n|---|\n\n~~x~~ www.a.bc\n\n- [ ] t\n\n> [!NOTE]\n> q\n\n[^n]: note\n"
    kinds = {r["kind"] for _, r in block_rows(parse(text, Options("commonmark")))}
    assert not kinds & {"Table", "Alert", "FootnoteDefinition"}
    assert {r["kind"] for b, _ in block_rows(parse(text, Options("commonmark"))) for r in inline_rows(b.inline or [], 0)} <= {"Text", "SoftBreak"}
    assert all(r["task"] is None for _, r in block_rows(parse(text, Options("commonmark"))))


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("a *b **c** d* e", [("Text", "a "), ("Italic", None), ("Text", "b "), ("Bold", None), ("Text", "c"), ("Text", " d"), ("Text", " e")]),
        ("~a~ ~~b~~ ~~~c~~~ ~d~~", [("Strikethrough", None), ("Text", "a"), ("Text", " "), ("Strikethrough", None), ("Text", "b"), ("Text", " ~~~c~~~ ~d~~")]),
        ("\\``", [("Text", "``")]),
        ("\\``x` y", [("Text", "`"), ("Code", "x"), ("Text", " y")]),
        ("\\`x`", [("Text", "`x`")]),
        ("`a` ``b`c``", [("Code", "a"), ("Text", " "), ("Code", "b`c")]),
        ("a  \nb\\\nc\nd", [("Text", "a"), ("HardBreak", None), ("Text", "b"), ("HardBreak", None), ("Text", "c"), ("SoftBreak", None), ("Text", "d")]),
        ("[a [b](c) d](e)", [("Text", "[a "), ("Link", "c"), ("Text", "b"), ("Text", " d](e)")]),
        ("![a [b](c)](d)", [("Image", "d"), ("Text", "a "), ("Link", "c"), ("Text", "b")]),
        ("<b>x</b> <http://a.b> <c@d.e>", [("RawHtml", "<b>"), ("Text", "x"), ("RawHtml", "</b>"), ("Text", " "), ("Autolink", "http://a.b"), ("Text", " "), ("Autolink", "c@d.e")]),
        ("see www.a.com/b). (http://x.y/(z)) me@a.bc.", [("Text", "see "), ("Autolink", "www.a.com/b"), ("Text", "). ("), ("Autolink", "http://x.y/(z)"), ("Text", ") "), ("Autolink", "me@a.bc"), ("Text", ".")]),
        ("[www.a.com](/x)", [("Link", "/x"), ("Text", "www.a.com")]),
        (r"&copy; &#65; \&copy; &amp\;", [("Text", "© A &copy; &amp;")]),
        ("http://a.bc?x=1&amp; ftp://d.e", [("Autolink", "http://a.bc?x=1"), ("Text", "& "), ("Autolink", "ftp://d.e")]),
        ("mailto:a@b.cd xmpp:e@f.gh/i x_y@a_b.cd", [("Autolink", "mailto:a@b.cd"), ("Text", " "), ("Autolink", "xmpp:e@f.gh/i"), ("Text", " "), ("Autolink", "x_y@a_b.cd")]),
    ],
)
def test_inlines(text, want):
    assert inline(text) == want


def test_text_borders_decide_what_an_address_is():
    """An escaped character joins the text behind it only where the context has a delimiter."""
    assert inline("foo\\.bar@x.com")[-1] == ("Autolink", "bar@x.com")
    assert inline("*z* foo\\.bar@x.com")[-1] == ("Autolink", ".bar@x.com")


def test_container_paragraphs_are_read_line_by_line():
    assert to_html(parse("> a  \n> `b\n> c` *d\n> e*")) == "<blockquote>\n<p>a\n`b\nc` <em>d\ne</em></p>\n</blockquote>\n"


def test_references_and_scope():
    doc = parse("[Foo  bar][], [x]\n\n> [foo BAR]: /in 'T'\n\n[foo bar]: /top\n[ẞ]: /s\n")
    assert [(d["label_norm"], d["url"], d["title"], d["scope"]) for d in definition_rows(doc)] == [("foo bar", "/top", None, "top"), ("ss", "/s", None, "top"), ("foo bar", "/in", "T", "container")]
    assert inline("[a][b]\n\n[a]: /x")[0] == ("Text", "[a][b]")


def test_footnotes_are_numbered_by_first_use():
    doc = parse("[^b] [^a] [^b] [^none]\n\n[^a]: one\n[^b]: two [^a]\n[^c]: three\n")
    notes = {r["fn_label"]: (r["fn_number"], r["fn_references"]) for _, r in block_rows(doc) if r["kind"] == "FootnoteDefinition"}
    assert notes == {"a": (2, 2), "b": (1, 2), "c": (0, 0)}
    html = to_html(doc)
    assert html.index('id="fn-b"') < html.index('id="fn-a"') and 'id="fn-c"' not in html and 'id="fnref-b-2"' in html


def test_intervals_and_parents():
    rows = [r for _, r in block_rows(parse("> - a\n>   - b\n>\n> c\n\n| x | y |\n|---|---|\n| 1 |\n"))]
    for r in rows:
        below = [x for x in rows if r["node_id"] < x["node_id"] <= r["node_id"] + r["subtree_len"]]
        assert {x["node_id"] for x in rows if x["parent_id"] == r["node_id"]} <= {x["node_id"] for x in below}
        assert all(x["depth"] > r["depth"] for x in below)


def test_depth_limits():
    assert tree("> > > a", max_block_depth=2) == [("Blockquote", ("Blockquote", "Paragraph"))]
    deep = parse("[" * 40 + "a" + "](b)" * 40, Options(max_inline_depth=4))
    assert to_html(deep).count("<a ") == 1
    images = to_html(parse("![" * 40 + "a" + "](b)" * 40))
    assert images.count("<img") == 1


@pytest.mark.parametrize(
    ("line", "columns", "at"),
    [("\ta", 4, (1, 2)), ("  \ta", 4, (2, 0)), ("  a", 2, (2, 0)), ("a", 0, (0, 0)), ("   ", 3, (2, 0))],
)
def test_columns(line, columns, at):
    assert lx.columns(line) == columns and lx.at_column(line, 2) == at


def test_long_labels_and_titles():
    assert parse(f"[{'a' * 999}]: /x\n").definitions and not parse(f"[{'a' * 1000}]: /x\n").definitions
    assert not parse("[a]: /x 'b\n\nc'\n").definitions
    assert parse("[a]:\n  </x y>\n  'b\n  c'\n").definitions[0].url == "/x y"


def test_inline_content_only_where_it_is_wanted():
    text = "# *a*\n\n- b\n\n| c |\n|---|\n| `d` |\n"
    full, some = parse(text), parse(text, inline=frozenset({"TableCell"}))
    assert [{k: v for k, v in r.items()} for _, r in block_rows(full)] == [r for _, r in block_rows(some)]
    assert {b.kind for b, _ in block_rows(some) if b.inline is not None} == {"TableCell"}
    assert {b.kind for b, _ in block_rows(parse("x[^1]\n\n[^1]: y", inline=frozenset())) if b.inline is not None} == {"Paragraph"}
