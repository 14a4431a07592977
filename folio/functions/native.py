"""Line classifiers and escapes as Catalyst expressions: they push down, and stay in generated code.

Line functions take one line without its line break. They say what a line could be; whether it is
that also depends on what is open before it, which only the parser knows.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folio.kernel.lexer import BLOCK_TAGS, FILTERED_TAGS, RAW_TAGS, TRIM

#: White space in a Java pattern's brackets.
_BLANKS = "".join(f"\\x{{{ord(c):x}}}" for c in TRIM)

_Col = Column | str


def _c(c: _Col) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _body(c: _Col) -> Column:
    """The line without an indent of up to three blanks; null where the indent is deeper."""
    return F.when(has_shallow_indent(c), F.regexp_replace(_c(c), "^ {0,3}", ""))


def _matches(c: _Col, pattern: str) -> Column:
    """Whether the line's body matches; false where the indent is deeper."""
    return F.coalesce(_body(c).rlike(pattern), F.lit(False))


def normalize(c: _Col) -> Column:
    """CR LF and lone CR to LF."""
    return F.regexp_replace(_c(c), "\r\n?", "\n")


def is_blank(c: _Col) -> Column:
    return _c(c).rlike(r"^[ \t\f\r\n]*\z")


def has_shallow_indent(c: _Col) -> Column:
    """Less than four columns of indent."""
    return _c(c).rlike(r"^ {0,3}(?![ \t])")


def leading_spaces(c: _Col) -> Column:
    return F.length(F.regexp_extract(_c(c), "^( *)", 1))


def leading_columns(c: _Col) -> Column:
    """Columns of indent, tabs to the next multiple of four."""
    blanks = F.split(F.regexp_extract(_c(c), "^([ \t]*)", 1), "")
    return F.aggregate(blanks, F.lit(0), lambda n, x: F.when(x == "\t", n + 4 - n % 4).when(x == " ", n + 1).otherwise(n))


def at_column(c: _Col, target: int) -> Column:
    """struct(index, pad): where the indent reaches a column, and the blanks left over of a tab."""
    blanks = F.split(F.regexp_extract(_c(c), "^([ \t]*)", 1), "")
    start = F.struct(F.lit(0).alias("col"), F.lit(0).alias("index"))

    def step(s, x):
        wide = F.when(x == "\t", s["col"] + 4 - s["col"] % 4).when(x == " ", s["col"] + 1).otherwise(s["col"])
        more = (s["col"] < target) & x.isin(" ", "\t")
        return F.struct(F.when(more, wide).otherwise(s["col"]).alias("col"), (s["index"] + more.cast("int")).alias("index"))

    end = F.aggregate(blanks, start, step)
    return F.struct(end["index"].alias("index"), F.greatest(F.lit(0), end["col"] - target).alias("pad"))


def strip_columns(c: _Col, target: int) -> Column:
    """The line without its first ``target`` columns of indent, what is left of a tab as blanks."""
    at = at_column(c, target)
    return F.concat(F.repeat(F.lit(" "), at["pad"]), F.substring(_c(c), at["index"] + 1, F.length(_c(c))))


def opens_fence(c: _Col) -> Column:
    return _matches(c, r"^(?:`{3,}[^`]*|~{3,}.*)\z")


def fence_mark(c: _Col) -> Column:
    """The run of fence characters, or an empty string."""
    return F.when(opens_fence(c), F.regexp_extract(_body(c), "^(`{3,}|~{3,})", 1)).otherwise("")


def closes_fence(c: _Col, mark: _Col) -> Column:
    run = F.regexp_extract(F.coalesce(_body(c), F.lit("")), r"^(`{3,}|~{3,})[ \t\f\r]*\z", 1)
    return (F.length(run) >= F.length(_c(mark))) & (F.substring(run, 1, 1) == F.substring(_c(mark), 1, 1))


def info_string(c: _Col) -> Column:
    return F.when(opens_fence(c), F.trim(F.regexp_replace(_body(c), "^(`+|~+)", "")))


def is_rule(c: _Col) -> Column:
    return _matches(c, r"^([-*_])[ \t]*(\1[ \t]*){2,}\z")


def heading_level(c: _Col) -> Column:
    """1 to 6, or null where the line is no ATX heading."""
    n = F.length(F.regexp_extract(F.coalesce(_body(c), F.lit("")), r"^(#{1,6})(?:[ \t]|\z)", 1))
    return F.when(n > 0, n)


def heading_text(c: _Col) -> Column:
    body = F.regexp_replace(_body(c), r"^#{1,6}[ \t]*", "")
    return F.when(heading_level(c).isNotNull(), F.regexp_replace(F.regexp_replace(body, r"[ \t]+\z", ""), r"(^|[ \t]+)#+\z", ""))


def list_marker(c: _Col) -> Column:
    """The marker (-, +, *, or a number with its delimiter), or null."""
    m = F.regexp_extract(F.coalesce(_body(c), F.lit("")), r"^([-+*]|[0-9]{1,9}[.)])(?:[ \t]|\z)", 1)
    return F.when((m != "") & ~is_rule(c), m)


def same_family(a: _Col, b: _Col) -> Column:
    """Whether two markers continue one list: the same bullet or delimiter."""
    return F.substring(_c(a), -1, 1) == F.substring(_c(b), -1, 1)


def list_delimiter(marker: _Col) -> Column:
    d = F.substring(_c(marker), -1, 1)
    return F.when(d.isin(".", ")"), d)


def content_column(c: _Col) -> Column:
    """The column of a list item's content: behind one to four blanks, else right behind the marker's blank."""
    at = leading_spaces(c) + F.length(list_marker(c))
    rest = F.regexp_extract(_c(c), r"^ *(?:[-+*]|[0-9]{1,9}[.)])([ \t]*)", 1)
    gap = F.length(rest)
    empty = _c(c).rlike(r"^ *(?:[-+*]|[0-9]{1,9}[.)])[ \t]*\z")
    return F.when(list_marker(c).isNotNull(), at + F.when(empty | (gap > 4) | (gap == 0), 1).otherwise(gap))


def setext_level(c: _Col) -> Column:
    return F.when(_matches(c, r"^=+[ \t]*\z"), 1).when(_matches(c, r"^-+[ \t]*\z"), 2)


def begins_block(c: _Col) -> Column:
    return is_blank(c) | _matches(c, "^>") | list_marker(c).isNotNull() | is_rule(c) | opens_fence(c) | heading_level(c).isNotNull()


def could_start_block(c: _Col) -> Column:
    return _matches(c, r"^[#>\-*+_0-9]")


def opens_html(c: _Col) -> Column:
    """Kind 1 to 6 of the HTML block that the line would open, or null (kind 7 needs the parser)."""
    return (
        F.when(_matches(c, rf"(?i)^<(?:{'|'.join(RAW_TAGS)})(?:[ \t]|>|\z)"), 1)
        .when(_matches(c, "^<!--"), 2)
        .when(_matches(c, r"^<\?"), 3)
        .when(_matches(c, r"^<!\[CDATA\["), 5)
        .when(_matches(c, "^<![A-Za-z]"), 4)
        .when(_matches(c, rf"(?i)^</?(?:{'|'.join(BLOCK_TAGS)})(?:[ \t]|/?>|\z)"), 6)
    )


def delimiter_columns(c: _Col) -> Column:
    """Columns of a table's delimiter row, or null."""
    inner = F.regexp_replace(F.trim(_c(c)), r"^\||\|\z", "")
    ok = inner.rlike(r"^[ \t]*:?-+:?[ \t]*(\|[ \t]*:?-+:?[ \t]*)*\z")
    return F.when(has_shallow_indent(c) & ok, F.size(F.split(inner, r"\|", -1)))


def alignment(cell: _Col) -> Column:
    """none, left, center or right of a delimiter cell."""
    t = F.trim(_c(cell))
    return F.when(t.rlike("^:.*:$"), "center").when(t.rlike("^:"), "left").when(t.rlike(":$"), "right").otherwise("none")


def split_row(c: _Col) -> Column:
    """The cells of a table row, at pipes that no backslash escapes."""
    inner = F.regexp_replace(F.trim(_c(c)), r"^\||\|\z", "")
    return F.transform(F.split(inner, r"(?<=(?<!\\)(?:\\\\){0,100})\|", -1), lambda x: F.trim(x))


def task_state(c: _Col) -> Column:
    m = F.regexp_extract(_c(c), r"^ {0,3}\[([ xX])\](?=\s|\z)", 1)
    return F.when(m == " ", "unchecked").when(m != "", "checked")


def alert_kind(c: _Col) -> Column:
    m = F.regexp_extract(_c(c), r"(?i)^\[!(note|tip|important|warning|caution)\]", 1)
    return F.when(m != "", F.lower(m))


def alert_title(kind: _Col, custom: _Col) -> Column:
    """The title shown: the custom one, or the kind's own name."""
    return F.coalesce(_c(custom), F.initcap(_c(kind)))


def line_kind(c: _Col) -> Column:
    """What a line is by itself: blank, code, fence, rule, heading, quote, list, html, delimiter or text."""
    # The first character rules out most kinds, so that few patterns run on a line.
    lead = F.substring(_c(c), 1, 1)
    first = F.substring(F.ltrim(_c(c)), 1, 1)
    return (
        F.when(first.isin("", "\t", "\f", "\r", "\n") & is_blank(c), "blank")
        .when(lead.isin(" ", "\t") & ~has_shallow_indent(c), "code")
        .when(first.isin("`", "~") & opens_fence(c), "fence")
        .when(first.isin("-", "*", "_") & is_rule(c), "rule")
        .when((first == "#") & heading_level(c).isNotNull(), "heading")
        .when(first == ">", "quote")
        .when(first.isin("-", "+", "*", *map(str, range(10))) & list_marker(c).isNotNull(), "list")
        .when((first == "<") & opens_html(c).isNotNull(), "html")
        .when(first.isin("|", ":", "-") & _c(c).contains("|") & delimiter_columns(c).isNotNull(), "delimiter")
        .otherwise("text")
    )


# ------------------------------------------------------------------ escapes and keys
def escape_html(c: _Col) -> Column:
    out = _c(c)
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def escape_code_span(c: _Col) -> Column:
    flat = F.translate(_c(c), "\n", " ")
    cut = (F.length(flat) > 1) & flat.startswith(" ") & flat.endswith(" ") & (F.trim(flat) != "")
    return escape_html(F.when(cut, F.substring(flat, F.lit(2), F.length(flat) - 2)).otherwise(flat))


def strip_code_indent(c: _Col) -> Column:
    """Up to four columns of indent off every line."""
    return F.regexp_replace(_c(c), r"(?m)^( {0,3}\t| {1,4})", "")


def cell_literal(c: _Col) -> Column:
    """Code and raw HTML of a table cell: an escaped pipe is a pipe."""
    return F.replace(_c(c), F.lit("\\|"), F.lit("|"))


def filter_tags(c: _Col) -> Column:
    return F.regexp_replace(_c(c), rf"(?i)<(?=/?({'|'.join(FILTERED_TAGS)})(\s|>|/>))", "&lt;")


def label_norm(c: _Col) -> Column:
    """The key by which labels match: trimmed, runs of blanks one, each letter lowered by itself, sharp s as ss."""
    flat = F.regexp_replace(F.regexp_replace(_c(c), f"[{_BLANKS}]+", " "), r"^ | \z", "")
    # Lowering a whole word may depend on a letter's place in it (Greek sigma), so letters beyond ASCII go one by one.
    single = F.array_join(F.transform(F.regexp_extract_all(flat, F.lit("(?s)."), F.lit(0)), F.lower), "")
    return F.when(flat.rlike(r"^[\x00-\x7f]*\z"), F.lower(flat)).otherwise(F.replace(single, F.lit("ß"), F.lit("ss")))


def autolink_prefix(kind: _Col) -> Column:
    return F.when(_c(kind) == "email", "mailto:").when(_c(kind) == "www", "http://").otherwise("")


def may_have_url(c: _Col) -> Column:
    return _c(c).rlike(r"www\.|://")


def has_inline_syntax(c: _Col) -> Column:
    """Whether a text holds any character that starts an inline element; if not, it is plain text."""
    return _c(c).rlike(r"[*_\[!\\`<~@&]|www\.|://")
