"""Line and character classes of the grammar, as compiled patterns and small measures."""

from __future__ import annotations

import re
from functools import lru_cache
from html.entities import html5
from unicodedata import category

WS = " \t\n\f\r"
#: The White_Space code points.
UNICODE_SPACE = frozenset("\t\n\v\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")
TRIM = "".join(sorted(UNICODE_SPACE))
PUNCT = frozenset("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")
#: Tags that open an HTML block by themselves, and those whose text is raw.
BLOCK_TAGS = (
    "address article aside base basefont blockquote body caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form frame frameset "
    "h1 h2 h3 h4 h5 h6 head header hr html iframe legend li link main menu menuitem nav noframes ol optgroup option p param search section summary table tbody td tfoot th thead title tr track ul"
).split()
RAW_TAGS = ("pre", "script", "style", "textarea")
#: Tags that the GitHub dialect shows as text.
FILTERED_TAGS = ("title", "textarea", "style", "xmp", "iframe", "noembed", "noframes", "script", "plaintext")

BLANK = re.compile(r"[ \t\f\r]*\Z")
RULE = re.compile(r"([-*_])[ \t]*(?:\1[ \t]*){2,}\Z")
FENCE = re.compile(r"(`{3,})([^`]*)\Z|(~{3,})(.*)\Z", re.S)
ATX = re.compile(r"(#{1,6})(?:[ \t]+|\Z)")
MARKER = re.compile(r"(?:([-+*])|([0-9]{1,9})([.)]))(?=[ \t]|\Z)")
SETEXT = re.compile(r"(=+|-+)[ \t]*\Z")

ATTRIBUTE = r"""(?:[ \t\n]+[A-Za-z_:][A-Za-z0-9_.:-]*(?:[ \t\n]*=[ \t\n]*(?:[^ \t\n"'=<>`]+|'[^']*'|"[^"]*"))?)"""
OPEN_TAG = rf"<[A-Za-z][A-Za-z0-9-]*{ATTRIBUTE}*[ \t\n]*/?>"
CLOSE_TAG = r"</[A-Za-z][A-Za-z0-9-]*[ \t\n]*>"
INLINE_HTML = re.compile(rf"{OPEN_TAG}|{CLOSE_TAG}")
URI = re.compile(r"<([A-Za-z][A-Za-z0-9+.-]{1,31}:[^\x00-\x20<>\x7f]*)>")
EMAIL = re.compile(r"<([A-Za-z0-9.!#$%&'*+/=?^_`{|}~-]+@[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?)*)>")
_HTML_1 = re.compile(rf"<(?:{'|'.join(RAW_TAGS)})(?:[ \t]|>|\Z)", re.I)
_HTML_6 = re.compile(rf"</?(?:{'|'.join(BLOCK_TAGS)})(?:[ \t]|/?>|\Z)", re.I)
_HTML_7 = re.compile(rf"(?:{OPEN_TAG}|{CLOSE_TAG})[ \t\f\r]*\Z")
_HTML_1_END = re.compile(rf"</(?:{'|'.join(RAW_TAGS)})>", re.I)
FILTERED = re.compile(rf"<(?=/?(?:{'|'.join(FILTERED_TAGS)})(?:[ \t\n\f\r]|>|/>))", re.I)

ALERT = re.compile(r"\[!(note|tip|important|warning|caution)\]", re.I)
TASK = re.compile(r" {0,3}\[([ xX])\](?=[ \t\n\f\r]|\Z)")
FOOTNOTE_DEF = re.compile(r"\[\^([^\] \t\r]+)\]:[ \t]*")


def indent_of(line: str) -> int | None:
    """Length of an indent of less than four columns; None if it is deeper."""
    n = len(line) - len(line.lstrip(" "))
    if n > 3 or (n < len(line) and line[n] == "\t"):
        return None
    return n


def spaces(line: str) -> int:
    return len(line) - len(line.lstrip(" "))


def columns(line: str) -> int:
    """Columns of leading blanks, tabs to the next multiple of four."""
    col = 0
    for c in line:
        if c == " ":
            col += 1
        elif c == "\t":
            col += 4 - col % 4
        else:
            break
    return col


def at_column(line: str, target: int, start: int = 0) -> tuple[int, int]:
    """(index, blanks left over of a tab) where the indent reaches a column, or where it ends before it."""
    col = start
    for i, c in enumerate(line):
        if col >= target:
            return i, col - target
        if c == " ":
            col += 1
        elif c == "\t":
            col += 4 - col % 4
        else:
            return i, 0
    return len(line), max(0, col - target)


def is_blank(line: str) -> bool:
    return BLANK.match(line) is not None


def is_rule(body: str) -> bool:
    return RULE.match(body) is not None


def fence(body: str) -> tuple[str, int] | None:
    """(character, length) of an opening code fence."""
    m = FENCE.match(body)
    return (m[0][0], len(m[1] or m[3])) if m else None


def closes(body: str, opened: tuple[str, int]) -> bool:
    char, size = opened
    n = len(body) - len(body.lstrip(char))
    return n >= size and not body[n:].strip(WS)


def atx(body: str) -> tuple[int, str] | None:
    m = ATX.match(body)
    if not m:
        return None
    text = body[m.end() :].strip(" \t")
    bare = text.rstrip("#")
    if not bare:
        text = ""
    elif bare != text and bare[-1] in " \t":
        text = bare.rstrip(" \t")
    return len(m[1]), text


class Marker:
    """A list marker: its width, the bullet or delimiter, and an ordered list's number."""

    __slots__ = ("number", "sign", "width")

    def __init__(self, m: re.Match):
        self.width = m.end()
        self.sign = m[1] or m[3]
        self.number = int(m[2]) if m[2] else None

    def like(self, other: Marker) -> bool:
        return self.sign == other.sign and (self.number is None) == (other.number is None)

    def content_column(self, column: int, rest: str) -> int:
        """Where the content of an item stands whose marker is at ``column``: behind one to four columns of blanks, else behind one."""
        at = column + self.width
        blanks = rest[: len(rest) - len(rest.lstrip(" \t"))]
        gap = len((" " * at + blanks).expandtabs(4)) - at
        return at + (gap if 1 <= gap <= 4 and rest.strip(WS) else 1)


def marker(body: str) -> Marker | None:
    m = MARKER.match(body)
    return Marker(m) if m else None


def setext(body: str) -> int | None:
    m = SETEXT.match(body)
    return (1 if m[1][0] == "=" else 2) if m else None


def begins_block(body: str) -> bool:
    return not body or body[0] == ">" or MARKER.match(body) is not None or is_rule(body) or fence(body) is not None or ATX.match(body) is not None


def html_start(body: str, in_paragraph: bool) -> int | None:
    """Kind 1 to 7 of the HTML block that a line opens."""
    if not body.startswith("<"):
        return None
    if _HTML_1.match(body):
        return 1
    if body.startswith("<!--"):
        return 2
    if body.startswith("<?"):
        return 3
    if body.startswith("<![CDATA["):
        return 5
    if body.startswith("<!") and body[2:3].isascii() and body[2:3].isalpha():
        return 4
    if _HTML_6.match(body):
        return 6
    return 7 if not in_paragraph and _HTML_7.match(body) else None


def html_ends(kind: int, line: str) -> bool:
    if kind == 1:
        return _HTML_1_END.search(line) is not None
    return kind < 6 and {2: "-->", 3: "?>", 4: ">", 5: "]]>"}[kind] in line


def inline_html(text: str, at: int) -> int | None:
    """End of the raw HTML that starts at ``at``."""
    if text.startswith("<!--", at):
        if text.startswith(("<!-->", "<!--->"), at):
            return text.index(">", at + 4) + 1
        end = text.find("-->", at + 4)
        return end + 3 if end >= 0 else None
    for head, tail in (("<?", "?>"), ("<![CDATA[", "]]>")):
        if text.startswith(head, at):
            end = text.find(tail, at + len(head))
            return end + len(tail) if end >= 0 else None
    if text.startswith("<!", at) and text[at + 2 : at + 3].isascii() and text[at + 2 : at + 3].isalpha():
        end = text.find(">", at)
        return end + 1 if end >= 0 else None
    m = INLINE_HTML.match(text, at)
    return m.end() if m else None


@lru_cache(maxsize=4096)
def char_class(c: str) -> int:
    """0 white space, 1 punctuation, 2 other; the start and end of a text are white space."""
    if not c or c in UNICODE_SPACE:
        return 0
    if c in PUNCT:
        return 1
    return 1 if not c.isascii() and category(c)[0] in "PS" else 2


@lru_cache(maxsize=4096)
def host_char(c: str) -> bool:
    """Whether a character may stand in the host of a bare address."""
    if not c or c in UNICODE_SPACE:
        return False
    return c not in PUNCT if c.isascii() else not category(c).startswith("P")


_ENTITY = re.compile(r"&(?:#([0-9]{1,7})|#[xX]([0-9a-fA-F]{1,6})|([A-Za-z][A-Za-z0-9]*));")


def _entity(m: re.Match) -> str:
    if m[3]:
        return html5.get(m[3] + ";", m[0])
    n = int(m[1]) if m[1] else int(m[2], 16)
    return chr(n) if 0 < n <= 0x10FFFF and not 0xD800 <= n <= 0xDFFF else "\ufffd"


def decode_entities(text: str) -> str:
    """Named references with their semicolon, and numbers of 7 decimal or 6 hexadecimal digits at most."""
    return _ENTITY.sub(_entity, text) if "&" in text else text


_ESCAPED = re.compile(r"\\([!-/:-@\[-`{-~])")


def unescape(text: str) -> str:
    """Drop the backslash before ASCII punctuation and decode entities elsewhere."""
    if "\\" not in text:
        return decode_entities(text)
    out, at = [], 0
    for m in _ESCAPED.finditer(text):
        out += [decode_entities(text[at : m.start()]), m[1]]
        at = m.end()
    return "".join(out) + decode_entities(text[at:])


def label_key(label: str) -> str:
    """Labels match by this: trimmed, runs of blanks one, each character lowered by itself, sharp s as ss."""
    words = re.split(f"[{re.escape(TRIM)}]+", label.strip(TRIM))
    return "".join(c.lower() for c in " ".join(words)).replace("ß", "ss")
