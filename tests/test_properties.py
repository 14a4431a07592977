"""Invariants over random and hostile inputs."""

import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from folio.kernel import Options, parse
from folio.kernel.flatten import block_rows, inline_rows
from folio.kernel.html import to_html

MARKUP = st.text(alphabet="ab \n\t*_~`[]()<>!#-+.0123|:\\&;\"'^=@/xw", max_size=120)


@given(MARKUP | st.text(max_size=60))
@settings(max_examples=2000, deadline=None)
def test_any_text_parses_in_both_dialects(text):
    for dialect in ("gfm", "commonmark"):
        doc = parse(text, Options(dialect))
        to_html(doc)
        rows = block_rows(doc)
        for b, r in rows:
            assert r["node_id"] + r["subtree_len"] < len(rows) + 0
            if r["kind"] == "Table":
                assert all(len(row.children) == r["columns"] for row in b.children)
            inl = inline_rows(b.inline or [], r["node_id"])
            for x in inl:
                assert x["inline_id"] + x["subtree_len"] < len(inl)
                assert x["parent_inline_id"] is None or x["parent_inline_id"] < x["inline_id"]
            assert not any(a["kind"] == z["kind"] == "Text" and a["parent_inline_id"] == z["parent_inline_id"] and a["ordinal"] + 1 == z["ordinal"] for a, z in zip(inl, inl[1:], strict=False))


@given(MARKUP)
@settings(max_examples=1000, deadline=None)
def test_quoting_keeps_a_document_in_one_quote(text):
    quoted = "\n".join("> " + line for line in text.split("\n"))
    assert [b.kind for b in parse(quoted, Options("commonmark")).blocks] == ["Blockquote"]


HOSTILE = {
    "underscores": "_" * 100_000, "stars": "*" * 100_000, "openers": "*a " * 50_000, "low openers": "_a " * 50_000, "brackets": "[" * 50_000, "nested": "[" * 20_000 + "]" * 20_000,
    "images": "![" * 50_000, "links in links": "[" * 5000 + "[a](b)" + "](c)" * 5000, "images in images": "![" * 5000 + "![a](b)" + "](c)" * 5000, "backslashes": "\\" * 100_000,
    "ticks": "` " * 50_000, "growing ticks": " ".join("`" * i for i in range(1, 600)), "angles": "<" * 50_000, "parentheses": "[a]" + "(" * 50_000, "quotes": ">" * 50_000, "spaced quotes": "> " * 10_000,
    "lists": "\n".join("  " * i + "- x" for i in range(500)), "blanks": "- x\n" + "\n" * 50_000, "trailing": "x  \n" * 50_000, "comments": "<!--" * 20_000, "deep emphasis": "*a **b " * 5000 + "c** d*" * 5000,
    "addresses": "a.b@c.d " * 20_000, "www": "www." * 20_000, "schemes": "http://" * 20_000, "pipes": "|" * 5000 + "\n" + "|-" * 5000, "definitions": "[a]: /b\n" * 20_000, "tildes": "~~a ~" * 20_000,
}


@pytest.mark.parametrize("name", HOSTILE)
def test_hostile_inputs_return_in_time(name):
    began = time.monotonic()
    to_html(parse(HOSTILE[name]))
    assert time.monotonic() - began < 20


def test_a_document_that_fails_is_an_error_row(spark, monkeypatch):
    """In the permissive mode; the others are parsed. A parser that fails has to be made up."""
    from folio.operators import relations as R

    real = R._kernel

    def failing(relation, options, only):
        rows = real(relation, options, only)

        def rows_of(doc_id, text):
            if "boom" in text:
                raise KeyError(text)
            return rows(doc_id, text)

        return rows_of

    monkeypatch.setattr(R, "_kernel", failing)
    docs = spark.createDataFrame([(1, "a"), (2, "boom"), (3, None), (4, "# b")], "doc_id long, text string")
    assert [(r.doc_id, r.error) for r in R.parse_errors(docs).collect()] == [(2, "KeyError: 'boom'")]
    assert sorted((r.doc_id, r.html) for r in R.render_html(docs, permissive=True).collect()) == [(1, "<p>a</p>\n"), (2, None), (3, None), (4, "<h1>b</h1>\n")]
    assert sorted(r.doc_id for r in R.parse_blocks(docs, permissive=True).collect()) == [1, 4]
    with pytest.raises(Exception, match="boom"):
        R.parse_blocks(docs).collect()
