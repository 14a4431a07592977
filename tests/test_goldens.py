"""The examples of the specifications, and where the dialects differ."""

import pytest

from folio.kernel import Options, parse
from folio.kernel.html import to_html
from folio.plans.catalogue import goldens


@pytest.mark.parametrize("example", goldens("commonmark"), ids=lambda g: ascii(g["markdown"])[:40])
def test_commonmark(example):
    assert to_html(parse(example["markdown"], Options("commonmark"))) == example["html"]


@pytest.mark.parametrize("example", goldens("gfm"), ids=lambda g: g["name"])
def test_gfm(example):
    assert to_html(parse(example["markdown"])) == example["html"]


def test_examples_that_differ_under_gfm():
    """Tag filtering and bare addresses only."""
    found = [g["markdown"] for g in goldens("commonmark") if to_html(parse(g["markdown"])) != g["html"]]
    assert len(found) == 10
    assert all("<" in m or "://" in m or "@" in m for m in found)
