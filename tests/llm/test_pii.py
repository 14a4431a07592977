import hashlib
import random
import re
import time

import numpy as np

from folio.llm import pii

from tests.llm.conftest import ODD
from tests.llm.pii_plants import planted

#: The patterns of the contract.
PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def _brute(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if (kind == "ip" and any(int(p) > 255 for p in m[0].split("."))) or (kind == "card" and not (16 <= len(digits) <= 19 and pii.luhn(digits))) or (kind == "phone" and not 8 <= len(digits) <= 15):
                continue
            out.append((kind, m.start(), m.end()))
    return out


def test_base_spans_are_the_patterns():
    rng = random.Random(1)
    for _ in range(6000):
        alphabet = rng.choice(["0123456789.", "0123456789 -", "+0123456789 ().-", "ab@.-_%+1 ", "1234@.+ -()a"])
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60)))
        assert pii.base_spans(text) == _brute(text)


def test_base_digest_and_added_spans(spark, documents):
    rows = {r.doc_id: r for r in pii.personal_data(documents).collect()}
    for d in documents.collect():
        want = _brute(d.text or "")
        r = rows[d.doc_id]
        assert r.base_sha256 == hashlib.sha256(pii.joined(want).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == kind for k, _, _ in want) for kind in pii.KINDS]
        assert set(pii.joined(want).split(",")) - {""} <= set(r.spans.split(","))


def test_skip_edges_carry_a_label_across_the_document(spark):
    text = "Call +1 (743) 555-3824 now. " + "filler " * 50 + "Again 743-555-3824 today; number 4785380592391138 is none"
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").union(spark.createDataFrame([(10**6, text)], "doc_id long, text string"))
    got = pii.personal_data(docs).where("doc_id = 1000000").first()
    at = text.index("743-555")
    assert f"phone:{at}:{at + 12}" in got.spans.split(",") and got.n_added == 1 and got.n_phone == 1


def _field():
    """Equal labels across a skip edge, and unaries that prefer none by half."""
    unary = np.zeros((pii.N_FEATURES, 5))
    unary[0, 0] = 0.5
    return unary, np.zeros((5, 5)), pii.SKIP_PRIOR * np.eye(5)


def test_repeats_in_each_grouping_are_found():
    first = "Call +1 (743) 555-3824 now. "
    for form in ("(743) 555-3824", "743 555 3824", "743-555-3824", "743.555.3824", "743 555-3824", "7435553824", "1 (743) 555-3824", "1-743-555-3824", "(743)555-3824", "0743 555 3824", "743 - 555 - 3824"):
        for before, after in (("again ", " today"), ("3 rooms, ", ""), ("again 12 ", " today"), ("again 88 ", " 41 and 6")):
            text = first + "filler " * 50 + before + form + after
            base = pii.base_spans(text)
            at = len(first) + 350 + len(before)
            assert pii.added_spans(text, base, _field()) == [("phone", at, at + len(form))], (form, before)
    for other in ("(743) 555-3825", "743 555 382", "743 555 38 24x", "555-3824", "743; 555; 3824"):
        text = first + "filler " * 50 + other
        got = pii.added_spans(text, pii.base_spans(text), _field())
        assert bool(got) == (other == "743 555 38 24x"), other
    card = "4539 1488 0343 6467"
    text = f"Card {card}. Again 4539.1488.0343.6467 or 7 {card} 9"
    assert [text[s:e] for k, s, e in pii.added_spans(text, pii.base_spans(text), _field()) if k == "card"] == ["4539.1488.0343.6467", card]


def test_the_number_of_repeats_does_not_matter():
    for strength in (0.5, 1.0, 2.0):
        field = _field()
        field[0][0, 0] = strength
        for form in ("743-555-3824", "(743) 555-3824"):
            for n in (1, 7, 20, 100):
                text = "+1 (743) 555-3824 first" + ", then " * 9 + ("filler " * 9 + form + " ") * n
                assert len(pii.added_spans(text, pii.base_spans(text), field)) == n, (strength, form, n)


def test_repeats_are_no_examples_of_none(spark):
    """Also where most of the sample's repeats are bare, a fitted field marks them."""
    text = "+1 (743) 555-3824 first " + ("filler " * 9 + "(743) 555-3824 ") * 30
    docs = spark.createDataFrame([(i, text.replace("743", str(200 + i))) for i in range(40)], "doc_id long, text string")
    assert {r.n_added for r in pii.personal_data(docs).collect()} == {30}


def test_beliefs_match_enumeration():
    """On a tree (no loops) message passing is exact."""
    rng = np.random.default_rng(0)
    text = "1234567 @ab 7654321"
    g = pii.Graph(text, [])
    field = (rng.normal(size=(pii.N_FEATURES, 5)), rng.normal(size=(5, 5)), rng.normal(size=(5, 5)))
    field = (field[0], field[1] + field[1].T, field[2] + field[2].T)
    n = len(g.spans)
    node = g.x @ field[0]
    weight = np.zeros((5,) * n)
    for y in np.ndindex(weight.shape):
        weight[y] = sum(node[i, y[i]] for i in range(n)) + sum(field[1][y[a], y[b]] for a, b in g.chain) + sum(field[2][y[a], y[b]] for a, b in g.skip)
    p = np.exp(weight - weight.max())
    p /= p.sum()
    want = np.stack([p.sum(axis=tuple(j for j in range(n) if j != i)) for i in range(n)])
    assert not g.skip and np.abs(pii.beliefs(g, field) - want).max() < 0.02


def test_long_runs_take_linear_time():
    for text in ("a" * 200_000, "1" * 200_000, "1." * 100_000, "a@" * 50_000, "+1(" * 50_000, "1 " * 100_000):
        pii.base_spans(text)


def test_odd_rows(odd, none):
    got = pii.personal_data(odd).collect()
    assert len(got) == len(ODD)
    assert {r.base_sha256 for r in got} == {hashlib.sha256(b"").hexdigest()}
    assert pii.personal_data(none).count() == 0


def test_spellings_that_the_patterns_miss_are_found(spark):
    """Recall and precision on planted spellings; the field is fitted on the base spans of other documents."""
    plants = list(planted(600, 5))
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = spark.createDataFrame([(10**6 + i, t) for i, (t, _) in enumerate(plants)], "doc_id long, text string")
    got = {r.doc_id - 10**6: r for r in pii.personal_data(docs.union(rows)).where("doc_id >= 1000000").collect()}
    hit = wanted = added = 0
    by_kind = {k: [0, 0] for k in pii.KINDS}
    for i, (text, want) in enumerate(plants):
        base = set(pii.base_spans(text))
        want = [x for x in want if x not in base]
        found = {(k, int(s), int(e)) for k, s, e in (x.split(":") for x in got[i].spans.split(",") if x)} - base
        for x in want:
            by_kind[x[0]][0] += x in found
            by_kind[x[0]][1] += 1
        hit, wanted, added = hit + len(found & set(want)), wanted + len(want), added + len(found)
    print("recall", hit / wanted, "precision", hit / added, by_kind)
    assert hit / wanted >= 0.9 and hit / added >= 0.95


def test_what_is_added_to_the_tables_is_personal_data(spark):
    """The tables hold few other spellings: cards beside other numbers, phones whose plus belongs to another number."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = pii.personal_data(docs).where("n_added > 0").join(docs.select("doc_id", "text"), "doc_id").collect()
    assert sum(r.n_added for r in rows) <= 10
    for r in rows:
        base = set(pii.base_spans(r.text))
        for k, s, e in (x.split(":") for x in r.spans.split(",")):
            if (k, int(s), int(e)) not in base:
                digits = "".join(c for c in r.text[int(s) : int(e)] if c.isdigit())
                assert (k == "card" and pii.luhn(digits)) or (k == "phone" and len(digits) in (10, 11)), r.text[int(s) : int(e)]


def test_a_field_over_a_long_text_takes_little_time():
    for text in ("+1 (743) 555-3824 " + "again 743-555-3824, " * 50_000, "4539148803436467 " * 60_000, "a (at) b.cd " * 90_000, "1 2 3 4 " * 130_000, "12.3.4.5 " * 110_000):
        began = time.monotonic()
        pii.added_spans(text, pii.base_spans(text), _field())
        assert time.monotonic() - began < 12, text[:40]
