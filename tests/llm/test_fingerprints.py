import hashlib
import re

import pyarrow as pa

from folio.llm import minhash
from folio.llm.hashing import shingle_sets

from tests.llm.conftest import ODD


def _edited(texts):
    return [a[: len(a) - len(a) // 2] + b[: len(a) // 2] for a, b in zip(texts, texts[1:] + texts[:1], strict=True)]


def test_edited_texts_and_likeness(documents):
    got = {r.doc_id: r for r in minhash.fingerprints(documents).collect()}
    rows = sorted(documents.select("doc_id", "text").collect(), key=lambda r: -r.doc_id)
    texts = [r.text or "" for r in rows]
    assert len(got) == len(rows)
    off = []
    for r, t, e in zip(rows, texts, _edited(texts), strict=True):
        assert got[r.doc_id].edited_sha256 == hashlib.sha256(e.encode()).hexdigest()
        assert got[r.doc_id].n_chars == len(t)
        a, b = (_shingles(x) for x in (t, e))
        off.append(abs(got[r.doc_id].near_edited - len(a & b) / max(1, len(a | b))))
    assert sum(off) / len(off) < 0.05


def _shingles(t, k=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in w]
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} - {()}


def test_equal_texts_have_equal_fingerprints(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g"), (2, "x"), (3, "A b c d e f g"), (4, "")], "doc_id long, text string")
    got = {r.doc_id: r for r in minhash.fingerprints(docs).collect()}
    assert got[1].fingerprint == got[3].fingerprint != got[2].fingerprint
    assert got[4].near_next == 0.0


def test_odd_rows(odd, none):
    got = minhash.fingerprints(odd).collect()
    assert len(got) == len(ODD)
    ordered = sorted(((r[0] if r[0] is not None else -(1 << 63), r[1] or "") for r in ODD), key=lambda x: (-x[0], x[1]))
    want = sorted(hashlib.sha256(e.encode()).hexdigest() for e in _edited([t for _, t in ordered]))
    assert sorted(r.edited_sha256 for r in got) == want
    assert minhash.fingerprints(none).count() == 0


def test_one_document_is_next_to_itself(spark):
    got = minhash.fingerprints(spark.createDataFrame([(1, "abcd")], "doc_id long, text string")).collect()
    assert got[0].edited_sha256 == hashlib.sha256(b"abab").hexdigest() and got[0].near_next == 1.0


def test_near_duplicate_classes(spark):
    base = [f"w{i}" for i in range(200)]
    far = list(base)
    for i in range(0, 200, 25):
        far[i] = "x"  # from the first 40 / 236 shingles apart, one step from each neighbour
    rows = [(1, base), (2, [*base, "tail"]), (3, [f"v{i}" for i in range(200)]), (4, base), (6, base[:190]), (7, far)]
    docs = spark.createDataFrame([*((i, " ".join(w)) for i, w in rows), (5, None), (8, ""), (8, "")], "doc_id long, text string")
    got = sorted((r.doc_id, r.class_id) for r in minhash.near_duplicates(docs).collect())
    a, b = (_shingles(" ".join(w)) for w in (base, far))
    joined = len(a & b) / len(a | b) >= 0.8
    assert got == [(1, 1), (2, 1), (3, 3), (4, 1), (5, 5), (6, 1), (7, 1 if joined else 7), (8, 8), (8, 8)]


def test_near_duplicate_classes_of_the_table(spark):
    """The banded classes against the exact join of the same shingles and threshold."""
    from folio.llm.jaccard_join import jaccard_components

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id: r.class_id for r in minhash.near_duplicates(docs).collect()}
    want = {r.doc_id: r.component_id for r in jaccard_components(docs, 80, 5).collect()}
    assert sum(got[i] == want[i] for i in want) / len(want) > 0.998


def test_near_duplicates_of_odd_rows(odd, none):
    assert minhash.near_duplicates(odd).count() == len(ODD)
    assert minhash.near_duplicates(none).count() == 0


def test_a_frequent_id_is_divided(spark, monkeypatch):
    """A quarter of the rows has one id, another none: ranges of a hash divide them, and each still meets its next one."""
    monkeypatch.setattr(minhash, "shuffle_partitions", lambda spark: 16)
    rows = [(i, f"text {i} of some") for i in range(300)] + [(70, f"copy {i} under one id") for i in range(150)] + [(None, f"none {i}") for i in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    ordered, _, _ = minhash.with_next(docs, "doc_id", "text")
    ordered = ordered.collect()
    parts: dict = {}
    for r in ordered:
        parts.setdefault(r["__part"], []).append(r)
    own = [r for p in sorted(parts) for r in parts[p] if not r["__extra"]]
    assert sorted(((r.doc_id, r.text) for r in own), key=repr) == sorted(rows, key=repr)
    key = lambda r: minhash.NULL_ID if r.doc_id is None else r.doc_id
    assert [key(r) for r in own] == sorted((key(r) for r in own), reverse=True)
    assert sum(any(r.doc_id == 70 for r in p) for p in parts.values()) > 1
    nexts = {(r.doc_id, r.text): (z.doc_id, z.text) for r, z in zip(own, [*own[1:], own[0]], strict=True)}
    for p in parts.values():
        for a, z in zip(p, p[1:], strict=False):
            assert nexts[(a.doc_id, a.text)] == (z.doc_id, z.text)
    got = minhash.fingerprints(docs).collect()
    assert len(got) == len(rows)
    want = sorted(hashlib.sha256(e.encode()).hexdigest() for e in _edited([r.text for r in own]))
    assert sorted(r.edited_sha256 for r in got) == want


def test_fingerprints_against_a_plain_minhash(spark, documents):
    """Row by row: each function over each shingle, one number at a time, and the share of equal values."""
    a, b = (x[:, 0].tolist() for x in minhash._functions(minhash.PERMUTATIONS, minhash.SEED))
    rows = sorted((r for r in documents.select("doc_id", "text").collect() if len(r.text or "") < 1500), key=lambda r: -r.doc_id)[:12]
    docs = spark.createDataFrame([(r.doc_id, r.text) for r in rows] + [(-5, ""), (-6, None), (-7, "two words")], "doc_id long, text string")
    texts = [r.text or "" for r in sorted(docs.collect(), key=lambda r: -r.doc_id)]

    def plain(text):
        (found,) = shingle_sets(pa.array([text]), minhash.SHINGLE_WORDS)
        return [min((x * int(h) + y) % 2**64 for h in found) >> 48 for x, y in zip(a, b, strict=True)] if len(found) else [2**16 - 1] * len(a)

    def alike(s, t, x, y):
        if not s.split() or not t.split():
            return float(not s.split() and not t.split())
        return sum(u == v for u, v in zip(x, y, strict=True)) / len(x)

    got = [r for r in sorted(minhash.fingerprints(docs).collect(), key=lambda r: -r.doc_id)]
    own, edited = [plain(t) for t in texts], _edited(texts)
    for i, r in enumerate(got):
        changed = plain(edited[i])
        assert r.fingerprint == "".join(f"{v:04x}" for v in own[i]) and r.edited_fingerprint == "".join(f"{v:04x}" for v in changed)
        assert abs(r.near_edited - alike(texts[i], edited[i], own[i], changed)) < 1e-12
        assert abs(r.near_next - alike(texts[i], texts[(i + 1) % len(texts)], own[i], own[(i + 1) % len(texts)])) < 1e-12
