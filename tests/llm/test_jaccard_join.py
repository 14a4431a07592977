import random
import re

import numpy as np
import pytest

from folio.llm import jaccard_join as J

from tests.llm.conftest import ODD


def _sets(texts, k):
    out = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in w]
        out.append(frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else []))
    return out


def _brute(ids, sets, percent):
    top = {i: i for i in ids}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a in range(len(ids)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(ids[a]), find(ids[b])
                top[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def _chain(n, seed, size=300):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(4000)]
    base = [rng.choice(words) for _ in range(size)]
    out = []
    for i in range(n):
        text = list(base)
        for _ in range(rng.randint(0, 10)):
            text[rng.randrange(len(text))] = rng.choice(words)
        if i % 9 == 0:
            base = text
        out.append(" ".join(text))
    return out + [" ".join(rng.choice(words) for _ in range(rng.randint(1, 400))) for _ in range(20)]


@pytest.mark.parametrize(("k", "percent"), [(3, 90), (5, 80)])
def test_components_match_brute_force(spark, documents, k, percent):
    rows = documents.select("doc_id", "text").collect()
    sets = _sets([r.text for r in rows], k)
    want = _brute([r.doc_id for r in rows], sets, percent)
    got = {r.doc_id: r for r in J.jaccard_components(documents, percent, k).collect()}
    assert {i: r.component_id for i, r in got.items()} == want
    assert [got[r.doc_id].n_shingles for r in rows] == [len(s) for s in sets]


@pytest.mark.parametrize("bound", [1_500_000, 6000])
def test_families_of_near_copies(spark, monkeypatch, bound):
    """Also where a family is too large for a task and is split by broadcast pivots."""
    monkeypatch.setattr(J, "FAMILY_SHINGLES", bound)
    texts = _chain(90, 4)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in J.jaccard_components(docs).collect()}
    assert got == _brute(range(len(texts)), _sets(texts, 3), 90)


def test_long_sets_are_cut_in_parts(spark):
    texts = _chain(8, 7, size=6000)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in J.jaccard_components(docs).collect()}
    assert got == _brute(range(len(texts)), _sets(texts, 3), 90)


def test_voronoi_links_span_the_components():
    texts = _chain(150, 11)
    index: dict = {}
    sets = [np.sort(np.asarray([index.setdefault(x, len(index)) for x in s], np.uint64)) for s in _sets(texts, 3)]
    offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    links = J.voronoi_links(J.Sets(np.concatenate(sets), offsets), 90)
    top = list(range(len(texts)))
    for a, b in links:
        x, y = top[a], top[b]
        top = [min(x, y) if t in (x, y) else t for t in top]
    assert dict(enumerate(top)) == _brute(range(len(texts)), _sets(texts, 3), 90)


def test_block_links_are_exact(spark, monkeypatch):
    monkeypatch.setattr(J, "FAMILY_SHINGLES", 4000)
    texts = _chain(40, 5)
    index: dict = {}
    rows = [(1, i, sorted(index.setdefault(x, len(index)) for x in s)) for i, s in enumerate(_sets(texts, 3)) if s]
    links = J._block_links(spark.createDataFrame(rows, "family long, point long, values array<long>"), 90).collect()
    top = list(range(len(texts)))
    for r in links:
        x, y = top[r.a], top[r.b]
        top = [min(x, y) if t in (x, y) else t for t in top]
    assert dict(enumerate(top)) == _brute(range(len(texts)), _sets(texts, 3), 90)


def test_prefix_and_parts_lose_no_neighbour():
    rng = random.Random(2)
    for _ in range(200):
        n = rng.randint(1, 4000)
        a = {rng.getrandbits(62) for _ in range(n)}
        b = set(a)
        while 100 * len(a & b) >= 90 * len(a | b):
            last = set(b)
            b.add(rng.getrandbits(62)) if rng.random() < 0.5 else b.discard(next(iter(b)))
        b = last
        pa, pb = ({k: s for k, s in J.parts_of(np.sort(np.asarray(list(x), np.uint64)), 90)} for x in (a, b))
        hit = False
        for key in pa.keys() & pb.keys():
            x, y = (np.sort(p)[: J.prefix_length(len(p), 90)] for p in (pa[key], pb[key]))
            total = len(pa[key]) + len(pb[key])
            room = total - 2 * -(-90 * total // 190)
            hit = hit or (bool(set(x.tolist()) & set(y.tolist())) and J._bits(J.parity(pa[key]) ^ J.parity(pb[key])) <= room)
        assert hit


def test_odd_rows(odd, none):
    got = J.jaccard_components(odd).collect()
    assert len(got) == len(ODD)
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got if r.doc_id in (3, 4, 5)} == {(3, 0, 3), (4, 0, 4), (5, 0, 5)}
    assert next(r for r in got if r.doc_id == 6).n_shingles == 1
    assert [r.component_id for r in got if r.doc_id is None] == [None, None]
    assert J.jaccard_components(none).count() == 0


def test_keep_one(spark):
    base = " ".join(f"w{i}" for i in range(100))
    docs = spark.createDataFrame([(3, base), (1, base + " x"), (2, "other"), (4, None), (5, None)], "doc_id long, text string")
    assert sorted(r.doc_id for r in J.keep_one(docs, J.jaccard_components(docs, 80, 5)).collect()) == [1, 2, 4, 5]


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r.point: r.component for r in J.components(edges).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100}


def test_ids_that_repeat_with_other_texts(spark, monkeypatch):
    """Texts are points of their own under one id, or under none; and a point is not met once a row of its id."""
    texts = _chain(60, 21)
    ids = [None if i % 3 == 0 else 5 if i % 3 == 1 else i for i in range(len(texts))]
    docs = spark.createDataFrame(list(zip(ids, texts, strict=True)) + [(5, texts[1])] * 3, "doc_id long, text string")
    sets = _sets(texts, 3)
    parts = _brute(range(len(texts)), sets, 90)
    low = {}
    for i, p in parts.items():
        low[p] = min(low.get(p, 10**6), -1 if ids[i] is None else ids[i])
    want = sorted((-1 if i is None else i, len(s), low[parts[n]]) for n, (i, s) in enumerate(zip(ids, sets, strict=True)))
    want = sorted(want + [(5, len(sets[1]), low[parts[1]])] * 3)
    held = []
    links_of = J.links_of
    monkeypatch.setattr(J, "links_of", lambda sized, percent: (held.append((sized.count(), sized.select("point").distinct().count())), links_of(sized, percent))[1])
    got = J.jaccard_components(docs).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_shingles, -1 if r.component_id is None else r.component_id) for r in got) == want
    assert held and all(rows == points for rows, points in held)


def test_several_large_families_and_large_regions(spark, monkeypatch):
    """Families split in one pass, and regions that are stars because they outgrow comparison."""
    monkeypatch.setattr(J, "FAMILY_SHINGLES", 5000)
    monkeypatch.setattr(J, "REGION_ROWS", 10)
    texts = [*_chain(50, 4), *_chain(50, 21), *_chain(30, 33)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in J.jaccard_components(docs).collect()}
    assert got == _brute(range(len(texts)), _sets(texts, 3), 90)
