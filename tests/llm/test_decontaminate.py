import random
import re

import numpy as np

from folio.llm import decontaminate as D

from tests.llm.conftest import ODD


def _normal(t):
    return re.sub(r"[\W_]+", " ", t.lower()).strip()


def _words(rng, n):
    return " ".join("".join(rng.choice("aeiourstln") for _ in range(rng.randint(2, 8))) for _ in range(n))


def test_exact_items_in_the_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    bench = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet")
    items = {r.item_id: _normal(r.text) for r in bench.collect()}
    want = {(r.doc_id, i) for r in docs.collect() for i, t in items.items() if t in _normal(r.text)}
    got = {(r.doc_id, r.item_id) for r in D.leaks(docs, bench).collect()}
    assert want and got == want


def test_edited_items_within_the_budget(spark):
    rng = random.Random(3)
    items = [(i, _words(rng, 35)) for i in range(6)]
    docs, want = [], set()
    for n in range(60):
        i, item = items[n % 6]
        chars = list(item)
        for _ in range(rng.randint(0, D.budget(len(item)))):
            at = rng.randrange(len(chars))
            rng.choice([lambda: chars.pop(at), lambda: chars.insert(at, "x"), lambda: chars.__setitem__(at, "y")])()
        docs.append((n, f"{_words(rng, rng.randint(0, 60))}. {''.join(chars).upper() if n % 3 else ''.join(chars)}, {_words(rng, 30)}"))
        want.add((n, i))
    docs += [(1000 + n, _words(rng, 100) + " " + items[n % 6][1][:70] + " " + _words(rng, 50)) for n in range(10)]  # fragments are clean
    got = D.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want
    for r in got:
        a, b = _normal(docs[r.doc_id][1][r.start : r.end]), _normal(dict(items)[r.item_id])
        assert _distance(a, b) <= r.edits + 2 and r.edits <= D.budget(len(b))


def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(last + (x != y), row[j] + 1, row[j - 1] + 1)
    return row[-1]


def _best_stretch(item, text):
    row = [0] * (len(text) + 1)
    for i, x in enumerate(item, 1):
        new = [i]
        for j, y in enumerate(text, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_alignment_matches_the_full_matrix():
    rng = random.Random(5)
    for _ in range(150):
        item = "".join(rng.choice("abc") for _ in range(rng.randint(5, 25)))
        chars = list(item)
        for _ in range(rng.randint(0, 4)):
            at = rng.randrange(len(chars))
            rng.choice([lambda: chars.pop(at), lambda: chars.insert(at, "x"), lambda: chars.__setitem__(at, "y")])()
        before = "".join(rng.choice("xyz") for _ in range(rng.randint(0, 10)))
        text = before + "".join(chars) + "zzz"
        k = 6
        a, t = (np.frombuffer(x.encode(), np.uint8) for x in (item, text))
        got = D.align(a, t, len(before) - k, 2 * k, k)
        want = _best_stretch(item, text)
        assert (got is None) == (want > k)
        if got is not None:
            assert got[0] == want and _distance(item, text[got[1] : got[2]]) == want


def test_blocks_of_the_benchmark_meet_all_documents(spark, monkeypatch):
    monkeypatch.setattr(D, "BLOCK_BYTES", 400)
    rng = random.Random(8)
    items = [(i, _words(rng, 30)) for i in range(9)]
    docs = [(i, f"{_words(rng, 5)} {t} {_words(rng, 5)}") for i, t in items]
    got = D.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((r.doc_id, r.item_id) for r in got) == [(i, i) for i in range(9)]


def test_odd_rows(spark, odd, none):
    bench = spark.createDataFrame([(1, "naïve CAFÉ über done and over, once more"), (1, "naïve CAFÉ über done and over, once more"), (2, None), (3, ""), (4, "Zero one"), (5, "a text without an id of its own, long enough to be read"), (None, "Two lines three lines last of them")], "item_id long, text string")
    got = sorted((r.doc_id is not None, r.item_id or 0, r.edits) for r in D.leaks(odd, bench).collect())
    assert got == [(False, 5, 0), (True, 0, 0), (True, 0, 0)]
    assert D.leaks(odd, bench.limit(0)).count() == 0 and D.leaks(none, bench).count() == 0
    assert D.without_leaks(odd, bench).count() == len(ODD) - 5
