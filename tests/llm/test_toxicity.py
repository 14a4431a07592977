import re
import zlib

import numpy as np
import pyarrow as pa

from folio.llm import toxicity
from folio.llm.hashing import word_hashes

from tests.llm.conftest import ODD


def test_held_out_ranking(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    got = toxicity.score_toxicity(docs, labels).collect()
    assert len(got) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.5) for r in got)
    held = [(r.score, truth[r.doc_id]) for r in got if r.held_out and r.doc_id in truth]
    pos, neg = ([s for s, y in held if y == v] for v in (1, 0))
    assert np.mean([(p > n) + (p == n) / 2 for p in pos for n in neg]) > 0.95
    assert sum(s >= 0.5 for s in neg) <= 0.01 * len(neg)
    assert sum(s >= 0.5 for s in pos) >= 0.9 * len(pos)


def test_held_out_labels_change_nothing(spark, documents):
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    turned = labels.selectExpr("doc_id", "if(crc32(cast(cast(doc_id as string) as binary)) % 5 = 0, 1 - toxic, toxic) as toxic")
    a, b = (sorted((r.doc_id, r.score) for r in toxicity.score_toxicity(documents, x).collect()) for x in (labels, turned))
    assert a == b


def test_ftrl_is_sparse_and_separates():
    rng = np.random.default_rng(0)
    rows, y = [], []
    for _ in range(1500):
        toxic = rng.random() < 0.2
        rows.append(np.unique(np.append(rng.integers(1000, 200_000, 60), [7] if toxic else [])).astype(np.int32))
        y.append(float(toxic))
    w, b = toxicity.train_ftrl(rows, np.asarray(y))
    assert np.count_nonzero(w) < 200 and w[7] > 1
    assert np.mean([(w[r].sum() + b > 0) == (t > 0) for r, t in zip(rows, y, strict=True)]) > 0.99


def test_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, 1), (1, 0), (3, None), (None, 1), (77, 0)], "doc_id long, toxic int")
    got = toxicity.score_toxicity(odd, labels).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got)
    assert {r.score for r in toxicity.score_toxicity(odd, labels.limit(0)).collect()} == {0.0}
    assert toxicity.score_toxicity(none, labels).count() == 0


def _mix(x):
    x ^= x >> 30
    x = x * 0xBF58476D1CE4E5B9 % 2**64
    x ^= x >> 27
    x = x * 0x94D049BB133111EB % 2**64
    return x ^ (x >> 31)


def _hash(word):
    buf = np.frombuffer(word, np.uint8)
    return int(word_hashes(buf, np.asarray([0]), np.asarray([len(buf)]))[0])


def test_features_against_brute_force():
    texts = ["You stupid, STUPID clown!", "", None, "one", "réeuxaux! 12 achlichkeiten a-b_c", "x " * 50]
    for text, got in zip(texts, toxicity.features(pa.array(texts)), strict=True):
        words = re.findall(rb"[0-9A-Za-z\x80-\xff]+", (text or "").encode())
        h = [_hash(w) for w in words]
        want = set(h) | {_mix((a * 3 + b * 0x9E3779B97F4A7C15) % 2**64) for a, b in zip(h, h[1:], strict=False)}
        want |= {_mix((a * 5 + b * 0xC2B2AE3D27D4EB4F) % 2**64) for a, b in zip(h, h[2:], strict=False)}
        want |= {_mix(_hash(w[:n]) ^ salt) for n, salt in toxicity.STEMS.items() for w in words if len(w) > n}
        assert got.tolist() == sorted({x >> (64 - toxicity.FEATURE_BITS) for x in want}), text


def test_ftrl_against_brute_force():
    """One number at a time, in dictionaries: the same weights."""
    rng = np.random.default_rng(4)
    rows = [np.unique(rng.integers(0, 400, 12)).astype(np.int32) for _ in range(150)]
    y = np.asarray([float(3 in r or 17 in r or rng.random() < 0.1) for r in rows])
    alpha, beta, l1, l2, heavy = 0.5, 1.0, 0.4, 1.0, 3.0
    w, bias = toxicity.train_ftrl(rows, y, heavy, 3, alpha, beta, l1, l2, seed=8)
    z, n = {}, {}

    def weight(i):
        zi, ni = z.get(i, 0.0), n.get(i, 0.0)
        if i == "bias":
            return -zi / ((beta + ni**0.5) / alpha)
        return 0.0 if abs(zi) <= l1 else -(zi - (1 if zi > 0 else -1) * l1) / ((beta + ni**0.5) / alpha + l2)

    order = np.random.default_rng(8)
    for _ in range(3):
        for d in order.permutation(len(rows)):
            held = {i: weight(i) for i in [*rows[d].tolist(), "bias"]}
            p = 1 / (1 + np.exp(-sum(held.values())))
            g = (p - y[d]) * (heavy if y[d] else 1.0)
            for i, wi in held.items():
                sigma = ((n.get(i, 0.0) + g * g) ** 0.5 - n.get(i, 0.0) ** 0.5) / alpha
                z[i] = z.get(i, 0.0) + g - sigma * wi
                n[i] = n.get(i, 0.0) + g * g
    assert np.allclose(bias, weight("bias"))
    assert np.allclose(w[:400], [weight(i) for i in range(400)], atol=1e-5) and not w[400:].any()


def test_the_sample_is_bounded_in_bytes(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "SAMPLE_BYTES", 2000)
    seen = []
    train = toxicity.train_ftrl
    monkeypatch.setattr(toxicity, "train_ftrl", lambda rows, y, **kw: seen.append(sum(r.nbytes for r in rows)) or train(rows, y, **kw))
    docs = spark.createDataFrame([(i, f"some words {i} " * (i % 7)) for i in range(300)], "doc_id long, text string")
    got = toxicity.score_toxicity(docs, docs.selectExpr("doc_id", "doc_id % 2 as toxic")).collect()
    assert len(got) == 300 and 1000 < seen[0] <= 2000
