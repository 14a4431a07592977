import base64
import random
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from folio.llm import language

from tests.llm.conftest import ODD


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    truth = {r.doc_id: r.lang for r in docs.collect()}
    got = language.identify(docs).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    held = [r for r in got if r.held_out]
    assert len(held) > 100 and np.mean([truth[r.doc_id] == r.lang_pred for r in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in got)
    assert sum(r.rejected for r in got) <= 3


def test_labels_of_held_out_documents_change_nothing(spark, documents):
    other = documents.withColumn("lang", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, "xx").otherwise(F.col("lang"))).withColumn("source", F.lit("?"))
    a, b = (sorted((r.doc_id, r.lang_pred, round(r.score, 9)) for r in language.identify(d).collect()) for d in (documents, other))
    assert a == b


def test_counts_against_brute_force():
    texts = ["Ab, c!!", "", "éé x", None, "zz"]
    for t, c in zip(texts, language.counts(pa.array(texts)), strict=True):
        kept = bytearray()
        for byte in (t or "").encode():
            x = byte + 32 if 65 <= byte <= 90 else byte
            x = x if 97 <= x <= 122 or x >= 128 else 32
            if not (x == 32 and kept and kept[-1] == 32):
                kept.append(x)
        assert c.sum() == max(0, len(kept) - 1) + max(0, len(kept) - 2)


def test_odd_rows(odd, none, documents):
    got = language.identify(odd.select("doc_id", "text", "lang").union(documents.select("doc_id", "text", "lang"))).collect()
    assert len(got) == len(ODD) + documents.count()
    assert sum(r.lang_pred == "und" for r in got) == sum(1 for r in ODD if not any(c.isalpha() for c in r[1] or ""))
    assert all(r.rejected and r.score == 0 for r in got if r.lang_pred == "und")
    assert language.identify(none).count() == 0
    assert {r.lang_pred for r in language.identify(odd.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_far_texts_are_rejected(spark, documents):
    far = spark.createDataFrame([(10**6, "机器学习是人工智能的一个分支。" * 20, None)], "doc_id long, text string, lang string")
    got = language.identify(documents.select("doc_id", "text", "lang").union(far)).where("doc_id = 1000000").first()
    assert got.rejected


ITALIAN = """Quel ramo del lago di Como, che volge a mezzogiorno, tra due catene non interrotte di monti, tutto a seni e
a golfi, a seconda dello sporgere e del rientrare di quelli, vien, quasi a un tratto, a ristringersi, e a prender corso e
figura di fiume, tra un promontorio a destra, e un'ampia costiera dall'altra parte; e il ponte, che ivi congiunge le due
rive, par che renda ancor più sensibile all'occhio questa trasformazione, e segni il punto in cui il lago cessa, e l'Adda
rincomincia, per ripigliar poi nome di lago dove le rive, allontanandosi di nuovo, lascian l'acqua distendersi e
rallentarsi in nuovi golfi e in nuovi seni. La costiera, formata dal deposito di tre grossi torrenti, scende appoggiata a
due monti contigui, l'uno detto di san Martino, l'altro, con voce lombarda, il Resegone, dai molti suoi cocuzzoli in
fila, che in vero lo fanno somigliare a una sega."""


def test_long_texts_of_no_learned_language_are_rejected_and_short_clean_ones_stay(spark):
    rng = random.Random(7)
    letters = "abcdefghijklmnopqrstuvwxyz"
    far = [" ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 9))) for _ in range(n)) for n in (100, 200, 2000)]
    far += [base64.b64encode(rng.randbytes(n)).decode() for n in (1100, 20_000)] + [ITALIAN]
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    rows = [(10**6 + i, t, None) for i, t in enumerate(far)]
    clean = [r for r in docs.where("length(text) > 400").orderBy("doc_id").collect() if len(set(r.text.split())) > 60][:200]
    rows += [(2 * 10**6 + 1000 * n + i, " ".join(r.text.split()[:n]), None) for n in (3, 8, 40) for i, r in enumerate(clean)]
    got = language.identify(docs.union(spark.createDataFrame(rows, "doc_id long, text string, lang string"))).where("doc_id >= 1000000").collect()
    assert [r.doc_id for r in got if r.doc_id < 2 * 10**6 and not r.rejected] == []
    assert sum(r.rejected for r in got if r.doc_id >= 2 * 10**6) <= 3


def _dimensions(text):
    """Counts of hashed grams, each gram hashed by itself from its bytes."""
    kept = bytearray()
    for byte in (text or "").encode():
        x = byte + 32 if 65 <= byte <= 90 else byte
        x = x if 97 <= x <= 122 or x >= 128 else 32
        if not (x == 32 and kept and kept[-1] == 32):
            kept.append(x)
    out: dict = {}
    for n in (2, 3):
        for i in range(len(kept) - n + 1):
            b = [*kept[i : i + n], 0]
            two = (b[0] * 0x9E3779B1 + b[1] * 0x85EBCA77) % 2**32
            h = ((two ^ (two >> 13)) * 0x165667B1) % 2**32
            if n == 3:
                three = ((two ^ (two >> 15)) * 0xC2B2AE3D + b[2] * 0x27D4EB2F) % 2**32
                h = ((three ^ (three >> 16)) * 0x9E3779B1) % 2**32
            out[h >> 20] = out.get(h >> 20, 0) + 1
    return out


def test_frequencies_and_predictions_against_brute_force(spark, documents):
    rows = [r for r in documents.orderBy("doc_id").limit(120).collect()]
    docs = spark.createDataFrame([(r.doc_id, r.text, r.lang) for r in rows], "doc_id long, text string, lang string")
    train = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 4 != 2 and r.text and r.lang and any(c.isalpha() for c in r.text)]
    model = language.fit(spark.createDataFrame([(r.doc_id, r.text, r.lang) for r in train], "doc_id long, text string, lang string"))
    frequency: dict = {}
    for r in train:
        for d in _dimensions(r.text):
            frequency[d] = frequency.get(d, 0) + 1
    idf = [np.log((1 + len(train)) / (1 + frequency.get(d, 0))) + 0.1 for d in range(language.DIMENSIONS)]
    assert np.allclose(model.idf, idf, atol=1e-5)
    assert np.allclose(np.linalg.norm(model.centroids, axis=1), 1, atol=1e-5)
    got = {r.doc_id: r for r in language.identify(docs).collect()}
    for r in rows:
        x = {d: np.log1p(c) * idf[d] for d, c in _dimensions(r.text).items()}
        norm = sum(v * v for v in x.values()) ** 0.5
        if not any(c.isalpha() for c in r.text or ""):
            assert got[r.doc_id].lang_pred == "und"
            continue
        near = [sum(v * float(c[d]) for d, v in x.items()) / norm for c in model.centroids]
        best = [max(s for s, o in zip(near, model.owner, strict=True) if o == k) for k in range(len(model.languages))]
        top = max(best)
        assert got[r.doc_id].lang_pred == model.languages[best.index(top)]
        assert abs(got[r.doc_id].score - 1 / sum(np.exp((b - top) / language.TEMPERATURE) for b in best)) < 1e-3


def test_clusters_fit_better_than_one_centroid():
    rng = np.random.default_rng(1)
    x = np.abs(rng.normal(size=(300, 20))) + np.repeat(np.eye(20)[[0, 5, 9]] * 9, 100, axis=0)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    one, three = (language.clusters(x, k, 5) for k in (1, 3))
    assert (x @ three.T).max(axis=1).mean() > (x @ one.T).max(axis=1).mean() + 0.1
