"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A document's features are its distinct words, pairs of neighbours and pairs one word apart, and the
beginnings of longer words, hashed to 2**FEATURE_BITS. FTRL-proximal keeps a learning rate for each coordinate and, by its L1 term, weights
that are mostly zero: what is broadcast for scoring is the few that aren't.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm.common import id_fold, small_batches, written
from folio.llm.hashing import NON_WORD, U64, mix, text_bytes, word_hashes, words

FEATURE_BITS = 20
#: Bytes of a word's beginning that are a feature as well, so that unseen forms of a word count, and the salt of its hash.
STEMS = {5: 0x51ED270B7F4A7C15, 7: 0x2545F4914F6CDD1D}
#: Labelled documents that the model is fitted on, at most (drawn by a hash of the id), and bytes of their features.
SAMPLE_DOCS, SAMPLE_BYTES = 12_000, 96 << 20
EPOCHS, ALPHA, BETA, L1, L2 = 4, 0.5, 1.0, 20.0, 1.0
#: How much more than others a toxic document counts: they are few.
TOXIC_WEIGHT = 3.0


def features(column: pa.Array) -> list[np.ndarray]:
    """The distinct feature numbers of each row."""
    buf, offs = text_bytes(column)
    starts, ends, rows = words(buf, offs, NON_WORD)
    hashes = word_hashes(buf, starts, ends)
    stems = []
    for n, salt in STEMS.items():
        long = ends - starts > n
        before = np.concatenate([[0], np.cumsum(long)])[rows]
        stems.append((mix(word_hashes(buf, starts[long], starts[long] + n) ^ U64(salt)), before))
    shift = U64(64 - FEATURE_BITS)
    out = []
    for r, (a, z) in enumerate(zip(rows[:-1], rows[1:], strict=True)):
        h = hashes[a:z]
        pair = mix(h[:-1] * U64(3) + h[1:] * U64(0x9E3779B97F4A7C15))
        skip = mix(h[:-2] * U64(5) + h[2:] * U64(0xC2B2AE3D27D4EB4F))
        out.append(np.unique(np.concatenate([h, pair, skip, *(x[at[r] : at[r + 1]] for x, at in stems)]) >> shift).astype(np.int32))
    return out


def train_ftrl(rows: list[np.ndarray], labels: np.ndarray, weight: float = TOXIC_WEIGHT, epochs: int = EPOCHS, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2, seed: int = 3) -> tuple[np.ndarray, float]:
    """Weights and bias by FTRL-proximal, one document at a time in seeded random order."""
    size = 1 << FEATURE_BITS
    z, n = np.zeros(size + 1), np.zeros(size + 1)  # the last coordinate is the bias, without L1
    rng = np.random.default_rng(seed)

    def weights(i: np.ndarray, zi: np.ndarray, ni: np.ndarray) -> np.ndarray:
        w = -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(ni)) / alpha + l2)
        w[np.abs(zi) <= l1] = 0
        w[i == size] = -zi[i == size] / ((beta + np.sqrt(ni[i == size])) / alpha)
        return w

    for _ in range(epochs):
        for d in rng.permutation(len(rows)):
            i = np.append(rows[d], size)
            zi, ni = z[i], n[i]
            w = weights(i, zi, ni)
            p = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35)))
            g = (p - labels[d]) * (weight if labels[d] else 1.0)
            grown = ni + g * g
            z[i] = zi + g - (np.sqrt(grown) - np.sqrt(ni)) / alpha * w
            n[i] = grown
    w = weights(np.arange(size + 1), z, n)
    return w[:-1].astype(np.float32), float(w[-1])


OUT = "doc_id long, held_out boolean, score double, predicted int"


def score_toxicity(docs: DataFrame, labels: DataFrame, fold: int = 0, folds: int = 5, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.

    Learns from labelled documents whose crc32(id as text) mod ``folds`` is not ``fold``; a null id is
    held out, a null label is none, of repeated labels of an id the largest counts. A null text is an
    empty one and scores the bias. Without labels, all scores are 0. Repeated rows have a row each.
    Other columns are not read.
    """
    spark = docs.sparkSession
    small_batches(spark, 500)
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.coalesce(id_fold(id_col, folds) == fold, F.lit(True)).alias("held_out"))
    marked = labels.where(F.col(label_col).isNotNull() & F.coalesce(id_fold(id_col, folds) != fold, F.lit(False))).groupBy(F.col(id_col).cast("long").alias("doc_id")).agg(F.max(label_col).alias("y"))
    known = marked.count()
    drawn = marked.where(F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(1_000_000)) < int(1_000_000 * min(1.0, SAMPLE_DOCS / max(1, known)))).limit(SAMPLE_DOCS + SAMPLE_DOCS // 10)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("y"), pa.array([f.astype("<i4").tobytes() for f in features(b.column("text"))], pa.binary())], ["doc_id", "y", "f"])

    joined = base.join(F.broadcast(drawn), "doc_id").select("doc_id", F.col("y").cast("double").alias("y"), "text")  # at most SAMPLE_DOCS ids
    sample = written(joined.mapInArrow(extract, "doc_id long, y double, f binary"), "toxicity-sample").withColumn("h", F.xxhash64("doc_id"))
    # In the order of the hash, as many as SAMPLE_BYTES hold: long texts make the sample smaller, not the driver larger.
    sizes = sorted((r["h"], r["n"]) for r in sample.select("h", F.octet_length("f").alias("n")).collect())
    kept = int(np.searchsorted(np.cumsum([n for _, n in sizes]), SAMPLE_BYTES, side="right"))
    if kept < len(sizes):
        sample = sample.where(F.col("h") < sizes[kept][0])
    sample = sample.orderBy("h", "doc_id")
    rows, y = [], []
    for r in sample.toLocalIterator():
        rows.append(np.frombuffer(r["f"], "<i4"))
        y.append(float(r["y"] > 0))
    model = train_ftrl(rows, np.asarray(y)) if rows else None
    if model is not None:
        hit = np.flatnonzero(model[0]).astype(np.int32)
        model = (hit, model[0][hit], model[1])
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        weight = np.zeros(1 << FEATURE_BITS, np.float32)
        if m is not None:
            weight[m[0]] = m[1]
        for b in batches:
            if m is None:
                score = np.zeros(len(b))
            else:
                raw = np.asarray([weight[f].sum(dtype=np.float64) for f in features(b.column("text"))]) + m[2]
                score = 1 / (1 + np.exp(-np.clip(raw, -35, 35)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(score, pa.float64()), pa.array((score >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return base.select("doc_id", "held_out", "text").mapInArrow(run, OUT)
