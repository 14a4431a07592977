"""Language identification: nearest centroid over TF-IDF vectors of byte n-grams.

A text's vector holds the hashed 2- and 3-grams of its letters (upper-case ASCII lowered, runs of
anything else one blank), log-scaled, weighted by inverse document frequency and normalised. Document
frequencies count every training document. Each language has several centroids, clusters of a bounded
sample of its documents; a text takes the language of the centroid with the largest cosine, unless it
is farther from it than a limit learned per language and number of distinct n-grams: the similarity of
prose rises with it, from 0.1 for a word to 0.9 for a page, and a text that repeats a word counts as short.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm.common import id_fold, small_batches, total_vector, vector_part, written
from folio.llm.hashing import LOWER, text_bytes

DIMENSIONS_BITS = 12
DIMENSIONS = 1 << DIMENSIONS_BITS
#: Documents of one language that its centroids are fitted on, and of all languages.
SAMPLE_PER_LANGUAGE, SAMPLE_ALL = 1500, 12_000
CLUSTERS, ROUNDS = 3, 8
#: A text is rejected below this share of the similarity that all but 1 in 1000 of the sample in its band reach.
REJECT_SHARE = 0.5
#: Bands of distinct n-grams (octaves), the least rows to learn a band's limit from (else with those of the
#: next lower bands), and the n-gram places at which sample texts are also cut, so that short texts are known.
BANDS, BAND_ROWS, CUTS = DIMENSIONS_BITS + 1, 30, (8, 24, 80, 240)
TEMPERATURE = 0.05

_MAP = LOWER.copy()
_MAP[:128][~((np.arange(128) >= 97) & (np.arange(128) <= 122)) & ~((np.arange(128) >= 65) & (np.arange(128) <= 90))] = 32


def grams(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed 2-grams and 3-grams at each byte, and the offsets of the rows.

    A row's grams may reach into the next row: count those of [start, end - 1) and [start, end - 2).
    """
    buf, offs = text_bytes(column)
    mapped = _MAP[buf]
    blank = mapped == 32
    keep = np.ones(len(mapped), bool)
    keep[1:] = ~(blank[1:] & blank[:-1])
    starts = offs[:-1][offs[:-1] < len(mapped)]
    keep[starts] = True
    at = np.concatenate([[0], np.cumsum(keep)])
    b = np.concatenate([mapped[keep], np.zeros(2, np.uint8)]).astype(np.uint32)
    two = b[:-2] * np.uint32(0x9E3779B1) + b[1:-1] * np.uint32(0x85EBCA77)
    three = (two ^ (two >> np.uint32(15))) * np.uint32(0xC2B2AE3D) + b[2:] * np.uint32(0x27D4EB2F)
    shift = np.uint32(32 - DIMENSIONS_BITS)
    two = (two ^ (two >> np.uint32(13))) * np.uint32(0x165667B1)
    three = (three ^ (three >> np.uint32(16))) * np.uint32(0x9E3779B1)
    return two >> shift, three >> shift, at[offs]


def counts(column: pa.Array, cut: int | None = None) -> Iterator[np.ndarray]:
    """The gram counts of each row, or of its first ``cut`` places; empty ones for rows of no more than that."""
    two, three, rows = grams(column)
    for a, z in zip(rows[:-1], rows[1:], strict=True):
        if cut is not None:
            z = a + cut if z - a > cut else a
        yield np.bincount(two[a : max(a, z - 1)], minlength=DIMENSIONS) + np.bincount(three[a : max(a, z - 2)], minlength=DIMENSIONS)


def vectors(column: pa.Array, idf: np.ndarray) -> np.ndarray:
    out = np.zeros((len(column), DIMENSIONS), np.float32)
    for i, c in enumerate(counts(column)):
        hit = np.flatnonzero(c)
        out[i, hit] = np.log1p(c[hit]) * idf[hit]
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.maximum(norm, 1e-12)


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    centroids: np.ndarray  # a row per centroid
    owner: np.ndarray  # the language of each
    limits: np.ndarray  # per language and band, the least similarity that is not rejected

    def predict(self, column: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Languages, scores (0 to 1) and whether the distance rejects, for each row."""
        x = vectors(column, self.idf)
        band = bands(np.count_nonzero(x, axis=1))
        near = x @ self.centroids.T
        by = np.stack([near[:, self.owner == i].max(axis=1) for i in range(len(self.languages))], axis=1)
        best = by.argmax(axis=1)
        top = by[np.arange(len(by)), best]
        score = 1 / np.exp((by - top[:, None]) / TEMPERATURE).sum(axis=1)
        return [self.languages[i] for i in best], score.astype(np.float64), top < self.limits[best, band]


def bands(distinct: np.ndarray) -> np.ndarray:
    """The band of each number of distinct n-grams."""
    return np.log2(np.maximum(distinct, 1)).astype(np.int64)


def band_limits(band: np.ndarray, near: np.ndarray) -> np.ndarray:
    """The limit of each band, from the bands and similarities of a language's sample."""
    out = []
    for b in range(BANDS):
        own = band == b
        for other in (*range(b - 1, -1, -1), *range(b + 1, BANDS)):
            if own.sum() >= BAND_ROWS:
                break
            own |= band == other
        out.append(REJECT_SHARE * float(np.quantile(near[own], 0.001)))
    return np.asarray(out)


def clusters(x: np.ndarray, k: int, seed: int) -> np.ndarray:
    """Unit centroids of spherical k-means."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(ROUNDS):
        home = (x @ c.T).argmax(axis=1)
        c = np.stack([x[home == i].mean(axis=0) if (home == i).any() else c[i] for i in range(len(c))])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c


def fit(train: DataFrame, seed: int = 5) -> Model | None:
    """Fit on ``train`` (text, lang, both not null; doc_id only to draw the sample); None if it is empty."""

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(DIMENSIONS + 1, np.int64)
        for b in batches:
            total[-1] += len(b)
            for c in counts(b.column("text")):
                total[:-1] += c > 0
        if total[-1]:
            yield vector_part(total)

    by_lang = {r["lang"]: r["n"] for r in train.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not by_lang:
        return None
    totals = total_vector(train.select("text").mapInArrow(frequencies, "lot int, v binary"), DIMENSIONS + 1, "int64")
    idf = np.log((1 + totals[-1]) / (1 + totals[:-1])).astype(np.float32) + np.float32(0.1)
    each = max(CLUSTERS, min(SAMPLE_PER_LANGUAGE, SAMPLE_ALL // len(by_lang)))
    share = F.create_map(*[F.lit(x) for lang, n in by_lang.items() for x in (lang, min(1.0, each / n))])
    drawn = train.where(F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1_000_000)) < 1_000_000 * F.element_at(share, F.col("lang")))

    def compact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for cut in (None, *CUTS):
                index, value = [], []
                for c in counts(b.column("text"), cut):
                    hit = np.flatnonzero(c)
                    index.append(hit.astype("<i2").tobytes())
                    value.append((np.log1p(c[hit]) * idf[hit]).astype("<f4").tobytes())
                yield pa.RecordBatch.from_arrays([b.column("lang"), pa.array([cut or 0] * len(b), pa.int32()), pa.array(index, pa.binary()), pa.array(value, pa.binary())], ["lang", "cut", "i", "v"])

    sample = written(drawn.select("text", "lang").limit(SAMPLE_ALL + len(by_lang) * 200).mapInArrow(compact, "lang string, cut int, i binary, v binary"), "language-sample")
    languages, centroids, owner, limits = [], [], [], []
    for lang in sorted(by_lang):
        own = sample.where(F.col("lang") == lang)
        rows = sorted(own.where("cut = 0").select("i", "v").limit(2 * each).collect())  # in one order for every run
        x = np.zeros((len(rows), DIMENSIONS), np.float32)
        for row, r in zip(x, rows, strict=True):
            row[np.frombuffer(r["i"], "<i2")] = np.frombuffer(r["v"], "<f4")
        norms = np.linalg.norm(x, axis=1, keepdims=True)
        x = x[norms[:, 0] > 0] / norms[norms[:, 0] > 0]
        if not len(x):
            continue
        c = clusters(x, CLUSTERS, seed)
        band, near = [bands(np.count_nonzero(x, axis=1))], [(x @ c.T).max(axis=1)]
        for r in own.where("cut > 0 and length(i) > 0").select("i", "v").limit(2 * each * len(CUTS)).collect():
            at, v = np.frombuffer(r["i"], "<i2"), np.frombuffer(r["v"], "<f4")
            band.append(bands(np.asarray([len(at)])))
            near.append(np.asarray([(c[:, at] @ v).max() / max(float(np.linalg.norm(v)), 1e-12)]))
        limits.append(band_limits(np.concatenate(band), np.concatenate(near)))
        owner += [len(languages)] * len(c)
        languages.append(lang)
        centroids.append(c)
    return Model(languages, idf, np.concatenate(centroids), np.asarray(owner), np.asarray(limits)) if languages else None


OUT = "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean"


def identify(docs: DataFrame, fold: int = 2, folds: int = 4, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", key_col: str | None = None) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score, rejected, and key_col (a long) if it is named.

    Learns from documents with text and language whose crc32(id as text) mod ``folds`` is not
    ``fold``; a null id is held out. ``und`` (score 0, rejected) is given to null texts, texts without
    a letter, and all texts if there is nothing to learn from. ``rejected`` marks texts whose distance
    to every centroid is beyond the limit of the nearest one's language for texts of as many n-grams. Repeated rows have a row each.
    Other columns are not read.
    """
    spark = docs.sparkSession
    small_batches(spark, 500)
    out_of = F.coalesce(id_fold(id_col, folds) == fold, F.lit(True))
    keys = [] if key_col is None else [key_col]
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), out_of.alias("held_out"), *keys)
    lettered = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    model = fit(base.where(~F.col("held_out") & F.col("lang").isNotNull() & lettered).select("doc_id", "text", "lang"))
    shared = spark.sparkContext.broadcast(model)  # centroids: languages * CLUSTERS * DIMENSIONS floats

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            n = len(b)
            if m is None:
                langs, score, far = ["und"] * n, np.zeros(n), np.ones(n, bool)
            else:
                langs, score, far = m.predict(b.column("text"))
                for i, letter in enumerate(b.column("lettered").to_pylist()):
                    if not letter:
                        langs[i], score[i], far[i] = "und", 0.0, True
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(langs), pa.array(score), pa.array(far), *(b.column(c) for c in keys)], ["doc_id", "held_out", "lang_pred", "score", "rejected", *keys])

    return base.select("doc_id", "held_out", lettered.alias("lettered"), "text", *keys).mapInArrow(run, OUT + "".join(f", {c} long" for c in keys))
