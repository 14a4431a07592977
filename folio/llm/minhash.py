"""Document fingerprints: MinHash signatures, and near duplicates from banded signatures.

A signature holds, for each of PERMUTATIONS universal hash functions x -> a*x + b modulo 2**64 (a
odd, so each permutes the 64-bit values), the leading bits of the least value over the word shingles
of a text. All functions run over all shingles of a text at once in numpy. Two texts' share of equal
values estimates the Jaccard similarity of their shingle sets.

Near duplicates: bands of the signatures are joined in Spark, each bucket as a star around its least
member, so a bucket of any size gives as many edges as rows; within what the edges connect, Jaccard
similarities are verified on the whole shingle sets.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.llm.common import shuffle_partitions, small_batches, written
from folio.llm.hashing import U64, shingle_sets, shingles, text_bytes, word_hashes, words
from folio.llm.jaccard_join import all_links, components
from folio.session import input_bytes

PERMUTATIONS, SHINGLE_WORDS, SEED = 128, 5, 11
#: Bits of a minimum that a signature keeps; two that differ agree in them once in 2**16.
KEPT_BITS = 16
NULL_ID = -(1 << 63)
#: Bytes of the input's files that a range of ids should have, and the most ranges.
PART_BYTES, MOST_PARTS = 16 << 20, 1 << 14


@lru_cache(maxsize=4)
def _functions(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    a = rng.integers(0, 1 << 63, n, dtype=np.uint64) * U64(2) + U64(1)
    return a[:, None], rng.integers(0, 1 << 63, n, dtype=np.uint64)[:, None]


def signature(values: np.ndarray, n: int = PERMUTATIONS, seed: int = SEED) -> np.ndarray:
    """The signature of a set of shingle hashes; of the empty set, a constant."""
    if not len(values):
        return np.full(n, (1 << KEPT_BITS) - 1, np.uint16)
    a, b = _functions(n, seed)
    least = np.full(n, np.iinfo(np.uint64).max, U64)
    for i in range(0, len(values), 512):  # blocks that stay in the cache
        block = values[None, i : i + 512] * a
        block += b
        np.minimum(least, block.min(axis=1), out=least)
    return (least >> U64(64 - KEPT_BITS)).astype(np.uint16)


def signatures(texts: list[str], k: int = SHINGLE_WORDS) -> tuple[list[np.ndarray], list[int]]:
    """Signatures and word counts of texts."""
    buf, offs = text_bytes(pa.array(texts, pa.large_string()))
    starts, ends, rows = words(buf, offs)
    hashes = word_hashes(buf, starts, ends)
    return [signature(shingles(hashes[a:b], k)) for a, b in zip(rows[:-1], rows[1:], strict=True)], np.diff(rows).tolist()


def likeness(a: np.ndarray, b: np.ndarray, empty_a: bool = False, empty_b: bool = False) -> float:
    """Share of equal values; 1 between two texts without words, 0 between one and another text."""
    return float(empty_a and empty_b) if empty_a or empty_b else float(np.mean(a == b))


def text_of(sig: np.ndarray) -> str:
    return sig.astype(">u2").tobytes().hex()


# ------------------------------------------------------------------ documents beside their next one
def _longs(values: list) -> Column:
    """A constant array of longs: one literal in the plan, however many they are."""
    return F.split(F.lit(",".join("" if v is None else str(v) for v in values)), ",").try_cast("array<bigint>")


def _above(cuts: list[int], key: Column) -> Column:
    """How many of the descending ``cuts`` lie above the key: counted in a coarse list, then in one stretch of the fine one."""
    if not cuts:
        return F.lit(0)
    step = max(1, int(len(cuts) ** 0.5))
    whole = F.size(F.filter(_longs(cuts[::step]), lambda c: c > key))
    start = F.greatest(whole - 1, F.lit(0)) * step
    return (start + F.size(F.filter(F.slice(_longs(cuts), start + 1, F.lit(step)), lambda c: c > key))).cast("int")


def with_next(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, str, str]:
    """Documents dealt by ranges of descending id, each range followed by the document after it.

    Rows have __part, __extra, doc_id, text, sorted. One shuffle moves each text once; the documents
    at range borders (one a range) go to two. Rows of one id are ordered by a hash of the text, and
    where an id has more rows than a range should hold, ranges of the hash divide them. There are as
    many ranges as shuffle partitions, or as the input has PART_BYTES, MOST_PARTS at most; only
    their borders reach the driver.
    """
    spark = docs.sparkSession
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID))
    keys = docs.select(key.alias("__key"))
    parts = min(MOST_PARTS, max(1, shuffle_partitions(spark), input_bytes(docs) // PART_BYTES))
    quantiles = [int(x) for x in keys.approxQuantile("__key", [i / parts for i in range(1, parts)], 1e-3 / 4)] if parts > 1 else []
    # A cut is the last id of its range. What several quantiles hit is divided by the hash, in ranges behind that one.
    times = Counter(quantiles)
    cuts = sorted(times, reverse=True)
    extra = [times[c] - 1 for c in cuts] + [0]
    first = [sum(1 + e for e in extra[:i]) for i in range(len(extra))]

    def place(key: Column, h: Column) -> Column:
        at = _above(cuts, key)
        more = F.get(_longs(extra), at)
        within = F.floor((F.shiftrightunsigned(h, 33).cast("double") / (1 << 31)) * more).cast("long") + 1
        on_cut = F.get(_longs([*cuts, None]), at).eqNullSafe(key) & (more > 0)
        return (F.get(_longs(first), at) + F.when(on_cut, within).otherwise(F.lit(0).cast("long"))).cast("int")

    base = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), key.alias("__key"))
    if any(extra):  # texts are hashed only where ids alone don't divide the rows
        base = base.withColumn("__h", F.xxhash64("text"))
    else:
        base = base.withColumn("__h", F.lit(0).cast("long"))
    # Unsigned order of the hash, as a signed number.
    base = base.withColumn("__h", F.col("__h").bitwiseXOR(F.lit(NULL_ID))).withColumn("__own", place(F.col("__key"), F.col("__h").bitwiseXOR(F.lit(NULL_ID))))
    heads = {r["__own"]: r["h"] for r in base.groupBy("__own").agg(F.max(F.struct("__key", F.bitwise_not("__h").alias("__i"))).alias("h")).collect()}
    # The first document of a range follows the last one of the range before it that has any; of the first range, of the last.
    full = sorted(heads)
    before = {p: full[i - 1] for i, p in enumerate(full)}
    count = len(cuts) + 1 + sum(extra)
    head_of, hash_of, also_to = (_longs([f(p) for p in range(count)]) for f in (lambda p: heads[p]["__key"] if p in heads else None, lambda p: ~heads[p]["__i"] if p in heads else None, before.get))
    own = F.struct(F.col("__own").alias("part"), F.lit(False).alias("extra"))
    copy = F.struct(F.get(also_to, F.col("__own")).cast("int").alias("part"), F.lit(True).alias("extra"))
    leads = (F.get(head_of, F.col("__own")) == F.col("__key")) & (F.get(hash_of, F.col("__own")) == F.col("__h"))
    copies = F.when(leads, F.array(own, copy)).otherwise(F.array(own))
    dealt = base.withColumn("__to", F.explode(copies)).select("doc_id", "text", "__key", "__h", F.col("__to.part").alias("__part"), F.col("__to.extra").alias("__extra"))
    ordered = dealt.repartitionById(count, F.col("__part")).sortWithinPartitions("__part", "__extra", F.desc("__key"), "__h", "text")
    return ordered, "__part", "__extra"


FINGERPRINTS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE_WORDS) -> DataFrame:
    """The fingerprint of each text and of its edited text, and how alike they are.

    The edited text: the last floor(n/2) code points are replaced by the first as many (or all) of
    the next document, by descending id (nulls last; ties by text, those of very frequent ids by its hash first); after the last comes the first. A
    null text is an empty one. Rows that repeat an id and a text are documents of their own, next to
    each other; of ties at a border the first counts. A text of fewer than k words is one shingle; one
    without words has a constant fingerprint, like only to others without words. An empty table gives
    an empty result; other columns are not read.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None  # the document that waits for its next one: part, id, text, signature, words
        closed: int | None = None  # the part whose last document has been given out
        for b in batches:
            for lo in range(0, len(b), 64):  # few texts at a time are held as Python strings
                piece = b.slice(lo, 64)
                parts, extras, ids, texts = (piece.column(c).to_pylist() for c in ("__part", "__extra", "doc_id", "text"))
                sigs, n_words = signatures(texts, k)
                todo: list[tuple[tuple, tuple]] = []
                for part, extra, doc_id, text, sig, n in zip(parts, extras, ids, texts, sigs, n_words, strict=True):
                    if part == closed:
                        continue
                    row = (part, doc_id, text, sig, n)
                    if held is not None and held[0] == part:
                        todo.append((held, row))
                    if extra:
                        held, closed = None, part
                    else:
                        held = row
                if todo:
                    edited = [t[: len(t) - len(t) // 2] + after[: len(t) // 2] for (_, _, t, _, _), (_, _, after, _, _) in todo]
                    esigs, e_words = signatures(edited, k)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([a[1] for a, _ in todo], pa.int64()),
                            pa.array([len(a[2]) for a, _ in todo], pa.int64()),
                            pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited]),
                            pa.array([text_of(a[3]) for a, _ in todo]),
                            pa.array([text_of(s) for s in esigs]),
                            pa.array([likeness(a[3], s, not a[4], not n) for (a, _), s, n in zip(todo, esigs, e_words, strict=True)]),
                            pa.array([likeness(a[3], z[3], not a[4], not z[4]) for a, z in todo]),
                        ],
                        names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
                    )

    ordered, _, _ = with_next(docs, id_col, text_col)
    return ordered.mapInArrow(run, FINGERPRINTS)


# ------------------------------------------------------------------ near duplicates
def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80, bands: int = 20, rows: int = 5, k: int = SHINGLE_WORDS) -> DataFrame:
    """One row per document: doc_id, class_id (the least id of its near-duplicate class), n_shingles.

    Signature bands are joined in Spark: each bucket gives a star around its least member, so a bucket
    of any size gives as many edges as rows. What the edges connect is a family; within it all sets
    are compared (by ``jaccard_join.links_of``, which splits families of any size), so a class lacks no
    link between two documents of a family: only pairs that share no band are missed, with probability
    (1 - s**rows)**bands for similarity s, 4e-4 at 0.8. Equal texts are one point. Null and empty
    texts, and those without words, are classes of their own. Rows that repeat an id have a row each.
    """
    small_batches(docs.sparkSession)
    source = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("doc_id"), F.xxhash64(text_col).alias("text_key"), F.col(text_col).alias("text"))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, point, banded = [], [], []
            for s in shingle_sets(b.column("text"), k):
                n.append(len(s))
                point.append(int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True))
                sig = signature(s)
                banded.append([int.from_bytes(hashlib.blake2b(bytes([i]) + sig[i * rows : (i + 1) * rows].tobytes(), digest_size=8).digest(), "little", signed=True) for i in range(bands)] if len(s) else [])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_key"), pa.array(n, pa.int64()), pa.array(point, pa.int64()), pa.array(banded, pa.list_(pa.int64()))], ["doc_id", "text_key", "n_shingles", "point", "bands"])

    told = written(source.mapInArrow(describe, "doc_id long, text_key long, n_shingles long, point long, bands array<long>"), "minhash-points")
    points = told.where("n_shingles > 0").groupBy("point").agg(F.min(F.struct("doc_id", "text_key")).alias("of"), F.first("bands").alias("bands"))
    points = points.select("point", F.col("of.doc_id").alias("id"), F.col("of.text_key").alias("text_key"), "bands")
    points = written(points, "minhash-distinct")
    buckets = points.select("point", F.explode("bands").alias("h"))
    least = buckets.groupBy("h").agg(F.min("point").alias("a"), F.count("*").alias("n")).where("n > 1").drop("n")
    edges = buckets.join(least, "h").where("point <> a").select("a", F.col("point").alias("b")).distinct()
    families = written(components(edges, "minhash-families"), "minhash-family-of").select("point", F.col("component").alias("family"))
    members = written(points.join(families, "point").select("point", "family", F.col("id").alias("doc_id"), "text_key"), "minhash-members")
    links = written(all_links(docs, members, percent, k, id_col, text_col), "minhash-links")
    linked = components(links, "minhash-components")
    named = points.select("point", "id").join(linked, "point", "left").withColumn("component", F.coalesce("component", "point"))
    classes = named.select("point", "component").join(named.groupBy("component").agg(F.min("id").alias("class_id")), "component").select("point", "class_id")
    own = told.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("point")).alias("point"))
    real = lambda c: F.when(F.col(c) != NULL_ID, F.col(c)).alias(c)
    some = own.where("n_shingles > 0").join(classes, "point").select(real("doc_id"), real("class_id"), "n_shingles")
    return some.unionByName(own.where("n_shingles = 0").select(real("doc_id"), real("doc_id").alias("class_id"), "n_shingles"))
