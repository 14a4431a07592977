"""N-gram Jaccard join: exact, by pivots, regions and triangle-inequality windows.

Documents are points of a metric space: sets of hashed word shingles under the Jaccard distance.
Most texts share no shingle with most others, so all their distances are 1, to any pivot document
too; there no pivot tells them apart. The join therefore recurses over two kinds of pivots:

1. Coarse regions. Single shingles are the pivots. All shingles have one order, the rarer first, and
   a document's region is that of its first pivot. Two sets with similarity t or more differ so
   little that their first pivots lie within the first n - ceil(t*n) + 1 of each: that window copies
   a document into the regions in which a neighbour can be at home. Long sets are first cut in parts
   by hash: of two similar sets, one pair of parts at least is as similar. A region whose members are all
   apart (by a sketch that never exceeds the true difference) falls to pieces at once; what hangs
   together, over all regions, is a family. No link leaves a family.
2. Voronoi regions. In a family distances vary. Each point goes to the region of its nearest pivot
   document; by the triangle inequality a neighbour within r of x can be at home only with a pivot q
   for which d(x, q) <= d(x, nearest) + 2r, so x is copied there too. Points far from all pivots form
   one region, with those that are less than r nearer. Points within r of a pivot are linked to it. A
   region joins recursively, until all its points hang together, or are so few, or so much alike in
   their distances, that the rest is compared directly. Families too large for one task are split by
   the same step with broadcast pivots, as often as needed.

Equal sets are one point. Results are links that connect whatever the join would connect (a spanning
set of the links, each verified on whole sets), and the components that they make.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm.common import row_key, small_batches, without, written
from folio.llm.hashing import U64, mix, shingle_sets, shingles, text_bytes, word_hashes, words

SHINGLE_WORDS, PERCENT = 3, 90
#: Counters of the shingle-frequency sketch, and blocks in which partial counts travel.
SKETCH_BITS, SKETCH_BLOCKS = 21, 64
#: Longs of a part's parity sketch.
PARITY_WORDS = 8
#: Members of a coarse region that are compared by sketches (seconds of work); a larger one hangs together as a whole.
REGION_ROWS = 20_000
#: Shingles of a family that one task joins; pivots a split takes.
FAMILY_SHINGLES, SPLIT_PIVOTS = 1_500_000, 8
#: Distance from which a point is far from a pivot. Points far from all pivots share one region: by the
#: nearest of several that have nothing in common with it, a point would lie in all their windows.
FAR = 0.5
#: Points that are compared directly; how often a step may copy points before it is given up for that.
LEAF, SPREAD = 12, 1.4
#: Bytes of the table of family members up to which it is broadcast to the scan of the texts.
BROADCAST_BYTES = 8 << 20


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


# ------------------------------------------------------------------ frequencies, for the order of pivots
def frequency_levels(docs: DataFrame, k: int, text_col: str) -> bytes:
    """log2 of the counts of hashed shingles over all documents, a byte a counter (a few MB in all).

    Partial counts are added up in two steps, so that no task gathers those of all partitions. The
    levels only order pivots: any order gives the same links.
    """
    size, block = 1 << SKETCH_BITS, (1 << SKETCH_BITS) // SKETCH_BLOCKS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.uint32)
        for b in batches:
            buf, offs = text_bytes(b.column("text"))
            starts, ends, rows = words(buf, offs)
            hashes = word_hashes(buf, starts, ends)
            found = [shingles(hashes[x:y], k) for x, y in zip(rows[:-1], rows[1:], strict=True) if y > x]
            if found:
                total += np.bincount((np.concatenate(found) >> U64(64 - SKETCH_BITS)).astype(np.int64), minlength=size).astype(np.uint32)
        if total.any():
            lot = int(np.random.default_rng().integers(256))
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(SKETCH_BLOCKS), pa.int32()), pa.array([lot] * SKETCH_BLOCKS, pa.int32()), pa.array([zlib.compress(total[i * block : (i + 1) * block].tobytes(), 1) for i in range(SKETCH_BLOCKS)], pa.binary())],
                ["block", "lot", "counts"],
            )

    def add(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(block, np.uint64)
        for b in batches:
            for c in b.column("counts"):
                part = zlib.decompress(c.as_py())
                total += np.frombuffer(part, np.uint32)
        kept = np.minimum(total, np.iinfo(np.uint32).max).astype(np.uint32)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([0], pa.int32()), pa.array([zlib.compress(kept.tobytes(), 1)], pa.binary())], ["block", "lot", "counts"])

    schema = "block int, lot int, counts binary"
    parts = docs.select(F.col(text_col).alias("text")).mapInArrow(count, schema)
    sums = parts.groupBy("block", "lot").applyInArrow(add, schema).groupBy("block").applyInArrow(add, schema)
    levels = np.zeros(size, np.uint8)
    for r in sums.collect():
        counts = np.frombuffer(zlib.decompress(r["counts"]), np.uint32)
        levels[r["block"] * block : (r["block"] + 1) * block] = np.ceil(np.log2(counts.astype(np.float64) + 1))
    return levels.tobytes()


# ------------------------------------------------------------------ sets
def _signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def parity(s: np.ndarray) -> np.ndarray:
    """PARITY_WORDS longs: the parities of how many elements fall in each of their bits.

    Two sets' sketches differ in at most as many bits as the sets differ in elements.
    """
    bits = np.bincount((s & U64(64 * PARITY_WORDS - 1)).astype(np.int64), minlength=64 * PARITY_WORDS) & 1
    return np.packbits(bits.astype(np.uint8)).view(U64)


def part_size(percent: int) -> int:
    """Elements that a part should have: similar ones then differ in fewer bits of their sketches than
    unrelated ones, which differ in about half."""
    return max(64, int(0.37 * 64 * PARITY_WORDS * (100 + percent) / (2 * (100 - percent)))) if percent < 100 else 1 << 30


def part_counts(n: int, percent: int) -> list[int]:
    """Into how many parts a set of n is cut (powers of two): as its own size and as that of the largest neighbour asks."""
    most = part_size(percent)
    own = [1 << max(0, (size - 1) // most).bit_length() for size in (n, 100 * n // percent)]
    return sorted({*own, *(1 << i for i in range(own[0].bit_length(), own[1].bit_length() - 1))})


def parts_of(s: np.ndarray, percent: int) -> Iterator[tuple[int, np.ndarray]]:
    """(part, its elements) of a set; equal part numbers of two sets are cut alike."""
    if not len(s):
        return
    for m in part_counts(len(s), percent):
        home = (mix(s) >> U64(20)) & U64(m - 1)
        for j in np.unique(home) if m > 1 else [0]:
            yield (m << 32) + int(j), s[home == U64(j)] if m > 1 else s


POINT = "doc_id long, text_key long, n long, s1 long, s2 long, parts array<struct<part: long, n: long, parity: array<long>, pivots: array<long>>>"


def document_sets(docs: DataFrame, levels: bytes, k: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text_key, n, s1, s2, parts): a digest of the text, size and digest of each document's set, and the pivot windows of its parts."""
    sc = docs.sparkSession.sparkContext
    shared = sc.broadcast(levels)  # 2**SKETCH_BITS bytes
    part_type = pa.list_(pa.struct([("part", pa.int64()), ("n", pa.int64()), ("parity", pa.list_(pa.int64())), ("pivots", pa.list_(pa.int64()))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = np.frombuffer(shared.value, np.uint8)
        for b in batches:
            n, s1, s2, offs = [], [], [], [0]
            part, size, parities, pivots = [], [], [], []
            for s in shingle_sets(b.column("text"), k):
                n.append(len(s))
                s1.append(int(_signed((s * U64(0x9E3779B97F4A7C15) ^ (s >> U64(29))).sum(keepdims=True))[0]) if len(s) else 0)
                s2.append(int(_signed(np.bitwise_xor.reduce(s * (s | U64(1)), keepdims=True))[0]) if len(s) else 0)
                for key, own in parts_of(s, percent):
                    order = np.lexsort((own, level[(own >> U64(64 - SKETCH_BITS)).astype(np.int64)]))[: prefix_length(len(own), percent)]
                    part.append(key)
                    size.append(len(own))
                    parities.append(parity(own))
                    # A pivot belongs to one way of cutting.
                    pivots.append(mix(own[order] ^ U64(key >> 32)))
                offs.append(len(part))
            lengths = np.concatenate([[0], np.cumsum([len(p) for p in pivots])]).astype(np.int32)
            fields = [
                pa.array(part, pa.int64()),
                pa.array(size, pa.int64()),
                pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1, dtype=np.int32) * PARITY_WORDS), pa.array(_signed(np.concatenate([np.zeros(0, U64), *parities])))),
                pa.ListArray.from_arrays(pa.array(lengths), pa.array(_signed(np.concatenate([np.zeros(0, U64), *pivots])))),
            ]
            parts = pa.ListArray.from_arrays(pa.array(offs, pa.int32()), pa.StructArray.from_arrays(fields, fields=list(part_type.value_type)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_key"), pa.array(n, pa.int64()), pa.array(s1, pa.int64()), pa.array(s2, pa.int64()), parts], ["doc_id", "text_key", "n", "s1", "s2", "parts"])

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("text_key"), F.col(text_col).alias("text"))
    return source.mapInArrow(run, POINT)


# ------------------------------------------------------------------ coarse regions
def repeated_pivots(points: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pivot, point, part) of pivots that several points have in a part's window, and (a, b): edges of large regions.

    A region of more than REGION_ROWS rows is not compared: it hangs together as a whole, as a star
    around its least point. That is a join of rows with one row a pivot, which Spark may split; only
    the others are gathered by pivot.
    """
    rows = points.select("point", F.explode("parts").alias("p")).select(F.explode("p.pivots").alias("pivot"), "point", "p.part")
    held = rows.groupBy("pivot").agg(F.count("*").alias("__n"), F.min("point").alias("__least")).where(F.col("__n") > REGION_ROWS)
    large = written(held, "large-regions")
    if large.isEmpty():
        few, edges = rows, None
    else:
        edges = rows.join(large, "pivot").where("point <> __least").select(F.col("__least").alias("a"), F.col("point").alias("b"))
        few = rows.join(large, "pivot", "left_anti")
    dealt = few.repartition("pivot").sortWithinPartitions("pivot")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # the row before, and whether it has been given out
        for b in batches:
            pivot = b.column("pivot").to_numpy()
            if not len(pivot):
                continue
            keep = np.zeros(len(pivot), bool)
            same = pivot[1:] == pivot[:-1]
            keep[1:] |= same
            keep[:-1] |= same
            if last is not None and last[0].column("pivot")[0].as_py() == pivot[0]:
                keep[0] = True
                if not last[1]:
                    yield last[0]
            yield b.filter(pa.array(keep))
            last = (b.slice(len(b) - 1, 1), bool(keep[-1]))

    return dealt.mapInArrow(run, "pivot long, point long, part long"), edges


def _bits(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).sum(axis=-1)


def _region_edges(points: np.ndarray, n: np.ndarray, sketch: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges that span the parts of a region that hang together: points whose sizes and sketches allow a link."""
    m = len(points)
    if m > REGION_ROWS:
        return np.full(m - 1, points[0]), points[1:]
    order = np.argsort(n, kind="stable")
    points, n, sketch = points[order], n[order], sketch[order]
    part = np.arange(m)
    a_out, b_out = [], []
    for i in range(m - 1):
        j = int(np.searchsorted(n, (100 * n[i]) // percent, side="right"))
        others = np.flatnonzero(part[i + 1 : j] != part[i]) + i + 1  # the rest hangs together with it already
        if not len(others):
            continue
        total = n[i] + n[others]
        room = total - 2 * -(-percent * total // (100 + percent))  # most elements that may differ
        near = others[_bits(sketch[others] ^ sketch[i]) <= room]
        found, first = np.unique(part[near], return_index=True)
        if len(found):
            a_out += [points[i]] * len(found)
            b_out += points[near[first]].tolist()
            part[np.isin(part, found)] = part[i]
    return np.asarray(a_out, np.int64), np.asarray(b_out, np.int64)


def family_edges(members: DataFrame, percent: int) -> DataFrame:
    """(a, b): edges over points of which no link leaves the parts. Rows: pivot, point, n, parity."""
    dealt = members.repartition("pivot").sortWithinPartitions("pivot")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        whole: int | None = None  # the first point of a region that outgrew comparison

        def close(parts: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
            p, n, s = (np.concatenate([x[i] for x in parts]) for i in (1, 2, 3))
            return _region_edges(p, n, s, percent) if len(p) > 1 else (np.zeros(0, np.int64), np.zeros(0, np.int64))

        for b in batches:
            pivot, point, n = (b.column(c).to_numpy() for c in ("pivot", "point", "n"))
            if not len(pivot):
                continue
            sketch = b.column("parity").flatten().to_numpy().view(U64).reshape(len(pivot), PARITY_WORDS)
            cuts = np.flatnonzero(pivot[1:] != pivot[:-1]) + 1
            out_a, out_b = [], []
            for lo, hi in zip([0, *cuts], [*cuts, len(pivot)], strict=True):
                if held and held[0][0] != pivot[lo]:
                    x, y = close(held)
                    out_a.append(x)
                    out_b.append(y)
                    held, whole = [], None
                if whole is not None:
                    out_a.append(np.full(hi - lo, whole))
                    out_b.append(point[lo:hi])
                    continue
                held.append((pivot[lo], point[lo:hi], n[lo:hi], sketch[lo:hi]))
                if sum(len(h[1]) for h in held) > REGION_ROWS:
                    x, y = close(held)
                    out_a.append(x)
                    out_b.append(y)
                    whole = int(held[0][1][0])
                    held = [(pivot[lo], held[0][1][:1], held[0][2][:1], held[0][3][:1])]
            if out_a and sum(map(len, out_a)):
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_a), pa.int64()), pa.array(np.concatenate(out_b), pa.int64())], ["a", "b"])
        if held:
            x, y = close(held)
            if len(x):
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())], ["a", "b"])

    return dealt.mapInArrow(run, "a long, b long").distinct()


# ------------------------------------------------------------------ components
def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(point, component: the least point reachable) of every point of ``edges`` (a, b).

    Alternating large-star and small-star steps until nothing changes; each step is a table in the
    shared folder. The driver sees counts and checksums only.
    """
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), name)
    said = None
    while True:
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        now = written(small, name)
        state = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == said:
            break
        said = state
    return now.select(F.col("u").alias("point"), F.col("v").alias("component")).union(now.select(F.col("v").alias("point"), F.col("v").alias("component")).distinct())


# ------------------------------------------------------------------ Voronoi regions
class Sets:
    """Sets as one array of sorted hashes with offsets; distances to one of them are vectorised."""

    def __init__(self, values: np.ndarray, offsets: np.ndarray):
        self.values, self.offsets, self.n = values, offsets, np.diff(offsets)

    def overlap(self, one: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Sizes of the intersections of ``one`` with the sets of ``rows``."""
        if len(rows) == len(self.n):
            values, sizes = self.values, self.n
        else:
            sizes = self.n[rows]
            starts = np.repeat(self.offsets[rows] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes)
            values = self.values[starts + np.arange(len(starts))]
        at = np.searchsorted(one, values)
        hit = np.zeros(len(values) + 1, np.int64)
        np.cumsum(one[np.minimum(at, len(one) - 1)] == values, out=hit[1:])
        ends = np.cumsum(sizes)
        return hit[ends] - hit[ends - sizes]

    def set_of(self, i: int) -> np.ndarray:
        return self.values[self.offsets[i] : self.offsets[i + 1]]


def voronoi_links(sets: Sets, percent: int, seed: int = 0) -> list[tuple[int, int]]:
    """Links that span the components of the join over ``sets``, each verified exactly."""
    radius = 1 - percent / 100
    top = np.arange(len(sets.n))
    links: list[tuple[int, int]] = []

    def find(x: int) -> int:
        while top[x] != x:
            top[x] = top[top[x]]
            x = top[x]
        return int(x)

    def link(i: int, j: int) -> None:
        u, v = find(i), find(j)
        if u != v:
            top[max(u, v)] = min(u, v)
            links.append((i, j))

    def distances(i: int, rows: np.ndarray) -> np.ndarray:
        """To set i; links what is near enough, by exact arithmetic of integers."""
        both = sets.overlap(sets.set_of(i), rows)
        union = sets.n[i] + sets.n[rows] - both
        for j in rows[100 * both >= percent * union]:
            if j != i:
                link(i, int(j))
        return 1 - both / union

    def direct(rows: np.ndarray) -> None:
        """Compare all of ``rows`` by counting in lists of who has a shingle."""
        m = len(rows)
        n = sets.n[rows]
        _, ids = np.unique(np.concatenate([sets.set_of(int(r)) for r in rows]), return_inverse=True)
        owner = np.repeat(np.arange(m), n)
        order = np.argsort(ids, kind="stable")
        holders, first = owner[order], np.concatenate([[0], np.cumsum(np.bincount(ids))])
        ends = np.cumsum(n)
        part = np.asarray([find(int(r)) for r in rows])
        for i in range(m):
            if (part == part[i]).all():
                return
            own = ids[ends[i] - n[i] : ends[i]]
            times = first[own + 1] - first[own]
            at = np.repeat(first[own] - np.cumsum(times) + times, times) + np.arange(int(times.sum()))
            both = np.bincount(holders[at], minlength=m)
            for j in np.flatnonzero((100 * both >= percent * (n[i] + n - both)) & (part != part[i])):
                if part[j] != part[i]:
                    link(int(rows[i]), int(rows[j]))
                    part[part == part[j]] = part[i]

    rng = np.random.default_rng(seed)
    stack = [(np.arange(len(sets.n)), 0)]
    while stack:
        rows, depth = stack.pop()
        if len({find(int(r)) for r in rows}) < 2:
            continue  # all hang together: nothing to find
        if len(rows) <= LEAF or depth > 40:
            direct(rows)
            continue
        pivots = rng.choice(rows, min(4 if depth < 6 else 2, len(rows)), replace=False)
        d = np.stack([distances(int(p), rows) for p in pivots])
        home = d.argmin(axis=0)
        near = d.min(axis=0)
        open_ = ~np.isin(rows, pivots)  # a pivot has met every row of this region: it goes on with none of them
        cells = [rows[open_ & (near >= FAR - radius - 1e-9)]]
        for q in range(len(pivots)):
            cells.append(rows[open_ & (near < FAR) & ((home == q) | (d[q] <= near + 2 * radius + 1e-9))])
        if sum(map(len, cells)) > SPREAD * len(rows):
            direct(rows[open_])  # distances vary too little: pivots would only multiply the work
            continue
        stack += [(c, depth + 1) for c in cells if len(c) > 1]
    return links


def _sets_of(table: pa.Table) -> tuple[np.ndarray, Sets]:
    points = table.column("point").to_numpy()
    column = table.column("values").combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = column.chunk(0) if column.num_chunks else pa.array([], pa.list_(pa.int64()))
    offsets = column.offsets.to_numpy().astype(np.int64)
    values = column.values.to_numpy()[offsets[0] : offsets[-1]].view(U64)
    return points, Sets(values, offsets - offsets[0])


def family_links(sized: DataFrame, percent: int) -> DataFrame:
    """(a, b): spanning links of each family. Rows: family, point, values."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        points, sets = _sets_of(table)
        found = voronoi_links(sets, percent)
        a, b = (np.asarray([points[x[i]] for x in found], np.int64) for i in (0, 1))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return sized.groupBy("family").applyInArrow(run, "a long, b long")


def split_families(rows: DataFrame, sizes: DataFrame, percent: int, depth: int) -> tuple[DataFrame, DataFrame]:
    """Families that are too large for one task, all split by pivots in one pass: (links, rows of the regions).

    Rows: family, point, values; ``sizes``: family, __blocks (how many tasks share its rows). A family's
    pivots are the least points, by a hash, of SPLIT_PIVOTS buckets, found with partial aggregates.
    Each block of its rows meets them all, and notes in bits which ones a row links to and in which
    ones' regions or windows it lies. The distinct notes of a family, at most 2**SPLIT_PIVOTS, tell
    which pivots hang together. A region whose points all hang together already ends here.
    """
    order = F.xxhash64("point", F.lit(depth))
    first = rows.groupBy("family", F.pmod(order, F.lit(SPLIT_PIVOTS)).alias("bucket")).agg(F.min_by(F.struct("point", "values"), F.struct(order, "point")).alias("p"))
    pivots = written(first.select("family", "bucket", F.col("p.point").alias("point"), F.col("p.values").alias("values")), "pivots")
    radius = 1 - percent / 100
    schema = "family long, point long, linked int, cells int, pivot boolean, values array<long>"

    def run(own: pa.Table, chosen: pa.Table) -> pa.Table:
        if not own.num_rows:
            return pa.table({"family": pa.array([], pa.int64()), "point": pa.array([], pa.int64()), "linked": pa.array([], pa.int32()), "cells": pa.array([], pa.int32()), "pivot": pa.array([], pa.bool_()), "values": pa.array([], pa.list_(pa.int64()))})
        chosen = chosen.sort_by("bucket")
        names, heads = _sets_of(chosen)
        points, sets = _sets_of(own)
        d, linked = np.ones((SPLIT_PIVOTS, len(points))), np.zeros(len(points), np.int32)
        for i, q in enumerate(chosen.column("bucket").to_pylist()):
            p = heads.set_of(i)
            both = sets.overlap(p, np.arange(len(points)))
            union = len(p) + sets.n - both
            d[q] = 1 - both / union
            linked |= (100 * both >= percent * union).astype(np.int32) << q
        near = d.min(axis=0)
        windows = (d <= near + 2 * radius + 1e-9) & (near < FAR)
        windows = np.concatenate([windows, (near >= FAR - radius - 1e-9)[None]])  # the last region: far from all
        cells = (windows * (1 << np.arange(len(windows), dtype=np.int32))[:, None]).sum(axis=0).astype(np.int32)
        return pa.table({"family": own.column("family"), "point": own.column("point"), "linked": pa.array(linked), "cells": pa.array(cells), "pivot": pa.array(np.isin(points, names)), "values": own.column("values")})

    dealt = rows.join(sizes.select("family", "__blocks"), "family").withColumn("__block", F.pmod(F.xxhash64("point", F.lit(7)), F.col("__blocks")).cast("int"))
    met_by = pivots.join(sizes.select("family", "__blocks"), "family").withColumn("__block", F.explode(F.sequence(F.lit(0), F.col("__blocks") - 1)))
    left, right = dealt.select("family", "__block", "point", "values").groupBy("family", "__block"), met_by.select("family", "__block", "bucket", "point", "values").groupBy("family", "__block")
    out = written(left.cogroup(right).applyInArrow(run, schema), "voronoi")
    bits = f"filter(sequence(0, {SPLIT_PIVOTS}), q -> (shiftright({{}}, q) & 1) = 1)"
    met = out.where("linked > 0").select("family", F.explode(F.expr(bits.format("linked"))).alias("bucket"), F.col("point").alias("b"))
    links = met.join(pivots.select("family", "bucket", F.col("point").alias("a")), ["family", "bucket"]).where("a <> b").select("a", "b")

    def hang(key: tuple, notes: pa.Table) -> pa.Table:
        top = list(range(SPLIT_PIVOTS))
        for note in notes.column("linked").to_pylist():
            found = [q for q in range(SPLIT_PIVOTS) if note >> q & 1]
            for q in found[1:]:
                x, y = top[found[0]], top[q]
                top = [min(x, y) if t in (x, y) else t for t in top]
        return pa.table({"family": pa.array([key[0].as_py()], pa.int64()), "tops": pa.array([top], pa.list_(pa.int64()))})

    tops = out.where("linked > 0").select("family", "linked").distinct().groupBy("family").applyInArrow(hang, "family long, tops array<long>")
    rest = out.where("not pivot").join(tops, "family", "left")
    part = F.when(F.col("linked") > 0, F.get("tops", F.get(F.expr(bits.format("linked")), F.lit(0)))).otherwise(F.col("point"))
    # What hangs on a pivot has its number, with a sign that no point's name has.
    rest = rest.withColumn("__part", F.when(F.col("linked") > 0, -1 - part).otherwise(part))
    cells = rest.select("family", F.explode(F.expr(bits.format("cells"))).alias("q"), "point", "__part", "values")
    open_cells = cells.groupBy("family", "q").agg((F.min("__part") != F.max("__part")).alias("open")).where("open").select("family", "q")
    regions = cells.join(open_cells, ["family", "q"]).select(F.xxhash64("family", F.lit(depth), "q").alias("family"), "point", "values")
    return links, regions


def jaccard_components(docs: DataFrame, percent: int = PERCENT, k: int = SHINGLE_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, class_id.

    Words are runs of anything but ASCII white space, A-Z lower-cased; a set holds the distinct
    ``k``-word shingles, or the whole sequence of a text of fewer words. Documents link when
    100 * intersection >= percent * union; a component's id is its least doc_id. A null or empty text,
    or one without words, has an empty set and links with nothing. class_id is the least doc_id with an
    equal set. Rows that repeat an id have a row each, and count as one document if their sets are equal;
    a null id takes part like a least id. Other columns are not read. Shingles are compared by hashes
    of 64 bits and sets held equal by size and 128 bits of digest: exact up to collisions of those.
    """
    spark = docs.sparkSession
    small_batches(spark)
    levels = frequency_levels(docs, k, text_col)
    rows = written(document_sets(docs, levels, k, percent, id_col, text_col), "sets")
    real = rows.where("n > 0").withColumn("__id", F.coalesce("doc_id", F.lit(-(1 << 63))))
    # The text of a point is that of its least id; ids may repeat with other texts, so it is named with it.
    points = real.groupBy("s1", "s2", "n").agg(F.min(F.struct("__id", "text_key")).alias("__of"), F.first("parts").alias("parts")).select("s1", "s2", "n", F.col("__of.__id").alias("id"), F.col("__of.text_key").alias("text_key"), "parts")
    # Two sets can share a least id where ids repeat: points get names of their own, which the written table fixes.
    points = written(points.withColumn("point", F.monotonically_increasing_id()), "points")

    shared, stars = repeated_pivots(points)
    shared = written(shared, "regions")
    sketches = points.select("point", F.explode("parts").alias("p")).select("point", "p.part", "p.n", "p.parity").join(shared.select("point", "part").distinct(), ["point", "part"], "left_semi")
    edges = family_edges(shared.join(sketches, ["point", "part"]), percent)
    edges = edges if stars is None else edges.union(stars)
    families = written(components(edges, "families"), "family-of").select("point", F.col("component").alias("family"))

    members = written(points.select("point", "id", "text_key").join(families, "point").select("point", "family", F.col("id").alias("doc_id"), "text_key"), "members")
    links = written(all_links(docs, members, percent, k, id_col, text_col), "links")
    linked = components(links, "components")
    named = points.select("point", "s1", "s2", "n", "id").join(linked, "point", "left").withColumn("component", F.coalesce("component", "point"))
    least = named.groupBy("component").agg(F.min("id").alias("component_id"))
    done = named.join(least, "component").select("s1", "s2", "n", "component_id", F.col("id").alias("class_id"))
    low = F.lit(-(1 << 63))
    some = rows.where("n > 0").select("doc_id", "n", "s1", "s2").join(done, ["s1", "s2", "n"])
    none = rows.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id"), F.col("doc_id").alias("class_id"))
    return some.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("component_id") != low, F.col("component_id")).alias("component_id"), F.when(F.col("class_id") != low, F.col("class_id")).alias("class_id")).union(
        none.select("doc_id", F.col("n").alias("n_shingles"), "component_id", "class_id")
    )


def all_links(docs: DataFrame, members: DataFrame, percent: int, k: int, id_col: str, text_col: str) -> DataFrame:
    """Verified spanning links of all families; ``members``: point, family, doc_id and text_key (xxhash64) of the point's text."""
    wanted = members.select(F.col("doc_id").alias("__m"), F.col("text_key").alias("__t"), "family", "point")
    n = members.count()
    side = F.broadcast(wanted) if 32 * n <= BROADCAST_BYTES else wanted
    texts = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("__m"), F.xxhash64(text_col).alias("__t"), F.col(text_col).alias("text")).join(side, ["__m", "__t"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [_signed(s) for s in shingle_sets(b.column("text"), k)]
            yield pa.RecordBatch.from_arrays([b.column("family"), b.column("point"), pa.array(found, pa.list_(pa.int64()))], ["family", "point", "values"])

    made = texts.select("family", "point", "text").mapInArrow(run, "family long, point long, values array<long>")
    sized = written(made.where(F.size("values") > 0), "family-sets")
    if sized.count() > n:  # rows equal in id and text gave the same set
        sized = written(sized.dropDuplicates(["family", "point"]), "family-sets")
    return links_of(sized, percent)


def links_of(sized: DataFrame, percent: int) -> DataFrame:
    """Links of families (family, point, values): small ones a task each, large ones split first, as often as it helps."""
    found: DataFrame | None = None
    for depth in range(12):
        per = sized.groupBy("family").agg(F.sum(F.size("values")).alias("__v"))
        large = written(per.where(F.col("__v") > FAMILY_SHINGLES).withColumn("__blocks", F.ceil(2 * F.col("__v") / FAMILY_SHINGLES).cast("int")), "large-families")
        before = large.agg(F.sum("__v")).first()[0]
        small = sized.join(large, "family", "left_anti") if before else sized
        part = family_links(small, percent)
        found = part if found is None else found.union(part)
        if not before:
            return found
        links, regions = split_families(sized.join(large.select("family"), "family", "left_semi"), large, percent, depth)
        found = found.union(links)
        sized = written(regions.dropDuplicates(["family", "point"]), "family-sets")
        if (sized.agg(F.sum(F.size("values"))).first()[0] or 0) > 0.9 * before:
            break  # the pivots split nothing
    return found.union(_block_links(sized, percent))


def _block_links(sized: DataFrame, percent: int) -> DataFrame:
    """The exact rest: what pivots can't split is joined by pairs of blocks, each within a task."""
    per = sized.groupBy("family").agg(F.sum(F.size("values")).alias("__v")).withColumn("__b", F.ceil(2 * F.col("__v") / FAMILY_SHINGLES).cast("int"))
    dealt = sized.join(per.select("family", "__b"), "family").withColumn("__own", F.pmod(F.xxhash64("point"), F.col("__b")).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("__b") - 1), lambda x: F.struct(F.least(x, F.col("__own")).alias("lo"), F.greatest(x, F.col("__own")).alias("hi")))
    cells = dealt.withColumn("__c", F.explode(pairs)).select(F.xxhash64("family", "__c.lo", "__c.hi").alias("family"), "point", "values")
    return family_links(cells, percent)


def keep_one(docs: DataFrame, found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``docs`` without the documents that another one of their component stands for (its least id).

    Rows that repeat an id stay together. Components come from ``jaccard_components``.
    """
    return without(docs, found.where(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select("doc_id"), id_col)


def one_of_each(docs: DataFrame, percent: int = PERCENT, k: int = SHINGLE_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each component of the Jaccard join; rows without words all stay.

    Each row counts for itself, also where ids repeat or are null. The row with the least id stays
    (null first, ties by key of id and text); of rows equal in both, the least in all columns.
    """
    keyed = docs.withColumn("__row", row_key(id_col, text_col))
    found = jaccard_components(keyed, percent, k, "__row", text_col).where("n_shingles > 0").groupBy("doc_id").agg(F.min("component_id").alias("component"), F.count("*").alias("n"))
    found = written(found.select(F.col("doc_id").alias("__row"), "component", "n"), "row-components")
    # Only components of several keys need their ids.
    several = found.groupBy("component").agg(F.count("*").alias("m")).where("m > 1").select("component")
    near = found.join(several, "component").select("__row", "component")
    ids = keyed.select("__row", F.col(id_col).alias("__id")).join(near, "__row").distinct()
    stays = ids.groupBy("component").agg(F.min(F.struct("__id", "__row"))["__row"].alias("__stays"))
    left = without(keyed, near.join(stays, "component").where("__row <> __stays").select("__row"), "__row")
    again = found.where("n > 1").select(F.col("__row").alias("__again"))
    again = written(again, "equal-rows")
    side = F.broadcast(again) if 16 * again.count() <= BROADCAST_BYTES else again
    marked = left.join(side, F.col("__row") == F.col("__again"), "left")
    least = marked.where("__again is not null").groupBy("__row").agg(F.min(F.struct(*docs.columns)).alias("r")).select("r.*")
    return marked.where("__again is null").select(docs.columns).unionByName(least)
