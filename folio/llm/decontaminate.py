"""Benchmark decontamination: q-gram lemma filtering and banded alignment.

A benchmark item of m normalised characters leaks into a text if some stretch of the text is within
k = EDIT_SHARE * m edits of it. By the q-gram lemma such a stretch shares at least m - q + 1 - k*q
q-grams with the item, on diagonals no more than k apart. Shared q-grams are therefore counted in
overlapping bands of 2(k + 1) diagonals; bands that reach the bound are verified by an alignment
that stays within the band.

The benchmark goes to the tasks in blocks of bounded size; however large it is, each block meets all
documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm.common import small_batches, without
from folio.llm.hashing import LOWER, NON_WORD, U64, mix, text_bytes

Q, EDIT_SHARE = 8, 0.1
#: Least shared q-grams that a budget must leave: shorter items get a smaller budget for it.
LEAST_SHARED = 4
#: Bytes of benchmark text in one block.
BLOCK_BYTES = 4 << 20
TABLE_BITS = 22


def normalised(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased letters and digits, runs of other ASCII as one blank: (bytes, offsets, place of each byte in ``buf``)."""
    low = LOWER[buf]
    # Latin-1 capitals are C3 80..9E in UTF-8; C3 97 is the multiplication sign.
    after = np.zeros(len(buf), bool)
    after[1:] = (buf[:-1] == 0xC3) & (buf[1:] >= 0x80) & (buf[1:] <= 0x9E) & (buf[1:] != 0x97)
    low[after] += 0x20
    gap = NON_WORD[buf]
    low[gap] = 32
    keep = ~gap
    keep[1:] |= ~gap[:-1]
    starts = offs[:-1][offs[:-1] < len(buf)]
    keep[starts] = ~gap[starts]  # no leading blank
    at = np.concatenate([[0], np.cumsum(keep)])
    return low[keep], at[offs], np.flatnonzero(keep)


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the Q = 8 bytes from each byte on (the last seven are padded)."""
    padded = np.concatenate([data, np.zeros(Q, np.uint8)])
    out = np.zeros(len(data), U64)
    for i in range(Q):
        out |= padded[i : i + len(data)].astype(U64) << U64(8 * i)
    return mix(out)


def budget(m: int, share: float = EDIT_SHARE) -> int:
    return max(0, min(int(share * m), (m - Q + 1 - LEAST_SHARED) // Q))


class Index:
    """The q-grams of a block of benchmark items."""

    def __init__(self, items: list[tuple[int, str]], share: float = EDIT_SHARE):
        self.ids = [i for i, _ in items]
        data, offs, _ = normalised(*text_bytes(pa.array([t for _, t in items], pa.large_string())))
        self.items = [data[a:z].tobytes().rstrip(b" ") for a, z in zip(offs[:-1], offs[1:], strict=True)]
        self.k = np.asarray([budget(len(t), share) for t in self.items], np.int64)
        self.bound = np.asarray([len(t) - Q + 1 - k * Q for t, k in zip(self.items, self.k, strict=True)], np.int64)
        keys, item, place = [], [], []
        for n, t in enumerate(self.items):
            if len(t) >= Q + LEAST_SHARED:
                h = gram_hashes(np.frombuffer(t, np.uint8))[: len(t) - Q + 1]
                keys.append(h)
                item.append(np.full(len(h), n))
                place.append(np.arange(len(h)))
        keys = np.concatenate(keys) if keys else np.zeros(0, U64)
        order = np.argsort(keys, kind="stable")
        self.item = np.concatenate(item)[order] if item else np.zeros(0, np.int64)
        self.place = np.concatenate(place)[order] if place else np.zeros(0, np.int64)
        self.grams, self.first, self.times = np.unique(keys[order], return_index=True, return_counts=True)
        self.table = np.zeros(1 << TABLE_BITS, bool)
        self.table[(self.grams >> U64(64 - TABLE_BITS)).astype(np.int64)] = True
        self.short = [(n, t) for n, t in enumerate(self.items) if 0 < len(t) < Q + LEAST_SHARED]

    def candidates(self, hashes: np.ndarray) -> list[tuple[int, int, int]]:
        """(item, first diagonal, width) of the bands of one text that reach the bound."""
        if not len(hashes) or not len(self.grams):
            return []
        maybe = np.flatnonzero(self.table[(hashes >> U64(64 - TABLE_BITS)).astype(np.int64)])
        if len(maybe) < LEAST_SHARED:
            return []
        slot = np.minimum(np.searchsorted(self.grams, hashes[maybe]), len(self.grams) - 1)
        real = self.grams[slot] == hashes[maybe]
        maybe, slot = maybe[real], slot[real]
        times = self.times[slot]
        text_at = np.repeat(maybe, times)
        step = np.arange(len(text_at)) - np.repeat(np.cumsum(times) - times, times)
        row = np.repeat(self.first[slot], times) + step
        item, place = self.item[row], self.place[row]
        # An item needs its bound in all before its bands are looked at.
        enough = np.bincount(item, minlength=len(self.items)) >= np.maximum(1, self.bound)
        sel = enough[item]
        if not sel.any():
            return []
        item, place, text_at = item[sel], place[sel], text_at[sel]
        width = self.k[item] + 1
        band = (text_at - place) // width
        low, bands = int(band.min()) - 1, int(band.max() - band.min()) + 2
        pair = np.concatenate([item * bands + (band - low), item * bands + (band - 1 - low)])
        pairs, inverse, hits = np.unique(pair, return_inverse=True, return_counts=True)
        bound = np.maximum(1, self.bound[pairs // bands])
        full = hits >= bound
        if not full.any():
            return []
        # A q-gram of the item counts once in a band, however often the text repeats it.
        sel = full[inverse]
        longest = int(place.max()) + 1
        once = np.unique(inverse[sel] * longest + np.concatenate([place, place])[sel])
        shared = np.bincount(once // longest, minlength=len(pairs))
        good = pairs[shared >= bound]
        return [(int(n), int((b + low) * (self.k[n] + 1)), int(2 * (self.k[n] + 1))) for n, b in zip(good // bands, good % bands, strict=True)]


def align(item: np.ndarray, text: np.ndarray, low: int, width: int, k: int) -> tuple[int, int, int] | None:
    """Fewest edits that turn ``item`` into a stretch of ``text`` on diagonals [low - k, low + width + k).

    (edits, start, end) of the leftmost best stretch, or None beyond k edits. A column of the band is
    a diagonal: row i holds the distances of the item's first i bytes to stretches that end at i + d.
    """
    first, span = low - k, width + 2 * k
    at = max(0, first)
    exact = text[at : max(at, first + span - 1 + len(item))].tobytes().find(item.tobytes())
    if exact >= 0:
        return 0, at + exact, at + exact + len(item)
    diagonals = np.arange(span)
    big = len(item) + span + 1
    ends = first + diagonals  # of row 0: a stretch may begin at any place of the band
    cost = np.where((ends >= 0) & (ends <= len(text)), 0, big)
    begin = ends.copy()
    padded = np.concatenate([text, np.zeros(1, np.uint8)])
    for i in range(1, len(item) + 1):
        at = ends + i  # end of the stretch
        ok = (at >= 1) & (at <= len(text))
        other = padded[np.clip(at - 1, 0, len(text))]
        swap = cost + np.where(ok & (other == item[i - 1]), 0, 1)
        swap[~ok] = big
        drop = np.concatenate([cost[1:], [big]]) + 1  # the item's byte is missing: one diagonal down
        take = drop < swap
        new = np.where(take, drop, swap)
        start = np.where(take, np.concatenate([begin[1:], [0]]), begin)
        # Bytes of the text that the item lacks: along the row, cost rises by one a diagonal.
        base = new - diagonals
        best = np.minimum.accumulate(base)
        source = np.maximum.accumulate(np.where(base == best, diagonals, 0))
        add = best + diagonals < new
        new, start = np.where(add, best + diagonals, new), np.where(add, start[source], start)
        new[(at < 0) | (at > len(text))] = big
        cost, begin = new, start
        if cost.min() > k:
            return None
    d = int(cost.argmin())
    return (int(cost[d]), int(begin[d]), int(ends[d] + len(item))) if cost[d] <= k else None


HITS = "doc_id long, item_id long, edits long, start long, end long"


def leaks(docs: DataFrame, benchmark: DataFrame, share: float = EDIT_SHARE, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row per document and benchmark item found in it: doc_id, item_id, edits, start, end.

    start and end are code points of the text, of the stretch with the fewest edits (the first of
    them). Letter case, punctuation and white space don't count. Items of less than Q + 4 normalised
    bytes are too short to tell a leak from chance and match only a text that is nothing else; empty
    and null items and texts match nothing. Rows that repeat an id and text repeat their hits; repeated
    items each have theirs. An empty table on either side gives an empty result. Other columns are not
    read.
    """
    spark = docs.sparkSession
    small_batches(spark, 500)
    items = benchmark.where(F.col(item_text_col).isNotNull()).select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).alias("text"))
    total = items.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    blocks = -(-total // BLOCK_BYTES)
    found: DataFrame | None = None
    base = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    for block in range(max(1, blocks)):
        own = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(max(1, blocks))) == block)
        rows = [(r["item_id"], r["text"]) for r in own.orderBy("item_id", "text").collect()]  # about BLOCK_BYTES
        index = spark.sparkContext.broadcast(Index(rows, share))

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            ix = index.value
            for b in batches:
                buf, offs = text_bytes(b.column("text"))
                data, rows, place = normalised(buf, offs)
                hashes = gram_hashes(data)
                out: list[tuple] = []
                ids = b.column("doc_id").to_pylist()
                for r in range(len(ids)):
                    a, z = int(rows[r]), int(rows[r + 1])
                    best: dict[int, tuple[int, int, int]] = {}
                    for n, low, width in ix.candidates(hashes[a : max(a, z - Q + 1)]):
                        hit = align(np.frombuffer(ix.items[n], np.uint8), data[a:z], low, width, int(ix.k[n]))
                        if hit is not None and (n not in best or hit < best[n]):
                            best[n] = hit
                    if ix.short:
                        text = data[a:z].tobytes().rstrip(b" ")
                        best |= {n: (0, 0, len(t)) for n, t in ix.short if t == text}
                    for n, (edits, s, e) in best.items():
                        src = buf[offs[r] : offs[r + 1]]
                        lo = int(place[a + s] - offs[r]) if s < e else 0
                        hi = int(place[a + e - 1] - offs[r]) + 1 if s < e else lo
                        points = (src & 0xC0) != 0x80
                        out.append((ids[r], ix.ids[n], edits, int(points[:lo].sum()), int(points[:hi].sum())))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["doc_id", "item_id", "edits", "start", "end"])

        part = base.mapInArrow(run, HITS)
        found = part if found is None else found.unionByName(part)
    return found


def without_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **columns) -> DataFrame:
    """``docs`` without the documents that hold a benchmark item; documents with a null id are kept only
    if no document with a null id has a leak."""
    return without(docs, leaks(docs, benchmark, id_col=id_col, **columns).select("doc_id"), id_col)
