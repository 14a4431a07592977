"""Best-fit packing of token sequences by bin completion.

Texts are tokenised once, in Arrow batches, into pieces of at most CAPACITY tokens. The packing
itself needs only how many pieces there are of each length: at most CAPACITY numbers, whatever the
size of the corpus. On the driver, branch and bound works on that histogram: it takes the largest
length left, enumerates the undominated fillings around it, applies the chosen filling once, or as
many times as the counts allow, and prunes by the waste that any packing must have. Incumbents are
best-fit packings. The search is bounded; where the bound stops it, the incumbent is improved by
completing a few of its bins anew, again and again, so that their waste gathers in one of them until
it is empty. The result says how many sequences it took and how many any packing needs, so that it
shows where it is optimal.

The plan is a list of runs, "this filling so many times". Each piece finds its place from its rank
among the pieces of its length. Ranks come from counts per (length, hash bucket), so a length that a
third of all pieces have is ranked by many tasks.
"""

from __future__ import annotations

import random
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folio.llm.common import small_batches, written

CAPACITY = 2048
END_ID = 0
#: Branch-and-bound nodes, and how many of them after the first branch is done, before the best packing so far is taken.
NODE_LIMIT, MORE_NODES = 4000, 400
#: Bins that are completed anew (copies of one run, and of all), rounds of that, and items of one round.
SAME_BINS, LOOSE_BINS, ROUNDS, ROUND_ITEMS = 16, 4000, 150_000, 13
#: Fillings kept of one enumeration, the fullest first, and steps that it may take.
FILLINGS, FILLING_STEPS = 24, 4000
#: Rows of a bucket within which a length's pieces are ranked, and the least and most buckets.
RANK_ROWS, RANK_BUCKETS = 20_000, (64, 1 << 20)

#: The pre-tokenisation pattern of byte-level BPE files, and the bytes that stand for themselves in them.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


# ------------------------------------------------------------------ tokens
class Encoder:
    """Ids of texts by the tokenizer file, as bytes of little-endian unsigned 32-bit numbers.

    A plain byte-level BPE whose ids follow its merges has the same ids by rank; that is run by a
    library several times as fast. Any other file, and any text that holds the string of an added
    token, goes to the file's own library.
    """

    def __init__(self, path: str):
        import json

        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.added = [t["content"] for t in spec.get("added_tokens", [])]
        pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
        plain = spec.get("normalizer") is None and spec.get("post_processor") is None and model["type"] == "BPE" and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
        self.by_rank = self._ranked(model) if plain else None

    def _ranked(self, model: dict):
        import tiktoken

        vocab, added = model["vocab"], set(self.added)
        merged = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        if any(vocab.get(a + b) != 256 + i for i, (a, b) in enumerate(merged)) or len(vocab) != 256 + len(merged) + sum(t in vocab for t in added):
            return None
        others = iter(range(256, 512))
        byte_of = {chr(b if b in PRINTABLE else next(others)): b for b in range(256)}
        ranks = {bytes(byte_of[c] for c in t): i for t, i in vocab.items() if t not in added}
        return tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def __call__(self, text: str) -> bytes:
        if self.by_rank is None or any(a in text for a in self.added):
            return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return np.asarray(self.by_rank(text), "<u4").tobytes()


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int | None = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The pieces of each text: its ids and then ``end_id``; of more than ``capacity`` ids, the first
    piece takes what full pieces leave. A null text is an empty one."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        end = b"" if end_id is None else np.asarray([end_id], "<u4").tobytes()
        for b in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(b.column("doc_id"), b.column("text"), strict=True):
                ids = encode(text.as_py() or "") + end
                n = len(ids) // 4
                first = n - (max(n - 1, 0) // capacity) * capacity
                at, size, piece = 0, first, 0
                while at < n or (not n and not piece):
                    rows.append((doc_id.as_py(), piece, at, size, zlib.crc32(ids[4 * at : 4 * (at + size)])))
                    at, size, piece = at + size, capacity, piece + 1
            if rows:
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, PIECES)


# ------------------------------------------------------------------ bin completion on a histogram
def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """Bins that any packing needs: by volume, and by volume once items over half stand alone.

    For a threshold k, items over capacity - k fill bins to which none of size k or more can be
    added, so only the room left in bins of items over a half is free for the items from k on.
    """
    n = np.zeros(capacity + 1, np.int64)
    for s, c in counts.items():
        n[s] += c
    sizes = np.arange(capacity + 1)
    above = np.concatenate([np.cumsum(n[::-1])[::-1], [0]])  # items of a length or more
    volume = np.concatenate([np.cumsum((n * sizes)[::-1])[::-1], [0]])
    half = capacity // 2
    k = np.arange(0, half + 1)
    alone = above[half + 1]
    between = above[half + 1] - above[capacity - k + 1]
    room = between * capacity - (volume[half + 1] - volume[capacity - k + 1])
    small = volume[k] - volume[half + 1]
    return int((alone + np.maximum(0, -(-(small - room) // capacity))).max())


def _best_fit(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit on a histogram: around each largest length, the largest that still fits, and so on."""
    left = dict(counts)
    runs: list[tuple[tuple[int, ...], int]] = []
    sizes = sorted(left, reverse=True)
    while sizes:
        room, fill, used = capacity, [], {}
        for s in sizes:
            take = min(room // s if s else left[s], left[s])
            if take:
                fill += [s] * take
                used[s] = take
                room -= s * take
        times = min(left[s] // n for s, n in used.items())
        runs.append((tuple(fill), times))
        for s, n in used.items():
            left[s] -= n * times
        sizes = [s for s in sizes if left[s]]
    return runs


def fillings(room: int, sizes: list[int], left: dict[int, int]) -> list[tuple[int, ...]]:
    """Undominated fillings of ``room``, least waste first (``sizes`` descending, all <= room).

    A filling is dominated if a length that is left fits where it has a shorter one (or nothing); so
    kept fillings are maximal, and of two with one waste the one with larger items comes first.
    """
    found: list[tuple[int, tuple[int, ...]]] = []
    steps = 0

    def go(i: int, room: int, chosen: list[int], used: dict[int, int]) -> bool:
        nonlocal steps
        steps += 1
        if steps > FILLING_STEPS or len(found) > 4 * FILLINGS:
            return True
        while i < len(sizes) and sizes[i] > room:
            i += 1
        if i == len(sizes) or room == 0:
            found.append((room, tuple(chosen)))
            return room == 0 and len(found) >= FILLINGS
        s = sizes[i]
        most = min(left[s] - used.get(s, 0), room // s)
        for n in range(most, -1, -1):
            if n == 0 and most and i + 1 == len(sizes):
                break  # nothing else is left to take: dominated
            chosen.extend([s] * n)
            used[s] = used.get(s, 0) + n
            stop = go(i + 1, room - n * s, chosen, used)
            used[s] -= n
            if n:
                del chosen[-n:]
            if stop:
                return True
        return False

    go(0, room, [], {})
    smallest = {}
    for waste, f in found:
        # dominated where a length of the waste or more is left that the filling could still take
        extra = next((s for s in sizes if s <= waste and left[s] > f.count(s)), None)
        if extra is None:
            smallest.setdefault(f, waste)
    ranked = sorted(smallest.items(), key=lambda x: (x[1], len(x[0]), tuple(-s for s in x[0])))
    return [f for f, _ in ranked[:FILLINGS]] or [()]


def _split(items: list[int], bins: int, capacity: int) -> tuple[list[int], int] | None:
    """(item masks of at most ``bins`` bins, sum of squared fills) of few items, waste gathered in the last bins.

    Bin completion again: each bin takes the largest item left with the fullest companions, one of the four fullest.
    """
    sums = np.zeros(1, np.int64)
    for s in items:
        sums = np.concatenate([sums, sums + s])
    masks = np.arange(len(sums))
    best: tuple[list[int], int] | None = None

    def go(rest: int, left: int, chosen: list[int], value: int) -> None:
        nonlocal best
        room = int(sums[rest])
        if room <= capacity:
            if best is None or value + room * room > best[1]:
                best = ([*chosen, rest], value + room * room)
            return
        if left == 1:
            return
        top = 1 << (rest.bit_length() - 1)
        own = masks[((masks & ~rest) == 0) & ((masks & top) != 0) & (sums <= capacity) & (room - sums <= (left - 1) * capacity)]
        for m in own[np.argsort(-sums[own], kind="stable")[: 4 if left > 2 else 1]]:
            go(rest & ~int(m), left - 1, [*chosen, int(m)], value + int(sums[m]) ** 2)

    go(len(sums) - 1, bins, [], 0)
    return best


def complete_anew(runs: list[tuple[tuple[int, ...], int]], capacity: int, floor: int, rounds: int = ROUNDS, seed: int = 1) -> list[tuple[tuple[int, ...], int]]:
    """``runs`` in no more bins, fewer where some bins can be emptied; ``floor`` bins need no work.

    A round takes a bin with waste and up to three others, and splits their items anew so that the
    squares of their fills grow or stay. Of a run, SAME_BINS bins take part at most.
    """
    rng = random.Random(seed)
    rest: list[tuple[tuple[int, ...], int]] = []
    loose: list[list[int]] = []
    for filling, times in sorted(runs, key=lambda r: sum(r[0])):
        n = min(times, SAME_BINS, LOOSE_BINS - len(loose))
        loose += [list(filling) for _ in range(n)]
        if times > n:
            rest.append((filling, times - n))
    held = sum(n for _, n in rest)
    fill = [sum(b) for b in loose]
    wasteful = [i for i, f in enumerate(fill) if f < capacity]
    for _ in range(rounds):
        if held + len(loose) <= floor or len(wasteful) < 2:
            break
        picked = set(rng.sample(wasteful, 1 + (rng.random() < 0.6)))
        if rng.random() < 0.1:  # what has gathered most moves on
            picked.add(min(wasteful, key=fill.__getitem__))
        size = sum(len(loose[i]) for i in picked)
        for _ in range(rng.choice((1, 2))):
            i = rng.randrange(len(loose))
            if i not in picked and size + len(loose[i]) <= ROUND_ITEMS:
                picked.add(i)
                size += len(loose[i])
        if len(picked) < 2 or size > ROUND_ITEMS:
            continue
        own = sorted(picked)
        items = sorted(s for i in own for s in loose[i])
        found = _split(items, len(own), capacity)
        if found is None or found[1] < sum(fill[i] ** 2 for i in own):
            continue
        made = [[s for j, s in enumerate(items) if m >> j & 1] for m in found[0] if m]
        for i, b in zip(own, made, strict=False):
            loose[i], fill[i] = b, sum(b)
        for i in reversed(own[len(made) :]):
            loose[i], fill[i] = loose[-1], fill[-1]
            loose.pop()
            fill.pop()
        if len(made) < len(own):
            wasteful = [i for i, f in enumerate(fill) if f < capacity]
        else:
            wasteful = [i for i in wasteful if i not in picked] + [i for i in own if fill[i] < capacity]
    return rest + list(Counter(tuple(sorted(b, reverse=True)) for b in loose).items())


def complete_bins(counts: dict[int, int], capacity: int = CAPACITY, node_limit: int = NODE_LIMIT, rounds: int = ROUNDS) -> list[tuple[tuple[int, ...], int]]:
    """Runs (filling, times) that use every item of the histogram, in as few bins as the search finds.

    Depth first: the largest length left is placed with each of its undominated fillings, fullest
    first, each as often as it goes, then once. A node is pruned when its bins plus the lower bound of
    what is left reach the incumbent; an incumbent that meets the lower bound of all is optimal and
    ends the search. It need not be found: FILLINGS, ``rounds`` and ``node_limit`` bound the work.
    """
    counts = {int(s): int(n) for s, n in counts.items() if n > 0}
    if any(s > capacity or s < 0 for s in counts):
        raise ValueError("a piece is longer than the capacity")
    floor = lower_bound(counts, capacity)
    best = _best_fit(counts, capacity)
    best_bins = sum(n for _, n in best)
    nodes, first = 0, True

    def expand(left: dict[int, int]) -> list[tuple[tuple[int, ...], int]]:
        sizes = sorted((s for s, n in left.items() if n), reverse=True)
        big = sizes[0]
        less = left | {big: left[big] - 1}
        fits = [s for s in sizes if s and s <= capacity - big and less[s]]
        whole = [(big, *f) for f in (fillings(capacity - big, fits, less) if fits else [()])]
        times = [min(left[s] // f.count(s) for s in set(f)) for f in whole]
        return [*zip(whole, times, strict=True), *((f, 1) for f, n in zip(whole, times, strict=True) if n > 1)]

    # An explicit stack: a plan may have thousands of runs. Each entry: left, bins, runs so far, choices to try.
    stack: list[tuple[dict[int, int], int, list, list]] = [(counts, 0, [], None)]
    while stack and best_bins > floor and nodes < node_limit:
        left, bins, runs, choices = stack.pop()
        if choices is None:
            nodes += 1
            done = not any(left.values())
            if done and bins < best_bins:
                best, best_bins = runs, bins
            if done or bins + lower_bound(left, capacity) >= best_bins:
                node_limit = min(node_limit, nodes + MORE_NODES) if first else node_limit
                first = False
                continue
            if nodes % 16 == 0:  # an incumbent of its own for some nodes
                rest = _best_fit(left, capacity)
                if bins + sum(n for _, n in rest) < best_bins:
                    best, best_bins = runs + rest, bins + sum(n for _, n in rest)
            choices = expand(left)
        (filling, times), rest_choices = choices[0], choices[1:]
        if rest_choices:
            stack.append((left, bins, runs, rest_choices))
        after = dict(left)
        for s in filling:
            after[s] -= times
        after = {s: n for s, n in after.items() if n}
        stack.append((after, bins + times, [*runs, (filling, times)], None))
    return complete_anew(best, capacity, floor, rounds) if best_bins > floor and stack else best


# ------------------------------------------------------------------ places
def plan_rows(runs: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, ranks, first sequence, place among equals, times a filling has the length, offset).

    Ranks of a length are dealt run by run: rank r of a run's stretch goes to its sequence
    ``r // repeats`` at the ``r % repeats``-th place that the length has in the filling.
    """
    out, next_rank, sequence = [], {}, 0
    for filling, times in runs:
        offset, begins = 0, {}
        for s in filling:
            begins.setdefault(s, offset)
            offset += s
        for s, at in begins.items():
            repeats = filling.count(s)
            first = next_rank.get(s, 0)
            out.append((s, first, first + repeats * times, sequence, repeats, at))
            next_rank[s] = first + repeats * times
        sequence += times
    return out


def place(pieces: DataFrame, runs: list[tuple[tuple[int, ...], int]], most: int = 0) -> DataFrame:
    """``pieces`` with sequence_id and offset. The plan has as many rows as it has runs and lengths of
    them, which the capacity bounds, not the corpus; it goes to the tasks with the function. ``most``:
    how many pieces have the most frequent length."""
    buckets = min(RANK_BUCKETS[1], max(RANK_BUCKETS[0], -(-most // RANK_ROWS)))
    by: dict[int, list] = {}
    for size, *rest in plan_rows(runs):
        by.setdefault(size, []).append(rest)
    stretches = {size: np.asarray(sorted(rest), np.int64) for size, rest in by.items()}
    # Order within a length: by bucket of a hash, then by id; counts per bucket give each bucket's first rank.
    keyed = pieces.withColumn("__bucket", F.pmod(F.xxhash64("doc_id", "piece", "start", "ids_crc32"), F.lit(buckets)))
    counts = keyed.groupBy("length", "__bucket").agg(F.count("*").alias("__n"))
    before = Window.partitionBy("length").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("length", "__bucket", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    inner = Window.partitionBy("length", "__bucket").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = keyed.withColumn("__inner", F.row_number().over(inner) - 1).join(starts, ["length", "__bucket"]).withColumn("__rank", F.col("__start") + F.col("__inner"))

    # The stretch of a rank is found by bisection, not by a join on a range.
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size, rank = b.column("length").to_numpy(), b.column("__rank").to_numpy()
            seq, off = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
            for s in np.unique(size):
                own = np.flatnonzero(size == s)
                rows = stretches[int(s)]
                hit = rows[np.searchsorted(rows[:, 0], rank[own], side="right") - 1]
                inside = rank[own] - hit[:, 0]
                seq[own] = hit[:, 2] + inside // hit[:, 3]
                off[own] = hit[:, 4] + (inside % hit[:, 3]) * s
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(seq), pa.array(off)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "__rank").mapInArrow(run, PIECES + ", sequence_id long, offset long")


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int | None = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset, sequences, lower_bound.

    The last two are alike on all rows: how many sequences there are, and how many any packing needs.

    A null text is an empty one and gives one piece of the end id (of no ids if that is None). Rows
    that repeat an id are documents of their own. Empty tables give an empty result. Other columns
    are not read.
    """
    pieces = written(token_pieces(docs, tokenizer or default_tokenizer(), capacity, end_id, id_col, text_col), "pieces")
    histogram = {int(r["length"]): int(r["n"]) for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    runs = complete_bins(histogram, capacity)
    placed = place(pieces, runs, max(histogram.values(), default=0))
    return placed.withColumn("sequences", F.lit(sum(n for _, n in runs)).cast("long")).withColumn("lower_bound", F.lit(lower_bound(histogram, capacity)).cast("long"))
