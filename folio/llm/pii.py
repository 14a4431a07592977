"""Personal data: base patterns, and a skip-chain conditional random field that adds to them.

Nodes of a document are its base spans and what else may be personal data: numbers in any grouping,
addresses in any spelling (``name (at) host.tld``, ``1[.]2[.]3[.]4``). Neighbours within CHAIN_GAP
characters form a chain; nodes with equal or similar content, however far apart, are joined by skip
edges; where a base span is among them, each has its edges to base spans, so that no repeat depends on the ones between.

Unary, chain and skip potentials are fitted by pseudo-likelihood on a bounded sample labelled by the
base patterns. As the patterns know one spelling only, a copy of each sampled text is spelled anew:
``respelled`` writes some of its base spans in another form that keeps the label, and puts decoys
(dates, decimals, serial numbers) in the place of others. Loopy belief propagation over chain and
skip edges then makes labels agree across a document. What the base patterns find is observed and
never changed; the field only adds: a node that a skip edge joins to a base span from a belief of
ADD_FROM, any other from ALONE_FROM.
"""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from bisect import bisect
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm.common import small_batches, written

KINDS = ("email", "ip", "card", "phone")
LABELS = ("none", *KINDS)
#: Documents that the field is fitted on, at most, and neighbouring nodes of one (at a random place in it).
SAMPLE_DOCS, SAMPLE_NODES = 1500, 80
#: Copies of a sampled text that are spelled anew.
RESPELLINGS = 3
#: Belief from which a node becomes a span, if a skip edge leads from it to a base span, and if none does.
ADD_FROM, ALONE_FROM = 0.6, 0.9
#: Skip edges of a node where no base span is alike: to the next alike ones (which join all of them in a row).
#: Where one is, a node has an edge to the nearest base span on each side.
SKIPS = 2
#: Characters between neighbours of the chain, at most; behind a longer gap a new chain begins.
CHAIN_GAP = 40
#: What the weight of equal labels across a skip edge is drawn to: alike tokens rarely differ, and most samples hold few.
SKIP_PRIOR = 6.0
#: Messages are passed until none changes by more than SETTLED; ROUNDS only ends those that circle.
ROUNDS, DAMPING, SETTLED = 500, 0.2, 1e-2

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9][0-9.]*")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_RUN = re.compile(r"[0-9]+(?:[\x20().-]{1,4}[0-9]+)*")
_GROUP = re.compile(r"[0-9]+")
#: A word with an @, a number with a few digits between single separators, and spelled-out addresses.
_WORD = re.compile(r"(?<![A-Za-z0-9@._%+-])[A-Za-z0-9._%+-]*@[A-Za-z0-9@._%+-]*")
_NUMBER = re.compile(r"(?<![A-Za-z0-9])(?:\([0-9]{1,4}\)[\x20.-]?)?[0-9]+(?:(?:[\x20.-]|[\x20.-]?\([0-9]{1,4}\)[\x20.-]?)[0-9]+)*(?![A-Za-z0-9])")
_QUAD = re.compile(r"(?<![0-9.])[0-9]{1,3}(?:(?:\x20?[\[({]\x20?(?:\.|dot)\x20?[\])}]\x20?|\x20\.\x20|\x20dot\x20)[0-9]{1,3}){3}(?![0-9])", re.I)
_PLAIN_QUAD = re.compile(r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}")
_SPELLED = re.compile(
    r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+(?:\x20?[\[({]\x20?at\x20?[\])}]\x20?[A-Za-z0-9-]+(?:(?:\.|\x20?[\[({]\x20?dot\x20?[\])}]\x20?|\x20dot\x20)[A-Za-z0-9-]+)+"
    r"|\x20at\x20[A-Za-z0-9-]+(?:\x20dot\x20[A-Za-z0-9-]+)+)", re.I,
)
#: What any node holds (as Arrow's expressions have it): other texts have none.
_ANY_NODE = r"[0-9@]|(?i)[\[({] ?at ?[\])}]| dot "

Span = tuple[str, int, int]


# ------------------------------------------------------------------ base patterns
def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c)
        total += d if i % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def emails(text: str) -> Iterator[Span]:
    """In time linear in the text: a run of local characters is looked at from its @ only."""
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield "email", start, m.end()
            last = m.end()
        at = text.find("@", max(at + 1, last))


def ips(text: str) -> Iterator[Span]:
    for run in _DOTTED.finditer(text):
        if run[0].count(".") < 3:
            continue
        parts, at, i = run[0].split("."), [], 0
        place = run.start()
        for p in parts:
            at.append(place)
            place += len(p) + 1
        while i + 3 < len(parts):
            four = parts[i : i + 4]
            if not all(four):
                i += max(j for j in range(4) if not four[j]) + 1
                continue
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in four):
                yield "ip", at[i], at[i + 3] + len(four[3])
            i += 4


def cards(text: str) -> Iterator[Span]:
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            yield "card", m.start(), m.end()


def phones(text: str) -> Iterator[Span]:
    for m in _PHONE.finditer(text):
        if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
            yield "phone", m.start(), m.end()


def base_spans(text: str) -> list[Span]:
    """All base spans, by kind as listed, then by start."""
    return [*emails(text), *ips(text), *cards(text), *phones(text)]


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


# ------------------------------------------------------------------ the field
def candidates(text: str) -> list[tuple[int, int]]:
    """(start, end) of what may be personal data, apart from base spans; they don't overlap.

    A run of numbers with blanks between is one candidate if its digits are grouped by 3, 3 and 4
    (behind a country's number, maybe). Of others, each number of seven digits or more stands alone; a run
    of shorter ones is one candidate if it has 7 to 19 digits in groups of two to four (the first of
    one as well). Shorter numbers are no personal data of these kinds.
    """
    low = text.lower()
    out = [m.span() for m in _SPELLED.finditer(text)] if "at" in low else []
    if "." in text or "dot" in low:
        out += [m.span() for m in _QUAD.finditer(text)]
    if "@" in text:
        out += [m.span() for m in _WORD.finditer(text)]
    for m in _NUMBER.finditer(text):
        groups = [g.span() for g in _GROUP.finditer(text, *m.span())]
        if sum(e - s for s, e in groups) < 7:
            continue
        parts: list[list[tuple[int, int]]] = []
        for g in groups:
            # A blank parts numbers, but for one behind a bracket.
            if parts and "\x20" not in text[parts[-1][-1][1] : g[0]].replace(") ", ")"):
                parts[-1].append(g)
            else:
                parts.append([g])
        sizes = [sum(e - s for s, e in p) for p in parts]
        if [e - s for s, e in groups[-3:]] == [3, 3, 4] and (len(groups) == 3 or (len(groups) == 4 and groups[0][1] - groups[0][0] <= 3)):
            parts = [groups]
            sizes = [sum(sizes)]
        elif max(sizes) < 7:
            even = all(2 <= e - s <= 4 for s, e in groups[1:]) and groups[0][1] - groups[0][0] <= 4
            parts = [groups] if sum(sizes) <= 19 and even else []
            sizes = [sum(sizes)]
        for p, n in zip(parts, sizes, strict=False):
            if n >= 7:
                s, e = p[0][0], p[-1][1]
                out.append((s - 1 if text[s - 1 : s] == "(" and s > m.start() and ")" in text[s:e] else s, e))
    out.sort()
    kept: list[tuple[int, int]] = []
    for s, e in out:
        if not kept or s >= kept[-1][1]:
            kept.append((s, e))
    return kept


N_FEATURES = 27


@lru_cache(maxsize=1 << 14)
def node_features(t: str) -> np.ndarray:
    """Bias, signs, digits and their groups, and what only numbers of a kind have (Luhn's sum, parts up to 255)."""
    groups = _GROUP.findall(t)
    sizes = [len(g) for g in groups]
    digits, letters = sum(sizes), sum(c.isalpha() for c in t)
    quad = _QUAD.fullmatch(t) is not None or _PLAIN_QUAD.fullmatch(t) is not None
    checked = 16 <= digits <= 19 and not letters and luhn("".join(groups))
    year = any(len(g) == 4 and g[:2] in ("19", "20") for g in groups[:3])
    x = np.zeros(N_FEATURES)
    x[0] = 1
    x[1] = "@" in t
    x[2] = _SPELLED.fullmatch(t) is not None
    x[3] = "." in t
    x[4] = t.startswith("+")
    x[5] = "-" in t
    x[6 + min(6, digits // 3)] = 1  # digits by threes, 18 or more together
    x[13] = len(groups) == 1
    x[14] = letters > digits
    x[15] = "(" in t and ")" in t and not letters
    x[16] = checked
    x[17] = 16 <= digits <= 19 and not checked
    x[18] = quad and all(int(g) <= 255 for g in groups)
    x[19] = 3 <= len(groups) <= 5 and sizes[-2:] == [3, 4]
    x[20] = len(groups) >= 4 and set(sizes[:3]) == {4}
    x[21] = year and 3 <= len(groups) <= 6 and sum(n == 2 for n in sizes) >= 2  # a date, maybe with its time
    x[22] = len(groups) == 2 and "." in t
    x[23] = digits in (10, 11) and len(groups) > 1
    x[24] = digits in (10, 11) and len(groups) == 1
    x[25] = "@" in t and _DOMAIN.match(t, t.rfind("@") + 1) is None
    x[26] = digits in (7, 8, 9)
    return x


# ------------------------------------------------------------------ other spellings, to learn from
def other_spelling(kind: str, t: str, rng: random.Random) -> str:
    """A base span as people write it where they don't write the pattern."""
    groups = _GROUP.findall(t)
    if kind == "email":
        name, host = t.split("@", 1)
        at, dot = rng.choice((("(at)", "."), (" (at) ", "."), ("[at]", "[dot]"), (" [at] ", " [dot] "), (" at ", " dot "), ("{at}", "{dot}"), (" (at) ", " (dot) ")))
        return name + at + host.replace(".", dot)
    if kind == "ip":
        return rng.choice(("[.]", "(.)", "[dot]", " . ", " dot ", "(dot)")).join(groups)
    digits = "".join(groups)
    if kind == "card":
        return ".".join(digits[i : i + 4] for i in range(0, len(digits), 4))
    tail = digits[-10:]
    if len(tail) < 10:
        return digits
    a, b, c = tail[:3], tail[3:6], tail[6:]
    return rng.choice((f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"{a} {b} {c}", f"({a}){b}-{c}", f"1-{a}-{b}-{c}", f"1 ({a}) {b}-{c}", f"{a} {b}-{c}"))


def decoy(rng: random.Random) -> str:
    """A number that is nobody's: a date, a decimal, a version, a serial number, an amount, a range of years."""
    d = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    date = f"{rng.choice(('19', '20'))}{d(2)}-{rng.randint(1, 12):02}-{rng.randint(1, 28):02}"
    while luhn(serial := rng.choice("123456789") + d(15)):
        pass
    return rng.choice((date, f"{date} {rng.randint(0, 23):02}", date.replace("-", "."), f"{d(1)}.{d(rng.randint(6, 14))}", serial, d(rng.randint(7, 15)), f"{d(4)}-{d(4)}", f"{d(3)} {d(3)} {d(3)}", f"@{rng.choice(('home', 'work', 'all'))}{d(2)}", f"{d(5)}-{d(4)}", f"{d(2)}-{d(7)}"))


def respelled(text: str, base: list[Span], rng: random.Random) -> tuple[str, list[Span], list[tuple[int, int]]]:
    """``text`` with its base spans in other spellings, the spans where they are now, and the decoys put in.

    Of spans of one kind that overlap others, the first counts. Each is written anew, or kept and
    written anew behind it, or gives its place to a decoy.
    """
    out: list[str] = []
    spans: list[Span] = []
    decoys: list[tuple[int, int]] = []
    done = size = 0

    def put(t: str, kind: str | None = None) -> None:
        nonlocal size
        out.append(t)
        if kind == "decoy":
            decoys.append((size, size + len(t)))
        elif kind:
            spans.append((kind, size, size + len(t)))
        size += len(t)

    for kind, s, e in sorted(base, key=lambda x: x[1:]):
        if s < done:
            continue
        put(text[done:s])
        done = e
        way = rng.random()
        if way < 0.4:
            put(other_spelling(kind, text[s:e], rng), kind)
        elif way < 0.7:
            put(text[s:e], kind)
            put(" then" * rng.randint(1, 9) + " ")
            put(other_spelling(kind, text[s:e], rng), kind)
        else:
            put(decoy(rng), "decoy")
    put(text[done:])
    return "".join(out), spans, decoys


#: Labels in lessons besides those of LABELS: of what no pattern and no respelling names, and of what is left out.
FREE, UNKNOWN = -1, -2


def lessons(text: str, seed: int) -> list[tuple[Graph, np.ndarray]]:
    """(graph, label by node) of a text with base spans, as it is and spelled anew."""
    base = base_spans(text)
    if not base:
        return []
    g = Graph(text, base)
    # What repeats a base span has no label to learn from: as none it would unlearn the repeats.
    out = [(g, np.where(g.reached & (g.seen < 0), UNKNOWN, g.seen))]
    rng = random.Random(zlib.crc32(text.encode("utf-8", "surrogatepass")) ^ seed)
    for _ in range(RESPELLINGS):
        anew, spans, decoys = respelled(text, base, rng)
        g = Graph(anew, base_spans(anew))
        known = {(s, e): LABELS.index(k) for k, s, e in spans}
        label = np.asarray([known.get(x, n if n >= 0 else UNKNOWN if r else FREE) for x, n, r in zip(g.spans, g.seen, g.reached, strict=True)], np.int64)
        near = sorted([(s, e, UNKNOWN) for _, s, e in spans] + [(s, e, 0) for s, e in decoys])
        k = 0
        for j, (s, e) in enumerate(g.spans):  # a part of a span is neither that kind nor none; of a decoy, none
            while k < len(near) and near[k][1] <= s:
                k += 1
            if label[j] == FREE and k < len(near) and near[k][0] < e:
                label[j] = near[k][2]
        out.append((g, label))
    return out


def key_of(t: str) -> str:
    """Nodes with one key are alike: the digits of a number, or an address in one spelling and lower case."""
    low = t.lower()
    if "@" in low or _SPELLED.fullmatch(low):
        spelled = re.sub(r"\x20?[\[({]\x20?(at|dot)\x20?[\])}]\x20?", r" \1 ", low)
        return spelled.replace(" at ", "@").replace(" dot ", ".").replace(" ", "")
    if _QUAD.fullmatch(low) or _PLAIN_QUAD.fullmatch(low):
        return ".".join(_GROUP.findall(low)) + "."
    digits = "".join(c for c in t if c.isdigit())
    return digits if len(digits) >= 6 else ""


def class_of(key: str) -> str:
    """Keys of one class are alike: numbers agree in their last ten digits, with and without a country."""
    return key[-10:] if key.isdigit() else key


def repeats(text: str, keys: set[str], taken: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """(start, end) of numbers outside ``taken`` that repeat one of ``keys``, however their digits are grouped.

    A repeat is whole groups of a run of digits, blanks, brackets, dots and dashes; runs may hold other
    numbers too. Its digits are a key's, a key's last ten, or end in those within the first group.
    """
    whole = keys | {class_of(k) for k in keys}
    tails = {class_of(k) for k in keys if len(k) >= 10}
    most = max(15, *map(len, keys))
    out: list[tuple[int, int]] = []
    n = 0
    for run in _RUN.finditer(text):
        groups = []
        for m in _GROUP.finditer(text, run.start(), run.end()):
            while n < len(taken) and taken[n][1] <= m.start():
                n += 1
            free = n == len(taken) or taken[n][0] >= m.end()
            groups.append((m.start(), m.end(), m[0] if free else ""))
        i = 0
        while i < len(groups):
            digits, end = "", -1
            for j in range(i, len(groups)):
                if not groups[j][2] or len(digits) + len(groups[j][2]) > most:
                    break
                digits += groups[j][2]
                if digits in whole or (len(digits) - len(groups[i][2]) < 10 and len(digits) >= 10 and digits[-10:] in tails):
                    end = j
            if end < 0:
                i += 1
                continue
            s, e = groups[i][0], groups[end][1]
            out.append((s - 1 if text[s - 1 : s] == "(" and ")" in text[s:e] else s, e))
            i = end + 1
    return out


class Graph:
    """Nodes of a document with features, observed labels (-1: none) and edges."""

    def __init__(self, text: str, base: list[Span]):
        spans = sorted((s, e, LABELS.index(k)) for k, s, e in base)
        nodes: list[tuple[int, int, int]] = []
        for n, (s, e, _) in enumerate(spans):  # of base spans that overlap, the first is the node
            if not nodes or s >= nodes[-1][1]:
                nodes.append((s, e, n))
        shown = len(nodes)
        i = 0
        for s, e in candidates(text):
            while i < shown and nodes[i][1] <= s:
                i += 1
            if i == shown or nodes[i][0] >= e:
                nodes.append((s, e, -1))
        nodes.sort()
        owner = [o for _, _, o in nodes]
        groups = [(s, e) for s, e, _ in nodes]
        keys = {key_of(text[s:e]) for (s, e), o in zip(groups, owner, strict=True) if o >= 0 and LABELS[spans[o][2]] in ("card", "phone")}
        if keys - {""}:
            taken: list[tuple[int, int]] = []
            for s, e, _ in spans:  # base spans of two kinds may overlap
                if taken and s < taken[-1][1]:
                    taken[-1] = (taken[-1][0], max(e, taken[-1][1]))
                else:
                    taken.append((s, e))
            nodes, n = [], 0
            again = repeats(text, keys - {""}, taken)
            for (s, e), o in zip(groups, owner, strict=True):
                while n < len(again) and again[n][1] <= s:
                    n += 1
                if o >= 0 or n == len(again) or again[n][0] >= e:
                    nodes.append((s, e, o))
            nodes = sorted(nodes + [(s, e, -1) for s, e in again])
            groups, owner = [(s, e) for s, e, _ in nodes], [o for _, _, o in nodes]
        self.spans = groups
        self.seen = np.asarray([spans[o][2] if o >= 0 else -1 for o in owner], np.int64)
        self.x = np.asarray([node_features(text[s:e]) for s, e in groups]).reshape(len(groups), N_FEATURES)
        self.chain = [(j, j + 1) for j in range(len(groups) - 1) if groups[j + 1][0] - groups[j][1] <= CHAIN_GAP]
        alike: dict[str, list[int]] = defaultdict(list)
        for j, (s, e) in enumerate(groups):
            key = key_of(text[s:e])
            if key:
                alike[class_of(key)].append(j)
        pairs: set[tuple[int, int]] = set()
        self.reached = self.seen > 0  # base spans and what is alike to one
        for own in alike.values():
            shown = [j for j in own if self.seen[j] > 0]
            pairs |= {(a, b) for same in ([shown] if shown else [own]) for n, a in enumerate(same) for b in same[n + 1 : n + 1 + SKIPS]}
            if shown:
                self.reached[own] = True
                for j in own:
                    if self.seen[j] <= 0:
                        n = bisect(shown, j)
                        pairs |= {(min(a, j), max(a, j)) for a in shown[max(0, n - 1) : n + 1]}
        self.skip = sorted(pairs)


def settle_free(graphs: list[tuple[np.ndarray, np.ndarray, list, list]]) -> None:
    """Make free nodes none, but unknown where they look just like a span in some spelling.

    In a text that holds other spellings, they are free as well: as none they would unlearn themselves.
    """
    shown = {x.tobytes() for g in graphs for x in g[0][g[1] > 0]}
    for x, y, *_ in graphs:
        for j in np.flatnonzero(y == FREE):
            y[j] = UNKNOWN if x[j].tobytes() in shown else 0


def fit_field(graphs: list[tuple[np.ndarray, np.ndarray, list, list]], steps: int = 400, rate: float = 1.0, decay: float = 1e-4) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unary, chain and skip weights by pseudo-likelihood: each token given its neighbours' labels.

    A node of label UNKNOWN is neither fitted nor a neighbour.
    """
    n_labels = len(LABELS)
    x = np.concatenate([g[0] for g in graphs])
    y = np.concatenate([g[1] for g in graphs])
    known = y != UNKNOWN
    y = np.maximum(y, 0)
    first = np.cumsum([0] + [len(g[1]) for g in graphs])
    near = []
    for which in (2, 3):
        m = np.zeros((len(y), n_labels))
        for g, at in zip(graphs, first, strict=False):
            for a, b in g[which]:
                m[at + a, y[at + b]] += known[at + b]
                m[at + b, y[at + a]] += known[at + a]
        near.append(m)
    feats, y = np.concatenate([x, *near], axis=1)[known], y[known]
    n = x.shape[1]
    prior = np.zeros((feats.shape[1], n_labels))
    prior[n + n_labels :] = SKIP_PRIOR * np.eye(n_labels)
    w = prior.copy()
    target = np.eye(n_labels)[y]
    square = np.full_like(w, 1e-8)
    for _ in range(steps):
        z = feats @ w
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        grad = feats.T @ (p - target) / len(y) + decay * (w - prior)
        square += grad * grad
        w -= rate * grad / np.sqrt(square)
    chain, skip = w[n : n + n_labels], w[n + n_labels :]
    return w[:n], (chain + chain.T) / 2, (skip + skip.T) / 2


def beliefs(g: Graph, field: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    """Label beliefs of each token by damped loopy sum-product over chain and skip edges."""
    unary, chain, skip = field
    n_labels = len(LABELS)
    node = g.x @ unary
    held = g.seen >= 0
    node[held] = -30.0
    node[held, g.seen[held]] = 30.0
    edges = np.asarray([*g.chain, *g.skip], np.int64).reshape(-1, 2)
    if len(edges):
        src, dst = np.concatenate([edges[:, 0], edges[:, 1]]), np.concatenate([edges[:, 1], edges[:, 0]])
        back = np.concatenate([np.arange(len(edges)) + len(edges), np.arange(len(edges))])
        skips = np.tile(np.arange(len(edges)) >= len(g.chain), 2)
        pairs = np.exp(chain - chain.max()), np.exp(skip - skip.max())  # a constant factor of a message says nothing
        # Only messages whose sender has heard something new are computed again: a text of many nodes
        # costs as much as there is to hear, not rounds times edges.
        msg = np.zeros((len(src), n_labels))
        total = node.copy()
        active = np.arange(len(src))
        for _ in range(ROUNDS):
            out = total[src[active]] - msg[back[active]]
            out = np.exp(out - out.max(axis=1, keepdims=True))
            far = skips[active]
            new = np.empty_like(out)
            new[far], new[~far] = out[far] @ pairs[1], out[~far] @ pairs[0]
            new = np.log(new + 1e-30)
            new -= new.max(axis=1, keepdims=True)
            new = DAMPING * msg[active] + (1 - DAMPING) * new
            new[held[dst[active]]] = 0  # what is observed hears nothing: many repeats together would outweigh it
            change = new - msg[active]
            msg[active] = new
            np.add.at(total, dst[active], change)
            moved = np.abs(change).max(axis=1) > SETTLED
            if not moved.any():
                break
            again = np.zeros(len(src), bool)
            again[active[moved]] = True
            heard = np.zeros(len(node), bool)
            heard[dst[active[moved]]] = True
            active = np.flatnonzero(again | heard[src])
        node = node.copy()
        np.add.at(node, dst, msg)
    p = np.exp(node - node.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def added_spans(text: str, base: list[Span], field) -> list[Span]:
    """What the field adds: nodes outside the base spans that it believes to be personal data."""
    g = Graph(text, base)
    free = np.flatnonzero(g.seen < 0)
    if field is None or not len(free):
        return []
    p = beliefs(g, field)
    best = p.argmax(axis=1)
    need = np.where(g.reached, ADD_FROM, ALONE_FROM)
    return [(LABELS[best[j]], *g.spans[j]) for j in free if best[j] and p[j, best[j]] >= need[j]]


OUT = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 13) -> DataFrame:
    """One row per document: doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans, n_added.

    Base spans: the patterns' leftmost non-overlapping matches per kind that pass the checks. spans
    holds base and added ones as kind:start:end (code points, end exclusive), by kind as listed, then
    start. A null text is an empty one. Repeated rows have a row each. Other columns are not read.
    """
    spark = docs.sparkSession
    small_batches(spark)
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for t in b.column("text").to_pylist():
                for g, label in lessons(t, seed):
                    rng = random.Random(len(t))
                    z = (a := rng.randrange(max(1, len(label) - SAMPLE_NODES + 1))) + SAMPLE_NODES
                    inside = [[x - a for e in edges if a <= min(e) and max(e) < z for x in e] for edges in (g.chain, g.skip)]
                    out.append((g.x[a:z].ravel(), label[a:z], *inside))
            if out:
                kinds = (pa.list_(pa.float64()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["x", "y", "chain", "skip"])

    # A bounded sample, drawn by a hash of the id among texts with a long number or an address in them.
    likely = base.where(F.col("text").rlike("@[A-Za-z0-9-]+[.]|[0-9]{6}|[+][0-9]|[0-9][.][0-9]+[.][0-9]"))
    n = likely.count()
    drawn = likely.where(F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1_000_000)) < int(1_000_000 * min(1.0, SAMPLE_DOCS / max(1, n)))).limit(SAMPLE_DOCS)
    sample = written(drawn.select("text").mapInArrow(examples, "x array<double>, y array<long>, chain array<long>, skip array<long>"), "pii-sample")
    graphs = [
        (np.array(r["x"]).reshape(-1, N_FEATURES), np.array(r["y"], np.int64), list(zip(r["chain"][::2], r["chain"][1::2], strict=True)), list(zip(r["skip"][::2], r["skip"][1::2], strict=True)))
        for r in sample.toLocalIterator()
    ]
    settle_free(graphs)
    shared = spark.sparkContext.broadcast(fit_field(graphs) if graphs else None)
    nothing = hashlib.sha256(b"").hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = shared.value
        for b in batches:
            n = len(b)
            counts = np.zeros((len(KINDS), n), np.int64)
            digest, spans, more = [nothing] * n, [""] * n, np.zeros(n, np.int64)
            text = b.column("text")
            for i in np.flatnonzero(pc.match_substring_regex(text, _ANY_NODE).to_numpy(zero_copy_only=False)):
                t = text[int(i)].as_py()
                found = base_spans(t)
                for k, _, _ in found:
                    counts[KINDS.index(k), i] += 1
                extra = added_spans(t, found, field)
                if found:
                    digest[i] = hashlib.sha256(joined(found).encode()).hexdigest()
                if found or extra:
                    spans[i] = joined(sorted({*found, *extra}, key=lambda s: (KINDS.index(s[0]), s[1], s[2])))
                more[i] = len(extra)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), *(pa.array(c) for c in counts), pa.array(digest), pa.array(spans), pa.array(more)],
                ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"],
            )

    return base.mapInArrow(run, OUT)
