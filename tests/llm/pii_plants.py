"""Documents with personal data in spellings that the base patterns don't know, and what they hold."""

import random

from folio.llm import pii

_WORDS = "la tion der und with from über there, mente von. no reading of a los".split()


def _luhn_card(rng):
    while True:
        n = rng.choice("3456") + "".join(rng.choice("0123456789") for _ in range(15))
        if pii.luhn(n):
            return n


def full(kind, rng):
    d = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    if kind == "email":
        return f"{rng.choice(('jo', 'ann.lee', 'info', 'k_v'))}{d(2)}@{rng.choice(('post', 'web', 'mail3'))}.{rng.choice(('example.com', 'example.org', 'test'))}"
    if kind == "ip":
        return ".".join(str(rng.randint(1, 254)) for _ in range(4))
    if kind == "card":
        return _luhn_card(rng)
    return f"+1 ({rng.randint(201, 989)}) {rng.randint(200, 999)}-{d(4)}"


def spelled(kind, t, rng):
    """By hand, apart from what the field is taught with; some spellings are the same, some are not."""
    digits = "".join(c for c in t if c.isdigit())
    if kind == "email":
        name, host = t.split("@")
        return rng.choice((f"{name} (at) {host}", f"{name}[at]{host.replace('.', '[dot]')}", f"{name} at {host.replace('.', ' dot ')}", f"{name}(AT){host}", f"{name} {{at}} {host.replace('.', ' {dot} ')}"))
    if kind == "ip":
        return rng.choice(("[.]", " . ", "(dot)", " [.] ")).join(t.split("."))
    if kind == "card":
        return ".".join((digits[:4], digits[4:8], digits[8:12], digits[12:]))
    a, b, c = digits[1:4], digits[4:7], digits[7:]
    return rng.choice((f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"1-{a}-{b}-{c}", f"{a} {b} {c}", f"{a} {b}.{c}"))


def others(rng):
    d = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    while pii.luhn(serial := "4" + d(15)):
        pass
    return rng.choice((f"{rng.randint(1950, 2030)}-0{rng.randint(1, 9)}-1{rng.randint(0, 9)}", f"0.{d(9)}", serial, f"version {d(1)}.{d(1)}", f"{d(1)},{d(3)},{d(3)}", f"ISBN 978-3-{d(4)}-{d(4)}-{d(1)}", f"look at example dot", f"@user{d(3)}", f"#{d(8)}", f"{d(4)}-{d(4)} pages"))


def planted(n, seed):
    """(text, spans that a reader would mark apart from base spans)."""
    rng = random.Random(seed)
    for _ in range(n):
        text, want = "", []
        for _ in range(rng.randint(1, 4)):
            text += " ".join(rng.choice(_WORDS) for _ in range(rng.randint(3, 30))) + " "
            kind = rng.choice(pii.KINDS)
            t = full(kind, rng)
            way = rng.random()
            if way < 0.3:
                text += t + " " + " ".join(rng.choice(_WORDS) for _ in range(rng.randint(3, 60))) + " "
            if way < 0.7:
                again = spelled(kind, t, rng)
                want.append((kind, len(text), len(text) + len(again)))
                text += again
            else:
                text += others(rng)
            text += rng.choice((", ", " ", "; ", ".\n"))
        yield text, want
