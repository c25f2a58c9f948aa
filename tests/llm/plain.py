"""Plain versions of the operators' contracts, written for small tables."""

from __future__ import annotations

import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def words(text: str | None) -> list[str]:
    return WORD.findall((text or "").translate(UPPER))


def shingles(ws: list[str], size: int = 5) -> list[tuple[str, ...]]:
    size = min(size, len(ws))
    return [tuple(ws[i : i + size]) for i in range(len(ws) - size + 1)] if ws else []


def components(texts: dict[int, str | None]) -> dict[int, tuple[int, int]]:
    """(set size, smallest id reachable) of each document."""
    sets = {i: set(shingles(words(t))) for i, t in texts.items()}
    root = {i: i for i in sets}

    def find(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(s), find(i)) for i, s in sets.items()}


def removed(bodies: list[bytes], length: int) -> list[tuple[int, int, bytes]]:
    """(bytes removed, runs, bytes kept) of each document."""
    seen = Counter(t[i : i + length] for t in bodies for i in range(len(t) - length + 1))
    out = []
    for t in bodies:
        gone = [False] * len(t)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        runs = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((sum(gone), runs, bytes(b for b, g in zip(t, gone, strict=True) if not g)))
    return out


def leaks(text: str | None, items: list[tuple[int, str | None]], least: float = 0.8) -> dict[int, tuple[float, int, int]]:
    """By item: similarity, first word and words of its best window, the first of equals."""
    ws, out = words(text), {}
    own = set(shingles(ws))
    for item, t in items:
        bag_words = words(t)
        n = min(len(bag_words), len(ws))
        size = min(5, n)
        if not n or (size == 5 and not own & set(shingles(bag_words))):
            continue
        bag = Counter(shingles(bag_words))
        for start in range(len(ws) - n + 1):
            window = Counter(shingles(ws[start : start + n]))
            both = sum((window & bag).values())
            s = both / (sum(window.values()) + sum(bag.values()) - both)
            if s >= least and s > out.get(item, (0,))[0]:
                out[item] = (s, start, n)
    return out


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


PERSONAL = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda v: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda v: all(int(p) <= 255 for p in v.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda v: 16 <= len(d := re.sub("[^0-9]", "", v)) <= 19 and luhn(d)),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda v: 8 <= len(re.sub("[^0-9]", "", v)) <= 15),
}
SECRETS = {
    "assign": (r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 6),
    "access": (r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20),
    "hex": (r"[0-9a-f]+", lambda m: len(m[0]) >= 24),
}


def personal(text: str | None) -> list[str]:
    return [f"{k}:{m.start()}:{m.end()}" for k, (p, ok) in PERSONAL.items() for m in re.finditer(p, text or "", re.A) if ok(m[0])]


def secrets(text: str | None) -> list[str]:
    found = [(m.start(), j, f"{k}:{m.start()}:{m.end()}") for j, (k, (p, ok)) in enumerate(SECRETS.items()) for m in re.finditer(p, text or "", re.A) if ok(m)]
    return [x for *_, x in sorted(found)]


def targets(sizes: list[int], weights: tuple[int, ...] = (5, 2, 1), most: int = 3) -> list[float]:
    """Of sources in order: shares of the total by weight, none above ``most`` times its size, the excess shared again."""
    total, open_, out = sum(sizes), set(range(len(sizes))), {}
    w = [weights[i % len(weights)] for i in range(len(sizes))]
    while open_:
        rest, all_ = total - sum(out.values()), sum(w[i] for i in open_)
        over = {i for i in open_ if rest * w[i] / all_ > most * sizes[i]}
        if not over:
            out |= {i: rest * w[i] / all_ for i in open_}
            break
        out |= {i: float(most * sizes[i]) for i in over}
        open_ -= over
    return [out[i] for i in range(len(sizes))]
