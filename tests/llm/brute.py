"""Plain Python versions of the operators, for small inputs."""

from __future__ import annotations

import hashlib
import re
import tracemalloc

AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def traced(f):
    """The most bytes that Python and numpy hold at a time while f runs, beyond those from before."""
    tracemalloc.start()
    try:
        f()
        return tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def luhn(s: str) -> bool:
    d = [int(c) for c in s if c.isascii() and c.isdigit()][::-1]
    return sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(d)) % 10 == 0


def pii_base(text: str | None) -> list[tuple[str, int, int]]:
    text = text or ""
    n = lambda s: sum(c in "0123456789" for c in s)
    rules = (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 14 <= n(s) <= 19 and luhn(s)),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 10 <= n(s) <= 15),
    )
    out = []
    for k, (kind, pattern, valid) in enumerate(rules):
        out += [(m.start(), k, kind, m.end()) for m in re.finditer(pattern, text) if valid(m[0])]
    return [(kind, start, end) for start, _, kind, end in sorted(out)]


def sha256(s: str) -> str:
    return hashlib.sha256(s.encode()).hexdigest()


def simhash(text: str | None) -> int:
    import xxhash

    w = WORD.findall((text or "").translate(AZ))
    if not w:
        return 0
    sh = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def components(fps: list[tuple[int, int]], bits: int = 2) -> list[tuple[int, str, int]]:
    """(id, hex, least id reachable) of (id, fingerprint) rows."""
    root = list(range(len(fps)))

    def top(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i][1] ^ fps[j][1]).bit_count() <= bits:
                root[top(i)] = top(j)
    least: dict[int, int] = {}
    for i, (d, _) in enumerate(fps):
        least[top(i)] = min(least.get(top(i), d), d)
    return sorted((d, f"{f:016x}", least[top(i)]) for i, (d, f) in enumerate(fps))
