"""Plain versions of what the operators compute."""

from __future__ import annotations

import re

WHITE = " \t\n\x0b\x0c\r"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def base(text):
    text = text or ""
    w = words(text)
    seen = {}
    for i in range(len(w) - 4):
        seen.setdefault(tuple(w[i : i + 5]), []).append(i)
    covered = {p for at in seen.values() if len(at) > 1 for i in at for p in range(i, i + 5)}
    lines = [x for x in text.split("\n") if words(x)]
    n, repeat = len(w), len(covered)
    return n, sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), repeat, n < 10 or 100 * repeat > 20 * n


def fingerprint(text, n=4):
    import xxhash

    w = words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(w[i : i + n]) for i in range(len(w) - n + 1)] if len(w) >= n else ([" ".join(w)] if w else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(n, pairs):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def near_pairs(prints, distance=4):
    return [(i, j) for i in range(len(prints)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= distance]


def normal(text):
    return (text or "").translate({ord(c): None for c in WHITE})


def shingle_set(text, n=5):
    w = words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {" ".join(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def similar_left(rows, similar=0.8):
    """The first row of each component of rows whose shingle sets are similar: all pairs that share a shingle are compared."""
    sets = [shingle_set(r.text) for r in rows]
    holders = {}
    for i, s in enumerate(sets):
        for x in s or [None]:
            holders.setdefault(x, []).append(i)
    pairs = set()
    for i, s in enumerate(sets):
        common = {}
        for x in s or [None]:
            for j in holders[x]:
                if j < i:
                    common[j] = common.get(j, 0) + 1
        pairs |= {(i, j) for j, n in common.items() if not s or n >= similar * (len(s) + len(sets[j]) - n)}
    root = roots(len(rows), sorted(pairs))
    return [r for i, r in enumerate(rows) if root[i] == i]
