"""Hashes of word shingles."""

from __future__ import annotations

import numpy as np

#: Values whose bits are spread out at a time.
BITS_OF = 8192


def shingle_hashes(texts: list[str], words: int, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """(XXH64 of the shingles of all texts in order, repeats included; how many each text has).

    ASCII capitals are lowered; fewer words than a shingle are one shingle; no words have none."""
    from xxhash import xxh64_intdigest

    hashes: list[int] = []
    counts = np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        found = text.encode().lower().split()  # of bytes: ASCII letters and ASCII white space only
        if not found:
            continue
        joined = b" ".join(found)
        if len(found) <= words:
            hashes.append(xxh64_intdigest(joined, seed))
            counts[i] = 1
            continue
        starts = [0]
        for w in found:
            starts.append(starts[-1] + len(w) + 1)
        hashes += [xxh64_intdigest(joined[a : b - 1], seed) for a, b in zip(starts, starts[words:], strict=False)]
        counts[i] = len(found) - words + 1
    return np.array(hashes, np.uint64), counts


def majority_bits(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """SimHash of each run of values: a bit is 1 if it is set in over half of them; empty runs give zero."""
    out = np.zeros(len(counts), np.uint64)
    some = np.flatnonzero(counts)
    ends = np.cumsum(counts[some])
    done = 0
    for group in np.split(some, np.flatnonzero(np.diff(ends // BITS_OF)) + 1):  # 64 bytes for each value of a group, and longer ones in sums
        size = counts[group]
        mine = values[done : done + int(size.sum())]
        done += len(mine)
        if len(mine) > BITS_OF and len(group) == 1:  # a long text: sums of its parts
            ones = sum(_bits(mine[i : i + BITS_OF]).sum(axis=0, dtype=np.int64) for i in range(0, len(mine), BITS_OF))[None]
        elif len(mine):
            ones = np.add.reduceat(_bits(mine), np.cumsum(size) - size, axis=0, dtype=np.int64)
        else:
            continue
        out[group] = np.packbits(2 * ones > size[:, None], axis=1, bitorder="little").view("<u8").reshape(-1)
    return out


def _bits(values: np.ndarray) -> np.ndarray:
    return np.unpackbits(values.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def distinct_runs(values: np.ndarray, counts: np.ndarray) -> list[np.ndarray]:
    """The sorted distinct values of each run."""
    ends = np.cumsum(counts)
    return [np.unique(values[a:b]) for a, b in zip((ends - counts).tolist(), ends.tolist(), strict=True)]
