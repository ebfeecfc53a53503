"""Token ids of whole texts with the tokenizers library, with a cache for space-separated pieces.

A BPE with a whitespace-aware pre-tokeniser never merges across the gap between a
non-space character and the single space after it, so a text's ids are those of its
pieces (each with the space before it) one after another. Pieces repeat, so each task
asks the library once for each of them. Texts where a cut could fall inside a run of
white space, or that hold the text of an added token, go to the library whole.
"""

from __future__ import annotations

import ctypes
import functools
import itertools
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: A space that has white space on its left and white space or nothing on its right.
_SPACE = r"[\s\p{Z}\x{1c}-\x{1f}\x{85}\x{0b}]"
INSIDE_RUN = rf"{_SPACE} (?:{_SPACE}|$)"
#: Bytes of text encoded at a time; bounds a task's memory whatever the batch holds.
SLICE_BYTES = 2_000_000
#: The same where texts are only encoded: more repeated pieces meet in one look at the cache; and pieces that a process keeps.
ENCODED_BYTES, ENCODED_PIECES = 3_000_000, 700_000
#: Parts pieces from each other in one call of the library; pieces that hold it are encoded alone.
MARK = "\x01"
MARKED = " " + MARK


def _joined(found: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.fromiter(map(len, found), np.int64, len(found))
    return np.fromiter(itertools.chain.from_iterable(found), np.uint32, int(lengths.sum())), lengths


def strings(column: pa.Array) -> list[str]:
    """The values of a column without nulls; by way of numpy, which makes them faster than ``to_pylist``."""
    return column.to_numpy(zero_copy_only=False).tolist()


def gather(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions of runs one after another: each ``starts[i], starts[i] + 1, ...`` of ``lengths[i]`` values."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(int(ends[-1]) if len(ends) else 0)


class PieceEncoder:
    """``encode(texts)`` gives the ids of all texts in one array, and how many each text has."""

    def __init__(self, path: str, plain_special: bool = False, max_cached: int = 400_000) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # there is a task for each core already
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = plain_special
        self.added = [] if plain_special else [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.mark = self.tokenizer.encode(MARKED, add_special_tokens=False).ids
        self.max_cached = max_cached
        self.index: dict[str, int] = {}
        self.ids = np.zeros(0, np.uint32)
        self.starts = np.zeros(0, np.int64)
        self.lengths = np.zeros(0, np.int64)

    def library(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _marked(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces that begin with a space. The library takes long texts faster than many short ones, so they go in rows with MARK between."""
        if not any(MARK in p for p in pieces):
            rows = [MARKED.join(pieces[i : i + 200]) + MARKED for i in range(0, len(pieces), 200)]
            flat = _joined(self.library(rows))[0]
            ends = np.flatnonzero(flat == self.mark[-1])
            if len(ends) == len(pieces):
                keep = np.ones(len(flat), bool)
                for k in range(len(self.mark)):
                    keep[ends - k] = False
                return flat[keep], np.diff(ends, prepend=-1) - len(self.mark)
        return _joined(self.library(pieces))

    def _distinct(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, starts, lengths) such that the ids of ``pieces[i]``, with a space before it, are at ``starts[i]``."""
        at = np.fromiter(map(self.index.get, pieces, [-1] * len(pieces)), np.int64, len(pieces))
        new = np.flatnonzero(at < 0)
        flat, lengths = self._marked([" " + pieces[i] for i in new])
        starts = len(self.ids) + np.cumsum(lengths) - lengths
        room = max(0, self.max_cached - len(self.index))
        ids = np.concatenate([self.ids, flat])
        out_starts, out_lengths = np.zeros(len(pieces), np.int64), np.zeros(len(pieces), np.int64)
        out_starts[new], out_lengths[new] = starts, lengths
        old = at >= 0
        out_starts[old], out_lengths[old] = self.starts[at[old]], self.lengths[at[old]]
        if room:
            kept = len(self.index)
            self.index.update(zip((pieces[i] for i in new[:room]), range(kept, kept + room)))
            self.starts = np.concatenate([self.starts, starts[:room]])
            self.lengths = np.concatenate([self.lengths, lengths[:room]])
            self.ids = ids[: int(self.starts[-1] + self.lengths[-1])] if len(self.starts) else ids[:0]
        return ids, out_starts, out_lengths

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        whole = pc.match_substring_regex(texts, INSIDE_RUN)
        for added in self.added:
            whole = pc.or_(whole, pc.match_substring(texts, added))
        whole = whole.to_numpy(zero_copy_only=False)
        split = pc.split_pattern(pc.if_else(pa.array(whole), "", texts), " ")
        edges = split.offsets.to_numpy().astype(np.int64)
        pieces = split.flatten().dictionary_encode()
        at = pieces.indices.to_numpy().astype(np.int64)
        ids, starts, lengths = self._distinct(strings(pieces.dictionary))
        starts, lengths = starts[at], lengths[at]
        firsts = edges[:-1]  # each text has a first piece, without a space before it
        first_ids, first_lengths = _joined(self.library(strings(pieces.dictionary.take(pa.array(at[firsts])))))
        starts[firsts], lengths[firsts] = len(ids) + np.cumsum(first_lengths) - first_lengths, first_lengths
        flat = np.concatenate([ids, first_ids])[gather(starts, lengths)]
        ends = np.concatenate([[0], np.cumsum(lengths)])[edges]
        counts = np.diff(ends)
        if whole.any():
            at_whole = np.flatnonzero(whole)
            parts, done = [], 0
            for i, found in zip(at_whole, self.library([texts[int(i)].as_py() for i in at_whole]), strict=True):
                parts += [flat[done : ends[i]], np.array(found, np.uint32)]
                done, counts[i] = ends[i], len(found)
            flat = np.concatenate([*parts, flat[done:]])
        return flat, counts


@functools.lru_cache(maxsize=1)
def shared_encoder(path: str, plain_special: bool = False) -> PieceEncoder:
    """The encoder of a worker process, which keeps it from task to task: loading one for each task leaves memory in pieces."""
    return PieceEncoder(path, plain_special, ENCODED_PIECES)


def give_back() -> None:
    """Returns to the system what this worker process has freed: the next task may be another operator's, and a freed heap counts as used."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library than glibc
        pass


def slices(column: pa.Array, size: int = SLICE_BYTES, encoder: PieceEncoder | None = None) -> Iterator[tuple[int, pa.Array]]:
    """Runs of texts of about ``size`` bytes, with where each run begins; null counts as empty.

    An operator that uses this process's encoder names it here; for others the one that an earlier task left is dropped."""
    if encoder is None:
        shared_encoder.cache_clear()
    give_back()
    texts = column.fill_null("")
    lengths = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    group = np.cumsum(lengths) // size
    edges = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(texts)]
    for a, b in zip(edges, edges[1:], strict=False):
        if b > a:
            yield a, texts.slice(a, b - a)
            pa.default_memory_pool().release_unused()


def with_end(flat: np.ndarray, counts: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The same ids with ``end_id`` after each document, and the new counts."""
    return np.insert(flat, np.cumsum(counts), end_id), counts + 1


def flat_values(column: pa.Array, kind: str) -> np.ndarray:
    """What a binary column without nulls holds, one value after another."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    if not len(column) or offsets[0] == offsets[-1]:
        return np.zeros(0, kind)
    return np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].view(kind)


def binary_column(flat: np.ndarray, counts: np.ndarray) -> pa.Array:
    """One binary value for each document: its ids as they lie in memory."""
    width = flat.dtype.itemsize
    offsets = np.concatenate([[0], np.cumsum(counts) * width]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(flat))])
