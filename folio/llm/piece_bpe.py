"""Encoding and decoding with a SentencePiece BPE model by vectorised merge rounds.

The model is read with the sentencepiece library; the work on texts is numpy. A text is
``▁`` and the text with spaces as ``▁``; no piece goes on past a ``▁`` that follows another
character, so words (each with the ``▁``s before it) merge apart from each other, and each
task merges a word once. All words of a slice stand in one flat array of symbols. In a round
each word's pairs of least rank merge, from the left; then the array is compacted, and words
without a pair left drop out. The library merges the best pair first, the leftmost of equals, one at a
time; a word in which a merge of this round would make a pair at least as good as itself
therefore merges its leftmost pair alone.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm.encoding import gather, slices, strings

SPACE = "▁"
NONE = np.int64(1) << 40  # the rank of pairs that don't merge
_WORD = re.compile(f"{SPACE}+[^{SPACE}]*")


class PieceModel:
    """Encoder and decoder of one model file. Models with a normaliser, user-defined or unused pieces, or without byte pieces are refused."""

    def __init__(self, path: str, max_cached: int = 300_000) -> None:
        from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        spec, library = proto.normalizer_spec, SentencePieceProcessor(model_proto=proto.SerializeToString())
        kinds = [p.type for p in proto.pieces]
        plain = not spec.precompiled_charsmap and spec.add_dummy_prefix and spec.escape_whitespaces and not spec.remove_extra_whitespaces
        if not plain or set(kinds) - {1, 2, 3, 6} or proto.trainer_spec.treat_whitespace_as_suffix or kinds.count(6) != 256:
            raise ValueError("this model needs more than plain byte-fallback BPE")
        texts = [p.piece for p in proto.pieces]
        normal = {t: i for i, t in enumerate(texts) if kinds[i] == 1}
        if any(re.search(f"[^{SPACE}]{SPACE}", t) for t in normal):
            raise ValueError("a piece goes on past a space")
        self.byte_ids = np.zeros(256, np.uint32)
        for i, t in enumerate(texts):
            if kinds[i] == 6:
                self.byte_ids[int(t[1:-1], 16)] = i
        symbols = dict(normal)
        for t in normal:
            for c in t:
                symbols.setdefault(c, len(texts) + len(symbols))  # characters that are no piece, but parts of one
        self.symbol_of = np.full(0x110000, -1, np.int32)
        for t, i in symbols.items():
            if len(t) == 1:
                self.symbol_of[ord(t)] = i
        scores = sorted({-library.get_score(i) for i in normal.values()})
        rank_of = {s: k for k, s in enumerate(scores)}
        pairs = {}
        for t, i in normal.items():
            for k in range(1, len(t)):
                if t[:k] in symbols and t[k:] in symbols:
                    pairs[symbols[t[:k]] << 32 | symbols[t[k:]]] = (rank_of[-library.get_score(i)], i)
        keys = np.array(sorted(pairs), np.int64)
        ranks, merged = np.array([pairs[k][0] for k in keys.tolist()], np.int64), np.array([pairs[k][1] for k in keys.tolist()], np.int32)
        self.size = len(texts)
        self._hash(keys, ranks, merged)

        piece_bytes = [b"" if kinds[i] in (2, 3) else bytes([int(t[1:-1], 16)]) if kinds[i] == 6 else t.replace(SPACE, " ").encode() for i, t in enumerate(texts)]
        self.piece_lengths = np.array([len(b) for b in piece_bytes], np.int64)
        self.piece_starts = np.cumsum(self.piece_lengths) - self.piece_lengths
        self.piece_bytes = np.frombuffer(b"".join(piece_bytes), np.uint8)
        decimal = [b"%d," % i for i in range(len(texts))]
        self.decimal_lengths = np.array([len(b) for b in decimal], np.int64)
        self.decimal_starts = np.cumsum(self.decimal_lengths) - self.decimal_lengths
        self.decimal_bytes = np.frombuffer(b"".join(decimal), np.uint8)

        self.max_cached = max_cached
        self.index: dict[str, int] = {}
        self.ids = np.zeros(0, np.uint32)
        self.starts = np.zeros(0, np.int64)
        self.lengths = np.zeros(0, np.int64)

    def _hash(self, keys: np.ndarray, ranks: np.ndarray, merged: np.ndarray) -> None:
        """An open table of pairs, probed by all pairs of a round at once."""
        self.bits = max(4, int(4 * len(keys)).bit_length())
        self.table_key, self.table_rank, self.table_merged = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, NONE), np.zeros(1 << self.bits, np.int32)
        slot, todo = self._slot(keys), np.arange(len(keys))
        while len(todo):
            free = self.table_key[slot[todo]] == -1
            taken, first = np.unique(slot[todo][free], return_index=True)
            mine = todo[free][first]
            self.table_key[taken], self.table_rank[taken], self.table_merged[taken] = keys[mine], ranks[mine], merged[mine]
            todo = np.setdiff1d(todo, mine)
            slot[todo] = slot[todo] + 1 & (1 << self.bits) - 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, merged symbol) of pairs; symbols under 0 merge with nothing."""
        keys = left.astype(np.int64) << 32 | right.astype(np.int64)
        keys[(left < 0) | (right < 0)] = -2
        slot = self._slot(keys)
        found = self.table_key[slot]
        rank, merged = np.where(found == keys, self.table_rank[slot], NONE), self.table_merged[slot]
        todo = np.flatnonzero((found != keys) & (found != -1))
        while len(todo):
            slot[todo] = slot[todo] + 1 & (1 << self.bits) - 1
            found = self.table_key[slot[todo]]
            hit = found == keys[todo]
            rank[todo[hit]], merged[todo[hit]] = self.table_rank[slot[todo[hit]]], self.table_merged[slot[todo[hit]]]
            todo = todo[~hit & (found != -1)]
        return rank, merged

    def merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words, ids of each): words as in the text, each with its spaces as ``▁``."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        points = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").astype(np.int64)
        symbol, word = self.symbol_of[points], np.repeat(np.arange(len(words)), sizes)
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        rank, merged = np.full(len(symbol), NONE), np.zeros(len(symbol), np.int32)
        inside = np.flatnonzero(word[1:] == word[:-1])
        rank[inside], merged[inside] = self._pairs(symbol[inside], symbol[inside + 1])
        while len(symbol):
            first = np.flatnonzero(np.diff(word, prepend=-1))
            size = np.diff(np.append(first, len(word)))
            best = np.repeat(np.minimum.reduceat(rank, first), size)
            ended = best == NONE
            if ended.any():
                out.append((word[ended], symbol[ended], points[ended]))
                symbol, word, points, rank, merged, best = (x[~ended] for x in (symbol, word, points, rank, merged, best))
                if not len(symbol):
                    break
            hit = rank == best
            at = np.flatnonzero(hit)
            run = np.flatnonzero(~np.insert(hit[:-1], 0, False)[at])  # pairs that overlap: every other one, from the left
            if len(run) < len(at):
                nth = np.arange(len(at)) - np.repeat(run, np.diff(np.append(run, len(at))))
                at = at[nth % 2 == 0]
            at = self._safe(at, symbol, word, rank, merged)
            symbol[at] = merged[at]
            keep = np.ones(len(symbol), bool)
            keep[at + 1] = False
            changed = np.zeros(len(symbol), bool)
            changed[at] = True
            symbol, word, points, rank, merged, changed = (x[keep] for x in (symbol, word, points, rank, merged, changed))
            changed[:-1] |= changed[1:].copy()
            look = np.flatnonzero(changed)
            rank[look] = NONE
            look = look[look < len(symbol) - 1]
            look = look[word[look] == word[look + 1]]
            rank[look], merged[look] = self._pairs(symbol[look], symbol[look + 1])
        return self._output(out, len(words))

    def _safe(self, at: np.ndarray, symbol: np.ndarray, word: np.ndarray, rank: np.ndarray, merged: np.ndarray) -> np.ndarray:
        """Of the pairs that would merge together, those that the library would also merge before any pair that they make."""
        many = np.flatnonzero(np.diff(word[at], prepend=-1) == 0)  # a word's second pair and further ones
        if not len(many):
            return at
        several = np.isin(word[at], word[at[many]])
        mine = at[several]
        final = symbol.copy()
        final[mine] = merged[mine]
        gone = np.zeros(len(symbol) + 1, bool)
        gone[mine + 1] = True
        left = mine - 1 - gone[mine - 1]  # what stands to the left by then; index -1 or -2 is another word or checked below
        ok_left = (mine > 0) & (word[np.maximum(left, 0)] == word[mine]) & (left >= 0)
        right = mine + 2
        ok_right = (right < len(symbol)) & (word[np.minimum(right, len(symbol) - 1)] == word[mine])
        made = np.full(len(mine), NONE)
        made[ok_left] = self._pairs(final[left[ok_left]], final[mine[ok_left]])[0]
        made[ok_right] = np.minimum(made[ok_right], self._pairs(final[mine[ok_right]], symbol[right[ok_right]])[0])
        bad = np.unique(word[mine[made <= rank[mine]]])
        if not len(bad):
            return at
        leftmost = np.diff(word[at], prepend=-1) != 0
        return at[leftmost | ~np.isin(word[at], bad)]

    def _output(self, parts: list[tuple[np.ndarray, ...]], n: int) -> tuple[np.ndarray, np.ndarray]:
        if not parts:
            return np.zeros(0, np.uint32), np.zeros(n, np.int64)
        word, symbol, points = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(word, kind="stable")
        word, symbol, points = word[order], symbol[order], points[order]
        unknown = (symbol < 0) | (symbol >= self.size)
        width = np.where(unknown, 1 + (points > 0x7F).astype(np.int64) + (points > 0x7FF) + (points > 0xFFFF), 1)
        ids = np.repeat(symbol, width).astype(np.uint32)
        if unknown.any():
            content = points[unknown].astype("<u4").tobytes().decode("utf-32-le").encode()
            ids[np.repeat(unknown, width)] = self.byte_ids[np.frombuffer(content, np.uint8)]
        return ids, np.bincount(word, weights=width, minlength=n).astype(np.int64)

    def lookup(self, keys: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, starts, lengths) of the words ``▁`` + key; ``keys`` are distinct. The first ``max_cached`` words stay for later calls."""
        at = np.fromiter(map(self.index.get, keys, [-1] * len(keys)), np.int64, len(keys))
        new, old = np.flatnonzero(at < 0), np.flatnonzero(at >= 0)
        flat, lengths = self.merge([SPACE + keys[i] for i in new])
        ids = np.concatenate([self.ids, flat])
        starts = len(self.ids) + np.cumsum(lengths) - lengths
        out_starts, out_lengths = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        out_starts[new], out_lengths[new] = starts, lengths
        out_starts[old], out_lengths[old] = self.starts[at[old]], self.lengths[at[old]]
        room = max(0, self.max_cached - len(self.index))
        if room and len(new):
            kept = len(self.starts)
            self.index.update(zip((keys[i] for i in new[:room]), range(kept, kept + room)))
            self.starts = np.concatenate([self.starts, starts[:room]])
            self.lengths = np.concatenate([self.lengths, lengths[:room]])
            self.ids = ids[: int(self.starts[-1] + self.lengths[-1])]
            if len(self.index) != len(self.starts):
                raise ValueError("a word was looked up twice in one call")
        return ids, out_starts, out_lengths

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, and how many each text has."""
        odd = pc.or_(pc.or_(pc.match_substring(texts, "  "), pc.starts_with(texts, " ")), pc.match_substring(texts, SPACE))
        odd = odd.to_numpy(zero_copy_only=False)
        split = pc.split_pattern(pc.if_else(pa.array(odd), "", texts), " ")
        edges = split.offsets.to_numpy().astype(np.int64)
        pieces = split.flatten().dictionary_encode()
        keys, at = strings(pieces.dictionary), pieces.indices.to_numpy().astype(np.int64)
        empty = np.flatnonzero(pc.binary_length(pc.if_else(pa.array(odd), "", texts)).to_numpy(zero_copy_only=False) == 0)
        words = {int(i): [w[1:] for w in _WORD.findall(SPACE + texts[int(i)].as_py().replace(" ", SPACE))] for i in np.flatnonzero(odd)}
        more = {k: n for n, k in enumerate(keys)} if words else {}  # a word of an oddly spaced text may be one of the others' too
        for w in (w for ws in words.values() for w in ws):
            more.setdefault(w, len(more))
        ids, starts, lengths = self.lookup(list(more) if words else keys)
        piece_lengths = lengths[at]
        piece_lengths[edges[empty]] = 0
        ends = np.concatenate([[0], np.cumsum(piece_lengths)])[edges]
        flat, counts = ids[gather(starts[at], piece_lengths)], np.diff(ends)
        if words:
            parts, done = [], 0
            for i, found in words.items():
                mine = np.array([more[w] for w in found], np.int64)
                parts += [flat[done : ends[i]], ids[gather(starts[mine], lengths[mine])]]
                done, counts[i] = ends[i], int(lengths[mine].sum())
            flat = np.concatenate([*parts, flat[done:]])
        return flat, counts

    def decode(self, flat: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """The UTF-8 text of each run of ids, without the space that encoding puts first; ids are those of ``encode``."""
        content, edges = _spread(flat, counts, self.piece_starts, self.piece_lengths, self.piece_bytes)
        return [content[a + (content[a : a + 1] == b" ") : b] for a, b in zip(edges.tolist(), edges[1:].tolist(), strict=False)]

    def decimal(self, flat: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """The ids of each run as decimal numbers with commas between."""
        content, edges = _spread(flat, counts, self.decimal_starts, self.decimal_lengths, self.decimal_bytes)
        return [content[a : max(a, b - 1)] for a, b in zip(edges.tolist(), edges[1:].tolist(), strict=False)]


def _spread(flat: np.ndarray, counts: np.ndarray, starts: np.ndarray, lengths: np.ndarray, table: np.ndarray) -> tuple[bytes, np.ndarray]:
    size = lengths[flat]
    content = table[gather(starts[flat], size)].tobytes()
    return content, np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], np.cumsum(counts)])]


def round_trip(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row.

    Null and empty texts have no ids; repeated rows and null doc_ids stay; pairs of equal rank in a word merge from the left, as in the
    library; a text of any length is encoded whole, in slices of texts of about two million bytes; an empty table gives no rows;
    other columns are left out, so their names can't clash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = PieceModel(model_path)
        for batch in batches:
            for at, texts in slices(batch.column(1)):
                flat, counts = model.encode(texts)
                ids = [hashlib.sha256(b).hexdigest() for b in model.decimal(flat, counts)]
                decoded = [hashlib.sha256(b).hexdigest() for b in model.decode(flat, counts)]
                yield pa.record_batch([batch.column(0).slice(at, len(texts)), pa.array(counts.astype(np.int64)), pa.array(ids), pa.array(decoded)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
