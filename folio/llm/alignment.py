"""Alignment of two tokenizers' tokens of the same text, and corpus-wide counts of id pairs.

Tokens of A and B whose byte ranges overlap are linked. In the bipartite graph of the links, components found by
union-find are the minimal groups: no component goes on past a byte where tokens of both end, and none ends elsewhere. Both tokenizers
cut at a space that follows another character, so a text is aligned word by word, and a slice of a task's texts does each
distinct word once; texts with other spacing are one word. Words count with how often they stand in the slice:
pairs are summed per slice, then over all slices, and each slice gets the sums of its own pairs back, by a join on the pair.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm.components import spanning
from folio.llm.encoding import INSIDE_RUN, PieceEncoder, binary_column, flat_values, gather, slices, strings
from folio.llm.piece_bpe import SPACE, PieceModel
from folio.storage import cut

#: Bytes of text whose words are counted together, and words that are aligned at a time.
SLICE, WORDS = 2_000_000, 16_384
#: Words that a process keeps aligned.
KEPT = 150_000
PER_WORD = ("sound", "n_a", "n_b", "n_groups", "n_links")


class Vocabulary:
    """Bytes of the tokens of one tokenizer, and their numbers as text."""

    def __init__(self, tokens: list[bytes]) -> None:
        self.lengths = np.array([len(t) for t in tokens], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)

    def join(self, ids: np.ndarray) -> np.ndarray:
        return self.bytes[gather(self.starts[ids], self.lengths[ids])]


def byte_level_tokens(path: str) -> list[bytes]:
    """The bytes of each id of a byte-level vocabulary, whose characters stand for bytes: printable ones for themselves, others from 256 on."""
    from tokenizers import Tokenizer

    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(plain)))}
    known = Tokenizer.from_file(path).get_vocab()
    out = [b""] * (max(known.values()) + 1)
    for token, i in known.items():
        out[i] = bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else token.encode()
    return out


class Aligner:
    """Both tokenizers, with their vocabularies."""

    def __init__(self, byte_path: str, piece_path: str) -> None:
        self.a, self.b = PieceEncoder(byte_path, plain_special=True, max_cached=0), PieceModel(piece_path, max_cached=0)
        self.a_tokens = Vocabulary(byte_level_tokens(byte_path))
        self.b_tokens = Vocabulary([self.b.piece_bytes[s : s + n].tobytes() for s, n in zip(self.b.piece_starts.tolist(), self.b.piece_lengths.tolist(), strict=True)])
        self.numbers = Vocabulary([b"%d," % i for i in range(max(len(self.a_tokens.lengths), len(self.b_tokens.lengths)))])
        self.index: dict[str, int] = {}
        self.held = Alignment(self, [], *[np.zeros(0, np.int64)] * 4)

    def words(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """(distinct words, the words of all texts by number, words of each text). Empty texts have none."""
        spaced = pc.binary_join_element_wise(pa.scalar("", texts.type), texts, " ")
        whole = pc.match_substring_regex(spaced, INSIDE_RUN)
        for odd in (pc.match_substring(spaced, "  "), pc.ends_with(texts, " "), pc.match_substring(texts, SPACE)):
            whole = pc.or_(whole, odd)
        split = pc.split_pattern(pc.if_else(whole, "", texts), " ")
        edges = split.offsets.to_numpy().astype(np.int64)
        pieces = split.flatten()
        whole = whole.to_numpy(zero_copy_only=False)
        empty = pc.equal(texts, "").to_numpy(zero_copy_only=False)
        if whole.any():  # each of these has one empty piece, in whose place the text comes
            at = np.zeros(len(pieces), bool)
            at[edges[:-1][whole]] = True
            pieces = pc.replace_with_mask(pieces, pa.array(at), texts.filter(pa.array(whole)))
        counts = np.diff(edges)
        if empty.any():
            keep = np.ones(len(pieces), bool)
            keep[edges[:-1][empty]] = False
            pieces, counts = pieces.filter(pa.array(keep)), np.where(empty, 0, counts)
        coded = pieces.dictionary_encode()
        return coded.dictionary, coded.indices.to_numpy().astype(np.int64), counts

    def align(self, words: pa.Array) -> Alignment:
        """Of distinct words. The first ``KEPT`` words without a space stay aligned for later calls."""
        keys = strings(words)
        at = np.fromiter(map(self.index.get, keys, [-1] * len(keys)), np.int64, len(keys))
        new = np.flatnonzero(at < 0).tolist()
        plain, odd = [i for i in new if " " not in keys[i]], [i for i in new if " " in keys[i]]
        parts = [self.held]
        for i in range(0, len(plain), WORDS):
            some = [keys[j] for j in plain[i : i + WORDS]]
            a, n_a = self.a._marked([" " + w for w in some])
            b, n_b = self.b.merge([SPACE + w for w in some])
            parts.append(Alignment(self, some, a.astype(np.int64), n_a, b.astype(np.int64), n_b))
        for i in range(0, len(odd), 64):
            some = pa.array([keys[j] for j in odd[i : i + 64]])
            a, n_a = self.a.encode(pc.binary_join_element_wise(pa.scalar(""), some, " "))
            b, n_b = self.b.encode(some)
            parts.append(Alignment(self, some.to_pylist(), a.astype(np.int64), n_a.astype(np.int64), b.astype(np.int64), n_b.astype(np.int64)))
        whole = joined(parts)
        at[plain + odd] = len(self.held.text) + np.arange(len(new))
        room = plain[: max(0, KEPT - len(self.index))]
        if room:
            first = len(self.held.text)
            self.index.update(zip((keys[i] for i in room), range(first, first + len(room)), strict=True))
            self.held = whole.take(np.arange(first + len(room)))
        return whole.take(at)


class Alignment:
    """Of distinct words: whether both tokenizers give the word's bytes (``sound``; others have no tokens), tokens, groups and links of each."""

    def __init__(self, by: Aligner, words: list[str], a: np.ndarray, n_a: np.ndarray, b: np.ndarray, n_b: np.ndarray) -> None:
        n = len(words)
        spaced = [f" {w}".encode() for w in words]
        wanted, size = np.frombuffer(b"".join(spaced), np.uint8), np.fromiter(map(len, spaced), np.int64, n)
        self.sound = _same(by.a_tokens, a, n_a, wanted, size) & _same(by.b_tokens, b, n_b, wanted, size)
        a, b = a[np.repeat(self.sound, n_a)], b[np.repeat(self.sound, n_b)]
        self.n_a, self.n_b = np.where(self.sound, n_a, 0), np.where(self.sound, n_b, 0)
        a_word, b_word = np.repeat(np.arange(n), self.n_a), np.repeat(np.arange(n), self.n_b)
        a_end, b_end = np.cumsum(by.a_tokens.lengths[a]), np.cumsum(by.b_tokens.lengths[b])
        a_start, b_start = a_end - by.a_tokens.lengths[a], b_end - by.b_tokens.lengths[b]
        first, last = np.searchsorted(b_end, a_start, "right"), np.searchsorted(b_start, a_end, "left")
        wide = last - first
        link_a, link_b = np.repeat(np.arange(len(a)), wide), gather(first, wide)
        self.pairs = a[link_a] << 32 | b[link_b]
        self.n_links = np.bincount(a_word[link_a], minlength=n)
        group = np.arange(len(a) + len(b))
        node, root = spanning(link_a, link_b + len(a)) if len(link_a) else (group[:0], group[:0])
        group[node] = root  # the first A token of the component
        roots = group[: len(a)] == np.arange(len(a))
        self.n_groups = np.bincount(a_word[roots], minlength=n)
        self._spell(by, a, b, group, a_word, b_word, n)

    def _spell(self, by: Aligner, a: np.ndarray, b: np.ndarray, group: np.ndarray, a_word: np.ndarray, b_word: np.ndarray, n: int) -> None:
        """``text[i]``: the groups of word ``i`` as ``a1,a2|b1;a3|b2``."""
        order = np.argsort(group, kind="stable")  # a group's A tokens stand before its B tokens
        ids, is_b, group, word = np.concatenate([a, b])[order], order >= len(a), group[order], np.concatenate([a_word, b_word])[order]
        size = by.numbers.lengths[ids]
        content, ends = by.numbers.join(ids).copy(), np.cumsum(size)
        ended = np.append(group[1:] != group[:-1], True) if len(group) else np.zeros(0, bool)
        turns = np.append(is_b[1:] != is_b[:-1], True) & ~ended if len(group) else ended
        content[ends[turns] - 1], content[ends[ended] - 1] = ord("|"), ord(";")
        edges = np.concatenate([[0], np.cumsum(np.bincount(word, weights=size, minlength=n).astype(np.int64))]).tolist()
        whole = content.tobytes()
        self.text = [whole[x : max(x, y - 1)] for x, y in zip(edges, edges[1:], strict=False)]


    def take(self, at: np.ndarray) -> Alignment:
        """The words at these places."""
        out = object.__new__(Alignment)
        for name in PER_WORD:
            setattr(out, name, getattr(self, name)[at])
        ends = np.cumsum(self.n_links)
        out.pairs = self.pairs[gather((ends - self.n_links)[at], self.n_links[at])]
        out.text = list(map(self.text.__getitem__, at.tolist()))
        return out


def joined(parts: list[Alignment]) -> Alignment:
    if len(parts) == 1:
        return parts[0]
    out = object.__new__(Alignment)
    for name in (*PER_WORD, "pairs"):
        setattr(out, name, np.concatenate([getattr(p, name) for p in parts]))
    out.text = [t for p in parts for t in p.text]
    return out


def _same(tokens: Vocabulary, ids: np.ndarray, counts: np.ndarray, wanted: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the bytes of each run of ids are those wanted."""
    runs = np.concatenate([[0], np.cumsum(tokens.lengths[ids])])[np.concatenate([[0], np.cumsum(counts)])]
    same = np.diff(runs) == size
    got, want = tokens.join(ids), wanted
    if not same.all():
        got, want = got[np.repeat(same, np.diff(runs))], want[np.repeat(same, size)]
    kept = size[same]
    differs = np.concatenate([[0], np.cumsum(got != want)])
    edges = np.concatenate([[0], np.cumsum(kept)])
    same[same] = np.diff(differs[edges]) == 0
    return same


def sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The sum of each run of values."""
    return np.diff(np.concatenate([[0], np.cumsum(values)])[np.concatenate([[0], np.cumsum(counts)])])


@functools.lru_cache(maxsize=1)
def _aligner(byte_path: str, piece_path: str) -> Aligner:
    return Aligner(byte_path, piece_path)


_SLICE_ROWS = "slice long, kind int, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, at binary, links binary, pairs array<long>, times array<long>"


def aligned_slices(docs: DataFrame, byte_path: str, piece_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each slice of texts a row of kind 1 (its distinct pairs with how often each is linked in it, and the pairs of each word) and one of kind 2 for each of its documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by, context = _aligner(byte_path, piece_path), TaskContext.get()
        number = context.partitionId() << 33
        for batch in batches:
            for start, texts in slices(batch.column(1), SLICE, by.a):
                words, at, counts = by.words(texts)
                found = by.align(words)
                sound = sums((~found.sound[at]).astype(np.int64), counts) == 0
                at, counts = at[np.repeat(sound, counts)], np.where(sound, counts, 0)
                pairs, pair_at = np.unique(found.pairs, return_inverse=True)
                times = np.bincount(pair_at, weights=np.repeat(np.bincount(at, minlength=len(words)), found.n_links), minlength=len(pairs)).astype(np.int64)
                shas, places, edge = [], at.tolist(), 0
                for n in counts.tolist():
                    shas.append(hashlib.sha256(b";".join(map(found.text.__getitem__, places[edge : edge + n]))).hexdigest() if n else "")
                    edge += n
                totals = [pa.array(sums(x[at], counts)) for x in (found.n_a, found.n_b, found.n_groups, found.n_links)]
                n, schema = len(texts), _schema()
                yield pa.record_batch([pa.array([number]), pa.array([1], pa.int32()), *[pa.nulls(1, f.type) for f in list(schema)[2:8]], pa.array([found.n_links.astype("<u4").tobytes()]), pa.array([pair_at.astype("<u4").tobytes()]), pa.array([pairs]), pa.array([times])], schema=schema)
                yield pa.record_batch([pa.array(np.full(n, number)), pa.array(np.full(n, 2, np.int32)), batch.column(0).slice(start, n), *totals, pa.array(shas), binary_column(at.astype("<u4"), counts), *[pa.nulls(n, f.type) for f in list(schema)[9:]]], schema=schema)
                number += 1

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, _SLICE_ROWS)


def _schema() -> pa.Schema:
    long, many = pa.int64(), pa.list_(pa.int64())
    kinds = [long, pa.int32(), long, long, long, long, long, pa.string(), pa.binary(), pa.binary(), many, many]
    return pa.schema([(c.split()[0], k) for c, k in zip(_SLICE_ROWS.split(", "), kinds, strict=True)])


def pair_counts(held: DataFrame) -> DataFrame:
    """(pair, n, best) over the corpus: its links, and whether no other pair of its B id has more."""
    found = held.where("kind = 1").select(F.explode(F.arrays_zip("pairs", "times")).alias("p")).groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.times").alias("n")).where("n > 0")
    counts = cut(found.withColumn("b", F.col("pair").bitwiseAND((1 << 32) - 1)), "pair-counts")
    return counts.join(counts.groupBy("b").agg(F.max("n").alias("most")), "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def align(docs: DataFrame, byte_path: str, piece_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row.

    Null and empty texts, and those that a tokenizer doesn't give back byte for byte after a space, have zeros and ''; texts of any length are aligned whole;
    ties for a B id's highest count are all best; repeated rows count as often as they stand and each has its row, as has a null doc_id; an empty table gives no rows; other
    columns are left out, so their names can't clash."""
    held = cut(aligned_slices(docs, byte_path, piece_path, id_col, text_col), "aligned", "zstd")
    own = held.where("kind = 1").select("slice", F.posexplode("pairs").alias("place", "pair"))
    # a pair stands in a slice once, so it has at most as many rows here as there are slices
    told = own.join(pair_counts(held), "pair", "left").select("slice", F.lit(0).alias("kind"), "place", "n", "best")
    rest = held.select("slice", "kind", F.lit(0).alias("place"), F.lit(None).cast("long").alias("n"), F.lit(None).cast("boolean").alias("best"), *held.columns[2:10])
    stream = rest.unionByName(told, allowMissingColumns=True).repartition("slice").sortWithinPartitions("slice", "kind", "place")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counted: list[np.ndarray] = []
        bests: list[np.ndarray] = []
        current, word_sum, word_best = None, None, None
        for batch in batches:
            col = {f.name: batch.column(i) for i, f in enumerate(batch.schema)}
            number, kind = col["slice"].to_numpy(), col["kind"].to_numpy()
            edges = [0, *(np.flatnonzero((np.diff(number) != 0) | (np.diff(kind) != 0)) + 1).tolist(), batch.num_rows]
            for x, y in zip(edges, edges[1:], strict=False):
                if x == y:
                    continue
                if number[x] != current:
                    current, counted, bests = number[x], [], []
                if kind[x] == 0:
                    counted.append(col["n"].slice(x, y - x).fill_null(0).to_numpy())
                    bests.append(col["best"].slice(x, y - x).fill_null(False).to_numpy(zero_copy_only=False))
                elif kind[x] == 1:
                    n_links, link_at = (np.frombuffer(col[c][x].as_py(), "<u4").astype(np.int64) for c in ("at", "links"))
                    n, best = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in (counted, bests))
                    word_sum, word_best = sums(n[link_at], n_links), sums(best[link_at].astype(np.int64), n_links)
                else:
                    some = col["at"].slice(x, y - x)
                    at, counts = flat_values(some, "<u4"), pc.binary_length(some).to_numpy(zero_copy_only=False).astype(np.int64) // 4
                    part = {c: col[c].slice(x, y - x) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")}
                    part |= {"n_best": pa.array(sums(word_best[at], counts)), "count_sum": pa.array(sums(word_sum[at], counts))}
                    yield pa.record_batch(part)

    return stream.mapInArrow(run, "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long")
