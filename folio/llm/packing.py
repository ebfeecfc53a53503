"""Minimum bin slack packing of tokenised documents into fixed-length sequences.

A document's ids are cut at multiples of the capacity, so it gives full pieces and one
remainder. How many pieces there are of each length is at most ``capacity`` numbers.
From them the driver plans patterns: the largest length that is left, and for the rest of
the window the multiset of remaining lengths that comes closest to it, found by subset
sums over bitsets and traced back to counts. A pattern is used as often as the counts
allow, so each one uses up a length: the plan has at most ``capacity`` patterns however
many documents there are. Each piece then finds its place from its number among the
pieces of its length, without any exchange of texts or ids.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folio.llm.encoding import ENCODED_BYTES, shared_encoder, slices, with_end
from folio.storage import cut


def pieces(docs: DataFrame, tokenizer_path: str, end_id: int, capacity: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens): each document's ids with ``end_id``, cut at multiples of ``capacity``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = shared_encoder(tokenizer_path)
        for batch in batches:
            for at, texts in slices(batch.column(1), ENCODED_BYTES, encoder):
                flat, counts = with_end(*encoder.encode(texts), end_id)
                view = memoryview(np.ascontiguousarray(flat.astype("<u4"))).cast("B")
                n = -(-counts // capacity)
                owner = np.repeat(np.arange(len(counts)), n)
                start = (np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)) * capacity
                length = np.minimum(capacity, counts[owner] - start)
                begin = (np.cumsum(counts) - counts)[owner] + start
                crc = np.fromiter((zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(begin.tolist(), (begin + length).tolist(), strict=True)), np.int64, len(owner))
                columns = [batch.column(0).slice(at, len(texts)).take(pa.array(owner)), *(pa.array(x.astype(np.int64)) for x in (start, length, crc, counts[owner]))]
                yield pa.record_batch(columns, names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


def fullest(counts: dict[int, int], room: int) -> dict[int, int]:
    """The multiset of lengths, at most ``counts`` of each, with the largest sum that is not over ``room``."""
    mask = (1 << (room + 1)) - 1
    reach, steps = 1, []
    for length in sorted((x for x, n in counts.items() if n and x <= room), reverse=True):
        left, group = min(counts[length], room // length), 1
        while left:
            take = min(group, left)
            steps.append((length, take, reach))
            reach |= (reach << (length * take)) & mask
            left, group = left - take, group * 2
        if reach >> room & 1:
            break
    total = reach.bit_length() - 1
    chosen: dict[int, int] = {}
    for length, take, before in reversed(steps):
        if not before >> total & 1:
            total -= length * take
            chosen[length] = chosen.get(length, 0) + take
    return chosen


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """[(times, {length: pieces of it in the window})]: every piece is in one window."""
    left, out = {x: n for x, n in counts.items() if n}, []
    while left:
        first = max(left)
        left[first] -= 1
        window = fullest(left, capacity - first)
        left[first] += 1
        window[first] = window.get(first, 0) + 1
        times = min(left[x] // n for x, n in window.items())
        for x, n in window.items():
            left[x] -= times * n
            if not left[x]:
                del left[x]
        out.append((times, window))
    return out


def places(planned: list[tuple[int, dict[int, int]]]) -> dict[int, tuple[np.ndarray, ...]]:
    """For each length, in the order of the plan: first piece number, pieces a window, first window, offset of the first of them."""
    rows: dict[int, list[tuple[int, int, int, int]]] = {}
    used: dict[int, int] = {}
    window = 0
    for times, chosen in planned:
        offset = 0
        for length in sorted(chosen, reverse=True):
            rows.setdefault(length, []).append((used.get(length, 0), chosen[length], window, offset))
            used[length] = used.get(length, 0) + times * chosen[length]
            offset += length * chosen[length]
        window += times
    return {x: tuple(np.array(c, np.int64) for c in zip(*r, strict=True)) for x, r in rows.items()}


def pack(docs: DataFrame, tokenizer_path: str, end_id: int = 1, capacity: int = 2048) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Null and empty texts are documents of one id; a text of any length is encoded whole and cut at multiples of ``capacity``; repeated rows
    are documents of their own; pieces of equal length take their places in row order, and of equally full windows the planner takes
    the one it finds first; a null doc_id stays null; an empty table gives no rows; other columns are left out, so their names can't clash."""
    cut_pieces = pieces(docs, tokenizer_path, end_id, capacity).withColumn("part", F.spark_partition_id()).withColumn("row", F.monotonically_increasing_id())
    held = cut(cut_pieces, "pieces")
    by_part = cut(held.groupBy("part", "length").agg(F.count("*").alias("n")), "piece-counts")
    counts = {r.length: r.n for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # capacity rows at most
    where = places(plan(counts, capacity))

    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    numbered = held.withColumn("number", F.row_number().over(Window.partitionBy("part", "length").orderBy("row")) - 1)
    numbered = numbered.join(by_part.select("part", "length", before.alias("before")).hint("merge"), ["part", "length"])  # both sides are dealt by these keys already
    numbered = numbered.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("number") + F.col("before")).alias("number"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, number = batch.column(2).to_numpy(), batch.column(5).to_numpy()
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for x in np.unique(length):
                mine = np.flatnonzero(length == x)
                first, each, window, at = where[int(x)]
                k = np.searchsorted(first, number[mine], side="right") - 1
                nth = number[mine] - first[k]
                sequence[mine], offset[mine] = window[k] + nth // each[k], at[k] + nth % each[k] * x
            yield pa.record_batch([*batch.columns[:5], pa.array(sequence), pa.array(offset)], names=[*batch.schema.names[:5], "sequence_id", "offset"])

    return numbered.mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
