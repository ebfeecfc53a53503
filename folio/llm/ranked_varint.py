"""Token files: frequency-ranked ids in byte-aligned variable-length coding with separate control bytes.

Ids are replaced by their rank in the whole corpus (0: the most frequent; ties by id), so
that most values take one byte. A file holds, in ascending doc_id order,

    header    8 little-endian uint64: MAGIC, version, documents, values, control bytes, data bytes, 0, 0
    doc_ids   int64 for each document, then a uint8 each: 1 if the doc_id was null
    counts    uint32 for each document: its values
    control   two bits for each value, four values a byte, lowest bits first: data bytes less one
    data      each value's low bytes, least significant first

and is decoded with numpy by a table from control byte to four lengths.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folio.llm.encoding import ENCODED_BYTES, binary_column, flat_values, shared_encoder, slices, with_end
from folio.storage import cut, new_folder, open_fs

MAGIC = 0x544B52414E4B3031
#: Values after which a writer begins another file.
FILE_VALUES = 4_000_000
#: Tasks that read files back at most; beyond, a task reads several files one after another.
MOST_TASKS = 20_000
#: Four lengths (1 to 4) of each control byte.
LENGTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3) + 1
KEEP = np.array([0, 0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], np.uint32)


def pack_values(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(control, data) bytes of non-negative values below 2**32."""
    values = values.astype(np.uint32)
    lengths = 1 + (values > 0xFF).astype(np.uint8) + (values > 0xFFFF) + (values > 0xFFFFFF)
    codes = np.zeros(-(-len(values) // 4) * 4, np.uint8)
    codes[: len(values)] = lengths - 1
    control = (codes.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(axis=1, dtype=np.uint8)
    wanted = np.arange(4) < lengths[:, None]
    return control, values.astype("<u4").view(np.uint8).reshape(-1, 4)[wanted]


def unpack_values(control: np.ndarray, data: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` values of ``pack_values``."""
    lengths = LENGTHS[control].reshape(-1)[:n]
    at = np.cumsum(lengths) - lengths
    padded = np.concatenate([data, np.zeros(4, np.uint8)])
    four = np.lib.stride_tricks.sliding_window_view(padded, 4)[at]
    return np.ascontiguousarray(four).view("<u4").reshape(-1) & KEEP[lengths]


def file_bytes(doc_ids: np.ndarray, nulls: np.ndarray, counts: np.ndarray, ranks: np.ndarray) -> bytes:
    control, data = pack_values(ranks)
    header = np.array([MAGIC, 1, len(counts), len(ranks), len(control), len(data), 0, 0], "<u8")
    return b"".join(x.tobytes() for x in (header, doc_ids.astype("<i8"), nulls.astype(np.uint8), counts.astype("<u4"), control, data))


def parse_file(content: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(doc_ids, nulls, counts, ranks)."""
    header = np.frombuffer(content, "<u8", 8)
    if int(header[0]) != MAGIC:
        raise ValueError("not a token file")
    docs, values, n_control, n_data = map(int, header[2:6])
    at = 64
    out = []
    for kind, n in (("<i8", docs), (np.uint8, docs), ("<u4", docs), (np.uint8, n_control), (np.uint8, n_data)):
        out.append(np.frombuffer(content, kind, n, at))
        at += out[-1].nbytes
    return out[0], out[1] > 0, out[2], unpack_values(out[3], out[4], values)


def encode_documents(docs: DataFrame, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids binary, n_tokens): each text's ids with ``end_id`` after them, as little-endian uint16 (uint32 if the vocabulary needs it).

    Null texts count as empty; a null or repeated doc_id stays one row each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = shared_encoder(tokenizer_path)
        width = "<u2" if encoder.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        for batch in batches:
            for at, texts in slices(batch.column(1), ENCODED_BYTES, encoder):
                flat, counts = with_end(*encoder.encode(texts), end_id)
                yield pa.record_batch([batch.column(0).slice(at, len(texts)), binary_column(flat.astype(width), counts), pa.array(counts)], names=["doc_id", "ids", "n_tokens"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, ids binary, n_tokens long")


def id_width(tokenizer_path: str) -> str:
    from tokenizers import Tokenizer

    return "<u2" if Tokenizer.from_file(tokenizer_path).get_vocab_size() <= 1 << 16 else "<u4"


def rank_table(encoded: DataFrame, width: str) -> np.ndarray:
    """ids by frequency, most frequent first: as many values as the vocabulary has at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            found = np.bincount(flat_values(batch.column(0), width))
            if len(found) > len(total):
                found[: len(total)] += total
                total = found
            else:
                total[: len(found)] += found
        seen = np.flatnonzero(total)
        yield pa.record_batch([pa.array(seen), pa.array(total[seen])], names=["id", "n"])

    rows = encoded.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    return np.array([r.id for r in sorted(rows, key=lambda r: (-r.n, r.id))], np.int64)


def write_files(encoded: DataFrame, by_rank: np.ndarray, width: str, folder: str) -> DataFrame:
    """Writes the token files in ascending doc_id order (null first); returns a row for each: part, seq, path, n_docs, n_values."""
    rank_of = np.zeros(int(by_rank.max()) + 1 if len(by_rank) else 1, np.uint32)
    rank_of[by_rank] = np.arange(len(by_rank))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        part, attempt = context.partitionId(), context.taskAttemptId()
        fs, inner = open_fs(folder)
        fs.create_dir(inner, recursive=True)
        held: list[tuple[pa.Array, np.ndarray, np.ndarray]] = []
        seq = values = 0

        def flush() -> pa.RecordBatch:
            nonlocal seq, values, held
            ids = pa.concat_arrays([h[0] for h in held])
            counts = np.concatenate([h[1] for h in held])
            content = file_bytes(ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False), counts, np.concatenate([h[2] for h in held]))
            name = f"tokens-{part:06d}-{seq:04d}-{attempt}.rvb"  # a repeated task writes files of its own; the rows name those that count
            with fs.open_output_stream(f"{inner}/{name}") as out:
                out.write(content)
            row = pa.record_batch([pa.array([part]), pa.array([seq]), pa.array([f"{folder}/{name}"]), pa.array([len(counts)]), pa.array([values])], names=["part", "seq", "path", "n_docs", "n_values"])
            held, values, seq = [], 0, seq + 1
            return row

        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                some = batch.slice(i, 256)
                flat = flat_values(some.column(1), width)
                counts = some.column(2).to_numpy()
                held.append((some.column(0), counts, rank_of[flat]))
                values += len(flat)
                if values >= FILE_VALUES:
                    yield flush()
        if held:
            yield flush()

    ordered = encoded.repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    return ordered.mapInArrow(run, "part long, seq long, path string, n_docs long, n_values long")


def with_starts(files: DataFrame) -> DataFrame:
    """Adds ``start``: the values in all files before. One row for each file of millions of values; summed by part first, so only parts meet in one task."""
    parts = files.groupBy("part").agg(F.sum("n_values").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    within = F.coalesce(F.sum("n_values").over(Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return files.join(parts.select("part", before.alias("before")), "part").withColumn("start", F.col("before") + within).drop("before")


def read_files(files: DataFrame, by_rank: np.ndarray) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the files of ``with_starts``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                fs, inner = open_fs(path)
                with fs.open_input_stream(inner) as stream:
                    doc_ids, nulls, counts, ranks = parse_file(stream.read())
                ids = by_rank[ranks].astype("<u4")
                ends = np.cumsum(counts, dtype=np.int64)
                view = memoryview(ids).cast("B")
                crc = np.fromiter((zlib.crc32(view[4 * a : 4 * b]) for a, b in zip((ends - counts).tolist(), ends.tolist(), strict=True)), np.int64, len(counts))
                yield pa.record_batch([pa.array(doc_ids, mask=nulls), pa.array(first + ends - counts), pa.array(counts.astype(np.int64)), pa.array(crc)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    # a task for each file up to MOST_TASKS, said outright: adaptive execution would join these few bytes a file in one task
    dealt = files.select("path", "start").repartition(max(1, min(files.count(), MOST_TASKS)), "path")
    return dealt.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(spark: SparkSession, docs: DataFrame, tokenizer_path: str, end_id: int = 0) -> tuple[DataFrame, np.ndarray]:
    """Encodes, ranks and writes ``docs``; returns the files (path, part, seq, n_docs, n_values, start) and the ids by rank."""
    width = id_width(tokenizer_path)
    encoded = cut(encode_documents(docs, tokenizer_path, end_id), "ids", "zstd")
    by_rank = rank_table(encoded, width)
    files = cut(write_files(encoded, by_rank, width, new_folder(spark, "tokens")), "token-files")
    return with_starts(files), by_rank


def digest(spark: SparkSession, docs: DataFrame, tokenizer_path: str, end_id: int = 0) -> DataFrame:
    """Writes the token files of ``docs`` and reads them back: a row for each document.

    Null and empty texts have only the end id; a text of any length is encoded whole; repeated rows stay apart, in any order among
    themselves (ties of frequency are ranked by id); a null doc_id comes first; an empty table gives no rows; other columns are left
    out, so their names can't clash."""
    files, by_rank = token_files(spark, docs, tokenizer_path, end_id)
    return read_files(files, by_rank)
