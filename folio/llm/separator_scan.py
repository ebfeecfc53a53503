"""Token counts by a scan for end-of-document ids in flat token files that have no index.

A file is split into blocks at fixed byte positions. Each task reads blocks and finds the
separators with numpy; a document that crosses blocks is put together by a prefix scan over
the blocks of its file: the last separator before a block is where its first document begins.
Positions are counts of ids, not bytes; files hold little-endian ids of one width.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folio.llm.encoding import ENCODED_BYTES, shared_encoder, slices, with_end
from folio.llm.ranked_varint import id_width
from folio.storage import cut, new_folder, open_fs

FILE_TOKENS = 16_000_000
BLOCK_TOKENS = 1_000_000
#: Blocks whose counts are summed first in the prefix scan.
RUN = 1024
#: Tasks that scan blocks at most; beyond, a task takes several blocks one after another.
MOST_TASKS = 20_000


def write_flat_files(docs: DataFrame, tokenizer_path: str, end_id: int, folder: str, file_tokens: int = FILE_TOKENS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes each text's ids and ``end_id`` to flat files; (path, file, ordinal, doc_id) says which document of which file each row became.

    The strings of special tokens in a text are encoded as ordinary text, so ``end_id`` only ever ends a document."""
    width = id_width(tokenizer_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        part, attempt = context.partitionId(), context.taskAttemptId()
        fs, inner = open_fs(folder)
        fs.create_dir(inner, recursive=True)
        encoder = shared_encoder(tokenizer_path, plain_special=True)
        seq, in_file, ordinal, out, name = 0, 0, 0, None, ""
        for batch in batches:
            for at, texts in slices(batch.column(1), ENCODED_BYTES, encoder):
                flat, counts = with_end(*encoder.encode(texts), end_id)
                if out is None:
                    name = f"flat-{part:06d}-{seq:04d}-{attempt}.bin"
                    out = fs.open_output_stream(f"{inner}/{name}")
                out.write(flat.astype(width).tobytes())
                n = len(counts)
                yield pa.record_batch(
                    [pa.array([f"{folder}/{name}"] * n), pa.array(np.full(n, part << 20 | seq, np.int64)), pa.array(ordinal + np.arange(n, dtype=np.int64)), batch.column(0).slice(at, n), pa.array(counts)],
                    names=["path", "file", "ordinal", "doc_id", "written"],
                )
                in_file, ordinal = in_file + len(flat), ordinal + n
                if in_file >= file_tokens:
                    out.close()
                    seq, in_file, ordinal, out = seq + 1, 0, 0, None
        if out is not None:
            out.close()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "path string, file long, ordinal long, doc_id long, written long")


def scan(files: DataFrame, separator: int, width: str = "<u2", block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """A row for each document in ``files`` (path, file, n_ids): file, ordinal, start (in its file), n_tokens with the separator, ended.

    Ids after a file's last separator are a document with ``ended`` false; an empty file gives no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = np.dtype(width).itemsize
        for batch in batches:
            rows = batch.to_pydict()
            for path, file, block, n_ids in zip(rows["path"], rows["file"], rows["block"], rows["n_ids"], strict=True):
                fs, inner = open_fs(path)
                first = block * block_tokens
                with fs.open_input_file(inner) as source:
                    ids = np.frombuffer(source.read_at(size * min(block_tokens, n_ids - first), size * first), width)
                ends = first + np.flatnonzero(ids == separator)
                yield pa.record_batch(
                    [pa.array([file]), pa.array([block]), pa.array([n_ids]), pa.array([len(ends)]), pa.array([int(ends[-1]) if len(ends) else None], pa.int64()), pa.array([ends.tolist()], pa.list_(pa.int64()))],
                    names=["file", "block", "n_ids", "n_ends", "last_end", "ends"],
                )

    spark = files.sparkSession
    some = files.where("n_ids > 0")
    n_tasks = some.agg(F.coalesce(F.sum(F.ceil(F.col("n_ids") / F.greatest(F.lit(block_tokens), F.lit(BLOCK_TOKENS)))), F.lit(0))).first()[0]
    blocks = some.select("path", "file", "n_ids", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n_ids") - 1) / block_tokens))).alias("block"))
    # a task for each block or BLOCK_TOKENS ids, said outright: adaptive execution would join these few bytes a row in one task
    dealt = blocks.repartition(int(max(1, min(n_tasks, MOST_TASKS))), "file", "block")
    path = new_folder(spark, "block-ends")
    dealt.mapInArrow(run, "file long, block long, n_ids long, n_ends long, last_end long, ends array<long>").write.parquet(path)
    found = spark.read.parquet(path)

    spread = found.join(carries(found).hint("merge"), ["file", "block"])
    # the last block also closes what follows the last separator
    is_last = (F.col("block") + 1) * block_tokens >= F.col("n_ids")
    edges = F.when(is_last & (F.coalesce(F.array_max("ends"), F.col("carry") - 1) < F.col("n_ids") - 1), F.concat("ends", F.array(F.col("n_ids") - 1))).otherwise(F.col("ends"))
    spread = spread.withColumn("edges", edges).select("*", F.posexplode("edges").alias("i", "end"))
    start = F.when(F.col("i") == 0, F.col("carry")).otherwise(F.get("edges", F.col("i") - 1) + 1)
    return spread.select("file", (F.col("done") + F.col("i")).alias("ordinal"), start.alias("start"), (F.col("end") - start + 1).alias("n_tokens"), (F.col("i") < F.size("ends")).alias("ended"))


def carries(found: DataFrame, run: int = RUN) -> DataFrame:
    """(file, block, carry, done): where each block's first document begins, and how many documents end before the block.

    A prefix scan in two levels over (file, block, n_ends, last_end): runs of ``run`` blocks are summed first, so no task holds more than
    a run's blocks, or one row for each run of a file."""
    narrow = found.select("file", "block", F.floor(F.col("block") / run).alias("run"), "n_ends", "last_end")
    runs = narrow.groupBy("file", "run").agg(F.sum("n_ends").alias("n_ends"), F.max("last_end").alias("last_end"))
    earlier = Window.partitionBy("file").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("file", "run", F.max("last_end").over(earlier).alias("run_end"), F.coalesce(F.sum("n_ends").over(earlier), F.lit(0)).alias("run_done"))
    before = Window.partitionBy("file", "run").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    within = narrow.select("file", "run", "block", F.max("last_end").over(before).alias("own_end"), F.coalesce(F.sum("n_ends").over(before), F.lit(0)).alias("own_done"))
    carry = F.coalesce("own_end", "run_end", F.lit(-1)) + 1
    return within.join(runs.hint("merge"), ["file", "run"]).select("file", "block", carry.alias("carry"), (F.col("own_done") + F.col("run_done")).alias("done"))


def token_counts(spark: SparkSession, docs: DataFrame, tokenizer_path: str, end_id: int, file_tokens: int = FILE_TOKENS, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Writes ``docs`` to flat files and counts each document's ids by the scan: doc_id, file, start, n_tokens.

    Null and empty texts are one id; a text of any length is encoded whole and may cross blocks; repeated rows stay apart (a row is told
    by its place in its file, so there are no ties); a null doc_id stays null; an empty table gives no rows; other columns are left out,
    so their names can't clash."""
    written = cut(write_flat_files(docs, tokenizer_path, end_id, new_folder(spark, "flat"), file_tokens), "flat-rows")
    files = cut(written.groupBy("path", "file").agg(F.sum("written").alias("n_ids")), "flat-files")
    found = scan(files, end_id, id_width(tokenizer_path), block_tokens)
    return found.join(written.select("file", "ordinal", "doc_id").hint("merge"), ["file", "ordinal"]).select("doc_id", "file", "start", "n_tokens")
