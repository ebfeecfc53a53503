"""Exact duplicates by content-defined chunk recipes.

Each normalised text is cut where a hash of the bytes before a place has its low bits
zero, so equal texts have equal chunks and equal recipes: the ordered hashes of their chunks.
Only the texts whose recipe another row has too need a closer look: each task knows its own rows of
that kind, and cuts them again. Their chunks travel once: combined in each task, they are brought
together by hash and content, which gives each content a verified identifier (its hash, and its
number among the contents of that hash, nearly always 0). Documents are then compared by their
ordered identifier lists, and other texts never move.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.llm.encoding import slices
from folio.llm.rows import chooser, numbered, without_rows
from folio.llm.spread import spread_join
from folio.storage import cut

#: White space that the comparison leaves out.
WHITE = b" \t\n\x0b\x0c\r"
#: Bytes that decide on a cut; mean, least and largest chunk.
WINDOW, MEAN, LEAST, MOST = 16, 2048, 256, 16_384


def cut_points(content: bytes) -> list[int]:
    """Ends of the chunks of ``content``."""
    n = len(content)
    if n <= LEAST:
        return [n]
    value = np.frombuffer(content, np.uint8).astype(np.uint32)
    value = (value + np.uint32(1)) * np.uint32(2654435761)
    rolled, span = value, 1
    while span < WINDOW:  # rolled[i] covers the span bytes up to i; twice as many each time
        shifted = np.concatenate([np.zeros(span, np.uint32), rolled[:-span]])
        rolled = rolled * np.uint32(0x9E3779B1) ^ (shifted >> np.uint32(5)) + shifted * np.uint32(0x85EBCA77)
        span *= 2
    wanted = np.flatnonzero(rolled >> np.uint32(8) & np.uint32(MEAN - 1) == 0) + 1
    out, last = [], 0
    for at in [*wanted.tolist(), n]:
        while at - last > MOST:
            last += MOST
            out.append(last)
        if at - last >= LEAST or at == n and at > last:
            out.append(at)
            last = at
    return out


def normalise(text: str) -> bytes:
    return text.encode().translate(None, WHITE)


def _digest(chunk: bytes, hash_bits: int) -> int:
    return int.from_bytes(hashlib.blake2b(chunk, digest_size=8).digest(), "little", signed=True) & ((1 << hash_bits) - 1 if hash_bits < 64 else -1)


def recipes(docs: DataFrame, row: Column, hash_bits: int, id_col: str, text_col: str) -> DataFrame:
    """(row, doc_id, n_points, text_sha256, n_bytes, recipe): the text's length in code points as it was, and its chunks' hashes in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in slices(batch.column(2)):
                points, sha, size, lists = [], [], [], []
                for text in texts.to_pylist():
                    content = normalise(text)
                    ends = cut_points(content)
                    points.append(len(text))
                    sha.append(hashlib.sha256(content).hexdigest())
                    size.append(len(content))
                    lists.append([_digest(content[a:b], hash_bits) for a, b in zip([0, *ends], ends, strict=False)])
                yield pa.record_batch([batch.column(0).slice(at, len(texts)), batch.column(1).slice(at, len(texts)), pa.array(points, pa.int64()), pa.array(sha), pa.array(size, pa.int64()), pa.array(lists, pa.list_(pa.int64()))], names=["row", "doc_id", "n_points", "text_sha256", "n_bytes", "recipe"])

    rows = docs.select(row.alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "row long, doc_id long, n_points long, text_sha256 string, n_bytes long, recipe array<long>")


def chunks(docs: DataFrame, rows: DataFrame, key: str, hash_bits: int, text_col: str) -> DataFrame:
    """(hash, chunk): the chunks of the texts of ``rows``; those that a slice of a task holds twice come once. Other texts are not cut."""
    make = chooser(rows, "row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        among = make()
        for batch in batches:
            for _, texts in slices(batch.column(1).filter(pa.array(among(batch.column(0).to_numpy())))):
                found: dict[bytes, int] = {}
                for text in texts.to_pylist():
                    content = normalise(text)
                    ends = cut_points(content)
                    for a, b in zip([0, *ends], ends, strict=False):
                        chunk = content[a:b]
                        if chunk not in found:
                            found[chunk] = _digest(chunk, hash_bits)
                yield pa.record_batch([pa.array(list(found.values()), pa.int64()), pa.array(list(found.keys()), pa.binary())], names=["hash", "chunk"])

    return docs.select(key, F.col(text_col).cast("string").alias("text")).mapInArrow(run, "hash long, chunk binary")


def deduplicate(docs: DataFrame, hash_bits: int = 64, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) of every row.

    Texts are equal if they are the same bytes without ASCII white space; null counts as empty; a text of any length is compared whole. Of
    a group the row with the most code points stays, then the smallest doc_id (null last), then any one of repeated rows. An empty table
    gives no rows; other columns are left out, so their names can't clash. ``hash_bits`` shortens the chunk hash, for tests."""
    held, key = numbered(docs.select(id_col, text_col), "texts")
    joined = _grouped(held, key, hash_bits, id_col, text_col)
    return joined.select("doc_id", F.col("best.d").alias("keep_id"), "group_size", (F.col("row") == F.col("best.r")).alias("kept"), "text_sha256")


def without_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay by the rule of ``deduplicate``, as they were, with all their columns. Null and empty texts are one group;
    an empty table stays empty. Rows are told apart by a number that is written with them first."""
    held, key = numbered(docs)
    dropped = _grouped(held, key, 64, id_col, text_col).where("row <> best.r").select(F.col("row").alias(key))
    return without_rows(held, dropped, key).select(*docs.columns)


def _grouped(docs: DataFrame, key: str, hash_bits: int, id_col: str, text_col: str) -> DataFrame:
    """Every row's recipe, and of its group the size and the best row (p, z, d: doc_id, r: row)."""
    # lists are compared by 128 bits of them, so that no key is as long as a text has chunks
    told = recipes(docs, F.col(key), hash_bits, id_col, text_col).withColumns({"r1": F.xxhash64("recipe"), "r2": F.xxhash64(F.lit(1), "recipe")})
    held = cut(told.drop("recipe"), "recipes")
    shared = _shared_rows(held)
    contents = chunks(docs, shared, key, hash_bits, text_col).groupBy("hash", "chunk").agg(F.lit(1).alias("one")).select("hash", "chunk")
    clashes = cut(contents.withColumn("number", F.row_number().over(Window.partitionBy("hash").orderBy("chunk")) - 1).where("number > 0"), "clashes")
    keyed = held.withColumn("clash", F.lit("")) if clashes.isEmpty() else cut(_tell_apart(docs, held, clashes, hash_bits, text_col), "keyed")
    best = F.struct((-F.col("n_points")).alias("p"), F.col("doc_id").isNull().alias("z"), F.col("doc_id").alias("d"), F.col("row").alias("r"))
    by = ["r1", "r2", "n_bytes", "clash"]
    groups = cut(keyed.groupBy(*by).agg(F.count("*").alias("group_size"), F.min(best).alias("best")), "groups")
    return spread_join(keyed, groups, by)


def _shared_rows(held: DataFrame) -> DataFrame:
    """The rows whose recipe another row has too: the only ones whose chunks are looked at."""
    by = ["r1", "r2", "n_bytes"]
    groups = held.groupBy(*by).agg(F.count("*").alias("n")).where("n > 1").select(*by)
    return spread_join(held, cut(groups, "shared-recipes"), by).select("row")


def _tell_apart(docs: DataFrame, held: DataFrame, clashes: DataFrame, hash_bits: int, text_col: str) -> DataFrame:
    """Adds ``clash``: which of several contents of one hash stand where in a text. Needed only where two contents share a hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in slices(batch.column(0)):
                owner, place, value = [], [], []
                for i, text in enumerate(texts.to_pylist()):
                    content = normalise(text)
                    ends = cut_points(content)
                    for k, (a, b) in enumerate(zip([0, *ends], ends, strict=False)):
                        owner.append(i)
                        place.append(k)
                        value.append(content[a:b])
                sha = [hashlib.sha256(normalise(t)).hexdigest() for t in texts.to_pylist()]
                yield pa.record_batch([pa.array(sha).take(pa.array(owner, pa.int64())), pa.array(place, pa.int64()), pa.array([_digest(v, hash_bits) for v in value], pa.int64()), pa.array(value, pa.binary())], names=["text_sha256", "place", "hash", "chunk"])

    pieces = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "text_sha256 string, place long, hash long, chunk binary")
    found = pieces.join(clashes, ["hash", "chunk"]).select("text_sha256", "place", "number").distinct()
    marks = found.groupBy("text_sha256").agg(F.concat_ws(",", F.array_sort(F.collect_list(F.concat_ws(":", "place", "number")))).alias("mark"))
    return held.join(marks, "text_sha256", "left").withColumn("clash", F.coalesce("mark", F.lit(""))).drop("mark")
