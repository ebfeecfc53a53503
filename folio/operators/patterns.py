"""Which of many given strings stand in texts, by Aho-Corasick automata.

The strings are dealt in shards of at most ``SHARD`` characters. A task for each shard builds its automaton once and writes it to the shared
folder; tasks over the texts load what they need and run it over each text, so texts are read once, aren't shuffled, and are walked once a shard
however many strings it has.
"""

from __future__ import annotations

import functools
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.storage import new_folder, open_fs

#: Characters of a shard's strings: about 35 times as many bytes of automaton, which a task holds ``LOADED`` of.
SHARD, LOADED = 2_000_000, 2


def write_automata(patterns: DataFrame, key: str, pattern: str) -> list[str]:
    """Paths of the automata of ``patterns`` (key: long, pattern): one for each ``SHARD`` characters, as they are few the driver has them.

    A string that several keys have stands in the automaton once. Null strings stand nowhere."""
    rows = patterns.select(F.col(key).cast("long").alias("key"), F.col(pattern).alias("pattern")).where("pattern IS NOT NULL AND key IS NOT NULL").groupBy("pattern").agg(F.sort_array(F.collect_set("key")).alias("keys"))
    total = rows.agg(F.sum(F.length("pattern") + 1)).first()[0] or 0
    shards, folder = -(-total // SHARD), new_folder(patterns.sparkSession, "automata")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        fs, inner = open_fs(folder)
        fs.create_dir(inner, recursive=True)
        now, automaton, everywhere = None, None, []

        def flush() -> pa.RecordBatch:
            if len(automaton):
                automaton.make_automaton()
            with fs.open_output_stream(f"{inner}/{now}.pickle") as out:  # a repeated task writes the same
                out.write(pickle.dumps((automaton if len(automaton) else None, everywhere)))
            return pa.record_batch([pa.array([f"{folder}/{now}.pickle"])], names=["path"])

        for batch in batches:
            for shard, string, keys in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if shard != now:
                    if automaton is not None:
                        yield flush()
                    now, automaton, everywhere = shard, ahocorasick.Automaton(), []
                if string:
                    automaton.add_word(string, keys)
                else:
                    everywhere = keys  # the empty string stands in every text
        if automaton is not None:
            yield flush()

    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("pattern"), F.lit(max(1, shards)))).repartition(max(1, shards), "shard").sortWithinPartitions("shard")
    return sorted(r.path for r in dealt.select("shard", "pattern", "keys").mapInArrow(run, "path string").collect())


@functools.lru_cache(maxsize=LOADED)
def _load(path: str) -> tuple[object, list[int]]:
    fs, inner = open_fs(path)
    with fs.open_input_stream(inner) as stream:
        return pickle.loads(stream.read())


def contained(texts: DataFrame, patterns: DataFrame, id_col: str = "doc_id", text_col: str = "text", key: str = "item_id", pattern: str = "text", key_name: str = "item_id") -> DataFrame:
    """(id_col, key_name, n): for each text the keys of the strings that it holds letter for letter, with how often they begin in it.

    Null texts hold nothing; an empty string stands once in every text; repeated texts have their rows each; overlapping and nested finds count."""
    paths = write_automata(patterns, key, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in paths:
                automaton, everywhere = _load(path)
                rows: list[int] = []
                keys: list[int] = []
                times: list[int] = []
                for row, text in enumerate(batch.column(1)):
                    if not text.is_valid:
                        continue
                    found: dict[int, int] = dict.fromkeys(everywhere, 1)
                    for _, own in automaton.iter(text.as_py()) if automaton else ():
                        for k in own:
                            found[k] = found.get(k, 0) + 1
                    rows += [row] * len(found)
                    keys += found
                    times += found.values()
                yield pa.record_batch([batch.column(0).take(pa.array(np.array(rows, np.int64))), pa.array(keys, pa.int64()), pa.array(times, pa.int64())], names=["id", "key", "n"])

    kind = dict(texts.dtypes)[id_col]
    return texts.select(id_col, text_col).mapInArrow(run, f"id {kind}, key long, n long").toDF(id_col, key_name, "n")


def bind_images(chunks: DataFrame, images: DataFrame) -> DataFrame:
    """``chunks`` (doc_id, content, img_url, asset_id, ...) with the link and asset of the first of their document's images whose syntax their content holds.

    images: doc_id, n (their order), raw, img_url, asset_id; those without a link or syntax don't count. Chunks that have a link keep theirs. Images meet the chunks of their own
    document only, as a list, so a chunk stays one row."""
    known = images.where("img_url IS NOT NULL AND img_url <> '' AND raw <> ''").groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("n", "raw", "img_url", "asset_id"))).alias("__images"))
    first = F.get(F.filter("__images", lambda i: F.contains(F.coalesce("content", F.lit("")), i["raw"])), F.lit(0))
    joined = chunks.join(known, "doc_id", "left").withColumn("__first", F.when(F.coalesce("img_url", F.lit("")) == "", first))
    bound = joined.withColumn("img_url", F.coalesce("__first.img_url", "img_url")).withColumn("asset_id", F.coalesce("__first.asset_id", "asset_id"))
    return bound.select(*chunks.columns)

