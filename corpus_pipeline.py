"""A corpus pipeline of five stages, each an operator of ``folio.llm`` over all that the stage before it kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from folio.llm.exact_dedup import without_copies
from folio.llm.line_crf import without_low_quality
from folio.llm.packing import pack
from folio.llm.simhash import without_near_copies
from folio.llm.toxicity import without_toxic
from folio.session import bound_batches
from folio.storage import discard, new_folder, scope

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.7 or more for toxicity go.

    Null and empty texts are scored as empty, repeated rows alike (each stays or goes by itself); a text of any length is scored whole; a score of 0.7 itself goes; an
    empty table stays empty; all columns of ``docs`` come out as they were, whatever their names."""
    bound_batches(spark)
    return without_toxic(docs, _labels(spark, sf_dir))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under 0.3 for quality go.

    Null and empty texts are scored as a text without lines, repeated rows alike; a text of any length is scored whole; a score of 0.3 itself stays; an empty table stays
    empty; all columns of ``docs`` come out as they were, whatever their names."""
    bound_batches(spark)
    return without_low_quality(docs, _labels(spark, sf_dir))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal without white space, the longest stays, then the smallest doc_id (null last), then any one of repeated rows.

    Null and empty texts are one group; a text of any length is compared whole; an empty table stays empty; all columns come out as they were, whatever their names."""
    bound_batches(spark)
    return without_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that a Jaccard similarity of five-word shingles of 0.8 or more joins, the one with the smallest doc_id stays.

    Null counts as empty, and texts of fewer words are one shingle; of repeated rows any one stays, a null doc_id is the largest; a text of any length is compared whole; an
    empty table stays empty; all columns come out as they were, whatever their names."""
    bound_batches(spark)
    return without_near_copies(docs, words=5, similar=0.8)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens: a row for each piece.

    Null and empty texts are one token; a text of any length is cut into as many pieces as it needs; repeated rows and null doc_ids are documents of their own, in any order among
    equals; an empty table gives no rows; other columns are left out, so their names can't clash."""
    import public_tokenizers

    bound_batches(spark)
    return pack(docs, str(public_tokenizers.path("word_bpe_49k.json")), 1, 2048)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", toxicity),
    ("quality_classifier", quality),
    ("exact_dedup", exact_dedup),
    ("simhash_near_dedup", near_dedup),
    ("packing", packing),
]

#: The first two stages train models, which SQL can't express; tests hold the pipeline against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``. Each one's result is written to the shared folder and read again; what a stage has written for itself goes then,
    and so does the result before the last."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES[:-1]:
        path = new_folder(spark, f"stage-{name}")
        with scope():
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            discard(before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
