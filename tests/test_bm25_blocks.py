"""BM25 by blocks against the plain search."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from folio.operators import bm25, bm25_blocks


def _plain(index, asked, k):
    found = bm25.scores(index, asked).withColumn("score", F.round("score", 6))
    return sorted((r.query, r.id, r.score, r.rank) for r in bm25.top_k(found, k).collect())


def _blocks(index, asked, k):
    return sorted((r.query, r.id, r.score, r.rank) for r in bm25_blocks.search(index, asked, k).collect())


@pytest.fixture(scope="module")
def docs(spark):
    """Two languages that share few words, copies, an empty and a null text."""
    rnd = random.Random(4)
    words = {"a": [f"a{i}" for i in range(60)], "b": [f"b{i}" for i in range(60)]}
    rows = [(i, " ".join(rnd.choice(words["ab"[i % 2]]) for _ in range(rnd.randint(1, 40))) + (" both" if i % 5 == 0 else "")) for i in range(600)]
    rows += [(i, rows[i % 7][1]) for i in range(600, 640)] + [(700, ""), (701, None), (702, "a1 a1 a1")]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(4)


@pytest.mark.parametrize("size", [16, 256])
def test_the_same_rows(spark, docs, monkeypatch, size):
    monkeypatch.setattr(bm25_blocks, "BLOCK", size)
    monkeypatch.setattr(bm25_blocks, "QUERIES", 3)
    plain = bm25.build_index(docs)
    index = bm25_blocks.build_index(plain)
    asked = bm25.query_tokens(docs.where("doc_id % 9 = 0").select(F.col("doc_id").alias("query"), F.concat_ws(" ", "text", F.lit("unknown")).alias("text")))
    for k in (1, 5, 200):
        assert _blocks(index, asked, k) == _plain(plain, asked, k)


def test_blocks_are_left_out_and_few_rows_come_out(spark, docs, monkeypatch):
    monkeypatch.setattr(bm25_blocks, "BLOCK", 16)
    index = bm25_blocks.build_index(bm25.build_index(docs))
    asked = bm25.query_tokens(docs.where("doc_id % 10 = 0").select(F.col("doc_id").alias("query"), "text"))
    seen = bm25_blocks.looked_into(index, asked, 5).agg(F.sum("blocks").alias("b"), F.sum("left_out").alias("l")).first()
    assert seen.l > 0.25 * seen.b
    # what a search shuffles: rows of queries and blocks, and hits, not of queries and documents
    vectors = index.vocabulary.join(asked, "token").groupBy("query").agg(F.sort_array(F.collect_list(F.struct("number", (F.col("qtf") * F.col("weight")).alias("w")))).alias("v"))
    vectors = vectors.select("query", F.col("v.number").alias("asked"), F.col("v.w").alias("weights"))
    pairs = index.blocks.select("block").crossJoin(F.broadcast(vectors.select("query"))).withColumn("least", F.lit(float("-inf")))
    n_queries, n_docs = vectors.count(), docs.count()
    assert bm25_blocks._scored(index, pairs, vectors, 5).count() < 0.5 * n_queries * n_docs


def test_saved_blocks(spark, docs, tmp_path):
    index = bm25_blocks.build_index(bm25.build_index(docs))
    asked = bm25.query_tokens(spark.createDataFrame([(0, "a1 both"), (1, "nothing known"), (2, "")], "query long, text string"))
    index.save(f"file://{tmp_path}/blocks")
    again = bm25_blocks.load_index(spark, f"file://{tmp_path}/blocks")
    got = _blocks(again, asked, 10)
    assert got == _blocks(index, asked, 10) and {g[0] for g in got} == {0}


def test_no_documents(spark, docs):
    index = bm25_blocks.build_index(bm25.build_index(docs.where("1 = 0")))
    assert _blocks(index, bm25.query_tokens(docs.select(F.col("doc_id").alias("query"), "text")), 3) == []
