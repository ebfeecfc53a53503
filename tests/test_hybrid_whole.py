"""Hybrid search takes documents and queries without a vector."""

from __future__ import annotations

from folio.catalog.retrieval import hybrid_search


def test_documents_and_queries_without_vectors(spark, tmp_path):
    docs = [(i, f"title{i} apple pie number{i}", "en", "s", 30) for i in (0, 1, 2, 100, 101)] + [(300, "zebra crossing", "en", "s", 14), (301, "zebra stripes", "en", "s", 13)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, [1.0, float(i)], 0) for i in (0, 1, 2)], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    found = hybrid_search(spark, str(tmp_path)).collect()
    assert {r.query for r in found} == {0, 100, 300}
    assert {r.id for r in found if r.query == 300} == {300, 301}
    assert 101 in {r.id for r in found if r.query == 100}
