"""The vector index against the exact search."""

from __future__ import annotations

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from folio.operators import dense, vector_index


def _pairs(found):
    return {(r.query, r.id): r.similarity for r in found.collect()}


@pytest.fixture(scope="module")
def vectors(spark):
    """Twenty groups of near vectors, one vector that a third of the rows have, and rows without a vector or an id."""
    rnd = np.random.default_rng(5)
    centres = rnd.normal(size=(20, 24))
    rows = [(i, (centres[i % 20] + 0.4 * rnd.normal(size=24)).tolist()) for i in range(4000)]
    rows += [(i, centres[0].tolist()) for i in range(4000, 6000)] + [(None, centres[1].tolist()), (6001, None), (6002, [0.0] * 24)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(6)


def test_recall_of_given_vectors(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    asked = table.where("vec_id % 100 = 0")
    index = vector_index.build_index(table)
    exact, got = _pairs(dense.knn_join(table, asked, 50)), _pairs(vector_index.search(index, asked, 50))
    assert len(exact.keys() & got.keys()) >= 0.9 * len(exact)
    assert all(abs(exact[p] - s) < 1e-9 for p, s in got.items() if p in exact)
    assert _pairs(vector_index.search(index, asked, 50, probes=vector_index.MOST_CELLS, refined=0)).keys() == exact.keys()


def test_few_cells_hold_near_groups(spark, vectors, monkeypatch):
    monkeypatch.setattr(vector_index, "BLOCK", 256)
    asked = vectors.where("vec_id % 100 = 1 AND vec_id < 4000")
    index = vector_index.build_index(vectors)
    sizes = [r.n for r in index.lists.select(F.size("ids").alias("n")).collect()]
    assert sum(sizes) == 6001 and max(sizes) < 400  # the common vector lies in several blocks; every row with id and vector is in one
    exact, got = _pairs(dense.knn_join(vectors, asked, 10)), _pairs(vector_index.search(index, asked, 10))
    assert len(exact.keys() & got.keys()) >= 0.9 * len(exact)
    assert vector_index._model(index.model_path).probes < 40


def test_ties_of_a_common_vector_go_by_id(spark, vectors):
    index = vector_index.build_index(vectors)
    asked = vectors.where("vec_id = 5000")
    got = [r.id for r in vector_index.search(index, asked, 20).orderBy("rank").collect()]
    assert got == [r.id for r in dense.knn_join(vectors, asked, 20).orderBy("rank").collect()] == list(range(4000, 4020))


def test_saved_index_gives_the_same_rows(spark, vectors, tmp_path):
    index = vector_index.build_index(vectors)
    asked = vectors.where("vec_id % 500 = 0")
    index.save(f"file://{tmp_path}/index")
    again = vector_index.load_index(spark, f"file://{tmp_path}/index")
    assert _pairs(vector_index.search(again, asked, 5)) == _pairs(vector_index.search(index, asked, 5))


def test_empty_tables(spark, vectors):
    none = vectors.where("1 = 0")
    assert _pairs(vector_index.search(vector_index.build_index(vectors.limit(3)), none, 5)) == {}
    assert _pairs(vector_index.search(vector_index.build_index(none), vectors.limit(3), 5)) == {}


def test_a_sample_of_a_larger_table_is_bounded_below_the_driver(spark, monkeypatch):
    """Tasks pass on what the sample takes and not SAMPLE_ROWS each; repeated ids still leave a sample."""
    monkeypatch.setattr(vector_index, "SAMPLE_ROWS", 400)
    rows = spark.range(0, 20_000, 1, 8).selectExpr("id", "array(cast(id AS float), 1f) AS vector")
    got = vector_index._sample(rows, 20_000)
    assert 200 < len(got) <= 400
    least = rows.orderBy(F.xxhash64("id"), "id").limit(len(got)).toArrow()
    assert got["id"].to_pylist() == least["id"].to_pylist()
    assert len(vector_index._sample(rows.selectExpr("0L AS id", "vector"), 20_000)) == 400


def test_probes_hold_no_vectors(spark):
    vectors = spark.range(300).selectExpr("id AS vec_id", "array(cast(id % 17 AS float), cast(id % 5 AS float), 1f) AS embedding")
    index = vector_index.build_index(vectors)
    plan = vector_index.search(index, vectors.where("vec_id % 10 = 0"), 3)._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"MapInArrow probe\(.*\)#\d+, \[file#\d+, row#\d+, cell#\d+\]", plan), plan
