"""The pipeline against the same stages done plainly."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F
from brute import normal, similar_left

from folio.llm import line_crf, toxicity
from folio.llm.labelled import training_rows

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_pipeline(spark):
    small = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{small}/documents.parquet")
    labels = spark.read.parquet(f"{small}/labels.parquet")
    left, steps = docs, [docs.orderBy("doc_id").collect()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        path = f"{corpus_pipeline.new_folder(spark, name)}"
        stage(spark, left, small).write.parquet(path)
        left = spark.read.parquet(path)
        assert left.columns == docs.columns
        steps.append(left.orderBy("doc_id").collect())

    model = toxicity.train(training_rows(docs, labels, "toxic", ~toxicity.held_out(F.col("doc_id")), toxicity.MAX_ROWS))
    score = model.score(toxicity.Featurizer(model.lexicon).features([r.text for r in steps[0]]))
    want = [r for r, s in zip(steps[0], score, strict=True) if s < 0.7]
    assert steps[1] == want and len(want) < len(steps[0])

    rest = spark.createDataFrame(want, docs.schema)
    crf = line_crf.train(training_rows(rest, labels, "quality", ~line_crf.held_out(F.col("doc_id")), line_crf.MAX_ROWS))
    share = crf.good_share(*line_crf.line_features([r.text for r in want]))[0]
    want = [r for r, s in zip(want, crf.calibration.apply(share), strict=True) if s >= 0.3]
    assert steps[2] == want and len(want) < len(steps[1])

    best = {}
    for r in want:
        key = normal(r.text)
        if key not in best or (-len(r.text), r.doc_id) < (-len(best[key].text), best[key].doc_id):
            best[key] = r
    want = sorted(best.values(), key=lambda r: r.doc_id)
    assert steps[3] == want and len(want) < len(steps[2])

    want = similar_left(want)
    assert steps[4] == want

    packed = corpus_pipeline.run(spark, small).collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in want}
    used = {}
    for r in packed:
        used[r.sequence_id] = used.get(r.sequence_id, 0) + r.length
    assert max(used.values()) <= 2048
