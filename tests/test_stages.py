"""Table functions, embedding, run logs and conditions on metadata."""

from __future__ import annotations

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from folio.functions.splitting import parents_by_text, sections, split_parents
from folio.operators import dense
from folio.plans import embedding
from folio.runlog import RunLog
from folio.session import bound_batches
from folio.storage import new_folder

LINES = ["# one", "## two ", "## two", "### three  x", "#no heading", "```", "~~~ x", "  ```", "text " * 30, "short", "", "  ", "#### \t deep", "中文。" * 40, "## a > b", "###### six", "## \r", "x\ty", "## tail\r"]


def test_one_table_function_gives_the_same_families(spark):
    rnd = random.Random(6)
    texts = ["", " \n ", None, "no heading", "## only heading", *("\n".join(rnd.choice(LINES) for _ in range(rnd.randint(1, 30))) for _ in range(120))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    sizes = {"child_size": 80, "child_overlap": 20, "parent_size": 300, "parent_overlap": 40}
    got = parents_by_text(docs, **sizes)
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString().replace("REPARTITION_BY_NUM", "").replace("Exchange RoundRobin", "")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, split_parents(sections(docs), **sizes).collect()))


def test_only_new_contents_are_embedded(spark, tmp_path):
    store = f"file://{tmp_path}/vectors"
    calls = spark.sparkContext.accumulator(0)

    def embed(texts):
        calls.add(1)
        if len(texts) > 64:
            raise ValueError("too many")
        return [[float(len(t)), 1.0] for t in texts]

    rows = spark.createDataFrame([(i, f"text {i % 200}") for i in range(1000)] + [(2000, None), (2001, "  ")], "id long, content string").repartition(5)
    first = embedding.embedded(rows, embed, store, wait=0.0)
    assert {r.id: r.embedding for r in first.collect()} == {**{i: [float(len(f"text {i % 200}")), 1.0] for i in range(1000)}, 2000: None, 2001: None}
    assert 4 <= calls.value <= 200 and first.count() == 1002
    assert embedding.embed_new(rows, embed, store) == 0
    before = calls.value
    more = rows.unionByName(spark.createDataFrame([(3000, "a new one"), (3001, "a new one")], "id long, content string"))
    assert embedding.embed_new(more, embed, store) == 1 and calls.value == before + 1


def test_a_failing_call_is_tried_again(spark, tmp_path):
    tried = []

    def twice(texts):
        tried.append(len(texts))
        if len(tried) < 3:
            raise OSError("busy")
        return [[0.0]] * len(texts)

    assert embedding.call(twice, ["a", "b"], wait=0.0) == [[0.0], [0.0]] and tried == [2, 2, 2]
    with pytest.raises(ValueError):
        embedding.call(lambda texts: [], ["a"], wait=0.0)

    def never(texts):
        raise OSError("gone")

    store = f"file://{tmp_path}/vectors"
    rows = spark.createDataFrame([(1, "x")], "id long, content string")
    with pytest.raises(Exception, match="gone"):
        embedding.embed_new(rows, never, store, wait=0.0)
    assert embedding.embed_new(rows, lambda texts: [[1.0]] * len(texts), store) == 1  # nothing was written by the failed one


def test_nodes_and_batches_are_logged(spark, small):
    from folio.streaming import events as S

    log = RunLog(spark, new_folder(spark, "runlog"), "run-1")
    docs = spark.read.parquet(f"{small}/documents.parquet")
    few = log.node("few", docs.where("doc_id % 2 = 0"))
    log.node("grouped", few.groupBy("lang").count())
    with log.streams():
        rows = S.run_to_end(S.read_events(spark, f"{small}/event[s].parquet").select("event_id"))
    log.save()
    told = {r.node: r for r in log.table().collect()}
    assert told["few"].rows == few.count() and told["grouped"].rows == docs.select("lang").distinct().count()
    assert sum(r.rows for n, r in told.items() if "/" in n) == rows.count() and all(r.ms > 0 for n, r in told.items() if "/" not in n)


def test_conditions_on_metadata(spark):
    rows = spark.createDataFrame([(1, "a.md", "x > yes", ["t"]), (2, "a.md", None, ["t", "u"]), (3, "b.md", "yes", None)], "id long, filepath string, heading_path string, tags array<string>")
    found = lambda **c: sorted(r.id for r in rows.where(dense.metadata_where(**c)).collect())
    assert found(filepath="a.md") == [1, 2] and found(heading="yes") == [1, 3] and found(tag="u") == [2] and found(filepath="a.md", heading="yes", tag="t") == [1]
    assert dense.metadata_where() is None and rows.where(F.lit(True)).count() == 3


def test_rows_go_to_python_in_small_batches(spark):
    """30 MB of texts by Spark's own setting come in batches of about 4 MB; a session's own size stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    fresh = spark.newSession()
    own = fresh.conf.get(name, None)
    try:
        bound_batches(fresh)
        assert fresh.conf.get(name) == (own or "4m")
        fresh.conf.unset(name)
        if fresh.conf.get(name, None) is None:
            bound_batches(fresh)
            sizes = fresh.range(0, 10_000, 1, 1).selectExpr("repeat('x', 3000) AS t").mapInArrow(lambda batches: (pa.record_batch([pa.array([b.nbytes])], names=["n"]) for b in batches), "n long").collect()
            assert max(r.n for r in sizes) < 5_000_000
    finally:
        if own:
            fresh.conf.set(name, own)
