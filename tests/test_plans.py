"""Index building, refreshing and search over a small folder of notes."""

from __future__ import annotations

from pyspark.sql import functions as F

from folio.plans import index_build
from folio.plans.search import agent_rounds, hybrid_search, with_neighbours
from folio.sources import notes, sinks


def _vault(tmp_path):
    (tmp_path / "ai").mkdir()
    (tmp_path / ".obsidian").mkdir()
    (tmp_path / "ai" / "rag.md").write_text("---\ntitle: RAG 入门\ntags: [ai, rag]\naliases: [检索增强]\n---\n# 概述\n用 [[search]] 检索。\n## 表\n| a | b |\n| - | - |\n| 1 | 2 |\n")
    (tmp_path / "search.md").write_text("# Search\nvector search finds near things\n## More\nsee [[检索增强]] and [[ghost]]\n")
    (tmp_path / "page one.html").write_text("<html><head><title>Page</title></head><body><h2>Part</h2><p>Text of the page</p><a href='search.html'>s</a></body></html>")
    (tmp_path / ".obsidian" / "x.md").write_text("# hidden")
    (tmp_path / "skip.txt").write_text("no")
    return str(tmp_path)


def test_scan_and_load(spark, tmp_path):
    docs = notes.load(notes.scan(spark, _vault(tmp_path))).orderBy("filepath").collect()
    assert [d.filepath for d in docs] == ["ai/rag.md", "page one.html", "search.md"]
    assert docs[0].title == "RAG 入门" and list(docs[0].tags) == ["ai", "rag"] and list(docs[0].wikilinks) == ["search"]
    assert docs[1].title == "Page" and "## Part" in docs[1].text and list(docs[1].wikilinks) == ["search"]
    assert docs[0].dir == "ai" and not docs[0].text.startswith("---")


def test_build_and_refresh(spark, tmp_path):
    root = _vault(tmp_path)
    docs = notes.load(notes.scan(spark, root)).persist()
    tables = index_build.build(docs)
    chunks = tables.chunks.collect()
    assert len({c.chunk_id for c in chunks}) == len(chunks)
    assert {c.chunk_class for c in chunks} == {"text", "extracted_summary", "front_matter"}
    assert any("《RAG 入门》" in c.content for c in chunks) and any(c.has_table for c in chunks)
    edges = {(e.src, e.dst) for e in tables.edges.collect()}
    assert ("ai/rag.md", "search.md") in edges and ("search.md", "ai/rag.md") in edges and ("search.md", "[[ghost]]") in edges
    again, changes = index_build.refresh(tables, docs)
    assert {c.change for c in changes.collect()} == {"unchanged"} and again.chunks.count() == len(chunks)
    fewer, changes = index_build.refresh(tables, docs.where("filepath <> 'search.md'"))
    assert fewer.chunks.where("filepath = 'search.md'").count() == 0


def test_search_and_rounds(spark):
    chunks = spark.createDataFrame(
        [(1, "red fox jumps", "Fox", "", "d", "text", None, [1.0, 0.0], "a.md"), (2, "blue hen sits", "Hen", "", "d", "image", None, [0.0, 1.0], "b.md"), (3, "green fox", "Third", "", "d", "text", None, [0.9, 0.1], "c.md")],
        "id long, content string, title string, heading_path string, dir string, kind string, parent_id string, embedding array<double>, filepath string",
    )
    asked = spark.createDataFrame([(10, "red fox diagram", [1.0, 0.0])], "query long, text string, embedding array<double>")
    found = hybrid_search(chunks, asked, final=2).orderBy("rank").collect()
    assert found[0].id == 1 and [r.id for r in found] == [1, 2]  # the image takes the last place
    edges = spark.createDataFrame([("a.md", "c.md")], "src string, dst string")
    more = with_neighbours(hybrid_search(chunks, asked, final=2), chunks, edges)
    assert {(r.chunk_id, r.origin) for r in more.collect()} >= {(3, "graph")}
    rounds = agent_rounds(lambda q: hybrid_search(chunks, q, final=2), asked, lambda g: g.groupBy("query").agg(F.lit("rewrite").alias("verdict")), lambda q: q)
    assert {r.id for r in rounds.collect()} == {1, 2}


def test_sinks(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    sinks.merge_into(spark, path, rows, ["k"])
    sinks.merge_into(spark, path, spark.createDataFrame([("b", 3), ("c", 4)], "k string, v int"), ["k"], gone=spark.createDataFrame([("a",)], "k string"))
    assert sorted(map(tuple, sinks.read_table(spark, path).collect())) == [("b", 3), ("c", 4)]
    (tmp_path / "t" / "version-00000009").mkdir()  # a writer that failed
    assert sinks.read_table(spark, path).count() == 2
    log = str(tmp_path / "log")
    sinks.append_once(spark, log, rows, ["k"])
    sinks.append_once(spark, log, spark.createDataFrame([("b", 9), ("d", 5)], "k string, v int"), ["k"])
    assert sorted(map(tuple, spark.read.parquet(log).collect())) == [("a", 1), ("b", 2), ("d", 5)]
