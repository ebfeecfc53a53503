"""Searches: BM25, dense, fusion, boosts, parents, reranking."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.catalog import query, sql_tokens, table
from folio.operators import bm25, bm25_rows, dense, fusion, vector_index
from folio.sources.notes import from_documents
from folio.storage import new_folder

#: Documents with an id divisible by this are the queries of searches, with their whole texts.
EVERY = 100

_saved: dict[tuple[str, str, str, str], str] = {}


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where(F.col("doc_id") % EVERY == 0).select(F.col("doc_id").alias("query"), "text")


def _saved_once(spark: SparkSession, name: str, source: str, save: Callable[[str], None], load: Callable[[SparkSession, str], object]) -> object:
    """What ``save`` wrote for the files that ``source`` has now: made by the first search of an application, read by all further ones; a table that has been
    written anew is another one."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(source)
    fs = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    status = fs.getFileStatus(hadoop)
    found = sorted((f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in fs.listStatus(hadoop)) if status.isDirectory() else [(status.getLen(), status.getModificationTime())]
    key = (spark.sparkContext.applicationId, name, source, str(found))
    if key not in _saved:
        path = new_folder(spark, name)
        save(path)
        _saved[key] = path
    return load(spark, _saved[key])


def saved_rows(spark: SparkSession, sf_dir: str) -> bm25_rows.RowIndex:
    return _saved_once(spark, "bm25", f"{sf_dir}/documents.parquet", lambda path: bm25_rows.build_index(table(spark, sf_dir, "documents"), path=path), bm25_rows.load_index)


def _bm25_sql(k: int) -> str:
    return f"""
tok AS MATERIALIZED (SELECT doc_id, {sql_tokens("text")} AS w FROM documents),
st AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM tok),
post AS MATERIALIZED (SELECT doc_id, token, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS token FROM tok) GROUP BY doc_id, token),
voc AS (SELECT token, count(*) AS df FROM post GROUP BY token),
raw AS (SELECT token, ln(n - df + 0.5) - ln(df + 0.5) AS idf FROM voc, st),
idf AS (SELECT token, CASE WHEN idf < 0 THEN 0.25 * (SELECT avg(idf) FROM raw) ELSE idf END AS idf FROM raw),
asked AS (SELECT query, token, count(*) AS qtf FROM (SELECT doc_id AS query, unnest({sql_tokens("text")}) AS token FROM documents WHERE doc_id % 100 = 0) GROUP BY query, token),
scored AS (
  SELECT query, post.doc_id AS id, sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(w) / avgdl))) AS score
  FROM asked JOIN idf USING (token) JOIN post USING (token) JOIN tok USING (doc_id), st GROUP BY query, post.doc_id
),
sparse_top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 6) DESC, id) AS rank FROM scored) WHERE rank <= {k})"""


def _scored(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    return bm25_rows.search(saved_rows(spark, sf_dir), bm25.query_tokens(questions(spark, sf_dir)), k)


_HAN_SQL = "(SELECT doc_id, text || chr(10) || CASE doc_id % 4 WHEN 0 THEN '检索评测指标与向量检索' WHEN 1 THEN '评测指标 recall@k 的含义' WHEN 2 THEN '知识图谱扩展检索' ELSE '' END AS text FROM documents)"
_HAN_ASKED = "CASE doc_id // 100 % 4 WHEN 0 THEN '评测指标' WHEN 1 THEN '知识图谱' WHEN 2 THEN '向量检索 recall' ELSE '扩展' END"


@query(f"""WITH {_bm25_sql(10)
    .replace("unnest(" + sql_tokens("text") + ") AS token FROM documents WHERE doc_id % 100 = 0", "unnest(" + sql_tokens("question") + f") AS token FROM (SELECT doc_id, {_HAN_ASKED} AS question FROM documents WHERE doc_id % 100 = 0)")
    .replace("AS w FROM documents", f"AS w FROM {_HAN_SQL}")}
SELECT query, id, round(score, 4) AS score, rank::INTEGER AS rank FROM sparse_top""")
def bm25_chinese(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chinese questions to documents with Chinese lines: pairs of neighbouring characters meet."""
    k = F.col("doc_id") % 4
    line = F.when(k == 0, "检索评测指标与向量检索").when(k == 1, "评测指标 recall@k 的含义").when(k == 2, "知识图谱扩展检索").otherwise("")
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat("text", F.lit("\n"), line).alias("text"))
    asked = table(spark, sf_dir, "documents").where(F.col("doc_id") % EVERY == 0).select(F.col("doc_id").alias("query"), F.expr(_HAN_ASKED.replace("//", "div")).alias("text"))
    return bm25_rows.search(bm25_rows.build_index(docs), bm25.query_tokens(asked), 10).select("query", "id", F.round("exact", 4).alias("score"), "rank")


@query(f"WITH {_bm25_sql(10)} SELECT query, id, round(score, 4) AS score, rank::INTEGER AS rank FROM sparse_top")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir, 10).select("query", "id", F.round("exact", 4).alias("score"), "rank")


_KNN_SQL = """
knn AS (
  SELECT q.vec_id AS query, v.vec_id AS id, list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) AS similarity,
         row_number() OVER (PARTITION BY q.vec_id ORDER BY list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) DESC, v.vec_id) AS rank
  FROM embeddings q, embeddings v WHERE q.vec_id % 100 = 0 AND q.vec_id <> v.vec_id QUALIFY rank <= 50
)"""


def _knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return dense.knn_join(vectors, vectors.where(F.col("vec_id") % EVERY == 0), 50)


@query(f"WITH {_KNN_SQL} SELECT query, id, round(similarity, 6) AS similarity, rank::INTEGER AS rank FROM knn")
def knn_join_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _knn(spark, sf_dir).select("query", "id", F.round("similarity", 6).alias("similarity"), "rank")


@query(f"WITH {_KNN_SQL} SELECT query, id, round(1 - similarity, 6) AS distance, rank::INTEGER AS rank FROM knn WHERE rank <= 10")
def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    found = dense.knn_join(vectors, vectors.where(F.col("vec_id") % EVERY == 0), 10)
    return found.select("query", "id", F.round(1 - F.col("similarity"), 6).alias("distance"), "rank")


@query(f"WITH {_KNN_SQL.replace('q.vec_id <> v.vec_id', 'q.vec_id <> v.vec_id AND v.label = 1')} SELECT query, id, round(1 - similarity, 6) AS distance, rank::INTEGER AS rank FROM knn WHERE rank <= 20")
def filtered_dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows are filtered before the search, for all queries."""
    vectors = table(spark, sf_dir, "embeddings")
    found = dense.knn_join(vectors.where("label = 1"), vectors.where(F.col("vec_id") % EVERY == 0), 20)
    return found.select("query", "id", F.round(1 - F.col("similarity"), 6).alias("distance"), "rank")


@query(f"""WITH c AS (SELECT doc_id, str_split(text, chr(10))[1] AS heading_path, lang AS tag FROM documents),
{_KNN_SQL.replace('q.vec_id <> v.vec_id', "q.vec_id <> v.vec_id AND v.vec_id IN (SELECT doc_id FROM c WHERE tag = 'de' AND contains(heading_path, 'er'))")}
SELECT query, id, round(similarity, 6) AS similarity, rank::INTEGER AS rank FROM knn WHERE rank <= 10""")
def metadata_dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest among documents with a tag and with a part of a heading: the condition holds before the search."""
    heading = F.substring_index("text", "\n", 1).alias("heading_path")
    known = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"), F.lit(None).cast("string").alias("filepath"), heading, F.array("lang").alias("tags"))
    vectors = table(spark, sf_dir, "embeddings")
    some = vectors.join(known.where(dense.metadata_where(heading="er", tag="de")).select("vec_id"), "vec_id", "left_semi")
    found = dense.knn_join(some, vectors.where(F.col("vec_id") % EVERY == 0), 10)
    return found.select("query", "id", F.round("similarity", 6).alias("similarity"), "rank")


_DENSE_NORM = """
dn AS (SELECT query, id, 1 - (d - lo) / CASE WHEN hi > lo THEN hi - lo ELSE 1 END AS dense
       FROM (SELECT *, 1 - similarity AS d, min(1 - similarity) OVER (PARTITION BY query) AS lo, max(1 - similarity) OVER (PARTITION BY query) AS hi FROM knn))"""
_SPARSE_NORM = """
sn AS (SELECT query, id, (s - lo) / CASE WHEN hi > lo THEN hi - lo ELSE 1 END AS sparse
       FROM (SELECT query, id, round(score, 6) AS s, min(round(score, 6)) OVER (PARTITION BY query) AS lo, max(round(score, 6)) OVER (PARTITION BY query) AS hi FROM sparse_top))"""


def _vector_index(spark: SparkSession, sf_dir: str) -> vector_index.VectorIndex:
    """The index of a folder's vectors, saved by the first search of an application, and loaded by all further ones."""
    source = f"{sf_dir}/embeddings.parquet"
    return _saved_once(spark, "vectors", source, lambda path: vector_index.build_index(spark.read.parquet(source)).save(path), vector_index.load_index)


@query()
def dense_index_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 nearest by the index's own choice of cells; tests hold its recall against ``knn_join``."""
    asked = table(spark, sf_dir, "embeddings").where(F.col("vec_id") % EVERY == 0)
    found = vector_index.search(_vector_index(spark, sf_dir), asked, 50)
    return found.select("query", "id", F.round("similarity", 6).alias("similarity"), "rank")


@query(f"WITH {_KNN_SQL} SELECT query, id, round(similarity, 6) AS similarity, rank::INTEGER AS rank FROM knn WHERE rank <= 10")
def dense_index_all_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index's exact way: all cells, all rows of their blocks."""
    asked = table(spark, sf_dir, "embeddings").where(F.col("vec_id") % EVERY == 0)
    found = vector_index.search(_vector_index(spark, sf_dir), asked, 10, probes=vector_index.MOST_CELLS, refined=0)
    return found.select("query", "id", F.round("similarity", 6).alias("similarity"), "rank")


@query(f"WITH {_KNN_SQL}, {_DENSE_NORM} SELECT query, id, round(dense, 5) AS dense FROM dn")
def minmax_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dense.min_max_similarity(_knn(spark, sf_dir).withColumn("distance", 1 - F.col("similarity")), group="query")
    return found.select("query", "id", F.round("dense", 5).alias("dense"))


@query(f"WITH {_bm25_sql(50)}, {_SPARSE_NORM} SELECT query, id, round(sparse, 4) AS sparse FROM sn")
def minmax_sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dense.min_max_sparse(_scored(spark, sf_dir, 50), group="query").select("query", "id", F.round("sparse", 4).alias("sparse"))


def _fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = dense.min_max_similarity(_knn(spark, sf_dir).withColumn("distance", 1 - F.col("similarity")), group="query")
    sparse = dense.min_max_sparse(_scored(spark, sf_dir, 50), group="query")
    return fusion.fuse(near, sparse, keys=("query", "id"))


_FUSED_SQL = f"""WITH {_bm25_sql(50)}, {_SPARSE_NORM}, {_KNN_SQL}, {_DENSE_NORM},
fused AS (SELECT query, id, coalesce(dense, 0) AS dense, coalesce(sparse, 0) AS sparse, 0.7 * coalesce(dense, 0) + 0.3 * coalesce(sparse, 0) AS score FROM dn FULL JOIN sn USING (query, id))"""


@query(f"{_FUSED_SQL} SELECT query, id, round(dense, 4) AS dense, round(sparse, 4) AS sparse, round(score, 4) AS score FROM fused")
def hybrid_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fused(spark, sf_dir).select("query", "id", *(F.round(c, 4).alias(c) for c in ("dense", "sparse", "score")))


_STRUCT_SQL = f"""
notes AS (SELECT doc_id, source, trim(str_split(text, chr(10))[1]) AS title, lang FROM documents),
struct AS (
  SELECT query, doc_id AS id, title, CASE WHEN len(q) > 0 THEN least(1.0, 0.6 * len(list_intersect(q, t)) / len(q) + 0.1 * len(list_intersect(q, s)) / len(q)) ELSE 0 END AS structural,
         length(title) > 1 AND form(title) <> '' AND contains(form(asked), form(title)) AS hit
  FROM (SELECT doc_id AS query, text AS asked, list_distinct({sql_tokens("text")}) AS q FROM documents WHERE doc_id % 100 = 0),
       (SELECT doc_id, title, list_distinct({sql_tokens("title")}) AS t, list_distinct({sql_tokens("source")}) AS s FROM notes)
)""".replace("form(title)", r"regexp_replace(title, '[《》「」『』【】\[\]()（）\s]', '', 'g')").replace("form(asked)", r"regexp_replace(asked, '[《》「」『』【】\[\]()（）\s]', '', 'g')")


@query(f"{_FUSED_SQL}, {_STRUCT_SQL} SELECT query, id, round(structural, 4) AS structural, hit, round(score + CASE WHEN structural > 0.5 THEN 0.25 * structural ELSE 0 END + CASE WHEN hit THEN 0.15 ELSE 0 END, 4) AS score FROM fused JOIN struct USING (query, id)")
def structural_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    notes = from_documents(table(spark, sf_dir, "documents")).select(F.col("doc_id").alias("id"), "title", "dir")
    hits = _fused(spark, sf_dir).join(notes, "id").join(fusion.prepared(questions(spark, sf_dir)).drop("text"), "query")
    hits = hits.withColumn("structural", fusion.structural_score(F.col("asked_tokens"), F.col("title"), F.lit(""), F.col("dir"))).withColumn("hit", fusion.title_hit(F.col("asked_form"), F.col("title")))
    return hits.select("query", "id", F.round("structural", 4).alias("structural"), "hit", F.round(fusion.boosted(F.col("score"), F.col("structural"), F.col("hit")), 4).alias("score"))


@query(f"""{_FUSED_SQL}, kids AS (SELECT query, id, round(score, 6) AS score, id // 10 AS parent FROM fused)
SELECT query, parent, id, round(score, 4) AS score, 'parent ' || parent AS content FROM kids QUALIFY row_number() OVER (PARTITION BY query, parent ORDER BY score DESC, id) = 1""")
def parent_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    parent = F.floor(F.col("id") / 10)
    hits = _fused(spark, sf_dir).withColumn("score", F.round("score", 6)).withColumn("parent_id", parent.cast("string")).withColumn("content", F.lit("child"))
    parents = table(spark, sf_dir, "documents").select(F.floor(F.col("doc_id") / 10).cast("string").alias("parent_id")).distinct().withColumn("content", F.concat(F.lit("parent "), "parent_id"))
    found = fusion.collapse_parents(hits, parents.unionByName(table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 10).cast("string").alias("parent_id")).distinct().withColumn("content", F.concat(F.lit("parent "), "parent_id"))).distinct(), "query")
    return found.select("query", F.col("parent_id").cast("long").alias("parent"), "id", F.round("score", 4).alias("score"), "content")


@query(f"""WITH {_bm25_sql(20)}, r AS (
  SELECT query, s.id, CASE WHEN len(q) > 0 THEN len(list_intersect(q, w)) / len(q) ELSE 0 END AS overlap
  FROM sparse_top s JOIN tok ON tok.doc_id = s.id JOIN (SELECT doc_id AS query, list_distinct({sql_tokens("text")}) AS q FROM documents WHERE doc_id % 100 = 0) USING (query))
SELECT query, id, round(overlap, 5) AS score, row_number() OVER (PARTITION BY query ORDER BY overlap DESC, id)::INTEGER AS rank FROM r QUALIFY rank <= 5""")
def rerank_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = _scored(spark, sf_dir, 20).drop("rank").join(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content")), "id")
    hits = hits.join(fusion.prepared(questions(spark, sf_dir)).select("query", "asked_tokens"), "query")
    return fusion.rerank(hits, fusion.overlap_scorer, F.col("asked_tokens"), 5).select("query", "id", F.round("score", 5).alias("score"), "rank")


@query(f"""WITH {_bm25_sql(10)}, v AS (SELECT *, id % 7 = 3 AS visual FROM sparse_top),
m AS (SELECT *, least(5, count(*) OVER (PARTITION BY query)) AS last, sum((visual AND rank <= 5)::INT) OVER (PARTITION BY query) AS shown,
             row_number() OVER (PARTITION BY query, visual ORDER BY rank) AS nth FROM v),
p AS (SELECT *, shown = 0 AND visual AND nth = 1 AS pinned, max((shown = 0 AND visual AND nth = 1)::INT) OVER (PARTITION BY query) AS any_pin FROM m)
SELECT query, id, visual, (CASE WHEN pinned THEN last ELSE rank END)::INTEGER AS rank FROM p WHERE pinned OR rank <= last - any_pin""")
def pin_visual(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = _scored(spark, sf_dir, 10).withColumn("visual", F.col("id") % 7 == 3)
    return fusion.pin_visual(ranked, 5, F.col("visual"), F.lit(True)).select("query", "id", "visual", "rank")


@query(f"""{_FUSED_SQL.replace(" AND q.vec_id <> v.vec_id", " AND q.vec_id IN (SELECT doc_id FROM documents) AND v.vec_id IN (SELECT doc_id FROM documents)")}, {_STRUCT_SQL},
b AS (SELECT query, id, structural, round(score + CASE WHEN structural > 0.5 THEN 0.25 * structural ELSE 0 END + CASE WHEN hit THEN 0.15 ELSE 0 END, 6) AS score FROM fused JOIN struct USING (query, id)),
t AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY query ORDER BY score DESC, id) <= 20),
r AS (SELECT t.query, t.id, structural, CASE WHEN len(q) > 0 THEN len(list_intersect(q, w)) / len(q) ELSE 0 END AS overlap
  FROM t JOIN tok ON tok.doc_id = t.id JOIN (SELECT doc_id AS query, list_distinct({sql_tokens("text")}) AS q FROM documents WHERE doc_id % 100 = 0) a ON a.query = t.query)
SELECT query, id, rank::INTEGER AS rank, round(overlap, 5) AS score, round(structural, 5) AS structural
FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY overlap DESC, id) AS rank FROM r) WHERE rank <= 5""")
def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folio.plans.search import hybrid_search as search

    notes = from_documents(table(spark, sf_dir, "documents")).withColumn("id", F.col("doc_id"))
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    chunks = notes.join(vectors, "id", "left").select("id", F.col("text").alias("content"), "title", F.lit("").alias("heading_path"), "dir", F.lit("text").alias("kind"), F.lit(None).cast("string").alias("parent_id"), "embedding", "filepath")
    asked = questions(spark, sf_dir).join(vectors.withColumnRenamed("id", "query"), "query", "left")
    found = search(chunks, asked, index=saved_rows(spark, sf_dir))
    return found.select("query", "id", "rank", F.round("score", 5).alias("score"), F.round("structural", 5).alias("structural"))
