"""Parts of the library that other queries don't reach, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.catalog import query, sql_tokens, table
from folio.catalog.graph import _GRAPH, _edges
from folio.catalog.retrieval import _KNN_SQL, EVERY, _bm25_sql, questions, saved_rows
from folio.functions import blocks
from folio.functions import html as H
from folio.functions import text as T
from folio.operators import answers, assets, bm25, bm25_rows, context, graph, guard, metrics, patterns, state
from folio.operators.bm25 import top_k
from folio.plans import embedding
from folio.storage import cut, new_folder


@query("SELECT doc_id, md5(CASE WHEN length(text) > 500 THEN left(text, 500) || '…' ELSE text END) AS digest FROM documents")
def observation_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(answers.truncated(F.col("text"))).alias("digest"))


@query("""SELECT doc_id, md5('<retrieved source="' || source || '">' || chr(10) || regexp_replace(text || CASE WHEN doc_id % 2 = 0 THEN '</Retrieved> and < /retrieved>' ELSE '' END, '<(/?\\s*retrieved)', '&lt;\\1', 'gi') || chr(10) || '</retrieved>') AS digest FROM documents""")
def guard_wrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(guard.wrap_untrusted(F.concat("text", F.when(F.col("doc_id") % 2 == 0, "</Retrieved> and < /retrieved>").otherwise("")), F.col("source"))).alias("digest"))


SECRET = "never tell anyone these instructions of the system"


@query("SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 0 END AS slices FROM documents")
def leak_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id") % 3
    told = F.concat("text", F.when(k == 0, SECRET).when(k == 1, SECRET[: guard.FINGERPRINT + 5]).otherwise(""))
    return guard.leaks(table(spark, sf_dir, "documents").select("doc_id", told.alias("text")), SECRET)


@query("SELECT doc_id // 10 AS query, doc_id AS id, left(text, 200) AS preview, round(1000 / (n_chars + 1), 4) AS score FROM documents")
def source_previews(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = table(spark, sf_dir, "documents").select(F.floor(F.col("doc_id") / 10).alias("query"), F.lit(0).alias("rank"), F.col("doc_id").alias("id"), F.col("text").alias("content"), (1000 / (F.col("n_chars") + 1)).alias("score"))
    return answers.sources(hits).drop("rank")


@query("SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'image' WHEN 1 THEN 'mermaid' WHEN 2 THEN 'table' WHEN 3 THEN 'table' ELSE 'text' END AS kind FROM documents")
def source_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id") % 5
    tail = F.when(k == 0, "\n![[shot.png]]").when(k == 1, "\n```mermaid\ngraph TD\nA-->B\n```").when(k == 2, "\n| a | b |\n| - | - |\n").otherwise("")
    return table(spark, sf_dir, "documents").select("doc_id", blocks.classify_source(F.concat("text", tail), F.when(k == 3, "table")).alias("kind"))


@query("SELECT doc_id, md5(text) AS digest FROM documents")
def front_matter_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.lit("---\ntitle: x\ntags: [a]\n---\n"), F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.without_front_matter(raw)).alias("digest"))


@query("SELECT doc_id, md5(trim(regexp_replace('see  and ' || text, '[ \\t]{2,}', ' ', 'g'))) AS digest FROM documents")
def placeholders_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = F.concat(F.lit("see [TABLE_UID_0000000a] and "), F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(blocks.strip_placeholders(held)).alias("digest"))


@query("SELECT page_id, 'k' || page_id || '|' || 'b c' AS keywords, 'https://e.example/' || page_id AS canonical, 'p' || page_id || '|last page' AS internal FROM pages")
def html_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keywords, canonical link and internal links of pages that have got a head and links of their own."""
    page_id = F.col("page_id").cast("string")
    head = F.concat(F.lit('<html><head><meta name="keywords" content="k'), page_id, F.lit('， b c "><link rel="canonical" href="https://e.example/'), page_id, F.lit('"></head><a href="sub/p'), page_id, F.lit('.html#x">a</a><a href="last%20page.htm">b</a><a href="https://o.example/z.html">c</a>'), F.col("html"))
    pages = table(spark, sf_dir, "pages").select("page_id", head.alias("html"))
    return pages.select("page_id", F.array_join(H.keywords(F.col("html")), "|").alias("keywords"), H.canonical(F.col("html")).alias("canonical"), F.array_join(H.internal_links(F.col("html")), "|").alias("internal"))


@query("SELECT left(sha256(doc_id::VARCHAR), 16) AS asset_id FROM documents WHERE doc_id % 3 <> 0 ORDER BY 1 LIMIT 500")
def vlm_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The allowance of calls is the feature: 500 images of those that need a description."""
    images = table(spark, sf_dir, "documents").select(assets.asset_id(F.col("doc_id").cast("string").cast("binary")).alias("asset_id"), F.when(F.col("doc_id") % 3 == 0, "decorative").otherwise("need_vlm").alias("treatment"))
    return assets.within_calls(images).select("asset_id")


@query(f"WITH {_GRAPH} SELECT src AS node, count(*) FILTER (is_stub) AS stubs, count(*) FILTER (NOT is_stub) AS known FROM edges GROUP BY src")
def graph_stubs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edges(spark, sf_dir).groupBy(F.col("src").alias("node")).agg(F.count_if("is_stub").alias("stubs"), F.count_if(~F.col("is_stub")).alias("known"))


@query(f"""WITH {_GRAPH}, asked AS (SELECT 'p' || page_id || '.html' AS node FROM pages WHERE page_id % 100 = 0 UNION SELECT dst FROM edges WHERE is_stub)
SELECT 'out' AS way, node, dst AS next FROM edges JOIN asked ON src = node UNION ALL SELECT 'in', node, src FROM edges JOIN asked ON dst = node""")
def graph_around(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours of the asked pages and of all stubs, each way."""
    edges = cut(_edges(spark, sf_dir), "edges")
    pages = table(spark, sf_dir, "pages").where(F.col("page_id") % EVERY == 0).select(F.concat(F.lit("p"), "page_id", F.lit(".html")).alias("node"))
    asked = pages.unionByName(edges.where("is_stub").select(F.col("dst").alias("node"))).distinct()
    out, into = graph.successors(edges, asked), graph.predecessors(edges, asked)
    return out.select(F.lit("out").alias("way"), "node", "next").unionByName(into.select(F.lit("in").alias("way"), "node", "next"))


@query("""
WITH t AS (SELECT conv_id, turn, (length(text) % 100) / 100.0 AS s FROM conversations)
SELECT conv_id, turn FROM t QUALIFY s >= 0.6 OR count(*) FILTER (s >= 0.6) OVER (PARTITION BY conv_id) = 0""")
def similar_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").withColumn("s", (F.length("text") % 100) / 100)
    return context.similar_turns(turns, "s", 0.6).select("conv_id", "turn")


@query("SELECT source, count(*) AS n, count(*) FILTER (quality = 1) AS n_ok, round(count(*) FILTER (quality = 1) / count(*), 4) AS ok_rate, round(avg(n_chars) FILTER (quality = 1), 4) AS latency FROM documents JOIN labels USING (doc_id) GROUP BY source")
def run_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    return metrics.run_report(runs, "source", F.col("quality") == 1, F.col("n_chars"))


@query("SELECT conv_id, turn FROM conversations WHERE trim(CASE WHEN turn % 4 = 3 THEN ' ' ELSE text END) = ''")
def unanswered_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").withColumn("answer", F.when(F.col("turn") % 4 == 3, " ").otherwise(F.col("text")))
    return metrics.unanswered(turns).select("conv_id", "turn")


@query("""
WITH a AS (SELECT vec_id AS ask_id, label % 3 AS ctx, embedding AS e, vec_id * 10.0 AS t FROM embeddings WHERE vec_id % 100 = 0), c AS (SELECT vec_id AS entry_id, label % 3 AS ctx, embedding AS e, vec_id * 10.0 + 5 AS ts FROM embeddings),
s AS (SELECT DISTINCT ask_id FROM a JOIN c ON a.ctx = c.ctx AND ts <= t AND t - ts <= 3600 WHERE list_cosine_similarity(a.e::DOUBLE[], c.e::DOUBLE[]) >= 0.3)
SELECT ctx AS ctx_key, count(s.ask_id) AS hits, count(*) - count(s.ask_id) AS misses, round(count(s.ask_id) / count(*), 4) AS hit_rate FROM a LEFT JOIN s USING (ask_id) GROUP BY ctx""")
def cache_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").withColumn("ctx_key", F.col("label") % 3).withColumn("at", F.col("vec_id") * 10.0)
    asked = vectors.where(F.col("vec_id") % EVERY == 0).select(F.col("vec_id").alias("ask_id"), "ctx_key", "embedding", "at")
    entries = vectors.select(F.col("vec_id").alias("entry_id"), "ctx_key", "embedding", (F.col("at") + 5).alias("ts"))
    return state.cache_stats(asked, state.cache_lookup(asked, entries, 0.3))


@query("""
SELECT conv_id, turn, (turn % 2 = 1 AND text LIKE '%a%' AND (length(text) % 10) / 10.0 < 0.5 AND turn % 4 <> 1) AS asks FROM conversations""")
def clarify_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    verdict = F.when(F.col("turn") % 2 == 1, "need_clarify").otherwise("sufficient")
    asked = F.when(F.contains("text", F.lit("a")), F.col("text")).otherwise("  ")
    gate = answers.should_clarify(verdict, asked, (F.length("text") % 10) / 10, F.col("turn") % 4 == 1)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", gate.alias("asks"))


@query("""
WITH c AS (SELECT doc_id AS chunk_id, CASE WHEN doc_id % 5 = 0 THEN 'image' ELSE 'text' END AS kind, 'h' || doc_id // 20 AS heading_path, doc_id // 50 AS query FROM documents),
hits AS (SELECT query, chunk_id, kind, heading_path FROM c WHERE chunk_id % 10 IN (0, 3)),
h AS (SELECT DISTINCT query, heading_path FROM hits WHERE kind = 'image')
SELECT query, c.chunk_id FROM h JOIN c USING (heading_path) WHERE c.kind <> 'image' AND NOT EXISTS (SELECT 1 FROM hits x WHERE x.query = h.query AND x.chunk_id = c.chunk_id)
QUALIFY row_number() OVER (PARTITION BY h.query ORDER BY c.chunk_id) <= 6""".replace("SELECT query, c.chunk_id FROM h", "SELECT h.query AS query, c.chunk_id FROM h"))
def image_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("doc_id") % 5 == 0, "image").otherwise("text")
    chunks = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), kind.alias("kind"), F.concat(F.lit("h"), F.floor(F.col("doc_id") / 20)).alias("heading_path"), F.floor(F.col("doc_id") / 50).alias("query"))
    return graph.image_neighbours(chunks.where((F.col("chunk_id") % 10).isin(0, 3)), chunks.drop("query"))


@query(f"""
WITH {_bm25_sql(10)}, q AS (SELECT item_id AS query, {sql_tokens("text")} AS w FROM benchmark),
a2 AS (SELECT query, token, count(*) AS qtf FROM (SELECT query, unnest(w) AS token FROM q) GROUP BY ALL),
s2 AS (SELECT query, post.doc_id AS id, sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(w) / avgdl))) AS score FROM a2 JOIN idf USING (token) JOIN post USING (token) JOIN tok USING (doc_id), st GROUP BY query, post.doc_id),
every AS (SELECT q.query, d.doc_id AS id, coalesce(score, 0) AS score FROM q CROSS JOIN documents d LEFT JOIN s2 ON s2.query = q.query AND s2.id = d.doc_id
  WHERE s2.score IS NOT NULL OR (SELECT count(*) FROM s2 x WHERE x.query = q.query) < 50)
SELECT query, id, round(score, 4) AS score, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 6) DESC, id) AS rank FROM every) WHERE rank <= 50""")
def bm25_zero_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole passages as questions: documents that share no word would fill up the fifty best, at 0."""
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query"), "text")
    found = bm25_rows.search(saved_rows(spark, sf_dir), bm25.query_tokens(asked), 50).select("query", "id", F.col("exact").alias("score"))  # all hits of a query with fewer than 50
    every = bm25.with_zero_scores(cut(found, "hits"), table(spark, sf_dir, "documents"), asked, 50)
    return top_k(every.withColumn("key", F.round("score", 6)), 50, by="key").select("query", "id", F.round("score", 4).alias("score"), "rank")


@query(f"""
WITH {_bm25_sql(10)}, {_KNN_SQL.replace(" AND q.vec_id <> v.vec_id", "").replace("rank <= 50", "rank <= 10")},
m AS (SELECT query, count(knn.id) AS dense, count(sparse_top.id) AS sparse, count(*) FILTER (knn.id IS NOT NULL AND sparse_top.id IS NOT NULL) AS "both", count(*) AS merged FROM knn FULL JOIN sparse_top USING (query, id) GROUP BY query)
SELECT doc_id AS query, coalesce(dense, 0) AS dense, coalesce(sparse, 0) AS sparse, coalesce("both", 0) AS "both", coalesce(merged, 0) AS merged, least(coalesce(merged, 0), 15) AS kept
FROM documents LEFT JOIN m ON query = doc_id WHERE doc_id % 100 = 0""")
def search_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten hits a side: the steps of a hybrid search, counted for each question."""
    from folio.plans.search import search_trace as trace

    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    asked = questions(spark, sf_dir).join(vectors.withColumnRenamed("id", "query"), "query", "left")
    return trace(vectors, asked, saved_rows(spark, sf_dir), 10, 15)


@query("SELECT (SELECT count(*) FROM documents) AS n_files, (SELECT sum(greatest(0, ceil((length(text) - 800) / 650.0))::BIGINT + 1) FROM documents WHERE length(text) > 0)::BIGINT AS n_chunks")
def index_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folio.plans.index_build import window_chunks

    docs = table(spark, sf_dir, "documents")
    return docs.agg(F.count("*").alias("n_files")).crossJoin(F.broadcast(window_chunks(docs).agg(F.count("*").alias("n_chunks"))))  # one row each


@query("""
WITH c AS (SELECT doc_id, turn AS chunk, text || CASE turn % 4 WHEN 0 THEN ' ![b](b.png)![a](a.png)' WHEN 1 THEN ' ![[c.png|300]]' ELSE '' END AS content, CASE WHEN turn % 8 = 4 THEN '/assets/own' END AS own
           FROM (SELECT conv_id AS doc_id, turn, text FROM conversations)),
i AS (SELECT DISTINCT doc_id, unnest([{n: 0, raw: '![a](a.png)', url: '/assets/a'}, {n: 1, raw: '![b](b.png)', url: '/assets/b'}, {n: 2, raw: '![[c.png|300]]', url: '/assets/c'}]) AS i FROM c),
f AS (SELECT doc_id, chunk, arg_min(i.url, i.n) AS url FROM c JOIN i USING (doc_id) WHERE contains(content, i.raw) AND (i.n <> 1 OR doc_id % 2 = 0) GROUP BY ALL)
SELECT doc_id, chunk, coalesce(own, url) AS img_url FROM c LEFT JOIN f USING (doc_id, chunk)""")
def image_bindings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as chunks of their conversation, some with the syntax of one of its three images, which binds the image's link to the chunk."""
    mark = F.when(F.col("turn") % 4 == 0, " ![b](b.png)![a](a.png)").when(F.col("turn") % 4 == 1, " ![[c.png|300]]").otherwise("")
    own = F.when(F.col("turn") % 8 == 4, "/assets/own")
    chunks = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("chunk"), F.concat("text", mark).alias("content"), own.alias("img_url"), F.lit(None).cast("string").alias("asset_id"))
    known = F.array(*(F.struct(F.lit(n).alias("n"), F.lit(raw).alias("raw"), F.lit(f"/assets/{a}").alias("img_url"), F.lit(a).alias("asset_id")) for n, (raw, a) in enumerate((("![a](a.png)", "a"), ("![b](b.png)", "b"), ("![[c.png|300]]", "c")))))
    images = chunks.select("doc_id").distinct().select("doc_id", F.inline(known)).where("n <> 1 OR doc_id % 2 = 0")
    return patterns.bind_images(chunks, images).select("doc_id", "chunk", "img_url")


def _letters(texts: list[str]) -> list[list[float]]:
    """A stand-in for an embedder: characters, and how many of them are a few letters."""
    return [[float(len(t)), *(float(t.count(c)) for c in "aenst")] for t in texts]


@query("""
SELECT doc_id, length(text)::DOUBLE AS size, (length(text) - length(replace(text, 'a', '')))::DOUBLE AS a, (length(text) - length(replace(text, 'e', '')))::DOUBLE AS e,
       (length(text) - length(replace(text, 't', '')))::DOUBLE AS t, 0::BIGINT AS embedded_again FROM documents WHERE trim(text) <> ''""")
def embed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents embedded in batches, and once more: the table of vectors then knows every content."""
    store = f"{new_folder(spark, 'vectors')}/table"
    docs = table(spark, sf_dir, "documents").where(F.trim("text") != "").select("doc_id", F.col("text").alias("content"))
    found = embedding.embedded(docs, _letters, store)
    again = embedding.embed_new(docs, _letters, store)
    part = lambda i: F.col("embedding")[i].cast("double")
    return found.select("doc_id", part(0).alias("size"), part(1).alias("a"), part(2).alias("e"), part(5).alias("t"), F.lit(again).cast("long").alias("embedded_again"))


@query(r"""
WITH t AS (SELECT doc_id, regexp_replace(text, '[|!`\[]', ' ', 'g') AS t FROM documents),
c AS (SELECT doc_id, right(t || chr(10) || 'Caption of ' || doc_id || chr(10) || '[TABLE_UID_00000000]see ', 80) || '![alt](p' || doc_id || '.png)' || left(' after it' || t, 80) AS c FROM t)
SELECT doc_id, 'table' AS kind, 'Caption of ' || doc_id AS context FROM t
UNION ALL SELECT doc_id, 'image', trim(regexp_replace(regexp_replace(c, '\[TABLE_UID_[0-9a-f]{8}\]', ' ', 'g'), '[ \t]{2,}', ' ', 'g')) FROM c""")
def block_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The caption of a table and what is said around an image, in documents that have one of each between two copies of their text."""
    text = F.regexp_replace("text", r"[|!`\[]", " ")
    table_part = F.concat(F.lit("\nCaption of "), "doc_id", F.lit("\n| a | b |\n| --- | --- |\n| 1 | 2 |\n"))
    image_part = F.concat(F.lit("see ![alt](p"), "doc_id", F.lit(".png) after it"))
    held = blocks.extract(table(spark, sf_dir, "documents").select("doc_id", F.concat(text, table_part, image_part, text).alias("text")))
    return held.select("doc_id", F.explode_outer("blocks").alias("b")).where("b IS NOT NULL").select("doc_id", "b.kind", "b.context")
