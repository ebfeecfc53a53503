"""BM25 over an inverted index held as DataFrames.

``score = sum idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avgdl))`` over a query's tokens, repeats included, with
``idf = ln(N - df + 0.5) - ln(df + 0.5)``, and ``epsilon`` times the vocabulary's mean idf where that is negative.
Only postings of query tokens are joined and summed; the documents' texts don't move.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folio.functions.text import tokens
from folio.storage import cut

K1, B, EPSILON = 1.5, 0.75, 0.25


@dataclass
class Index:
    """``postings`` (token, id, tf, dl), ``vocabulary`` (token, df) and ``stats`` (n_docs, avgdl, mean_idf: one row)."""

    postings: DataFrame
    vocabulary: DataFrame
    stats: DataFrame

    def save(self, path: str) -> None:
        """Writes the index to a folder that doesn't exist yet; postings are dealt in ranges of token and id, so that
        a search reads few row groups and a token that all documents have is split."""
        self.postings.repartitionByRange("token", "id").sortWithinPartitions("token", "id").write.parquet(f"{path}/postings")
        self.vocabulary.write.parquet(f"{path}/vocabulary")
        self.stats.write.parquet(f"{path}/stats")


def load_index(spark: SparkSession, path: str) -> Index:
    """An index that ``Index.save`` wrote."""
    return Index(*(spark.read.parquet(f"{path}/{name}") for name in ("postings", "vocabulary", "stats")))


def idf(n_docs: Column, df: Column) -> Column:
    return F.log(n_docs - df + 0.5) - F.log(df + 0.5)


def token_runs(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, dl, runs): sorted tokens stand in runs, and a run's length is how far the next one begins; ``runs`` has (run, next), each with its token and place. A row for each of ``docs``."""
    rows = docs.select(F.col(id_col).alias("id"), F.sort_array(tokens(F.coalesce(F.col(text_col), F.lit("")))).alias("__sorted"))
    pairs = F.arrays_zip(F.col("__sorted").alias("own"), F.array_prepend(F.col("__sorted"), F.lit(None)).alias("before"))
    marked = F.transform(pairs, lambda z, i: F.struct(z["own"].alias("token"), i.alias("i"), (z["own"].isNotNull() & ~z["own"].eqNullSafe(z["before"])).alias("first")))
    rows = rows.select("id", F.size("__sorted").cast("long").alias("dl"), F.filter(marked, lambda x: x["first"]).alias("__runs"))
    ahead = F.arrays_zip(F.col("__runs").alias("run"), F.slice("__runs", 2, F.greatest(F.size("__runs") - 1, F.lit(0))).alias("next"))
    return rows.select("id", "dl", ahead.alias("runs"))


def counted_tokens(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, dl, token, tf), counted within each row. Nothing is shuffled."""
    rows = token_runs(docs, id_col, text_col).select("id", "dl", F.explode("runs").alias("z"))
    return rows.select("id", "dl", F.col("z.run.token").alias("token"), (F.coalesce("z.next.i", F.col("dl").cast("int")) - F.col("z.run.i")).cast("long").alias("tf"))


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Index:
    """The tables of an index, written to the shared folder: texts are split once, and only counts are shuffled by token."""
    postings = cut(counted_tokens(docs, id_col, text_col), "postings")
    lengths = docs.agg(F.count("*").alias("n_docs")).crossJoin(F.broadcast(postings.agg(F.sum("tf").alias("total")))).select("n_docs", (F.coalesce("total", F.lit(0)) / F.col("n_docs")).alias("avgdl"))
    vocabulary = cut(postings.groupBy("token").agg(F.count("*").alias("df")), "vocabulary")
    mean = vocabulary.crossJoin(F.broadcast(lengths)).agg(F.avg(idf(F.col("n_docs"), F.col("df"))).alias("mean_idf"))
    return Index(postings, vocabulary, lengths.crossJoin(F.broadcast(mean)))  # one row each


def query_tokens(queries: DataFrame, query_col: str = "query", text_col: str = "text") -> DataFrame:
    """(query, token, qtf): how often each token stands in each query."""
    return queries.select(F.col(query_col).alias("query"), F.explode(tokens(F.col(text_col))).alias("token")).groupBy("query", "token").agg(F.count("*").alias("qtf"))


def scores(index: Index, asked: DataFrame) -> DataFrame:
    """(query, id, score) of the documents that share a token with the query; others score 0."""
    weighted = asked.join(index.vocabulary, "token").crossJoin(F.broadcast(index.stats))
    raw = idf(F.col("n_docs"), F.col("df"))
    weighted = weighted.select("query", "token", "qtf", "avgdl", F.when(raw < 0, EPSILON * F.col("mean_idf")).otherwise(raw).alias("idf"))
    part = F.col("qtf") * F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return index.postings.join(weighted, "token").groupBy("query", "id").agg(F.sum(part).alias("score"))


def with_zero_scores(found: DataFrame, docs: DataFrame, queries: DataFrame, k: int, id_col: str = "doc_id") -> DataFrame:
    """Adds to ``scores`` (query, id, score) what queries with fewer than k hits need: the documents with the least ids that share no token, at 0.

    Of any 2 * k ids at least k aren't among a query's fewer than k hits, so these few are enough for all queries."""
    few = docs.select(F.col(id_col).alias("id")).distinct().orderBy("id").limit(2 * k)
    short = queries.select("query").distinct().join(found.groupBy("query").agg(F.count("*").alias("n")), "query", "left").where(F.coalesce("n", F.lit(0)) < k).select("query")
    zeros = short.crossJoin(F.broadcast(few)).join(found.select("query", "id"), ["query", "id"], "left_anti")  # 2 * k rows
    return found.select("query", "id", "score").unionByName(zeros.withColumn("score", F.lit(0.0)))


def top_k(scored: DataFrame, k: int, *, by: str = "score", group: str | None = "query", tie: str = "id", ascending: bool = False) -> DataFrame:
    """The k best of each group with their rank, ties by id: a row_number bound that Catalyst pushes below the shuffle."""
    if k < 1:
        raise ValueError("k must be at least 1")
    best = F.asc(by) if ascending else F.desc(by)
    over = Window.partitionBy(group).orderBy(best, tie) if group else Window.partitionBy(F.lit(0)).orderBy(best, tie)
    return scored.withColumn("rank", F.row_number().over(over)).where(F.col("rank") <= k)
