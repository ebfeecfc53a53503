"""Note collections as DataFrames: Markdown and HTML files, evaluation sets, and tables with a text column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.functions import html as H
from folio.functions import text as T

EVAL_SCHEMA = "name string, questions array<struct<question:string,golden_answer:string,relevant_files:array<string>,relevant_chunk_ids:array<string>,turns:array<struct<question:string,golden_answer:string,relevant_files:array<string>>>>>"


def scan(spark: SparkSession, root: str, ignored: tuple[str, ...] = ()) -> DataFrame:
    """(filepath, mtime, size, content) of the Markdown and HTML files below ``root`` that aren't ignored; the path is relative to it."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{md,MD,html,HTML,htm,HTM}").load(root)
    base = root.rstrip("/").split("://")[-1].removeprefix("file:")
    path = F.regexp_replace(F.url_decode(F.regexp_replace("path", r"\+", "%2B")), "^.*?" + _quoted(base) + "/", "")
    found = files.select(path.alias("filepath"), F.unix_micros("modificationTime").cast("double").__truediv__(1e6).alias("mtime"), F.col("length").alias("size"), "content")
    return found.where(T.is_indexable(F.col("filepath"), ignored))


def _quoted(text: str) -> str:
    return "".join("\\" + c if c in r".^$*+?{}[]\|()" else c for c in text)


def load(files: DataFrame) -> DataFrame:
    """Documents of ``scan``: filepath, dir, title, tags, aliases, wikilinks, headings, url (of a page's canonical link), text, mtime, sha256."""
    markdown = files.where(F.lower("filepath").rlike(r"\.md$")).select("*", F.decode("content", "UTF-8").alias("raw"))
    pages = files.where(~F.lower("filepath").rlike(r"\.md$")).select("*", H.decode_html(F.col("content")).alias("raw"))
    raw = F.col("raw")
    notes = markdown.select(
        *_common(), F.coalesce(T.front_matter_value(raw, "title"), T.stem(F.col("filepath"))).alias("title"), T.front_matter_list(raw, "tags").alias("tags"),
        T.front_matter_list(raw, "aliases").alias("aliases"), F.array().cast("array<string>").alias("linked"), F.lit(None).cast("string").alias("url"), T.without_front_matter(raw).alias("text"),
    )
    sites = pages.select(
        *_common(), H.title(raw, F.col("filepath")).alias("title"), H.keywords(raw).alias("tags"), F.array().cast("array<string>").alias("aliases"),
        H.internal_links(raw).alias("linked"), H.canonical(raw).alias("url"), H.html_to_markdown(raw).alias("text"),
    )
    both = notes.unionByName(sites)
    return both.select("filepath", "dir", "title", "tags", "aliases", F.array_distinct(F.concat("linked", T.wikilinks(F.col("text")))).alias("wikilinks"), T.headings(F.col("text")).alias("headings"), "url", "text", "mtime", "sha256")


def _common() -> list[Column]:
    directory = F.when(F.contains("filepath", F.lit("/")), F.regexp_replace("filepath", r"/[^/]*$", "")).otherwise("")
    return [F.col("filepath"), directory.alias("dir"), F.col("mtime"), F.sha2(F.col("content"), 256).alias("sha256")]


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """(name, question_no, turn_no, question, golden_answer, relevant_files) of an evaluation set; a turn without gold of its own has its question's."""
    sets = spark.read.schema(EVAL_SCHEMA).option("multiLine", "true").json(path)
    asked = sets.select("name", F.posexplode("questions").alias("question_no", "q"))
    single = F.array(F.struct(F.col("q.question").alias("question"), F.col("q.golden_answer").alias("golden_answer"), F.col("q.relevant_files").alias("relevant_files")))
    turns = F.when(F.size(F.coalesce("q.turns", F.array())) > 0, F.col("q.turns")).otherwise(single)
    flat = asked.select("name", "question_no", "q", F.posexplode(turns).alias("turn_no", "t"))
    return flat.select("name", "question_no", "turn_no", "t.question", F.coalesce("t.golden_answer", "q.golden_answer").alias("golden_answer"), F.coalesce("t.relevant_files", "q.relevant_files").alias("relevant_files"))


def first_questions(questions: DataFrame, n: int) -> DataFrame:
    """The first n questions of each evaluation set, with all their turns."""
    return questions.where(F.col("question_no") < n)


def from_documents(docs: DataFrame) -> DataFrame:
    """The note columns of a plain documents table: the source is the directory, the language a tag, the first line the title."""
    first = F.trim(F.get(F.split("text", "\n"), F.lit(0)))
    return docs.select("doc_id", F.concat_ws("/", "source", F.concat("doc_id", F.lit(".md"))).alias("filepath"), F.col("source").alias("dir"), first.alias("title"), F.array("lang").alias("tags"), "text")


def sse_events(lines: DataFrame, column: str = "value") -> DataFrame:
    """(n, event) of server-sent lines ``data: {json}``; the marker ``[DONE]`` and broken JSON are left out."""
    data = lines.select(F.regexp_extract(column, r"^data: (.*)$", 1).alias("event")).where("event <> '' and event <> '[DONE]'")
    return data.where(F.try_parse_json("event").isNotNull())
