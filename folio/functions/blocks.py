"""Rich blocks of Markdown (diagrams, code, tables, images): taken out under placeholders, put back, and summed up.

Placeholders are numbered in order of kind and place, so results repeat from run to run. Kinds are taken out in a fixed
order, since a diagram is also a fence: mermaid, code, table, image.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The syntax of each kind of block.
MERMAID = r"```mermaid[ \t]*\n[\s\S]*?```"
CODE = r"```\w*\n[\s\S]*?```"
TABLE = r"(?m)(?:^\|.*(?:\n|\z)){2,}"
IMAGE = r"!\[\[[^\]]+\]\]|!\[[^\]]*\]\([^)]+\)"
KINDS = (("mermaid", MERMAID), ("code", CODE), ("table", TABLE), ("image", IMAGE))
PLACEHOLDER = r"<CODE_UID_[0-9a-f]{8}>|\[(?:TABLE|MERMAID|IMAGE)_UID_[0-9a-f]{8}\]"
BLOCK = "array<struct<kind:string,placeholder:string,raw:string,context:string>>"
# Characters before a table or diagram that may hold its caption, and on either side of an image that tell what it shows.
CAPTION_WINDOW, IMAGE_WINDOW = 200, 80


def placeholder(kind: str, number: Column) -> Column:
    body = F.concat(F.lit(f"{kind.upper()}_UID_"), F.lpad(F.lower(F.hex(number)), 8, "0"))
    return F.concat(F.lit("<"), body, F.lit(">")) if kind == "code" else F.concat(F.lit("["), body, F.lit("]"))


def _numbered(found: Column, kind: str) -> Column:
    return F.transform(found, lambda raw, i: F.struct(F.lit(kind).alias("kind"), placeholder(kind, (i + F.size("blocks")).cast("long")).alias("placeholder"), raw.alias("raw"), F.lit("").alias("context")))


def _with_context(text: Column, block: Column) -> Column:
    """A block with what is said around its placeholder: the line before it, and for an image some characters on either side. Other blocks say nothing."""
    before, behind = (F.call_function("substring_index", text, block["placeholder"], F.lit(side)) for side in (1, -1))
    line = F.element_at(F.split(F.regexp_replace(F.right(before, F.lit(CAPTION_WINDOW)), r"^\s+|\s+$", ""), "\n"), -1)
    around = F.concat(F.right(before, F.lit(IMAGE_WINDOW)), block["raw"], F.left(behind, F.lit(IMAGE_WINDOW)))
    said = F.when(block["kind"] == "image", around).otherwise(line)
    known = (block["kind"] != "code") & F.contains(text, block["placeholder"])  # a block inside another one has no place of its own
    return F.struct(block["kind"].alias("kind"), block["placeholder"].alias("placeholder"), block["raw"].alias("raw"), F.when(known, strip_placeholders(said)).otherwise("").alias("context"))


def extract(docs: DataFrame, text: str = "text") -> DataFrame:
    """Replaces ``text`` by the text with placeholders and adds ``blocks``, in the order in which they were taken out, each with its caption or context."""
    docs = docs.withColumn("blocks", F.array().cast(BLOCK))
    for kind, pattern in KINDS:
        found = F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0))
        docs = docs.withColumn("__new", _numbered(found, kind))
        # each block is replaced where it stands first: earlier copies of it have been replaced by then
        place = lambda t, b: F.position(b["raw"], t)
        cut = F.aggregate("__new", F.col(text), lambda t, b: F.concat(F.left(t, place(t, b) - 1), b["placeholder"], F.substring(t, place(t, b) + F.length(b["raw"]), F.length(t))))
        docs = docs.withColumn(text, cut).withColumn("blocks", F.concat("blocks", "__new")).drop("__new")
    return docs.withColumn("blocks", F.transform("blocks", lambda b: _with_context(F.col(text), b)))


def restore(text: Column, blocks: Column) -> Column:
    """Puts raw blocks back, the last taken out first, so that blocks inside blocks return too."""
    return F.aggregate(F.reverse(blocks), text, lambda t, b: F.replace(t, b["placeholder"], b["raw"]))


def strip_placeholders(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(text, PLACEHOLDER, " "), r"[ \t]{2,}", " "))


def has_kind(text: Column, blocks: Column, kind: str) -> Column:
    return F.exists(blocks, lambda b: (b["kind"] == kind) & F.contains(text, b["placeholder"]))


def image_target(raw: Column) -> Column:
    """struct<src, dims, alt> of an image's syntax."""
    target = F.coalesce(F.nullif(F.regexp_extract(raw, r"!\[\[([^\]]+)\]\]", 1), F.lit("")), F.regexp_extract(raw, r"!\[[^\]]*\]\(([^)]+)\)", 1))
    parts = F.split(target, r"\|", 2)
    return F.struct(F.trim(F.get(parts, F.lit(0))).alias("src"), F.trim(F.get(parts, F.lit(1))).alias("dims"), F.trim(F.regexp_extract(raw, r"!\[([^\]\[]*)\]\(", 1)).alias("alt"))


def summaries(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, number, kind, placeholder, summary): a describing chunk for each block that isn't code, with its caption or what is said around it."""
    # outer, as Spark would else ask below the explosion whether there are any, by working all of them out once more
    rows = docs.select(id_col, F.posexplode_outer("blocks").alias("number", "b")).where("b.kind <> 'code'")
    head = F.split(F.col("b.raw"), "\n")
    columns = F.array_join(F.array_remove(F.transform(F.split(F.get(head, F.lit(0)), r"\|"), lambda x: F.trim(x)), ""), ", ")
    image = image_target(F.col("b.raw"))
    text = (
        F.when(F.col("b.kind") == "table", F.concat(F.lit("表格，列："), columns, F.lit("，行数："), (F.size(F.array_remove(head, "")) - 2).cast("string")))
        .when(F.col("b.kind") == "mermaid", F.concat(F.lit("流程图："), F.trim(F.regexp_replace(F.regexp_replace("b.raw", r"```(mermaid)?", ""), r"\s+", " "))))
        .otherwise(F.concat_ws(" ", F.lit("图片："), image["alt"], image["src"]))
    )
    around = F.when(F.col("b.context") != "", F.concat(F.lit("，上下文："), F.col("b.context"))).otherwise("")
    return rows.select(id_col, "number", F.col("b.kind").alias("kind"), F.col("b.placeholder").alias("placeholder"), F.concat(text, around).alias("summary"))


def classify_source(content: Column, declared: Column) -> Column:
    """A result's kind: what it is declared as, else image before mermaid before table before text."""
    return (
        F.when(declared.isin("table", "mermaid", "image"), declared)
        .when(content.rlike(IMAGE), "image")
        .when(content.rlike(MERMAID), "mermaid")
        .when(content.rlike(TABLE), "table")
        .otherwise("text")
    )
