"""What surrounds a model's answer: its JSON, verdicts, sources, context blocks, image marks and links."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

VERDICTS = ("sufficient", "insufficient", "rewrite", "clarify")
# Fixed value: the mark of an image in an answer.
MARK = r"\[\[IMG:([^\]\s]+)\]\]"
PREVIEW, OBSERVATION, MOST_IMAGES = 200, 500, 4


def json_block(text: Column, required: tuple[str, ...] = ()) -> Column:
    """The first balanced JSON object in a text that has all ``required`` keys; else null."""

    @F.pandas_udf(StringType())
    def find(texts: pd.Series) -> pd.Series:
        decoder = json.JSONDecoder()

        def one(t: str | None) -> str | None:
            at = (t or "").find("{")
            while at >= 0:
                try:
                    value, end = decoder.raw_decode(t, at)
                    if all(k in value for k in required):
                        return t[at:end]
                except ValueError:
                    pass
                at = t.find("{", at + 1)
            return None

        return texts.map(one)

    return F.when(F.contains(text, F.lit("{")), find(text))


def verdict(text: Column) -> Column:
    """A judge's verdict in lower case; what is not known counts as sufficient."""
    found = F.lower(F.trim(F.coalesce(text, F.lit(""))))
    return F.when(found.isin(*VERDICTS), found).otherwise("sufficient")


def clamp(value: Column) -> Column:
    """A number as a share: bounded by 0 and 1, NaN as 0, and null if it isn't a number."""
    number = value.try_cast("double")
    return F.when(number.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.nanvl(number, F.lit(0.0)))))


def sources(hits: DataFrame) -> DataFrame:
    """(query, rank, id, preview, score): what a client shows of each hit."""
    return hits.select("query", "rank", "id", F.left("content", F.lit(PREVIEW)).alias("preview"), F.round("score", 4).alias("score"))


def context_block(hits: DataFrame, group: str = "query") -> DataFrame:
    """(group, context): hits by rank as numbered sections with their title and day of change."""
    day = F.date_format(F.timestamp_seconds(F.col("mtime")), "yyyy-MM-dd")
    head = F.concat(F.lit("### ["), F.col("rank").cast("string"), F.lit("] "), "title", F.when(F.col("mtime").isNotNull(), F.concat(F.lit("（修改于 "), day, F.lit("）"))).otherwise(""))
    blocks = hits.select(group, F.struct("rank", F.concat(head, F.lit("\n"), "content").alias("block")).alias("b"))
    return blocks.groupBy(group).agg(F.array_join(F.transform(F.array_sort(F.collect_list("b")), lambda x: x["block"]), "\n\n").alias("context"))


def history_lines(turns: DataFrame, n: int = 20, session: str = "conv_id", order: str = "turn") -> DataFrame:
    """(session, history): the last n turns that say something, one line each."""
    from folio.operators.context import last_turns

    said = last_turns(turns.where(F.trim(F.coalesce("text", F.lit(""))) != ""), n, session, order)
    line = F.concat(F.when(F.col("role") == "user", "用户: ").otherwise("助手: "), F.col("text"))
    return said.groupBy(session).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("l")))), lambda x: x["l"]), "\n").alias("history"))


def replace_marks(answers: DataFrame, assets: DataFrame, id_col: str = "id", answer_col: str = "answer") -> DataFrame:
    """(id, answer): image marks become images where the asset is known, and go where it isn't. assets: asset_id, img_url, alt."""
    marks = answers.select(id_col, F.explode(F.array_distinct(F.regexp_extract_all(answer_col, F.lit(MARK), F.lit(1)))).alias("asset_id"))
    image = F.concat(F.lit("!["), F.coalesce("alt", F.lit("")), F.lit("]("), "img_url", F.lit(")"))
    found = marks.join(assets, "asset_id").groupBy(id_col).agg(F.collect_list(F.struct(F.concat(F.lit("[[IMG:"), "asset_id", F.lit("]]")).alias("mark"), image.alias("image"))).alias("__found"))
    joined = answers.join(found, id_col, "left").withColumn("__found", F.coalesce("__found", F.array().cast("array<struct<mark:string,image:string>>")))
    filled = F.aggregate("__found", F.col(answer_col), lambda t, x: F.replace(t, x["mark"], x["image"]))
    return joined.select(id_col, F.regexp_replace(filled, MARK, "").alias(answer_col))


def append_images(answers: DataFrame, images: DataFrame, most: int = MOST_IMAGES, id_col: str = "id", answer_col: str = "answer") -> DataFrame:
    """(id, answer): the first ``most`` images of an answer's context (id, n, img_url, alt) that it doesn't show yet are put at its end."""
    missing = answers.join(images, id_col).where(~F.contains(answer_col, F.col("img_url")))
    line = F.concat(F.lit("\n!["), F.coalesce("alt", F.lit("")), F.lit("]("), "img_url", F.lit(")"))
    listed = F.array_join(F.transform(F.slice(F.array_sort(F.collect_list(F.struct("n", line.alias("line")))), 1, most), lambda x: x["line"]), "\n")
    found = missing.groupBy(id_col).agg(listed.alias("__lines"))
    block = F.when(F.coalesce("__lines", F.lit("")) != "", F.concat(F.lit("\n\n---\n**相关图片：**\n"), "__lines", F.lit("\n"))).otherwise("")
    return answers.join(found, id_col, "left").select(id_col, F.concat(answer_col, block).alias(answer_col))


def absolute_assets(text: Column, base: str) -> Column:
    return F.replace(text, F.lit("](/assets/"), F.lit(f"]({base.rstrip('/')}/assets/"))


def deep_link(path: Column, vault: str | None = None) -> Column:
    """A link that opens a note in its editor, its path percent-encoded."""
    file = F.regexp_replace(F.url_encode(F.regexp_replace(path, r"\.md$", "")), r"\+", "%20")
    head = F.concat(F.lit("obsidian://open?vault="), F.regexp_replace(F.url_encode(F.lit(vault)), r"\+", "%20"), F.lit("&file=")) if vault else F.lit("obsidian://open?file=")
    return F.concat(head, file)


def truncated(text: Column, most: int = OBSERVATION) -> Column:
    return F.when(F.length(text) > most, F.concat(F.left(text, F.lit(most)), F.lit("…"))).otherwise(text)


def etag(mtime: Column, size: Column) -> Column:
    return F.concat_ws("-", F.lower(F.hex(mtime.cast("long"))), F.lower(F.hex(size)))


def should_clarify(verdict: Column, question: Column, confidence: Column, just_clarified: Column, threshold: float = 0.5, enabled: bool = True) -> Column:
    """Whether to ask back: the judge wants it and words a question, the condensed question can't be trusted, and the last turn wasn't a question back."""
    unsure = F.coalesce(confidence, F.lit(1.0)) < threshold
    return F.lit(enabled) & (F.coalesce(verdict, F.lit("")) == "need_clarify") & (F.trim(F.coalesce(question, F.lit(""))) != "") & unsure & ~F.coalesce(just_clarified, F.lit(False))
