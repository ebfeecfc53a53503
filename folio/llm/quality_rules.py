"""Cross-document line frequency: lines that many documents of a host share go, and documents that they deplete are rejected.

A line is normalised (ends trimmed of ASCII white space, lower case) and hashed. For each host, documents are counted by
distinct text, so that copies of one document, which exact deduplication deals with, don't make its lines boilerplate.
A line is removed on a host where more than ``max_docs`` distinct texts have it and they are more than ``max_share_percent`` of
the host's, or, as a share says little on a large host, where it has LONG_LINE characters and more than ``always_docs`` texts have it.
Lines meet the list of their host as rows of hashes, so what a row costs doesn't grow with its host's list. All of it is
DataFrame functions; only hashes and counts are shuffled, but for the lines themselves where ``clean_text`` is asked for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.llm.spread import spread_join
from folio.storage import cut

WHITE = r"[\x20\x09-\x0D]"
WHITE_CHARS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
#: Characters from which a line that very many documents share is no chance.
LONG_LINE = 30


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, WHITE + "+"), "")


def lines_of(text: Column) -> Column:
    """Lines that hold a word."""
    return F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))


def line_hash(line: Column) -> Column:
    return F.xxhash64(F.lower(F.btrim(line, F.lit(WHITE_CHARS))))


def windows_of(hashes: Column, size: int) -> Column:
    """A hash for each run of ``size`` values, in order; empty if there are fewer."""
    shifted = F.arrays_zip(*(F.slice(hashes, i + 1, F.greatest(F.size(hashes) - i, F.lit(0))).alias(f"w{i}") for i in range(size)))
    return F.transform(F.slice(shifted, 1, F.greatest(F.size(hashes) - (size - 1), F.lit(0))), lambda z: F.xxhash64(z))


def with_coverage(rows: DataFrame, windows: str, size: int, name: str) -> DataFrame:
    """Adds ``name``: the values that stand in a window found twice or more. Sorted windows show repeats side by side, and their sorted places how far they overlap.

    Each step is a column of its own: Catalyst keeps columns that are read more than once apart, so none is worked out again for each element."""
    w = F.col(windows)
    sorted_windows = F.sort_array(F.transform(w, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    rows = rows.withColumn("__at", F.when(F.size(F.array_distinct(w)) == F.size(w), F.array().cast("array<struct<h:bigint,i:int>>")).otherwise(sorted_windows)).drop(windows)
    at = F.col("__at")
    beside = F.arrays_zip(at.alias("own"), F.array_prepend(at, F.lit(None)).alias("before"), F.slice(at, 2, F.greatest(F.size(at) - 1, F.lit(0))).alias("behind"))
    repeats = F.filter(beside, lambda z: F.coalesce(z["own"]["h"] == z["before"]["h"], F.lit(False)) | F.coalesce(z["own"]["h"] == z["behind"]["h"], F.lit(False)))
    rows = rows.withColumn("__places", F.sort_array(F.transform(repeats, lambda z: z["own"]["i"]))).drop("__at")
    places = F.col("__places")
    pairs = F.arrays_zip(places.alias("p"), F.slice(places, 2, F.greatest(F.size(places) - 1, F.lit(0))).alias("q"))
    total = F.aggregate(pairs, F.lit(0).cast("long"), lambda total, z: total + F.when(z["p"].isNull(), 0).otherwise(F.least(F.lit(size), F.coalesce(z["q"] - z["p"], F.lit(size)))))
    return rows.withColumn(name, total).drop("__places")


def frequent_lines(docs: DataFrame, max_docs: int, max_share_percent: int, always_docs: int) -> DataFrame:
    """(host, h): the hashes of each host's lines above the limits."""
    line = lambda x: F.struct(line_hash(x).alias("h"), (F.length(F.btrim(x, F.lit(WHITE_CHARS))) >= LONG_LINE).alias("long"))
    rows = docs.select("host", F.xxhash64("text").alias("t"), F.array_distinct(F.transform(lines_of(F.col("text")), line)).alias("lines"))
    by_line = rows.select("host", "t", F.explode("lines").alias("x")).select("host", "t", "x.*").distinct().groupBy("host", "h", "long").agg(F.count("*").alias("n")).where(F.col("n") > max_docs)
    by_host = rows.select("host", "t").distinct().groupBy("host").agg(F.count("*").alias("texts"))
    above = (100 * F.col("n") > max_share_percent * F.col("texts")) | (F.col("long") & (F.col("n") > always_docs))
    return by_line.join(by_host, "host").where(above).select("host", "h")


def quality_rules(
    docs: DataFrame,
    max_docs: int = 10,
    max_share_percent: int = 2,
    max_removed_percent: int = 70,
    min_words: int = 10,
    max_repeat_percent: int = 20,
    always_docs: int = 1000,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
    clean: bool = True,
) -> DataFrame:
    """A row for each row of ``docs``: doc_id, counts, base_failed, kept, and with ``clean`` ``clean_text`` without the frequent lines.

    Null and empty texts fail the base rules; a null host is the empty host; a text of any length is read whole; ties need no order;
    repeated rows count as one text and each gets its row; an empty table gives no rows. Other columns of ``docs`` are left out, so
    their names can't clash."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), F.coalesce(F.col(host_col).cast("string"), F.lit("")).alias("host"))
    frequent = cut(frequent_lines(rows, max_docs, max_share_percent, always_docs), "frequent-lines")

    text = F.col("text")
    counted = rows.withColumn("words", F.transform(words_of(text), lambda w: F.xxhash64(w))).withColumn("lines", lines_of(text))
    counted = counted.select(
        "doc_id", "text", "host",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.translate(text, WHITE_CHARS, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        windows_of(F.col("words"), 5).alias("windows"),
        F.transform("lines", lambda x: F.struct(line_hash(x).alias("h"), F.length(x).cast("long").alias("n"))).alias("lines"),
    )
    counted = with_coverage(counted, "windows", 5, "n_repeat_words")
    chars = F.aggregate("lines", F.lit(0).cast("long"), lambda total, x: total + x["n"])
    counted = counted.withColumns({"n_lines": F.size("lines").cast("long"), "line_chars": chars})
    # written with a number for each row, so that the numbers stay
    held = cut((counted if clean else counted.drop("text")).withColumn("__row", F.monotonically_increasing_id()), "counted", "zstd")
    lines = held.select("__row", "host", F.explode("lines").alias("x")).select("__row", "host", "x.*")
    gone = spread_join(lines, frequent, ["host", "h"]).groupBy("__row").agg(F.count("*").alias("n_removed_lines"), F.sum("n").alias("removed_chars"))
    judged = held.drop("lines").join(gone, "__row", "left").fillna(0, ["n_removed_lines", "removed_chars"])
    if clean:
        judged = judged.join(_clean_texts(held, frequent), "__row", "left").withColumn("clean_text", F.when(F.col("n_removed_lines") == 0, text).otherwise(F.coalesce("clean_text", F.lit(""))))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
        (~failed & (100 * F.col("removed_chars") <= max_removed_percent * F.col("line_chars"))).alias("kept"),
        "n_lines", "n_removed_lines", "removed_chars", *(["clean_text"] if clean else []),
    )


def _clean_texts(held: DataFrame, frequent: DataFrame) -> DataFrame:
    """(__row, clean_text): the lines of each row that aren't frequent on its host, in order."""
    lines = held.select("__row", "host", F.posexplode(F.split("text", "\n")).alias("place", "line")).withColumn("h", line_hash(F.col("line")))
    gone = spread_join(lines.select("__row", "host", "place", "h"), frequent, ["host", "h"]).select("__row", "place")
    left = lines.select("__row", "place", "line").join(gone, ["__row", "place"], "left_anti")
    return left.groupBy("__row").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "line"))), lambda x: x["line"]), "\n").alias("clean_text"))
