"""License texts in documents: MinHash bands over overlapping windows retrieve templates, exact shingle containment verifies them.

Words are runs of letters and digits in lower case; shingles are five words. A template of at most ``stride + 1`` shingles
lies within one window of ``2 * stride`` shingles that begin every ``stride``, so windows hold at least a quarter of it as a
share; with 64 bands of one row, a template that is all there is retrieved with a probability over 1 - 0.75 ** 64
(1e-8), and one that is there at 0.8 with over 1 - 0.81 ** 64 (1e-6).

Licenses resemble each other, so containment alone would take one for its sibling. For each other license that has some of a
template's shingles, the window therefore also has to hold at least half of those that the other one lacks, such as those around a name,
a version or an extra clause.

Texts and file headers are sought in the stream of a document's words. Short notices ("Released under ...") are sought among
sentences and lines that speak of a license, with marks for where a sentence begins and ends, so that they only count as sentences of their own.

Names of licenses inside longer sentences ("This file is licensed under the MIT License.") have too few shingles of their own for that. They are found as a
kind of their own by patterns: a word that grants, "under", and the name, in a sentence that neither takes it back nor asks; and identifiers behind their tag.

The templates are a fixed list, so their bands are too. A band of a window can only equal a template's if the window holds
the shingle that is the template's least there. Windows are therefore made only around those shingles, and only texts with one of
a few words are cut into shingles at all (``telling_words``); neither leaves out a match. All of it is DataFrame functions.
"""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.llm.license_texts import AFTER, GRANT, NAMES, NOTICES, REFUSED, SPDX, TEXTS
from folio.llm.quality_rules import windows_of

SHINGLE = 5
BANDS = 64
CONTAINED, DISTINCT = 0.8, 0.5
#: What every notice speaks of; sentences without it can't be one.
SPEAKS = "licens"
BEGIN, END = "^", "$"

Template = tuple[str, str]


def notice_templates() -> list[Template]:
    """(license, notice) pairs."""
    return [(k, v) for k, vs in NOTICES.items() for v in vs]


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def notice_words(text: Column) -> Column:
    """The words of the sentences and lines that speak of a license, each between a BEGIN and an END."""
    units = F.filter(F.split(F.lower(text), r"\n|(?<=[.!?])[ \t]+"), lambda u: F.contains(u, F.lit(SPEAKS)))
    return F.flatten(F.transform(units, lambda u: F.concat(F.array(F.lit(BEGIN)), words_of(u), F.array(F.lit(END)))))


def named_licenses(rows: DataFrame) -> DataFrame:
    """(doc_id, license) of docs (doc_id, text): licenses that a sentence or line grants by name, or that an identifier tells, once for each row."""
    low = F.lower("text")
    units = F.filter(F.split(low, r"\n|(?<=[.!?])[ \t]+"), lambda u: u.rlike(GRANT) & ~u.rlike(REFUSED))
    tagged = F.transform(F.regexp_extract_all(low, F.lit(SPDX), F.lit(1)), lambda t: F.regexp_replace(t, r"(?:-only|-or-later|\+)?[.+-]*$", ""))
    speaking = rows.where(low.rlike(r"[^a-z0-9]under |spdx-license-identifier:"))
    held = speaking.select("doc_id", units.alias("units"), F.array_remove(tagged, "").alias("tagged")).where((F.size("units") > 0) | (F.size("tagged") > 0))
    holds = lambda pattern: F.exists("units", lambda u: u.rlike(f"{GRANT}(?:{pattern}){AFTER}"))
    named = F.array(*(F.when(holds(pattern), F.lit(name)) for name, pattern in NAMES.items()))
    return held.select("doc_id", F.explode(F.array_distinct(F.concat(F.array_compact(named), "tagged"))).alias("license"))


def telling_words(templates: list[Template], contained: float) -> list[str]:
    """A few words of which each text that holds a template has at least one.

    Of a template the words chosen here stand in over 1 - ``contained`` of its shingles, so a text without any of them lacks too many. Long words
    come first, as they are rare. Without enough plain words in a template there are none, and every text is to be read."""
    chosen: list[str] = []
    for _, body in templates:
        words = re.findall(r"[^\W_]+", body.lower())
        shingles = {tuple(words[i : i + SHINGLE]) for i in range(len(words) - SHINGLE + 1)}
        left = set(shingles)
        plain = sorted((w for w in set(words) if w.isascii()), key=lambda w: (w not in chosen, len(w) < 7, -sum(w in x for x in shingles), w))
        for w in plain:
            if len(shingles) - len(left) > (1 - contained) * len(shingles):
                break
            if any(w in x for x in left):
                left = {x for x in left if w not in x}
                if w not in chosen:
                    chosen.append(w)
        if shingles and len(shingles) - len(left) <= (1 - contained) * len(shingles):
            return []
    return chosen


def with_shingles(rows: DataFrame, words: Column, drop: str) -> DataFrame:
    """Adds ``shingles``: the hashes of its word shingles in order. Word hashes are a column of their own, so they are worked out once."""
    hashed = rows.withColumn("__words", F.transform(words, lambda w: F.xxhash64(w))).drop(drop)
    return hashed.withColumn("shingles", windows_of(F.col("__words"), SHINGLE)).drop("__words")


def minhashes(shingles: Column, bands: int) -> Column:
    """(band, value) of each band: the least of the shingles' hashes under that band's seed."""
    return F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda b: F.struct(b.alias("band"), F.array_min(F.transform(shingles, lambda h: F.xxhash64(h, b))).alias("value")))


def template_table(spark: SparkSession, templates: list[Template], notices: bool) -> DataFrame:
    """(template, license, shingles, apart, stride). apart: for each other license that shares shingles, the template's shingles that it
    lacks; stride is the least power of two that a window of two strides needs. A row for each template, whatever the documents are."""
    rows = spark.createDataFrame([(i, k, v) for i, (k, v) in enumerate(templates)], "template int, license string, body string")
    rows = with_shingles(rows, notice_words(F.col("body")) if notices else words_of(F.col("body")), "body")
    rows = rows.select("template", "license", F.array_distinct("shingles").alias("shingles")).where(F.size("shingles") > 0)
    every = rows.groupBy(F.col("license").alias("other")).agg(F.array_distinct(F.flatten(F.collect_list("shingles"))).alias("theirs"))
    pairs = rows.join(every, (F.col("license") != F.col("other")) & F.arrays_overlap("shingles", "theirs"))  # of the fixed list
    apart = pairs.groupBy("template").agg(F.collect_list(F.array_except("shingles", "theirs")).alias("apart"))
    stride = F.pow(F.lit(2.0), F.greatest(F.lit(1.0), F.ceil(F.log2(F.greatest(F.size("shingles") - 1, F.lit(1)))).cast("double"))).cast("int")
    known = rows.join(apart, "template", "left").select("template", "license", "shingles", F.coalesce("apart", F.array().cast("array<array<bigint>>")).alias("apart"), stride.alias("stride"))
    return spark.createDataFrame(known.collect(), known.schema)


def _matches(docs: DataFrame, words: Column, known: DataFrame, bands: int, contained: float, distinct: float) -> DataFrame:
    """(row, doc_id, license, containment, first_word, n_words) of docs (doc_id, text): the best window for each template and row."""
    spark = docs.sparkSession
    rows = known.select("template", "stride", F.explode(minhashes(F.col("shingles"), bands)).alias("m")).select("template", "stride", "m.*")
    least = {(r.band, r.value) for r in rows.collect()}  # templates x bands
    strides = sorted({r.stride for r in known.select("stride").distinct().collect()})
    seeds = known.select(F.explode("shingles").alias("h")).distinct().select("h", F.explode(minhashes(F.array("h"), bands)).alias("m")).select("h", "m.*").collect()
    anchors = sorted({r.h for r in seeds if (r.band, r.value) in least})

    texts = with_shingles(docs, words, "text")
    # most rows hold none of them, which a set tells faster than a look at each place
    some = texts.where(F.size(F.array_intersect("shingles", F.array(*map(F.lit, anchors)))) > 0)
    marked = F.filter(F.transform("shingles", lambda h, i: F.struct(h.alias("h"), i.alias("i"))), lambda x: x["h"].isin(anchors))
    held = some.withColumn("at", F.transform(marked, lambda x: x["i"]))
    windows = held.withColumn("row", F.monotonically_increasing_id()).select("doc_id", "row", "shingles", "at", F.explode(F.array(*map(F.lit, strides))).alias("stride"))
    # each place lies in two windows: the one that begins at or before it, and the one before that
    numbers = F.array_distinct(F.flatten(F.transform("at", lambda i: F.array(F.floor(i / F.col("stride")), F.greatest(F.floor(i / F.col("stride")) - 1, F.lit(0))))))
    windows = windows.select("doc_id", "row", "shingles", "stride", F.explode(numbers).alias("number"))
    windows = windows.select("doc_id", "row", "stride", "number", F.slice("shingles", (F.col("number") * F.col("stride") + 1).cast("int"), 2 * F.col("stride")).alias("window"))
    banded = windows.select("*", F.explode(minhashes(F.col("window"), bands)).alias("m")).select("doc_id", "row", "stride", "number", "window", "m.*")
    candidates = banded.join(F.broadcast(rows), ["stride", "band", "value"])
    candidates = candidates.groupBy("row", "number", "template").agg(F.first("doc_id").alias("doc_id"), F.first("window").alias("window"))
    share = lambda part: F.size(F.array_intersect("window", part)) / F.size(part)
    checked = candidates.join(F.broadcast(known), "template").withColumn("containment", F.round(share("shingles"), 4)).where(F.col("containment") >= contained)
    checked = checked.where(F.forall("apart", lambda part: F.size(F.array_intersect("window", part)) >= distinct * F.size(part)))
    best = F.min_by(F.struct("doc_id", "containment", (F.col("number") * F.col("stride")).cast("long").alias("first_word"), (2 * F.col("stride") + SHINGLE - 1).cast("long").alias("n_words")), F.struct(-F.col("containment"), F.col("number"), F.col("template")))
    return checked.groupBy("row", "license").agg(best.alias("b")).select("b.doc_id", "license", "b.containment", "b.first_word", "b.n_words")


def scan_licenses(docs: DataFrame, texts: list[Template] | None = None, notices: list[Template] | None = None, bands: int = BANDS, contained: float = CONTAINED, distinct: float = DISTINCT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, license, kind, containment, first_word, n_words): a row for each license found in a row of ``docs``, as a ``text``, a ``notice`` or a ``name``.

    containment is the share of a template's distinct shingles in its best window, which begins at word first_word (the first of
    equals); for notices, words are those of the sentences that speak of a license, with their two marks. A name has a containment of 1, and no window: first_word is -1 and n_words 0. Null and empty texts match nothing; a
    text of any length is scanned whole; a repeated row gives its matches again; an empty table gives no rows; other columns are left
    out, so their names can't clash."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    told = telling_words(texts or list(TEXTS.items()), contained)
    possible = rows.where(reduce(or_, (F.contains(F.lower("text"), F.lit(w)) for w in told))) if told else rows
    whole = _matches(possible, words_of(F.col("text")), template_table(spark, texts or list(TEXTS.items()), False), bands, contained, distinct)
    speaking = rows.where(F.contains(F.lower("text"), F.lit(SPEAKS)))
    short = _matches(speaking, notice_words(F.col("text")), template_table(spark, notices or notice_templates(), True), bands, contained, distinct)
    kind = lambda found, name: found.select("doc_id", "license", F.lit(name).alias("kind"), "containment", "first_word", "n_words")
    named = named_licenses(rows).select("doc_id", "license", F.lit(1.0).alias("containment"), F.lit(-1).cast("long").alias("first_word"), F.lit(0).cast("long").alias("n_words"))
    return kind(whole, "text").unionByName(kind(short, "notice")).unionByName(kind(named, "name"))
