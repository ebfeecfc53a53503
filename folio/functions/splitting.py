"""Splitting texts into chunks: by headings, recursively by separators, and into parents with children.

Headings are found with DataFrame functions. Greedy packing depends on what came before, so it is a small
function over one document's text, run in batches by Arrow UDFs.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf
from pyspark.sql.types import ArrayType, StringType

from folio.functions.text import HEADING, NO_HEADING

# Separators from coarse to fine.
SEPARATORS = ("\n\n", "\n", "。", " ", "")
MAX_DEPTH = 6


def pieces(text: str, separator: str) -> list[str]:
    """The text cut before every separator, which stays with what follows it."""
    if not separator:
        return list(text)
    found = re.split(f"(?={re.escape(separator)})", text)
    return [x for x in found if x]


def pack(parts: list[str], size: int, overlap: int) -> list[str]:
    """Runs of parts of at most ``size`` characters; each run begins with as many of the last parts as fit ``overlap``."""
    out: list[str] = []
    run: list[str] = []
    length = 0
    for part in parts:
        if run and length + len(part) > size:
            out.append("".join(run))
            while run and (length > overlap or length + len(part) > size):
                length -= len(run.pop(0))
        run.append(part)
        length += len(part)
    if run:
        out.append("".join(run))
    return [x.strip() for x in out if x.strip()]


def recursive(text: str, size: int, overlap: int, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Packs the parts of the first separator that the text has; a part over ``size`` is split by the finer ones."""
    at = next((i for i, s in enumerate(separators) if not s or s in text), len(separators) - 1)
    out: list[str] = []
    fitting: list[str] = []
    for part in pieces(text, separators[at]):
        if len(part) <= size:
            fitting.append(part)
            continue
        out += pack(fitting, size, overlap)
        fitting = []
        out += recursive(part, size, overlap, separators[at + 1 :]) if at + 1 < len(separators) else [part]
    return out + pack(fitting, size, overlap)


def split_recursive(text: Column, size: int = 800, overlap: int = 150) -> Column:
    """array<string>: the chunks of each text; null and blank texts have none."""

    @F.pandas_udf(ArrayType(StringType()))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(lambda t: recursive(t, size, overlap) if t else [])

    return run(text)


def sections(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc id, section, heading_path, top, body): the runs of lines between headings.

    Lines inside code fences are no headings. A heading ends deeper ones. ``heading_path`` joins the open headings by ` > `;
    ``top`` is the second-level heading, else the first deeper one, else the first-level one. Sections without text are left out."""
    lines = docs.select(id_col, F.posexplode(F.split(text_col, "\n")).alias("line", "body"))
    order = Window.partitionBy(id_col).orderBy("line")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    fences = F.sum(F.col("body").rlike(r"^\s*(```|~~~)").cast("int")).over(upto)
    lines = lines.withColumn("level", F.when(fences % 2 == 0, F.length(F.regexp_extract("body", HEADING, 1))).otherwise(0)).withColumn("heading", F.trim(F.regexp_extract("body", HEADING, 2)))
    lines = lines.withColumn("section", F.sum((F.col("level") > 0).cast("int")).over(upto).cast("long"))
    open_at = {k: F.max(F.when((F.col("level") > 0) & (F.col("level") < k), F.col("line"))).over(upto) for k in range(1, MAX_DEPTH + 1)}
    for k in range(1, MAX_DEPTH + 1):
        last = F.max(F.when(F.col("level") == k, F.struct("line", "heading"))).over(upto)
        lines = lines.withColumn(f"h{k}", F.when(last["line"] > F.coalesce(open_at[k], F.lit(-1)), last["heading"]))
    names = [f"h{k}" for k in range(1, MAX_DEPTH + 1)]
    lines = lines.where("level = 0").groupBy(id_col, "section").agg(*(F.first(n).alias(n) for n in names), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "body"))), lambda x: x["body"]), "\n").alias("body"))
    path = F.coalesce(F.nullif(F.concat_ws(" > ", *(F.nullif(F.col(n), F.lit("")) for n in names)), F.lit("")), F.lit(NO_HEADING))
    top = F.coalesce("h2", "h3", "h4", "h5", "h6", "h1", F.lit(""))
    return lines.select(id_col, "section", path.alias("heading_path"), top.alias("top"), F.trim(F.regexp_replace("body", r"^\s+|\s+$", "")).alias("body")).where("body <> ''")


def common_prefix(paths: list[str]) -> str:
    """The headings that all paths begin with."""
    rows = [p.split(" > ") for p in paths]
    shared = []
    for level in zip(*rows, strict=False):
        if len(set(level)) > 1:
            break
        shared.append(level[0])
    return " > ".join(shared) or NO_HEADING


FAMILY = ("parent", "parent_path", "parent_body", "child", "child_path", "child_body")


def families(found: list[tuple[str, str, str]], child_size: int, child_overlap: int, parent_size: int, parent_overlap: int) -> Iterator[tuple[int, str, str, int, str, str]]:
    """(parent, parent_path, parent_body, child, child_path, child_body) of one document's sections (heading_path, top, body) in order."""
    runs: list[list[tuple[str, str, str]]] = []
    size = 0
    for path, top, body in found:
        if runs and runs[-1][0][1] == top and size + len(body) <= parent_size:
            runs[-1].append((path, top, body))
            size += len(body)
        else:
            runs.append([(path, top, body)])
            size = len(body)
    parent = 0
    for group in runs:
        whole, shared = "\n\n".join(x[2] for x in group), common_prefix([x[0] for x in group])
        if len(whole) <= parent_size:
            parts = [(whole, [(path, c) for path, _, body in group for c in recursive(body, child_size, child_overlap)])]
        else:
            parts = [(p, [(shared, c) for c in recursive(p, child_size, child_overlap)]) for p in recursive(whole, parent_size, parent_overlap)]
        for text, kids in parts:
            for k, (path, kid) in enumerate(kids):
                yield parent, shared, text, k, path, kid
            parent += 1


# what Java's patterns take for white space and for ends of lines
_WHITE = " \t\n\x0b\f\r"
_HEADING = re.compile("(#{1,6})[ \\t\\x0b\\f\\r]+([^\\n\\r\x85\u2028\u2029]+)(?:\\r\\n|[\\n\\r\x85\u2028\u2029])?\\Z")
_FENCE = re.compile("[ \\t\\x0b\\f\\r]*(```|~~~)")


def text_sections(text: str) -> Iterator[tuple[int, str, str, str]]:
    """(section, heading_path, top, body) of one text: what ``sections`` gives for it."""
    names: list[str | None] = [None] * MAX_DEPTH
    section, fenced, body = 0, False, []

    def told() -> tuple[int, str, str, str]:
        path = " > ".join(n for n in names if n) or NO_HEADING
        return section, path, next((n for n in (*names[1:], names[0]) if n is not None), ""), "\n".join(body).strip(_WHITE)

    for line in text.split("\n"):
        fenced ^= bool(_FENCE.match(line))
        found = None if fenced else _HEADING.match(line)
        if found is None:
            body.append(line)
            continue
        if (row := told())[3]:
            yield row
        level = len(found.group(1))
        names[level - 1 :] = [found.group(2).strip(" "), *[None] * (MAX_DEPTH - level)]
        section, body = section + 1, []
    if (row := told())[3]:
        yield row


def parents_by_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", child_size: int = 800, child_overlap: int = 150, parent_size: int = 2000, parent_overlap: int = 200) -> DataFrame:
    """The rows of ``split_parents(sections(docs))`` by one table function over each text, joined laterally: nothing is shuffled, and repeated rows stay apart.

    Null and blank texts have no rows; a text of any length is one call."""

    @udtf(returnType="parent long, parent_path string, parent_body string, child long, child_path string, child_body string", useArrow=True)
    class SplitParents:
        def eval(self, text: str) -> Iterator[tuple]:
            if text:
                yield from families([x[1:] for x in text_sections(text)], child_size, child_overlap, parent_size, parent_overlap)

    return docs.select(id_col, text_col).lateralJoin(SplitParents(F.col(text_col).outer())).select(id_col, *FAMILY)


def split_parents(found: DataFrame, id_col: str = "doc_id", child_size: int = 800, child_overlap: int = 150, parent_size: int = 2000, parent_overlap: int = 200) -> DataFrame:
    """(doc id, parent, parent_path, parent_body, child, child_path, child_body) from ``sections``.

    Neighbouring sections with one top heading make a parent while their bodies fit ``parent_size``; a parent over it is
    split again, and its children then carry the parent's path. A document is one group; a group holds one document's text."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.sort_values("section")
        made = families(list(zip(rows["heading_path"], rows["top"], rows["body"], strict=True)), child_size, child_overlap, parent_size, parent_overlap)
        return pd.DataFrame([(rows[id_col].iloc[0], *row) for row in made], columns=[id_col, *FAMILY])

    kind = dict(found.dtypes)[id_col]
    return found.groupBy(id_col).applyInPandas(run, f"{id_col} {kind}, parent long, parent_path string, parent_body string, child long, child_path string, child_body string")
