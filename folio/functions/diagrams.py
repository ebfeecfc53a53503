"""Diagrams as tables: nodes and edges of mermaid flowcharts and of SVG drawings."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# First words of diagram kinds, the brackets of node shapes, and how near a label and an edge's end must be.
KINDS = {"sequencediagram": "sequence", "classdiagram": "class", "statediagram": "state", "erdiagram": "er", "gantt": "gantt", "pie": "pie", "mindmap": "mindmap", "timeline": "timeline"}
SHAPES = (("[[", "]]", "subprocess"), ("[(", ")]", "cylinder"), ("((", "))", "circle"), ("[", "]", "rect"), ("(", ")", "round"), ("{", "}", "diamond"))
LABEL_NEAR, END_NEAR = 60.0, 120.0
SKIPPED = r"(?i)^(subgraph|end|direction|classdef|class\s|click|style\s|linkstyle|graph\s|flowchart\s|%%)"


def mermaid_source(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(text), r"^```(?:mermaid)?\s*", ""), r"\s*```$", ""))


def mermaid_kind(text: Column) -> Column:
    first = F.lower(F.trim(F.get(F.split(mermaid_source(text), "\n"), F.lit(0))))
    out = F.when(first.rlike(r"^(flowchart|graph)\s+(tb|td|bt|rl|lr)\b"), "flowchart")
    for word, kind in KINDS.items():
        out = out.when(first.startswith(word), kind)
    return out.otherwise("unknown")


_TOKEN = re.compile(r"\s*(?:(?P<arrow><?[-.=]{1,3}>{0,2}|->>)|\|(?P<mid>[^|]*)\||(?P<name>\w+))")


def flow_line(line: str) -> tuple[list[tuple[str, str, str]], list[tuple[str, str, str]]]:
    """(nodes: id, label, shape; edges: from, to, label) of one line, read from left to right: names, brackets behind them, arrows between."""
    nodes, edges, at, left, label, arrow = [], [], 0, None, "", False
    while at < len(line):
        m = _TOKEN.match(line, at)
        if not m or m.end() == at:
            at += 1
            continue
        at = m.end()
        if m["arrow"]:
            arrow = True
            inline = re.match(r"\s*([^->|][^>|]*?)\s*--+>", line[at:]) if m["arrow"] == "--" else None
            if inline:
                label, at = inline[1].strip(), at + inline.end()
        elif m["mid"] is not None:
            label = m["mid"].strip()
        else:
            name, text, shape = m["name"], "", ""
            for opening, closing, kind in SHAPES:
                if line.startswith(opening, at) and (end := line.find(closing, at + len(opening))) >= 0:
                    text, shape, at = line[at + len(opening) : end].strip().strip('"'), kind, end + len(closing)
                    break
            nodes.append((name, text, shape))
            if arrow and left is not None:
                edges.append((left, name, label))
            left, label, arrow = name, "", False
    return nodes, edges


def parse_flowchart(source: str) -> list[tuple[str, int, str, str, str, str]]:
    """Rows (what, number, a, b, label, group): nodes with their label and shape, edges with their ends."""
    nodes: dict[str, list[str]] = {}
    edges: list[tuple[str, str, str]] = []
    group = ""
    for raw in source.splitlines():
        line = raw.strip()
        if m := re.match(r"(?i)subgraph\s+(.*)", line):
            group = re.sub(r"^\w*\s*\[(.*)\]$", r"\1", m[1]).strip()
        elif line.lower() == "end":
            group = ""
        elif line and not re.match(SKIPPED, line):
            found, linked = flow_line(line)
            for name, label, shape in found:
                node = nodes.setdefault(name, [name, "rect", group])
                node[0], node[1], node[2] = label or node[0], shape or node[1], group or node[2]
            edges += linked
    rows = [("node", i, name, shape, label, where) for i, (name, (label, shape, where)) in enumerate(nodes.items())]
    return rows + [("edge", i, a, b, label, "") for i, (a, b, label) in enumerate(edges)]


def mermaid_graph(diagrams: DataFrame, id_col: str = "id", source_col: str = "source") -> DataFrame:
    """(id, what, number, a, b, label, group) of every flowchart; other kinds have no rows."""
    kind = dict(diagrams.dtypes)[id_col]
    flows = diagrams.select(id_col, mermaid_source(F.col(source_col)).alias("source"), mermaid_kind(F.col(source_col)).alias("kind")).where("kind = 'flowchart'").select(id_col, "source")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([(i, *row) for i, s in zip(pdf[id_col], pdf["source"], strict=True) for row in parse_flowchart(s)], columns=[id_col, "what", "number", "a", "b", "label", "group"])

    return flows.mapInPandas(run, f"{id_col} {kind}, what string, number long, a string, b string, label string, group string")


def raw_text(graph: DataFrame, id_col: str = "id") -> DataFrame:
    """(id, raw_text): node labels, then edges as ``from->to(label)``, in their order."""
    nodes, edges = graph.where("what = 'node'"), graph.where("what = 'edge'")
    names = nodes.select(id_col, F.col("a").alias("name"), F.col("label").alias("text"))
    ends = edges.join(names.select(id_col, F.col("name").alias("a"), F.col("text").alias("ta")), [id_col, "a"], "left").join(names.select(id_col, F.col("name").alias("b"), F.col("text").alias("tb")), [id_col, "b"], "left")
    arrow = F.concat(F.coalesce("ta", "a"), F.lit("->"), F.coalesce("tb", "b"), F.when(F.col("label") != "", F.concat(F.lit("("), F.col("label"), F.lit(")"))).otherwise(""))
    parts = nodes.select(id_col, F.lit(0).alias("o"), "number", F.col("label").alias("part")).unionByName(ends.select(id_col, F.lit(1).alias("o"), "number", arrow.alias("part")))
    return parts.groupBy(id_col).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o", "number", "part"))), lambda x: x["part"]), " ").alias("raw_text"))


def _numbers(text: str) -> list[float]:
    return [float(x) for x in re.findall(r"-?\d+(?:\.\d+)?", text or "")]


def svg_elements(source: str) -> list[tuple[str, int, str, float, float, float, float, str]]:
    """(what, number, name, x, y, x2, y2, text): texts and shapes at their places, lines with both ends."""
    try:
        root = ET.fromstring(source)
    except ET.ParseError:
        return []
    out = []
    n_shapes = 0
    for i, e in enumerate(root.iter()):
        tag = e.tag.rsplit("}", 1)[-1]
        get = lambda k, e=e: (_numbers(e.get(k, "")) or [0.0])[0]
        if tag == "text":
            text = " ".join(" ".join(e.itertext()).split())
            if text:
                out.append(("text", i, "", get("x"), get("y"), 0.0, 0.0, text))
            continue
        arrow = tag == "path" and (e.get("marker-end") or e.get("marker-start"))
        if tag == "line":
            out.append(("line", i, "", get("x1"), get("y1"), get("x2"), get("y2"), ""))
        elif tag == "polyline" or arrow:
            p = _numbers(e.get("points") or e.get("d") or "")
            if len(p) >= 4:
                out.append(("line", i, "", p[0], p[1], *p[len(p) // 2 * 2 - 2 : len(p) // 2 * 2], ""))
        elif tag in ("rect", "circle", "ellipse", "polygon", "path"):
            p = _numbers(e.get("points") or e.get("d") or "")
            if tag == "rect":
                x, y = get("x") + get("width") / 2, get("y") + get("height") / 2
            elif tag in ("circle", "ellipse"):
                x, y = get("cx"), get("cy")
            elif len(p) < 2:
                continue
            else:
                xs, ys = (p[0:1], p[1:2]) if tag == "path" else (p[0::2], p[1::2])
                x, y = sum(xs) / len(xs), sum(ys) / len(ys)
            out.append(("shape", i, e.get("id") or f"n{n_shapes}", x, y, 0.0, 0.0, tag))
            n_shapes += 1
    return out


def svg_graph(drawings: DataFrame, id_col: str = "id", source_col: str = "source") -> tuple[DataFrame, DataFrame]:
    """(nodes: id, name, shape, label; edges: id, a, b, label): labels are the nearest text, ends the nearest shape, both within a bound.

    The nearest are found by joins within a drawing and ``min_by`` of the distance; a drawing is a bounded group."""
    kind = dict(drawings.dtypes)[id_col]
    columns = [id_col, "what", "number", "name", "x", "y", "x2", "y2", "text"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([(i, *row) for i, s in zip(pdf[id_col], pdf[source_col], strict=True) for row in svg_elements(s or "")], columns=columns)

    parts = drawings.select(id_col, source_col).mapInPandas(run, f"{id_col} {kind}, what string, number long, name string, x double, y double, x2 double, y2 double, text string")
    texts = parts.where("what = 'text'").select(id_col, F.col("number").alias("t"), F.col("x").alias("tx"), F.col("y").alias("ty"), F.col("text").alias("label"))
    shapes, lines = parts.where("what = 'shape'"), parts.where("what = 'line'")
    far = lambda a, b: F.sqrt(F.pow(F.col(a[0]) - F.col(b[0]), 2) + F.pow(F.col(a[1]) - F.col(b[1]), 2))

    def labelled(rows: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
        near = rows.join(texts, id_col).withColumn("d", far((x, y), ("tx", "ty"))).where(F.col("d") < LABEL_NEAR)
        best = near.groupBy(*keys).agg(F.min_by("label", F.struct("d", "t")).alias("label"))
        return rows.join(best, keys, "left").withColumn("label", F.coalesce("label", F.lit("")))

    nodes = labelled(shapes, [id_col, "number"], "x", "y").select(id_col, "name", F.col("text").alias("shape"), "label")
    spots = shapes.select(id_col, F.col("number").alias("s"), "name", F.col("x").alias("sx"), F.col("y").alias("sy"))
    ends = lines.select(id_col, "number", F.explode(F.array(F.struct(F.lit("a").alias("end"), F.col("x").alias("x"), F.col("y").alias("y")), F.struct(F.lit("b").alias("end"), F.col("x2").alias("x"), F.col("y2").alias("y")))).alias("e")).select(id_col, "number", "e.*")
    near = ends.join(spots, id_col).withColumn("d", far(("x", "y"), ("sx", "sy"))).where(F.col("d") < END_NEAR)
    tied = near.groupBy(id_col, "number").pivot("end", ["a", "b"]).agg(F.min_by("name", F.struct("d", "s"))).where("a is not null and b is not null and a <> b")
    middles = lines.withColumn("mx", (F.col("x") + F.col("x2")) / 2).withColumn("my", (F.col("y") + F.col("y2")) / 2).join(tied, [id_col, "number"]).select(id_col, "number", "a", "b", "mx", "my")
    return nodes, labelled(middles, [id_col, "number"], "mx", "my").select(id_col, "a", "b", "label")
