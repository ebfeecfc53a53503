"""A Merkle manifest of a dataset: a tree for each group of rows, a tree over the groups' roots, and a proof for every row.

Leaves get their places by a range partitioning and sums over its partitions. Then nodes are events: a task keeps partial
parents, each takes digests of its children by their index, and the one that has as many as its place and the size of its level
ask for becomes a node, and so an event for its own parent. What a task can't complete goes on to the next round, in which
nodes under one ancestor meet; ancestors are ``SPAN`` levels apart, so rounds grow with the height over ``SPAN``. A parent that is complete leaves a reverse
link, the digests of its children; proofs walk down these links, ``STEP`` levels in a task, so no task holds more than ``arity ** STEP`` paths.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.storage import cut

#: Binary levels that one round of open nodes, and one step of proofs, go over; fewer for wider trees.
SPAN, STEP = 14, 8

_LINKS = "tree binary, level int, parent long, children array<string>, n long, kind int"


def digest_of(fields: list[Column]) -> Column:
    """Lowercase hex SHA-256 of the fields one after another, each as ``-`` if null, else its UTF-8 byte count, ``:`` and its value."""
    parts = [F.coalesce(F.concat(F.octet_length(f.cast("string")).cast("string"), F.lit(":"), f.cast("string")), F.lit("-")) for f in fields]
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def height(n: int, arity: int) -> int:
    levels = 0
    while n > 1:
        n, levels = -(-n // arity), levels + 1
    return levels


def _levels(binary: int, arity: int) -> int:
    return max(1, int(binary / (arity - 1).bit_length()))


class Frontier:
    """The partial parents of one task. ``offer`` gives the parents that a node completes: (level, index, digests of the children, digest)."""

    def __init__(self, arity: int) -> None:
        self.arity = arity
        self.open: dict[tuple[bytes, int, int], tuple[int, dict[int, str]]] = {}
        self.sizes: dict[tuple[int, int], int] = {}

    def size(self, n: int, level: int) -> int:
        if (n, level) not in self.sizes:
            self.sizes[n, level] = n if level == 0 else -(-self.size(n, level - 1) // self.arity)
        return self.sizes[n, level]

    def offer(self, tree: bytes, n: int, level: int, index: int, digest: str) -> Iterator[tuple[int, int, list[str], str]]:
        while self.size(n, level) > 1:
            parent, nth = divmod(index, self.arity)
            key = (tree, level + 1, parent)
            held = self.open.setdefault(key, (n, {}))[1]
            held[nth] = digest
            if len(held) < min(self.arity, self.size(n, level) - parent * self.arity):
                return
            del self.open[key]
            children = [held[i] for i in range(len(held))]
            digest = hashlib.sha256("".join(children).encode()).hexdigest()
            level, index = level + 1, parent
            yield level, index, children, digest


def _resolve(nodes: DataFrame, arity: int) -> DataFrame:
    """Nodes (tree, level, index, digest, n) to the links of completed parents (kind 0), nodes that wait (1) and roots (2)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("tree", pa.binary()), ("level", pa.int32()), ("parent", pa.int64()), ("children", pa.list_(pa.string())), ("n", pa.int64()), ("kind", pa.int32())])
        frontier = Frontier(arity)
        for batch in batches:
            out: list[tuple] = []
            for tree, level, index, digest, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if n == 1:
                    out.append((tree, 0, 0, [digest], n, 2))
                for up, parent, children, made in frontier.offer(tree, n, level, index, digest):
                    out.append((tree, up - 1, parent, children, n, 0))
                    if frontier.size(n, up) == 1:
                        out.append((tree, up, 0, [made], n, 2))
            if out:
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
        left = [(tree, up - 1, parent * arity + nth, [digest], n, 1) for (tree, up, parent), (n, held) in frontier.open.items() for nth, digest in held.items()]
        for i in range(0, len(left), 10_000):
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*left[i : i + 10_000], strict=True), schema, strict=True)], schema=schema)

    return nodes.select("tree", "level", "index", "digest", "n").mapInArrow(run, _LINKS)


def place(leaves: DataFrame, order: list[Column]) -> DataFrame:
    """``leaves`` (tree, digest, ...) with ``pos``, their place in their tree by ``order``, and ``n``, the leaves of the tree.

    Range partitions of (tree, order) can split any tree; places are then sums over (partition, tree), one row each."""
    # equal rows are told apart by a number, so that a value which very many rows share can still be split
    kept = cut(leaves.withColumn("__tie", F.monotonically_increasing_id()), "leaves")
    by = [F.col("tree"), *order, F.col("digest"), F.col("__tie")]
    held = cut(kept.repartitionByRange(*by).sortWithinPartitions(*by).drop("__tie").withColumn("__at", F.monotonically_increasing_id()), "sorted-leaves", "zstd")
    held = held.withColumn("__part", F.shiftright("__at", 33))
    runs = held.groupBy("tree", "__part").agg(F.count("*").alias("__rows"), F.min("__at").alias("__first"))
    tree = Window.partitionBy("tree")
    before = F.coalesce(F.sum("__rows").over(tree.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    places = runs.select("tree", "__part", (before - F.col("__first")).alias("__shift"), F.sum("__rows").over(tree).alias("n"))
    return cut(held.join(places, ["tree", "__part"]).withColumn("pos", F.col("__at") + F.col("__shift")).drop("__part", "__shift", "__at"), "placed-leaves", "zstd")


def build(placed: DataFrame, arity: int = 2) -> tuple[DataFrame, DataFrame]:
    """Of ``place``'s leaves: the reverse links (tree, level, parent, children; level is the children's) and the roots (tree, root, height)."""
    most = height(placed.agg(F.max("n")).first()[0] or 0, arity)
    start = placed.select("tree", F.lit(0).alias("level"), F.col("pos").alias("index"), "digest", "n")
    made = [cut(_resolve(start.sortWithinPartitions("tree", "index"), arity), "nodes", "zstd")]
    span, top = _levels(SPAN, arity), 0
    while top < most:
        top += span
        waiting = made[-1].where("kind = 1").select("tree", "level", F.col("parent").alias("index"), F.col("children")[0].alias("digest"), "n")
        # the ancestor at level ``top``; a node that stands there already waits for a later round
        block = F.expr(f"CASE WHEN level >= {top} THEN index ELSE index div CAST(pow({arity}, {top} - level) AS bigint) END")
        dealt = waiting.withColumn("block", block).repartition("tree", "block").sortWithinPartitions("tree", "block", "level", "index")
        made.append(cut(_resolve(dealt, arity), "nodes", "zstd"))
    rows = made[0]
    for more in made[1:]:
        rows = rows.unionByName(more)
    links = rows.where("kind = 0").select("tree", "level", "parent", "children")
    return links, rows.where("kind = 2").select("tree", F.col("children")[0].alias("root"), F.col("level").alias("height"))


def _descend(tops: DataFrame, links: DataFrame, low: int, step: int, arity: int, leaves: DataFrame | None = None) -> DataFrame:
    """Paths of nodes at level ``low + step`` (``tops``) and the links below them, to paths of the nodes at level ``low``; with ``leaves``
    (tree, pos, ...) to their other columns with their paths. A tree that ends below ``low + step`` has node 0 there."""
    last = leaves is not None
    more = [c for c in leaves.columns if c not in ("tree", "pos")] if last else []
    own_kinds = {"before": "array<string>", "after": "array<string>", "subroot": "string", "root": "string"}
    plain = own_kinds | {c: t for c, t in leaves.dtypes if c in more} if last else own_kinds

    def rows_of(df: DataFrame, block: Column, kind: int, turn: Column, node: Column, **known: Column) -> DataFrame:
        return df.select("tree", block.alias("block"), F.lit(kind).alias("kind"), turn.alias("turn"), node.cast("long").alias("node"), *[known.get(c, F.lit(None)).cast(t).alias(c) for c, t in plain.items()])

    stream = rows_of(tops, F.col("node"), 0, F.lit(0), F.lit(0), **{c: F.col(c) for c in own_kinds})
    within = links.where((F.col("level") >= low) & (F.col("level") < low + step))
    stream = stream.unionByName(rows_of(within, F.expr(f"parent div CAST(pow({arity}, {low + step - 1} - level) AS bigint)"), 1, -F.col("level"), F.col("parent"), before=F.col("children")))
    if last:
        stream = stream.unionByName(rows_of(leaves, F.expr(f"pos div CAST(pow({arity}, {step}) AS bigint)"), 2, F.lit(0), F.col("pos"), **{c: F.col(c) for c in more}))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, level, paths, held, named = None, low, {}, {}, (None, None)
        for batch in batches:
            kinds = [batch.schema.field(c).type for c in ("tree", "node", *plain)]
            names = [*(more if last else ("tree", "node")), *own_kinds]
            types = [kinds[2 + list(plain).index(c)] if c in plain else kinds[("tree", "node").index(c)] for c in names]
            out: list[tuple] = []
            for tree, block, kind, turn, node, before, after, subroot, root, *rest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if kind == 0:
                    key, level, paths, named = (tree, block), low + step, {block: (before, after)}, (subroot, root)
                elif kind == 1:
                    if key != (tree, block):
                        raise RuntimeError(f"no path to block {block} of a tree")
                    if level != -turn:
                        level, held, paths = -turn, paths, {}
                    up = held[node]
                    for nth in range(len(before)):  # the digests of the children
                        paths[node * arity + nth] = path = (["".join(before[:nth]), *up[0]], ["".join(before[nth + 1 :]), *up[1]])
                        if level == low and not last:
                            out.append((tree, node * arity + nth, *path, *named))
                else:
                    out.append((*rest, *paths[node], *named))
            for i in range(0, len(out), 2000):
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out[i : i + 2000], strict=True), types, strict=True)], names=names)

    schema = ", ".join(f"{c} {t}" for c, t in ([(c, plain[c]) for c in more] if last else [("tree", "binary"), ("node", "long")]) + list(own_kinds.items()))
    dealt = stream.repartition("tree", "block").sortWithinPartitions("tree", "block", "kind", "turn", "node")
    return dealt.mapInArrow(run, schema)


def paths(leaves: DataFrame, links: DataFrame, tops: DataFrame, arity: int = 2) -> DataFrame:
    """The columns of ``leaves`` (tree, pos, ...) but these two, with ``before`` and ``after``: for each level up to the root of
    all the digests that stand left and right of the row's node in its run, and the roots ``subroot`` and ``root``.

    ``tops`` has a row for each tree: tree, height, the path above its root as before and after, subroot, root."""
    step = _levels(STEP, arity)
    most = tops.agg(F.max("height")).first()[0] or 0
    found = None
    for low in range(max(0, (most - 1) // step * step), -1, -step):
        entering = tops.where((F.col("height") <= low + step) & ((F.col("height") > low) if low else F.lit(True)))
        entering = entering.select("tree", F.lit(0).cast("long").alias("node"), "before", "after", "subroot", "root")
        now = entering if found is None else found.unionByName(entering)
        if not low:
            return _descend(now, links, 0, step, arity, leaves)
        found = cut(_descend(now, links, low, step, arity), "paths", "zstd")
    raise AssertionError


def manifest(docs: DataFrame, group: str, order: list[Column], leaf: Column, keep: dict[str, Column], arity: int = 2) -> DataFrame:
    """(the columns of ``keep``, leaf, subroot, root, before, after) of every row of ``docs``.

    A tree for each value of ``group`` (null is one of them) over its rows by ``order`` and then by ``leaf``; the trees' roots, null
    first and then by their bytes, are leaves of the last tree, whose root stands for all rows. A run of ``arity`` nodes, the last one shorter, becomes the
    hash of its digests; one that holds a single node becomes that one's hash. Rows that are equal have places next to each other."""
    made = {f"__{i}": c for i, c in enumerate(keep.values())}
    orders = {f"__o{i}": c for i, c in enumerate(order)}
    tree = F.when(F.col(group).isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col(group).cast("string"))).cast("binary")
    rows = docs.select(tree.alias("tree"), leaf.alias("digest"), *[c.alias(n) for n, c in {**made, **orders}.items()])
    placed = place(rows, [F.col(n).asc_nulls_first() for n in orders])
    links, roots = build(placed, arity)
    whole = place(roots.select(F.lit(b"").alias("tree"), F.col("root").alias("digest"), F.col("tree").alias("own"), F.col("height")), [F.col("own").asc()])
    whole_links, whole_root = build(whole, arity)
    none = F.array().cast("array<string>")
    whole_tops = whole_root.select("tree", "height", none.alias("before"), none.alias("after"), F.lit(None).cast("string").alias("subroot"), "root")
    tops = paths(whole.select("tree", "pos", "own", "digest", F.col("height").alias("own_height")), whole_links, whole_tops, arity)
    tops = cut(tops.select(F.col("own").alias("tree"), F.col("own_height").alias("height"), "before", "after", F.col("digest").alias("subroot"), "root"), "tops")
    found = paths(placed.select("tree", "pos", F.col("digest").alias("leaf"), *made), links, tops, arity)
    return found.select(*[F.col(n).alias(c) for n, c in zip(made, keep, strict=True)], "leaf", "subroot", "root", "before", "after")


def fold(leaf: Column, before: Column, after: Column) -> Column:
    """The root that a leaf and its proof give."""
    return F.aggregate(F.arrays_zip(before.alias("before"), after.alias("after")), leaf, lambda made, level: F.sha2(F.concat(level["before"], made, level["after"]).cast("binary"), 256))


def proof_digest(before: Column, after: Column) -> Column:
    """Hash of a proof: the siblings level by level, each level's from left to right."""
    return F.sha2(F.array_join(F.zip_with(before, after, lambda b, a: F.concat(b, a)), "").cast("binary"), 256)


def document_manifest(docs: DataFrame, arity: int = 2) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of every document, a tree for each ``lang``, leaves by ``doc_id``.

    A leaf is the digest of doc_id, source, lang, n_chars and text. Where 7 divides the CRC-32 of the decimal doc_id, the proof is tried with a row whose
    n_chars is one more, so ``verified`` is false there unless n_chars is null. A null doc_id comes first and is not tried so; repeated doc_ids stand
    by their leaves; a null lang is a tree of its own, before the others; null and empty texts are different leaves; texts of any length are hashed whole; an
    empty table gives no rows; other columns are left out, so their names can't clash."""
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    leaf = digest_of(fields)
    changed = digest_of([*fields[:3], F.col("n_chars") + 1, fields[4]])
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    shown = manifest(docs, "lang", [F.col("doc_id")], leaf, {"doc_id": F.col("doc_id"), "given": F.when(tampered, changed).otherwise(leaf)}, arity)
    folded = shown.withColumn("folded_root", fold(F.col("given"), F.col("before"), F.col("after")))
    return folded.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("before"), F.col("after")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
