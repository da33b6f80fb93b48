"""K-d tree sharding: equal bytes per shard by recursive weighted median cuts.

The space is metadata that follows from a document's text alone (size, bytes per character, word length, number of
lines), each scaled to 16 bits over the whole table, with a 32-bit hash of the text as the last resort between equal
points.  Every node of the tree is cut along its widest dimension at the weighted quantile that gives each side the
bytes of its shards, until every leaf is one shard.

Scale: the points are one narrow table in shared storage.  Each tree level costs three aggregations over it (extents,
then the cut in two radix steps of 16 bits); the driver sees one row per open node.  The finished tree is a nested
comparison, so rows reach their shard without a join.  Equal texts share a point and therefore a shard; a group of
copies of more than ``split_share`` of a shard is dealt by ``doc_id`` as well, since it could not fit evenly.  There
are at most ``n_shards / split_share`` such groups, which bounds the only broadcast.

Edge cases: NULL text has no bytes (size 16, crc 0); a NULL ``doc_id`` is kept and numbered like any other; repeated
rows each get their own slot; an empty table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mediafold.llm.common import bucketed_prefix, stored
from mediafold.llm.mixing import first_places

ROW_BYTES = 16
SCALE = (1 << 16) - 1
TIE_BITS = 32
DIMENSIONS = 4


@dataclass
class Node:
    """A leaf while ``cut`` is None; else rows with ``key(dim) < cut`` go left."""

    first: int
    shards: int
    dim: int = 0
    cut: int | None = None
    left: Node | None = None
    right: Node | None = None


def _key(dim: int) -> Column:
    """Position of a row along a dimension: its 16-bit code, then the tie hash."""
    return F.shiftleft(F.col(f"d{dim}"), TIE_BITS) + F.col("tie")


def _walk(node: Node, leaf) -> Column:
    """Nested comparison that ends in ``leaf(node)``."""
    if node.cut is None:
        return F.lit(leaf(node))
    return F.when(_key(node.dim) < F.lit(node.cut), _walk(node.left, leaf)).otherwise(_walk(node.right, leaf))


def _by_node(values: dict[int, int], n: int) -> Column:
    """The value of a row's node, looked up in a literal array (-1 where a node has none)."""
    return F.element_at(F.array(*[F.lit(values.get(i, -1)).cast("long") for i in range(n)]), F.col("node") + 1)


def points(docs: DataFrame, n_shards: int, split_share: float, hashed: bool = False) -> DataFrame:
    """One narrow row per document: id, size, crc, four 16-bit codes and the tie hash (with ``hashed`` the text's, too)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    n_bytes = F.octet_length(text).cast("long")
    chars = F.length(text)
    spaces = chars - F.length(F.translate(text, " ", ""))
    lines = chars - F.length(F.translate(text, "\n", ""))
    raw = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (n_bytes + ROW_BYTES).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("text_hash"),
        F.log2(n_bytes + 1.0).alias("x0"), (n_bytes / F.greatest(chars, F.lit(1))).cast("double").alias("x1"),
        F.log2(n_bytes / (spaces + 1.0) + 1.0).alias("x2"), F.log2(lines + 1.0).alias("x3"))
    raw = stored(raw, "points")
    edge = raw.agg(*[f(f"x{i}").alias(f"{n}{i}") for i in range(DIMENSIONS) for n, f in (("lo", F.min), ("hi", F.max))],
                   F.sum("size").alias("total")).first()
    total = edge["total"] or 0
    # At most n_shards / split_share rows.
    large = (raw.groupBy("text_hash").agg(F.sum("size").alias("b"))
             .where(F.col("b") > F.lit(split_share * total / n_shards)).select(F.col("text_hash").alias("large_hash")))
    rows = raw.join(F.broadcast(large), F.col("text_hash") == F.col("large_hash"), "left")
    tie = F.when(F.col("large_hash").isNull(), F.xxhash64("text_hash")).otherwise(F.xxhash64("text_hash", "doc_id"))

    def code(i):
        lo, hi = edge[f"lo{i}"], edge[f"hi{i}"]
        if lo is None or hi <= lo:
            return F.lit(0).cast("long")
        return F.floor((F.col(f"x{i}") - F.lit(lo)) * F.lit(SCALE / (hi - lo))).cast("long")

    return stored(rows.select("doc_id", "size", "text_crc32", *[code(i).alias(f"d{i}") for i in range(DIMENSIONS)],
                              F.shiftrightunsigned(tie, 64 - TIE_BITS).alias("tie"), *["text_hash"] * hashed), "points")


def _cuts(rows: DataFrame, open_nodes: list[Node]) -> None:
    """Cut every open node in place; ``rows`` has ``node`` = its index in the list."""
    extent = rows.groupBy("node").agg(
        F.sum("size").alias("total"),
        *[(F.max(f"d{i}") - F.min(f"d{i}")).alias(f"w{i}") for i in range(DIMENSIONS)]).collect()
    target = {}
    for r in extent:
        x = open_nodes[r["node"]]
        x.dim = max(range(DIMENSIONS), key=lambda i, r=r: (r[f"w{i}"], -i))
        target[r["node"]] = r["total"] * (x.shards // 2) // x.shards
    n = len(open_nodes)
    code = F.element_at(F.array(*[f"d{i}" for i in range(DIMENSIONS)]),
                        F.element_at(F.array(*[F.lit(x.dim + 1) for x in open_nodes]), F.col("node") + 1))
    rows = rows.select("node", "size", (F.shiftleft(code, TIE_BITS) + F.col("tie")).alias("key"))
    goal = _by_node(target, n)
    base = dict.fromkeys(target, 0)
    prefix = dict.fromkeys(target, 0)
    for shift in (TIE_BITS, TIE_BITS - 16):
        # Cells of 16 bits inside the cell found so far; the running sum has at most 2**16 rows a node.
        cells = (rows.where(F.shiftright("key", shift + 16) == _by_node(prefix, n)) if shift < TIE_BITS else rows)
        cells = cells.groupBy("node", F.shiftright("key", shift).alias("cell")).agg(F.sum("size").alias("b"))
        run = F.sum("b").over(Window.partitionBy("node").orderBy("cell")) + _by_node(base, n)
        hit = (cells.withColumn("upto", run)
               .where((F.col("upto") > goal) & (F.col("upto") - F.col("b") <= goal))
               .collect())
        for r in hit:
            i, below = r["node"], r["upto"] - r["b"]
            prefix[i], base[i] = r["cell"], below
            nearer_end = r["upto"] - target[i] < target[i] - below
            open_nodes[i].cut = (r["cell"] + int(nearer_end)) << shift


def kd_shards(docs: DataFrame, n_shards: int = 40, split_share: float = 0.04,
              placed: DataFrame | None = None) -> DataFrame:
    """Deal documents to ``n_shards`` shards of near equal bytes (law ``bytes``).

    Returns ``doc_id, size, text_crc32, law, shard, slot, grown_shard``; slots are gapless from 0 inside a shard.  They
    follow a hash of the row, or with ``placed`` (``doc_id, text_hash, position`` of every document, as from
    ``mixing.pfair_mix``) that order, in which equal rows take the place of the first.
    """
    pts = points(docs, n_shards, split_share, placed is not None)
    root = Node(0, n_shards)
    level = [root]
    for _ in range(math.ceil(math.log2(n_shards)) if n_shards > 1 else 0):
        open_nodes = [n for n in level if n.shards > 1]
        where = {id(n): i for i, n in enumerate(open_nodes)}
        rows = pts.withColumn("node", _walk(root, lambda n, w=where: w.get(id(n), -1))).where("node >= 0")
        _cuts(rows, open_nodes)
        level = []
        for n in open_nodes:
            if n.cut is None:  # no rows here: any cut will do
                n.cut = 0
            half = n.shards // 2
            n.left, n.right = Node(n.first, half), Node(n.first + half, n.shards - half)
            level += [n.left, n.right]
    shard = _walk(root, lambda n: n.first).cast("int").alias("shard")
    rows = pts.count()
    buckets = max(64, rows // (n_shards * 100_000))
    order = ["doc_id", "text_crc32", "size"]
    if placed is None:
        dealt = bucketed_prefix(pts.select(*order, shard), ["shard"], order, F.lit(1), "slot", buckets)
    else:
        at = first_places(placed)
        dealt = pts.select(*order, "text_hash", shard).join(
            at, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("text_hash") == F.col("_hash")))
        # Positions are gapless, so equal stretches of them are equal buckets.
        dealt = bucketed_prefix(dealt, ["shard"], ["_position", *order], F.lit(1), "slot",
                                spread=F.floor(F.col("_position") / F.lit(max(1, -(-rows // buckets)))))
    return dealt.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                        F.lit(None).cast("int").alias("grown_shard"))
