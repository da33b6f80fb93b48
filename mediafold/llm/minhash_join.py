"""N-gram Jaccard self-join of texts by MinHash banding, verified on full n-gram sets.

Texts with the same words in the same order are copies and form one node; everything after that is between different
nodes.  A node's n-grams (five words; a shorter text is one n-gram) are MinHashed into bands whose number and width
follow from the wanted recall at the threshold.  Nodes that share a band are candidates.

Instead of writing out all pairs of a band (a group of thousands of near copies would square), each band links its
nodes to its smallest one.  The components of that graph hold all candidate pairs; the nodes of a component are brought
together once, with their texts, and every pair in it is verified on the full n-gram sets inside the task.  A component
larger than ``block_grams`` n-grams or ``BLOCK_NODES`` nodes is cut into blocks, and each pair of blocks is a group of its
own, so the matrix of common n-grams has at most 2 * ``BLOCK_NODES`` rows however short the texts.  A group returns one row a node: its number of links and the smallest node it hangs together with.  A second component search over these
verified links gives the classes.

Scale: shuffles are of ids and band hashes, plus the texts once for verification.  Copies are combined map-side before
any shuffle, so a text that a third of all rows share is one row a partition.

Edge cases: a text without words (NULL, empty, only marks) has no n-grams: it has no links and is a class of its own;
repeated rows are copies; a NULL ``doc_id`` takes part but never names a class (``class_id`` is the smallest non-NULL
id, NULL if there is none); an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mediafold.llm.common import (
    Words,
    connected_components,
    map_arrow,
    mix,
    powers,
    set_apart,
    sorted_groups,
    stored,
    text_chunks,
    utf8,
)

GRAM = 5
#: Nodes of a block: bounds the matrix of a pair of blocks (64 MB).
BLOCK_NODES = 2000
#: Rows of that matrix searched for links at a time.
STRIP = 512


def banding(threshold: float, recall: float, max_hashes: int = 224) -> tuple[int, int]:
    """(bands, rows): the widest bands that reach ``recall`` at ``threshold`` within ``max_hashes``."""
    best = None
    for rows in range(1, max_hashes + 1):
        p = threshold ** rows
        bands = math.ceil(math.log(1 - recall) / math.log1p(-p)) if p < 1 else 1
        if bands * rows > max_hashes:
            break
        best = bands, rows
    if best is None:
        raise ValueError("no banding reaches this recall within max_hashes")
    return best


def grams(w: Words, n: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hashes of word n-grams, bounds per text, two 64-bit keys of the word sequence per text)."""
    n_docs = len(w.bounds) - 1
    counts = w.counts
    first = w.bounds[:-1]
    keys = np.zeros((2, n_docs), np.uint64)
    full = np.flatnonzero(counts > 0)
    if not len(full):
        return np.zeros(0, np.uint64), np.zeros(n_docs + 1, np.int64), keys[0], keys[1]
    at = np.arange(len(w.hash)) - np.repeat(first, counts)
    p = powers(int(counts.max()))[0][at]
    other = mix(w.hash ^ np.uint64(0xA0761D6478BD642F))
    keys[0, full] = mix(np.add.reduceat(w.hash * p, first[full]))
    keys[1, full] = mix(np.add.reduceat(other * p, first[full]))
    q = powers(n)[0]
    h = np.zeros(len(w.hash), np.uint64)
    for j in range(min(n, len(h))):
        h[:len(h) - j] += other[j:] * q[j]
    h = mix(h)
    valid = np.repeat(counts, counts) - at >= n
    short = np.flatnonzero((counts > 0) & (counts < n))
    valid[first[short]] = True
    h[first[short]] = keys[0, short]
    bounds = np.zeros(n_docs + 1, np.int64)
    np.cumsum(np.where(counts >= n, counts - n + 1, counts > 0), out=bounds[1:])
    return h[valid], bounds, keys[0], keys[1]


def signatures(h: np.ndarray, bounds: np.ndarray, bands: int, rows: int, seed: int = 17) -> np.ndarray:
    """Band hashes (texts x bands) of texts that all have n-grams."""
    rng = np.random.default_rng(seed)
    flip = rng.integers(0, 1 << 32, bands * rows, dtype=np.uint32)
    factor = rng.integers(0, 1 << 31, bands * rows, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    weight = rng.integers(0, 1 << 62, rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    x = (h >> np.uint64(32)).astype(np.uint32)
    start = bounds[:-1]
    out = np.zeros((len(start), bands), np.uint64)
    for b in range(bands):
        for r in range(rows):
            i = b * rows + r
            low = np.minimum.reduceat((x ^ flip[i]) * factor[i], start)
            out[:, b] += (low.astype(np.uint64) + np.uint64(1)) * weight[r]
        out[:, b] = mix(out[:, b] ^ np.uint64((b + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
    return out


def links(h: np.ndarray, bounds: np.ndarray, threshold: float, side: np.ndarray | None = None) -> np.ndarray:
    """Pairs (i < j) of texts whose n-gram sets reach the threshold; with ``side``, only pairs between the two sides."""
    m = len(bounds) - 1
    doc = np.repeat(np.arange(m), np.diff(bounds))
    order = np.lexsort((doc, h))
    h, doc = h[order], doc[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    h, doc = h[keep], doc[keep]
    size = np.bincount(doc, minlength=m)
    new = np.ones(len(h), bool)
    new[1:] = h[1:] != h[:-1]
    start = np.flatnonzero(new)
    freq = np.diff(np.append(start, len(h)))
    common = np.zeros((m, m), np.float32)
    # Rare n-grams: count their few pairs; common ones: product of incidence columns.
    limit = max(8, m // 32)
    flat = common.reshape(-1)
    for f in np.unique(freq[(freq > 1) & (freq <= limit)]):
        cols = start[freq == f]
        a, b = np.triu_indices(f, 1)
        for lo in range(0, len(cols), max(1, (1 << 21) // len(a))):
            d = doc[cols[lo:lo + max(1, (1 << 21) // len(a)), None] + np.arange(f)]
            np.add.at(flat, d[:, a].ravel() * m + d[:, b].ravel(), np.float32(1))
    wide = np.flatnonzero(freq > limit)
    for lo in range(0, len(wide), 2048):
        cols = wide[lo:lo + 2048]
        n = freq[cols]
        col = np.repeat(np.arange(len(cols)), n)
        at = np.repeat(start[cols] - np.cumsum(n) + n, n) + np.arange(n.sum())
        inc = np.zeros((m, len(cols)), np.float32)
        inc[doc[at], col] = 1
        common += inc @ inc.T
    found = [np.zeros((0, 2), np.int32)]
    for lo in range(0, m, STRIP):
        i, j = np.nonzero(np.triu(common[lo:lo + STRIP], lo + 1))
        both = common[lo + i, j].astype(np.int64)
        i += lo
        ok = both >= threshold * (size[i] + size[j] - both) - 1e-9
        if side is not None:
            ok &= side[i] != side[j]
        found.append(np.column_stack([i[ok], j[ok]]).astype(np.int32))
    return np.concatenate(found)


def smallest_linked(pairs: np.ndarray, m: int) -> np.ndarray:
    """Smallest index each index hangs together with."""
    root = np.arange(m)
    while len(pairs):
        low = np.minimum(root[pairs[:, 0]], root[pairs[:, 1]])
        before = root.copy()
        np.minimum.at(root, root[pairs[:, 0]], low)
        np.minimum.at(root, root[pairs[:, 1]], low)
        np.minimum.at(root, pairs[:, 0], low)
        np.minimum.at(root, pairs[:, 1], low)
        root = root[root]
        if (root == before).all():
            break
    return root


def _node(k1: str = "k1", k2: str = "k2"):
    return F.concat(F.lpad(F.hex(k1), 16, "0"), F.lpad(F.hex(k2), 16, "0"))


def sketch(docs: DataFrame, bands: int, rows: int) -> DataFrame:
    """``doc_id, text_hash, k1, k2, n_grams, bands`` of every document (bands empty without words)."""
    def run(batches):
        for part, data, offsets in text_chunks(batches, "text"):
            h, bounds, k1, k2 = grams(Words(data, offsets))
            n = np.diff(bounds)
            full = np.flatnonzero(n > 0)
            found = np.zeros((0, bands), np.uint64)
            if len(full):
                found = signatures(h, np.append(bounds[:-1][full], len(h)), bands, rows)
            cut = np.zeros(len(n) + 1, np.int32)
            np.cumsum((n > 0) * bands, out=cut[1:])
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(k1.view(np.int64)), pa.array(k2.view(np.int64)), pa.array(n),
                 pa.ListArray.from_arrays(pa.array(cut), pa.array(found.ravel().view(np.int64)))],
                ["doc_id", "text_hash", "k1", "k2", "n_grams", "bands"])

    return map_arrow(
        docs, run, "doc_id long, text_hash long, k1 long, k2 long, n_grams long, bands array<long>")


def verify(members: DataFrame, threshold: float) -> DataFrame:
    """``node, n, other`` from rows ``root, i, j, block, node, text`` of candidate components.

    One row a node, block pair and task: its links in that pair of blocks and the smallest node they join it to.
    """
    def run(batches):
        held: list[pa.Table] = []
        size = 0

        def flush():
            table = pa.concat_tables(held).combine_chunks()
            lengths = [t.num_rows for t in held]
            w = Words(*utf8(table.column("text")))
            h, bounds, _, _ = grams(w)
            names = table.column("node").to_pylist()
            block = table.column("block").to_numpy()
            out = {"node": [], "n": [], "other": []}
            lo = 0
            for m in lengths:
                hi = lo + m
                side = block[lo:hi] if block[lo] != block[hi - 1] else None
                pairs = links(h[bounds[lo]:bounds[hi]], bounds[lo:hi + 1] - bounds[lo], threshold, side)
                if len(pairs):
                    count = np.bincount(pairs.ravel(), minlength=m)
                    low = smallest_linked(pairs, m)
                    own = names[lo:hi]
                    # Rows are sorted by block, then node: take the smallest name, not the smallest place.
                    best: dict[int, str] = {}
                    for k in range(m):
                        best[low[k]] = min(best.get(low[k], own[k]), own[k])
                    for k in np.flatnonzero(count):
                        out["node"].append(own[k])
                        out["n"].append(int(count[k]))
                        out["other"].append(best[low[k]])
                lo = hi
            return pa.RecordBatch.from_pydict(out, schema=pa.schema(
                [("node", pa.string()), ("n", pa.int64()), ("other", pa.string())]))

        for group in sorted_groups(batches, ["root", "i", "j"]):
            node = group.column("node").to_pylist()
            first = [k for k in range(len(node)) if k == 0 or node[k] != node[k - 1]]  # repeated rows of one id
            if len(first) > 1:
                held.append(group.take(first) if len(first) < len(node) else group)
                size += group.nbytes
            if held and size > 1 << 20:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()

    dealt = members.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j", "block", "node")
    return map_arrow(dealt, run, "node string, n long, other string")


def jaccard_classes(docs: DataFrame, threshold: float = 0.8, recall: float = 0.999,
                    block_grams: int = 400_000) -> DataFrame:
    """One row per document: ``doc_id, text_hash, class_key, class_id, copy_id, n_copies, n_links``.

    ``copy_id`` is the smallest id among the document's copies, ``n_links`` the number of other texts (not counting copies)
    within the threshold, and ``class_id`` the smallest id among all documents joined by such links.
    """
    bands, rows = banding(threshold, recall)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"),
                        F.col("text").cast("string").alias("text"))
    sig = stored(sketch(texts, bands, rows), "sketch")
    worded = sig.where("n_grams > 0")
    nodes = stored(worded.groupBy("k1", "k2").agg(
        F.min(F.struct("doc_id", "text_hash")).alias("rep"), F.min("doc_id").alias("copy_id"),
        F.count("*").alias("n_copies"), F.first("n_grams").alias("n_grams"), F.first("bands").alias("bands")), "nodes")
    # Star edges: each node of a band to the band's smallest node.
    low = F.min(F.struct("k1", "k2")).over(Window.partitionBy("band"))
    edges = (nodes.select(F.explode("bands").alias("band"), "k1", "k2").withColumn("low", low)
             .where("k1 <> low.k1 or k2 <> low.k2")
             .select(_node().alias("u"), _node("low.k1", "low.k2").alias("v")))
    candidate = connected_components(edges)
    place = Window.partitionBy("root").orderBy("n_grams", "node")
    # A node counts for at least its part of a block, so n-grams and nodes are both bounded.
    cost = F.greatest("n_grams", F.lit(-(-block_grams // BLOCK_NODES)).cast("long"))
    running = F.sum(cost).over(place.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - cost
    members = (nodes.select(_node().alias("node"), "rep", "n_grams").join(candidate, "node")
               .withColumn("block", F.floor(running / block_grams))
               .withColumn("last", F.max("block").over(Window.partitionBy("root"))))
    members = members.select("root", "node", F.col("rep.doc_id").alias("_doc"), F.col("rep.text_hash").alias("_hash"),
                             "block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("last"))).alias("with"))
    members = members.select("root", "node", "_doc", "_hash", "block", F.least("block", "with").alias("i"),
                             F.greatest("block", "with").alias("j"))
    with_text = members.join(texts, F.col("_doc").eqNullSafe(F.col("doc_id")) & (F.col("_hash") == F.col("text_hash")))
    checked = stored(verify(with_text.select("root", "i", "j", "block", "node", "text"), threshold), "links")
    n_links = checked.groupBy("node").agg(F.sum("n").alias("n_links"))
    final = connected_components(checked.select(F.col("node").alias("u"), F.col("other").alias("v")))
    linked = final.join(n_links, "node", "left")
    keyed = nodes.select("k1", "k2", _node().alias("node"), "copy_id", "n_copies")
    by_root = linked.join(keyed, "node").groupBy("root").agg(F.min("copy_id").alias("root_id"))
    linked = linked.join(by_root, "root").select("node", "root", "root_id", "n_links")
    table = keyed.join(linked, "node", "left").select(
        F.col("k1").alias("_k1"), F.col("k2").alias("_k2"), F.coalesce("root", "node").alias("class_key"),
        F.coalesce("root_id", "copy_id").alias("class_id"), "copy_id", "n_copies",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    out = worded.select("doc_id", "text_hash", "k1", "k2").join(
        table, (F.col("k1") == F.col("_k1")) & (F.col("k2") == F.col("_k2"))).select(
        "doc_id", "text_hash", "class_key", "class_id", "copy_id", "n_copies", "n_links")
    alone = sig.where("n_grams = 0").select(
        "doc_id", "text_hash", F.lit(None).cast("string").alias("class_key"), F.col("doc_id").alias("class_id"),
        F.col("doc_id").alias("copy_id"), F.lit(1).cast("long").alias("n_copies"), F.lit(0).cast("long").alias("n_links"))
    return out.unionByName(alone)


def keep_one(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay: of each class the smallest id, and every text without words."""
    first = classes.where("class_key is not null").groupBy("class_key").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "text_hash")).alias("s"))
    stay = first.select(F.col("s.doc_id").alias("_doc"), F.col("s.text_hash").alias("_hash")).unionByName(
        classes.where("class_key is null").select(F.col("doc_id").alias("_doc"), F.col("text_hash").alias("_hash")))
    inside, restored = set_apart(docs)
    keyed = inside.withColumn("_id", F.col("doc_id").cast("long")).withColumn("_of", F.xxhash64("text"))
    kept = keyed.join(stay.distinct(), F.col("_id").eqNullSafe(F.col("_doc")) & (F.col("_of") == F.col("_hash")))
    # Repeated rows share id and text: one of them stays.
    return restored(kept.dropDuplicates(["_id", "_of"]))
