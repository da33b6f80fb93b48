"""Exact ranked lexical search with ball trees over sparse document vectors.

A document's component of a term is ``x = 10**9 tf div (1000 tf + 20 m)``, where ``m`` grows with its length; a query's is the
term's weight ``w``; the score is their inner product.  Documents are read in shards of bounded size; each shard gets a
ball tree over its vectors: a node has the centroid of its documents and the radius around it, children come from two
far-apart pivots.  A query walks the tree best first through a priority queue by the bound

    q . x  <=  q . centroid + |q| * radius        (rounded up by more than the arithmetic can lose)

and stops when the bound of the best open node is below its k-th score; equal bounds are still opened, since ids break ties.  At a
leaf all documents are scored in 64-bit integers.  Vectors are stretched by a power of the weights (``STRETCH``), which
leaves products as they are and tightens the balls.  Nothing is cut off that could belong to the result.

On Spark: queries come in blocks (at most ``block_terms`` terms or ``block_items`` items, so a block, and the driver,
stay bounded).  For a block one map over the texts keeps of each document its length and its counts of the block's
terms, and per task one row of partial statistics; their sums give N, L and df of all documents.  Weights are broadcast
and a second map searches.  Thresholds to begin with come from a sample of ``SAMPLE_DOCS`` documents: its k-th score can
only be too low, so it saves work and changes no result.  Each task returns at most k rows a query; ranks are a window with a
group limit over these.

Edge cases: NULL and empty texts have no term and do not count for N; every row is a document and every row of the
items is a query of its own, repeats included; among equal scores a NULL ``doc_id`` comes last; an item without a term found
gives no row; empty tables give no row; other columns are ignored.  Terms of up to 15 bytes are looked up by their bytes,
longer ones in a dictionary, so no hash decides.
"""

from __future__ import annotations

import heapq
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mediafold.llm.common import LOWER, WORD_BYTE, map_arrow, scratch_path, stored, text_chunks
from mediafold.llm.keys import SHORT, KeyTable, packed, packed_strings

BLOCK_TERMS, BLOCK_ITEMS = 16_384, 2_000
LEAF_DOCS = 64
SHARD_DOCS, SHARD_CELLS = 4_096, 1 << 24
SAMPLE_DOCS, SAMPLE_SHARE = 500_000, 16
STRETCH = 0.5
_TERM = re.compile(rb"[0-9A-Za-z\x80-\xff]+")

COUNTS_SCHEMA = ("doc_id long, n long, terms array<int>, tfs array<int>, n_docs long, n_words long, df array<long>")
FOUND_SCHEMA = "item int, doc_id long, score long"


# ----------------------------------------------------------------- queries
def terms_of(text: str | None) -> set[bytes]:
    """Different terms of a text, A-Z lower-cased."""
    return {t.lower() for t in _TERM.findall((text or "").encode())}


@dataclass
class Block:
    """Queries that are searched together."""

    item_ids: list
    terms: dict[bytes, int]
    queries: list[np.ndarray]


def query_blocks(items: DataFrame, block_terms: int, block_items: int) -> Iterator[Block]:
    """Blocks of the items, read one partition at a time."""
    block = Block([], {}, [])
    for item_id, text in items.select("item_id", "text").toLocalIterator():
        found = sorted(terms_of(text))
        if not found:
            continue
        if block.queries and (len(block.queries) >= block_items or len(block.terms) + len(found) > block_terms):
            yield block
            block = Block([], {}, [])
        block.item_ids.append(item_id)
        block.queries.append(np.array([block.terms.setdefault(t, len(block.terms)) for t in found], np.int64))
    if block.queries:
        yield block


# ------------------------------------------------------------------ counts
class Vocabulary:
    """Numbers of the terms of a block, looked up for all words of a chunk at once."""

    def __init__(self, terms: dict[bytes, int]):
        short = [t for t in terms if len(t) <= SHORT]
        self.size = len(terms)
        self.short = KeyTable(*packed_strings(short), np.array([terms[t] for t in short], np.int32)) if short else None
        self.long = {t: i for t, i in terms.items() if len(t) > SHORT}

    def find(self, data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        out = np.full(len(start), -1, np.int64)
        if self.short is not None:
            at = np.flatnonzero(length <= SHORT)
            out[at] = self.short.find(*packed(data, start[at], length[at]))
        if self.long:
            at = np.flatnonzero(length > SHORT)
            raw = data.tobytes()
            out[at] = [self.long.get(raw[s:s + n], -1) for s, n in zip(start[at].tolist(), length[at].tolist(), strict=True)]
        return out


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, length) of the words of the texts ``data[offsets[i]:offsets[i + 1]]``."""
    inside = np.zeros(len(data) + 1, bool)
    inside[:-1] = WORD_BYTE[data]
    first, last = inside[:-1].copy(), inside[:-1] & ~inside[1:]
    first[1:] &= ~inside[:-2]
    cut = offsets[1:-1]
    cut = cut[(cut > 0) & (cut < len(data))]
    first[cut] |= inside[cut]
    last[cut - 1] |= inside[cut - 1]
    start = np.flatnonzero(first)
    return start, np.flatnonzero(last) + 1 - start


def counted(batches, vocabulary: Vocabulary):
    """Rows of term counts of the documents that hold a term, then one row of the task's statistics."""
    df, n_docs, n_words = np.zeros(vocabulary.size, np.int64), 0, 0
    for rows, data, offsets in text_chunks(batches, "text"):
        data = LOWER[data]
        start, length = word_spans(data, offsets)
        words = np.diff(np.searchsorted(start, offsets))
        n_docs, n_words = n_docs + int((words > 0).sum()), n_words + len(start)
        term = vocabulary.find(data, start, length)
        hit = term >= 0
        doc = np.repeat(np.arange(len(words)), words)[hit]
        cell, tf = np.unique(doc * vocabulary.size + term[hit], return_counts=True)
        doc, term = np.divmod(cell, vocabulary.size)
        df += np.bincount(term, minlength=vocabulary.size)
        held = np.bincount(doc, minlength=len(words))
        some = np.flatnonzero(held)
        at = np.append(0, np.cumsum(held[some])).astype(np.int32)
        none = pa.nulls(len(some), pa.int64())
        yield pa.RecordBatch.from_arrays([
            rows.column(0).cast(pa.int64()).take(pa.array(some)), pa.array(words[some], pa.int64()),
            pa.ListArray.from_arrays(pa.array(at), pa.array(term, pa.int32())),
            pa.ListArray.from_arrays(pa.array(at), pa.array(tf, pa.int32())),
            none, none, pa.nulls(len(some), pa.list_(pa.int64()))], _COUNTS)
    yield pa.RecordBatch.from_pylist([{"n_docs": n_docs, "n_words": n_words, "df": df}],
                                     schema=pa.schema(list(zip(_COUNTS, _COUNTS_TYPES, strict=True))))


_COUNTS = [f.split()[0] for f in COUNTS_SCHEMA.split(", ")]
_COUNTS_TYPES = [pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.int64(), pa.int64(), pa.list_(pa.int64())]


def weights(df: list[int], n_docs: int) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df], np.int64)


def components(tf: np.ndarray, n: np.ndarray, n_docs: int, n_words: int) -> np.ndarray:
    """Integer components of documents of ``n`` words for terms that occur ``tf`` times."""
    if len(n) and int(n.max()) > ((1 << 63) - 1) // (50 * n_docs):
        grown = np.array([50 * int(x) * n_docs // n_words for x in n], np.int64)
    else:
        grown = 50 * n * n_docs // n_words
    return 1_000_000_000 * tf // (1000 * tf + 20 * (50 + grown))


# -------------------------------------------------------------- ball trees
class BallTree:
    """Ball tree over the sparse vectors of a shard, with dense integer components at its leaves."""

    def __init__(self, ptr: np.ndarray, term: np.ndarray, x: np.ndarray, stretch: np.ndarray):
        self.ptr, self.term, self.y = ptr, term, x * stretch[term]
        self.width = len(stretch)
        # More than what sums of so many products can lose.
        self.slack = 1e-15 * (self.width + 1000)
        self.square = np.add.reduceat(self.y * self.y, ptr[:-1])
        self.order = np.zeros(len(ptr) - 1, np.int64)
        self.lo, self.hi, self.left, self.right, self.centroid, self.radius = [], [], [], [], [], []
        self._grow(np.arange(len(ptr) - 1))
        self.centroids, self.radii = np.array(self.centroid), np.array(self.radius)
        place = np.empty(len(self.order), np.int64)
        place[self.order] = np.arange(len(self.order))
        self.dense = np.zeros((self.width, len(self.order)), np.int32)  # a component is 1,000,000 at most
        self.dense[term, np.repeat(place, np.diff(ptr))] = x

    def _rows(self, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the components of ``docs`` and where each one's begin."""
        size = self.ptr[docs + 1] - self.ptr[docs]
        begin = np.cumsum(size) - size
        return np.repeat(self.ptr[docs] - begin, size) + np.arange(int(size.sum())), begin

    def _vector(self, doc: int) -> np.ndarray:
        v = np.zeros(self.width)
        v[self.term[self.ptr[doc]:self.ptr[doc + 1]]] = self.y[self.ptr[doc]:self.ptr[doc + 1]]
        return v

    def _grow(self, docs: np.ndarray) -> None:
        todo, filled = [(docs, -1, False)], 0
        while todo:
            docs, parent, is_right = todo.pop()
            node = len(self.lo)
            if parent >= 0:
                (self.right if is_right else self.left)[parent] = node
            at, begin = self._rows(docs)
            term, y, square = self.term[at], self.y[at], self.square[docs]
            c = np.bincount(term, y, self.width) / len(docs)
            apart = square - 2 * np.add.reduceat(y * c[term], begin) + c @ c
            self.lo.append(filled)
            self.hi.append(filled + len(docs))
            self.left.append(-1)
            self.right.append(-1)
            self.centroid.append(c)
            self.radius.append(math.sqrt(max(float(apart.max()), 0.0) + self.slack * float(square.max() + c @ c)))
            if len(docs) <= LEAF_DOCS:
                self.order[filled:filled + len(docs)] = docs
                filled += len(docs)
                continue
            a = self._vector(docs[int(apart.argmax())])
            b = self._vector(docs[int((square - 2 * np.add.reduceat(y * a[term], begin)).argmax())])
            along = np.add.reduceat(y * (a - b)[term], begin)
            near = along > (a @ a - b @ b) / 2
            if min(near.sum(), (~near).sum()) < len(docs) // 8:  # pivots that part few: halves along their line
                near = np.zeros(len(docs), bool)
                near[np.argpartition(along, len(docs) // 2)[len(docs) // 2:]] = True
            todo += [(docs[~near], node, True), (docs[near], node, False)]

    def bounds(self, terms: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Upper bounds of the inner product with a (stretched) query in every node."""
        return (self.centroids[:, terms] @ q + math.sqrt(q @ q) * self.radii) * (1 + self.slack) + 1

    def scores(self, node: int, terms: np.ndarray, w: np.ndarray) -> np.ndarray:
        return w @ self.dense[terms, self.lo[node]:self.hi[node]].astype(np.int64)


class Best:
    """The k best (score, id) of a query so far; a NULL id is ``None`` and comes last among equals."""

    def __init__(self, k: int, floor: int):
        self.k, self.floor = k, max(floor, 1)
        self.score, self.doc, self.null = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    def add(self, score: np.ndarray, doc: np.ndarray, null: np.ndarray) -> None:
        keep = score >= self.floor
        if not keep.any():
            return
        self.score, self.doc, self.null = (np.append(old, new[keep]) for old, new in (
            (self.score, score), (self.doc, doc), (self.null, null)))
        order = np.lexsort((self.doc, self.null, -self.score))[:self.k]
        self.score, self.doc, self.null = self.score[order], self.doc[order], self.null[order]
        if len(order) == self.k:
            self.floor = max(self.floor, int(self.score[-1]))


def walk(tree: BallTree, best: Best, terms, w, q, doc, null) -> int:
    """Best-first search of a tree for one query; returns the number of leaves that it opened."""
    bound = tree.bounds(terms, q)
    queue, opened = [(-bound[0], 0)], 0
    while queue and -queue[0][0] >= best.floor:
        _, node = heapq.heappop(queue)
        if tree.left[node] < 0:
            opened += 1
            lo, hi = tree.lo[node], tree.hi[node]
            at = tree.order[lo:hi]
            best.add(tree.scores(node, terms, w), doc[at], null[at])
            continue
        for child in (tree.left[node], tree.right[node]):
            if bound[child] >= best.floor:
                heapq.heappush(queue, (-bound[child], child))
    return opened


@dataclass
class Plan:
    """What a search task needs: queries with their weights, statistics, and scores known to be reached."""

    queries: list[np.ndarray]
    w: np.ndarray
    n_docs: int
    n_words: int
    k: int
    floors: list[int]


def _shards(batches, limit: int):
    """Term counts of at most ``limit`` documents at a time."""
    held, rows = [], 0
    for batch in batches:
        while batch.num_rows:
            part = batch.slice(0, limit - rows)
            held.append(part)
            rows += part.num_rows
            batch = batch.slice(part.num_rows)
            if rows == limit:
                yield pa.Table.from_batches(held).combine_chunks()
                held, rows = [], 0
    if rows:
        yield pa.Table.from_batches(held).combine_chunks()


def searched(batches, plan: Plan):
    """The best documents of a task for every query."""
    width = len(plan.w)
    limit = max(LEAF_DOCS, min(SHARD_DOCS, SHARD_CELLS // max(width, 1)))
    weight = plan.w.astype(np.float64)
    stretch = np.maximum(weight, 1.0) ** STRETCH
    queries = [(t, plan.w[t], weight[t] / stretch[t]) for t in plan.queries]
    best = [Best(plan.k, f) for f in plan.floors]
    for shard in _shards(batches, limit):
        ids = shard.column("doc_id").combine_chunks()
        terms, tfs = (shard.column(c).combine_chunks() for c in ("terms", "tfs"))
        ptr = terms.offsets.to_numpy().astype(np.int64)
        ptr = ptr - ptr[0]
        term = terms.flatten().to_numpy().astype(np.int64)
        n = np.repeat(shard.column("n").to_numpy(), np.diff(ptr))
        x = components(tfs.flatten().to_numpy().astype(np.int64), n, plan.n_docs, plan.n_words)
        tree = BallTree(ptr, term, x, stretch)
        doc, null = ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False)
        for b, (t, w, q) in zip(best, queries, strict=True):
            walk(tree, b, t, w, q, doc, null)
    for i, b in enumerate(best):
        if len(b.score):
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(b.score), i), pa.int32()), pa.array(b.doc, pa.int64(), mask=b.null),
                 pa.array(b.score, pa.int64())], ["item", "doc_id", "score"])


# ------------------------------------------------------------------- Spark
def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _search(counts: DataFrame, plan: Plan) -> DataFrame:
    shared = counts.sparkSession.sparkContext.broadcast(plan)
    return _ranked(map_arrow(counts, lambda batches: searched(batches, shared.value), FOUND_SCHEMA), plan.k)


def search_block(docs: DataFrame, block: Block, k: int) -> DataFrame:
    """``item, rank, doc_id, score`` of the k best documents of every query of a block (``item`` is its place there)."""
    spark = docs.sparkSession
    vocabulary = spark.sparkContext.broadcast(Vocabulary(block.terms))
    table = stored(map_arrow(docs.select("doc_id", "text"), lambda batches: counted(batches, vocabulary.value), COUNTS_SCHEMA),
                   "term-counts")
    statistics = table.where("n_docs is not null")
    n_docs, n_words = statistics.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_words"), F.lit(0))).first()
    df = dict(statistics.select(F.posexplode("df")).groupBy("pos").agg(F.sum("col")).collect())
    plan = Plan(block.queries, weights([df.get(i, 0) for i in range(len(block.terms))], n_docs), n_docs, n_words, k,
                [1] * len(block.queries))
    counts = table.where("n is not null").select("doc_id", "n", "terms", "tfs")
    share = max(SAMPLE_SHARE, n_docs // SAMPLE_DOCS)
    sample = _search(counts.where(F.pmod(F.xxhash64("doc_id"), F.lit(share)) == 0), plan)
    for item, score in sample.where(F.col("rank") == k).select("item", "score").collect():
        plan.floors[item] = score  # k documents of the sample reach it, so the result's k-th does
    return _search(counts, plan)


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 50, block_terms: int = BLOCK_TERMS,
                  block_items: int = BLOCK_ITEMS) -> DataFrame:
    """``item_id, rank, doc_id, score`` of the ``k`` highest scores above 0 of every item (``item_id``, ``text``)."""
    spark = docs.sparkSession
    kind = items.schema["item_id"].dataType
    path = scratch_path(spark, "ranked")
    names = ["item_id", "rank", "doc_id", "score"]
    empty = spark.createDataFrame([], "rank int, doc_id long, score long").withColumn("item_id", F.lit(None).cast(kind))
    empty.select(names).write.mode("append").parquet(path)
    for block in query_blocks(items, block_terms, block_items):
        ids = spark.createDataFrame(list(enumerate(block.item_ids)), f"item int, item_id {kind.simpleString()}")
        search_block(docs, block, k).join(F.broadcast(ids), "item").select(names).write.mode("append").parquet(path)
    return spark.read.schema(empty.select(names).schema).parquet(path)
