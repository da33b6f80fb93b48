"""Benchmark decontamination with an FM-index per training shard.

The benchmark's windows (10 consecutive words, or a whole item of fewer) are the patterns.  A shard is a chunk of whole
documents as word numbers.  Only the benchmark's own words need numbers; a run of such words shorter than the shortest
pattern cannot hold one and is left out of the index, everything else is indexed.  Runs are joined with separators, the
suffix array comes from prefix doubling (separators differ, so no comparison leaves its run), and the
Burrows-Wheeler transform goes into a wavelet matrix whose rank queries drive backward search, for all patterns at once.
Matches are located by walking back to sampled suffixes.  Their word spans are merged per document.

Scale: a map over the texts without a shuffle; an index lives only while its shard is searched.  Patterns are sent to the
tasks in blocks of at most ``block_items`` items and ``block_bytes`` bytes, one pass of the (pipelined) map a
block, so a benchmark of any size works with bounded memory.  Spans of a document are merged intervals.

Words are compared by 64-bit hashes of their ASCII-folded bytes.

Edge cases: NULL or empty texts have no words and no hits; items without words match nothing; an item
with a NULL id has hits but is not in the list or number of items; items that repeat an id count once a document; repeated or NULL document ids are rows of their own; an empty
benchmark leaves every document clean; an empty table gives an empty result; other columns pass through
:func:`remove_spans` untouched.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mediafold.llm.common import Words, map_arrow, set_apart, text_chunks, utf8

SHARD_BYTES = 1 << 20
SAMPLE = 16


# ------------------------------------------------------------ index parts
class WaveletMatrix:
    """Rank queries over a sequence of small numbers: one bit array with running counts per bit."""

    def __init__(self, seq: np.ndarray, top: int):
        self.bits = max(1, int(top).bit_length())
        self.levels = []
        for b in range(self.bits - 1, -1, -1):
            bit = ((seq >> b) & 1).astype(bool)
            ones = np.zeros(len(seq) + 1, np.int32)
            np.cumsum(bit, out=ones[1:])
            self.levels.append(ones)
            seq = np.concatenate([seq[~bit], seq[bit]])

    def rank(self, symbol: np.ndarray, upto: np.ndarray) -> np.ndarray:
        """Occurrences of each ``symbol`` before each position ``upto``."""
        lo, hi = np.zeros_like(upto), upto
        for level, ones in enumerate(self.levels):
            bit = ((symbol >> (self.bits - 1 - level)) & 1).astype(bool)
            zeros = len(ones) - 1 - ones[-1]
            lo = np.where(bit, zeros + ones[lo], lo - ones[lo])
            hi = np.where(bit, zeros + ones[hi], hi - ones[hi])
        return hi - lo


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffixes in order, by prefix doubling; only suffixes that are still tied are sorted again."""
    n = len(text)
    order = np.argsort(text, kind="stable")
    rank = np.empty(n, np.int64)
    new = np.ones(n, bool)
    new[1:] = text[order[1:]] != text[order[:-1]]
    rank[order] = np.flatnonzero(new)[np.cumsum(new) - 1]  # rank = first place of the group
    step = 1
    while True:
        group = rank[order]
        tied = np.zeros(n, bool)
        tied[1:] = group[1:] == group[:-1]
        tied[:-1] |= tied[1:]
        at = np.flatnonzero(tied)
        if not len(at):
            return order
        suffix = order[at]
        following = np.full(len(at), -1, np.int64)
        inside = suffix + step < n
        following[inside] = rank[suffix[inside] + step]
        by = np.lexsort((following, group[at]))
        suffix, following, g = suffix[by], following[by], group[at][by]
        order[at] = suffix
        fresh = np.ones(len(at), bool)
        fresh[1:] = (g[1:] != g[:-1]) | (following[1:] != following[:-1])
        rank[suffix] = at[np.flatnonzero(fresh)[np.cumsum(fresh) - 1]]
        step *= 2


class FmIndex:
    """Index of runs of words, for patterns without separators.

    ``text`` holds word numbers from 1, 0 after each run.
    """

    def __init__(self, text: np.ndarray, top: int):
        n = len(text)
        separator = text == 0
        wide = np.where(separator, np.cumsum(separator) - 1, text + int(separator.sum()))
        self.suffixes = suffix_array(wide)
        before = text[self.suffixes - 1]  # the word ahead of each suffix; the text ends with a separator
        self.bwt = before
        self.wavelet = WaveletMatrix(before, top)
        self.first = np.zeros(top + 2, np.int64)
        np.cumsum(np.bincount(text, minlength=top + 1), out=self.first[1:])
        # Sampled suffixes: every SAMPLE-th place, and those at the head of a run (nothing to walk back to).
        kept = (self.suffixes % SAMPLE == 0) | (before == 0)
        self.kept = kept
        self.place = np.cumsum(kept) - 1
        self.sampled = self.suffixes[kept]
        del self.suffixes
        self.size = n

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search: the range of suffixes that start with each pattern (rows, padded with 0 on the left)."""
        lo = np.zeros(len(patterns), np.int64)
        hi = np.full(len(patterns), self.size, np.int64)
        width = patterns.shape[1]
        for back in range(1, width + 1):
            live = np.flatnonzero((lengths >= back) & (lo < hi))
            if not len(live):
                break
            c = patterns[live, width - back]
            both = self.wavelet.rank(np.concatenate([c, c]), np.concatenate([lo[live], hi[live]]))
            lo[live] = self.first[c] + both[:len(live)]
            hi[live] = self.first[c] + both[len(live):]
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text position of each suffix row, by walking back to a sampled one."""
        at, steps = rows.copy(), np.zeros(len(rows), np.int64)
        live = np.flatnonzero(~self.kept[at])
        while len(live):
            c = self.bwt[at[live]]
            at[live] = self.first[c] + self.wavelet.rank(c, at[live])
            steps[live] += 1
            live = live[~self.kept[at[live]]]
        return self.sampled[self.place[at]] + steps


# ---------------------------------------------------------------- patterns
class Patterns:
    """Windows of a block of benchmark items."""

    def __init__(self, items: list[tuple[str, str | None]], window: int):
        data, offsets = utf8(pa.array([t for _, t in items], pa.string()))
        w = Words(data, offsets)
        self.names = [i for i, _ in items]
        self.words, number = np.unique(w.hash, return_inverse=True)
        rows: dict[tuple[int, ...], set[int]] = {}
        for d in range(len(items)):
            seq = tuple((number[w.bounds[d]:w.bounds[d + 1]] + 1).tolist())
            for s in range(max(1, len(seq) - window + 1)) if seq else ():
                rows.setdefault(seq[s:s + window], set()).add(d)
        self.owners = list(rows.values())
        self.lengths = np.array([len(r) for r in rows], np.int64)
        self.rows = np.zeros((len(rows), window), np.int64)
        for i, r in enumerate(rows):
            self.rows[i, window - len(r):] = r
        self.shortest = int(self.lengths.min()) if len(rows) else 0

    def hits(self, w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, pattern, first word) of each occurrence in the shard; words are counted over the shard."""
        none = np.zeros(0, np.int64)
        if not len(self.rows) or not len(w.hash):
            return none, none, none
        at = np.searchsorted(self.words, w.hash)
        at[at == len(self.words)] = 0
        number = np.where(self.words[at] == w.hash, at + 1, 0)
        # Runs of benchmark words inside one document.
        known = number > 0
        head = known.copy()
        head[1:] &= ~known[:-1]
        start = w.bounds[:-1][w.counts > 0]
        head[start] |= known[start]
        run = np.cumsum(head)
        run[~known] = 0
        length = np.bincount(run)
        length[0] = 0
        keep = np.flatnonzero(length[run] >= self.shortest)
        if not len(keep):
            return none, none, none
        # The kept words with a separator behind each run.
        last = np.ones(len(keep), bool)
        last[:-1] = run[keep[1:]] != run[keep[:-1]]
        place = np.arange(len(keep)) + np.cumsum(last) - last
        text = np.zeros(len(keep) + int(last.sum()), np.int64)
        text[place] = number[keep]
        word_at = np.zeros(len(text), np.int64)
        word_at[place] = keep
        index = FmIndex(text, len(self.words))
        lo, hi = index.search(self.rows, self.lengths)
        found = np.flatnonzero(hi > lo)
        n = (hi - lo)[found]
        rows = np.arange(n.sum()) + np.repeat(lo[found] - np.cumsum(n) + n, n)
        first = word_at[index.locate(rows)]
        return np.searchsorted(w.bounds, first, side="right") - 1, np.repeat(found, n), first


def benchmark_blocks(benchmark: DataFrame, block_items: int, block_bytes: int) -> Iterator[list[tuple[str | None, str]]]:
    """Items in blocks of bounded size, streamed partition by partition; an item without an id is one like any other."""
    rows = benchmark.select(F.col("item_id").cast("string").alias("i"), F.col("text").cast("string").alias("t"))
    block, size = [], 0
    for r in rows.where("t is not null").toLocalIterator():
        block.append((r["i"], r["t"]))
        size += len(r["t"])
        if len(block) >= block_items or size >= block_bytes:
            yield block
            block, size = [], 0
    if block:
        yield block


def _merge(spans: np.ndarray) -> np.ndarray:
    """Union of half-open intervals, sorted."""
    if not len(spans):
        return spans.reshape(0, 2)
    spans = spans[np.lexsort((spans[:, 1], spans[:, 0]))]
    end = np.maximum.accumulate(spans[:, 1])
    new = np.ones(len(spans), bool)
    new[1:] = spans[1:, 0] > end[:-1]
    first = np.flatnonzero(new)
    return np.column_stack([spans[first, 0], np.append(end[first[1:] - 1], end[-1])])


# Internal columns: words of the text, merged hit spans [from, to, ...] in words, the same in bytes, items found.
STATE = T.StructType([
    T.StructField("_n_words", T.LongType()), T.StructField("_spans", T.ArrayType(T.LongType())),
    T.StructField("_bytes", T.ArrayType(T.LongType())), T.StructField("_items", T.ArrayType(T.StringType()))])


def find_spans(docs: DataFrame, benchmark: DataFrame, window: int = 10, block_items: int = 50_000,
               block_bytes: int = 16 << 20) -> DataFrame:
    """``docs`` with the columns of ``STATE`` appended."""
    spark = docs.sparkSession
    schema = T.StructType([*docs.schema.fields, *STATE.fields])
    names = [f.name for f in schema.fields]
    blocks = benchmark_blocks(benchmark, block_items, block_bytes)
    for nth, block in enumerate(chain([next(blocks, [])], blocks)):
        shared = spark.sparkContext.broadcast(Patterns(block, window))  # at most one block

        def run(batches, shared=shared, nth=nth):
            patterns = shared.value
            for part, data, offsets in text_chunks(batches, "text", SHARD_BYTES):
                w = Words(data, offsets)
                doc, pattern, first = patterns.hits(w)
                length = patterns.lengths[pattern] if len(pattern) else first
                n = part.num_rows
                order = np.argsort(doc, kind="stable")
                doc, pattern, first, length = doc[order], pattern[order], first[order], length[order]
                cut = np.searchsorted(doc, np.arange(n + 1))
                old_spans = old_items = None
                if nth:
                    old_spans = part.column(names.index("_spans")).to_pylist()
                    old_items = part.column(names.index("_items")).to_pylist()
                spans, pieces, items = [], [], []
                for d in range(n):
                    a, b = cut[d], cut[d + 1]
                    s = np.column_stack([first[a:b], first[a:b] + length[a:b]]) - w.bounds[d]
                    found = {patterns.names[o] for p in set(pattern[a:b].tolist()) for o in patterns.owners[p]}
                    found.discard(None)  # an item without an id has hits but no name
                    if nth:
                        s = np.concatenate([s, np.array(old_spans[d], np.int64).reshape(-1, 2)])
                        found |= set(old_items[d])
                    s = _merge(s)
                    spans.append(s.ravel().tolist())
                    words = s + w.bounds[d]
                    at = np.column_stack([w.start[words[:, 0]], w.end[words[:, 1] - 1]]) - offsets[d] if len(s) else s
                    pieces.append(at.ravel().tolist())
                    items.append(sorted(found))
                kept = part.columns[:len(names) - len(STATE.fields)]
                yield pa.RecordBatch.from_arrays(
                    [*kept, pa.array(w.counts, pa.int64()), pa.array(spans, pa.list_(pa.int64())),
                     pa.array(pieces, pa.list_(pa.int64())), pa.array(items, pa.list_(pa.string()))], names)

        docs = map_arrow(docs, run, schema)
    return docs


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, **blocks) -> DataFrame:
    """Per document: ``doc_id, n_words, n_hit, n_items, items_sha256, contaminated``."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = find_spans(rows, benchmark, window, **blocks)
    # Spans are [from, to, from, to, ...]: the sum of differences with alternating sign.
    hit = F.aggregate(F.transform("_spans", lambda x, i: F.when(i % 2 == 1, x).otherwise(-x)),
                      F.lit(0).cast("long"), lambda a, x: a + x)
    return rows.select(
        "doc_id", F.col("_n_words").alias("n_words"), hit.alias("n_hit"),
        F.size("_items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("_items"), ","), 256).alias("items_sha256"),
        (F.size("_spans") > 0).alias("contaminated"))


def remove_spans(docs: DataFrame, benchmark: DataFrame, window: int = 10, **blocks) -> DataFrame:
    """``docs`` with every hit span cut out of ``text``.

    Clean documents come through unchanged.  White space around a cut becomes one space; ``n_chars``, if there, follows
    the new text.  Documents with no word left after a cut are dropped.
    """
    inside, restored = set_apart(docs)
    found = find_spans(inside, benchmark, window, **blocks)
    dirty = F.size("_spans") > 0
    # The pieces between the cuts, by bytes: [0, to, to, ...] to [from, from, ..., end].
    raw = F.encode("text", "UTF-8")
    cuts = F.col("_bytes")
    low = F.concat(F.array(F.lit(0).cast("long")), F.filter(cuts, lambda x, i: i % 2 == 1))
    high = F.concat(F.filter(cuts, lambda x, i: i % 2 == 0), F.array(F.octet_length("text").cast("long")))
    pieces = F.zip_with(low, high, lambda a, b: F.btrim(
        F.decode(F.substring(raw, (a + 1).cast("int"), (b - a).cast("int")), "UTF-8"), F.lit(" \t\r\n")))
    left = F.col("_n_words") - F.aggregate(
        F.transform("_spans", lambda x, i: F.when(i % 2 == 1, x).otherwise(-x)), F.lit(0).cast("long"), lambda a, x: a + x)
    cleaned = found.where(~dirty | (left > 0)).withColumn("_cut", dirty).withColumn(
        "text", F.when(dirty, F.array_join(F.filter(pieces, lambda x: x != ""), " ")).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        cleaned = cleaned.withColumn("n_chars", F.when(
            F.col("_cut"), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return restored(cleaned)
