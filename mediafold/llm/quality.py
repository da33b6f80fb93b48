"""Quality classifier: a generalised additive model with pairwise interactions.

Numbers about a whole text (case, symbols, repetition, word shapes, line shapes) are binned at quantiles.  Training
cycles over the features and boosts one shallow tree at a time on each; as a tree over one binned feature is a step
function, the sum of a feature's trees is a lookup table over its bins.  The pairs whose bins explain most of what is
left get two-dimensional tables in the same way.  A score is the logistic of one table entry per feature and pair.

Scale: scoring is one pass over the texts, a chunk of about a megabyte at a time, with no shuffle; the model is a few
kilobytes.  Training takes at most ``train_rows`` labelled documents, chosen by a hash of their id.

Edge cases: NULL and empty texts have all features 0 and are scored; rows with a NULL ``doc_id`` are never trained on
and not held out; repeated rows are each scored; several labels of one document count as their maximum; with no usable
label, or only one class, every score is the smoothed share of label 1 (0.5 without rows); an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediafold.llm.common import Words, map_arrow, segment_sum, text_chunks

FEATURES = (
    "log_words", "word_length", "long_words", "short_words", "upper", "digits", "symbols", "bangs", "bars", "stops",
    "breaks", "spaces", "non_ascii", "glued", "top_word", "distinct", "repeat_next", "line_length", "distinct_lines",
    "n_bars", "n_glued", "n_repeats", "n_shouted")

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in ".,;:'\"!?|-()"]] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True


def _share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return part / np.maximum(whole, 1)


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Feature matrix of a chunk of texts, one row per text."""
    w = Words(data, offsets)
    n_docs = len(offsets) - 1
    n_bytes = np.diff(offsets)
    n_words = w.counts
    size = w.end - w.start

    def count(mask):
        total = np.zeros(len(mask) + 1, np.int64)
        np.cumsum(mask, out=total[1:])
        return total

    def per_byte(mask):
        return np.diff(count(mask)[offsets])

    def per_word(mask):
        return np.diff(count(mask)[w.bounds])

    letters = per_byte((LETTER[data]))
    line_break = data == 10
    doc = w.doc
    # Runs of equal (document, word) after sorting give counts of distinct and of the commonest words.
    order = np.lexsort((w.hash, doc))
    d, h = doc[order], w.hash[order]
    new = np.ones(len(d), bool)
    new[1:] = (d[1:] != d[:-1]) | (h[1:] != h[:-1])
    at = np.flatnonzero(new)
    run = np.diff(np.append(at, len(d)))
    distinct = np.bincount(d[at], minlength=n_docs)
    top = np.zeros(n_docs)
    np.maximum.at(top, d[at], run)
    same = np.zeros(len(doc), bool)
    same[1:] = (w.hash[1:] == w.hash[:-1]) & (doc[1:] == doc[:-1])
    # A symbol right behind a word.
    after = np.minimum(w.end, max(len(data) - 1, 0))
    glued = (w.end < offsets[1:][doc]) & _SYMBOL[data[after]] if len(doc) else np.zeros(0, bool)
    upper = count(_UPPER[data])
    shouted = (size > 2) & (upper[w.end] - upper[w.start] == size)
    lines = per_byte(line_break) + (n_bytes > 0)
    # Lines are hashed whole to count distinct ones.
    starts = np.unique(np.concatenate([offsets[:-1][n_bytes > 0], np.flatnonzero(line_break) + 1]))
    line_doc = np.searchsorted(offsets, starts, side="right") - 1
    keep = line_doc < n_docs
    starts, line_doc = starts[keep], line_doc[keep]
    ends = np.append(starts[1:], len(data))
    line_hash = w.span_hash(starts, ends) if len(starts) else np.zeros(0, np.uint64)
    order = np.lexsort((line_hash, line_doc))
    ld, lh = line_doc[order], line_hash[order]
    fresh = np.ones(len(ld), bool)
    fresh[1:] = (ld[1:] != ld[:-1]) | (lh[1:] != lh[:-1])
    distinct_lines = np.bincount(ld[fresh], minlength=n_docs)
    word_length = _share(segment_sum(size, w.bounds), n_words)
    return np.column_stack([
        np.log1p(n_words), word_length, _share(per_word(size > 12), n_words), _share(per_word(size <= 3), n_words),
        _share(per_byte(_UPPER[data]), letters), _share(per_byte(_DIGIT[data]), n_bytes),
        _share(per_byte(_SYMBOL[data]), n_bytes), _share(per_byte(data == ord("!")), n_bytes),
        _share(per_byte(data == ord("|")), n_bytes), _share(per_byte(data == ord(".")), n_words),
        _share(per_byte(line_break), n_bytes), _share(per_byte(data == 32), n_bytes),
        _share(per_byte(data >= 128), n_bytes), _share(per_word(glued), n_words), _share(top, n_words),
        _share(distinct, n_words), _share(per_word(same), n_words), np.log1p(_share(n_bytes, lines)),
        _share(distinct_lines, lines), np.log1p(per_byte(data == ord("|"))), np.log1p(per_word(glued)),
        np.log1p(per_word(same)), np.log1p(per_word(shouted))]).astype(np.float64)


LETTER = np.zeros(256, bool)
LETTER[65:91] = LETTER[97:123] = LETTER[128:] = True


# ------------------------------------------------------------------- model
@dataclass
class AdditiveModel:
    """``edges[f]`` are bin borders, ``single[f]`` the table of a feature, ``pairs`` (f, g, table)."""

    base: float
    edges: list[np.ndarray] = field(default_factory=list)
    single: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(self.edges)]) \
            if self.edges else np.zeros((len(x), 0), int)

    def margin(self, b: np.ndarray) -> np.ndarray:
        out = np.full(len(b), self.base)
        for f, table in enumerate(self.single):
            out += table[b[:, f]]
        for f, g, table in self.pairs:
            out += table[b[:, f], b[:, g]]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(self.bins(x)), -30, 30)))


def _gain(g, h, penalty):
    return g * g / (h + penalty)


def _step_tree(g: np.ndarray, h: np.ndarray, depth: int, penalty: float) -> np.ndarray:
    """Leaf value of each bin for a tree of ``depth`` over ordered bins with gradients ``g`` and weights ``h``."""
    if depth and len(g) > 1:
        left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
        gain = _gain(left_g, left_h, penalty) + _gain(g.sum() - left_g, h.sum() - left_h, penalty)
        cut = int(np.argmax(gain)) + 1
        if gain[cut - 1] > _gain(g.sum(), h.sum(), penalty) + 1e-9:
            return np.concatenate([_step_tree(g[:cut], h[:cut], depth - 1, penalty),
                                   _step_tree(g[cut:], h[cut:], depth - 1, penalty)])
    return np.full(len(g), g.sum() / (h.sum() + penalty))


def _pair_tree(g: np.ndarray, h: np.ndarray, penalty: float) -> np.ndarray:
    """One cut of the first feature, then one of the second on each side; also the other way round; the better wins."""
    def one_way(g, h):
        best, found = -np.inf, None
        top_g, top_h = np.cumsum(g, 0)[:-1], np.cumsum(h, 0)[:-1]
        for a in range(len(g) - 1):
            value, sides = 0.0, []
            for sg, sh in ((top_g[a], top_h[a]), (g.sum(0) - top_g[a], h.sum(0) - top_h[a])):
                leaf = _step_tree(sg, sh, 1, penalty)
                value += float((leaf * (sg - 0.5 * leaf * (sh + penalty / len(sh)))).sum())
                sides.append(leaf)
            if value > best:
                best, found = value, (a + 1, sides)
        out = np.zeros(g.shape)
        if found:
            out[:found[0]], out[found[0]:] = found[1]
        return best, out

    first, second = one_way(g, h), one_way(g.T, h.T)
    return first[1] if first[0] >= second[0] else second[1].T


def train(x: np.ndarray, y: np.ndarray, rounds: int = 60, pair_rounds: int = 15, n_pairs: int = 5, max_bins: int = 32,
          rate: float = 0.2, depth: int = 2, penalty: float = 1.0) -> AdditiveModel:
    """Cyclic boosting of shallow trees, single features first, then the most useful pairs."""
    share = (y.sum() + 1.0) / (len(y) + 2.0)
    model = AdditiveModel(float(np.log(share / (1 - share))))
    if len(y) == 0 or y.min() == y.max():
        return model
    quantiles = np.linspace(0, 1, max_bins + 1)[1:-1]
    model.edges = [np.unique(np.quantile(x[:, f], quantiles)) for f in range(x.shape[1])]
    b = model.bins(x)
    sizes = [len(e) + 1 for e in model.edges]
    model.single = [np.zeros(n) for n in sizes]
    margin = np.full(len(y), model.base)

    def grad():
        p = 1 / (1 + np.exp(-margin))
        return y - p, np.maximum(p * (1 - p), 1e-6)

    for _ in range(rounds):
        for f, n in enumerate(sizes):
            g, h = grad()
            step = rate * _step_tree(np.bincount(b[:, f], g, n), np.bincount(b[:, f], h, n), depth, penalty)
            model.single[f] += step
            margin += step[b[:, f]]
    g, h = grad()
    ranked = []
    for f in range(len(sizes)):
        for k in range(f + 1, len(sizes)):
            cell = b[:, f] * sizes[k] + b[:, k]
            cg, ch = np.bincount(cell, g), np.bincount(cell, h)
            ranked.append((-float(_gain(cg, ch, 5.0).sum()), f, k))
    for _, f, k in sorted(ranked)[:n_pairs]:
        model.pairs.append((f, k, np.zeros((sizes[f], sizes[k]))))
    for _ in range(pair_rounds):
        for f, k, table in model.pairs:
            g, h = grad()
            cell, n = b[:, f] * sizes[k] + b[:, k], sizes[f] * sizes[k]
            step = rate * _pair_tree(np.bincount(cell, g, n).reshape(sizes[f], sizes[k]),
                                     np.bincount(cell, h, n).reshape(sizes[f], sizes[k]), penalty)
            table += step
            margin += step[b[:, f], b[:, k]]
    return model


# ------------------------------------------------------------------- Spark
def labelled(docs: DataFrame, labels: DataFrame, label: str, usable: Callable[[Column], Column],
             train_rows: int, extra: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, text, y`` (and ``extra`` columns of ``docs``) of at most ``train_rows`` labelled documents, chosen by a hash of the id."""
    picked = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y"))
              .where(F.col("doc_id").isNotNull() & F.col("y").isNotNull() & usable(F.col("doc_id")))
              .groupBy("doc_id").agg(F.max("y").alias("y"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows))
    picked = picked.withColumnRenamed("doc_id", "_id")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
                        *extra)
    # At most train_rows rows.
    return texts.join(F.broadcast(picked), F.col("doc_id") == F.col("_id")).select("doc_id", "text", "y", *extra)


def fit(docs: DataFrame, labels: DataFrame, usable: Callable[[Column], Column],
        train_rows: int = 20_000) -> AdditiveModel:
    """Train on a bounded sample; only feature rows reach the driver."""
    def run(batches):
        for part, data, offsets in text_chunks(batches, "text"):
            x = features(data, offsets)
            yield pa.RecordBatch.from_arrays(
                [part.column(part.schema.get_field_index("doc_id")), part.column(part.schema.get_field_index("y")),
                 pa.array(list(x), pa.list_(pa.float64()))], ["doc_id", "y", "x"])

    rows = labelled(docs, labels, "quality", usable, train_rows)
    rows = map_arrow(rows, run, "doc_id long, y int, x array<double>")
    # Repeated documents could add rows; the limit keeps the driver's share bounded.
    rows = rows.orderBy(F.xxhash64("doc_id"), "doc_id", "x").limit(train_rows).collect()
    x = np.array([r["x"] for r in rows], np.float64).reshape(-1, len(FEATURES))
    return train(x, np.array([1.0 if r["y"] > 0 else 0.0 for r in rows]))


def with_score(docs: DataFrame, model: AdditiveModel, name: str = "score") -> DataFrame:
    """``docs`` with a score column appended (all other columns pass through)."""
    from pyspark.sql.types import DoubleType, StructField, StructType

    def run(batches):
        for part, data, offsets in text_chunks(batches, "text"):
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(model.score(features(data, offsets)))],
                                             [*part.schema.names, name])

    return map_arrow(docs, run, StructType([*docs.schema.fields, StructField(name, DoubleType())]))


def quality_scores(docs: DataFrame, labels: DataFrame, held_out: Callable[[Column], Column],
                   threshold: float = 0.7, train_rows: int = 20_000) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document; learns only where ``held_out`` is false."""
    model = fit(docs, labels, lambda c: ~held_out(c), train_rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return with_score(texts, model).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"))
