"""Language identification by nearest centroid over character n-gram TF-IDF vectors.

A text becomes counts of hashed n-grams (2 to 4 bytes of the case-folded text, spaces standing in for everything that is
not part of a word), weighted by log(1 + count) and inverse document frequency and scaled to length one.  Each language
has several centroids (spherical k-means of its training vectors); the language of the centroid with the largest cosine
wins, ties to the smaller name.  ``accepted`` says whether the cosine reaches the language's floor, a low quantile of
its own training cosines: rejection by distance.

Scale: one pass over the texts, no shuffle; the model is ``dims`` floats a centroid.  Training takes up to
``rows_per_lang`` different texts of each language, chosen by a hash of the text, so a hot language or text costs no more
than a rare one.

Edge cases: a NULL text, or one without any letter, is ``und`` with score 0; rows with a NULL language or ``doc_id`` are
never trained on; repeated rows are each predicted; without training rows every text is ``und``; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mediafold.llm.common import LOWER, WORD_BYTE, byte_chunks, map_arrow, text_chunks, utf8

DIMS = 4096
_TABLE = LOWER.copy()
_TABLE[~WORD_BYTE] = 32
_TABLE[48:58] = 32  # digits say nothing about a language
_MIX = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D))


def ngram_counts(data: np.ndarray, offsets: np.ndarray, dims: int = DIMS) -> np.ndarray:
    """Counts of hashed 2-, 3- and 4-byte grams of each text (rows) in ``dims`` cells."""
    n_docs = len(offsets) - 1
    shift = np.uint32(32 - int(dims).bit_length() + 1)
    out = np.zeros((n_docs, dims), np.float32)
    for d in range(n_docs):
        t = _TABLE[data[offsets[d]:offsets[d + 1]]]
        if not len(t):
            continue
        keep = np.ones(len(t), bool)
        keep[1:] = (t[1:] != 32) | (t[:-1] != 32)  # one space between words
        t = np.concatenate([[32], t[keep], [32]]).astype(np.uint32)
        gram, counts = t, np.zeros(dims, np.int64)
        for k in (2, 3, 4):
            if len(t) < k:
                break
            gram = (gram[:-1] << np.uint32(8)) | t[k - 1:]
            cells = ((gram * _MIX[k - 2]) ^ (gram >> np.uint32(15)) * _MIX[(k - 1) % 3]) >> shift
            counts += np.bincount(cells, minlength=dims)
        out[d] = counts
    return out


def has_letter(texts: pa.Array) -> np.ndarray:
    """True where a text holds a Unicode letter."""
    data, offsets = utf8(texts)
    total = np.zeros(len(data) + 1, np.int64)
    folded = data | 32
    np.cumsum((folded >= 97) & (folded <= 122) & (data < 128), out=total[1:])
    found = np.diff(total[offsets]) > 0
    for i in np.flatnonzero(~found & (np.diff(offsets) > 0)):
        found[i] = any(unicodedata.category(c)[0] == "L" for c in texts[int(i)].as_py())
    return found


@dataclass
class CentroidModel:
    langs: list[str]           # language of each centroid
    centroids: np.ndarray      # one unit row a centroid
    idf: np.ndarray
    floor: dict[str, float]

    def vectors(self, counts: np.ndarray) -> np.ndarray:
        x = np.log1p(counts) * self.idf
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)

    def predict(self, counts: np.ndarray) -> tuple[list[str], np.ndarray]:
        if not self.langs:
            return ["und"] * len(counts), np.zeros(len(counts))
        cosine = self.vectors(counts) @ self.centroids.T
        best = cosine.argmax(1)
        return [self.langs[i] for i in best], np.clip(cosine[np.arange(len(best)), best], 0, 1).astype(float)


def _spherical_kmeans(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Centroids of unit rows; the first is the row nearest the mean, then farthest first."""
    picked = [int((x @ x.mean(0)).argmax())]
    while len(picked) < min(k, len(x)):
        picked.append(int((x @ x[picked].T).max(1).argmin()))
    c = x[picked]
    for _ in range(rounds):
        own = (x @ c.T).argmax(1)
        sums = np.stack([x[own == i].sum(0) if (own == i).any() else c[i] for i in range(len(c))])
        c = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return c


def train(langs: list[str], counts: np.ndarray, k: int = 4, floor_quantile: float = 0.01) -> CentroidModel:
    df = (counts > 0).sum(0)
    idf = (np.log((1 + len(counts)) / (1 + df)) + 1).astype(np.float32)
    model = CentroidModel([], np.zeros((0, counts.shape[1]), np.float32), idf, {})
    x = model.vectors(counts)
    names, rows = np.array(langs, dtype=object), []
    for lang in sorted(set(langs)):
        own = x[names == lang]
        c = _spherical_kmeans(own, k)
        rows.append(c)
        model.langs += [lang] * len(c)
        model.floor[lang] = float(np.quantile((own @ c.T).max(1), floor_quantile))
    if rows:
        model.centroids = np.concatenate(rows).astype(np.float32)
    return model


def fit(docs: DataFrame, usable: Callable[[Column], Column], rows_per_lang: int = 500, dims: int = DIMS) -> CentroidModel:
    """Train on up to ``rows_per_lang`` different texts a language, picked by a hash of the text.

    Copies of a text count once, however many there are, and every language gets its own cut of the hashes, so neither a
    hot text nor a hot language takes the place of others.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
                       F.col("lang").cast("string").alias("lang"))
    rows = rows.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull() & F.col("lang").isNotNull()
                      & usable(F.col("doc_id"))).withColumn("h", F.xxhash64(F.lit(5), "text"))
    # Sketches of the different texts of each language; twice the rows asked for leave room for their error.
    texts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")).collect()}
    if not texts:
        return train([], np.zeros((0, dims), np.float32))
    cut = F.lit(-1)
    for lang, n in sorted(texts.items()):
        part = min(1.0, 2.0 * rows_per_lang / max(n, 1))
        cut = F.when(F.col("lang") == lang, F.lit(min(int(part * 2 ** 63), 2 ** 63 - 1))).otherwise(cut)
    rows = rows.where(F.shiftrightunsigned("h", 1) <= cut)
    some = rows.groupBy("lang", "h").agg(F.min("text").alias("text"))  # copies combine before the shuffle
    order = Window.partitionBy("lang").orderBy("h", "text")
    some = some.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= rows_per_lang).drop("nth", "h")

    def run(batches):
        for p, data, offsets in text_chunks(batches, "text"):
            c = ngram_counts(data, offsets, dims)
            cells = [np.flatnonzero(r).astype("<u2").tobytes() for r in c]
            values = [r[r > 0].astype("<u4").tobytes() for r in c]
            yield pa.RecordBatch.from_arrays(
                [p.column(p.schema.get_field_index("lang")), pa.array(cells, pa.binary()), pa.array(values, pa.binary())],
                ["lang", "cells", "n"])

    langs: list[str] = []
    counts = []
    for r in sorted(map_arrow(some, run, "lang string, cells binary, n binary").collect()):
        langs.append(r["lang"])
        v = np.zeros(dims, np.float32)
        v[np.frombuffer(r["cells"], "<u2")] = np.frombuffer(r["n"], "<u4")
        counts.append(v)
    return train(langs, np.stack(counts) if counts else np.zeros((0, dims), np.float32))


def predict_languages(docs: DataFrame, held_out: Callable[[Column], Column], rows_per_lang: int = 500) -> DataFrame:
    """``doc_id, held_out, lang_pred, score, accepted``; learns only where ``held_out`` is false."""
    model = fit(docs, lambda c: ~held_out(c), rows_per_lang)

    def run(batches):
        for batch in batches:
            texts = batch.column(1)
            data, offsets = utf8(texts)
            letter = has_letter(texts)
            for lo, hi in byte_chunks(offsets):
                counts = ngram_counts(data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo])
                lang, score = model.predict(counts)
                ok = letter[lo:hi]
                lang = [x if y else "und" for x, y in zip(lang, ok, strict=True)]
                score = np.where(ok, score, 0.0)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(lang, pa.string()), pa.array(score),
                     pa.array([x in model.floor and s >= model.floor[x] for x, s in zip(lang, score, strict=True)])],
                    ["doc_id", "lang_pred", "score", "accepted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = map_arrow(rows, run, "doc_id long, lang_pred string, score double, accepted boolean")
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "accepted")
