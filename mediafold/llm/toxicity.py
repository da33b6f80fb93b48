"""Toxicity: a convolutional text classifier over hashed word embeddings.

A word's embedding is the sum of hashed vectors for the word and for its prefixes of 3 to 7 bytes, so that an unseen
form of a known stem is still recognised.  Filters of widths 1 to 3 run over the words of the whole text, each keeps its
maximum, and a logistic layer weighs the maxima.  Gradients (Adam) reach only the words that hold a maximum; embeddings
start with the log odds of each cell in the training texts.  Afterwards the margin at which a prediction is worth making
is calibrated for each language, told from the text by word profiles learned on the same training rows, and the score is
shifted so that this margin lies at 0.5.

Scale: scoring is one pass over the texts in chunks of half a megabyte, no shuffle; the model is a few megabytes and is
broadcast.  Counts, network and thresholds are learned from every usable labelled document, each with its whole text: the
word cells of the documents are stored once in units of at most ``unit_rows`` rows and ``UNIT_WORDS`` words (a longer text
stands alone); in each round every unit trains the network of the round before by itself, and Spark adds up the changes,
a parameter's by the rows or batches that moved it.  Changes and counts are summed as whole numbers, so the model does not
depend on how units are spread.  What reaches the driver is bounded: cells, languages and steps of the margin.

Edge cases: NULL and empty texts have no word, all maxima are 0, and they are scored like any other; rows with a NULL
``doc_id`` are never trained on and not held out; repeated rows are each scored; several labels of one document count as
their maximum; with no usable label, or only one class, every score is the smoothed share of label 1 (0.5 without
rows); an empty table gives an empty result; other columns are ignored.  A language takes 16 kB of the model.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from copy import deepcopy
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediafold.llm.common import Words, byte_chunks, map_arrow, stored, text_chunks

CELLS = 1 << 15
WIDTHS = (1, 2, 3)
FILTERS = 12
SIZE = 12
PREFIXES = (3, 4, 5, 6, 7)
PROFILE = 1 << 12

#: Words of a training unit, of a batch of gradients and of a chunk of margins: each bounds a task's memory.
UNIT_WORDS = 1 << 21
BATCH_WORDS = 1 << 17
#: Up to this many labelled ids are joined by broadcast (some 30 MB); more are joined by a shuffle of the texts.
BROADCAST_IDS = 1_000_000
#: Rounds of training, and epochs of each unit in a round.
ROUNDS = 3
EPOCHS = 2
#: Changes of parameters are summed in these fractions, margins are calibrated in these.
CHANGE = 1 << 24
STEPS = 1 << 10


def cells(w: Words) -> np.ndarray:
    """Hash cells of each word: the word, then its prefixes (cell 0 where the word is shorter)."""
    out = np.zeros((len(w.start), 1 + len(PREFIXES)), np.int32)
    out[:, 0] = (w.hash >> np.uint64(20)).astype(np.int64) % (CELLS - 1) + 1
    length = w.end - w.start
    for i, k in enumerate(PREFIXES):
        long = np.flatnonzero(length >= k)
        h = w.span_hash(w.start[long], w.start[long] + k) ^ np.uint64(0x5851F42D4C957F2D * (i + 1) & (1 << 64) - 1)
        out[long, i + 1] = (h >> np.uint64(20)).astype(np.int64) % (CELLS - 1) + 1
    return out


def profile_cells(w: Words) -> np.ndarray:
    """Cell of each word in the word profile of a language."""
    return (w.hash % np.uint64(PROFILE)).astype(np.int64)


@dataclass
class TextCnn:
    table: np.ndarray                # CELLS x SIZE, row 0 stays 0
    filters: list[np.ndarray]        # width x SIZE x FILTERS each
    bias: np.ndarray                 # one per filter
    out: np.ndarray
    base: float
    langs: list[str]
    profile: np.ndarray              # PROFILE x languages, log odds
    shift: np.ndarray                # margin that scores 0.5, one per language and one for none

    def embed(self, c: np.ndarray) -> np.ndarray:
        e = self.table.take(c[:, 0], axis=0)
        for i in range(1, c.shape[1]):
            e += self.table.take(c[:, i], axis=0)
        return e

    def pooled(self, e: np.ndarray, bounds: np.ndarray, where: bool = False):
        """Maxima of each filter over each text, at least 0; with ``where`` also the word each starts at (-1: none)."""
        n = len(bounds) - 1
        counts = np.diff(bounds)
        best = np.zeros((n, FILTERS * len(WIDTHS)), np.float32)
        at = np.full(best.shape, -1, np.int64) if where else None
        for i, f in enumerate(self.filters):
            k = len(f)
            full = np.flatnonzero(counts >= k)
            if not len(full):
                continue
            m = len(e) - k + 1
            act = e[:m] @ f[0]
            for j in range(1, k):
                act += e[j:m + j] @ f[j]
            act += self.bias[i * FILTERS:(i + 1) * FILTERS]
            # Windows that would run into the next text are put out of play.
            for j in range(1, k):
                edge = bounds[1:][counts > 0] - j
                act[edge[(edge >= 0) & (edge < m)]] = -np.inf
            # Start of each text that has a window; the rows up to the next such text belong to it or are out of play.
            lead = bounds[:-1][full]
            top = np.maximum.reduceat(act, lead, axis=0)
            cols = slice(i * FILTERS, (i + 1) * FILTERS)
            best[full, cols] = np.maximum(top, 0)
            if where:
                for r, lo, hi in zip(full, lead, np.append(lead[1:], m), strict=True):
                    at[r, cols] = lo + act[lo:hi].argmax(0)
        if where:
            at[best <= 0] = -1
        return best, at

    def margins(self, w: Words) -> tuple[np.ndarray, np.ndarray]:
        """(margin, language index) of each text of a chunk."""
        best, _ = self.pooled(self.embed(cells(w)), w.bounds)
        return best.astype(np.float64) @ self.out + self.base, self.languages(w)

    def languages(self, w: Words) -> np.ndarray:
        """Index of the likeliest language; the last index if there is no word or no profile."""
        return self.languages_of(profile_cells(w), w.bounds)

    def languages_of(self, words: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        none = len(self.langs)
        got = np.full(len(bounds) - 1, none)
        if none and len(words):
            full = np.flatnonzero(np.diff(bounds) > 0)
            got[full] = np.add.reduceat(self.profile[words], bounds[:-1][full], axis=0).argmax(1)
        return got

    def score(self, w: Words) -> np.ndarray:
        margin, lang = self.margins(w)
        return 1 / (1 + np.exp(-np.clip(margin - self.shift[lang], -30, 30)))

    def packed(self) -> np.ndarray:
        """All that is trained, as rows of SIZE numbers: the embeddings, then everything else."""
        rest = np.concatenate([*[f.ravel() for f in self.filters], self.bias, self.out, [self.base]])
        rest = np.append(rest, np.zeros(-len(rest) % SIZE))
        return np.concatenate([self.table.astype(np.float64), rest.reshape(-1, SIZE)])

    def unpack(self, rows: np.ndarray) -> None:
        self.table = rows[:CELLS].astype(np.float32)
        rest, at = rows[CELLS:].ravel(), 0
        for i, f in enumerate(self.filters):
            self.filters[i] = rest[at:at + f.size].reshape(f.shape).astype(np.float32)
            at += f.size
        self.bias = rest[at:at + len(self.bias)].astype(np.float32)
        at += len(self.bias)
        self.out = rest[at:at + len(self.out)].copy()
        self.base = float(rest[at + len(self.out)])


class Adam:
    def __init__(self, shape, rate):
        self.m, self.v, self.t, self.rate = np.zeros(shape, np.float32), np.zeros(shape, np.float32), 0, rate

    def step(self, p, g):
        self.t += 1
        self.m += 0.1 * (g - self.m)
        self.v += 0.001 * (g * g - self.v)
        p -= self.rate * (self.m / (1 - 0.9 ** self.t)) / (np.sqrt(self.v / (1 - 0.999 ** self.t)) + 1e-8)


def start(seen: np.ndarray, n0: float, n1: float, seed: int = 3) -> TextCnn:
    """The network before training, from the rows of each label (``n0``, ``n1``) and those that hold each cell (``seen``)."""
    rng = np.random.default_rng(seed)
    share = (n1 + 1.0) / (n0 + n1 + 2.0)
    n_out = FILTERS * len(WIDTHS)
    model = TextCnn(np.zeros((CELLS, SIZE), np.float32),
                    [(rng.standard_normal((k, SIZE, FILTERS)) * 0.1).astype(np.float32) for k in WIDTHS],
                    np.zeros(n_out, np.float32), np.zeros(n_out), float(np.log(share / (1 - share))), [],
                    np.zeros((PROFILE, 0), np.float32), np.zeros(1))
    if not n0 or not n1:
        return model
    # Log odds of a cell's presence, shrunk where it is rare, as the first coordinate.
    odds = np.log((seen[1] + 0.5) / (n1 + 1)) - np.log((seen[0] + 0.5 * n0 / n1) / (n0 + n0 / n1))
    odds *= (seen[0] + seen[1]) >= 2
    model.table[:] = rng.standard_normal(model.table.shape) * 0.02
    model.table[:, 0] = np.clip(odds, -1, 4) / 2
    model.table[0] = 0
    for f in model.filters:
        f[:, 0, :] = np.abs(f[:, 0, :]) + 0.3 / len(f)
    model.bias[:] = -1.0
    model.out[:] = 0.3
    return model


def presence(rows: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """Rows of each label that hold each cell."""
    seen, flag = np.zeros((2, CELLS), np.int64), np.zeros(CELLS, bool)
    for r, label in zip(rows, y, strict=True):
        flag[:] = False
        flag[r.ravel()] = True
        seen[int(label)] += flag
    return seen


def train(rows: list[np.ndarray], y: np.ndarray, epochs: int = 6, batch: int = 64, rate: float = 0.01,
          seed: int = 3) -> TextCnn:
    """Fit the network on the word cells of each text (one array a text) in one place."""
    n1 = float(y.sum())
    model = start(presence(rows, y), len(y) - n1, n1, seed)
    if 0 < n1 < len(y):
        improve(model, rows, y, (len(y) - n1) / n1, epochs, batch, rate, seed)
    return model


def improve(model: TextCnn, rows: list[np.ndarray], y: np.ndarray, ratio: float, epochs: int, batch: int = 64,
            rate: float = 0.01, seed=3) -> np.ndarray:
    """Train ``model`` further on some texts; ``ratio`` is the number of rows of label 0 for each of label 1.

    Returns the number of batches that moved each cell.
    """
    rng = np.random.default_rng(seed)
    n_out = FILTERS * len(WIDTHS)
    moved = np.zeros(CELLS, np.int64)
    params = [model.table, *model.filters, model.bias]
    steps = [Adam(p.shape, rate) for p in params]
    out_step, base = Adam(n_out, rate), np.array([model.base])
    base_step = Adam(1, rate)
    weight = np.where(y > 0, min(5.0, ratio), 1.0)
    size = np.array([len(r) for r in rows], np.int64)
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for part in (order[a:b][lo:hi] for a, b in _ranges(len(order), batch)
                     for lo, hi in byte_chunks(_bounds(size[order[a:b]]), BATCH_WORDS)):
            bounds = _bounds(size[part])
            if bounds[-1] < max(WIDTHS):
                continue
            c = np.concatenate([rows[i] for i in part]).astype(np.int32)
            e = model.embed(c)
            best, at = model.pooled(e, bounds, where=True)
            p = 1 / (1 + np.exp(-np.clip(best @ model.out + base[0], -30, 30)))
            d = (p - y[part]) * weight[part] / len(part)
            d_best = np.outer(d, model.out).astype(np.float32)
            g_table = np.zeros_like(model.table)
            g_bias = np.zeros_like(model.bias)
            g_filters = [np.zeros_like(f) for f in model.filters]
            r, col = np.nonzero(at >= 0)
            word, grad = at[r, col], d_best[r, col]
            np.add.at(g_bias, col, grad)
            for i, f in enumerate(model.filters):
                own = (col // FILTERS) == i
                k, wd, g = col[own] % FILTERS, word[own], grad[own]
                for j in range(len(f)):
                    np.add.at(g_filters[i][j].T, k, g[:, None] * e[wd + j])
                    g_word = g[:, None] * f[j].T[k]
                    for q in range(c.shape[1]):
                        np.add.at(g_table, c[wd + j, q], g_word)
            g_table[0] = 0
            moved += g_table.any(1)
            for s, prm, g in zip(steps, params, [g_table, *g_filters, g_bias], strict=True):
                s.step(prm, g)
            model.table[0] = 0
            out_step.step(model.out, best.T.astype(np.float64) @ d + 1e-4 * model.out)
            base_step.step(base, np.array([d.sum()]))
    model.base = float(base[0])
    return moved


def _bounds(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)


def _ranges(n: int, step: int) -> Iterator[tuple[int, int]]:
    return ((lo, min(lo + step, n)) for lo in range(0, n, step))


def calibrate(lang: np.ndarray, margin: np.ndarray, clean: np.ndarray, toxic: np.ndarray, n_langs: int,
              prior: float = 20.0) -> np.ndarray:
    """Margin with the fewest training errors for each language, drawn towards that of all rows where rows are few.

    The arrays hold the number of rows of each label for each language and margin.
    """
    def cut(here):
        level, at = np.unique(margin[here], return_inverse=True)
        t0, t1 = (np.bincount(at, n[here], len(level)) for n in (clean, toxic))
        if not t0.sum() or not t1.sum():
            return None
        # errors if everything from position i on is called toxic
        errors = np.concatenate([[0], np.cumsum(t1)]) + np.concatenate([np.cumsum(t0[::-1])[::-1], [0]])
        low = np.flatnonzero(errors == errors.min())
        i = int(low[len(low) // 2])
        left = level[i - 1] if i else level[0] - 1
        right = level[i] if i < len(level) else level[-1] + 1
        return float((left + right) / 2)

    overall = cut(np.full(len(margin), True))
    shift = np.full(n_langs + 1, 0.0 if overall is None else overall)
    for k in range(n_langs):
        own = cut(lang == k)
        if own is not None:
            n = float(toxic[lang == k].sum())
            shift[k] = (own * n + shift[-1] * prior) / (n + prior)
    return shift


def labelled(docs: DataFrame, labels: DataFrame, usable: Callable[[Column], Column]) -> DataFrame:
    """``doc_id, text, lang, y`` of every labelled document that may be learned from."""
    known = (labels.select(F.col("doc_id").cast("long").alias("_id"), (F.col("toxic").cast("int") > 0).cast("int").alias("y"))
             .where(F.col("_id").isNotNull() & F.col("y").isNotNull() & usable(F.col("_id")))
             .groupBy("_id").agg(F.max("y").alias("y")))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lower(F.col("text").cast("string")).alias("text"),
                        F.col("lang").cast("string").alias("lang")).where(usable(F.col("doc_id")))
    if known.count() <= BROADCAST_IDS:
        known = F.broadcast(known)
    return texts.join(known, F.col("doc_id") == F.col("_id")).drop("_id")


def training_units(rows: DataFrame, unit_rows: int) -> DataFrame:
    """The words of all ``rows``, one row for each unit that is trained on in one go.

    Units depend on the rows alone: a hash of the id picks the block, a block's rows come in a fixed order.  A unit lists
    its different words' cells once (``vocabulary``), and for each word of its texts the place there (``ids``).
    """
    def run(batches):
        block, piece, held, words = None, 0, [], 0

        def unit():
            y, lang, c, h = zip(*held, strict=True)
            size = np.array([len(x) for x in h], "<i8")
            _, first, ids = np.unique(np.concatenate(h), return_index=True, return_inverse=True)
            vocabulary = np.concatenate(c)[first]
            return pa.RecordBatch.from_arrays(
                [pa.array([block], pa.int64()), pa.array([piece], pa.int32()), pa.array([bytes(y)], pa.binary()),
                 pa.array([list(lang)], pa.list_(pa.string())), pa.array([size.tobytes()], pa.binary()),
                 pa.array([vocabulary.tobytes()], pa.binary()), pa.array([ids.astype(_id_type(len(first))).tobytes()], pa.binary())],
                ["block", "piece", "y", "lang", "size", "vocabulary", "ids"])

        for part, data, offsets in text_chunks(batches, "text"):
            w = Words(data, offsets)
            c = np.column_stack([cells(w), profile_cells(w)]).astype("<u2")
            col = [part.column(part.schema.get_field_index(n)).to_pylist() for n in ("block", "y", "lang")]
            for i, (b, y, lang) in enumerate(zip(*col, strict=True)):
                lo, hi = w.bounds[i], w.bounds[i + 1]
                if held and (b != block or len(held) == unit_rows or words + hi - lo > UNIT_WORDS):
                    yield unit()
                    held, words, piece = [], 0, piece + 1
                if b != block:
                    block, piece = b, 0
                held.append((y, lang, c[lo:hi], w.hash[lo:hi]))
                words += hi - lo
        if held:
            yield unit()

    n_blocks = max(1, -(-rows.count() // unit_rows))
    rows = rows.withColumn("hash", F.xxhash64("doc_id")).withColumn("block", F.pmod("hash", F.lit(n_blocks)))
    rows = rows.repartition("block").sortWithinPartitions("block", "hash", "doc_id", "text", "lang")
    return stored(map_arrow(rows, run, "block long, piece int, y binary, lang array<string>, size binary, "
                                       "vocabulary binary, ids binary"), "toxicity")


def _id_type(n: int) -> str:
    return "<u2" if n <= 1 << 16 else "<u4"


@dataclass
class Unit:
    key: tuple[int, int]
    y: np.ndarray
    lang: list[str | None]
    bounds: np.ndarray
    cells: np.ndarray
    words: np.ndarray

    def rows(self) -> list[np.ndarray]:
        return [self.cells[a:b] for a, b in zip(self.bounds[:-1], self.bounds[1:], strict=True)]


def opened(batches) -> Iterator[Unit]:
    for batch in batches:
        for i in range(batch.num_rows):
            r = batch.slice(i, 1).to_pylist()[0]
            words = np.frombuffer(r["vocabulary"], "<u2").reshape(-1, 2 + len(PREFIXES))
            words = words[np.frombuffer(r["ids"], _id_type(len(words)))]
            yield Unit((r["block"], r["piece"]), np.frombuffer(r["y"], np.uint8).astype(np.float64), r["lang"],
                       _bounds(np.frombuffer(r["size"], "<i8")), words[:, :-1], words[:, -1])


def _counted(units: DataFrame) -> tuple[np.ndarray, np.ndarray, list[str], np.ndarray]:
    """Over all units: rows of each label, those that hold each cell, the languages and the log odds of their words."""
    def run(batches):
        n, seen, profile = np.zeros(2, np.int64), np.zeros((2, CELLS), np.int64), {}
        for u in opened(batches):
            n += np.bincount(u.y.astype(np.int64), minlength=2)
            seen += presence(u.rows(), u.y)
            for lang, a, b in zip(u.lang, u.bounds[:-1], u.bounds[1:], strict=True):
                if lang is not None:
                    profile.setdefault(lang, np.zeros(PROFILE, np.int64))
                    profile[lang] += np.bincount(u.words[a:b], minlength=PROFILE)
        for kind, lang, counts in [(0, None, n), (1, None, seen.ravel()), *[(2, x, p) for x, p in profile.items()]]:
            # A language stays known if none of its texts has a word.
            at = np.flatnonzero(counts) if kind < 2 else np.arange(PROFILE)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(at), kind, np.int32)), pa.array([lang] * len(at), pa.string()), pa.array(at),
                 pa.array(counts[at])], ["kind", "lang", "cell", "n"])

    got = map_arrow(units, run, "kind int, lang string, cell long, n long")
    got = got.groupBy("kind", "lang", "cell").agg(F.sum("n").alias("n")).toArrow().to_pydict()
    n, seen = np.zeros(2), np.zeros(2 * CELLS)
    langs = sorted({x for x in got["lang"] if x is not None})
    place = {x: i for i, x in enumerate(langs)}
    words = np.ones((PROFILE, len(langs)))
    for kind, lang, cell, count in zip(got["kind"], got["lang"], got["cell"], got["n"], strict=True):
        if kind == 2:
            words[cell, place[lang]] += count
        else:
            (seen if kind else n)[cell] = count
    return n, seen.reshape(2, CELLS), langs, np.log(words / words.sum(0)).astype(np.float32)


def _round(units: DataFrame, model: TextCnn, ratio: float, number: int) -> None:
    """One round: every unit trains ``model`` by itself, which then takes the weighted mean of their changes."""
    shared = units.sparkSession.sparkContext.broadcast(model)
    columns = [f"d{i}" for i in range(SIZE)]

    def run(batches):
        for u in opened(batches):
            own = deepcopy(shared.value)
            before = own.packed()
            moved = improve(own, u.rows(), u.y, ratio, EPOCHS, seed=[3, number, *u.key])
            weight = np.concatenate([moved, np.full(len(before) - CELLS, len(u.y))])
            at = np.flatnonzero(weight)
            change = np.rint((own.packed() - before)[at] * weight[at, None] * CHANGE).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(weight[at]), *[pa.array(x) for x in change.T.copy()]],
                                             ["cell", "weight", *columns])

    got = map_arrow(units, run, ", ".join(f"{c} long" for c in ["cell", "weight", *columns]))
    got = got.groupBy("cell").agg(F.sum("weight").alias("weight"), *[F.sum(c).alias(c) for c in columns]).toArrow()
    change = np.stack([got[c].to_numpy() for c in columns], 1) / CHANGE / got["weight"].to_numpy()[:, None]
    rows = model.packed()
    rows[got["cell"].to_numpy()] += change
    model.unpack(rows)


def _margins(units: DataFrame, model: TextCnn) -> tuple[np.ndarray, ...]:
    """Languages, margins and the number of rows of each label at them, over all units; margins in steps."""
    shared = units.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for u in opened(batches):
            for lo, hi in byte_chunks(u.bounds, BATCH_WORDS):
                a, b = u.bounds[lo], u.bounds[hi]
                bounds = u.bounds[lo:hi + 1] - a
                best, _ = shared.value.pooled(shared.value.embed(u.cells[a:b]), bounds)
                margin = np.clip(best.astype(np.float64) @ shared.value.out + shared.value.base, -30, 30)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(shared.value.languages_of(u.words[a:b], bounds)),
                     pa.array(np.rint(margin * STEPS).astype(np.int64)), pa.array(u.y[lo:hi].astype(np.int64))],
                    ["lang", "step", "y"])

    got = map_arrow(units, run, "lang long, step long, y long").groupBy("lang", "step").agg(
        F.sum(1 - F.col("y")).alias("clean"), F.sum("y").alias("toxic")).toArrow()
    lang, step, clean, toxic = (got[c].to_numpy() for c in ("lang", "step", "clean", "toxic"))
    return lang, step / STEPS, clean, toxic


def fit(docs: DataFrame, labels: DataFrame, usable: Callable[[Column], Column], unit_rows: int = 4_000) -> TextCnn:
    """Train on every usable labelled document; sums over all of them reach the driver, no rows."""
    units = training_units(labelled(docs, labels, usable), unit_rows)
    (n0, n1), seen, langs, profile = _counted(units)
    model = start(seen, n0, n1)
    model.langs, model.profile, model.shift = langs, profile, np.zeros(len(langs) + 1)
    if n0 and n1:
        for number in range(ROUNDS):
            _round(units, model, n0 / n1, number)
        model.shift = calibrate(*_margins(units, model), len(langs))
    return model


def toxicity_scores(docs: DataFrame, labels: DataFrame, held_out: Callable[[Column], Column],
                    threshold: float = 0.5, unit_rows: int = 4_000) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document; learns only where ``held_out`` is false."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, lambda c: ~held_out(c), unit_rows))

    def run(batches):
        for part, data, offsets in text_chunks(batches, "text"):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(model.value.score(Words(data, offsets)))],
                                             ["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lower(F.col("text").cast("string")).alias("text"))
    rows = map_arrow(rows, run, "doc_id long, score double")
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                       (F.col("score") >= threshold).cast("int").alias("predicted"))
