"""Quality, language and toxicity: held-out accuracy, edge cases, training rows only."""

import numpy as np
import pytest
from llm_fixtures import SF_SMALL, edge_docs, labels, no_docs  # noqa: F401
from pyspark.sql import functions as F

from mediafold.llm import langid, quality, toxicity
from mediafold.llm.common import Words, held_out, word_hash
from mediafold.sources.tables import load

SF = "/root/testdata/sf0.01"


def test_words_match_a_plain_scan():
    import re
    texts = ["Ab cD,e1", "", "x", "été  ÉTÉ", "a-b_c", "tail "]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.cumsum([0, *[len(t.encode()) for t in texts]])
    w = Words(data, offsets)
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    fold = {c: c + 32 for c in range(65, 91)}
    want = [[m.translate(fold) for m in pattern.findall(t)] for t in texts]
    assert w.counts.tolist() == [len(x) for x in want]
    assert [int(h) for h in w.hash] == [word_hash(x) for r in want for x in r]


@pytest.fixture(scope="module")
def tables(spark):
    return load(spark, SF, "documents"), load(spark, SF, "labels")


def _accuracy(scores, labels, name):
    rows = scores.join(labels, "doc_id").where("held_out").select("score", name).collect()
    y, s = np.array([r[1] for r in rows]), np.array([r[0] for r in rows])
    return ((s >= 0.5) == (y == 1)).mean()


def test_quality_on_held_out_rows(tables):
    docs, labels = tables
    got = quality.quality_scores(docs, labels, lambda c: held_out(c, 4, 2)).cache()
    assert got.count() == docs.count()
    assert _accuracy(got, labels, "quality") > 0.93


def test_toxicity_on_held_out_rows(tables):
    docs, labels = tables
    got = toxicity.toxicity_scores(docs, labels, lambda c: held_out(c, 5, 0)).cache()
    assert got.count() == docs.count()
    assert _accuracy(got, labels, "toxic") > 0.93


def test_language_on_held_out_rows(tables):
    docs, _ = tables
    got = langid.predict_languages(docs, lambda c: held_out(c, 3, 1))
    hit = got.join(docs, "doc_id").where("held_out").agg(F.avg((F.col("lang_pred") == F.col("lang")).cast("int")))
    assert hit.first()[0] > 0.98


def test_held_out_labels_are_not_learned(spark):
    docs, labels = load(spark, SF_SMALL, "documents"), load(spark, SF_SMALL, "labels")
    out = held_out(F.col("doc_id"), 4, 2)
    flipped = labels.withColumn("quality", F.when(out, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (sorted(map(tuple, quality.quality_scores(docs, x, lambda c: held_out(c, 4, 2)).collect()))
            for x in (labels, flipped))
    assert a == b


@pytest.mark.parametrize("fn,column", [(quality.quality_scores, "quality"), (toxicity.toxicity_scores, "toxic")])
def test_scores_of_edge_rows(edge_docs, no_docs, labels, fn, column):
    got = fn(edge_docs, labels, lambda c: held_out(c, 4, 2)).collect()
    assert len(got) == edge_docs.count()
    assert all(0 <= r["score"] <= 1 and r["predicted"] in (0, 1) for r in got)
    assert not any(r["held_out"] for r in got if r["doc_id"] is None)
    twice = [r["score"] for r in got if r["doc_id"] == 5]
    assert len(twice) == 2 and twice[0] == twice[1]
    assert fn(no_docs, labels, lambda c: held_out(c, 4, 2)).count() == 0
    assert {r["score"] for r in fn(edge_docs, labels.limit(0), lambda c: held_out(c, 4, 2)).collect()} == {0.5}


def test_language_of_edge_rows(edge_docs, no_docs):
    got = langid.predict_languages(edge_docs, lambda c: F.lit(False)).collect()
    assert len(got) == edge_docs.count()
    for r in got:
        if r["doc_id"] in (0, 1, 2, 3):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
        elif r["doc_id"] is not None:
            assert r["lang_pred"] in ("en", "de") and 0 <= r["score"] <= 1
    assert langid.predict_languages(no_docs, lambda c: F.lit(False)).count() == 0
    untrained = langid.predict_languages(edge_docs, lambda c: F.lit(True)).collect()
    assert {r["lang_pred"] for r in untrained} == {"und"}


def test_additive_model_finds_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.random((4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality.train(x, y, n_pairs=1)
    assert {model.pairs[0][0], model.pairs[0][1]} == {0, 1}
    assert ((model.score(x) > 0.5) == (y > 0.5)).mean() > 0.95


def test_convolution_matches_a_loop():
    rng = np.random.default_rng(1)
    rows = [rng.integers(1, toxicity.CELLS, (n, 1 + len(toxicity.PREFIXES))) for n in (0, 1, 2, 5, 0, 9)]
    model = toxicity.train([r for r in rows if len(r)] * 4, np.array([0.0, 1, 0, 1] * 4), epochs=1)
    c = np.concatenate(rows)
    bounds = np.cumsum([0, *map(len, rows)])
    best, _ = model.pooled(model.embed(c), bounds)
    for r, got in zip(rows, best, strict=True):
        e = model.embed(r) if len(r) else np.zeros((0, toxicity.SIZE))
        for i, f in enumerate(model.filters):
            acts = [sum(e[s + j] @ f[j] for j in range(len(f))) + model.bias[i * toxicity.FILTERS:(i + 1) * toxicity.FILTERS]
                    for s in range(len(r) - len(f) + 1)]
            want = np.maximum(np.max(acts, axis=0), 0) if acts else np.zeros(toxicity.FILTERS)
            assert np.allclose(got[i * toxicity.FILTERS:(i + 1) * toxicity.FILTERS], want, atol=1e-4)


def test_one_hot_text_does_not_fill_the_language_sample(spark):
    import random

    from pyspark.sql import functions as F

    from llm_fixtures import docs_of
    from mediafold.llm import langid
    rng = random.Random(4)
    letters = {"en": "the and of with that from this have", "fr": "les des une dans pour avec que est", "de": "der und nicht ein sich auch auf"}

    def text(lang):
        return " ".join(rng.choice(letters[lang].split()) + rng.choice(["", "s", "er", "en"]) for _ in range(30))
    rows = [(lang, text(lang)) for lang, n in (("en", 400), ("fr", 400), ("de", 40)) for _ in range(n)]
    hot = [("en", "a hot text about nothing at all")] * 6000
    docs = docs_of(spark, [(i, t, lang, "s") for i, (lang, t) in enumerate(hot + rows)])
    got = langid.predict_languages(docs, lambda c: c % 5 == 0, rows_per_lang=60)
    score = got.join(docs.select("doc_id", "lang"), "doc_id").where((F.col("doc_id") >= 6000) & F.col("held_out")).groupBy(
        "lang").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")).alias("right")).collect()
    assert {r["lang"] for r in score} == {"en", "fr", "de"} and all(r["right"] >= 0.95 for r in score)


def test_nearest_centroid_matches_plain_cosines():
    from mediafold.llm import langid
    rng = np.random.default_rng(2)
    counts = rng.poisson(0.4, (60, 64)).astype(np.float32)
    langs = [("a", "b", "c")[i % 3] for i in range(60)]
    model = langid.train(langs, counts, k=2)
    lang, score = model.predict(counts)
    x = np.log(1 + counts) * model.idf
    for i in range(60):
        cosines = [float(x[i] @ c / (np.linalg.norm(x[i]) * np.linalg.norm(c))) for c in model.centroids]
        best = max(cosines)
        assert score[i] == pytest.approx(best, abs=1e-4)
        assert lang[i] in {model.langs[k] for k, v in enumerate(cosines) if v > best - 1e-5}


def _toxic_rows(spark, n, words_per_row=6):
    """Documents with a label each; the language of the row that any sample by id hash would take last is its own."""
    import random

    from llm_fixtures import docs_of
    rng = random.Random(5)
    words = ["stone", "river", "cloud", "paper", "green", "seven", "maple", "candle"]
    last = max(spark.range(n).select("id", F.xxhash64("id")).collect(), key=lambda r: r[1])[0]
    y = [int(rng.random() < 0.2) for _ in range(n)]
    text = [" ".join(rng.choice(words) for _ in range(words_per_row)) + (" rotten" if t else "") for t in y]
    docs = docs_of(spark, [(i, text[i], "xx" if i == last else "en", "s") for i in range(n)])
    labels = spark.createDataFrame([(i, t) for i, t in enumerate(y)], "doc_id long, toxic int")
    return docs, labels


def test_toxicity_learns_from_every_labelled_row(spark):
    docs, labels = _toxic_rows(spark, 6_500)
    model = toxicity.fit(docs, labels, lambda c: F.lit(True))
    assert model.langs == ["en", "xx"]
    got = toxicity.toxicity_scores(docs, labels, lambda c: c < 500).join(labels, "doc_id").where("held_out")
    assert got.where("predicted <> toxic").count() == 0 and got.count() == 500


def test_toxicity_units_hold_each_row_once_and_do_not_depend_on_partitions(spark, monkeypatch):
    docs, labels = _toxic_rows(spark, 300)
    labels = labels.unionByName(labels.withColumn("toxic", F.lit(0)))
    rows = toxicity.labelled(docs, labels, lambda c: c >= 10)
    units = toxicity.training_units(rows, 40)
    found = list(toxicity.opened(units.toArrow().to_batches()))
    assert len(found) >= 8 and max(len(u.y) for u in found) <= 40
    assert sum(len(u.y) for u in found) == 290
    want = sorted(tuple(map(tuple, toxicity.cells(w).tolist())) for w in _words(rows))
    assert sorted(tuple(map(tuple, r.tolist())) for u in found for r in u.rows()) == want
    a = toxicity.fit(docs, labels, lambda c: c >= 10, unit_rows=40)
    monkeypatch.setattr(toxicity, "BROADCAST_IDS", 0)
    b = toxicity.fit(docs.repartition(5), labels.repartition(3), lambda c: c >= 10, unit_rows=40)
    assert np.allclose(a.packed(), b.packed(), atol=1e-5) and np.allclose(a.shift, b.shift, atol=1e-2)


def _words(rows):
    for r in rows.select("text").collect():
        data = np.frombuffer(r[0].encode(), np.uint8)
        yield Words(data, np.array([0, len(data)]))


def test_toxicity_thresholds_have_the_fewest_errors():
    rng = np.random.default_rng(7)
    lang = rng.integers(0, 3, 400)
    margin = np.rint(rng.normal(0, 1, 400) * 8) / 8
    y = (margin + rng.normal(0, 1, 400) > 0.5).astype(int)
    # one entry a row, and one a language and margin: the same thresholds
    shift = toxicity.calibrate(lang, margin, 1 - y, y, 3)
    key, at = np.unique(np.stack([lang, margin], 1), axis=0, return_inverse=True)
    at = at.ravel()
    grouped = toxicity.calibrate(key[:, 0].astype(int), key[:, 1], np.bincount(at, 1 - y), np.bincount(at, y), 3)
    assert np.allclose(shift, grouped)
    cuts = np.append(np.unique(margin) - 1 / 16, margin.max() + 1)
    assert ((margin > shift[3]) != y).sum() == min(((margin > c) != y).sum() for c in cuts)
