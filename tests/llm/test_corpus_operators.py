"""Joins, decontamination, sharding, mixing, token files and the pipeline against brute force."""

import collections
import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from llm_fixtures import SF_SMALL, edge_docs, no_docs  # noqa: F401
from pyspark.sql import functions as F

from mediafold.llm import decontaminate, minhash_join, mixing, sharding, token_files
from mediafold.llm.common import connected_components
from mediafold.sources.tables import load

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FOLD = {c: c + 32 for c in range(65, 91)}


def words(text):
    return WORD.findall((text or "").translate(FOLD))


def make(spark, texts):
    return spark.createDataFrame([(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)],
                                 "doc_id long, text string, lang string, source string, n_chars long")


# ------------------------------------------------------------------ joins
def brute_classes(rows, threshold):
    seqs = [tuple(words(t)) for _, t in rows]
    sets = {s: {s[i:i + 5] for i in range(len(s) - 4)} if len(s) >= 5 else {s} for s in seqs if s}
    root, links = {s: s for s in sets}, collections.Counter()

    def find(s):
        while root[s] != s:
            s = root[s]
        return s

    keys = list(sets)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            both = len(sets[a] & sets[b])
            if both >= threshold * (len(sets[a]) + len(sets[b]) - both) - 1e-9:
                links[a] += 1
                links[b] += 1
                root[find(a)] = find(b)
    low = {}
    for (i, _), s in zip(rows, seqs, strict=True):
        if s:
            low[find(s)] = min(low.get(find(s), i), i)
    return sorted((i, low[find(s)] if s else i, links[s] if s else 0) for (i, _), s in zip(rows, seqs, strict=True))


def near_copies(rng, base, n, edits):
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.integers(0, edits + 1)):
            w[rng.integers(len(w))] = f"new{rng.integers(10_000)}"
        out.append(" ".join(w))
    return out


@pytest.fixture(scope="module")
def grouped(spark):
    rng = np.random.default_rng(5)
    texts = []
    for g in range(6):
        texts += near_copies(rng, [f"g{g}w{rng.integers(400)}" for _ in range(90)], 25, 6)
    texts += [texts[0]] * 10 + [texts[0].upper()] + ["a b c"] * 3 + ["", None, "..."]
    return make(spark, texts)


@pytest.mark.parametrize("block_grams", [400_000, 500])
def test_jaccard_classes_match_all_pairs(grouped, block_grams):
    got = minhash_join.jaccard_classes(grouped, 0.8, block_grams=block_grams)
    got = sorted(map(tuple, got.select("doc_id", "class_id", "n_links").collect()))
    assert got == brute_classes([tuple(r) for r in grouped.select("doc_id", "text").collect()], 0.8)


def test_links_of_common_and_rare_grams():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 60, 40)) for _ in range(300)] + [np.arange(100, 140)] * 3
    h = np.concatenate(sets).astype(np.uint64)
    bounds = np.cumsum([0, *map(len, sets)])
    got = {tuple(p) for p in minhash_join.links(h, bounds, 0.6).tolist()}
    want = set()
    for i, a in enumerate(sets):
        for j in range(i + 1, len(sets)):
            both = len(np.intersect1d(a, sets[j]))
            if both >= 0.6 * (len(a) + len(sets[j]) - both):
                want.add((i, j))
    assert got == want


def test_links_of_a_pair_of_full_blocks_stay_small():
    import tracemalloc
    m = 2 * minhash_join.BLOCK_NODES
    h = np.concatenate([np.append(np.arange(15), 100 + i) for i in range(m)]).astype(np.uint64)
    tracemalloc.start()
    pairs = minhash_join.links(h, np.arange(m + 1) * 16, 0.8, np.arange(m) // minhash_join.BLOCK_NODES)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(pairs) == (m // 2) ** 2 and peak < 250 << 20


def test_a_component_of_many_short_texts(spark, monkeypatch):
    rows, links = [], minhash_join.verify
    monkeypatch.setattr(minhash_join, "verify", lambda members, t: (rows.append(members), links(members, t))[1])
    base = " ".join(f"w{i}" for i in range(19))
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.concat(F.lit(base + " x"), "id").alias("text"))
    got = minhash_join.jaccard_classes(docs, 0.8).groupBy("class_id", "n_links").count().collect()
    assert list(map(tuple, got)) == [(0, 19_999, 20_000)]
    groups = rows[0].groupBy("root", "i", "j").count()
    assert groups.agg(F.max("count")).first()[0] <= 2 * minhash_join.BLOCK_NODES + 2


def test_banding_reaches_the_recall():
    bands, rows = minhash_join.banding(0.8, 0.999)
    assert bands * rows <= 224 and 1 - (1 - 0.8 ** rows) ** bands >= 0.999


def test_classes_of_edge_rows(edge_docs, no_docs):
    got = minhash_join.jaccard_classes(edge_docs).collect()
    assert len(got) == edge_docs.count()
    by_id = {r["doc_id"]: r for r in got if r["doc_id"] is not None}
    assert by_id[4]["class_id"] == by_id[5]["class_id"] == 4 and by_id[5]["n_copies"] == 3
    assert by_id[6]["class_id"] == by_id[7]["class_id"] == 6 and by_id[7]["n_links"] == 1
    assert all(by_id[i]["class_id"] == i and by_id[i]["n_links"] == 0 for i in (0, 1, 2, 3))
    assert minhash_join.jaccard_classes(no_docs).count() == 0
    kept = minhash_join.keep_one(edge_docs, minhash_join.jaccard_classes(edge_docs))
    assert kept.columns == edge_docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == [0, 1, 2, 3, 4, 6, 8] and ids.count(None) == 2


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 130)] + [(7, 7), (300, 200)]
    got = connected_components(spark.createDataFrame(edges, "u long, v long")).collect()
    assert sorted(map(tuple, got)) == sorted([(i, 0) for i in range(41)] + [(i, 100) for i in range(100, 130)]
                                             + [(200, 200), (300, 200)])


# --------------------------------------------------------- decontamination
def brute_hits(docs, items, window=10):
    patterns = collections.defaultdict(set)
    for i, t in items:
        w = words(t)
        for s in range(max(1, len(w) - window + 1)) if w and i is not None else ():
            patterns[tuple(w[s:s + window])].add(str(i))
    out = {}
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for k in set(map(len, patterns)):
            for s in range(len(w) - k + 1):
                if (own := patterns.get(tuple(w[s:s + k]))):
                    hit |= set(range(s, s + k))
                    found |= own
        out[d] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit))
    return out


@pytest.fixture(scope="module")
def benchmark(spark):
    rng = np.random.default_rng(9)
    items = [(i, " ".join(f"b{rng.integers(30)}" for _ in range(n))) for i, n in enumerate([25, 10, 3, 11, 40, 1, 12])]
    items += [(7, None), (8, "..."), (None, "b1 b2 b3"), (1, items[1][1]), (2, "b1, B2 b3"), (11, items[0][1])]
    return spark.createDataFrame(items, "item_id long, text string")


@pytest.fixture(scope="module")
def dirty(spark, benchmark):
    rng = np.random.default_rng(4)
    items = [r["text"] for r in benchmark.collect() if r["text"]]
    texts = []
    for i in range(120):
        w = [f"b{rng.integers(30)}" if rng.random() < 0.7 else f"x{rng.integers(99)}" for _ in range(rng.integers(0, 60))]
        if i % 3 == 0:
            w[rng.integers(len(w) + 1):0] = items[i % len(items)].upper().split()
        texts.append("; ".join(w))
    texts += [" ".join(items), " ".join(items * 3), items[0] + "b1", items[0][:-3], "", None]
    return make(spark, texts)


@pytest.mark.parametrize("blocks", [{}, {"block_items": 3}])
def test_contamination_matches_brute_force(dirty, benchmark, blocks):
    got = {r["doc_id"]: tuple(r)[1:] for r in decontaminate.contamination(dirty, benchmark, **blocks).collect()}
    items = [tuple(r) for r in benchmark.select("item_id", "text").collect()]
    assert got == brute_hits([tuple(r) for r in dirty.select("doc_id", "text").collect()], items)


def test_items_without_an_id_are_searched(spark):
    duckdb = pytest.importorskip("duckdb")
    from mediafold.llm.queries import OP7_SQL
    item = " ".join(f"n{i}" for i in range(14))
    docs = make(spark, [f"x {item} y", "n0 n1 n2", "b1 b2 b3 x", None, f"{item} b1 b2 b3"])
    items = spark.createDataFrame([(None, item), (3, "b1 b2 b3"), (None, None)], "item_id long, text string")
    db = duckdb.connect()
    db.register("documents", docs.toArrow())
    db.register("benchmark", items.toArrow())
    rule = {r[0]: r[1:] for r in db.execute(OP7_SQL).fetchall()}
    got = {r["doc_id"]: tuple(r)[1:] for r in decontaminate.contamination(docs, items).collect()}
    # All but n_items: the SQL counts the missing name as an item.
    assert {i: (*r[:2], *r[3:]) for i, r in got.items()} == {i: (*r[:2], *r[3:]) for i, r in rule.items()}
    assert [got[i][1] for i in range(5)] == [14, 0, 3, 0, 17] and [got[i][2] for i in range(5)] == [0, 0, 1, 0, 1]
    left = {r["doc_id"]: r["text"] for r in decontaminate.remove_spans(docs, items).collect()}
    assert left == {0: "x y", 1: "n0 n1 n2", 2: "x", 3: None}


def test_cut_texts_are_clean_and_the_rest_is_untouched(dirty, benchmark):
    before = {r["doc_id"]: r for r in dirty.collect()}
    state = {r["doc_id"]: r for r in decontaminate.contamination(dirty, benchmark).collect()}
    after = {r["doc_id"]: r for r in decontaminate.remove_spans(dirty, benchmark).collect()}
    for i, r in before.items():
        if not state[i]["contaminated"]:
            assert after[i] == r
        elif state[i]["n_hit"] == state[i]["n_words"]:
            assert i not in after
        else:
            assert len(words(after[i]["text"])) == state[i]["n_words"] - state[i]["n_hit"]
            assert after[i]["n_chars"] == len(after[i]["text"])


def test_decontamination_edge_rows(edge_docs, no_docs, benchmark):
    assert decontaminate.contamination(edge_docs, benchmark).count() == edge_docs.count()
    assert decontaminate.contamination(no_docs, benchmark).count() == 0
    clean = decontaminate.contamination(edge_docs, benchmark.limit(0)).collect()
    assert len(clean) == edge_docs.count() and not any(r["contaminated"] for r in clean)
    assert sorted(map(str, decontaminate.remove_spans(edge_docs, benchmark).collect())) == sorted(
        map(str, edge_docs.collect()))


def test_suffix_array_and_index():
    rng = np.random.default_rng(3)
    runs = [rng.integers(1, 4, rng.integers(1, 30)) for _ in range(40)] + [np.ones(50, int), np.ones(50, int)]
    text = np.concatenate([np.append(r, 0) for r in runs])
    index = decontaminate.FmIndex(text, 3)
    patterns = np.array([[0, 1, 2], [1, 1, 1], [0, 0, 3], [3, 2, 1]])
    lengths = np.array([2, 3, 1, 3])
    lo, hi = index.search(patterns, lengths)
    for p, n, a, b in zip(patterns, lengths, lo, hi, strict=True):
        p = p[3 - n:].tolist()
        want = [i for i in range(len(text) - n + 1) if text[i:i + n].tolist() == p]
        assert sorted(index.locate(np.arange(a, b)).tolist()) == want


# ----------------------------------------------------- sharding and mixing
def check_shards(rows, n_docs, n_shards):
    assert len(rows) == n_docs
    by_shard = collections.defaultdict(list)
    for r in rows:
        assert r["law"] == "bytes" and r["grown_shard"] is None and 0 <= r["shard"] < n_shards
        by_shard[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in by_shard.values())


def test_shards_are_even_and_keep_copies_together(spark):
    docs = load(spark, "/root/testdata/sf0.1", "documents")
    rows = sharding.kd_shards(docs, 8).collect()
    check_shards(rows, docs.count(), 8)
    size = collections.Counter()
    where = collections.defaultdict(set)
    crc = collections.defaultdict(set)
    for r in rows:
        size[r["shard"]] += r["size"]
        where[r["text_crc32"]].add(r["shard"])
    mean = sum(size.values()) / 8
    assert max(size.values()) < 1.03 * mean and min(size.values()) > 0.97 * mean
    for r in docs.select("doc_id", "text").limit(200).collect():
        crc[zlib.crc32(r["text"].encode())].add(r["doc_id"])
    assert set(crc) <= set(where) and max(map(len, where.values())) <= 2


def test_sharding_edge_rows(spark, edge_docs, no_docs):
    rows = sharding.kd_shards(edge_docs, 5).collect()
    check_shards(rows, edge_docs.count(), 5)
    null = [r for r in rows if r["doc_id"] == 0]
    assert (null[0]["size"], null[0]["text_crc32"]) == (16, 0)
    assert sharding.kd_shards(no_docs, 5).count() == 0
    same = make(spark, ["one text"] * 500)
    rows = sharding.kd_shards(same, 4).collect()  # one group of copies: dealt by id
    check_shards(rows, 500, 4)
    assert max(collections.Counter(r["shard"] for r in rows).values()) < 140


def test_pfair_period_keeps_every_source_within_a_block():
    for share in ([1], [1, 1, 1], [700, 200, 99, 1], [5, 3, 2], [333, 333, 334]):
        slots, period = mixing.pfair_period(share), sum(share)
        assert sorted(t for s in slots for t in s) == list(range(period))
        for a, s in zip(share, slots, strict=True):
            assert all(j * period // a <= t < -(-(j + 1) * period // a) for j, t in enumerate(s))


@pytest.mark.parametrize("weights", [[0.5] + [0.5 / 19] * 19, [0.9] + [0.1 / 99] * 99, [1e-7, 0.3, 0.7], [0.0, 3.0, 1.0]])
def test_no_source_lags_a_block_behind_its_weight(weights):
    blocks = [int(20_000 * w / sum(weights)) + 7 for w in weights]
    left = list(blocks)
    end, rows = 0, list(mixing.phases(blocks, weights, 1000))
    for s, first, _, slots in rows:
        assert first == blocks[s] - left[s]
        left[s] -= len(slots)
    assert not any(left) and sorted(t for *_, p in rows for t in p) == list(range(sum(blocks)))
    for phase in range(rows[-1][2] + 1):
        own = [(s, p) for s, _, n, p in rows if n == phase]
        total, base = sum(weights[s] for s, _ in own), end
        end += sum(len(p) for _, p in own)
        for s, p in own:
            w = weights[s] / total if total else 1 / len(own)
            ahead = [j + 1 - (t + 1 - base) * w for j, t in enumerate(p)]
            behind = [(t - base) * w - j for j, t in enumerate([*p, end])]
            assert max(ahead + behind) < 1.001


def test_runs_of_slots_are_whole():
    got = list(mixing.runs(1000, list(range(3000))))
    assert [t for *_, p in got for t in p] == list(range(3000))
    assert [r[:3] for r in got] == [(0, 1000, 1024), (1, 1024, 2048), (2, 2048, 3072), (3, 3072, 4000)]


def test_mixing_follows_the_weights_and_keeps_all(spark):
    docs = load(spark, "/root/testdata/sf0.01", "documents")
    rows = mixing.pfair_mix(docs, weights={"src0": 1.0, "src1": 1.0, "src2": 2.0}, block_bytes=4096).orderBy("position")
    rows = rows.collect()
    assert [r["position"] for r in rows] == list(range(docs.count()))
    blocks = collections.Counter()
    seen = set()
    for r in rows:
        if r["phase"] == 0 and (r["source"], r["block"]) not in seen:
            seen.add((r["source"], r["block"]))
            blocks[r["source"]] += 1
            slots = r["slot"] + 1
            if r["source"] in ("src0", "src1"):
                assert abs(r["block"] - slots * 0.25) < 2
            if r["source"] == "src2":
                assert abs(r["block"] - slots * 0.5) < 2
    assert blocks["src2"] > 0


def test_mixing_edge_rows(edge_docs, no_docs):
    placed = mixing.pfair_mix(edge_docs, block_bytes=64)
    assert sorted(r["position"] for r in placed.collect()) == list(range(edge_docs.count()))
    mixed = mixing.in_mixed_order(edge_docs, placed)
    assert mixed.columns == edge_docs.columns
    assert sorted(map(str, mixed.collect())) == sorted(map(str, edge_docs.collect()))
    assert mixing.pfair_mix(no_docs).count() == 0
    assert mixing.in_mixed_order(no_docs, mixing.pfair_mix(no_docs)).count() == 0


# ------------------------------------------------------------- token files
def test_packing_round_trip():
    rng = np.random.default_rng(8)
    for n in (0, 1, 3, 4, 1000):
        v = (rng.integers(0, 1 << 32, n) >> rng.integers(0, 33, n)).astype(np.uint32)
        control, data = token_files.pack(v)
        assert len(control) == -(-n // 4)
        assert (token_files.unpack(control, data, n) == v).all()
    content = token_files.file_bytes([None, 5], np.array([1, 2]), np.array([7, 300, 70_000]))
    ids, counts, ranks = token_files.parse_file(content)
    assert (ids, counts.tolist(), ranks.tolist()) == ([None, 5], [1, 2], [7, 300, 70_000])
    with pytest.raises(ValueError):
        token_files.parse_file(content[:-1] + b"x")


def tokenizer():
    from tokenizers import Tokenizer
    public = pytest.importorskip("public_tokenizers")
    path = public.path("word_bpe_49k.json")
    return path, Tokenizer.from_file(path)


def test_pieces_give_the_ids_of_the_whole_text():
    import random
    path, t = tokenizer()
    e = token_files.PieceEncoder(path)
    random.seed(2)
    letters = list("aAbÉé.,'! \n\t1²½<|>ßſ́中 -_\"s")
    texts = ["".join(random.choice(letters) for _ in range(random.randint(0, 40))) for _ in range(400)]
    texts += ["<|endoftext|> a.", "don't.'s,x's", "x́. ́y Ω Σας ΣΑΣ", "", "日本語。 ", "A.B,c!?x 12.5% $$$&&"]
    ids, counts = e.encode(pa.array(texts))
    at = np.cumsum(counts) - counts
    for text, a, n in zip(texts, at, counts, strict=True):
        assert ids[a:a + n].tolist() == t.encode(text, add_special_tokens=False).ids, text


def test_token_files_round_trip(spark):
    path, t = tokenizer()
    docs = load(spark, SF_SMALL, "documents")
    got = {r["doc_id"]: r for r in token_files.token_files(docs, path).collect()}
    start = 0
    for r in sorted(docs.collect(), key=lambda r: r["doc_id"]):
        ids = np.array([*t.encode(r["text"], add_special_tokens=False).ids, 1], "<u4")
        assert tuple(got[r["doc_id"]])[1:] == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_token_files_edge_rows(edge_docs, no_docs):
    path, _ = tokenizer()
    rows = token_files.token_files(edge_docs, path).collect()
    assert len(rows) == edge_docs.count()
    assert sum(r["n_tokens"] for r in rows if r["doc_id"] in (0, 1, 2)) == 3
    spans = sorted((r["start"], r["n_tokens"]) for r in rows)
    assert [a for a, _ in spans] == np.cumsum([0, *[n for _, n in spans]])[:-1].tolist()
    assert all(r["start"] <= 1000 for r in rows if r["doc_id"] is None)  # a NULL id sorts first
    assert token_files.token_files(no_docs, path).count() == 0


# ---------------------------------------------------------------- pipeline
def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline as pipeline
    sf = "/root/testdata/sf0.01"
    docs = load(spark, sf, "documents")
    columns, seen = docs.columns, [docs.count()]
    for i, (_, stage) in enumerate(pipeline.STAGES):
        before = docs
        stage(spark, docs, sf).write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        seen.append(docs.count())
        if i < 4:
            assert docs.columns == columns
        if i == 0:
            bad = load(spark, sf, "labels").where("quality = 0").join(before, "doc_id")
            good = load(spark, sf, "labels").where("quality = 1").join(before, "doc_id")
            assert bad.join(docs, "doc_id", "left_semi").count() <= 0.05 * bad.count()
            assert good.join(docs, "doc_id", "left_anti").count() <= 0.03 * good.count()
        if i == 1:
            classes = brute_classes_of(before)
            left = {r["doc_id"] for r in docs.select("doc_id").collect()}
            assert all(len(left & set(c)) == 1 for c in classes.values())
        if i == 2:
            bench = load(spark, sf, "benchmark")
            dirty = decontaminate.contamination(docs, bench).where("contaminated").count()
            assert dirty == 0 and decontaminate.contamination(before, bench).where("contaminated").count() > 0
        if i == 3:
            assert docs.exceptAll(before).count() == 0 and before.exceptAll(docs).count() == 0
    assert seen[0] > seen[1] > seen[2] >= seen[3] == seen[4] == seen[5]
    assert docs.select(F.countDistinct("shard")).first()[0] == 40


CLASHES = ["_quality", "_quality_score", "_spans", "_bytes", "_items", "_n_words", "_cut", "_id", "_of", "_doc", "_hash",
           "_position", "extra_0", "extra_5", "score", "shard", "slot"]


def test_pipeline_stages_keep_columns_of_any_name(spark):
    import corpus_pipeline as pipeline
    sf = "/root/testdata/sf0.001"
    plain = load(spark, sf, "documents")
    docs = plain.select("*", *[F.concat(F.lit(f"{c}:"), F.col("doc_id").cast("string")).alias(c) for c in CLASHES])
    for name, stage in pipeline.STAGES[:4]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns, name
        rows = out.collect()
        assert rows and all(r[c] == f"{c}:{r['doc_id']}" for r in rows for c in CLASHES), name
    assert pipeline.deal_shards(spark, docs, sf).count() == docs.count()


def test_pipeline_stages_of_an_empty_table(spark):
    import corpus_pipeline as pipeline
    sf = "/root/testdata/sf0.001"
    none = load(spark, sf, "documents").limit(0)
    for i, (name, stage) in enumerate(pipeline.STAGES):
        out = stage(spark, none, sf)
        assert out.count() == 0 and (i == 4 or out.columns == none.columns), name


def test_slots_of_the_pipeline_follow_the_mixed_order(spark):
    import corpus_pipeline as pipeline
    sf = "/root/testdata/sf0.01"
    docs = load(spark, sf, "documents").dropDuplicates(["doc_id"])
    at = {r["doc_id"]: r["position"] for r in mixing.pfair_mix(docs).collect()}
    rows = pipeline.deal_shards(spark, pipeline.mix_sources(spark, docs, sf), sf).collect()
    check_shards(rows, docs.count(), 40)
    by_shard = collections.defaultdict(list)
    for r in sorted(rows, key=lambda r: (r["shard"], r["slot"])):
        by_shard[r["shard"]].append(at[r["doc_id"]])
    assert all(p == sorted(p) for p in by_shard.values())
    plain = {(r["doc_id"], r["shard"]) for r in sharding.kd_shards(docs, 40).collect()}
    assert {(r["doc_id"], r["shard"]) for r in rows} == plain


def test_slots_by_place_keep_edge_rows(edge_docs, no_docs):
    rows = sharding.kd_shards(edge_docs, 5, placed=mixing.pfair_mix(edge_docs, block_bytes=64)).collect()
    check_shards(rows, edge_docs.count(), 5)
    assert sharding.kd_shards(no_docs, 5, placed=mixing.pfair_mix(no_docs)).count() == 0


def brute_classes_of(df):
    """Classes through shared n-grams only (all pairs that share one)."""
    rows = [(r["doc_id"], tuple(words(r["text"]))) for r in df.collect()]
    sets = {s: {s[i:i + 5] for i in range(len(s) - 4)} if len(s) >= 5 else {s} for _, s in rows if s}
    at = collections.defaultdict(list)
    for s, grams in sets.items():
        for g in grams:
            at[g].append(s)
    both = collections.Counter((a, b) for own in at.values() for i, a in enumerate(own) for b in own[:i])
    root = {s: s for s in sets}

    def find(s):
        while root[s] != s:
            s = root[s]
        return s

    for (a, b), n in both.items():
        if n >= 0.8 * (len(sets[a]) + len(sets[b]) - n) - 1e-9:
            root[find(a)] = find(b)
    out = collections.defaultdict(list)
    for i, s in rows:
        out[find(s) if s else i].append(i)
    return out
