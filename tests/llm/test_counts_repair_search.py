"""Token counts, conversation repair and ranked search against the library and brute force."""

import hashlib
import heapq
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from llm_fixtures import EDGE, SF_SMALL, docs_of, edge_docs, no_docs  # noqa: F401

from mediafold.llm import conversation_repair, lexical_search, token_counts
from mediafold.llm.keys import KeyTable, packed_strings
from mediafold.llm.queries import op11_token_counts, op12_conversation_repair, op13_ball_tree_search
from mediafold.sources.tables import load

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")


# ------------------------------------------------------------ token counts
def chunk(texts):
    parts = [t.encode() for t in texts]
    return np.frombuffer(b"".join(parts), np.uint8), np.cumsum([0, *map(len, parts)])


def library_counts(texts):
    tokenizer = token_counts.counter(BYTE_BPE).tokenizer
    return [len(e) for e in tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]


BITS = ["'", "s", "t", "re", "ve", "m", "ll", "d", "'s", "'re", " ", "  ", "\n", "\t", "\r\n", " ", "　", " ",
        "\x85", "\x0b", "\x1c", "a", "é", "日本", "1", "½", "²", "Ⅷ", "٣", "!", "...", "_", "́", "😀", "<|endoftext|>", "<|",
        "|>", "A", "ñ", "​", "﻿", "\x00", "ᄀ", " ", "᠎"]


def test_counts_of_random_strings_match_the_library():
    rng = random.Random(5)
    texts = ["".join(rng.choices(BITS, k=rng.randint(0, 25))) for _ in range(5000)]
    data, offsets = chunk(texts)
    counter = token_counts.PieceCounter(BYTE_BPE)
    some = [b"a", b" a", b"'s", b" ", b"\n", b"...", "日本".encode()]
    table = KeyTable(*packed_strings(some), np.array(counter.lengths(some), np.uint8))
    want = library_counts(texts)
    for tier in (None, table):
        assert counter.count(data, offsets, tier).tolist() == want


def test_long_texts_are_cut_where_pre_tokens_end(spark, monkeypatch):
    rng = random.Random(6)
    texts = ["".join(rng.choices([*BITS, " the", " and", "\n"], k=4000)) for _ in range(6)] + ["x" * 5000, " " * 3000]
    monkeypatch.setattr(token_counts, "CHUNK_BYTES", 100)
    counter = token_counts.PieceCounter(BYTE_BPE)
    for text in texts:
        data, _ = chunk([text])
        cuts = token_counts.parts_of(data, 100)
        got = [counter.count(data[a:b], np.array([0, b - a]), None)[0] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        assert sum(got) == library_counts([text])[0]
    assert len(token_counts.parts_of(chunk([texts[0]])[0], 100)) > 10


def test_a_full_cache_starts_anew(monkeypatch):
    monkeypatch.setattr(token_counts, "MEMO_PIECES", 3)
    counter = token_counts.PieceCounter(BYTE_BPE)
    texts = ["one two three", "two three four five six", "one one", "seven eight nine ten two"]
    for text in texts:
        assert counter.count(*chunk([text]), None).tolist() == library_counts([text])
        assert len(counter.memo) <= 3


def test_other_tokenizers_get_whole_texts(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    counter = token_counts.PieceCounter(path)
    texts = ["Größe été", "", "it's  a <|endoftext|> test"]
    assert not counter.by_pieces
    want = [len(e) for e in counter.tokenizer.encode_batch(texts, add_special_tokens=False)]
    got = token_counts.token_counts(docs_of(spark, [(i, t, None, None) for i, t in enumerate(texts)]), path)
    assert [r.n_tokens for r in got.orderBy("doc_id").collect()] == want


def test_token_counts_of_a_table(spark):
    got = op11_token_counts(spark, SF_SMALL)
    assert got.dtypes == [("doc_id", "bigint"), ("n_bytes", "bigint"), ("n_tokens", "bigint"), ("over_limit", "boolean")]
    rows = load(spark, SF_SMALL, "documents").select("doc_id", "text").collect()
    want = sorted((r.doc_id, len(r.text.encode()), n, n > 512)
                  for r, n in zip(rows, library_counts([r.text for r in rows]), strict=True))
    assert sorted(map(tuple, got.collect())) == want


@pytest.mark.parametrize("keys", [1, 1000])
def test_token_counts_of_edge_rows(edge_docs, no_docs, keys):
    got = token_counts.token_counts(edge_docs, BYTE_BPE, fit_rows=4, table_keys=keys).collect()
    want = [(r[0], len((r[1] or "").encode()), n) for r, n in zip(EDGE, library_counts([r[1] for r in EDGE]), strict=True)]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert token_counts.token_counts(no_docs, BYTE_BPE).collect() == []


def test_key_tables_hold_what_was_put_in():
    rng = np.random.default_rng(1)
    strings = list({rng.integers(0, 3, rng.integers(1, 16), np.uint8).tobytes() for _ in range(5000)})
    kept, others = strings[::2], strings[1::2]
    table = KeyTable(*packed_strings(kept), np.arange(len(kept), dtype=np.int32))
    assert table.find(*packed_strings(kept)).tolist() == list(range(len(kept)))
    assert (table.find(*packed_strings(others)) == -1).all()


# ----------------------------------------------------- conversation repair
LEGAL = re.compile(r"\A(s?(ua)+)?\Z")


def cheapest(initials, faults):
    """Uniform-cost search over all edit lists by (cost, audit)."""
    n, heap, seen = len(initials), [(0, "", 0, "")], set()
    while True:
        cost, audit, i, out = heapq.heappop(heap)
        if i == n and LEGAL.match(out):
            return cost, audit
        if len(out) > 2 * n + 2 or (i, out) in seen:
            continue
        seen.add((i, out))
        for r in "ua":
            heapq.heappush(heap, (cost + 5, audit + "I", i, out + r))
        if i == n:
            continue
        heapq.heappush(heap, (cost + 2, audit + "D", i + 1, out))
        if faults[i] not in (1, 2):
            more = 5 if faults[i] == 3 else 0
            heapq.heappush(heap, (cost + more, audit + "K", i + 1, out + (initials[i] or "?")))
            for r in "ua":
                heapq.heappush(heap, (cost + 1 + more, audit + "R", i + 1, out + r))


def test_cheapest_edits_match_uniform_cost_search():
    rng = random.Random(1)
    for _ in range(1500):
        n = rng.randint(0, 6)
        initials = [rng.choice(["s", "u", "a", "u", "a", "x", ""]) for _ in range(n)]
        faults = [rng.choice([0, 0, 0, 1, 2, 3]) for _ in range(n)]
        assert conversation_repair.cheapest_edits(initials, faults) == cheapest(initials, faults), (initials, faults)


def test_a_long_conversation_is_searched_in_proportion():
    rng = random.Random(2)
    initials = [rng.choice("suax") for _ in range(30_000)]
    faults = [rng.choice([0, 0, 0, 1, 2, 3]) for _ in initials]
    cost, audit = conversation_repair.cheapest_edits(initials, faults)
    out, i, paid = "", 0, 0
    for letter, row, role in conversation_repair.new_roles(initials, audit):
        assert row == i
        paid += {"D": 2, "I": 5, "R": 1, "K": 0}[letter]
        if letter in "KR":
            assert faults[i] not in (1, 2)
            paid += 5 * (faults[i] == 3)
        if letter != "D":
            out += (role or initials[i])[0]
        i += letter != "I"
    assert i == len(initials) and paid == cost and LEGAL.match(out)


BLANKS = " \t\n\x0b\x0c\r"


def repaired_by_hand(conversations, search=cheapest):
    """The contract, row by row: (conv_id, turn, role, text) rows to one tuple per conversation."""
    damaged = {}
    for conv, turn, role, text in conversations:
        rows = damaged.setdefault(conv, [])
        said = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        fate = zlib.crc32(said.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if fate == 1:
            text = ""
        elif fate == 2:
            text = re.sub("[.!?]", "", text)
        elif fate == 4:
            role = "user"
        rows += [(turn, role, text)] * {0: 0, 3: 2}.get(fate, 1)
    out = []
    for conv, rows in damaged.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1],
                                 hashlib.md5(f"{len(r[1].encode())}:{r[1]}{r[2]}".encode()).hexdigest()))
        seen, faults = set(), []
        for _, role, text in rows:
            end = text.rstrip(BLANKS)
            faults.append(1 if not end else 2 if (role, text) in seen else 3 if end[-1] not in ".!?" else 0)
            seen.add((role, text))
        initials = [r[1][:1] for r in rows]
        cost, audit = search(initials, faults)
        kept, state, i = [], "", 0
        for letter in audit:
            due = "user" if state in ("", "s", "a") else "assistant"
            if letter == "I":
                kept.append((due, ""))
            elif letter in "KR":
                kept.append((rows[i][1] if letter == "K" else due, rows[i][2]))
            if letter != "D":
                state = kept[-1][0][0]
            i += letter != "I"
        turns = [r[0] for r in rows if r[0] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
        sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest()
        out.append((conv, gaps, faults.count(1), faults.count(2), faults.count(3), illegal, cost, audit, sha))
    return sorted(out, key=str)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_repair_of_a_table(spark, sf):
    folder = f"/root/testdata/{sf}"
    rows = list(map(tuple, load(spark, folder, "conversations").select("conv_id", "turn", "role", "text").collect()))
    got = op12_conversation_repair(spark, folder)
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == repaired_by_hand(rows)


def odd_conversations():
    rng = random.Random(9)
    texts = [None, "", " \n", "Yes.", "Yes.", "No", "Why? \t", "a:b\nc!", "é…", "x" * 20_000 + "."]
    roles = ["user", "assistant", "system", None, "", "User", "tool"]
    rows = [(rng.choice([None, 1, 2, 3, 4]), rng.choice([None, 0, 1, 1, 2, 5, -3]), rng.choice(roles), rng.choice(texts))
            for _ in range(60)]
    return rows[:40] + rows[:5] + [(i, 0, "user", "Hm") for i in range(100, 160)]


def test_repair_of_edge_rows(spark):
    rows = odd_conversations()
    schema = "conv_id long, turn long, role string, text string"
    df = spark.createDataFrame(rows, schema).selectExpr("*", "'x' as audit", "1 as seq", "'y' as part", "2 as cost", "3 as copy")
    damaged = conversation_repair.damaged(df)
    got = conversation_repair.repair_digests(damaged, conversation_repair.plan(damaged))
    assert sorted(map(tuple, got.collect()), key=str) == repaired_by_hand(rows, quick)
    none = conversation_repair.damaged(spark.createDataFrame([], schema))
    assert conversation_repair.repair_digests(none, conversation_repair.plan(none)).collect() == []


def quick(initials, faults):
    """The exhaustive search is too slow for long conversations: their edits come from the one checked against it."""
    return (cheapest if len(initials) <= 6 else conversation_repair.cheapest_edits)(initials, faults)


def test_repaired_rows_are_conversations(spark):
    rows = [(7, 0, "system", "Be brief."), (7, 1, "user", "Hi."), (7, 2, "user", "Are you there?"), (7, 3, "assistant", "Yes"),
            (8, 0, "assistant", "Hello."), (9, 0, "user", "  ")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    plans = conversation_repair.plan(df)
    said = {r.conv_id: (r.cost, r.audit) for r in plans.where("part = 0").collect()}
    assert said == {7: (3, "KKRD"), 8: (2, "D"), 9: (2, "D")}
    got = conversation_repair.repaired_rows(df, plans).orderBy("conv_id", "position").collect()
    assert list(map(tuple, got)) == [(7, 0, "system", "Be brief."), (7, 1, "user", "Hi."), (7, 2, "assistant", "Are you there?")]


# ----------------------------------------------------------- ranked search
def ranked_by_hand(docs, items, k):
    def words(text):
        return [w.translate(FOLD) for w in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text or "")]
    counted = [(i, Counter(words(t))) for i, t in docs]
    counted = [(i, c, sum(c.values())) for i, c in counted if c]
    n_docs, n_words = len(counted), sum(n for _, _, n in counted)
    df = Counter(t for _, c, _ in counted for t in c)
    out = []
    for item, text in items:
        scores = []
        for i, c, n in counted:
            m = 100 - 50 + (50 * n * n_docs) // n_words
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m))
                    for t in set(words(text)) if t in c)
            if s > 0:
                scores.append((-s, i is None, i or 0))
        out += [(item, r, None if null else i, -s) for r, (s, null, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


FOLD = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


@pytest.mark.parametrize("block", [{}, {"block_terms": 400, "block_items": 15}])
def test_ranking_of_a_table(spark, block):
    docs, items = load(spark, SF_SMALL, "documents"), load(spark, SF_SMALL, "benchmark")
    got = lexical_search.ranked_search(docs, items, k=50, **block)
    want = ranked_by_hand([(r.doc_id, r.text) for r in docs.collect()], [tuple(r) for r in items.collect()], 50)
    assert sorted(map(tuple, got.collect()), key=str) == want
    assert got.dtypes == [("item_id", "bigint"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]


def test_ranking_with_ties_and_small_trees(spark, monkeypatch):
    monkeypatch.setattr(lexical_search, "LEAF_DOCS", 4)
    monkeypatch.setattr(lexical_search, "SHARD_DOCS", 50)
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(30)] + ["averyveryverylongword" + "x" * 9, "É", "日本語の長い言葉です"]
    texts = [" ".join(rng.choices(vocabulary, k=rng.randint(0, 12))) for _ in range(250)]
    docs = [(i, t) for i, t in enumerate(texts)] + [(i, texts[i]) for i in range(60)] + [(None, texts[3]), (None, None)]
    items = [(1, "W1 w2 w3"), (2, "averyveryverylongword" + "x" * 9 + " É"), (3, None), (4, "nothing here"), (5, texts[7]),
             (5, "日本語の長い言葉です"), (None, "w5, w5; w6")]
    plan_docs = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as n", "'q' as item", "2 as score")
    plan_items = spark.createDataFrame(items, "item_id long, text string").repartition(2)
    got = lexical_search.ranked_search(plan_docs, plan_items, k=20)
    assert sorted(map(tuple, got.collect()), key=str) == ranked_by_hand(docs, items, 20)


def test_bounds_hold_in_every_node():
    rng = np.random.default_rng(4)
    tf = rng.poisson(0.3, (700, 90)) + (rng.random((700, 90)) < 0.02)
    tf = tf[tf.any(1)]
    doc, term = np.nonzero(tf)
    n = tf.sum(1)
    x = lexical_search.components(tf[doc, term], n[doc], len(tf), int(n.sum()))
    w = lexical_search.weights((tf > 0).sum(0).tolist(), len(tf))
    stretch = np.maximum(w, 1.0) ** lexical_search.STRETCH
    ptr = np.append(0, np.cumsum(np.bincount(doc)))
    tree = lexical_search.BallTree(ptr, term, x, stretch)
    exact = np.zeros(tf.shape, np.int64)
    exact[doc, term] = x
    assert sorted(tree.order) == list(range(len(tf))) and len(tree.lo) > 10
    for terms in (np.arange(5), np.arange(0, 90, 7), np.array([89])):
        bound = tree.bounds(terms, w[terms] / stretch[terms])
        for node in range(len(tree.lo)):
            at = tree.order[tree.lo[node]:tree.hi[node]]
            want = exact[at][:, terms] @ w[terms]
            assert want.max() <= bound[node]
            assert (tree.scores(node, terms, w[terms]) == want).all()


def test_ranking_edge_rows(spark, edge_docs, no_docs):
    items = spark.createDataFrame([(1, "ONE two words"), (2, "word1x1 word2x2")], "item_id long, text string")
    got = lexical_search.ranked_search(edge_docs, items, k=50).collect()
    want = ranked_by_hand([r[:2] for r in EDGE], [(1, "ONE two words"), (2, "word1x1 word2x2")], 50)
    assert sorted(map(tuple, got), key=str) == want
    assert lexical_search.ranked_search(no_docs, items).collect() == []
    assert lexical_search.ranked_search(edge_docs, items.limit(0)).collect() == []
    assert op13_ball_tree_search(spark, SF_SMALL).count() > 0
