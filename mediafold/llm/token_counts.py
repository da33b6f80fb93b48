"""Token counts of whole texts by a two-tier lookup in the map.

A byte-level BPE first cuts a text into pre-tokens, and the tokens of a text are those of its pre-tokens one after the
other; so a count is a sum of pre-token lengths.  Pre-tokens are found by array operations over the characters of a chunk
of texts.  Their lengths come from two tiers: a compact table of the frequent ones, broadcast once, and for the others
the cache of the worker, which asks the tokenizer for each new pre-token.  Nothing is shuffled: one map over the texts.

Frequent pre-tokens are taken from a sample of ``fit_rows`` rows, ``table_keys`` of them at most (18 bytes a slot).  The
table holds lengths that the tokenizer gave, so it changes only where a length is looked up, never a count; any
table, an empty one too, gives the same counts.

The classes of characters (letter, number, space, other) are asked of the tokenizer's own pre-tokenizer, once per worker
and character.  A tokenizer of another kind (a normalizer, another pre-tokenizer, added tokens that strip) encodes whole
texts through the library instead.  Special strings inside texts are single tokens, as the library's default has it; no
token is added, cut off or padded.

Memory: half a megabyte of text at a time.  A longer text is cut between a printable ASCII character and a space or line
feed behind it, where a pre-token always ends, so only a longer run without any such place is held whole.

Edge cases: a NULL or empty text has 0 bytes and 0 tokens; a NULL ``doc_id`` stays; repeated rows are counted each; an empty
table gives no row; other columns are ignored.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mediafold.llm.common import CHUNK_BYTES, map_arrow, text_chunks
from mediafold.llm.keys import SHORT, KeyTable, packed, packed_strings

LETTER, NUMBER, SPACE, OTHER = 1, 2, 3, 4
#: Endings that the pattern parts from the word ahead of them (fixed values).
ENDINGS_2 = ("s", "t", "m", "d")
ENDINGS_3 = ("re", "ve", "ll")
FIT_ROWS, TABLE_KEYS = 20_000, 1 << 16
MEMO_PIECES, MEMO_BYTES = 500_000, 48 << 20
SCHEMA = "doc_id long, n_bytes long, n_tokens long"
# Bytes that can stand ahead of a cut of a long text, and the cut itself.
_CUT = re.compile(rb"[!-~](?=[ \n])")

_counters: dict[str, "PieceCounter"] = {}


class PieceCounter:
    """Pre-tokens of texts and their lengths in tokens, for one tokenizer file."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, added = spec.get("pre_tokenizer") or {}, spec.get("added_tokens") or []
        self.by_pieces = (
            spec.get("normalizer") is None and spec["model"].get("type") == "BPE" and not spec["model"].get("dropout")
            and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
            and not any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] or re.search(r"\s", t["content"])
                        for t in added))
        contents = sorted((t["content"] for t in added), key=len, reverse=True)
        self.special = re.compile(b"|".join(re.escape(c.encode()) for c in contents)) if contents else None
        self.kind = np.zeros(0x110000, np.uint8)
        self.kind[32] = SPACE
        self.memo: dict[bytes, int] = {}
        self.memo_bytes = 0

    # -------------------------------------------------------- pre-tokens
    def _learn(self, points: np.ndarray) -> None:
        cut = self.tokenizer.pre_tokenizer.pre_tokenize_str
        for p in points.tolist():
            c = chr(p)
            by_digit = [span for _, span in cut(f"a{c}1")]
            if by_digit[0] == (0, 2):
                self.kind[p] = LETTER
            elif by_digit[1] == (1, 3):
                self.kind[p] = NUMBER
            else:
                self.kind[p] = OTHER if cut(f"a{c}!")[1][1] == (1, 3) else SPACE

    def pieces(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start byte, length in bytes, is special) of the pre-tokens of the texts ``data[offsets[i]:offsets[i + 1]]``."""
        first = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))  # byte position of each character
        n = len(first) - 1
        if n == 0:
            return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, bool),)
        point = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), "<u4")
        kind = self.kind[point]
        if not kind.all():
            self._learn(np.unique(point[kind == 0]))
            kind = self.kind[point]
        fresh = np.zeros(n + 1, bool)  # a text, or the part behind a special string, begins
        fresh[np.searchsorted(first, offsets)] = True
        specials = self._specials(data, offsets)
        if len(specials):
            specials = np.searchsorted(first, specials)
            fresh[specials.ravel()] = True
        space, blank = kind == SPACE, point == 32
        start = fresh[:n].copy()
        start[1:] |= kind[1:] != kind[:-1]
        # The last space ahead of a character starts a pre-token: with it if it is a blank, else by itself.
        last = np.flatnonzero(space[:-1] & ~space[1:] & ~fresh[1:n])
        start[last] = True
        start[last[blank[last]] + 1] = False
        self._endings(point, kind, fresh, start)
        special = np.zeros(n, bool)
        for lo, hi in specials:
            start[lo:hi] = False
            start[lo] = special[lo] = True
        at = np.flatnonzero(start)
        begin = first[at]
        return begin, np.diff(np.append(begin, len(data))), special[at]

    @staticmethod
    def _endings(point, kind, fresh, start) -> None:
        """An apostrophe that starts a pre-token takes an ending behind it along, and what follows starts anew."""
        n = len(point)
        at = np.flatnonzero((point == ord("'")) & start)
        at = at[at + 1 < n]
        at = at[~fresh[at + 1]]
        one = point[at + 1]
        two = np.where((at + 2 < n) & ~fresh[np.minimum(at + 2, n)], point[np.minimum(at + 2, n - 1)], 0)
        size = np.zeros(len(at), np.int64)
        size[np.isin(one, [ord(c) for c in ENDINGS_2])] = 2
        for a, b in ENDINGS_3:
            size[(one == ord(a)) & (two == ord(b))] = 3
        at, size = at[size > 0], size[size > 0]
        start[at + 1] = False
        behind = at + size
        behind = behind[behind < n]
        start[behind[(kind[behind] == LETTER)]] = True

    def _specials(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        raw = data.tobytes()
        if self.special is None or not self.special.search(raw):
            return np.zeros((0, 2), np.int64)
        spans = [(lo + m.start(), lo + m.end()) for lo, hi in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)
                 for m in self.special.finditer(raw[lo:hi])]
        return np.array(spans, np.int64).reshape(-1, 2)

    # ----------------------------------------------------------- lengths
    def lengths(self, pieces: list[bytes]) -> list[int]:
        """Tokens of each pre-token, from the worker's cache or the tokenizer."""
        memo = self.memo
        new = list({p for p in pieces if p not in memo})
        found = {}
        if new:
            encoded = self.tokenizer.encode_batch([p.decode("utf-8") for p in new], add_special_tokens=False)
            found = dict(zip(new, map(len, encoded), strict=True))
            size = sum(map(len, new))
            if len(memo) + len(new) > MEMO_PIECES or self.memo_bytes + size > MEMO_BYTES:
                old, self.memo, self.memo_bytes = memo, {}, 0
                found.update((p, old[p]) for p in pieces if p in old)
                memo = self.memo
            if len(new) <= MEMO_PIECES and size <= MEMO_BYTES:
                memo.update((p, found[p]) for p in new)
                self.memo_bytes += size
        return [found[p] if p in found else memo[p] for p in pieces]

    def count(self, data: np.ndarray, offsets: np.ndarray, table: KeyTable | None) -> np.ndarray:
        """Tokens of each text of a chunk."""
        if not self.by_pieces:
            texts = [data[lo:hi].tobytes().decode("utf-8") for lo, hi in zip(offsets[:-1], offsets[1:], strict=True)]
            return np.array([len(e) for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)], np.int64)
        begin, size, special = self.pieces(data, offsets)
        tokens = np.full(len(begin), -1, np.int64)
        if table is not None:
            short = np.flatnonzero(size <= SHORT)
            tokens[short] = table.find(*packed(data, begin[short], size[short]))
        tokens[special] = 1
        miss = np.flatnonzero(tokens < 0)
        if len(miss):
            raw = data.tobytes()
            tokens[miss] = self.lengths([raw[a:a + s] for a, s in zip(begin[miss].tolist(), size[miss].tolist(), strict=True)])
        total = np.zeros(len(tokens) + 1, np.int64)
        np.cumsum(tokens, out=total[1:])
        return np.diff(total[np.searchsorted(begin, offsets)])


def counter(path: str) -> PieceCounter:
    """The worker's counter for a tokenizer file: its cache outlives a task."""
    if path not in _counters:
        _counters.clear()
        _counters[path] = PieceCounter(path)
    return _counters[path]


def parts_of(data: np.ndarray, limit: int = CHUNK_BYTES) -> np.ndarray:
    """Offsets that cut one long text where pre-tokens end, into parts of ``limit`` bytes or little more."""
    raw, cuts, at = data.tobytes(), [0], limit
    while at < len(raw):
        found = _CUT.search(raw, at)
        if found is None:
            break
        cuts.append(found.end())
        at = found.end() + limit
    return np.array([*cuts, len(raw)])


def _counts_of(batches, path, table):
    c = counter(path)
    for rows, data, offsets in text_chunks(batches, "text"):
        if len(offsets) == 2 and len(data) > CHUNK_BYTES and c.by_pieces:
            cuts = parts_of(data)
            tokens = [sum(int(c.count(data[lo:hi], np.array([0, hi - lo]), table)[0])
                          for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True))]
        else:
            tokens = c.count(data, offsets, table)
        yield pa.RecordBatch.from_arrays(
            [rows.column(0).cast(pa.int64()), pa.array(np.diff(offsets), pa.int64()), pa.array(tokens, pa.int64())],
            ["doc_id", "n_bytes", "n_tokens"])


def frequent_lengths(docs: DataFrame, path: str, fit_rows: int = FIT_ROWS, table_keys: int = TABLE_KEYS) -> KeyTable | None:
    """Lengths of the most frequent short pre-tokens of a sample of about ``fit_rows`` rows (None if there is none)."""
    rows = docs.count()
    if not rows or not counter(path).by_pieces:
        return None

    def pieces(batches):
        c = counter(path)
        seen: dict[bytes, int] = {}
        for _, data, offsets in text_chunks(batches, "text"):
            begin, size, special = c.pieces(data, offsets)
            begin, size = begin[~special & (size <= SHORT)], size[~special & (size <= SHORT)]
            if not len(begin):
                continue
            a, b = packed(data, begin, size)
            order = np.lexsort((a, b))
            a, b, begin, size = a[order], b[order], begin[order], size[order]
            head = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
            raw = data.tobytes()
            for i, m in zip(head.tolist(), np.diff(np.append(head, len(a))).tolist(), strict=True):
                piece = raw[begin[i]:begin[i] + size[i]]
                seen[piece] = seen.get(piece, 0) + m
            if len(seen) > MEMO_PIECES:
                yield pa.RecordBatch.from_pydict({"piece": list(seen), "n": list(seen.values())})
                seen = {}
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())],
                                         ["piece", "n"])

    sample = docs.select("text")
    if rows > fit_rows:
        sample = sample.sample(fraction=fit_rows / rows, seed=11)
    top = (map_arrow(sample, pieces, "piece binary, n long").groupBy("piece").agg(F.sum("n").alias("n")).where("n > 1")
           .orderBy(F.desc("n"), "piece").limit(table_keys).select("piece").collect())
    if not top:
        return None
    strings = [bytes(r[0]) for r in top]
    return KeyTable(*packed_strings(strings), np.array(counter(path).lengths(strings), np.uint8))


def token_counts(docs: DataFrame, path: str, fit_rows: int = FIT_ROWS, table_keys: int = TABLE_KEYS) -> DataFrame:
    """``doc_id, n_bytes, n_tokens`` of every row of ``docs`` (columns ``doc_id``, ``text``) by the tokenizer file ``path``."""
    docs = docs.select("doc_id", "text")
    shared = docs.sparkSession.sparkContext.broadcast(frequent_lengths(docs, path, fit_rows, table_keys))
    return map_arrow(docs, lambda batches: _counts_of(batches, path, shared.value), SCHEMA)
