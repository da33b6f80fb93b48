"""Token-ID files: frequency-ranked ids in a byte-aligned variable-length code.

Every document is tokenised, ids are replaced by their rank in the corpus (0 = most frequent) and written in ascending
``doc_id`` order.  A file holds a header, the documents' ids and lengths, one control byte for four tokens (two bits
each: bytes used minus one) and, apart from them, the data bytes.  Reading is a table lookup: the control byte gives
four lengths, their running sum gives the offsets.

Tokenising works on the pieces between spaces and line feeds: where a tokenizer's pattern never joins characters
across them (``PIECE_SAFE``), the ids of a text are the ids of its pieces in a row, and each distinct piece goes
through the library once per worker (a bounded memo).  Other tokenizers get whole texts.

Scale: ids are kept as a table of 16- or 32-bit integers in shared storage; counts are one row per id and partition;
one range shuffle of the ids puts documents in order; a task streams its range into files of ``file_tokens`` tokens.
Files are written under a temporary name and moved, so a repeated task only replaces a file by an equal one.  Start
offsets are a two-level running sum over files.  The target folder must be reachable by ``pyarrow.fs`` (local, HDFS, S3,
GCS); the default lies in the session's shared checkpoint folder.

Edge cases: NULL or empty text gives the end id alone; a NULL ``doc_id`` sorts first; repeated rows are written each
time (ordered by their ids); an empty table gives no file and no row; other columns are ignored.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mediafold.llm.common import bucketed_prefix, byte_chunks, map_arrow, scratch_path, stored, utf8

#: Tokenizers whose patterns never match across a space or line feed.
PIECE_SAFE = ("word_bpe_49k.json",)
MAGIC = b"tokfile1"
HEADER = struct.Struct("<8sQQQQI")
SUFFIX = ".tok"
# A mark that the pattern parts from the letter or digit ahead of it (an apostrophe may belong to the word).
MARK_BEHIND = r"([A-Za-z0-9])([.,!?;:%&$#*|()])"
MEMO_PIECES, MEMO_BYTES = 1_000_000, 64 << 20

# Lengths of the four tokens of each control byte.
LENGTHS = ((np.arange(256)[:, None] >> (2 * np.arange(4))) & 3).astype(np.int64) + 1


# ------------------------------------------------------------- byte coding
def pack(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(control bytes, data bytes) of unsigned 32-bit values."""
    v = np.ascontiguousarray(values, "<u4")
    extra = (v > 0xFF).astype(np.uint8) + (v > 0xFFFF) + (v > 0xFFFFFF)
    padded = np.zeros(-(-len(v) // 4) * 4, np.uint8)
    padded[:len(v)] = extra
    control = (padded.reshape(-1, 4) << (2 * np.arange(4, dtype=np.uint8))).sum(1, dtype=np.uint8)
    data = v.view(np.uint8).reshape(-1, 4)[np.arange(4) <= extra[:, None]]
    return control, data


def unpack(control: np.ndarray, data: np.ndarray, n: int) -> np.ndarray:
    """Inverse of :func:`pack`."""
    lengths = LENGTHS[control].ravel()[:n]
    at = np.cumsum(lengths) - lengths
    out = data[at].astype(np.uint32)
    for k in range(1, 4):
        more = np.flatnonzero(lengths > k)
        if not len(more):
            break
        out[more] |= data[at[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def file_bytes(doc_ids: list, counts: np.ndarray, ranks: np.ndarray) -> bytes:
    control, data = pack(ranks)
    body = b"".join((
        np.array([d is None for d in doc_ids], np.uint8).tobytes(),
        np.array([d or 0 for d in doc_ids], "<i8").tobytes(),
        np.asarray(counts, "<u8").tobytes(), control.tobytes(), data.tobytes()))
    return HEADER.pack(MAGIC, len(doc_ids), len(ranks), len(control), len(data), zlib.crc32(body)) + body


def parse_file(content) -> tuple[list, np.ndarray, np.ndarray]:
    """(doc ids, token counts, ranks) of a file's bytes."""
    magic, docs, tokens, controls, size, crc = HEADER.unpack_from(content)
    body = memoryview(content)[HEADER.size:]
    if magic != MAGIC or zlib.crc32(body) != crc:
        raise ValueError("not a token file, or damaged")
    raw = np.frombuffer(body, np.uint8)
    null, at = raw[:docs], docs
    ids = raw[at:at + 8 * docs].view("<i8")
    counts = raw[at + 8 * docs:at + 16 * docs].view("<u8").astype(np.int64)
    at += 16 * docs
    ranks = unpack(raw[at:at + controls], raw[at + controls:at + controls + size], tokens)
    return [None if z else int(i) for i, z in zip(ids, null, strict=True)], counts, ranks


# -------------------------------------------------------------- tokenising
class PieceEncoder:
    """Ids of texts through a memo of distinct pieces.

    A piece is what stands between spaces and line feeds; marks behind an ASCII letter or digit start a piece of their own
    (the pattern always parts them), and ASCII letters are folded, as the tokenizer does itself.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.safe = os.path.basename(path) in PIECE_SAFE
        size = self.tokenizer.get_vocab_size()
        self.dtype = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        self.closes = np.zeros(size, bool)  # ids that end a word
        for token, i in self.tokenizer.get_vocab().items():
            self.closes[i] = token.endswith("</w>")
        self.clear()

    def clear(self) -> None:
        self.memo: dict[str, int] = {"": 0}
        self.size = 0
        self.ids = np.zeros(0, self.dtype)
        self.ends = np.zeros(2, np.int64)  # ids of entry i: ends[i]:ends[i + 1]

    def _learn(self, new: list[str]) -> None:
        # Words of Latin letters are one word to the tokenizer: they go through it together and are parted at word ends.
        plain = [w for w in new if w.isalpha() and max(w) < "\u0250"] if self.safe else []
        ids = np.array(self.tokenizer.encode(" ".join(plain), add_special_tokens=False).ids, self.dtype)
        ends = np.flatnonzero(self.closes[ids]) + 1
        if len(ends) != len(plain):
            plain, ids, ends = [], ids[:0], ends[:0]
        done = set(plain)
        rest = [w for w in new if w not in done]
        rows = [e.ids for e in self.tokenizer.encode_batch_fast(rest, add_special_tokens=False)]
        more = np.cumsum([0, *map(len, rows)], dtype=np.int64)[1:] + len(ids)
        first = len(self.memo)
        self.memo.update(zip(plain + rest, range(first, first + len(new)), strict=True))
        self.ends = np.concatenate([self.ends, self.ends[-1] + ends, self.ends[-1] + more])
        self.ids = np.concatenate([self.ids, ids, np.fromiter(chain.from_iterable(rows), self.dtype)])
        self.size += sum(map(len, new))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, number of ids of each)."""
        texts = texts.fill_null("")
        if len(self.memo) > MEMO_PIECES or self.size > MEMO_BYTES:
            self.clear()
        if self.safe:
            special = pc.any(pc.match_substring(texts, "<|")).as_py()
            texts = pc.replace_substring(texts, "\n", " ")
            if not special:  # a special token must neither be cut nor appear by folding
                texts = pc.replace_substring_regex(pc.ascii_lower(texts), MARK_BEHIND, r"\1 \2")
            split = pc.split_pattern(texts, " ")
            bounds = split.offsets.to_numpy().astype(np.int64)
            coded = split.flatten().dictionary_encode()
            pieces, at = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        else:
            pieces, at, bounds = texts.to_pylist(), np.arange(len(texts)), np.arange(len(texts) + 1)
        new = [p for p in pieces if p not in self.memo]
        if new:
            self._learn(sorted(set(new)))
        entry = np.fromiter(map(self.memo.__getitem__, pieces), np.int64, len(pieces))[at]
        start = self.ends[entry]
        length = self.ends[entry + 1] - start
        total = np.zeros(len(entry) + 1, np.int64)
        np.cumsum(length, out=total[1:])
        take = np.repeat(start - total[:-1], length)
        take += np.arange(total[-1])
        return self.ids[take], np.diff(total[bounds - bounds[0]])


_encoders: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    if path not in _encoders:
        _encoders[path] = PieceEncoder(path)
    return _encoders[path]


def token_table(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """``doc_id, ids`` with the ids of each whole text and the end id, as little-endian integers."""
    def run(batches):
        e = encoder(path)
        for batch in batches:
            _, offsets = utf8(batch.column(1))
            for lo, hi in byte_chunks(offsets, 8 << 20):
                ids, counts = e.encode(batch.column(1).slice(lo, hi - lo))
                ends = np.cumsum(counts)
                ids = np.insert(ids, ends, end_id)
                cut = np.zeros(len(ends) + 1, np.int64)
                np.cumsum((counts + 1) * e.dtype.itemsize, out=cut[1:])
                out = pa.LargeBinaryArray.from_buffers(
                    pa.large_binary(), len(counts), [None, pa.py_buffer(cut), pa.py_buffer(ids.tobytes())])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), out.cast(pa.binary())], ["doc_id", "ids"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_arrow(rows, run, "doc_id long, ids binary")


def rank_table(tokens: DataFrame, vocabulary: int, itemsize: int) -> np.ndarray:
    """Ids in order of falling corpus frequency (ties: smaller id first); all documents are counted."""
    def count(batches):
        n = np.zeros(vocabulary, np.int64)
        for batch in batches:
            column = batch.column(0).cast(pa.large_binary())
            offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
            if len(column):
                raw = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0]:offsets[-1]]
                n += np.bincount(raw.view(f"<u{itemsize}"), minlength=vocabulary)
        seen = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(n[seen])], ["id", "n"])

    # At most one row per id of the vocabulary.
    rows = map_arrow(tokens.select("ids"), count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    n = np.zeros(vocabulary, np.int64)
    for r in rows:
        n[r["id"]] = r["n"]
    return np.lexsort((np.arange(vocabulary), -n)).astype("<u4")


# ------------------------------------------------------------------- files
def _filesystem(uri: str):
    from pyarrow import fs
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("/") else uri.replace(":", "://", 1))


def put(folder: str, name: str, content: bytes) -> None:
    """Write a file under a temporary name, then move it into place."""
    fs, base = _filesystem(folder)
    fs.create_dir(base, recursive=True)
    temporary = f"{base}/.{name}.{uuid.uuid4().hex}"
    with fs.open_output_stream(temporary) as out:
        out.write(content)
    fs.move(temporary, f"{base}/{name}")


def write_files(docs: DataFrame, folder: str, path: str, end_id: int = 1, file_tokens: int = 4 << 20) -> DataFrame:
    """Tokenise ``docs`` into files of ``folder``; returns the manifest ``part, seq, n_docs, n_tokens``."""
    from tokenizers import Tokenizer
    spark = docs.sparkSession
    vocabulary = Tokenizer.from_file(path).get_vocab_size()
    itemsize = 2 if vocabulary <= 1 << 16 else 4
    tokens = token_table(docs, path, end_id)
    table = scratch_path(spark, "ids")
    tokens.write.option("compression", "zstd").parquet(table)
    tokens = spark.read.schema(tokens.schema).parquet(table)
    by_rank = rank_table(tokens, vocabulary, itemsize)
    put(folder, "ranks.bin", by_rank.tobytes())
    rank = np.zeros(vocabulary, "<u4")
    rank[by_rank] = np.arange(vocabulary)
    rank_of = spark.sparkContext.broadcast(rank)  # one integer per id of the vocabulary

    def write(batches):
        part, seq = TaskContext.get().partitionId(), 0
        ids, ranks, held = [], [], 0

        def flush():
            nonlocal ids, ranks, held, seq
            counts = np.array([len(r) for r in ranks])
            put(folder, f"part-{part:06d}-{seq:06d}{SUFFIX}", file_bytes(ids, counts, np.concatenate(ranks)))
            row = pa.RecordBatch.from_pydict({"part": [part], "seq": [seq], "n_docs": [len(ids)], "n_tokens": [held]})
            ids, ranks, held, seq = [], [], 0, seq + 1
            return row

        for batch in batches:
            for doc_id, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                r = rank_of.value[np.frombuffer(raw.as_buffer(), f"<u{itemsize}")]
                ids.append(doc_id)
                ranks.append(r)
                held += len(r)
                if held >= file_tokens:
                    yield flush()
        if ids:
            yield flush()

    ordered = tokens.repartitionByRange("doc_id").sortWithinPartitions(
        F.asc_nulls_first("doc_id"), F.length("ids"), "ids")
    return stored(map_arrow(ordered, write, "part long, seq long, n_docs long, n_tokens long"), "manifest")


def read_files(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """Digest of each document from the files: ``doc_id, start, n_tokens, ids_crc32``."""
    fs, base = _filesystem(folder)
    with fs.open_input_stream(f"{base}/ranks.bin") as f:
        by_rank = spark.sparkContext.broadcast(np.frombuffer(f.read(), "<u4"))

    def decode(batches):
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                part, seq = map(int, os.path.basename(name)[len("part-"):-len(SUFFIX)].split("-"))
                doc_ids, counts, ranks = parse_file(content.as_buffer())
                ids = by_rank.value[ranks]
                ends = np.cumsum(counts)
                starts = ends - counts
                raw = memoryview(ids.tobytes())
                crc = [zlib.crc32(raw[4 * a:4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                n = len(doc_ids)
                yield pa.RecordBatch.from_pydict({
                    "doc_id": pa.array(doc_ids, pa.int64()), "part": pa.array([part] * n, pa.int64()),
                    "seq": pa.array([seq] * n, pa.int64()), "at": pa.array(starts),
                    "n_tokens": pa.array(counts), "ids_crc32": pa.array(crc, pa.int64())})

    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*{SUFFIX}").load(folder)
    rows = map_arrow(files.select("path", "content"), decode,
                     "doc_id long, part long, seq long, at long, n_tokens long, ids_crc32 long")
    before = bucketed_prefix(manifest, [], ["part", "seq"], F.col("n_tokens"), "before",
                             spread=F.floor(F.col("part") / 64))
    before = before.select(F.col("part").alias("_part"), F.col("seq").alias("_seq"), "before")
    return rows.join(before, (F.col("part") == F.col("_part")) & (F.col("seq") == F.col("_seq"))).select(
        "doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def token_files(docs: DataFrame, path: str, end_id: int = 1, folder: str | None = None) -> DataFrame:
    """Write the token files of ``docs`` and return the digest read back from them."""
    spark = docs.sparkSession
    folder = folder or scratch_path(spark, "tokens")
    manifest = write_files(docs, folder, path, end_id)
    return read_files(spark, folder, manifest)
