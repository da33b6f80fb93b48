"""Helpers shared by the operators of this package.

* scratch tables in the shared checkpoint folder (never a local one),
* Arrow batches cut into byte-bounded chunks,
* a vectorised word scanner that hashes every word of a chunk of texts,
* streaming of sorted groups inside a partition,
* connected components by alternating star contraction.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mediafold.session import checkpoint_dir, find_package_on_workers
from mediafold.sources.tables import load

#: Bytes of text that a task works on at a time, and of a batch that it is handed: both bound its memory.
CHUNK_BYTES = 1 << 19
BATCH_BYTES = "8m"


# ------------------------------------------------------------------ storage
def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint directory."""
    return f"{checkpoint_dir(spark).rstrip('/')}/llm/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to shared storage and read it back: cuts the lineage and runs Python stages once."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def map_arrow(df: DataFrame, fn: Callable, schema) -> DataFrame:
    """``mapInArrow`` on batches of bounded bytes (a batch bounded by rows alone could hold any amount of text)."""
    find_package_on_workers(df.sparkSession)
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return df.mapInArrow(fn, schema)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents")


def remainder(doc_id, n: int):
    """crc32 of the id written as text, modulo ``n`` (NULL for a NULL id)."""
    return F.crc32(doc_id.cast("string").cast("binary")) % F.lit(n)


def held_out(doc_id, n: int, r: int):
    """True if the id's remainder is ``r``; a NULL id is not held out."""
    return F.coalesce(remainder(doc_id, n) == F.lit(r), F.lit(False))


def set_apart(docs: DataFrame, known: Iterable[str] = ("doc_id", "text", "lang", "source", "n_chars")):
    """(``docs`` with all but the ``known`` columns under names of our own, a function that brings their names back).

    An operator's working columns can then not meet a column of the caller, whatever it is called.
    """
    inside = {c: c if c in known else f"extra_{i}" for i, c in enumerate(docs.columns)}

    def restored(rows: DataFrame) -> DataFrame:
        return rows.select(*[rows[f"`{i}`"].alias(c) for c, i in inside.items()])
    return docs.select(*[docs[f"`{c}`"].alias(i) for c, i in inside.items()]), restored


# ------------------------------------------------------------ Arrow chunks
def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; NULL counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def byte_chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes (a longer row stands alone)."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi
        lo = hi


def text_chunks(batches, column: str, limit: int = CHUNK_BYTES):
    """(record batch slice, bytes, offsets) for chunks of the batches' text column."""
    for batch in batches:
        data, offsets = utf8(batch.column(batch.schema.get_field_index(column)))
        for lo, hi in byte_chunks(offsets, limit):
            yield batch.slice(lo, hi - lo), data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo]


# ------------------------------------------------------------------- words
# A word: a run of digits, ASCII letters and bytes of non-ASCII characters.
WORD_BYTE = np.zeros(256, bool)
WORD_BYTE[ord("0"):ord("9") + 1] = True
WORD_BYTE[ord("A"):ord("Z") + 1] = True
WORD_BYTE[ord("a"):ord("z") + 1] = True
WORD_BYTE[128:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A"):ord("Z") + 1] += 32

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE_CODE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64)
_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n-1 of the hash base and of its inverse, modulo 2**64."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, CHUNK_BYTES + 1024)
        with np.errstate(over="ignore"):
            made = []
            for base in (_BASE, _INVERSE):
                p = np.full(size, base, np.uint64)
                p[0] = 1
                made.append(np.cumprod(p, dtype=np.uint64))
        _powers[:] = made
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (a bijection)."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(32)
    return x


class Words:
    """Words of a chunk of texts, ASCII case folded, as arrays.

    ``start``/``end`` are byte positions in the chunk, ``bounds[d]:bounds[d+1]`` are the words of document ``d``
    and ``hash`` is a 64-bit hash of each word's bytes.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        folded = LOWER[data]
        inside = WORD_BYTE[data]
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        last = inside.copy()
        last[:-1] &= ~inside[1:]
        cut = offsets[1:-1]
        cut = cut[(cut > 0) & (cut < len(data))]
        first[cut] |= inside[cut]
        last[cut - 1] |= inside[cut - 1]
        self.start = np.flatnonzero(first)
        self.end = np.flatnonzero(last) + 1
        self.bounds = np.searchsorted(self.start, offsets)
        p, q = powers(len(data) + 1)
        code = _BYTE_CODE[folded]
        code *= p[:-1]
        self._sum = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(code, out=self._sum[1:])
        self._inverse = q
        self.folded = folded
        self.hash = self.span_hash(self.start, self.end)

    def span_hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of the folded bytes of each span."""
        return mix((self._sum[end] - self._sum[start]) * self._inverse[start])

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), self.counts)


def word_hash(word: str) -> int:
    """The hash that :class:`Words` gives ``word``."""
    data = np.frombuffer(word.encode(), np.uint8)
    return int(Words(data, np.array([0, len(data)])).hash[0])


def segment_sum(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of ``values`` in each ``bounds[i]:bounds[i+1]`` (0 for an empty range)."""
    total = np.zeros((len(values) + 1, *values.shape[1:]), np.float64)
    np.cumsum(values, axis=0, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


# --------------------------------------------------------- grouped streaming
def sorted_groups(batches: Iterator[pa.RecordBatch], keys: list[str], max_rows: int | None = None) -> Iterator[pa.Table]:
    """Groups of equal ``keys`` from batches sorted by them; a group may span batches.

    With ``max_rows`` a larger group comes in several pieces, each about as large.
    """
    held: list[pa.RecordBatch] = []
    held_key = None
    for batch in batches:
        if batch.num_rows == 0:
            continue
        columns = [batch.column(batch.schema.get_field_index(k)).to_pylist() for k in keys]
        rows = list(zip(*columns, strict=True))
        lo = 0
        while lo < len(rows):
            hi = lo + 1
            while hi < len(rows) and rows[hi] == rows[lo] and (max_rows is None or hi - lo < max_rows):
                hi += 1
            full = max_rows is not None and sum(b.num_rows for b in held) >= max_rows
            if held and (full or rows[lo] != held_key):
                yield pa.Table.from_batches(held)
                held = []
            held_key = rows[lo]
            held.append(batch.slice(lo, hi - lo))
            lo = hi
    if held:
        yield pa.Table.from_batches(held)


# ----------------------------------------------------- connected components
def connected_components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """Component of each node of an undirected graph.

    ``edges`` has columns ``u`` and ``v`` of one orderable type.  Returns ``node, root`` with ``root`` the smallest node
    of the component; nodes without an edge to another node are left out.  Alternating large-star and small-star
    steps (O(log n) rounds in practice); each round is written to shared storage, so no lineage builds up and nothing
    but a row count and a checksum reaches the driver.
    """
    spark = edges.sparkSession
    e = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e = stored(e, "edges")
    before = None
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(
            F.col("u").alias("k"), F.least("u", "m").alias("m"))
        large = (both.where("v > u").join(low, F.col("u") == F.col("k"))
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        low = large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "k")
        small = large.join(low, F.col("u") == F.col("k"))
        small = (small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        e = stored(small, "edges")
        # Cast to decimal: a sum of 64-bit hashes would overflow.
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if before is not None and tuple(now) == before:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        before = tuple(now)
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


# --------------------------------------------------------------- numbering
def bucketed_prefix(df: DataFrame, group: list[str], order: list[str], weight, out: str,
                    buckets: int = 64, spread=None) -> DataFrame:
    """Exclusive running sum of ``weight`` inside each ``group``, without one task per group.

    Rows of a group are ordered by a bucket first and by ``order`` inside it.  ``spread`` is a Column with the bucket
    (default: hash of ``order``).  Sums per bucket are aggregated map-side and accumulated over at most ``buckets``
    rows a group; the running sum inside a bucket is a window over that bucket alone.
    """
    from pyspark.sql import Window
    b = spread if spread is not None else F.pmod(F.xxhash64(*order), F.lit(buckets))
    rows = df.withColumn("_bucket", b.cast("long")).withColumn("_weight", weight.cast("long"))
    sums = rows.groupBy(*group, "_bucket").agg(F.sum("_weight").alias("_sum"))
    before = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*[F.col(c).alias(f"_g_{c}") for c in group], F.col("_bucket").alias("_b"),
                       F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy(*group, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_inside", F.coalesce(F.sum("_weight").over(inside), F.lit(0)))
    same = F.col("_b") == F.col("_bucket")
    for c in group:
        same = same & F.col(c).eqNullSafe(F.col(f"_g_{c}"))
    return (rows.join(sums, same).withColumn(out, F.col("_base") + F.col("_inside"))
            .drop("_bucket", "_weight", "_inside", "_b", "_base", *[f"_g_{c}" for c in group]))
