"""Mixing sources to target weights by Pfair scheduling.

Each source is a queue of blocks of ``block_bytes`` (its documents in a pseudo-random order, cut by running bytes).
With ``a`` of every ``period`` slots as its share, block ``j`` of a source is released at slot ``floor(j*period/a)`` and
due by ``ceil((j+1)*period/a)``; the earliest deadline among the released blocks takes each slot.  As the shares add up
to the period, no deadline is missed and a source never strays a whole block from its share.  The period is so much
longer than the table has blocks that the whole shares stand for the target weights themselves: rounding them adds less
than a thousandth of a block over all slots.  When a source runs out, the shares of the others are renewed and the next
phase begins, so every row is kept.

Scale: the driver draws up one slot a block (some 120,000 for 30 GB) and ships them in runs of ``RUN`` blocks; each row
finds its slot by its source and block.  There is at most one phase a source; sources and blocks must be countable on
the driver.  Running bytes and the final positions are two-level prefix sums: no source and no stretch of the order is
ever one task.

Edge cases: NULL is a source of its own; NULL or empty texts weigh one byte; repeated rows and repeated or NULL ids
keep a position each; an empty table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from fractions import Fraction

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mediafold.llm.common import bucketed_prefix, set_apart, stored

PLACED = "source string, run long, first_block long, end_block long, phase int, slots array<long>"

#: Blocks of a source whose slots are shipped in one row.
RUN = 1024


def shares(weights: list[float], resolution: int) -> list[int]:
    """Whole slots of a period for each weight: largest remainders, then one slot for a source without any."""
    n = len(weights)
    period = max(resolution, n)
    # Exact arithmetic: a period may be longer than a float can count.
    parts = [Fraction(w) for w in weights]
    total = sum(parts)
    exact = [period * (w / total if total > 0 else Fraction(1, n)) for w in parts]
    out = [int(x) for x in exact]
    for i in sorted(range(n), key=lambda i: (out[i] - exact[i], i))[:period - sum(out)]:
        out[i] += 1
    for i in range(n):
        if not out[i]:
            out[out.index(max(out))] -= 1
            out[i] = 1
    return out


def pfair_period(share: list[int], left: list[int] | None = None) -> list[list[int]]:
    """Slots of each source in one period, by earliest deadline among released blocks.

    With ``left`` the schedule ends as soon as one source has dealt that many blocks.
    """
    period = sum(share)
    slots: list[list[int]] = [[] for _ in share]
    release = [(0, s) for s in range(len(share))]
    heapq.heapify(release)
    ready: list[tuple[int, int, int]] = []
    for t in range(period):
        while release and release[0][0] <= t:
            _, s = heapq.heappop(release)
            heapq.heappush(ready, (-(-(len(slots[s]) + 1) * period // share[s]), -share[s], s))
        _, _, s = heapq.heappop(ready)
        slots[s].append(t)
        if left is not None and len(slots[s]) == left[s]:
            break
        if len(slots[s]) < share[s]:
            heapq.heappush(release, (len(slots[s]) * period // share[s], s))
    return slots


def phases(blocks: list[int], weights: list[float], resolution: int) -> Iterator[tuple]:
    """(source, first block, phase, slots of the blocks from there on) until every source is used up."""
    done, base, phase = [0] * len(blocks), 0, 0
    while active := [s for s, n in enumerate(blocks) if n > done[s]]:
        left = [blocks[s] - done[s] for s in active]
        period = max(resolution, 1000 * (len(active) + 1) * sum(left))
        slots = pfair_period(shares([weights[s] for s in active], period), left)
        for s, p in zip(active, slots, strict=True):
            yield s, done[s], phase, [base + t for t in p]
            done[s] += len(p)
        base += sum(map(len, slots))
        phase += 1


def runs(first: int, slots: list[int]) -> Iterator[tuple]:
    """(run, first block, end block, slots) of consecutive blocks, cut at multiples of ``RUN``."""
    lo, end = first, first + len(slots)
    while lo < end:
        hi = min(end, (lo // RUN + 1) * RUN)
        yield lo // RUN, lo, hi, slots[lo - first:hi - first]
        lo = hi


def pfair_mix(docs: DataFrame, weights: dict[str | None, float] | None = None, block_bytes: int = 1 << 18,
              resolution: int = 1000, seed: int = 11) -> DataFrame:
    """Order of all documents in which each source follows its target weight.

    ``weights`` maps a source to its target share of bytes; without it, shares go by the square root of a source's
    bytes (temperature 2).  A source that the map lacks gets the smallest share.  ``resolution`` is the smallest period.
    Returns
    ``doc_id, source, text_hash, block, phase, slot, position``; ``position`` is gapless from 0.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
                       F.greatest(F.octet_length(text), F.lit(1)).cast("long").alias("size"),
                       F.xxhash64(text).alias("text_hash"))
    rows = stored(rows.withColumn("shuffled", F.xxhash64(F.lit(seed), "doc_id", "text_hash")), "mix")
    by_source = rows.groupBy("source").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).collect()
    by_source.sort(key=lambda r: (r["source"] is not None, r["source"] or ""))
    blocks = [-(-r["bytes"] // block_bytes) for r in by_source]
    if weights is None:
        target = [float(r["bytes"]) ** 0.5 for r in by_source]
    else:
        target = [float(weights.get(r["source"], 0.0)) for r in by_source]
    plan = [(by_source[s]["source"], run, lo, hi, phase, own) for s, first, phase, slots in
            phases(blocks, target, resolution) for run, lo, hi, own in runs(first, slots)]
    # One slot a block.
    plan = F.broadcast(spark.createDataFrame(plan, PLACED).withColumnRenamed("source", "of"))
    buckets = max(64, sum(r["n"] for r in by_source) // 100_000)
    spread = F.shiftright(F.col("shuffled"), 40) + F.lit(1 << 23)  # order-preserving, 24 bits
    spread = F.floor(spread * F.lit(buckets) / F.lit(1 << 24))
    rows = bucketed_prefix(rows, ["source"], ["shuffled", "doc_id"], F.col("size"), "offset", spread=spread)
    rows = rows.withColumn("block", F.floor(F.col("offset") / F.lit(block_bytes)).cast("long"))
    rows = rows.join(plan, F.col("source").eqNullSafe(F.col("of"))
                     & (F.floor(F.col("block") / F.lit(RUN)).cast("long") == F.col("run"))
                     & (F.col("block") >= F.col("first_block")) & (F.col("block") < F.col("end_block")))
    slot = F.element_at("slots", (F.col("block") - F.col("first_block") + 1).cast("int"))
    rows = stored(rows.select("doc_id", "source", "text_hash", "size", "block", "phase", slot.alias("slot"), "offset"),
                  "mix")
    stretch = max(1, -(-sum(blocks) // 4096))
    rows = bucketed_prefix(rows, [], ["slot", "offset"], F.lit(1), "position",
                           spread=F.floor(F.col("slot") / F.lit(stretch)))
    return rows.select("doc_id", "source", "text_hash", "block", "phase", "slot", "position")


def first_places(placed: DataFrame) -> DataFrame:
    """``_doc, _hash, _position``: the first position of each id and text."""
    return placed.groupBy("doc_id", "text_hash").agg(F.min("position").alias("_position")).select(
        F.col("doc_id").alias("_doc"), F.col("text_hash").alias("_hash"), "_position")


def in_mixed_order(docs: DataFrame, placed: DataFrame) -> DataFrame:
    """All columns of ``docs``, range-partitioned and sorted by position; equal rows lie side by side."""
    at = first_places(placed)
    inside, restored = set_apart(docs)
    keyed = inside.withColumn("_of", F.xxhash64(F.coalesce(F.col("text"), F.lit(""))))
    joined = keyed.join(at, F.col("doc_id").cast("long").eqNullSafe(F.col("_doc")) & (F.col("_of") == F.col("_hash")))
    return restored(joined.repartitionByRange("_position").sortWithinPartitions("_position"))
