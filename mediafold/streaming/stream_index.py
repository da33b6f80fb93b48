"""Continuous index (I1) and duplicate content on arrival (I2) with Structured Streaming.

I1: a file-listing stream (any streaming source with an explicit schema) is mapped to catalog rows; a streaming aggregate
keeps the newest row of each path in the state store (distributed, checkpointed, on disk with RocksDB).  Each micro-batch
writes the paths that it touched, and nothing else, to a folder of its own number, so what a batch writes grows with
the batch and not with the hosts or the catalog, and a batch that is delivered again replaces itself.  The newest row
of a path wins wherever it arrives, so the final catalog does not depend on how the input is cut into files or batches.
:func:`latest_catalog` is the last version of each path, :func:`change_history` the versions that replaced another.

I2: ``dropDuplicates(['id'])`` keeps the ids seen in the state store (distributed, on disk with RocksDB), so an id is
emitted once however the input is cut.  With ``delay`` the state is bounded by a watermark instead, and an id that
comes again after that time is emitted again.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mediafold import schemas
from mediafold.operators import catalog as C
from mediafold.session import checkpoint_dir


def scratch_root(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint directory of the session."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def newest_rows(rows: DataFrame) -> DataFrame:
    """One row per path: the newest by modification time; equal times by the other columns, so the pick is fixed."""
    rest = [c for c in C.CATALOG_COLUMNS if c not in C.KEY]
    order = F.struct("timemodified", *[c for c in rest if c != "timemodified"])
    return (rows.groupBy(*C.KEY).agg(F.max_by(F.struct(*rest), order).alias("r"))
            .select(*C.KEY, "r.*").select(*C.CATALOG_COLUMNS))


def path_versions(rows: DataFrame) -> DataFrame:
    """The newest row so far of every path that a micro-batch of catalog rows touches (output mode ``update``)."""
    return newest_rows(rows.select(*C.CATALOG_COLUMNS))


def write_versions(root: str) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` function: the versions of a micro-batch become the folder of its number."""
    def run(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/batch={batch_id}")
    return run


def start_index_stream(stream: DataFrame, to_catalog_rows: Callable[[DataFrame], DataFrame], root: str,
                       checkpoint: str, available_now: bool = True):
    """Start the continuous index; versions of paths go to ``root``.  Returns the StreamingQuery."""
    w = (path_versions(to_catalog_rows(stream)).writeStream.outputMode("update").foreachBatch(write_versions(root))
         .option("checkpointLocation", checkpoint))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start()


def versions(spark: SparkSession, root: str) -> DataFrame:
    """All versions so far: catalog columns and ``batch``; a path that a batch touched in vain comes again unchanged."""
    schema = T.StructType([schemas.FILES[c] for c in C.CATALOG_COLUMNS]).add("batch", "long")
    return spark.read.schema(schema).option("basePath", root).parquet(root)


def latest_catalog(spark: SparkSession, root: str) -> DataFrame:
    """The catalog: the last version of each path."""
    rest = [c for c in C.CATALOG_COLUMNS if c not in C.KEY]
    last = versions(spark, root).groupBy(*C.KEY).agg(F.max_by(F.struct(*rest), "batch").alias("r"))
    return last.select(*C.KEY, "r.*").select(*C.CATALOG_COLUMNS)


def change_history(spark: SparkSession, root: str) -> DataFrame:
    """Previous and new values of every replaced row, and the ``batch`` that replaced it; once each."""
    rest = F.struct(*[c for c in C.CATALOG_COLUMNS if c not in C.KEY])
    before = F.lag(rest).over(Window.partitionBy(*C.KEY).orderBy("batch"))
    pairs = versions(spark, root).select(*C.KEY, "batch", rest.alias("new"), before.alias("old"))
    return pairs.where("old is not null and not old <=> new").select(
        *C.KEY, *[F.col(f"{side}.{c}").alias(f"{side}_{c}") for side in ("old", "new") for c in ("id", "size", "timemodified")],
        "batch")


def start_dedupe_stream(stream: DataFrame, to_rows: Callable[[DataFrame], DataFrame], out: str, checkpoint: str,
                        event_time: str = "ts", delay: str | None = None, available_now: bool = True):
    """First arrival of each content id, appended to a parquet table."""
    rows = to_rows(stream)
    rows = rows.dropDuplicates(["id"]) if delay is None else \
        rows.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(["id"])
    w = rows.writeStream.format("parquet").outputMode("append").option("path", out) \
        .option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start()
