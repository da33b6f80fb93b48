"""File listing and content reading (A1, A2, C1, G1, D8 on real files).

The walk is a job of its own, not the ``binaryFile`` source: Hadoop listing
hides names that start with ``.`` or ``_`` (``_MG_0001.jpg`` is a camera name).
Directories are rows; each level of the tree is listed by the executors and
written to shared storage, and its sub-directories are the next level's rows.
Links to directories are followed, within the root and out of it, but each real
directory (device and inode) is listed once, so links that lead back up end and
no file is listed twice through them.  Any file system that ``pyarrow.fs`` knows will do (local or mounted, HDFS, S3,
GCS).

Hashing reads only the files that need indexing (the catalog diff's work
list), in chunks, spread over tasks by the bytes to read.  Its result is written
once to shared storage, so no later branch reads a file again.  A file that
cannot be read is reported, never given an id.
"""

from __future__ import annotations

import uuid
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HEADER_BYTES = 8192          # fixed value: bytes kept for type detection
CHUNK_BYTES = 8 * 1024 * 1024
TASK_BYTES = 1 << 30         # bytes a hash task should read
ENTRY_SCHEMA = "path string, kind string, size long, timemodified long, error string, ident string, linked boolean"
HASH_SCHEMA = "name string, id long, header binary, read_ok boolean, error string"


def open_filesystem(path: str):
    """(file system, path in it, prefix that turns such a path back into a full one)."""
    from pyarrow import fs
    if "://" not in path and path.startswith("file:"):
        path = path[len("file:"):]
    system, inner = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    local = isinstance(system, fs.LocalFileSystem)
    return system, inner, "" if local else path[:len(path) - len(inner)]


def _stored(df: DataFrame, name: str) -> DataFrame:
    from mediafold.session import checkpoint_dir
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _ident(path: str, local: bool) -> str:
    """What tells a directory from others however it is reached: device and inode, its path where there are no links."""
    import os
    if not local:
        return path
    at = os.stat(path)
    return f"{at.st_dev}:{at.st_ino}"


def _list_directories(batches):
    import os

    from pyarrow import fs
    for batch in batches:
        rows: list[tuple] = []
        for directory in batch.column(0).to_pylist():
            try:
                system, inner, prefix = open_filesystem(directory)
                local = isinstance(system, fs.LocalFileSystem)
                rows.append((directory, "self", None, None, None, _ident(inner, local), None))
                for e in system.get_file_info(fs.FileSelector(inner, recursive=False)):
                    if e.type == fs.FileType.Directory:
                        try:
                            rows.append((prefix + e.path, "dir", None, None, None, _ident(e.path, local),
                                         local and os.path.islink(e.path)))
                        except OSError as error:  # gone or closed since it was listed
                            rows.append((prefix + e.path, "error", None, None, str(error)[:300], None, None))
                    elif e.type == fs.FileType.File:
                        mtime = None if e.mtime_ns is None else (e.mtime_ns + 500_000_000) // 1_000_000_000
                        rows.append((prefix + e.path, "file", e.size, mtime, None, None, None))
            except OSError as error:
                rows.append((directory, "error", None, None, str(error)[:300], None, None))
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[i] for r in rows], t) for i, t in enumerate(
                (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.bool_()))],
            ["path", "kind", "size", "timemodified", "error", "ident", "linked"])


def walk(spark: SparkSession, root: str) -> DataFrame:
    """Every file and directory below ``root`` (``kind`` file, dir or error), stored; no name is left out.

    A real directory is listed under one name: of the names that a level finds for it the first one that is no link.  A link
    to a directory that is listed under another name is a ``dir`` row without entries.
    """
    tasks = spark.sparkContext.defaultParallelism
    frontier = spark.createDataFrame([(root.rstrip("/") or "/",)], "path string")
    levels = []
    while True:
        levels.append(_stored(frontier.repartition(tasks).mapInArrow(_list_directories, ENTRY_SCHEMA), "walk"))
        found = reduce(DataFrame.unionByName, levels)
        names = levels[-1].where("kind = 'dir'").groupBy("ident").agg(F.min(F.struct("linked", "path")).alias("first"))
        frontier = names.join(found.where("kind = 'self'").select("ident"), "ident", "left_anti").select("first.path")
        if frontier.isEmpty():
            break
    return found.where("kind <> 'self'").drop("ident", "linked")


def list_files(spark: SparkSession, root: str, hostname: str, pattern: str | None = None,
               entries: DataFrame | None = None) -> DataFrame:
    """A1/A2: ``(name, hostname, size, timemodified)``; mtime rounded half up to the second.

    ``pattern`` is a regular expression on the base name; ``entries`` a walk that was made before.
    """
    files = (entries if entries is not None else walk(spark, root)).where("kind = 'file'")
    if pattern is not None:
        files = files.where(F.element_at(F.split("path", "/"), -1).rlike(pattern))
    return files.select(F.col("path").alias("name"), F.lit(hostname).alias("hostname"), "size", "timemodified")


def content_id(stream) -> tuple[int, bytes]:
    """(signed XXH3-64, first bytes) of an open input stream."""
    import xxhash
    h, head = xxhash.xxh3_64(), b""
    while chunk := stream.read(CHUNK_BYTES):
        if len(head) < HEADER_BYTES:
            head += chunk[:HEADER_BYTES - len(head)]
        h.update(chunk)
    i = h.intdigest()
    return i - (1 << 64) if i >= 1 << 63 else i, head


def _hash_partition(batches):
    for batch in batches:
        rows = []
        for name in batch.column(0).to_pylist():
            try:
                system, inner, _ = open_filesystem(name)
                with system.open_input_stream(inner) as f:
                    i, head = content_id(f)
                rows.append((name, i, head, True, None))
            except OSError as error:
                rows.append((name, None, None, False, str(error)[:300]))
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[i] for r in rows], t) for i, t in enumerate(
                (pa.string(), pa.int64(), pa.binary(), pa.bool_(), pa.string()))],
            ["name", "id", "header", "read_ok", "error"])


def hash_files(work: DataFrame, partitions: int | None = None) -> DataFrame:
    """G1 on file bytes: ``name, id, header, read_ok, error``, read once and stored.

    Without ``partitions`` the number of tasks follows the bytes to read (column ``size`` if there is one).  Unreadable
    files have ``read_ok`` false and no id; see :func:`readable` and :func:`unreadable`.
    """
    if partitions is None:
        size = F.sum("size") if "size" in work.columns else F.lit(0)
        n, total = work.agg(F.count("*"), size).first()
        tasks = work.sparkSession.sparkContext.defaultParallelism
        partitions = max(1, min(n, max(tasks, -(-(total or 0) // TASK_BYTES))))
    spread = work.select("name").repartition(partitions)
    return _stored(spread.mapInArrow(_hash_partition, HASH_SCHEMA), "hashes")


def readable(hashed: DataFrame) -> DataFrame:
    """Files with a content id; only these go on to the catalog."""
    return hashed.where("read_ok").select("name", "id", "header")


def unreadable(hashed: DataFrame) -> DataFrame:
    """Files that could not be read, with the reason."""
    return hashed.where("not read_ok").select("name", "error")
