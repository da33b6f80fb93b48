"""Row filters of the index and backup jobs."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Largest file accepted (8 GiB) and the media types backed up.
MAX_FILE_BYTES = 8 * 1024 ** 3
BACKUP_MEDIA_TYPES = ("video", "audio", "image")
# Pattern tables up to this many rows are broadcast; larger ones are joined
# by shuffle (AQE splits a hot prefix key).
PATTERN_BYTES = 1 << 20


def size_ok(size_col: str = "size"):
    """Non-empty and at most 8 GiB."""
    return (F.col(size_col) > 0) & (F.col(size_col) <= MAX_FILE_BYTES)


def size_filter(files: DataFrame, size_col: str = "size") -> DataFrame:
    return files.where(size_ok(size_col))


def backup_media(mime_col: str = "mimetype"):
    """C4: only video, audio and image content is copied (unknown type: not media)."""
    return F.coalesce(F.col(mime_col).isin(*BACKUP_MEDIA_TYPES), F.lit(False))


def glob_to_regex(glob: str) -> str:
    """Glob -> anchored regex: ``**`` any path, ``*`` within a segment, ``?`` one char."""
    out, i = [], 0
    while i < len(glob):
        ch = glob[i]
        if glob.startswith("**", i):
            out.append(".*")
            i += 2
            continue
        if ch == "*":
            out.append("[^/]*")
        elif ch == "?":
            out.append("[^/]")
        else:
            out.append(re.escape(ch))
        i += 1
    return "^" + "".join(out) + "$"


def ancestors(path):
    """Directory prefixes of a path: '' then 'a/', 'a/b/', ... (bounded by depth)."""
    parts = F.split(path, "/")
    return F.transform(
        F.sequence(F.lit(0), F.size(parts) - 1),
        lambda i: F.when(i == 0, F.lit("")).otherwise(
            F.concat(F.array_join(F.slice(parts, F.lit(1), i), "/"), F.lit("/"))))


def ignored_paths(paths: DataFrame, patterns: DataFrame, key: str = "key",
                  path_col: str = "path") -> DataFrame:
    """Flag paths matched by an ignore pattern of an enclosing directory.

    ``patterns`` has ``dir`` (prefix ending in '/' or '' for the root) and
    ``regex`` (see :func:`glob_to_regex`); a pattern matches the path
    relative to its directory or the path's basename.  Patterns whose measured
    bytes stay under ``PATTERN_BYTES`` become one map from directory to
    patterns (a scalar subquery), looked up for each ancestor of a path in the
    projection: no join, no shuffle.  A larger table is equi-joined with the
    paths' exploded ancestors.  Returns ``paths`` plus ``ignored``.
    """
    size = patterns.agg(F.sum(F.octet_length("dir") + F.octet_length("regex") + 32)).first()[0] or 0
    if size <= PATTERN_BYTES:
        by_dir = (patterns.groupBy("dir").agg(F.collect_list("regex").alias("r"))
                  .agg(F.map_from_entries(F.collect_list(F.struct("dir", "r"))).alias("m")))
        path, base = F.col(path_col), F.element_at(F.split(F.col(path_col), "/"), -1)
        staged = paths.withColumn("_of", by_dir.scalar()).withColumn("_base", base).withColumn("_dirs", ancestors(path))

        def hits(d):
            rel = F.substring(path, F.length(d) + 1, F.length(path))
            none = F.array().cast("array<string>")
            return F.exists(F.coalesce(F.try_element_at(F.col("_of"), d), none),
                            lambda r: F.regexp_like(rel, r) | F.regexp_like(F.col("_base"), r))
        return staged.withColumn("ignored", F.coalesce(F.exists("_dirs", hits), F.lit(False))).drop("_of", "_base", "_dirs")
    pats = patterns.select(F.col("dir").alias("_dir"), F.col("regex").alias("_regex"))
    exploded = paths.select(key, path_col, F.explode(ancestors(F.col(path_col))).alias("_dir"))
    rel = F.expr(f"substring({path_col}, length(_dir) + 1)")
    base = F.element_at(F.split(F.col(path_col), "/"), -1)
    hit = (exploded.join(pats, "_dir")
           .where(F.regexp_like(rel, F.col("_regex")) | F.regexp_like(base, F.col("_regex")))
           .select(key).distinct().withColumn("ignored", F.lit(True)))
    return (paths.join(hit, key, "left")
            .withColumn("ignored", F.coalesce(F.col("ignored"), F.lit(False))))
