"""Duplicate-content groups (J13: E1-E6, C6, F1, A4, D5).

One row per content id.  Every statistic is an algebraic aggregate
(``count``/``min``/``max``/``sum``/``min_by``), so Spark combines it map-side
before the shuffle on ``id``: a content id that holds a third of all rows
still arrives at its reducer as one partial row per input partition, never as
a list.  No member list is collected.

The reference folds the group in arrival order against a running value; here
the order is fixed: the existing backup first, then members by ``name``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mediafold.functions.ids import id_hex
from mediafold.functions.paths import basename

_ROW_FIELDS = ["name", "hostname", "size", "timemodified", "timeborn", "timebornsrc",
               "mimetype", "mimesubtype"]


def group_stats(files: DataFrame, host: str | None = None) -> DataFrame:
    """Per-id partial statistics over the catalog members (E2-E6 inputs)."""
    if host is not None:
        files = files.where(F.col("hostname") == host)
    m = files.select(*_ROW_FIELDS, "id").withColumn("basename", basename(F.col("name")))
    is_meta = F.col("timebornsrc") == "meta"
    return m.groupBy("id").agg(
        F.count(F.lit(1)).alias("n_members"),
        F.count_distinct("basename").alias("n_names"),
        # F1 without a backup: first member by name (struct order = name first).
        F.min(F.struct(*_ROW_FIELDS)).alias("first"),
        F.min("size").alias("min_size"),
        F.max("size").alias("max_size"),
        F.min("timemodified").alias("min_mtime"),
        F.min("timeborn").alias("min_birth"),
        F.min(F.when(is_meta, F.col("timeborn"))).alias("meta_min_birth"),
        F.max(F.when(is_meta, F.col("timeborn"))).alias("meta_max_birth"),
        # E5: shortest basename by bytes; ties keep the earlier member.
        F.min_by("basename", F.struct(F.octet_length("basename"), F.col("name"))).alias("short_name"),
        F.sum("size").alias("total_bytes"),
    )


PUBLIC_COLUMNS = ["id", "id_hex", "n_members", "n_names", "has_backup", "base_name", "name", "size",
                  "timemodified", "timeborn", "timebornsrc", "mimetype", "mimesubtype", "total_bytes",
                  "saved_bytes", "conflict"]


def duplicate_groups(files: DataFrame, backups: DataFrame | None = None,
                     host: str | None = None) -> DataFrame:
    return reduced_groups(files, backups, host).select(*PUBLIC_COLUMNS)


def group_conflicts(files: DataFrame, backups: DataFrame | None = None,
                    host: str | None = None) -> DataFrame:
    """Groups whose members disagree on size, or on a metadata birth time.

    The anchor is the base row's birth (the reference compared with a running
    minimum, so its verdict depended on row order).  Reported, never fatal.
    """
    return (reduced_groups(files, backups, host).where("conflict")
            .select("id", "id_hex", "n_members", "base_name", "size", "timeborn",
                    "size_conflict", "birth_conflict"))


def reduced_groups(files: DataFrame, backups: DataFrame | None = None,
                   host: str | None = None) -> DataFrame:
    """Reduce every content id to one representative row.

    ``backups`` is the ``filez`` table (one row per id).  Output columns:
    ``id, id_hex, n_members, n_names, has_backup, base_name, name, size,
    timemodified, timeborn, timebornsrc, mimetype, mimesubtype, total_bytes,
    saved_bytes, conflict``.
    """
    g = group_stats(files, host)
    if backups is not None:
        # The existing backup of each id, one left join instead of one query per id
        extra = ["state"] if "state" in backups.columns else []
        b = backups.select("id", F.struct(*_ROW_FIELDS, *extra).alias("backup"))
        g = g.join(b, "id", "left")  # both sides one row per id: no skew
    else:
        extra = []
        g = g.withColumn("backup", F.lit(None).cast(g.schema["first"].dataType))

    first = F.struct(*[F.col("first")[c].alias(c) for c in _ROW_FIELDS], *[F.lit(None).cast("string").alias(c)
                                                                           for c in extra])
    base = F.coalesce(F.col("backup"), first)
    base_bn = basename(base["name"])
    anchor = base["timeborn"]
    # Sizes differ, or a birth taken from metadata differs from the anchor.
    size_conflict = (F.col("min_size") != base["size"]) | (F.col("max_size") != base["size"])
    birth_conflict = (F.coalesce(F.col("meta_min_birth") != anchor, F.lit(False))
                      | F.coalesce(F.col("meta_max_birth") != anchor, F.lit(False)))
    # E5 with a backup present: a member replaces the backup's name only if strictly shorter.
    short = F.when(
        F.col("backup").isNull() | (F.octet_length("short_name") < F.octet_length(base_bn)),
        F.col("short_name"),
    ).otherwise(base_bn)
    return g.select(
        "id",
        id_hex(F.col("id")).alias("id_hex"),
        "n_members",
        "n_names",
        F.col("backup").isNotNull().alias("has_backup"),
        base["name"].alias("base_name"),
        short.alias("name"),
        base["size"].alias("size"),
        F.least(base["timemodified"], F.col("min_mtime")).alias("timemodified"),  # E3
        F.least(base["timeborn"], F.col("min_birth")).alias("timeborn"),  # E4
        base["timebornsrc"].alias("timebornsrc"),
        base["mimetype"].alias("mimetype"),
        base["mimesubtype"].alias("mimesubtype"),
        "total_bytes",
        # bytes held by members beyond one kept copy
        (F.col("total_bytes") - base["size"]).alias("saved_bytes"),
        (size_conflict | birth_conflict).alias("conflict"),
        size_conflict.alias("size_conflict"),
        birth_conflict.alias("birth_conflict"),
        F.col("backup.name").alias("backup_name"),
        *[F.col(f"backup.{c}").alias(f"backup_{c}") for c in extra],
    )


def alternate_names(files: DataFrame, host: str | None = None) -> DataFrame:
    """(id, basename, n_files) for ids whose members carry more than one name.

    Two grouped aggregations joined on ``id``; never a per-id list.
    """
    if host is not None:
        files = files.where(F.col("hostname") == host)
    pairs = (files.select("id", basename(F.col("name")).alias("basename"))
             .groupBy("id", "basename").agg(F.count(F.lit(1)).alias("n_files")))
    multi = pairs.groupBy("id").agg(F.count(F.lit(1)).alias("n_names")).where("n_names > 1")
    return pairs.join(multi.select("id"), "id", "left_semi")


def status_counts(df: DataFrame, status_col: str = "status") -> DataFrame:
    """Counters per status."""
    return df.groupBy(status_col).agg(F.count(F.lit(1)).alias("n"))
