"""Catalog diff, upsert and change log (J12: A3, D1-D3, C3, F5, F6, B2, B3).

A listing ``(name, hostname, size, timemodified)`` is compared with the stored
catalog.  All joins are equi-joins on ``(name, hostname)``: Spark shuffles
both sides on the key (or broadcasts a side AQE measures as small), so one
host holding most files still spreads over many partitions because ``name``
is part of the key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEY = ["name", "hostname"]
CATALOG_COLUMNS = ["name", "hostname", "id", "size", "timemodified", "timeborn", "timebornsrc",
                   "mimetype", "mimesubtype"]


def host_snapshot(catalog: DataFrame, host: str | None = None) -> DataFrame:
    """A3: the four columns the diff needs (partition-pruned on ``hostname``)."""
    if host is not None:
        catalog = catalog.where(F.col("hostname") == host)
    return catalog.select("name", "hostname", "size", "timemodified", "id")


def catalog_diff(listing: DataFrame, catalog: DataFrame, host: str | None = None,
                 include_vanished: bool = True) -> DataFrame:
    """Classify every listed path as new, changed or unchanged.

    With ``include_vanished`` catalog rows missing from the listing are
    reported as ``vanished`` (the reference never removes them).
    Columns: name, hostname, status, size, timemodified, old_size,
    old_timemodified, old_id.
    """
    if host is not None:
        listing = listing.where(F.col("hostname") == host)
    snap = host_snapshot(catalog, host).select(
        *KEY, F.col("size").alias("old_size"), F.col("timemodified").alias("old_timemodified"),
        F.col("id").alias("old_id"), F.lit(True).alias("_in_catalog"))
    lst = listing.select(*KEY, "size", "timemodified", F.lit(True).alias("_listed"))
    j = lst.join(snap, KEY, "full_outer" if include_vanished else "left")
    same = (F.col("size") == F.col("old_size")) & (F.col("timemodified") == F.col("old_timemodified"))
    status = (F.when(F.col("_listed").isNull(), F.lit("vanished"))
              .when(F.col("_in_catalog").isNull(), F.lit("new"))
              .when(same, F.lit("unchanged"))
              .otherwise(F.lit("changed")))
    return j.select(*KEY, status.alias("status"), "size", "timemodified", "old_size",
                    "old_timemodified", "old_id")


def work_list(listing: DataFrame, catalog: DataFrame, host: str | None = None) -> DataFrame:
    """Listing minus unchanged paths (key-based ``left_anti``).

    This runs before any content is read, so unchanged files are never hashed.
    """
    if host is not None:
        listing = listing.where(F.col("hostname") == host)
    unchanged = host_snapshot(catalog, host).select(*KEY, "size", "timemodified")
    return listing.join(unchanged, KEY + ["size", "timemodified"], "left_anti")


def upsert(catalog: DataFrame, new_rows: DataFrame, scope: str = "host") -> DataFrame:
    """Replace catalog rows by the new rows of the same path.

    ``scope='host'`` (default) replaces ``(name, hostname)``; ``scope='name'``
    reproduces the reference, whose delete matched ``name`` on every host.  A NULL host is a host like any other.
    """
    key = KEY if scope == "host" else ["name"]
    if scope not in ("host", "name"):
        raise ValueError("scope must be 'host' or 'name'")
    old, new = catalog.select(*CATALOG_COLUMNS).alias("o"), new_rows.select(*key).distinct().alias("n")
    same = [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in key]
    kept = old.join(new, same, "left_anti")
    return kept.unionByName(new_rows.select(*CATALOG_COLUMNS))


def change_log(catalog: DataFrame, new_rows: DataFrame, changed_at: int) -> DataFrame:
    """Previous and new values of every replaced row (append-only history)."""
    old = catalog.select(*KEY, F.col("id").alias("old_id"), F.col("size").alias("old_size"),
                         F.col("timemodified").alias("old_timemodified"))
    new = new_rows.select(*KEY, F.col("id").alias("new_id"), F.col("size").alias("new_size"),
                          F.col("timemodified").alias("new_timemodified"))
    return old.join(new, KEY, "inner").select(
        *KEY, "old_id", "old_size", "old_timemodified", "new_id", "new_size", "new_timemodified",
        F.lit(changed_at).cast("bigint").alias("changed_at"))


def presentation_order(df: DataFrame) -> DataFrame:
    """the walk's sorted order, applied only where results are presented
    (a global sort; never needed for the jobs themselves)."""
    return df.orderBy("name", "hostname")
