"""Metadata cache keyed by content id.

The cache is a table ``(id, namespace, key, json)``.  Looking it up is a
left join of the distinct content ids (duplicates are parsed once); the ids
still to extract are the ``left_anti`` side.  Only results with a plausible
taken time are written back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediafold.functions.ids import id_hex

DEFAULT_NAMESPACE = "json"
DEFAULT_KEY = "exiftool.json"
MIN_CACHED_YEAR = 1900


def cache_name(hex_id: Column, key: Column | str) -> Column:
    """``{hash}_{key}``; NULL (an error) when the key is empty."""
    k = F.lit(key) if isinstance(key, str) else key
    return F.when(F.coalesce(k, F.lit("")) != "", F.concat(hex_id, F.lit("_"), k))


def cache_lookup(ids: DataFrame, cache: DataFrame, namespace: str = DEFAULT_NAMESPACE,
                 key: str = DEFAULT_KEY) -> DataFrame:
    """Distinct ids + ``json`` from the cache + ``status`` (cached / extract)."""
    c = (cache.where((F.col("namespace") == namespace) & (F.col("key") == key))
         .select("id", "json"))
    return (ids.select("id").distinct().join(c, "id", "left")
            .withColumn("status", F.when(F.col("json").isNotNull(), "cached").otherwise("extract"))
            .withColumn("cache_name", cache_name(id_hex(F.col("id")), key)))


def to_extract(ids: DataFrame, cache: DataFrame, namespace: str = DEFAULT_NAMESPACE,
               key: str = DEFAULT_KEY) -> DataFrame:
    """Ids with no cache entry (``left_anti``)."""
    c = cache.where((F.col("namespace") == namespace) & (F.col("key") == key)).select("id")
    return ids.select("id").distinct().join(c, "id", "left_anti")


def cache_writes(extracted: DataFrame, taken_col: str = "taken_utc", namespace: str = DEFAULT_NAMESPACE,
                 key: str = DEFAULT_KEY) -> DataFrame:
    """New cache rows, only for results taken after 1900."""
    ok = F.year(F.timestamp_seconds(F.col(taken_col))) > MIN_CACHED_YEAR
    return extracted.where(F.coalesce(ok, F.lit(False))).select(
        "id", F.lit(namespace).alias("namespace"), F.lit(key).alias("key"), "json")
