"""The index job (J1-J12 in one): list, diff, read, metadata, type, birth, cache, history, upsert.

``indexed_rows`` is the relational middle of it, from a work list and the files' contents to catalog rows; ``index_job``
runs it against real files and the catalog store.  Only paths that are new or changed are read, each once; files that cannot
be read are returned, not indexed.  Metadata documents are taken from the cache by content id, so copies of a file are
extracted once; the caller supplies the extractor for the rest.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mediafold import schemas
from mediafold.functions.names import with_birth_from_name
from mediafold.operators import catalog as C
from mediafold.operators import filters, metacache, mime
from mediafold.operators import tags as TG
from mediafold.operators.normalize import normalize_tags
from mediafold.sources import catalog as store
from mediafold.sources import listing as L

Extractor = Callable[[DataFrame], DataFrame]  # (name) rows -> (name, json) rows


@dataclass
class IndexResult:
    rows: DataFrame          # catalog rows written
    unreadable: DataFrame    # name, error
    run: str | None          # id of the run, None if nothing changed


def documents_by_id(contents: DataFrame, cache: DataFrame, extracted: DataFrame | None) -> DataFrame:
    """``id, json, cached``: the cached document of each id, else the extracted one of its first file by name."""
    looked = metacache.cache_lookup(contents, cache).select("id", F.col("json").alias("_cached"))
    if extracted is None:
        return looked.select("id", F.col("_cached").alias("json"), F.lit(True).alias("cached")).where("json is not null")
    new = (contents.join(extracted.select("name", "json"), "name").groupBy("id")
           .agg(F.min_by("json", "name").alias("_new")))
    return (looked.join(new, "id", "left").select(
        "id", F.coalesce("_cached", "_new").alias("json"), F.col("_cached").isNotNull().alias("cached"))
        .where("json is not null"))


def indexed_rows(work: DataFrame, contents: DataFrame, docs: DataFrame, regions: DataFrame | None = None,
                 now_year: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(catalog rows, normalised metadata per id).

    ``work``: ``name, hostname, size, timemodified``; ``contents``: ``name, id, header``; ``docs``: see
    :func:`documents_by_id`.  A type comes from the signature, else from the metadata; a birth from the metadata, else from
    the name, else from the file's time.
    """
    meta = normalize_tags(docs.withColumn("tags", TG.parse_typed_tags(F.col("json"))), "tags", regions)
    meta = L._stored(meta, "normalized")  # the rows and the cache read it; no filter of theirs reaches into the parsing
    facts = meta.select("id", F.col("mime_type").alias("_mime"), F.col("birth").alias("_birth"))
    rows = with_birth_from_name(work.join(contents, "name"), now_year=now_year)
    rows = mime.classify(rows.join(facts, "id", "left"), "header", "_mime")
    known = F.col("_birth").isNotNull()
    rows = (rows.withColumn("timebornsrc", F.when(known, F.lit("meta")).otherwise(F.col("timebornsrc")))
            .withColumn("timeborn", F.when(known, F.col("_birth")).otherwise(F.col("timeborn"))))
    return rows.select(*C.CATALOG_COLUMNS), meta


def _created(spark: SparkSession, path: str, schema) -> DataFrame:
    """An append-only table, made on first use: one folder a run."""
    spark.createDataFrame([], schema).write.mode("append").parquet(path)
    return spark.read.schema(schema).option("recursiveFileLookup", True).parquet(path)


def index_job(spark: SparkSession, root: str, hostname: str, store_root: str, extract: Extractor | None = None,
              regions: DataFrame | None = None, ignore: DataFrame | None = None, now_year: int | None = None,
              changed_at: int = 0, run_id: str | None = None) -> IndexResult:
    """Index the files below ``root`` into the catalog at ``store_root`` (tables ``files``, ``history``, ``cache``).

    History and cache rows of a run lie in a folder of its ``run_id``, written before the catalog: a run that failed and is
    started again under the same id replaces what it had written.
    """
    run_id = run_id or uuid.uuid4().hex
    table = store.create_catalog(spark, store_root)
    listing = filters.size_filter(L.list_files(spark, root, hostname))
    if ignore is not None:
        listing = filters.ignored_paths(listing, ignore, key="name", path_col="name").where("not ignored").drop("ignored")
    catalog = store.read_table(spark, table, hosts=[hostname])
    work = C.work_list(listing, catalog, hostname)
    hashed = L.hash_files(work)
    contents = L.readable(hashed)
    cache = _created(spark, f"{store_root}/cache", schemas.META_CACHE)
    _created(spark, f"{store_root}/history", schemas.FILES_HISTORY)
    extracted = None
    if extract is not None:
        todo = contents.join(metacache.to_extract(contents, cache), "id", "left_semi")
        # One file per content id is enough.
        first = todo.groupBy("id").agg(F.min("name").alias("name")).select("name")
        extracted = L._stored(extract(first).select("name", "json"), "extracted")
    docs = documents_by_id(contents, cache, extracted)
    rows, meta = indexed_rows(work, contents, docs, regions, now_year)
    rows = L._stored(rows, "indexed")  # the history, the upsert and the caller all read it
    if rows.isEmpty():
        return IndexResult(rows, L.unreadable(hashed), None)
    new_cache = metacache.cache_writes(meta.where("not cached"))
    new_cache.write.mode("overwrite").parquet(f"{store_root}/cache/run={run_id}")
    C.change_log(catalog, rows, changed_at).write.mode("overwrite").parquet(f"{store_root}/history/run={run_id}")
    store.upsert_table(rows, table)
    return IndexResult(rows, L.unreadable(hashed), run_id)
