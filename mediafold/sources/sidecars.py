"""Sidecar sources: photo / album JSON and XMP.

Sidecar text arrives as a column (e.g. ``spark.read.text(path, wholetext=True)``
plus ``_metadata.file_path``); kind detection and parsing are native
expressions with explicit schemas, so a malformed file yields NULLs and an
``error`` column, never a failed job.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mediafold import schemas
from mediafold.functions import dates as D
from mediafold.functions import text as X
from mediafold.operators.tags import json_kind


def read_json_sidecars(spark: SparkSession, path: str, glob: str = "*.json") -> DataFrame:
    """Whole JSON sidecar files as ``(path, doc, kind)``."""
    df = (spark.read.option("wholetext", True).option("pathGlobFilter", glob)
          .option("recursiveFileLookup", True).text(path))
    return df.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("doc")).withColumn(
        "kind", json_kind(F.col("doc")))


def photo_fields(doc: Column, zone: Column | None = None) -> Column:
    """A8 + C15: struct of the photo sidecar fields; on a frame use :func:`with_photo_fields`, which parses once."""
    return _photo_struct(F.from_json(doc, schemas.PHOTO_SIDECAR), zone)


def with_photo_fields(df: DataFrame, doc_col: str, out: str = "photo", regions: DataFrame | None = None) -> DataFrame:
    """A8 + C15 on a frame: the document is parsed once into a staged column.

    With ``regions`` the zone of the photo's position is looked up and the taken time is re-read in it (H29); the struct
    then also has ``time_zone`` ('' when unknown) and ``taken_local`` (wall clock as Unix seconds).
    """
    from mediafold.operators.timezones import zone_lookup
    parsed = F.array(F.struct(F.from_json(F.col(doc_col), schemas.PHOTO_SIDECAR).alias("_photo")))
    s = df.select("*", F.inline(parsed))  # one row out per row in; the parse cannot be inlined into later steps
    if regions is None:
        return s.withColumn(out, _photo_struct(F.col("_photo"), None)).drop("_photo")
    geo = F.col("_photo.geoData")
    s = zone_lookup(s.withColumn("_zlat", geo["latitude"].cast("float")).withColumn("_zlng", geo["longitude"].cast("float")),
                    regions, "_zlat", "_zlng")
    # The utc clock of the epoch, re-read in the zone; its wall clock there is that of the epoch.
    wall = D.photo_epoch_time(F.col("_photo.photoTakenTime.timestamp"))
    return s.withColumn(out, _photo_struct(F.col("_photo"), F.col("zone"), [
        F.coalesce(F.col("zone"), F.lit("")).alias("time_zone"), wall.alias("taken_local")])).drop(
        "_photo", "_zlat", "_zlng", "zone")


def _photo_struct(p: Column, zone: Column | None, more: list[Column] | None = None) -> Column:
    """title (G9) and description (G10) if non-empty; views if > 0; taken time
    from ``photoTakenTime`` when its epoch is > 0 (H29, re-read in ``zone``
    when given); position when latitude and longitude are both non-zero;
    altitude truncated, only with a position.
    """
    title = X.sanitize_title(p["title"])
    desc = X.sanitize_description(p["description"])
    views = F.when(p["imageViews"].rlike(r"^[0-9]+$"), p["imageViews"].try_cast("int"))
    geo = p["geoData"]
    has_pos = F.coalesce((geo["latitude"] != 0) & (geo["longitude"] != 0), F.lit(False))
    taken = D.photo_epoch_time(p["photoTakenTime"]["timestamp"], zone)
    return F.struct(
        F.when(title != "", title).alias("title"),
        F.when(desc != "", desc).alias("description"),
        F.when(views > 0, views).alias("views"),
        taken.alias("taken_utc"),
        F.when(has_pos, geo["latitude"].cast("float")).alias("lat"),
        F.when(has_pos, geo["longitude"].cast("float")).alias("lng"),
        F.when(has_pos, geo["altitude"].try_cast("int")).alias("altitude"),
        *(more or []),
    )


def albums_by_directory(sidecars: DataFrame, path_col: str = "path", doc_col: str = "doc") -> DataFrame:
    """The albums that the album sidecars of a directory name, one row each: ``directory, title, n_sidecars``."""
    t = sidecars.select(F.regexp_replace(path_col, "/[^/]*$", "").alias("directory"), album_title(F.col(doc_col)).alias("title"))
    return t.where(F.col("title").isNotNull()).groupBy("directory", "title").agg(F.count(F.lit(1)).alias("n_sidecars"))


def album_title(doc: Column) -> Column:
    """The album title when non-empty (one album row per sidecar; E11 keeps albums as rows)."""
    a = F.from_json(doc, schemas.ALBUM_SIDECAR)["albumData"]
    t = F.trim(F.coalesce(a["title"], F.lit("")))
    return F.when(t != "", a["title"])


# -- XMP (A10) -------------------------------------------------------------------

def read_xmp(spark: SparkSession, path: str) -> DataFrame:
    """A10: XMP sidecars -> one merged record per file.

    Every ``rdf:Description`` block is a row.  The schema nests ``Alt``/``Seq`` lists, so the XML reader resolves
    entities and list items itself and text is never parsed a second time.  Where blocks of one file repeat a field,
    the block that comes later in the file wins.
    """
    blocks = (spark.read.format("xml").option("rowTag", "rdf:Description").option("valueTag", "_text")
              .schema(schemas.XMP_BLOCK).load(path)
              .withColumn("path", F.col("_metadata.file_path")).withColumn("_at", F.monotonically_increasing_id()))
    merged = blocks.groupBy("path").agg(*[
        F.max_by(F.col(f"`{c}`"), F.when(_filled(c), F.col("_at"))).alias(c) for c in schemas.XMP_COLUMNS])
    return xmp_fields(merged)


XMP_DOCUMENT = T.StructType([T.StructField("rdf:RDF", T.StructType([
    T.StructField("rdf:Description", T.ArrayType(schemas.XMP_BLOCK))]))])


def xmp_records(df: DataFrame, doc_col: str) -> DataFrame:
    """A10 on a text column: the other columns of ``df`` and the merged, cleaned record of each XMP document.

    Blocks merge inside the row, without a shuffle: of each field the last block that has it wins.  NULL or malformed
    documents give empty texts.
    """
    keep = [c for c in df.columns if c != doc_col]
    parsed = F.from_xml(F.col(f"`{doc_col}`"), XMP_DOCUMENT, {"valueTag": "_text"})
    held = df.select(*[F.col(f"`{c}`").alias(f"_in_{i}") for i, c in enumerate(keep)], parsed["rdf:RDF"]["rdf:Description"].alias("_blocks"))
    merged = held.select(*[f"_in_{i}" for i in range(len(keep))], *[
        F.try_element_at(F.filter(F.col("_blocks"), _has(c)), F.lit(-1))[c].alias(c)
        for c in schemas.XMP_COLUMNS])
    fields = xmp_fields(merged, [f"_in_{i}" for i in range(len(keep))])
    return fields.select(*[F.col(f"_in_{i}").alias(c) for i, c in enumerate(keep)], *fields.columns[len(keep):])


def _has(c: str):
    return lambda block: _filled_in(block, c)


def _filled_in(block: Column, c: str) -> Column:
    """True where a block has the field (for list fields: bare text or items)."""
    col = block[c]
    if c in schemas.XMP_LISTS:
        items = col[f"rdf:{schemas.XMP_LISTS[c]}"]["rdf:li"]
        return F.coalesce((F.trim(F.coalesce(col["_text"], F.lit(""))) != "") | (F.size(items) > 0), F.lit(False))
    return col.isNotNull()


def _item(c: str, kind: str) -> Column:
    return F.col(f"`{c}`")[f"rdf:{kind}"]["rdf:li"]


def _filled(c: str) -> Column:
    """True where a block has the field (for list fields: bare text or items)."""
    col = F.col(f"`{c}`")
    if c in schemas.XMP_LISTS:
        return (F.trim(F.coalesce(col["_text"], F.lit(""))) != "") | (F.size(_item(c, schemas.XMP_LISTS[c])) > 0)
    return col.isNotNull()


def _last_item(c: str, kind: str) -> Column:
    return F.coalesce(F.try_element_at(_item(c, kind), F.lit(-1)), F.lit(""))


def xmp_fields(merged: DataFrame, keep: Sequence[str] = ("path",)) -> DataFrame:
    """Cleaned fields of merged blocks: title (G9), description (G10; bare text by G9), other texts by G7, the subject
    list as text and as a sorted set of keywords (E8)."""
    title, text = _last_item("dc:title", "Alt"), F.coalesce(F.col("`dc:title`")["_text"], F.lit(""))
    desc, bare = _last_item("dc:description", "Alt"), F.coalesce(F.col("`dc:description`")["_text"], F.lit(""))
    subject = F.array_join(F.col("`dc:subject`")["rdf:Seq"]["rdf:li"], ", ")
    return merged.select(
        *keep,
        X.sanitize_title(F.when(title != "", title).otherwise(text)).alias("title"),
        F.when(desc != "", X.sanitize_description(desc)).otherwise(X.sanitize_title(bare)).alias("description"),
        X.sanitize_string(_last_item("dc:rights", "Alt")).alias("copyright"),
        X.sanitize_string(_last_item("dc:creator", "Seq")).alias("artist"),
        F.coalesce(subject, F.lit("")).alias("subject"),
        X.add_keywords(F.lit(None), subject).alias("keywords"),
        X.sanitize_string(F.col("`tiff:Make`")).alias("camera_make"),
        X.sanitize_string(F.col("`tiff:Model`")).alias("camera_model"),
        X.sanitize_string(F.col("`exifEX:LensModel`")).alias("lens_model"),
        D.parse_xmp_date(X.sanitize_string(F.col("`photoshop:DateCreated`"))).alias("taken_utc"),
    )
