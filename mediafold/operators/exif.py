"""Long Exif tag rows -> one typed row per file (J6: A11, E9, E10, H17-H21, H28, H31-H33).

Input rows ``(path, ifd, tag, value, ord)`` (``ord`` = position in the file).
E9 picks one value per (path, tag) as the maximum of a rank, E10 pivots a
fixed tag list with ``groupBy(path).pivot(tag, TAGS)`` (the list is given, so
no extra job discovers it), then one projection decodes fields.

Ranks hold strings, so Spark aggregates them over sorted rows.  Rows are
spread by path first: a sort then holds one shuffle partition, not all rows
of an input file in one task, and E9 and E10 need no further shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediafold.functions import dates as D
from mediafold.functions import ids as I
from mediafold.functions import numbers as N
from mediafold.functions import text as X

# The thumbnail directory and the tags the decoder reads.
THUMBNAIL_IFD = "IFD1"
EXIF_TAGS = [
    "Artist", "Copyright", "Model", "CameraModel", "Make", "CameraMake", "CameraOwnerName",
    "BodySerialNumber", "LensMake", "LensModel", "Software", "ExposureTime", "FNumber", "ApertureValue",
    "FocalLengthIn35mmFilm", "FocalLength", "ISOSpeedRatings", "ImageUniqueID", "PixelXDimension",
    "ImageWidth", "PixelYDimension", "ImageLength", "Orientation", "Flash", "ImageDescription",
    "ProjectionType", "DateTimeOriginal", "DateTimeCreated", "CreateDate", "DateTime", "DateTimeDigitized",
    "SubSecTimeOriginal", "SubSecTime", "SubSecTimeDigitized",
]
EXIF_DATETIME_TAGS = ["DateTimeOriginal", "DateTimeCreated", "CreateDate", "DateTime", "DateTimeDigitized"]


def pick_values(rows: DataFrame) -> DataFrame:
    """One value per (path, tag).

    Values are cut at the first NUL; empty ones are ignored.  A value from a
    non-thumbnail directory overwrites earlier ones (the last wins); a
    thumbnail value counts only while nothing is set, so it wins only when no
    other value exists, and then the first one.  Rows at the same position
    (which a real file cannot have) are ordered by value, so the pick is
    deterministic.
    """
    return _ranked(rows).groupBy("path", "tag").agg(F.max("rank").alias("rank")).select(
        "path", "tag", F.col("rank.value").alias("value"))


def _ranked(rows: DataFrame) -> DataFrame:
    """Usable rows, spread by path, with a rank whose maximum is the pick of E9 (and holds its value)."""
    v = F.substring_index(F.col("value"), "\x00", 1)
    main = F.col("ifd") != THUMBNAIL_IFD
    rank = F.struct(main.alias("main"), F.when(main, F.col("ord")).otherwise(-F.col("ord")).alias("at"), v.alias("value"))
    return rows.where((F.col("tag") != "") & (v != "")).select("path", "tag", rank.alias("rank")).repartition("path")


def pick_and_pivot(rows: DataFrame, tags: list[str] | None = None) -> DataFrame:
    """E9 and E10 in one shuffle: one row per path with the picked value of each tag as a column.

    The maximum of each tag's rank is taken per path directly.
    """
    tags = tags or EXIF_TAGS
    return _ranked(rows).groupBy("path").agg(
        *[F.max(F.when(F.col("tag") == t, F.col("rank")))["value"].alias(t) for t in tags])


def pivot_tags(picked: DataFrame, tags: list[str] | None = None) -> DataFrame:
    """Picked long rows -> one row per path with a column per tag."""
    tags = tags or EXIF_TAGS
    return picked.groupBy("path").pivot("tag", tags).agg(F.first("value"))


def decode(wide: DataFrame, *extra: Column) -> DataFrame:
    """Typed fields from the pivoted tags (and ``extra`` columns of the same row)."""
    c = F.col

    def txt(t):
        return F.when(c(t).isNotNull(), X.sanitize_string(c(t)))
    desc = c("ImageDescription")
    auto = F.when(desc.isNotNull(), X.auto_keywords(desc)).otherwise(F.array().cast("array<string>"))
    flash = N.flash_fired(c("Flash"))
    kw = F.array_sort(F.array_distinct(F.concat(
        auto, F.when(flash, F.array(F.lit(X.KEYWORD_FLASH))).otherwise(F.array().cast("array<string>")),
        F.when(c("ProjectionType").isNotNull(), F.array(F.lit(X.KEYWORD_PANORAMA)))
        .otherwise(F.array().cast("array<string>")))))
    return wide.select(
        "path",
        F.when(c("Artist").isNotNull(), X.sanitize_meta(txt("Artist"))).alias("artist"),
        txt("Copyright").alias("copyright"),
        F.coalesce(txt("Model"), txt("CameraModel")).alias("camera_model"),
        F.coalesce(txt("Make"), txt("CameraMake")).alias("camera_make"),
        txt("CameraOwnerName").alias("camera_owner"),
        txt("BodySerialNumber").alias("camera_serial"),
        txt("LensMake").alias("lens_make"),
        txt("LensModel").alias("lens_model"),
        txt("Software").alias("software"),
        F.when(c("ExposureTime").isNotNull(), N.exposure(c("ExposureTime"))).alias("exposure"),
        N.rational_3(c("FNumber")).alias("f_number"),
        N.rational_3(c("ApertureValue")).alias("aperture"),
        N.focal_length(c("FocalLengthIn35mmFilm"), c("FocalLength")).alias("focal_length"),
        N.atoi(c("ISOSpeedRatings")).alias("iso"),
        F.when(I.sanitize_uuid(c("ImageUniqueID")) != "", I.sanitize_uuid(c("ImageUniqueID"))).alias("document_id"),
        F.when(c("PixelXDimension").isNotNull(), N.atoi(c("PixelXDimension")))
        .otherwise(N.atoi(c("ImageWidth"))).alias("width"),
        F.when(c("PixelYDimension").isNotNull(), N.atoi(c("PixelYDimension")))
        .otherwise(N.atoi(c("ImageLength"))).alias("height"),
        F.when(c("Orientation").isNotNull(), N.atoi(c("Orientation"))).otherwise(F.lit(1)).alias("orientation"),
        flash.alias("flash"),
        F.when(desc.isNotNull(), X.sanitize_description(desc)).alias("description"),
        X.keywords_string(kw).alias("keywords"),
        F.when(F.array_contains(auto, "hdr"), F.lit(3)).alias("image_type"),
        F.coalesce(*[c(t) for t in EXIF_DATETIME_TAGS]).alias("taken_text"),
        *extra,
    )


def normalize_exif_rows(rows: DataFrame, tags: list[str] | None = None) -> DataFrame:
    """Long tag rows -> decoded row per path."""
    return decode(pick_and_pivot(rows, tags))


GPS_TAGS = ["GPSLatitude", "GPSLatitudeRef", "GPSLongitude", "GPSLongitudeRef", "GPSAltitude", "GPSAltitudeRef"]
GPS_TIME_TAGS = ["GPSDateStamp", "GPSTimeStamp"]
EXIF_SUBSEC_TAGS = ["SubSecTimeOriginal", "SubSecTime", "SubSecTimeDigitized"]


def _rational_triplet_degrees(text):
    """``d/1, m/1, s/100`` (or bracketed) -> decimal degrees; NULL when not three rationals."""
    parts = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"([0-9]+)/([0-9]+)"), 0)
    def val(i):
        p = F.split(F.try_element_at(parts, F.lit(i)), "/")
        return F.try_divide(F.try_element_at(p, F.lit(1)).try_cast("double"),
                            F.try_element_at(p, F.lit(2)).try_cast("double"))
    return F.when(F.size(parts) == 3, val(1) + val(2) / 60.0 + val(3) / 3600.0)


def gps_columns() -> list[Column]:
    """Exif GPS position of a row of pivoted tags: ``lat, lng, altitude``.

    Latitude/longitude only when both are numbers (rationals with non-zero
    denominators), S/W negative; altitude when not zero (below sea level when
    the reference is 1).  Expects the ``GPS_TAGS`` columns (pivot them too).
    """
    c = F.col
    lat = _rational_triplet_degrees(c("GPSLatitude"))
    lng = _rational_triplet_degrees(c("GPSLongitude"))
    lat = F.when(F.upper(F.substring(c("GPSLatitudeRef"), 1, 1)) == "S", -lat).otherwise(lat)
    lng = F.when(F.upper(F.substring(c("GPSLongitudeRef"), 1, 1)) == "W", -lng).otherwise(lng)
    ok = lat.isNotNull() & lng.isNotNull() & ~F.isnan(lat) & ~F.isnan(lng)
    ap = F.split(c("GPSAltitude"), "/")
    alt = F.try_divide(F.try_element_at(ap, F.lit(1)).try_cast("double"),
                       F.try_element_at(ap, F.lit(2)).try_cast("double"))
    alt = F.when(c("GPSAltitudeRef") == "1", -alt).otherwise(alt).try_cast("int")
    return [F.when(ok, lat.cast("float")).alias("lat"), F.when(ok, lng.cast("float")).alias("lng"),
            F.when(alt != 0, alt).alias("altitude")]


def gps_position(wide: DataFrame) -> DataFrame:
    """H32 as a frame: ``path, lat, lng, altitude``."""
    return wide.select("path", *gps_columns())


def gps_time() -> Column:
    """The GPS date and time stamps as an instant; NULL unless both are complete."""
    parts = F.regexp_extract_all(F.coalesce(F.col("GPSTimeStamp"), F.lit("")), F.lit(r"([0-9]+)/([0-9]+)"), 0)

    def part(i):
        p = F.split(F.try_element_at(parts, F.lit(i)), "/")
        return F.try_divide(F.try_element_at(p, F.lit(1)).try_cast("double"), F.try_element_at(p, F.lit(2)).try_cast("double"))
    day = F.unix_date(F.try_to_date(F.regexp_replace(F.col("GPSDateStamp"), "-", ":"), "yyyy:MM:dd")).cast("bigint")
    seconds = part(1) * 3600 + part(2) * 60 + part(3)
    return F.when(F.size(parts) == 3, day * 86400 + F.floor(seconds)).cast("bigint")


def exif_metadata(rows: DataFrame, regions: DataFrame | None = None) -> DataFrame:
    """J6 to the end: long tag rows -> decoded fields, position, zone, taken time (UTC and local) and sub-seconds.

    A taken time is the first valid Exif date-time, read in the zone of the position when there is one (an offset in the
    text wins), else the GPS time.  ``taken_local`` is its wall clock as Unix seconds.
    """
    from mediafold.operators.timezones import zone_lookup
    wide = pick_and_pivot(rows, [*EXIF_TAGS, *GPS_TAGS, *GPS_TIME_TAGS])
    subsec = F.coalesce(*[F.when(N.subsec_ns(F.col(t)) > 0, N.subsec_ns(F.col(t))) for t in EXIF_SUBSEC_TAGS], F.lit(0))
    s = decode(wide, *gps_columns(), gps_time().alias("gps_utc"), subsec.alias("taken_ns"),
               *[F.col(t).alias(f"_t{i}") for i, t in enumerate(EXIF_DATETIME_TAGS)]).drop("taken_text")
    s = zone_lookup(s, regions) if regions is not None else s.withColumn("zone", F.lit(None).cast("string"))
    for i in range(len(EXIF_DATETIME_TAGS)):
        s = D.with_tag_datetime(s, f"_t{i}", f"_p{i}")
    parsed = [F.col(f"_p{i}") for i in range(len(EXIF_DATETIME_TAGS))]
    first_local = F.coalesce(*[p["local"] for p in parsed])
    s = s.withColumn("taken_utc", D.exif_taken(parsed, F.col("gps_utc"), F.col("zone"), parsed=True))
    s = s.withColumn("taken_local", F.coalesce(first_local, F.col("gps_utc")))
    return s.withColumn("time_zone", F.coalesce("zone", F.lit(""))).drop(
        "zone", *[f"_{x}{i}" for x in "tp" for i in range(len(EXIF_DATETIME_TAGS))])
