"""Explicit schemas (no inference anywhere in the package)."""

from __future__ import annotations

from pyspark.sql import types as T

# Catalog of every observed path; key (name, hostname).  Times are Unix seconds.
FILES = T.StructType([
    T.StructField("name", T.StringType(), False),
    T.StructField("hostname", T.StringType(), True),
    T.StructField("id", T.LongType(), False),
    T.StructField("size", T.LongType(), False),
    T.StructField("timemodified", T.LongType(), True),
    T.StructField("timeborn", T.LongType(), True),
    T.StructField("timebornsrc", T.StringType(), True),
    T.StructField("mimetype", T.StringType(), True),
    T.StructField("mimesubtype", T.StringType(), True),
    T.StructField("info", T.StringType(), True),
])

# One row per backed-up content; key (id).  Same columns, ``name`` is the backup path.
FILEZ = FILES

# Append-only change log of replaced catalog rows.
FILES_HISTORY = T.StructType([
    T.StructField("name", T.StringType(), False),
    T.StructField("hostname", T.StringType(), True),
    T.StructField("old_id", T.LongType(), True),
    T.StructField("old_size", T.LongType(), True),
    T.StructField("old_timemodified", T.LongType(), True),
    T.StructField("new_id", T.LongType(), True),
    T.StructField("new_size", T.LongType(), True),
    T.StructField("new_timemodified", T.LongType(), True),
    T.StructField("changed_at", T.LongType(), True),
])

# Metadata cache: parsed tag document by content id.
META_CACHE = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("namespace", T.StringType(), False),
    T.StructField("key", T.StringType(), False),
    T.StructField("json", T.StringType(), True),
])

# Long Exif tag rows.
EXIF_ROWS = T.StructType([
    T.StructField("path", T.StringType(), False),
    T.StructField("ifd", T.StringType(), True),
    T.StructField("tag", T.StringType(), False),
    T.StructField("value", T.StringType(), True),
])

# Listing produced by the file source (A1, A2).
LISTING = T.StructType([
    T.StructField("name", T.StringType(), False),
    T.StructField("hostname", T.StringType(), True),
    T.StructField("size", T.LongType(), False),
    T.StructField("timemodified", T.LongType(), True),
])

# Photo sidecar.
_GEO = T.StructType([
    T.StructField("latitude", T.DoubleType()),
    T.StructField("longitude", T.DoubleType()),
    T.StructField("altitude", T.DoubleType()),
    T.StructField("latitudeSpan", T.DoubleType()),
    T.StructField("longitudeSpan", T.DoubleType()),
])
_TS = T.StructType([
    T.StructField("timestamp", T.StringType()),
    T.StructField("formatted", T.StringType()),
])
PHOTO_SIDECAR = T.StructType([
    T.StructField("title", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("imageViews", T.StringType()),
    T.StructField("creationTime", _TS),
    T.StructField("modificationTime", _TS),
    T.StructField("photoTakenTime", _TS),
    T.StructField("geoData", _GEO),
    T.StructField("geoDataExif", _GEO),
])

# Album sidecar.
ALBUM_SIDECAR = T.StructType([
    T.StructField("albumData", T.StructType([
        T.StructField("title", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("access", T.StringType()),
        T.StructField("location", T.StringType()),
        T.StructField("date", _TS),
        T.StructField("geoData", _GEO),
    ])),
])

# XMP description block (A10): plain fields as text, list fields as bare text or a list of items.
XMP_LISTS = {"dc:title": "Alt", "dc:description": "Alt", "dc:rights": "Alt", "dc:creator": "Seq", "dc:subject": "Seq"}
XMP_COLUMNS = [*XMP_LISTS, "photoshop:DateCreated", "tiff:Make", "tiff:Model", "exifEX:LensModel"]


def _xmp_field(name: str) -> T.StructField:
    if name not in XMP_LISTS:
        return T.StructField(name, T.StringType())
    items = T.StructType([T.StructField("rdf:li", T.ArrayType(T.StringType()))])
    return T.StructField(name, T.StructType([T.StructField("_text", T.StringType()),
                                             T.StructField(f"rdf:{XMP_LISTS[name]}", items)]))


XMP_BLOCK = T.StructType([_xmp_field(c) for c in XMP_COLUMNS])
