"""Tool-tag JSON -> typed metadata (J5: A6, A7, C7, G14, F4, H22-H25).

``TAG_FIELDS`` is the declarative precedence table: for every output field
an ordered tag list and a type.  :func:`assign_fields` turns it into one
projection: per field, the first tag that is present and not empty supplies
the value (``coalesce`` over the list); that value is then converted by the
field's type, and a conversion that yields zero leaves the field unset
(the next tag is not consulted, as in the reference).  The table is an
argument, so users can extend it.

Tags come as a struct with one text per tag that is read (:func:`parse_typed_tags`, one typed parse
of the document, so that a tag is a field access), or as a map of any tags
(:func:`parse_tag_document`), which is brought into that struct once a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mediafold.functions import dates as D
from mediafold.functions import numbers as N
from mediafold.functions import text as X

# Field -> (tags in precedence order, type).
TAG_FIELDS: dict[str, tuple[list[str], str]] = {
    "mime_type": (["MIMEType"], "string"),
    "offset_time_original": (["OffsetTimeOriginal", "OffsetTimeDigitized", "OffsetTime"], "string"),
    "file_name": (["FileName"], "string"),
    "document_id": (["BurstUUID", "MediaGroupUUID", "ImageUniqueID", "OriginalDocumentID", "DocumentID",
                     "DigitalImageGUID"], "string"),
    "instance_id": (["InstanceID", "DocumentID"], "string"),
    "created_at": (["SubSecCreateDate", "CreationDate", "CreateDate", "MediaCreateDate", "ContentCreateDate",
                    "TrackCreateDate"], "time"),
    "taken_at": (["SubSecDateTimeOriginal", "SubSecDateTimeCreated", "DateTimeOriginal", "CreationDate",
                  "DateTimeCreated", "DateTime", "DateTimeDigitized"], "time"),
    "taken_at_local": (["SubSecDateTimeOriginal", "SubSecDateTimeCreated", "DateTimeOriginal", "CreationDate",
                        "DateTimeCreated", "DateTime", "DateTimeDigitized"], "time"),
    "taken_gps": (["GPSDateTime", "GPSDateStamp"], "time"),
    "duration": (["Duration", "MediaDuration", "TrackDuration"], "duration"),
    "fps": (["VideoFrameRate", "VideoAvgFrameRate"], "float"),
    "frames": (["FrameCount"], "int"),
    "codec": (["CompressorID", "VideoCodecID", "CodecID", "FileType"], "string"),
    "title": (["Headline", "Title"], "string"),
    "subject": (["Subject", "PersonInImage", "ObjectName", "HierarchicalSubject", "CatalogSets"], "string"),
    "keywords": (["Keywords"], "keywords"),
    "notes": (["Comment"], "string"),
    "artist": (["Artist", "Creator", "By-line", "OwnerName", "Owner"], "string"),
    "description": (["Description", "Caption-Abstract"], "string"),
    "copyright": (["Rights", "Copyright", "CopyrightNotice", "WebStatement"], "string"),
    "license": (["UsageTerms", "License"], "string"),
    "projection": (["ProjectionType"], "string"),
    "color_profile": (["ICCProfileName", "ProfileDescription"], "string"),
    "camera_make": (["CameraMake", "Make"], "string"),
    "camera_model": (["CameraModel", "Model"], "string"),
    "camera_owner": (["OwnerName"], "string"),
    "camera_serial": (["SerialNumber"], "string"),
    "lens_make": (["LensMake"], "string"),
    "lens_model": (["Lens", "LensModel"], "string"),
    "software": (["Software", "HistorySoftwareAgent", "ProcessingSoftware"], "string"),
    "flash": (["FlashFired"], "bool"),
    "focal_length": (["FocalLength", "FocalLengthIn35mmFormat"], "int"),
    "focal_distance": (["HyperfocalDistance"], "float"),
    "exposure": (["ExposureTime", "ShutterSpeedValue", "ShutterSpeed", "TargetExposureTime"], "string"),
    "aperture": (["ApertureValue", "Aperture"], "float32"),
    "f_number": (["FNumber"], "float32"),
    "iso": (["ISO"], "int"),
    "image_type": (["HDRImageType"], "int"),
    "gps_position": (["GPSPosition"], "string"),
    "gps_latitude": (["GPSLatitude"], "string"),
    "gps_longitude": (["GPSLongitude"], "string"),
    "altitude": (["GlobalAltitude", "GPSAltitude"], "int"),
    "width": (["ImageWidth", "PixelXDimension", "ExifImageWidth", "SourceImageWidth"], "int"),
    "height": (["ImageHeight", "ImageLength", "PixelYDimension", "ExifImageHeight", "SourceImageHeight"], "int"),
    "rotation": (["Rotation"], "int"),
}
SUBSEC_TAGS = ["SubSecTimeOriginal", "SubSecTime", "SubSecTimeDigitized"]
# Tags that are read beside those of the fields.
OTHER_TAGS = [*SUBSEC_TAGS, "MIMEType", "FileName", "GPSAltitude", "Orientation", "ImageWidth", "ImageHeight"]
# Texts that count as an empty tag value.
EMPTY_VALUES = ["", "0", "-1", "nil", "null", "nan", "0000:00:00 00:00:00", "0000:00:00"]
KIND_MARKERS = [("ExifToolVersion", "exiftool"), ("albumData", "album"), ("photoTakenTime", "photo")]


def json_kind(doc: Column) -> Column:
    """Sidecar kind by substring, tested in this order; else ``unknown``."""
    out = F.lit("unknown")
    for marker, kind in reversed(KIND_MARKERS):
        out = F.when(doc.contains(marker), F.lit(kind)).otherwise(out)
    return out


def parse_tag_document(doc: Column) -> Column:
    """Tag JSON (array of objects, or one object) -> one ``map<string,string>``.

    Objects are merged, later keys winning (``spark.sql.mapKeyDedupPolicy=LAST_WIN``);
    only top-level keys count (nested values arrive as their JSON text).
    NULL for text that is not such a document.
    """
    t = F.trim(F.coalesce(doc, F.lit("")))
    wrapped = F.when(t.startswith("{"), F.concat(F.lit("["), t, F.lit("]"))).otherwise(t)
    arr = F.from_json(wrapped, "array<map<string,string>>")
    empty = F.create_map().cast("map<string,string>")
    # most documents hold one object: take it directly; merge (an interpreted lambda) only when several
    merged = F.aggregate(arr, empty, lambda acc, m: F.map_concat(acc, F.coalesce(m, empty)))
    return (F.when(arr.isNull(), F.lit(None).cast("map<string,string>"))
            .when(F.size(arr) == 1, F.coalesce(F.element_at(arr, 1), empty))
            .otherwise(merged))


def tag_names(fields: dict[str, tuple[list[str], str]] | None = None) -> list[str]:
    """Every tag that the assignment of ``fields`` reads, once each."""
    return list(dict.fromkeys([t for names, _ in (fields or TAG_FIELDS).values() for t in names] + OTHER_TAGS))


def _tag_struct(names: list[str]) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


def parse_typed_tags(doc: Column, names: list[str] | None = None) -> Column:
    """A7 as one typed parse: tag JSON -> a struct with the text of each tag of ``names``, NULL where it is absent.

    Other tags are skipped by the parser.  Objects are merged as by :func:`parse_tag_document`, which reads the rare
    document of several objects.  NULL for text that is not such a document.  Stage it as a column of its own.
    """
    kind = _tag_struct(names or tag_names())
    t = F.trim(F.coalesce(doc, F.lit("")))
    wrapped = F.when(t.startswith("{"), F.concat(F.lit("["), t, F.lit("]"))).otherwise(t)
    arr = F.from_json(wrapped, T.ArrayType(kind))
    return (F.when(arr.isNull(), F.lit(None).cast(kind))
            .when((F.size(arr) == 1) & F.element_at(arr, 1).isNotNull(), F.element_at(arr, 1))
            .otherwise(typed_tags(parse_tag_document(doc), names)))


def typed_tags(tags: Column, names: list[str] | None = None) -> Column:
    """The struct of :func:`parse_typed_tags` from a tag map (NULL for a NULL map)."""
    return F.from_json(F.to_json(tags), _tag_struct(names or tag_names()))


def is_map(df: DataFrame, tags_col: str) -> bool:
    return isinstance(df.schema[tags_col].dataType, T.MapType)


def tag_text(df: DataFrame, tags_col: str, name: str) -> Column:
    """Text of a tag as it came, from a map or a struct; NULL if it is absent."""
    kind = df.schema[tags_col].dataType
    if isinstance(kind, T.MapType):
        return F.try_element_at(F.col(tags_col), F.lit(name))
    return F.col(tags_col).getField(name) if name in kind.names else F.lit(None).cast("string")


def _quoted(name: str) -> str:
    return f"`{name.replace('`', '``')}`"


def _empty_sql(v: str) -> str:
    """Condition: the tag text is blank, zero-like or null-like after trimming white space, ``%`` and ``*``.

    A text whose first character neither is trimmed nor starts an empty value needs no trimming.
    """
    skip = sorted({ord(c) for x in EMPTY_VALUES for c in (x[:1] + x[:1].upper())} | {ord("%"), ord("*")})
    values = ", ".join(f"'{x}'" for x in EMPTY_VALUES)
    return (f"CASE WHEN ascii({v}) BETWEEN 33 AND 126 AND ascii({v}) NOT IN ({', '.join(map(str, skip))}) THEN false "
            f"ELSE lower(btrim(btrim({v}, '{X.SPACE_CHARS}'), '%*')) IN ({values}) END")


def first_tag(tags_col: str, names: list[str]) -> Column:
    """Value of the first tag of a tag struct that is present and not empty.

    Written as SQL text: a table of fields reads a hundred tags, and text crosses to the JVM in one call.
    """
    texts = [f"{_quoted(tags_col)}.{_quoted(n)}" for n in names]
    return F.expr(f"coalesce({', '.join(f'if({_empty_sql(t)}, NULL, {t})' for t in texts)})")


def _trimmed(name: str) -> Column:
    """A staged text without white space at its ends; most texts have none, which two characters tell."""
    v = _quoted(name)
    return F.expr(f"CASE WHEN ascii({v}) BETWEEN 33 AND 126 AND ascii(right({v}, 1)) BETWEEN 33 AND 126 THEN {v} "
                  f"ELSE btrim({v}, '{X.SPACE_CHARS}') END")


def convert(v: Column, kind: str) -> Column:
    if kind == "string":
        return X.trim_space(v)
    if kind == "int":
        i = N.leading_int(v)
        return F.when(i != 0, i)
    if kind in ("float", "float32"):
        f = N.leading_number(v)
        f = F.when(f != 0, f)
        return f.cast("float") if kind == "float32" else f
    if kind == "duration":
        return F.when(v.isNull(), F.lit(0).cast("bigint")).otherwise(N.duration_seconds(v))
    if kind == "bool":
        return F.lower(X.trim_space(v)).isin("t", "true") | F.coalesce(v.try_cast("double") != 0, F.lit(False))
    if kind == "time":
        return D.parse_tag_datetime(v)
    if kind == "keywords":
        return X.add_keywords(F.lit(None), v)
    raise ValueError(kind)


def assign_fields(df: DataFrame, tags_col: str = "tags",
                  fields: dict[str, tuple[list[str], str]] | None = None) -> DataFrame:
    """G14 as one projection: adds one typed column per field, and ``taken_ns``."""
    fields = fields or TAG_FIELDS
    # Stage 1: a map becomes a struct; stage 2: the raw winner of each tag list; stage 3: the parts of date-times; stage
    # 4: typed conversion.  Each stage is a separate projection (its columns are referenced several times, so Catalyst
    # keeps them apart).
    staged, held = df, tags_col
    if is_map(df, tags_col):
        staged, held = df.withColumn("__tags", typed_tags(F.col(tags_col), tag_names(fields))), "__tags"
    lists = list(dict.fromkeys(tuple(names) for names, _ in fields.values()))  # fields may share a list
    raw = {names: f"__raw_{i}" for i, names in enumerate(lists)}
    times = list(dict.fromkeys(tuple(names) for names, kind in fields.values() if kind == "time"))
    parts = {names: f"__parts_{i}" for i, names in enumerate(times)}
    staged = staged.select(*df.columns, *[first_tag(held, list(n)).alias(c) for n, c in raw.items()],
                           *[tag_text(staged, held, t).alias(f"__{t}") for t in SUBSEC_TAGS])
    staged = staged.select("*", *[D.tag_datetime_parts(F.col(raw[n])).alias(c) for n, c in parts.items()])
    cols = [(D.tag_datetime_from_parts(F.col(parts[tuple(names)])) if kind == "time"
             else _trimmed(raw[tuple(names)]) if kind == "string" else convert(F.col(raw[tuple(names)]), kind)).alias(field)
            for field, (names, kind) in fields.items()]
    ns = [N.subsec_ns(F.col(f"__{t}")) for t in SUBSEC_TAGS]
    return staged.select(*df.columns, *cols,
                         F.coalesce(*[F.when(n > 0, n) for n in ns], F.lit(0)).alias("taken_ns"))


def check_file_name(df: DataFrame, expected_col: str, tags_col: str = "tags") -> DataFrame:
    """An error when the sidecar's ``FileName`` differs from the expected name."""
    fn = tag_text(df, tags_col, "FileName")
    bad = (F.coalesce(fn, F.lit("")) != "") & (F.coalesce(F.col(expected_col), F.lit("")) != "") \
        & (fn != F.col(expected_col))
    return df.withColumn("error", F.when(bad, F.concat(F.lit("original name "), F.col(expected_col),
                                                       F.lit(" does not match "), fn)))


def image_size_override(df: DataFrame, tags_col: str = "tags") -> DataFrame:
    """When both ``ImageWidth`` and ``ImageHeight`` exist, positive values replace width/height."""
    def tag_int(t):
        v = tag_text(df, tags_col, t)
        return F.when(v.rlike(r"^[+\-]?[0-9]+(\.[0-9]*)?$"), v.try_cast("double").try_cast("int"))
    both = tag_text(df, tags_col, "ImageWidth").isNotNull() & tag_text(df, tags_col, "ImageHeight").isNotNull()
    w, h = tag_int("ImageWidth"), tag_int("ImageHeight")
    return (df.withColumn("width", F.when(both & (w > 0), w).otherwise(F.col("width")))
              .withColumn("height", F.when(both & (h > 0), h).otherwise(F.col("height"))))
