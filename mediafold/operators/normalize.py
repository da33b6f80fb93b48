"""Tags -> normalised metadata, as one operator (J5 end to end).

The steps run as successive projections, so every parse happens once a row and the plan has no shuffle (the zone regions
are broadcast by :func:`mediafold.operators.timezones.zone_lookup` if they are small):

precedence and types (G14, H22-H25) -> position (H9, H10) -> altitude (H12) -> zone (D7) -> taken time, local time and
zone (H27) -> birth (H4, H5) -> size (H23) and orientation (H13) -> codec (G15), ids (G17), projection and automatic
keywords (G18, G12) -> cleaned texts (G9-G11).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mediafold.functions import geo as G
from mediafold.functions import numbers as N
from mediafold.functions import text as X
from mediafold.functions.ids import sanitize_uuid
from mediafold.operators import tags as TG
from mediafold.operators import timezones as TZ

#: Fields that go through unchanged from the precedence table.
PLAIN = ["file_name", "mime_type", "duration", "fps", "frames", "notes", "copyright", "license", "projection",
         "color_profile", "camera_make", "camera_model", "camera_owner", "camera_serial", "lens_make", "lens_model",
         "software", "focal_length", "focal_distance", "exposure", "aperture", "f_number", "iso", "image_type"]


def with_position(df: DataFrame) -> DataFrame:
    """``lat, lng``: the position text if there is one, else the two coordinates (both must be there); 0 if unknown."""
    c = F.col
    text = F.coalesce(c("gps_position"), F.lit("")) != ""
    both = ~text & (F.coalesce(c("gps_latitude"), F.lit("")) != "") & (F.coalesce(c("gps_longitude"), F.lit("")) != "")
    # A text that does not count is NULL, and no pattern runs over a NULL.
    rest = [x for x in df.columns if x not in ("gps_position", "gps_latitude", "gps_longitude")]
    df = df.select(*rest, F.when(text, c("gps_position")).alias("_p"), F.when(both, c("gps_latitude")).alias("_a"),
                   F.when(both, c("gps_longitude")).alias("_b"))
    df = G.with_lat_lng(df, "_p", "_plat", "_plng")
    df = G.with_decimal(G.with_decimal(df, "_a", "_dlat"), "_b", "_dlng")

    def pick(a, b):
        return F.when(c("_p").isNotNull(), c(a)).when(c("_a").isNotNull(), c(b)).otherwise(F.lit(0.0).cast("float"))
    return df.select(*rest, pick("_plat", "_dlat").alias("lat"), pick("_plng", "_dlng").alias("lng"))


def normalize_tags(df: DataFrame, tags_col: str = "tags", regions: DataFrame | None = None,
                   offset_policy: str = "respect") -> DataFrame:
    """``df`` (without its tags, a struct of :func:`parse_typed_tags` or a map) plus the normalised metadata of each row.

    ``regions`` are the zone regions of :func:`zone_lookup`; without them a position gives no zone.  NULL tags give
    empty texts and NULL times.  Added columns: ``PLAIN`` plus ``title, subject, artist, description, keywords, codec,
    document_id, instance_id, lat, lng, altitude, width, height, orientation, flash, taken_utc, taken_local, time_zone,
    taken_ns, birth``.
    """
    c = F.col
    keep = [x for x in df.columns if x != tags_col]
    # Every reader below finds its text under a staged column.
    tags = c(f"`{tags_col}`")
    s = df.select(*[c(f"`{x}`").alias(f"_in_{i}") for i, x in enumerate(keep)],
                  (TG.typed_tags(tags) if TG.is_map(df, tags_col) else tags).alias("_tags"))
    s = TG.assign_fields(s, "_tags")
    s = TG.image_size_override(s, "_tags")
    # What the many steps of position and time do not read travels as one struct: rows stay narrow until the end.
    rest = [*[f"_in_{i}" for i in range(len(keep))], *PLAIN, "title", "subject", "artist", "description", "keywords", "codec",
            "document_id", "instance_id", "width", "height", "rotation", "flash", "taken_ns"]
    tag = {t: TG.tag_text(s, "_tags", t) for t in ("GPSAltitude", "Orientation", "MIMEType")}
    altitude = F.coalesce(c("altitude"), N.altitude_fallback(tag["GPSAltitude"]).cast("bigint"))
    s = s.select(F.struct(*rest, altitude.alias("altitude"), tag["Orientation"].alias("_orientation")).alias("_rest"),
                 "gps_position", "gps_latitude", "gps_longitude", c("taken_at").alias("taken"),
                 c("created_at").alias("created"), c("taken_gps").alias("gps"), tag["MIMEType"].alias("mime"))
    s = with_position(s)
    if regions is None:
        s = s.withColumn("zone", F.lit(None).cast("string"))
    else:
        s = TZ.zone_lookup(s, regions)
    s = TZ.resolve_taken_time(s.withColumn("has_position", G.has_position(c("lat"), c("lng"))))
    birth = TZ.birth_from_taken(c("taken_utc"), c("time_zone"), c("taken.offset_text"), offset_policy=offset_policy)
    s = s.select("_rest.*", "lat", "lng", "taken_utc", "taken_local", "time_zone", birth.alias("birth"),
                 (c("taken.micros") * 1000).alias("_ns"))
    ns = F.when(c("taken_ns") > 0, c("taken_ns")).otherwise(F.coalesce(c("_ns"), F.lit(0)))
    # Texts are cleaned last; keywords see the description as it came.
    s = s.withColumn("_low", F.lower(X.sanitize_meta(c("description"))))
    auto = F.when(F.coalesce(c("description"), F.lit("")) != "", X.auto_keywords_lower(c("_low")))
    keywords = X.add_words(X.projection_keywords(c("keywords"), c("projection")), auto)
    return s.select(
        *[c(f"_in_{i}").alias(x) for i, x in enumerate(keep)], *PLAIN,
        X.sanitize_title(c("title")).alias("title"), X.sanitize_meta(c("subject")).alias("subject"),
        X.sanitize_meta(c("artist")).alias("artist"), X.sanitize_description(c("description")).alias("description"),
        keywords.alias("keywords"), X.normalize_codec(c("codec")).alias("codec"),
        F.coalesce(sanitize_uuid(c("document_id")), F.lit("")).alias("document_id"),
        F.coalesce(sanitize_uuid(c("instance_id")), F.lit("")).alias("instance_id"),
        "lat", "lng", "altitude", "width", "height",
        N.orientation(c("_orientation"), c("rotation").try_cast("int")).alias("orientation"),
        F.coalesce(c("flash"), F.lit(False)).alias("flash"), "taken_utc", "taken_local", "time_zone",
        ns.cast("bigint").alias("taken_ns"), "birth")
