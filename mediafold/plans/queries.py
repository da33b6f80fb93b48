"""Registered queries: driver tables -> operator -> result DataFrame.

Each function takes ``(spark, sf_dir)`` and returns a DataFrame whose column
names and types equal those of the SQL twin in :mod:`mediafold.plans.oracle`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from mediafold.operators import dedupe
from mediafold.plans import derive

# Fixed "now" of the registered queries, so results are reproducible.
NOW_YEAR = 2026
FLAGSHIP = "duplicate_groups"


def q_duplicate_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = derive.documents_as_files(spark, sf_dir)
    return dedupe.duplicate_groups(files)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "duplicate_groups": q_duplicate_groups,
}




def q_birth_from_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    from mediafold.functions import names
    f = derive.orders_as_named_files(spark, sf_dir)
    return names.with_birth_from_name(f, now_year=NOW_YEAR, keep_parts=True).select(
        "file_key", "name", "timemodified", "name_time", "base_time", "path_time", "timeborn", "timebornsrc")


QUERIES["birth_from_name"] = q_birth_from_name


# Fixed change time of the registered history query (2026-01-01 UTC).
CHANGED_AT = 1_767_225_600


def q_catalog_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    from mediafold.operators import catalog
    return catalog.catalog_diff(derive.orders_listing(spark, sf_dir), derive.orders_catalog(spark, sf_dir))


def _new_index_rows(spark: SparkSession, sf_dir: str):
    from mediafold.operators import catalog
    cat = derive.orders_catalog(spark, sf_dir)
    work = catalog.work_list(derive.orders_listing(spark, sf_dir), cat)
    return cat, derive.index_rows(work, NOW_YEAR)


def q_catalog_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    from mediafold.operators import catalog
    cat, new = _new_index_rows(spark, sf_dir)
    return catalog.upsert(cat, new)


def q_catalog_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    from mediafold.operators import catalog
    cat, new = _new_index_rows(spark, sf_dir)
    return catalog.change_log(cat, new, CHANGED_AT)


QUERIES["catalog_diff"] = q_catalog_diff
QUERIES["catalog_upsert"] = q_catalog_upsert
QUERIES["catalog_history"] = q_catalog_history


# -- filters, ids, years ------------------------------------------------------

def q_size_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C1 over documents whose byte size is scaled up so both limits bite."""
    from pyspark.sql import functions as F

    from mediafold.operators import filters
    from mediafold.sources.tables import load
    d = load(spark, sf_dir, "documents", ["doc_id", "n_chars"])
    sized = d.select("doc_id", ((F.col("n_chars") - 4) * 1_000_000).cast("bigint").alias("size"))
    return filters.size_filter(sized)


def q_content_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from mediafold.functions.ids import digest_id, id_hex
    from mediafold.sources.tables import load
    d = load(spark, sf_dir, "documents", ["doc_id", "text"])
    return (d.select("doc_id", digest_id(F.col("text")).alias("id"))
             .withColumn("id_hex", id_hex(F.col("id"))))


def q_year_in_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from mediafold.functions.names import year_in_text
    from mediafold.sources.tables import load
    docs = load(spark, sf_dir, "documents", ["doc_id", "text"]).select(
        F.lit("documents").alias("source"), F.col("doc_id").alias("key"),
        year_in_text(F.col("text"), NOW_YEAR).alias("year"))
    pages = load(spark, sf_dir, "pages", ["page_id", "url"]).select(
        F.lit("pages").alias("source"), F.col("page_id").alias("key"),
        year_in_text(F.col("url"), NOW_YEAR).alias("year"))
    return docs.unionByName(pages)


def q_group_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedupe.group_conflicts(derive.documents_as_files(spark, sf_dir))


# Fixed ignore patterns of the registered query: (directory prefix, glob).
IGNORE_GLOBS = [
    ("", "*#*"),
    ("", "m.*/**"),
    ("", "*.example.org/es/*"),
    ("", "*?page=2*"),
    ("thther.example.org/", "en/*"),
]


def ignore_patterns(spark: SparkSession) -> DataFrame:
    from mediafold.operators.filters import glob_to_regex
    rows = [(d, g, glob_to_regex(g)) for d, g in IGNORE_GLOBS]
    return spark.createDataFrame(rows, "dir string, glob string, regex string")


def q_ignore_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from mediafold.operators import filters
    from mediafold.sources.tables import load
    pages = load(spark, sf_dir, "pages", ["page_id", "url"]).select(
        "page_id", F.regexp_replace("url", "^[a-z]+://", "").alias("path"))
    return filters.ignored_paths(pages, ignore_patterns(spark), key="page_id", path_col="path")


QUERIES["size_filter"] = q_size_filter
QUERIES["content_ids"] = q_content_ids
QUERIES["year_in_text"] = q_year_in_text
QUERIES["group_conflicts"] = q_group_conflicts
QUERIES["ignore_paths"] = q_ignore_paths


# -- backup plan ----------------------------------------------------------------

def q_backup_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from mediafold.operators import backup
    files, backups, disk = derive.documents_backup_inputs(spark, sf_dir)
    return backup.backup_plan(files, backups, disk, derive.BACKUP_ROOT, derive.BACKUP_TZ)


QUERIES["backup_plan"] = q_backup_plan
FLAGSHIP = "backup_plan"


def q_plan_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    from mediafold.operators import backup
    files, backups, disk = derive.documents_backup_inputs(spark, sf_dir)
    plan = backup.backup_plan(files, backups, disk, derive.BACKUP_ROOT, derive.BACKUP_TZ)
    return backup.plan_outcome(plan, files, derive.documents_fresh_listing(spark, sf_dir, files))


QUERIES["plan_outcome"] = q_plan_outcome


def q_filez_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The filez table after a run in which every copy with a matching source succeeds and the others fail."""
    from mediafold.operators import backup
    from pyspark.sql import functions as F

    from mediafold.functions.ids import id_hex
    files, backups, disk = derive.documents_backup_inputs(spark, sf_dir)
    plan = backup.backup_plan(files, backups, disk, derive.BACKUP_ROOT, derive.BACKUP_TZ)
    outcome = backup.plan_outcome(plan, files, derive.documents_fresh_listing(spark, sf_dir, files))
    done = plan.join(outcome.select("id", "outcome"), "id").withColumn(
        "path_final", F.when(F.col("outcome").isin("copy", "move", "keep", "present"), F.col("dest"))).withColumn(
        "status", F.col("outcome"))
    rows = backup.filez_rows(done, backups)
    return rows.select(id_hex(F.col("id")).alias("id_hex"), "name", "size", "timemodified", "timeborn", "timebornsrc",
                       "mimetype", "mimesubtype", "status")


QUERIES["filez_upsert"] = q_filez_upsert


# -- scalar parsers -------------------------------------------------------------

def events_duration_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from mediafold.sources.tables import load
    e = load(spark, sf_dir, "events", ["event_id", "event_type", "value"])
    v = F.floor(F.col("value") * 100).cast("bigint")
    e = e.select("event_id", "event_type", F.expr("0").alias("_"), v.alias("v100")).drop("_")
    ip, cc = F.expr("v100 div 100").cast("string"), F.lpad((F.col("v100") % 100).cast("string"), 2, "0")
    secs = F.expr("v100 div 100")
    hms = F.concat((secs / 3600).cast("bigint").cast("string"), F.lit(":"),
                   F.lpad(((secs / 60).cast("bigint") % 60).cast("string"), 2, "0"), F.lit(":"),
                   F.lpad((secs % 60).cast("string"), 2, "0"))
    t = F.col("event_type")
    text = (F.when(t == "view", F.concat(ip, F.lit("."), cc, F.lit(" s")))
            .when(t == "click", hms)
            .when(t == "purchase", ip)
            .when(t == "error", F.concat(F.lit("v"), ip, F.lit("."), cc, F.lit("."), cc))
            .otherwise(F.concat(F.lit("0:"), ip, F.lit("."), cc, F.lit(":10"))))
    return e.select("event_id", text.alias("text"))


def q_duration_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from mediafold.functions.numbers import duration_seconds
    d = events_duration_text(spark, sf_dir)
    return d.select("event_id", "text", duration_seconds(F.col("text")).alias("seconds"))


def _coord_texts(centi, pos: str, neg: str, salt):
    """Decimal and degree/minute/second renderings of a coordinate in 1/100 degree."""
    from pyspark.sql import functions as F
    a = F.abs(centi)
    dec = F.concat(F.when(centi < 0, F.lit("-")).otherwise(F.lit("")), (a / 100).cast("bigint").cast("string"),
                   F.lit("."), F.lpad((a % 100).cast("string"), 2, "0"))
    tot = (a % 100) * 36
    dms = F.concat((a / 100).cast("bigint").cast("string"), F.lit(" deg "),
                   (tot / 60).cast("bigint").cast("string"), F.lit("' "), (tot % 60).cast("string"),
                   F.lit("."), F.lpad((salt % 100).cast("string"), 2, "0"), F.lit('" '),
                   F.when(centi < 0, F.lit(neg)).otherwise(F.lit(pos)))
    return dec, dms


def events_position_text(spark: SparkSession, sf_dir: str, keep: tuple[str, ...] = ()) -> DataFrame:
    from pyspark.sql import functions as F

    from mediafold.sources.tables import load
    e = load(spark, sf_dir, "events", list(dict.fromkeys(["event_id", "event_type", *keep])))
    k = F.col("event_id")
    lat_dec, lat_dms = _coord_texts((k * 37) % 18000 - 9000, "N", "S", k)
    lng_dec, lng_dms = _coord_texts((k * 91) % 36000 - 18000, "E", "W", k * 3)
    t = F.col("event_type")
    pos = (F.when(t == "view", F.concat(lat_dec, F.lit(", "), lng_dec))
           .when(t == "click", F.concat(lat_dms, F.lit(", "), lng_dms))
           .when(t == "purchase", lat_dec)
           .when(t == "error", F.lit("abc bdf"))
           .otherwise(F.concat(lat_dec, F.lit(" "), lng_dec, F.lit(" 12.5"))))
    lat_text = F.when(t == "purchase", lat_dec).otherwise(lat_dms)
    return e.select("event_id", pos.alias("position"), lat_text.alias("lat_text"), *keep)


def q_gps_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from mediafold.functions.geo import with_decimal, with_lat_lng
    p = with_lat_lng(events_position_text(spark, sf_dir), "position")
    return with_decimal(p, "lat_text", "lat_decimal").select(
        "event_id", "position", "lat", "lng", "lat_text", "lat_decimal")


def parts_as_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from mediafold.sources.tables import load
    p = load(spark, sf_dir, "part", ["p_partkey", "p_type", "p_size"])
    t = F.col("p_type")
    tag = (F.when(t == "ECONOMY", "6").when(t == "SMALL", "Rotate 90 CW")
           .when(t == "MEDIUM", "Horizontal (normal)").when(t == "PROMO", "Rotate 180")
           .when(t == "LARGE", "Unknown (0)").otherwise(""))
    return p.select("p_partkey", (F.col("p_size") * 64).cast("int").alias("width"),
                    ((F.col("p_partkey") % 50) * 48).cast("int").alias("height"),
                    tag.alias("orientation_tag"),
                    (((F.col("p_size") % 5) - 2) * 90).cast("int").alias("rotation"))


def q_orientation_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from mediafold.functions import numbers as N
    p = parts_as_images(spark, sf_dir).withColumn(
        "orientation", N.orientation(F.col("orientation_tag"), F.col("rotation")))
    w, h, o = F.col("width"), F.col("height"), F.col("orientation")
    p = (p.withColumn("actual_width", N.actual_width(w, h, o))
          .withColumn("actual_height", N.actual_height(w, h, o)))
    aw, ah = F.col("actual_width"), F.col("actual_height")
    return p.select("p_partkey", "width", "height", "orientation", "actual_width", "actual_height",
                    N.aspect_ratio(aw, ah).alias("aspect_ratio"), N.is_portrait(aw, ah).alias("portrait"),
                    N.megapixels(w, h).alias("megapixels"))


def lineitem_rationals(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from mediafold.sources.tables import load
    li = load(spark, sf_dir, "lineitem", ["l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice",
                                          "l_discount", "l_tax", "l_returnflag"])

    def s(c):
        return F.floor(c).cast("bigint").cast("string")
    return li.select(
        "l_orderkey", "l_linenumber",
        F.concat(F.col("l_linenumber").cast("string"), F.lit("/"), s(F.col("l_quantity"))).alias("exposure_text"),
        F.concat(s(F.col("l_extendedprice")), F.lit("/"),
                 F.when(F.col("l_tax") == 0, F.lit("0")).otherwise(s(F.col("l_quantity")))).alias("fnumber_text"),
        F.concat(s(F.col("l_discount") * 100), F.lit("/10")).alias("aperture_text"),
        F.when(F.col("l_returnflag") == "A", s(F.col("l_quantity") * 3)).alias("focal35_text"),
        F.concat(s(F.col("l_extendedprice")), F.lit("/"), (F.col("l_linenumber") * 10).cast("string"))
        .alias("focal_text"))


def q_rational_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from mediafold.functions import numbers as N
    r = lineitem_rationals(spark, sf_dir)
    return r.select("l_orderkey", "l_linenumber", N.exposure(F.col("exposure_text")).alias("exposure"),
                    N.rational_3(F.col("fnumber_text")).alias("f_number"),
                    N.rational_3(F.col("aperture_text")).alias("aperture"),
                    N.focal_length(F.col("focal35_text"), F.col("focal_text")).alias("focal_length"))


QUERIES["duration_parse"] = q_duration_parse
QUERIES["gps_parse"] = q_gps_parse
QUERIES["orientation_facts"] = q_orientation_facts
QUERIES["rational_tags"] = q_rational_tags


# -- text cleaning ----------------------------------------------------------------

def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of every document (whole texts, no line dropped)."""
    from pyspark.sql import functions as F

    from mediafold.sources.tables import load
    d = load(spark, sf_dir, "documents", ["doc_id", "text"])
    return d.select("doc_id", F.posexplode(F.split(F.col("text"), "\n")).alias("pos", "line")).select(
        "doc_id", (F.col("pos") + 1).alias("line_no"), "line")


def q_clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from mediafold.functions import text as X
    lines = document_lines(spark, sf_dir)
    line = F.col("line")
    tags = F.concat(F.lit('["'), F.split(line, " ").getItem(0), F.lit('", "'),
                    F.coalesce(F.try_element_at(F.split(line, " "), F.lit(2)), F.lit("")), F.lit('"]'))
    return lines.select("doc_id", "line_no", X.sanitize_string(line).alias("clean"),
                        X.sanitize_uid(line).alias("uid"), X.sanitize_description(line).alias("description"),
                        X.sanitize_meta(line).alias("meta"), X.sanitize_meta(tags).alias("meta_list"))


def pages_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from mediafold.sources.tables import load
    p = load(spark, sf_dir, "pages", ["page_id", "url", "html"])
    t = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    slug = F.regexp_replace(F.lower(t), "[^a-z0-9 ]", "")
    url = F.col("url")
    path = F.regexp_replace(url, "[?#].*$", "")
    title_in = (F.when(url.startswith("http://"), F.concat(F.regexp_replace(slug, " ", "_"), F.lit(".jpg")))
                .when(url.startswith("https://m."), F.concat(F.lit("IMG_"), F.col("page_id").cast("string"),
                                                              F.lit(".JPG")))
                .when(url.contains(".example.org/"), F.concat(F.regexp_replace(slug, " ", "--"), F.lit(".mp4")))
                .otherwise(F.concat(t, F.lit(".png"))))
    return p.select("page_id", path.alias("path"), t.alias("title_text"), title_in.alias("title_in"))


def q_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from mediafold.functions import text as X
    from mediafold.functions.paths import basename
    p = pages_titles(spark, sf_dir)
    return p.select("page_id", basename(F.col("path")).alias("segment"), "title_in",
                    X.sanitize_title(F.col("title_in")).alias("title"),
                    X.sanitize_title(basename(F.col("path"))).alias("segment_title"),
                    X.sanitize_description(F.col("title_text")).alias("description"))


def q_keyword_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from mediafold.functions import text as X
    from mediafold.sources.tables import load
    docs = load(spark, sf_dir, "documents", ["doc_id", "text"]).select(
        F.lit("documents").alias("source"), F.col("doc_id").alias("key"), F.col("text").alias("body"))
    pages = pages_titles(spark, sf_dir).select(
        F.lit("pages").alias("source"), F.col("page_id").alias("key"), F.col("title_text").alias("body"))
    both = docs.unionByName(pages)
    # the cleaned lower-case text is staged once; words and automatic keywords both read it
    both = both.withColumn("low", F.lower(X.sanitize_meta(F.col("body"))))
    auto = X.auto_keywords_lower(F.col("low"))
    kw = X.add_words(auto, X.words(F.col("low")))
    return both.select("source", "key", X.keywords_string(kw).alias("keywords"),
                       F.size(kw).alias("n_keywords"), X.keywords_string(auto).alias("auto_keywords"),
                       F.when(F.array_contains(auto, "hdr"), 3).otherwise(0).alias("image_type"))


def parts_as_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from mediafold.sources.tables import load
    p = load(spark, sf_dir, "part", ["p_partkey", "p_name", "p_type", "p_size"])
    t = F.col("p_type")
    codec = (F.when(t == "ECONOMY", "AVC1").when(t == "SMALL", "hvc1").when(t == "MEDIUM", "JPEG Baseline")
             .when(t == "PROMO", "A_AAC").when(t == "STANDARD", "vp09").otherwise("Theora"))
    mime = (F.when(t == "ECONOMY", "video/mp4").when(t == "SMALL", "video/quicktime")
            .when(t == "MEDIUM", "image/jpeg").when(t == "PROMO", "audio/aac").when(t == "STANDARD", "video/webm")
            .otherwise("application"))
    h = F.md5(F.col("p_name"))
    uuid = F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4),
                       F.substring(h, 17, 4), F.substring(h, 21, 12))
    doc = (F.when(F.col("p_size") % 3 == 0, F.upper(uuid)).when(F.col("p_size") % 3 == 1, uuid)
           .otherwise(h))
    return p.select("p_partkey", codec.alias("codec_tag"), mime.alias("mime_tag"),
                    F.when(F.col("p_size") > 40, "Equirectangular").otherwise("").alias("projection"),
                    doc.alias("document_tag"))


def q_codec_mime(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from mediafold.functions import ids as I
    from mediafold.functions import text as X
    from mediafold.operators.filters import backup_media
    p = parts_as_media(spark, sf_dir)
    codec = X.normalize_codec(F.col("codec_tag"))
    mp = X.mime_parts(F.col("mime_tag"))
    kw = X.projection_keywords(F.array().cast("array<string>"), F.col("projection"))
    return (p.select("p_partkey", codec.alias("codec"), mp["type"].alias("mimetype"),
                     mp["subtype"].alias("mimesubtype"), X.keywords_string(kw).alias("keywords"),
                     I.sanitize_uuid(F.col("document_tag")).alias("document_id"),
                     I.is_uuid(F.col("document_tag")).alias("has_document_id"))
            .withColumn("is_avc", X.is_avc(F.col("codec")))
            .withColumn("backed_up", F.coalesce(backup_media("mimetype"), F.lit(False))))


def q_media_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from mediafold.functions import geo as G
    from mediafold.functions import numbers as N
    from mediafold.functions.names import is_time
    p = G.with_lat_lng(events_position_text(spark, sf_dir, ("ts", "event_type", "value")), "position")
    t = F.col("event_type")
    text = (F.when(t == "view", F.date_format("ts", "yyyy-MM-dd"))
            .when(t == "click", F.date_format("ts", "yyyyMMdd"))
            .when(t == "purchase", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
            .when(t == "error", F.date_format("ts", "yyyy_MM_dd_HHmmss"))
            .otherwise(F.date_format("ts", "dd.MM.yyyy")))
    taken = F.when(t != "error", F.col("ts"))
    image_type = F.when(F.col("value") > 400, 3).otherwise(F.floor(F.col("value")).cast("int") % 3)
    return p.select("event_id", text.alias("time_text"), is_time(text).alias("is_time"),
                    G.has_time_and_place(taken, F.col("lat"), F.col("lng")).alias("has_time_and_place"),
                    N.is_hdr(image_type).alias("is_hdr"))


QUERIES["clean_text"] = q_clean_text
QUERIES["titles"] = q_titles
QUERIES["keyword_sets"] = q_keyword_sets
QUERIES["codec_mime"] = q_codec_mime
QUERIES["media_flags"] = q_media_flags


# -- tag documents ------------------------------------------------------------------

def events_tag_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One tool-tag JSON document per event, built from the event's columns.

    Views carry an array with one object; clicks two objects (later keys win)
    with empty first tags; purchases a lone object with an all-zero date;
    errors truncated JSON; signups nested groups, a flag and units.
    """
    from pyspark.sql import functions as F

    from mediafold.sources.tables import load
    e = load(spark, sf_dir, "events", ["event_id", "ts", "user_id", "event_type", "props"])
    k = F.regexp_extract("props", r"(\d+)", 1)
    u = F.col("user_id").cast("string")
    eid = F.col("event_id").cast("string")
    dt = F.date_format("ts", "yyyy:MM:dd HH:mm:ss")
    t = F.col("event_type")
    q = F.lit('"')

    def kv(key, val):
        return F.concat(F.lit(f'"{key}": '), q, val, q)

    view = F.concat(F.lit('[{"k": '), k, F.lit(', "ExifToolVersion": 12.5, '), kv("Headline", F.lit("")), F.lit(", "),
                    kv("Title", F.concat(F.lit("Trip "), u)), F.lit(', "Make": "Canon", "ISO": '), u,
                    F.lit(', "FocalLength": "5.6 mm", '), kv("DateTimeOriginal", dt),
                    F.lit(', "Duration": "2.41 s", "ImageWidth": '), (F.col("user_id") * 10).cast("string"),
                    F.lit(', "Keywords": ["Sea","sky"], "SubSecTimeOriginal": "'), F.substring(eid, 1, 3),
                    F.lit('"}]'))
    click = F.concat(F.lit('[{"Make": "Nikon", "ISO": '), u, F.lit('}, {"CameraMake": "  ", "Make": "NIKON", '),
                     F.lit('"Title": "0", '), kv("Headline", F.concat(F.lit("Click "), eid)),
                     F.lit(', "ISO": "0", "FocalLength": 35, '), kv("CreateDate", F.concat(dt, F.lit("+01:00"))),
                     F.lit(', "PixelXDimension": "640", "Keywords": "Foo; bar", "Rotation": 90}]'))
    purchase = F.concat(F.lit('{"k": '), k, F.lit(", "), kv("Model", F.concat(F.lit("M "), u)),
                        F.lit(', "Duration": "0:01:05", "DateTimeOriginal": "0000:00:00 00:00:00", '),
                        kv("DateTime", dt), F.lit(', "GPSDateTime": "2024:01:02 03:04:05Z"}'))
    error = F.concat(F.lit('[{"k": '), k, F.lit(', "Make": "x"'))
    signup = F.concat(F.lit('{"k": '), k, F.lit(', "Grouped": {"Make": "inner"}, "FlashFired": "True", '),
                      F.lit('"GPSAltitude": "84.4 m Above Sea Level", "HDRImageType": "3", "ApertureValue": 2.8, '),
                      F.lit('"Artist": "null", "Creator": "'), u, F.lit('"}'))
    doc = (F.when(t == "view", view).when(t == "click", click).when(t == "purchase", purchase)
           .when(t == "error", error).otherwise(signup))
    return e.select("event_id", doc.alias("doc"))


TAG_OUTPUT = ["title", "camera_make", "camera_model", "artist", "iso", "focal_length", "width", "duration",
              "flash", "image_type", "altitude", "aperture", "rotation", "keywords", "taken_at", "created_at",
              "taken_gps"]


def q_tag_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from mediafold.functions import text as X
    from mediafold.operators import tags as TG
    d = events_tag_documents(spark, sf_dir).select(
        "event_id", TG.json_kind(F.col("doc")).alias("kind"),
        TG.parse_typed_tags(F.col("doc"), [*TG.tag_names(), "k"]).alias("tags"))
    a = TG.assign_fields(d, "tags")
    return a.select(
        "event_id", "kind", F.col("tags").isNull().alias("error"), F.col("tags.k").alias("k"),
        "title", "camera_make", "camera_model", "artist", "iso", "focal_length", "width", "duration", "flash",
        "image_type", "altitude", "aperture", "rotation", X.keywords_string(F.col("keywords")).alias("keywords"),
        F.col("taken_at.utc").alias("taken_utc"), F.col("taken_at.offset").alias("taken_offset"),
        F.col("created_at.utc").alias("created_utc"), F.col("taken_gps.utc").alias("gps_utc"), "taken_ns")


QUERIES["tag_precedence"] = q_tag_precedence


# -- Exif tag rows ----------------------------------------------------------------

PIVOT_TAGS = ["Make", "Model", "ExposureTime", "FNumber", "ISOSpeedRatings", "Orientation", "Software"]


def lineitem_tag_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lineitem`` as long Exif rows: one image per order, one tag per line."""
    from pyspark.sql import functions as F

    from mediafold.sources.tables import load
    li = load(spark, sf_dir, "lineitem", ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_discount",
                                          "l_returnflag", "l_linestatus"])
    tag = F.element_at(F.array(*[F.lit(t) for t in PIVOT_TAGS]), (F.col("l_partkey") % 7 + 1).cast("int"))
    value = F.when(F.col("l_discount") == 0, F.lit("")).otherwise(F.concat(
        F.col("l_returnflag"), F.col("l_suppkey").cast("string"),
        F.when(F.col("l_linestatus") == "F", F.lit("\x00junk")).otherwise(F.lit(""))))
    return li.select(F.concat(F.lit("img/"), F.col("l_orderkey").cast("string")).alias("path"),
                     F.when(F.col("l_returnflag") == "R", "IFD1").otherwise("IFD0").alias("ifd"),
                     tag.alias("tag"), value.alias("value"), F.col("l_linenumber").cast("int").alias("ord"))


def q_exif_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    from mediafold.operators import exif
    return exif.pivot_tags(exif.pick_values(lineitem_tag_rows(spark, sf_dir)), PIVOT_TAGS)


def customer_tag_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``customer`` as long Exif rows: one image per customer, 15 tags each."""
    from pyspark.sql import functions as F

    from mediafold.sources.tables import load
    c = load(spark, sf_dir, "customer", ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"])
    # A file's one row group would be one task with 15 times its rows.
    c = c.repartition("c_custkey")
    k, n, seg = F.col("c_custkey"), F.col("c_nationkey"), F.col("c_mktsegment")

    def r(ifd, tag, value, o):
        return F.struct(F.lit(ifd).alias("ifd"), F.lit(tag).alias("tag"), value.alias("value"), F.lit(o).alias("ord"))
    rows = F.array(
        r("IFD0", "Artist", F.col("c_name"), 1),
        r("IFD0", "Copyright", F.concat(F.lit(' "'), seg, F.lit('" ')), 2),
        r("IFD1", "Model", F.concat(F.lit("Thumb "), k.cast("string")), 3),
        r("IFD0", "Model", F.when(F.col("c_acctbal") > 0, F.concat(F.lit("Model "), n.cast("string")))
          .otherwise(F.lit("")), 4),
        r("IFD0", "CameraMake", F.lit("Vendor"), 5),
        r("IFD0", "ImageDescription", F.when(seg == "BUILDING", F.lit("OLYMPUS DIGITAL CAMERA"))
          .when(seg == "MACHINERY", F.concat(F.lit("HDR burst of "), F.col("c_name")))
          .otherwise(F.concat(F.lit("  Shot "), k.cast("string"), F.lit("  "))), 6),
        r("IFD0", "Flash", n.cast("string"), 7),
        r("IFD0", "FocalLength", F.concat((k % 300).cast("string"), F.lit("/10")), 8),
        r("IFD0", "FocalLengthIn35mmFilm", F.when(n > 20, (n * 2).cast("string")).otherwise(F.lit("")), 9),
        r("IFD0", "ISOSpeedRatings", (k % 3200).cast("string"), 10),
        r("IFD0", "PixelXDimension", (k % 4000 + 100).cast("string"), 11),
        r("IFD0", "ImageLength", (n * 100 + 50).cast("string"), 12),
        r("IFD0", "ExposureTime", F.concat(F.lit("10/"), k.cast("string")), 13),
        r("IFD0", "Software", F.lit("App\x00junk"), 14),
        r("IFD0", "ProjectionType", F.when(n == 5, F.lit("equirectangular")).otherwise(F.lit("")), 15),
    )
    return c.select(k.cast("string").alias("path"), F.explode(rows).alias("r")).select("path", "r.*")


def q_exif_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from mediafold.operators import exif
    d = exif.normalize_exif_rows(customer_tag_rows(spark, sf_dir))
    return d.select("path", "artist", "copyright", "camera_model", "camera_make", "software", "description",
                    "keywords", "flash", "focal_length", "iso", "width", "height", "orientation", "exposure",
                    "image_type")


def events_exif_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GPS and date tag rows of every event."""
    from pyspark.sql import functions as F

    from mediafold.sources.tables import load
    e = load(spark, sf_dir, "events", ["event_id", "ts", "event_type", "user_id"]).repartition("event_id")  # as for customer_tag_rows
    k, u, t = F.col("event_id"), F.col("user_id"), F.col("event_type")

    def n(c):
        return c.cast("string")
    tag = F.date_format("ts", "yyyy:MM:dd HH:mm:ss")
    rows = [
        ("IFD0", "Make", F.lit("Kodak")), ("IFD0", "DateTimeOriginal", F.when(t == "view", tag).otherwise(F.lit(""))),
        ("IFD1", "DateTime", tag), ("IFD0", "CreateDate", F.when(t == "click", F.concat(tag, F.lit("+02:00"))).otherwise("")),
        ("IFD0", "SubSecTimeOriginal", n(k % 90)),
        ("GPS", "GPSLatitude", F.concat(n(k % 80), F.lit("/1, "), n(u % 60), F.lit("/1, "), n(k % 6000), F.lit("/100"))),
        ("GPS", "GPSLatitudeRef", F.when(u % 2 == 0, "S").otherwise("N")),
        ("GPS", "GPSLongitude", F.when(k % 9 == 0, F.lit("1/1, 2/1")).otherwise(
            F.concat(n(k % 170), F.lit("/1, "), n(u % 60), F.lit("/1, 0/1")))),
        ("GPS", "GPSLongitudeRef", F.when(k % 3 == 0, "W").otherwise("E")),
        ("GPS", "GPSAltitude", F.concat(n(k % 5000), F.lit("/10"))), ("GPS", "GPSAltitudeRef", n(u % 2)),
        ("GPS", "GPSDateStamp", F.date_format("ts", "yyyy:MM:dd")),
        ("GPS", "GPSTimeStamp", F.concat(n(k % 24), F.lit("/1, "), n(u % 60), F.lit("/1, 59/2"))),
    ]
    cells = F.array(*[F.struct(F.lit(ifd).alias("ifd"), F.lit(name).alias("tag"), v.alias("value"), F.lit(i).alias("ord"))
                      for i, (ifd, name, v) in enumerate(rows)])
    return e.select(n(k).alias("path"), F.explode(cells).alias("r")).select("path", "r.*")


def q_exif_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exif rows of every event to position, zone and taken time."""
    from mediafold.operators import exif
    m = exif.exif_metadata(events_exif_rows(spark, sf_dir), nation_regions(spark, sf_dir))
    return m.select("path", "camera_make", "lat", "lng", "altitude", "time_zone", "gps_utc", "taken_utc", "taken_local",
                    "taken_ns")


QUERIES["exif_metadata"] = q_exif_metadata
QUERIES["exif_pivot"] = q_exif_pivot
QUERIES["exif_text"] = q_exif_text


# -- numbers with units ---------------------------------------------------------------

def lineitem_number_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from mediafold.sources.tables import load
    li = load(spark, sf_dir, "lineitem", ["l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_tax",
                                          "l_returnflag", "l_linestatus", "l_shipdate"])

    def s(c):
        return F.floor(c).cast("bigint").cast("string")
    rf, ls, ln = F.col("l_returnflag"), F.col("l_linestatus"), F.col("l_linenumber")
    q = s(F.col("l_quantity"))
    dt = F.date_format("l_shipdate", "yyyy:MM:dd HH:mm:ss")
    return li.select(
        "l_orderkey", "l_linenumber",
        F.when(ls == "O", F.concat(F.lit(" "), q, F.lit(" ")))
        .otherwise(F.concat(q, F.when(rf == "R", F.lit("x")).otherwise(F.lit("")))).alias("int_text"),
        F.when(rf == "N", F.concat(s(F.col("l_extendedprice")), F.lit("."),
                                   F.lpad((F.floor(F.col("l_extendedprice") * 100) % 100).cast("string"), 2, "0")))
        .otherwise(F.lit("n/a")).alias("float_text"),
        F.when(rf == "A", F.lit("12 m, 13 m"))
        .otherwise(F.concat(q, F.lit("."), ln.cast("string"), F.lit(" m Above Sea Level"))).alias("altitude_text"),
        F.when(ln == 1, F.concat(s(F.col("l_tax") * 100), F.lit(".5E-2")))
        .when(ln == 2, F.concat(F.lit("30000000"), F.lpad(q, 2, "0"), F.lit(" units")))
        .otherwise(F.concat(s(F.col("l_tax") * 100), F.lit(".5 mm"))).alias("unit_text"),
        F.when(rf == "R", F.lit("-3")).otherwise((ln * 7).cast("string")).alias("subsec_text"),
        F.when(ln == 7, F.lit("0000:00:00 00:00:00"))
        .when(ls == "O", F.concat(dt, F.lit("+05:30")))
        .when(rf == "R", F.concat(dt, F.when(ln == 3, F.lit(".25000000019Z")).otherwise(F.lit(".25Z"))))
        .otherwise(dt).alias("dt_text"),
        ln.cast("string").alias("flash_text"),
    )


def q_number_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from mediafold.functions import dates as D
    from mediafold.functions import numbers as N
    from mediafold.functions.names import to_int
    t = D.with_tag_datetime(lineitem_number_texts(spark, sf_dir), "dt_text", "dt")
    return t.select(
        "l_orderkey", "l_linenumber",
        to_int(F.col("int_text")).alias("int_value"),
        N.parse_float(F.col("float_text")).alias("float_value"),
        N.altitude_fallback(F.col("altitude_text")).alias("altitude"),
        N.leading_number(F.col("unit_text")).alias("unit_value"),
        N.leading_int(F.col("unit_text")).alias("unit_int"),
        N.subsec_ns(F.col("subsec_text")).alias("subsec_ns"),
        F.col("dt.utc").alias("dt_utc"), F.col("dt.offset").alias("dt_offset"), F.col("dt.micros").alias("dt_micros"),
        N.flash_fired(F.col("flash_text")).alias("flash"))


QUERIES["number_tags"] = q_number_tags


# -- zones and taken times ------------------------------------------------------------

# Fixed values of the registered zone queries: the zone of each region.
REGION_ZONES = {"AFRICA": "Africa/Cairo", "AMERICA": "America/New_York", "ASIA": "Asia/Shanghai",
                "EUROPE": "Europe/Berlin", "MIDDLE EAST": "Asia/Dubai"}


def nation_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One overlapping box per nation (a 5 x 5 grid widened by 2 degrees), zone by region."""
    from pyspark.sql import functions as F

    from mediafold.operators.timezones import box_polygon
    from mediafold.sources.tables import load
    n = load(spark, sf_dir, "nation", ["n_nationkey", "n_regionkey"])
    r = load(spark, sf_dir, "region", ["r_regionkey", "r_name"])
    zone = F.lit("Asia/Dubai")
    for name, z in REGION_ZONES.items():
        zone = F.when(F.col("r_name") == name, F.lit(z)).otherwise(zone)
    k = F.col("n_nationkey")
    lat0 = F.lit(-90) + (k % 5) * 36 - 2
    lng0 = F.lit(-180) + F.floor(k / 5) * 72 - 2
    return n.join(r, n.n_regionkey == r.r_regionkey).select(
        zone.alias("zone"), k.cast("int").alias("priority"), box_polygon(lat0, lat0 + 40, lng0, lng0 + 76).alias("polygon"))


def event_points(spark: SparkSession, sf_dir: str, keep: tuple[str, ...] = ()) -> DataFrame:
    from pyspark.sql import functions as F

    from mediafold.functions.geo import with_lat_lng
    p = events_position_text(spark, sf_dir, keep)
    return with_lat_lng(p, "position").select("event_id", "lat", "lng", *keep)


def q_zone_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from mediafold.operators.timezones import zone_lookup
    return zone_lookup(event_points(spark, sf_dir), nation_regions(spark, sf_dir))


def events_time_tags(e: DataFrame) -> DataFrame:
    """Adds the date-time texts and MIME type of an event (needs ``ts, user_id, event_type``)."""
    from pyspark.sql import functions as F
    t, u = F.col("event_type"), F.col("user_id")
    fmt = "yyyy:MM:dd HH:mm:ss"
    base = F.date_format("ts", fmt)
    taken = (F.when(t == "view", base).when(t == "click", F.concat(base, F.lit("+02:00")))
             .when(t == "purchase", F.lit("")).when(t == "error", F.concat(base, F.lit("Z")))
             .otherwise(F.concat(base, F.lit("+08:00"))))
    shifted = F.date_format(F.expr("ts + make_dt_interval(0, CAST(user_id % 50 AS INT), 0, 0)"), fmt)
    created = F.when(u % 4 == 0, shifted).otherwise(F.lit(""))
    gps = F.concat(F.date_format(F.expr("ts - make_dt_interval(0, 1, 0, 0)"), fmt), F.lit("Z"))
    mime = F.when(u % 2 == 0, F.lit("video/mp4")).otherwise(F.lit("image/jpeg"))
    return e.select("*", taken.alias("taken_text"), created.alias("created_text"), gps.alias("gps_text"),
                    mime.alias("mime"))


def q_resolve_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from mediafold.functions import dates as D
    from mediafold.functions.geo import has_position
    from mediafold.operators import timezones as TZ
    pts = event_points(spark, sf_dir, ("ts", "user_id", "event_type"))
    tt = events_time_tags(TZ.zone_lookup(pts, nation_regions(spark, sf_dir)))
    tt = tt.select("event_id", "mime", "zone", has_position(F.col("lat"), F.col("lng")).alias("has_position"),
                   "taken_text", "created_text", "gps_text")
    for src, out in (("taken_text", "taken"), ("created_text", "created"), ("gps_text", "gps")):
        tt = D.with_tag_datetime(tt, src, out)
    r = TZ.resolve_taken_time(tt)
    off = F.col("taken.offset_text")
    return r.select("event_id", "taken_utc", "taken_local", "time_zone",
                    TZ.birth_from_taken(F.col("taken_utc"), F.col("time_zone"), off).alias("birth"),
                    TZ.birth_from_taken(F.col("taken_utc"), F.col("time_zone"), off,
                                        offset_policy="reference").alias("birth_reference"))


QUERIES["zone_join"] = q_zone_join
QUERIES["resolve_time"] = q_resolve_time


def events_tag_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One tag map per event with times, positions, texts, ids and sizes taken from its columns."""
    from pyspark.sql import functions as F
    e = events_time_tags(events_position_text(spark, sf_dir, ("ts", "user_id", "event_type")))
    u, k = F.col("user_id"), F.col("event_id")
    us, ks = u.cast("string"), k.cast("string")

    def nth(i, *texts):
        out = F.lit(None).cast("string")
        for n, t in enumerate(texts):
            out = F.when(i % len(texts) == n, t if not isinstance(t, str) else F.lit(t)).otherwise(out)
        return out
    tags = {
        "DateTimeOriginal": F.col("taken_text"), "CreateDate": F.col("created_text"), "GPSDateTime": F.col("gps_text"),
        "MIMEType": F.col("mime"), "GPSPosition": F.when(k % 5 != 0, F.col("position")),
        "GPSLatitude": F.col("lat_text"), "GPSLongitude": F.when(k % 10 != 0, F.col("lat_text")),
        "GPSAltitude": F.concat(ks, F.lit(".5 m Above Sea Level")), "SubSecTimeOriginal": nth(k, "25", "x", "0"),
        "Headline": nth(u, F.concat(F.lit("let_it_snow-"), us, F.lit("x.jpg")), F.lit("IMG_1234.jpg"), F.lit(""),
                        F.concat(F.lit("Plain "), us)),
        "Subject": nth(k, F.concat(F.lit('["One '), us, F.lit('", "Two"]')), F.lit("[1]"), F.lit('  "Quoted" ')),
        "Artist": nth(u, F.lit('["A", "B"]'), F.lit("null")), "Creator": us,
        "Description": nth(k, F.lit("HDR Burst at sea"), F.lit("OLYMPUS DIGITAL CAMERA"), F.lit('a "panorama" of '), us),
        "Keywords": nth(u, F.lit("Sea, sky"), F.lit('["b","a"]'), F.lit("")),
        "ProjectionType": nth(k, F.lit("Equirectangular"), F.lit(""), F.lit("cubestrip")),
        "CompressorID": nth(u, F.lit("HVC1"), F.lit("x-jpeg"), F.lit("A_AAC"), F.lit("odd")),
        "DocumentID": nth(k, F.lit("0F7AC9B2-1111-2222-3333-ABCDEF012345"), F.lit("xmp.did:1"), F.lit("0")),
        "ImageWidth": nth(u, us, F.lit("0"), F.lit("640 px")), "ImageHeight": nth(k, F.lit("480"), ks),
        "PixelXDimension": us, "Orientation": nth(u, F.lit("Rotate 90 CW"), F.lit("Unknown (0)"), F.lit("8")),
        "Rotation": nth(k, F.lit("90"), F.lit("180"), F.lit("7")), "ISO": nth(u, F.lit("3000000000"), F.lit("1E2"), us),
        "FNumber": nth(k, F.lit("0.00012"), F.lit("12345678.5"), F.lit("2.8")), "FlashFired": nth(u, "2", "True", "0", "no"),
        "Duration": nth(k, "2.41 s", "0:01:05", "1.5E1"), "Make": F.lit(" Kodak "),
    }
    return e.select("event_id", F.create_map(*[x for t, v in tags.items() for x in (F.lit(t), v)]).alias("tags"))


def q_normalize_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event's tag map normalised in one go, through zones and taken times."""
    from pyspark.sql import functions as F

    from mediafold.operators.normalize import normalize_tags
    n = normalize_tags(events_tag_maps(spark, sf_dir), "tags", nation_regions(spark, sf_dir))
    return n.select("event_id", "title", "subject", "artist", "description", F.array_join("keywords", ", ").alias("keywords"),
                    "codec", "document_id", "lat", "lng", "altitude", "width", "height", "orientation", "iso", "f_number",
                    "flash", "duration", "camera_make", "taken_utc", "taken_local", "time_zone", "taken_ns", "birth")


QUERIES["normalize_tags"] = q_normalize_tags


# -- summaries and the metadata cache ------------------------------------------------------

def q_catalog_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    from mediafold.operators import facts
    return facts.catalog_summary(derive.documents_as_files(spark, sf_dir), derive.BACKUP_TZ)


def q_action_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedupe.status_counts(q_backup_plan(spark, sf_dir), "action")


def documents_meta_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cache entries exist for the English documents' contents."""
    from pyspark.sql import functions as F

    from mediafold.functions.ids import digest_id
    from mediafold.sources.tables import load
    d = load(spark, sf_dir, "documents", ["doc_id", "text", "lang"]).where(F.col("lang") == "en")
    rows = d.select(digest_id(F.col("text")).alias("id"),
                    F.concat(F.lit('{"FileName": "'), F.col("doc_id").cast("string"), F.lit('.txt"}')).alias("json"))
    return rows.groupBy("id").agg(F.min("json").alias("json")).select(
        "id", F.lit("json").alias("namespace"), F.lit("exiftool.json").alias("key"), "json")


def q_cache_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from mediafold.functions.ids import id_hex
    from mediafold.operators import metacache
    files = derive.documents_as_files(spark, sf_dir)
    looked = metacache.cache_lookup(files, documents_meta_cache(spark, sf_dir))
    meta = files.groupBy("id").agg(
        F.min(F.when(F.col("timebornsrc") == "meta", F.col("timeborn"))).alias("taken_utc"))
    extracted = (looked.where(F.col("status") == "extract").join(meta, "id")
                 .withColumn("json", F.concat(F.lit('{"taken": '), F.col("taken_utc").cast("string"), F.lit("}"))))
    writes = metacache.cache_writes(extracted).select("id", F.lit(True).alias("write_cache"))
    return (looked.join(meta, "id").join(writes, "id", "left")
            .select(id_hex(F.col("id")).alias("id_hex"), "status", "cache_name", "taken_utc",
                    F.coalesce(F.col("write_cache"), F.lit(False)).alias("write_cache")))


QUERIES["catalog_summary"] = q_catalog_summary
QUERIES["action_counts"] = q_action_counts
QUERIES["cache_join"] = q_cache_join


# -- content types and merged sources ------------------------------------------------------

# Fixed values of the derivation: leading bytes (hex) put before a page's html, by page_id modulo 8.
PAGE_HEADERS = {1: "1A45DFA301000000000000FFEC40C8" + "00" * 200 + "4282847765626D",
                2: "00FF00FF", 3: "00" * 257 + "7573746172", 4: "000000186674797068656963",
                5: "52494646000000005741564566", 6: "1A45DFA3010000004282886D6174726F736B61",
                7: "000000206674797033677035"}


def pages_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page bytes: the html, behind a media header by page number, else by kind of host."""
    from pyspark.sql import functions as F

    from mediafold.sources.tables import load
    p = load(spark, sf_dir, "pages", ["page_id", "url", "html"])
    url = F.col("url")
    head = F.when(F.lit(False), F.unhex(F.lit("")))
    for k, h in PAGE_HEADERS.items():
        head = head.when(F.col("page_id") % 8 == k, F.unhex(F.lit(h)))
    head = (head.when(url.startswith("https://m."), F.unhex(F.lit("FFD8FFE0")))
            .when(url.contains(".example.org/"), F.unhex(F.lit("0000001866747970")))
            .when(url.startswith("http://"), F.unhex(F.lit("89504E470D0A1A0A")))
            .otherwise(F.unhex(F.lit(""))))
    return p.select("page_id", "url", F.concat(head, F.encode("html", "UTF-8")).alias("content"))


def q_mime_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Type of every page's bytes by signature, in one projection."""
    from pyspark.sql import functions as F

    from mediafold.operators import mime
    from mediafold.operators.filters import backup_media
    d = mime.detect(pages_content(spark, sf_dir), "content")
    return d.select("page_id", "mimetype", "mimesubtype",
                    F.coalesce(backup_media("mimetype"), F.lit(False)).alias("backed_up"))


def q_classify_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D8 + G16: signature first, else the MIME type stated by the metadata."""
    from pyspark.sql import functions as F

    from mediafold.operators import mime
    from mediafold.operators.filters import backup_media
    stated = (F.when(F.col("url").contains("?page="), "audio/x-stated").when(F.col("page_id") % 3 == 0, "video/mp4; x")
              .when(F.col("page_id") % 3 == 1, "oddity"))
    d = mime.classify(pages_content(spark, sf_dir).withColumn("stated", stated), "content", "stated")
    return d.select("page_id", "mimetype", "mimesubtype",
                    F.coalesce(backup_media("mimetype"), F.lit(False)).alias("backed_up"))


def q_merge_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exif-like fields from documents, JSON from labels, XMP from toxic labels."""
    from pyspark.sql import functions as F

    from mediafold.operators.merge import merge_sources
    from mediafold.sources.tables import load
    d = load(spark, sf_dir, "documents", ["doc_id", "lang", "source"])
    lab = load(spark, sf_dir, "labels", ["doc_id", "quality", "toxic"])
    exif = d.select("doc_id", F.concat(F.lit("Doc "), F.col("doc_id").cast("string")).alias("title"),
                    F.col("source").alias("make"),
                    F.when(F.col("lang") == "en", F.lit("")).otherwise(F.col("lang")).alias("description"))
    js = lab.select("doc_id", F.concat(F.lit("Label "), F.col("doc_id").cast("string")).alias("title"),
                    F.concat(F.lit("lang-"), F.col("quality").cast("string")).alias("description"),
                    F.col("quality").cast("string").alias("rating"))
    xmp = lab.where(F.col("toxic") == 1).select(
        "doc_id", F.concat(F.lit("Flagged "), F.col("doc_id").cast("string")).alias("title"),
        F.lit("").alias("make"))
    return merge_sources([("exif", exif, "fill"), ("json", js, "fill"), ("xmp", xmp, "overwrite")],
                         "doc_id", ["title", "make", "description", "rating"])


QUERIES["mime_signatures"] = q_mime_signatures
QUERIES["classify_media"] = q_classify_media
QUERIES["merge_sources"] = q_merge_sources


# -- sidecars ---------------------------------------------------------------------

def _json_str(c):
    """Text as a JSON string body (backslash, quote and control characters escaped)."""
    from pyspark.sql import functions as F
    e = F.replace(c, F.lit("\\"), F.lit("\\\\"))
    for a, b in (('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        e = F.replace(e, F.lit(a), F.lit(b))
    return e


def conversation_sidecars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One sidecar document per conversation turn: user turns are photo sidecars,
    assistant turns album sidecars, every fifth conversation tool tags, system turns unknown."""
    from pyspark.sql import functions as F

    from mediafold.sources.tables import load
    c = load(spark, sf_dir, "conversations", ["conv_id", "turn", "role", "text"])
    k = F.col("conv_id")
    t = _json_str(F.col("text"))
    epoch = (F.lit(1_600_000_000) + k * 86_400 + F.col("turn") * 3_600).cast("string")
    lat = F.when(F.col("turn") % 3 == 0, F.lit("0.0")).otherwise(((k % 170) - 85).cast("string"))
    lng = ((k * 7 % 360) - 180).cast("string")
    photo = F.concat(F.lit('{"title": "'), t, F.lit('", "description": "'), F.col("role"),
                     F.lit('", "imageViews": "'), (F.col("turn") * 3).cast("string"),
                     F.lit('", "photoTakenTime": {"timestamp": "'), epoch,
                     F.lit('", "formatted": ""}, "geoData": {"latitude": '), lat, F.lit(', "longitude": '), lng,
                     F.lit(', "altitude": '), (F.col("turn") * 10).cast("string"), F.lit(".75}}"))
    album = F.concat(F.lit('{"albumData": {"title": "'),
                     F.when(F.col("turn") % 4 == 1, F.lit("")).otherwise(t), F.lit('", "description": ""}}'))
    tool = F.concat(F.lit('[{"ExifToolVersion": 12.4, "Title": "'), t, F.lit('"}]'))
    role = F.col("role")
    doc = (F.when(k % 5 == 0, tool).when(role == "user", photo).when(role == "assistant", album)
           .otherwise(F.lit('{"unknown": 1}')))
    return c.select("conv_id", "turn", doc.alias("doc"))


def q_sidecar_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from mediafold.operators.tags import json_kind
    from mediafold.sources import sidecars
    s = conversation_sidecars(spark, sf_dir).withColumn("kind", json_kind(F.col("doc")))
    photo = F.when(F.col("kind") == "photo", F.col("doc"))
    s = sidecars.with_photo_fields(s.withColumn("photo_doc", photo), "photo_doc", "p")
    return s.select("conv_id", "turn", "kind", F.col("p.title").alias("title"),
                    F.col("p.description").alias("description"), F.col("p.views").alias("views"),
                    F.col("p.taken_utc").alias("taken_utc"), F.col("p.lat").alias("lat"), F.col("p.lng").alias("lng"),
                    F.col("p.altitude").alias("altitude"),
                    F.when(F.col("kind") == "album", sidecars.album_title(F.col("doc"))).alias("album"))


def q_photo_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A8 + H29: photo sidecars with the zone of their position and the taken time re-read in it."""
    from pyspark.sql import functions as F

    from mediafold.operators.tags import json_kind
    from mediafold.sources import sidecars
    s = conversation_sidecars(spark, sf_dir).withColumn("kind", json_kind(F.col("doc")))
    s = sidecars.with_photo_fields(s.withColumn("doc", F.when(F.col("kind") == "photo", F.col("doc"))), "doc", "p",
                                   nation_regions(spark, sf_dir))
    return s.select("conv_id", "turn", F.col("p.taken_utc").alias("taken_utc"), F.col("p.taken_local").alias("taken_local"),
                    F.col("p.time_zone").alias("time_zone"))


def q_album_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Albums named by the sidecars of each directory (a directory holds ten conversations)."""
    from pyspark.sql import functions as F

    from mediafold.operators.tags import json_kind
    from mediafold.sources import sidecars
    s = conversation_sidecars(spark, sf_dir)
    path = F.concat(F.lit("/albums/"), F.floor(F.col("conv_id") / 10).cast("string"), F.lit("/"),
                    F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string"), F.lit(".json"))
    album = F.when(json_kind(F.col("doc")) == "album", F.col("doc"))
    return sidecars.albums_by_directory(s.select(path.alias("path"), album.alias("doc")))


def q_name_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders whose sidecar names another file than expected."""
    from pyspark.sql import functions as F

    from mediafold.operators import tags as TG
    from mediafold.sources.tables import load
    o = load(spark, sf_dir, "orders", ["o_orderkey", "o_custkey", "o_orderstatus"])
    k, st = F.col("o_orderkey"), F.col("o_orderstatus")
    name = F.concat(F.lit("IMG_"), k.cast("string"), F.lit(".jpg"))
    stated = (F.when(st == "O", name).when(st == "F", F.concat(F.lit("IMG_"), (k + F.col("o_custkey") % 2).cast("string"),
                                                              F.lit(".jpg"))).otherwise(F.lit("")))
    doc = F.concat(F.lit('[{"FileName": "'), stated, F.lit('"}]'))
    d = o.select("o_orderkey", F.when(k % 7 != 0, name).alias("expected"), TG.parse_tag_document(doc).alias("tags"))
    return TG.check_file_name(d, "expected").select("o_orderkey", "error")


QUERIES["photo_zones"] = q_photo_zones
QUERIES["album_titles"] = q_album_titles
QUERIES["name_check"] = q_name_check
QUERIES["sidecar_kinds"] = q_sidecar_kinds


# -- taken dates from several sources -------------------------------------------------------

def q_taken_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from mediafold.functions import dates as D
    from mediafold.operators import timezones as TZ
    from mediafold.sources.tables import load
    z = TZ.zone_lookup(event_points(spark, sf_dir, ("ts", "event_type")), nation_regions(spark, sf_dir))
    t = F.col("event_type")
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    xmp = (F.when(t == "view", F.concat(iso, F.lit("+01:00")))
           .when(t == "click", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))
           .when(t == "purchase", F.concat(iso, F.lit("Z")))
           .when(t == "error", F.concat(iso, F.lit(" extra"))).otherwise(F.lit("garbage")))
    tag = F.date_format("ts", "yyyy:MM:dd HH:mm:ss")
    dto = F.when(t == "view", tag)
    cdt = F.when(t.isin("click", "error"), tag)
    gps = F.when(t == "purchase", F.unix_timestamp("ts") - 60)
    x = z.select(
        "event_id", "zone", xmp.alias("xmp_text"), dto.alias("dto"), cdt.alias("cdt"), gps.alias("gps"),
        F.unix_timestamp("ts").cast("string").alias("epoch_text"), t.alias("event_type"))
    # Parsed date-times are staged as columns (each is read several times below).
    x = D.with_tag_datetime(D.with_tag_datetime(x, "dto", "dto_p"), "cdt", "cdt_p")
    x = D.with_xmp_date(x, "xmp_text", "xmp_utc")
    photo_zone = F.when(F.col("event_type") == "click", F.col("zone"))
    photo = D.photo_epoch_time(F.col("epoch_text"), photo_zone)
    none = D.parse_tag_datetime(F.lit(None).cast("string"))
    exif = D.exif_taken([F.col("dto_p"), none, F.col("cdt_p")], F.col("gps"), F.col("zone"), parsed=True)
    y = x.select("event_id", "zone", "xmp_utc", photo.alias("photo_utc"), exif.alias("exif_utc"))
    birth = TZ.birth_from_taken(F.col("exif_utc"), F.coalesce(F.col("zone"), F.lit("")), F.lit(None))
    return y.select("event_id", "xmp_utc", "photo_utc", "exif_utc", birth.alias("birth"),
                    F.when(birth.isNotNull(), F.lit("meta")).alias("birth_src"))


QUERIES["taken_dates"] = q_taken_dates


# -- place cells and streams ----------------------------------------------------------------

def q_cell_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events per place cell, and how many of them lie in the wider cell around it (level 8)."""
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    from mediafold.functions import cells
    p = cells.with_cell_ids(event_points(spark, sf_dir), "lat", "lng", "id")
    per_cell = p.where(F.col("id").isNotNull()).groupBy("id").agg(
        F.count(F.lit(1)).alias("n_points"), F.min("event_id").alias("first_event"))
    wide = cells.parent(F.col("id"), 8)
    return per_cell.select(
        cells.cell_token(F.col("id")).alias("cell"), "n_points", "first_event", cells.cell_token(wide).alias("area"),
        F.sum("n_points").over(Window.partitionBy(wide)).alias("n_area"))


def events_stream(spark: SparkSession, sf_dir: str, files: int = 6) -> DataFrame:
    """All events, dealt over ``files`` Parquet files by number and streamed two files a micro-batch."""
    from pyspark.sql import functions as F

    from mediafold.sources.tables import load
    from mediafold.streaming.stream_index import scratch_root
    events = load(spark, sf_dir, "events")
    folder = scratch_root(spark, "events-files")
    events.repartition(files, F.pmod(F.col("event_id"), F.lit(1009))).write.parquet(folder)
    return (spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 2).parquet(folder))


def events_as_catalog_rows(stream: DataFrame) -> DataFrame:
    """Each event is a sighting of its user's file of that type, so paths come again with other times and sizes."""
    from pyspark.sql import functions as F

    from mediafold.functions.ids import digest_id
    return stream.select(
        F.concat(F.lit("/stream/"), F.col("event_type"), F.lit("/"), F.col("user_id").cast("string"),
                 F.lit(".evt")).alias("name"),
        F.concat(F.lit("user"), (F.col("user_id") % 8).cast("string")).alias("hostname"),
        digest_id(F.concat(F.col("event_type"), F.lit(":"), F.col("user_id").cast("string"))).alias("id"),
        F.floor(F.col("value") * 100).cast("bigint").alias("size"),
        F.unix_timestamp("ts").cast("bigint").alias("timemodified"),
        F.unix_timestamp("ts").cast("bigint").alias("timeborn"),
        F.lit("stat").alias("timebornsrc"), F.lit("application").alias("mimetype"),
        F.lit("octet-stream").alias("mimesubtype"),
        # event time for the watermark (the table stores wall-clock NTZ; the session zone is UTC)
        F.col("ts").cast("timestamp").alias("ts"))


def q_stream_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events file streamed (availableNow) into a catalog via foreachBatch upserts."""
    from mediafold.streaming import stream_index as S
    root = S.scratch_root(spark, "stream-index")
    q = S.start_index_stream(events_stream(spark, sf_dir), lambda s: events_as_catalog_rows(s).drop("ts"),
                             f"{root}/catalog", f"{root}/_checkpoint")
    q.awaitTermination()
    return S.latest_catalog(spark, f"{root}/catalog")


def q_stream_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content ids as first seen by the streaming dedupe."""
    from pyspark.sql import functions as F

    from mediafold.functions.ids import id_hex
    from mediafold.streaming import stream_index as S
    root = S.scratch_root(spark, "stream-dedupe")
    q = S.start_dedupe_stream(events_stream(spark, sf_dir), events_as_catalog_rows, f"{root}/out",
                              f"{root}/_checkpoint")
    q.awaitTermination()
    return spark.read.parquet(f"{root}/out").select(id_hex(F.col("id")).alias("id_hex"))


QUERIES["cell_rollup"] = q_cell_rollup
QUERIES["stream_index"] = q_stream_index
QUERIES["stream_dedupe"] = q_stream_dedupe


def q_alternate_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Basenames of contents stored under more than one name."""
    from pyspark.sql import functions as F

    from mediafold.functions.ids import id_hex
    pairs = dedupe.alternate_names(derive.documents_as_files(spark, sf_dir))
    return pairs.select(id_hex(F.col("id")).alias("id_hex"), "basename", "n_files")


QUERIES["alternate_names"] = q_alternate_names


def q_image_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """width/height by tag precedence, replaced by ImageWidth/ImageHeight when both are there and > 0."""
    from pyspark.sql import functions as F

    from mediafold.operators import tags as TG
    from mediafold.sources.tables import load
    p = load(spark, sf_dir, "part", ["p_partkey", "p_size", "p_type"])
    w, h = (F.col("p_size") * 40).cast("string"), (F.col("p_partkey") % 50 * 30).cast("string")
    t = F.col("p_type")
    doc = (F.when(t == "ECONOMY", F.concat(F.lit('{"ImageWidth": '), w, F.lit(', "ImageHeight": '), h,
                                           F.lit(', "ExifImageWidth": 11, "ExifImageHeight": 22}')))
           .when(t == "SMALL", F.concat(F.lit('{"ImageWidth": '), w, F.lit(', "ExifImageHeight": 22}')))
           .otherwise(F.concat(F.lit('{"PixelXDimension": "'), w, F.lit('", "ImageLength": "'), h,
                               F.lit('", "ImageWidth": "0", "ImageHeight": "'), h, F.lit('"}'))))
    d = p.select("p_partkey", TG.parse_tag_document(doc).alias("tags"))
    fields = {k: TG.TAG_FIELDS[k] for k in ("width", "height")}
    return TG.image_size_override(TG.assign_fields(d, "tags", fields)).select("p_partkey", "width", "height")


QUERIES["image_sizes"] = q_image_sizes


# -- XMP documents -----------------------------------------------------------------------------

def documents_as_xmp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One XMP document of two or three blocks per document: bare and listed texts, fields that come again, dates."""
    from pyspark.sql import functions as F

    from mediafold.sources.tables import load
    d = load(spark, sf_dir, "documents", ["doc_id", "lang", "source"])
    k, text = F.col("doc_id"), F.col("doc_id").cast("string")

    def block(*parts):
        return F.concat(F.lit('<rdf:Description rdf:about="">'), *[F.lit(p) if isinstance(p, str) else p for p in parts],
                        F.lit("</rdf:Description>"))
    two = F.lpad((k % 10).cast("string"), 2, "0")
    zone = F.when(k % 3 == 0, F.lit("Z")).when(k % 3 == 1, F.lit("+02:30")).otherwise(F.lit(".250"))
    date = F.concat(F.lit("20"), F.lpad((k % 20).cast("string"), 2, "0"), F.lit("-0"), (k % 9 + 1).cast("string"), F.lit("-1"),
                    (k % 10).cast("string"), F.lit("T"), two, F.lit(":3"), (k % 6).cast("string"), F.lit(":"), two, zone)
    title = F.when(k % 3 == 0, F.concat(F.lit("<dc:title>Bare &amp; "), text, F.lit(" title</dc:title>"))).otherwise(
        F.concat(F.lit("<dc:title><rdf:Alt><rdf:li>Old</rdf:li><rdf:li>Walk &lt;"), text, F.lit("&gt; home</rdf:li></rdf:Alt></dc:title>")))
    first = block(title, "<dc:subject><rdf:Seq><rdf:li>", "Lang ", F.col("lang"), "</rdf:li><rdf:li>sea</rdf:li></rdf:Seq></dc:subject>",
                  "<photoshop:DateCreated>", date, "</photoshop:DateCreated><dc:creator><rdf:Seq><rdf:li>\"Jo\" ", F.col("source"),
                  "</rdf:li></rdf:Seq></dc:creator>")
    second = block("<tiff:Make> Kodak </tiff:Make><tiff:Model>", F.col("source"), "</tiff:Model>",
                   "<dc:rights><rdf:Alt><rdf:li>R</rdf:li></rdf:Alt></dc:rights>")
    third = F.when(k % 4 == 0, block("<dc:title><rdf:Alt><rdf:li>Last word ", text, "</rdf:li></rdf:Alt></dc:title>")).otherwise("")
    names = {"x": "adobe:ns:meta/", "rdf": "http://www.w3.org/1999/02/22-rdf-syntax-ns#", "dc": "http://purl.org/dc/elements/1.1/",
             "photoshop": "http://ns.adobe.com/photoshop/1.0/", "tiff": "http://ns.adobe.com/tiff/1.0/"}
    head = "<x:xmpmeta " + " ".join(f'xmlns:{n}="{u}"' for n, u in names.items()) + "><rdf:RDF>"
    doc = F.when(k % 50 == 7, F.lit("not xml <")).otherwise(
        F.concat(F.lit(head), first, second, third, F.lit("</rdf:RDF></x:xmpmeta>")))
    return d.select("doc_id", doc.alias("doc"))


def q_xmp_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A10 + J8: XMP documents in a text column, one merged record each."""
    from pyspark.sql import functions as F

    from mediafold.sources.sidecars import xmp_records
    r = xmp_records(documents_as_xmp(spark, sf_dir), "doc")
    return r.select("doc_id", "title", "artist", "subject", F.array_join("keywords", ", ").alias("keywords"), "copyright",
                    "camera_make", "camera_model", "taken_utc")


QUERIES["xmp_records"] = q_xmp_records


def q_merge_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D10 + J11 on typed records: numbers, flags and keyword lists of three sources, texts of two."""
    from pyspark.sql import functions as F

    from mediafold.functions.text import add_keywords
    from mediafold.operators.merge import merge_sources
    from mediafold.sources.tables import load
    d = load(spark, sf_dir, "documents", ["doc_id", "lang", "source", "n_chars"])
    lab = load(spark, sf_dir, "labels", ["doc_id", "quality", "toxic"])
    k = F.col("doc_id")
    exif = d.select("doc_id", (k % 4).cast("int").alias("iso"), (F.col("n_chars") % 3).alias("width"), (k % 5 == 0).alias("flash"),
                    add_keywords(F.lit(None), F.concat(F.lit("Sea, "), F.col("lang"))).alias("keywords"),
                    (k % 3).cast("double").alias("fps"), F.col("source").alias("artist"))
    js = lab.select("doc_id", (F.col("quality") * 100).cast("long").alias("iso"), (k % 7).alias("width"), (F.col("quality") == 1).alias("flash"),
                    F.array(F.lit("json"), F.when(k % 2 == 0, F.lit("sea"))).alias("keywords"), F.lit(29.97).alias("fps"))
    xmp = lab.where("toxic = 1").select("doc_id", F.lit(0).alias("iso"), F.lit(640).cast("long").alias("width"),
                                        F.array(F.lit("art"), F.lit("")).alias("keywords"), F.lit("  ").alias("artist"))
    m = merge_sources([("exif", exif, "fill"), ("json", js, "fill"), ("xmp", xmp, "overwrite")], "doc_id",
                      ["iso", "width", "flash", "keywords", "fps", "artist"])
    return m.withColumn("keywords", F.array_join("keywords", ", "))


QUERIES["merge_metadata"] = q_merge_metadata
