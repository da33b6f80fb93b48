"""Text and keyword cleaning (J9: G7-G13, G15, G18, C12, C14, E8).

Every rule is a native Column expression (regex, higher-order array
functions, ``create_map`` lookups), usable in any projection.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mediafold.functions.names import is_time

# Fixed value: the characters Go's TrimSpace removes (Unicode White_Space).
SPACE_CLASS = (r"[\t\n\x{0B}\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}"
               r"\x{202F}\x{205F}\x{3000}]")
BINARY_PREFIX = "string with binary data"

# Descriptions written by cameras and apps, removed as noise.
UNWANTED_DESCRIPTIONS = [
    "Created by Imlib", "iClarified", "OLYMPUS DIGITAL CAMERA", "SAMSUNG",
    "SAMSUNG CAMERA PICTURES", "<Digimax i5, Samsung #1>", "SONY DSC", "rhdr", "hdrpl",
    "oznorWO", "frontbhdp", "fbt", "rbt", "ptr", "fbthdr", "btr", "mon", "nor", "dav", "mde",
    "mde_soft", "edf", "btfmdn", "btf", "btfhdr", "frem", "oznor", "rpt", "burst", "sdr_HDRB",
    "cof", "qrf", "fshbty", "binary comment", "default", "Exif_JPEG_PICTURE", "DVC 10.1 HDMI",
    "charset=Ascii",
]

# Words added automatically when they occur in a description.
AUTO_KEYWORDS = ["hdr", "burst", "panorama", "equirectangular"]
KEYWORD_FLASH = "flash"
KEYWORD_PANORAMA = "panorama"
PROJECTION_EQUIRECTANGULAR = "equirectangular"
WORD_PATTERN = r"[\p{L}\p{N}]+"

# File extensions stripped from titles (case-insensitive) and
# the camera/app name shapes treated as generated names.
KNOWN_EXTENSIONS = [
    "jpg", "jpeg", "jpe", "png", "gif", "bmp", "tif", "tiff", "heic", "heif", "webp", "avif",
    "raw", "cr2", "cr3", "nef", "arw", "dng", "orf", "rw2", "raf", "mp4", "mov", "avi", "mkv",
    "m4v", "mts", "m2ts", "3gp", "webm", "wmv", "mpg", "mpeg", "mp3", "m4a", "wav", "flac",
    "aac", "ogg", "ogv", "xmp", "json",
]
GENERATED_NAME_PATTERN = (r"^(?:(?:IMG|DSC|DSCN|DSCF|DSCI|PXL|VID|MVI|MOV|GOPR|GP|DJI|SAM|PANO|WP|"
                          r"PHOTO|VIDEO|SCAN)[_\-]?[0-9]+(?:[_\-][0-9]+)*|[0-9a-fA-F]{16,}|"
                          r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12})$")
LOWER_WORD_PATTERN = r"[a-z\d_\-]+"
# Title words whose casing is not plain initial capitals.
TITLE_WORDS = {"mcgregor": "McGregor", "tiff": "TIFF", "usa": "USA", "uk": "UK", "nyc": "NYC"}

# Codec names folded to one spelling.
VIDEO_CODECS = {
    "avc1": "avc1", "avc": "avc1", "h264": "avc1", "h.264": "avc1", "x264": "avc1",
    "hvc1": "hevc", "hev1": "hevc", "hevc": "hevc", "h265": "hevc", "h.265": "hevc", "x265": "hevc",
    "av01": "av01", "av1": "av01",
    "vp08": "vp8", "vp8": "vp8",
    "vp09": "vp9", "vp9": "vp9",
    "theora": "ogv", "ogv": "ogv",
}
CODEC_AVC = "avc1"
CODEC_JPEG = "jpeg"


# The same characters, spelled out for ``btrim`` (no regex on the hot path).
SPACE_CHARS = ("\t\n\x0b\f\r \x85\xa0\u1680" + "".join(chr(c) for c in range(0x2000, 0x200B))
               + "\u2028\u2029\u202f\u205f\u3000")


def trim_space(s: Column) -> Column:
    """Go's TrimSpace: Unicode white space removed at both ends (native ``btrim``)."""
    return F.btrim(s, F.lit(SPACE_CHARS))


def sanitize_string(s: Column) -> Column:
    """G7: '' for binary-data placeholders; trimmed; double quotes removed."""
    v = F.coalesce(s, F.lit(""))
    return F.when(v.startswith(BINARY_PREFIX), F.lit("")).otherwise(
        F.regexp_replace(trim_space(v), '"', ""))


def sanitize_uid(s: Column) -> Column:
    """G7, text after the last ':', 15-36 bytes else '', lower case."""
    v = F.substring_index(sanitize_string(s), ":", -1)
    return F.when(F.octet_length(v).between(15, 36), F.lower(v)).otherwise(F.lit(""))


def sanitize_description(s: Column) -> Column:
    """G7, then '' for camera noise or a bare ``DCIM\\`` path."""
    v = sanitize_string(s)
    unwanted = v.isin(*UNWANTED_DESCRIPTIONS)
    dcim = v.startswith("DCIM\\") & ~v.contains(" ")
    return F.when(unwanted | dcim, F.lit("")).otherwise(v)


def sanitize_meta(s: Column) -> Column:
    """A JSON array of strings (or nulls, read as '') -> ``a, b``; another bracketed text stays as is; else G7.

    The JSON parser decides what is an array of strings: texts of any length are safe, and it only runs on bracketed
    texts.
    """
    v = F.coalesce(s, F.lit(""))
    bracketed = v.startswith("[") & v.endswith("]")
    parsed = F.try_parse_json(F.when(bracketed, v))
    items = F.transform(F.try_variant_get(parsed, "$", "array<string>"), lambda x: F.coalesce(x, F.lit("")))
    as_list = F.when(F.schema_of_variant(parsed).isin("ARRAY<STRING>", "ARRAY<VOID>"), F.array_join(items, ", "))
    return (F.when(v == "", F.lit(""))
            .when(bracketed, F.coalesce(as_list, v))
            .otherwise(sanitize_string(v)))


def words(low: Column) -> Column:
    """Letter/digit words of text that is cleaned (G11) and lower-cased."""
    return F.regexp_extract_all(low, F.lit(WORD_PATTERN), 0)


def keyword_words(s: Column) -> Column:
    """Lower-case letter/digit words of a keyword text (after G11)."""
    return words(F.lower(sanitize_meta(s)))


def add_words(current: Column, more: Column) -> Column:
    """Sorted distinct union of two word lists (NULL counts as empty)."""
    none = F.array().cast("array<string>")
    return F.array_sort(F.array_distinct(F.concat(F.coalesce(current.cast("array<string>"), none), F.coalesce(more, none))))


def add_keywords(current: Column, s: Column) -> Column:
    """Sorted distinct union of the current keywords and the words of ``s``."""
    return add_words(current, keyword_words(s))


def auto_keywords(s: Column) -> Column:
    """The automatic keywords contained in the lower-cased text.

    One ``instr`` per keyword on the same lower-cased text; the text is a
    common subexpression of the always-evaluated conditions, so it is
    computed once per row (a lambda over the keyword array would recompute
    it per keyword).
    """
    return auto_keywords_lower(F.lower(sanitize_meta(s)))


def auto_keywords_lower(low: Column) -> Column:
    """G12 on text that is already cleaned (G11) and lower-cased."""
    return F.array_compact(F.array(*[F.when(F.instr(low, F.lit(w)) > 0, F.lit(w)) for w in AUTO_KEYWORDS]))


def keywords_string(k: Column) -> Column:
    """Keyword list -> ``a, b``."""
    return F.array_join(k, ", ")


def _title_word(w: Column) -> Column:
    special = F.create_map(*[x for k, v in TITLE_WORDS.items() for x in (F.lit(k), F.lit(v))])
    plain = F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, F.lit(2), F.length(w))))
    return F.coalesce(F.try_element_at(special, F.lower(w)), plain)


def file_title(s: Column) -> Column:
    """Title from a lower-case file name: ``--`` separates parts (`` / ``),
    ``-``/``_`` separate words, numbers and one-letter tokens drop, words get
    initial capitals (with a small exception table)."""
    segs = F.split(s, "--")

    def seg_title(seg):
        words = F.filter(F.split(seg, "[-_ ]+"),
                         lambda w: ~w.rlike("^[0-9]+$") & (F.length(w) > 1))
        return F.array_join(F.transform(words, _title_word), " ")

    return F.array_join(F.filter(F.transform(segs, seg_title), lambda x: x != ""), " / ")


def strip_known_ext(s: Column) -> Column:
    exts = "|".join(KNOWN_EXTENSIONS)
    return F.regexp_replace(s, f"(?i)\\.(?:{exts})$", "")


def is_generated_name(s: Column) -> Column:
    return s.rlike(GENERATED_NAME_PATTERN)


def sanitize_title(s: Column) -> Column:
    """Clean a title that may be a file name.

    Known extension stripped; a generated name or a date -> ''; no extension
    removed -> unchanged; mixed case or other characters -> ``_`` to space;
    all lower-case name -> :func:`file_title`.
    """
    v = sanitize_string(s)
    r = strip_known_ext(v)
    lower_only = F.regexp_extract(r, LOWER_WORD_PATTERN, 0) == r
    spaced = F.regexp_replace(F.regexp_replace(r, "_", " "), "  ", " ")
    ft = file_title(r)
    return (F.when(v == "", F.lit(""))
            .when(is_generated_name(r) | is_time(r), F.lit(""))
            .when(r == v, v)
            .when(~lower_only, spaced)
            .when(ft != "", ft)
            .otherwise(F.initcap(F.regexp_replace(r, "-", " "))))


def normalize_codec(s: Column) -> Column:
    """Lower case; contains ``jpeg`` -> jpeg; known video codec -> canonical; ``a_`` prefix -> ''."""
    v = F.lower(F.coalesce(s, F.lit("")))
    m = F.create_map(*[x for k, c in VIDEO_CODECS.items() for x in (F.lit(k), F.lit(c))])
    return (F.when(v.contains(CODEC_JPEG), F.lit(CODEC_JPEG))
            .when(F.try_element_at(m, v).isNotNull(), F.try_element_at(m, v))
            .when(v.startswith("a_"), F.lit(""))
            .otherwise(v))


def is_avc(codec: Column) -> Column:
    """C12."""
    return F.coalesce(codec == CODEC_AVC, F.lit(False))


def mime_parts(mime: Column) -> Column:
    """struct(type, subtype) of ``type/subtype``; a missing half is NULL."""
    parts = F.split(mime, "/", 2)
    t = F.try_element_at(parts, F.lit(1))
    return F.struct(F.when(t != "", t).alias("type"), F.try_element_at(parts, F.lit(2)).alias("subtype"))


def projection_keywords(keywords: Column, projection: Column) -> Column:
    """An equirectangular projection adds the keyword ``panorama``."""
    eq = F.coalesce(F.lower(projection) == PROJECTION_EQUIRECTANGULAR, F.lit(False))
    return F.when(eq, add_keywords(keywords, F.lit(KEYWORD_PANORAMA))).otherwise(keywords)
