"""Number, duration and image-geometry expressions.

All native Column expressions.  Parsing never fails a job: invalid input
yields the reference's zero value (ANSI mode stays on; ``try_*`` casts).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns and lookup tables of the reference's parsers.
DURATION_NUMBER_PATTERN = r"[0-9\.]+"
SIGNED_INT_PATTERN = r"^[+\-]?[0-9]+$"
UNSIGNED_INT_PATTERN = r"^[0-9]+$"
FLOAT_PATTERN = r"[+\-]?(?:(?:0|[1-9]\d*)(?:\.\d*)?|\.\d+)"
ORIENTATION_TEXT = {
    "1": 1, "Horizontal (normal)": 1,
    "2": 2,
    "3": 3, "Rotate 180 CW": 3,
    "4": 4,
    "5": 5,
    "6": 6, "Rotate 90 CW": 6,
    "7": 7,
    "8": 8, "Rotate 270 CW": 8,
}
ROTATION_ORIENTATION = {0: 1, -180: 3, 180: 3, 90: 6, -90: 8, 270: 8}
IMAGE_TYPE_HDR = 3


def atoi(s: Column) -> Column:
    """Go ``strconv.Atoi``: optional sign and digits only (no blanks), else NULL."""
    return F.when(_unpadded(s), s.try_cast("int"))


def _unpadded(s: Column) -> Column:
    """No blank or control character at either end (a cast would skip those): two byte comparisons, no regex."""
    return (F.substring(s, 1, 1) > " ") & (F.substring(s, -1, 1) > " ")


def _digit(c: Column) -> Column:
    return c.between("0", "9")


def parse_float(s: Column) -> Column:
    """Text -> double, invalid -> 0 (blank text is invalid)."""
    # What the cast accepts beyond plain decimals (blanks, a type letter, hex, NaN, Infinity) is told by a few characters.
    first, last = F.substring(s, 1, 1), F.substring(s, -1, 1)
    ok = (_digit(first) | first.isin("+", "-", ".")) & (_digit(last) | (last == ".")) & ~F.upper(s).contains("X")
    v = s.try_cast("double")
    return F.coalesce(F.when(ok & (F.abs(v) < F.lit(float("inf"))), v), F.lit(0.0))


def duration_seconds(s: Column) -> Column:
    """H8: duration text -> whole seconds.

    Exactly one number -> that number truncated; else ``h:m:s`` with three
    parts (a part that is not an integer counts 0); else 0.
    """
    t = F.trim(F.coalesce(s, F.lit("")))
    nums = F.regexp_extract_all(t, F.lit(DURATION_NUMBER_PATTERN), 0)
    one = F.try_element_at(nums, F.lit(1))
    single = F.coalesce(
        F.when(one.rlike(r"^(?:[0-9]+\.?[0-9]*|\.[0-9]+)$"), one.try_cast("double")).try_cast("bigint"),
        F.lit(0).cast("bigint"))
    parts = F.split(t, ":")

    def part(i: int) -> Column:
        return F.coalesce(atoi(F.try_element_at(parts, F.lit(i))).cast("bigint"), F.lit(0).cast("bigint"))

    hms = part(1) * 3600 + part(2) * 60 + part(3)
    return (F.when(t == "", F.lit(0).cast("bigint"))
            .when(F.size(nums) == 1, single)
            .when(F.size(parts) == 3, hms)
            .otherwise(F.lit(0).cast("bigint")))


def leading_number(s: Column) -> Column:
    """Number at the start of text with units (``5.6 mm`` -> 5.6), else NULL."""
    # NULL in, NULL out; a whole text that is a number (also 1.2E-4) needs no regex, only text with a unit does.
    whole = s.try_cast("double")
    m = F.regexp_extract(s, r"^\s*([+\-]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][+\-]?[0-9]+)?)", 1)
    finite = F.lit(float("inf"))
    return F.when(F.abs(whole) < finite, whole).when(F.abs(m.try_cast("double")) < finite, m.try_cast("double"))


def leading_int(s: Column) -> Column:
    """H24 for int fields: leading number truncated toward zero as a 64-bit integer, else 0."""
    return F.coalesce(leading_number(s).try_cast("bigint"), F.lit(0).cast("bigint"))


def altitude_fallback(s: Column) -> Column:
    """Exactly one float in ``GPSAltitude`` -> truncated int, else 0."""
    fl = F.regexp_extract_all(F.coalesce(s, F.lit("")), F.lit(FLOAT_PATTERN), 0)
    v = F.try_element_at(fl, F.lit(1)).try_cast("double")
    return F.when((F.size(fl) == 1) & (v != 0), v.try_cast("int")).otherwise(F.lit(0))


def subsec_ns(s: Column) -> Column:
    """Positive-integer sub-second text right-padded to 9 digits, else 0."""
    ok = (F.length(s) <= 9) & _digit(F.substring(s, 1, 1)) & _digit(F.substring(s, -1, 1)) & (s.try_cast("bigint") > 0)
    return F.coalesce(F.when(ok, F.rpad(s, 9, "0").try_cast("int")), F.lit(0))


def flash_fired(s: Column) -> Column:
    """Exif ``Flash`` value with the low bit set."""
    return F.coalesce(atoi(s).bitwiseAND(F.lit(1)) == 1, F.lit(False))


def exposure(s: Column) -> Column:
    """``a/b`` with a != "1", len(a) < len(b), both > 0 -> ``1/(b div a)``; else as is."""
    parts = F.split(s, "/")
    a, b = F.try_element_at(parts, F.lit(1)), F.try_element_at(parts, F.lit(2))
    na = F.when(a.rlike(UNSIGNED_INT_PATTERN), a.try_cast("decimal(20,0)"))
    nb = F.when(b.rlike(UNSIGNED_INT_PATTERN), b.try_cast("decimal(20,0)"))
    ok = ((F.size(parts) == 2) & (a != "1") & (F.octet_length(a) < F.octet_length(b))
          & F.coalesce(na > 0, F.lit(False)) & (nb > 0))
    q = F.floor(nb / na).cast("decimal(20,0)").cast("string")
    return F.when(ok, F.concat(F.lit("1/"), q)).otherwise(s)


def rational_value(s: Column) -> Column:
    """H18 core: ``a/b`` -> a/b as double when b is neither '0' nor ''; else NULL."""
    parts = F.split(s, "/")
    a, b = F.try_element_at(parts, F.lit(1)), F.try_element_at(parts, F.lit(2))
    ok = (F.size(parts) == 2) & (b != "0") & (b != "")
    num = F.coalesce(a.try_cast("double"), F.lit(0.0))
    den = F.coalesce(b.try_cast("double"), F.lit(0.0))
    return F.when(ok, F.try_divide(num, den))


def rational_3(s: Column) -> Column:
    """Rational rounded to 3 decimals, as float32 (FNumber, Aperture); NULL if skipped."""
    return (F.round(rational_value(s) * 1000, 0) / 1000).cast("float")


def focal_length(mm35: Column, rational: Column) -> Column:
    """The 35 mm value when present (``Atoi``), else the rational rounded to 3 places and truncated."""
    r = (F.round(rational_value(rational) * 1000, 0) / 1000).try_cast("int")
    return F.when(mm35.isNotNull(), atoi(mm35)).otherwise(r)


def orientation(tag: Column, rotation: Column) -> Column:
    """Orientation 1-8 from the tag text, else derived from rotation, else 0.

    ``Rotate 180`` without ``CW`` is not a known text and falls to rotation.
    """
    mapping = F.create_map(*[x for k, v in ORIENTATION_TEXT.items() for x in (F.lit(k), F.lit(v))])
    rot = F.create_map(*[x for k, v in ROTATION_ORIENTATION.items() for x in (F.lit(k), F.lit(v))])
    from_tag = F.try_element_at(mapping, F.coalesce(tag, F.lit("")))
    from_rot = F.try_element_at(rot, F.coalesce(rotation, F.lit(0)))
    return F.coalesce(from_tag, from_rot, F.lit(0))


def actual_width(width: Column, height: Column, orient: Column) -> Column:
    """Displayed width (sides swap when orientation > 4)."""
    return F.when(orient > 4, height).otherwise(width)


def actual_height(width: Column, height: Column, orient: Column) -> Column:
    return F.when(orient > 4, width).otherwise(height)


def aspect_ratio(w: Column, h: Column) -> Column:
    """round(w/h*100)/100 as float32; 0 when a side is <= 0."""
    r = F.round(w.cast("double") / h.cast("double") * 100, 0) / 100
    return F.when((w <= 0) | (h <= 0), F.lit(0.0)).otherwise(r).cast("float")


def megapixels(w: Column, h: Column) -> Column:
    """round(w*h / 1e6)."""
    return F.round(w.cast("bigint") * h.cast("bigint") / 1e6, 0).cast("int")


def is_portrait(w: Column, h: Column) -> Column:
    """C11: displayed width < displayed height."""
    return w < h


def is_hdr(image_type: Column) -> Column:
    """HDR image type."""
    return F.coalesce(image_type == IMAGE_TYPE_HDR, F.lit(False))
