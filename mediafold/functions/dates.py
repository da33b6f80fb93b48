"""Tag date-times and time-zone handling.

Instants are Unix seconds (``bigint``); a wall clock "as if UTC" is also Unix
seconds.  Zones are explicit arguments or columns (session zone is UTC).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tag date-time shape, and the default zone for times without one.
TAG_DATETIME_PATTERN = (r"^\s*(\d{4})[:\-](\d{2})[:\-](\d{2})[ T](\d{2}):(\d{2}):(\d{2})"
                        r"(?:\.(\d+))?\s*(Z|[+\-]\d{2}:?\d{2})?\s*$")
USUAL_HEADS = ["0000:00:00 00:00:00", "0000-00-00 00:00:00", "0000:00:00T00:00:00", "0000-00-00T00:00:00"]
USUAL_TAILS = ["", "Z", "+00:00", "-00:00", "+0000", "-0000"]
DEFAULT_ZONE = "Asia/Chongqing"
# Offset texts the reference matched as layouts; they carry no zone, so such
# a time is read as UTC (quirk reproduced under offset_policy='reference').
REFERENCE_OFFSET_LAYOUTS = ["+08:00", "+0800", "-08:00", "-0800"]


def tag_datetime_parts(s: Column) -> Column:
    """The 8 groups of :data:`TAG_DATETIME_PATTERN` as an array, NULL when no match.

    A group that did not take part is ''.  Texts of a usual shape (told by mapping every digit to 0) are cut at
    fixed places; the regex runs only on the others that are long enough to match at all.
    """
    def shape(c):
        return F.translate(c, "123456789", "000000000")
    tail = F.substring(s, F.lit(20), F.length(s))
    usual = shape(F.substring(s, 1, 19)).isin(*USUAL_HEADS) & shape(tail).isin(*USUAL_TAILS)
    cut = F.array(*[F.substring(s, at, n) for at, n in ((1, 4), (6, 2), (9, 2), (12, 2), (15, 2), (18, 2))], F.lit(""), tail)
    joined = F.regexp_replace(s, TAG_DATETIME_PATTERN, "$1|$2|$3|$4|$5|$6|$7|$8")
    # a text that does not match comes back unchanged; a match always gains the separators
    return F.when(usual, cut).when((F.length(s) > 18) & (joined != s), F.split(joined, r"\|"))


def tag_datetime_from_parts(parts: Column) -> Column:
    """Struct of :func:`parse_tag_datetime` from :func:`tag_datetime_parts`."""
    def g(i):
        return F.try_element_at(parts, F.lit(i))
    y, mo, d = (g(i).try_cast("int") for i in (1, 2, 3))
    h, mi, sec = (g(i).try_cast("int") for i in (4, 5, 6))
    frac, off = g(7), g(8)
    ok = (y >= 1) & mo.between(1, 12) & d.between(1, 31) & h.between(0, 23) & mi.between(0, 59) & sec.between(0, 59)
    safe_y = F.least(F.greatest(y, F.lit(1)), F.lit(9999))
    safe_m = F.least(F.greatest(mo, F.lit(1)), F.lit(12))
    day = F.unix_date(F.make_date(safe_y, safe_m, F.lit(1))).cast("bigint") + (d - 1).cast("bigint")
    local = day * 86400 + h.cast("bigint") * 3600 + mi.cast("bigint") * 60 + sec.cast("bigint")
    off_digits = F.substring(F.replace(off, F.lit(":"), F.lit("")), 2, 4)
    off_secs = (F.when(off == "Z", F.lit(0))
                .when(off != "", (F.substring(off_digits, 1, 2).cast("int") * 3600
                                  + F.substring(off_digits, 3, 2).cast("int") * 60)
                      * F.when(off.startswith("-"), -1).otherwise(1)))
    micros = F.when(frac != "", F.rpad(F.substring(frac, 1, 6), 6, "0").cast("int")).otherwise(F.lit(0))
    good = F.coalesce(ok, F.lit(False))
    return F.struct(
        F.when(good, local).alias("local"),
        F.when(good, off_secs).alias("offset"),
        F.when(good, local - F.coalesce(off_secs, F.lit(0)).cast("bigint")).alias("utc"),
        F.when(good, micros).alias("micros"),
        F.when(good, off).alias("offset_text"),
    )


def parse_tag_datetime(s: Column) -> Column:
    """``yyyy:MM:dd HH:mm:ss[.fff][Z|±hh:mm]`` -> struct.

    Fields: ``local`` (wall clock as Unix seconds), ``offset`` (seconds east
    of UTC, NULL when the text has none), ``utc`` (instant: local - offset,
    or local when no offset), ``micros`` (fraction), ``offset_text``.
    All-zero dates and out-of-range parts give NULL.  On wide frames stage
    :func:`tag_datetime_parts` as its own column first (see
    :func:`mediafold.operators.tags.assign_fields`).
    """
    return tag_datetime_from_parts(tag_datetime_parts(s))


def with_tag_datetime(df, text_col: str, out: str):
    """H25 on a DataFrame, staged: the regex runs once per row in one
    projection and the struct fields read that column in the next."""
    tmp = f"__{out}_parts"
    return (df.withColumn(tmp, tag_datetime_parts(F.col(text_col)))
              .withColumn(out, tag_datetime_from_parts(F.col(tmp))).drop(tmp))


def wall_clock_in_zone(utc_seconds: Column, zone: Column | str) -> Column:
    """Wall clock (as if UTC) of an instant seen in ``zone``."""
    z = F.lit(zone) if isinstance(zone, str) else zone
    return F.unix_timestamp(F.from_utc_timestamp(F.timestamp_seconds(utc_seconds), z)).cast("bigint")


def instant_from_wall_clock(local_seconds: Column, zone: Column | str) -> Column:
    """Instant of a wall clock read in ``zone``."""
    z = F.lit(zone) if isinstance(zone, str) else zone
    return F.unix_timestamp(F.to_utc_timestamp(F.timestamp_seconds(local_seconds), z)).cast("bigint")


def default_zone_fix(taken_utc: Column, time_zone: Column, offset_text: Column,
                     default_zone: str = DEFAULT_ZONE, offset_policy: str = "respect") -> Column:
    """H4/H5: birth time from a taken time.

    With a zone known the taken time stands.  Without one the reference
    re-reads the (UTC) clock in the default zone using that day's midnight
    offset: instant - (offset of default zone at local midnight).  An offset
    text equal to one of the four layout strings made it use UTC instead.
    ``offset_policy='respect'`` (default) also keeps the time when any offset
    was parsed; ``'reference'`` reproduces the quirk exactly.
    """
    day_start = (F.floor(taken_utc / 86400) * 86400).cast("bigint")
    midnight_shift = day_start - instant_from_wall_clock(day_start, default_zone)
    fixed = taken_utc - midnight_shift
    no_zone = F.coalesce(time_zone, F.lit("")) == ""
    layout_utc = F.coalesce(offset_text, F.lit("")).isin(*REFERENCE_OFFSET_LAYOUTS)
    keep = ~no_zone | layout_utc
    if offset_policy == "respect":
        keep = keep | (F.coalesce(offset_text, F.lit("")) != "")
    elif offset_policy != "reference":
        raise ValueError("offset_policy must be 'respect' or 'reference'")
    return F.when(keep, taken_utc).otherwise(fixed)


XMP_RFC3339 = r"^(\d{4})-(\d{2})-(\d{2})T(\d{2}):(\d{2}):(\d{2})(?:\.(\d+))?(Z|[+\-]\d{2}:\d{2})$"
XMP_LOCAL = r"^(\d{4})-(\d{2})-(\d{2})T(\d{2}):(\d{2}):(\d{2})(?:\.(\d+))?$"


def _xmp_texts(s: Column) -> tuple[Column, Column]:
    """An XMP date in tag form: the whole text if it has one of the two full shapes, and its first 19 characters."""
    v = F.trim(F.coalesce(s, F.lit("")))
    head = r"^(\d{4})-(\d{2})-(\d{2})T"
    whole = F.when(v.rlike(XMP_RFC3339) | v.rlike(XMP_LOCAL), F.regexp_replace(v, head, "$1:$2:$3 "))
    return whole, F.regexp_replace(F.substring(v, 1, 19), head, "$1:$2:$3 ")


def parse_xmp_date(s: Column) -> Column:
    """RFC 3339 with zone, or a local date-time with fraction, or the first 19 characters.

    Returns the instant (Unix seconds); a local time is read as UTC.
    """
    whole, first19 = (parse_tag_datetime(t)["utc"] for t in _xmp_texts(s))
    return F.coalesce(whole, first19)


def photo_epoch_time(epoch_text: Column, zone: Column | None = None) -> Column:
    """Epoch seconds in text; with a zone the UTC wall clock is re-read
    in that zone (the reference's quirk: the result is shifted by the zone offset)."""
    t = F.when(F.coalesce(epoch_text, F.lit("")).rlike(r"^[0-9]+$"), epoch_text.try_cast("bigint"))
    t = F.when(t > 0, t)
    if zone is None:
        return t
    return F.when(F.coalesce(zone, F.lit("")) == "", t).otherwise(instant_from_wall_clock(t, zone))


def exif_taken(texts: list[Column], gps_utc: Column, zone: Column | None = None,
               parsed: bool = False) -> Column:
    """First valid of the Exif date-time tags, read in the place's zone
    when one is known (an explicit offset in the text wins); else the GPS time.

    With ``parsed`` the inputs are already :func:`parse_tag_datetime` structs
    (stage them as columns on wide frames)."""
    vals = []
    for t in texts:
        p = t if parsed else parse_tag_datetime(t)
        if zone is None:
            vals.append(p["utc"])
        else:
            in_zone = F.when(F.coalesce(zone, F.lit("")) == "", p["utc"]).otherwise(
                instant_from_wall_clock(p["local"], zone))
            vals.append(F.when(p["offset"].isNotNull(), p["utc"]).otherwise(in_zone))
    return F.coalesce(*vals, gps_utc)


def with_xmp_date(df, text_col: str, out: str):
    """H26 on a DataFrame, staged (each regex once per row): ``out`` = instant or NULL."""
    full_text, first19 = _xmp_texts(F.col(text_col))
    a, b = f"__{out}_full", f"__{out}_19"
    df = df.withColumn(a, tag_datetime_parts(full_text)).withColumn(b, tag_datetime_parts(first19))
    return df.withColumn(out, F.coalesce(tag_datetime_from_parts(F.col(a))["utc"],
                                         tag_datetime_from_parts(F.col(b))["utc"])).drop(a, b)
