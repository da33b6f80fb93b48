"""GPS text (H9, H10, C8)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mediafold.functions.numbers import FLOAT_PATTERN

# Coordinate number and hemisphere patterns.
COORD_NUMBER_PATTERN = r"[0-9\.]+"
REF_PATTERN = r"[NSEW]+"


def _float0(s: Column) -> Column:
    ok = s.rlike(r"^[+\-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)$")
    return F.coalesce(F.when(ok, s.try_cast("double")), F.lit(0.0))


def _dms(co: Column, first: int, ref: Column) -> Column:
    deg = _float0(F.try_element_at(co, F.lit(first)))
    mins = _float0(F.try_element_at(co, F.lit(first + 1)))
    secs = _float0(F.try_element_at(co, F.lit(first + 2)))
    v = deg + mins / 60.0 + secs / 3600.0
    r = F.substring(ref, 1, 1)
    return F.when(r.isin("S", "W"), -v).otherwise(v)


def _text_arrays(s: Column) -> Column:
    """The text of a position and the numbers and hemisphere letters found in it (NULL arrays for a NULL text)."""
    t = F.coalesce(s, F.lit(""))
    return F.struct(t.alias("t"), F.regexp_extract_all(s, F.lit(FLOAT_PATTERN), 0).alias("fl"),
                    F.regexp_extract_all(s, F.lit(COORD_NUMBER_PATTERN), 0).alias("co"),
                    F.regexp_extract_all(s, F.lit(REF_PATTERN), 0).alias("re"))


def gps_to_lat_lng(s: Column) -> Column:
    """H9: struct(lat, lng) as float32 from position text.

    Exactly two floats -> as written; else six numbers and two hemisphere
    letters -> degrees/minutes/seconds (S and W negative); else (0, 0).
    On wide frames use :func:`with_lat_lng`, which runs each regex once a row.
    """
    return _lat_lng_from_arrays(_text_arrays(s))


def gps_to_decimal(s: Column) -> Column:
    """One coordinate -> float32: a plain number, or three numbers and one hemisphere letter; else 0."""
    return _decimal_from_arrays(_text_arrays(s))


def _decimal_from_arrays(a: Column) -> Column:
    t, co, re_ = a["t"], a["co"], a["re"]
    plain = F.when(t.rlike(r"^[+\-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+\-]?[0-9]+)?$"), t.try_cast("double"))
    dms_ok = (F.size(co) == 3) & (F.size(re_) == 1)
    v = (F.when(t == "", F.lit(0.0)).when(plain.isNotNull(), plain)
         .when(dms_ok, _dms(co, 1, F.try_element_at(re_, F.lit(1)))).otherwise(F.lit(0.0)))
    return v.cast("float")


def has_position(lat: Column, lng: Column) -> Column:
    """Zero latitude or longitude means no position."""
    return F.coalesce((lat != 0) & (lng != 0), F.lit(False))


def has_time_and_place(taken: Column, lat: Column, lng: Column) -> Column:
    """A taken time and a position."""
    return taken.isNotNull() & has_position(lat, lng)


def _lat_lng_from_arrays(a: Column) -> Column:
    fl, co, re_, t = a["fl"], a["co"], a["re"], a["t"]
    f1 = F.try_element_at(fl, F.lit(1)).try_cast("double")
    f2 = F.try_element_at(fl, F.lit(2)).try_cast("double")
    two_ok = (F.size(fl) == 2) & f1.isNotNull() & f2.isNotNull()
    dms_ok = (F.size(co) == 6) & (F.size(re_) == 2)
    lat = (F.when(t == "", F.lit(0.0)).when(two_ok, f1)
           .when(dms_ok, _dms(co, 1, F.try_element_at(re_, F.lit(1)))).otherwise(F.lit(0.0)))
    lng = (F.when(t == "", F.lit(0.0)).when(two_ok, f2)
           .when(dms_ok, _dms(co, 4, F.try_element_at(re_, F.lit(2)))).otherwise(F.lit(0.0)))
    return F.struct(lat.cast("float").alias("lat"), lng.cast("float").alias("lng"))


def with_lat_lng(df, text_col: str, lat: str = "lat", lng: str = "lng"):
    """H9 on a DataFrame, staged: the three regex arrays are computed once per
    row in one projection, the coordinates in the next.

    The coordinates leave through ``inline(array(struct))`` (one row out per
    row in): filters on them (``lat != 0``, a join's inferred ``isnotnull``)
    cannot be pushed below a Generate that produces them, so they are not
    re-inlined into the scan as a copy of the whole parse expression.
    """
    tmp = "__gps_arrays"
    out = df.withColumn(tmp, _text_arrays(F.col(text_col)))
    ll = _lat_lng_from_arrays(F.col(tmp))
    fence = F.array(F.struct(ll["lat"].alias(lat), ll["lng"].alias(lng)))
    return out.select(*[c for c in df.columns if c not in (lat, lng)], F.inline(fence))


def with_decimal(df, text_col: str, out: str):
    """H10 on a DataFrame, staged: the two regex arrays are computed once per row, the coordinate in the next projection."""
    tmp = "__coord_arrays"
    staged = df.withColumn(tmp, _text_arrays(F.col(text_col)))
    return staged.select(*df.columns, F.inline(F.array(F.struct(_decimal_from_arrays(F.col(tmp)).alias(out)))))
