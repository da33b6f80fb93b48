"""Birth time guessed from a file path (J4: H1, H2, H3, H6, H7, C13).

All rules are native Column expressions (regex find, ``regexp_extract_all``,
date arithmetic), so they run inside whole-stage codegen.  ``now_year`` is an
argument so results are reproducible.

Regex notes: Go's ``.`` excludes only ``\\n`` while Java's also excludes
``\\r`` and a few separators, so the patterns spell ``[^\\n]``.  Java's
``find`` returns the same leftmost-first match as Go's ``Find``.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The four path patterns, tried in this order, the number
# splitter, and the year / calendar bounds.
DATE_TIME_PATTERN = r"\D\d{4}[\-_]\d{2}[\-_]\d{2}[^\n]{1,4}\d{2}\D\d{2}\D\d{2,}"
DATE_PATTERN = r"\D\d{4}[\-_]\d{2}[\-_]\d{2,}"
DATE_PATH_PATTERN = r"\D\d{4}/\d{1,2}/?\d*"
COMPACT_DATE_PATTERN = r"(202[0-9]|201[0-9]|200[0-9]|[0-1][0-9]{3})(1[0-2]|0[1-9])(3[01]|[0-2][1-9]|[12]0)"
NUMBER_PATTERN = r"\d{1,4}"
YEAR_PATTERN = r"\d{4,5}"
IS_DATE_PATTERN = r"\d{4}[\-_]?\d{2}[\-_]?\d{2}"
IS_DATE_TIME_PATTERN = r"\d{4}[\-_]?\d{2}[\-_]?\d{2}[^\n]{1,4}\d{2}\D?\d{2}\D?\d{2}"
YEAR_MIN = 1990
YEARS_AHEAD = 3
MIN_NAME_BYTES = 6


def default_now_year() -> int:
    return _dt.datetime.now(_dt.timezone.utc).year


def to_int(s: Column) -> Column:
    """H7: text -> int (32-bit, surrounding white space allowed), invalid -> 0."""
    t = F.regexp_replace(s, r"^\s+|\s+$", "")
    return F.coalesce(F.when(t.rlike(r"^[+\-]?[0-9]+$"), t.try_cast("int")), F.lit(0))


def _num(parts: Column, i: int) -> Column:
    return F.try_element_at(parts, F.lit(i)).cast("int")


def _unix(y: Column, m: Column, d: Column, h: Column | None = None,
          mi: Column | None = None, s: Column | None = None) -> Column:
    """Unix seconds of y-m-d h:mi:s with calendar overflow (31 Feb -> 2/3 Mar, hour 24 -> next day).

    Callers validate month 1..12 first; the clamp only keeps ANSI ``make_date``
    from raising in branches whose result is discarded.
    """
    year = F.least(F.greatest(y, F.lit(1)), F.lit(9999))
    month = F.least(F.greatest(m, F.lit(1)), F.lit(12))
    first = F.unix_date(F.make_date(year, month, F.lit(1))).cast("bigint")
    secs = (first + (d - 1).cast("bigint")) * 86400
    if h is not None:
        secs = secs + h.cast("bigint") * 3600 + mi.cast("bigint") * 60 + s.cast("bigint")
    return secs


def _path_matches(path: Column) -> Column:
    p = F.when(path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path))
    return F.struct(
        (F.octet_length(path) < MIN_NAME_BYTES).alias("short"),
        F.regexp_extract(p, DATE_TIME_PATTERN, 0).alias("dt"),
        F.regexp_extract(p, DATE_PATTERN, 0).alias("d"),
        F.regexp_extract(p, DATE_PATH_PATTERN, 0).alias("dp"),
        F.regexp_extract(p, COMPACT_DATE_PATTERN, 0).alias("c"),
    )


def _decided(m: Column) -> Column:
    """Which pattern decides, and the numbers of its match."""
    which = (F.when(m["short"], F.lit(None).cast("string"))
             .when(m["dt"] != "", F.lit("dt")).when(m["d"] != "", F.lit("d"))
             .when(m["dp"] != "", F.lit("dp")).when(m["c"] != "", F.lit("c")))
    text = (F.when(which == "dt", m["dt"]).when(which == "d", m["d"])
            .when(which == "dp", m["dp"]).when(which == "c", m["c"]))
    nums = F.when(which == "c", F.array(F.substring(text, 1, 4), F.substring(text, 5, 2),
                                        F.substring(text, 7, 2))
                  ).otherwise(F.regexp_extract_all(text, F.lit(NUMBER_PATTERN), 0))
    return F.struct(which.alias("which"), nums.alias("n"))


def _time_of(dec: Column, year_max: int) -> Column:
    which, n = dec["which"], dec["n"]
    cnt = F.size(n)
    y, mo, d, h, mi, s = (_num(n, i) for i in range(1, 7))
    d = F.when((which == "dp") & (cnt == 2), F.lit(1)).otherwise(d)
    count_ok = (F.when(which == "dt", cnt == 6).when(which == "d", cnt == 3)
                .when(which == "dp", cnt.between(2, 3)).otherwise(F.lit(True)))
    ymd_ok = (y >= YEAR_MIN) & (y <= year_max) & mo.between(1, 12) & d.between(1, 31)
    hms_ok = (which != "dt") | (h.between(0, 24) & mi.between(0, 59) & s.between(0, 59))
    base = _unix(y, mo, d)
    hms = F.when(which == "dt", h.cast("bigint") * 3600 + mi.cast("bigint") * 60 + s.cast("bigint")
                 ).otherwise(F.lit(0).cast("bigint"))
    return F.when(which.isNotNull() & count_ok & ymd_ok & hms_ok, base + hms)


def time_from_path(path: Column, now_year: int | None = None) -> Column:
    """H1: Unix seconds of the date/time written in a path, NULL when none.

    The first pattern that matches decides; when its numbers fail the checks
    the result is NULL (later patterns are not tried).  For wide use on a
    DataFrame prefer :func:`with_time_from_path`, which computes each regex
    once per row in staged projections.
    """
    year_max = (now_year or default_now_year()) + YEARS_AHEAD
    return _time_of(_decided(_path_matches(path)), year_max)


def with_time_from_path(df: DataFrame, path: Column, out: str,
                        now_year: int | None = None) -> DataFrame:
    """Adds ``out`` = H1 of ``path``.

    Staged: regex matches, then the decided number list, then the time.
    Catalyst keeps the stages apart because each expensive intermediate is
    referenced several times, so no regex runs twice and the generated code
    stays small.
    """
    year_max = (now_year or default_now_year()) + YEARS_AHEAD
    m, dec = f"__{out}_m", f"__{out}_dec"
    return (df.withColumn(m, _path_matches(path))
              .withColumn(dec, _decided(F.col(m)))
              .withColumn(out, _time_of(F.col(dec), year_max))
              .drop(m, dec))


def with_birth_from_name(df: DataFrame, name: str = "name", mtime: str = "timemodified",
                         now_year: int | None = None, keep_parts: bool = False) -> DataFrame:
    """H1-H3 on a DataFrame: adds ``timeborn`` and ``timebornsrc``.

    H2: the basename's time replaces the full path's if its year > 1980 and
    it is earlier; an absent full-path time stays absent (the reference
    compares with the zero time, which nothing precedes).  H3: the path time
    is used unless absent or later than the mtime; else the mtime (``stat``).
    With ``keep_parts`` the columns ``name_time``, ``base_time`` and
    ``path_time`` are kept.
    """
    df = with_time_from_path(df, F.col(name), "name_time", now_year)
    df = with_time_from_path(df, F.element_at(F.split(F.col(name), "/"), -1), "base_time", now_year)
    tb, tf = F.col("base_time"), F.col("name_time")
    base_ok = F.coalesce((F.year(F.timestamp_seconds(tb)) > 1980) & (tb < tf), F.lit(False))
    df = df.withColumn("path_time", F.when(base_ok, tb).otherwise(tf))
    t = F.col("path_time")
    use_name = t.isNotNull() & (F.col(mtime) >= t)
    df = (df.withColumn("timeborn", F.when(use_name, t).otherwise(F.col(mtime)))
            .withColumn("timebornsrc", F.when(use_name, F.lit("name")).otherwise(F.lit("stat"))))
    if not keep_parts:
        df = df.drop("name_time", "base_time", "path_time")
    return df


def year_in_text(s: Column, now_year: int | None = None) -> Column:
    """H6: first 4-5 digit run strictly between 1990 and now+3, else 0."""
    year_max = (now_year or default_now_year()) + YEARS_AHEAD
    runs = F.regexp_extract_all(F.coalesce(s, F.lit("")), F.lit(YEAR_PATTERN), 0)
    ok = F.filter(runs, lambda x: (x.cast("int") > YEAR_MIN) & (x.cast("int") < year_max))
    return F.coalesce(F.try_element_at(ok, F.lit(1)).cast("int"), F.lit(0))


def is_time(s: Column) -> Column:
    """The leftmost date (or date-time) match is the whole string."""
    return (F.coalesce(s, F.lit("")) != "") & (
        (F.regexp_extract(s, IS_DATE_PATTERN, 0) == s)
        | (F.regexp_extract(s, IS_DATE_TIME_PATTERN, 0) == s))
