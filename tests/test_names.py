"""Time from a path (H1-H3, H6, C13): rules of SURVEY 2.H.1 as cases."""

import datetime as dt

from conftest import one


def _unix(*a):
    return int(dt.datetime(*a, tzinfo=dt.timezone.utc).timestamp())


def test_time_from_path(spark):
    from mediafold.functions.names import time_from_path
    cases = {
        "/photos/2020-01-30_09-57-18.jpg": _unix(2020, 1, 30, 9, 57, 18),
        "2020-01-30": _unix(2020, 1, 30),
        "/a/2020/01/03/x.jpg": _unix(2020, 1, 3),
        "/a/2019/7/x.jpg": _unix(2019, 7, 1),
        "/dcim/VID20200103.mov": _unix(2020, 1, 3),
        "/x/2020-02-31_10-00-00.jpg": _unix(2020, 3, 2, 10, 0, 0),   # day overflow
        "/x/2020-02-01_24-00-00.jpg": _unix(2020, 2, 2),             # hour 24
        "/x/2020-02-01_10-00-60.jpg": None,                           # second 60: decided, then rejected
        "/x/1985-02-01.jpg": None,                                    # before 1990
        "/x/2018-12-18123": None,                                     # trailing digits: 4 numbers
        "abc": None,                                                  # shorter than 6 bytes
        "/nothing/here.jpg": None,
    }
    got = one(spark, lambda c: time_from_path(c, 2026), *cases.keys())
    assert got == list(cases.values())


def test_birth_from_name(spark):
    from mediafold.functions.names import with_birth_from_name
    rows = [("/inbox/1996-05-17/IMG-19950203.jpg", _unix(2000, 1, 1)),   # basename earlier -> wins
            ("/a/2020/01/03/x.jpg", _unix(2019, 1, 1)),                  # later than mtime -> stat
            ("/plain/file.bin", 1234)]
    df = spark.createDataFrame(rows, "name string, timemodified long")
    out = with_birth_from_name(df, now_year=2026).collect()
    assert (out[0].timeborn, out[0].timebornsrc) == (_unix(1995, 2, 3), "name")
    assert (out[1].timeborn, out[1].timebornsrc) == (_unix(2019, 1, 1), "stat")
    assert (out[2].timeborn, out[2].timebornsrc) == (1234, "stat")


def test_year_and_is_time(spark):
    from mediafold.functions.names import is_time, to_int, year_in_text
    assert one(spark, lambda c: year_in_text(c, 2026), "trip 1989 then 2015", "none", "123456 2001") == [2015, 0, 2001]
    assert one(spark, is_time, "2020-01-30", "20200130", "2020-01-30 10:11:12", "x2020-01-30", "") == \
        [True, True, True, False, False]
    assert one(spark, to_int, " 17 ", "17x", "+5", "99999999999") == [17, 0, 5, 0]
