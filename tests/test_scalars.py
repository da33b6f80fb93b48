"""Golden values of the reference's unit tests, re-derived on Spark expressions."""

import pytest
from pyspark.sql import functions as F

from conftest import one


def test_duration(spark):
    from mediafold.functions.numbers import duration_seconds
    cases = {"": 0, "0": 0, "2.41 s": 2, "0.41 s": 0, "41 s": 41, "0:0:1": 1, "0:04:25": 265,
             "0001:04:25": 3865, "01:04:25:67": 0, "1.2.3": 0, "0:1.5:10": 10}
    got = one(spark, duration_seconds, *cases.keys())
    assert got == list(cases.values())


def test_gps_decimal_and_pair(spark):
    from mediafold.functions.geo import gps_to_decimal, gps_to_lat_lng
    lat = one(spark, gps_to_decimal, "51 deg 15' 17.47\" N", "7 deg 23' 22.09\" E", "", "abc", "-33.5")
    assert lat[0] == pytest.approx(51.254852, abs=1e-5)
    assert lat[1] == pytest.approx(7.389469, abs=1e-5)
    assert lat[2:] == [0.0, 0.0, -33.5]
    ll = one(spark, gps_to_lat_lng, "51 deg 15' 17.47\" N, 7 deg 23' 22.09\" E", "", "abc bdf",
             "10 deg 0' 0\" S, 20 deg 30' 0\" W", "48.1, 11.5")
    assert ll[0]["lat"] == pytest.approx(51.254852, abs=1e-5) and ll[0]["lng"] == pytest.approx(7.389469, abs=1e-5)
    assert (ll[1]["lat"], ll[1]["lng"]) == (0.0, 0.0)
    assert (ll[2]["lat"], ll[2]["lng"]) == (0.0, 0.0)
    assert ll[3]["lat"] == pytest.approx(-10.0) and ll[3]["lng"] == pytest.approx(-20.5)
    assert ll[4]["lat"] == pytest.approx(48.1) and ll[4]["lng"] == pytest.approx(11.5)


def test_sanitize_title(spark):
    from mediafold.functions.text import sanitize_title
    cases = {
        "IMG_0599": "", "IMG_0599.JPG": "", "IMG_0599 ABC": "IMG_0599 ABC", "DSC10599": "",
        "titanic_cloud_computing.jpg": "Titanic Cloud Computing",
        "naomi-watts--ewan-mcgregor--the-impossible--tiff-2012_7999540939_o.jpg":
            "Naomi Watts / Ewan McGregor / The Impossible / TIFF",
        "Bei den Landungsbrücken.png": "Bei den Landungsbrücken",
        "Bei den Landungsbrücken.foo": "Bei den Landungsbrücken.foo",
        "let_it_snow": "let_it_snow", "let_it_snow.jpg": "Let It Snow",
        "Niklaus_Wirth.jpg": "Niklaus Wirth", "Niklaus_Wirth": "Niklaus_Wirth",
        "string with binary data blablabla": "",
    }
    assert one(spark, sanitize_title, *cases.keys()) == list(cases.values())


def test_sanitize_description_and_uid(spark):
    from mediafold.functions.text import sanitize_description, sanitize_uid
    d = {"IMG_0599": "IMG_0599", "OLYMPUS DIGITAL CAMERA": "", "DCIM\\108GOPRO\\GOPR2137.JPG": "",
         "hdrpl": "", "btf": "", "wtf": "wtf", '  "quoted"  ': "quoted"}
    assert one(spark, sanitize_description, *d.keys()) == list(d.values())
    u = {"77d9a719ede3f95915abd081d7b7CB2c": "77d9a719ede3f95915abd081d7b7cb2c", "77d": "",
         ":77d9a719ede3f95915abd081d7b7CB2c": "77d9a719ede3f95915abd081d7b7cb2c"}
    assert one(spark, sanitize_uid, *u.keys()) == list(u.values())


def test_sanitize_meta(spark):
    from mediafold.functions.text import sanitize_meta
    m = {'["a", "b"]': "a, b", "[not json]": "[not json]", " plain ": "plain", "": "", '["x"]': "x"}
    assert one(spark, sanitize_meta, *m.keys()) == list(m.values())


def test_keywords(spark):
    from pyspark.sql import functions as F

    from mediafold.functions.text import add_keywords, auto_keywords, keywords_string
    df = spark.createDataFrame([("FooBar", "BAZ; pro", "Fo", "Schöne Wiese")], "a string, b string, c string, d string")
    r = df.select(
        keywords_string(add_keywords(add_keywords(F.lit(None), F.col("a")), F.col("b"))).alias("ab"),
        keywords_string(add_keywords(F.lit(None), F.col("c"))).alias("c"),
        keywords_string(add_keywords(F.lit(None), F.col("d"))).alias("d")).first()
    assert (r.ab, r.c, r.d) == ("baz, foobar, pro", "fo", "schöne, wiese")
    auto = one(spark, lambda c: keywords_string(auto_keywords(c)), "FooBar burst baz flash",
               "FooBar go pro baz banana", "es", "Equirectangular HDR")
    assert auto == ["burst", "", "", "hdr, equirectangular"]


def test_dimensions(spark):
    from pyspark.sql import functions as F

    from mediafold.functions import numbers as N
    df = spark.createDataFrame([(500, 600, 1), (0, 600, 1), (800, 600, 1), (5000, 6000, 1), (800, 600, 6)],
                               "w int, h int, o int")
    w, h, o = F.col("w"), F.col("h"), F.col("o")
    aw, ah = N.actual_width(w, h, o), N.actual_height(w, h, o)
    rows = df.select(N.aspect_ratio(aw, ah).alias("a"), N.is_portrait(aw, ah).alias("p"),
                     N.megapixels(w, h).alias("m")).collect()
    assert rows[0].a == pytest.approx(0.83, abs=1e-6) and rows[0].p is True
    assert rows[1].a == 0.0
    assert rows[2].p is False
    assert rows[3].m == 30
    assert rows[4].p is True  # rotated: 600 x 800


def test_orientation(spark):
    from pyspark.sql import functions as F

    from mediafold.functions.numbers import orientation
    df = spark.createDataFrame([("6", 0), ("Rotate 90 CW", 0), ("Rotate 180", 180), ("", -90), ("Unknown (0)", 45)],
                               "t string, r int")
    assert [r[0] for r in df.select(orientation(F.col("t"), F.col("r"))).collect()] == [6, 6, 3, 8, 0]


def test_uuid_checks(spark):
    from mediafold.functions.ids import is_uuid
    assert one(spark, is_uuid, "fe2c6d4f-5b4a-4c4c-9a3e-2a1b3c4d5e6f", "not-a-uuid", "") == [True, False, False]


def test_id_hex_roundtrip(spark):
    from pyspark.sql import functions as F

    from mediafold.functions.ids import digest_id, id_hex
    r = spark.createDataFrame([("abc",)], "s string").select(
        id_hex(digest_id(F.col("s"))).alias("h"), F.substring(F.md5("s"), 1, 16).alias("m")).first()
    assert r.h == r.m


def test_xxh3_matches_library(spark):
    import numpy as np
    import xxhash

    from mediafold.functions.ids import xxh3_id
    got = one(spark, xxh3_id, "hello", "")
    want = [int(np.uint64(xxhash.xxh3_64_intdigest(b)).astype(np.int64)) for b in (b"hello", b"")]
    assert got == want


def test_tag_and_xmp_dates(spark):
    from mediafold.functions.dates import parse_tag_datetime, parse_xmp_date
    got = one(spark, parse_tag_datetime, "2020:01:30 09:57:18+01:00", "2020:01:30 09:57:18.5Z",
              "0000:00:00 00:00:00", "2020:13:01 00:00:00", "2020:01:30 09:57:18")
    base = 1580378238  # 2020-01-30 09:57:18 UTC
    assert (got[0]["local"], got[0]["offset"], got[0]["utc"]) == (base, 3600, base - 3600)
    assert (got[1]["utc"], got[1]["micros"], got[1]["offset"]) == (base, 500000, 0)
    assert got[2]["utc"] is None and got[3]["utc"] is None
    assert (got[4]["utc"], got[4]["offset"]) == (base, None)
    xmp = one(spark, parse_xmp_date, "2021-03-24T13:07:29+01:00", "2020-01-01T17:28:25.729626112",
              "2020-01-01T17:28:25 extra", "garbage")
    assert xmp == [1616587649, 1577899705, 1577899705, None]


def test_numbers_with_exponents_units_and_64_bits(spark):
    from conftest import one
    from mediafold.functions import numbers as N
    texts = ["0.00012", "12345678.5", "1e1", "1.2E-4", "5.6 mm", "3000000000", "x", "", None, "NaN", "1E400", "2E3 s"]
    assert one(spark, N.leading_number, *texts) == [0.00012, 12345678.5, 10.0, 0.00012, 5.6, 3e9, None, None, None, None,
                                                    None, 2000.0]
    assert one(spark, N.leading_int, *texts) == [0, 12345678, 10, 0, 5, 3000000000, 0, 0, 0, 0, 0, 2000]


def test_tag_fraction_of_any_length(spark):
    from conftest import one
    from mediafold.functions import dates as D
    got = one(spark, lambda c: D.parse_tag_datetime(c)["micros"], "2024:01:02 03:04:05.12345678901234", "2024:01:02 03:04:05")
    assert got == [123456, 0]


def test_flag_texts(spark):
    from conftest import one
    from mediafold.operators import tags
    assert one(spark, lambda c: tags.convert(c, "bool"), "2", "1", "0", "True", "t", "no") == [True, True, False, True, True,
                                                                                               False]


def test_long_title_words_are_whole(spark):
    from conftest import one
    from mediafold.functions import text as X
    word = "b" * 70_000
    assert one(spark, X.file_title, f"a{word}-two") == [f"A{word} Two"]


def test_signatures_beyond_the_first_bytes(spark):
    from pyspark.sql import functions as F

    from mediafold.operators import mime
    heads = {"tar": b"\0" * 257 + b"ustar", "heic": b"\0\0\0\x18ftypheic", "wav": b"RIFF\0\0\0\0WAVEfmt ",
             "m4a": b"\0\0\0\x20ftypM4A ", "avi": b"RIFF\0\0\0\0AVI LIST", "mkv": bytes.fromhex("1A45DFA3") + b"..matroska",
             "none": b"hello"}
    df = spark.createDataFrame([(k, bytearray(v)) for k, v in heads.items()], "k string, content binary")
    got = {r.k: r.mimesubtype for r in mime.detect(df, "content").collect()}
    assert got == {"tar": "x-tar", "heic": "heif", "wav": "x-wav", "m4a": "mp4", "avi": "x-msvideo", "mkv": "x-matroska",
                   "none": None}
    own = [("x", "far", [[(300, "ABCD")]])]
    far = df.where("k = 'none'").select("k", F.concat(F.lit(b"\0" * 300), F.unhex(F.lit("ABCD"))).alias("content"))
    assert mime.header_bytes(own) == 302 and mime.detect(far, "content", own).first().mimesubtype == "far"
    said = mime.classify(df.withColumn("m", F.lit("audio/odd; x")), "content", "m")
    assert said.where("k = 'none'").first().mimetype == "audio"


def test_zone_lookup_and_detection_do_not_shuffle(spark):
    import __spark_entry__ as E
    from test_jobs import _plan

    from conftest import SF_SMALL
    for name, scans in (("zone_join", 1), ("mime_signatures", 1), ("media_flags", 1), ("gps_parse", 1)):
        plan = _plan(E.queries()[name](spark, SF_SMALL))
        lines = plan.split("\n\n")[0].splitlines()
        facts = [x for x in lines if "Scan parquet" in x]
        # The broadcast side (regions by cell) may group; the rows themselves must not be exchanged.
        assert "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan, name
        assert len(facts) - 2 * (name == "zone_join") == scans, name
        if name != "zone_join":
            assert "Exchange" not in plan, name


def test_documents_are_parsed_once(spark):
    import __spark_entry__ as E
    from test_jobs import _plan

    from conftest import SF_SMALL
    photo_reads = _plan(E.queries()["sidecar_kinds"](spark, SF_SMALL)).count("photoTakenTime,StructType")
    assert photo_reads <= 1


def test_number_texts_that_only_a_cast_would_take(spark):
    from conftest import one
    from mediafold.functions import numbers as N
    texts = [" 5", "5 ", "+5", "-7", "5.0", "0x1", "1d", "", "99999999999", "\t5"]
    assert one(spark, N.atoi, *texts) == [None, None, 5, -7, None, None, None, None, None, None]
    texts = ["1d", "1f", "0x1p3", "NaN", "Infinity", "1e5", " 1", "1 ", "5.", ".5", ".", "+.5", "-2E-1", "1e", None]
    assert one(spark, N.parse_float, *texts) == [0, 0, 0, 0, 0, 1e5, 0, 0, 5, 0.5, 0, 0.5, -0.2, 0, 0]
    assert one(spark, N.subsec_ns, "25", "+25", "025", "0", "1234567890", "1 ", "x") == [250000000, 0, 25000000, 0, 0, 0, 0]


def test_tag_datetimes_of_every_shape(spark):
    from conftest import one
    from mediafold.functions import dates as D
    texts = ["2024:01:02 03:04:05", " 2024:01:02 03:04:05 ", "2024-01-02T03:04:05Z", "2024:01:02 03:04:05.5+01:00",
             "2024:01-02 03:04:05-0130", "2024:01:02 03:04", "2024:01:02 03:04:05x", "2024:13:02 03:04:05", "", None]
    got = one(spark, lambda c: D.parse_tag_datetime(c)["utc"], *texts)
    t = 1704164645
    assert got == [t, t, t, t - 3600, t + 5400, None, None, None, None, None]


def test_matroska_type_behind_other_elements(spark):
    from mediafold.operators import mime
    head = bytes.fromhex("1A45DFA301000000000001FFEC40F0")
    files = {"webm": head + bytes(240) + bytes.fromhex("428284") + b"webm", "mkv": head + bytes(3000) + bytes.fromhex("428288") + b"matroska",
             "both": head + b"matroska" + bytes.fromhex("428284") + b"webm", "none": head + bytes(300), "far": head + bytes(5000) + b"matroska"}
    df = spark.createDataFrame([(n, bytearray(b)) for n, b in files.items()], "n string, b binary")
    got = {r.n: r.mimesubtype for r in mime.detect(df, "b").collect()}
    assert got == {"webm": "webm", "mkv": "x-matroska", "both": "webm", "none": "webm", "far": "webm"}
    assert mime.header_bytes() >= 4096


def bitwise_cell(lat, lng, level):
    """The curve walked one bit at a time in Python integers."""
    import math

    from mediafold.functions import cells
    a, o = math.radians(lat), math.radians(lng)
    x, y, z = math.cos(a) * math.cos(o), math.cos(a) * math.sin(o), math.sin(a)
    axis = max(range(3), key=lambda k: (abs((x, y, z)[k]), -k))
    face = axis + 3 * ((x, y, z)[axis] < 0)
    u, v = [(y / x, z / x) if axis == 0 and face == 0 else None, (-x / y, z / y) if face == 1 else None,
            (-x / z, -y / z) if face == 2 else None, (z / x, y / x) if face == 3 else None,
            (z / y, -x / y) if face == 4 else None, (-y / z, -x / z) if face == 5 else None][face]

    def number(w):
        s = 0.5 * math.sqrt(1 + 3 * w) if w >= 0 else 1 - 0.5 * math.sqrt(1 - 3 * w)
        return min(max(math.floor(s * 2**30), 0), 2**30 - 1)
    i, j, o, pos = number(u), number(v), face & 1, 0
    for bit in range(29, 29 - level, -1):
        q = cells.IJ_TO_POS[o][(i >> bit & 1) * 2 + (j >> bit & 1)]
        pos, o = pos * 4 + q, o ^ cells.POS_TO_ORIENTATION[q]
    return (((face << 2 * level | pos) << 1 | 1) << 2 * (30 - level))


def test_cells_match_a_walk_bit_by_bit(spark):
    import random

    from mediafold.functions import cells
    rng = random.Random(6)
    points = [(rng.uniform(-90, 90), rng.uniform(-180, 180)) for _ in range(400)]
    points += [(45.0, 45.0), (-90.0, 1.0), (90.0, 1.0), (1e-9, 180.0), (5.0, -180.0), (35.264389682754654, 45.0)]
    none = [(0.0, 5.0), (5.0, 0.0), (None, 1.0), (float("nan"), 1.0), (1.0, float("inf"))]
    df = spark.createDataFrame([(n, a, b) for n, (a, b) in enumerate(points + none)], "n int, lat double, lng double")
    levels = (0, 8, 21, 22)
    rows = cells.with_cell_ids(df, "lat", "lng", "id", levels).orderBy("n").collect()
    for level in levels:
        got = [r[f"id_{level}"] for r in rows]
        assert [g % 2**64 for g in got[:len(points)]] == [bitwise_cell(a, b, level) for a, b in points]
        assert got[len(points):] == [None] * len(none)
    up = cells.with_cell_ids(df, "lat", "lng", "id", (8, 21)).where(cells.parent(F.col("id_21"), 8) != F.col("id_8"))
    assert up.count() == 0
    one = spark.createDataFrame([(1.334, 4.567)], "lat float, lng float")
    token = cells.with_cell_ids(one, "lat", "lng", "id").select(cells.cell_token(F.col("id"))).first()[0]
    assert token == "s2:100c9acde614"
    plan = cells.with_cell_ids(df, "lat", "lng", "id")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
