"""Property checks of the jobs (SURVEY 5 (c)) on authored and driver inputs."""

from pyspark.sql import functions as F

from conftest import SF_SMALL

FILE_COLS = "name string, hostname string, id long, size long, timemodified long, timeborn long, " \
            "timebornsrc string, mimetype string, mimesubtype string"


def _files(spark, rows):
    return spark.createDataFrame(rows, FILE_COLS)


def test_duplicate_groups_rules(spark):
    from mediafold.operators import dedupe
    rows = [
        ("/a/long_name.jpg", "h1", 1, 10, 100, 50, "stat", "image", "jpeg"),
        ("/b/ab.jpg", "h1", 1, 10, 90, 40, "stat", "image", "jpeg"),
        ("/c/xy.jpg", "h2", 1, 10, 95, 45, "stat", "image", "jpeg"),
        ("/d/solo.mp4", "h1", 2, 5, 10, 10, "meta", "video", "mp4"),
        ("/e/m1.mp4", "h1", 3, 7, 10, 10, "meta", "video", "mp4"),
        ("/f/m2.mp4", "h1", 3, 7, 10, 11, "meta", "video", "mp4"),
        ("/g/s1.mp3", "h1", 4, 7, 10, 10, "stat", "audio", "mpeg"),
        ("/h/s2.mp3", "h1", 4, 8, 10, 10, "stat", "audio", "mpeg"),
    ]
    g = {r.id: r for r in dedupe.duplicate_groups(_files(spark, rows)).collect()}
    assert g[1].n_members == 3 and g[1].name == "ab.jpg"  # shortest basename, earlier by name on ties
    assert g[1].timemodified == 90 and g[1].timeborn == 40 and g[1].base_name == "/a/long_name.jpg"
    assert g[1].saved_bytes == 20 and not g[1].conflict
    assert not g[2].conflict and g[2].n_members == 1
    assert g[3].conflict       # metadata birth differs
    assert g[4].conflict       # size differs
    assert sorted(g) == [1, 2, 3, 4]


def test_backup_plan_properties(spark):
    from mediafold.operators import backup
    rows = [
        ("/s/a.jpg", "h", 1, 10, 100, 1_600_000_000, "stat", "image", "jpeg"),
        ("/t/a.jpg", "h", 2, 11, 100, 1_600_000_000, "stat", "image", "jpeg"),   # same dest as id 1
        ("/u/a.jpg", "h", 3, 12, 100, 1_600_000_000, "stat", "image", "jpeg"),   # same dest again
        ("/v/doc.txt", "h", 4, 5, 100, 1_600_000_000, "stat", "text", "plain"),
        ("/w/kept.mp4", "h", 5, 9, 100, 1_600_000_000, "stat", "video", "mp4"),
    ]
    files = _files(spark, rows)
    kept = "/bk/video/2020/09/13/kept.mp4"
    filez = _files(spark, [(kept, "h", 5, 9, 100, 1_600_000_000, "stat", "video", "mp4")])
    taken = "/bk/image/2020/09/13/a.jpg"
    disk = spark.createDataFrame([(kept, 5), (taken, 99)], "path string, disk_id long")
    plan = {r.id: r for r in backup.backup_plan(files, filez, disk, "/bk", "Asia/Shanghai").collect()}
    assert plan[4].action == "ignored" and plan[4].dest is None
    assert plan[5].action == "keep" and plan[5].dest == kept
    dests = [plan[i].dest for i in (1, 2, 3)]
    assert len(set(dests)) == 3 and all(d.startswith(taken + "-") for d in dests)  # plain path held by id 99
    assert all(plan[i].action == "copy" for i in (1, 2, 3))


def test_catalog_rerun_is_noop(spark):
    from mediafold.operators import catalog
    from mediafold.plans import derive
    cat = derive.orders_catalog(spark, SF_SMALL)
    listing = derive.orders_listing(spark, SF_SMALL)
    new = derive.index_rows(catalog.work_list(listing, cat), 2026)
    after = catalog.upsert(cat, new)
    assert catalog.work_list(listing, after).count() == 0
    # key uniqueness after the upsert
    assert after.groupBy("name", "hostname").count().where("count > 1").count() == 0


def test_upsert_scope(spark):
    from mediafold.operators import catalog
    base = _files(spark, [("/x", "h1", 1, 1, 1, 1, "stat", "a", "b"), ("/x", "h2", 2, 1, 1, 1, "stat", "a", "b")])
    new = _files(spark, [("/x", "h1", 3, 2, 2, 2, "stat", "a", "b")])
    assert catalog.upsert(base, new, "host").count() == 2
    assert catalog.upsert(base, new, "name").count() == 1   # the reference's delete by name


def test_tag_document_parsing(spark):
    from mediafold.operators import tags
    docs = ['[{"Make": "A", "ISO": 100}, {"Make": "B", "Model": "M"}]', '{"Title": "x", "Headline": ""}',
            '[{"k": 1', '[{"Grouped": {"Make": "inner"}}]']
    df = spark.createDataFrame([(d,) for d in docs], "doc string").select(
        tags.parse_tag_document(F.col("doc")).alias("tags"))
    out = tags.assign_fields(df).select("camera_make", "camera_model", "iso", "title", "tags").collect()
    assert (out[0].camera_make, out[0].camera_model, out[0].iso) == ("B", "M", 100)
    assert out[1].title == "x"                 # empty Headline skipped
    assert out[2].tags is None                 # malformed document
    assert out[3].camera_make is None          # nested groups are not top-level tags


def test_typed_parse_agrees_with_the_map(spark):
    from mediafold.operators import tags
    docs = ['[{"Make": "A", "ISO": 200, "X": {"y": [1, 2]}, "FNumber": 11.80}]', '{"Make": "B", "Keywords": ["a", "b"]}',
            '[{"Make": "A", "Model": "m", "ISO": 1}, {"Make": "B", "ISO": null}]', "[]", "{}", "", None, "no json", "[1]", "[null]",
            '{"Make": "A", "Make": "B"}', '{"Make": "a\\"b", "By-line": "  me\\u00a0"}', '  {"Model": null}', '{"ISO": 01}',
            '{"SubSecTime": "25", "DateTimeOriginal": "2020:01:02 03:04:05+02:00", "Flash": true}', '"text"', "[[1]]"]
    df = spark.createDataFrame([(i, d) for i, d in enumerate(docs)], "i int, doc string")
    names = tags.tag_names()
    both = df.select("i", tags.parse_tag_document(F.col("doc")).alias("m"), tags.parse_typed_tags(F.col("doc")).alias("t"))
    for r in both.collect():
        assert (r.m is None) == (r.t is None), docs[r.i]
        if r.m is not None:
            assert {k: v for k, v in r.t.asDict().items() if v is not None} == {
                k: v for k, v in r.m.items() if k in names and v is not None}, docs[r.i]
    fields = [c for c in tags.TAG_FIELDS if c != "keywords"]
    a, b = (tags.assign_fields(both.select("i", F.col(c).alias("tags"))).select("i", "taken_ns", *fields) for c in ("m", "t"))
    assert a.exceptAll(b).count() == b.exceptAll(a).count() == 0
    empty = ["", "0", " 0 ", "-1", "NIL", "%nan*", "\u30000\u3000", "0000:00:00", " null", "**", "N/A", "0.0", "-1.0", "x0"]
    df = spark.createDataFrame([(i, {"Make": v, "CameraMake": None}) for i, v in enumerate(empty)], "i int, tags map<string,string>")
    got = {r.i: r.camera_make for r in tags.assign_fields(df).collect()}
    assert [v for i, v in enumerate(empty) if got[i] is not None] == ["N/A", "0.0", "-1.0", "x0"]


def test_exif_pick_thumbnail_rule(spark):
    from mediafold.operators import exif
    rows = [("p", "IFD1", "Model", "thumb1", 1), ("p", "IFD1", "Model", "thumb2", 2),
            ("q", "IFD1", "Model", "thumb", 1), ("q", "IFD0", "Model", "main1", 2), ("q", "IFD0", "Model", "main2", 3),
            ("r", "IFD0", "Model", "cut\x00junk", 1), ("s", "IFD0", "Model", "", 1)]
    df = spark.createDataFrame(rows, "path string, ifd string, tag string, value string, ord int")
    got = {r.path: r.value for r in exif.pick_values(df).collect()}
    assert got == {"p": "thumb1", "q": "main2", "r": "cut"}


def test_zone_lookup_priority(spark):
    from mediafold.operators.timezones import box_polygon, zone_lookup
    regions = spark.createDataFrame([("Z1", 1, 0.0, 10.0, 0.0, 10.0), ("Z2", 0, 5.0, 20.0, 5.0, 20.0)],
                                    "zone string, priority int, a double, b double, c double, d double").select(
        "zone", "priority", box_polygon(F.col("a"), F.col("b"), F.col("c"), F.col("d")).alias("polygon"))
    pts = spark.createDataFrame([(1, 1.0, 1.0), (2, 6.0, 6.0), (3, 0.0, 5.0), (4, 30.0, 30.0), (5, 10.0, 1.0)],
                                "k int, lat double, lng double")
    got = {r.k: r.zone for r in zone_lookup(pts, regions).collect()}
    assert got == {1: "Z1", 2: "Z2", 3: None, 4: None, 5: None}   # zero = no position; boxes half-open


def test_default_zone_fix(spark):
    from mediafold.functions.dates import default_zone_fix
    df = spark.createDataFrame([(1_704_067_200, "", ""), (1_704_067_200, "", "+08:00"), (1_704_067_200, "UTC", "")],
                               "t long, z string, o string")
    got = [r[0] for r in df.select(default_zone_fix(F.col("t"), F.col("z"), F.col("o"),
                                                     offset_policy="reference")).collect()]
    assert got == [1_704_067_200 - 8 * 3600, 1_704_067_200, 1_704_067_200]


def test_image_size_override(spark):
    from mediafold.operators import tags
    docs = ['{"ImageWidth": 640, "ImageHeight": 480, "PixelXDimension": 10}', '{"ImageWidth": 640, "ExifImageWidth": 5}',
            '{"ImageWidth": "0", "ImageHeight": "0", "ExifImageWidth": 7, "ExifImageHeight": 9}']
    df = spark.createDataFrame([(d,) for d in docs], "doc string").select(
        tags.parse_tag_document(F.col("doc")).alias("tags"))
    out = tags.image_size_override(tags.assign_fields(df)).select("width", "height").collect()
    assert [(r.width, r.height) for r in out] == [(640, 480), (640, None), (7, 9)]


def test_exif_gps_rows(spark):
    from mediafold.operators import exif
    rows = [("p", "GPS", "GPSLatitude", "51/1, 15/1, 1747/100", 1), ("p", "GPS", "GPSLatitudeRef", "N", 2),
            ("p", "GPS", "GPSLongitude", "7/1, 23/1, 2209/100", 3), ("p", "GPS", "GPSLongitudeRef", "W", 4),
            ("p", "GPS", "GPSAltitude", "844/10", 5), ("q", "GPS", "GPSLatitude", "1/0, 2/1, 3/1", 1),
            ("q", "GPS", "GPSLongitude", "1/1, 2/1, 3/1", 2)]
    df = spark.createDataFrame(rows, "path string, ifd string, tag string, value string, ord int")
    wide = exif.pivot_tags(exif.pick_values(df), exif.GPS_TAGS)
    got = {r.path: r for r in exif.gps_position(wide).collect()}
    assert abs(got["p"].lat - 51.254852) < 1e-5 and abs(got["p"].lng + 7.389469) < 1e-5 and got["p"].altitude == 84
    assert got["q"].lat is None and got["q"].lng is None


def test_filez_rows(spark):
    from mediafold.operators import backup
    done = spark.createDataFrame(
        [(1, "copy", "/b/x.jpg", "copied", 10, 1, 1, "stat", "image", "jpeg"),
         (2, "ignored", None, "ignored", 5, 1, 1, "stat", "text", "plain"),
         (3, "copy", None, "verify_failed", 7, 1, 1, "stat", "image", "png")],
        "id long, action string, path_final string, status string, size long, timemodified long, timeborn long, "
        "timebornsrc string, mimetype string, mimesubtype string")
    old = spark.createDataFrame([("/old/x.jpg", None, 1, 10, 1, 1, "stat", "image", "jpeg"),
                                 ("/old/z.jpg", None, 9, 3, 1, 1, "stat", "image", "jpeg")], FILE_COLS)
    rows = {r.id: r for r in backup.filez_rows(done, old).collect()}
    # ignored and failed ids get no row, the old row of id 1 is replaced, a failed id keeps the row it had
    assert sorted(rows) == [1, 9]
    assert rows[1].name == "/b/x.jpg" and rows[9].status == "ok"
    failed = done.withColumn("path_final", F.lit(None).cast("string"))
    kept = {r.id: r.name for r in backup.filez_rows(failed, old).collect()}
    assert kept == {1: "/old/x.jpg", 9: "/old/z.jpg"}


def _plan(df):
    import contextlib
    import io
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


def test_hot_id_is_combined_before_the_shuffle(spark):
    """A content id holding a third of all rows: every per-id aggregate is partial before the exchange."""
    from mediafold.operators import dedupe
    n = 3000
    rows = [(f"/p/{i}.jpg", "h", -7 if i % 3 == 0 else i, 10, i, i, "stat", "image", "jpeg") for i in range(n)]
    files = _files(spark, rows).repartition(8)
    groups = dedupe.duplicate_groups(files)
    plan = _plan(groups)
    assert "partial_min" in plan and "partial_count" in plan and "partial_min_by" in plan
    assert "collect_list" not in plan and "collect_set" not in plan
    hot = groups.where("id = -7").first()
    assert hot.n_members == n // 3


def test_no_cross_or_nested_loop_joins(spark):
    import __spark_entry__ as E
    from conftest import SF_SMALL
    for name in ("ignore_paths", "mime_signatures", "zone_join", "backup_plan"):
        plan = _plan(E.queries()[name](spark, SF_SMALL))
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name


def test_host_scan_is_partition_pruned(spark):
    import tempfile

    from mediafold.operators import catalog
    from mediafold.sources import catalog as store
    root = tempfile.mkdtemp(prefix="mediafold-cat-", dir="/tmp") + "/files"
    rows = _files(spark, [(f"/f{i}", f"h{i % 3}", i, 10, 1, 1, "stat", "image", "jpeg") for i in range(30)])
    store.write_hosts(rows, root)
    snap = catalog.host_snapshot(store.read_table(spark, root), host="h1")
    plan = _plan(snap)
    assert "PartitionFilters: [isnotnull(hostname" in plan and "(hostname#" in plan and "= h1)" in plan
    assert snap.count() == 10


def test_scans_are_pruned_and_filtered(spark):
    import __spark_entry__ as E
    from conftest import SF_SMALL
    plan = _plan(E.queries()["catalog_diff"](spark, SF_SMALL))
    orders_scans = [ln for ln in plan.splitlines() if ln.startswith("ReadSchema: struct<o_orderkey")]
    assert orders_scans and all("o_custkey" not in s for s in orders_scans)      # column pruning
    assert "PushedFilters: [IsNotNull(o_orderstatus), Not(EqualTo(o_orderstatus,O))" in plan  # pushdown


def test_plan_destinations_unique_on_driver_data(spark):
    import __spark_entry__ as E
    from conftest import SF_SMALL
    plan = E.queries()["backup_plan"](spark, SF_SMALL)
    assert plan.count() == plan.select("id").distinct().count()                      # one row per content id
    dests = plan.where(F.col("dest").isNotNull())
    assert dests.count() == dests.select("dest").distinct().count()                  # no two ids share a path
    assert dests.where(F.octet_length("dest") > 256).count() == 0


def test_presentation_order(spark):
    from mediafold.operators import catalog
    rows = _files(spark, [(n, "h", 1, 1, 1, 1, "stat", "image", "jpeg") for n in ("/b", "/a/z", "/a", "/C")])
    assert [r.name for r in catalog.presentation_order(rows).collect()] == ["/C", "/a", "/a/z", "/b"]


def test_typed_merge_of_sources(spark):
    import pytest

    from mediafold.operators.merge import merge_sources
    a = spark.createDataFrame([("x", 0, 1.5, False, ["b", "a"], " "), ("y", 7, 0.0, True, None, "t")],
                              "k string, iso int, fps double, flash boolean, words array<string>, title string")
    b = spark.createDataFrame([("x", 9, ["c", "a", None], "j"), ("z", 3, [], "")], "k string, iso long, words array<string>, title string")
    c = spark.createDataFrame([("y", 5, ["d"], "over")], "k string, iso int, words array<string>, title string")
    m = merge_sources([("a", a, "fill"), ("b", b, "fill"), ("c", c, "overwrite")], "k", ["iso", "fps", "flash", "words", "title", "none"])
    rows = {r.k: tuple(r)[1:] for r in m.collect()}
    assert rows == {"x": (9, 1.5, None, ["a", "b", "c"], "j", None, "a,b"), "y": (5, None, True, ["d"], "over", None, "a,c"),
                    "z": (3, None, None, None, None, None, "b")}
    assert dict(m.dtypes)["iso"] == "bigint" and dict(m.dtypes)["words"] == "array<string>"
    with pytest.raises(ValueError):
        merge_sources([("a", a, "fill"), ("b", b.withColumn("title", F.lit(1)), "fill")], "k", ["title"])


def test_exif_rows_are_sorted_only_after_they_are_spread_by_path(spark, capsys):
    """A sort before the shuffle would hold all rows of an input file in one task."""
    from mediafold.operators import exif
    from mediafold.plans.queries import customer_tag_rows
    rows = customer_tag_rows(spark, "/root/testdata/sf0.001")
    for made in (exif.pick_and_pivot(rows), exif.pivot_tags(exif.pick_values(rows))):
        capsys.readouterr()
        made.explain()
        plan = capsys.readouterr().out.splitlines()
        spread = [i for i, line in enumerate(plan) if "Exchange hashpartitioning(path" in line]
        held = [i for i, line in enumerate(plan) if "Sort" in line or "HashAggregate" in line]
        assert len(spread) == 1 and held and max(held) < spread[0]
        # The file's rows are dealt out before each becomes 15.
        dealt = [i for i, line in enumerate(plan) if "Exchange hashpartitioning(c_custkey" in line]
        assert dealt and dealt[0] > next(i for i, line in enumerate(plan) if "Generate" in line)
