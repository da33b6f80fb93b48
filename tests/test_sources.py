"""File-based sources, catalog storage and the streaming variant."""

import os
import tempfile

from pyspark.sql import functions as F

from conftest import SF_SMALL

XMP = """<?xml version="1.0" encoding="UTF-8"?>
<x:xmpmeta xmlns:x="adobe:ns:meta/">
 <rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#">
  <rdf:Description rdf:about="" xmlns:dc="http://purl.org/dc/elements/1.1/"
      xmlns:photoshop="http://ns.adobe.com/photoshop/1.0/">
   <dc:description><rdf:Alt><rdf:li xml:lang="de">OLYMPUS DIGITAL CAMERA</rdf:li></rdf:Alt></dc:description>
   <dc:title>Salt &amp; Pepper Mill</dc:title>
   <photoshop:DateCreated>2017-08-05T21:40:03-03:30</photoshop:DateCreated>
   <dc:creator><rdf:Seq><rdf:li>"Jo" Doe</rdf:li></rdf:Seq></dc:creator>
   <dc:subject><rdf:Seq><rdf:li>Winter &lt;Sea&gt;</rdf:li><rdf:li>beach</rdf:li></rdf:Seq></dc:subject>
  </rdf:Description>
  <rdf:Description rdf:about="" xmlns:tiff="http://ns.adobe.com/tiff/1.0/"
      xmlns:dc="http://purl.org/dc/elements/1.1/">
   <tiff:Model>"Box 7"</tiff:Model>
   <tiff:Make>Kodak</tiff:Make>
   <dc:title><rdf:Alt><rdf:li>IMG_20170805.jpg</rdf:li></rdf:Alt></dc:title>
  </rdf:Description>
  <rdf:Description rdf:about="" xmlns:dc="http://purl.org/dc/elements/1.1/">
   <dc:title><rdf:Alt><rdf:li>Salt &amp; Pepper Mill, second</rdf:li></rdf:Alt></dc:title>
  </rdf:Description>
 </rdf:RDF>
</x:xmpmeta>
"""


def _tmp():
    return tempfile.mkdtemp(prefix="mediafold-test-", dir="/tmp")


def test_xmp_blocks_merge(spark):
    from mediafold.sources.sidecars import read_xmp
    d = _tmp()
    with open(f"{d}/a.xmp", "w") as fh:
        fh.write(XMP)
    r = read_xmp(spark, d).first()
    assert (r.title, r.description) == ("Salt & Pepper Mill, second", "")     # the last block with a title; camera noise
    assert (r.subject, r.keywords) == ("Winter <Sea>, beach", ["beach", "sea", "winter"])
    assert (r.camera_make, r.camera_model, r.artist) == ("Kodak", "Box 7", "Jo Doe")
    assert r.taken_utc == 1501981803          # 21:40:03-03:30


def test_xmp_documents_in_a_column(spark, tmp_path):
    from mediafold.sources.sidecars import read_xmp, xmp_records
    (tmp_path / "a.xmp").write_text(XMP)
    one_block = XMP.split("<rdf:Description")[0] + '<rdf:Description><dc:title>Only</dc:title></rdf:Description></rdf:RDF></x:xmpmeta>'
    docs = [("a", XMP, 1), ("b", None, 2), ("c", "no xml <", 3), ("d", "", 4), ("e", one_block.replace("<dc:", "<dc:"), 5)]
    df = spark.createDataFrame(docs, "path string, doc string, title int").withColumn("_blocks", F.lit("x"))
    rows = {r[0]: r for r in xmp_records(df, "doc").collect()}
    want = read_xmp(spark, str(tmp_path)).first()
    assert tuple(rows["a"])[:3] == ("a", 1, "x") and tuple(rows["a"])[3:] == tuple(want)[1:]
    assert all(rows[k][3] == "" and rows[k][-1] is None for k in "bcd") and rows["e"][3] == "Only"


def test_json_sidecar_files(spark):
    from mediafold.sources import sidecars
    d = _tmp()
    docs = {
        "photo.json": '{"title": "winter_walk.jpg", "description": "OLYMPUS DIGITAL CAMERA", "imageViews": "12",'
                      ' "photoTakenTime": {"timestamp": "1546300800", "formatted": ""},'
                      ' "geoData": {"latitude": 48.5, "longitude": 11.25, "altitude": 520.9}}',
        "nogeo.json": '{"title": "", "imageViews": "0", "photoTakenTime": {"timestamp": "0"},'
                      ' "geoData": {"latitude": 0.0, "longitude": 11.25, "altitude": 3.0}}',
        "album.json": '{"albumData": {"title": "Holidays", "description": ""}}',
        "tags.json": '[{"ExifToolVersion": 12.4, "Make": "Canon"}]',
        "other.json": '{"x": 1}',
    }
    for n, t in docs.items():
        with open(f"{d}/{n}", "w") as fh:
            fh.write(t)
    s = sidecars.read_json_sidecars(spark, d)
    s = s.withColumn("p", sidecars.photo_fields(F.col("doc"))).withColumn("album", sidecars.album_title(F.col("doc")))
    got = {os.path.basename(r.path): r for r in s.collect()}
    assert {k: v.kind for k, v in got.items()} == {"photo.json": "photo", "nogeo.json": "photo", "album.json": "album",
                                                   "tags.json": "exiftool", "other.json": "unknown"}
    p = got["photo.json"].p
    assert (p.title, p.description, p.views, p.taken_utc, p.altitude) == ("Winter Walk", None, 12, 1546300800, 520)
    q = got["nogeo.json"].p
    assert (q.title, q.views, q.taken_utc, q.lat, q.altitude) == (None, None, None, None, None)
    assert got["album.json"].album == "Holidays"


def test_catalog_is_created_once(spark):
    from mediafold.sources import catalog as S
    base = _tmp()
    path = S.create_catalog(spark, base)
    assert S.read_table(spark, path).count() == 0
    rows = spark.createDataFrame([("/a", "h1", 1, 10, 5, 5, "stat", "image", "jpeg", None)], S.schemas.FILES)
    S.upsert_table(rows, path)
    assert S.create_catalog(spark, base) == path and S.read_table(spark, path).count() == 1


def test_catalog_upsert_rewrites_touched_hosts_only(spark):
    import glob

    from mediafold.sources import catalog as S
    path = S.create_catalog(spark, _tmp())

    def rows(*r):
        return spark.createDataFrame([(n, h, i, 10, 5, 5, "stat", "image", "jpeg", None) for n, h, i in r], S.schemas.FILES)

    def files():
        return {h: set(glob.glob(f"{h}/*.parquet")) for h in glob.glob(f"{path}/hostname=*")}
    S.upsert_table(rows(("/a", "h1", 1), ("/b", "h1", 2), ("/a", "h 2/x", 3), ("/n", None, 4)), path)
    before = files()
    S.upsert_table(rows(("/a", "h1", 9), ("/c", "h1", 8)), path)
    after = files()
    assert [h.split("=")[1] for h in after if after[h] != before.get(h)] == ["h1"] and len(after) == 3
    got = sorted((r["name"], r["hostname"] or "", r["id"]) for r in S.read_table(spark, path).collect())
    assert got == [("/a", "h 2/x", 3), ("/a", "h1", 9), ("/b", "h1", 2), ("/c", "h1", 8), ("/n", "", 4)]
    assert S.read_table(spark, path, hosts=["h 2/x"]).count() == 1
    assert S.read_table(spark, path, hosts=["h 2/x", None]).count() == 2
    S.upsert_table(rows(("/n", None, 5)), path)
    S.upsert_table(rows(), path)
    assert sorted(r["id"] for r in S.read_table(spark, path).collect()) == [2, 3, 5, 8, 9]


def test_name_check_and_field_report(spark):
    from mediafold.operators import facts, tags
    df = spark.createDataFrame([('{"FileName": "a.jpg"}', "a.jpg"), ('{"FileName": "b.jpg"}', "a.jpg"),
                                ('{"Make": "x"}', "a.jpg")], "doc string, expected string")
    df = df.withColumn("tags", tags.parse_tag_document(F.col("doc")))
    errs = [r.error for r in tags.check_file_name(df, "expected").collect()]
    assert errs[0] is None and errs[2] is None and "does not match" in errs[1]
    rep = {r[0]: r for r in facts.field_report(spark, tags.TAG_FIELDS, df.schema).collect()}
    assert rep["doc"][1:] == ("text", "")
    assert rep["taken_at"][1] == "timestamp" and rep["keywords"][1] == "list"
    assert rep["camera_make"][2] == "CameraMake, Make"


def test_alternate_names(spark):
    from mediafold.operators import dedupe
    f = spark.createDataFrame([("/a/x.jpg", 1), ("/b/x.jpg", 1), ("/c/y.jpg", 1), ("/d/z.jpg", 2)],
                              "name string, id long").withColumn("hostname", F.lit("h"))
    got = sorted((r.id, r.basename, r.n_files) for r in dedupe.alternate_names(f).collect())
    assert got == [(1, "x.jpg", 2), (1, "y.jpg", 1)]


def test_stream_equals_batch(spark):
    from mediafold.plans import queries as Q
    from mediafold.sources.tables import load
    streamed = Q.q_stream_index(spark, SF_SMALL)
    batch = Q.events_as_catalog_rows(load(spark, SF_SMALL, "events")).drop("ts")
    from mediafold.streaming.stream_index import newest_rows
    assert streamed.exceptAll(newest_rows(batch).select(*streamed.columns)).count() == 0
    assert streamed.count() == newest_rows(batch).count() < batch.count()
    ids = Q.q_stream_dedupe(spark, SF_SMALL)
    assert ids.count() == ids.distinct().count() == batch.select("id").distinct().count()


def test_streams_do_not_depend_on_the_file_layout(spark):
    from mediafold.plans import queries as Q
    from mediafold.streaming import stream_index as S
    results = []
    for files in (1, 6):
        root = S.scratch_root(spark, "layout")
        S.start_index_stream(Q.events_stream(spark, SF_SMALL, files), lambda s: Q.events_as_catalog_rows(s).drop("ts"),
                             f"{root}/catalog", f"{root}/c1").awaitTermination()
        S.start_dedupe_stream(Q.events_stream(spark, SF_SMALL, files), Q.events_as_catalog_rows, f"{root}/out",
                              f"{root}/c2").awaitTermination()
        ids = spark.read.parquet(f"{root}/out")
        results.append((sorted(map(tuple, S.latest_catalog(spark, f"{root}/catalog").collect())),
                        sorted(r["id"] for r in ids.collect())))
    assert results[0] == results[1] and len(set(results[0][1])) == len(results[0][1])


def test_changes_of_a_stream_leave_once_and_survive_a_restart(spark):
    from mediafold.streaming import stream_index as S
    root = S.scratch_root(spark, "restart")
    rows = [("/a", 1, 10, 100), ("/b", 2, 20, 100), ("/a", 3, 30, 200), ("/a", 9, 90, 50), ("/b", 2, 20, 100), ("/c", 4, 40, 300)]
    columns = "name string, hostname string, id long, size long, timemodified long, timeborn long, timebornsrc string, " \
              "mimetype string, mimesubtype string"

    def arrive(*picked):
        df = spark.createDataFrame([(n, "h", i, z, t, t, "stat", "image", "jpeg") for n, i, z, t in picked], columns)
        df.coalesce(1).write.mode("append").parquet(f"{root}/in")

    def run():
        stream = spark.readStream.schema(columns).parquet(f"{root}/in")
        S.start_index_stream(stream, lambda s: s, f"{root}/out", f"{root}/ck").awaitTermination()
        return sorted((r.name, r.old_id, r.new_id) for r in S.change_history(spark, f"{root}/out").collect())
    arrive(*rows[:2])
    assert run() == []
    arrive(*rows[2:4])                                  # a newer and an older sighting of /a
    assert run() == [("/a", 1, 3)]                      # a new query from the checkpoint knows the state
    arrive(*rows[4:])                                   # /b again, unchanged
    assert run() == [("/a", 1, 3)] and run() == [("/a", 1, 3)]
    got = {r.name: r.id for r in S.latest_catalog(spark, f"{root}/out").collect()}
    assert got == {"/a": 3, "/b": 2, "/c": 4}
    batch = S.versions(spark, f"{root}/out").where("batch = 1").drop("batch")
    S.write_versions(f"{root}/out")(spark.createDataFrame(batch.collect(), batch.schema), 1)
    assert S.latest_catalog(spark, f"{root}/out").count() == 3   # a batch that is delivered again replaces itself


def test_json_lists_of_any_length(spark):
    from conftest import one
    from mediafold.functions import text as X
    long = "x" * 50_000
    got = one(spark, X.sanitize_meta, f'["{long}", "b"]', '["a", null]', '[1, "a"]', "[not json]", '["a\\"b"]', "[]", None)
    assert got == [f"{long}, b", "a, ", '[1, "a"]', "[not json]", 'a"b', "", ""]
