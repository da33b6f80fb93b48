"""J1 -> J15 on authored files: list, hash, catalog, groups, plan, copy, re-run."""

import os
import tempfile
import time

from pyspark.sql import functions as F


def _write(path, data, mtime):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as fh:
        fh.write(data)
    os.utime(path, (mtime, mtime))


def test_index_and_backup_roundtrip(spark):
    from mediafold.functions.names import with_birth_from_name
    from mediafold.operators import backup, catalog, dedupe, filters, mime
    from mediafold.sources import listing

    base = tempfile.mkdtemp(prefix="mediafold-e2e-", dir="/tmp")
    src, dst = f"{base}/src", f"{base}/backup"
    jpeg = bytes.fromhex("FFD8FFE0") + b"photo-one" * 100
    png = bytes.fromhex("89504E470D0A1A0A") + b"png" * 50
    t0 = 1_600_000_000
    _write(f"{src}/2020/05/17/IMG_0001.jpg", jpeg, t0)
    _write(f"{src}/copies/a_longer_name.jpg", jpeg, t0 + 10)       # same content, other name
    _write(f"{src}/misc/pic.png", png, t0 + 20)
    _write(f"{src}/misc/notes.txt", b"just text", t0 + 30)
    _write(f"{src}/misc/empty.bin", b"", t0 + 40)

    lst = filters.size_filter(listing.list_files(spark, src, "h1"))
    assert lst.count() == 4                                          # empty file dropped
    empty_cat = spark.createDataFrame([], "name string, hostname string, id long, size long, timemodified long")
    work = catalog.work_list(lst, empty_cat)
    hashed = listing.hash_files(work, partitions=2)
    typed = mime.detect(listing.readable(hashed), "header")
    files = (with_birth_from_name(work, now_year=2026)
             .join(typed.select("name", "id", "mimetype", "mimesubtype"), "name"))
    groups = {r.id: r for r in dedupe.duplicate_groups(files).collect()}
    assert len(groups) == 3
    jpeg_group = [g for g in groups.values() if g.n_members == 2][0]
    assert jpeg_group.name == "IMG_0001.jpg" and jpeg_group.mimetype == "image"

    disk = spark.createDataFrame([], "path string, disk_id long")
    plan = backup.backup_plan(files, None, disk, dst, "UTC")
    actions = {r.id: r.action for r in plan.collect()}
    assert sorted(actions.values()) == ["copy", "copy", "ignored"]
    srcs = backup.copy_sources(plan, files, lst)
    done = backup.execute_plan(plan, srcs, partitions=2).collect()
    assert sorted(r.status for r in done) == ["copied", "copied"]
    dest = [r.path_final for r in done if r.id == jpeg_group.id][0]
    assert dest == f"{dst}/image/2020/05/17/IMG_0001.jpg"           # birth from the path
    with open(dest, "rb") as fh:
        assert fh.read() == jpeg
    assert abs(os.stat(dest).st_mtime - t0) < 1                      # mtime kept

    # a second run finds everything in place
    on_disk = (listing.hash_files(listing.list_files(spark, dst, "backup"))
               .select(F.col("name").alias("path"), F.col("id").alias("disk_id")))
    again = {r.id: r.action for r in backup.backup_plan(files, None, on_disk, dst, "UTC").collect()}
    assert sorted(again.values()) == ["ignored", "present", "present"]
    # and re-listing the sources gives an empty work list once the catalog holds them
    cat = files.select("name", "hostname", "id", "size", "timemodified")
    assert catalog.work_list(lst, cat).count() == 0
    time.sleep(0)


def test_reader_edge_cases(spark):
    import numpy as np
    import xxhash

    from mediafold.sources import listing
    base = tempfile.mkdtemp(prefix="mediafold-read-", dir="/tmp")
    big = b"x" * 20000
    _write(f"{base}/big.bin", big, 1_600_000_000)
    os.utime(f"{base}/big.bin", (1_600_000_000.6, 1_600_000_000.6))     # rounds up to the next second
    lst = listing.list_files(spark, base, "h").collect()
    assert [(r.size, r.timemodified) for r in lst] == [(20000, 1_600_000_001)]
    work = spark.createDataFrame([(f"{base}/big.bin",), (f"{base}/missing.bin",)], "name string")
    got = {os.path.basename(r.name): r for r in listing.hash_files(work).collect()}
    want = int(np.uint64(xxhash.xxh3_64_intdigest(big)).astype(np.int64))
    assert got["big.bin"].id == want and len(got["big.bin"].header) == listing.HEADER_BYTES and got["big.bin"].read_ok
    assert got["missing.bin"].id is None and not got["missing.bin"].read_ok and got["missing.bin"].error
    assert [r.name for r in listing.unreadable(listing.hash_files(work)).collect()] == [f"{base}/missing.bin"]


def test_no_name_is_left_out_and_unreadable_files_are_reported(spark):
    from mediafold.sources import listing
    base = tempfile.mkdtemp(prefix="mediafold-walk-", dir="/tmp")
    names = ["_MG_1.jpg", ".x.jpg", "_dir/a.jpg", "d/e/f/_deep/.g.png", "plain one.txt"]
    for i, n in enumerate(names):
        _write(f"{base}/{n}", b"x" * (i + 1), 1_600_000_000)
    os.symlink(base, f"{base}/d/loop")
    found = {r.name: r.size for r in listing.list_files(spark, base, "h").collect()}
    assert found == {f"{base}/{n}": i + 1 for i, n in enumerate(names)}
    work = listing.list_files(spark, base, "h")
    gone = spark.createDataFrame([(f"{base}/gone1", "h", 1, 1), (f"{base}/gone2", "h", 1, 1)], work.schema)
    hashed = listing.hash_files(work.unionByName(gone))
    assert listing.readable(hashed).count() == 5 and listing.unreadable(hashed).count() == 2
    assert listing.walk(spark, f"{base}/absent").where("kind = 'error'").count() == 1


def _catalog(spark, rows):
    return spark.createDataFrame([(n, "h", i, size, mtime, mtime, "stat", "image", "jpeg") for n, i, size, mtime in rows],
                                 "name string, hostname string, id long, size long, timemodified long, timeborn long, "
                                 "timebornsrc string, mimetype string, mimesubtype string")


def test_directory_links_are_followed_once(spark):
    from mediafold.sources import listing as L
    base = tempfile.mkdtemp(prefix="mediafold-links-", dir="/tmp")
    root, away = f"{base}/root", f"{base}/away"
    for name in ("root/a/1.jpg", "root/a/deep/2.jpg", "root/b/3.jpg", "away/4.jpg", "away/sub/5.jpg"):
        _write(f"{base}/{name}", b"x", 1_600_000_000)
    os.symlink(root, f"{root}/a/deep/up")             # back to the root
    os.symlink(f"{root}/a", f"{root}/b/again")         # a directory that is listed anyway
    os.symlink(away, f"{root}/out")                    # out of the root
    os.symlink(f"{root}/b", f"{away}/sub/back")        # and back into it
    os.symlink(f"{away}/sub", f"{root}/a/deep/sub")    # reached on two ways
    os.symlink(f"{base}/nowhere", f"{root}/broken")
    os.symlink(f"{root}/b/3.jpg", f"{root}/file-link.jpg")
    names = sorted(r.name[len(root) + 1:] for r in L.list_files(spark, root, "h").collect())
    assert names == ["a/1.jpg", "a/deep/2.jpg", "b/3.jpg", "file-link.jpg", "out/4.jpg", "out/sub/5.jpg"]
    linked = sorted(r.name for r in L.list_files(spark, f"{root}/b/again", "h").collect())
    assert [n[len(root) + 1:] for n in linked][:2] == ["b/again/1.jpg", "b/again/deep/2.jpg"]  # the root itself may be a link


def test_backup_job_moves_copies_and_tries_every_source(spark):
    from mediafold.operators import backup
    from mediafold.sources.listing import content_id
    base = tempfile.mkdtemp(prefix="mediafold-job-", dir="/tmp")
    t0 = 1_600_000_000

    def put(path, data):
        _write(f"{base}/{path}", data, t0)
        with open(f"{base}/{path}", "rb") as f:
            return content_id(f)[0]
    moved, copied, lost = put("old/m.jpg", b"moved" * 9), put("src/c2.jpg", b"copied" * 9), 77
    put("src/m.jpg", b"moved" * 9)
    put("src/c1.jpg", b"other!" * 9)                     # same size and time as the copy's source, rotten content
    os.utime(f"{base}/src/c2.jpg", (t0 + 0.5, t0 + 0.5))  # half a second: rounds up, as the listing does
    files = _catalog(spark, [(f"{base}/src/m.jpg", moved, 45, t0), (f"{base}/src/c1.jpg", copied, 54, t0),
                             (f"{base}/src/c2.jpg", copied, 54, t0 + 1), (f"{base}/src/none.jpg", lost, 5, t0)])
    old = _catalog(spark, [(f"{base}/old/m.jpg", moved, 45, t0), (f"{base}/old/keep.jpg", 5, 4, t0)])
    disk = spark.createDataFrame([(f"{base}/old/m.jpg", moved)], "path string, disk_id long")
    listing = files.where("id <> 77").select("name", "hostname", "size", "timemodified")
    done, filez = backup.backup_job(files, old, disk, listing, f"{base}/bk", "UTC")
    status = {r.id: (r.status, r.path_final) for r in done.collect()}
    assert status[moved][0] == "moved" and status[copied][0] == "copied" and status[lost] == ("no_source", None)
    assert open(status[copied][1], "rb").read() == b"copied" * 9 and not os.path.exists(f"{base}/old/m.jpg")
    rows = {r.id: r.name for r in filez.collect()}
    assert rows == {moved: status[moved][1], copied: status[copied][1], 5: f"{base}/old/keep.jpg"}
    # carried out again (a lost task, a second run): everything is found done
    again = backup.run_plan(backup.backup_plan(files, old, disk, f"{base}/bk", "UTC"), files, listing)
    assert {r.id: r.path_final for r in again.collect()} == {i: p for i, (_, p) in status.items()}
    assert not [f for _, _, fs in os.walk(base) for f in fs if f.endswith(".tmp")]


def test_move_falls_back_to_a_copy(spark):
    from mediafold.operators import backup
    from mediafold.sources.listing import content_id
    base = tempfile.mkdtemp(prefix="mediafold-move-", dir="/tmp")
    _write(f"{base}/src/a.jpg", b"abc", 1_600_000_000)
    with open(f"{base}/src/a.jpg", "rb") as f:
        i = content_id(f)[0]
    files = _catalog(spark, [(f"{base}/src/a.jpg", i, 3, 1_600_000_000)])
    old = _catalog(spark, [(f"{base}/gone/a.jpg", i, 3, 1_600_000_000)])
    disk = spark.createDataFrame([(f"{base}/gone/a.jpg", i)], "path string, disk_id long")  # deleted since it was listed
    plan = backup.backup_plan(files, old, disk, f"{base}/bk", "UTC")
    assert [r.action for r in plan.collect()] == ["move"]
    done = backup.run_plan(plan, files, files.select("name", "hostname", "size", "timemodified")).first()
    assert done.status == "copied" and open(done.path_final, "rb").read() == b"abc"


def test_backup_plan_without_backups_has_no_null_keys(spark):
    from mediafold.operators import backup
    files = _catalog(spark, [(f"/s/{i}.jpg", i, 5, 1) for i in range(400)])
    old = _catalog(spark, [("/bk/x.jpg", 3, 5, 1)])
    disk = spark.createDataFrame([("/bk/x.jpg", 3)], "path string, disk_id long")
    plan = backup.backup_plan(files, old, disk, "/bk", "UTC", materialize=False)
    states = {r.backup_state: r["count"] for r in plan.groupBy("backup_state").count().collect()}
    assert states == {"none": 399, "ok": 1}
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in text.splitlines() if "Join" in line and "backup_name" in line]


def test_index_job_end_to_end(spark):
    from mediafold.operators.index_job import index_job
    from mediafold.sources import catalog as store
    base = tempfile.mkdtemp(prefix="mediafold-index-", dir="/tmp")
    src, root = f"{base}/src", f"{base}/store"
    t0 = 1_600_000_000
    jpeg = bytes.fromhex("FFD8FFE0") + b"one" * 100
    _write(f"{src}/2020/05/17/_MG_1.jpg", jpeg, t0)
    _write(f"{src}/copy.jpg", jpeg, t0 + 5)
    _write(f"{src}/odd.bin", b"unknown bytes", t0 + 9)
    _write(f"{src}/empty", b"", t0)
    asked = []

    def extract(names):
        asked.append(sorted(os.path.basename(r.name) for r in names.collect()))
        doc = F.when(F.col("name").endswith("odd.bin"), F.lit('[{"MIMEType": "video/mp4", "CreateDate": "2015:03:04 05:06:07Z"}]')) \
            .otherwise(F.lit('[{"Make": "x"}]'))
        return names.select("name", doc.alias("json"))
    first = index_job(spark, src, "h1", root, extract, now_year=2026)
    rows = {os.path.basename(r.name): r for r in store.read_table(spark, f"{root}/files").collect()}
    assert sorted(rows) == ["_MG_1.jpg", "copy.jpg", "odd.bin"] and first.unreadable.count() == 0
    assert rows["_MG_1.jpg"].id == rows["copy.jpg"].id and rows["copy.jpg"].mimetype == "image"
    assert rows["_MG_1.jpg"].timebornsrc == "name" and rows["copy.jpg"].timebornsrc == "stat"
    odd = rows["odd.bin"]
    assert (odd.mimetype, odd.mimesubtype, odd.timebornsrc, odd.timeborn) == ("video", "mp4", "meta", 1425445567)
    assert [len(a) for a in asked] == [2]                       # one file per content id
    assert spark.read.option("recursiveFileLookup", True).parquet(f"{root}/cache").count() == 1     # only documents with a taken time are cached
    again = index_job(spark, src, "h1", root, extract, now_year=2026)
    assert again.run is None and again.rows.count() == 0 and asked[-1] == []
    _write(f"{src}/copy.jpg", b"GIF89a changed", t0 + 50)
    index_job(spark, src, "h1", root, extract, now_year=2026, changed_at=7)
    rows = {os.path.basename(r.name): r for r in store.read_table(spark, f"{root}/files").collect()}
    assert rows["copy.jpg"].mimesubtype == "gif" and len(rows) == 3
    log = spark.read.option("recursiveFileLookup", True).parquet(f"{root}/history").collect()
    assert [(os.path.basename(r.name), r.changed_at) for r in log] == [("copy.jpg", 7)]
