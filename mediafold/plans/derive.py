"""Catalog-shaped inputs derived from the driver's tables.

The driver's tables hold no media files, so each registered query first maps
a driver table onto the shape an operator consumes (a ``files`` catalog, a
listing, tag rows ...).  Every mapping is a per-row projection of whole
tables: no row is dropped, sampled or capped, so the work grows with the
data.  Each mapping has a twin SQL fragment in :mod:`mediafold.plans.oracle`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mediafold.functions.ids import digest_id
from mediafold.sources.tables import load

# Fixed values of the mapping (shared with the SQL twins).
DOC_MTIME_BASE = 1_500_000_000
DOC_MTIME_STEP = 7_919
DOC_BIRTH_BASE = 1_400_000_000


def documents_as_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` as a ``files`` catalog: one file per document.

    Exact text copies become files with one content id under different
    names.  Language decides the media type and where the birth time came
    from; German births derive from the row, so copies there may conflict.
    """
    d = load(spark, sf_dir, "documents", ["doc_id", "text", "lang", "source", "n_chars"])
    lang = F.col("lang")
    return d.select(
        F.concat(F.lit("/srv/"), F.col("source"), F.lit("/"), lang, F.lit("/"),
                 F.col("doc_id").cast("string"), F.lit(".txt")).alias("name"),
        F.col("source").alias("hostname"),
        digest_id(F.col("text")).alias("id"),
        F.octet_length("text").cast("bigint").alias("size"),
        (F.lit(DOC_MTIME_BASE) + F.col("doc_id") * DOC_MTIME_STEP).cast("bigint").alias("timemodified"),
        F.when(lang == "en", F.lit(DOC_BIRTH_BASE) + F.col("n_chars") * 3600)
        .otherwise(F.lit(DOC_BIRTH_BASE) + F.col("doc_id") * 86400).cast("bigint").alias("timeborn"),
        F.when(lang.isin("en", "de"), "meta").when(lang == "fr", "name").otherwise("stat").alias("timebornsrc"),
        F.when(lang == "en", "image").when(lang == "fr", "video").when(lang == "de", "audio")
        .otherwise("text").alias("mimetype"),
        F.when(lang == "en", "jpeg").when(lang == "fr", "mp4").when(lang == "de", "mpeg")
        .otherwise("plain").alias("mimesubtype"),
    )


def _pad2(c):
    return F.lpad(c.cast("string"), 2, "0")


def orders_as_named_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``orders`` as files whose paths carry the order date in five shapes.

    The shape follows ``o_orderpriority``; time-of-day, day overflow (31 Feb),
    hour 24, second 60, trailing digits, pre-1990 years and a basename date
    earlier than its folder's are all produced from the row's own values.
    mtime is the order date shifted by -3..+3 days.
    """
    o = load(spark, sf_dir, "orders", ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate",
                                       "o_orderpriority"])
    k, c, st, dt = F.col("o_orderkey"), F.col("o_custkey"), F.col("o_orderstatus"), F.col("o_orderdate")
    yyyy, mm, dd = F.date_format(dt, "yyyy"), F.date_format(dt, "MM"), F.date_format(dt, "dd")
    ks, cs = k.cast("string"), c.cast("string")
    day_var = _pad2(F.lit(1) + k % 31)
    hh, mi, ss = _pad2((k * 7) % 25), _pad2((k * 13) % 60), _pad2((c * 17) % 61)
    prio = F.col("o_orderpriority")
    name = (
        F.when(prio == "1-URGENT", F.concat(F.lit("/media/"), cs, F.lit("/"), yyyy, F.lit("-"), mm,
                                            F.lit("-"), day_var, F.lit("_"), hh, F.lit("-"), mi,
                                            F.lit("-"), ss, F.lit(".mp4")))
        .when(prio == "2-HIGH", F.concat(F.lit("/backup/"), yyyy, F.lit("_"), mm, F.lit("_"), dd,
                                         F.when(st == "O", ks).otherwise(F.lit("")),
                                         F.lit("/scan"), ks, F.lit(".png")))
        .when(prio == "3-MEDIUM", F.when(
            st == "F", F.concat(F.lit("/albums/"), yyyy, F.lit("/"), F.month(dt).cast("string"), F.lit("/"),
                                F.dayofmonth(dt).cast("string"), F.lit("/p"), ks, F.lit(".jpg")))
            .otherwise(F.concat(F.lit("/albums/"), yyyy, F.lit("/"), F.month(dt).cast("string"),
                                F.lit("/x"), ks, F.lit(".jpg"))))
        .when(prio == "4-NOT SPECIFIED", F.concat(
            F.lit("/dcim/"), cs, F.lit("/VID"),
            F.when(st == "P", (F.year(dt) - 8).cast("string")).otherwise(yyyy), mm, dd, F.lit(".mov")))
        .otherwise(F.concat(F.lit("/inbox/"), yyyy, F.lit("-"), mm, F.lit("-"), dd, F.lit("/IMG-"),
                            F.date_format(F.date_sub(F.to_date(dt), (k % 400).cast("int")), "yyyyMMdd"),
                            F.lit(".jpg")))
    )
    mtime = F.unix_timestamp(dt) + ((c % 7) - 3) * 86400
    return o.select(k.alias("file_key"), name.alias("name"), mtime.cast("bigint").alias("timemodified"))


def orders_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``orders`` as a fresh file listing: one file per order."""
    o = load(spark, sf_dir, "orders", ["o_orderkey", "o_orderstatus", "o_orderpriority", "o_totalprice",
                                       "o_orderdate"])
    return o.select(
        F.concat(F.lit("/data/"), F.col("o_orderstatus"), F.lit("/"), F.col("o_orderkey").cast("string"),
                 F.lit(".dat")).alias("name"),
        F.concat(F.lit("host"), F.substring("o_orderpriority", 1, 1)).alias("hostname"),
        F.floor(F.col("o_totalprice") * 100).cast("bigint").alias("size"),
        F.unix_timestamp("o_orderdate").cast("bigint").alias("timemodified"),
    )


def orders_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored catalog the listing is compared with.

    Open orders ('O') are not catalogued yet (new files); pending ones ('P')
    were catalogued with another size (resized); finished high-priority ones
    with an older mtime (touched); customers are catalogued files that no
    longer exist (vanished).
    """
    o = load(spark, sf_dir, "orders", ["o_orderkey", "o_orderstatus", "o_orderpriority", "o_totalprice",
                                       "o_orderdate"]).where(F.col("o_orderstatus") != "O")
    st, prio = F.col("o_orderstatus"), F.col("o_orderpriority")
    name = F.concat(F.lit("/data/"), st, F.lit("/"), F.col("o_orderkey").cast("string"), F.lit(".dat"))
    size = F.floor(F.col("o_totalprice") * 100).cast("bigint") + F.when(st == "P", 1).otherwise(0)
    mtime = (F.unix_timestamp("o_orderdate")
             - F.when((st == "F") & (prio == "2-HIGH"), 3600).otherwise(0)).cast("bigint")
    orders_part = o.select(
        name.alias("name"),
        F.concat(F.lit("host"), F.substring(prio, 1, 1)).alias("hostname"),
        digest_id(F.concat(name, F.lit(":"), size.cast("string"))).alias("id"),
        size.alias("size"), mtime.alias("timemodified"), mtime.alias("timeborn"),
        F.lit("stat").alias("timebornsrc"), F.lit("application").alias("mimetype"),
        F.lit("octet-stream").alias("mimesubtype"))
    c = load(spark, sf_dir, "customer", ["c_custkey"])
    cname = F.concat(F.lit("/data/gone/"), F.col("c_custkey").cast("string"), F.lit(".dat"))
    csize = (F.col("c_custkey") * 10).cast("bigint")
    cm = (F.lit(1_600_000_000) + F.col("c_custkey")).cast("bigint")
    gone = c.select(cname.alias("name"), F.lit("host1").alias("hostname"),
                    digest_id(F.concat(cname, F.lit(":"), csize.cast("string"))).alias("id"),
                    csize.alias("size"), cm.alias("timemodified"), cm.alias("timeborn"),
                    F.lit("stat").alias("timebornsrc"), F.lit("application").alias("mimetype"),
                    F.lit("octet-stream").alias("mimesubtype"))
    return orders_part.unionByName(gone)


def index_rows(work: DataFrame, now_year: int) -> DataFrame:
    """Catalog rows for the files that need (re)indexing: content id + birth time."""
    from mediafold.functions.names import with_birth_from_name
    rows = work.select(
        "name", "hostname",
        digest_id(F.concat(F.col("name"), F.lit(":"), F.col("size").cast("string"))).alias("id"),
        "size", "timemodified")
    return with_birth_from_name(rows, now_year=now_year).select(
        "name", "hostname", "id", "size", "timemodified", "timeborn", "timebornsrc",
        F.lit("application").alias("mimetype"), F.lit("octet-stream").alias("mimesubtype"))


# Fixed values of the registered backup queries.
BACKUP_ROOT = "/backup"
BACKUP_TZ = "Asia/Shanghai"


def _own_dest(f: DataFrame) -> DataFrame:
    from mediafold.functions.paths import basename, destination
    return f.withColumn("own_dest", destination(BACKUP_ROOT, F.col("mimetype"), F.col("timeborn"),
                                                basename(F.col("name")), BACKUP_TZ))


def documents_backups(spark: SparkSession, sf_dir: str, files: DataFrame | None = None) -> DataFrame:
    """``filez``: contents of hosts src0-src3 were backed up earlier, each at
    the dated path of its first member (by name)."""
    f = _own_dest(files if files is not None else documents_as_files(spark, sf_dir))
    row = F.struct(F.col("own_dest").alias("name"), "hostname", "size", "timemodified", "timeborn",
                   "timebornsrc", "mimetype", "mimesubtype")
    b = (f.where(F.col("hostname").isin("src0", "src1", "src2", "src3"))
         .groupBy("id").agg(F.min_by(row, F.col("name")).alias("b")))
    return b.select("id", "b.*")


def documents_backup_disk(spark: SparkSession, sf_dir: str, files: DataFrame | None = None) -> DataFrame:
    """``(path, disk_id)`` under the backup root after hashing.

    Backups of src1 rotted (other id), of src2 vanished; files of src5/src6
    find their path taken by foreign content (src6 also the first suffixed
    path); files of src7 are already present.
    """
    from mediafold.functions.ids import id_hex
    from mediafold.functions.paths import SUFFIX_TAG
    files = files if files is not None else documents_as_files(spark, sf_dir)
    b = documents_backups(spark, sf_dir, files)
    f = _own_dest(files)
    h = F.col("hostname")
    stored = b.where(h != "src2").select(
        F.col("name").alias("path"),
        F.when(h == "src1", F.col("id").bitwiseXOR(F.lit(1))).otherwise(F.col("id")).alias("disk_id"))
    foreign = f.where(h.isin("src5", "src6")).select(
        F.col("own_dest").alias("path"), F.col("id").bitwiseXOR(F.lit(7)).alias("disk_id"))
    foreign2 = f.where(h == "src6").select(
        F.concat("own_dest", F.lit("-"), id_hex(F.col("id")), F.lit(SUFFIX_TAG)).alias("path"),
        F.col("id").bitwiseXOR(F.lit(9)).alias("disk_id"))
    present = f.where(h == "src7").select(F.col("own_dest").alias("path"), F.col("id").alias("disk_id"))
    return stored.unionByName(foreign).unionByName(foreign2).unionByName(present)


def documents_fresh_listing(spark: SparkSession, sf_dir: str, files: DataFrame | None = None) -> DataFrame:
    """A new scan of the sources: Spanish files changed size since they were
    catalogued and host src8 no longer has its files."""
    f = files if files is not None else documents_as_files(spark, sf_dir)
    return f.where(F.col("hostname") != "src8").select(
        "name", "hostname",
        (F.col("size") + F.when(F.col("name").contains("/es/"), 1).otherwise(0)).alias("size"),
        "timemodified")


def documents_backup_inputs(spark: SparkSession, sf_dir: str):
    """(files, filez, on-disk listing) for the backup queries.

    The derived catalog stands in for a stored table: it is checkpointed once
    into the shared ``spark.checkpoint.dir`` so the three inputs read it
    instead of re-hashing every document three times.
    """
    from mediafold.session import checkpoint_dir
    checkpoint_dir(spark)
    files = documents_as_files(spark, sf_dir).checkpoint(eager=True)
    return files, documents_backups(spark, sf_dir, files), documents_backup_disk(spark, sf_dir, files)
