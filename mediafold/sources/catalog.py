"""The catalog table (A3, B1, and the write side of B2): plain Parquet, partitioned by host.

An upsert rewrites the hosts that it touches by dynamic partition overwrite and leaves the others where they are; a host
scan is partition-pruned.  Spark stages the new files and puts them in place at the job's commit, so a job that dies
before leaves the table as it was; a job that dies within the commit can leave some hosts renewed and others not, and
running it again ends the same (the diff compares paths, not runs).  There is one writer at a time.

Edge cases: rows of a NULL host are a partition of their own; an empty host name is read back as NULL, as Spark's
partition folders do; an upsert without rows writes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mediafold import schemas


def create_catalog(spark: SparkSession, root: str, table: str = "files") -> str:
    """B1: an empty table, if none exists yet; returns its folder."""
    path = f"{root.rstrip('/')}/{table}"
    spark.createDataFrame([], schemas.FILES).write.mode("append").partitionBy("hostname").parquet(path)
    return path


def read_table(spark: SparkSession, path: str, hosts: list[str | None] | None = None) -> DataFrame:
    """The table (of some hosts)."""
    rows = spark.read.schema(schemas.FILES).parquet(path).select(*[f.name for f in schemas.FILES.fields])
    if hosts is None:
        return rows
    named = [h for h in hosts if h is not None]
    wanted = F.col("hostname").isin(*named) if named else F.lit(False)
    return rows.where(wanted | F.col("hostname").isNull() if len(named) < len(hosts) else wanted)


def write_hosts(df: DataFrame, path: str) -> None:
    """Replace the hosts that ``df`` holds by its rows."""
    for f in schemas.FILES.fields:
        if f.name not in df.columns:
            df = df.withColumn(f.name, F.lit(None).cast(f.dataType))
    # Rows of a host meet before writing, in as many tasks as its size asks for (AQE splits large partitions).
    (df.select(*[f.name for f in schemas.FILES.fields]).hint("rebalance", "hostname").write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("hostname").parquet(path))


def upsert_table(new_rows: DataFrame, path: str, merge=None) -> None:
    """B2 on storage: merge ``new_rows`` into the hosts they touch; other hosts are not read or written.

    ``merge(old, new)`` defaults to replacing rows of the same path.
    """
    from mediafold.operators import catalog as C
    new_rows = new_rows.select(*C.CATALOG_COLUMNS)
    touched = new_rows.select("hostname").distinct()
    old = read_table(new_rows.sparkSession, path).alias("o")
    same = F.col("o.hostname").eqNullSafe(F.col("t.hostname"))
    old = old.join(touched.alias("t"), same, "left_semi").select(*C.CATALOG_COLUMNS)  # pruned to these at run time
    write_hosts((merge or C.upsert)(old, new_rows), path)
