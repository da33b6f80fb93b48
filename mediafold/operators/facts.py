"""Derived media facts and catalog rollups (J16: C8-C12, H14-H16, H30, E12, G19)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def catalog_summary(files: DataFrame, tz: str) -> DataFrame:
    """Per media type and birth month (in ``tz``): files, distinct
    contents, bytes, and bytes held by duplicate copies.

    Two algebraic aggregations: first per (type, year, month, id), then per
    (type, year, month); both combine map-side, so a hot id or a hot month is
    never a list in one task.
    """
    local = F.from_utc_timestamp(F.timestamp_seconds(F.col("timeborn")), tz)
    per_id = (files.select("mimetype", F.year(local).alias("year"), F.month(local).alias("month"), "id", "size")
              .groupBy("mimetype", "year", "month", "id")
              .agg(F.count(F.lit(1)).alias("n"), F.min("size").alias("size"), F.sum("size").alias("bytes")))
    return per_id.groupBy("mimetype", "year", "month").agg(
        F.sum("n").alias("files"),
        F.count(F.lit(1)).alias("contents"),
        F.sum("bytes").alias("bytes"),
        F.sum((F.col("n") - 1) * F.col("size")).alias("duplicate_bytes"))


def field_report(spark: SparkSession, tag_fields: dict, schema: T.StructType | None = None) -> DataFrame:
    """One row per metadata field: ``field, kind, tags``.

    Built from the declarative tag table and, for fields that no tag fills, the output schema.
    """
    classes = {"string": "text", "int": "number", "float": "decimal", "float32": "decimal", "bool": "flag",
               "time": "timestamp", "duration": "duration", "keywords": "list"}
    rows = [(name, classes.get(kind, kind), ", ".join(tags)) for name, (tags, kind) in tag_fields.items()]
    types = {"string": "text", "int": "number", "bigint": "number", "float": "decimal", "double": "decimal",
             "boolean": "flag", "timestamp": "timestamp"}
    for f in schema.fields if schema is not None else []:
        if f.name not in tag_fields:
            kind = f.dataType.simpleString()
            rows.append((f.name, types.get(kind, "list" if kind.startswith("array") else kind), ""))
    return spark.createDataFrame(rows, "field string, kind string, tags string")
