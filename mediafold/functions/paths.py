"""Path expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Longest destination accepted, and the conflict-suffix tag.
MAX_DEST_BYTES = 256
SUFFIX_TAG = "_XXH3"


def basename(path: Column) -> Column:
    """Last path element ('' for a path ending in '/')."""
    return F.element_at(F.split(path, "/"), -1)



def clean_path(path: Column) -> Column:
    """Collapse repeated separators and drop a trailing one (root stays '/')."""
    p = F.regexp_replace(path, "/+", "/")
    return F.when(p == "/", p).otherwise(F.regexp_replace(p, "/$", ""))


def date_dirs(unix_seconds: Column, tz: str) -> Column:
    """``yyyy/MM/dd`` of an instant as seen in zone ``tz``."""
    local = F.from_utc_timestamp(F.timestamp_seconds(unix_seconds), tz)
    return F.date_format(local, "yyyy/MM/dd")


def destination(root: str | Column, mime: Column, birth_unix: Column, name: Column,
                tz: str) -> Column:
    """``{root}/{mime}/{yyyy}/{MM}/{dd}/{basename}``, cleaned."""
    root_c = F.lit(root) if isinstance(root, str) else root
    return clean_path(F.concat_ws("/", root_c, mime, date_dirs(birth_unix, tz), name))
