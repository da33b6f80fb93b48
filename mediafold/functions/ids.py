"""Content ids and identifier tests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed value: the 8-4-4-4-12 hex form of a UUID.
UUID_PATTERN = r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"


def digest_id(content: Column, algo: str = "md5") -> Column:
    """Signed 64-bit content id from the first 8 bytes of a native digest.

    ``md5`` / ``sha256`` stay inside whole-stage codegen.  The digest's first
    16 hex digits are read as an unsigned number and reinterpreted as signed
    (``conv`` with a negative target base), as the catalog stores ``id`` as a
    signed long.
    """
    if algo == "md5":
        digest = F.md5(content)
    elif algo == "sha256":
        digest = F.sha2(content, 256)
    else:
        raise ValueError(f"unknown digest {algo!r}; use xxh3_id for XXH3")
    return F.conv(F.substring(digest, 1, 16), 16, -10).cast("bigint")


def id_hex(id_col: Column) -> Column:
    """Id -> 16 lower-case hex digits, big-endian (two's complement for negatives)."""
    return F.lower(F.lpad(F.hex(id_col), 16, "0"))


def xxh3_id(content: Column) -> Column:
    """G1 with the reference's hash: XXH3-64 of the bytes, as a signed long.

    Runs as an Arrow-batched pandas UDF (one call per batch, not per row); the
    native ``digest_id`` is the default because it stays JVM-side.
    """
    return _xxh3_udf(content)


def _xxh3_batch(s):  # pandas Series of bytes/str -> Series of int64
    import numpy as np
    import pandas as pd
    import xxhash

    out = np.empty(len(s), dtype=np.int64)
    for i, v in enumerate(s):
        if v is None:
            out[i] = 0
            continue
        b = v.encode("utf-8") if isinstance(v, str) else bytes(v)
        out[i] = np.uint64(xxhash.xxh3_64_intdigest(b)).astype(np.int64)
    return pd.Series(out)


_xxh3_udf = F.pandas_udf(_xxh3_batch, T.LongType())


def is_uuid(s: Column) -> Column:
    """True when the text is a UUID in 8-4-4-4-12 hex form (any case)."""
    return F.coalesce(F.lower(F.trim(s)).rlike(UUID_PATTERN), F.lit(False))


def sanitize_uuid(s: Column) -> Column:
    """Lower-case UUID, else ''."""
    v = F.lower(F.trim(s))
    return F.when(v.rlike(UUID_PATTERN), v).otherwise(F.lit(""))
