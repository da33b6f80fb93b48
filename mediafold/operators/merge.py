"""Merging several metadata sources of one file.

Sources arrive as separate DataFrames keyed by the file.  They are combined
with full outer joins on the key and an ordered ``coalesce`` per field: the
first source fills a field, the second (JSON) fills only fields still empty,
the last (XMP) overwrites whatever it has.

Fields keep their types.  A blank text, a zero, a false flag and an empty list are absent values, as in the metadata records
themselves.  Lists of texts (keywords) are not replaced but united: sorted, each word once.

Edge cases: a NULL key matches nothing and stays a row of its own; a key that a source holds twice gives a row for each; a
field that no source has is a NULL text.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def field_type(sources: list[tuple[str, DataFrame, str]], name: str) -> T.DataType:
    """Type of a field: that of the first source that has it; numbers of two types meet in the wider one."""
    kinds = [df.schema[name].dataType for _, df, _ in sources if name in df.columns]
    if not kinds:
        return T.StringType()
    order = [T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType]
    if all(type(k) in order for k in kinds):
        return max(kinds, key=lambda k: order.index(type(k)))
    if len({k.simpleString() for k in kinds}) > 1:
        raise ValueError(f"sources disagree about the type of {name}: {', '.join(k.simpleString() for k in kinds)}")
    return T.ArrayType(kinds[0].elementType) if isinstance(kinds[0], T.ArrayType) else kinds[0]


def _present(c, kind: T.DataType):
    """The value, NULL where it stands for nothing."""
    if isinstance(kind, T.StringType):
        return F.when(F.trim(c) != "", c)
    if isinstance(kind, T.NumericType):
        return F.when(c != 0, c)
    if isinstance(kind, T.BooleanType):
        return F.when(c, c)
    if isinstance(kind, T.ArrayType):
        return F.when(F.size(c) > 0, c)
    return c


def _united(lists):
    """All words of several lists, sorted, each once; NULL if there is none."""
    words = F.flatten(F.array(*[F.coalesce(c, F.array().cast("array<string>")) for c in lists]))
    words = F.array_sort(F.array_distinct(F.filter(words, lambda w: F.coalesce(w, F.lit("")) != "")))
    return F.when(F.size(words) > 0, words)


def merge_sources(sources: list[tuple[str, DataFrame, str]], key: str, fields: list[str]) -> DataFrame:
    """``sources`` = [(name, df, mode)], mode ``fill`` (only empty fields) or ``overwrite``.

    Later ``fill`` sources never replace earlier values; ``overwrite``
    sources replace any value they carry.  Adds ``sources`` (names present).
    """
    kinds, parts = {f: field_type(sources, f) for f in fields}, []
    for i, (name, df, _mode) in enumerate(sources):
        cols = [F.col(key)] + [(_present(F.col(f), kinds[f]) if f in df.columns else F.lit(None)).cast(kinds[f])
                               .alias(f"__{i}_{f}") for f in fields]
        parts.append(df.select(*cols, F.lit(name).alias(f"__{i}_src")))
    joined = reduce(lambda a, b: a.join(b, key, "full_outer"), parts)
    out = [F.col(key)]
    for f in fields:
        fill = [F.col(f"__{i}_{f}") for i, (_, _, m) in enumerate(sources) if m == "fill"]
        over = [F.col(f"__{i}_{f}") for i, (_, _, m) in reversed(list(enumerate(sources))) if m == "overwrite"]
        out.append((_united(over + fill) if isinstance(kinds[f], T.ArrayType) else F.coalesce(*over, *fill)).alias(f))
    present = F.concat_ws(",", *[F.col(f"__{i}_src") for i in range(len(sources))])
    return joined.select(*out, present.alias("sources"))
