import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from mediafold.session import build_session
    s = build_session(master="local[*]", shuffle_partitions=8, app_name="mediafold-tests")
    yield s
    s.stop()


def one(spark, expr_fn, *values, schema="s string"):
    """Evaluate a Column function on literal rows; returns the list of results."""
    from pyspark.sql import functions as F
    df = spark.createDataFrame([(v,) for v in values], schema)
    return [r[0] for r in df.select(expr_fn(F.col(df.columns[0]))).collect()]
