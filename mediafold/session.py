"""Session settings the library relies on.

On a cluster the session is created by the platform; call
:func:`apply_settings` on it.  Tests and the bench use :func:`build_session`.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings every job in the package assumes.
REQUIRED_CONF = {
    # Times are carried as UTC instants; every zone is passed explicitly.
    "spark.sql.session.timeZone": "UTC",
    # A tag that appears twice in one JSON document: the later value wins.
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    # Job-level codegen tuning (no effect on results): HotSpot does not
    # JIT-compile methods over 8000 bytes of bytecode, so wider whole-stage
    # codegen stages fall back to per-expression code, which is compiled.
    "spark.sql.codegen.hugeMethodLimit": "8000",
}

# Of those, the ones that only tune; with Spark's defaults, which may be replaced.
TUNING = {"spark.sql.codegen.hugeMethodLimit": "65535"}

# Settings that matter for scale; applied when the session does not set them.
SCALE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Broadcast only small build sides; the planner checks sizes at runtime.
    "spark.sql.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
    "spark.sql.adaptive.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
    "spark.sql.parquet.filterPushdown": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def find_package_on_workers(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver did.

    Enough where executors see the same path (local mode, a shared or installed copy); elsewhere ship the package with
    ``--py-files``.
    """
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = spark.sparkContext.environment
    known = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in known:
        env["PYTHONPATH"] = os.pathsep.join([*known, root])


def apply_settings(spark: SparkSession) -> SparkSession:
    find_package_on_workers(spark)
    for k, v in REQUIRED_CONF.items():
        if k not in TUNING or _conf(spark, k) in (None, TUNING[k]):  # a caller's own tuning stands
            spark.conf.set(k, v)
    for k, v in SCALE_CONF.items():
        if _conf(spark, k) is None:
            spark.conf.set(k, v)
    return spark


def _conf(spark: SparkSession, key: str) -> str | None:
    try:
        return spark.conf.get(key, None)
    except Exception:  # pragma: no cover - conf not readable
        return None


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "mediafold") -> SparkSession:
    """Local session for tests and the bench (UI off, UTC, AQE on)."""
    master = master or os.environ.get("MEDIAFOLD_MASTER", "local[8]")
    parts = shuffle_partitions or int(os.environ.get("MEDIAFOLD_SHUFFLE_PARTITIONS", "8"))
    builder = (
        SparkSession.builder.master(master)
        .appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.driver.memory", os.environ.get("MEDIAFOLD_DRIVER_MEMORY", "16g"))
        .config("spark.sql.files.maxPartitionBytes", str(64 * 1024 * 1024))
        # checkpoint files of unreferenced DataFrames are removed by the cleaner
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    for k, v in {**REQUIRED_CONF, **SCALE_CONF}.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return apply_settings(spark)


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster the platform sets it to shared storage and it is only read
    here.  Only when it is unset (tests, local bench) is a fresh local scratch
    folder created and registered.
    """
    sc = spark.sparkContext
    configured = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get(
        "spark.checkpoint.dir", None)
    if configured:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(configured)
        return configured
    current = sc.getCheckpointDir()
    if current:
        return current
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    path = tempfile.mkdtemp(prefix="mediafold-ckpt-")
    sc.setCheckpointDir(path)
    spark.conf.set("spark.checkpoint.dir", path)
    return path
