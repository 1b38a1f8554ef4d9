"""Spark session helpers.

All jobs share one set of session settings: UTC session time zone (week
arithmetic never depends on the machine zone), AQE with skew-join splitting,
and a reliable checkpoint directory.  The checkpoint directory is read from
the session (``spark.checkpoint.dir``, which a cluster points at shared
storage); a scratch directory is only created when the setting is absent,
as in local tests.
"""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "reviewloom", extra: dict | None = None) -> SparkSession:
    """Create (or fetch) a session with the engine's defaults."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint directory, creating a scratch one only
    when the session has none configured (local runs and tests)."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    try:
        sc = spark.sparkContext
    except Exception:  # Spark Connect: no SparkContext on the client
        sc = None
    if sc is not None:
        current = sc.getCheckpointDir()
        if current:
            return current
        configured = configured or sc.getConf().get("spark.checkpoint.dir", None)
        if configured:
            sc.setCheckpointDir(configured)
            return sc.getCheckpointDir()
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        scratch = tempfile.mkdtemp(prefix="reviewloom-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
        sc.setCheckpointDir(scratch)
        return sc.getCheckpointDir()
    if not configured:
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return configured


def materialize(df: DataFrame) -> DataFrame:
    """Cut lineage by writing ``df`` as a parquet table in the shared
    checkpoint directory and reading it back.  Parquet is columnar and
    compressed, so this is much cheaper than an RDD checkpoint of rows for
    wide text/array columns; a lost executor does not lose the table."""
    spark = df.sparkSession
    base = ensure_checkpoint_dir(spark).rstrip("/")
    path = f"{base}/tables/{uuid.uuid4().hex}"
    # modest row groups keep the scratch table splittable, so re-reads of a
    # table written by few tasks still spread over all cores
    df.write.mode("overwrite").option("parquet.block.size", 8 * 1024 * 1024).parquet(path)
    return spark.read.parquet(path)


_SHIPPED: set = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``reviewloom`` importable in the Python workers (the Arrow UDFs
    call its helpers), like ``--py-files``: zip the package once per session
    and add it with ``addPyFile`` (``addArtifacts`` under Spark Connect)."""
    try:
        sc = spark.sparkContext
    except Exception:  # Spark Connect
        sc = None
    key = ("sc", sc.applicationId) if sc is not None else ("connect", id(spark))
    if key in _SHIPPED:
        return
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    out = os.path.join(tempfile.mkdtemp(prefix="reviewloom-pkg-"), "reviewloom.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for root, _, files in os.walk(pkg_dir):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(root, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(pkg_dir)))
    if sc is not None:
        sc.addPyFile(out)
    else:
        spark.addArtifacts(out, pyfile=True)
    _SHIPPED.add(key)


def apply_session_defaults(spark: SparkSession) -> None:
    """Apply the runtime-settable defaults to an existing session (e.g. one the
    caller created) without touching the cluster-level settings."""
    for k in ("spark.sql.session.timeZone", "spark.sql.adaptive.enabled",
              "spark.sql.adaptive.skewJoin.enabled",
              "spark.sql.execution.arrow.pyspark.enabled"):
        try:
            spark.conf.set(k, DEFAULT_CONF[k])
        except Exception:  # pragma: no cover - static conf on some deployments
            pass
    ensure_checkpoint_dir(spark)
    ship_package(spark)
