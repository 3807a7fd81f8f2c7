"""Spark session helpers.

Every operator in this package is a table-in / table-out function over an existing
``SparkSession``; nothing here starts a cluster.  ``get_session`` exists for tests,
the bench and the command line, and only sets options that are still unset so a
cluster's own settings (shuffle partitions, checkpoint folder, ...) always win.
"""
from __future__ import annotations

import io
import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

# Options applied only when the session does not define them already.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Runtime (post-shuffle) broadcast only for sides proven small by AQE stats.
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "32MB",
    "spark.sql.autoBroadcastJoinThreshold": "32MB",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.files.maxPartitionBytes": "128MB",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "ledgerlens") -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    builder = builder.config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
    if shuffle_partitions is not None:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    for key, value in DEFAULT_CONF.items():
        if spark.conf.get(key, None) in (None, ""):
            spark.conf.set(key, value)
    ensure_checkpoint_dir(spark)
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    A cluster names a shared folder there; we read it from the session.  Only when
    it is unset (local tests) do we pick a fresh scratch folder of our own; on a cluster that is an error.
    """
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 - sessions without a context handle (e.g. Connect)
        sc = None
    current = sc.getCheckpointDir() if sc is not None else None
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured and sc is not None:
        configured = sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        if sc is not None and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        configured = tempfile.mkdtemp(prefix="ledgerlens-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
        if sc is None:
            spark.conf.set("spark.checkpoint.dir", configured)
    if sc is None:
        return configured
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, once per application, so that Python functions can
    be loaded there whatever folder or ``PYTHONPATH`` the workers start with."""
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 - a session without a context handle ships by artifacts
        sc = None
    app = sc.applicationId if sc is not None else str(id(spark))
    if app in _SHIPPED:
        return
    here = os.path.dirname(os.path.abspath(__file__))
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z:
        for top, _, names in os.walk(here):
            for name in sorted(names):
                if name.endswith(".py"):
                    z.write(os.path.join(top, name), os.path.relpath(os.path.join(top, name), os.path.dirname(here)))
    path = os.path.join(tempfile.mkdtemp(prefix="ledgerlens-"), "ledgerlens.zip")
    with open(path, "wb") as f:
        f.write(packed.getvalue())
    sc.addPyFile(path) if sc is not None else spark.addArtifacts(path, pyfile=True)
    _SHIPPED.add(app)


def checkpoint_path(spark: SparkSession, name: str) -> str:
    """A sub-folder of the shared checkpoint folder for written tables / stream state."""
    base = ensure_checkpoint_dir(spark)
    return base.rstrip("/") + "/" + name


def spread(df):
    """``df`` dealt evenly over the session's shuffle partitions, for expensive per-row work (regex
    cascades, JSON parsing) behind a scan of few, large row groups.  Building the plan runs no job."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
