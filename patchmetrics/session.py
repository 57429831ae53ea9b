"""Spark session helpers.

The library never creates its own session inside an operator; these helpers are for scripts, tests and the bench.
Cluster settings (master, memory, ``spark.checkpoint.dir``) come from the submitting environment. A checkpoint
folder is only invented when none is configured *and* the master is local (tests, bench on one machine).
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile

from pyspark.sql import SparkSession

# Settings every session of ours wants; the cluster may override any of them.
DEFAULT_CONF = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Spark's own size rules decide broadcasts; operators store small lookup sides first, so that their size is known.
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "10MB",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Skip per-Column Python call-site capture (only used to decorate error messages); it dominates the
    # construction time of wide plans such as the KPI report.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    # Document-sized rows: keep Arrow batches small for the Python jobs.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1024",
}


def build_session(master: str | None = None, app: str = "patchmetrics", shuffle_partitions: int | None = None,
                  extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app)
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
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the session's checkpoint folder, setting a scratch one only for local masters.

    On a cluster the folder must be shared storage named by ``spark.checkpoint.dir``; we never pick a
    machine-local folder there.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir()
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir is not set; point it at shared storage (HDFS/S3/ABFS)")
    path = tempfile.mkdtemp(prefix="pm-ckpt-", dir=os.environ.get("PM_SCRATCH", "/tmp"))
    sc.setCheckpointDir(path)
    return sc.getCheckpointDir()


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors (``addPyFile``), for sessions whose workers cannot import it.

    Needed when the package is only on the driver's ``sys.path``; with an installed wheel, ``--py-files`` or
    ``PYTHONPATH`` on the workers there is nothing to do.
    """
    here = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="pm-ship-")     # Spark's file server reads it until the driver ends
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    spark.sparkContext.addPyFile(shutil.make_archive(os.path.join(folder, "patchmetrics"), "zip", os.path.dirname(here),
                                                     os.path.basename(here)))
