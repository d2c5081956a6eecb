"""Spark session settings used by tests, the bench and the entry points.

On a cluster the session already exists and carries its own settings; the
helpers here only fill in what is unset, so nothing overrides the cluster's
choice of shuffle partitions, checkpoint folder or memory.
"""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.sql import SparkSession

# Settings every job relies on for correct results.
REQUIRED_CONF = {
    # Chart dates are wall-clock values; keep them zone-free.
    "spark.sql.session.timeZone": "UTC",
}

# Bytes of rows that go to a Python worker at a time.
BATCH_BYTES = 2 << 20

# Settings for speed and for skew; safe at any scale.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.localShuffleReader.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(
    app: str = "salesops",
    master: str | None = None,
    shuffle_partitions: int | None = None,
    extra: dict[str, str] | None = None,
) -> SparkSession:
    """Get or create a session with the library's settings.

    ``master`` and ``shuffle_partitions`` are for local runs (tests, bench);
    leave them ``None`` on a cluster.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = {**DEFAULT_CONF, **REQUIRED_CONF}
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    for key, value in REQUIRED_CONF.items():
        spark.conf.set(key, value)
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder the cluster names in ``spark.checkpoint.dir``.

    Read from the session. Where it is unset, only a local session (tests, the
    bench) gets a scratch folder of its own; on a cluster that is an error, as a
    machine-local folder would be lost with its machine.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    current = sc.getCheckpointDir()
    if configured:
        if not current:
            sc.setCheckpointDir(configured)  # named by the cluster, not yet registered with the context
        return configured
    if current:
        return current
    if not (sc.master == "local" or sc.master.startswith("local[")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    local = tempfile.mkdtemp(prefix="salesops-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    spark.conf.set("spark.checkpoint.dir", local)
    spark.sparkContext.setCheckpointDir(local)
    return local


def bound_batches(spark: SparkSession, most: int = BATCH_BYTES) -> None:
    """Send rows to Python workers in Arrow batches of about ``most`` bytes.

    Spark's 10,000 rows are tens of MB of texts, which the executor and the
    worker both hold. A bound that the session already has is kept; a longer row
    is a batch of its own.
    """
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(most))


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors through Spark's own file server.

    Python workers import the functions they run by name, so a cluster whose
    machines lack the repository needs the code; done once per application.
    """
    sc = spark.sparkContext
    if getattr(sc, "_salesops_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    if not os.path.isdir(os.path.join(root, "salesops")):  # already running from an archive
        return
    stem = os.path.join(tempfile.mkdtemp(prefix="salesops-code-"), "salesops_code")
    sc.addPyFile(shutil.make_archive(stem, "zip", root_dir=root, base_dir="salesops"))
    sc._salesops_shipped = True
