"""Session construction and the few cluster-level settings the jobs rely on."""

from __future__ import annotations

import os
import re
import shutil
import tempfile

from pyspark.sql import SparkSession


def get_spark(app: str = "quarry", master: str | None = None,
              shuffle_partitions: int | None = None) -> SparkSession:
    """Build (or reuse) a session tuned for these jobs.

    On a cluster ``master`` stays None and the launcher decides; ``shuffle_partitions``
    should then be sized so one shuffle partition is ~128-256 MB of shuffle data.
    AQE coalesces the tiny partitions that the small query-side tables produce.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = {
        "spark.ui.enabled": "false",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    if master and master.startswith("local"):
        conf["spark.driver.host"] = "127.0.0.1"
        conf["spark.driver.bindAddress"] = "127.0.0.1"
        conf.setdefault("spark.driver.memory", os.environ.get("QUARRY_DRIVER_MEMORY", "16g"))
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    bound_batches(spark)
    ship_package(spark)
    return spark


#: Rows and bytes of an Arrow batch at most. Rows are whole texts, of which Python holds several copies as objects.
BATCH_ROWS, BATCH_BYTES = 500, 4 << 20


def bound_batches(spark: SparkSession) -> None:
    """Keep what a Python worker holds at once small, also in a session that was not made here."""
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{name}"
        try:
            now = int(re.match(r"-?\d+", spark.conf.get(key)).group())
        except Exception:  # noqa: BLE001 - a setting that this version lacks
            continue
        if now <= 0 or now > most:
            spark.conf.set(key, str(most))


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, so that they need not have it on their path."""
    root = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="quarry-package-")          # on the driver only; Spark passes the file on
    archive = shutil.make_archive(os.path.join(folder, "quarry"), "zip", os.path.dirname(root), os.path.basename(root))
    spark.sparkContext.addPyFile(archive)


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by the cluster in ``spark.checkpoint.dir``.

    Where the setting is absent, a local session (as in tests) gets a scratch folder; on a cluster
    executors would each write to their own disk, so that is an error.
    """
    sc = spark.sparkContext
    d = sc.getCheckpointDir()
    if d:
        return d
    d = sc.getConf().get("spark.checkpoint.dir", None)
    if not d:
        try:
            d = spark.conf.get("spark.checkpoint.dir")
        except Exception:  # noqa: BLE001 - unset key
            d = None
    if not d:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        d = tempfile.mkdtemp(prefix="quarry-ckpt-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", d)
    sc.setCheckpointDir(d)
    return sc.getCheckpointDir() or d


def scratch_path(spark: SparkSession, name: str) -> str:
    """A sub-path of the shared checkpoint folder for written intermediate tables."""
    base = checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}"
