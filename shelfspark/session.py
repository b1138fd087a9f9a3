"""Session settings and the shared folder every job writes its working data to."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

# Runtime settings the library's results or its behaviour under skew depend on.
RUNTIME_CONF = {
    # later map keys replace earlier ones, in the place of the first
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.session.timeZone": "UTC",
    # hot join keys: split the big side's partition, even if that adds a shuffle later
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # pages are wide: keep Arrow batches small in rows and in bytes
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(32 << 20),
}

_OWN_FOLDER: str | None = None


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session that somebody else built."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def build(app: str = "shelfspark", master: str | None = None, **conf: str) -> SparkSession:
    """Build a configured session; on a cluster leave ``master`` to spark-submit."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return configure(builder.getOrCreate())


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can read: ``spark.checkpoint.dir`` of the session.

    Only a local session (tests) may go without; it gets a temporary folder of its own.
    """
    global _OWN_FOLDER
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder every executor can reach")
    if _OWN_FOLDER is None:
        _OWN_FOLDER = tempfile.mkdtemp(prefix="shelfspark-")
    return _OWN_FOLDER


def drop_scratch(spark: SparkSession, path: str) -> None:
    """Remove a folder that ``scratch`` named, once nothing reads it any more."""
    if not path.startswith(shared_dir(spark) + "/"):
        raise ValueError(f"{path} is not in the shared folder")
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder; nothing is created or deleted here."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex[:12]}"
