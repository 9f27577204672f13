"""Sessions for local use, and the shared folder for written intermediates."""

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def local_session(cpus: str = "8", shuffle_partitions: int = 8, name: str = "titrant") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "12g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("WARN")
    return spark


def shared_root(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir; a local one only where none is set."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.sparkContext.getCheckpointDir()
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir names no shared folder, and executors cannot share a local one")
        root = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(root)
    return root


def new_folder(spark: SparkSession, label: str) -> str:
    """A fresh path under the shared folder; nothing is created until a job writes there."""
    return f"{shared_root(spark).rstrip('/')}/titrant/{label}-{uuid.uuid4().hex}"


_KEPT: list = []


def keep(df):
    """Persist a table that several branches of one plan read. Lost parts are recomputed from their
    lineage; `release` frees everything kept so far."""
    _KEPT.append(df.persist())
    return df


def release() -> None:
    while _KEPT:
        _KEPT.pop().unpersist()
