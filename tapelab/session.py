"""Session helpers.

A cluster hands its own session in; ``local_session`` is for tests and the bench.
"""

from __future__ import annotations

import atexit
import functools
import os
import shutil
import tempfile
import uuid
from urllib.parse import urlsplit

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = 8, app: str = "tapelab") -> SparkSession:
    """A local session with the settings the operators are tested under."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("TAPELAB_DRIVER_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    A local session that names none gets one private folder, removed when the process ends; a cluster must name one, as
    its executors do not see each other's disks.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir is not set: name a folder that all executors share")
    return _private_folder()


@functools.cache
def _private_folder() -> str:
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder under the shared folder the cluster names."""
    return f"{checkpoint_dir(spark)}/tapelab-{name}-{uuid.uuid4().hex}"


def mounted(path: str) -> str:
    """A folder of the shared storage as a path that workers can map into memory."""
    found = urlsplit(path)
    if found.scheme not in ("", "file"):
        raise ValueError(f"{path}: its files are memory-mapped; name a mounted shared folder in spark.checkpoint.dir")
    return found.path


def settle(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Writes an intermediate table once (to ``path``, if it is to be removed later) and reads it back.

    For a costly input that a plan would otherwise recompute at every use. The table lies in
    shared storage, so a lost executor costs a read and not the computation.
    """
    path = path or scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of one task where the number of tasks follows the input (``tasks_for``).
ROWS = 500_000


def tasks_for(scan: DataFrame) -> int:
    """Partitions of about ``ROWS`` rows, and one for every core at least, for operators that hold a partition in memory.

    The rows are counted, which for a scan reads the files' footers only.
    """
    return max(scan.sparkSession.sparkContext.defaultParallelism, -(-scan.count() // ROWS))


def spread(scan: DataFrame) -> DataFrame:
    """A scan with its rows dealt to all cores where it has fewer partitions than cores, else as it is.

    For costly row functions over files of one or a few row groups, which one task each would read and work on; a table of many files is
    left alone.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan
