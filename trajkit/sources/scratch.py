"""The folder that the driver and all executors share, for intermediate files."""

from __future__ import annotations

import atexit
import re
import tempfile

from pyspark.sql import SparkSession

_own_folder: list[str] = []
_deleted_at_end: set[str] = set()


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, as the cluster names it in spark.checkpoint.dir.

    Where that is unset and all runs in one process, as in tests, a folder of this process's own is used. Executors of their
    own would write to their own disks, and the driver would miss their files: there RuntimeError is raised.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder.rstrip("/")
    master = spark.sparkContext.master
    if not re.fullmatch(r"local(\[[^\]]*\])?", master):
        raise RuntimeError(f"set spark.checkpoint.dir to a folder that all executors share; the master is {master}")
    if not _own_folder:
        keep = tempfile.TemporaryDirectory(prefix="trajkit-")
        atexit.register(keep.cleanup)
        _own_folder.append(f"file://{keep.name}")
    return _own_folder[0]


def own_folder(spark: SparkSession) -> str:
    """This application's part of the shared folder; see delete_at_end()."""
    return f"{shared_folder(spark)}/trajkit/{spark.sparkContext.applicationId}"


def delete_at_end(spark: SparkSession) -> None:
    """Have the driver's JVM delete own_folder() when it ends. The folder must exist."""
    folder = own_folder(spark)
    if folder not in _deleted_at_end:
        at = spark._jvm.org.apache.hadoop.fs.Path(folder)
        if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at):
            _deleted_at_end.add(folder)
