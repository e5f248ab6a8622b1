"""Results that several later steps read are written once, to the cluster's shared folder.

The folder is the one that spark.checkpoint.dir names. Where none is set, a local
session (as in tests) gets a folder of its own; on a cluster that is an error, as
executors would each write to a disk of their own. What the library has put there
is removed when the Python session ends.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from .errors import StorageError

_made: list[tuple[SparkSession, str]] = []


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or a folder of our own where it is unset and the session is local."""
    sc = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not where:
        if not (sc.master or "").startswith("local[") and sc.master != "local":
            raise StorageError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = tempfile.mkdtemp(prefix="bandloom-ckpt-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(where)
    return where


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; what is there at the end of the session is removed."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if not _made:
        atexit.register(clear)
    _made.append((spark, path))
    return path


def clear(spark: SparkSession | None = None) -> None:
    """Remove the paths of shared_folder (of one session, or of all), where the session still runs."""
    for own, path in list(_made):
        if spark is not None and own is not spark:
            continue
        _made.remove((own, path))
        try:
            jvm, conf = own.sparkContext._jvm, own.sparkContext._jsc.hadoopConfiguration()
            place = jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(conf).delete(place, True)
        except Exception:  # noqa: BLE001  the session has ended; its folder is the cluster's to clear
            continue


def written(df: DataFrame) -> DataFrame:
    """A checkpoint: lineage is cut, and lost executors cost no recomputation."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """A Parquet table in the shared folder: as written(), for tables that are read in parts."""
    path = shared_folder(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)
