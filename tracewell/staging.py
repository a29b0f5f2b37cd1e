"""Where plans of many rounds are cut: tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own_folder: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or in tests a folder of this machine."""
    set_by_cluster = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if set_by_cluster:
        return set_by_cluster.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _own_folder.setdefault("path", "file://" + tempfile.mkdtemp(prefix="tracewell-"))


def own_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, with the scheme of the file system that Spark finds it in. All paths of an application lie in one folder, which goes when
    its driver ends."""
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/tracewell-library-{spark.sparkContext.applicationId}")
    folder = place.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(place).toString()
    if folder not in _own_folder.values():
        _own_folder[folder] = folder
        atexit.register(_remove, spark, folder, os.getpid())
    return f"{folder}/{name}-{uuid.uuid4().hex}"


def _remove(spark: SparkSession, path: str, owner: int | None = None) -> None:
    """Removes a path of the shared folder; does nothing in a process that only descends from the driver, or once the session is stopped."""
    if spark.sparkContext._jsc is None or owner not in (None, os.getpid()):
        return
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def cut(df: DataFrame) -> DataFrame:
    """Writes df as Parquet into the shared folder and returns the table read back: later rounds do not repeat its work."""
    path = own_path(df.sparkSession, "round")
    df.write.parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back.__dict__["_cut_at"] = path
    return back


def release(*tables: DataFrame) -> None:
    """Removes what `cut` wrote for these tables, once nothing that is still to run reads them."""
    for t in tables:
        if path := t.__dict__.get("_cut_at"):
            _remove(t.sparkSession, path)
