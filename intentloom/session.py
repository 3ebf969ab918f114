"""Session helpers."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def build_session(app: str = "intentloom", **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; `conf` goes on top."""
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def work_folder(spark: SparkSession, what: str) -> str:
    """A new folder for tables and checkpoints: in the cluster's shared checkpoint folder, or a temporary one where none is set and the master is local."""
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        shared = tempfile.mkdtemp(prefix="spark-")
    return f"{shared}/{what}-{uuid.uuid4().hex}"


def _place(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def has_files(spark: SparkSession, path: str, marker: bool = False) -> bool:
    """Whether a table has been written at `path`, in whatever store that is; with `marker`, whether just that file is there."""
    place, files = _place(spark, path)
    if marker:
        return files.exists(place)
    return files.exists(place) and any(not s.getPath().getName().startswith(("_", ".")) for s in files.listStatus(place))


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a table's files, if there are any."""
    place, files = _place(spark, path)
    if files.exists(place):
        files.delete(place, True)
