"""Tables settled in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: The folder of each application on a local master.
_OWN: dict[str, str] = {}


def new_path(spark: SparkSession, label: str) -> str:
    """A new path under spark.checkpoint.dir; where that is unset, under /tmp on a local master and an error elsewhere."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        base = _OWN.get(app) or _OWN.setdefault(app, "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def settled(rows: DataFrame, label: str) -> DataFrame:
    """rows, written and read back: what depends on how rows were dealt out stays as it is if an executor is lost."""
    path = new_path(rows.sparkSession, label)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def discard(rows: DataFrame) -> None:
    """Deletes the files of a table made by ``settled`` once nothing reads it any more."""
    spark = rows.sparkSession
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for parent in {f.rsplit("/", 1)[0] for f in rows.inputFiles()}:
        at = path(parent)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
