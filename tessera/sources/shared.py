"""Tables between the rounds of an iterative plan, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; only where it is unset and Spark runs in one process a temporary folder of its own."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        own = tempfile.mkdtemp(prefix="tessera-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        sc.setCheckpointDir(own)
    return sc._jsc.sc().getCheckpointDir().get()


def stored(df: DataFrame, tag: str, before: DataFrame | None = None) -> DataFrame:
    """``df`` written once and read back, which cuts its lineage and outlives executors.

    ``before``: a table that this function stored and nothing reads any more; it is deleted.
    """
    spark = df.sparkSession
    path = f"{folder(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if before is not None:
        target = spark._jvm.org.apache.hadoop.fs.Path(_PATHS.pop(id(before), (before, ""))[1] or path + "-none")
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    out = spark.read.schema(df.schema).parquet(path)
    _PATHS[id(out)] = out, path
    return out


#: What was stored and not replaced, by the DataFrame that reads it.
_PATHS: dict[int, tuple[DataFrame, str]] = {}
