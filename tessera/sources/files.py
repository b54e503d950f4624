"""File sources: text of binary files, JSON message logs, CSV sheets, guarded paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_messages(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON lines with a declared schema; broken lines end in ``_corrupt_record``."""
    full = T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])
    return spark.read.schema(full).option("mode", "PERMISSIVE").json(path)


def read_text_heads(spark: SparkSession, path: str, chars: int = 2000) -> DataFrame:
    """Path, size and the first characters of each text file."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", "length", F.substring(F.col("content").cast("string"), 1, chars).alias("head"))


def read_sheet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", "true").csv(path)


def inside(folder: str, name: Column) -> Column:
    """The file's path, null where the name leads out of ``folder``."""
    bad = name.contains("..") | name.startswith("/") | name.contains("\\") | name.contains("\x00")
    return F.when(~bad, F.concat(F.lit(folder.rstrip("/") + "/"), name))
