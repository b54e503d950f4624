"""The inbound stream: batches of messages, each with items of four kinds.

A source pushes JSON lines into a folder; every file is read once, a bounded number a
trigger, so a burst is held back by the source instead of by memory.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The kinds of an item in the order in which they are looked for.
KINDS = ("text", "voice", "file", "image")
MESSAGES = f"bot_id string, user_id string, seq long, items array<struct<{','.join(f'{k}:string' for k in KINDS)}>>"


def message_stream(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(MESSAGES).option("maxFilesPerTrigger", files_per_trigger).json(path)


def items(messages: DataFrame) -> DataFrame:
    """``(bot_id, user_id, seq, item_no, kind, body)``: one row an item; an item of no kind is left out."""
    rows = messages.select("bot_id", "user_id", "seq", F.posexplode("items").alias("item_no", "i"))
    found = F.coalesce(*(F.when(F.col(f"i.{k}").isNotNull(), F.struct(F.lit(k).alias("kind"), F.col(f"i.{k}").alias("body"))) for k in KINDS))
    return rows.withColumn("x", found).filter("x is not null").select("bot_id", "user_id", "seq", F.col("item_no").cast("long"), "x.kind", "x.body")
