"""Operators that keep more than a number for each key: a cache whose entries expire, and stacks that rows can leave from the middle.

Both use Spark's keyed state with named variables, which the RocksDB state store holds
on disk; call ``keep_state_on_disk`` before such a stream is started.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


def keep_state_on_disk(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class _Cache(StatefulProcessor):
    """One entry a key. A write starts its time anew, a read does not; a timer drops what has expired."""

    def __init__(self, ttl_us: int) -> None:
        self.ttl_us = ttl_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entry = handle.getValueState("entry", "value string, written_us long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows))
        frame = frame.sort_values(["us", "reads", "value"])
        entry, changed, out = self.entry.get() if self.entry.exists() else None, False, []
        for us, reads, value in zip(frame["us"].tolist(), frame["reads"].tolist(), frame["value"].tolist(), strict=True):
            if reads:
                live = entry is not None and 0 <= us - entry[1] < self.ttl_us
                out.append((key[0], us, live, entry[0] if live else None))
            elif entry is None or us >= entry[1]:
                entry, changed = (value, us), True
        if changed:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.entry.update(entry)
            self.handle.registerTimer((entry[1] + self.ttl_us) // 1000 + 1)
        yield pd.DataFrame(out, columns=["key", "us", "hit", "value"], dtype=object).astype({"us": "int64", "hit": "bool"})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.entry.clear()
        yield from ()

    def close(self) -> None:
        pass


def cache_reads(stream: DataFrame, ttl_minutes: int = 30, late: str = "1 hour") -> DataFrame:
    """``(key, read_at, hit, value)`` of each read of a stream ``(key string, at timestamp, reads boolean, value string)``.

    The answers of ``sinks.cache_reads`` in batch, as long as a key's rows do not come in a
    later micro-batch than newer ones; rows behind the watermark are dropped.
    """
    rows = stream.select(F.col("key").cast("string").alias("key"), F.col("at").cast("timestamp").alias("at"), "reads", "value")
    rows = rows.withWatermark("at", late).withColumn("us", F.unix_micros("at"))
    found = rows.groupBy("key").transformWithStateInPandas(
        _Cache(60_000_000 * ttl_minutes), "key string, us long, hit boolean, value string", "append", "EventTime"
    )
    return found.select("key", F.timestamp_micros("us").alias("read_at"), "hit", "value")


class _Stack(StatefulProcessor):
    """A key's stack as a map from place to row, beside the place of each row: every step is a few look-ups, whatever its height."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.height = handle.getValueState("height", "height long")
        self.rows = handle.getMapState("rows", "place long", "id long")
        self.places = handle.getMapState("places", "id long", "place long")

    def leave(self, place: int, row: int) -> None:
        self.rows.removeKey((place,))
        self.places.removeKey((row,))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows)).sort_values(["id", "action"])
        height, out = self.height.get()[0] if self.height.exists() else 0, []
        for i, action, target in zip(frame["id"].tolist(), frame["action"].tolist(), frame["target"].tolist(), strict=True):
            if action == "delete":
                if self.places.containsKey((target,)):
                    self.leave(self.places.getValue((target,))[0], target)
                    out.append((*key, target, "deleted", None, i))
            elif action != "skip":
                old = None
                if action == "supersede":
                    # Places that were left from the middle are gone.
                    while height and not self.rows.containsKey((height,)):
                        height -= 1
                    if height:
                        (old,) = self.rows.getValue((height,))
                        self.leave(height, old)
                        out.append((*key, old, "superseded", None, i))
                        height -= 1
                height += 1
                self.rows.updateValue((height,), (i,))
                self.places.updateValue((i,), (height,))
                out.append((*key, i, "active", old, i))
        self.height.update((height,))
        names = ["user_id", "dimension", "id", "status", "supersedes_id", "at"]
        yield pd.DataFrame(out, columns=names, dtype=object).astype({"supersedes_id": "Int64", "id": "int64", "at": "int64"})

    def close(self) -> None:
        pass


def stack_changes(stream: DataFrame) -> DataFrame:
    """``(user_id, dimension, id, status, supersedes_id, at)``: what each row of a memory log changes, as it comes.

    A row's last change is its status in ``memory.supersede_with_deletes``; keys' rows come in order.
    """
    rows = stream.select(F.col("user_id").cast("string"), "dimension", "id", "action", F.coalesce("target", F.lit(-1)).alias("target"))
    schema = "user_id string, dimension string, id long, status string, supersedes_id long, at long"
    return rows.groupBy("user_id", "dimension").transformWithStateInPandas(_Stack(), schema, "append", "None")
