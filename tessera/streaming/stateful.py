"""Streaming forms of the ordered operators.

Windows by session and deduplication are Spark's own. Failure streaks and turn
counters keep a few numbers per key in state; rows of a micro-batch are put in
order by their sequence number before they change the state.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def sessions(stream: DataFrame, key: str, ts: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Write sessions, emitted once the watermark has passed their end."""
    rows = stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    return rows.groupBy(key, F.session_window(ts, gap).alias("w")).agg(F.count("*").alias("writes")).select(
        key, F.col("w.start").alias("first_write"), F.col("w.end").alias("expires"), "writes"
    )


def dedupe(stream: DataFrame, keys: list[str], ts: str, late: str = "1 hour") -> DataFrame:
    return stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def failure_streaks(stream: DataFrame, key: str, order: str, failed: str, n: int = 10) -> DataFrame:
    """Rows at which a run of failures reaches ``n``; the run then starts anew."""

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        (count,) = state.get if state.exists else (0,)
        out = []
        rows = pd.concat(list(batches)).sort_values(order)
        for at, bad in zip(rows[order], rows[failed], strict=True):
            count = count + 1 if bad else 0
            if count == n:
                out.append((k[0], at, n))
                count = 0
        state.update((count,))
        yield pd.DataFrame(out, columns=["bot_id", "seq", "run"]).astype({"bot_id": "int64", "seq": "int64", "run": "int64"})

    return (
        stream.select(F.col(key).cast("long"), F.col(order).cast("long"), failed)
        .groupBy(key)
        .applyInPandasWithState(run, "bot_id long, seq long, run long", "count int", "append", GroupStateTimeout.NoTimeout)
    )


def turn_counter(stream: DataFrame, key: str, order: str, every: int = 10) -> DataFrame:
    """Rows at which a key's turn number is a multiple of ``every``."""

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        (turn,) = state.get if state.exists else (0,)
        rows = pd.concat(list(batches)).sort_values(order)
        numbers = range(turn + 1, turn + len(rows) + 1)
        state.update((turn + len(rows),))
        out = pd.DataFrame({"user_id": k[0], "id": rows[order].to_numpy(), "turn_no": list(numbers)})
        yield out[out["turn_no"] % every == 0].astype("int64")

    return (
        stream.select(F.col(key).cast("long"), F.col(order).cast("long"))
        .groupBy(key)
        .applyInPandasWithState(run, "user_id long, id long, turn_no long", "turn int", "append", GroupStateTimeout.NoTimeout)
    )


def in_order(stream: DataFrame, key: str, order: str, value: str, first: int = 0) -> DataFrame:
    """Rows of each key in the order of their gapless sequence numbers, also across micro-batches.

    A row that comes early is held until all before it have come; repeated rows and
    those before ``first`` are dropped. A consumer of the result sees each key as a
    single worker would: one row after the other.
    """

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        expected, numbers, texts = state.get if state.exists else (first, [], [])
        held = dict(zip(numbers, texts, strict=True))
        for rows in batches:
            for n, text in zip(rows[order], rows[value], strict=True):
                if n >= expected:
                    held.setdefault(int(n), text)
        out = []
        while expected in held:
            out.append((k[0], expected, held.pop(expected)))
            expected += 1
        state.update((expected, sorted(held), [held[n] for n in sorted(held)]))
        yield pd.DataFrame(out, columns=["key", "seq", "value"]).astype({"key": "int64", "seq": "int64"})

    return (
        stream.select(F.col(key).cast("long").alias(key), F.col(order).cast("long").alias(order), F.col(value).cast("string").alias(value))
        .groupBy(key)
        .applyInPandasWithState(
            run, "key long, seq long, value string", "expected long, numbers array<long>, texts array<string>", "append", GroupStateTimeout.NoTimeout
        )
    )


def _queue(limit: int):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        held, out = 0, []
        for seq, arrives in zip(*(rows.sort_values("seq")[c] for c in ("seq", "arrives")), strict=True):
            if not arrives:
                held = max(held - 1, 0)
            else:
                out.append((key[0], seq, held < limit))
                held += held < limit
        return pd.DataFrame(out, columns=["bot_id", "seq", "accepted"]).astype({"bot_id": "int64", "seq": "int64", "accepted": "bool"})

    return run


def bounded_queue(events: DataFrame, limit: int = 100) -> DataFrame:
    """Replay of ``(bot_id, seq, arrives)``: arrivals at a full queue are dropped, other events take one row out.

    Spark's own triggers hold back instead of dropping; this is the discrete
    simulation of a queue that drops its newest.
    """
    return events.groupBy("bot_id").applyInPandas(_queue(limit), "bot_id long, seq long, accepted boolean")
