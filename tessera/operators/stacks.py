"""Stacks replayed in Spark: which row a pop takes, where rows can also leave from the middle.

A log is sorted into ranges of (key, id), so a key with very many rows spreads over many
tasks. Each task replays its ranges with a stack for one key at a time. What crosses the
begin of a range is joined afterwards: of each stretch of a key remain the pops that found
its own stack empty, and the rows left on it. A stretch's leftovers go down a tree of
neighbouring stretches; only as many rows are passed on as later pops can reach.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import stored

#: Stretches of a key that are joined in one round.
FAN = 64
NEVER = (1 << 63) - 1

Stack = list[tuple[int, int]]


def met(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A left join on ``keys`` in which nulls meet."""
    right = right.withColumnsRenamed({c: f"_{c}_2" for c in keys})
    same = F.lit(True)
    for c in keys:
        same &= F.col(c).eqNullSafe(F.col(f"_{c}_2"))
    return left.join(right, same, "left").drop(*(f"_{c}_2" for c in keys))


def popped(stack: Stack, at: int) -> int | None:
    """The newest row that is still there at ``at``; what left before goes as well."""
    while stack:
        row, gone = stack.pop()
        if gone > at:
            return row
    return None


def joined(stretches: Iterator[tuple[Sequence[int], Stack]], whole: bool) -> tuple[list[int], Stack, list[tuple[int, int]]]:
    """Neighbouring stretches as one: open pops, rows left, links found. ``whole``: nothing precedes them."""
    waiting: list[int] = []
    stack: Stack = []
    found = []
    for pops, rows in stretches:
        for at in pops:
            old = popped(stack, at)
            if old is not None:
                found.append((at, old))
            elif not whole:
                waiting.append(at)
        stack += rows
    return waiting, stack, found


def reachable(stack: Stack, pops: int) -> Stack:
    """The top of a stack that ``pops`` more pops can reach: as many rows that never leave, and all above them."""
    for k in range(len(stack) - 1, -1, -1):
        if pops <= 0:
            return stack[k + 1 :]
        pops -= stack[k][1] == NEVER
    return stack


COLUMNS = ["kind", "key", "part", "id", "old", "waiting", "rows", "gone"]
SCHEMA = "kind string, key string, part long, id long, old long, waiting array<long>, rows array<long>, gone array<long>"


def _part(key: str, part: int, waiting: Sequence[int], stack: Stack) -> tuple:
    return "part", key, part, 0, 0, list(waiting), [r for r, _ in stack], [g for _, g in stack]


def _replay(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One range: links found inside it, and a stretch of its first and its last key, which may go on elsewhere."""
    part, key, leads = TaskContext.get().partitionId(), None, True
    waiting: list[int] = []
    stack: Stack = []
    out: list[tuple] = []
    begun = False
    for frame in frames:
        for own, row, pops, gone in zip(*(frame[c].tolist() for c in ("key", "id", "pops", "gone")), strict=True):
            if not begun or own != key:
                if begun and leads:
                    out.append(_part(key, part, waiting, stack))
                leads, begun = not begun, True
                key, waiting, stack = own, [], []
            if pops:
                old = popped(stack, row)
                if old is not None:
                    out.append(("link", key, part, row, old, None, None, None))
                else:
                    waiting.append(row)
            stack.append((row, gone))
        yield pd.DataFrame(out, columns=COLUMNS, dtype=object)
        out = []
    if begun:
        yield pd.DataFrame([_part(key, part, waiting, stack)], columns=COLUMNS, dtype=object)


def _stretch(whole: bool):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("part")
        stretches = (
            (w, reachable(list(zip(r, g, strict=True)), later))
            for w, r, g, later in zip(frame["waiting"], frame["rows"], frame["gone"], frame["later"], strict=True)
        )
        waiting, stack, found = joined(stretches, whole)
        key, part = frame["key"].iloc[0], int(frame["part"].iloc[0])
        out = [("link", key, part, at, old, None, None, None) for at, old in found]
        if not whole:
            out.append(_part(key, part, waiting, stack))
        return pd.DataFrame(out, columns=COLUMNS, dtype=object)

    return run


def links(rows: DataFrame, keys: Sequence[str], fan: int = FAN) -> DataFrame:
    """``(keys, id, old)``: the row that each popping row takes off its key's stack before it goes on top itself.

    ``rows``: the keys, ``id`` (their order, unique in a key), ``pops``, ``gone`` (the point
    in that order at which the row leaves the stack wherever it is, or null).
    """
    key = F.to_json(F.struct(*keys), {"ignoreNullFields": "false"}).alias("key")
    told = rows.select(key, "id", "pops", F.coalesce("gone", F.lit(NEVER)).alias("gone"))
    found = stored(told.repartitionByRange("key", "id").sortWithinPartitions("key", "id").mapInPandas(_replay, SCHEMA), "replayed")
    pairs, parts = found.filter("kind = 'link'"), found.filter("kind = 'part'")
    tasks = (parts.agg(F.max("part")).first()[0] or 0) + 1
    while tasks > 1:
        # A row for each stretch of a key.
        sizes = parts.select("key", "part", F.size("waiting").alias("_w"))
        after = Window.partitionBy("key").orderBy("part").rowsBetween(1, Window.unboundedFollowing)
        later = sizes.select("key", "part", F.coalesce(F.sum("_w").over(after), F.lit(0)).alias("later"))
        whole = tasks <= fan
        parts = parts.join(later, ["key", "part"]).groupBy("key", F.floor(F.col("part") / fan).alias("to")).applyInPandas(_stretch(whole), SCHEMA)
        parts = stored(parts.withColumn("part", F.floor(F.col("part") / fan)), "stretches")
        pairs, parts, tasks = pairs.unionByName(parts.filter("kind = 'link'")), parts.filter("kind = 'part'"), -(-tasks // fan)
    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in keys)
    own = pairs.select(F.from_json("key", kinds).alias("k"), "id", "old")
    return own.select(*(F.col(f"k.{c}").alias(c) for c in keys), "id", "old")
