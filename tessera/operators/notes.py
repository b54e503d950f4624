"""A user's notes as calls that write, list and delete, replayed in the order of their numbers.

A list has to show the newest notes that are there at its moment. Calls are sorted into
ranges of (user, call), so that a user with very many calls spreads over many tasks; each
task answers lists from the notes of its own range. Where those are too few, the notes that
the range began with complete the list: of each range only the top of its notes is handed
on, down to as many notes that are never deleted as a list shows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import trim
from ..sources.shared import stored
from .stacks import NEVER, met, reachable

SHOWN = 50
# The answers.
WRITTEN = '{"success": true, "note_id": %s, "message": "已记住，后续对话会自动参考该笔记"}'
LISTED, DELETED = '{"success": true, "notes": %s}', '{"success": true, "message": "笔记已删除"}'
NO_USER, NO_CONTENT, NO_ID = '{"error": "缺少用户上下文，无法操作记忆"}', '{"error": "content 不能为空"}', '{"error": "note_id 无效"}'
UNKNOWN, BROKEN = '{"error": "不支持的操作: %s，可用操作: write/list/delete"}', '{"error": "笔记操作异常"}'


def parsed(calls: DataFrame) -> DataFrame:
    """``calls (call_id, user_id, args)`` with ``kind`` (write, list, delete, or the answer's error), ``content`` and ``target``."""
    args = F.from_json("args", "operation string, content string, note_id string")
    rows = calls.select("call_id", F.col("user_id").cast("string").alias("user_id"), "args", args.alias("a"))
    operation = trim(F.coalesce("a.operation", F.lit("")))
    content = trim(F.coalesce("a.content", F.lit("")))
    target = F.coalesce(F.expr("try_cast(a.note_id as bigint)"), F.lit(-1))
    broken = F.expr("try_parse_json(args)").isNull()
    blank_user = F.coalesce(trim(F.col("user_id")) == "", F.lit(True))
    kind = (
        F.when(broken, "broken").when(blank_user, "no user")
        .when(operation == "write", F.when(content == "", "no content").otherwise("write"))
        .when(operation == "list", "list")
        .when(operation == "delete", F.when(target <= 0, "no id").otherwise("delete"))
        .otherwise("unknown")
    )
    return rows.select("call_id", "user_id", kind.alias("kind"), operation.alias("operation"), content.alias("content"), target.alias("target"))


def _newest(stack: list[tuple[int, int]], at: int, shown: int) -> list[int]:
    """The newest notes there at ``at``. Those deleted before leave the stack for good, so each is met once."""
    kept, out = [], []
    while stack and len(out) < shown:
        note, gone = stack.pop()
        if gone > at:
            kept.append((note, gone))
            out.append(note)
    stack.extend(reversed(kept))
    return out


COLUMNS = ["kind", "user_id", "part", "call_id", "notes", "gone"]
SCHEMA = "kind string, user_id string, part long, call_id long, notes array<long>, gone array<long>"


def _replay(shown: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Lists of one range from its own notes, and the top of each user's notes at its end."""
        part, user, begun = TaskContext.get().partitionId(), None, False
        stack: list[tuple[int, int]] = []
        for frame in frames:
            out: list[tuple] = []
            for own, call, kind, gone in zip(*(frame[c].tolist() for c in ("user_id", "call_id", "kind", "gone")), strict=True):
                if not begun or own != user:
                    if begun:
                        out.append(_top(user, part, stack, shown))
                    begun, user, stack = True, own, []
                if kind == "write":
                    stack.append((call, gone))
                else:
                    out.append(("list", own, part, call, _newest(stack, call, shown), None))
            yield pd.DataFrame(out, columns=COLUMNS, dtype=object)
        if begun:
            yield pd.DataFrame([_top(user, part, stack, shown)], columns=COLUMNS, dtype=object)

    return run


def _top(user: str, part: int, stack: list[tuple[int, int]], shown: int) -> tuple:
    top = reachable(stack, shown)
    return "top", user, part, 0, [n for n, _ in top], [g for _, g in top]


def _carried(shown: int):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        """What each range of a user begins with, newest first."""
        frame, stack, out = frame.sort_values("part"), [], []
        for part, notes, gone in zip(frame["part"].tolist(), frame["notes"], frame["gone"], strict=True):
            out.append((frame["user_id"].iloc[0], part, [n for n, _ in reversed(stack)], [g for _, g in reversed(stack)]))
            stack = reachable(stack + list(zip(notes, gone, strict=True)), shown)
        return pd.DataFrame(out, columns=["user_id", "part", "before", "gone"], dtype=object)

    return run


def shown_notes(rows: DataFrame, shown: int = SHOWN) -> DataFrame:
    """``(user_id, call_id, notes)`` of each list call of ``parsed`` calls: ids of the newest notes there then."""
    deleted = rows.filter("kind = 'delete' and call_id > target").groupBy("user_id", F.col("target").alias("call_id")).agg(F.min("call_id").alias("gone"))
    told = met(rows.filter("kind in ('write', 'list')").select("user_id", "call_id", "kind"), deleted, ["user_id", "call_id"])
    told = told.withColumn("gone", F.coalesce("gone", F.lit(NEVER)))
    ranged = told.repartitionByRange("user_id", "call_id").sortWithinPartitions("user_id", "call_id")
    found = stored(ranged.mapInPandas(_replay(shown), SCHEMA), "notes")
    # A row for each range that a user has, with the few notes that it hands on.
    before = found.filter("kind = 'top'").groupBy("user_id").applyInPandas(_carried(shown), "user_id string, part long, before array<long>, gone array<long>")
    lists = found.filter("kind = 'list'").select("user_id", "part", "call_id", "notes").join(before, ["user_id", "part"])
    older = F.filter(F.arrays_zip("before", "gone"), lambda x: x["gone"] > F.col("call_id"))
    older = F.transform(older, lambda x: x["before"])
    return lists.select("user_id", "call_id", F.slice(F.concat("notes", older), 1, shown).alias("notes"))


def remember(calls: DataFrame, shown: int = SHOWN) -> DataFrame:
    """``(call_id, user_id, answer)``: the answer of each of ``calls (call_id, user_id, args)``, in the order of their numbers.

    A note's id is the number of the call that wrote it. A note that another user names, or
    that is not there, is deleted as little as an unknown one, and the answer is the same.
    """
    rows = stored(parsed(calls), "calls")
    listed = shown_notes(rows, shown).select("call_id", F.posexplode("notes").alias("place", "note_id"))
    texts = rows.filter("kind = 'write'").select(F.col("call_id").alias("note_id"), "content")
    lines = F.array_sort(F.collect_list(F.struct("place", F.struct("note_id", "content").alias("note"))))
    notes = listed.join(texts, "note_id").groupBy("call_id").agg(F.to_json(F.transform(lines, lambda x: x["note"])).alias("notes"))

    def filled(text: str, value: Column) -> Column:
        head, tail = text.split("%s")
        return F.concat(F.lit(head), value, F.lit(tail))

    fixed = {"broken": BROKEN, "no user": NO_USER, "no content": NO_CONTENT, "no id": NO_ID, "delete": DELETED}
    answer = (
        F.when(F.col("kind") == "write", filled(WRITTEN, F.col("call_id").cast("string")))
        .when(F.col("kind") == "list", filled(LISTED, F.coalesce("notes", F.lit("[]"))))
        .when(F.col("kind") == "unknown", filled(UNKNOWN, F.col("operation")))
    )
    for kind, text in fixed.items():
        answer = answer.when(F.col("kind") == kind, text)
    return rows.join(notes, "call_id", "left").select("call_id", "user_id", answer.alias("answer"))
