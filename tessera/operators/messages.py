"""Conversation history: retention, context windows, tool-row hygiene, prompt assembly.

Orders are by a unique id within a session; sessions are partitions, so every
operator scales with the number of sessions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLANK = r"^\s*$"


def scan_session(messages: DataFrame, bot_id: str, user_id, collation: str | None = None) -> DataFrame:
    """A conversation in order; under a ``collation`` the bot is meant however it is spelled (no filter is pushed down then)."""
    bot = F.col("bot_id") if collation is None else F.collate("bot_id", collation)
    return messages.filter((bot == bot_id) & (F.col("user_id") == user_id)).orderBy("id")


def newest(df: DataFrame, keys: Sequence[str], order: str, n: int) -> DataFrame:
    """The ``n`` rows with the largest ``order`` of each key; plans a window group limit."""
    w = Window.partitionBy(*keys).orderBy(F.col(order).desc())
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def retention_deleted(df: DataFrame, keys: Sequence[str], order: str, n: int) -> DataFrame:
    """What retention removes: all but the ``n`` newest rows of each key, in one pass over each."""
    w = Window.partitionBy(*keys).orderBy(F.col(order).desc())
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") > n).drop("_rn")


def cache_trim(df: DataFrame, keys: Sequence[str], order: str, half: int) -> DataFrame:
    """Pairs of the oldest rows go while more than ``2 * half`` are left, so an odd surplus keeps one fewer."""
    w = Window.partitionBy(*keys)
    limit = 2 * half
    n = F.count("*").over(w)
    keep = F.when(n <= limit, n).otherwise(limit - (n - limit) % 2)
    rank = F.row_number().over(w.orderBy(F.col(order).desc()))
    return df.withColumn("_rank", rank).withColumn("_keep", keep).filter("_rank <= _keep").drop("_rank", "_keep")


def usable(df: DataFrame) -> DataFrame:
    return df.filter((F.col("role") != "system") & F.col("content").isNotNull() & ~F.col("content").rlike(BLANK))


def context_window(df: DataFrame, keys: Sequence[str], order: str, n: int = 20) -> DataFrame:
    """One text per session: its newest ``n`` usable messages, oldest first."""
    rows = newest(usable(df), keys, order, n)
    line = F.concat(F.col("role"), F.lit(": "), F.col("content"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("l")))), lambda x: x["l"]), "\n")
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), joined.alias("context"))


def nth_turn(df: DataFrame, key: str, order: str, every: int = 10) -> DataFrame:
    turn = F.row_number().over(Window.partitionBy(key).orderBy(order)).cast("long")
    return df.withColumn("turn_no", turn).filter(F.col("turn_no") % every == 0)


def after_replies(replies: DataFrame, key: str, order: str, every: int = 10) -> DataFrame:
    """``(.., turn_no, step, task)``: what is to be done after each reply, in a key's order: a summary every so many turns, then the extraction.

    ``every`` of 0 or less asks for no summaries.
    """
    turn = F.row_number().over(Window.partitionBy(key).orderBy(order)).cast("long")
    summary = F.col("turn_no") % every == 0 if every > 0 else F.lit(False)
    tasks = F.when(summary, F.array(F.lit("summarize"), F.lit("extract"))).otherwise(F.array(F.lit("extract")))
    return replies.withColumn("turn_no", turn).select("*", F.posexplode(tasks).alias("step", "task"))


def task_outcomes(tasks: DataFrame, key: str, order: str, failed: Column) -> DataFrame:
    """``(key, order, turn_no, ran, ok)``: a failed task ends its turn's work, and the next turn's is done all the same."""
    known = F.coalesce(failed, F.lit(False))
    rows = tasks.select(key, order, "turn_no", "step", "task", F.when(known, F.col("step")).alias("_failed"))
    found = rows.groupBy(key, order, "turn_no").agg(F.array_sort(F.collect_list(F.struct("step", "task"))).alias("_t"), F.min("_failed").alias("_end"))
    done = F.filter("_t", lambda x: F.coalesce(x["step"] <= F.col("_end"), F.lit(True)))
    return found.select(key, order, "turn_no", F.array_join(F.transform(done, lambda x: x["task"]), ",").alias("ran"), F.col("_end").isNull().alias("ok"))


def sanitize_tool_pairs(df: DataFrame, key: str, order: str) -> DataFrame:
    """Tool rows need a call before them (other tool rows aside); calls need a tool row after them."""
    w = Window.partitionBy(key).orderBy(order)
    calls = F.when(F.col("role") != "tool", (F.col("role") == "assistant") & F.col("has_calls"))
    lead_in = F.last(calls, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    first = df.withColumn("_lead", F.coalesce(lead_in, F.lit(False))).filter("role <> 'tool' or _lead").drop("_lead")
    after = F.coalesce(F.lead("role").over(w), F.lit(""))
    second = first.withColumn("_after", after)
    return second.filter(~((F.col("role") == "assistant") & F.col("has_calls")) | (F.col("_after") == "tool")).drop("_after")


def drop_leading_tools(df: DataFrame, key: str, order: str) -> DataFrame:
    """Tool rows before the first row that is neither tool nor system."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    started = F.max(F.when(~F.col("role").isin("tool", "system"), 1).otherwise(0)).over(w)
    return df.withColumn("_on", started).filter("role <> 'tool' or _on = 1").drop("_on")


def last_user_message(df: DataFrame, key: str, order: str) -> DataFrame:
    """Both rules: null contents are skipped, or count as empty."""
    user = F.col("role") == "user"
    return df.groupBy(key).agg(
        F.max_by("content", F.when(user & F.col("content").isNotNull(), F.col(order))).alias("last_with_text"),
        F.max_by(F.coalesce("content", F.lit("")), F.when(user, F.col(order))).alias("last_any"),
    )


def loop_guard(calls: DataFrame, run: str, key: str, order: str, ok: str, cap: int = 15) -> DataFrame:
    """Steps up to and with the first call that succeeds again right after its own last success; ``cap`` at most."""
    step = F.row_number().over(Window.partitionBy(run).orderBy(order)).cast("long") - 1
    again = F.col(ok) & F.coalesce(F.lag(ok).over(Window.partitionBy(run, key).orderBy(order)), F.lit(False))
    rows = calls.withColumn("step", step).withColumn("_again", again)
    stop = F.min(F.when(F.col("_again"), F.col("step"))).over(Window.partitionBy(run))
    return rows.withColumn("_stop", F.coalesce(stop, F.lit(cap))).filter(f"step <= _stop and step < {cap}").drop("_again", "_stop")


def dedupe(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """At-least-once rows once: the smallest ``order`` of each key stays."""
    rest = [c for c in df.columns if c not in keys]
    best = F.min(F.struct(order, *[c for c in rest if c != order])).alias("_b")
    return df.groupBy(*keys).agg(best).select(*keys, *[F.col(f"_b.{c}").alias(c) for c in rest])


def with_system_row(df: DataFrame, key: str, prompt: str) -> DataFrame:
    """A session's stored rows (system rows are never stored) behind one system row."""
    stored = df.filter("role <> 'system'").select(key, F.col("id"), "role", "content")
    head = df.select(key).distinct().select(key, F.lit(0).cast("long").alias("id"), F.lit("system").alias("role"), F.lit(prompt).alias("content"))
    return head.unionByName(stored)


def assemble(parts: Sequence[tuple[int, DataFrame]], key: str, order: str) -> DataFrame:
    """Ordered concatenation: parts by ordinal, rows by ``order`` within them, numbered per key."""
    out = None
    for slot, df in parts:
        rows = df.select(key, F.lit(slot).alias("slot"), F.col(order).alias("_o"), "role", "content")
        out = rows if out is None else out.unionByName(rows)
    place = F.row_number().over(Window.partitionBy(key).orderBy("slot", "_o")).cast("long")
    return out.withColumn("place", place).drop("_o")


def inject_prompt(df: DataFrame, key: str, order: str, prompt: Column | str) -> DataFrame:
    """``prompt`` goes before the first system row's text; sessions without one get a row at place 0."""
    text = F.lit(prompt) if isinstance(prompt, str) else prompt
    first = F.min(F.when(F.col("role") == "system", F.col(order))).over(Window.partitionBy(key))
    rows = df.withColumn("_first", first)
    changed = rows.withColumn(
        "content",
        F.when(F.col(order) == F.col("_first"), F.concat(text, F.lit("\n\n"), F.coalesce("content", F.lit("")))).otherwise(F.col("content")),
    ).select(key, order, "role", "content")
    missing = rows.filter("_first is null").select(key).distinct()
    added = missing.select(key, F.lit(0).cast("long").alias(order), F.lit("system").alias("role"), text.alias("content"))
    return changed.unionByName(added)
