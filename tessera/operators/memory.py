"""Versioned memory: validation, supersede chains, top-k reads, injection slots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import normalize_dimension, normalize_type
from ..sources.shared import stored
from .messages import newest
from .stacks import links, met

ACTIONS = ("new", "supersede", "skip")


def valid_entry() -> Column:
    return F.coalesce(
        ~F.col("dimension").rlike(r"^\s*$") & ~F.col("content").rlike(r"^\s*$") & F.col("action").isin(*ACTIONS), F.lit(False)
    )


def entries(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid entries, normalised, and the rejected ones as they came."""
    good = df.filter(valid_entry()).withColumns(
        {"dimension": normalize_dimension(F.col("dimension")), "memory_type": normalize_type(F.col("memory_type"))}
    )
    return good, df.filter(~valid_entry())


def supersede(log: DataFrame) -> DataFrame:
    """Each supersede marks and links the row before it; ``skip`` rows are no rows."""
    w = Window.partitionBy("user_id", "dimension").orderBy("id")
    return (
        log.filter("action <> 'skip'")
        .withColumn("supersedes_id", F.when(F.col("action") == "supersede", F.lag("id").over(w)))
        .withColumn("status", F.when(F.lead("action").over(w) == "supersede", "superseded").otherwise("active"))
    )


def supersede_with_deletes(log: DataFrame) -> DataFrame:
    """Deletes between supersedes make the newest row still active a stack's top, see ``stacks.links``.

    A delete counts if it comes after the row it names: then the row leaves the stack unless it was superseded before.
    """
    key = ["user_id", "dimension"]
    rows = log.select(*key, "id", "action", "target")
    gone = rows.filter("action = 'delete' and id > target").groupBy(*key, F.col("target").alias("id")).agg(F.min("id").alias("gone"))
    pushed = met(rows.filter("action in ('new', 'supersede')").drop("target"), gone, [*key, "id"])
    pushed = stored(pushed, "stacks")
    pairs = stored(links(pushed.withColumn("pops", F.col("action") == "supersede"), key), "links")
    taken = pairs.select(*key, F.col("old").alias("id"), F.lit(True).alias("_taken"))
    out = met(met(pushed, pairs, [*key, "id"]), taken, [*key, "id"])
    status = F.when(F.col("_taken"), "superseded").when(F.col("gone").isNotNull(), "deleted").otherwise("active")
    return out.select(*key, "id", status.alias("status"), F.col("old").alias("supersedes_id"))


def chains(rows: DataFrame, key: str = "id", parent: str = "supersedes_id") -> DataFrame:
    """``(id, root, depth, cyclic)``: the end of each row's chain of parents, and the steps to it.

    Pointer doubling: each round a row that still goes on takes over what its parent has
    found, so a chain of n links takes log2(n) rounds of one equi-join. A parent that is no
    row ends the chain. Rows still open when 2 ** rounds exceeds their number are on a cycle
    or lead to one; their root is the smallest id of the cycle and they have no depth.
    ``key`` is unique.
    """
    ids = rows.select(F.col(key).alias("id"), F.col(parent).alias("to"))
    known = ids.select(F.col("id").alias("to"))
    going = F.col("to").isNotNull()
    # to: where the pointer stands, null at the end of a chain; low: the least id passed on the way there.
    # Rows without a pointer stay out of the joins, where all of them would meet in one task.
    first = ids.filter(going).join(known.withColumn("_is", F.lit(True)), "to", "left")
    first = first.select("id", F.when(F.col("_is"), F.col("to")).alias("to"), F.when(F.col("_is"), 1).otherwise(0).cast("long").alias("steps"))
    first = first.unionByName(ids.filter(~going).select("id", "to", F.lit(0).cast("long").alias("steps")))
    first = first.withColumns({"root": F.col("id"), "low": F.col("id")})
    found = stored(first, "chains")
    n, reached = found.filter(going).count(), 1
    while n and reached <= 2 * n:
        ahead = found.select(F.col("id").alias("to"), *(F.col(c).alias(f"_{c}") for c in ("to", "steps", "root", "low")))
        on = found.filter(going).join(ahead, "to").select(
            "id",
            F.col("_to").alias("to"),
            (F.col("steps") + F.col("_steps")).alias("steps"),
            F.col("_root").alias("root"),
            F.least("low", "_low").alias("low"),
        )
        found, reached = stored(on.unionByName(found.filter(~going)), "chains", found), 2 * reached
        if found.filter(going).isEmpty():
            break
    # A pointer that went on longer than there are rows stands on a cycle, and the row it stands on has been all around it.
    around = found.select(F.col("id").alias("to"), F.col("low").alias("_cycle"))
    ended = found.filter(~going).select("id", "root", F.col("steps").alias("depth"), F.lit(False).alias("cyclic"))
    return ended.unionByName(
        found.filter(going).join(around, "to").select("id", F.col("_cycle").alias("root"), F.lit(None).cast("long").alias("depth"), F.lit(True).alias("cyclic"))
    )


def supersede_pairs(rows: DataFrame) -> DataFrame:
    old = rows.select(F.col("id").alias("old_id"), F.col("content").alias("old_content"))
    return rows.filter("supersedes_id is not null").join(old, F.col("supersedes_id") == F.col("old_id")).select(
        "id", "old_id", "content", "old_content"
    )


def soft_delete(memory: DataFrame, deletes: DataFrame) -> DataFrame:
    """Rows named by id and user become deleted, whatever their type."""
    log = deletes.select("id", "user_id").distinct().withColumn("_gone", F.lit(True))
    return memory.join(log, ["id", "user_id"], "left").withColumn(
        "status", F.when(F.col("_gone"), "deleted").otherwise(F.col("status"))
    ).drop("_gone")


def active(memory: DataFrame, *types: str) -> DataFrame:
    rows = memory.filter("status = 'active'")
    return rows.filter(F.col("memory_type").isin(*types)) if types else rows


def injection(memory: DataFrame, facts: int = 5, notes: int = 3) -> DataFrame:
    """Three independent slots per user: newest summary, facts and preferences, notes."""

    def lines(df: DataFrame, name: str, text: Column) -> DataFrame:
        ordered = F.array_sort(F.collect_list(F.struct((-F.col("id")).alias("o"), text.alias("t"))))
        return df.groupBy("user_id").agg(F.array_join(F.transform(ordered, lambda x: x["t"]), "\n").alias(name))

    tagged = F.concat(F.lit("["), F.col("memory_type"), F.lit("/"), F.col("dimension"), F.lit("] "), F.col("content"))
    s = active(memory, "summary").groupBy("user_id").agg(F.max_by("content", "id").alias("summary"))
    f = lines(newest(active(memory, "fact", "preference"), ["user_id"], "id", facts), "facts", tagged)
    n = lines(newest(active(memory, "note"), ["user_id"], "id", notes), "notes", F.col("content"))
    users = memory.select("user_id").distinct()
    return users.join(s, "user_id", "left").join(f, "user_id", "left").join(n, "user_id", "left")



def known_facts(memory: DataFrame, n: int = 20) -> DataFrame:
    """Per user the newest ``n`` active facts and preferences as lines for an extractor."""
    line = F.concat(F.lit("- ["), F.col("dimension"), F.lit("] "), F.col("content"))
    rows = newest(active(memory, "fact", "preference"), ["user_id"], "id", n).select("user_id", "id", line.alias("line"))
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("id")).alias("o"), "line")))
    return rows.groupBy("user_id").agg(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias("known"))
